"""Fixed values shared by producers and queries."""

# --- fixed values -----------------------------------------------------------
SERVICE_KEY = "snow.service.name"  # one resource key that contains dots
DEFAULT_SERVICE = "GAME_SERVICE"
DEFAULT_PREFIX = "game."
DEFAULT_ZONE = "Europe/Stockholm"
UNKNOWN_PLAYER = "unknown"
FIRST_LEVEL = "1-1"

KNOWN_EVENTS = (
    "title_screen",
    "game_start",
    "level_start",
    "game_over",
    "death",
    "level_win",
    "coin",
    "powerup_spawn",
    "game_win",
    "game_over_screen",
    "key_press",
    "session_end",
    "telemetry_init",
)

KEY_NAMES = {37: "left", 38: "up", 39: "right", 40: "down", 65: "A_sprint", 83: "S_jump"}
KEY_REPEAT_MS = 500

CPU = "container.cpu.usage"
MEMORY = "container.memory.usage"
CONNECTIONS = "network.ingress.connections.active"
CONNECTION_RATE = "network.ingress.cps"
SPANS_STARTED = "otel.sdk.span.started"
SPANS_LIVE = "otel.sdk.span.live"
BYTES_PER_MB = 1048576

TIME_RANGES = {"15m": 15, "1h": 60, "6h": 360, "24h": 1440, "all": None}

# Default explicit-bucket bounds of the OpenTelemetry histogram instrument.
HISTOGRAM_BOUNDS = (0, 5, 10, 25, 50, 75, 100, 250, 500, 750, 1000, 2500, 5000, 7500, 10000)
# ----------------------------------------------------------------------------
