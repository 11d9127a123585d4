"""Headline timings: one JSON line.

Reads ``BENCH_SF_DIR`` (default sf0.1) on ``local[BENCH_CPUS]``. Each query runs once to warm up,
then ``BENCH_RUNS`` times; the median counts. ``value`` is the sum over all queries.

* plain names: over the stored event table, deriving everything else on the way, with the result
  written to the no-op sink; requests and streams start from the given table itself;
* ``live/...``: dashboard queries over refreshed live tables, as a dashboard would run them;
* ``build/...``: storing the event table and rebuilding the live tables.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from playlens.plans import feeds, registry, rollups, verified
from playlens.plans.live_layer import LiveLayer
from playlens.session import build_session, new_path
from playlens.sources import event_table, live_store
from playlens.sources.bindings import Telemetry

HEADLINE = (
    "game_events",
    "player_stats",
    "event_timeline",
    "key_presses",
    "deaths_by_level",
    "powerups",
    "player_sessions",
    "game_sessions",
    "avg_stats",
    "top_scores_all",
    "leaderboard",
    "kpi_totals",
    "health_check",
    "cpu_usage_all",
    "network_ingress_all",
    "log_health_all",
    "timeline_pivot",
    "event_feed_500",
    "rel_events_keys",
    "key_throttle",
    "ingest_requests",
    "vq_activity_summary",
    "stream_event_timeline",
    "stream_ingest",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = build_session(
        f"local[{cpus}]",
        "playlens-bench",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    given = Telemetry(spark, sf_dir)
    timings: dict[str, float] = {}

    def measure(name, build, times=runs) -> None:
        seconds = []
        for _ in range(times + 1):
            started = time.perf_counter()
            result = build()
            if result is not None:
                result.write.format("noop").mode("overwrite").save()
            seconds.append(time.perf_counter() - started)
        timings[name] = round(statistics.median(seconds[1:]), 4)

    stored = new_path(spark, "bench_event_table")

    def store() -> None:
        event_table.write_event_table(given.event_table, stored, "overwrite", by_day=False)

    measure("build/event_table", store, 1)
    telemetry = Telemetry(spark, sf_dir, event_table.read_event_table(spark, stored))
    for name in HEADLINE:
        measure(name, lambda: registry.QUERIES[name](telemetry))

    layer = LiveLayer(spark, new_path(spark, "bench_layer"))
    layer.append_records(telemetry.event_table)

    def refresh() -> None:
        live_store.refresh_live_tables(telemetry.game_events, layer.folder)

    measure("build/live_tables", refresh, 1)
    measure("build/layer", lambda: layer.refresh(), 1)

    panels = {
        "live/kpi_totals": lambda: rollups.kpi_totals(layer.table("game_events"), layer.table("powerups")),
        "live/kpi_totals_player": lambda: rollups.kpi_totals(layer.table("game_events"), layer.table("powerups"), player=registry.PLAYER),
        "live/deaths_rollup": lambda: rollups.deaths_rollup(layer.table("deaths_by_level")),
        "live/keys_rollup": lambda: rollups.keys_rollup(layer.table("key_presses")),
        "live/powerups_rollup": lambda: rollups.powerups_rollup(layer.table("powerups")),
        "live/event_feed_200": lambda: layer.event_feed(limit=200, as_text=True),
        "live/timeline_500": lambda: feeds.timeline(layer.table("event_timeline"), limit=500),
        "live/leaderboard": lambda: layer.leaderboard(),
        "live/recent_sessions_50": lambda: layer.recent_sessions(),
        "live/vq_event_frequency": lambda: verified.event_frequency(layer.table("game_events")),
        "live/vq_sessions_by_coins": lambda: verified.sessions_by_coins(layer.table("player_sessions")),
        "live/vq_activity_summary": lambda: layer.activity_summary(),
        "live/health_check": lambda: layer.health_check(),
        "live/record_type_counts": lambda: layer.record_type_counts(),
    }
    for name, build in panels.items():
        measure(name, build)

    print(
        json.dumps(
            {
                "metric": "telemetry_queries_total",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": os.path.basename(sf_dir.rstrip("/")),
            }
        )
    )


if __name__ == "__main__":
    main()
