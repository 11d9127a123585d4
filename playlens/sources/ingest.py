"""From collector requests to event-table records.

A request is ``/telemetry?d=<url-encoded JSON object>&_t=<ms>`` plus an identity header, or a POST to ``/telemetry`` with the
object as its body. Parsing is a chain of projections: no shuffle, and the same code runs on a table or on a stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playlens.functions.predicates import is_event
from playlens.sources.event_table import span_records
from playlens.vocabulary import DEFAULT_PREFIX, DEFAULT_SERVICE, KNOWN_EVENTS, UNKNOWN_PLAYER

# --- fixed values -----------------------------------------------------------
# First non-empty ``d`` in the query of a request whose path starts with /telemetry.
PAYLOAD_PATTERN = r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)?/telemetry[^?#]*\?(?:[^#]*?&)?d=([^&#]+)"
# A path that starts with /telemetry.
TELEMETRY_PATTERN = r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)?/telemetry"
# ----------------------------------------------------------------------------


def encoded_payloads(uri: str = "request_uri") -> Column:
    """The encoded payload of a telemetry request in an array; empty for any other request."""
    return F.regexp_extract_all(uri, F.lit(PAYLOAD_PATTERN), F.lit(1))


def resolve_player(header: Column | str, browser: Column | str) -> Column:
    """The trimmed identity header, or else the name the client sent, or else ``unknown``."""
    header = F.col(header) if isinstance(header, str) else header
    browser = F.col(browser) if isinstance(browser, str) else browser
    return F.coalesce(F.nullif(F.trim(header), F.lit("")), F.nullif(browser, F.lit("")), F.lit(UNKNOWN_PLAYER))


def _last_wins(members: str) -> Column:
    """``members`` with one entry per name: as in any JSON reader, the last one counts."""
    names, entries = F.map_keys(members), F.map_entries(members)

    def is_last(entry: Column, index: Column) -> Column:
        return ~F.array_contains(F.slice(names, index + 2, F.size(names)), entry["key"])

    repeated = F.size(F.array_distinct(names)) < F.size(names)
    return F.when(repeated, F.map_from_entries(F.filter(entries, is_last))).otherwise(F.col(members))


def parse_objects(rows: DataFrame, payload: str = "payload") -> DataFrame:
    """``rows`` with ``members``: the members of a JSON object as texts, NULL for any other text.

    Reading the text as the only element of an array rejects what follows a complete object.
    Exploding that array, rather than filtering on a column computed from it, has every payload
    parsed once: a filter would be pushed below the column and parse it again.
    """
    schema = "array<map<string,string>>"
    array = F.from_json(F.concat(F.lit("["), payload, F.lit("]")), schema, {"allowSingleQuotes": "false"})
    parsed = rows.withColumn("elements", array)
    single = F.when(F.size("elements") == 1, F.col("elements"))
    return parsed.select(*rows.columns, F.explode_outer(single).alias("members"))


def payloads(requests: DataFrame) -> Column:
    """The payloads of a request, decoded, in an array: one, or none if it is no telemetry request.

    A table without the columns ``method`` and ``body`` holds GET requests only. The body of a POST is the payload as it is,
    the empty text if it is missing; other methods carry none.
    """
    sent = F.transform(encoded_payloads(), F.try_url_decode)
    if not {"method", "body"} <= set(requests.columns):
        return sent
    posted = F.when(F.col("request_uri").rlike(TELEMETRY_PATTERN), F.array(F.coalesce("body", F.lit(""))))
    return F.when(F.coalesce("method", F.lit("GET")) == "GET", sent).when(F.col("method") == "POST", posted)


def is_post(requests: DataFrame) -> Column:
    return F.coalesce(F.col("method") == "POST", F.lit(False)) if "method" in requests.columns else F.lit(False)


def telemetry_requests(requests: DataFrame) -> DataFrame:
    """Requests that carry a payload, with its text and its members."""
    decoded = requests.select("*", F.explode(payloads(requests)).alias("payload"))
    return parse_objects(decoded)


def event_name(attributes: Column | str, prefix: str = DEFAULT_PREFIX) -> Column:
    attributes = F.col(attributes) if isinstance(attributes, str) else attributes
    return F.concat(F.lit(prefix), F.coalesce(F.try_element_at(attributes, F.lit("event")), F.lit("unknown")))


def stringify_attributes(attributes: Column, player: Column) -> Column:
    """Every attribute but the event name as text, with the resolved player."""
    rest = F.map_filter(attributes, lambda key, _: ~key.isin("event", "player_name"))
    return F.map_concat(rest, F.create_map(F.lit("player_name"), player))


def ingest_requests(requests: DataFrame, *, prefix: str = DEFAULT_PREFIX) -> tuple[DataFrame, DataFrame]:
    """Parsed events, and the requests whose payload could not be parsed.

    The player of a POST comes from the header alone; a name in its body does not count.
    """
    parsed = telemetry_requests(requests)
    members = parsed.where(F.col("members").isNotNull()).withColumn("members", _last_wins("members"))
    player = resolve_player("user_header", F.when(~is_post(requests), F.try_element_at("members", F.lit("player_name"))))
    good = members.withColumn("player_name", player).select(
        "event_id",
        F.col("ts").alias("timestamp"),
        event_name("members", prefix).alias("name"),
        "player_name",
        stringify_attributes(F.col("members"), F.col("player_name")).alias("attributes"),
    )
    quarantine = parsed.where(F.col("members").isNull()).select("event_id", "ts", "request_uri", "payload")
    return good, quarantine


def route_known_events(good: DataFrame, *, prefix: str = DEFAULT_PREFIX) -> DataFrame:
    """Parsed events with a flag for names outside the vocabulary."""
    known = is_event(*KNOWN_EVENTS, prefix=prefix)
    return good.withColumn("event_type", F.col("name")).withColumn("known", known).drop("event_type")


def build_spans(requests: DataFrame, *, service: str = DEFAULT_SERVICE, prefix: str = DEFAULT_PREFIX) -> DataFrame:
    """SPAN records of the event table for the well-formed requests."""
    good, _ = ingest_requests(requests, prefix=prefix)
    return span_records(good, service)


def request_attributes(requests: DataFrame, *, prefix: str = DEFAULT_PREFIX) -> DataFrame:
    """Parsed requests as the rows that instruments count: event name, time and labels."""
    good, _ = ingest_requests(requests, prefix=prefix)
    attribute = lambda name: F.try_element_at("attributes", F.lit(name))
    return good.select(
        "event_id",
        "timestamp",
        F.concat(F.lit(DEFAULT_PREFIX), F.substring("name", F.lit(len(prefix) + 1), F.char_length("name"))).alias("event_type"),
        attribute("level").alias("level"),
        attribute("difficulty").alias("difficulty"),
        attribute("key").alias("key_name"),
        attribute("type").alias("powerup_type"),
        attribute("duration").try_cast("double").alias("duration"),
        attribute("session_duration").try_cast("double").alias("session_duration"),
    )
