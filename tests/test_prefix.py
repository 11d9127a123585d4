"""Events stored under another prefix give the same answers."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from playlens.operators import projections
from playlens.plans.registry import QUERIES
from playlens.sources.bindings import SPANS, Telemetry, span_attributes
from playlens.sources.event_table import span_records
from playlens.vocabulary import DEFAULT_SERVICE

NAMES = (
    "player_stats event_timeline key_presses deaths_by_level powerups player_sessions game_sessions top_scores leaderboard "
    "event_feed_500 kpi_totals key_throttle_6h counters"
).split()


def telemetry(spark, sf_dir, prefix: str) -> Telemetry:
    out = Telemetry(spark, sf_dir)
    spans = out.bound(SPANS).withColumn("event_type", F.regexp_replace("event_type", "^game\\.", prefix))
    out.event_table = span_records(span_attributes(spans), DEFAULT_SERVICE)
    out.spans = projections.spans(out.event_table, prefix=prefix)
    out.game_events = projections.game_events(out.event_table, prefix=prefix)
    return out


@pytest.mark.parametrize("name", NAMES)
def test_another_prefix_gives_the_same_rows(spark, sf_dir, name, monkeypatch):
    monkeypatch.setattr(projections, "attribute_frame", lambda table, full=projections.attribute_frame: full(table, prefix=chosen[0]))
    results = []
    for prefix in ("game.", "app/"):
        chosen = [prefix]
        results.append(sorted(map(str, QUERIES[name](telemetry(spark, sf_dir, prefix)).collect())))
    assert results[0] == results[1] and results[0]
