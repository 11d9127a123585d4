"""Session reconstruction: edge cases, and the scalable form against the plain one."""

from __future__ import annotations

import random
import re

import pytest

from helpers import at, plan_of, spans_frame
from playlens.operators import aggregates, sessions


def report(spark, rows, **options):
    frame = sessions.game_sessions(spans_frame(spark, rows), **options)
    return {row["session_id"]: row.asDict() for row in frame.collect()}


def test_earliest_game_over_ends_the_session(spark):
    got = report(
        spark,
        [
            {"t": 0, "event": "game_start", "player_name": "a"},
            {"t": 5, "event": "game_over", "level": "1-2", "coins": 7, "session_duration": 5.04},
            {"t": 6, "event": "game_over", "level": "9-9", "coins": 1, "session_duration": 6.0},
        ],
    )
    assert got[1]["session_end"] == at(5)
    assert (got[1]["final_level"], got[1]["score_coins"], got[1]["duration_seconds"]) == ("1-2", 7, 5.0)


def test_game_over_at_a_start_matches_neither_session(spark):
    got = report(
        spark,
        [
            {"t": 0, "event": "game_start"},
            {"t": 0, "event": "game_over"},
            {"t": 9, "event": "game_start"},
            {"t": 9, "event": "game_over"},
        ],
    )
    assert [got[i]["session_end"] for i in (1, 2)] == [None, None]


def test_first_of_two_simultaneous_starts_stays_open(spark):
    got = report(
        spark,
        [
            {"t": 1, "event": "game_start", "player_name": "a"},
            {"t": 1, "event": "game_start", "player_name": "b"},
            {"t": 3, "event": "game_over"},
            {"t": 4, "event": "death"},
        ],
    )
    assert got[1]["player_name"] == "a" and got[1]["session_end"] is None and got[1]["total_deaths"] == 1
    assert got[2]["player_name"] == "b" and got[2]["session_end"] == at(3) and got[2]["total_deaths"] == 0


def test_open_session_counts_up_to_as_of(spark):
    rows = [
        {"t": 0, "event": "game_start"},
        {"t": 1, "event": "death"},
        {"t": 2, "event": "game_start"},
        {"t": 3, "event": "game_over"},
        {"t": 4, "event": "death"},
        {"t": 8, "event": "death"},
    ]
    assert report(spark, rows)[1]["total_deaths"] == 3
    assert report(spark, rows, as_of=at(4))[1]["total_deaths"] == 2
    assert report(spark, rows, as_of=at(-1))[1]["total_deaths"] == 0


def test_deaths_at_both_ends_count(spark):
    got = report(
        spark,
        [
            {"t": 0, "event": "death"},
            {"t": 0, "event": "game_start"},
            {"t": 5, "event": "game_over"},
            {"t": 5, "event": "death"},
            {"t": 5.001, "event": "death"},
        ],
    )
    assert got[1]["total_deaths"] == 2


def test_session_without_levels_has_defaults(spark):
    got = report(spark, [{"t": 0, "event": "game_start"}, {"t": 5, "event": "game_over"}])
    assert (got[1]["levels_played"], got[1]["highest_level"]) == (0, "1-1")


def test_highest_level_is_the_largest_text(spark):
    rows = [{"t": 0, "event": "game_start"}]
    rows += [{"t": i, "event": "level_start", "level": level} for i, level in enumerate(("10-1", "2-1", "10-1"), start=1)]
    assert report(spark, rows)[1]["highest_level"] == "2-1"
    assert report(spark, rows)[1]["levels_played"] == 2
    closed = report(spark, [*rows, {"t": 9, "event": "game_over"}])
    assert (closed[1]["highest_level"], closed[1]["levels_played"]) == ("2-1", 2)


def test_no_ended_session_means_no_averages(spark):
    spans = spans_frame(spark, [{"t": 0, "event": "game_start", "player_name": "a"}])
    averages = sessions.avg_stats(sessions.game_sessions(spans), aggregates.player_stats(spans))
    assert averages.count() == 0


def test_no_starts_at_all(spark):
    assert report(spark, [{"t": 0, "event": "death"}, {"t": 1, "event": "game_over"}]) == {}


def plain(rows, as_of):
    """The definition by brute force."""
    starts = sorted((r["t"], r["id"]) for r in rows if r["event"] == "game_start")
    of = lambda kind: [r for r in rows if r["event"] == kind]
    result = {}
    for number, (start, _) in enumerate(starts, start=1):
        following = starts[number][0] if number < len(starts) else None
        overs = [r for r in of("game_over") if r["t"] > start and (following is None or r["t"] < following)]
        over = min(overs, key=lambda r: (r["t"], r["id"]), default=None)
        end = over["t"] if over else as_of
        levels = {r["level"] for r in of("level_start") if start <= r["t"] <= end and r["level"]}
        result[number] = (
            over["t"] if over else None,
            over["coins"] if over else None,
            sum(start <= r["t"] <= end for r in of("death")),
            len(levels),
            max(levels, default="1-1"),
        )
    return result


@pytest.mark.parametrize(("seed", "partitions"), [(0, 1), (1, 5), (2, 40), (3, 5), (4, 5), (5, 40)])
def test_equals_brute_force(spark, seed, partitions):
    rng = random.Random(seed)
    kinds = ["game_start", "game_over", "death", "level_start", "key_press"]
    weights = [(1, 1, 1, 1, 1), (1, 20, 5, 5, 1), (20, 1, 5, 5, 1), (1, 0, 30, 9, 0), (0, 1, 1, 1, 1), (3, 3, 0, 9, 0)][seed]
    span = rng.choice([5, 40, 400])
    rows = []
    for number in range(1, 121):
        rows.append(
            {
                "t": rng.randrange(span),
                "id": number,
                "event": rng.choices(kinds, weights)[0],
                "level": rng.choice([None, "1-1", "2-1", "10-1", "3-2"]),
                "coins": rng.randrange(50),
            }
        )
    as_of = rng.choice([span, span // 2])
    spans = spans_frame(spark, [{**row, "event_id": row["id"]} for row in rows])
    got = {
        r["session_id"]: (r["session_end"], r["score_coins"], r["total_deaths"], r["levels_played"], r["highest_level"])
        for r in sessions.game_sessions(spans, as_of=at(as_of), partitions=partitions).collect()
    }
    want = {
        number: (None if end is None else at(end), *rest) for number, (end, *rest) in plain(rows, as_of).items()
    }
    assert got == want


@pytest.mark.parametrize(("seed", "partitions"), [(0, 1), (1, 7), (2, 30)])
def test_timelines_of_players_equal_brute_force(spark, seed, partitions):
    """One player holds half the rows; some events have no player."""
    rng = random.Random(seed)
    rows = [
        {
            "t": rng.randrange(60),
            "id": number,
            "event": rng.choice(["game_start", "game_over", "death", "level_start"]),
            "level": rng.choice([None, "1-1", "2-1", "10-1"]),
            "coins": rng.randrange(50),
            "player_name": rng.choices(["hot", None, "b", "c"], [6, 2, 2, 1])[0],
        }
        for number in range(1, 241)
    ]
    spans = spans_frame(spark, [{**row, "event_id": row["id"]} for row in rows])
    as_of = rng.choice([60, 40])
    report = sessions.game_sessions(spans, as_of=at(as_of), partition_by_player=True, partitions=partitions).collect()
    got = {
        (r["player_name"], r["session_id"]): (r["session_end"], r["score_coins"], r["total_deaths"], r["levels_played"], r["highest_level"])
        for r in report
    }
    want = {}
    for player in {row["player_name"] for row in rows}:
        own = plain([row for row in rows if row["player_name"] == player], as_of)
        want |= {(player, number): (None if end is None else at(end), *rest) for number, (end, *rest) in own.items()}
    assert got == want and len(got) == len(report)


def test_plan_has_no_pairwise_join(spark, sf_dir):
    from playlens.sources.bindings import Telemetry

    plan = plan_of(sessions.game_sessions(Telemetry(spark, sf_dir).spans))
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
    # Single partitions hold the totals per range only: below each is an aggregate by range.
    for piece in plan.split("Exchange SinglePartition")[1:]:
        assert re.search(r"Aggregate\(keys?=\[part#", piece.split("Exchange")[0])
