"""Key-repeat throttle: keep a key event only if it comes more than ``gap_ms`` after the last
kept one of the same player and key.

Whether an event is kept depends on the last *kept* one, so this is a chain and not a comparison
with the previous row. The chain is cut into slices of time. What a slice does to the chain
depends only on when the last event before it was kept, and only events close to its beginning can
be its first kept one. So:

1. each slice is reduced to its possible first events and the last kept event of each;
2. walking these along the slices of a key tells when the chain was last kept before every slice; the walk may start
   from what was kept before the first one, which lets a stream go on;
3. each slice marks its own events.

Times are whole milliseconds and equal times collapse to one event beforehand, so however much
data one player and key have, a slice of an hour never exceeds 3.6 million events, and its reduced
form never exceeds ``gap_ms`` + 2 rows. Steps 1 and 3 spread a hot key over all its slices. The
tasks work on whole Arrow batches that hold many keys and slices, not on one group at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playlens.functions.predicates import is_event
from playlens.vocabulary import KEY_REPEAT_MS

HOUR_MS = 3_600_000
NEVER = -(1 << 62)  # "nothing kept yet"
KEYS = ("player_name", "key_name")
SLICE = (*KEYS, "slice")


def chain(times: np.ndarray, first: int, gap_ms: int) -> list[int]:
    """Indexes kept in sorted ``times`` when the first kept one is ``first``."""
    following = np.searchsorted(times, times + gap_ms, side="right")
    kept = []
    while first < len(times):
        kept.append(first)
        first = int(following[first])
    return kept


def key_events(spans: DataFrame, slice_ms: int) -> DataFrame:
    """Key presses with their time in whole milliseconds; events of equal time count once."""
    return (
        spans.where(is_event("key_press"))
        .groupBy(*KEYS, F.unix_millis(F.col("timestamp").cast("timestamp")).alias("at_ms"))
        .agg(F.min(F.struct("event_id", "timestamp")).alias("first"))
        .select(*KEYS, "at_ms", "first.event_id", "first.timestamp")
        .withColumn("slice", F.floor(F.col("at_ms") / slice_ms))
    )


def _changes(frame: pd.DataFrame, columns: tuple[str, ...]) -> np.ndarray:
    """Whether each row differs from the one before in ``columns``; missing equals missing."""
    changed = np.zeros(len(frame), dtype=bool)
    changed[:1] = True
    for name in columns:
        codes = pd.factorize(frame[name], use_na_sentinel=False)[0]
        changed[1:] |= codes[1:] != codes[:-1]
    return changed


def _whole_slices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches cut so that no slice is spread over two of them."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if held:
            edge = pd.concat([held[-1].tail(1), batch], ignore_index=True)
            starts = np.flatnonzero(_changes(edge, SLICE)[1:])
        else:
            starts = np.flatnonzero(_changes(batch, SLICE))[1:]
        if len(starts):
            yield pd.concat([*held, batch.iloc[: starts[-1]]], ignore_index=True)
            held = [batch.iloc[starts[-1] :]]
        else:
            held.append(batch)
    if held:
        yield pd.concat(held, ignore_index=True)


def _successors(frame: pd.DataFrame, gap_ms: int, slice_ms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the slice, time within the slice, next event beyond the gap or the row itself)."""
    group = np.cumsum(_changes(frame, SLICE)) - 1
    offset = frame["at_ms"].to_numpy() - frame["slice"].to_numpy() * slice_ms
    # One axis for all slices, with a distance between them that no gap can bridge.
    axis = group * (slice_ms + gap_ms + 1) + offset
    following = np.searchsorted(axis, axis + gap_ms, side="right")
    here = np.arange(len(axis))
    inside = following < len(axis)
    inside[inside] = group[following[inside]] == group[inside]
    return group, offset, np.where(inside, following, here)


def key_throttle(
    spans: DataFrame, *, gap_ms: int = KEY_REPEAT_MS, slice_ms: int = HOUR_MS, kept_before: DataFrame | None = None
) -> DataFrame:
    """The key presses that survive the throttle.

    ``kept_before`` (player, key, ``last_ms``) tells when an event of a key was last kept; an older event is dropped.
    """

    def reduce_slices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in _whole_slices(batches):
            group, offset, jump = _successors(frame, gap_ms, slice_ms)
            while not np.array_equal(jump[jump], jump):
                jump = jump[jump]
            leave = frame["at_ms"].to_numpy()[jump]
            # The chain was last kept before the slice, so it enters within the gap or at the
            # first event after that.
            late = offset > gap_ms
            first_late = late & np.append(True, (~late[:-1]) | (group[1:] != group[:-1]))
            possible = ~late | first_late
            # Neighbouring entries with the same exit are one case: the latest stands for all.
            rows, exits, owner = frame[possible], leave[possible], group[possible]
            turns = np.append((exits[1:] != exits[:-1]) | (owner[1:] != owner[:-1]), True)
            yield rows.loc[turns, list(SLICE)].assign(entry_ms=rows.loc[turns, "at_ms"], exit_ms=exits[turns])

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = number = last = before = None
        for batch in batches:
            heads, kept = [], []
            rows = zip(batch["player_name"], batch["key_name"], batch["slice"], batch["entry_ms"], batch["exit_ms"])
            for i, (player, name, part, entry, leave) in enumerate(rows):
                if (player, name) != key:
                    key, number, last = (player, name), None, NEVER
                if part == NEVER:
                    last = leave
                    continue
                if part != number:
                    number, before = part, last
                    heads.append(i)
                    kept.append(before)
                if last == before and entry > before + gap_ms:
                    last = leave
            yield batch.iloc[heads][list(SLICE)].assign(kept_before_ms=kept)

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in _whole_slices(batches):
            # The first row of a slice is the result of the walk.
            is_event_row = frame["is_event"].to_numpy()
            head = np.maximum.accumulate(np.where(is_event_row, 0, np.arange(len(frame))))
            before = frame["at_ms"].to_numpy()[head][is_event_row]
            events = frame[is_event_row].reset_index(drop=True)
            group, _, jump = _successors(events, gap_ms, slice_ms)
            open_ = np.flatnonzero(events["at_ms"].to_numpy() > before + gap_ms)
            heads = open_[np.unique(group[open_], return_index=True)[1]]
            kept = np.zeros(len(events), dtype=bool)
            while len(heads):
                kept[heads] = True
                heads = jump[heads][jump[heads] != heads]
            yield events.loc[kept, ["event_id", "timestamp", *KEYS]]

    events = key_events(spans, slice_ms)
    key_type = "player_name string, key_name string, slice long"
    reduced = (
        events.select(*SLICE, "at_ms")
        .repartition(*SLICE)
        .sortWithinPartitions(*SLICE, "at_ms")
        .mapInPandas(reduce_slices, f"{key_type}, entry_ms long, exit_ms long")
    )
    if kept_before is not None:
        asked = spans.where(is_event("key_press")).select(*[F.col(name).alias(f"asked_{name}") for name in KEYS]).distinct()
        same = [F.col(name).eqNullSafe(F.col(f"asked_{name}")) for name in KEYS]
        never, last = F.lit(NEVER).cast("bigint"), F.col("last_ms").cast("bigint")
        started = kept_before.join(asked, same, "leftsemi").select(*KEYS, never.alias("slice"), last.alias("entry_ms"), last.alias("exit_ms"))
        reduced = reduced.unionByName(started)
    entered = (
        reduced.repartition(*KEYS)
        .sortWithinPartitions(*SLICE, "entry_ms")
        .mapInPandas(walk, f"{key_type}, kept_before_ms long")
    )
    time_type = spans.schema["timestamp"].dataType.simpleString()
    heads = entered.select(
        *SLICE,
        F.col("kept_before_ms").alias("at_ms"),
        F.lit(0).cast("bigint").alias("event_id"),
        F.lit(None).cast(time_type).alias("timestamp"),
        F.lit(False).alias("is_event"),
    )
    return (
        events.withColumn("is_event", F.lit(True))
        .unionByName(heads)
        .repartition(*SLICE)
        .sortWithinPartitions(*SLICE, "is_event", "at_ms")
        .mapInPandas(mark, f"event_id long, timestamp {time_type}, player_name string, key_name string")
    )
