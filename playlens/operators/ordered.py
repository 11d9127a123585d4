"""Global order without a single partition.

A window without partition keys would pull all rows into one task. Here rows are range
partitioned by the full order instead, numbered inside each range, and stored; what a range needs
to know about the ranges before it is one row of totals per range. The number of ranges is the
number of shuffle partitions, so the totals are small whatever the size of the data. The order
must be total (end it with a unique column); then even rows that share their first order value
are spread over several ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from playlens.session import materialise

ROW_BITS = 33  # monotonically_increasing_id keeps the row number of a partition in the low 33 bits


def _so_far(spec: WindowSpec) -> WindowSpec:
    return spec.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def forward() -> WindowSpec:
    """The rows of a range up to this one."""
    return _so_far(Window.partitionBy("part").orderBy("pos"))


def backward() -> WindowSpec:
    """The rows of a range from its end back to this one."""
    return _so_far(Window.partitionBy("part").orderBy(F.desc("pos")))


def before(spec: WindowSpec) -> WindowSpec:
    """The same without the row itself."""
    return spec.rowsBetween(Window.unboundedPreceding, -1)


def parts_before() -> WindowSpec:
    """For the totals, one row per range: all earlier ranges."""
    return before(Window.orderBy("part"))


def parts_after() -> WindowSpec:
    """For the totals, one row per range: all later ranges."""
    return before(Window.orderBy(F.desc("part")))


def parts_all() -> WindowSpec:
    """For the totals, one row per range: all ranges."""
    return Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def ordered_layout(df: DataFrame, order: list, *, partitions: int | None = None) -> DataFrame:
    """``df`` in global order, with ``part`` (range) and ``pos`` (row in the range), stored.

    The range limits come from a sample, for which Spark evaluates its input once more than for
    the shuffle. ``df`` is therefore stored first, so that the source is read once. Storing the
    result pins the limits for every later use.
    """
    rows = materialise(df, "unordered")
    ranged = rows.repartitionByRange(partitions, *order) if partitions else rows.repartitionByRange(*order)
    numbered = ranged.sortWithinPartitions(*order).withColumn("row_id", F.monotonically_increasing_id())
    return materialise(
        numbered.withColumn("part", F.shiftright("row_id", ROW_BITS).cast("int"))
        .withColumn("pos", F.col("row_id").bitwiseAND(F.lit((1 << ROW_BITS) - 1)))
        .drop("row_id"),
        "ordered",
    )


def per_part(layout: DataFrame, totals: dict[str, Column]) -> DataFrame:
    """One row per range with the given aggregates."""
    return layout.groupBy("part").agg(*[column.alias(name) for name, column in totals.items()])


def with_parts(layout: DataFrame, parts: DataFrame) -> DataFrame:
    """Attach what was derived per range; as many rows as there are shuffle partitions."""
    return layout.join(F.broadcast(parts), "part")


# Totals that merge from partial results: how a group, and how two partial results, combine.
COMBINE = {
    "sum": (F.sum, lambda a, b: F.coalesce(a + b, a, b)),
    "xor": (F.bit_xor, lambda a, b: F.coalesce(a.bitwiseXOR(b), a, b)),
    "max": (F.max, F.greatest),
    "min": (F.min, F.least),
}


def segment_edges(layout: DataFrame, keys: list[str], totals: dict[str, tuple[str, Column]]) -> DataFrame:
    """What the earlier and the later ranges hold of the segments that a range limit cuts.

    A segment is all rows of one key; ``layout`` is ordered by ``keys`` first. Only the first and the last segment of a
    range go on in another one, so there are at most two rows per range, however many keys there are and however many
    ranges one key fills. Columns: part, keys, ``<name>_earlier`` and ``<name>_later``.
    """
    partial = {name: COMBINE[kind][0](value) for name, (kind, value) in totals.items()}
    ends = layout.groupBy("part").agg(F.max("pos").alias("part_end"))
    segments = layout.groupBy("part", *keys).agg(
        F.min("pos").alias("from_pos"), F.max("pos").alias("to_pos"), *[column.alias(name) for name, column in partial.items()]
    )
    edges = segments.join(F.broadcast(ends), "part").where((F.col("from_pos") == 0) | (F.col("to_pos") == F.col("part_end")))
    earlier = before(Window.partitionBy(*keys).orderBy("part"))
    later = before(Window.partitionBy(*keys).orderBy(F.desc("part")))
    return edges.select(
        "part",
        *keys,
        *[COMBINE[kind][0](name).over(earlier).alias(f"{name}_earlier") for name, (kind, _) in totals.items()],
        *[COMBINE[kind][0](name).over(later).alias(f"{name}_later") for name, (kind, _) in totals.items()],
    )


def segment_running(
    layout: DataFrame,
    keys: list[str],
    *,
    so_far: dict[str, tuple[str, Column]] | None = None,
    until: dict[str, tuple[str, Column]] | None = None,
    from_here: dict[str, tuple[str, Column]] | None = None,
) -> DataFrame:
    """``layout`` with running totals per key: ``so_far`` up to the row, ``until`` before it, ``from_here`` from it on.

    Rows are shuffled by range and key, so one key with much of the data still spans many tasks; totals are carried
    between the ranges of a key by ``segment_edges``. Missing keys are one key. A total without a value is null.
    """
    rows = Window.partitionBy("part", *keys).orderBy("pos")
    onward = _so_far(Window.partitionBy("part", *keys).orderBy(F.desc("pos")))
    asked = [(so_far or {}, _so_far(rows), "earlier"), (until or {}, before(rows), "earlier"), (from_here or {}, onward, "later")]
    edges = segment_edges(layout, keys, {name: total for totals, _, _ in asked for name, total in totals.items()})
    local = layout.select(
        "*", *[COMBINE[kind][0](value).over(frame).alias(name) for totals, frame, _ in asked for name, (kind, value) in totals.items()]
    )
    carried = edges.select(*[F.col(name).alias(f"edge_{name}") for name in edges.columns])
    same = F.col("part") == F.col("edge_part")
    for key in keys:
        same = same & F.col(key).eqNullSafe(F.col(f"edge_{key}"))
    merged = {name: (kind, f"edge_{name}_{side}") for totals, _, side in asked for name, (kind, _) in totals.items()}
    return local.join(F.broadcast(carried), same, "left").select(
        *layout.columns, *[COMBINE[kind][1](F.col(name), F.col(other)).alias(name) for name, (kind, other) in merged.items()]
    )


def segment_rank(df: DataFrame, keys: list[str], order: list, name: str = "rank", *, partitions: int | None = None) -> DataFrame:
    """``df`` with its row number from 1 within each key, in ``order``; keys may be missing and may hold most rows."""
    layout = ordered_layout(df, [*[F.col(key).asc_nulls_first() for key in keys], *order], partitions=partitions)
    return segment_running(layout, keys, so_far={name: ("sum", F.lit(1).cast("bigint"))}).drop("part", "pos")


def global_rank(df: DataFrame, order: list, name: str = "rank", *, partitions: int | None = None) -> DataFrame:
    """``df`` with its row number in ``order``, from 1."""
    layout = ordered_layout(df, order, partitions=partitions)
    parts = per_part(layout, {"n": F.count("*")}).select(
        "part", F.coalesce(F.sum("n").over(parts_before()), F.lit(0)).alias("before")
    )
    return with_parts(layout, parts).withColumn(name, F.col("before") + F.col("pos") + 1).drop("part", "pos", "before")


def global_lead(df: DataFrame, column: str, order: list, name: str, *, partitions: int | None = None) -> DataFrame:
    """``df`` with the value of ``column`` in the next row of ``order``."""
    layout = ordered_layout(df, order, partitions=partitions)
    parts = per_part(layout, {"head": F.min_by(F.struct(column), "pos"), "n": F.count("*")}).select(
        "part", "n", F.lead("head").over(Window.orderBy("part"))[column].alias("next_head")
    )
    inside = F.lead(column).over(Window.partitionBy("part").orderBy("pos"))
    value = F.when(F.col("pos") == F.col("n") - 1, F.col("next_head")).otherwise(F.col("inside"))
    return (
        with_parts(layout.withColumn("inside", inside), parts)
        .withColumn(name, value)
        .drop("part", "pos", "inside", "n", "next_head")
    )


def assign_interval(
    points: DataFrame,
    intervals: DataFrame,
    *,
    point: str,
    start: str,
    end: str,
    point_id: str,
    carry: list[str],
    closed: bool = True,
    partitions: int | None = None,
) -> DataFrame:
    """Points with the ``carry`` columns of the interval that holds them.

    Intervals must not overlap. ``closed`` includes both ends. A point can only lie in the last
    interval that starts before it, so one pass in time order finds it: no pair of a point and a
    wrong interval is ever formed. Points in no interval are left out.
    """
    interval = F.struct(F.col(start).alias("start"), F.col(end).alias("end"), *carry)
    nothing = F.lit(None)
    starts = intervals.select(
        F.col(start).alias("at"),
        F.lit(0 if closed else 1).alias("kind"),
        nothing.cast(points.schema[point_id].dataType).alias("id"),
        interval.alias("interval"),
        nothing.cast(points.schema).alias("point"),
    )
    rows = points.select(
        F.col(point).alias("at"),
        F.lit(1 if closed else 0).alias("kind"),
        F.col(point_id).alias("id"),
        nothing.cast(starts.schema["interval"].dataType).alias("interval"),
        F.struct(*points.columns).alias("point"),
    )
    layout = ordered_layout(starts.unionByName(rows), ["at", "kind", "id"], partitions=partitions)
    parts = per_part(layout, {"latest": F.max("interval")}).select(
        "part", F.max("latest").over(parts_before()).alias("before")
    )
    latest = F.coalesce(F.max("interval").over(forward()), F.col("before"))
    inside = F.col("at") <= F.col("held.end") if closed else F.col("at") < F.col("held.end")
    return (
        with_parts(layout, parts)
        .withColumn("held", latest)
        .where(F.col("point").isNotNull() & inside)
        .select("point.*", *[F.col(f"held.{name}").alias(name) for name in carry])
    )

