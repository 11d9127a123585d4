"""Connected components of a graph that no single machine needs to hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playlens.llm import common


def _stars(edges: DataFrame, small: bool) -> DataFrame:
    """One round of the star rules over edges (u > v): every node's neighbours are hung on its least neighbour.

    The least neighbour is an aggregate with a map-side combine, and the join back is an ordinary one
    that AQE can split, so a node with very many neighbours is not one task's work.
    """
    if small:
        pairs = edges
    else:
        pairs = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = pairs.groupBy("u").agg(F.min("v").alias("least"))
    least = least.select(F.col("u").alias("centre"), F.least("u", "least").alias("least"))
    joined = pairs.join(least, F.col("u") == F.col("centre"))
    if small:
        hung = joined.select(F.explode(F.array("u", "v")).alias("u"), F.col("least").alias("v"))
    else:
        hung = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("least").alias("v"))
    return hung.filter(F.col("u") != F.col("v")).distinct()


def connected_components(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v); the root is the least node of its component.

    Alternating large-star and small-star rounds (Kiveris et al. 2014) end when the edges no longer
    change: every node then hangs on its root. Each round is a written table; no round has more edges than the one before.
    ``rows``, if known, is the number of rows of ``edges``.
    """
    now = edges.filter(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = common.store(now, "edges") if rows is None else common.store_few(now, "edges", rows)
    most, mark = now.count(), None
    while True:
        now = common.store_few(_stars(now, small=False), "large_star", most)
        now = common.store_few(_stars(now, small=True), "small_star", most)
        row = now.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if tuple(row) == mark:
            break
        mark = tuple(row)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
