"""Merkle manifest of a dataset by a butterfly exchange.

Every row is a leaf: the SHA-256 of its length-prefixed fields. The leaves of a language, in the order of their ids, are cut into
aligned partitions of ``FANOUT ** levels``; one task hashes a partition up to its root. From there on partitions swap roots
round by round: in a round the subtrees of eight aligned groups of partitions meet, every partition sends its node to one
partition of each other group, receives one node of each, and hashes the common parent itself. So ancestors are computed by
all partitions below them, and a partition leaves the last round with its whole upper proof: nothing is sent down again.

Groups at the end of a tree are smaller. The member ``i`` of a group receives from the member ``i mod size`` of each other
group, so a member of a small group sends to several. The trees of the languages meet in the same way: a group is then all
partitions of some languages. A round shuffles eight short rows per partition and is stored, so a lost executor repeats one
round at most. Languages may hold any share of the rows: leaves are ranked by range, and partitions have equal sizes.

A member's list of receivers has eight bytes per partition of the largest sibling group: 8 MB where a language of one
partition meets one of four billion rows.

Results: equal rows are leaves of their own beside one another; a null id comes before all others, as does a null language;
null fields count as ``-``; an empty table has an empty manifest. Columns beyond ``FIELDS`` have no influence.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from playlens.llm.common import lower_ascii, pieces, store
from playlens.operators.ordered import ordered_layout, segment_rank, segment_running

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FANOUT = 8
#: Levels of the tree that one task hashes: partitions of 4096 leaves.
LEVELS = 4
PROOF = "array<struct<left: string, right: string>>"


def _field(column: Column) -> Column:
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def _hash(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def leaf_of(**replaced: Column) -> Column:
    """The leaf of a document; named columns may stand in for its fields."""
    return _hash(F.concat(*[_field(replaced.get(name, F.col(name))) for name in FIELDS]))


def fold(leaf: Column, proof: Column) -> Column:
    """The root that follows from a leaf and the siblings on its way up."""
    return F.aggregate(proof, leaf, lambda node, step: _hash(F.concat(step["left"], node, step["right"])))


def siblings(proof: Column) -> Column:
    """All siblings of a proof as one text, from the leaf's to the root's, left to right."""
    return F.array_join(F.transform(proof, lambda step: F.concat(step["left"], step["right"])), "")


def _parents(nodes: list[str]) -> list[str]:
    return [sha256("".join(nodes[i : i + FANOUT]).encode()).hexdigest() for i in range(0, len(nodes), FANOUT)]


def _climb(leaves: list[str], levels: int | None) -> list[list[str]]:
    """The levels above ``leaves``: as many as asked for, or until one node is left."""
    tree = [leaves]
    while len(tree) <= levels if levels is not None else len(tree[-1]) > 1:
        tree.append(_parents(tree[-1]))
    return tree


def _steps(nodes: list[str]) -> list[dict]:
    """For each node, its siblings to the left and to the right."""
    steps = []
    for start in range(0, len(nodes), FANOUT):
        run = nodes[start : start + FANOUT]
        steps += [{"left": "".join(run[:i]), "right": "".join(run[i + 1 :])} for i in range(len(run))]
    return steps


def _partitions(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """The rows of one partition after the other; they come sorted."""
    key, rows = None, []
    for batch in pieces(batches, 1000):
        for row in batch.to_pylist():
            if (row["lang"], row["block"]) != key:
                if rows:
                    yield rows
                key, rows = (row["lang"], row["block"]), []
            rows.append(row)
    if rows:
        yield rows


def _together(rows: DataFrame) -> DataFrame:
    return rows.repartition("lang", "block").sortWithinPartitions("lang", "block", "rank")


def _roots(leaves: DataFrame, levels: int) -> DataFrame:
    """One row per partition: its node after ``levels`` levels, and its top if it is a whole tree."""
    schema = f"lang string, block bigint, n bigint, node string, top string"
    result = to_arrow_schema(leaves.sparkSession.createDataFrame([], schema).schema)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _partitions(batches):
            hashes = [row["leaf"].hex() for row in rows]
            row = {"lang": rows[0]["lang"], "block": rows[0]["block"], "n": len(rows)}
            row |= {"node": _climb(hashes, levels)[-1][0], "top": _climb(hashes, None)[-1][0]}
            yield pa.RecordBatch.from_pylist([row], schema=result)

    return _together(leaves.select("lang", "block", "rank", "leaf")).mapInArrow(make, schema)


def _trees(blocks: DataFrame) -> DataFrame:
    """One row per language in order: its number, and the numbers of its partitions among all."""
    langs = blocks.groupBy("lang").agg(F.count("*").alias("blocks"))
    layout = ordered_layout(langs, [F.col("lang").asc_nulls_first()])
    numbered = segment_running(layout, [], so_far={"tree": ("sum", F.lit(1)), "until": ("sum", F.col("blocks"))})
    return store(
        numbered.select("lang", "blocks", (F.col("tree") - 1).alias("tree"), (F.col("until") - F.col("blocks")).alias("offset")), "trees"
    )


def _exchange(state: DataFrame, bounds: Column) -> DataFrame:
    """One round. ``bounds``: the first members of the groups that meet, and the end of the last group."""
    digit = F.size(F.filter(F.slice("bounds", 1, F.size("bounds") - 1), lambda first: first <= F.col("member"))) - 1
    own = state.withColumn("bounds", bounds).withColumn("digit", digit)
    mine = F.col("member") - F.get("bounds", F.col("digit"))
    size = F.get("bounds", F.col("digit") + 1) - F.get("bounds", F.col("digit"))

    def receivers(group: Column) -> Column:
        first = F.get("bounds", group)
        last = F.get("bounds", group + 1) - first - 1
        others = F.when(mine <= last, F.transform(F.sequence(mine, F.greatest(mine, last), size), lambda i: first + i))
        return F.when(group == F.col("digit"), F.array("member")).otherwise(F.coalesce(others, F.array().cast("array<bigint>")))

    to = F.flatten(F.transform(F.sequence(F.lit(0), F.size("bounds") - 2), receivers))
    sent = own.select(F.explode(to).alias("to"), "digit", "node", F.struct(*state.columns).alias("state"), "member")
    kept = F.when(F.col("to") == F.col("member"), F.struct("state", "digit"))
    met = sent.groupBy("to").agg(
        F.sort_array(F.collect_list(F.struct("digit", "node"))).alias("met"), F.any_value(kept, F.lit(True)).alias("own")
    )
    nodes = F.transform("met", lambda m: m["node"])
    step = F.struct(
        F.array_join(F.slice(nodes, 1, F.col("own.digit")), "").alias("left"),
        F.array_join(F.slice(nodes, F.col("own.digit") + 2, FANOUT), "").alias("right"),
    )
    return met.select(
        *[F.col(f"own.state.{name}") for name in state.columns if name not in ("node", "path")],
        _hash(F.array_join(nodes, "")).alias("node"),
        F.concat("own.state.path", F.array(step)).cast(PROOF).alias("path"),
    ).select(*state.columns)


def _upper(blocks: DataFrame) -> DataFrame:
    """Partitions with the node their language ends in, the root, and the proof from their own node up."""
    trees = _trees(blocks)
    most = trees.agg(F.max("blocks").alias("blocks"), F.max("tree").alias("tree")).first()
    same = F.col("lang").eqNullSafe(F.col("tree_lang"))
    state = blocks.join(trees.withColumnRenamed("lang", "tree_lang"), same).select(
        "lang",
        "block",
        "tree",
        "blocks",
        "offset",
        (F.col("offset") + F.col("block")).alias("member"),
        F.when(F.col("blocks") == 1, F.col("top")).otherwise(F.col("node")).alias("node"),
        F.array().cast(PROOF).alias("path"),
    )
    width = 1
    while most.blocks and width < most.blocks:
        first = F.expr(f"block div {FANOUT * width} * {FANOUT * width}")
        end = F.least(first + FANOUT * width, F.col("blocks"))
        starts = F.filter(F.transform(F.sequence(F.lit(0), F.lit(FANOUT - 1)), lambda d: first + d * width), lambda at: at < end)
        bounds = F.transform(F.concat(starts, F.array(end)), lambda at: at + F.col("offset"))
        # A tree of one node is done; its partitions wait.
        waiting = state.where(F.col("blocks") <= width)
        state = store(_exchange(state.where(F.col("blocks") > width), bounds).unionByName(waiting), "butterfly")
        width *= FANOUT
    state = state.withColumn("subroot", F.col("node"))
    width = 1
    while most.tree and width <= most.tree:
        groups = trees.groupBy(F.expr(f"tree div {width}").alias("part")).agg(
            F.min("offset").alias("first"), F.max(F.col("offset") + F.col("blocks")).alias("end")
        )
        meeting = groups.groupBy(F.expr(f"part div {FANOUT}").alias("meeting")).agg(
            F.concat(F.sort_array(F.collect_list("first")), F.array(F.max("end"))).alias("given")
        )
        met = state.withColumn("meeting", F.expr(f"tree div {FANOUT * width}")).join(meeting, "meeting").drop("meeting")
        state = store(_exchange(met, F.col("given")).drop("given"), "butterfly")
        width *= FANOUT
    return state.select("lang", "block", "blocks", "subroot", F.col("node").alias("root"), "path")


def manifest(docs: DataFrame, *, carried: dict[str, Column] | None = None, levels: int = LEVELS) -> DataFrame:
    """Every document with its ``leaf``, the ``subroot`` of its language, the ``root``, and the ``proof`` from leaf to root.

    ``carried``: further binary columns, derived from the document, that travel with it.
    """
    carried = carried or {}
    leaves = docs.select(
        F.col("lang").cast("string").alias("lang"),
        "doc_id",
        F.unhex(leaf_of()).alias("leaf"),
        *[column.alias(name) for name, column in carried.items()],
        F.monotonically_increasing_id().alias("row"),
    )
    ranked = segment_rank(leaves, ["lang"], [F.col("doc_id").asc_nulls_first(), "leaf", "row"]).drop("row")
    size = FANOUT**levels
    placed = store(ranked.withColumn("block", F.expr(f"(rank - 1) div {size}")), "leaves")
    upper = store(_upper(store(_roots(placed, levels), "partition_roots")), "upper_proofs")

    # The upper proof of a partition comes as its first row, with rank 0.
    both = placed.unionByName(upper.withColumn("rank", F.lit(0).cast("bigint")), allowMissingColumns=True)
    given = both.schema
    names = ["doc_id", *carried]
    parts = [f"`{name}` {given[name].dataType.simpleString()}" for name in names]
    schema = ", ".join([*parts, "leaf string", "subroot string", "root string", f"proof {PROOF}"])
    result = to_arrow_schema(docs.sparkSession.createDataFrame([], schema).schema)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for head, *rows in _partitions(batches):
            tree = _climb([row["leaf"].hex() for row in rows], None if head["blocks"] == 1 else levels)
            steps = [_steps(nodes) for nodes in (tree[:-1])]
            for start in range(0, len(rows), 500):
                out = []
                for i, row in enumerate(rows[start : start + 500], start):
                    proof = [level[i // FANOUT**k] for k, level in enumerate(steps)] + head["path"]
                    out.append({name: row[name] for name in names} | {"leaf": tree[0][i], "proof": proof})
                    out[-1] |= {"subroot": head["subroot"], "root": head["root"]}
                yield pa.RecordBatch.from_pylist(out, schema=result)

    return _together(both).mapInArrow(make, schema)


def tampered(docs: DataFrame) -> DataFrame:
    """The manifest, checked against documents of which some were changed: where 3 divides the CRC-32 of the id's digits,
    A-Z of the text are lower-cased. A document without an id is not changed. ``verified`` tells whether the leaf that is
    there now still leads to the root."""
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    claimed = F.when(changed, F.unhex(leaf_of(text=lower_ascii(F.col("text")))))
    held = manifest(docs, carried={"claimed": claimed})
    folded = held.withColumn("folded_root", fold(F.coalesce(F.lower(F.hex("claimed")), "leaf"), F.col("proof")))
    return folded.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        _hash(siblings(F.col("proof"))).alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )
