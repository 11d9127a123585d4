"""The prefix trie of conversations, by ROLLUP over columns of turn ids.

A turn is known by an id, the MD5 of its role and text with the text's bytes beside it; texts are not shuffled. The turns of
a conversation are cut into blocks of ``WIDTH`` columns, and ``GROUP BY block, prior, ROLLUP(t1, ..., t8)`` aggregates all
prefixes of all blocks in one pass: the grouping id tells the length of a prefix. A block after the first is keyed by ``prior``,
the node in which the block before it ended. A node is known by the XOR of two 64-bit hashes of its turns at their places,
so the key of a block follows from running totals, however long a conversation is, and all blocks are rolled up together.

A second ROLLUP, over the nodes, adds up subtrees: a node counts for each of its prefixes. What lies in later blocks is added
at the node that they continue. These totals come from pointer doubling over the blocks, in as many rounds as the number of
blocks of the longest conversation has binary digits.

Keys may hold any share of the rows: turns are numbered by range, a ROLLUP combines in the map tasks, and joins at a node with
many children can be split. The ids of the conversations that end in a node are sorted by range, joined in chunks, and the
chunks of a node pass through its task one after the other.

Results: rows without a conversation id belong to no conversation and are left out; a missing turn number comes first; a
missing role or text is the empty one; rows of equal turn number follow the order of their ids (MD5), repeated rows are turns
of their own; other columns have no influence; an empty table has no conversation and no node.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playlens.llm.common import store, whole_text
from playlens.operators.ordered import ordered_layout, segment_rank, segment_running

#: Turns of one block.
WIDTH = 8
#: Conversation ids joined in one chunk.
CHUNK = 4096
NODE = ["a", "b"]
PRIOR = ["prior_a", "prior_b"]


def turn_id(role: Column, text: Column) -> Column:
    """MD5 of role and text, and the bytes of the text."""
    size = F.octet_length(role).cast("string")
    return F.concat_ws(":", F.md5(F.concat(size, F.lit(":"), role, text).cast("binary")), F.octet_length(text).cast("string"))


def _bytes_of(turn: Column) -> Column:
    return F.coalesce(F.substring_index(turn, ":", -1).cast("bigint"), F.lit(0).cast("bigint"))


def numbered(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, turn): the turns of each conversation, numbered from 1."""
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        "conv_id",
        F.col("turn").alias("at"),
        turn_id(whole_text("role"), whole_text("text")).alias("turn"),
        F.monotonically_increasing_id().alias("row"),
    )
    ranked = segment_rank(turns, ["conv_id"], [F.col("at").asc_nulls_first(), "turn", "row"], "place")
    return store(ranked.select("conv_id", "place", "turn"), "turns")


def members_of(turns: DataFrame) -> DataFrame:
    return turns.select("conv_id").distinct()


def rebuilt(turns: DataFrame) -> DataFrame:
    """Each conversation ``c`` begins with the first ``h`` turns of ``c - c % 5`` in place of its own first ``h``; ``h`` is
    the CRC-32 of the id's digits modulo 9. Numbers may have gaps."""
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9
    convs = members_of(turns).select("conv_id", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % 5).alias("base"))
    first = turns.where(F.col("place") <= 8).withColumnRenamed("conv_id", "base")
    heads = convs.join(first, "base").where(F.col("place") <= F.col("h")).select("conv_id", "place", "turn")
    own = turns.where(F.col("place") > h).select("conv_id", "place", "turn")
    return heads.unionByName(own)


def _mark(turn: Column, depth: Column, lane: str) -> Column:
    """The hash of a turn at its depth."""
    return F.xxhash64(turn, depth) if lane == "a" else F.xxhash64(F.lit(lane), depth, turn)


def _paths(turns: DataFrame) -> DataFrame:
    """Turns with their depth and with the node that they end in."""
    layout = ordered_layout(turns.select("conv_id", "place", "turn"), ["conv_id", "place", "turn"])
    deep = store(segment_running(layout, ["conv_id"], so_far={"depth": ("sum", F.lit(1).cast("bigint"))}), "depths")
    marks = {lane: ("xor", _mark(F.col("turn"), F.col("depth"), lane)) for lane in NODE}
    return store(segment_running(deep, ["conv_id"], so_far=marks).select("conv_id", "depth", "turn", *NODE), "paths")


def _blocks(paths: DataFrame, members: DataFrame, width: int) -> DataFrame:
    """One row per conversation and block: the turns as columns and the node before them. Each conversation has a first block."""
    before = {
        f"prior_{lane}": F.when(F.col("slot") == 1, F.col(lane).bitwiseXOR(_mark(F.col("turn"), F.col("depth"), lane))) for lane in NODE
    }
    at = paths.withColumns({"block": F.expr(f"(depth - 1) div {width}"), "slot": (F.col("depth") - 1) % width + 1})
    none = members.select(
        "conv_id", F.lit(0).cast("bigint").alias("block"), *[F.lit(0).cast("bigint").alias(name) for name in PRIOR]
    )
    rows = at.select("conv_id", "block", "slot", "turn", *[column.alias(name) for name, column in before.items()])
    return (
        rows.unionByName(none, allowMissingColumns=True)
        .groupBy("conv_id", "block")
        .agg(
            *[F.max(name).alias(name) for name in PRIOR],
            *[F.max(F.when(F.col("slot") == slot, F.col("turn"))).alias(f"t{slot}") for slot in range(1, width + 1)],
        )
    )


def _rollup(rows: DataFrame, width: int, aggregates: str) -> DataFrame:
    """Aggregates for every prefix of every block; ``slot`` is the length of the prefix.

    A prefix of length 0 repeats the node that the block continues, but for the root. A prefix that ends in a missing turn
    stands for shorter sequences and is no node.
    """
    columns = ", ".join(f"t{slot}" for slot in range(1, width + 1))
    rolled = rows.sparkSession.sql(
        f"""SELECT block, prior_a, prior_b, {columns}, {width} - bit_count(grouping_id()) AS slot, {aggregates}
            FROM {{rows}} GROUP BY block, prior_a, prior_b, ROLLUP({columns})""",
        rows=rows,
    )
    last = F.get(F.array(*[f"t{slot}" for slot in range(1, width + 1)]), F.col("slot") - 1)
    kept = rolled.withColumn("turn", last).where(F.when(F.col("slot") == 0, F.col("block") == 0).otherwise(F.col("turn").isNotNull()))
    return kept.withColumn("depth", F.col("block") * width + F.col("slot"))


def _nodes(blocks: DataFrame, width: int) -> DataFrame:
    """One row per node: its turns in its block, its key and its parent's, its members and the smallest of them."""

    def key(lane: str, upto: Column) -> Column:
        node = F.col(f"prior_{lane}")
        for slot in range(1, width + 1):
            mark = F.when(F.lit(slot) <= upto, _mark(F.col(f"t{slot}"), F.col("block") * width + slot, lane))
            node = node.bitwiseXOR(F.coalesce(mark, F.lit(0).cast("bigint")))
        return node

    rolled = _rollup(blocks, width, "count(*) AS n_convs, min(conv_id) AS conv_id")
    return store(
        rolled.select(
            "*",
            *[key(lane, F.col("slot")).alias(lane) for lane in NODE],
            *[F.when(F.col("slot") > 0, key(lane, F.col("slot") - 1)).alias(f"parent_{lane}") for lane in NODE],
            ((F.col("n_convs") - 1) * _bytes_of(F.col("turn"))).alias("saved"),
        ).drop("turn"),
        "trie_nodes",
    )


def _family(nodes: DataFrame) -> DataFrame:
    """Nodes with the number of their children and their parent's smallest member."""
    up = ["parent_a", "parent_b"]
    children = nodes.where("slot > 0").groupBy(*up).agg(F.count("*").alias("n_children"))
    counted = nodes.join(children.toDF(*NODE, "n_children"), NODE, "left")
    parents = nodes.select(*NODE, "conv_id").toDF(*up, "parent_conv_id")
    zero = F.lit(0).cast("bigint")
    return store(
        counted.join(parents, up, "left")
        .drop(*up)
        .withColumns({"n_children": F.coalesce("n_children", zero), "leaves": F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("bigint")}),
        "trie_families",
    )


def _continued(nodes: DataFrame, width: int, most_blocks: int) -> DataFrame:
    """For each node that later blocks continue, what lies in all blocks below it: (a, b, more_leaves, more_saved)."""
    sums = [F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")]
    own = nodes.where("block > 0").groupBy(*PRIOR).agg(*sums).toDF(*NODE, "leaves", "saved")
    ends = nodes.where(f"slot = {width}").select(*NODE, *[F.when(F.col("block") > 0, F.col(name)).alias(f"up_{name[-1]}") for name in PRIOR])
    state, up = own.join(ends, NODE), ["up_a", "up_b"]
    for _ in range(most_blocks.bit_length()):
        state = store(state, "trie_blocks")
        gains = state.where("up_a IS NOT NULL").groupBy(*up).agg(*sums).toDF(*NODE, "more_leaves", "more_saved")
        beyond = state.select(*NODE, *up).toDF(*up, "next_a", "next_b")
        state = (
            state.join(gains, NODE, "left")
            .join(beyond, up, "left")
            .select(
                *NODE,
                (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("leaves"),
                (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved"),
                F.col("next_a").alias("up_a"),
                F.col("next_b").alias("up_b"),
            )
        )
    return state.select(*NODE, F.col("leaves").alias("more_leaves"), F.col("saved").alias("more_saved"))


def _ends(paths: DataFrame, members: DataFrame) -> DataFrame:
    """(a, b, ends_sha256) for each node in which conversations end."""
    zero = F.lit(0).cast("bigint")
    none = members.select("conv_id", zero.alias("depth"), *[zero.alias(lane) for lane in NODE])
    last = paths.drop("turn").unionByName(none).groupBy("conv_id").agg(F.max_by(F.struct(*NODE), "depth").alias("end"))
    layout = ordered_layout(last.select("conv_id", "end.*"), [*NODE, "conv_id"])
    chunks = layout.groupBy("part", *NODE, F.expr(f"pos div {CHUNK}").alias("chunk")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids")
    )

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(node, state) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"a": [node[0]], "b": [node[1]], "ends_sha256": [state.hexdigest()]})

        node = state = None
        for batch in batches:
            for a, b, ids in zip(*[batch.column(name) for name in (*NODE, "ids")]):
                if (a.as_py(), b.as_py()) != node:
                    if node:
                        yield row(node, state)
                    node, state = (a.as_py(), b.as_py()), sha256()
                else:
                    state.update(b",")
                state.update(ids.as_py().encode())
        if node:
            yield row(node, state)

    together = chunks.repartition(*NODE).sortWithinPartitions(*NODE, "part", "chunk")
    return together.select(*NODE, "ids").mapInArrow(digest, "a bigint, b bigint, ends_sha256 string")


def trie(turns: DataFrame, members: DataFrame, *, width: int = WIDTH) -> DataFrame:
    """The nodes of the trie of ``turns`` (conv_id, place, turn), of which ``members`` lists the conversations.

    One row per node: ``conv_id``, its smallest member, which with ``depth`` names the node; ``parent_conv_id``; ``n_convs``,
    members; ``n_children``; ``n_leaves``, childless nodes below or the node itself; ``saved_tokens``, bytes that a trie saves
    from here on; ``ends_sha256``, digest of the members that end here.
    """
    paths = _paths(turns)
    blocks = store(_blocks(paths, members, width), "trie_rows")
    nodes = _family(_nodes(blocks, width))
    most = blocks.agg(F.max("block").alias("block")).first().block or 0
    more = _continued(nodes, width, most)
    added = {name: F.col(name) + F.coalesce(f"more_{name}", F.lit(0)) for name in ("leaves", "saved")}
    rows = nodes.join(more, NODE, "left").withColumns(added)
    own = "named_struct('conv_id', conv_id, 'parent_conv_id', parent_conv_id, 'n_convs', n_convs, 'n_children', n_children, 'a', a, 'b', b)"
    summed = _rollup(
        rows.withColumnRenamed("slot", "own_slot"),
        width,
        f"sum(leaves) AS n_leaves, sum(saved) AS saved_tokens, min_by({own}, own_slot) AS node",
    )
    found = summed.select("node.*", "depth", "n_leaves", "saved_tokens").join(_ends(paths, members), NODE, "left")
    return found.select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        "n_children",
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the conversations as they are."""
    turns = numbered(conversations)
    return trie(turns, members_of(turns))


def rebuilt_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations."""
    turns = numbered(conversations)
    return trie(rebuilt(turns), members_of(turns))
