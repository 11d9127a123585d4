"""Mixing sources to target weights.

Each source's words are packed into blocks of fixed length; a mix is a sequence of output slots, each
of which takes one block. The slots of a source in all shards together follow its target; how many of them a
shard gets is drawn as a multinomial with these totals held (groups of shards get their even part, shards
inside a group draw from it). A source's slots are numbered; slot ``t`` takes the block with index ``permutation(t)``: every
pass over the source is its own pseudorandom permutation (a keyed Feistel network), so blocks repeat only
when the source is used up, and nothing is shuffled to be ordered. Slots and blocks meet by index.

Reruns agree: everything follows from the ids, the sizes and the seed.

Defined results: a null or empty text has size zero and is never taken; a null source is a source of its own, after all
others; a null id sorts before all others; rows that share an id are told apart by their texts, rows that repeat both
share what is taken evenly, the first ones one word more; an empty table gives no rows; other columns are kept only
by ``mixed_documents``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from playlens.llm import common

WEIGHTS, MOST_PASSES, BLOCK_WORDS, SEED = (5, 2, 1), 3, 32, 20240229
SHARD_SLOTS, GROUP_SHARDS = 1024, 32
#: Documents that are packed one after the other into one stream of blocks.
STREAM_DOCS = 2_000
#: Sources are listed on the driver; more than this many are refused.
MOST_SOURCES = 100_000
NO_ID = -(1 << 63)


def targets(sizes: list[int], weights: tuple[float, ...] = WEIGHTS, most: float = MOST_PASSES) -> list[float]:
    """Words of each source: its weight's share of all words, at most ``most`` times its size.

    What is over a source's bound is shared anew by weight among the others until none is above.
    """
    weight = [weights[i % len(weights)] for i in range(len(sizes))]
    bound, open_ones, total = [most * size for size in sizes], set(range(len(sizes))), sum(sizes)
    out = [0.0] * len(sizes)
    while open_ones:
        rest = total - math.fsum(bound[i] for i in range(len(sizes)) if i not in open_ones)
        unit = sum(weight[i] for i in open_ones)
        shares = {i: rest * weight[i] / unit for i in open_ones}
        full = {i for i in open_ones if shares[i] > bound[i]}
        for i in open_ones:
            out[i] = bound[i] if i in full else shares[i]
        if not full:
            break
        open_ones -= full
    return out


def _documents(docs: DataFrame) -> DataFrame:
    """(doc, tie, source, size, copies): one row per different document."""
    schema = pa.schema([("doc", pa.int64()), ("tie", pa.int64()), ("source", pa.string()), ("size", pa.int64())])

    def make(batch: pa.RecordBatch) -> dict:
        doc, tie, source, raw = (batch.column(i) for i in range(4))
        return {"doc": doc, "tie": tie, "source": source, "size": [len(text.as_py().split()) for text in raw]}

    raw = common.whole_text().cast("binary")
    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"),
        F.xxhash64(raw).alias("tie"),
        F.col("source").cast("string").alias("source"),
        raw.alias("raw"),
    ).mapInArrow(common.arrow_rows(schema, make), "doc bigint, tie bigint, source string, size bigint")
    return rows.groupBy("doc", "tie", "source", "size").agg(F.count(F.lit(1)).alias("copies"))


class Plan:
    """Sizes, targets, blocks and slots of every source."""

    def __init__(self, sizes: DataFrame, weights, most, block_words, seed):
        """``sizes``: (doc, tie, source, size, copies), a written table."""
        self.spark, self.sizes, self.block_words, self.seed = sizes.sparkSession, sizes, block_words, seed
        found = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("words"), F.count(F.lit(1)).alias("docs"))
        rows = found.limit(MOST_SOURCES + 1).collect()
        if len(rows) > MOST_SOURCES:
            raise ValueError(f"more than {MOST_SOURCES} sources")
        rows.sort(key=lambda row: (row.source is None, (row.source or "").encode()))
        self.words = [row.words for row in rows]
        self.targets = targets(self.words, weights, most)
        self.sources = self.spark.createDataFrame(
            [
                (row.source, number, row.words, float(target), -(-row.docs // STREAM_DOCS))
                for number, (row, target) in enumerate(zip(rows, self.targets, strict=True))
            ],
            "source string, number int, source_size bigint, target double, streams bigint",
        )
        self.pieces = common.store(self._pieces(), "pieces")
        counts = self.pieces.groupBy("number").agg((F.max("block") + 1).alias("blocks")).collect()
        self.blocks = {row.number: row.blocks for row in counts}
        # As many slots as hold the target's words: blocks are full but for the last of each stream.
        self.slots = [
            round(target * self.blocks.get(number, 0) / words) if words else 0
            for number, (words, target) in enumerate(zip(self.words, self.targets, strict=True))
        ]

    def _pieces(self) -> DataFrame:
        """(doc, tie, number, block, begin, words): which words of a document stand in which block of its source.

        A source is packed as streams of about ``STREAM_DOCS`` documents, so that none of them outgrows a task; the
        blocks of its streams are numbered one after the other.
        """
        known = self.sizes.join(F.broadcast(self.sources), self.sizes.source.eqNullSafe(self.sources.source))
        known = known.filter("size > 0").select(
            "doc", "tie", "number", (F.col("size") * F.col("copies")).alias("words"), F.pmod(F.xxhash64("doc", "tie"), "streams").alias("stream")
        )
        block = self.block_words
        totals = known.groupBy("number", "stream").agg(F.sum("words").alias("in_stream"))
        before = F.sum(F.ceil(F.col("in_stream") / block)).over(Window.partitionBy("number").orderBy("stream"))
        totals = totals.select("number", "stream", (before - F.ceil(F.col("in_stream") / block)).alias("base"))
        order = Window.partitionBy("number", "stream").orderBy("doc", "tie").rowsBetween(Window.unboundedPreceding, 0)
        at = known.withColumn("at", F.sum("words").over(order) - F.col("words")).join(totals, ["number", "stream"])
        end = F.col("at") + F.col("words")
        own = at.select(
            "*", F.explode(F.sequence(F.floor(F.col("at") / block), F.floor((end - 1) / block))).alias("in_block")
        )
        start = F.greatest(F.col("at"), F.col("in_block") * block)
        stop = F.least(end, (F.col("in_block") + 1) * block)
        return own.select(
            "doc", "tie", "number", (F.col("base") + F.col("in_block")).alias("block"), (start - F.col("at")).alias("begin"), (stop - start).alias("words")
        )

    def slot_table(self) -> DataFrame:
        """(shard, number, slot, block): what every slot of every output shard takes."""
        slots, blocks, seed = self.slots, dict(self.blocks), self.seed
        per_group = SHARD_SLOTS * GROUP_SHARDS
        groups = -(-sum(slots) // per_group) or 1

        def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for group in (g for batch in batches for g in batch.column(0).to_pylist()):
                first = np.array([n * group // groups for n in slots], np.int64)
                left = np.array([n * (group + 1) // groups for n in slots], np.int64) - first
                random = np.random.default_rng([seed, group])
                shards = max(1, -(-int(left.sum()) // SHARD_SLOTS))
                for shard in range(shards):
                    size = int(left.sum()) // (shards - shard)
                    drawn = random.multivariate_hypergeometric(left, size, method="marginals") if shard < shards - 1 else left.copy()
                    for number in np.flatnonzero(drawn).tolist():
                        taken = np.arange(first[number], first[number] + drawn[number])
                        places = permuted(taken, blocks[number], seed, number)
                        fields = [np.full(len(taken), group * GROUP_SHARDS * 2 + shard), np.full(len(taken), number), taken, places]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(x, t) for x, t in zip(fields, (pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)],
                            names=["shard", "number", "slot", "block"],
                        )
                    first, left = first + drawn, left - drawn

        spread = self.spark.range(groups, numPartitions=max(1, min(groups, 4096)))
        return spread.mapInArrow(draw, "shard bigint, number int, slot bigint, block bigint")

    def mixed_pieces(self) -> DataFrame:
        """(shard, slot, number, doc, tie, begin, words): the contents of every slot."""
        slots = self.slot_table()
        return slots.hint("merge").join(self.pieces, ["number", "block"]).select("shard", "slot", "number", "doc", "tie", "begin", "words")

    def uses(self) -> DataFrame:
        """(doc, tie, number, begin, words, uses): how often the mix takes each piece of a document."""
        used = self.slot_table().groupBy("number", "block").agg(F.count(F.lit(1)).alias("uses"))
        # Spark takes what comes from a short range for small; it grows with the input and must not be broadcast.
        return self.pieces.join(used.hint("merge"), ["number", "block"]).select("doc", "tie", "number", "begin", "words", "uses")


def permuted(slots: np.ndarray, blocks: int, seed: int, number: int) -> np.ndarray:
    """The block of each slot: slots of one pass over a source take each of its blocks once, in pseudorandom order.

    A Feistel network of four rounds permutes the least square of a power of two that holds all blocks; values
    beyond the blocks are permuted again until they fall among them.
    """
    half = max(1, (max(1, blocks - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    passes, out = (slots // blocks).astype(np.uint64), (slots % blocks).astype(np.uint64)
    key = np.uint64((seed * 0x9E3779B97F4A7C15 + number * 0xD1B54A32D192ED03) & (2**64 - 1)) + passes * np.uint64(0x8CB92BA72F3D8DD7)
    todo = np.arange(len(slots))
    while len(todo):
        left, right = out[todo] >> np.uint64(half), out[todo] & mask
        for turn in range(4):
            x = (right + np.uint64(turn + 1)) * np.uint64(0xBF58476D1CE4E5B9) ^ key[todo]
            x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((x ^ (x >> np.uint64(29))) & mask)
        out[todo] = (left << np.uint64(half)) | right
        todo = todo[out[todo] >= np.uint64(blocks)]
    return out.astype(np.int64)


def plan(docs: DataFrame, weights=WEIGHTS, most=MOST_PASSES, block_words: int = BLOCK_WORDS, seed: int = SEED) -> Plan:
    """Read every text once for its size, then plan the mix from the sizes."""
    return Plan(common.store(_documents(docs), "sizes"), weights, most, block_words, seed)


def _even(total: Column, copies: Column, copy: Column) -> Column:
    """The share of one of ``copies`` equal rows."""
    base = F.floor(total / copies)
    return (base + F.when(copy <= F.pmod(total, copies), 1).otherwise(0)).cast("long")


def taken(mix: Plan) -> DataFrame:
    """(doc_id, size, source_size, target, taken), one row per document."""
    used = mix.uses().groupBy("doc", "tie").agg(F.sum(F.col("words") * F.col("uses")).alias("taken_words"))
    sizes = mix.sizes.join(F.broadcast(mix.sources), mix.sizes.source.eqNullSafe(mix.sources.source)).join(used.hint("merge"), ["doc", "tie"], "left")
    rows = sizes.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    total = F.coalesce("taken_words", F.lit(0))
    return rows.select(
        F.nullif("doc", F.lit(NO_ID)).alias("doc_id"), "size", "source_size", "target", _even(total, F.col("copies"), F.col("copy")).alias("taken")
    )


def _mixed_text(raw: bytes, pieces: list[dict]) -> str:
    words, last = raw.split(), max(piece["uses"] for piece in pieces)
    pieces = sorted(pieces, key=lambda piece: piece["begin"])
    if last == 1 and sum(piece["words"] for piece in pieces) == len(words):
        return raw.decode()
    taken = (
        words[i % len(words)]
        for turn in range(last)
        for piece in pieces
        if piece["uses"] > turn
        for i in range(piece["begin"], piece["begin"] + piece["words"])
    )
    return b" ".join(taken).decode()


def mixed_documents(docs: DataFrame, mix: Plan) -> DataFrame:
    """The columns of ``docs`` for the documents in the mix, with the words that it takes as text.

    A document taken once as a whole keeps its text as it is; otherwise its taken words stand in order, pass after
    pass, joined by one space. ``n_chars``, if there is one, follows the new text. Equal rows of one id become one row.
    """

    @F.arrow_udf("string")
    def mixed(raw: pa.Array, pieces: pa.Array) -> pa.Array:
        return pa.array((_mixed_text(r.as_py(), p.as_py()) for r, p in zip(raw, pieces, strict=True)), pa.string())

    raw = common.whole_text().cast("binary")
    used = mix.uses().groupBy("doc", "tie").agg(F.collect_list(F.struct("begin", "words", "uses")).alias("__mix_pieces"))
    used = used.withColumnsRenamed({"doc": "__mix_doc", "tie": "__mix_tie"})
    met = (F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_ID)) == used["__mix_doc"]) & (F.xxhash64(raw) == used["__mix_tie"])
    text = {"text": mixed(raw, F.col("__mix_pieces"))}
    rows = docs.join(used.hint("merge"), met).dropDuplicates(["__mix_doc", "__mix_tie"]).withColumns(text)
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return rows.select(*[F.col(f"`{name}`") for name in docs.columns])
