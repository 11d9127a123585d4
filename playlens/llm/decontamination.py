"""Benchmark decontamination by SimHash over item-sized windows.

Words are runs of letters, marks and digits, lower-cased. A document matches an item if one of its windows of just as many
words has a weighted similarity of ``similarity`` or more: both are bags of shingles of ``SHINGLE`` words, a
shingle weighs its number of characters, and the similarity is the weight of the common part over the weight
of the union.

1. Windows that cannot match are left out: the shingles of a match that the benchmark has too must weigh
   ``similarity`` of the whole window. This needs one pass over the texts and a join with the benchmark's shingles; it
   says nothing yet about which item a window resembles.
2. Every different window text gets a weighted 64-bit SimHash, as every item does.
3. Multi-index Hamming search: fingerprints are cut into ``BLOCKS`` blocks. If two differ in at most ``radius`` bits,
   some block differs in at most ``radius // BLOCKS``; items are filed under all such variants of every block,
   windows ask with their own blocks, together with the window size. No pair within the radius is missed.
4. Candidates are verified by the exact similarity, shingle by shingle.

Only DataFrame functions are used. The benchmark's shingles are broadcast only if counted at most ``BROADCAST_ROWS``.

Defined results: a null text, or one shorter than an item, does not match it; an item of fewer than ``SHINGLE`` words
never matches, one repeated in the benchmark matches under each of its ids; null ids are kept; rows that repeat id
and text give one result; an empty table on either side gives no rows; other columns of the inputs are not read.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playlens.llm import common

SHINGLE, SIMILARITY, RADIUS, BLOCKS = 5, 0.8, 17, 6
BROADCAST_ROWS = 200_000
WORD = r"[\p{L}\p{M}\p{N}]+"


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({WORD})"), F.lit(1))


def shingles(words: str) -> Column:
    """All shingles of an array of words, as texts."""
    at = F.when(F.size(words) >= SHINGLE, F.sequence(F.lit(1), F.size(words) - SHINGLE + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.array_join(F.slice(words, i, SHINGLE), " "))


def _hashed(words: str) -> Column:
    at = F.when(F.size(words) >= SHINGLE, F.sequence(F.lit(1), F.size(words) - SHINGLE + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(F.slice(words, i, SHINGLE)))


def _documents(docs: DataFrame) -> DataFrame:
    text = common.whole_text()
    return docs.select(F.col("doc_id").cast("long").alias("doc"), F.xxhash64(text).alias("tie"), words_of(text).alias("words"))


def _same_document(left: DataFrame, doc: str, tie: str) -> Column:
    return left["doc"].eqNullSafe(F.col(doc)) & (left["tie"] == F.col(tie))


def window_texts(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc, tie, start, size, text): the windows that may match an item of their size."""
    held = items.withColumns({"hash": _hashed("words"), "shingle": shingles("words")})
    held = held.select("size", F.explode(F.arrays_zip("hash", "shingle")).alias("one")).select("size", "one.*")
    held = held.groupBy("size", "hash").agg(F.max(F.char_length("shingle")).alias("weight"))
    held = common.store(held, "benchmark_shingles")
    if held.count() <= BROADCAST_ROWS:
        held = F.broadcast(held)
    placed = _documents(docs).select("doc", "tie", F.size("words").alias("n"), F.posexplode(_hashed("words")).alias("pos", "hash"))
    met = placed.join(held, "hash").filter("n >= size")
    starts = F.sequence(F.greatest(F.lit(0), F.col("pos") - F.col("size") + SHINGLE), F.least(F.col("pos"), F.col("n") - F.col("size")))
    weighed = met.select("doc", "tie", "size", "weight", F.explode(starts).alias("start")).groupBy("doc", "tie", "size", "start")
    places = weighed.agg(F.sum("weight").alias("hits")).groupBy(F.col("doc").alias("in_doc"), F.col("tie").alias("in_tie"))
    places = places.agg(F.collect_list(F.struct("size", "start", "hits")).alias("places"))
    text = common.whole_text()
    whole = docs.select(F.col("doc_id").cast("long").alias("doc"), F.xxhash64(text).alias("tie"), text.alias("whole"))
    joined = whole.join(places, _same_document(whole, "in_doc", "in_tie")).withColumn("words", words_of(F.col("whole")))
    # The weight of all shingles of a window: words count once for each shingle they are in, and each has its spaces.
    lengths = joined.withColumn("lengths", F.transform("words", F.char_length))

    def total(place: Column) -> Column:
        inner = place["size"] - SHINGLE + 1
        own = F.transform(
            F.slice("lengths", place["start"] + 1, place["size"]),
            lambda length, i: length * F.least(i + 1, place["size"] - i, F.lit(SHINGLE), inner),
        )
        return F.aggregate(own, inner * (SHINGLE - 1), lambda a, b: a + b)

    heavy = F.filter("places", lambda place: place["hits"] >= F.lit(similarity) * total(place))
    cut = F.transform(
        heavy,
        lambda place: F.struct(
            place["start"].alias("start"),
            place["size"].alias("size"),
            F.array_join(F.slice("words", place["start"] + 1, place["size"]), " ").alias("text"),
        ),
    )
    return lengths.select("doc", "tie", F.explode(cut).alias("window")).select("doc", "tie", "window.*").distinct()


def simhashes(texts: DataFrame) -> DataFrame:
    """(size, text, fp) for different (size, text): each bit by the sign of the shingles' weighted votes."""
    each = texts.withColumn("words", F.split("text", " ")).select("size", "text", F.explode(shingles("words")).alias("shingle"))
    each = each.select("size", "text", F.xxhash64("shingle").alias("h"), F.char_length("shingle").alias("w"))
    # Bits i and i + 32 are counted in the halves of one sum; a window has under 2^31 characters.
    votes = [F.sum((F.shiftrightunsigned("h", bit).bitwiseAND(F.lit((1 << 32) + 1))) * F.col("w")).alias(f"v{bit}") for bit in range(32)]
    counted = each.groupBy("size", "text").agg(*votes, F.sum("w").alias("all"))
    halves = [(F.col(f"v{bit}").bitwiseAND(F.lit((1 << 32) - 1)), F.shiftrightunsigned(f"v{bit}", 32)) for bit in range(32)]
    set_votes = [low for low, _ in halves] + [high for _, high in halves]
    bits = [F.when(votes * 2 > F.col("all"), F.lit(_signed(1 << bit))).otherwise(F.lit(0).cast("long")) for bit, votes in enumerate(set_votes)]
    return counted.select("size", "text", reduce(Column.bitwiseOR, bits).alias("fp"))


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def block_keys(blocks: int = BLOCKS, flips: int = 0) -> Column:
    """Array of (block, value) of ``fp``, with all values that at most ``flips`` changed bits of a block give."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    keys = []
    for block, (low, high) in enumerate(zip(edges, edges[1:], strict=False)):
        own = F.expr(f"shiftrightunsigned(fp, {low}) & {(1 << (high - low)) - 1}L")
        masks = [sum(1 << bit for bit in chosen) for n in range(flips + 1) for chosen in combinations(range(high - low), n)]
        values = F.transform(F.array(*[F.lit(mask).cast("long") for mask in masks]), lambda mask, own=own: own.bitwiseXOR(mask))
        keys.append(F.transform(values, lambda value, block=block: F.struct(F.lit(block).alias("block"), value.alias("value"))))
    return F.concat(*keys)


def candidates(windows: DataFrame, items: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """(size, text, item_text): texts of one size whose fingerprints differ in at most ``radius`` bits."""
    asked = windows.select("size", "text", "fp", F.explode(block_keys(blocks)).alias("key")).select("size", "text", "fp", "key.*")
    filed = items.select("size", F.col("text").alias("item_text"), F.col("fp").alias("item_fp"), F.explode(block_keys(blocks, radius // blocks)).alias("key"))
    filed = filed.select("size", "item_text", "item_fp", "key.*")
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= radius
    return asked.join(filed, ["size", "block", "value"]).filter(near).select("size", "text", "item_text").distinct()


def similarities(pairs: DataFrame) -> DataFrame:
    """(text, item_text, common, total): the weight of the common part and of the union of two bags of shingles."""
    ids = [F.xxhash64("text").alias("t1"), F.xxhash64(F.lit("text"), "text").alias("t2")]
    items = [F.xxhash64("item_text").alias("i1"), F.xxhash64(F.lit("text"), "item_text").alias("i2")]
    pairs = pairs.select("text", "item_text", *ids, *items)

    def bag(name: str, one: str, two: str, count: str) -> DataFrame:
        each = pairs.select(name, one, two).distinct().withColumn("words", F.split(name, " "))
        return each.select(one, two, F.explode(shingles("words")).alias("shingle")).groupBy(one, two, "shingle").agg(F.count(F.lit(1)).alias(count))

    mine, theirs = bag("text", "t1", "t2", "n"), bag("item_text", "i1", "i2", "m")
    weight = F.char_length("shingle")
    linked = pairs.select("t1", "t2", "i1", "i2")
    shared = linked.join(mine, ["t1", "t2"]).join(theirs, ["i1", "i2", "shingle"])
    shared = shared.groupBy("t1", "t2", "i1", "i2").agg(F.sum(F.least("n", "m") * weight).alias("common"))
    all_mine = mine.groupBy("t1", "t2").agg(F.sum(F.col("n") * weight).alias("weight"))
    all_theirs = theirs.groupBy("i1", "i2").agg(F.sum(F.col("m") * weight).alias("item_weight"))
    joined = pairs.join(shared, ["t1", "t2", "i1", "i2"]).join(all_mine, ["t1", "t2"]).join(all_theirs, ["i1", "i2"])
    return joined.select("text", "item_text", "common", (F.col("weight") + F.col("item_weight") - F.col("common")).alias("total"))


def leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """(doc, tie, item_id, start, common, total): for each document and item the first of its most similar windows."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), words_of(common.whole_text()).alias("words"))
    items = items.withColumn("size", F.size("words")).filter(F.col("size") >= SHINGLE).distinct()
    items = common.store(items.withColumn("text", F.array_join("words", " ")), "items")
    windows = common.store(window_texts(docs, items, similarity), "windows")
    pairs = common.store(
        candidates(simhashes(windows.select("size", "text").distinct()), simhashes(items.select("size", "text").distinct()), radius), "candidates"
    )
    alike = similarities(pairs.select("text", "item_text")).filter(F.col("common") >= F.lit(similarity) * F.col("total"))
    named = alike.join(items.select("item_id", F.col("text").alias("item_text")), "item_text").drop("item_text")
    found = windows.join(named, "text")
    best = F.struct((-F.col("common") / F.col("total")).alias("less"), "start", "common", "total")
    return found.groupBy("doc", "tie", "item_id").agg(F.min(best).alias("best")).select("doc", "tie", "item_id", "best.start", "best.common", "best.total")


def contamination(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, item_id, start, common, total, similarity)."""
    found = leaks(docs, benchmark, similarity)
    share = (F.col("common") / F.col("total")).alias("similarity")
    return found.select(F.col("doc").alias("doc_id"), "item_id", F.col("start").cast("long").alias("start"), "common", "total", share)


def decontaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows and columns of ``docs`` that match no item."""
    bad = leaks(docs, benchmark, similarity).select(F.col("doc").alias("__leak_doc"), F.col("tie").alias("__leak_tie"))
    bad = common.store(bad.distinct(), "leaks")
    same = docs["doc_id"].cast("long").eqNullSafe(bad["__leak_doc"]) & (F.xxhash64(common.whole_text()) == bad["__leak_tie"])
    return docs.join(bad, same, "left_anti")
