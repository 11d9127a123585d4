"""SimHash near duplicates by meet-in-the-middle ball hashing.

Two fingerprints at most ``2r`` bits apart have a common variant within ``r`` bits of both. Every
*distinct* fingerprint emits all its variants within half the radius; variants are shuffled and
fingerprints that meet are linked. No group has more members than a ball has variants (65 for half radius 1),
however many documents are copies, and no pair of a group is left unlinked: members hang on the least one.

Defined results: a null or empty text has fingerprint zero, which links like any other; repeated rows give
repeated results; null ids never name a component (it is null only if all its ids are); other columns of the
input are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playlens.llm import common
from playlens.llm.components import connected_components

WORDS, RADIUS, SEED = 3, 2, 42
NO_ID = -(1 << 63)
SHINGLES_AT_ONCE = 1 << 16


def fingerprint(raw: bytes, words: int = WORDS) -> int:
    """64-bit SimHash of a UTF-8 text: a bit is set if it is set in over half of the shingle hashes."""
    tokens = raw.lower().split()  # of bytes: only A-Z and [\x20\x09-\x0D]
    if not tokens:
        return 0
    parts = [tokens[i:] for i in range(words)] if len(tokens) >= words else [[b" ".join(tokens)]]
    count = len(parts[-1])
    hashes = np.fromiter((xxhash.xxh64_intdigest(b" ".join(s), SEED) for s in zip(*parts, strict=False)), "<u8", count)
    totals = np.zeros(64, np.int64)
    for start in range(0, count, SHINGLES_AT_ONCE):
        block = hashes[start : start + SHINGLES_AT_ONCE].view(np.uint8).reshape(-1, 8)
        totals += np.unpackbits(block, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(totals * 2 > count, bitorder="little").tobytes(), "little", signed=True)


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, tie, fp): hash of the text and fingerprint, as signed longs. No shuffle."""
    schema = pa.schema([("doc_id", pa.int64()), ("tie", pa.int64()), ("fp", pa.int64())])

    def make(batch: pa.RecordBatch) -> dict:
        found = [fingerprint(raw.as_py(), words) for raw in batch.column(2)]
        return {"doc_id": batch.column(0), "tie": batch.column(1), "fp": found}

    text = common.whole_text()
    raw = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("tie"), text.cast("binary").alias("raw"))
    return raw.mapInArrow(common.arrow_rows(schema, make), "doc_id bigint, tie bigint, fp bigint")


def ball(fp: Column, radius: int) -> Column:
    """The array of all values at most ``radius`` bits from ``fp``."""
    values = F.array(fp)
    masks = [0]
    for _ in range(radius):
        masks = sorted({mask ^ (1 << bit) for mask in masks for bit in range(64)} | set(masks))
    signed = [mask - (1 << 64) if mask >= 1 << 63 else mask for mask in masks if mask]
    if not signed:
        return values
    return F.concat(values, F.transform(F.array(*[F.lit(mask) for mask in signed]), lambda mask: fp.bitwiseXOR(mask)))


def links(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(u, v): verified links that connect all distinct fingerprints ``fp`` at most ``radius`` bits apart."""
    if radius % 2:
        raise ValueError("the radius must be even: it is met from both sides")
    spread = common.spread(nodes, "fp").select("fp", F.explode(ball(F.col("fp"), radius // 2)).alias("variant"))
    met = spread.groupBy("variant").agg(F.collect_set("fp").alias("members")).filter(F.size("members") > 1)
    met = met.select(F.array_min("members").alias("v"), F.explode("members").alias("u"))
    close = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))).between(1, radius)
    return met.filter(close).distinct()


def components(docs: DataFrame, words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """(doc_id, tie, fp, component_id, root): the smallest id that links reach, one row per document."""
    prints = common.store(fingerprints(docs, words), "fingerprints")
    nodes = common.store(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "nodes")
    roots = connected_components(links(nodes, radius))
    rooted = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    rooted = common.store(rooted, "rooted")
    names = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    classes = common.store(rooted.join(names, "root").select(F.col("fp").alias("of"), "component_id", "root"), "classes")
    return prints.join(classes, F.col("fp") == F.col("of")).select("doc_id", "tie", "fp", "component_id", "root")


def hex_fingerprint(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_first(docs: DataFrame, rooted: DataFrame) -> DataFrame:
    """The columns of ``docs``, one document of each root of ``rooted`` (doc_id, tie, root): the smallest id (null last), then the smallest text hash.

    Of rows that repeat id and text any one stays.
    """
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "tie")
    chosen = rooted.groupBy("root").agg(F.min(order).alias("best"))
    # Plain equality on keys without nulls: the join's partitioning then serves the removal of repeated rows as well.
    # Whether there is an id is a key of its own, as any number can be one.
    key = F.coalesce(F.col("best.doc_id"), F.lit(NO_ID)).alias("__kept_id")
    chosen = chosen.select(F.col("best.unnamed").alias("__kept_unnamed"), key, F.col("best.tie").alias("__kept_tie")).hint("merge")
    own_id, own_tie = docs["doc_id"].cast("long"), F.xxhash64(common.whole_text())
    same_id = (own_id.isNull() == F.col("__kept_unnamed")) & (F.coalesce(own_id, F.lit(NO_ID)) == F.col("__kept_id"))
    rows = docs.join(chosen, same_id & (own_tie == F.col("__kept_tie")))
    keys = ["__kept_unnamed", "__kept_id", "__kept_tie"]
    return rows.dropDuplicates(keys).drop(*keys)


def drop_near_duplicates(docs: DataFrame, words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """The columns of ``docs``, one document of each component as ``keep_first`` chooses it."""
    return keep_first(docs, components(docs, words, radius))
