"""Line dedup that returns keep bitmaps.

Lines that many documents share lose all their places but those in the largest id that holds them.

1. Every document counts each of its distinct keys once; counts combine map-side, so the commonest line reaches
   the shuffle as one row per task. Only keys of ``min_docs`` documents and more go on.
2. Their places are range partitioned by 128-bit hash and sorted within by document (largest first) and position;
   a running window streams each key's first document. A key of more than ``hot`` documents is split over several
   ranges, and its first document is the one that the counts brought.
3. A document's dropped places become one bitmap in run-length form: lines kept, dropped, kept, ... by turns.

Texts are not moved until the bitmaps are applied. Only DataFrame functions are used.

Defined results: a null or empty text is one empty line; a null id is smaller than all others; rows that share an
id count as so many documents, and all rows of the largest id keep the line; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from playlens.llm import common

MIN_CHARS, MIN_DOCS, HOT = 20, 3, 1000
NO_ID = -(1 << 63)


def line_key(line: Column) -> Column:
    """The line without ``[\\x20\\x09-\\x0D]`` at both ends, A-Z lower-cased."""
    bare = F.btrim(line, F.lit(common.SPACES))
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(common.lower_ascii(bare))


def _rows(docs: DataFrame) -> DataFrame:
    text = common.whole_text()
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64(text).alias("tie"), text.alias("text")
    )


def _hashes() -> list[Column]:
    return [F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("line"), "key").alias("h2")]


def dropped_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, hot: int = HOT) -> DataFrame:
    """(doc, tie, pos): the places that go."""
    rows = _rows(docs)
    lines = F.split("text", "\n")
    long_enough = F.char_length("key") >= min_chars
    held = rows.select("doc", F.explode(F.array_distinct(F.transform(lines, line_key))).alias("key")).filter(long_enough)
    counts = held.select("doc", *_hashes()).groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("docs"), F.max("doc").alias("last"))
    # Written, so that both sides of the join are plain shuffles and AQE can split the commonest line's places.
    shared = common.store(counts.filter(F.col("docs") >= min_docs), "shared_lines")
    places = rows.select("doc", "tie", F.posexplode(lines).alias("pos", "line")).withColumn("key", line_key(F.col("line")))
    places = places.filter(long_enough).select("doc", "tie", "pos", *_hashes()).join(shared, ["h1", "h2"])
    split = F.col("docs") > hot
    parts = F.when(split, F.pmod(F.xxhash64("doc"), F.ceil(F.col("docs") / hot))).otherwise(0)
    ranged = places.withColumn("part", parts).repartitionByRange("h1", "h2", "part")
    stream = Window.partitionBy("h1", "h2", "part").orderBy(F.col("doc").desc(), "pos").rowsBetween(Window.unboundedPreceding, 0)
    first = F.when(split, F.col("last")).otherwise(F.first("doc").over(stream))
    return ranged.withColumn("first_doc", first).filter("doc <> first_doc").select("doc", "tie", "pos")


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, hot: int = HOT) -> DataFrame:
    """(doc, tie, gone): per document that loses lines the runs of dropped lines as (start, size)."""
    order = Window.partitionBy("doc", "tie").orderBy("pos")
    runs = dropped_lines(docs, min_chars, min_docs, hot).withColumn("run", F.col("pos") - F.dense_rank().over(order))
    runs = runs.groupBy("doc", "tie", "run").agg(F.min("pos").alias("start"), (F.max("pos") - F.min("pos") + 1).alias("size"))
    return runs.groupBy("doc", "tie").agg(F.sort_array(F.collect_list(F.struct("start", "size"))).alias("gone"))


def dedup(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, hot: int = HOT) -> DataFrame:
    """(doc_id, text, n_lines, n_dropped, keep_runs): what is left of each text and its bitmap in run-length form."""
    bitmaps = keep_bitmaps(docs, min_chars, min_docs, hot)
    joined = _rows(docs).join(bitmaps, ["doc", "tie"], "left").withColumn("lines", F.split("text", "\n"))

    def end_before(i: Column) -> Column:
        before = F.get("gone", i - 1)
        return F.coalesce(before["start"] + before["size"], F.lit(0))

    flags = F.flatten(
        F.transform(
            "gone", lambda run, i: F.concat(F.array_repeat(F.lit(True), run["start"] - end_before(i)), F.array_repeat(F.lit(False), run["size"]))
        )
    )
    lengths = F.flatten(F.transform("gone", lambda run, i: F.array(run["start"] - end_before(i), run["size"])))
    lines = F.transform(F.filter(F.arrays_zip("lines", "flags"), lambda x: F.coalesce(x["flags"], F.lit(True))), lambda x: x["lines"])
    n_lines = F.size("lines")
    tail = n_lines - end_before(F.size("gone"))
    joined = joined.withColumns({"flags": flags, "tail": F.when(F.col("gone").isNull(), n_lines).otherwise(tail)})
    runs = F.concat(F.coalesce(lengths, F.array().cast("array<int>")), F.when(F.col("tail") > 0, F.array("tail")).otherwise(F.array()))
    return joined.select(
        F.nullif("doc", F.lit(NO_ID)).alias("doc_id"),
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(lines, "\n")).alias("text"),
        n_lines.cast("long").alias("n_lines"),
        F.coalesce(F.aggregate("gone", F.lit(0), lambda total, run: total + run["size"]), F.lit(0)).cast("long").alias("n_dropped"),
        F.array_join(F.transform(runs, lambda x: x.cast("string")), ",").alias("keep_runs"),
    )
