"""Exact duplicates by a persistent digest index.

The index is a table bucketed and sorted by the digest of the normalised text, one row per text. A
batch is first reduced to one row per digest (with a map-side combine, so a text that fills a third of
the batch reaches the shuffle as one row per task), then sort-merge anti-joined with the index, whose
buckets need no shuffle; what is left is appended. Only DataFrame functions are used.

Defined results: a null text counts as empty; a null ``doc_id`` is a document whose id sorts after all
others; of rows that repeat both id and text one stays; an empty batch adds nothing; other columns
of the input are not read. A batch that is added again gives the same decisions again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from playlens.llm import common

DIGEST_COLUMNS = "digest binary, keep_id bigint, keep_chars int"


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, n_chars): SHA-256 of the text without ``[\\x20\\x09-\\x0D]``."""
    text = common.whole_text()
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.unhex(F.sha2(F.translate(text, common.SPACES, "").cast("binary"), 256)).alias("digest"),
        F.char_length(text).alias("n_chars"),
    )


class DigestIndex:
    """Texts seen so far. ``buckets`` is fixed when the table is made: about one per 100 MB expected."""

    def __init__(self, spark: SparkSession, table: str, buckets: int | None = None, path: str | None = None):
        self.spark, self.table, self.path = spark, table, path
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        if not spark.catalog.tableExists(table):
            self._append(spark.createDataFrame([], DIGEST_COLUMNS))

    def _append(self, rows: DataFrame) -> None:
        writer = rows.select("digest", "keep_id", "keep_chars").write.format("parquet").mode("append")
        if self.path:
            writer = writer.option("path", self.path)
        writer.bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.table)

    def entries(self) -> DataFrame:
        """(digest, keep_id, keep_chars), one row per text."""
        return self.spark.table(self.table)

    def add(self, docs: DataFrame) -> DataFrame:
        """Append the texts that are new; one row per document of the batch.

        Of equal texts within the batch the row with the most code points, then the smallest id stays;
        a text that an earlier batch brought stays with that earlier document. ``group_size`` counts
        the batch's rows with the text.
        """
        rows = common.store(
            digests(docs).groupBy("digest", "doc_id", "n_chars").agg(F.count(F.lit(1)).alias("copies")), "digests"
        )
        order = F.struct((-F.col("n_chars")).alias("less"), F.col("doc_id").isNull().alias("unnamed"), "doc_id")
        batch = rows.groupBy("digest").agg(F.min(order).alias("best"), F.sum("copies").alias("group_size"))
        batch = common.store(
            batch.select("digest", F.col("best.doc_id").alias("best_id"), (-F.col("best.less")).alias("best_chars"), "group_size"),
            "batch",
        )
        fresh = batch.join(self.entries().hint("merge"), "digest", "left_anti")
        self._append(
            fresh.select("digest", F.col("best_id").alias("keep_id"), F.col("best_chars").alias("keep_chars")).repartition(
                self.buckets, "digest"
            )
        )
        self.spark.catalog.refreshTable(self.table)
        known = common.store(batch.select("digest", "group_size").join(self.entries().hint("merge"), "digest"), "known")
        answers = rows.join(known.hint("merge"), "digest")  # a hot text's rows are split by AQE: both sides are shuffled
        own = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_chars") == F.col("keep_chars"))
        return answers.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(
            "doc_id",
            "keep_id",
            F.col("group_size").cast("long").alias("group_size"),
            (own & (F.col("copy") == 1)).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"),
        )
