"""Quality rules: counts of a text by itself, and lines that too many documents of a host share.

A line is normalised (A-Z lower-cased, digits as 0, runs of spaces as one) and hashed to 128 bits. For every host and hash the
distinct texts that hold the line are counted; copies of one text count once, so that a text is not called boilerplate because
it was copied. Lines in more than ``LINE_LIMIT`` texts of a host are removed. A document that keeps less than ``LEAST_LEFT`` of
its words is depleted and rejected, as is one that fails the base rules: fewer than 20 words, or over 30 % of the words in
repeated runs of eight words.

One pass of Arrow code reads the texts and stores counts and line hashes; texts are not shuffled. A line that very many
documents hold is counted in the map tasks first, and the join of lines with removed lines can be split at it.

Results: a null text has no word and fails; a null host is a host of its own; repeated rows and ids are judged one by one;
lines without a word are not counted or removed; other columns have no influence; an empty table gives an empty one.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from playlens.llm.common import SPACES, arrow_rows, store, whole_text

#: Distinct texts of a host that may hold a line before it is removed.
LINE_LIMIT = 10
#: Share of the words that must be left.
LEAST_LEFT = 0.3
LEAST_WORDS = 20
MOST_REPEATED = 30
SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: Helper columns beside those of the documents.
ROW, GONE = "quality_rules_row", "quality_rules_gone"

_NORMAL = bytes(ord("0") if 48 <= c <= 57 else c + 32 if 65 <= c <= 90 else c for c in range(256))
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(texts: list[list[bytes]]) -> np.ndarray:
    """For each text, its words in runs of eight words that it holds twice or more.

    Runs are told apart exactly: pairs of words get numbers, then pairs of pairs, then pairs of those.
    """
    sizes = np.array([len(words) for words in texts], dtype=np.int64)
    total = int(sizes.sum())
    if total < WINDOW:
        return np.zeros(len(texts), dtype=np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    codes = pd.factorize(np.fromiter(chain.from_iterable(texts), dtype=object, count=total))[0].astype(np.int64)
    run = np.unique(owner * (int(codes.max()) + 1) + codes, return_inverse=True)[1]
    for step in (1, 2, 4):
        run = np.unique(run[:-step] * (int(run.max()) + 1) + run[step:], return_inverse=True)[1]
    inside = owner[: total - WINDOW + 1] == owner[WINDOW - 1 :]
    starts = np.flatnonzero(inside & (np.bincount(run[inside], minlength=int(run.max()) + 1)[run] > 1))
    covered = np.zeros(total + 1, dtype=np.int64)
    np.add.at(covered, starts, 1)
    np.add.at(covered, starts + WINDOW, -1)
    return np.bincount(owner, weights=np.cumsum(covered[:-1]) > 0, minlength=len(texts)).astype(np.int64)


def _key(words: list[bytes]) -> bytes:
    return xxhash.xxh3_128_digest(b" ".join(words))


def _lines(raw: bytes) -> tuple[int, list[dict]]:
    """Lines that repeat an earlier one, and the normalised lines of a text with their words."""
    seen, repeats, words = set(), 0, {}
    for line in raw.split(b"\n"):
        parts = line.translate(_NORMAL).split()
        if parts:
            repeats += line in seen
            seen.add(line)
            key = _key(parts)
            words[key] = words.get(key, 0) + len(parts)
    return repeats, [{"line": key, "words": count} for key, count in words.items()]


def measured(docs: DataFrame, host: str = "source", row: Column | None = None) -> DataFrame:
    """Documents without their text: the base counts, the text's digest and its lines. Stored, which pins the row numbers."""
    kinds = dict(docs.dtypes)
    lines = "array<struct<line: binary, words: bigint>>"
    schema = f"row bigint, doc_id {kinds['doc_id']}, host string, {', '.join(f'{name} bigint' for name in COUNTS)}, digest binary, lines {lines}"
    result = to_arrow_schema(docs.sparkSession.createDataFrame([], schema).schema)

    def make(batch: pa.RecordBatch) -> dict:
        texts = batch.column("text").to_pylist()
        raw = [text.encode() for text in texts]
        words = [one.split() for one in raw]
        found = [_lines(one) for one in raw]
        return {
            "row": batch.column("row"),
            "doc_id": batch.column("doc_id"),
            "host": batch.column("host"),
            "n_words": [len(one) for one in words],
            "word_chars": [len(text) - sum(map(text.count, SPACES)) for text in texts],
            "n_symbols": [sum(map(text.count, SYMBOLS)) for text in texts],
            "n_dup_lines": [repeats for repeats, _ in found],
            "n_repeat_words": repeated_words(words),
            "digest": [xxhash.xxh3_128_digest(one) for one in raw],
            "lines": [lines for _, lines in found],
        }

    rows = docs.select(
        (F.monotonically_increasing_id() if row is None else row).alias("row"), "doc_id", F.col(host).cast("string").alias("host"), whole_text().alias("text")
    )
    return store(rows.mapInArrow(arrow_rows(result, make), schema), "line_hashes")


def removed_lines(documents: DataFrame, limit: int = LINE_LIMIT) -> DataFrame:
    """(host, line, texts): the lines of a host that more than ``limit`` different texts hold."""
    lines = documents.select("host", "digest", F.explode("lines.line").alias("line"))
    return lines.groupBy("host", "line").agg(F.count_distinct("digest").alias("texts")).where(F.col("texts") > limit)


def _verdicts(documents: DataFrame, limit: int, least_left: float) -> DataFrame:
    shared = removed_lines(documents, limit).toDF("shared_host", "shared_line", "texts")
    lines = documents.select("row", "host", F.explode("lines").alias("held")).select("row", "host", "held.*")
    same = (F.col("line") == F.col("shared_line")) & F.col("host").eqNullSafe(F.col("shared_host"))
    lost = lines.join(shared, same).groupBy("row").agg(
        F.count("*").alias("lines_lost"), F.sum("words").alias("words_lost"), F.collect_list("line").alias("gone")
    )
    words, none = F.col("n_words"), F.lit(0).cast("bigint")
    judged = documents.drop("lines").join(lost, "row", "left").withColumns(
        {
            "base_failed": (words < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > words * MOST_REPEATED),
            "n_removed_lines": F.coalesce("lines_lost", none),
            "n_removed_words": F.coalesce("words_lost", none),
        }
    )
    return judged.withColumn("kept", ~F.col("base_failed") & (words - F.col("n_removed_words") >= words * F.lit(least_left)))


def judge(docs: DataFrame, *, host: str = "source", limit: int = LINE_LIMIT, least_left: float = LEAST_LEFT) -> DataFrame:
    """Documents with the base counts, ``base_failed``, ``kept``, and the lines and words that were removed."""
    judged = _verdicts(measured(docs, host), limit, least_left)
    return judged.select("doc_id", *COUNTS, "base_failed", "kept", "n_removed_lines", "n_removed_words")


def cleaned(docs: DataFrame, *, host: str = "source", limit: int = LINE_LIMIT, least_left: float = LEAST_LEFT) -> DataFrame:
    """The documents that are kept, with all their columns; their texts have lost the removed lines."""
    given = store(docs.withColumn(ROW, F.monotonically_increasing_id()), "given")
    verdicts = _verdicts(measured(given, host, F.col(ROW)), limit, least_left).where("kept")
    left = given.join(verdicts.select(F.col("row").alias(ROW), F.col("gone").alias(GONE)), ROW).select(*docs.columns, GONE)
    result, names = to_arrow_schema(docs.schema), docs.columns

    def make(batch: pa.RecordBatch) -> dict:
        texts = []
        for text, gone in zip(batch.column("text").to_pylist(), batch.column(GONE).to_pylist()):
            if gone:
                keys = set(gone)
                text = "\n".join(line for line in text.split("\n") if _key(line.encode().translate(_NORMAL).split()) not in keys)
            texts.append(text)
        return {name: batch.column(name) for name in names} | {"text": texts}

    return left.mapInArrow(arrow_rows(result, make), docs.schema)
