"""Removal of repeated word windows by super-k-mers.

A window is ``WINDOW`` consecutive words. Its minimiser is the least hash of the ``CORE`` consecutive
words inside it (the leftmost of equal ones), so equal windows have equal minimisers wherever they stand. Consecutive
windows that share one minimiser form a super-k-mer.

1. Documents with equal texts are found first. All but the one with the smallest id lose every window, so only that
   one goes on.
2. Minimiser values are counted with a map-side combine. A window that repeats has a minimiser value
   that occurs at least twice, so only super-k-mers of such values go on: new text does not travel.
3. Places of those super-k-mers are combined by hash of their words to one row with first place and number; then each
   different super-k-mer travels once, from its first place, as one packed string of words to the bucket of its
   minimiser. A minimiser found more than ``HOT`` times has its windows travel singly, dealt by their own hash, so it is
   no single task's work.
4. In the bucket the strings are cut into windows, which sorting groups: each window's first place and number.
5. What is found is joined back to the places and to the texts. The texts are shuffled once, by document; all
   joins with them read that shuffle again.

Defined results: a null text has no words; texts of fewer than ``WINDOW`` words stay; a null id sorts before all
others; rows that repeat both id and text count as one document and get equal results; of rows that share
an id only, the smaller text hash comes first; other columns of the input are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playlens.llm import common

WINDOW, CORE, HOT = 20, 6, 2000
NO_ID = -(1 << 63)
BLOCK, LONG_WORD = 1 << 16, 1 << 12
#: Place of a word within its text, modulo this, in the low bits of a core's rank.
PLACES = 1 << 20

_FACTOR, _MIX = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)


def _powers(factor: int) -> np.ndarray:
    out = np.full(BLOCK + 1, factor, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_FACTOR), _powers(pow(_FACTOR, -1, 1 << 64))


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(32))) * _MIX
    return values ^ (values >> np.uint64(29))


def _block_hashes(text: bytes) -> np.ndarray:
    """64-bit hashes of the words of a text of at most ``BLOCK`` bytes, as differences of one running polynomial."""
    flat = np.frombuffer(text, np.uint8)
    spaces = np.flatnonzero(flat == 0x20)
    starts, ends = np.concatenate([[0], spaces + 1]), np.concatenate([spaces, [len(flat)]])
    running = np.zeros(len(flat) + 1, np.uint64)
    np.cumsum((flat.astype(np.uint64) + np.uint64(1)) * _UP[: len(flat)], out=running[1:])
    hashes = _mixed((running[ends] - running[starts]) * _DOWN[starts] ^ (ends - starts).astype(np.uint64))
    for i in np.flatnonzero(ends - starts >= LONG_WORD).tolist():
        hashes[i] = xxhash.xxh64_intdigest(text[starts[i] : ends[i]])
    return hashes


def word_hashes(text: bytes) -> np.ndarray:
    """Hashes of the words of a text in which single spaces divide them; a block at a time."""
    out, at = [np.empty(0, np.uint64)], 0
    while at < len(text):
        end = len(text) if len(text) - at <= BLOCK else text.rfind(b" ", at, at + BLOCK)
        if end > at:
            out.append(_block_hashes(text[at:end]))
        else:
            end = text.find(b" ", at)
            end = len(text) if end < 0 else end
            out.append(np.array([xxhash.xxh64_intdigest(text[at:end])], np.uint64))
        at = end + 1
    return np.concatenate(out)


def super_kmers(text: bytes, window: int = WINDOW, core: int = CORE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, number of windows, minimiser) of every super-k-mer of a text with single spaces.

    Cores are ranked by the upper 44 bits of their hash, equal ones by place; the minimiser is those bits.
    """
    hashes = word_hashes(text)
    if len(hashes) < window:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    cores = np.zeros(len(hashes) - core + 1, np.uint64)
    for offset in range(core):
        cores = cores * np.uint64(_FACTOR) + hashes[offset : offset + len(cores)]
    places = np.arange(len(cores), dtype=np.uint64) % np.uint64(PLACES)
    least = (_mixed(cores) & np.uint64(~(PLACES - 1) & (2**64 - 1))) | places
    inside, width = window - core + 1, 1
    while width < inside:  # the least of ``width`` cores from each on
        step = min(width, inside - width)
        least, width = np.minimum(least[:-step], least[step:]), width + step
    starts = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    return starts, np.diff(starts, append=len(least)), (least[starts] >> np.uint64(20)).astype(np.int64)


def _texts(docs: DataFrame) -> DataFrame:
    """(doc, tie, raw, first): ``first`` marks the smallest id of each text; ``tie`` tells rows of one id apart.

    The join partitions the texts by document. It is the same wherever it is used, so Spark shuffles them once.
    """
    raw = common.whole_text().cast("binary")
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), raw.alias("raw"))
    known = rows.select("doc", F.xxhash64("raw").alias("h1"), F.xxhash64(F.lit("text"), "raw").alias("h2"))
    firsts = known.groupBy("h1", "h2").agg(F.min("doc").alias("doc")).select("doc", F.lit(True).alias("first"), F.lit(False).alias("several"))
    several = known.groupBy("doc").count().filter("count > 1").select("doc", F.lit(False).alias("first"), F.lit(True).alias("several"))
    marks = firsts.unionByName(several).groupBy(F.col("doc").alias("of")).agg(F.max("first").alias("first"), F.max("several").alias("several"))
    tie = F.when(F.col("several"), F.xxhash64("raw")).otherwise(F.lit(0)).alias("tie")
    return rows.join(marks, rows.doc == marks.of, "left").select("doc", tie, "raw", F.coalesce("first", F.lit(False)).alias("first"))


def _with_spaces(raw: bytes) -> bytes:
    return b" ".join(raw.split())


def _minimisers(texts: DataFrame, window: int, core: int, once: bool) -> DataFrame:
    """(doc, mini) of every super-k-mer; of each different minimiser of a text if ``once``."""

    def make(batch: pa.RecordBatch) -> dict:
        found = [super_kmers(_with_spaces(raw.as_py()), window, core)[2] for raw in batch.column(1)]
        found = [np.unique(values) for values in found] if once else found
        return {"doc": np.repeat(batch.column(0).to_numpy(), [len(values) for values in found]), "mini": np.concatenate(found)}

    schema = pa.schema([("doc", pa.int64()), ("mini", pa.int64())])
    return texts.select("doc", "raw").mapInArrow(common.arrow_rows(schema, make), "doc bigint, mini bigint")


def _ends(text: bytes) -> np.ndarray:
    """Where each word of a text with single spaces ends."""
    return np.append(np.flatnonzero(np.frombuffer(text, np.uint8) == 0x20), len(text))


def _packed(text: bytes, ends: np.ndarray, start: int, words: int) -> bytes:
    return text[int(ends[start - 1]) + 1 if start else 0 : int(ends[start + words - 1])]


PLACE = pa.schema([(name, pa.int64()) for name in ("bucket", "pack", "doc", "tie")] + [("start", pa.int32()), ("size", pa.int32())])


def _places(window: int, core: int):
    """(bucket, pack, doc, tie, start, size) of the super-k-mers whose minimisers repeat."""

    def make(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {name: [] for name in PLACE.names}
        for doc, raw, tie, minis, hot in zip(*(batch.column(i) for i in range(5)), strict=True):
            text = _with_spaces(raw.as_py())
            starts, sizes, values = super_kmers(text, window, core)
            ends, crowded = _ends(text), set(hot.values.to_pylist())
            for k in np.flatnonzero(np.isin(values, minis.values.to_numpy())).tolist():
                first, size, mini = int(starts[k]), int(sizes[k]), int(values[k])
                single = mini in crowded
                for start in range(first, first + size) if single else (first,):
                    pack = xxhash.xxh64_intdigest(_packed(text, ends, start, (1 if single else size) + window - 1)) - (1 << 63)
                    row = (pack if single else mini, pack, doc.as_py(), tie.as_py(), start, 1 if single else size)
                    for name, value in zip(PLACE.names, row, strict=True):
                        out[name].append(value)
        return out

    return common.arrow_rows(PLACE, make)


STRING = pa.schema([PLACE.field(name) for name in ("bucket", "pack", "doc", "tie", "start")] + [("n", pa.int64()), ("packed", pa.string())])


def _strings(window: int):
    """The packed strings of the places listed with a text."""

    def make(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {name: [] for name in STRING.names}
        for doc, raw, tie, own in zip(*(batch.column(i) for i in range(4)), strict=True):
            text, tie = _with_spaces(raw.as_py()), tie.as_py()
            ends = _ends(text)
            for place in own.as_py():
                if place["tie"] == tie:
                    packed = _packed(text, ends, place["start"], place["size"] + window - 1).decode()
                    row = (place["bucket"], place["pack"], doc.as_py(), tie, place["start"], place["n"], packed)
                    for name, value in zip(STRING.names, row, strict=True):
                        out[name].append(value)
        return out

    return common.arrow_rows(STRING, make)


def repeated_windows(texts: DataFrame, window: int = WINDOW, core: int = CORE, hot: int = HOT) -> DataFrame:
    """(doc, spans): per document the windows that start earlier elsewhere, as (tie, start, mask of offsets)."""
    new = texts.filter("first")
    often = _minimisers(new, window, core, once=False).groupBy("mini").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("mini", (F.col("n") > hot).alias("hot"))
    wanted = _minimisers(new, window, core, once=True).join(often, "mini").groupBy(F.col("doc").alias("in_doc"))
    wanted = wanted.agg(F.collect_set("mini").alias("minis"), F.collect_set(F.when(F.col("hot"), F.col("mini"))).alias("crowded"))
    places = new.join(wanted, new.doc == wanted.in_doc).select("doc", "raw", "tie", "minis", "crowded")
    places = places.mapInArrow(_places(window, core), "bucket bigint, pack bigint, doc bigint, tie bigint, start int, size int")
    place = F.struct("doc", "tie", "start").alias("place")
    packs = places.groupBy("bucket", "pack", "size").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"))
    own = packs.groupBy(F.col("first.doc").alias("in_doc"))
    own = own.agg(F.collect_list(F.struct("bucket", "pack", "first.tie", "first.start", "size", "n")).alias("own"))
    strings = new.join(own, new.doc == own.in_doc).select("doc", "raw", "tie", "own")
    strings = strings.mapInArrow(_strings(window), "bucket bigint, pack bigint, doc bigint, tie bigint, start int, n bigint, packed string")
    in_buckets = strings.repartition("bucket").withColumn("words", F.split("packed", " "))
    windows = F.transform(
        F.sequence(F.lit(0), F.size("words") - window),
        lambda i: F.array_join(F.slice("words", i + 1, window), " "),
    )
    first = F.struct("doc", "tie", "start").alias("first")
    cut = in_buckets.select("bucket", "pack", first, "n", F.posexplode(windows).alias("at", "window"))
    own_place = F.struct("first.doc", "first.tie", (F.col("first.start") + F.col("at")).alias("start")).alias("own")
    cut = cut.select("bucket", "pack", "first", "n", "at", F.md5("window").alias("window"), own_place)
    same = common.window_of("bucket", "window")
    counted = cut.withColumns({"total": F.sum("n").over(same), "owner": F.min("own").over(same)}).filter("total > 1")
    bit = F.expr("shiftleft(1L, at)")
    owned = F.when(F.col("owner") == F.col("own"), bit).otherwise(0)
    masks = counted.groupBy("bucket", "pack", "first").agg(F.bit_or(bit).alias("mask"), F.bit_or(owned).alias("owned"))
    found = places.select("bucket", "pack", place).join(masks, ["bucket", "pack"])
    left = F.when(F.col("place") == F.col("first"), F.col("mask").bitwiseAND(F.bitwise_not("owned"))).otherwise(F.col("mask"))
    found = found.select("place.*", left.alias("mask")).filter("mask <> 0")
    return found.groupBy("doc").agg(F.collect_list(F.struct("tie", "start", "mask")).alias("spans"))


def kept_words(words: list[bytes], starts: np.ndarray, masks: np.ndarray, window: int) -> list[bytes]:
    if not len(starts):
        return words
    hits = np.flatnonzero(np.unpackbits(masks.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").ravel())
    begins = starts[hits // 64] + hits % 64
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, begins, 1)
    np.add.at(edges, begins + window, -1)
    keep = np.flatnonzero(np.cumsum(edges[:-1]) == 0)
    return [words[i] for i in keep.tolist()]


def dedup(docs: DataFrame, window: int = WINDOW, core: int = CORE, hot: int = HOT) -> DataFrame:
    """(doc_id, text, n_words, n_removed, kept_sha256): the kept words joined by one space."""
    if not core < window <= 64 - core:
        raise ValueError("a window must be longer than its core and its masks fit 64 bits")
    texts = _texts(docs)
    found = repeated_windows(texts, window, core, hot).withColumnRenamed("doc", "in_doc")
    schema = pa.schema(
        [("doc_id", pa.int64()), ("text", pa.string()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())]
    )

    def make(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {name: [] for name in schema.names}
        for doc, raw, tie, first, spans in zip(*(batch.column(i) for i in range(5)), strict=True):
            doc, words = doc.as_py(), raw.as_py().split()
            if not first.as_py() and len(words) >= window:
                words_left: list[bytes] = []
            elif spans.is_valid:
                ties, starts, masks = (spans.values.field(i).to_numpy() for i in range(3))
                own = ties == tie.as_py()
                words_left = kept_words(words, starts[own].astype(np.int64), masks[own], window)
            else:
                words_left = words
            text = b" ".join(words_left)
            out["doc_id"].append(None if doc == NO_ID else doc)
            out["text"].append(text.decode())
            out["n_words"].append(len(words))
            out["n_removed"].append(len(words) - len(words_left))
            out["kept_sha256"].append(hashlib.sha256(text).hexdigest())
        return out

    joined = texts.join(found, texts.doc == found.in_doc, "left").select("doc", "raw", "tie", "first", "spans")
    return joined.mapInArrow(
        common.arrow_rows(schema, make), "doc_id bigint, text string, n_words bigint, n_removed bigint, kept_sha256 string"
    )
