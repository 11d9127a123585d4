"""Token ids in binary shards with a minimal perfect hash index.

Documents are range partitioned and sorted by id; each task encodes its range and cuts it into shards. A
shard is one row of a written table: the raw little-endian ids of its documents, one after the other, and
its index, a minimal perfect hash of its document keys (levels of bit arrays, as BBHash has them). The hash
gives each key its own slot; the slot holds the key's fingerprint and the place of its ids. ``lookup`` finds the
shard of a key by its range and answers in constant time; a key that is not there fails on its fingerprint.

Defined results: a null or empty text is one document of only the end id; documents with a null id come first and
are in the file but not in the index; rows that repeat an id follow one another ordered by text and the index
points at the first; an empty table writes no shard; other columns of the input are not read.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from functools import cache, reduce
from itertools import groupby, islice

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from playlens.llm import common
from playlens.session import new_path

VOCABULARY, END_ID = "word_bpe_49k.json", 2
SHARD_TOKENS = 1 << 20
#: Chunks (text between white space) whose ids a Python worker remembers, and the longest of them.
KNOWN_CHUNKS, KNOWN_LENGTH = 500_000, 40
NO_ID = -(1 << 63)
LOOKUP_KEYS = 1000

SHARD_SCHEMA = (
    "part int, number int, first_key bigint, last_key bigint, n_docs bigint, n_ids bigint, width int, payload binary, "
    "levels array<binary>, prints binary, slots binary, keys binary, lengths binary"
)


# -- encoding


class ChunkEncoder:
    """Ids of whole texts, by the chunks between ASCII white space.

    The vocabulary's rules never join characters across white space, so a text's ids are those of its chunks.
    Frequent chunks are remembered. The rest are encoded by the library: chunks of plain Latin characters are
    lower-cased and split here by the file's own pattern and encoded many at a time, others go through its full rules.
    """

    #: Precomposed Latin: stable under NFC, and lower-cased alike everywhere.
    PLAIN = regex.compile(r"[\x21-\x7e\xc0-ɏ]+")
    WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
    #: What makes these rules hold for a vocabulary file.
    RULES = {
        "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}],
        "split": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+",
    }

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.full = Tokenizer.from_file(path)
        spec = json.loads(self.full.to_str())
        split, level = spec["pre_tokenizer"]["pretokenizers"]
        if spec["normalizer"]["normalizers"] != self.RULES["normalizers"] or split["pattern"] != {"Regex": self.RULES["split"]}:
            raise ValueError(f"{path} splits text by other rules")
        self.wide = self.full.get_vocab_size() > 1 << 16
        self.type = np.dtype("<u4" if self.wide else "<u2")
        spec |= {"normalizer": None, "added_tokens": []}
        spec["pre_tokenizer"] = {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, level]}
        self.words = Tokenizer.from_str(json.dumps(spec))
        ends = np.zeros(self.full.get_vocab_size(), bool)
        for token, number in spec["model"]["vocab"].items():
            ends[number] = token.endswith(spec["model"]["end_of_word_suffix"])
        self.ends = ends
        self.known: dict[bytes, bytes] = {}

    def _words(self, chunk: str) -> list[str]:
        low = chunk.lower()  # may add marks
        if low.isalpha():
            return [low]
        if low[:-1].isalpha() and not low[-1].isalnum():  # a word and one mark
            return [low[:-1], low[-1]]
        return self.WORDS.findall(low)

    def _plain(self, chunks: list[str]) -> list[bytes]:
        parts = [self._words(chunk) for chunk in chunks]
        lines = [" ".join(word for part in parts[i : i + 256] for word in part) for i in range(0, len(parts), 256)]
        ids = [np.array(line.ids, self.type) for line in self.words.encode_batch_fast(lines, add_special_tokens=False)]
        ids = np.concatenate(ids) if ids else np.empty(0, self.type)
        word_ends = np.concatenate([[0], np.flatnonzero(self.ends[ids]) + 1])
        counts = np.cumsum([0, *map(len, parts)])
        if counts[-1] != len(word_ends) - 1:
            raise ValueError("a word did not end in one end-of-word token")
        places, raw = (word_ends[counts] * self.type.itemsize).tolist(), ids.tobytes()
        return [raw[places[i] : places[i + 1]] for i in range(len(chunks))]

    def learn(self, chunks: list[bytes]) -> dict[bytes, bytes]:
        """Ids of different chunks; remembers them while there is room."""
        words = [chunk.decode() for chunk in chunks]
        easy = [i for i, word in enumerate(words) if "<|" not in word and self.PLAIN.fullmatch(word)]
        hard = sorted(set(range(len(words))) - set(easy))
        found = dict(zip((chunks[i] for i in easy), self._plain([words[i] for i in easy]), strict=True))
        for i, ids in zip(hard, self.full.encode_batch([words[i] for i in hard], add_special_tokens=False), strict=True):
            found[chunks[i]] = np.array(ids.ids, self.type).tobytes()
        room = KNOWN_CHUNKS - len(self.known)
        if room > 0:
            short = (item for item in found.items() if len(item[0]) <= KNOWN_LENGTH)
            self.known.update(islice(short, room))
        return found

    def encode(self, raws: list[bytes]) -> list[bytes]:
        get, texts, missing = self.known.get, [], []
        for raw in raws:
            chunks = raw.split()
            ids = list(map(get, chunks))
            at = -1
            for _ in range(ids.count(None)):
                at = ids.index(None, at + 1)
                missing.append((ids, at, chunks[at]))
            texts.append(ids)
        found = self.learn(list({chunk for _, _, chunk in missing}))
        for ids, at, chunk in missing:
            ids[at] = found[chunk]
        return [b"".join(ids) for ids in texts]


@cache
def encoder(vocabulary: str) -> ChunkEncoder:
    return ChunkEncoder(public_tokenizers.path(vocabulary))


# -- minimal perfect hash


def _mix(keys: np.ndarray, level: int) -> np.ndarray:
    """Pseudorandom 64-bit values of keys, another function for each level."""
    x = keys.astype(np.uint64) + np.uint64((level * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _print_of(keys: np.ndarray) -> np.ndarray:
    return (_mix(keys, 1_000_003) >> np.uint64(32)).astype("<u4")


def build_levels(keys: np.ndarray) -> list[bytes]:
    """Bit arrays for distinct keys: a level's bit is set where exactly one of the keys left over falls."""
    levels = []
    while len(keys):
        size = max(8, -(-len(keys) * 3 // 2 // 8) * 8)
        places = (_mix(keys, len(levels)) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(places, minlength=size) == 1
        levels.append(np.packbits(alone, bitorder="little").tobytes())
        keys = keys[~alone[places]]
    return levels


def slots_of(keys: np.ndarray, levels: list[bytes]) -> np.ndarray:
    """The slot of each key: its bit's rank among all set bits; -1 where no level has its bit."""
    out, before = np.full(len(keys), -1, np.int64), 0
    left = np.arange(len(keys))
    for number, level in enumerate(levels):
        bits = np.unpackbits(np.frombuffer(level, np.uint8), bitorder="little")
        places = (_mix(keys[left], number) % np.uint64(len(bits))).astype(np.int64)
        hit = bits[places] == 1
        out[left[hit]] = before + np.cumsum(bits, dtype=np.int64)[places[hit]] - 1
        before += int(bits.sum(dtype=np.int64))
        left = left[~hit]
    return out


# -- shards


def make_shard(part: int, number: int, keys: list[int], docs: list[bytes], width: int) -> dict:
    lengths = np.array([len(doc) // width for doc in docs], "<i8")
    places = np.cumsum(lengths) - lengths
    all_keys = np.array(keys, "<i8")
    named, first = np.unique(all_keys, return_index=True)
    named, first = named[named != NO_ID], first[named != NO_ID]
    levels = build_levels(named)
    slots = slots_of(named, levels)
    prints, table = np.zeros(len(named), "<u4"), np.zeros((len(named), 2), "<i8")
    prints[slots] = _print_of(named)
    table[slots] = np.stack([places[first], lengths[first]], axis=1)
    return {
        "part": part,
        "number": number,
        "first_key": keys[0],
        "last_key": keys[-1],
        "n_docs": len(keys),
        "n_ids": int(lengths.sum()),
        "width": width,
        "payload": b"".join(docs),
        "levels": levels,
        "prints": prints.tobytes(),
        "slots": table.tobytes(),
        "keys": all_keys.tobytes(),
        "lengths": lengths.tobytes(),
    }


def _arrow_schema() -> pa.Schema:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "array<binary>": pa.list_(pa.binary())}
    return pa.schema([(name, kinds[kind]) for name, kind in (field.split(" ") for field in SHARD_SCHEMA.split(", "))])


def write_token_files(
    docs: DataFrame, path: str, vocabulary: str = VOCABULARY, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS
) -> None:
    """Encode every whole text, append ``end_id`` to each, and write shards in ascending id order.

    A shard ends where it has ``shard_tokens`` ids, never between rows of one id.
    """
    schema = _arrow_schema()

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(vocabulary)
        width, end = tool.type.itemsize, np.array([end_id], tool.type).tobytes()
        part, number, keys, texts, held = 0, 0, [], [], 0

        def batch_of() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([make_shard(part, number, keys, texts, width)], schema=schema)

        for batch in common.pieces(batches):
            part = batch.column(2)[0].as_py()
            rows = zip(batch.column(0).to_pylist(), tool.encode(batch.column(1).to_pylist()), strict=True)
            for key, same in groupby(rows, key=lambda row: row[0]):
                if held >= shard_tokens * width and key != keys[-1]:
                    yield batch_of()
                    number, keys, texts, held = number + 1, [], [], 0
                for _, ids in same:
                    keys.append(key)
                    texts.append(ids + end)
                    held += len(ids) + width
        if keys:
            yield batch_of()

    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("key"), common.whole_text().cast("binary").alias("raw")
    )
    ordered = rows.repartitionByRange("key").sortWithinPartitions("key", "raw").withColumn("part", F.spark_partition_id())
    with common.text_batches(docs.sparkSession):
        ordered.mapInArrow(shards, SHARD_SCHEMA).write.option("compression", "zstd").parquet(path)


def _with_places(shards: DataFrame) -> DataFrame:
    """Shards with ``base``, the ids of all shards before. Only one row of numbers per shard is ordered."""
    sizes = shards.select(F.col("part").alias("in_part"), F.col("number").alias("at"), "n_ids")
    before = F.sum("n_ids").over(Window.orderBy("in_part", "at")) - F.col("n_ids")
    bases = sizes.select("in_part", "at", before.alias("base"))
    return shards.join(bases, (shards.part == bases.in_part) & (shards.number == bases.at))


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, indexed) of every document, from the shards.

    The place of a document's ids comes from the index; rows that the index does not point at (null or repeated ids)
    are taken from the list of lengths.
    """
    schema = pa.schema(
        [("doc_id", pa.int64()), ("part", pa.int32()), ("number", pa.int32()), ("place", pa.int64())]
        + [("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("indexed", pa.bool_())]
    )

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in (row for batch in batches for i in range(batch.num_rows) for row in batch.slice(i, 1).to_pylist()):
            keys, lengths = np.frombuffer(shard["keys"], "<i8"), np.frombuffer(shard["lengths"], "<i8")
            ids = np.frombuffer(shard["payload"], f"<u{shard['width']}")
            places = np.cumsum(lengths) - lengths
            slots, table = slots_of(keys, shard["levels"]), np.frombuffer(shard["slots"], "<i8").reshape(-1, 2)
            first = np.concatenate([[True], keys[1:] != keys[:-1]]) & (keys != NO_ID)
            ok = _print_of(keys[first]) == np.frombuffer(shard["prints"], "<u4")[slots[first]]
            if not ok.all():
                raise ValueError("a key of the shard is not in its index")
            places[first], lengths = table[slots[first], 0], lengths.copy()
            lengths[first] = table[slots[first], 1]
            checks = [zlib.crc32(ids[p : p + n].astype("<u4").tobytes()) for p, n in zip(places.tolist(), lengths.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([None if key == NO_ID else key for key in keys.tolist()], pa.int64()),
                    pa.array(np.full(len(keys), shard["part"]), pa.int32()),
                    pa.array(np.full(len(keys), shard["number"]), pa.int32()),
                    pa.array(places, pa.int64()),
                    pa.array(lengths, pa.int64()),
                    pa.array(checks, pa.int64()),
                    pa.array(first),
                ],
                schema=schema,
            )

    shards = spark.read.schema(SHARD_SCHEMA).parquet(path)
    found = shards.mapInArrow(
        documents, "doc_id bigint, part int, number int, place bigint, n_tokens bigint, ids_crc32 bigint, indexed boolean"
    )
    bases = _with_places(shards.select("part", "number", "n_ids")).select("in_part", "at", "base")
    joined = found.join(bases, (found.part == bases.in_part) & (found.number == bases["at"]))
    return joined.select("doc_id", (F.col("base") + F.col("place")).alias("start"), "n_tokens", "ids_crc32", "indexed")


def lookup(spark: SparkSession, path: str, keys: list[int]) -> DataFrame:
    """(key, ids) for those of at most ``LOOKUP_KEYS`` keys that are in the files.

    The key ranges select the shards (a filter that reaches the scan), the perfect hash the slot, the slot the ids.
    Larger sets are a join with ``read_token_files``.
    """
    if len(keys) > LOOKUP_KEYS:
        raise ValueError(f"at most {LOOKUP_KEYS} keys at once")
    shards = spark.read.schema(SHARD_SCHEMA).parquet(path)
    ranges = [(F.col("first_key") <= F.lit(key)) & (F.col("last_key") >= F.lit(key)) for key in set(keys)]
    chosen = reduce(Column.__or__, ranges, F.lit(False))
    wanted = np.unique(np.array(keys, np.int64))
    schema = pa.schema([("key", pa.int64()), ("ids", pa.list_(pa.int64()))])

    def answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in (row for batch in batches for i in range(batch.num_rows) for row in batch.slice(i, 1).to_pylist()):
            keys = wanted[(wanted >= shard["first_key"]) & (wanted <= shard["last_key"])]
            slots = slots_of(keys, shard["levels"])
            prints, table = np.frombuffer(shard["prints"], "<u4"), np.frombuffer(shard["slots"], "<i8").reshape(-1, 2)
            ids = np.frombuffer(shard["payload"], f"<u{shard['width']}")
            there = slots >= 0
            there[there] = prints[slots[there]] == _print_of(keys[there])
            found = [ids[p : p + n].tolist() for p, n in table[slots[there]].tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(keys[there], pa.int64()), pa.array(found, schema.field(1).type)], schema=schema)

    needed = shards.filter(chosen).select("first_key", "last_key", "levels", "prints", "slots", "payload", "width")
    return needed.mapInArrow(answers, "key bigint, ids array<bigint>")


def token_files(docs: DataFrame, name: str = "token_files", **options) -> tuple[str, DataFrame]:
    """Write to a new folder of the shared working folder; its path and the documents read back."""
    path = new_path(docs.sparkSession, name)
    write_token_files(docs, path, **options)
    return path, read_token_files(docs.sparkSession, path)
