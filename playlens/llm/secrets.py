"""Secret scans: patterns, and character Markov models for strings that no pattern names.

Patterns give the base spans. Every other run of 16 and more characters of the secret alphabet is scored by two
variable-order character models, one of random strings and one of ordinary identifiers: where the mean
log-likelihood ratio per character is over the threshold, the run is a span of kind ``model``.

The models are trained from labelled samples of the documents themselves: values that the patterns found are random
strings, other long runs are identifiers unless they may be secrets without a pattern: a first model of ordinary
strings knows only short words that stand in several texts, and ``REFITS`` times the runs that the last model finds nearer
to random strings are left out before the next one is fitted. Random strings may use characters that no pattern value
has: half of their chances are even. The sample is bounded by ``SAMPLE_DOCS`` documents and ``SAMPLE_VALUES``
different values of a label. Half of the values fit the models, the other half sets the threshold, so that at most
``FALSE_RATE`` of the identifiers that are left lie above it. Scanning itself covers every whole text and needs no shuffle.

Defined results: a null or empty text has no spans; without any labelled random string or identifier the models add
nothing; repeated rows give repeated results; ids may be null or repeat; other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playlens.llm import common

KINDS = ("assign", "access", "hex", "model")
SAMPLE_DOCS, SAMPLE_VALUES, SAMPLE_LENGTH, FALSE_RATE = 20_000, 20_000, 256, 1e-4
#: Rounds that clean the identifiers; the share of even chances among those of random strings.
REFITS, EVEN = 2, 0.5

#: The base patterns and their least lengths.
ASSIGN = re.compile(
    r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ASSIGN_LENGTH = 12
#: Greedy runs: asking for the least length finds the same matches as dropping shorter ones.
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
#: Every access and hex match lies inside one of these.
RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
IDENTIFIER = re.compile(r"[A-Za-z0-9+/_=-]{12,}")
#: Too short to be labelled or scored.
WORD = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z]{3,11}(?![A-Za-z0-9+/_=-])")

_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-."
#: Class 0 stands before the first character and for characters outside the alphabet.
_CLASS = np.zeros(256, np.int64)
_CLASS[np.frombuffer(_ALPHABET.encode(), np.uint8)] = np.arange(1, len(_ALPHABET) + 1)
SIZE = len(_ALPHABET) + 1


def base_spans(text: str) -> tuple[list[tuple[int, int, int]], list[str], list[tuple[int, int]]]:
    """(start, end, kind) of the pattern matches, their values, and the runs that no match touches."""
    spans, values, runs = [], [], []
    if ":" in text or "=" in text:
        for match in ASSIGN.finditer(text):
            if len(match[2]) >= ASSIGN_LENGTH:
                spans.append((match.start(), match.end(), 0))
                values.append(match[2])
    for run in RUN.finditer(text):
        runs.append(run.span())
        for kind, pattern in ((1, ACCESS), (2, HEX)):
            for match in pattern.finditer(text, run.start(), run.end()):
                spans.append((match.start(), match.end(), kind))
                values.append(match[0])
    order = sorted(range(len(spans)), key=lambda i: (spans[i][0], spans[i][2]))
    spans, values = [spans[i] for i in order], [values[i] for i in order]
    return spans, values, _untouched(runs, spans)


def _untouched(runs: list[tuple[int, int]], spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """The runs that no span overlaps; both lists are ordered by start."""
    if not spans:
        return runs
    free, reach, at = [], -1, 0
    for start, end in runs:
        while at < len(spans) and spans[at][0] < end:
            reach, at = max(reach, spans[at][1]), at + 1
        if reach <= start:
            free.append((start, end))
    return free


# -- models


def classes(value: str) -> np.ndarray:
    return _CLASS[np.frombuffer(value.encode("latin-1", "replace"), np.uint8)]


def log_model(values: list[str]) -> np.ndarray:
    """log P(c | a b) as a table [a, b, c]: each order is smoothed by the order below, the lowest by even chances.

    The weight of an order is n / (n + d) with n characters and d different characters seen after its context.
    """
    triples = np.zeros((SIZE, SIZE, SIZE))
    for value in values:
        padded = np.concatenate([[0, 0], classes(value)])
        np.add.at(triples, (padded[:-2], padded[1:-1], padded[2:]), 1)
    chances = np.full(SIZE, 1 / SIZE)
    for counts in (triples.sum((0, 1)), triples.sum(0), triples):
        total, different = counts.sum(-1, keepdims=True), (counts > 0).sum(-1, keepdims=True)
        chances = (counts + different * chances) / np.maximum(total + different, 1) + np.where(total > 0, 0, chances)
    return np.log(chances)


def score(table: np.ndarray, value: str) -> float:
    """Mean log-likelihood ratio per character."""
    padded = np.concatenate([[0, 0], classes(value)])
    return float(table[padded[:-2], padded[1:-1], padded[2:]].mean())


def random_model(values: list[str]) -> np.ndarray:
    return np.log((1 - EVEN) * np.exp(log_model(values)) + EVEN / SIZE)


def clean_identifiers(random: np.ndarray, ordinary: list[str], words: list[str]) -> list[str]:
    """The values of ``ordinary`` that are nearer to ``words``, and to one another, than to random strings."""
    clean: list[str] = []
    for _ in range(REFITS):
        table = random - log_model(words + clean)
        clean = [value for value in ordinary if score(table, value) <= 0]
    return clean


class Model:
    """The table of log-likelihood ratios and the threshold. Without ``words`` all of ``ordinary`` count as identifiers."""

    def __init__(self, random: list[str], ordinary: list[str], false_rate: float = FALSE_RATE, words: list[str] | None = None):
        drawn = [sorted(set(random))[i::2] for i in range(2)]
        chances = random_model(drawn[0])
        words = sorted({form for word in words or [] for form in (word.lower(), word.upper(), word.capitalize())})
        names = sorted(set(ordinary))
        names = clean_identifiers(chances, names, words) if words else names
        self.table = (chances - log_model(words + names[::2])).astype(np.float32)
        scores = np.sort([score(self.table, value) for value in names[1::2]])
        allowed = int(false_rate * len(scores))
        self.threshold = max(0.0, float(scores[-1 - allowed])) if len(scores) else 0.0
        self.recall = float(np.mean([score(self.table, value) > self.threshold for value in drawn[1]] or [0]))

    def is_secret(self, value: str) -> bool:
        return score(self.table, value) > self.threshold


def labelled_values(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_values: int = SAMPLE_VALUES) -> tuple[list[str], list[str], list[str]]:
    """(random strings, long runs, short words of several texts) of a sample of documents chosen by hash."""
    raw = docs.select(common.whole_text().alias("text"))
    share = min(1.0, sample_docs / max(1, raw.count()))
    sample = raw.withColumn("tie", F.xxhash64("text")).filter(common.sampled(F.col("text"), share))
    schema = pa.schema([("label", pa.string()), ("value", pa.string()), ("low", pa.int64()), ("high", pa.int64())])

    def make(batch: pa.RecordBatch) -> dict:
        ends: dict[tuple[str, str], tuple[int, int]] = {}
        for text, tie in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            spans, values, _ = base_spans(text)
            rows = {("random", value[:SAMPLE_LENGTH]) for value in values}
            long_runs = [match.span() for match in IDENTIFIER.finditer(text)]
            rows.update(("ordinary", text[start:end][:SAMPLE_LENGTH]) for start, end in _untouched(long_runs, spans))
            rows.update(("word", word.lower()) for word in set(WORD.findall(text)))
            for row in rows:
                low, high = ends.get(row, (tie, tie))
                ends[row] = min(low, tie), max(high, tie)
        columns = list(zip(*((*row, *end) for row, end in ends.items()), strict=True)) or [[]] * 4
        return dict(zip(schema.names, map(list, columns), strict=True))

    found = sample.mapInArrow(common.arrow_rows(schema, make), "label string, value string, low bigint, high bigint")
    found = found.groupBy("label", "value").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    found = common.store(found.filter((F.col("label") != "word") | (F.col("low") < F.col("high"))).select("label", "value"), "labelled")
    out = []
    for label in ("random", "ordinary", "word"):
        chosen = found.filter(F.col("label") == label).orderBy(F.xxhash64("value"), "value").limit(sample_values).collect()
        out.append([row.value for row in chosen])
    return out[0], out[1], out[2]


def train(docs: DataFrame) -> Model | None:
    random, ordinary, words = labelled_values(docs)
    return Model(random, ordinary, words=words) if len(random) > 1 and len(ordinary) > 1 else None


def scan(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_model, base_sha256, spans) of every whole text."""
    schema = pa.schema(
        [("doc_id", pa.int64())] + [(f"n_{kind}", pa.int64()) for kind in KINDS] + [("base_sha256", pa.string()), ("spans", pa.string())]
    )

    def written(spans: list[tuple[int, int, int]]) -> str:
        return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, end, kind in spans)

    def make(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {name: [] for name in schema.names}
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            base, _, runs = base_spans(text)
            more = [(start, end, 3) for start, end in runs if model and model.is_secret(text[start:end])]
            spans = sorted(base + more, key=lambda span: (span[0], span[2]))
            out["doc_id"].append(doc_id)
            for kind, name in enumerate(KINDS):
                out[f"n_{name}"].append(sum(span[2] == kind for span in spans))
            out["base_sha256"].append(hashlib.sha256(written(base).encode()).hexdigest())
            out["spans"].append(written(spans))
        return out

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.whole_text().alias("text"))
    counts = ", ".join(f"n_{kind} bigint" for kind in KINDS)
    return rows.mapInArrow(common.arrow_rows(schema, make), f"doc_id bigint, {counts}, base_sha256 string, spans string")
