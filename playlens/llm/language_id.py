"""Language identification of words in code-switched text by a linear-chain conditional random field.

Every word (a run of non-white-space with a letter) is labelled. Its features are byte n-grams of the lower-cased word
between boundary marks (those with a mark are its affixes) and whether a lexicon of frequent words has it; weights
are hashed. Transitions between the labels of neighbouring words are learned with them. Labels are read by
forward-backward over the whole text, however long: a text is cut into chunks whose transfer matrices are multiplied
first, so the work is done for all chunks of a batch at once and is exact. A document's language has the largest
share of posterior mass; its score is that share.

The model is fitted on a bounded sample (``SAMPLE_DOCS`` documents a language, ``SAMPLE_RUNS`` runs of ``RUN_WORDS``
words of each), whose runs are strung together so that the language switches inside a sequence. Only the text and ``lang``
of documents outside the held-out fold are learned from.

Defined results: a null text, or one without a letter, is ``und`` with score 0, and so is every text if there is nothing
to learn from; a null id is in the fold of the empty text; repeated rows give repeated results; other columns are not
read. Only the ``MOST_LANGUAGES`` most frequent languages are learned.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from playlens.llm import common

FOLDS, SEED = 5, 20240301
SAMPLE_DOCS, SAMPLE_RUNS, RUN_WORDS, MOST_LANGUAGES = 300, 24, 16, 500
SEQUENCE, ROUNDS, RATE, DECAY = 32, 40, 0.15, 1e-6
BUCKETS, NGRAMS, LEXICON = 1 << 16, (2, 3, 4), 20_000
CHUNK, KNOWN_WORDS = 64, 150_000
UNDETERMINED = "und"
#: Sequences of a gradient that are in memory together.
AT_ONCE = 1000
_EDGE = bytes(range(0x21, 0x41)) + bytes(range(0x5B, 0x61)) + bytes(range(0x7B, 0x7F))
_PRIME = np.uint64(0x100000001B3)


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)) == 0


def core(token: bytes) -> bytes | None:
    """The token without ASCII marks and digits at its ends; None if it has no letter."""
    word = token.strip(_EDGE)
    if word.isalpha() or any(c.isalpha() for c in word.decode("utf-8", "ignore")):
        return word
    return None


def tokens(text: str) -> list[bytes]:
    return text.lower().encode().split()


def ngram_buckets(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, word number) of every n-gram of the words between boundary marks."""
    flat = np.frombuffer(b"".join(b"\x01" + word + b"\x02" for word in words), np.uint8).astype(np.uint64)
    lengths = np.array([len(word) + 2 for word in words], np.int64)
    owner = np.repeat(np.arange(len(words)), lengths)
    buckets, owners = [], []
    for n in NGRAMS:
        count = max(0, len(flat) - n + 1)
        values = np.full(count, 14695981039346656037 + n, np.uint64)
        for i in range(n):
            values = (values ^ flat[i : i + count]) * _PRIME
        inside = owner[:count] == owner[n - 1 : n - 1 + count]
        values = values[inside]
        buckets.append(((values ^ (values >> np.uint64(29))) % np.uint64(BUCKETS)).astype(np.int64))
        owners.append(owner[:count][inside])
    return np.concatenate(buckets), np.concatenate(owners)


# -- the chain


def _scaled(values: np.ndarray, axes: tuple[int, ...]) -> np.ndarray:
    return values / values.max(axis=axes, keepdims=True)


def marginals(potentials: np.ndarray, valid: np.ndarray, first: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """Posterior label chances for chunks of words.

    ``potentials`` (chunks, words, labels) are positive; ``valid`` (chunks, words) marks words, which come first in their
    chunk; ``first`` marks a text's first chunk, and the chunks of a text follow one another.
    """
    chunks, size, labels = potentials.shape
    numbers = np.arange(chunks)
    at = numbers - np.maximum.accumulate(np.where(first, numbers, 0))  # place of the chunk in its text
    inner = np.broadcast_to(np.eye(labels), (chunks, labels, labels)).copy()
    many = np.flatnonzero((at > 0) | np.append(at[1:] > 0, False))  # a text of one chunk needs no transfer matrix
    part = inner[many]
    for t in range(size):
        step = _scaled((part @ transitions) * potentials[many, t][:, None, :], (1, 2))
        part = np.where(valid[many, t][:, None, None], step, part)
    inner[many] = part
    before, after = np.full((chunks, labels), 1.0), np.full((chunks, labels), 1.0)
    order = np.argsort(at, kind="stable")
    levels = np.split(order, np.flatnonzero(np.diff(at[order])) + 1)
    for level in levels[1:]:
        before[level] = _scaled(np.einsum("ki,kij->kj", before[level - 1], inner[level - 1]), (1,))
    for level in reversed(levels[1:]):
        after[level - 1] = _scaled(np.einsum("kij,kj->ki", inner[level], after[level]), (1,))
    ahead = np.empty((size, chunks, labels))
    now = before
    for t in range(size):
        now = np.where(valid[:, t, None], _scaled((now @ transitions) * potentials[:, t], (1,)), now)
        ahead[t] = now
    back, now = np.empty((size, chunks, labels)), after
    for t in range(size - 1, -1, -1):
        back[t] = now
        now = np.where(valid[:, t, None], _scaled((now * potentials[:, t]) @ transitions.T, (1,)), now)
    joint = ahead * back
    joint /= joint.sum(-1, keepdims=True)
    return joint.transpose(1, 0, 2) * valid[:, :, None]


class Model:
    """Hashed feature weights, lexicon and transitions."""

    def __init__(self, languages: list[str], weights: np.ndarray, in_lexicon: np.ndarray, lexicon: dict[bytes, int], transitions: np.ndarray):
        self.languages, self.weights, self.in_lexicon, self.lexicon = languages, weights, in_lexicon, lexicon
        self.transitions = transitions
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.table = np.empty((0, len(self.languages)))

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("known", "table")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._forget()

    def emissions(self, words: list[bytes]) -> np.ndarray:
        """Scores of words for every label."""
        out = np.zeros((len(words), len(self.languages)))
        if words:
            buckets, owners = ngram_buckets(words)
            for label in range(len(self.languages)):
                out[:, label] = np.bincount(owners, self.weights[buckets, label], len(words))
            entries = np.array([self.lexicon.get(word, -1) for word in words])
            out[entries >= 0] += self.in_lexicon[entries[entries >= 0]]
        return out

    def numbers(self, texts: list[list[bytes]]) -> list[list[int]]:
        """For every token of the texts its row of ``table``, -1 without a letter; recent tokens are remembered."""
        if len(self.known) > KNOWN_WORDS:
            self._forget()
        known = self.known
        new = list({token for text in texts for token in text if token not in known})
        words = [core(token) for token in new]
        named = [i for i, word in enumerate(words) if word is not None]
        self.table = np.concatenate([self.table, self.emissions([words[i] for i in named])])
        rows = dict(zip(named, range(len(self.table) - len(named), len(self.table)), strict=True))
        known.update((token, rows.get(i, -1)) for i, token in enumerate(new))
        return [[known[token] for token in text] for text in texts]

    def shares(self, texts: list[str]) -> np.ndarray:
        """Posterior mass of every label in every text; all zero for a text without words."""
        rows = [np.array(row, np.int64) for row in self.numbers([tokens(text) for text in texts])]
        rows = [row[row >= 0] for row in rows]
        total = np.zeros((len(texts), len(self.languages)))
        owners = [i for i, row in enumerate(rows) for _ in range(0, len(row), CHUNK)]
        if not owners:
            return total
        filled = np.full((len(owners), CHUNK), -1, np.int64)
        at = 0
        for row in rows:
            count = -(-len(row) // CHUNK)
            filled[at : at + count].reshape(-1)[: len(row)] = row
            at += count
        valid, owners = filled >= 0, np.array(owners)
        scores = self.table[filled]
        potentials = np.exp(scores - scores.max(-1, keepdims=True))
        found = marginals(potentials, valid, np.diff(owners, prepend=-1) > 0, self.transitions)
        np.add.at(total, owners, found.sum(1))
        return total / np.maximum(1, np.array([len(row) for row in rows]))[:, None]

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        shares = self.shares(texts)
        best = shares.argmax(1)
        none = shares.sum(1) == 0
        names = [UNDETERMINED if no else self.languages[i] for i, no in zip(best, none, strict=True)]
        return names, np.clip(shares[np.arange(len(texts)), best], 0, 1).tolist()


# -- learning


def sample_runs(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, runs: int = SAMPLE_RUNS, words: int = RUN_WORDS) -> list[tuple[str, list[bytes]]]:
    """(lang, words) of runs from a bounded sample of labelled documents outside the held-out fold."""
    labelled = docs.select(F.col("doc_id").cast("long").alias("doc"), F.col("lang").cast("string").alias("lang"), common.whole_text().alias("text"))
    labelled = labelled.filter(F.col("doc").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc")))
    counts = labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGUAGES).collect()
    if not counts:
        return []
    # Hashes leave about four times the sample of each language, whatever its share, before rows are ranked.
    shares = docs.sparkSession.createDataFrame([(row.lang, min(1.0, 4 * sample_docs / row["count"])) for row in counts], "lang string, share double")
    near = labelled.select("lang", "doc").join(F.broadcast(shares), "lang")
    near = near.filter(F.pmod(F.xxhash64("doc"), F.lit(1_000_000)) <= F.col("share") * 1_000_000)
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc"), "doc"))
    chosen = near.withColumn("place", place).filter(F.col("place") <= sample_docs).select("doc").distinct()
    schema = pa.schema([("lang", pa.string()), ("run", pa.string())])

    def make(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {"lang": [], "run": []}
        for doc, lang, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            found = [word for word in map(core, tokens(text)) if word is not None]
            starts = range(0, len(found), words)
            if len(starts) > runs:
                starts = np.random.default_rng([SEED, doc & 0xFFFFFFFF]).choice(np.array(starts), runs, replace=False).tolist()
            out["lang"] += [lang] * len(starts)
            out["run"] += [b" ".join(found[start : start + words]).decode() for start in starts]
        return out

    # At most SAMPLE_DOCS ids of MOST_LANGUAGES languages are broadcast.
    rows = labelled.join(F.broadcast(chosen), "doc", "left_semi").select("doc", "lang", "text")
    found = rows.mapInArrow(common.arrow_rows(schema, make), "lang string, run string").collect()
    return sorted((row.lang, row.run.encode().split()) for row in found)


def _chain_gradient(potentials: np.ndarray, gold: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gold minus expected counts: per word and label, and per pair of labels (transitions before exponentiation)."""
    count, size, labels = potentials.shape
    ahead, back = np.empty_like(potentials), np.empty_like(potentials)
    now = np.ones((count, labels))
    for t in range(size):
        ahead[:, t] = now = _scaled((now @ transitions) * potentials[:, t], (1,))
    now = np.ones((count, labels))
    for t in range(size - 1, -1, -1):
        back[:, t] = now
        now = _scaled((now * potentials[:, t]) @ transitions.T, (1,))
    joint = ahead * back
    words = np.eye(labels)[gold] - joint / joint.sum(-1, keepdims=True)
    pairs = np.zeros((labels, labels))
    for t in range(1, size):
        both = ahead[:, t - 1, :, None] * transitions * (potentials[:, t] * back[:, t])[:, None, :]
        pairs -= (both / both.sum((1, 2), keepdims=True)).sum(0)
    np.add.at(pairs, (gold[:, :-1].ravel(), gold[:, 1:].ravel()), 1)
    return words, pairs


def fit(runs: list[tuple[str, list[bytes]]], rounds: int = ROUNDS) -> Model | None:
    """Maximise the conditional log-likelihood of switching sequences by Adam over the whole sample, a part at a time in memory."""
    runs = [run for run in runs if run[1]]
    if not runs:
        return None
    languages = sorted({lang for lang, _ in runs})
    number = {lang: i for i, lang in enumerate(languages)}
    counts = Counter((word, number[lang]) for lang, words in runs for word in words)
    best: dict[bytes, tuple[int, int]] = {}
    for (word, label), n in sorted(counts.items()):
        best[word] = max(best.get(word, (0, 0)), (n, -label))
    frequent = sorted((word for word in best if best[word][0] > 2), key=lambda word: (-best[word][0], word))[:LEXICON]
    lexicon = {word: -best[word][1] for word in frequent}
    random = np.random.default_rng(SEED)
    order = random.permutation(len(runs))
    words = [word for i in order for word in runs[i][1]]
    gold = np.array([number[runs[i][0]] for i in order for _ in runs[i][1]])
    length = min(SEQUENCE, len(words))
    usable = len(words) // length * length
    types = {word: i for i, word in enumerate(dict.fromkeys(words))}
    rows = np.array([types[word] for word in words[:usable]]).reshape(-1, length)
    gold = gold[:usable].reshape(-1, length)
    buckets, owners = ngram_buckets(list(types))
    entries = np.array([lexicon.get(word, -1) for word in types])
    labels = len(languages)
    weights = {"ngram": np.zeros((BUCKETS, labels)), "lexicon": np.zeros((labels, labels)), "chain": np.zeros((labels, labels))}
    moments = {name: (np.zeros_like(value), np.zeros_like(value)) for name, value in weights.items()}
    for turn in range(1, rounds + 1):
        scores = np.stack([np.bincount(owners, weights["ngram"][buckets, k], len(types)) for k in range(labels)], 1)
        scores[entries >= 0] += weights["lexicon"][entries[entries >= 0]]
        scores = np.exp(scores - scores.max(1, keepdims=True))
        by_type, pairs, transitions = np.zeros((len(types), labels)), np.zeros((labels, labels)), np.exp(weights["chain"])
        for start in range(0, len(rows), AT_ONCE):
            part = rows[start : start + AT_ONCE]
            by_word, by_pair = _chain_gradient(scores[part], gold[start : start + AT_ONCE], transitions)
            by_type += np.stack([np.bincount(part.ravel(), by_word[:, :, k].ravel(), len(types)) for k in range(labels)], 1)
            pairs += by_pair
        known = entries >= 0
        gradients = {
            "ngram": np.stack([np.bincount(buckets, by_type[owners, k], BUCKETS) for k in range(labels)], 1),
            "lexicon": np.stack([np.bincount(entries[known], by_type[known, k], labels) for k in range(labels)], 1),
            "chain": pairs,
        }
        for name, value in weights.items():
            gradient = gradients[name] / usable - DECAY * value
            mean, square = moments[name]
            mean += 0.1 * (gradient - mean)
            square += 0.01 * (gradient**2 - square)
            value += RATE * (mean / (1 - 0.9**turn)) / (np.sqrt(square / (1 - 0.99**turn)) + 1e-9)
    return Model(languages, weights["ngram"].astype(np.float32), weights["lexicon"], lexicon, np.exp(weights["chain"]))


def train(docs: DataFrame) -> Model | None:
    return fit(sample_runs(docs))


def _predict(model: Model | None, texts: list[str]) -> tuple[list[str], list[float]]:
    return model.predict(texts) if model else ([UNDETERMINED] * len(texts), [0.0] * len(texts))


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every whole text. No shuffle."""
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def make(batch: pa.RecordBatch) -> dict:
        names, scores = _predict(model, batch.column(2).to_pylist())
        return {"doc_id": batch.column(0), "held_out": batch.column(1), "lang_pred": names, "score": scores}

    doc_id = F.col("doc_id").cast("long")
    rows = docs.select(doc_id.alias("doc_id"), held_out(doc_id).alias("held_out"), common.whole_text().alias("text"))
    return rows.mapInArrow(common.arrow_rows(schema, make), "doc_id bigint, held_out boolean, lang_pred string, score double")


def identified(docs: DataFrame, model: Model | None) -> DataFrame:
    """The columns and rows of ``docs`` that have a language, however many they switch between; all rows if there is no model."""
    if model is None:
        return docs

    @F.arrow_udf("boolean")
    def accepted(texts: pa.Array) -> pa.Array:
        out: list[bool] = []
        for start in range(0, len(texts), common.TEXT_ROWS):
            out += [name != UNDETERMINED for name in model.predict(texts.slice(start, common.TEXT_ROWS).to_pylist())[0]]
        return pa.array(out, pa.bool_())

    return docs.filter(accepted(common.whole_text()))
