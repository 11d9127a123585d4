"""Quality rules against plain Python."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pytest

from llm_cases import SCHEMA, edge_rows, fast_words, frame, prose
from playlens.llm import quality_rules

LICENSE = "Licensed under the terms of version 3, see the file number 12"


def rows_with_shared_lines():
    rng = random.Random(5)
    rows = edge_rows()
    for i in range(100, 130):  # the line differs in case, spaces and digits only
        line = [LICENSE, LICENSE.upper(), "  " + LICENSE.replace("12", "98"), LICENSE.replace(" ", " \t")][i % 4]
        own = " ".join(prose(rng, rng.choice([2, 3, 5, 12, 60])))
        rows.append((i, f"{own}\n{line}\n{line}\n{' '.join(prose(rng, 12))}", "en", rng.choice(["a", "a", None]), 1))
    copied = "\n".join(" ".join(prose(rng, 15)) for _ in range(6))
    rows += [(200 + i, copied, "en", "a", 1) for i in range(40)]  # copies of one text are one text
    repeated = prose(rng, 9)
    rows += [(300, " ".join(prose(rng, 30) + repeated + prose(rng, n) + repeated), "en", "c", 1) for n in (5, 40, 200)]
    return rows


def normal(line):
    return " ".join(fast_words(re.sub("[0-9]", "0", "".join(c.lower() if "A" <= c <= "Z" else c for c in line))))


def expected(rows, limit, least_left):
    texts = defaultdict(set)
    for _, text, _, source, _ in rows:
        for line in (text or "").split("\n"):
            texts[source, normal(line)].add(text or "")
    out = []
    for doc_id, text, _, source, _ in rows:
        text, lines = text or "", (text or "").split("\n")
        words = fast_words(text)
        runs = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
        covered = {i + k for i in range(len(words) - 7) if runs[tuple(words[i : i + 8])] > 1 for k in range(8)}
        with_words = [line for line in lines if fast_words(line)]
        gone = [line for line in with_words if len(texts[source, normal(line)]) > limit]
        lost, failed = sum(len(fast_words(line)) for line in gone), len(words) < 20 or 100 * len(covered) > 30 * len(words)
        kept = not failed and len(words) - lost >= len(words) * least_left
        left = "\n".join(line for line in lines if line not in gone) if kept else None
        counts = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(with_words) - len(set(with_words)), len(covered))
        out.append((doc_id, *counts, failed, kept, len(set(map(normal, gone))), lost, left))
    return out


def key(row):
    return tuple(str(value) for value in row)


@pytest.mark.parametrize("limit, least_left", [(10, 0.3), (2, 0.8)])
def test_equals_brute_force(spark, limit, least_left):
    rows = rows_with_shared_lines()
    docs = frame(spark, rows).repartition(6)
    want = expected(rows, limit, least_left)
    got = quality_rules.judge(docs, limit=limit, least_left=least_left).collect()
    assert sorted(map(key, got)) == sorted(key(row[:-1]) for row in want)
    assert 0 < sum(row[9] > 0 for row in want) and {row[7] for row in want} == {True, False}
    cleaned = quality_rules.cleaned(docs, limit=limit, least_left=least_left)
    assert cleaned.columns == docs.columns
    left = sorted(key((row.doc_id, row.text)) for row in cleaned.collect())
    assert left == sorted(key((row[0], row[-1])) for row in want if row[7])


def test_copies_of_a_text_stay(spark):
    rows = [(i, "\n".join(f"line {chr(97 + k)} " + "word " * 9 + chr(97 + k) for k in range(6)), "en", "a", 1) for i in range(50)]
    rows = [(i, re.sub("word", lambda m: f"w{hash(m.start()) % 977}", text), *rest) for i, text, *rest in rows]
    assert all(row.kept for row in quality_rules.judge(frame(spark, rows)).collect())


def test_runs_are_told_apart_within_a_text_only():
    rng = random.Random(3)
    texts = [[rng.choice([b"a", b"b"]) for _ in range(n)] for n in (0, 3, 7, 8, 9, 40, 300)] * 2
    for got, words in zip(quality_rules.repeated_words(texts), texts):
        runs = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
        assert got == len({i + k for i in range(len(words) - 7) if runs[tuple(words[i : i + 8])] > 1 for k in range(8)})


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert quality_rules.judge(docs).count() == 0 and quality_rules.cleaned(docs).count() == 0
