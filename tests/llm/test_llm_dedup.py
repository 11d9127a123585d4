"""Exact, line, substring and SimHash dedup against plain Python."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import pytest
import xxhash

from llm_cases import SPACE, edge_rows, fast_words, frame, lowered, words_of
from playlens.llm import exact_dedup, line_dedup, simhash_dedup, substring_dedup


@pytest.fixture(scope="module")
def rows():
    return edge_rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows).repartition(5)


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def index(spark, name):
    import uuid

    return exact_dedup.DigestIndex(spark, f"{name}_{uuid.uuid4().hex}", buckets=4)


def test_exact_dedup_equals_brute_force(spark, docs, rows):
    normal = {i: "".join(c for c in r[1] or "" if c not in SPACE) for i, r in enumerate(rows)}
    groups = defaultdict(list)
    for i, text in normal.items():
        groups[text].append(i)
    want = Counter()
    for text, members in groups.items():
        best = min(members, key=lambda i: (-len(rows[i][1] or ""), rows[i][0] is None, rows[i][0] or 0))
        for i in members:
            want[(rows[i][0], rows[best][0], len(members), i == best, sha(text))] += 1
    got = index(spark, "brute").add(docs)
    assert Counter(tuple(r) for r in got.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()) == want
    assert sum(n for key, n in want.items() if key[3]) == len(groups)


def test_exact_dedup_index_persists_and_appends(spark):
    store = index(spark, "persist")
    first = store.add(frame(spark, [(1, "a b", None, None, 0), (2, "c", None, None, 0)]))
    assert {(r.doc_id, r.kept) for r in first.collect()} == {(1, True), (2, True)}
    again = exact_dedup.DigestIndex(spark, store.table, buckets=4)
    second = again.add(frame(spark, [(3, "a   b longer", None, None, 0), (4, "a  b", None, None, 0), (5, "d", None, None, 0)]))
    assert {(r.doc_id, r.keep_id, r.kept) for r in second.collect()} == {(3, 3, True), (4, 1, False), (5, 5, True)}
    assert again.entries().count() == 4
    repeat = again.add(frame(spark, [(1, "a b", None, None, 0)]))
    assert [(r.keep_id, r.kept) for r in repeat.collect()] == [(1, True)]
    assert again.add(frame(spark, [])).count() == 0


def test_line_dedup_equals_brute_force(docs, rows):
    def key(line):
        return lowered(line.strip(SPACE))

    def order(doc_id):
        return -(1 << 63) if doc_id is None else doc_id

    held = defaultdict(list)
    for r in rows:
        for k in {key(line) for line in (r[1] or "").split("\n")}:
            if len(k) >= 20:
                held[k].append(order(r[0]))
    last = {k: max(ids) for k, ids in held.items() if len(ids) >= 3}
    want, dropped = Counter(), 0
    for r in rows:
        lines = (r[1] or "").split("\n")
        keep = [last.get(key(line), order(r[0])) == order(r[0]) for line in lines]
        kept = "\n".join(line for line, ok in zip(lines, keep, strict=True) if ok)
        runs, state = [0], True
        for ok in keep:
            if ok != state:
                runs, state = [*runs, 0], ok
            runs[-1] += 1
        want[(r[0], len(lines), len(lines) - sum(keep), kept, ",".join(map(str, runs)))] += 1
        dropped += len(lines) - sum(keep)
    for hot in (1000, 2):  # unsplit and split keys
        got = line_dedup.dedup(docs, hot=hot).select("doc_id", "n_lines", "n_dropped", "text", "keep_runs")
        assert Counter(tuple(r) for r in got.collect()) == want
    assert dropped > 20


def test_substring_dedup_equals_brute_force(docs, rows):
    def order(r):
        return (-(1 << 63) if r[0] is None else r[0], r[1] or "")

    # Rows of one id come in the order of their text hashes; here such rows share no window.
    first = {}
    for r in sorted(set(rows), key=order):
        words = fast_words(r[1])
        for i in range(len(words) - 19):
            first.setdefault(tuple(words[i : i + 20]), (order(r), i))
    want = Counter()
    for r in rows:
        words = fast_words(r[1])
        gone = set()
        for i in range(len(words) - 19):
            if first[tuple(words[i : i + 20])] != (order(r), i):
                gone.update(range(i, i + 20))
        want[(r[0], len(words), len(gone), " ".join(w for i, w in enumerate(words) if i not in gone))] += 1
    assert sum(key[2] for key in want) > 5000
    for hot in (2000, 3):  # packed runs, and windows that travel singly
        got = substring_dedup.dedup(docs, hot=hot).select("doc_id", "n_words", "n_removed", "text")
        assert Counter(tuple(r) for r in got.collect()) == want


def test_words_are_split_at_six_characters():
    text = "a b\x1cc d\x0be\r\nf"
    assert words_of(text) == fast_words(text) == ["a b\x1cc d", "e", "f"]


def test_long_words_hash_alike_at_any_place():
    word = b"x" * 5000
    giant = b"y" * 70_000
    texts = [b"a " + word + b" " + giant + b" b", giant + b" " + word, b"q " * 40_000 + word]
    found = [substring_dedup.word_hashes(text) for text in texts]
    assert found[0][1] == found[1][1] == found[2][-1]
    assert found[0][2] == found[1][0]
    assert len(found[2]) == 40_001 and len(set(found[2][:-1].tolist())) == 1


def plain_fingerprint(text):
    words = fast_words(lowered(text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def test_simhash_equals_brute_force(spark):
    base = "one two three four five six seven eight nine ten " * 30
    rows = edge_rows()[:20] + [(100 + i, base + f"tail {i}", "en", "a", 0) for i in range(12)] + [(90, "", None, None, 0), (0, "  ", None, None, 0)]
    prints = [plain_fingerprint(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                parent[root(i)] = root(j)
    smallest = {}
    for i, r in enumerate(rows):
        known = [x for x in (smallest.get(root(i)), r[0]) if x is not None]
        smallest[root(i)] = min(known, default=None)
    want = Counter((r[0], prints[i], smallest[root(i)]) for i, r in enumerate(rows))
    docs = frame(spark, rows).repartition(4)
    got = Counter((r.doc_id, r.fp % (1 << 64), r.component_id) for r in simhash_dedup.components(docs).collect())
    assert got == want
    kept = simhash_dedup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    found = [(r.doc_id, plain_fingerprint(r.text)) for r in kept.select("doc_id", "text").collect()]
    of_print = {prints[i]: root(i) for i in range(len(rows))}
    assert sorted(of_print[fp] for _, fp in found) == sorted({root(i) for i in range(len(rows))})
    assert all(doc_id == smallest[of_print[fp]] for doc_id, fp in found)


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 200), (200, 300), (7, 7)]
    got = {r.node: r.root for r in simhash_dedup.connected_components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 200: 100, 300: 100}


def test_empty_tables(spark):
    none = frame(spark, [])
    assert line_dedup.dedup(none).count() == 0
    assert substring_dedup.dedup(none).count() == 0
    assert simhash_dedup.components(none).count() == 0
    assert simhash_dedup.drop_near_duplicates(none).count() == 0
