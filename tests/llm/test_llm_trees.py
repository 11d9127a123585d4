"""The prefix trie of conversations and the Merkle manifest against plain Python."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict
from hashlib import md5, sha256

import pytest

from llm_cases import SCHEMA, edge_rows, frame
from playlens.llm import merkle_manifest, prefix_trie

TURNS = "conv_id bigint, turn bigint, role string, text string, place string, a string, block string"


def h(text):
    return sha256(text.encode()).hexdigest()


# -- trie


def conversations():
    rng = random.Random(4)
    rows = []
    for c in [*range(0, 60), -7, -5, 10**12]:
        length = rng.choice([1, 2, 3, 8, 9, 16, 17, 40])
        rows += [(c, t, "user" if t % 2 == 0 else "assistant", f"é{c % 3 if t < 12 else c % 6} {t}") for t in range(length)]
    rows += [(100, None, "user", "first"), (100, 3, None, None), (100, 3, "user", "tie"), (100, 3, "user", "tie"), (100, 1, "user", "")]
    rows += [(101, 0, "user", "x" * 100_000), (None, 0, "user", "no conversation"), (102, None, None, None)]
    rows += [(c, t, "user", "same") for c in range(200, 230) for t in range(3)]
    rows += [(40, 5, "user", "é1 5")]  # a repeated turn number
    rng.shuffle(rows)
    return rows


def ordered(rows):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            turns[c].append((turn is not None, turn or 0, md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest(), role, text))
    return {c: [t[-2:] for t in sorted(found)] for c, found in turns.items()}


def rebuilt(given):
    out = {}
    for c, turns in given.items():
        n = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        out[c] = given.get(base, [])[:n] + turns[n:]
    return out


def expected_trie(given):
    members, parent, last = defaultdict(list), {}, {}
    for c, turns in given.items():
        for depth in range(len(turns) + 1):
            node = tuple(turns[:depth])
            members[node].append(c)
            if depth:
                parent[node], last[node] = node[:-1], node[-1][1]
    children, leaves, saved = Counter(parent.values()), Counter(), Counter()
    for node in sorted(members, key=len, reverse=True):
        leaves[node] += not children[node]
        saved[node] += (len(members[node]) - 1) * len(last.get(node, "").encode())
        if node:
            leaves[parent[node]] += leaves[node]
            saved[parent[node]] += saved[node]
    return sorted(
        (
            min(found), len(node), min(members[node[:-1]]) if node else -1, len(found), children[node], leaves[node], saved[node],
            h(",".join(str(c) for c in sorted(found) if len(given[c]) == len(node))),
        )
        for node, found in members.items()
    )


def collected(trie):
    return sorted(tuple(-1 if value is None else value for value in row) for row in trie.collect())


@pytest.mark.parametrize("width", [1, 3, 8])
def test_trie_equals_brute_force(spark, width):
    rows = conversations()
    frame = spark.createDataFrame([(*row, "x", "y", "z") for row in rows], TURNS).repartition(5)
    turns = prefix_trie.numbered(frame)
    members = prefix_trie.members_of(turns)
    assert collected(prefix_trie.trie(prefix_trie.rebuilt(turns), members, width=width)) == expected_trie(rebuilt(ordered(rows)))
    assert collected(prefix_trie.trie(turns, members, width=width)) == expected_trie(ordered(rows))


def test_ids_of_a_node_in_several_chunks(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK", 3)
    rows = [(c, 0, "user", "hello") for c in range(95, 120)]
    frame = spark.createDataFrame([(*row, "", "", "") for row in rows], TURNS)
    assert collected(prefix_trie.conversation_trie(frame)) == expected_trie(ordered(rows))


def test_empty_trie(spark):
    empty = spark.createDataFrame([], TURNS)
    assert prefix_trie.rebuilt_trie(empty).count() == 0 and prefix_trie.conversation_trie(empty).count() == 0


# -- manifest


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf(row, text):
    doc_id, _, lang, source, n_chars = row
    return h("".join(map(field, (doc_id, source, lang, n_chars, text))))


def climb(nodes):
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for path, i in zip(paths, at):
            start = i - i % 8
            path.append(("".join(nodes[start:i]), "".join(nodes[i + 1 : start + 8])))
        nodes, at = [h("".join(nodes[i : i + 8])) for i in range(0, len(nodes), 8)], [i // 8 for i in at]
    return nodes[0], paths


def expected_manifest(rows):
    langs = defaultdict(list)
    for row in rows:
        langs[row[2]].append(row)
    order = sorted(langs, key=lambda name: (name is not None, (name or "").encode()))
    trees = {}
    for name in order:
        langs[name].sort(key=lambda row: (row[0] is not None, row[0] or 0, bytes.fromhex(leaf(row, row[1]))))
        trees[name] = climb([leaf(row, row[1]) for row in langs[name]])
    root, upper = climb([trees[name][0] for name in order])
    out = []
    for name, above in zip(order, upper):
        for row, path in zip(langs[name], trees[name][1]):
            path, text = path + above, row[1]
            if row[0] is not None and text is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            node = leaf(row, text)
            for left, right in path:
                node = h(left + node + right)
            proof = h("".join(left + right for left, right in path))
            out.append((row[0], leaf(row, row[1]), trees[name][0], root, proof, node, node == root))
    return sorted(map(str, out))


def many_languages():
    rng = random.Random(9)
    rows = edge_rows()
    for i in range(100, 900):  # a language with half the rows, others of one to some dozen rows, more than eight of them
        lang = "hot" if rng.random() < 0.5 else rng.choice([f"l{n}" for n in range(int(rng.choice([1, 4, 70])))])
        rows.append((i, f"Text {i} É", lang, rng.choice(["a", None]), i))
    return rows


@pytest.mark.parametrize("levels", [0, 1, 4])
def test_manifest_equals_brute_force(spark, monkeypatch, levels):
    rows = many_languages()
    docs = frame(spark, rows).repartition(6)
    plain = merkle_manifest.manifest
    monkeypatch.setattr(merkle_manifest, "manifest", lambda docs, **options: plain(docs, **options, levels=levels))
    got = merkle_manifest.tampered(docs).collect()
    want = expected_manifest(rows)
    assert sorted(str(tuple(row)) for row in got) == want
    assert {row.verified for row in got} == {True, False}


@pytest.mark.parametrize("count", [1, 2, 8, 9, 65])
def test_small_trees(spark, count):
    rows = [(i, f"T{i}", "en", None, i) for i in range(count)]
    got = merkle_manifest.tampered(frame(spark, rows)).collect()
    assert sorted(str(tuple(row)) for row in got) == expected_manifest(rows)


def test_empty_manifest(spark):
    assert merkle_manifest.tampered(spark.createDataFrame([], SCHEMA)).count() == 0
