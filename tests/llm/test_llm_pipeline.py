"""Registered queries against their SQL, and the pipeline stage by stage."""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from llm_cases import edge_rows, frame
from parity import compare, database
from playlens.llm import queries
from playlens.llm.common import store


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, sf_dir, name):
    verdict, _, _, note = compare(spark, database(sf_dir), sf_dir, name, queries.QUERIES[name], queries.ORACLES[name])
    assert verdict == "ok", note


def test_every_operator_is_registered_once():
    numbers = sorted(int(name[2:].split("_")[0]) for name in entry.queries() if name.startswith("op"))
    assert numbers == list(range(1, 14)) and "pipeline" in entry.queries()
    assert set(queries.ORACLES) <= set(entry.oracle_sql())


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """What each stage returns, over the given documents with awkward rows among them."""
    given = spark.read.parquet(f"{sf_dir}/documents.parquet")
    awkward = frame(spark, [(None if r[0] is None else 10_000 + r[0], *r[1:]) for r in edge_rows()], clashes=False)
    docs = store(given.unionByName(awkward), "given")
    out = {"given": docs}
    for name, stage in corpus_pipeline.STAGES:
        docs = store(stage(spark, docs, sf_dir), name)
        out[name] = docs
    return out


def test_stages_return_documents_and_only_drop(stages):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "simhash_near_dedup", "decontamination", "mixing", "token_files"]
    before = stages["given"]
    for name in names[:3]:
        now = stages[name]
        assert now.columns == before.columns
        assert now.exceptAll(before).count() == 0 and 0 < now.count() < before.count()
        before = now
    assert stages["mixing"].columns == before.columns
    assert stages["mixing"].select("doc_id").exceptAll(before.select("doc_id")).count() == 0


def test_language_stage_keeps_documents_with_words(stages):
    gone = stages["given"].exceptAll(stages["language_id"]).collect()
    assert all(not any(c.isalpha() for c in r.text or "") or r.doc_id is None or r.doc_id >= 10_000 for r in gone)
    assert len(gone) >= 4


def test_tokens_are_those_of_the_mixed_texts(stages):
    tool = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    start, want = 0, []
    for r in sorted(stages["mixing"].collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text)):
        ids = np.array([*tool.encode(r.text, add_special_tokens=False).ids, 2], "<u4")
        want.append((r.doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = [tuple(r) for r in stages["token_files"].collect()]
    assert sorted(got, key=lambda r: r[1]) == want


def test_stages_take_an_empty_table(spark, sf_dir, stages):
    docs = stages["given"].limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = store(stage(spark, docs, sf_dir), name)
        assert docs.count() == 0
