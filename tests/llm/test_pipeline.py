"""The corpus pipeline, stage by stage, each against brute force on what the stage before kept."""

from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from clipquery.llm import queries
from conftest import SMALL
from test_llm_operators import DOCS, check_packing, components_by_hand, docs_of, messy, shingles


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The rows that go into the first stage and come out of each."""
    top, docs = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{SMALL}/documents.parquet")
    out = [docs]
    for k, (_, f) in enumerate(corpus_pipeline.STAGES):
        f(spark, docs, SMALL).write.parquet(f"{top}/{k}")
        docs = spark.read.parquet(f"{top}/{k}")
        out.append(docs)
    return out


def test_columns(stages):
    assert all(s.columns == stages[0].columns for s in stages[1:-1])


def test_toxicity(spark, stages):
    before, after = ({r.doc_id for r in s.collect()} for s in stages[:2])
    rejected = {r.doc_id for r in queries.op1_toxicity(spark, SMALL).filter("predicted = 1").collect()}
    assert after == before - rejected


def test_exact(stages):
    best = defaultdict(list)
    for r in stages[1].collect():
        best[r.text].append(r.doc_id)
    assert sorted(r.doc_id for r in stages[2].collect()) == sorted(max(ids) for ids in best.values())


def test_near(stages):
    rows = sorted((r.doc_id, r.text) for r in stages[2].collect())
    root = components_by_hand([shingles(t, 5) for _, t in rows])
    assert sorted(r.doc_id for r in stages[3].collect()) == [i for k, (i, _) in enumerate(rows) if root[k] == k]


def test_mix(stages):
    before = {r.doc_id: r for r in stages[3].collect()}
    times = Counter(r.doc_id for r in stages[4].collect())
    assert set(times) <= set(before) and max(times.values()) <= 3
    assert all(r == before[r.doc_id] for r in stages[4].collect())


def test_pack(spark, stages):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.vocabulary())
    docs, pieces = stages[4].collect(), stages[5].collect()
    assert sum(p.length for p in pieces) == sum(len(tok.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in docs)
    once = {i for i, n in Counter(r.doc_id for r in docs).items() if n == 1}
    by = defaultdict(int)
    for p in pieces:
        by[p.sequence_id] += p.length
    assert max(by.values()) <= 2048
    alone = [p for p in pieces if p.doc_id in once]
    assert {p.doc_id for p in alone} == once


def test_run(spark, stages):
    got = corpus_pipeline.run(spark, SMALL)
    assert got.columns == stages[5].columns and got.count() == stages[5].count()


def test_messy_rows_and_no_rows(spark, tmp_path):
    """Nulls in every column, null and repeated ids, empty and long texts, more columns with names used inside."""
    bare = {200, 201, 202}
    for name, rows in (("messy", messy()), ("empty", [])):
        docs = docs_of(spark, rows) if rows else spark.createDataFrame([], DOCS)
        for k, (stage, f) in enumerate(corpus_pipeline.STAGES[:-1]):
            f(spark, docs, SMALL).write.parquet(f"{tmp_path}/{name}{k}")
            after = spark.read.parquet(f"{tmp_path}/{name}{k}")
            assert after.columns == docs.columns and after.count() <= docs.count() * (3 if stage == "source mix" else 1)
            docs = after
        pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).collect()
        left = [r.doc_id for r in docs.collect()]
        assert {p.doc_id for p in pieces} == set(left) and (rows or not pieces)
        if rows:  # of equal texts (null is empty) the largest id stays, of rows without words each
            assert bare & set(left) == {201, 202} and {400, 401} <= set(left)
            assert not {300, 301} <= set(left)
