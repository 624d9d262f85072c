"""Odd values and the plans of queries that failed on larger tables."""

import random
import re
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

import oracle
from clipquery.operators import dense, match, nearest, serve, sparse
from clipquery.plans import catalogue
from clipquery.sources.tables import table
from conftest import SMALL


def test_frame_sampling_of_empty_and_long_segments(spark, tmp_path):
    spark.createDataFrame([(1, 0.0), (2, -1.0), (3, 12.0), (4, 1e12)], "event_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    q = catalogue.QUERIES["frame_sampling"](spark, str(tmp_path))
    assert oracle.differences(q.filter("event_id < 4"), oracle.connect(str(tmp_path)), catalogue.SQL["frame_sampling"] + " WHERE event_id < 4") == []
    assert q.filter("event_id = 4").first().n_adaptive == 8


def shuffles_of(df, column):
    """How many shuffles of the plan hold a column."""
    jvm = df.sparkSession._jvm
    plan = df._jdf.queryExecution().explainString(jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    return sum(bool(re.search(rf"\b{column}#", x)) for x in re.findall(r"\) Exchange\nInput \[\d+\]: (.*)", plan))


def test_extended_text_moves_texts_once(spark):
    docs = spark.createDataFrame([("v", " ".join(f"w{i}" for i in range(20)))], "video_id string, text string")
    s = spark.createDataFrame([("v", f"v_{i}", i * 4, i * 4 + 4, float(i), i + 0.5) for i in range(5)] + [("v", "lone", 1, 3, None, None)], "video_id string, segment_id string, start_token int, end_token int, range_start double, range_end double")
    got = {r.segment_id: (r.n_segments, r.extended_text, r.range_start, r.range_end) for r in serve.extended_text(s, docs).collect()}
    assert got["v_2"] == (5, " ".join(f"w{i}" for i in range(20)), 0.0, 4.5)
    assert got["v_0"] == (3, " ".join(f"w{i}" for i in range(12)), 0.0, 2.5) and got["lone"] == (1, "w1 w2", None, None)
    assert shuffles_of(catalogue.QUERIES["extended_text"](spark, SMALL), "text") <= 1


def test_bm25_and_shared_terms_in_blocks(spark, monkeypatch):
    """Blocks of two queries and of single documents give the rows of one block, ties and rare terms too."""
    rng = random.Random(5)
    docs = [(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 12)))) for i in range(60)] + [(60, None), (61, "a b"), (62, "a b")]
    docs = spark.createDataFrame(docs, "doc_id int, text string").repartition(3)
    asked = spark.createDataFrame([(str(i), t) for i, t in enumerate(["a b", "c c d", "zz", "e f g h a", "h", "", "b a"])], "query_id string, text string")
    search_ = lambda: (sparse.bm25(docs, asked, 4), sparse.shared(docs, asked, 4))
    whole = [sorted(map(tuple, x.collect())) for x in search_()]
    by_join = [r for r in sparse.bm25(docs, asked, None).collect() if r["rank"] <= 4]
    assert whole[0] == sorted(map(tuple, by_join))
    monkeypatch.setattr(nearest, "QUERIES", 2)
    monkeypatch.setattr(nearest, "CELLS", 1)
    assert [sorted(map(tuple, x.collect())) for x in search_()] == whole
    texts = {r.doc_id: set((r.text or "").split()) for r in docs.collect()}
    for query, terms in (("0", {"a", "b"}), ("3", set("efgha"))):
        near = sorted((rounded_up(1 - len(terms & t) / len(terms | t)), i) for i, t in texts.items() if terms & t)[:4]
        assert near == [(d, i) for q, i, d, _ in sorted(whole[1], key=lambda r: r[3]) if q == query]
    assert sparse.shared(docs.limit(0), asked, 4).count() == 0


def rounded_up(x):
    return float(Decimal(repr(x)).quantize(Decimal("0.000001"), ROUND_HALF_UP))


@pytest.mark.parametrize("name", ["bm25_topk", "generated_answers", "diversity_sample", "evidence_list", "relevance_score", "adaptive_select", "bm25_expanded", "citation_injection", "conflict_resolution", "evaluation_rates", "fused_distance", "fusion_contribution"])
def test_pairs_of_query_and_document_are_not_shuffled(spark, name):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        q = catalogue.QUERIES[name](spark, SMALL)
        assert shuffles_of(q, "dl") + shuffles_of(q, "nd") + shuffles_of(q, "n_chars") == 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_containing_by_join(spark, monkeypatch):
    """The same rows whether runs are looked up in the document's row or joined."""
    docs, asked = table(spark, SMALL, "documents").select("doc_id", "text"), table(spark, SMALL, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("passage"))
    got = [sorted(map(tuple, match.containing(docs, asked).collect()))]
    monkeypatch.setattr(match, "RUNS", 0)
    got.append(sorted(map(tuple, match.containing(docs, asked).collect())))
    assert got[0] == got[1] and got[0]


@pytest.mark.parametrize("name", ["average_precision", "retrieval_metrics", "reciprocal_rank"])
def test_passages_are_looked_for_once(spark, name):
    q = catalogue.QUERIES[name](spark, SMALL)
    q.collect()
    final = q._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert final.count("explode(array_distinct(filter(") == 1


@pytest.mark.parametrize("kind", ["long", "string"])
def test_knn_of_many_queries(spark, monkeypatch, kind):
    """Queries that aren't held, in blocks: the same rows as by brute force, by products of matrices and not by pairs of rows."""
    rng = np.random.default_rng(4)
    v = rng.integers(-2, 3, (50, 4)).astype(float)
    ids = [x if kind == "long" else f"{x:02}" for x in range(50)]
    corpus = spark.createDataFrame([(i, x.tolist()) for i, x in zip(ids, v)], f"row_id {kind}, v array<double>").repartition(3)
    q = corpus.filter("cast(row_id as int) < 7").select(F.col("row_id").alias("query_id"), F.col("v").alias("qv"))
    d = ((v[:7, None] - v[None]) ** 2).sum(2)
    want = sorted((ids[a], ids[b], d[a, b], r + 1) for a in range(7) for r, b in enumerate(np.lexsort((np.arange(50), d[a]))[:5]))
    got = lambda: sorted(map(tuple, dense.knn(q, corpus, 5).select("query_id", "row_id", "distance", "rank").collect()))
    assert got() == want
    for name, n in (("HELD", 1), ("MATRIX_ROWS", 2), ("BLOCK_ROWS", 3)):
        monkeypatch.setattr(dense, name, n)
        assert got() == want


@pytest.mark.parametrize("name", ["dense_knn_l2", "results_export", "video_multimodal", "segment_multimodal", "similarity_transforms", "overfetch_rerank"])
def test_searches_by_products_of_matrices(spark, monkeypatch, name):
    """With many queries for a matrix and for the driver: the rows of the SQL, and no distance by pairs of rows."""
    for limit, n in (("MATRIX_ROWS", 3), ("HELD", 1), ("BLOCK_ROWS", 100)):
        monkeypatch.setattr(dense, limit, n)
    q = catalogue.QUERIES[name](spark, SMALL)
    assert "zip_with(qv" not in q._jdf.queryExecution().optimizedPlan().toString()
    if name in catalogue.SQL:
        assert oracle.differences(q, oracle.connect(SMALL), catalogue.SQL[name]) == []


def test_length_of_a_vector_is_worked_out_once(spark):
    plan = dense.normalized_vectors(spark.range(1).select(F.array(F.col("id")).alias("embedding")))._jdf.queryExecution().optimizedPlan().toString()
    assert max(line.count("SQRT(") for line in plan.split("\n")) <= 1 and "array(SQRT(" in plan
