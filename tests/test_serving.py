"""Sinks, downloads, resumable runs, model boundaries and feature folders."""

import json
from functools import reduce
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import oracle
from clipquery.operators import answer, attribute, clean, dense, match, models, serve
from clipquery.plans import serving
from clipquery.sources import features, results

MIDDLE = "/root/testdata/sf0.01"


def rows_of(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_questions_and_features(spark, tmp_path):
    (tmp_path / "q.json").write_text(json.dumps([{"sample_id": 1, "question": "How?", "video_id": "a", "video_length": 9}, {"sample_id": 2, "video_id": None}]))
    assert rows_of(features.read_questions(spark, str(tmp_path / "q.json")).fillna(""), "sample_id", "question", "video_id") == [(1, "How?", "a"), (2, "", "")]
    vis = spark.createDataFrame([("a", "a_1", "uniform", "mean", "test"), ("b", "b_1", "adaptive", "mean", "val"), ("c", "c_1", None, None, "val")], "video_id string, segment_id string, sampling_strategy string, aggregation_method string, split string")
    for form in ("json", "parquet"):
        features.write_features(vis, f"{tmp_path}/{form}", form)
        features.write_features(vis.filter("split = 'val'"), f"{tmp_path}/{form}", form)
        back = getattr(spark.read, form)(f"{tmp_path}/{form}")
        assert back.count() == 5 and rows_of(back.filter("split = 'val'"), "video_id") == [("b",), ("b",), ("c",), ("c",)]
    got = features.read_features(spark, f"{tmp_path}/json", features.VISUAL)
    assert got.count() == 5 and got.filter("source_file like '%split=test%'").count() == 1
    assert rows_of(features.filter_visual(vis, "uniform"), "video_id") == [("a",)] and features.filter_visual(vis).count() == 3
    assert rows_of(features.filter_visual(vis, None, "mean"), "video_id") == [("a",), ("b",)]


def test_download_and_failures(spark):
    urls = spark.createDataFrame([("a", "u"), ("a", "u2"), ("b", "bad"), ("c", None), ("d", "there")], "video_id string, video_url string")

    def fetch(video, url):
        if url == "bad":
            raise OSError(video)
        return True

    got = results.download(urls, fetch, spark.createDataFrame([("d",)], "video_id string"))
    assert rows_of(got, "video_id", "ok") == [("a", True), ("b", False), ("d", True)] and rows_of(results.failed(got), "video_id") == [("b",)]
    assert results.download(urls.limit(0), fetch).count() == 0


def test_splits_and_evaluation(spark, tmp_path):
    frames = {s: spark.createDataFrame([(s, k) for k in range(4)], "s string, k int") for s in ("train", "val")}
    results.write_splits(frames, f"{tmp_path}/splits", lambda df: df.filter("k > 1"))
    assert rows_of(spark.read.json(f"{tmp_path}/splits"), "split", "k") == [("train", 2), ("train", 3), ("val", 2), ("val", 3)]
    summary = spark.createDataFrame([("iou", 0.5, 0.1, 0.5, 0.0, 1.0, 3)], "metric string, mean double, std double, median double, min double, max double, count long")
    results.save_evaluation(frames["val"], summary, f"{tmp_path}/eval", "Title")
    text = "\n".join(r.value for r in spark.read.text(f"{tmp_path}/eval/report").collect())
    assert text.startswith("# Title") and "| iou | 0.500 | 0.100 | 0.500 | 0.000 | 1.000 | 3 |" in text
    assert spark.read.json(f"{tmp_path}/eval/results").count() == 4


def test_report_rounds_exact_values(spark):
    kind = "metric string, mean double, std double, median double, min double, max double, count long"
    halves = [k / 2000 for k in range(1, 2000, 2)] + [0.4875, -0.0625, -0.0001, 1e20, float("nan")]
    rows = [(f"m{k:04}", x, x, x, x, x, 1) for k, x in enumerate(halves)]
    text = results.report(spark.createDataFrame(rows, kind), "T", 3).first()[0]
    assert text.splitlines()[6:] == [f"| {m} |" + f" {x:.3f} |" * 5 + " 1 |" for m, x, *_ in rows] and "| 0.487 |" in text
    none = spark.createDataFrame([], kind)
    assert results.report(none, "T", 3).first()[0].startswith("# T") and results.report(none, "T", 3, bare=False).first()[0] is None


def test_evaluation_report_as_its_sql(spark, tmp_path):
    for p in Path(MIDDLE).glob("*.parquet"):
        if p.stem != "benchmark":
            (tmp_path / p.name).symlink_to(p)
    spark.read.parquet(f"{MIDDLE}/benchmark.parquet").limit(0).write.parquet(f"{tmp_path}/benchmark.parquet")
    for d in (MIDDLE, str(tmp_path)):  # means of half a thousandth; no query at all
        assert oracle.differences(serving.evaluation_report(spark, d), oracle.connect(d), serving.SQL["evaluation_report"]) == []


def test_resume(spark, tmp_path):
    todo, seen = spark.range(10).toDF("query_id"), []

    def run(part):
        seen.append(part.count())
        return part.withColumn("x", F.col("query_id") * 2)

    assert results.resume(todo.filter("query_id < 4"), f"{tmp_path}/r", run, batches=2).count() == 4
    before = sum(seen)
    assert rows_of(results.resume(todo, f"{tmp_path}/r", run, batches=3), "query_id", "x") == [(k, 2 * k) for k in range(10)]
    assert before == 4 and sum(seen) == 10


def test_answer_json(spark, tmp_path):
    said = spark.createDataFrame([(1, "q", "a"), (2, "p", None)], "query_id long, query string, answer string")
    hits = spark.createDataFrame([(1, 2, "y"), (1, 1, "x")], "query_id long, rank int, segment_id string")
    results.write_json(results.answer_json(said, hits), f"{tmp_path}/j")
    got = sorted((json.loads(r.value) for r in spark.read.text(f"{tmp_path}/j").collect()), key=lambda r: r["query"], reverse=True)
    assert got[0] == {"query": "q", "search_results": [{"rank": 1, "segment_id": "x"}, {"rank": 2, "segment_id": "y"}], "generated_answer": {"answer": "a"}}
    assert got[1]["search_results"] == []


def test_models(spark):
    files = spark.createDataFrame([("a", "p"), ("b", "bad")], "video_id string, path string")

    def asr(path):
        if path == "bad":
            raise ValueError(path)
        return [(0.0, 1.5, "one"), (1.5, None, "two")]

    assert [(r.video_id, r.chunk_ix, r.text, tuple(r.ts)) for r in models.transcribe(files, asr).orderBy("chunk_ix").collect()] == [("a", 0, "one", (0.0, 1.5)), ("a", 1, "two", (1.5, None))]
    t = spark.createDataFrame([(1, "Aspirin for Flu"), (2, None)], "id int, t string")
    got = {r.id: (r.v, r.e) for r in t.select("id", models.encoder(lambda xs: [[len(x), 1] for x in xs])("t").alias("v"), models.tagger(lambda x: [w for w in x.split() if w[0].isupper()])("t").alias("e")).collect()}
    assert got == {1: ([15.0, 1.0], ["Aspirin", "Flu"]), 2: (None, [])}
    pairs = spark.createDataFrame([(1, "a", "a"), (2, "a", None)], "pair_id long, candidate string, reference string")
    same = lambda a, b: [float(x == y) for x, y in zip(a, b)]
    assert rows_of(models.bert_score(pairs, lambda a, b: (same(a, b),) * 3), "pair_id", "bert_score_f1") == [(1, 1.0), (2, 0.0)]
    assert rows_of(models.bert_score(pairs, lambda a, b: 1 / 0), "pair_id", "bert_score_recall") == [(1, 0.0), (2, 0.0)]
    claims = attribute.claims(spark.createDataFrame([(1, "Take water now.")], "answer_id long, text string"))
    ev = spark.createDataFrame([(1, 1, "unlike"), (1, 2, "Drink something")], "answer_id long, evidence_ix int, text string")
    best = attribute.attribute(claims, ev, None, models.pair_scorer(lambda a, b: [0.8 if y.startswith("Drink") else 0.1 for y in b])).first()
    assert (best.evidence_ix, best.support_level) == (2, "HIGH")


def test_cite(spark):
    df = spark.createDataFrame([("See [Evidence 1] and Evidence 2, not Evidence 12 or Evidence 3.", ["00:10-00:20", "01:00-01:05"])], "a string, t array<string>")
    assert df.select(answer.cite(F.col("a"), F.col("t"))).first()[0] == "See [Evidence 1, 00:10-00:20] and Evidence 2 (01:00-01:05), not Evidence 12 or Evidence 3."


def test_containing(spark):
    docs = spark.createDataFrame([(1, "xx one two three four five six yy"), (2, "one two three four five seven"), (3, "two cats"), (4, None), (5, "")], "doc_id long, text string")
    q = spark.createDataFrame([(1, "e two three four five s"), (2, "two"), (3, "one two three four five six yy zz")], "query_id long, passage string")
    assert rows_of(match.containing(docs, q), "query_id", "doc_id") == [(1, 1), (1, 2), (2, 1), (2, 2), (2, 3)]
    assert match.containing(docs.limit(0), q).count() == 0


@pytest.mark.parametrize("many", [False, True])
def test_knn(spark, monkeypatch, many):
    if many:
        monkeypatch.setattr(dense, "MATRIX_ROWS", 1)
    rng = np.random.default_rng(3)
    v = rng.integers(-2, 3, (60, 4)).astype(float)
    corpus = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "row_id long, v array<double>").repartition(3)
    q = corpus.filter("row_id < 5").select(F.col("row_id").alias("query_id"), F.col("v").alias("qv"))
    want = [(a, b, round(float(((v[a] - v[b]) ** 2).sum()), 6), r + 1) for a in range(5) for r, b in enumerate(sorted(range(60), key=lambda b: (((v[a] - v[b]) ** 2).sum(), b))[:7])]
    assert rows_of(dense.knn(q, corpus, 7), "query_id", "row_id", "distance", "rank") == sorted(want)
    assert dense.knn(q.limit(0), corpus, 7).count() == 0


def test_keep_first_and_precise(spark):
    r = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), (None, 5, "z"), (None, 6, "w")], "k string, o int, v string")
    assert sorted(x.v for x in clean.keep_first(r, ["k"], ["o"]).collect()) == ["y", "z"]
    segs = spark.createDataFrame([("v", "s", "t", [(1.0, 2.0), (3.0, 4.0)]), ("v", "n", "t", [])], "video_id string, segment_id string, text string, ts array<struct<start: double, end: double>>")
    hits = reduce(lambda a, b: a.unionAll(b), (spark.createDataFrame([("v", s)], "video_id string, segment_id string") for s in ("s", "n", "o")))
    assert sorted((x.segment_id, x.precise_start or -1.0) for x in serve.precise(hits, segs).collect()) == [("n", -1.0), ("o", -1.0), ("s", 3.0)]
