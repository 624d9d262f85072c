"""Operators on small literals, against values worked out by hand or by brute force."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from clipquery.functions import text as T
from clipquery.functions.synonyms import expand
from clipquery.operators import aggregate, answer, attribute, clean, curate, dense, evaluate, explore, fusion, segments, sparse, textmetrics
from clipquery.sources import features
from clipquery.streaming import ingest


def one(spark, expr, **cols):
    return spark.createDataFrame([tuple(cols.values())], list(cols)).select(expr.alias("x")).first()[0]


def test_ranking_metrics(spark):
    hits = spark.createDataFrame([(1, f"seg_{i}", i) for i in range(1, 6)], "query_id int, doc_id string, rank int")
    truth = spark.createDataFrame([(1, "seg_1"), (1, "seg_3"), (1, "seg_7")], "query_id int, doc_id string")
    m = evaluate.judged(hits, truth)
    pr = evaluate.precision_recall(m).first()
    assert (pr.precision_5, pr.recall_5, pr.precision_10) == (0.4, 0.666667, 0.2)
    assert evaluate.average_precision(m).first()[1] == round(5 / 9, 6)
    ideal = sum(1 / math.log2(i + 1) for i in range(1, 4))
    assert evaluate.ndcg(m).first()[1] == round((1 + 1 / math.log2(4)) / ideal, 6)
    assert evaluate.reciprocal_rank(m).first()[1] == 1.0


def test_attribution_accuracy(spark):
    p = spark.createDataFrame([(1, 0, 1), (1, 1, 2), (1, 2, 9)], "answer_id int, claim_ix int, evidence_ix int")
    t = spark.createDataFrame([(1, 0, 1), (1, 1, 2), (1, 2, 3)], "answer_id int, claim_ix int, evidence_ix int")
    assert tuple(attribute.accuracy(p, t).first())[1:] == (0.666667, 0.666667, 0.666667, 0.0)


def test_attribution_levels_and_quotes(spark):
    c = attribute.claims(spark.createDataFrame([(1, "Wash the wound with water. Evidence 2 says rest. Dr. Who flies.")], "answer_id int, text string"))
    assert [r.claim for r in c.orderBy("claim_ix").collect()] == ["Wash the wound with water", "Evidence 2 says rest", "Dr. Who flies."]
    e = spark.createDataFrame([(1, 1, "First look. Wash the wound with water"), (1, 2, "Sleep a lot")], "answer_id int, evidence_ix int, text string")
    rows = {r.claim_ix: r for r in attribute.attribute(c, e).collect()}
    assert rows[0].support_level == "HIGH" and rows[0].exact_quote == "Wash the wound with water"
    assert (rows[1].evidence_ix, rows[1].support_level, rows[1].similarity) == (2, "HIGH", 1.0)
    assert rows[2].support_level == "UNSUPPORTED" and rows[2].evidence_ix is None
    clash = spark.createDataFrame([(1, 1)], "answer_id int, evidence_ix int")
    marked = {r.claim_ix: r.support_level for r in attribute.attribute(c, e, clash).collect()}
    assert marked == {0: "CONFLICTED", 1: "HIGH", 2: "UNSUPPORTED"}
    assert attribute.stats(attribute.attribute(c, e, clash)).first().confidence == round((0.3 + 1 + 0) / 3, 6)


def union(spans):
    out = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def test_interval_union_and_overlap(spark):
    rng = random.Random(3)
    rows = [(v, a, a + rng.randrange(0, 9)) for v in range(30) for a in (rng.randrange(50) for _ in range(rng.randrange(1, 9)))]
    got = segments.interval_union(spark.createDataFrame(rows, "v int, start int, end int"), ["v"]).collect()
    for v in range(30):
        assert sorted([r.start, r.end] for r in got if r.v == v) == union([(a, b) for w, a, b in rows if w == v])
    preds = spark.createDataFrame([("a", 0.0, 10.0), ("a", 5.0, 20.0)], "k string, start double, end double")
    truth = spark.createDataFrame([("a", 10.0, 30.0), ("b", 1.0, 2.0)], "k string, gs double, ge double")
    o = {r.k: r for r in evaluate.temporal_overlap(preds, truth, "k").collect()}
    assert (o["a"].iou, o["a"].temporal_precision, o["a"].temporal_recall, o["a"].center_distance) == (round(10 / 30, 6), 0.5, 0.5, 11.25)
    assert (o["b"].iou, o["b"].center_distance) == (0.0, None)


def test_windows_and_coverage(spark):
    text = " ".join(f"w{i}" for i in range(150))
    w = segments.windows(spark.createDataFrame([("v", text), ("short", "one two"), ("none", None)], "video_id string, text string"), 40, 20)
    rows = w.filter("video_id = 'v'").orderBy("window_id").collect()
    assert [(r.start_token, r.end_token) for r in rows] == [(s, min(s + 40, 150)) for s in range(0, 150, 20) if min(s + 40, 150) - s >= 10]
    assert w.filter("video_id <> 'v'").count() == 0
    kept, e = [], 0
    for r in rows:
        new = max(0, r.end_token - max(r.start_token, e))
        if new / (r.end_token - r.start_token) >= 0.6:
            kept.append(r.segment_id)
            e = max(e, r.end_token)
    assert {r.segment_id for r in segments.keep_new_coverage(w, 0.6).collect()} == set(kept)
    same = spark.createDataFrame([("v", 0, "h"), ("v", 1, "h"), ("w", 0, "h")], "video_id string, window_id int, content_hash string")
    assert segments.keep_new_text(same).count() == 2


def test_extended_context_needs_abutting_windows(spark):
    s = spark.createDataFrame([("v", f"v_{i}", i * 4, i * 4 + 4) for i in range(5)] + [("w", f"w_{i}", i * 3, i * 3 + 4) for i in range(5)], "video_id string, segment_id string, start_token int, end_token int")
    got = {r.segment_id: (r.n_segments, r.first_token, r.last_token) for r in segments.extended(s, 2).collect()}
    assert got["v_2"] == (5, 0, 20) and got["v_0"] == (3, 0, 12) and got["w_2"] == (1, 6, 10)


def bm25_by_hand(docs, query, k1=1.5, b=0.75):
    toks = {d: t.lower().split() for d, t in docs}
    n, avg = len(docs), sum(map(len, toks.values())) / len(docs)
    terms = {t for ts in toks.values() for t in ts}
    idf = {t: math.log((n - sum(t in x for x in toks.values()) + 0.5) / (sum(t in x for x in toks.values()) + 0.5)) for t in terms}
    mean = sum(idf.values()) / len(idf)
    idf = {t: x if x >= 0 else 0.25 * mean for t, x in idf.items()}
    return {d: s for d, ts in toks.items() if (s := round(sum(idf[q] * ts.count(q) * (k1 + 1) / (ts.count(q) + k1 * (1 - b + b * len(ts) / avg)) for q in query.split() if q in ts), 6)) > 0}


def test_bm25(spark):
    docs = [(1, "a b c a"), (2, "a c d"), (3, "e f a"), (4, "f f g"), (5, "")]
    q = spark.createDataFrame([(1, "a b f f zz"), (2, "")], "query_id int, text string")
    got = sparse.bm25(spark.createDataFrame(docs, "doc_id int, text string"), q).collect()
    assert {r.doc_id: r.bm25_score for r in got} == bm25_by_hand(docs, "a b f f")
    assert [r.rank for r in sorted(got, key=lambda r: r.rank)] == list(range(1, len(got) + 1))
    assert sparse.bm25(spark.createDataFrame([], "doc_id int, text string"), q).count() == 0


def test_knn_and_pooling(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(40, 5))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    corpus = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "row_id long, v array<double>")
    queries = corpus.filter("row_id < 3").select(F.col("row_id").alias("query_id"), F.col("v").alias("qv"))
    d = np.round(((v[:3, None] - v[None]) ** 2).sum(2), 6)
    want = {(i, int(j)) for i in range(3) for j in np.lexsort((np.arange(40), d[i]))[:4]}
    assert {(r.query_id, r.row_id) for r in dense.knn(queries, corpus, 4).collect()} == want
    assert {(r.query_id, r.row_id) for r in dense.batched_similarity(corpus, v[:3], np.arange(3), 4).collect()} == want
    zero = spark.createDataFrame([(1, [0.0, 0.0]), (2, [3.0, 4.0])], "id int, embedding array<double>")
    assert [r.embedding for r in dense.normalized_vectors(zero).collect()] == [[0.6, 0.8]]
    near = spark.createDataFrame([("a", 1, [1.0, 0.0]), ("a", 2, [0.99, 0.1]), ("a", 3, [0.0, 1.0])], "g string, i int, embedding array<double>")
    assert sorted(r.i for r in dense.drop_near_vectors(near, "g", "i", 0.9).collect()) == [1, 3]


def test_fusion(spark):
    d = spark.createDataFrame([(1, "a", 0.5), (1, "b", 1.0)], "query_id int, segment_id string, distance double")
    s = spark.createDataFrame([(1, "b", 4.0), (1, "c", 2.0)], "query_id int, segment_id string, bm25_score double")
    lin = {r.segment_id: r.combined_score for r in fusion.linear(d, s, 0.3).collect()}
    assert lin == {"a": round(0.3 * math.exp(-0.5), 6), "b": round(0.3 * math.exp(-1) + 0.7, 6), "c": 0.0}
    rrf = {r.segment_id: r.rrf_score for r in fusion.rrf(d, s, 0.3).collect()}
    assert rrf == {"a": round(0.3 / 60, 9), "b": round(0.3 / 61 + 0.7 / 60, 9), "c": round(0.7 / 61, 9)}
    flat = spark.createDataFrame([(1, "x", 3.0), (1, "y", 3.0)], "query_id int, segment_id string, bm25_score double")
    assert {r.bm25_score for r in fusion.min_max(flat, "bm25_score", ["query_id"]).collect()} == {0.0}


def test_multimodal_contexts(spark):
    t = spark.createDataFrame([(1, "a", "v", 0.1), (1, "a", "v", 0.2), (1, "b", "v", 0.3)], "query_id int, segment_id string, video_id string, distance double")
    v = spark.createDataFrame([(1, "a", "v", 2.0), (1, "c", "w", 0.1)], "query_id int, segment_id string, video_id string, distance double")
    ctx = {r.segment_id: r for r in aggregate.contexts(t, v).collect()}
    assert ctx["a"].fusion_mode == "adaptive_text_heavy" and ctx["a"].combined_score == round(0.85 * math.exp(-0.1) + 0.15 * math.exp(-2), 6)
    assert (ctx["b"].fusion_mode, ctx["c"].fusion_mode) == ("text_only", "visual_only")
    videos = aggregate.videos(aggregate.contexts(t, v), 5).orderBy("rank").collect()
    assert [(r.video_id, r.num_multimodal_matches) for r in videos] == [("v", 1), ("w", 0)]


def test_text_functions(spark):
    assert one(spark, T.tokens(F.col("t")), t="Self-check: über_1 -x- it's") == ["self-check", "über_1", "x", "it", "s"]
    assert [one(spark, T.question_type(F.col("t")), t=x) for x in ("How to bandage", "Identify it", "What is flu", "Hm")] == ["procedural", "diagnostic", "factoid", "general"]
    assert one(spark, expand(F.col("t")), t="A mouth cancer check at home") == "A mouth cancer check at home oral cancer oral cavity cancer oropharyngeal cancer mouth tumor tumor malignancy carcinoma neoplasm oncology malignant growth examination screening inspection assessment evaluation self-examination self-check self-screening at-home"
    assert one(spark, T.clock_range(F.col("a"), F.col("b")), a=61.9, b=3700.0) == "01:01-61:40"
    assert one(spark, T.seconds_range(F.col("a"), F.col("b")), a=1.0, b=2.5) == "1.00s - 2.50s"
    assert [one(spark, T.parse_clock(F.col("t")), t=x) for x in ("01:05", "01:00:01", "7.5", "x", "a:b")] == [65.0, 3601.0, 7.5, 0.0, 0.0]
    assert one(spark, T.file_name(F.col("t")), t="a b/ç.mp4") == "a_b_mp4"
    assert one(spark, T.snippet(F.col("t"), 3), t="abcd") == "abc..."
    assert one(spark, answer.cite(F.col("t"), F.array(F.lit("00:01-00:02"))), t="[Evidence 1] and Evidence 1, Evidence 2") == "[Evidence 1, 00:01-00:02] and Evidence 1 (00:01-00:02), Evidence 2"
    assert one(spark, answer.confidence(F.col("s")), s=0.95) == 0.9


def test_conflicts(spark):
    m = lambda t: T.measures(F.lit(t))
    differs = lambda a, b: spark.range(1).select(T.numeric_conflict(m(a), m(b))).first()[0]
    assert differs("take 10 mg", "take 20 mg") and not differs("take 10 mg", "take 11 mg") and not differs("10 mg", "20 ml") and not differs("0 mg", "0 mg") and not differs("5", "9")
    base = " ".join(f"{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(30))
    rows = [(1, "s1", 1, 0.9, base), (1, "s2", 2, 0.9, base + " not"), (1, "s3", 3, 0.5, "other words")]
    ctx = spark.createDataFrame(rows, "query_id int, segment_id string, rank int, relevance double, text string")
    found = curate.conflicts(ctx)
    assert [tuple(r) for r in found.collect()] == [(1, "s1", "s2", "negation", "s2")]
    assert sorted(r.segment_id for r in curate.resolve(ctx, found).collect()) == ["s1", "s3"]
    by_model = curate.conflicts(ctx, contradiction=lambda a, b: F.lit(0.7)).collect()
    assert len(by_model) == 3 and {r.type for r in by_model} == {"nli_contradiction"}


def test_selection(spark):
    rows = [(1, f"s{i}", i, t) for i, t in enumerate(["a b c d", "a b c d e", "x y z", "", None, "x y q r s t"], 1)]
    ctx = spark.createDataFrame(rows, "query_id int, segment_id string, rank int, text string")
    chosen = []
    sets = {i: set((t or "").split()) for _, i, _, t in rows}
    for i, s in sets.items():
        if len(chosen) < 4 and all(not s or not sets[c] or len(s & sets[c]) / len(s | sets[c]) <= 0.5 for c in chosen):
            chosen.append(i)
    assert [r.segment_id for r in curate.diverse(ctx, 4, 0.5).orderBy("rank").collect()] == chosen
    long = spark.createDataFrame([(1, "a", 1, "x" * 40), (1, "b", 2, " "), (1, "c", 3, "x" * 80), (1, "d", 4, "x" * 4)], "query_id int, segment_id string, rank int, text string")
    assert [r.segment_id for r in curate.within_budget(long, 15).collect()] == ["a"]


def test_clean(spark):
    rows = spark.createDataFrame([(1, "q", "v"), (2, "q", "v"), (3, None, "v"), (4, None, "v"), (5, "r", "v")], "i int, question string, video_id string")
    assert sorted(r.i for r in clean.repeated(rows, ["question", "video_id"]).collect()) == [1, 2, 3, 4]
    urls = spark.createDataFrame([("a", None, 1), ("a", "u2", 2), ("a", "u1", 3), ("", "u", 4), (None, "u", 5)], "k string, url string, o int")
    assert [tuple(r) for r in clean.first_url(urls, "k", "url", "o").collect()] == [("a", "u2")]
    ids = spark.createDataFrame([("a",), (None,), ("b",)], "k string")
    assert {r.k for r in clean.without_failed(ids, ids.filter("k = 'a'"), "k").collect()} == {None, "b"}
    with pytest.raises(ValueError):
        clean.union_splits({}, "train")


def test_explore(spark):
    x = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (None,)], "v double")
    d = explore.describe(x, ["v"]).first()
    assert (d.n, d.mean, d["std"], d.q1, d.q2, d.q3) == (3, 2.333333, round(np.std([1, 2, 4], ddof=1), 6), 1.5, 2.0, 3.0)
    assert {r.bin: r.n for r in explore.histogram(x, "v", 3).collect()} == {0: 1, 1: 1, 2: 1}
    assert one(spark, explore.frame_times(F.col("a"), F.col("b")), a=0.0, b=12.0) == [0.0, 4.0, 8.0, 12.0]
    assert one(spark, explore.frame_times(F.col("a"), F.col("b")), a=3.0, b=3.0) == [3.0]
    g = explore.grid(spark, {"a": [1, 2], "b": ["x", "y", "z"]}).orderBy("config").collect()
    assert [(r.a, r.b) for r in g] == [(a, b) for a in (1, 2) for b in "xyz"]
    best = spark.createDataFrame([(1, None), (2, float("nan")), (3, 0.5), (4, 0.5)], "config int, m double")
    assert explore.best_config(best, "m").first().config == 3


def lcs_by_hand(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_text_metrics(spark):
    rng = random.Random(5)
    word = lambda: rng.choice("abcd")
    rows = [(i, " ".join(word() for _ in range(rng.randrange(12))), " ".join(word() for _ in range(rng.randrange(12)))) for i in range(60)] + [(99, None, "a"), (100, "a b c d e", "a b c d e")]
    pairs = spark.createDataFrame(rows, "pair_id int, candidate string, reference string")
    got = {r.pair_id: r.rouge_l for r in textmetrics.rouge_l(pairs).collect()}
    for i, c, r in rows:
        a, b = (c or "").split(), (r or "").split()
        assert got[i] == pytest.approx(2 * lcs_by_hand(a, b) / (len(a) + len(b)) if a or b else 0.0, abs=1e-6)
    b = {r.pair_id: r for r in textmetrics.bleu(pairs).collect()}
    assert (b[100].bleu_1, b[100].bleu_4, b[99].bleu_1) == (1.0, 1.0, 0.0)
    ident = {r.pair_id: r for r in textmetrics.rouge_n(pairs).collect()}[100]
    assert (ident.rouge_1, ident.rouge_2) == (1.0, 1.0)


def test_summary(spark):
    m = spark.createDataFrame([(1.0,), (2.0,), (6.0,)], "x double")
    r = evaluate.summary(m, ["x"]).first()
    assert (r["mean"], r["std"], r["median"], r["min"], r["max"], r["count"]) == (3.0, round(np.std([1, 2, 6]), 6), 2.0, 1.0, 6.0, 3)


def test_feature_folders(spark, tmp_path):
    (tmp_path / "in/train/deep").mkdir(parents=True)
    row = {"video_id": "v", "segment_id": "v_seg_0", "ts": {"start": 0.0, "end": 1.0}, "text": "t", "embedding": [3.0, 4.0]}
    (tmp_path / "in/train/a.json").write_text(json.dumps([row, row | {"segment_id": "v_seg_1", "embedding": [0.0, 0.0]}]))
    (tmp_path / "in/train/deep/b.json").write_text(json.dumps(row | {"video_id": "w", "segment_id": "w_seg_0"}))
    (tmp_path / "in/train/bad.json").write_text("{not json")
    f = features.read_features(spark, str(tmp_path / "in"), split="train")
    assert sorted(r.segment_id for r in f.collect()) == ["v_seg_0", "v_seg_1", "w_seg_0"]
    videos = spark.createDataFrame([("w",)], "video_id string")
    assert features.of_videos(f, videos).count() == 1 and features.missing(f, videos).count() == 2
    assert features.write_index(f.drop("source_file"), str(tmp_path / "index"), "text", "train")
    assert not features.write_index(f.filter("false"), str(tmp_path / "index"), "text", "val")
    idx = features.read_index(spark, str(tmp_path / "index"), "text", "train").collect()
    assert sorted(r.segment_id for r in idx) == ["v_seg_0", "w_seg_0"] and idx[0].embedding == pytest.approx([0.6, 0.8])
    with pytest.raises(Exception):
        features.read_features(spark, str(tmp_path / "none")).count()


def test_results_json(spark):
    rows = spark.createDataFrame([(1, "q", 2, "b"), (1, "q", 1, "a")], "query_id int, query string, rank int, segment_id string")
    said = json.loads(features.results_json(rows, "query", "segment").first().json)
    assert said == {"query": "q", "total_segments": 2, "aggregation_mode": "segment", "results": [{"rank": 1, "segment_id": "a"}, {"rank": 2, "segment_id": "b"}]}


def test_stream_stores_each_key_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    row = lambda i: {"video_id": "v", "segment_id": f"s{i}", "text": "t"}
    (tmp_path / "in/a.json").write_text(json.dumps([row(1), row(2), row(2)]))
    run = lambda: ingest.store_new(ingest.arriving(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    run()
    (tmp_path / "in/b.json").write_text(json.dumps([row(2), row(3)]))
    run()
    assert sorted(r.segment_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["s1", "s2", "s3"]
