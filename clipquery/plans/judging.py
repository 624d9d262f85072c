"""Queries that judge searches and answers: ranking metrics, temporal overlap, text similarity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clipquery.operators import evaluate, match, segments, textmetrics
from clipquery.plans.answering import entities_sql
from clipquery.plans.search import COVERED, PROXY, SEG, bm25_sql, bm25_topk, documents, proxy_hits, questions, windowed
from clipquery.sources.tables import table


def truth(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold a benchmark passage: the stated queries against all rows."""
    return match.containing(documents(spark, d), questions(spark, d).withColumnRenamed("text", "passage"))


def judged(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.judged(bm25_topk(spark, d).select("query_id", "doc_id", "rank"), truth(spark, d))


def retrieval_metrics(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.precision_recall(judged(spark, d))


def retrieval_metrics_truncated(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.precision_recall(judged(spark, d), truncate=True)


def average_precision(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.average_precision(judged(spark, d))


def ndcg(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.ndcg(judged(spark, d))


def reciprocal_rank(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.reciprocal_rank(judged(spark, d))


def spans(spark: SparkSession, d: str) -> DataFrame:
    return windowed(spark, d).select("video_id", "segment_id", "window_id", "total_tokens", "start_token", "end_token")


def middle_truth(spark: SparkSession, d: str) -> DataFrame:
    """Each document's second quarter of tokens as the interval to be found."""
    n = F.col("total_tokens")
    return spans(spark, d).select("video_id", F.expr("total_tokens div 4").cast("double").alias("gs"), F.floor(n / 2).cast("double").alias("ge")).distinct()


def temporal_overlap(spark: SparkSession, d: str) -> DataFrame:
    preds = segments.keep_new_coverage(spans(spark, d), 0.9).select("video_id", F.col("start_token").cast("double").alias("start"), F.col("end_token").cast("double").alias("end"))
    return evaluate.temporal_overlap(preds, middle_truth(spark, d), "video_id")


def relevant_segments(spark: SparkSession, d: str) -> DataFrame:
    """All windows as hits of their own document's query."""
    hits = spans(spark, d).select(F.col("video_id").alias("query_id"), "video_id", "segment_id", F.col("start_token").cast("double").alias("start"), F.col("end_token").cast("double").alias("end"))
    t = middle_truth(spark, d).select(F.col("video_id").alias("query_id"), "video_id", F.col("gs").alias("start"), F.col("ge").alias("end"))
    return evaluate.relevant_segments(hits, t)


def assessment(spark: SparkSession, d: str) -> DataFrame:
    """The right video counts as found if any predicted second is right."""
    o = temporal_overlap(spark, d).withColumn("correct_video", F.col("temporal_recall") > 0)
    return evaluate.assessment(o).select("video_id", "iou", "correct_video", "assessment")


def metric_summary(spark: SparkSession, d: str) -> DataFrame:
    m = retrieval_metrics(spark, d).join(average_precision(spark, d), "query_id").join(ndcg(spark, d), "query_id")
    return evaluate.summary(m, ["precision_5", "recall_5", "f1_5", "average_precision", "ndcg_10"])


def search_compare(spark: SparkSession, d: str) -> DataFrame:
    dense = proxy_hits(spark, d).select("query_id", F.col("segment_id").alias("doc_id"), "rank")
    return evaluate.compare_ranks(dense, bm25_topk(spark, d).select("query_id", "doc_id", "rank"), truth(spark, d))


def pairs(spark: SparkSession, d: str) -> DataFrame:
    """Each assistant turn as a candidate for the user turn before it."""
    c = table(spark, d, "conversations")
    u = c.filter("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("reference"))
    a = c.filter("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("candidate"))
    return a.join(u, ["conv_id", "turn"]).select((F.col("conv_id") * 1000 + F.col("turn")).alias("pair_id"), "candidate", "reference")


def bleu(spark: SparkSession, d: str) -> DataFrame:
    return textmetrics.bleu(pairs(spark, d))


def rouge_n(spark: SparkSession, d: str) -> DataFrame:
    return textmetrics.rouge_n(pairs(spark, d))


def rouge_l(spark: SparkSession, d: str) -> DataFrame:
    return textmetrics.rouge_l(pairs(spark, d))


def entity_f1(spark: SparkSession, d: str) -> DataFrame:
    return textmetrics.entity_f1(pairs(spark, d))


def average_score(spark: SparkSession, d: str) -> DataFrame:
    """The mean of all similarities of a pair."""
    names = [*(f"bleu_{k}" for k in range(1, 5)), "rouge_1", "rouge_2", "rouge_l", "entity_f1"]
    m = bleu(spark, d).join(rouge_n(spark, d), "pair_id").join(rouge_l(spark, d), "pair_id").join(entity_f1(spark, d), "pair_id")
    return m.select("pair_id", F.round(sum((F.col(n) for n in names), F.lit(0.0)) / len(names), 5).alias("average_score"))


JUDGED = f"""{bm25_sql()},
 tr AS (SELECT DISTINCT item_id AS query_id, doc_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)),
 jd AS (SELECT query_id, doc_id, rank, (t.doc_id IS NOT NULL)::INT AS rel, coalesce(n, 0) AS n_rel FROM bm25 LEFT JOIN tr t USING (query_id, doc_id) LEFT JOIN (SELECT query_id, count(*) AS n FROM tr GROUP BY 1) USING (query_id))"""


def pr_sql(cut: bool) -> str:
    out = []
    for k in (5, 10):
        h = f"sum(CASE WHEN rank <= {k} THEN rel ELSE 0 END)" if cut else "sum(rel)"
        p, r = f"({h}::DOUBLE / {k})", f"(CASE WHEN n_rel > 0 THEN {h}::DOUBLE / n_rel ELSE 0E0 END)"
        out.append(f"round({p}, 6) AS precision_{k}, round({r}, 6) AS recall_{k}, round(2 * {p} * {r} / ({p} + {r} + 1E-10), 6) AS f1_{k}")
    return f"SELECT query_id, {', '.join(out)} FROM jd GROUP BY query_id, n_rel"


AP = "SELECT query_id, round(CASE WHEN n_rel > 0 THEN sum(p * rel) / n_rel ELSE 0E0 END, 6) AS average_precision FROM (SELECT *, sum(rel) OVER (PARTITION BY query_id ORDER BY rank)::DOUBLE / rank AS p FROM jd) GROUP BY query_id, n_rel"
NDCG = "SELECT query_id, round(CASE WHEN n_rel > 0 THEN sum(CASE WHEN rank <= 10 THEN rel / log2(rank + 1) ELSE 0E0 END) / list_sum(list_transform(range(1, least(n_rel, 10) + 1), lambda i: 1 / log2(i + 1))) ELSE 0E0 END, 6) AS ndcg_10 FROM jd GROUP BY query_id, n_rel"
SPANS = f"""{SEG}, {COVERED.replace("{m}", "0.9")},
 gt AS (SELECT DISTINCT video_id, (total_tokens // 4)::DOUBLE AS gs, (total_tokens // 2)::DOUBLE AS ge FROM seg)"""
OVERLAP = f"""{SPANS},
 ow AS (SELECT video_id, start_token::DOUBLE AS s, end_token::DOUBLE AS e, greatest(start_token, coalesce(max(end_token) OVER (PARTITION BY video_id ORDER BY start_token, end_token ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), start_token))::DOUBLE AS own FROM kept),
 ou AS (SELECT video_id, gs, ge, coalesce(sum(greatest(0, e - own)), 0E0) AS u, coalesce(sum(greatest(0, least(e, ge) - greatest(own, gs))), 0E0) AS i, avg(abs((s + e) / 2 - (gs + ge) / 2)) AS c FROM gt LEFT JOIN ow USING (video_id) GROUP BY ALL),
 op AS (SELECT *, CASE WHEN u > 0 THEN i / u ELSE 0 END AS p, CASE WHEN ge > gs THEN i / (ge - gs) ELSE 0 END AS r FROM ou),
 ov AS (SELECT video_id, round(CASE WHEN u + ge - gs - i > 0 THEN i / (u + ge - gs - i) ELSE 0 END, 6) AS iou, round(p, 6) AS temporal_precision, round(r, 6) AS temporal_recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS temporal_f1, round(c, 6) AS center_distance FROM op)"""
PAIRS = "pairs AS (SELECT a.conv_id * 1000 + a.turn AS pair_id, a.text AS candidate, u.text AS reference FROM conversations a JOIN conversations u ON u.conv_id = a.conv_id AND u.turn + 1 = a.turn WHERE a.role = 'assistant' AND u.role = 'user')"


def grams_sql(prefix: str, tokens: str, orders: range) -> str:
    """CTEs ``{prefix}t`` with token counts nc, nr and ``{prefix}m{n}`` with common n-grams of each order."""
    out = f"{prefix}t AS (SELECT pair_id, c, r, len(c) AS nc, len(r) AS nr FROM (SELECT pair_id, {tokens.replace('{x}', 'candidate')} AS c, {tokens.replace('{x}', 'reference')} AS r FROM pairs))"
    for n in orders:
        side = lambda s: f"(SELECT pair_id, g, count(*) AS k FROM (SELECT pair_id, unnest(list_transform(range(1, greatest(len({s}) - {n} + 2, 1)), lambda i: array_to_string({s}[i : i + {n} - 1], ' '))) AS g FROM {prefix}t) GROUP BY ALL)"  # noqa: B023, E731
        out += f", {prefix}m{n} AS (SELECT pair_id, sum(least(a.k, b.k))::DOUBLE AS m{n} FROM {side('c')} a JOIN {side('r')} b USING (pair_id, g) GROUP BY 1)"
    return out


def bleu_sql() -> str:
    p = [f"ln(coalesce(m{n}, 0.1E0) / greatest(nc - {n} + 1, 1))" for n in range(1, 5)]
    brevity = "CASE WHEN nc >= nr THEN 1E0 ELSE exp(1 - nr::DOUBLE / nc) END"
    cols = [f"round(CASE WHEN nc = 0 OR m1 IS NULL THEN 0E0 ELSE ({brevity}) * exp({' + '.join(f'{w}E0 * {p[i]}' for i, w in enumerate(textmetrics.WEIGHTS[k]))}) END, 6) AS bleu_{k}" for k in range(1, 5)]
    joins = " ".join(f"LEFT JOIN bm{n} USING (pair_id)" for n in range(1, 5))
    return f"SELECT pair_id, {', '.join(cols)} FROM bt {joins}"


def rouge_sql() -> str:
    f1 = lambda n: f"round(coalesce(2 * m{n} / (greatest(nc - {n} + 1, 0) + greatest(nr - {n} + 1, 0)), 0E0), 6) AS rouge_{n}"
    return f"SELECT pair_id, {f1(1)}, {f1(2)} FROM rt LEFT JOIN rm1 USING (pair_id) LEFT JOIN rm2 USING (pair_id)"


ENTITY = f"""SELECT pair_id, round(CASE WHEN len(r) = 0 THEN CASE WHEN len(c) = 0 THEN 1E0 ELSE 0E0 END ELSE 2E0 * len(list_intersect(c, r)) / (len(c) + len(r)) END, 6) AS entity_f1
 FROM (SELECT pair_id, {entities_sql("candidate")} AS c, {entities_sql("reference")} AS r FROM pairs)"""
GRAMS = f"{grams_sql('b', "list_filter(regexp_split_to_array({x}, '\\s+'), lambda w: w <> '')", range(1, 5))}, {grams_sql('r', "regexp_extract_all(lower({x}), '[a-z0-9]+')", range(1, 3))}"
#: One token of the candidate a round: lengths of common subsequences with each head of the reference.
LCS = """
 lw AS (SELECT pair_id, 0 AS k, list_transform(r, lambda x: 0) AS row FROM rt
   UNION ALL SELECT lw.pair_id, lw.k + 1, list_transform(range(1, nr + 1), lambda j: list_max(m[1 : j])) FROM lw JOIN rt USING (pair_id),
   LATERAL (SELECT list_transform(range(1, nr + 1), lambda j: greatest(lw.row[j], CASE WHEN r[j] = c[lw.k + 1] THEN coalesce(lw.row[j - 1], 0) + 1 ELSE 0 END)) AS m) WHERE lw.k < nc),
 lc AS (SELECT pair_id, coalesce(list_max(row), 0) AS n FROM lw JOIN rt USING (pair_id) WHERE k = nc)"""
ROUGE_L = "SELECT pair_id, round(CASE WHEN nc + nr > 0 THEN 2E0 * n / (nc + nr) ELSE 0E0 END, 6) AS rouge_l FROM rt JOIN lc USING (pair_id)"
BEST = "SELECT query_id, min(rank) AS {c} FROM tr JOIN {h} USING (query_id, doc_id) GROUP BY 1"

SQL = {
    "retrieval_metrics": f"WITH {JUDGED} {pr_sql(False)}",
    "retrieval_metrics_truncated": f"WITH {JUDGED} {pr_sql(True)}",
    "average_precision": f"WITH {JUDGED} {AP}",
    "ndcg": f"WITH {JUDGED} {NDCG}",
    "reciprocal_rank": f"WITH {JUDGED} SELECT query_id, round(coalesce(1E0 / min(rank) FILTER (rel = 1), 0E0), 6) AS reciprocal_rank FROM jd GROUP BY query_id",
    "temporal_overlap": f"WITH RECURSIVE {OVERLAP} SELECT * FROM ov",
    "relevant_segments": f"WITH RECURSIVE {SPANS} SELECT DISTINCT video_id AS query_id, segment_id FROM seg JOIN gt USING (video_id) WHERE greatest(start_token, gs) < least(end_token, ge)",
    "assessment": f"WITH RECURSIVE {OVERLAP} SELECT video_id, iou, temporal_recall > 0 AS correct_video, CASE WHEN temporal_recall <= 0 THEN 'critical' WHEN iou >= 0.7E0 THEN 'excellent' WHEN iou >= 0.5E0 THEN 'good' WHEN iou >= 0.3E0 THEN 'fair' ELSE 'poor' END AS assessment FROM ov",
    "metric_summary": f"""WITH {JUDGED}, m AS (SELECT * FROM ({pr_sql(False)}) JOIN ({AP}) USING (query_id) JOIN ({NDCG}) USING (query_id)),
 l AS (UNPIVOT (SELECT precision_5, recall_5, f1_5, average_precision, ndcg_10 FROM m) ON COLUMNS(*) INTO NAME metric VALUE value)
 SELECT metric, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(quantile_cont(value, 0.5), 6) AS median, round(min(value), 6) AS min, round(max(value), 6) AS max, count(value) AS count FROM l GROUP BY metric""",
    "search_compare": f"""WITH {JUDGED}, {PROXY}, pd2 AS (SELECT query_id, segment_id AS doc_id, rank FROM proxy),
 c AS (SELECT * FROM (SELECT DISTINCT query_id FROM tr) LEFT JOIN ({BEST.format(c="first_rank", h="pd2")}) USING (query_id) LEFT JOIN ({BEST.format(c="second_rank", h="bm25")}) USING (query_id))
 SELECT *, first_rank - second_rank AS improvement, CASE WHEN first_rank IS NULL AND second_rank IS NULL THEN 'neither' WHEN first_rank IS NULL THEN 'second only' WHEN second_rank IS NULL THEN 'first only' WHEN first_rank > second_rank THEN 'better' WHEN first_rank < second_rank THEN 'worse' ELSE 'same' END AS verdict FROM c""",
    "bleu": f"WITH {PAIRS}, {GRAMS} {bleu_sql()}",
    "rouge_n": f"WITH {PAIRS}, {GRAMS} {rouge_sql()}",
    "rouge_l": f"WITH RECURSIVE {PAIRS}, {GRAMS}, {LCS} {ROUGE_L}",
    "entity_f1": f"WITH {PAIRS} {ENTITY}",
    "average_score": f"WITH RECURSIVE {PAIRS}, {GRAMS}, {LCS} SELECT pair_id, round((bleu_1 + bleu_2 + bleu_3 + bleu_4 + rouge_1 + rouge_2 + rouge_l + entity_f1) / 8, 5) AS average_score FROM ({bleu_sql()}) JOIN ({rouge_sql()}) USING (pair_id) JOIN ({ROUGE_L}) USING (pair_id) JOIN ({ENTITY}) USING (pair_id)",
}

QUERIES = {f.__name__: f for f in (
    retrieval_metrics, retrieval_metrics_truncated, average_precision, ndcg, reciprocal_rank, temporal_overlap, relevant_segments, assessment, metric_summary, search_compare, bleu, rouge_n, rouge_l, entity_f1, average_score,
)}
