"""Ranking metrics, temporal overlap and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def judged(hits: DataFrame, truth: DataFrame) -> DataFrame:
    """Hits ``query_id, doc_id, rank`` with ``rel``, and the number of relevant documents of their query.

    ``truth`` is distinct (query_id, doc_id). Queries without hits or truth keep their row of nulls out.
    """
    truth = truth.filter("query_id is not null and doc_id is not null")  # as the joins do, so that one plan serves both
    n = truth.groupBy("query_id").agg(F.count("*").alias("n_rel"))
    marked = hits.join(truth.withColumn("rel", F.lit(1)), ["query_id", "doc_id"], "left").fillna(0, ["rel"])
    return marked.join(n, "query_id", "left").fillna(0, ["n_rel"])


def precision_recall(marked: DataFrame, ks: tuple[int, ...] = (5, 10), truncate: bool = False) -> DataFrame:
    """P, R and F1 at each k, one row per query. By default k divides but doesn't cut the list; ``truncate`` cuts it."""
    out = []
    for k in ks:
        hit = F.sum(F.when((F.col("rank") <= k) if truncate else F.lit(True), F.col("rel")).otherwise(0))
        out += [hit.alias(f"h{k}")]
    g = marked.groupBy("query_id", "n_rel").agg(*out)
    cols = [F.col("query_id")]
    for k in ks:
        p, r = F.col(f"h{k}") / F.lit(float(k)), F.when(F.col("n_rel") > 0, F.col(f"h{k}") / F.col("n_rel")).otherwise(0.0)
        cols += [F.round(p, 6).alias(f"precision_{k}"), F.round(r, 6).alias(f"recall_{k}"), F.round(2 * p * r / (p + r + 1e-10), 6).alias(f"f1_{k}")]
    return g.select(*cols)


def average_precision(marked: DataFrame) -> DataFrame:
    """Sum of precision at each relevant hit over the number of relevant documents."""
    w = Window.partitionBy("query_id").orderBy("rank")
    at = marked.withColumn("p", F.sum("rel").over(w) / F.col("rank"))
    return at.groupBy("query_id", "n_rel").agg(F.sum(F.col("p") * F.col("rel")).alias("s")).select("query_id", F.round(F.when(F.col("n_rel") > 0, F.col("s") / F.col("n_rel")).otherwise(0.0), 6).alias("average_precision"))


def ndcg(marked: DataFrame, k: int = 10) -> DataFrame:
    """Binary nDCG at k; the ideal list has min(relevant, k) hits first."""
    gain = F.sum(F.when(F.col("rank") <= k, F.col("rel") / F.log2(F.col("rank") + 1.0)).otherwise(0.0))
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(F.col("n_rel"), F.lit(k)), F.lit(1)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    return marked.groupBy("query_id", "n_rel").agg(gain.alias("dcg")).select("query_id", F.round(F.when(F.col("n_rel") > 0, F.col("dcg") / ideal).otherwise(0.0), 6).alias(f"ndcg_{k}"))


def reciprocal_rank(marked: DataFrame) -> DataFrame:
    """1 / rank of the first relevant hit, 0 without one (an addition to the usual metrics)."""
    return marked.groupBy("query_id").agg(F.round(F.coalesce(1 / F.min(F.when(F.col("rel") == 1, F.col("rank"))), F.lit(0.0)), 6).alias("reciprocal_rank"))


def relevant_segments(hits: DataFrame, truth: DataFrame) -> DataFrame:
    """Hits (with video_id, start, end) of the truth's video that overlap its interval: ``query_id, segment_id``."""
    t = truth.select("query_id", "video_id", F.col("start").alias("gs"), F.col("end").alias("ge"))
    return hits.join(t, ["query_id", "video_id"]).filter(F.greatest("start", "gs") < F.least("end", "ge")).select("query_id", "segment_id").distinct()


def temporal_overlap(preds: DataFrame, truth: DataFrame, key: str) -> DataFrame:
    """IoU, precision, recall, F1 and mean center distance of the union of predicted intervals against one interval.

    ``preds`` is (key, start, end), ``truth`` (key, gs, ge). Without predictions all are 0 and the distance is null.
    """
    w = Window.partitionBy(key).orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    # Each interval's own part of the union is what lies beyond all earlier ends.
    p = preds.withColumn("own", F.when(reach.isNull(), F.col("start")).otherwise(F.greatest("start", reach))).join(truth, key)
    part = lambda lo, hi: F.greatest(F.lit(0.0), hi - lo)
    g = p.groupBy(key, "gs", "ge").agg(F.sum(part(F.col("own"), F.col("end"))).alias("u"), F.sum(part(F.greatest("own", "gs"), F.least("end", "ge"))).alias("i"), F.avg(F.abs((F.col("start") + F.col("end")) / 2 - (F.col("gs") + F.col("ge")) / 2)).alias("center"))
    g = truth.join(g.drop("gs", "ge"), key, "left").fillna(0.0, ["u", "i"])
    pr, re = F.when(F.col("u") > 0, F.col("i") / F.col("u")).otherwise(0.0), F.when(F.col("ge") > F.col("gs"), F.col("i") / (F.col("ge") - F.col("gs"))).otherwise(0.0)
    either = F.col("u") + F.col("ge") - F.col("gs") - F.col("i")
    return g.select(key, F.round(F.when(either > 0, F.col("i") / either).otherwise(0.0), 6).alias("iou"), F.round(pr, 6).alias("temporal_precision"), F.round(re, 6).alias("temporal_recall"), F.round(F.when(pr + re > 0, 2 * pr * re / (pr + re)).otherwise(0.0), 6).alias("temporal_f1"), F.round("center", 6).alias("center_distance"))


def assessment(df: DataFrame) -> DataFrame:
    """A label for each IoU; critical where the right video wasn't found."""
    i = F.col("iou")
    return df.withColumn("assessment", F.when(~F.col("correct_video"), "critical").when(i >= 0.7, "excellent").when(i >= 0.5, "good").when(i >= 0.3, "fair").otherwise("poor"))


def summary(metrics: DataFrame, names: list[str]) -> DataFrame:
    """Long form: mean, population deviation, median, least, most and count of each metric, zeros without rows."""
    long = metrics.unpivot([], [F.col(n).cast("double").alias(n) for n in names], "metric", "value")
    z = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 6)
    g = long.groupBy("metric").agg(z(F.avg("value")).alias("mean"), z(F.stddev_pop("value")).alias("std"), z(F.percentile("value", F.lit(0.5))).alias("median"), z(F.min("value")).alias("min"), z(F.max("value")).alias("max"), F.count("value").alias("count"))
    return g


def video_found(hits: DataFrame, truth: DataFrame) -> DataFrame:
    """``query_id, correct_video``: whether any hit is of one of the query's right videos; queries without hits: false.

    Both are (query_id, video_id).
    """
    right = hits.select("query_id", "video_id").distinct().join(truth.select("query_id", "video_id").distinct(), ["query_id", "video_id"]).select("query_id").distinct().withColumn("correct_video", F.lit(True))
    return truth.select("query_id").distinct().join(right, "query_id", "left").withColumn("correct_video", F.coalesce("correct_video", F.lit(False)))


def rates(rows: DataFrame, flags: dict[str, str]) -> DataFrame:
    """One row: for each name the share of rows whose flag holds, nulls counting as not; 0 without rows."""
    return rows.agg(*(F.round(F.coalesce(F.avg(F.coalesce(F.col(c), F.lit(False)).cast("double")), F.lit(0.0)), 6).alias(name) for name, c in flags.items()))


def compare_ranks(first: DataFrame, second: DataFrame, truth: DataFrame) -> DataFrame:
    """Where two searches find each query's expected document, and how many places the second gains."""
    best = lambda h, c: truth.join(h, ["query_id", "doc_id"]).groupBy("query_id").agg(F.min("rank").alias(c))
    j = truth.select("query_id").distinct().join(best(first, "first_rank"), "query_id", "left").join(best(second, "second_rank"), "query_id", "left")
    gain = F.col("first_rank") - F.col("second_rank")
    verdict = F.when(F.col("first_rank").isNull() & F.col("second_rank").isNull(), "neither").when(F.col("first_rank").isNull(), "second only").when(F.col("second_rank").isNull(), "first only").when(gain > 0, "better").when(gain < 0, "worse").otherwise("same")
    return j.withColumn("improvement", gain).withColumn("verdict", verdict)
