"""Fusion of dense and sparse hits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clipquery.operators.common import ranked

KEYS = ["query_id", "segment_id"]


def min_max(df: DataFrame, col: str, by: list[str]) -> DataFrame:
    """Scale ``col`` to 0..1 in each group; 0 where all are equal."""
    w = Window.partitionBy(*by)
    lo, hi = F.min(col).over(w), F.max(col).over(w)
    return df.withColumn(col, F.when(hi > lo, (F.col(col) - lo) / (hi - lo)).otherwise(0.0))


def linear(dense: DataFrame, sparse: DataFrame, alpha: float = 0.3) -> DataFrame:
    """alpha * exp(-distance) + (1 - alpha) * scaled bm25 over the union of hits; a missing side counts 0.

    ``dense`` is (query_id, segment_id, distance), ``sparse`` (query_id, segment_id, bm25_score).
    """
    d = dense.groupBy(*KEYS).agg(F.exp(-F.max("distance")).alias("dense_score"))
    s = min_max(sparse.groupBy(*KEYS).agg(F.max("bm25_score").alias("bm25_score")), "bm25_score", ["query_id"])
    j = d.join(s, KEYS, "full_outer").fillna(0.0, ["dense_score", "bm25_score"])
    j = j.withColumn("combined_score", F.round(alpha * F.col("dense_score") + (1 - alpha) * F.col("bm25_score"), 6)).withColumn("dense_score", F.round("dense_score", 6)).withColumn("bm25_score", F.round("bm25_score", 6))
    return ranked(j, ["query_id"], [F.col("combined_score").desc(), F.col("segment_id")])


def rrf(dense: DataFrame, sparse: DataFrame, alpha: float = 0.3, k: int = 60) -> DataFrame:
    """Reciprocal ranks, weighted alpha and 1 - alpha, with 0-based ranks in the sum and 1-based ones in the result.

    One union and one aggregation: no join.
    """
    d = ranked(dense, ["query_id"], [F.col("distance"), F.col("segment_id")], "r").select(*KEYS, F.col("r").alias("dense_rank"), F.lit(None).cast("int").alias("bm25_rank"))
    s = ranked(sparse, ["query_id"], [F.col("bm25_score").desc(), F.col("segment_id")], "r").select(*KEYS, F.lit(None).cast("int").alias("dense_rank"), F.col("r").alias("bm25_rank"))
    g = d.unionByName(s).groupBy(*KEYS).agg(F.min("dense_rank").alias("dense_rank"), F.min("bm25_rank").alias("bm25_rank"))
    part = lambda w, c: F.coalesce(F.lit(w) / (k + F.col(c) - 1), F.lit(0.0))
    g = g.withColumn("rrf_score", F.round(part(alpha, "dense_rank") + part(1 - alpha, "bm25_rank"), 9))
    return ranked(g, ["query_id"], [F.col("rrf_score").desc(), F.col("segment_id")])


def contribution(fused: DataFrame, alpha: float = 0.3) -> DataFrame:
    """What each side adds to a linear score, and which side drives it."""
    d, s = F.col("dense_score"), F.col("bm25_score")
    return fused.withColumn("dense_part", F.round(alpha * d, 8)).withColumn("sparse_part", F.round((1 - alpha) * s, 8)).withColumn("driver", F.when(d > s, "dense-driven").when(s > d, "sparse-driven").otherwise("balanced"))
