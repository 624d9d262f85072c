"""Evidence across modalities, per segment and per video."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipquery.operators.common import top



def contexts(text_hits: DataFrame, visual_hits: DataFrame, text_weight: float = 0.6, visual_weight: float = 0.4, weak: float = 0.4) -> DataFrame:
    """Each segment's best text and visual hit, full outer joined, with adaptive weights.

    Hits are (query_id, segment_id, video_id, distance). With both sides, a visual score under ``weak`` counts .15 to
    the text's .85, else the given weights hold; a single side counts alone. Segments of score 0 are left out.
    """
    best = lambda h, c: h.groupBy("query_id", "segment_id", "video_id").agg(F.exp(-F.min("distance")).alias(c))
    j = best(text_hits, "text_score").join(best(visual_hits, "visual_score"), ["query_id", "segment_id", "video_id"], "full_outer")
    t, v = F.col("text_score"), F.col("visual_score")
    both = t.isNotNull() & v.isNotNull()
    mode = F.when(both & (v < weak), "adaptive_text_heavy").when(both, "balanced").when(t.isNotNull(), "text_only").otherwise("visual_only")
    score = F.when(both & (v < weak), 0.85 * t + 0.15 * v).when(both, text_weight * t + visual_weight * v).otherwise(F.coalesce(t, v))
    j = j.withColumn("has_both_modalities", both).withColumn("fusion_mode", mode).withColumn("combined_score", F.round(score, 6))
    return j.withColumn("text_score", F.round(F.coalesce(t, F.lit(0.0)), 6)).withColumn("visual_score", F.round(F.coalesce(v, F.lit(0.0)), 6)).filter("combined_score > 0")


def segments(ctx: DataFrame, k: int) -> DataFrame:
    """The ``k`` best segments of each query: those with both modalities first."""
    return top(ctx, ["query_id"], [F.col("has_both_modalities").desc(), F.col("combined_score").desc(), F.col("segment_id")], k)


def videos(ctx: DataFrame, k: int) -> DataFrame:
    """The ``k`` best videos of each query by number of multimodal matches, then by best score."""
    count = lambda c: F.count(F.when(c, 1))
    g = ctx.groupBy("query_id", "video_id").agg(
        F.max("combined_score").alias("best_combined_score"), count(F.col("fusion_mode") != "visual_only").alias("num_text_matches"), count(F.col("fusion_mode") != "text_only").alias("num_visual_matches"),
        count(F.col("has_both_modalities")).alias("num_multimodal_matches"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("combined_score")).alias("s"), F.col("segment_id").cast("string").alias("i")))), lambda x: x["i"]), ",").alias("segments"),
    )
    return top(g, ["query_id"], [F.col("num_multimodal_matches").desc(), F.col("best_combined_score").desc(), F.col("video_id")], k)
