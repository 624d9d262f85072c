"""Sliding token windows over transcripts, their deduplication, coverage and time ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clipquery.functions.text import words


def windows(docs: DataFrame, size: int = 256, stride: int = 64) -> DataFrame:
    """Windows ``[start, end)`` of ``size`` tokens every ``stride``, one row each; those under size/4 are left out but
    counted in ``window_id``. ``docs`` is (video_id, text)."""
    t = docs.select("video_id", words(F.col("text")).alias("t")).withColumn("n", F.size("t")).filter("n > 0")
    starts = t.select("video_id", "t", "n", F.posexplode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(stride))).alias("window_id", "start_token"))
    w = starts.withColumn("end_token", F.least(F.col("start_token") + size, F.col("n"))).filter(F.col("end_token") - F.col("start_token") >= size // 4)
    text = F.array_join(F.slice("t", F.col("start_token") + 1, F.col("end_token") - F.col("start_token")), " ")
    w = w.withColumn("text", text)
    return w.select("video_id", F.concat(F.col("video_id").cast("string"), F.lit("_seg_"), F.col("window_id").cast("string")).alias("segment_id"), "window_id", "start_token", "end_token", F.col("n").alias("total_tokens"), "text", F.md5("text").alias("content_hash"))


def keep_new_coverage(segments: DataFrame, least: float = 0.3) -> DataFrame:
    """Windows of which at least the share ``least`` isn't covered by kept earlier windows of the video.

    Starts and ends only grow, so what kept windows cover beyond a start is told by the end of the last kept one: one
    number, folded over a video's windows in order.
    """
    spans = segments.groupBy("video_id").agg(F.sort_array(F.collect_list(F.struct("window_id", "start_token", "end_token"))).alias("w"))

    def step(state: Column, w: Column) -> Column:
        new = F.greatest(F.lit(0), w["end_token"] - F.greatest(w["start_token"], state["end"]))
        ok = new / (w["end_token"] - w["start_token"]) >= least
        return F.struct(F.when(ok, F.greatest(state["end"], w["end_token"])).otherwise(state["end"]).alias("end"), F.when(ok, F.array_append(state["kept"], w["window_id"])).otherwise(state["kept"]).alias("kept"))

    kept = spans.select("video_id", F.explode(F.aggregate("w", F.struct(F.lit(0).alias("end"), F.array().cast("array<int>").alias("kept")), step)["kept"]).alias("window_id"))
    return segments.join(kept, ["video_id", "window_id"], "left_semi")


def keep_new_text(segments: DataFrame) -> DataFrame:
    """The first window of each text of a video."""
    w = Window.partitionBy("video_id", "content_hash").orderBy("window_id")
    return segments.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def interval_union(spans: DataFrame, by: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Maximal intervals of each group; touching ones are one."""
    w = Window.partitionBy(*by).orderBy(start, end)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("__new", F.when(before.isNull() | (F.col(start) > before), 1).otherwise(0)).withColumn("__island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*by, "__island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("__island")


def coverage(segments: DataFrame) -> DataFrame:
    """Share of each video's tokens, in percent, that its windows cover."""
    spans = interval_union(segments.select("video_id", "total_tokens", F.col("start_token").alias("start"), F.col("end_token").alias("end")), ["video_id", "total_tokens"])
    return spans.groupBy("video_id", "total_tokens").agg(F.sum(F.col("end") - F.col("start")).cast("long").alias("covered")).withColumn("coverage_pct", F.round(100 * F.col("covered") / F.col("total_tokens"), 6))


def chunk_overlap(segments: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks whose closed range meets a window's: ``segment_id, n_chunks, first_start, last_end, middle_start``.

    ``chunks`` is (video_id, start, end). The join is on the video, so ranges are compared within a video only.
    """
    return times(segments, chunks).select("segment_id", F.size("ts").alias("n_chunks"), F.element_at("ts", 1)["start"].alias("first_start"), F.array_max(F.transform("ts", lambda t: t["end"])).alias("last_end"), middle(F.col("ts"))["start"].alias("middle_start"))


def met(segments: DataFrame, chunks: DataFrame) -> DataFrame:
    """Windows beside each chunk that meets them."""
    return segments.select("video_id", "segment_id", "start_token", "end_token").join(chunks, "video_id").filter("start <= end_token and end >= start_token")


def times(segments: DataFrame, chunks: DataFrame) -> DataFrame:
    """``video_id, segment_id, ts``: the ranges of the chunks that meet a window, in order."""
    return met(segments, chunks).groupBy("video_id", "segment_id").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("ts"))


def time_range(segments: DataFrame, chunks: DataFrame) -> DataFrame:
    """``video_id, segment_id, start_token, end_token, range_start, range_end``: the first start and the last end of :func:`times`."""
    last = F.max(F.struct("start", "end"))["end"]
    return met(segments, chunks).groupBy("video_id", "segment_id", "start_token", "end_token").agg(F.min("start").alias("range_start"), last.alias("range_end"))


def middle(ts: Column) -> Column:
    """The middle element, the later of two."""
    return F.element_at(ts, F.floor(F.size(ts) / 2).cast("int") + 1)


def extended(segments: DataFrame, steps: int = 2) -> DataFrame:
    """Each window with up to ``steps`` windows before and after that abut it (end token = start token).

    Returns ``segment_id, n_segments, first_token, last_token``. Each step is an equi-join on (video, token).
    """
    s = segments.select("video_id", "segment_id", "start_token", "end_token")
    cur = s.select("video_id", "segment_id", F.col("start_token").alias("first_token"), F.col("end_token").alias("last_token")).withColumn("n_segments", F.lit(1))
    back = s.groupBy("video_id", F.col("end_token").alias("first_token")).agg(F.min("start_token").alias("prev"))
    ahead = s.groupBy("video_id", F.col("start_token").alias("last_token")).agg(F.max("end_token").alias("next"))
    for _ in range(steps):
        cur = cur.join(back, ["video_id", "first_token"], "left").withColumn("n_segments", F.col("n_segments") + F.col("prev").isNotNull().cast("int")).withColumn("first_token", F.coalesce("prev", "first_token")).drop("prev")
        cur = cur.join(ahead, ["video_id", "last_token"], "left").withColumn("n_segments", F.col("n_segments") + F.col("next").isNotNull().cast("int")).withColumn("last_token", F.coalesce("next", "last_token")).drop("next")
    return cur.select("segment_id", "n_segments", "first_token", "last_token")
