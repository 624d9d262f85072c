"""Exploratory statistics: counts, descriptions, histograms, correlations, sampling times and parameter grids."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def value_counts(rows: DataFrame, key: str, k: int) -> DataFrame:
    """The ``k`` most frequent values with their counts, ties to smaller values."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), key).limit(k)


def describe(rows: DataFrame, names: list[str]) -> DataFrame:
    """Count, mean, sample deviation, least, exact interpolated quartiles and most of each column, one row per column."""
    long = rows.unpivot([], [F.col(n).cast("double").alias(n) for n in names], "name", "value")
    q = lambda p, n: F.round(F.percentile("value", F.lit(p)), 6).alias(n)
    return long.groupBy("name").agg(
        F.count("value").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_samp("value"), 6).alias("std"), F.min("value").alias("least"),
        q(0.25, "q1"), q(0.5, "q2"), q(0.75, "q3"), F.max("value").alias("most"),
    )


def histogram(rows: DataFrame, name: str, bins: int = 30) -> DataFrame:
    """``bin, n``: counts in equal bins from the least to the largest value, the last bin closed; empty bins are left out.

    The bounds are one small aggregate that is joined by broadcast, so rows are only shuffled as bin counts.
    """
    x = F.col(name).cast("double")
    ends = rows.agg(F.min(x).alias("lo"), F.max(x).alias("hi"))
    place = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((x - F.col("lo")) * bins / (F.col("hi") - F.col("lo"))), F.lit(bins - 1))).otherwise(0)
    return rows.filter(x.isNotNull()).crossJoin(F.broadcast(ends)).select(place.cast("int").alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))


def correlations(rows: DataFrame, names: list[str]) -> DataFrame:
    """``a, b, r`` for each pair of columns, from one pass."""
    pairs = list(combinations(names, 2))
    one = rows.agg(*(F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"c{i}") for i, (a, b) in enumerate(pairs)))
    every = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.round(f"c{i}", 6).alias("r")) for i, (a, b) in enumerate(pairs)))
    return one.select(F.inline(every))


def frame_times(start: Column, end: Column, strategy: str = "adaptive", per_segment: int = 2, least: int = 2, most: int = 8) -> Column:
    """Times of the frames to read in a segment, evenly from start to end; its start alone if it is empty or one is due."""
    span = end - start
    n = {"adaptive": F.greatest(F.lit(least), F.least(span / 3, F.lit(float(most))).cast("int")), "quality_based": F.lit(min(2 * per_segment, most))}.get(strategy, F.lit(per_segment))
    return F.when((span <= 0) | (n <= 1), F.array(start)).otherwise(F.transform(F.sequence(F.lit(0), n - 1), lambda i: start + i * span / (n - 1)))


def sharpest(frames: DataFrame, k: int) -> DataFrame:
    """The ``k`` sharpest frames of each segment, with their place in time."""
    best = Window.partitionBy("segment_id").orderBy(F.col("sharpness").desc(), "time")
    kept = frames.withColumn("__n", F.row_number().over(best)).filter(F.col("__n") <= k).drop("__n")
    return kept.withColumn("place", F.row_number().over(Window.partitionBy("segment_id").orderBy("time")))


def grid(spark, choices: dict[str, list]) -> DataFrame:  # noqa: ANN001
    """Every combination of the choices, numbered in their order; ``sample`` or ``orderBy(rand(seed))`` choose from it."""
    one = spark.range(1).select()
    cells = reduce(lambda d, c: d.select("*", F.explode(F.array(*map(F.lit, c[1]))).alias(c[0])), choices.items(), one)
    number, step = F.lit(0), 1
    for name, values in reversed(choices.items()):
        number, step = number + (F.array_position(F.array(*map(F.lit, values)), F.col(name)) - 1) * step, step * len(values)
    return cells.withColumn("config", number.cast("long"))


def best_config(results: DataFrame, metric: str, config: str = "config", largest: bool = True) -> DataFrame:
    """The configuration of the best metric, ties to the smallest; failures and nulls don't count."""
    m = F.col(metric)
    return results.filter(m.isNotNull() & ~F.isnan(m.cast("double"))).orderBy(m.desc() if largest else m.asc(), config).limit(1)


# The parameter space, and presets to try first.
GRID = {
    "window_size": [128, 256, 384, 512], "stride": [64, 96, 128, 192, 256], "min_coverage_contribution": [0.05, 0.10, 0.15, 0.20, 0.25], "deduplication_mode": ["coverage", "similarity", "none"],
    "frames_per_segment": [1, 2, 3, 4, 5], "sampling_strategy": ["uniform", "adaptive", "quality_based"], "quality_filter": [True, False], "aggregation_method": ["mean", "max"],
}
PRESETS = [
    ("Baseline", 256, 192, 0.15, "coverage", 2, "uniform", False, "mean"), ("Fast", 128, 128, 0.20, "aggressive", 1, "uniform", False, "mean"),
    ("Quality", 384, 96, 0.10, "coverage", 4, "quality_based", True, "mean"), ("Balanced", 256, 128, 0.15, "coverage", 2, "adaptive", False, "mean"),
]


def random_configs(configs: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """A repeatable sample of ``n`` configurations, by the hash of their numbers."""
    return configs.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("config").cast("string"))), "config").limit(n)


def presets(spark) -> DataFrame:  # noqa: ANN001
    return spark.createDataFrame(PRESETS, "name string, window_size int, stride int, min_coverage_contribution double, deduplication_mode string, frames_per_segment int, sampling_strategy string, quality_filter boolean, aggregation_method string")


def window_metrics(lengths: DataFrame, configs: DataFrame) -> DataFrame:
    """Number of windows and covered tokens, in percent, of each (config, window_size, stride) over texts of ``n`` tokens.

    Windows are folded from the lengths alone, so no text is read again for a configuration. Configurations are few;
    lengths are counted first, so texts of one length are folded once.
    """
    per = lengths.groupBy("n").agg(F.count("*").alias("texts"))
    j = per.filter("n > 0").crossJoin(F.broadcast(configs.select("config", "window_size", "stride")))
    start = F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.col("stride")))
    w = j.select("config", "window_size", "stride", "n", "texts", start.alias("s")).withColumn("e", F.least(F.col("s") + F.col("window_size"), F.col("n"))).filter(F.col("e") - F.col("s") >= F.expr("window_size div 4"))
    # What a window adds lies beyond the end of the window before it.
    before = F.when(F.col("s") == 0, 0).otherwise(F.least(F.col("s") - F.col("stride") + F.col("window_size"), F.col("n")))
    fresh = F.greatest(F.lit(0), F.col("e") - F.greatest(F.col("s"), before))
    got = w.groupBy("config").agg(F.sum("texts").alias("n_windows"), F.sum(fresh * F.col("texts")).alias("covered"))
    total = per.agg(F.sum(F.col("n") * F.col("texts")).alias("tokens"))
    return configs.join(got, "config", "left").crossJoin(F.broadcast(total)).select("config", "window_size", "stride", F.coalesce("n_windows", F.lit(0)).cast("long").alias("n_windows"), F.round(100.0 * F.coalesce("covered", F.lit(0)) / F.col("tokens"), 6).alias("coverage_pct"))
