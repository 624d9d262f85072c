"""Connected components by alternating large-star and small-star steps, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipquery.llm.common import discard, materialize


def components(edges: DataFrame) -> DataFrame:
    """``v, label`` for every end of an edge of ``a, b`` (longs): the smallest number of its component.

    Each step links nodes to the smallest neighbour, first upwards (large star), then downwards (small star), until a
    round changes nothing; stars remain. Neighbourhoods are only ever reduced to their minimum, which is combined
    before the shuffle, so a node with any number of neighbours is no hot group. Each round is written to a table.
    """
    e = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
    before = None
    while True:
        both = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        # large star: neighbours greater than the node go to its minimum
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        # small star: neighbours not greater, and the node itself, go to their minimum
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(low.select("a", F.col("m").alias("b")))
        new = materialize(small.filter("a <> b").distinct(), "cc")
        state = new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        discard(e)
        e = new
        if state == before:
            return e.groupBy("a").agg(F.min("b").alias("label")).withColumnRenamed("a", "v").unionAll(e.select(F.col("b").alias("v"), F.col("b").alias("label")).distinct())
        before = state
