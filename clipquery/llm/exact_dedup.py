"""Exact deduplication by skew-safe combining, with DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clipquery.llm.common import materialize, unused


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row per document with the row that stays for its text.

    Three combining stages, each keyed by digest *and* full text, so that texts with one digest never merge:

    1. local: the map side of the first aggregation leaves one row per text and task (the salt is the task's
       partition, so all copies that a task reads share it);
    2. salted: rows of a digest and salt meet, which spreads a hot text over ``salts`` reducers;
    3. global: at most ``salts`` winners of a text meet.

    Winners go to a table of digests (no texts), which is joined back to the documents by digest; documents whose
    digest stands for several texts are joined by digest and text instead.

    Returns ``id_col, keep_id, group_size, kept, text_sha256``. Null texts count as empty. Of equal texts the
    row with the largest id stays; a null id is smaller than any other. Of repeated rows with that id exactly one
    stays. Other columns of ``docs`` are ignored, whatever their names; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("digest", digest(F.col("text")))
    salted = rows.withColumn("salt", F.spark_partition_id() % salts).groupBy("digest", "salt", "text").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size"))
    combined = salted.repartition("digest").groupBy("digest", "text").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    winners = materialize(combined.groupBy("digest").agg(F.count("*").alias("n_texts"), F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size")), "exact-winners")

    sha = F.col("digest") if digest is sha256 else sha256(F.col("text"))
    slim = rows.withColumn("text_sha256", sha)
    out = slim.drop("text").join(winners.filter("n_texts = 1").drop("n_texts"), "digest")
    shared = winners.filter("n_texts > 1").select("digest")
    if not shared.isEmpty():
        hit = slim.join(shared, "digest", "left_semi")
        own = hit.groupBy("digest", "text").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size"))
        out = out.unionByName(hit.join(own, ["digest", "text"]).drop("text"))
    # Of repeated rows one stays. Dealing by digest and id leaves a hot text's rows apart.
    turn = F.row_number().over(Window.partitionBy("text_sha256", "id").orderBy("id"))
    return out.repartition("text_sha256", "id").select(F.col("id").alias(id_col), "keep_id", "group_size", (F.col("id").eqNullSafe(F.col("keep_id")) & (turn == 1)).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without the copies that :func:`exact_dedup` drops, all columns as they were."""
    sha, turn, kept_sha, kept_id = unused(docs, "__sha", "__turn", "__kept_sha", "__kept_id")
    keep = exact_dedup(docs, id_col, text_col).filter("kept").select(F.col(id_col).alias(kept_id), F.col("text_sha256").alias(kept_sha))
    rows = docs.withColumn(sha, sha256(F.coalesce(F.col(text_col), F.lit(""))))
    left = rows.join(keep, (F.col(sha) == F.col(kept_sha)) & F.col(id_col).eqNullSafe(F.col(kept_id)), "left_semi")
    return left.withColumn(turn, F.row_number().over(Window.partitionBy(sha, id_col).orderBy(F.lit(1)))).filter(F.col(turn) == 1).select(*docs.columns)
