"""Bounded, repeatable samples of labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo the number of folds; 0 for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds, F.lit(0))


def sample(labels: DataFrame, id_col: str, label_col: str, learn: Column, most: int) -> DataFrame:
    """``id, label``: of each label (0 and 1) the ``most`` rows of smallest id hash for which ``learn`` holds.

    At most ``2 * most`` rows leave the executors, whatever the number of labels; null ids or labels and other
    labels are left out.
    """
    rows = labels.filter(learn & F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).dropDuplicates(["id"])
    of = lambda k: rows.filter(F.col("label") == k).orderBy(F.xxhash64("id"), "id").limit(most)
    return of(0).unionByName(of(1))


def texts_of(docs: DataFrame, chosen: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``label, text`` of the chosen rows; their number is bounded, so they are broadcast."""
    return docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).join(F.broadcast(chosen), "id").select("label", "text")
