"""Cleaning of question tables: keys, failures, splits and repeated rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipquery.operators.common import ranked


def first_url(rows: DataFrame, key: str, url: str, order: str) -> DataFrame:
    """The first URL in ``order`` of each key; rows without key or URL (null or empty) don't count."""
    full = rows.filter((F.coalesce(F.col(key).cast("string"), F.lit("")) != "") & (F.coalesce(F.col(url), F.lit("")) != ""))
    return full.groupBy(key).agg(F.min_by(url, order).alias(url))


def without_failed(rows: DataFrame, failed: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't among the failed ones; null keys stay."""
    return rows.join(failed.select(key).distinct(), key, "left_anti")


def with_both(rows: DataFrame, textual: DataFrame, visual: DataFrame, key: str) -> DataFrame:
    """Rows whose key has textual and visual features: two semi joins, so no set of keys is gathered."""
    return rows.join(textual.select(key), key, "left_semi").join(visual.select(key), key, "left_semi")


def keep_first(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The first whole row of each group in ``order``; null keys are a group of their own."""
    return ranked(rows, by, [F.col(c) for c in order], "__turn").filter("__turn = 1").drop("__turn")


def union_splits(tables: dict[str, DataFrame], split: str = "all") -> DataFrame:
    """One split's table or all of them in one, with a ``split`` column; absent splits are passed over."""
    names = [n for n in (("train", "test", "val") if split == "all" else (split,)) if n in tables]
    if not names:
        raise ValueError(f"no table for split {split!r}")
    return reduce(DataFrame.unionByName, (tables[n].withColumn("split", F.lit(n)) for n in names))


def repeated(rows: DataFrame, by: list[str]) -> DataFrame:
    """All rows of each group of ``by`` that has several, with ``copies``; nulls equal nulls.

    Groups are counted before the shuffle and joined back, so a large group is split by the adaptive join.
    """
    many = rows.groupBy(*(F.col(c).alias(f"__{c}") for c in by)).agg(F.count("*").alias("copies")).filter("copies > 1")
    same = reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by))
    return rows.join(many, same).drop(*(f"__{c}" for c in by))


def valid_times(rows: DataFrame, start: str, end: str, length: str) -> DataFrame:
    """Rows whose time range is not empty and lies inside the video."""
    return rows.filter((F.col(start) >= 0) & (F.col(end) > F.col(start)) & (F.col(end) <= F.col(length)))


def ground_truth(questions: DataFrame, truth: DataFrame) -> DataFrame:
    """Each question's first truth (smallest ``sample_id``) by trimmed, case-blind equality; unmatched ones are left out."""
    key = F.lower(F.trim("question"))
    first = truth.groupBy(key.alias("__key")).agg(F.min_by(F.struct("sample_id", "video_id", "answer_start", "answer_end"), "sample_id").alias("t"))
    return questions.withColumn("__key", key).join(first, "__key").select("query_id", "t.*")
