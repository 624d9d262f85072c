"""Ranking and size-checked broadcasting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A side of a join is broadcast only if its counted rows are no more.
BROADCAST_ROWS = 20_000


def ranked(df: DataFrame, by: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """Add each row's place, from 1, in its group."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def top(df: DataFrame, by: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group; Catalyst cuts groups before the shuffle as well."""
    return ranked(df, by, order, name).filter(F.col(name) <= k)


def small(df: DataFrame) -> DataFrame:
    """``df`` with a broadcast hint if it has few rows; at most BROADCAST_ROWS + 1 of them are counted."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def held(df: DataFrame, by: DataFrame, each: int) -> DataFrame:
    """``df`` as a frame of its rows with a broadcast hint, so that plans that read it several times compute it once, if
    it has few: at most ``each`` for a row of ``by``, which is what is counted."""
    most = BROADCAST_ROWS // each
    if by.limit(most + 1).count() > most:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(df.collect(), df.schema))
