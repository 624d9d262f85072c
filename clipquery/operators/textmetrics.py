"""Text similarity of answers and references: BLEU, ROUGE and entity overlap."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipquery.functions.text import entities, words

WEIGHTS = {1: (1.0,), 2: (0.5, 0.5), 3: (0.33, 0.33, 0.33), 4: (0.25, 0.25, 0.25, 0.25)}


def rouge_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def ngrams(t: Column, n: int) -> Column:
    """All runs of ``n`` tokens, joined by spaces."""
    starts = F.when(F.size(t) >= n, F.sequence(F.lit(1), F.size(t) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(t, i, n), " "))


def common(pairs: DataFrame, n: int, a: str, b: str) -> DataFrame:
    """``pair_id, common``: how many n-grams of token columns ``a`` and ``b`` match, each as often as in both."""
    one = lambda c, k: pairs.select("pair_id", F.explode(ngrams(F.col(c), n)).alias("gram")).groupBy("pair_id", "gram").agg(F.count("*").alias(k))
    return one(a, "x").join(one(b, "y"), ["pair_id", "gram"]).groupBy("pair_id").agg(F.sum(F.least("x", "y")).alias("common"))


def bleu(pairs: DataFrame) -> DataFrame:
    """``pair_id, bleu_1 .. bleu_4`` of (pair_id, candidate, reference): white-space tokens, no match counts 0.1.

    Orders for which the candidate has no n-gram count as one n-gram without a match; an empty candidate scores 0.
    """
    t = pairs.select("pair_id", words(F.coalesce("candidate", F.lit(""))).alias("c"), words(F.coalesce("reference", F.lit(""))).alias("r"))
    out = t.select("pair_id", F.size("c").alias("nc"), F.size("r").alias("nr"))
    for n in range(1, 5):
        out = out.join(common(t, n, "c", "r").withColumnRenamed("common", f"m{n}"), "pair_id", "left")
    p = {n: F.coalesce(F.col(f"m{n}").cast("double"), F.lit(0.1)) / F.greatest(F.col("nc") - n + 1, F.lit(1)) for n in range(1, 5)}
    brevity = F.when(F.col("nc") >= F.col("nr"), 1.0).otherwise(F.exp(1 - F.col("nr") / F.col("nc")))
    score = lambda k: brevity * F.exp(sum((w * F.log(p[i + 1]) for i, w in enumerate(WEIGHTS[k])), F.lit(0.0)))
    none = (F.col("nc") == 0) | F.col("m1").isNull()
    return out.select("pair_id", *(F.round(F.when(none, 0.0).otherwise(score(k)), 6).alias(f"bleu_{k}") for k in range(1, 5)))


def rouge_n(pairs: DataFrame, orders: tuple[int, ...] = (1, 2)) -> DataFrame:
    """F1 of common n-grams, without stemming; 0 where either side has none."""
    t = pairs.select("pair_id", rouge_tokens(F.coalesce("candidate", F.lit(""))).alias("c"), rouge_tokens(F.coalesce("reference", F.lit(""))).alias("r"))
    out = t.select("pair_id", F.size("c").alias("nc"), F.size("r").alias("nr"))
    for n in orders:
        out = out.join(common(t, n, "c", "r").withColumnRenamed("common", f"m{n}"), "pair_id", "left")
    # F1 of m / c and m / r is 2 m / (c + r).
    f1 = lambda n: F.coalesce(2.0 * F.col(f"m{n}") / (F.greatest(F.col("nc") - n + 1, F.lit(0)) + F.greatest(F.col("nr") - n + 1, F.lit(0))), F.lit(0.0))
    return out.select("pair_id", *(F.round(f1(n), 6).alias(f"rouge_{n}") for n in orders))


def lcs(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence; one numpy row per token of ``a``."""
    code = {w: i for i, w in enumerate(set(b))}
    bs = np.array([code[w] for w in b])
    row = np.zeros(len(b) + 1, dtype=np.int64)
    for w in a:
        if (k := code.get(w)) is not None:
            # A match gives one more than the row before up to the left; running maxima carry it to the right.
            row[1:] = np.maximum.accumulate(np.maximum(row[1:], np.where(bs == k, row[:-1] + 1, 0)))
    return int(row[-1])


def rouge_l(pairs: DataFrame) -> DataFrame:
    """F1 of the longest common subsequence, by an Arrow-batched function: SQL functions can't express its recurrence."""

    @F.pandas_udf("long")
    def longest(c: pd.Series, r: pd.Series) -> pd.Series:
        return pd.Series([lcs(list(x), list(y)) for x, y in zip(c, r)], dtype="int64")

    t = pairs.select("pair_id", rouge_tokens(F.coalesce("candidate", F.lit(""))).alias("c"), rouge_tokens(F.coalesce("reference", F.lit(""))).alias("r"))
    total = F.size("c") + F.size("r")
    return t.select("pair_id", F.round(F.when(total > 0, 2.0 * longest("c", "r") / total).otherwise(0.0), 6).alias("rouge_l"))


def entity_f1(pairs: DataFrame) -> DataFrame:
    """Set F1 of entities; without any in the reference 1 if the candidate has none either, else 0."""
    c, r = entities(F.col("candidate")), entities(F.col("reference"))
    both = F.size(F.array_intersect(c, r))
    f1 = F.when(F.size(r) == 0, F.when(F.size(c) == 0, 1.0).otherwise(0.0)).otherwise(2.0 * both / (F.size(c) + F.size(r)))
    return pairs.select("pair_id", F.round(f1, 6).alias("entity_f1"))
