"""Claims of answers and the evidence that supports them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipquery.functions.text import evidence_number, jaccard, sentences, support_level
from clipquery.operators.common import ranked

WEIGHTS = {"HIGH": 1.0, "MEDIUM": 0.7, "LOW": 0.4, "UNSUPPORTED": 0.0, "CONFLICTED": 0.3}


def claims(answers: DataFrame) -> DataFrame:
    """``answer_id, claim_ix, claim`` from (answer_id, text): one row per sentence."""
    return answers.select("answer_id", F.posexplode(sentences(F.col("text"))).alias("claim_ix", "claim"))


def word_set(text):  # noqa: ANN001, ANN201
    return F.array_distinct(F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != ""))


def attribute(claim_rows: DataFrame, evidence: DataFrame, conflicted: DataFrame | None = None, similarity: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """Each claim's best evidence by word overlap, with level and best quoted sentence.

    ``evidence`` is (answer_id, evidence_ix from 1, text). A claim that names ``Evidence N`` takes that one with
    certainty. Ties go to the first evidence; a claim that overlaps nothing has none. ``conflicted`` is (answer_id,
    evidence_ix) of evidence that takes part in a conflict. ``similarity`` of claim and evidence texts, such as a
    sentence model's, replaces the word overlap.
    """
    c = claim_rows.select("answer_id", "claim_ix", "claim", word_set(F.col("claim")).alias("cw"), evidence_number(F.col("claim")).alias("named"))
    e = evidence.select("answer_id", F.col("evidence_ix"), F.col("text").alias("evidence"), word_set(F.col("text")).alias("ew"))
    named = F.col("named") == F.col("evidence_ix")
    alike = similarity(F.col("claim"), F.col("evidence")) if similarity else jaccard(F.col("cw"), F.col("ew"))
    j = c.join(e, "answer_id").withColumn("similarity", F.when(named, 1.0).otherwise(F.round(alike, 6))).withColumn("sure", F.coalesce(named, F.lit(False)))
    best = ranked(j.filter("similarity > 0"), ["answer_id", "claim_ix"], [F.col("sure").desc(), F.col("similarity").desc(), F.col("evidence_ix")]).filter("rank = 1")
    out = c.select("answer_id", "claim_ix", "claim").join(best.select("answer_id", "claim_ix", "evidence_ix", "evidence", "similarity", "sure"), ["answer_id", "claim_ix"], "left")
    level = F.when(F.col("evidence_ix").isNull(), "UNSUPPORTED").when(F.col("sure"), "HIGH").otherwise(support_level(F.col("similarity"), F.col("claim"), F.col("evidence")))
    out = out.withColumn("support_level", level)
    if conflicted is not None:
        out = out.join(conflicted.select("answer_id", "evidence_ix", F.lit(True).alias("clash")).distinct(), ["answer_id", "evidence_ix"], "left").withColumn("support_level", F.when(F.col("clash"), "CONFLICTED").otherwise(F.col("support_level"))).drop("clash")
    cw = word_set(F.col("claim"))
    scored = F.transform(sentences(F.col("evidence")), lambda s: F.struct(jaccard(cw, word_set(s)).alias("x"), s.alias("s")))
    top = F.aggregate(scored, F.struct(F.lit(-1.0).alias("x"), F.lit("").alias("s")), lambda a, b: F.when(b["x"] > a["x"], b).otherwise(a))["s"]
    quote = F.when(F.length(top) > 150, F.concat(F.substring(top, 1, 147), F.lit("..."))).otherwise(top)
    return out.select("answer_id", "claim_ix", "claim", "evidence_ix", F.coalesce("similarity", F.lit(0.0)).alias("similarity"), "support_level", F.when(F.col("evidence_ix").isNotNull(), quote).alias("exact_quote"))


def stats(attributions: DataFrame) -> DataFrame:
    """Counts by level and mean confidence of each answer."""
    n = lambda x: F.count(F.when(F.col("support_level") == x, 1)).alias(x.lower())
    weight = F.lit(None).cast("double")
    for k, v in WEIGHTS.items():
        weight = F.when(F.col("support_level") == k, v).otherwise(weight)
    return attributions.groupBy("answer_id").agg(F.count("*").alias("n_claims"), *(n(k) for k in WEIGHTS), F.round(F.avg(weight), 6).alias("confidence"))


def accuracy(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """Accuracy, precision, recall and unsupported rate of attributions, one row per answer.

    Both are (answer_id, claim_ix, evidence_ix); a claim that neither side supports counts as right.
    """
    p = predicted.select("answer_id", "claim_ix", F.col("evidence_ix").alias("p"))
    t = truth.select("answer_id", "claim_ix", F.col("evidence_ix").alias("t"))
    j = t.join(p, ["answer_id", "claim_ix"], "full_outer")
    right = F.count(F.when(F.col("p").eqNullSafe(F.col("t")), 1))
    made, known = F.count(F.when(F.col("p").isNotNull(), 1)), F.count(F.when(F.col("t").isNotNull(), 1))
    both = F.count(F.when(F.col("p") == F.col("t"), 1))
    z = lambda a, b: F.round(F.when(b > 0, a / b).otherwise(0.0), 6)
    n = F.count("*")
    return j.groupBy("answer_id").agg(z(right, n).alias("accuracy"), z(both, made).alias("precision"), z(both, known).alias("recall"), z(n - made, n).alias("unsupported_rate"))
