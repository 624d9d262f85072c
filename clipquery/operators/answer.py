"""Answers from evidence: gates, prompts, citations and costs; the language model is a column that callers supply."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clipquery.functions.text import clock_range, question_type, snippet
from clipquery.operators import attribute
from clipquery.operators.common import ranked

TEMPLATES = {
    "procedural": "List the steps that the evidence shows, in order.", "diagnostic": "Name the signs that the evidence shows and what they point to.",
    "factoid": "State the fact that the evidence shows, briefly.", "general": "Answer from the evidence alone.",
}


def confidence(top: Column) -> Column:
    """A cautious confidence from the best score: the score, at most .9, .7 or .5 by band; 0 without one."""
    return F.when(top.isNull(), 0.0).when(top > 0.7, F.least(F.lit(0.9), top)).when(top > 0.5, F.least(F.lit(0.7), top)).otherwise(F.least(F.lit(0.5), top))


def cost(tokens_in: Column, tokens_out: Column, per_in: float = 0.15e-6, per_out: float = 0.60e-6) -> Column:
    return tokens_in * per_in + tokens_out * per_out


def gate(ctx: DataFrame, least_best: float = 0.45, least_mean: float = 0.35) -> DataFrame:
    """Whether a query's contexts (query_id, score) suffice for an answer, and what to say if not.

    A score is the first of several columns that isn't 0 or null; see :func:`first_score`.
    """
    g = ctx.groupBy("query_id").agg(F.round(F.max("score"), 6).alias("best"), F.round(F.avg("score"), 9).alias("mean"))
    enough = (F.col("best") >= least_best) & (F.col("mean") >= least_mean)
    why = F.when(enough, None).when(F.col("best") < 0.35, "very low relevance").when(F.col("best") < least_best, "moderate relevance, too little detail").otherwise("low relevance on average")
    return g.select("query_id", "best", "mean", enough.alias("sufficient"), why.alias("refusal"), F.round(confidence(F.col("best")), 6).alias("confidence"))


def first_score(*columns: str) -> Column:
    """The first score that is neither null nor 0, else 0."""
    return F.coalesce(*(F.nullif(F.col(c).cast("double"), F.lit(0.0)) for c in columns), F.lit(0.0))


def evidence(ctx: DataFrame) -> DataFrame:
    """What an answer shows of its contexts: the precise time range where there is one, else the coarse one."""
    precise = F.col("precise_start").isNotNull() & F.col("precise_end").isNotNull()
    at = lambda side: F.when(precise, F.col(f"precise_{side}")).otherwise(F.col(side))
    return ctx.select("query_id", "segment_id", "video_id", at("start").alias("start"), at("end").alias("end"), F.col("combined_score").alias("relevance_score"), clock_range(at("start"), at("end")).alias("formatted_time"))


def prompts(ctx: DataFrame, k: int = 3, chars: int = 350) -> DataFrame:
    """``query_id, query_type, prompt`` from the first ``k`` ranked contexts (video_id, question, text, start, end)."""
    line = F.concat(F.lit("[Video "), F.col("rank").cast("string"), F.lit(": "), F.col("video_id").cast("string"), F.lit(", Time: "), clock_range(F.col("start"), F.col("end")), F.lit("]\nContent: "), snippet(F.coalesce("text", F.lit("")), chars))
    g = ctx.filter(F.col("rank") <= k).groupBy("query_id", "question").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", line.alias("l")))), lambda x: x["l"]), "\n\n").alias("evidence"))
    kind = question_type(F.col("question"))
    ask = F.lit("")
    for t, say in TEMPLATES.items():
        ask = F.when(kind == t, say).otherwise(ask)
    return g.select("query_id", kind.alias("query_type"), F.concat(F.lit("Question: "), "question", F.lit("\n\nVideo Evidence:\n"), "evidence", F.lit("\n\nInstructions:\n"), ask, F.lit("\n\nAnswer:")).alias("prompt"))


def cite(answer: Column, times: Column, most: int = 10) -> Column:
    """Add times to evidence marks: ``[Evidence 1]`` becomes ``[Evidence 1, 00:10-00:20]``, bare ones get ``(..)``.

    ``times`` is an array of time ranges; marks beyond it stay.
    """
    def step(said: Column, i: Column) -> Column:
        t, n = F.try_element_at(times, i), i.cast("string")
        full = F.regexp_replace(said, F.concat(F.lit(r"\[Evidence "), n, F.lit(r"\]")), F.concat(F.lit("[Evidence "), n, F.lit(", "), t, F.lit("]")))
        bare = F.concat(F.lit(r"(?<!\[)Evidence "), n, F.lit(r"(?![\d\]])(?!\s*\()"))
        return F.coalesce(F.regexp_replace(full, bare, F.concat(F.lit("Evidence "), n, F.lit(" ("), t, F.lit(")"))), said)

    return F.aggregate(F.sequence(F.lit(1), F.lit(most)), answer, step)


def extractive(prompt: Column) -> Column:
    """The stand-in for a language model: the first line of the first evidence of the prompt."""
    return F.coalesce(F.nullif(F.regexp_extract(prompt, r"\[Video 1: [^\]]*\]\nContent: ([^\n]*)", 1), F.lit("")), F.lit("No evidence."))


def answers(ctx: DataFrame, model: Callable[[Column], Column] = extractive) -> DataFrame:
    """Gate, prompt and answer for each query; ``model`` turns the prompt column into the answer column."""
    p = prompts(ctx).join(gate(ctx.select("query_id", F.col("combined_score").alias("score"))), "query_id")
    return p.select("query_id", "query_type", F.when(F.col("sufficient"), model(F.col("prompt"))).otherwise(F.col("refusal")).alias("answer"), "confidence", "sufficient")


def minimal_prompt(question: Column, texts: Column, k: int = 3, chars: int = 200) -> Column:
    """A short prompt: the question and the first texts, without times or instructions."""
    lines = F.transform(F.slice(texts, 1, k), lambda t: F.concat(F.lit("- "), snippet(F.coalesce(t, F.lit("")), chars)))
    return F.concat(F.lit("Q: "), question, F.lit("\n"), F.array_join(lines, "\n"), F.lit("\nA:"))


def batch_prompt(rows: DataFrame, batch: str) -> DataFrame:
    """``batch, prompt``: the minimal prompts of a batch (columns ``ix`` and ``prompt``) as one, numbered in order."""
    line = F.struct("ix", "prompt")
    g = rows.groupBy(batch).agg(F.sort_array(F.collect_list(line)).alias("l"))
    return g.select(batch, F.array_join(F.transform("l", lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x["prompt"])), "\n\n").alias("prompt"))


def chain(ctx: DataFrame, model: Callable[[Column], Column] = extractive, curated: Callable[[DataFrame], DataFrame] | None = None, k: int = 3, similarity: Callable[[Column, Column], Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """The whole way from contexts to answers: curate (or take the first ``k``), gate, prompt, model, citations, claims.

    Returns answers (``query_id, query_type, answer, sufficient, confidence, n_claims``) and the claims' evidence. A
    refusal has confidence 0 and no claims. The confidence of others is the mean over their claims, else that of the
    gate. ``curated`` maps contexts to chosen ones with ``rank``.
    """
    chosen = curated(ctx) if curated else ctx.filter(F.col("rank") <= k)
    times = F.transform(F.sort_array(F.collect_list(F.struct("rank", clock_range(F.col("start"), F.col("end")).alias("t")))), lambda x: x["t"])
    said = answers(chosen, model).join(chosen.groupBy("query_id").agg(times.alias("times")), "query_id")
    said = said.withColumn("answer", F.when(F.col("sufficient"), cite(F.col("answer"), F.col("times"))).otherwise(F.col("answer")))
    given = said.filter("sufficient").select(F.col("query_id").alias("answer_id"), F.col("answer").alias("text"))
    shown = ranked(chosen.drop("evidence_ix").withColumnRenamed("rank", "place"), ["query_id"], [F.col("place")], "evidence_ix").select(F.col("query_id").alias("answer_id"), "evidence_ix", "text")
    claims = attribute.attribute(attribute.claims(given), shown, None, similarity)
    sure = attribute.stats(claims).select(F.col("answer_id").alias("query_id"), "n_claims", F.col("confidence").alias("by_claims"))
    j = said.join(sure, "query_id", "left")
    conf = F.when(F.col("sufficient"), F.coalesce("by_claims", "confidence")).otherwise(0.0)
    return j.select("query_id", "query_type", "answer", "sufficient", conf.alias("confidence"), F.coalesce("n_claims", F.lit(0).cast("long")).alias("n_claims")), claims


def cost_totals(rows: DataFrame, order: str) -> DataFrame:
    """Running cost of a batch in ``order``; a batch is one conversation."""
    w = Window.partitionBy("conv_id").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("running_cost", F.round(F.sum("cost").over(w), 9))
