"""Curation of contexts: quality, relevance, conflicts, diversity and token budgets."""

from __future__ import annotations

from functools import reduce

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clipquery.functions.text import alignment, entities, jaccard, measures, negation_conflict, numeric_conflict, plain_words, question_type, token_estimate
from clipquery.operators.common import ranked

#: Question type -> (segments at most, how they are chosen, least confidence).
STRATEGIES = {"procedural": (5, "top_score", 0.85), "diagnostic": (6, "diversity", 0.70), "factoid": (2, "top_score", 0.95), "general": (3, "top_score", 0.80)}


def quality_filter(ctx: DataFrame, threshold: float = 0.1, min_chars: int = 20, min_visual: float = 0.5) -> DataFrame:
    """Contexts with enough score, something to show (text or picture), and a time range unless the score is high."""
    shows = (F.length(F.coalesce("text", F.lit(""))) >= min_chars) | (F.col("visual_score") >= min_visual)
    timed = F.col("start").isNotNull() & F.col("end").isNotNull()
    return ctx.filter((F.col("combined_score") >= threshold) & shows & (timed | (F.col("combined_score") > 0.6)))


def relevance(ctx: DataFrame) -> DataFrame:
    """Score plus .2 entity overlap with the question plus .1 question-type alignment, ranked per query.

    Contexts have query_id, segment_id, question, text, combined_score and text_score.
    """
    base = F.coalesce(F.nullif(F.col("combined_score"), F.lit(0.0)), F.col("text_score"), F.lit(0.0))
    x = base + 0.2 * jaccard(entities(F.col("question")), entities(F.col("text"))) + 0.1 * alignment(question_type(F.col("question")), F.col("text"))
    return ranked(ctx.withColumn("relevance", F.round(x, 6)), ["query_id"], [F.col("relevance").desc(), F.col("segment_id")])


def nli_rerank(ctx: DataFrame, entailment: Column, k: int = 15) -> DataFrame:
    """Re-rank the first ``k`` by .7 relevance + .3 entailment; the rest follow as they were.

    ``entailment`` is a model's column; 0.5 is what a missing model gives.
    """
    head = F.col("rank") <= k
    final = F.when(head & F.col("text").isNotNull(), F.round(0.7 * F.col("relevance") + 0.3 * entailment, 8))
    order = [head.desc(), F.when(head, F.coalesce(final, F.col("relevance"))).desc(), F.col("rank")]
    return ctx.withColumn("final_score", final).withColumn("final_rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))


def conflicts(ctx: DataFrame, score: str = "relevance", least: int = 20, share: float = 0.5, contradiction: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """Pairs of a query's contexts, the earlier ranked first, of which one contradicts the other, and which one loses.

    ``contradiction`` is a model's probability over two text columns; above 0.6 it decides before the rules do. The
    pairs are those of one query's short list; word sets and measures are computed once per context.
    """
    c = ctx.select("query_id", "segment_id", "rank", F.col(score).alias("s"), plain_words(F.coalesce("text", F.lit(""))).alias("w"), measures(F.coalesce("text", F.lit(""))).alias("m"), *["text"] * bool(contradiction))
    a, b = (c.select("query_id", *(F.col(x).alias(f"{x}_{p}") for x in c.columns if x != "query_id")) for p in "ab")
    model = contradiction(F.col("text_a"), F.col("text_b")) > 0.6 if contradiction else F.lit(False)
    kind = F.when(model, "nli_contradiction").when(negation_conflict(F.col("w_a"), F.col("w_b"), least, share), "negation").when(numeric_conflict(F.col("m_a"), F.col("m_b")), "numeric")
    j = a.join(b, "query_id").filter("rank_a < rank_b").withColumn("type", kind).filter("type is not null")
    return j.select("query_id", F.col("segment_id_a"), F.col("segment_id_b"), "type", F.when(F.col("s_a") < F.col("s_b"), F.col("segment_id_a")).otherwise(F.col("segment_id_b")).alias("loser"))


def resolve(ctx: DataFrame, found: DataFrame) -> DataFrame:
    """The contexts that lose no conflict; all pairs count, in any order."""
    return ctx.join(found.select("query_id", F.col("loser").alias("segment_id")).distinct(), ["query_id", "segment_id"], "left_anti")


def diverse(ctx: DataFrame, k: int = 6, most: float = 0.7) -> DataFrame:
    """Greedy choice in rank order: a context joins if its words overlap those of every chosen one by ``most`` at most.

    One fold over a query's ranked list, which is short.
    """
    words = F.array_distinct(F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), r"\s+"), lambda x: x != ""))
    rows = ctx.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", F.col("segment_id").alias("i"), words.alias("w")))).alias("r"))
    first = F.struct(F.slice("r", 1, 0).alias("c"))

    def step(s: Column, x: Column) -> Column:
        ok = (F.size(s["c"]) < k) & ~F.exists(s["c"], lambda y: jaccard(y["w"], x["w"]) > most)
        return F.struct(F.when(ok, F.array_append(s["c"], x)).otherwise(s["c"]).alias("c"))

    return rows.select("query_id", F.explode(F.aggregate("r", first, step)["c"]).alias("x")).select("query_id", F.col("x.i").alias("segment_id"), F.col("x.rank").alias("rank"))


def within_budget(ctx: DataFrame, budget: int = 2000) -> DataFrame:
    """The longest run of ranked contexts whose estimated tokens fit; contexts without text are passed over."""
    t = ctx.filter(F.length(F.trim(F.coalesce("text", F.lit("")))) > 0).withColumn("tokens", token_estimate(F.col("text")))
    run = F.sum("tokens").over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    return t.withColumn("running", run).filter(F.col("running") <= budget)


def adaptive_select(ctx: DataFrame, budget: int = 2000) -> DataFrame:
    """As many contexts as the question's type asks for, by score or by diversity, then what fits the budget."""
    spark = ctx.sparkSession
    plan = spark.createDataFrame([(k, *v) for k, v in STRATEGIES.items()], "kind string, most int, choice string, confidence double")
    c = ctx.withColumn("kind", question_type(F.col("question"))).join(F.broadcast(plan), "kind")
    by_score = c.filter("choice = 'top_score' and rank <= most")
    spread = c.filter("choice = 'diversity'")
    spread = spread.join(diverse(spread, STRATEGIES["diagnostic"][0]).select("query_id", "segment_id"), ["query_id", "segment_id"], "left_semi").select(*by_score.columns)
    return within_budget(by_score.unionByName(spread), budget)


def curate(ctx: DataFrame, threshold: float = 0.1, budget: int = 2000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Quality filter, relevance, conflicts, selection: (selected, conflicts, stage counts per query)."""
    good = quality_filter(ctx, threshold)
    scored = relevance(good)
    found = conflicts(scored)
    left = resolve(scored, found)
    left = ranked(left.drop("rank"), ["query_id"], [F.col("relevance").desc(), F.col("segment_id")])
    chosen = adaptive_select(left, budget)
    stages = {"initial": ctx, "after_quality": good, "conflicts": found, "after_conflicts": left, "selected": chosen}
    seen = reduce(DataFrame.unionAll, (d.select("query_id", F.lit(c).alias("stage")) for c, d in stages.items()))
    stats = seen.groupBy("query_id").agg(*(F.count_if(F.col("stage") == c).alias(c) for c in stages)).filter("initial > 0")
    stats = stats.withColumn("pass_rate", F.round(F.col("after_quality") / F.col("initial"), 6)).withColumn("reduction_rate", F.round(1 - F.col("selected") / F.col("initial"), 6))
    return chosen, found, stats
