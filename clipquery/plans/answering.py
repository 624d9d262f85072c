"""Queries over contexts and answers: curation, prompts, claims and their evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clipquery.functions import text as T
from clipquery.operators import answer, attribute, curate, fusion
from clipquery.operators.common import held, ranked
from clipquery.plans.search import K, bm25_sql, bm25_topk, questions
from clipquery.sources.tables import table

BUDGET = 2000


def contexts(spark: SparkSession, d: str) -> DataFrame:
    """The ten best documents of each benchmark query as contexts.

    Scores are scaled by query. The visual score stands in for a second modality by the text's length; English texts
    have a time range, by words.
    """
    asked = questions(spark, d).withColumnRenamed("text", "question")
    hits = held(fusion.min_max(bm25_topk(spark, d), "bm25_score", ["query_id"]), asked, K)
    docs = table(spark, d, "documents").select("doc_id", "text", "lang", "n_chars")
    score, n = F.round("bm25_score", 6), F.size(T.words(F.col("text"))).cast("double")
    return hits.join(docs, "doc_id").join(F.broadcast(asked), "query_id").select(
        "query_id", F.col("doc_id").alias("segment_id"), F.col("doc_id").alias("video_id"), "question", "text", score.alias("combined_score"), score.alias("text_score"),
        F.round(F.least(F.lit(1.0), F.col("n_chars") / 2000.0), 6).alias("visual_score"), F.when(F.col("lang") == "en", 0.0).alias("start"), F.when(F.col("lang") == "en", n).alias("end"), "rank",
    )


def classify_question(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").filter("role = 'user'").select("conv_id", "turn", T.question_type(F.col("text")).alias("query_type"))


def quality_filter(spark: SparkSession, d: str) -> DataFrame:
    return curate.quality_filter(contexts(spark, d)).select("query_id", "segment_id", "combined_score", "visual_score")


def scored(spark: SparkSession, d: str) -> DataFrame:
    return curate.relevance(contexts(spark, d).drop("rank"))


def relevance_score(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d).select("query_id", "segment_id", "relevance", "rank")


def nli_rerank(spark: SparkSession, d: str) -> DataFrame:
    """The entailment of a missing model is 0.5; here half of the visual score stands in, so that order changes."""
    out = curate.nli_rerank(scored(spark, d), F.col("visual_score") / 2, 5)
    return out.select("query_id", "segment_id", "final_score", F.col("final_rank").cast("int").alias("final_rank"))


def conflict_pairs(spark: SparkSession, d: str) -> DataFrame:
    return curate.conflicts(scored(spark, d), least=5, share=0.3)


def conflict_resolution(spark: SparkSession, d: str) -> DataFrame:
    ctx = scored(spark, d)
    return curate.resolve(ctx, curate.conflicts(ctx, least=5, share=0.3)).select("query_id", "segment_id", "relevance")


def diversity_sample(spark: SparkSession, d: str) -> DataFrame:
    return curate.diverse(contexts(spark, d), 4, 0.1)


def token_budget(spark: SparkSession, d: str) -> DataFrame:
    return curate.within_budget(contexts(spark, d), BUDGET).select("query_id", "segment_id", "tokens", "running")


def adaptive_select(spark: SparkSession, d: str) -> DataFrame:
    return curate.adaptive_select(contexts(spark, d), BUDGET).select("query_id", "segment_id", "kind", "tokens", "running")


def curation_stats(spark: SparkSession, d: str) -> DataFrame:
    """Every stage reads the contexts, ten rows a query, so they are kept; lost parts are computed again."""
    return curate.curate(contexts(spark, d).persist(), budget=BUDGET)[2]


def prompt_render(spark: SparkSession, d: str) -> DataFrame:
    return answer.prompts(contexts(spark, d))


def confidence_gate(spark: SparkSession, d: str) -> DataFrame:
    ctx = contexts(spark, d).withColumn("score", answer.first_score("combined_score", "text_score"))
    return answer.gate(ctx)


def generated_answers(spark: SparkSession, d: str) -> DataFrame:
    return answer.answers(contexts(spark, d))


def evidence_list(spark: SparkSession, d: str) -> DataFrame:
    """Long texts have a precise range: their middle half."""
    ctx = contexts(spark, d)
    far = F.col("end") > 100
    ctx = ctx.withColumn("precise_start", F.when(far, F.col("end") / 4)).withColumn("precise_end", F.when(far, F.col("end") * 0.75))
    return answer.evidence(ctx)


def citation_injection(spark: SparkSession, d: str) -> DataFrame:
    """A fixed answer that cites a query's ten contexts by number."""
    times = F.transform(F.sort_array(F.collect_list(F.struct("rank", T.clock_range(F.col("start"), F.col("end")).alias("t")))), lambda x: x["t"])
    g = contexts(spark, d).groupBy("query_id").agg(times.alias("times"))
    said = F.lit("As [Evidence 1] shows, Evidence 2 agrees with [Evidence 3]; not Evidence 12.")
    return g.select("query_id", answer.cite(said, F.col("times")).alias("answer"))


def cost_estimate(spark: SparkSession, d: str) -> DataFrame:
    """Costs of assistant turns: the estimated tokens of the turn before as input, their own as output."""
    rows = table(spark, d, "conversations").select("conv_id", "turn", "role", T.token_estimate(F.col("text")).alias("tokens"), F.length("text").cast("long").alias("n_chars"), F.size(T.words(F.col("text"))).cast("long").alias("n_words"))
    before = rows.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("tokens").alias("tokens_in"))
    j = rows.filter("role = 'assistant'").join(before, ["conv_id", "turn"]).withColumn("cost", answer.cost(F.col("tokens_in"), F.col("tokens")))
    return answer.cost_totals(j, "turn").select("conv_id", "turn", "n_chars", "n_words", "tokens_in", F.col("tokens").alias("tokens_out"), F.round("cost", 9).alias("cost"), "running_cost")


def said(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").filter("role = 'assistant'")
    return rows.select((F.col("conv_id") * 1000 + F.col("turn")).alias("answer_id"), "conv_id", "turn", "text")


def heard(spark: SparkSession, d: str, back: int = 3) -> DataFrame:
    """The ``back`` turns before each answer as its evidence: equi-joins, however long a conversation is. All turns of a
    conversation instead would make a long one's work grow with its square."""
    turns = table(spark, d, "conversations").select("conv_id", "turn", "text")
    before = F.explode(F.sequence(F.lit(1), F.lit(back))).alias("evidence_ix")
    a = said(spark, d).select("answer_id", "conv_id", F.col("turn").alias("at"), before).withColumn("turn", F.col("at") - F.col("evidence_ix"))
    return a.join(turns, ["conv_id", "turn"]).select("answer_id", "evidence_ix", "text")


def claims_extract(spark: SparkSession, d: str) -> DataFrame:
    return attribute.claims(said(spark, d).select("answer_id", "text"))


def attributed(spark: SparkSession, d: str) -> DataFrame:
    return attribute.attribute(claims_extract(spark, d), heard(spark, d))


def claim_attribution(spark: SparkSession, d: str) -> DataFrame:
    return attributed(spark, d).select("answer_id", "claim_ix", "evidence_ix", "similarity", "support_level", "exact_quote")


def conflicted_claims(spark: SparkSession, d: str) -> DataFrame:
    """Attributions with the evidence that a later turn negates or measures otherwise marked."""
    e = ranked(heard(spark, d), ["answer_id"], [F.col("evidence_ix")]).select(F.col("answer_id").alias("query_id"), F.col("evidence_ix").alias("segment_id"), "rank", F.lit(0.0).alias("relevance"), "text")
    pairs = curate.conflicts(e, least=2, share=0.1)
    clash = pairs.select(F.col("query_id").alias("answer_id"), F.explode(F.array("segment_id_a", "segment_id_b")).alias("evidence_ix"))
    return attribute.attribute(claims_extract(spark, d), heard(spark, d), clash).select("answer_id", "claim_ix", "support_level")


def attribution_stats(spark: SparkSession, d: str) -> DataFrame:
    return attribute.stats(attributed(spark, d))


def attribution_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """Against a made-up truth: claims of 40 characters or more come from the turn before, others from nowhere."""
    truth = claims_extract(spark, d).select("answer_id", "claim_ix", F.when(F.length("claim") >= 40, 1).alias("evidence_ix"))
    return attribute.accuracy(attributed(spark, d), truth)


def question_kind(q: str) -> str:
    low = f"lower({q})"
    any_ = lambda ks: "(" + " OR ".join(f"contains({low}, '{k}')" for k in ks) + ")"
    return f"CASE WHEN {any_(T.PROCEDURAL)} THEN 'procedural' WHEN {any_(T.DIAGNOSTIC)} THEN 'diagnostic' WHEN {any_(T.FACTOID)} THEN 'factoid' ELSE 'general' END"


def clock_sql(a: str, b: str) -> str:
    one = lambda x: f"printf('%02d:%02d', (floor({x})::INT // 60), (floor({x})::INT % 60))"
    return f"CASE WHEN {a} IS NULL OR {b} IS NULL THEN 'unknown' ELSE {one(a)} || '-' || {one(b)} END"


def jaccard_sql(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0E0 ELSE len(list_intersect({a}, {b}))::DOUBLE / len(list_distinct(list_concat({a}, {b}))) END"


def entities_sql(x: str) -> str:
    return f"list_distinct(list_slice(list_filter(regexp_extract_all(coalesce({x}, ''), '[\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_full_match(w, '[A-Za-z]{{4,}}')), 1, 20))"


def sentences_sql(x: str) -> str:
    marked = f"regexp_replace(regexp_replace({x}, '(^|[^\\p{{L}}\\p{{N}}_])([A-Z][a-z]*\\.)', '\\1\\2<PROT>', 'g'), '(^|[^\\p{{L}}\\p{{N}}_])([A-Z]{{2,}}\\.)', '\\1\\2<PROT>', 'g')"
    return f"list_transform(list_filter(regexp_split_to_array({marked}, '[.!?]+\\s+'), lambda s: trim(s) <> ''), lambda s: trim(replace(s, '<PROT>', '')))"


WORDSET = "list_distinct(list_filter(regexp_split_to_array(lower({x}), '\\s+'), lambda w: w <> ''))"
NEG = "[" + ", ".join(f"'{n}'" for n in T.NEGATIONS) + "]"
CTX = f"""{bm25_sql()},
 mn AS (SELECT query_id, doc_id, rank, round(CASE WHEN max(bm25_score) OVER q > min(bm25_score) OVER q THEN (bm25_score - min(bm25_score) OVER q) / (max(bm25_score) OVER q - min(bm25_score) OVER q) ELSE 0 END, 6) AS s FROM bm25 WINDOW q AS (PARTITION BY query_id)),
 ctx AS (SELECT query_id, doc_id AS segment_id, doc_id AS video_id, b.text AS question, d.text AS text, s AS combined_score, s AS text_score, round(least(1E0, d.n_chars / 2000E0), 6) AS visual_score,
   CASE WHEN lang = 'en' THEN 0E0 END AS start, CASE WHEN lang = 'en' THEN len(list_filter(regexp_split_to_array(d.text, '\\s+'), lambda x: x <> ''))::DOUBLE END AS "end", rank
   FROM mn JOIN documents d USING (doc_id) JOIN benchmark b ON b.item_id = query_id)"""
GOOD = "combined_score >= 0.1E0 AND (length(coalesce(text, '')) >= 20 OR visual_score >= 0.5E0) AND ((start IS NOT NULL AND \"end\" IS NOT NULL) OR combined_score > 0.6E0)"


def relevant_sql(source: str) -> str:
    has = lambda ks: "least(1E0, (" + " + ".join(f"contains(lower(text), '{k}')::INT" for k in ks) + ") / 3E0)"
    fit = "CASE WHEN text IS NULL THEN 0E0 " + " ".join(f"WHEN kind = '{k}' THEN {has(v)}" for k, v in T.ALIGNMENT.items()) + " ELSE 0.5E0 END"
    return f"""
 rel0 AS (SELECT *, {question_kind("question")} AS kind FROM {source}),
 rel1 AS (SELECT * EXCLUDE (rank), round(coalesce(nullif(combined_score, 0), text_score, 0) + 0.2E0 * {jaccard_sql(entities_sql("question"), entities_sql("text"))} + 0.1E0 * {fit}, 6) AS relevance FROM rel0),
 rel AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, segment_id)::INT AS rank FROM rel1)"""


def conflicts_sql(source: str, least: int, share: float) -> str:
    pat = "(\\d+\\.?\\d*)\\s*([a-z/%]+)"
    other = f"len(list_filter(list_intersect(a.w, b.w), lambda x: NOT list_contains({NEG}, x)))"
    return f"""
 cw AS (SELECT query_id, segment_id, rank, relevance AS s, list_distinct(list_filter(regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_full_match(w, '[a-z]+'))) AS w,
   list_zip(list_transform(regexp_extract_all(lower(coalesce(text, '')), '{pat}', 1), lambda x: x::DOUBLE), regexp_extract_all(lower(coalesce(text, '')), '{pat}', 2)) AS m FROM {source}),
 cp AS (SELECT a.query_id, a.segment_id AS segment_id_a, b.segment_id AS segment_id_b, CASE WHEN a.s < b.s THEN a.segment_id ELSE b.segment_id END AS loser,
   CASE WHEN list_has_any(a.w, {NEG}) <> list_has_any(b.w, {NEG}) AND {other} > {least} AND {other}::DOUBLE / least(len(a.w), len(b.w)) > {share}E0 THEN 'negation'
   WHEN len(list_filter(a.m, lambda x: len(list_filter(b.m, lambda y: x[2] = y[2] AND coalesce(abs(x[1] - y[1]) / nullif(greatest(x[1], y[1]), 0) > 0.2E0, false))) > 0)) > 0 THEN 'numeric' END AS type
   FROM cw a JOIN cw b ON a.query_id = b.query_id AND a.rank < b.rank),
 conf AS (SELECT query_id, segment_id_a, segment_id_b, type, loser FROM cp WHERE type IS NOT NULL)"""


def diverse_sql(source: str, k: int, most: float) -> str:
    return f"""
 dv AS (SELECT query_id, segment_id, rank, {WORDSET.replace("{x}", "coalesce(text, '')")} AS w, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS n FROM {source}),
 walk AS (SELECT query_id, n, segment_id, rank, true AS ok, [w] AS kept FROM dv WHERE n = 1
   UNION ALL SELECT v.query_id, v.n, v.segment_id, v.rank, g.ok, CASE WHEN g.ok THEN list_append(k.kept, v.w) ELSE k.kept END FROM walk k JOIN dv v ON v.query_id = k.query_id AND v.n = k.n + 1,
   LATERAL (SELECT len(k.kept) < {k} AND len(list_filter(k.kept, lambda x: ({jaccard_sql("x", "v.w")}) > {most}E0)) = 0 AS ok) g),
 chosen AS (SELECT query_id, segment_id, rank FROM walk WHERE ok)"""


def budget_sql(source: str, name: str) -> str:
    return f"""
 {name}0 AS (SELECT *, (length(text) // 4)::BIGINT AS tokens FROM {source} WHERE length(trim(coalesce(text, ''))) > 0),
 {name}1 AS (SELECT *, sum(tokens) OVER (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING)::BIGINT AS running FROM {name}0),
 {name} AS (SELECT * FROM {name}1 WHERE running <= {BUDGET})"""


def adaptive_sql(source: str) -> str:
    top = " OR ".join(f"(kind = '{k}' AND rank <= {n})" for k, (n, how, _) in curate.STRATEGIES.items() if how == "top_score")
    most = curate.STRATEGIES["diagnostic"][0]
    return f"""
 ad0 AS (SELECT *, {question_kind("question")} AS kind FROM (SELECT * FROM {source})),
 adg AS (SELECT * FROM ad0 WHERE kind = 'diagnostic'), {diverse_sql("adg", most, 0.7)},
 ad AS (SELECT * FROM ad0 WHERE {top} UNION ALL SELECT adg.* FROM adg SEMI JOIN chosen USING (query_id, segment_id)), {budget_sql("ad", "fit")}"""


CLAIMS = f"""
 ans AS (SELECT conv_id * 1000 + turn AS answer_id, conv_id, turn, text FROM conversations WHERE role = 'assistant'),
 cl0 AS (SELECT answer_id, {sentences_sql("text")} AS l FROM ans),
 cl AS (SELECT answer_id, (generate_subscripts(l, 1) - 1)::INT AS claim_ix, unnest(l) AS claim FROM cl0)"""
ATTRIBUTED = f"""{CLAIMS},
 ev AS (SELECT answer_id, i::INT AS evidence_ix, c.text FROM ans, unnest([1, 2, 3]) AS u(i) JOIN conversations c ON c.conv_id = ans.conv_id AND c.turn = ans.turn - i),
 aj AS (SELECT answer_id, claim_ix, claim, evidence_ix, text AS evidence, round({jaccard_sql("cws", "ews")}, 6) AS similarity FROM (SELECT *, {WORDSET.replace("{x}", "claim")} AS cws FROM cl) JOIN (SELECT *, {WORDSET.replace("{x}", "text")} AS ews FROM ev) USING (answer_id)),
 ab AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY answer_id, claim_ix ORDER BY similarity DESC, evidence_ix) AS n FROM aj WHERE similarity > 0) WHERE n = 1),
 aq AS (SELECT answer_id, claim_ix, arg_max(s, x - i * 1E-9) AS quote FROM (SELECT answer_id, claim_ix, i, s, {jaccard_sql(WORDSET.replace("{x}", "claim"), WORDSET.replace("{x}", "s"))} AS x
   FROM (SELECT answer_id, claim_ix, claim, generate_subscripts(l, 1) AS i, unnest(l) AS s FROM (SELECT answer_id, claim_ix, claim, {sentences_sql("evidence")} AS l FROM ab))) GROUP BY ALL),
 att AS (SELECT cl.answer_id, cl.claim_ix, cl.claim, evidence_ix, coalesce(similarity, 0E0) AS similarity,
   CASE WHEN evidence_ix IS NULL THEN 'UNSUPPORTED' WHEN similarity < 0.3E0 THEN 'UNSUPPORTED' WHEN contains(lower(evidence), lower(cl.claim)) OR contains(lower(cl.claim), lower(evidence)) OR similarity >= 0.7E0 THEN 'HIGH' WHEN similarity >= 0.5E0 THEN 'MEDIUM' ELSE 'LOW' END AS support_level,
   CASE WHEN evidence_ix IS NOT NULL THEN CASE WHEN length(quote) > 150 THEN left(quote, 147) || '...' ELSE quote END END AS exact_quote
   FROM cl LEFT JOIN ab USING (answer_id, claim_ix) LEFT JOIN aq USING (answer_id, claim_ix))"""
ASK = "CASE kind " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in answer.TEMPLATES.items()) + " END"
GATE = f"""{CTX},
 gb AS (SELECT query_id, round(max(coalesce(nullif(combined_score, 0), nullif(text_score, 0), 0)), 6) AS best, round(avg(coalesce(nullif(combined_score, 0), nullif(text_score, 0), 0)), 9) AS mean FROM ctx GROUP BY query_id),
 gate AS (SELECT *, best >= 0.45E0 AND mean >= 0.35E0 AS sufficient, CASE WHEN best >= 0.45E0 AND mean >= 0.35E0 THEN NULL WHEN best < 0.35E0 THEN 'very low relevance' WHEN best < 0.45E0 THEN 'moderate relevance, too little detail' ELSE 'low relevance on average' END AS refusal,
   round(CASE WHEN best > 0.7E0 THEN least(0.9E0, best) WHEN best > 0.5E0 THEN least(0.7E0, best) ELSE least(0.5E0, best) END, 6) AS confidence FROM gb)"""
PROMPTS = f"""
 pr0 AS (SELECT query_id, question, {question_kind("question")} AS kind, string_agg('[Video ' || rank || ': ' || video_id || ', Time: ' || ({clock_sql("start", '"end"')}) || ']' || chr(10) || 'Content: ' || CASE WHEN length(text) > 350 THEN left(text, 350) || '...' ELSE text END, chr(10) || chr(10) ORDER BY rank) AS evidence,
   arg_min(regexp_extract(CASE WHEN length(text) > 350 THEN left(text, 350) || '...' ELSE text END, '^[^\\n]*'), rank) AS first FROM ctx WHERE rank <= 3 GROUP BY ALL),
 pr AS (SELECT query_id, kind AS query_type, 'Question: ' || question || chr(10) || chr(10) || 'Video Evidence:' || chr(10) || evidence || chr(10) || chr(10) || 'Instructions:' || chr(10) || {ASK} || chr(10) || chr(10) || 'Answer:' AS prompt, first FROM pr0)"""

SQL = {
    "classify_question": f"SELECT conv_id, turn, {question_kind('text')} AS query_type FROM conversations WHERE role = 'user'",
    "quality_filter": f"WITH {CTX} SELECT query_id, segment_id, combined_score, visual_score FROM ctx WHERE {GOOD}",
    "relevance_score": f"WITH {CTX}, {relevant_sql('ctx')} SELECT query_id, segment_id, relevance, rank FROM rel",
    "nli_rerank": f"""WITH {CTX}, {relevant_sql("ctx")}, f AS (SELECT *, CASE WHEN rank <= 5 AND text IS NOT NULL THEN round(0.7E0 * relevance + 0.3E0 * (visual_score / 2), 8) END AS final_score FROM rel)
 SELECT query_id, segment_id, final_score, row_number() OVER (PARTITION BY query_id ORDER BY rank <= 5 DESC, CASE WHEN rank <= 5 THEN coalesce(final_score, relevance) END DESC NULLS LAST, rank)::INT AS final_rank FROM f""",
    "conflict_pairs": f"WITH {CTX}, {relevant_sql('ctx')}, {conflicts_sql('rel', 5, 0.3)} SELECT * FROM conf",
    "conflict_resolution": f"WITH {CTX}, {relevant_sql('ctx')}, {conflicts_sql('rel', 5, 0.3)} SELECT query_id, segment_id, relevance FROM rel ANTI JOIN (SELECT query_id, loser AS segment_id FROM conf) USING (query_id, segment_id)",
    "diversity_sample": f"WITH RECURSIVE {CTX}, {diverse_sql('ctx', 4, 0.1)} SELECT * FROM chosen",
    "token_budget": f"WITH {CTX}, {budget_sql('ctx', 'fit')} SELECT query_id, segment_id, tokens, running FROM fit",
    "adaptive_select": f"WITH RECURSIVE {CTX}, {adaptive_sql('ctx')} SELECT query_id, segment_id, kind, tokens, running FROM fit",
    "curation_stats": f"""WITH RECURSIVE {CTX}, good AS (SELECT * FROM ctx WHERE {GOOD}), {relevant_sql("good")}, {conflicts_sql("rel", 20, 0.5)},
 lft AS (SELECT * EXCLUDE (rank, kind), row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, segment_id)::INT AS rank FROM rel ANTI JOIN (SELECT query_id, loser AS segment_id FROM conf) USING (query_id, segment_id)), {adaptive_sql("lft")}
 SELECT *, round(after_quality::DOUBLE / initial, 6) AS pass_rate, round(1 - selected::DOUBLE / initial, 6) AS reduction_rate FROM (SELECT query_id, initial, coalesce(a, 0) AS after_quality, coalesce(c, 0) AS conflicts, coalesce(l, 0) AS after_conflicts, coalesce(s, 0) AS selected
 FROM (SELECT query_id, count(*) AS initial FROM ctx GROUP BY 1) LEFT JOIN (SELECT query_id, count(*) AS a FROM good GROUP BY 1) USING (query_id) LEFT JOIN (SELECT query_id, count(*) AS c FROM conf GROUP BY 1) USING (query_id)
 LEFT JOIN (SELECT query_id, count(*) AS l FROM lft GROUP BY 1) USING (query_id) LEFT JOIN (SELECT query_id, count(*) AS s FROM fit GROUP BY 1) USING (query_id))""",
    "prompt_render": f"WITH {CTX}, {PROMPTS} SELECT query_id, query_type, prompt FROM pr",
    "confidence_gate": f"WITH {GATE} SELECT query_id, best, mean, sufficient, refusal, confidence FROM gate",
    "generated_answers": f"WITH {GATE}, {PROMPTS} SELECT query_id, query_type, CASE WHEN sufficient THEN coalesce(nullif(first, ''), 'No evidence.') ELSE refusal END AS answer, confidence, sufficient FROM pr JOIN gate USING (query_id)",
    "evidence_list": f"""WITH {CTX}, e AS (SELECT query_id, segment_id, video_id, CASE WHEN "end" > 100 THEN "end" / 4 ELSE start END AS s, CASE WHEN "end" > 100 THEN "end" * 0.75E0 ELSE "end" END AS e, combined_score FROM ctx)
 SELECT query_id, segment_id, video_id, s AS start, e AS "end", combined_score AS relevance_score, {clock_sql("s", "e")} AS formatted_time FROM e""",
    "citation_injection": f"""WITH {CTX}, t AS (SELECT query_id, list({clock_sql("start", '"end"')} ORDER BY rank) AS t FROM ctx GROUP BY 1)
 SELECT query_id, 'As [Evidence 1, ' || t[1] || '] shows, Evidence 2' || coalesce(' (' || t[2] || ')', '') || ' agrees with [Evidence 3' || coalesce(', ' || t[3], '') || ']; not Evidence 12.' AS answer FROM t""",
    "cost_estimate": """WITH r AS (SELECT conv_id, turn, role, (length(text) // 4)::BIGINT AS tokens, length(text)::BIGINT AS n_chars, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS n_words FROM conversations),
 j AS (SELECT a.*, b.tokens AS tokens_in, b.tokens * 0.15E-6 + a.tokens * 0.60E-6 AS cost FROM r a JOIN r b ON b.conv_id = a.conv_id AND b.turn + 1 = a.turn WHERE a.role = 'assistant')
 SELECT conv_id, turn, n_chars, n_words, tokens_in, tokens AS tokens_out, round(cost, 9) AS cost, round(sum(cost) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING), 9) AS running_cost FROM j""",
    "claims_extract": f"WITH {CLAIMS} SELECT * FROM cl",
    "claim_attribution": f"WITH {ATTRIBUTED} SELECT answer_id, claim_ix, evidence_ix, similarity, support_level, exact_quote FROM att",
    "conflicted_claims": f"""WITH {ATTRIBUTED}, hd AS (SELECT answer_id AS query_id, evidence_ix AS segment_id, row_number() OVER (PARTITION BY answer_id ORDER BY evidence_ix)::INT AS rank, 0E0 AS relevance, text FROM ev), {conflicts_sql("hd", 2, 0.1)},
 clash AS (SELECT DISTINCT query_id AS answer_id, unnest([segment_id_a, segment_id_b]) AS evidence_ix FROM conf)
 SELECT answer_id, claim_ix, CASE WHEN c.answer_id IS NOT NULL THEN 'CONFLICTED' ELSE support_level END AS support_level FROM att LEFT JOIN clash c USING (answer_id, evidence_ix)""",
    "attribution_stats": f"""WITH {ATTRIBUTED} SELECT answer_id, count(*) AS n_claims, {", ".join(f"count(*) FILTER (support_level = '{k}') AS {k.lower()}" for k in attribute.WEIGHTS)},
 round(avg(CASE support_level {" ".join(f"WHEN '{k}' THEN {v}E0" for k, v in attribute.WEIGHTS.items())} END), 6) AS confidence FROM att GROUP BY answer_id""",
    "attribution_accuracy": f"""WITH {ATTRIBUTED}, j AS (SELECT answer_id, evidence_ix AS p, CASE WHEN length(claim) >= 40 THEN 1 END AS t FROM att)
 SELECT answer_id, round(count(*) FILTER (p IS NOT DISTINCT FROM t)::DOUBLE / count(*), 6) AS accuracy, round(CASE WHEN count(p) > 0 THEN count(*) FILTER (p = t)::DOUBLE / count(p) ELSE 0 END, 6) AS precision,
 round(CASE WHEN count(t) > 0 THEN count(*) FILTER (p = t)::DOUBLE / count(t) ELSE 0 END, 6) AS recall, round((count(*) - count(p))::DOUBLE / count(*), 6) AS unsupported_rate FROM j GROUP BY answer_id""",
}

QUERIES = {f.__name__: f for f in (
    classify_question, quality_filter, relevance_score, nli_rerank, conflict_pairs, conflict_resolution, diversity_sample, token_budget, adaptive_select, curation_stats, prompt_render, confidence_gate, generated_answers, evidence_list,
    citation_injection, cost_estimate, claims_extract, claim_attribution, conflicted_claims, attribution_stats, attribution_accuracy,
)}
