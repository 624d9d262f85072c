"""Queries that compose whole services: hybrid search, result rows, answers with citations, evaluation rates, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clipquery.functions import text as T
from clipquery.operators import answer, clean, curate, dense, evaluate, segments, serve
from clipquery.plans import answering, judging, search
from clipquery.plans.answering import CTX, GATE, PROMPTS, WORDSET, attribute, clock_sql, conflicts_sql, jaccard_sql, relevant_sql, sentences_sql
from clipquery.plans.search import CHUNKS, EXPANDED, LINEAR, PROXY, SEG, VEC, bm25_sql
from clipquery.sources import results
from clipquery.sources.tables import table


def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    """Expanded queries over all documents, with the vectors as visual documents without text in the pool."""
    empty = table(spark, d, "embeddings").count()
    return serve.hybrid(search.documents(spark, d), search.questions(spark, d), search.proxy_hits(spark, d), search.K, search.ALPHA, empty_docs=empty)


def hybrid_search_rrf(spark: SparkSession, d: str) -> DataFrame:
    empty = table(spark, d, "embeddings").count()
    return serve.hybrid(search.documents(spark, d), search.questions(spark, d), search.proxy_hits(spark, d), search.K, search.ALPHA, "rrf", False, empty)


def shown(spark: SparkSession, d: str) -> DataFrame:
    """Windows as hits of their document: every third is visual, every fifth without type, entities from the text."""
    w = search.windowed(spark, d)
    k = F.col("window_id")
    tags = F.transform(F.array_sort(T.entities(F.col("text"))), lambda e: F.struct(e.alias("text")))
    info = F.struct((F.col("end_token") - F.col("start_token")).alias("window_size"), "start_token", "end_token")
    return w.select(
        F.col("video_id").alias("query_id"), F.when(k % 3 == 2, "visual").otherwise("text").alias("modality"), (k / 100.0).alias("distance"), F.concat(F.lit("features/test/"), F.col("video_id").cast("string"), F.lit(".json")).alias("source_file"), "segment_id",
        "video_id", F.col("start_token").cast("double").alias("start"), F.when(k % 7 != 6, F.col("end_token").cast("double")).alias("end"), "text", tags.alias("entities"), F.when(k % 5 != 4, "sliding_window").alias("processing_type"), F.when(k % 4 != 3, info).alias("window_info"), "window_id",
    )


def metadata_projection(spark: SparkSession, d: str) -> DataFrame:
    return serve.metadata(shown(spark, d)).select("segment_id", "video_id", "timestamp", "entities", "processing_type", "window_size", "window_range", "window_id", F.md5("text").alias("text_md5"))


def result_rows(spark: SparkSession, d: str) -> DataFrame:
    return serve.formatted(serve.metadata(shown(spark, d)), search.K)


def timed(spark: SparkSession, d: str) -> DataFrame:
    w = search.windowed(spark, d)
    return w.join(segments.times(w, search.chunks_of(spark, d)), ["video_id", "segment_id"])


def precise_hits(spark: SparkSession, d: str) -> DataFrame:
    """Windows as hits; every seventh has an id that no segment has and passes through."""
    w = search.windowed(spark, d)
    odd = F.when(F.col("window_id") % 7 == 6, F.concat("segment_id", F.lit("_x"))).otherwise(F.col("segment_id"))
    out = serve.precise(w.select("video_id", odd.alias("segment_id"), "window_id"), timed(spark, d))
    return out.select("video_id", "segment_id", "window_id", "precise_start", "precise_end", F.size("all_timestamps").alias("n_times"), F.md5("full_segment_text").alias("text_md5"))


def extended_text(spark: SparkSession, d: str) -> DataFrame:
    docs = search.documents(spark, d).withColumnRenamed("doc_id", "video_id")
    out = serve.extended_text(segments.time_range(search.windowed(spark, d), search.chunks_of(spark, d)), docs)
    return out.select("segment_id", "n_segments", F.md5("extended_text").alias("text_md5"), "range_start", "range_end")


def window_chars(spark: SparkSession, d: str) -> DataFrame:
    w = search.windowed(spark, d).join(search.documents(spark, d).select(F.col("doc_id").alias("video_id"), F.length("text").alias("n_chars")), "video_id")
    c = serve.char_range(F.col("start_token"), F.col("end_token"), F.col("total_tokens"), F.col("n_chars"))
    return w.select("segment_id", c["start_char"].alias("start_char"), c["end_char"].alias("end_char"))


def visual_neardup_entities(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings").select(F.expr("vec_id div 10").alias("video_id"), "vec_id", "embedding", (F.col("vec_id") % 3).cast("int").alias("n_entities"))
    return dense.drop_near_vectors(v, "video_id", "vec_id", 0.15, entities_col="n_entities")


def keep_first(spark: SparkSession, d: str) -> DataFrame:
    return clean.keep_first(table(spark, d, "documents").select("source", "doc_id", "lang", "n_chars"), ["source"], ["doc_id"])


def questions_per_video(spark: SparkSession, d: str) -> DataFrame:
    """Questions of each conversation beside the length of its first turn."""
    c = table(spark, d, "conversations").select("conv_id", "turn", "role", F.length("text").cast("long").alias("video_length"))
    n = c.filter("role = 'user'").groupBy("conv_id").agg(F.count("*").alias("num_questions"))
    return n.join(clean.keep_first(c, ["conv_id"], ["turn"]).select("conv_id", "video_length"), "conv_id")


def answer_chain(spark: SparkSession, d: str) -> DataFrame:
    return answer.chain(answering.contexts(spark, d))[0]


def answer_claims(spark: SparkSession, d: str) -> DataFrame:
    """The claims behind the answers, with their evidence."""
    return answer.chain(answering.contexts(spark, d))[1].select(F.col("answer_id").alias("query_id"), "claim_ix", "evidence_ix", "similarity", "support_level")


def curated_answers(spark: SparkSession, d: str) -> DataFrame:
    """Answers from curated contexts; their sorts of text are checked against the pieces' own queries."""
    return answer.chain(answering.contexts(spark, d), curated=lambda ctx: curate.curate(ctx)[0])[0]


def minimal_prompts(spark: SparkSession, d: str) -> DataFrame:
    g = answering.contexts(spark, d).groupBy("query_id", "question").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]).alias("texts"))
    return g.select("query_id", answer.minimal_prompt(F.col("question"), F.col("texts")).alias("prompt"))


def batch_prompts(spark: SparkSession, d: str) -> DataFrame:
    """Ten queries a prompt."""
    rows = minimal_prompts(spark, d).select(F.expr("query_id div 10").alias("batch"), F.col("query_id").alias("ix"), "prompt")
    return answer.batch_prompt(rows, "batch")


def nli_rerank_default(spark: SparkSession, d: str) -> DataFrame:
    out = curate.nli_rerank(answering.scored(spark, d), F.col("visual_score") / 2, 15)
    return out.select("query_id", "segment_id", "final_score", F.col("final_rank").cast("int").alias("final_rank"))


def conflict_pairs_default(spark: SparkSession, d: str) -> DataFrame:
    return curate.conflicts(answering.scored(spark, d))


def video_retrieved(spark: SparkSession, d: str) -> DataFrame:
    hits = search.bm25_topk(spark, d).select("query_id", F.col("doc_id").alias("video_id"))
    return evaluate.video_found(hits, judging.truth(spark, d).withColumnRenamed("doc_id", "video_id"))


def evaluation_rates(spark: SparkSession, d: str) -> DataFrame:
    """The share of queries whose video was found, and of those that got an answer."""
    rows = video_retrieved(spark, d).join(answering.generated_answers(spark, d).select("query_id", "sufficient"), "query_id", "full_outer")
    return evaluate.rates(rows, {"correct_video_rate": "correct_video", "success_rate": "sufficient"})


def evaluation_report(spark: SparkSession, d: str) -> DataFrame:
    """The metric summary as Markdown, null without metrics."""
    return results.report(judging.metric_summary(spark, d), "Evaluation of the test split", 3, bare=False)


def answer_export(spark: SparkSession, d: str) -> DataFrame:
    """Answers and their hits as JSON, read back: one row per hit."""
    ctx = answering.contexts(spark, d)
    said = answering.generated_answers(spark, d).join(search.questions(spark, d).withColumnRenamed("text", "query"), "query_id").select("query_id", "query", "answer", "sufficient")
    out = results.answer_json(said, ctx.select("query_id", "rank", "segment_id", "combined_score"))
    kind = "struct<query: string, search_results: array<struct<rank: int, segment_id: bigint, combined_score: double>>, generated_answer: struct<answer: string, sufficient: boolean>>"
    j = out.select("query_id", F.from_json("json", kind).alias("j"))
    return j.select("query_id", "j.query", "j.generated_answer.answer", "j.generated_answer.sufficient", F.inline("j.search_results"))


def download_failures(spark: SparkSession, d: str) -> DataFrame:
    """Pages as downloads of their host, where odd page numbers fail and even ones are there already."""
    p = table(spark, d, "pages").select(F.col("page_id").alias("video_id"), F.col("url").alias("video_url"))
    return results.failed(results.download(p, lambda video, url: video % 3 == 0, p.filter("video_id % 2 = 0").select("video_id")))


_POOL = bm25_sql("{q}").replace("count(*)::DOUBLE AS n, sum(dl)::DOUBLE / count(*) AS avgdl", "(count(*) + (SELECT count(*) FROM embeddings))::DOUBLE AS n, sum(dl)::DOUBLE / (count(*) + (SELECT count(*) FROM embeddings)) AS avgdl").replace(" WHERE rank <= 10", "")
TIMES = "tm AS (SELECT seg.video_id, segment_id, list(ch.start ORDER BY ch.start, ch.\"end\") AS s, list(ch.\"end\" ORDER BY ch.start, ch.\"end\") AS e FROM seg JOIN ch ON seg.video_id = ch.video_id AND ch.start <= end_token AND ch.\"end\" >= start_token GROUP BY ALL)"
_ENT = answering.entities_sql("text")
SHOWN = f"""{SEG},
 md AS (SELECT *, window_id % 3 = 2 AS visual, printf('%.2fs - %.2fs', start_token::DOUBLE, end_token::DOUBLE) AS span, array_to_string(list_sort({_ENT}), ', ') AS names FROM seg),
 sh AS (SELECT segment_id, video_id, window_id, visual, text, CASE WHEN window_id % 7 = 6 THEN 'unknown time' ELSE span END AS "timestamp", names AS entities, CASE WHEN window_id % 5 = 4 THEN 'unknown' ELSE 'sliding_window' END AS processing_type,
   CASE WHEN window_id % 4 <> 3 THEN end_token - start_token END AS window_size, CASE WHEN window_id % 4 <> 3 THEN 'tokens ' || start_token || '-' || end_token END AS window_range FROM md)"""
_FIRST = "coalesce(nullif(first, ''), 'No evidence.')"
CHAIN = f"""{GATE.replace("FROM ctx GROUP BY query_id)", "FROM ctx WHERE rank <= 3 GROUP BY query_id)")}, {PROMPTS},
 cs AS (SELECT query_id, query_type, CASE WHEN sufficient THEN {_FIRST} ELSE refusal END AS answer, sufficient, confidence AS gated FROM pr JOIN gate USING (query_id)),
 c0 AS (SELECT query_id, {sentences_sql("answer")} AS l FROM cs WHERE sufficient),
 cc AS (SELECT query_id, (generate_subscripts(l, 1) - 1)::INT AS claim_ix, unnest(l) AS claim FROM c0),
 ce AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rank)::INT AS evidence_ix, text FROM ctx WHERE rank <= 3),
 cn AS (SELECT *, nullif(regexp_extract(claim, '(?i)\\[?(?:Evidence|Video)\\s+(\\d+)\\]?', 1), '')::INT AS named FROM cc),
 cj AS (SELECT query_id, claim_ix, claim, evidence_ix, text AS evidence, coalesce(named = evidence_ix, false) AS sure, CASE WHEN named = evidence_ix THEN 1E0 ELSE round({jaccard_sql("a", "b")}, 6) END AS similarity
   FROM (SELECT *, {WORDSET.replace("{x}", "claim")} AS a FROM cn) JOIN (SELECT *, {WORDSET.replace("{x}", "text")} AS b FROM ce) USING (query_id)),
 cb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, claim_ix ORDER BY sure DESC, similarity DESC, evidence_ix) AS n FROM cj WHERE similarity > 0) WHERE n = 1),
 ca AS (SELECT query_id, claim_ix, evidence_ix, coalesce(similarity, 0E0) AS similarity, CASE WHEN evidence_ix IS NULL THEN 'UNSUPPORTED' WHEN sure THEN 'HIGH' WHEN similarity < 0.3E0 THEN 'UNSUPPORTED'
   WHEN contains(lower(evidence), lower(cc.claim)) OR contains(lower(cc.claim), lower(evidence)) OR similarity >= 0.7E0 THEN 'HIGH' WHEN similarity >= 0.5E0 THEN 'MEDIUM' ELSE 'LOW' END AS support_level FROM cc LEFT JOIN cb USING (query_id, claim_ix)),
 cq AS (SELECT query_id, count(*) AS n_claims, round(avg(CASE support_level {" ".join(f"WHEN '{k}' THEN {v}E0" for k, v in attribute.WEIGHTS.items())} END), 6) AS c FROM ca GROUP BY 1)"""
MINIMAL = f"""{CTX}, mp AS (SELECT query_id, 'Q: ' || question || chr(10) || string_agg('- ' || CASE WHEN length(text) > 200 THEN left(text, 200) || '...' ELSE coalesce(text, '') END, chr(10) ORDER BY rank) FILTER (rank <= 3) || chr(10) || 'A:' AS prompt FROM ctx GROUP BY query_id, question)"""
_ROW = "'| ' || metric || ' | ' || " + " || ' | ' || ".join(f"printf('%.3f', {c})" for c in ("mean", "std", '"median"', '"min"', '"max"')) + " || ' | ' || \"count\" || ' |'"
FOUND = f"{judging.JUDGED}, vr AS (SELECT query_id, coalesce(bool_or(bm25.doc_id IS NOT NULL), false) AS correct_video FROM tr LEFT JOIN bm25 USING (query_id, doc_id) GROUP BY query_id)"
SAID = f"SELECT query_id, CASE WHEN sufficient THEN {_FIRST} ELSE refusal END AS answer, sufficient FROM pr JOIN gate USING (query_id)"

SQL = {
    "hybrid_search": f"WITH {_POOL.replace('{q}', EXPANDED)}, {PROXY}, {LINEAR} SELECT * FROM linear WHERE rank <= 10",
    "hybrid_search_rrf": f"""WITH {_POOL.replace('{q}', 'text')}, {PROXY}, g AS (SELECT query_id, segment_id, min(d)::INT AS dense_rank, min(s)::INT AS bm25_rank FROM (SELECT query_id, segment_id, rank AS d, NULL AS s FROM proxy UNION ALL SELECT query_id, doc_id, NULL, rank FROM bm25) GROUP BY ALL),
 r AS (SELECT *, round(coalesce(0.3E0 / (59 + dense_rank), 0E0) + coalesce(0.7E0 / (59 + bm25_rank), 0E0), 9) AS rrf_score FROM g)
 SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, segment_id)::INT AS rank FROM r) WHERE rank <= 10""",
    "metadata_projection": f"WITH {SHOWN} SELECT segment_id, video_id::VARCHAR AS video_id, \"timestamp\", entities, processing_type, window_size, window_range, window_id, md5(text) AS text_md5 FROM sh",
    "result_rows": f"""WITH {SHOWN}, o AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY window_id)::INT AS rank FROM sh)
 SELECT video_id AS query_id, rank, CASE WHEN visual THEN 'visual' ELSE 'text' END AS modality, printf('%.3f', exp(-(window_id / 100E0))) AS similarity, video_id::VARCHAR AS video_id, "timestamp", video_id || '.json' AS source, processing_type,
 CASE WHEN NOT visual AND text <> '' THEN left(text, 200) END AS transcript, nullif(entities, '') AS entities, window_size, window_range FROM o WHERE rank <= 10""",
    "precise_hits": f"""WITH {SEG}, {CHUNKS}, {TIMES} SELECT w.video_id, CASE WHEN window_id % 7 = 6 THEN w.segment_id || '_x' ELSE w.segment_id END AS segment_id, window_id, s[len(s) // 2 + 1] AS precise_start, e[len(s) // 2 + 1] AS precise_end, len(s)::INT AS n_times, CASE WHEN s IS NOT NULL THEN md5(text) END AS text_md5
 FROM seg w LEFT JOIN tm ON tm.segment_id = w.segment_id AND window_id % 7 <> 6""",
    "extended_text": f"""WITH {SEG}, {CHUNKS}, {TIMES}, sg AS (SELECT seg.*, s, e FROM seg JOIN tm USING (video_id, segment_id)),
 l AS (SELECT a.segment_id, a.video_id, a.start_token, a.end_token, b.start_token AS b1, c.start_token AS b2, d.end_token AS d1, x.end_token AS d2, coalesce(c.s, b.s, a.s) AS s, coalesce(x.e, d.e, a.e) AS e FROM sg a
   LEFT JOIN sg b ON b.video_id = a.video_id AND b.end_token = a.start_token LEFT JOIN sg c ON c.video_id = a.video_id AND c.end_token = b.start_token
   LEFT JOIN sg d ON d.video_id = a.video_id AND d.start_token = a.end_token LEFT JOIN sg x ON x.video_id = a.video_id AND x.start_token = d.end_token)
 SELECT segment_id, (1 + (b1 IS NOT NULL)::INT + (b2 IS NOT NULL)::INT + (d1 IS NOT NULL)::INT + (d2 IS NOT NULL)::INT)::INT AS n_segments, md5(array_to_string(t[coalesce(b2, b1, start_token) + 1 : coalesce(d2, d1, end_token)], ' ')) AS text_md5, s[1] AS range_start, e[len(e)] AS range_end FROM l JOIN t USING (video_id)""",
    "window_chars": f"WITH {SEG} SELECT segment_id, floor(start_token::DOUBLE / total_tokens * length(d.text))::BIGINT AS start_char, floor(end_token::DOUBLE / total_tokens * length(d.text))::BIGINT AS end_char FROM seg JOIN documents d ON d.doc_id = video_id",
    "visual_neardup_entities": f"""WITH RECURSIVE {VEC}, o AS (SELECT vec_id // 10 AS video_id, vec_id, e, vec_id % 3 AS c, row_number() OVER (PARTITION BY vec_id // 10 ORDER BY vec_id) AS n FROM v),
 g AS (SELECT a.video_id, a.n, coalesce(list(b.n) FILTER (b.c <= a.c AND list_inner_product(a.e, b.e) > 0.15), []) AS later, coalesce(list(b.n) FILTER (b.c > a.c AND list_inner_product(a.e, b.e) > 0.15), []) AS richer FROM o a LEFT JOIN o b ON b.video_id = a.video_id AND b.n > a.n GROUP BY ALL),
 walk AS (SELECT DISTINCT video_id, 0::BIGINT AS n, []::BIGINT[] AS gone FROM o
   UNION ALL SELECT w.video_id, g.n, CASE WHEN list_contains(w.gone, g.n) THEN w.gone ELSE list_concat(w.gone, g.later, CASE WHEN len(list_filter(g.richer, lambda x: NOT list_contains(w.gone, x))) > 0 THEN [g.n] ELSE [] END) END FROM walk w JOIN g ON g.video_id = w.video_id AND g.n = w.n + 1),
 fin AS (SELECT video_id, arg_max(gone, n) AS gone FROM walk GROUP BY 1)
 SELECT video_id, vec_id FROM o JOIN fin USING (video_id) WHERE NOT list_contains(gone, n)""",
    "keep_first": "SELECT source, doc_id, lang, n_chars FROM (SELECT source, doc_id, lang, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents) WHERE n = 1",
    "questions_per_video": "SELECT conv_id, num_questions, video_length FROM (SELECT conv_id, count(*) AS num_questions FROM conversations WHERE role = 'user' GROUP BY 1) JOIN (SELECT conv_id, arg_min(length(text), turn) AS video_length FROM conversations GROUP BY 1) USING (conv_id)",
    "answer_chain": f"WITH {CHAIN} SELECT query_id, query_type, answer, sufficient, CASE WHEN sufficient THEN coalesce(c, gated) ELSE 0E0 END AS confidence, coalesce(n_claims, 0) AS n_claims FROM cs LEFT JOIN cq USING (query_id)",
    "answer_claims": f"WITH {CHAIN} SELECT query_id, claim_ix, evidence_ix, similarity, support_level FROM ca",
    "minimal_prompts": f"WITH {MINIMAL} SELECT * FROM mp",
    "batch_prompts": f"WITH {MINIMAL}, mn2 AS (SELECT query_id // 10 AS batch, prompt, row_number() OVER (PARTITION BY query_id // 10 ORDER BY query_id) AS i FROM mp) SELECT batch, string_agg(i || '. ' || prompt, chr(10) || chr(10) ORDER BY i) AS prompt FROM mn2 GROUP BY 1",
    "nli_rerank_default": answering.SQL["nli_rerank"].replace("rank <= 5", "rank <= 15"),
    "conflict_pairs_default": f"WITH {CTX}, {relevant_sql('ctx')}, {conflicts_sql('rel', 20, 0.5)} SELECT * FROM conf",
    "video_retrieved": f"WITH {FOUND} SELECT * FROM vr",
    "evaluation_rates": f"WITH {FOUND}, ga AS ({answering.SQL['generated_answers']}), j AS (SELECT * FROM vr FULL JOIN ga USING (query_id)) SELECT round(avg(coalesce(correct_video, false)::INT), 6) AS correct_video_rate, round(avg(coalesce(sufficient, false)::INT), 6) AS success_rate FROM j",
    "evaluation_report": f"SELECT '# Evaluation of the test split' || chr(10) || chr(10) || 'Queries: 3' || chr(10) || chr(10) || '| metric | mean | std | median | min | max | count |' || chr(10) || '|-|-|-|-|-|-|-|' || chr(10) || string_agg({_ROW}, chr(10) ORDER BY metric) || chr(10) AS report FROM ({judging.SQL['metric_summary']})",
    "answer_export": f"WITH {GATE}, {PROMPTS}, sd AS ({SAID}) SELECT query_id, question AS query, answer, sufficient, rank, segment_id, combined_score FROM ctx JOIN sd USING (query_id)",
    "download_failures": "SELECT page_id AS video_id FROM pages WHERE url IS NOT NULL AND page_id % 2 <> 0 AND page_id % 3 <> 0",
}

QUERIES = {f.__name__: f for f in (
    hybrid_search, hybrid_search_rrf, metadata_projection, result_rows, precise_hits, extended_text, window_chars, visual_neardup_entities, keep_first, questions_per_video, answer_chain, answer_claims, curated_answers, minimal_prompts,
    batch_prompts, nli_rerank_default, conflict_pairs_default, video_retrieved, evaluation_rates, evaluation_report, answer_export, download_failures,
)}
