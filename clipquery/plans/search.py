"""Search queries: segments, sparse and dense hits, fusion, aggregation by segment and video."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clipquery.functions.synonyms import SYNONYMS, expand
from clipquery.functions.text import TOKEN, tokens, words
from clipquery.functions.vector import similarity, to_distance
from clipquery.operators import aggregate, dense, fusion, segments, sparse
from clipquery.operators.common import top
from clipquery.sources.tables import table

K, ALPHA = 10, 0.3


def documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text")


def questions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def windowed(spark: SparkSession, d: str) -> DataFrame:
    return segments.windows(documents(spark, d).withColumnRenamed("doc_id", "video_id"))


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return dense.normalized_vectors(table(spark, d, "embeddings"))


def vector_queries(spark: SparkSession, d: str, backwards: bool = False) -> DataFrame:
    """The stated query set of searches: rows whose id is divisible by 50."""
    v = F.reverse("embedding") if backwards else F.col("embedding")
    return vectors(spark, d).filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), v.alias("qv"))


def vector_hits(spark: SparkSession, d: str, k: int, visual: bool = False) -> DataFrame:
    """Hits as segments of videos of ten; the second modality asks with the vector reversed."""
    corpus = vectors(spark, d).select(F.col("vec_id").alias("row_id"), F.col("embedding").alias("v"))
    hits = dense.knn(vector_queries(spark, d, visual), corpus, k)
    return hits.select("query_id", F.col("row_id").alias("segment_id"), F.expr("row_id div 10").alias("video_id"), "distance", "rank")


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return sparse.bm25(documents(spark, d), questions(spark, d), K)


def bm25_expanded(spark: SparkSession, d: str) -> DataFrame:
    return sparse.bm25(documents(spark, d), questions(spark, d).withColumn("text", expand(F.col("text"))), K)


def tokenize_stats(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return documents(spark, d).select("doc_id", F.size(tokens(t)).cast("long").alias("n_tokens"), F.size(words(t)).cast("long").alias("n_words"), F.size(F.array_distinct(tokens(t))).cast("long").alias("n_distinct"))


def dense_knn_l2(spark: SparkSession, d: str) -> DataFrame:
    return vector_hits(spark, d, K).select("query_id", "segment_id", "distance", "rank")


def similarity_transforms(spark: SparkSession, d: str) -> DataFrame:
    h = vector_hits(spark, d, K)
    x = F.col("distance")
    return h.select("query_id", "segment_id", F.round(similarity(x), 6).alias("exp_score"), F.round(1 / (1 + x), 6).alias("inverse_score"), F.round(to_distance(similarity(x)), 6).alias("back"))


def vector_pool_mean(spark: SparkSession, d: str) -> DataFrame:
    return dense.pooled(table(spark, d, "embeddings"), "label")


def vector_pool_max(spark: SparkSession, d: str) -> DataFrame:
    return dense.pooled(table(spark, d, "embeddings"), "label", method="max")


def visual_neardup_greedy(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings").select(F.expr("vec_id div 10").alias("video_id"), "vec_id", "embedding")
    return dense.drop_near_vectors(v, "video_id", "vec_id", 0.15)


def window_segments(spark: SparkSession, d: str) -> DataFrame:
    return windowed(spark, d).drop("text")


def window_dedup_coverage(spark: SparkSession, d: str) -> DataFrame:
    return segments.keep_new_coverage(windowed(spark, d)).select("segment_id", "start_token", "end_token")


def window_dedup_hash(spark: SparkSession, d: str) -> DataFrame:
    return segments.keep_new_text(windowed(spark, d)).select("segment_id", "content_hash")


def coverage_pct(spark: SparkSession, d: str) -> DataFrame:
    return segments.coverage(windowed(spark, d))


def interval_union(spark: SparkSession, d: str) -> DataFrame:
    s = segments.keep_new_coverage(windowed(spark, d), 0.9).select("video_id", F.col("start_token").alias("start"), F.col("end_token").alias("end"))
    return segments.interval_union(s, ["video_id"])


def chunks_of(spark: SparkSession, d: str) -> DataFrame:
    """Lines of documents as transcript chunks, timed by words."""
    lines = documents(spark, d).select(F.col("doc_id").alias("video_id"), F.posexplode(F.split("text", "\n")).alias("i", "line")).withColumn("n", F.size(words(F.col("line"))))
    end = F.sum("n").over(Window.partitionBy("video_id").orderBy("i"))
    return lines.withColumn("end", end).select("video_id", (F.col("end") - F.col("n")).alias("start"), "end").filter("end > start")


def window_overlap_join(spark: SparkSession, d: str) -> DataFrame:
    return segments.chunk_overlap(windowed(spark, d), chunks_of(spark, d)).select("segment_id", F.col("n_chunks").cast("long").alias("n_chunks"), "first_start", "last_end")


def refine_precise_ts(spark: SparkSession, d: str) -> DataFrame:
    return segments.chunk_overlap(windowed(spark, d), chunks_of(spark, d)).select("segment_id", "middle_start")


def extended_context(spark: SparkSession, d: str) -> DataFrame:
    return segments.extended(windowed(spark, d))


def proxy_hits(spark: SparkSession, d: str) -> DataFrame:
    """A deterministic stand-in for text vectors: documents hit at 1 - Jaccard of query and document tokens.

    Only documents that share a token with a query get a distance. Where the queries' tokens are many, those are found by
    joining on tokens.
    """
    found = sparse.shared(documents(spark, d), questions(spark, d), K)
    if found is not None:
        return found.select("query_id", F.col("doc_id").alias("segment_id"), "distance", "rank")
    q = questions(spark, d).select("query_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    t = documents(spark, d).select("doc_id", F.array_distinct(tokens(F.col("text"))).alias("t")).select("doc_id", F.size("t").alias("nd"), F.explode("t").alias("term"))
    nq = q.groupBy("query_id").agg(F.count("*").alias("nq"))
    common = t.join(F.broadcast(q), "term").groupBy("query_id", "doc_id", "nd").agg(F.count("*").alias("c"))
    j = common.join(F.broadcast(nq), "query_id").select("query_id", F.col("doc_id").alias("segment_id"), F.round(1 - F.col("c") / (F.col("nd") + F.col("nq") - F.col("c")), 6).alias("distance"))
    return top(j, ["query_id"], [F.col("distance"), F.col("segment_id")], K)


def both_hits(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return proxy_hits(spark, d), bm25_topk(spark, d).withColumnRenamed("doc_id", "segment_id")


def fusion_linear(spark: SparkSession, d: str) -> DataFrame:
    return fusion.linear(*both_hits(spark, d), ALPHA)


def fusion_rrf(spark: SparkSession, d: str) -> DataFrame:
    return fusion.rrf(*both_hits(spark, d), ALPHA)


def fusion_contribution(spark: SparkSession, d: str) -> DataFrame:
    return fusion.contribution(fusion_linear(spark, d), ALPHA).select("query_id", "segment_id", "dense_part", "sparse_part", "driver")


def fused_distance(spark: SparkSession, d: str) -> DataFrame:
    """Fused scores as distances and back, as later steps read them."""
    x = to_distance(F.col("combined_score"))
    return fusion_linear(spark, d).select("query_id", "segment_id", F.round(x, 6).alias("raw_distance"), F.round(similarity(x), 6).alias("text_score"))


def contexts(spark: SparkSession, d: str) -> DataFrame:
    return aggregate.contexts(vector_hits(spark, d, 50), vector_hits(spark, d, 50, True))


def segment_multimodal(spark: SparkSession, d: str) -> DataFrame:
    return aggregate.segments(contexts(spark, d), K).select("query_id", "segment_id", "video_id", "text_score", "visual_score", "combined_score", "has_both_modalities", "fusion_mode", "rank")


def video_multimodal(spark: SparkSession, d: str) -> DataFrame:
    return aggregate.videos(contexts(spark, d), K)


def overfetch_rerank(spark: SparkSession, d: str) -> DataFrame:
    """Three times as many hits by distance, ranked anew by similarity within the video, then cut."""
    h = vector_hits(spark, d, 3 * K)
    again = F.round(similarity(F.col("distance")) + 0.01 * F.count("*").over(Window.partitionBy("query_id", "video_id")), 6)
    return top(h.withColumn("score", again), ["query_id"], [F.col("score").desc(), F.col("segment_id")], K, "place").select("query_id", "segment_id", "score", "place")


_TOK = TOKEN.replace("'", "''")
BM25 = """
 tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{t}')) AS term FROM documents),
 dl AS (SELECT doc_id, len(regexp_extract_all(lower(text), '{t}')) AS dl FROM documents),
 tf AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY ALL),
 st AS (SELECT count(*)::DOUBLE AS n, sum(dl)::DOUBLE / count(*) AS avgdl FROM dl),
 idf AS (SELECT term, ln((n - c + 0.5E0) / (c + 0.5E0)) AS idf FROM (SELECT term, count(*) AS c FROM tf GROUP BY term), st),
 qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT item_id AS query_id, unnest(regexp_extract_all(lower({q}), '{t}')) AS term FROM benchmark) GROUP BY ALL),
 w AS (SELECT query_id, term, qtf * CASE WHEN idf < 0 THEN 0.25E0 * (SELECT avg(idf) FROM idf) ELSE idf END AS w FROM qt JOIN idf USING (term)),
 sc AS (SELECT query_id, doc_id, round(sum(w * tf * 2.5E0 / (tf + 1.5E0 * (0.25E0 + 0.75E0 * dl / avgdl))), 6) AS bm25_score FROM w JOIN tf USING (term) JOIN dl USING (doc_id), st GROUP BY ALL),
 bm25 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY bm25_score DESC, doc_id)::INT AS rank FROM sc WHERE bm25_score > 0) WHERE rank <= 10)"""


def bm25_sql(query: str = "text") -> str:
    return BM25.replace("{t}", _TOK).replace("{q}", query)


EXPANDED = "concat_ws(' ', text, " + ", ".join(f"CASE WHEN contains(lower(text), '{t}') THEN '{' '.join(s)}' END" for t, s in SYNONYMS.items()) + ")"
SEG = """
 t AS (SELECT doc_id AS video_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS t FROM documents),
 seg AS (SELECT video_id, video_id || '_seg_' || k AS segment_id, k::INT AS window_id, (64 * k)::INT AS start_token, least(64 * k + 256, len(t))::INT AS end_token,
   len(t)::INT AS total_tokens, array_to_string(t[64 * k + 1 : least(64 * k + 256, len(t))], ' ') AS text
   FROM (SELECT video_id, t, unnest(range((len(t) + 63) // 64)) AS k FROM t) WHERE least(64 * k + 256, len(t)) - 64 * k >= 64)"""
COVERED = """
 walk AS (
   SELECT video_id, 0 AS k, 0 AS e, false AS kept, -1 AS at FROM seg GROUP BY video_id
   UNION ALL
   SELECT w.video_id, w.k + 1, CASE WHEN g.ok THEN greatest(w.e, s.end_token) ELSE w.e END, g.ok, s.window_id
   FROM walk w JOIN (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY window_id) AS n FROM seg) s ON s.video_id = w.video_id AND s.n = w.k + 1,
   LATERAL (SELECT greatest(0, s.end_token - greatest(s.start_token, w.e))::DOUBLE / (s.end_token - s.start_token) >= {m} AS ok) g),
 kept AS (SELECT seg.* FROM seg JOIN walk ON seg.video_id = walk.video_id AND seg.window_id = walk.at WHERE walk.kept)"""
UNION = """
 u AS (SELECT *, CASE WHEN start_token <= max(end_token) OVER w THEN 0 ELSE 1 END AS fresh FROM {s} WINDOW w AS (PARTITION BY video_id ORDER BY start_token, end_token ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 isl AS (SELECT *, sum(fresh) OVER (PARTITION BY video_id ORDER BY start_token, end_token ROWS UNBOUNDED PRECEDING) AS g FROM u),
 un AS (SELECT video_id, total_tokens, g, min(start_token) AS start, max(end_token) AS "end" FROM isl GROUP BY ALL)"""
CHUNKS = """
 ln AS (SELECT doc_id AS video_id, generate_subscripts(l, 1) AS i, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
 ln2 AS (SELECT video_id, i, len(list_filter(regexp_split_to_array(line, '\\s+'), lambda x: x <> '')) AS n FROM ln),
 ch AS (SELECT video_id, (e - n)::BIGINT AS start, e::BIGINT AS "end" FROM (SELECT *, sum(n) OVER (PARTITION BY video_id ORDER BY i) AS e FROM ln2) WHERE n > 0),
 ov AS (SELECT segment_id, list(ch.start ORDER BY ch.start, ch."end") AS s, max(ch."end") AS last_end FROM seg JOIN ch ON seg.video_id = ch.video_id AND ch.start <= end_token AND ch."end" >= start_token GROUP BY segment_id)"""
VEC = """
 v0 AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
 v AS (SELECT vec_id, label, list_transform(e, lambda x: x / sqrt(list_inner_product(e, e))) AS e FROM v0)"""


def knn_sql(name: str, k: int, vector: str = "q.e") -> str:
    return f"""
 {name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, segment_id)::INT AS rank FROM
   (SELECT q.vec_id AS query_id, c.vec_id AS segment_id, c.vec_id // 10 AS video_id, round(list_sum(list_transform(list_zip({vector}, c.e), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 6) AS distance FROM v q, v c WHERE q.vec_id % 50 = 0)) WHERE rank <= {k})"""


PROXY = f"""
 pq AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '{_TOK}')) AS term FROM benchmark),
 pd AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '{_TOK}')) AS term FROM documents),
 pj AS (SELECT query_id, doc_id AS segment_id, round(1 - c::DOUBLE / (nd + nq - c), 6) AS distance FROM (SELECT query_id, doc_id, count(*) AS c FROM pq JOIN pd USING (term) GROUP BY ALL)
   JOIN (SELECT doc_id, count(*) AS nd FROM pd GROUP BY 1) USING (doc_id) JOIN (SELECT query_id, count(*) AS nq FROM pq GROUP BY 1) USING (query_id)),
 proxy AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, segment_id)::INT AS rank FROM pj) WHERE rank <= 10)"""
LINEAR = """
 mm AS (SELECT query_id, doc_id AS segment_id, CASE WHEN max(bm25_score) OVER q > min(bm25_score) OVER q THEN (bm25_score - min(bm25_score) OVER q) / (max(bm25_score) OVER q - min(bm25_score) OVER q) ELSE 0 END AS s FROM bm25 WINDOW q AS (PARTITION BY query_id)),
 lj AS (SELECT query_id, segment_id, coalesce(exp(-distance), 0E0) AS d, coalesce(s, 0E0) AS s FROM proxy FULL JOIN mm USING (query_id, segment_id)),
 lin AS (SELECT query_id, segment_id, round(d, 6) AS dense_score, round(s, 6) AS bm25_score, round(0.3E0 * d + 0.7E0 * s, 6) AS combined_score FROM lj),
 linear AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY combined_score DESC, segment_id)::INT AS rank FROM lin)"""
CTX = """
 a AS (SELECT query_id, segment_id, video_id, exp(-distance) AS t FROM th), b AS (SELECT query_id, segment_id, video_id, exp(-distance) AS v FROM vh),
 ab AS (SELECT *, t IS NOT NULL AND v IS NOT NULL AS has_both_modalities FROM a FULL JOIN b USING (query_id, segment_id, video_id)),
 ctx AS (SELECT query_id, segment_id, video_id, round(coalesce(t, 0), 6) AS text_score, round(coalesce(v, 0), 6) AS visual_score, has_both_modalities,
   CASE WHEN has_both_modalities AND v < 0.4 THEN 'adaptive_text_heavy' WHEN has_both_modalities THEN 'balanced' WHEN t IS NOT NULL THEN 'text_only' ELSE 'visual_only' END AS fusion_mode,
   round(CASE WHEN has_both_modalities AND v < 0.4 THEN 0.85E0 * t + 0.15E0 * v WHEN has_both_modalities THEN 0.6E0 * t + 0.4E0 * v ELSE coalesce(t, v) END, 6) AS combined_score FROM ab)"""
HITS = f"{VEC}, {knn_sql('th', 50)}, {knn_sql('vh', 50, 'list_reverse(q.e)')}, {CTX}"
FUSED = f"{bm25_sql()}, {PROXY}, {LINEAR}"

SQL = {
    "bm25_topk": f"WITH {bm25_sql()} SELECT * FROM bm25",
    "bm25_expanded": f"WITH {bm25_sql(EXPANDED)} SELECT * FROM bm25",
    "tokenize_stats": f"SELECT doc_id, len(regexp_extract_all(lower(text), '{_TOK}')) AS n_tokens, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS n_words, len(list_distinct(regexp_extract_all(lower(text), '{_TOK}'))) AS n_distinct FROM documents",
    "dense_knn_l2": f"WITH {VEC}, {knn_sql('h', 10)} SELECT query_id, segment_id, distance, rank FROM h",
    "similarity_transforms": f"WITH {VEC}, {knn_sql('h', 10)} SELECT query_id, segment_id, round(exp(-distance), 6) AS exp_score, round(1 / (1 + distance), 6) AS inverse_score, round(-ln(exp(-distance) + 1e-10), 6) AS back FROM h",
    "vector_pool_mean": "SELECT label, (pos - 1)::INT AS pos, round(avg(x), 6) AS value FROM (SELECT label, generate_subscripts(embedding, 1) AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY ALL",
    "vector_pool_max": "SELECT label, (pos - 1)::INT AS pos, round(max(x), 6) AS value FROM (SELECT label, generate_subscripts(embedding, 1) AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY ALL",
    "visual_neardup_greedy": f"""WITH RECURSIVE {VEC},
 o AS (SELECT vec_id // 10 AS video_id, vec_id, e, row_number() OVER (PARTITION BY vec_id // 10 ORDER BY vec_id) AS n FROM v),
 walk AS (SELECT video_id, 1 AS n, vec_id, true AS ok, [e] AS kept FROM o WHERE n = 1
   UNION ALL SELECT o.video_id, o.n, o.vec_id, g.ok, CASE WHEN g.ok THEN list_append(w.kept, o.e) ELSE w.kept END FROM walk w JOIN o ON o.video_id = w.video_id AND o.n = w.n + 1,
   LATERAL (SELECT list_max(list_transform(w.kept, lambda x: list_inner_product(x, o.e))) <= 0.15 AS ok) g)
 SELECT video_id, vec_id FROM walk WHERE ok""",
    "window_segments": f"WITH {SEG} SELECT video_id, segment_id, window_id, start_token, end_token, total_tokens, md5(text) AS content_hash FROM seg",
    "window_dedup_coverage": f"WITH RECURSIVE {SEG}, {COVERED.replace('{m}', '0.3')} SELECT segment_id, start_token, end_token FROM kept",
    "window_dedup_hash": f"WITH {SEG} SELECT segment_id, content_hash FROM (SELECT segment_id, md5(text) AS content_hash, row_number() OVER (PARTITION BY video_id, md5(text) ORDER BY window_id) AS n FROM seg) WHERE n = 1",
    "coverage_pct": f"WITH {SEG}, {UNION.replace('{s}', 'seg')} SELECT video_id, total_tokens, sum(\"end\" - start)::BIGINT AS covered, round(100 * sum(\"end\" - start)::DOUBLE / total_tokens, 6) AS coverage_pct FROM un GROUP BY video_id, total_tokens",
    "interval_union": f"WITH RECURSIVE {SEG}, {COVERED.replace('{m}', '0.9')}, {UNION.replace('{s}', 'kept')} SELECT video_id, start, \"end\" FROM un",
    "window_overlap_join": f"WITH {SEG}, {CHUNKS} SELECT segment_id, len(s) AS n_chunks, s[1] AS first_start, last_end FROM ov",
    "refine_precise_ts": f"WITH {SEG}, {CHUNKS} SELECT segment_id, s[len(s) // 2 + 1] AS middle_start FROM ov",
    "extended_context": f"""WITH {SEG}, l AS (SELECT a.segment_id, a.start_token, a.end_token, b.start_token AS b1, c.start_token AS b2, d.end_token AS d1, e.end_token AS d2 FROM seg a
   LEFT JOIN seg b ON b.video_id = a.video_id AND b.end_token = a.start_token LEFT JOIN seg c ON c.video_id = a.video_id AND c.end_token = b.start_token
   LEFT JOIN seg d ON d.video_id = a.video_id AND d.start_token = a.end_token LEFT JOIN seg e ON e.video_id = a.video_id AND e.start_token = d.end_token)
 SELECT segment_id, (1 + (b1 IS NOT NULL)::INT + (b2 IS NOT NULL)::INT + (d1 IS NOT NULL)::INT + (d2 IS NOT NULL)::INT)::INT AS n_segments, coalesce(b2, b1, start_token)::INT AS first_token, coalesce(d2, d1, end_token)::INT AS last_token FROM l""",
    "fusion_linear": f"WITH {FUSED} SELECT * FROM linear",
    "fusion_rrf": f"""WITH {bm25_sql()}, {PROXY}, g AS (SELECT query_id, segment_id, min(d)::INT AS dense_rank, min(s)::INT AS bm25_rank FROM (SELECT query_id, segment_id, rank AS d, NULL AS s FROM proxy UNION ALL SELECT query_id, doc_id, NULL, rank FROM bm25) GROUP BY ALL),
 r AS (SELECT *, round(coalesce(0.3E0 / (59 + dense_rank), 0E0) + coalesce(0.7E0 / (59 + bm25_rank), 0E0), 9) AS rrf_score FROM g)
 SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, segment_id)::INT AS rank FROM r""",
    "fusion_contribution": f"WITH {FUSED} SELECT query_id, segment_id, round(0.3E0 * dense_score, 8) AS dense_part, round(0.7E0 * bm25_score, 8) AS sparse_part, CASE WHEN dense_score > bm25_score THEN 'dense-driven' WHEN bm25_score > dense_score THEN 'sparse-driven' ELSE 'balanced' END AS driver FROM linear",
    "fused_distance": f"WITH {FUSED} SELECT query_id, segment_id, round(-ln(combined_score + 1e-10), 6) AS raw_distance, round(exp(ln(combined_score + 1e-10)), 6) AS text_score FROM linear",
    "segment_multimodal": f"WITH {HITS} SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY has_both_modalities DESC, combined_score DESC, segment_id)::INT AS rank FROM ctx) WHERE rank <= 10",
    "video_multimodal": f"""WITH {HITS}, g AS (SELECT query_id, video_id, max(combined_score) AS best_combined_score, count(*) FILTER (fusion_mode <> 'visual_only') AS num_text_matches, count(*) FILTER (fusion_mode <> 'text_only') AS num_visual_matches,
   count(*) FILTER (has_both_modalities) AS num_multimodal_matches, string_agg(segment_id::VARCHAR, ',' ORDER BY combined_score DESC, segment_id::VARCHAR) AS segments FROM ctx GROUP BY ALL)
 SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY num_multimodal_matches DESC, best_combined_score DESC, video_id)::INT AS rank FROM g) WHERE rank <= 10""",
    "overfetch_rerank": f"""WITH {VEC}, {knn_sql('h', 30)}, s AS (SELECT query_id, segment_id, round(exp(-distance) + 0.01E0 * count(*) OVER (PARTITION BY query_id, video_id), 6) AS score FROM h)
 SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, segment_id)::INT AS place FROM s) WHERE place <= 10""",
}

QUERIES = {f.__name__: f for f in (
    bm25_topk, bm25_expanded, tokenize_stats, dense_knn_l2, similarity_transforms, vector_pool_mean, vector_pool_max, visual_neardup_greedy, window_segments, window_dedup_coverage, window_dedup_hash, coverage_pct, interval_union,
    window_overlap_join, refine_precise_ts, extended_context, fusion_linear, fusion_rrf, fusion_contribution, fused_distance, segment_multimodal, video_multimodal, overfetch_rerank,
)}
