"""The queries opN_<name> over the tables of a folder, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clipquery.llm import quality, toxicity
from clipquery.llm.common import table
from clipquery.llm.exact_dedup import exact_dedup
from clipquery.llm.labelled import remainder
from clipquery.llm.license_scan import license_scan
from clipquery.llm.mixing import mix
from clipquery.llm.near_dedup import near_components
from clipquery.llm.packing import pack
from clipquery.llm.suffix_dedup import suffix_dedup
from clipquery.llm.token_counts import token_counts
from clipquery.llm.topk_search import top_k


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """The place of a public vocabulary file, the same on every executor."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, fold = table(spark, sf_dir, "documents"), remainder("doc_id", 5)
    lexicon = toxicity.fit(docs, table(spark, sf_dir, "labels"), fold != 0)
    return toxicity.score(docs, lexicon).select("doc_id", (fold == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"), passages=True)


def op4_near_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, fold = table(spark, sf_dir, "documents"), remainder("doc_id", 4)
    model = quality.fit(docs, table(spark, sf_dir, "labels"), fold != 2)
    return quality.score(docs, model).select("doc_id", (fold == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), vocabulary())


def op7_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), vocabulary())


def op8_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_toxicity, op2_exact_dedup, op3_suffix_dedup, op4_near_components, op5_quality, op6_token_counts, op7_pack_sequences, op8_topk_search, op9_license_scan, op10_mix_sources)}

SQL: dict[str, str] = {
    "op2_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER t AS keep_id, count(*) OVER t AS group_size,
               row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC) = 1 AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW t AS (PARTITION BY coalesce(text, ''))""",
    "op4_near_components": r"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
              ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' '))) END AS s FROM w),
        e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b USING (g) WHERE a.doc_id <> b.doc_id
              GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
        c AS (SELECT doc_id, doc_id AS r FROM s UNION SELECT p.b, c.r FROM c JOIN p ON p.a = c.doc_id),
        m AS (SELECT doc_id, min(r) AS component_id FROM c GROUP BY doc_id)
        SELECT doc_id, len(s) AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN m USING (doc_id)""",
    "op8_topk_search": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS w FROM embeddings),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.w, c.w)::BIGINT AS score
              FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
    "op10_mix_sources": r"""
        WITH RECURSIVE
        d AS (SELECT doc_id, source, text, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
        s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM d GROUP BY source),
        w AS (SELECT *, (rank - 1) % 3 + 1 AS weight, 3 * source_size AS cap FROM s),
        k AS (SELECT 0 AS round, []::BIGINT[] AS capped, (SELECT sum(source_size) FROM w)::BIGINT AS rest, (SELECT sum(weight) FROM w)::BIGINT AS weights
              UNION ALL
              SELECT round + 1, list_concat(capped, more), rest - less, weights - lighter FROM (
                SELECT k.*, (SELECT list(rank) FROM w WHERE NOT list_contains(k.capped, rank) AND rest * weight > cap * weights) AS more,
                       (SELECT sum(cap) FROM w WHERE NOT list_contains(k.capped, rank) AND rest * weight > cap * weights)::BIGINT AS less,
                       (SELECT sum(weight) FROM w WHERE NOT list_contains(k.capped, rank) AND rest * weight > cap * weights)::BIGINT AS lighter FROM k)
              WHERE more IS NOT NULL),
        f AS (SELECT * FROM k ORDER BY round DESC LIMIT 1),
        t AS (SELECT w.*, CASE WHEN list_contains(f.capped, rank) THEN cap::DOUBLE ELSE (weight * f.rest)::DOUBLE / f.weights END AS target FROM w, f),
        b AS (SELECT ceil(sum(source_size) / 32.0)::BIGINT AS blocks, greatest(1, ceil(sum(source_size) / 4e6))::BIGINT AS shards FROM s),
        q AS (SELECT rank, row_number() OVER (ORDER BY target / (2 * i - 1) DESC, rank) AS place FROM t, b, unnest(range(1, b.blocks + 1)) AS u(i) WHERE target > 0),
        seats AS (SELECT rank, count(*) * 32 AS seats FROM q, b WHERE place <= blocks GROUP BY rank),
        n AS (SELECT t.*, coalesce(seats, 0) AS seats, greatest(source_size // 32, least(source_size, 1)) AS n FROM t LEFT JOIN seats USING (rank)),
        m AS (SELECT *, CASE WHEN source_size > 0 THEN seats // source_size ELSE 0 END AS times FROM n),
        c AS (SELECT *, least(times * n + least(floor((seats - times * source_size) / 32.0 + 0.5), n), 3 * n)::BIGINT AS q,
                     CASE WHEN n > 0 THEN ('0x' || substr(md5('42:start:' || rank), 1, 8))::BIGINT % n ELSE 0 END AS start FROM m),
        o AS (SELECT d.*, c.* EXCLUDE (source), ('0x' || substr(md5('42:shard:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT % shards AS shard FROM d JOIN c ON d.source IS NOT DISTINCT FROM c.source, b),
        e AS (SELECT *, row_number() OVER () AS row, sum(size) OVER (PARTITION BY rank ORDER BY shard, md5('42:order:' || coalesce(doc_id::VARCHAR, '')), coalesce(doc_id::VARCHAR, ''), size ROWS UNBOUNDED PRECEDING)::BIGINT AS stop FROM o),
        x AS (SELECT *, unnest([stop - size, stop]) AS x, unnest([-1, 1]) AS sign FROM e),
        y AS (SELECT *, least(x // 32, n - 1) AS i FROM x),
        z AS (SELECT *, ((i + start) * (q % n)) // n - (start * (q % n)) // n AS low, ((i + 1 + start) * (q % n)) // n - (start * (q % n)) // n AS high FROM y),
        g AS (SELECT row, sum(sign * ((q // n) * x + 32 * low + (x - 32 * i) * (high - low)))::BIGINT AS taken FROM z GROUP BY row)
        SELECT doc_id, size, source_size, target, CASE WHEN size = 0 THEN 0 ELSE taken END AS taken FROM e JOIN g ON e.row = g.row""",
}
