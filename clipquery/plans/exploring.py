"""Queries that clean and explore tables, format times, sample frames and compare configurations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clipquery.functions import text as T
from clipquery.operators import clean, explore
from clipquery.plans.search import documents, questions, segment_multimodal
from clipquery.sources import features
from clipquery.sources.tables import table

NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def clean_antijoin(spark: SparkSession, d: str) -> DataFrame:
    """Documents but those whose label says that they are bad."""
    failed = table(spark, d, "labels").filter("quality = 0")
    return clean.without_failed(table(spark, d, "documents").select("doc_id", "lang"), failed, "doc_id")


def both_modalities(spark: SparkSession, d: str) -> DataFrame:
    """Documents with a label and a vector of their number."""
    return clean.with_both(table(spark, d, "documents").select("doc_id", "lang"), table(spark, d, "labels"), table(spark, d, "embeddings").withColumnRenamed("vec_id", "doc_id"), "doc_id")


def first_url(spark: SparkSession, d: str) -> DataFrame:
    """The first page of each host."""
    return clean.first_url(table(spark, d, "pages").withColumn("host", F.regexp_extract("url", "^https?://([^/:]+)", 1)), "host", "url", "page_id")


def dup_questions(spark: SparkSession, d: str) -> DataFrame:
    return clean.repeated(table(spark, d, "documents").select("doc_id", "source", "lang", F.md5("text").alias("digest")), ["digest", "lang"])


def union_splits(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang")
    lang = F.coalesce(F.col("lang"), F.lit(""))
    return clean.union_splits({"train": docs.filter(lang == "en"), "test": docs.filter(lang == "fr"), "val": docs.filter(~lang.isin("en", "fr"))})


def valid_times(spark: SparkSession, d: str) -> DataFrame:
    """Events as time ranges: from their value to twice the rest of ten minutes."""
    e = table(spark, d, "events").select("event_id", F.col("value").alias("start"), (600 - F.col("value") * 5).alias("end"), F.lit(600.0).alias("length"))
    return clean.valid_times(e, "start", "end", "length").select("event_id", "start", F.round("end", 6).alias("end"))


def ground_truth(spark: SparkSession, d: str) -> DataFrame:
    """Questions found again among the same texts with spaces around them."""
    q = questions(spark, d)
    t = q.select(F.col("query_id").alias("sample_id"), F.concat(F.lit("  "), "text", F.lit(" ")).alias("question"), F.col("query_id").alias("video_id"), F.lit(0.0).alias("answer_start"), F.length("text").cast("double").alias("answer_end"))
    return clean.ground_truth(q.withColumnRenamed("text", "question"), t)


def char_offsets(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("video_id"), F.col("turn").alias("chunk_ix"), "text")
    return features.char_offsets(c).select("video_id", "chunk_ix", F.col("offset").cast("long").alias("offset"))


def incremental_skip(spark: SparkSession, d: str) -> DataFrame:
    """Documents that no label covers yet."""
    return features.missing(table(spark, d, "documents").select("doc_id", "source"), table(spark, d, "labels"), "doc_id")


def eda_value_counts(spark: SparkSession, d: str) -> DataFrame:
    return explore.value_counts(table(spark, d, "events"), "user_id", 20)


def eda_describe(spark: SparkSession, d: str) -> DataFrame:
    return explore.describe(table(spark, d, "lineitem"), NUMBERS)


def eda_histogram(spark: SparkSession, d: str) -> DataFrame:
    return explore.histogram(table(spark, d, "events"), "value")


def eda_corr_matrix(spark: SparkSession, d: str) -> DataFrame:
    return explore.correlations(table(spark, d, "lineitem"), NUMBERS)


def eda_features(spark: SparkSession, d: str) -> DataFrame:
    """Per conversation: the first turn's length, turns, distinct roles, mean words, and mean start and end by characters."""
    c = table(spark, d, "conversations")
    off = char_offsets(spark, d).select(F.col("video_id").alias("conv_id"), F.col("chunk_ix").alias("turn"), "offset")
    j = c.join(off, ["conv_id", "turn"]).withColumn("n", F.size(T.words(F.col("text")))).withColumn("end", F.col("offset") + F.length("text"))
    return j.groupBy("conv_id").agg(
        F.min_by(F.length("text"), "turn").cast("long").alias("first_length"), F.count("*").alias("n_turns"), F.countDistinct("role").alias("n_roles"), F.round(F.avg("n"), 6).alias("mean_words"),
        F.round(F.avg("offset"), 6).alias("mean_start"), F.round(F.avg("end"), 6).alias("mean_end"), F.round(F.avg(F.col("end") - F.col("offset")), 6).alias("mean_duration"),
    )


def eda_feature_corr(spark: SparkSession, d: str) -> DataFrame:
    return explore.correlations(eda_features(spark, d), ["first_length", "n_turns", "mean_words", "mean_start", "mean_end", "mean_duration"])


def frame_sampling(spark: SparkSession, d: str) -> DataFrame:
    """Frames of each event as a segment of as many seconds as its value."""
    t = lambda s: explore.frame_times(F.lit(0.0), F.col("value"), s)
    last = lambda s: F.round(F.element_at(t(s), -1), 6)
    return table(spark, d, "events").select("event_id", *(F.size(t(s)).cast("int").alias(f"n_{s}") for s in ("adaptive", "quality_based", "uniform")), last("adaptive").alias("last_time"), F.round(F.try_element_at(t("adaptive"), F.lit(2)), 6).alias("second_time"))


def sharpest_frames(spark: SparkSession, d: str) -> DataFrame:
    """Of each ten vectors as frames the three of largest first component."""
    f = table(spark, d, "embeddings").select(F.expr("vec_id div 10").alias("segment_id"), F.col("vec_id").alias("time"), F.col("embedding")[0].cast("double").alias("sharpness"))
    return explore.sharpest(f, 3).select("segment_id", "time", F.col("place").cast("int").alias("place"))


def format_times(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("value")
    end = v * 2
    return table(spark, d, "events").select("event_id", T.clock_range(v, end).alias("clock_range"), T.seconds_range(v, end).alias("seconds_range"), T.snippet(F.col("props"), 6).alias("snippet"))


def parse_clock(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("value")
    return table(spark, d, "events").select(
        "event_id", T.parse_clock(T.clock(v)).alias("minutes"), T.parse_clock(F.concat(F.lit("01:"), T.clock(v))).alias("hours"), T.parse_clock(v.cast("string")).alias("plain"), T.parse_clock(F.col("event_type")).alias("junk"),
    )


def file_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", T.file_name(F.col("url")).alias("file_name"))


def results_export(spark: SparkSession, d: str) -> DataFrame:
    """One JSON document per query of the multimodal search."""
    rows = segment_multimodal(spark, d).select("query_id", F.col("query_id").cast("string").alias("query"), "rank", "segment_id", "fusion_mode")
    return features.results_json(rows, "query", "segment")


def grid_configs(spark: SparkSession, d: str) -> DataFrame:
    return explore.grid(spark, explore.GRID)


def random_configs(spark: SparkSession, d: str) -> DataFrame:
    return explore.random_configs(explore.grid(spark, explore.GRID), 50).select("config", "window_size", "stride")


def preset_configs(spark: SparkSession, d: str) -> DataFrame:
    return explore.presets(spark)


def config_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Windows and coverage of each window size and stride over the documents."""
    lengths = documents(spark, d).select(F.size(T.words(F.col("text"))).alias("n"))
    return explore.window_metrics(lengths, explore.grid(spark, {k: explore.GRID[k] for k in ("window_size", "stride")}))


def best_config(spark: SparkSession, d: str) -> DataFrame:
    """The fewest windows of the configurations that cover 99 percent or more."""
    return explore.best_config(config_metrics(spark, d).filter("coverage_pct >= 99"), "n_windows", largest=False)


LENGTHS = "ln AS (SELECT len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS n FROM documents)"
_N = {k: len(v) for k, v in explore.GRID.items()}


def grid_sql(names: list[str]) -> str:
    """All combinations with their number, the last name fastest."""
    lit = lambda x: f"'{x}'" if isinstance(x, str) else f"{x}E0" if isinstance(x, float) else str(x)
    number, step = [], 1
    for n in reversed(names):
        number.append(f"({n}_i - 1) * {step}")
        step *= _N[n]
    each = ", ".join(f"(SELECT unnest([{', '.join(map(lit, explore.GRID[n]))}]) AS {n}, unnest(range(1, {_N[n] + 1})) AS {n}_i)" for n in names)
    return f"SELECT {', '.join(names)}, ({' + '.join(number)})::BIGINT AS config FROM {each}"


METRICS = f"""{LENGTHS}, cfg AS ({grid_sql(["window_size", "stride"])}),
 wn AS (SELECT config, window_size AS w, n, unnest(range(0, n, stride)) AS s FROM ln, cfg WHERE n > 0),
 we AS (SELECT *, least(s + w, n) AS e FROM wn WHERE least(s + w, n) - s >= w // 4),
 wc AS (SELECT config, stride, count(*) AS n_windows, sum(greatest(0, e - greatest(s, CASE WHEN s = 0 THEN 0 ELSE least(s - stride + w, n) END))) AS covered FROM we JOIN (SELECT config, stride FROM cfg) USING (config) GROUP BY ALL),
 cm AS (SELECT cfg.config, window_size, cfg.stride, coalesce(n_windows, 0) AS n_windows, round(100E0 * coalesce(covered, 0) / (SELECT sum(n) FROM ln), 6) AS coverage_pct FROM cfg LEFT JOIN wc USING (config))"""
FEATURES = """
 off AS (SELECT *, coalesce(sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS o FROM conversations),
 ft AS (SELECT conv_id, arg_min(length(text), turn)::BIGINT AS first_length, count(*) AS n_turns, count(DISTINCT role) AS n_roles, round(avg(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''))), 6) AS mean_words,
   round(avg(o), 6) AS mean_start, round(avg(o + length(text)), 6) AS mean_end, round(avg(length(text)), 6) AS mean_duration FROM off GROUP BY conv_id)"""
_STEP = "(value - 0) / ({n} - 1)"
_ADAPT = "greatest(2, least(trunc(value / 3)::INT, 8))"


def corr_sql(names: list[str], source: str) -> str:
    return " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}::DOUBLE, {b}::DOUBLE), 6) AS r FROM {source}" for i, a in enumerate(names) for b in names[i + 1 :])


def mmss(x: str) -> str:
    return f"printf('%02d:%02d', (floor({x})::INT // 60), (floor({x})::INT % 60))"


SQL = {
    "clean_antijoin": "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)",
    "both_modalities": "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) AND doc_id IN (SELECT vec_id FROM embeddings)",
    "first_url": "SELECT host, arg_min(url, page_id) AS url FROM (SELECT regexp_extract(url, '^https?://([^/:]+)', 1) AS host, url, page_id FROM pages) WHERE host <> '' AND url <> '' GROUP BY host",
    "dup_questions": "SELECT * FROM (SELECT doc_id, source, lang, md5(text) AS digest, count(*) OVER (PARTITION BY md5(text), lang) AS copies FROM documents) WHERE copies > 1",
    "union_splits": "SELECT doc_id, lang, CASE lang WHEN 'en' THEN 'train' WHEN 'fr' THEN 'test' ELSE 'val' END AS split FROM documents",
    "valid_times": "SELECT event_id, value AS start, round(600 - value * 5, 6) AS \"end\" FROM events WHERE value >= 0 AND 600 - value * 5 > value AND 600 - value * 5 <= 600",
    "ground_truth": "SELECT q.item_id AS query_id, t.item_id AS sample_id, t.item_id AS video_id, 0E0 AS answer_start, length(t.text)::DOUBLE AS answer_end FROM benchmark q JOIN (SELECT *, row_number() OVER (PARTITION BY lower(trim(text)) ORDER BY item_id) AS n FROM benchmark) t ON t.n = 1 AND lower(trim(t.text)) = lower(trim(q.text))",
    "char_offsets": "SELECT conv_id AS video_id, turn AS chunk_ix, coalesce(sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS \"offset\" FROM conversations",
    "incremental_skip": "SELECT doc_id, source FROM documents ANTI JOIN labels USING (doc_id)",
    "eda_value_counts": "SELECT user_id, count(*) AS n FROM events GROUP BY user_id ORDER BY n DESC, user_id LIMIT 20",
    "eda_describe": f"""SELECT name, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, min(value) AS least, round(quantile_cont(value, 0.25), 6) AS q1, round(quantile_cont(value, 0.5), 6) AS q2, round(quantile_cont(value, 0.75), 6) AS q3, max(value) AS most
 FROM (UNPIVOT (SELECT {", ".join(NUMBERS)} FROM lineitem) ON COLUMNS(*) INTO NAME name VALUE value) GROUP BY name""",
    "eda_histogram": "SELECT least(floor((value - lo) * 30 / (hi - lo)), 29)::INT AS bin, count(*) AS n FROM events, (SELECT min(value) AS lo, max(value) AS hi FROM events) GROUP BY bin",
    "eda_corr_matrix": corr_sql(NUMBERS, "lineitem"),
    "eda_features": f"WITH {FEATURES} SELECT * FROM ft",
    "eda_feature_corr": f"WITH {FEATURES} {corr_sql(['first_length', 'n_turns', 'mean_words', 'mean_start', 'mean_end', 'mean_duration'], 'ft')}",
    "frame_sampling": f"""SELECT event_id, CASE WHEN value <= 0 THEN 1 ELSE {_ADAPT} END AS n_adaptive, CASE WHEN value <= 0 THEN 1 ELSE 4 END AS n_quality_based, CASE WHEN value <= 0 THEN 1 ELSE 2 END AS n_uniform, round(greatest(value, 0), 6) AS last_time,
 CASE WHEN value > 0 THEN round({_STEP.format(n=_ADAPT)}, 6) END AS second_time FROM events""",
    "sharpest_frames": """SELECT segment_id, time, row_number() OVER (PARTITION BY segment_id ORDER BY time)::INT AS place FROM (SELECT vec_id // 10 AS segment_id, vec_id AS time, row_number() OVER (PARTITION BY vec_id // 10 ORDER BY embedding[1]::DOUBLE DESC, vec_id) AS n FROM embeddings) WHERE n <= 3""",
    "format_times": f"SELECT event_id, {mmss('value')} || '-' || {mmss('value * 2')} AS clock_range, printf('%.2fs - %.2fs', value, value * 2) AS seconds_range, CASE WHEN length(props) > 6 THEN left(props, 6) || '...' ELSE props END AS snippet FROM events",
    "parse_clock": "SELECT event_id, floor(value) AS minutes, 3600 + floor(value) AS hours, value AS plain, 0E0 AS junk FROM events",
    "file_names": "SELECT page_id, regexp_replace(url, '[^A-Za-z0-9]+', '_', 'g') AS file_name FROM pages",
    "grid_configs": grid_sql(list(explore.GRID)),
    "random_configs": f"SELECT config, window_size, stride FROM ({grid_sql(list(explore.GRID))}) ORDER BY md5('42:' || config), config LIMIT 50",
    "preset_configs": "SELECT * FROM (VALUES " + ", ".join(f"('{n}', {w}, {s}, {m}E0, '{dm}', {f}, '{st}', {q}, '{a}')" for n, w, s, m, dm, f, st, q, a in explore.PRESETS) + ") AS t(name, window_size, stride, min_coverage_contribution, deduplication_mode, frames_per_segment, sampling_strategy, quality_filter, aggregation_method)",
    "config_metrics": f"WITH {METRICS} SELECT * FROM cm",
    "best_config": f"WITH {METRICS} SELECT * FROM cm WHERE coverage_pct >= 99 ORDER BY n_windows, config LIMIT 1",
}

QUERIES = {f.__name__: f for f in (
    clean_antijoin, both_modalities, first_url, dup_questions, union_splits, valid_times, ground_truth, char_offsets, incremental_skip, eda_value_counts, eda_describe, eda_histogram, eda_corr_matrix, eda_features, eda_feature_corr,
    frame_sampling, sharpest_frames, format_times, parse_clock, file_names, results_export, grid_configs, random_configs, preset_configs, config_metrics, best_config,
)}
