"""Feature folders of JSON, Parquet indexes by modality and split, and incremental writing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

TS = "struct<start: double, end: double>"
QUESTIONS = "sample_id long, question string, answer_start string, answer_end string, answer_start_second int, answer_end_second int, video_length int, video_id string, video_url string"
TRANSCRIPTS = f"video_id string, chunk_ix int, text string, ts {TS}"
TEXTUAL = f"video_id string, segment_id string, window_id int, ts {TS}, text string, content_hash string, overlapping_timestamps array<{TS}>, entities array<struct<text: string, links: array<string>>>, embedding array<float>, window_info struct<start_token: int, end_token: int, window_size: int, total_tokens: int, coverage_contribution: int>"
VISUAL = f"video_id string, segment_id string, ts {TS}, frame_path string, num_frames_averaged int, sampling_strategy string, aggregation_method string, embedding array<float>"


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of question records."""
    return spark.read.schema(QUESTIONS).option("multiLine", True).json(path)


def read_features(spark: SparkSession, folder: str, schema: str | StructType = TEXTUAL, split: str | None = None) -> DataFrame:
    """All JSON files (an array or one object each) under a folder, or under its subfolder ``split``.

    Files that aren't JSON give no rows; ``source_file`` names each row's file. A missing folder raises.
    """
    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    bad = StructType([*schema.fields]).add("_corrupt", "string")
    raw = spark.read.schema(bad).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt")
    rows = raw.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(f"{folder}/{split}" if split else folder)
    # Spark refuses to read the column of bad files alone, as a count would, so the filter reads a second one.
    good = F.col("_corrupt").isNull() | (F.col(schema.fieldNames()[0]).isNotNull() & (F.length("_corrupt") < 0))
    return rows.withColumn("source_file", F.col("_metadata.file_path")).filter(good).drop("_corrupt")


def of_videos(features: DataFrame, videos: DataFrame) -> DataFrame:
    """The features of the given videos."""
    return features.join(videos.select("video_id").distinct(), "video_id", "left_semi")


def write_features(features: DataFrame, folder: str, form: str = "json") -> None:
    """Append features to a folder by split; ``form`` is json or parquet."""
    features.write.mode("append").partitionBy("split").format(form).save(folder)


def write_index(features: DataFrame, folder: str, modality: str, split: str) -> bool:
    """Write the features that have a vector as an index table, one partition per modality and split, replacing only it.

    Vectors are normalised; those of length 0 or null are left out. False if nothing was left to write.
    """
    e = F.col("embedding").cast("array<double>")
    norm = F.sqrt(F.aggregate(e, F.lit(0.0), lambda s, x: s + x * x))
    rows = features.withColumn("__n", norm).filter("__n > 0").withColumn("embedding", F.transform("embedding", lambda x: (x / F.col("__n")).cast("float"))).drop("__n")
    if rows.isEmpty():
        return False
    rows.write.mode("overwrite").parquet(f"{folder}/modality={modality}/split={split}")
    return True


def read_index(spark: SparkSession, folder: str, modality: str | None = None, split: str | None = None) -> DataFrame:
    """Index tables of a modality and split, or of all; only their partitions are listed and read."""
    rows = spark.read.option("mergeSchema", True).parquet(folder)
    for name, value in (("modality", modality), ("split", split)):
        if value is not None:
            rows = rows.filter(F.col(name) == value)
    return rows


def filter_visual(pool: DataFrame, sampling: str | None = None, aggregation: str | None = None) -> DataFrame:
    """Visual features of one sampling strategy and aggregation method."""
    for name, value in (("sampling_strategy", sampling), ("aggregation_method", aggregation)):
        if value is not None:
            pool = pool.filter(F.col(name) == value)
    return pool


def missing(todo: DataFrame, done: DataFrame | None, key: str = "video_id") -> DataFrame:
    """The rows of ``todo`` whose key isn't in ``done`` yet: what an incremental run has to compute."""
    return todo if done is None else todo.join(done.select(key).distinct(), key, "left_anti")


def char_offsets(chunks: DataFrame) -> DataFrame:
    """Where each transcript chunk starts in its video's text, chunks joined by one character."""
    w = Window.partitionBy("video_id").orderBy("chunk_ix").rowsBetween(Window.unboundedPreceding, -1)
    return chunks.withColumn("offset", F.coalesce(F.sum(F.length("text") + 1).over(w), F.lit(0)))


def results_json(rows: DataFrame, query: str, mode: str) -> DataFrame:
    """One JSON document per query: its text, the number of results and the results in order of rank."""
    items = F.sort_array(F.collect_list(F.struct("rank", *(c for c in rows.columns if c not in ("rank", "query_id", query)))))
    g = rows.groupBy("query_id", query).agg(items.alias("results"))
    return g.select("query_id", F.to_json(F.struct(F.col(query).alias("query"), F.size("results").alias(f"total_{mode}s"), F.lit(mode).alias("aggregation_mode"), "results")).alias("json"))
