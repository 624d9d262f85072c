"""Sinks for results, answers, evaluations and reports; downloads and what failed; runs that go on where they stopped."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipquery.sources.features import missing


def download(urls: DataFrame, fetch: Callable[[str, str], bool], done: DataFrame | None = None) -> DataFrame:
    """``video_id, ok``: ``fetch`` is called for each video once, but for those that ``done`` says are there already.

    ``urls`` is (video_id, video_url). A call that raises counts as failed.
    """
    todo = missing(urls.filter("video_url is not null").groupBy("video_id").agg(F.min("video_url").alias("video_url")), done)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ok = []
            for video, url in zip(b["video_id"], b["video_url"]):
                try:
                    ok.append(bool(fetch(video, url)))
                except Exception:  # the network is a boundary
                    ok.append(False)
            yield pd.DataFrame({"video_id": b["video_id"], "ok": ok})

    kind = dict(urls.dtypes)["video_id"]
    got = todo.mapInPandas(run, f"video_id {kind}, ok boolean")
    return got if done is None else got.unionByName(done.select("video_id").distinct().withColumn("ok", F.lit(True)))


def failed(status: DataFrame) -> DataFrame:
    """The failure list: ids of videos without any successful download."""
    return status.groupBy("video_id").agg(F.max("ok").alias("ok")).filter("not coalesce(ok, false)").select("video_id")


def write_splits(frames: dict[str, DataFrame], folder: str, keep: Callable[[DataFrame], DataFrame]) -> None:
    """Write the rows of each split that ``keep`` leaves as JSON, one partition per split."""
    for split, df in frames.items():
        keep(df).write.mode("overwrite").json(f"{folder}/split={split}")


def answer_json(answers: DataFrame, hits: DataFrame) -> DataFrame:
    """``query_id, json``: a query, its search results by rank and its answer in one JSON document.

    ``answers`` is (query_id, query, ..), ``hits`` (query_id, rank, ..). Queries without hits have an empty list.
    """
    listed = hits.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", *(c for c in hits.columns if c not in ("rank", "query_id"))))).alias("search_results"))
    said = F.struct(*(c for c in answers.columns if c not in ("query_id", "query")))
    j = answers.join(listed, "query_id", "left")
    found = F.coalesce("search_results", F.array().cast(dict(listed.dtypes)["search_results"]))
    return j.select("query_id", F.to_json(F.struct("query", found.alias("search_results"), said.alias("generated_answer"))).alias("json"))


def write_json(rows: DataFrame, path: str) -> None:
    """Write the ``json`` column as lines of text."""
    rows.select(F.col("json").alias("value")).write.mode("overwrite").text(path)


def report(summary: DataFrame, title: str, n: int, bare: bool = True) -> DataFrame:
    """One row ``report``: a Markdown table of a summary (metric, mean, std, median, min, max, count).

    Numbers are rounded by their exact values, as Python and C print them (0.4875 is less than its digits say), which
    ``format_string`` doesn't: it rounds the digits half up. Without metrics the head stands alone, or the report is
    null if not ``bare``.
    """
    number = F.udf(lambda x: "null" if x is None else f"{x:.3f}", "string")
    line = F.concat(F.lit("| "), "metric", *(x for c in ("mean", "std", "median", "min", "max") for x in (F.lit(" | "), number(c))), F.lit(" | "), F.col("count").cast("string"), F.lit(" |"))
    head = f"# {title}\n\nQueries: {n}\n\n| metric | mean | std | median | min | max | count |\n|-|-|-|-|-|-|-|\n"
    text = F.concat(F.lit(head), F.array_join("l", "\n"), F.lit("\n"))
    return summary.select(line.alias("line")).agg(F.sort_array(F.collect_list("line")).alias("l")).select((text if bare else F.when(F.size("l") > 0, text)).alias("report"))


def save_evaluation(results: DataFrame, summary: DataFrame, folder: str, title: str) -> None:
    """Write an evaluation: its rows, its summary (both JSON) and its report (Markdown)."""
    results.write.mode("overwrite").json(f"{folder}/results")
    summary.write.mode("overwrite").json(f"{folder}/summary")
    report(summary, title, results.count()).coalesce(1).write.mode("overwrite").text(f"{folder}/report")


def resume(todo: DataFrame, folder: str, run: Callable[[DataFrame], DataFrame], key: str = "query_id", batches: int = 1) -> DataFrame:
    """Run what ``folder`` has no results of yet, in batches that are appended as they end, and return all results.

    Batches are dealt by a hash of the key, so a run that stops loses at most the batch that it was in.
    """
    spark = todo.sparkSession
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for k in range(batches):
        done = spark.read.parquet(folder).select(key) if fs.exists(place) else None
        part = missing(todo.filter(F.pmod(F.xxhash64(key), F.lit(batches)) == k), done, key)
        if not part.isEmpty():
            run(part).write.mode("append").parquet(folder)
    return spark.read.parquet(folder)
