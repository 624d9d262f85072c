"""Documents that hold given passages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipquery.operators.common import small

#: Words of a run, and runs of passages that are looked up in each document's row.
RUN, RUNS = 4, 2_000


def containing(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """``query_id, doc_id`` where the document's text contains the passage, distinct.

    ``docs`` is (doc_id, text), ``passages`` (query_id, passage). The second to fifth word of a passage stand whole in
    any text that contains it, so passages meet the documents that have this run of words, and only those pairs are
    compared in full. Runs are told apart in the document's row while passages' runs are few, else by a join of numbers
    alone: the text is never repeated for each run. Passages of under six words have no such run and are compared with
    every document.
    """
    words = lambda c: F.filter(F.split(c, r"\s+"), lambda w: w != "")
    p = passages.withColumn("w", words(F.col("passage")))
    long = p.filter(F.size("w") >= RUN + 2).select("query_id", "passage", F.xxhash64(F.array_join(F.slice("w", 2, RUN), " ")).alias("run"), F.get("w", F.lit(1)).alias("begin"))
    run = lambda i: F.xxhash64(F.array_join(F.slice(F.col("w"), i, RUN), " "))
    d = docs.withColumn("w", words(F.col("text")))
    asked = long.select("run", "begin").limit(RUNS + 1).collect()
    if len(asked) <= RUNS:
        begins, held = sorted({r.begin for r in asked}), sorted({r.run for r in asked})
        runs = F.filter(F.transform("w", lambda x, i: F.when(x.isin(begins), run(i + 1))), lambda r: r.isin(held))
        met = d.select("doc_id", "text", F.explode(F.array_distinct(runs)).alias("run")).join(F.broadcast(long), "run")
    else:
        runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - RUN + 1, F.lit(1))), run)
        pairs = d.select("doc_id", F.explode(F.array_distinct(runs)).alias("run")).join(small(long), "run")
        met = docs.select("doc_id", "text").join(pairs, "doc_id")
    found = met.filter(F.contains("text", "passage")).select("query_id", "doc_id")
    short = passages.withColumn("w", words(F.col("passage"))).filter(F.size("w") < RUN + 2).select("query_id", "passage")
    if not short.isEmpty():
        found = found.unionByName(docs.join(small(short), F.contains("text", "passage")).select("query_id", "doc_id"))
    return found.distinct()
