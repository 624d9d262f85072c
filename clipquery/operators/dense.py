"""Exact vector search, pooling and greedy removal of near copies."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipquery.functions.vector import normalized
from clipquery.operators.common import top
from clipquery.operators.nearest import closest, matrix

#: Queries that make one matrix, and numbers of queries' vectors that are held by the driver and each task (64 MB).
MATRIX_ROWS, HELD = 2_000, 8_000_000
#: Rows of the corpus that meet a block of queries at once, where queries aren't held.
BLOCK_ROWS = 20_000


def normalized_vectors(vectors: DataFrame, vector_col: str = "embedding") -> DataFrame:
    """Vectors as doubles of length 1; rows of length 0 are left out."""
    return vectors.withColumn(vector_col, normalized(F.col(vector_col).cast("array<double>"))).filter(F.col(vector_col).isNotNull())


def knn(queries: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    """``query_id, row_id, distance, rank``: each query's ``k`` nearest rows by squared distance, ties to smaller ids.

    ``queries`` is (query_id, qv), ``corpus`` (row_id, v). All pairs are compared, as products of matrices of at most
    MATRIX_ROWS queries; a task keeps ``k`` rows per query of what it reads. Queries of up to HELD numbers are held by
    each task, which then reads its part of the corpus once; else both sides are packed into blocks and every two blocks
    meet in some task, so that memory stays bounded.
    """
    q = queries.select("query_id", "qv")
    one = q.select(F.size("qv")).first()
    kinds = f"query_id {dict(queries.dtypes)['query_id']}, row_id {dict(corpus.dtypes)['row_id']}, distance double"
    if one is None or q.limit(HELD // max(one[0], 1) + 1).count() * max(one[0], 1) <= HELD:
        t = q.toArrow()
        ids, v = t.column("query_id").combine_chunks(), matrix(t.column("qv").combine_chunks())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from closest(ids, v, ((b.column(0), matrix(b.column(1))) for b in batches), k, MATRIX_ROWS)

        part = corpus.select("row_id", "v").mapInArrow(run, kinds)
    else:

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i in range(len(b)):
                    query_id, qv, row_id, v = (b.column(c)[i].values for c in range(4))
                    yield from closest(query_id, matrix(qv), [(row_id, matrix(v))], k, MATRIX_ROWS)

        part = packed(q, MATRIX_ROWS).hint("shuffle_replicate_nl").crossJoin(packed(corpus.select("row_id", "v"), BLOCK_ROWS)).mapInArrow(meet, kinds)
    return top(part, ["query_id"], [F.col("distance"), F.col("row_id")], k)


def packed(rows: DataFrame, n: int) -> DataFrame:
    """Rows of up to ``n`` rows each, as arrays of their columns."""

    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, len(b), n):
                part = b.slice(at, n)
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), c) for c in part.columns], names)

    return rows.mapInArrow(run, ", ".join(f"{c} array<{t}>" for c, t in rows.dtypes))


def pooled(vectors: DataFrame, by: str, vector_col: str = "embedding", method: str = "mean") -> DataFrame:
    """``by, pos, value``: the mean (or largest) component of each group's vectors, position by position."""
    f = F.max if method == "max" else F.avg
    parts = vectors.select(by, F.posexplode(F.col(vector_col).cast("array<double>")).alias("pos", "x"))
    return parts.groupBy(by, "pos").agg(F.round(f("x"), 6).alias("value"))


def drop_near_vectors(vectors: DataFrame, by: str, order: str, threshold: float, vector_col: str = "embedding", entities_col: str | None = None) -> DataFrame:
    """Rows of each group that greedy removal keeps, in ``order``: a row that is closer in cosine than ``threshold`` to
    a kept earlier row goes. A group is one video's segments, so it fits a task.

    With ``entities_col`` (numbers of entities) of two such rows the one with fewer goes, the later one if they are
    equal; a row that went while its turn lasts is still held against the rest.
    """

    def keep(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        v = np.stack(pdf["v"].to_numpy()) if len(pdf) else np.zeros((0, 1))
        v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
        kept: list[int] = []
        if entities_col:
            n, gone = pdf["n"].to_numpy(), np.zeros(len(v), dtype=bool)
            for i in range(len(v)):
                if not gone[i]:
                    near = np.flatnonzero((v @ v[i] > threshold) & ~gone & (np.arange(len(v)) > i))
                    gone[near[n[near] <= n[i]]] = True
                    gone[i] = bool((n[near] > n[i]).any())
            return pdf.iloc[np.flatnonzero(~gone)][[by, order]]
        for i in range(len(v)):
            if not kept or (v[kept] @ v[i]).max() <= threshold:
                kept.append(i)
        return pdf.iloc[kept][[by, order]]

    kinds = dict(vectors.dtypes)
    n = F.coalesce(F.col(entities_col), F.lit(0)) if entities_col else F.lit(0)
    rows = vectors.select(by, order, F.col(vector_col).cast("array<double>").alias("v"), n.alias("n"))
    return rows.groupBy(by).applyInPandas(keep, f"{by} {kinds[by]}, {order} {kinds[order]}")


def batched_similarity(corpus: DataFrame, queries: np.ndarray, ids: np.ndarray, k: int) -> DataFrame:
    """Like :func:`knn` for a bounded matrix of queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from closest(pa.array(ids, pa.int64()), queries, ((b.column(0).cast(pa.int64()), matrix(b.column(1))) for b in batches), k, MATRIX_ROWS)

    part = corpus.select("row_id", "v").mapInArrow(run, "query_id long, row_id long, distance double")
    return top(part, ["query_id"], [F.col("distance"), F.col("row_id")], k)
