"""Exact top-k search by exhaustive term-at-a-time accumulation, in tiles of query and candidate blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clipquery.llm.common import materialize

_LONG = 2**63 - 1


def accumulate(query: np.ndarray, postings: np.ndarray, scores: np.ndarray, work: np.ndarray) -> None:
    """Scores of one sparse query row against a block: each non-zero term scatters its weighted postings."""
    scores.fill(0)
    for term in np.flatnonzero(query):
        np.multiply(postings[term], query[term], out=work)
        np.add(scores, work, out=scores)


def best_of_block(queries: np.ndarray, own: np.ndarray, postings: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query number, place, score) of each query's k best places in a block, ties to smaller places.

    ``queries`` is queries x terms and ``postings`` terms x places, whole numbers as floats. ``own`` is each query's
    own place, or -1. Sums that fit 31 bits are held in 32-bit integers, others that fit 53 bits with the place in
    64-bit ones, and any larger ones in Python integers, so scores and their order are exact at every size.
    """
    terms = max(queries.shape[1], postings.shape[0])
    queries = np.pad(queries, ((0, 0), (0, terms - queries.shape[1])))
    postings = np.pad(postings, ((0, terms - postings.shape[0]), (0, 0)))
    n = postings.shape[1]
    bound = float(np.abs(queries).max(initial=0)) * float(np.abs(postings).max(initial=0)) * terms
    exact = bound * n < 2**61
    kind = np.int32 if bound < 2**31 - 1 else np.int64 if exact else object
    whole = np.frompyfunc(int, 1, 1) if kind is object else lambda x: x.astype(kind)
    queries, postings = whole(queries), whole(postings)
    scores, work = np.zeros(n, dtype=kind), np.zeros(n, dtype=kind)
    back = np.arange(n - 1, -1, -1, dtype=np.int64)
    rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for i in range(len(queries)):
        accumulate(queries[i], postings, scores, work)
        key = scores.astype(np.int64) * n + back if exact else np.array([min(max(s, -_LONG - 1), _LONG) * n + int(b) for s, b in zip(scores, back)], dtype=object)
        take = min(k + 1, n)
        if take < n and exact:
            place = np.argpartition(key, n - take)[n - take :]
        else:
            place = np.arange(n)
        place = place[np.argsort(key[place])[::-1]]
        place = place[place != own[i]][:k]
        rows.append((np.full(len(place), i), place, np.clip(scores[place], -_LONG - 1, _LONG).astype(np.int64)))
    return tuple(np.concatenate(x) if rows else np.zeros(0, dtype=np.int64) for x in zip(*rows)) if rows else (np.zeros(0, dtype=np.int64),) * 3


def top_k(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, scale: float = 64.0, query_block: int = 4096, block: int = 8192) -> DataFrame:
    """Each query row's k highest integer inner products over every other row, by exhaustive search.

    Components become floor(scale * x). Rows are dealt to blocks by a hash; each block is packed into one row of
    postings (terms x places), and each tile (query block, candidate block) accumulates scores and keeps k places
    per query, so a task holds one tile whatever the size of the table. The partial lists are merged by rank.

    Returns ``query_id, rank, vec_id, score``, ties to the smaller ``vec_id``. Vectors that are null or hold null or
    non-finite components take no part; shorter vectors count as 0 in missing terms, empty ones score 0. With
    repeated ids each row is a vector of its own: a query row is kept from itself, not from others with its id.
    Scores beyond 64 bits count as the nearest 64-bit number. Null ids are ordinary, first
    in ties. Other columns are ignored; an empty table gives an empty result.
    """
    v = vectors.select(F.col(id_col).cast("long").alias("id"), is_query.alias("asks"), F.col(vector_col).cast("array<double>").alias("x"))
    odd = F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    v = v.filter(F.col("x").isNotNull() & ~odd).withColumn("copy", F.row_number().over(Window.partitionBy("id").orderBy("x")))
    v = materialize(v, "topk-vectors")
    n, asked = v.agg(F.count("*"), F.count(F.when(F.col("asks"), 1))).first()
    nb, nq = max(1, -(-n // block)), max(1, -(-asked // query_block))

    def packed(rows: DataFrame, blocks: int, name: str) -> DataFrame:
        def run(t: pa.Table) -> pa.Table:
            t = t.sort_by([("id", "ascending"), ("copy", "ascending")])
            lists = t.column("x").combine_chunks()
            size = np.asarray(lists.value_lengths())
            terms = int(size.max(initial=0))
            x = np.zeros((len(size), terms))
            x[np.arange(terms) < size[:, None]] = np.floor(scale * np.asarray(lists.flatten()))
            ids = t.column("id").combine_chunks()
            return pa.table({
                name: t.column("block")[:1], f"{name}_rows": pa.array([len(size)], pa.int64()), f"{name}_x": pa.array([x.T.tobytes()], pa.binary()), f"{name}_copy": pa.array([t.column("copy").to_numpy().astype(np.int64).tobytes()], pa.binary()),
                f"{name}_id": pa.array([ids.fill_null(0).to_numpy().astype(np.int64).tobytes()], pa.binary()), f"{name}_null": pa.array([np.asarray(ids.is_null()).tobytes()], pa.binary()),
            })

        dealt = rows.withColumn("block", F.pmod(F.xxhash64("id", "copy"), F.lit(blocks)).cast("int"))
        return dealt.groupBy("block").applyInArrow(run, f"{name} int, {name}_rows long, {name}_x binary, {name}_copy binary, {name}_id binary, {name}_null binary")

    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.to_pylist():
                side = {}
                for s in ("q", "c"):
                    rows = t[f"{s}_rows"]
                    side[s] = (np.frombuffer(t[f"{s}_x"]).reshape(-1, rows), *(np.frombuffer(t[f"{s}_{f}"], dtype=d) for f, d in (("id", np.int64), ("copy", np.int64), ("null", np.bool_))))
                (qx, qi, qc, qn), (cx, ci, cc, cn) = side["q"], side["c"]
                at = {key: i for i, key in enumerate(zip(ci.tolist(), cc.tolist(), cn.tolist()))}
                own = np.array([at.get(key, -1) for key in zip(qi.tolist(), qc.tolist(), qn.tolist())], dtype=np.int64)
                i, place, score = best_of_block(qx.T, own, cx, k)
                yield pa.RecordBatch.from_arrays([pa.array(qi[i], mask=qn[i]), pa.array(qc[i]), pa.array(ci[place], mask=cn[place]), pa.array(cc[place]), pa.array(score)], ["query_id", "query_copy", "vec_id", "copy", "score"])

    every = packed(v.drop("asks"), nb, "c").withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(nq - 1))))
    asks = packed(v.filter("asks").drop("asks"), nq, "q").withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(nb - 1))))
    part = every.join(asks, ["q", "c"]).mapInArrow(tiles, "query_id long, query_copy long, vec_id long, copy long, score long")
    w = Window.partitionBy("query_id", "query_copy").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_first(), "copy")
    return part.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
