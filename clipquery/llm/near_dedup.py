"""Near-duplicate components by SetSketch registers: band, estimate jointly by likelihood, verify on full sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clipquery.llm.bytes_view import U64, mixed, powers, text_bytes
from clipquery.llm.common import discard, materialize, unused
from clipquery.llm.components import components

#: Registers are floor(1 - log_BASE(least hash)); near 1, so unrelated sets rarely share one.
BASE = 1.05
#: ROWS registers make a band. At similarity 0.8 registers agree with probability 0.804 or more, so a pair shares no
#: band with probability (1 - 0.804**5)**48 = 3e-9 at most.
BANDS, ROWS = 48, 5
REGISTERS = BANDS * ROWS
#: Pairs whose likeliest similarity is this far below the threshold, 7 standard errors or more, skip verification.
SLACK = 0.18
#: Elements that are hashed at once.
STEP = 1 << 16
_LOWER = np.array([c + 32 if 65 <= c <= 90 else 32 if 9 <= c <= 13 else c for c in range(256)], dtype=np.uint8)
_M = 0x9E3779B97F4A7C15 | 1
_SEEDS = np.random.default_rng(20240607).integers(1 << 31, 1 << 32, REGISTERS, dtype=np.uint32) | np.uint32(1)


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a column's texts, and n + 1 offsets: text i has words ``of[i]`` to ``of[i + 1]``.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, hashed at once from running sums of a polynomial.
    """
    data, at = text_bytes(column)
    if not len(data):
        return np.zeros(0, dtype=U64), np.zeros(len(at), dtype=np.int64)
    data = _LOWER[data]
    solid = data != 32
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    inner = at[:-1][(at[:-1] < len(data))]
    first[inner] = solid[inner]  # a text's start starts a word
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    ends = at[1:][at[1:] > 0] - 1
    last[ends] = solid[ends]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    # Sums of byte * M**position; dividing by M**start makes them independent of the position.
    power = powers(_M, len(data))
    total = np.zeros(len(data) + 1, dtype=U64)
    np.cumsum((data.astype(U64) + U64(1)) * power, out=total[1:])
    inverse = powers(pow(_M, -1, 1 << 64), len(data))[start]
    word = mixed((total[end] - total[start]) * inverse + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93))
    return word, np.searchsorted(start, at)


def run_hashes(word: np.ndarray, words: int) -> np.ndarray:
    """Hashes of all runs of so many words, whether or not a text ends within."""
    spread = powers(0xC2B2AE3D27D4EB4F, words + 1)
    h = np.zeros(max(0, len(word) - words + 1), dtype=U64)
    for k in range(words):
        h += word[k : k + len(h)] * spread[k]
    return mixed(h)


def shingle_hashes(column: pa.Array, words: int) -> list[np.ndarray]:
    """Each text's set of word shingles as sorted distinct 64-bit hashes.

    A text of fewer words has its whole sequence as its one shingle; one without words has none.
    """
    word, of = word_hashes(column)
    spread = powers(0xC2B2AE3D27D4EB4F, words + 1)
    h = run_hashes(word, words)
    out = []
    for a, b in zip(of[:-1].tolist(), of[1:].tolist()):
        if b - a >= words:
            s = np.sort(h[a : b - words + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif b > a:
            out.append(mixed((word[a:b] * spread[: b - a]).sum(keepdims=True) + U64(b - a)))
        else:
            out.append(np.zeros(0, dtype=U64))
    return out


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """SetSketch registers of non-empty sets, one row each: the exponent, to BASE, of the least of each hash.

    Elements are hashes already, so each register's hash is one multiplication of their upper half. Least uniform
    values are turned into exponential ones, then truncated to whole exponents, so registers of a union are the
    maxima of registers.
    """
    size = np.array([len(s) for s in sets])
    least = np.full((REGISTERS, len(sets)), 0xFFFFFFFF, dtype=np.uint32)
    at = 0
    while at < len(sets):  # whole sets, or one large set, up to STEP elements at once
        to = at + 1
        n = size[at]
        while to < len(sets) and n + size[to] <= STEP:
            n += size[to]
            to += 1
        every = (np.concatenate(sets[at:to]) >> U64(32)).astype(np.uint32)
        for lo in range(0, len(every), STEP):
            x = every[lo : lo + STEP]
            cuts = np.concatenate(([0], np.cumsum(size[at : to - 1]))) if to > at + 1 else np.zeros(1, dtype=np.int64)
            work = np.empty_like(x)
            for i in range(REGISTERS):
                np.multiply(x, _SEEDS[i], out=work)
                np.minimum(least[i, at:to], np.minimum.reduceat(work, cuts), out=least[i, at:to])
        at = to
    uniform = (least.astype(np.float64) + 0.5) / 2.0**32
    return np.floor(1 - np.log(-np.log1p(-uniform)) / np.log(BASE)).astype(np.int16).T


def likeliest(ku: np.ndarray, kv: np.ndarray, nu: np.ndarray, nv: np.ndarray) -> np.ndarray:
    """The likeliest Jaccard similarity of pairs of register rows and set sizes.

    With shares u and v of the sizes, a register of one exceeds the other's with probability p(u - vJ) or p(v - uJ),
    p(x) = -log_BASE(1 - x (BASE - 1) / BASE). The log-likelihood of the three counts is concave in J, so a ternary
    search over 0 .. min(u/v, v/u) finds its maximum for all pairs at once.
    """
    up, down = (ku > kv).sum(1), (ku < kv).sum(1)
    same = ku.shape[1] - up - down
    u, v = nu / (nu + nv), nv / (nu + nv)
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    def likelihood(j: np.ndarray) -> np.ndarray:
        a, b = p(u - v * j), p(v - u * j)
        tiny = 1e-300
        return up * np.log(a + tiny) + down * np.log(b + tiny) + same * np.log(np.maximum(1 - a - b, tiny))

    lo, hi = np.zeros(len(up)), np.minimum(u / v, v / u)
    for _ in range(40):
        third = (hi - lo) / 3
        left = likelihood(lo + third) < likelihood(hi - third)
        lo, hi = np.where(left, lo + third, lo), np.where(left, hi, hi - third)
    return (lo + hi) / 2


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, percent: int = 80) -> DataFrame:
    """Near-duplicate components, one row per document: ``id_col, n_shingles, component_id, kept``.

    The component's id is the smallest id that links reach, the row's own if it has no shingles; ``kept`` is whether
    it is that row. The rest is said at :func:`linked`. Other columns are ignored; an empty table gives an empty
    result.
    """
    out = linked(docs, id_col, text_col, words, percent)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


def linked(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int) -> DataFrame:
    """Components of documents whose word-shingle sets have a Jaccard similarity of ``percent`` / 100 or more.

    1. Sketch: one pass over the texts gives each row its set's size, 128-bit signature and registers. Rows of one
       signature are one vertex, so copies in any number are never paired.
    2. Band: vertices that share a band meet in a bucket. A bucket's least vertex is its pivot; members are paired
       with it, so a bucket of n gives n - 1 pairs, and near copies mostly choose the same pivot in all bands.
    3. Estimate and verify: sizes, then the likeliest similarity, rule out pairs; the rest are verified on full sets.
    4. Components of the links. A bucket that still holds several components may hide a link between members that
       aren't its pivot. Buckets of that kind that share members form a cluster, and within clusters all pairs across
       components are tested, in tiles of bounded size (:func:`crossing`). So no link within a bucket is lost, and
       nothing is capped, while members of one component are never paired again.

    Returns ``id, key, n, label, component_id``: the text's digest, the size of its set, a number of the component
    (null without shingles) and the smallest id in it (the row's own without shingles). Null ids are ignored in
    minima; null and empty texts have no shingles and no links. Repeated rows belong to one component.
    """
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    keyed = rows.select("id", F.unhex(F.md5("text")).alias("key"), "text")

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                b = whole.slice(lo, 512)
                sets = shingle_hashes(b.column(2), words)
                full = [s for s in sets if len(s)]
                regs = iter(registers(full)) if full else iter(())
                sign = [None if not len(s) else np.array([s.sum(), mixed(s ^ U64(_M)).sum()], dtype=U64).tobytes() for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(sign, pa.binary()), pa.array([next(regs).tobytes() if len(s) else None for s in sets], pa.binary())],
                    ["id", "key", "n", "sign", "regs"],
                )

    sketched = materialize(keyed.mapInArrow(sketch, f"id {kind}, key binary, n long, sign binary, regs binary"), "near-sketches")
    vertices = sketched.filter("n > 0").groupBy("sign", "n").agg(F.min(F.struct("id", "key")).alias("row"), F.min("id").alias("least"), F.first("regs").alias("regs"))
    vertices = materialize(vertices.select(F.monotonically_increasing_id().alias("v"), "sign", "n", "row.id", "row.key", "least", "regs"), "near-vertices")

    def bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spread = powers(0x9FB21C651E98DF25, ROWS + 1)
        for b in batches:
            if not b.num_rows:
                continue
            k = np.frombuffer(b"".join(b.column(2).to_pylist()), dtype=np.int16).reshape(-1, BANDS, ROWS).astype(np.int64).astype(U64)
            h = np.arange(1, BANDS + 1, dtype=U64) * U64(_M)
            for i in range(ROWS):
                h = mixed(h + k[:, :, i] * spread[i] + U64(i))
            yield pa.RecordBatch.from_arrays([pa.array(h.reshape(-1).astype(np.int64)), pa.array(np.repeat(b.column(0).to_numpy(), BANDS)), pa.array(np.repeat(b.column(1).to_numpy(), BANDS))], ["bucket", "v", "n"])

    members = vertices.select("v", "n", "regs").mapInArrow(bands, "bucket long, v long, n long")
    buckets = materialize(members.groupBy("bucket").agg(F.min(F.struct("v", "n")).alias("pivot"), F.count("*").alias("rows")).filter("rows > 1"), "near-buckets")
    shared = buckets.select("bucket", F.col("pivot.v").alias("p"), F.col("pivot.n").alias("pn"))
    members = materialize(members.join(shared, "bucket"), "near-members")

    def fits(pairs: DataFrame) -> DataFrame:
        return pairs.filter(100 * F.least("an", "bn") >= percent * F.greatest("an", "bn")).select("a", "b").distinct()

    pairs = materialize(fits(members.filter("v <> p").select(F.col("p").alias("a"), F.col("v").alias("b"), F.col("pn").alias("an"), F.col("n").alias("bn"))), "near-pairs")
    in_buckets = members.select(F.col("v").alias("need")).distinct()
    sets = materialize(vertex_sets(keyed, vertices.join(in_buckets, F.col("v") == F.col("need"), "left_semi"), words), "near-sets")
    links = materialize(verified(pairs, sets, percent), "near-links")
    first = materialize(components(links), "near-labels")
    more = materialize(crossing(members, first, sets, percent), "near-crossing")
    labels = first if more.isEmpty() else materialize(components(stars(first).unionAll(more)), "near-labels")
    named = vertices.select("v", "sign", "least").join(labels, "v", "left").withColumn("label", F.coalesce("label", "v"))
    least = named.groupBy("label").agg(F.min("least").alias("component_id"))
    named = materialize(named.join(least, "label").select("sign", "label", "component_id"), "near-components")
    discard(vertices, buckets, members, pairs, sets, links, more, first, *[labels] * (labels is not first))
    # A sign stands for one vertex; the sketches' side may hold a hot one, which adaptive joins split.
    out = sketched.select("id", "key", "n", "sign").join(named, "sign", "left")
    return out.select("id", "key", "n", "label", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))


def stars(labels: DataFrame) -> DataFrame:
    """Components as links ``a, b`` of their vertices with the least one: what later links are added to."""
    return labels.select(F.col("v").alias("a"), F.col("label").alias("b"))


def vertex_sets(keyed: DataFrame, vertices: DataFrame, words: int) -> DataFrame:
    """``v, n, regs, hashes`` of vertices: their sets, from the text of one row each."""
    want = vertices.select("v", "n", "regs", F.col("id").alias("__id"), F.col("key").alias("__key"))
    found = keyed.join(want, (F.col("key") == F.col("__key")) & F.col("id").eqNullSafe(F.col("__id"))).select("v", "n", "regs", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                b = whole.slice(lo, 512)
                yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([s.tobytes() for s in shingle_hashes(b.column(3), words)], pa.binary())], ["v", "n", "regs", "hashes"])

    return found.mapInArrow(run, "v long, n long, regs binary, hashes binary").dropDuplicates(["v"])


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` that are links: likely by their registers, and certain by their full sets."""
    side = lambda s: sets.select(*(F.col(c).alias(s + x) for c, x in (("v", ""), ("n", "n"), ("regs", "r"), ("hashes", "h"))))
    both = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "an", "bn", "ar", "br", "ah", "bh")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 1024):
                b = whole.slice(lo, 1024)
                an, bn = b.column(2).to_numpy(), b.column(3).to_numpy()
                ar, br = (np.frombuffer(b"".join(b.column(i).to_pylist()), dtype=np.int16).reshape(-1, REGISTERS) for i in (4, 5))
                ok = likeliest(ar, br, an, bn) >= percent / 100 - SLACK
                for i in np.flatnonzero(ok):
                    ok[i] = similar(b.column(6)[int(i)], b.column(7)[int(i)], percent)
                yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(ok)), b.column(1).filter(pa.array(ok))], ["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def numbered(rows: DataFrame, block: int) -> DataFrame:
    """``rows`` with the ``block`` that holds each in its cluster, by label and vertex.

    Rows are dealt by ranges of (cluster, label, vertex), so a large cluster spans many tasks: each task counts its own
    rows of a cluster, and the counts of the tasks before it, one row a task and cluster, are added.
    """
    part = materialize(rows.repartitionByRange("cluster", "label", "v").withColumn("part", F.spark_partition_id()), "near-ranges")
    inside = F.row_number().over(Window.partitionBy("cluster", "part").orderBy("label", "v")) - 1
    counts = part.groupBy("cluster", "part").count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy("cluster").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("cluster", "part", before.alias("before"))
    out = part.withColumn("place", inside).join(counts, ["cluster", "part"])
    return out.select("v", "label", "cluster", F.floor((F.col("place") + F.col("before")) / block).cast("int").alias("block"))


def crossing(members: DataFrame, labels: DataFrame, sets: DataFrame, percent: int, block: int = 512) -> DataFrame:
    """Links ``a, b`` that join components of ``labels`` inside the clusters of buckets that hold several.

    A cluster's vertices are dealt to blocks in order of their components, and pairs of blocks are tiles; tiles of a
    single component are left out. So however large one component is, only its meetings with others are tested.
    """
    named = members.join(labels, "v", "left").withColumn("label", F.coalesce("label", "v"))
    several = named.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi").select("bucket")
    open_ = materialize(named.join(several, "bucket").select("v", "p", "label").distinct(), "near-open")
    cluster = components(open_.select(F.col("v").alias("a"), F.col("p").alias("b")))
    rows = open_.select("v", "label").distinct().join(cluster.withColumnRenamed("label", "cluster"), "v")
    rows = materialize(numbered(rows, block), "near-blocks")
    blocks = rows.groupBy("cluster", "block").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
    x, y = (blocks.select("cluster", *(F.col(c).alias(c + s) for c in ("block", "lo", "hi"))) for s in "xy")
    tiles = x.join(y, "cluster").filter("blockx <= blocky and not (lox = hix and loy = hiy and lox = loy)").select("cluster", "blockx", "blocky", F.explode(F.array_distinct(F.array("blockx", "blocky"))).alias("block"))
    held = rows.join(tiles, ["cluster", "block"]).join(sets, "v").select("cluster", "blockx", "blocky", "block", "v", "label", "n", "regs", "hashes")

    def test(t: pa.Table) -> pa.Table:
        t = t.combine_chunks().sort_by([("block", "ascending"), ("v", "ascending")])
        block_, v, label, n = (t.column(c).to_numpy() for c in ("block", "v", "label", "n"))
        regs = np.frombuffer(b"".join(t.column("regs").to_pylist()), dtype=np.int16).reshape(-1, REGISTERS)
        hashes = t.column("hashes")
        one = block_[0] == block_[-1]
        left, right = (np.arange(len(v)),) * 2 if one else (np.flatnonzero(block_ == block_[0]), np.flatnonzero(block_ != block_[0]))
        near: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for i in left:  # sizes and shared registers first: both are quick for a row of the tile
            j = right[right > i] if one else right
            j = j[(label[j] != label[i]) & (100 * np.minimum(n[j], n[i]) >= percent * np.maximum(n[j], n[i]))]
            shared = (regs[j] == regs[i]).sum(1)
            ok = shared >= (percent / 100 - SLACK) * REGISTERS
            near.append((np.full(ok.sum(), i), j[ok], shared[ok]))
        i, j, shared = (np.concatenate(c) for c in zip(*near))
        ok = likeliest(regs[i], regs[j], n[i], n[j]) >= percent / 100 - SLACK if len(i) else np.zeros(0, dtype=bool)
        i, j, shared = i[ok], j[ok], shared[ok]
        parent = {x: x for x in label.tolist()}

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        out: tuple[list[int], list[int]] = ([], [])
        for k in np.argsort(-shared, kind="stable"):  # likeliest first; components that a link has joined need no other
            x, y = root(int(label[i[k]])), root(int(label[j[k]]))
            if x != y and similar(hashes[int(i[k])], hashes[int(j[k])], percent):
                parent[x] = y
                out[0].append(int(v[i[k]]))
                out[1].append(int(v[j[k]]))
        return pa.table({"a": pa.array(out[0], pa.int64()), "b": pa.array(out[1], pa.int64())})

    return held.groupBy("cluster", "blockx", "blocky").applyInArrow(test, "a long, b long")


def similar(x: pa.Scalar, y: pa.Scalar, percent: int) -> bool:
    """Whether two sets of sorted distinct hashes have a Jaccard similarity of ``percent`` / 100 or more."""
    a, b = (np.frombuffer(s.as_buffer(), dtype=U64) for s in (x, y))
    every = np.concatenate((a, b))
    every.sort()
    common = int((every[1:] == every[:-1]).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """The documents with one row of each component, all columns as they were.

    The row of the smallest id stays, null ids last; of repeated rows one stays. Documents without words are no
    copies of each other: all of them stay.
    """
    digest, number, kept_id, kept_key = unused(docs, "__digest", "__turn", "__kept_id", "__kept_key")
    best = F.struct(F.col("id").isNull(), F.col("id").alias("id"), F.col("key").alias("key"))
    keep = linked(docs, id_col, text_col, words, percent).filter("n > 0").groupBy("label").agg(F.min(best).alias("s")).select(F.col("s.id").alias(kept_id), F.col("s.key").alias(kept_key))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    bare = ~text.rlike("[^\\x20\\x09-\\x0D]")
    full = docs.filter(~bare).withColumn(digest, F.unhex(F.md5(text)))
    left = full.join(keep, (F.col(digest) == F.col(kept_key)) & F.col(id_col).eqNullSafe(F.col(kept_id)), "left_semi")
    turn = F.row_number().over(Window.partitionBy(digest, id_col).orderBy(F.lit(1)))
    return left.withColumn(number, turn).filter(F.col(number) == 1).select(*docs.columns).unionByName(docs.filter(bare))
