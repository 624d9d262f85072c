"""Removal of long repeated byte strings by column-wise construction over aligned contexts."""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipquery.llm.bytes_view import U64, mixed, text_bytes
from clipquery.llm.common import discard, materialize
from clipquery.llm.passages import with_passages

#: Bytes of an anchor; a power of two.
GRAM = 32
#: Starts of windows that are hashed at once.
STEP = 1 << 18
#: Bytes of contexts that are built together; a larger batch ends with the group that it is in.
BUDGET = 24 << 20
#: Bytes of contexts whose columns stay in memory; more go through a file of columns.
IN_MEMORY = 8 << 20
#: Distinct contexts of an anchor that are built in one task; of more, each string is judged by itself.
KINDS = 16_384
#: Anchors or strings that leave a task at once.
ROWS = 1 << 16
#: Bytes of contexts that are cut out of texts at once.
CUT = 8 << 20
_M, _M2 = 0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hashes of all GRAM-byte strings, by doubling: 2 bytes, 4 bytes, .."""
    h, k, m = data.astype(U64) + U64(1), 1, _M
    while k < GRAM:
        h = h[:-k] * U64(m) + h[k:]
        m = m * m & 0xFFFFFFFFFFFFFFFF
        k *= 2
    return mixed(h)


def anchors(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first start, anchor position, anchor hash) for each run of starts of ``length``-byte strings with one anchor.

    A string's anchor is its gram of least hash, the leftmost of equal ones; equal strings so have equal anchors at
    equal places. As a string moves on, its anchor never moves back, so each anchor serves one run of starts.
    """
    first, place, value = [], [], []
    width = length - GRAM + 1  # grams of a string
    for lo in range(0, len(data) - length + 1, STEP):
        hi = min(lo + STEP, len(data) - length + 1)
        h = gram_hashes(data[lo : hi + length - 1])
        least = (h & ~U64(0xFFFFF)) | np.arange(len(h), dtype=U64)
        k = 1
        while 2 * k <= width:
            least = np.minimum(least[:-k], least[k:])
            k *= 2
        if k < width:
            least = np.minimum(least[: len(least) - width + k], least[width - k :])
        at = (least[: hi - lo] & U64(0xFFFFF)).astype(np.int64)
        new = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        first.append(new + lo)
        place.append(at[new] + lo)
        value.append(h[at[new]].astype(np.int64))
    first_, place_, value_ = (np.concatenate(x) for x in (first, place, value))
    new = np.concatenate(([True], place_[1:] != place_[:-1]))  # a border of blocks ends no run
    return first_[new], place_[new], value_[new]


def string_hashes(data: np.ndarray, length: int, m: int) -> np.ndarray:
    """Hashes of all ``length``-byte strings, put together from those of strings of 1, 2, 4, .. bytes."""
    n = len(data) - length + 1
    h, k, at = mixed(data.astype(U64) + U64(m)), 1, 0
    out = np.zeros(n, dtype=U64)
    while True:
        if length & k:
            out = out * U64(m) + h[at : at + n]
            at += k
        if 2 * k > length:
            return mixed(out)
        h = h[:-k] * U64(m) + h[k:]
        m = m * m & 0xFFFFFFFFFFFFFFFF
        k *= 2


class Columns:
    """The symbols of contexts by column, aligned at their anchors; -1 outside a context. Beyond the budget they are
    written to a file, one column after another, and read back in that order."""

    def __init__(self, contexts: list[bytes], left: np.ndarray) -> None:
        size = np.array([len(c) for c in contexts])
        self.start = int(left.max()) - left  # first column of each context
        self.end = self.start + size
        self.width = int(self.end.max())
        self.data = np.frombuffer(b"".join(contexts), dtype=np.uint8)
        self.base = np.concatenate(([0], np.cumsum(size)[:-1])) - self.start
        self.file = tempfile.TemporaryFile(dir=os.environ.get("TMPDIR")) if len(self.data) > IN_MEMORY else None
        if self.file:
            for k in range(self.width):
                self.file.write(self._column(k).tobytes())
            self.data = None
            self.file.seek(0)

    def _column(self, k: int) -> np.ndarray:
        inside = (self.start <= k) & (k < self.end)
        at = np.where(inside, self.base + k, 0)
        return np.where(inside, self.data[at].astype(np.int16), np.int16(-1))

    def __iter__(self) -> Iterator[np.ndarray]:
        for k in range(self.width):
            yield np.frombuffer(self.file.read(2 * len(self.start)), dtype=np.int16) if self.file else self._column(k)
        if self.file:
            self.file.close()


def repeated_ends(group: np.ndarray, contexts: list[bytes], left: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, first, last): runs of columns of a context at which a ``length``-byte string ends that another
    context of its group has at the same columns. Contexts of a group (numbers in ascending order) are neighbours.

    One symbol of every context is inserted each round. ``order`` lists contexts by group, then by their reversed
    prefixes, so the symbols in that order are the column's Burrows-Wheeler transform; ``common`` is the length of
    the suffix that a context's prefix shares with its predecessor's. Inserting a column sorts each group's symbols
    stably; two that become neighbours share one more than the least of ``common`` between their old places.
    """
    n = len(contexts)
    columns = Columns(contexts, left)
    order, common = np.arange(n), np.zeros(n, dtype=np.int32)
    head = np.concatenate(([True], group[1:] != group[:-1]))  # places of groups don't change
    slot = np.cumsum(head) - 1
    on, since = np.zeros(n, dtype=bool), np.zeros(n, dtype=np.int64)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    place = np.arange(n)
    for k, symbol in enumerate(columns):
        s = symbol[order]
        differs = np.concatenate(([True], s[1:] != s[:-1])) | head
        keep = ~differs & (s >= 0)  # neighbours that stay so and share one more
        fresh = np.where(keep, common + 1, 0).astype(np.int32)
        changed = differs & ~head
        if changed.any():
            mixed_group = np.zeros(slot[-1] + 1, dtype=bool)
            mixed_group[slot[changed]] = True
            at = place[mixed_group[slot]]  # places of groups with several symbols
            by = np.argsort(slot[at] * 512 + (s[at] + 1), kind="stable")
            old = at[by]  # where each came from
            same = np.zeros(len(at), dtype=bool)
            same[1:] = (slot[at][1:] == slot[at][:-1]) & (s[old][1:] == s[old][:-1]) & (s[old][1:] >= 0)
            value = np.zeros(len(at), dtype=np.int32)
            i = np.flatnonzero(same)
            if len(i):
                a, b = old[i - 1] + 1, old[i] + 1
                near = b - a == 1
                value[i[near]] = common[a[near]] + 1
                far = np.flatnonzero(~near)
                if len(far):
                    padded = np.append(common, np.int32(0))
                    value[i[far]] = np.minimum.reduceat(padded, np.stack((a[far], b[far]), 1).reshape(-1))[::2] + 1
            fresh[at] = value
            order = order.copy()
            order[at] = order[old]
        common = fresh
        if k + 1 >= length:
            hit = common >= length
            hit[:-1] |= hit[1:]
            now = np.zeros(n, dtype=bool)
            now[order] = hit
            moved = now != on
            if moved.any():
                since[moved & now] = k
                over = np.flatnonzero(moved & on)
                if len(over):
                    found.append((over, since[over], np.full(len(over), k - 1)))
                on = now
    over = np.flatnonzero(on)
    found.append((over, since[over], np.full(len(over), columns.width - 1)))
    who, first, last = (np.concatenate(x) for x in zip(*found))
    return who, first - columns.start[who], last - columns.start[who]


def merged(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of half-open spans as sorted maximal ones; touching spans become one."""
    by = np.argsort(first, kind="stable")
    first, last = first[by], np.maximum.accumulate(last[by])
    new = np.concatenate(([True], first[1:] > last[:-1]))
    return first[new], last[np.concatenate((new[1:], [True]))]


#: Bytes of spans up to this many are broadcast to the texts that they cut; more are joined by shuffle.
BROADCAST_BYTES = 16 << 20


def keyed(docs: DataFrame, text_col: str) -> DataFrame:
    """``key, text``: half of the text's SHA-256, which stands for the text everywhere below."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.unhex(F.substring(F.sha2(text, 256), 1, 32)).alias("key"), text.alias("text"))


def repeated_spans(docs: DataFrame, text_col: str = "text", length: int = 400, kinds: int = KINDS) -> DataFrame:
    """``key, spans``: for texts that hold any, maximal spans ``first, last`` (bytes, half-open) in which every byte is
    covered by a ``length``-byte string that also starts elsewhere in the distinct texts.

    A text that several rows share is searched once; the caller knows that it is repeated as a whole. Anchors of up to
    ``kinds`` distinct contexts are built in one task each, the others by :func:`judged_alone`.
    """
    if length < 2 * GRAM:
        raise ValueError(f"length must be at least {2 * GRAM}")
    rows = keyed(docs, text_col)
    # The map side leaves one row per text and task, so a hot text is no hot group.
    texts = rows.groupBy("key").agg(F.first("text").alias("text"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                b = whole.slice(lo, 256)
                data, at = text_bytes(b.column(1))
                held: list[tuple[np.ndarray, ...]] = []
                digests: list[bytes] = []
                n = 0

                def found() -> pa.RecordBatch:
                    who, anchor, place, first, last = (np.concatenate(x) for x in zip(*held))
                    context = pa.Array.from_buffers(pa.binary(16), n, [None, pa.py_buffer(b"".join(digests))]).cast(pa.binary())
                    return pa.RecordBatch.from_arrays([pa.array(anchor), b.column(0).take(pa.array(who)), *(pa.array(x.astype(np.int32)) for x in (place, first, last)), context], ["anchor", "key", "place", "first", "last", "context"])

                for i in range(b.num_rows):
                    d = data[at[i] : at[i + 1]]
                    if len(d) < length:
                        continue
                    first, place, value = anchors(d, length)
                    last = np.append(first[1:], len(d) - length + 1)
                    raw = d.tobytes()
                    for k in range(0, len(first), ROWS):  # a periodic text has an anchor at every start
                        x, y = first[k : k + ROWS], last[k : k + ROWS]
                        held.append((np.full(len(x), i), value[k : k + ROWS], place[k : k + ROWS], x, y))
                        digests.append(b"".join(hashlib.md5(raw[u:v]).digest() for u, v in zip(x.tolist(), (y + length - 1).tolist())))
                        n += len(x)
                        if n >= ROWS:
                            yield found()
                            held, digests, n = [], [], 0
                if held:
                    yield found()

    # A copy's anchors are the same rows again and count once. Contexts are known by their digests until they are cut.
    seen = materialize(rows.mapInArrow(find, "anchor long, key binary, place int, first int, last int, context binary").distinct(), "suffix-anchors")
    same = seen.groupBy("anchor", (F.col("place") - F.col("first")).alias("left"), "context").agg(F.count("*").alias("n"), F.min(F.struct("key", "place", "first", "last")).alias("one"))
    same = materialize(same.select("anchor", "n", "one.*"), "suffix-contexts")
    # Contexts that occur again are repeated as a whole: all but those that occur once, which is asked by text, not by
    # context, so that no context is a hot key.
    once = same.filter("n = 1").select("key", "place")
    again = seen.join(once, ["key", "place"], "left_anti").select("key", F.col("first").cast("long").alias("first"), (F.col("last") + length - 1).cast("long").alias("last"))
    # One of each kind is built with the others of its anchor.
    shared = materialize(same.groupBy("anchor").agg(F.count("*").alias("kinds")).filter("kinds > 1"), "suffix-shared")
    every = same.join(shared, "anchor")
    wanted = every.filter(F.col("kinds") <= kinds).groupBy("key").agg(F.collect_list(F.struct("anchor", "place", "first", "last")).alias("at"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                b = whole.slice(lo, 256)
                data, at = text_bytes(b.column(1))
                lists = b.column(2)
                f = lists.flatten()
                anchor, place, first, last = (f.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4))
                n = np.asarray(lists.value_lengths())
                base = np.repeat(at[:-1], n)
                raw = data.tobytes()
                who, begin, end = np.repeat(np.arange(b.num_rows), n), base + first, base + last - 1 + length
                # A periodic text has a context at every start, so batches are cut by their bytes.
                batch = np.cumsum(end - begin) // CUT
                for at_ in np.split(np.arange(len(who)), np.flatnonzero(batch[1:] != batch[:-1]) + 1) if len(who) else ():
                    contexts = [raw[x:y] for x, y in zip(begin[at_].tolist(), end[at_].tolist())]
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(who[at_])), pa.array(anchor[at_]), pa.array(first[at_]), pa.array((place - first)[at_]), pa.array(contexts, pa.binary())], ["key", "anchor", "first", "left", "context"])

    contexts = texts.join(wanted, "key").select("key", "text", "at").mapInArrow(cut, "key binary, anchor long, first long, left long, context binary")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole groups of an anchor, of a bounded number of contexts each."""
        held: list[tuple[bytes, int, int, int, bytes]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            key, anchor, first, left, context = zip(*held)
            who, lo, hi = repeated_ends(np.array(anchor), list(context), np.array(left), length)
            start = np.array(first)[who]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([key[i] for i in who.tolist()], pa.binary()), pa.array(start + lo - length + 1), pa.array(start + hi + 1)], ["key", "first", "last"])

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if held and row[1] != held[-1][1] and size > BUDGET:  # only whole groups are built
                    yield flush()
                    size = 0
                held.append(row)
                size += len(row[4]) + 200
        if held:
            yield flush()

    spans = contexts.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(build, "key binary, first long, last long").unionAll(again)
    made = []
    if not shared.filter(F.col("kinds") > kinds).isEmpty():
        many = every.filter(F.col("kinds") > kinds).select(F.monotonically_increasing_id().alias("c"), "key", "first", "last")
        made.append(materialize(many, "suffix-many"))
        spans = spans.unionAll(judged_alone(texts, made[0], length))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = b.column(1).flatten()
            first, last = (f.field(i).to_numpy() for i in range(2))
            at = np.concatenate(([0], np.cumsum(b.column(1).value_lengths(), dtype=np.int64)))
            found = [merged(first[x:y], last[x:y]) for x, y in zip(at[:-1].tolist(), at[1:].tolist())]
            none = np.zeros(0, dtype=np.int64)
            runs = pa.StructArray.from_arrays([pa.array(np.concatenate([none, *(x[i] for x in found)])) for i in range(2)], ["first", "last"])
            ends = np.concatenate(([0], np.cumsum([len(x[0]) for x in found], dtype=np.int64))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends), runs)], ["key", "spans"])

    listed = spans.groupBy("key").agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    spans = materialize(listed.mapInArrow(join, "key binary, spans array<struct<first: long, last: long>>"), "suffix-spans")
    discard(seen, same, shared, *made)
    return spans


def judged_alone(texts: DataFrame, contexts: DataFrame, length: int) -> DataFrame:
    """``key, first, last``: the repeated spans of distinct contexts ``c, key, first, last`` that are too many for a task.

    Each string of a context becomes a row of its 128-bit hash. Hashes are counted with a combining map side, so a
    string of any number of contexts is no hot group, and those counted once name the one context they are in: what a
    context doesn't hold of them is repeated.
    """
    at = contexts.groupBy("key").agg(F.collect_list(F.struct("c", "first", "last")).alias("at"))

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                b = whole.slice(lo, 256)
                data, of = text_bytes(b.column(0))
                for i, found in enumerate(b.column(1)):
                    f = found.values
                    c, first, last = (f.field(j).to_numpy().astype(np.int64) for j in range(3))
                    for k in range(0, len(c), 256):
                        n = last[k : k + 256] - first[k : k + 256]
                        cuts = [data[of[i] + x : of[i] + y + length - 1] for x, y in zip(first[k : k + 256].tolist(), last[k : k + 256].tolist())]
                        h = [np.concatenate([string_hashes(d, length, m) for d in cuts]).astype(np.int64) for m in (_M, _M2)]
                        place = np.concatenate([np.arange(x) for x in n.tolist()]).astype(np.int32)
                        yield pa.RecordBatch.from_arrays([*map(pa.array, h), pa.array(np.repeat(c[k : k + 256], n)), pa.array(place)], ["h1", "h2", "c", "place"])

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            who, starts, ends = [], [], []
            for i, (x, y, single) in enumerate(zip(*(c.to_pylist() for c in b.columns[1:]))):
                on = np.zeros(y - x + 2, dtype=np.int8)
                on[1:-1] = 1
                on[np.array(single or [], dtype=np.int64) + 1] = 0
                turn = np.flatnonzero(np.diff(on))
                who += [i] * (len(turn) // 2)
                starts.append(turn[::2] + x)
                ends.append(turn[1::2] + x + length - 1)
            none = np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(who, pa.int32())), pa.array(np.concatenate([none, *starts])), pa.array(np.concatenate([none, *ends]))], ["key", "first", "last"])

    rows = texts.join(at, "key").select("text", "at").mapInArrow(strings, "h1 long, h2 long, c long, place int")
    single = rows.groupBy("h1", "h2").agg(F.count("*").alias("rows"), F.min("c").alias("c"), F.min("place").alias("place")).filter("rows = 1")
    single = single.groupBy("c").agg(F.collect_list("place").alias("single"))
    return contexts.join(single, "c", "left").select("key", "first", "last", "single").mapInArrow(runs, "key binary, first long, last long")


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, with_text: bool = False, passages: bool = False, kinds: int = KINDS) -> DataFrame:
    """Remove every byte covered by a ``length``-byte string that also starts anywhere else in the texts.

    Strings are judged on the input, as bytes of UTF-8, never across documents; overlaps count.

    1. Anchors: one pass over the texts finds each string's anchor, a gram of least hash, which equal strings have at
       equal places. Anchors that occur once can't be in a repeated string.
    2. Contexts: for each other anchor, the bytes of the strings that it serves, aligned at it. A context that occurs
       several times is repeated as a whole, and one of its kind goes on.
    3. Column-wise construction of all contexts that share an anchor, one symbol of each inserted per round, with
       orders and common lengths updated from the round before; columns of large batches are read from a file in
       sequence. Strings whose common length reaches ``length`` are repeated.
    4. An anchor of more than ``kinds`` distinct contexts would fill a task: its strings are counted by their hashes
       instead (:func:`judged_alone`), which gives the same spans and spreads over all tasks.
    5. Spans of a text are joined; texts that several rows share are repeated as a whole.

    Returns ``id_col, n_bytes, n_removed, n_spans, kept_sha256`` and, ``with_text``, ``kept``, the remaining bytes. With
    ``passages`` a column ``repeats_passage`` follows (:func:`clipquery.llm.passages.shared_passages`): a passage of
    over 50 words may have fewer than ``length`` bytes, so what is removed does not tell all of them.
    Null and empty texts have 0 bytes. Ids may be null or repeated: rows count as separate documents. Other columns
    are ignored; an empty table gives an empty result.
    """
    spans = repeated_spans(docs, text_col, length, kinds)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                b = whole.slice(lo, 256)
                data, at = text_bytes(b.column(1))
                raw = data.tobytes()
                left = []
                for i, found in enumerate(b.column(2).to_pylist()):
                    cuts = [at[i], *(at[i] + x for s in found or () for x in (s["first"], s["last"])), at[i + 1]]
                    left.append(b"".join(raw[x:y] for x, y in zip(cuts[::2], cuts[1::2])))
                cols = [b.column(0), pa.array([hashlib.sha256(x).hexdigest() for x in left], pa.string())]
                yield pa.RecordBatch.from_arrays([*cols, *[pa.array(left, pa.binary())] * with_text], ["key", "kept_sha256", *["kept"] * with_text])

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    sha = F.sha2(text, 256)
    ids = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("text_hash"), F.unhex(F.substring(sha, 1, 32)).alias("key"), sha.alias("sha"), F.octet_length(text).cast("long").alias("n_bytes"))
    ids = ids if passages else ids.drop("text_hash")
    copies = ids.groupBy("key").agg(F.count("*").alias("copies"))
    rows = ids.join(copies, "key").join(spans, "key", "left")
    # Only texts of which a part goes are read again.
    removed = F.coalesce(F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["last"] - x["first"]), F.lit(0).cast("long"))
    all_ = (F.col("n_bytes") >= length) & (F.col("copies") > 1)
    rows = rows.withColumn("n_removed", F.when(all_, F.col("n_bytes")).otherwise(removed)).withColumn("n_spans", F.when(all_, 1).otherwise(F.coalesce(F.size("spans"), F.lit(0))).cast("long")).drop("spans", "copies")
    size = spans.agg(F.sum(64 + 16 * F.size("spans"))).first()[0] or 0
    cut = spans if size > BROADCAST_BYTES else F.broadcast(spans)
    every = keyed(docs, text_col)
    if with_text:
        every = every.groupBy("key").agg(F.first("text").alias("text")).join(spans, "key", "left")
    else:
        every = every.join(cut, "key").dropDuplicates(["key"])
    done = every.select("key", "text", "spans").mapInArrow(keep, "key binary, kept_sha256 string" + ", kept binary" * with_text)
    out = rows.join(done, "key", "left")
    none = F.lit(hashlib.sha256(b"").hexdigest())
    whole = F.col("n_removed") == F.col("n_bytes")
    kept = F.when(whole, none).when(F.col("n_removed") == 0, F.col("sha")).otherwise(F.col("kept_sha256"))
    more = [F.when(whole, F.lit(b"")).otherwise(F.col("kept")).alias("kept")] * with_text
    out = out.select(F.col("id").alias(id_col), "n_bytes", "n_removed", "n_spans", kept.alias("kept_sha256"), *more, *["text_hash"] * passages)
    return with_passages(out, docs, text_col) if passages else out
