"""Packing documents into windows by best-fit decreasing over a segment tree."""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipquery.llm.cache import Recent
from clipquery.llm.token_counts import PATTERN, byte_symbols

#: Pieces that are packed together; a task with more packs them in such groups, so memory is bounded.
GROUP = 1 << 17
_CUT = re.compile(r" (?=\S)")
_ODD = re.compile(r" \s| $")


class Encoder:
    """Ids of a byte-level BPE tokenizer as little-endian unsigned 32-bit bytes.

    Its pre-tokens never span the place before a space that a non-space follows, so the text is cut there and each
    stretch is encoded once while it is in the cache. Where the vocabulary's ids are the ranks of its merges,
    stretches are encoded by the faster library of that kind, which gives the same ids; texts that hold special
    strings are encoded whole by the tokenizer library.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        ranks = merge_ranks(path)
        if ranks:
            import tiktoken

            self.ids = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        else:
            self.ids = self.library
        self.known = Recent(lambda piece: array("I", self.ids(" " + piece)).tobytes())

    def library(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if any(s in text for s in self.special):
            return array("I", self.library(text)).tobytes()
        first, *rest = text.split(" ") if not _ODD.search(text) else _CUT.split(text)
        return array("I", self.ids(first)).tobytes() + b"".join(map(self.known.__getitem__, rest))


def merge_ranks(path: str) -> dict[bytes, int] | None:
    """The vocabulary as ranks of byte strings; None unless each merge's id is its rank after the 256 bytes."""
    with open(path, encoding="utf-8") as f:
        said = json.load(f)
    model, pre = said["model"], said.get("pre_tokenizer") or {}
    if model.get("type") != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or said.get("normalizer"):
        return None
    byte = {c: b for b, c in enumerate(byte_symbols())}
    ids = model["vocab"]
    merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
    if any(ids.get(m) != 256 + i for i, m in enumerate(merged)):
        return None
    return {bytes(byte[c] for c in symbol): i for symbol, i in ids.items() if all(c in byte for c in symbol)}


@lru_cache(1)
def encoder(path: str) -> Encoder:
    return Encoder(path)


class OpenWindows:
    """Open windows by remaining capacity, with a segment tree whose nodes say whether a window is below them."""

    def __init__(self, window: int) -> None:
        self.base = 1 << window.bit_length()
        self.count = [0] * (2 * self.base)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def put(self, capacity: int, sequence: int) -> None:
        self.open[capacity].append(sequence)
        i = self.base + capacity
        while i:
            self.count[i] += 1
            i >>= 1

    def tightest(self, length: int) -> tuple[int, int] | None:
        """Take out the window with the least capacity that is at least ``length``."""
        count, i = self.count, self.base + length
        if not count[i]:
            while i > 1 and (i & 1 or not count[i + 1]):  # up to the first right sibling that has a window
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.base:  # down to its leftmost
                i = 2 * i if count[2 * i] else 2 * i + 1
        capacity = i - self.base
        while i:
            count[i] -= 1
            i >>= 1
        return capacity, self.open[capacity].pop()


def best_fit_decreasing(lengths: list[int], window: int) -> tuple[list[int], list[int], int]:
    """Sequence and offset of each piece (1 to ``window`` long), and the number of sequences."""
    sequence, offset, n = [0] * len(lengths), [0] * len(lengths), 0
    tree = OpenWindows(window)
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        size = lengths[i]
        found = tree.tightest(size)
        if found is None:
            capacity, s = window, n
            n += 1
        else:
            capacity, s = found
        sequence[i], offset[i] = s, window - capacity
        if capacity > size:
            tree.put(capacity - size, s)
    return sequence, offset, n


_FIELDS = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", window: int = 2048, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """Pack all documents into sequences of at most ``window`` tokens, one row per piece, without a shuffle.

    A document is its ids (tokenizer file ``path``, no added special tokens) and ``end_id``. An overlong one is first
    cut into full windows, each a sequence of its own; the remainders and short documents of a task are packed by
    best-fit decreasing. Windows of different tasks aren't mixed: each task leaves less than one window open on
    average, whatever the number of its documents. ``sequence_id`` joins the task's partition (high bits) and a
    number inside it, so a task that runs again gives the same rows.

    Returns ``id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset`` and, ``with_ids``, the ids
    themselves. Null and empty texts are the end id alone. Ids may be null or repeated: every row is packed. Other
    columns are ignored; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        enc = encoder(path)
        top = TaskContext.get().partitionId() << 33
        kind, cols, whole, first = None, [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal cols, whole, first
            lengths = [c[2] for c in cols]
            short = [i for i, n in enumerate(lengths) if n < window]
            sequence, offset, n = best_fit_decreasing([lengths[i] for i in short], window)
            place = np.zeros((len(cols), 2), dtype=np.int64)
            place[short, 0], place[short, 1] = sequence, offset
            full = [i for i, x in enumerate(lengths) if x == window]
            place[full, 0] = np.arange(n, n + len(full))
            arrays = [pa.array([c[0] for c in cols], kind), *(pa.array([c[k] for c in cols], pa.int64()) for k in (1, 2, 3, 4)), pa.array(place[:, 0] + top + first), pa.array(place[:, 1])]
            if with_ids:
                arrays.append(pa.array([np.frombuffer(x, dtype="<u4").astype(np.int32) for x in whole], pa.list_(pa.int32())))
            first += n + len(full)
            cols, whole = [], []
            yield pa.RecordBatch.from_arrays(arrays, ["id", *_FIELDS, *(["ids"] if with_ids else [])])

        for b in batches:
            kind = b.column(0).type
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = enc.encode(text) + end
                total = len(ids) // 4
                for at in range(0, total, window):
                    piece = ids[4 * at : 4 * (at + window)]
                    cols.append((key, at, len(piece) // 4, zlib.crc32(piece), total))
                    if with_ids:
                        whole.append(piece)
                if len(cols) >= GROUP:
                    yield from flush()
        if cols:
            yield from flush()

    schema = f"id {dict(rows.dtypes)['id']}, " + ", ".join(f"{f} long" for f in _FIELDS) + (", ids array<int>" if with_ids else "")
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)
