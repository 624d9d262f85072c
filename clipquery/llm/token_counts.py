"""Token counts of byte-level BPE by heap-and-linked-list merging, without emitting identifiers."""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipquery.llm.cache import Recent

#: How byte-level BPE cuts text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A pre-token never spans the place before a space that a non-space follows.
_CUT = re.compile(r" (?=\S)")
_ODD = re.compile(r" \s| $")


def byte_symbols() -> list[str]:
    """The character that stands for each byte in the vocabulary's merges: printable ones for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Counter:
    """Counts tokens as the vocabulary's own library does, special strings inside texts included."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        pairs = (m if isinstance(m, list) else m.split(" ") for m in said["model"]["merges"])
        self.rank: dict[tuple[str, str], int] = {(a, b): i for i, (a, b) in enumerate(pairs)}
        self.symbols = byte_symbols()
        self.special = sorted((t["content"] for t in said.get("added_tokens", [])), key=len, reverse=True)
        self.split = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.pre = regex.compile(PATTERN)
        self.words = Recent(self.merged, 400_000)
        self.chunks = Recent(lambda piece: self.chunk(" " + piece))

    def merged(self, word: str) -> int:
        """Tokens of one pre-token: its bytes, less one for each merge.

        Symbols are a doubly linked list, adjacent pairs a heap by (rank, place). Popping the lowest-rank pair joins
        it, unlinks its right symbol and pushes the two new neighbour pairs; pairs whose symbols have changed
        meanwhile are skipped when popped.
        """
        symbols, rank = self.symbols, self.rank
        part: list[str | None] = [symbols[b] for b in word.encode("utf-8", "surrogatepass")]
        n = count = len(part)
        after, prior = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, part[i], part[i + 1]) for i in range(n - 1) if (r := rank.get((part[i], part[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if part[i] != a or j >= n or part[j] != b:
                continue
            part[i], part[j] = a + b, None
            count -= 1
            k = after[i] = after[j]
            if k < n:
                prior[k] = i
                if (r := rank.get((part[i], part[k]))) is not None:
                    heapq.heappush(heap, (r, i, part[i], part[k]))
            if (h := prior[i]) >= 0 and (r := rank.get((part[h], part[i]))) is not None:
                heapq.heappush(heap, (r, h, part[h], part[i]))
        return count

    def chunk(self, text: str) -> int:
        """Tokens of a stretch that pre-tokens don't leave; sums what its pre-tokens have."""
        return sum(map(self.words.__getitem__, self.pre.findall(text)))

    def plain(self, text: str) -> int:
        if not text:
            return 0
        first, *rest = text.split(" ") if not _ODD.search(text) else _CUT.split(text)
        return self.chunk(first) + sum(map(self.chunks.__getitem__, rest))

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.split and any(s in text for s in self.special):
            return sum(map(self.plain, self.split.split(text))) + len(self.split.findall(text))
        return self.plain(text)


@lru_cache(2)
def counter(path: str) -> Counter:
    return Counter(path)


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """Tokens of every whole text, one row per document, without a shuffle.

    ``path`` is the vocabulary (byte-level BPE as JSON) on every executor. Each worker keeps bounded caches of what
    pre-tokens and stretches between spaces count; misses are merged by heap and linked list.

    Returns ``id_col, n_bytes, n_tokens, over_limit``. Null and empty texts have 0 tokens. Ids may be null or
    repeated; each row is counted alone. Other columns are ignored; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.compute.binary_length(b.column(1)).cast(pa.int64()), pa.array([c.count(t) for t in b.column(1).to_pylist()], pa.int64())], ["id", "n_bytes", "n_tokens"])

    counted = rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, n_bytes long, n_tokens long")
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
