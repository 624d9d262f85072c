"""Which documents share a passage of words, by winnowed fingerprints."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipquery.llm.bytes_view import U64
from clipquery.llm.common import materialize
from clipquery.llm.near_dedup import run_hashes, word_hashes


def fingerprints(column: pa.Array, run: int, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash): the runs of ``run`` words that are least of their neighbours in any window of ``words`` words.

    A window's choice depends on nothing else, so texts that share the window share its fingerprint. Texts of fewer
    words have none; each fingerprint of a text is given once.
    """
    word, of = word_hashes(column)
    h = run_hashes(word, run)
    width = words - run + 1  # runs of a window
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=U64)

    def slide(x: np.ndarray, f: np.ufunc) -> np.ndarray:
        k = 1
        while 2 * k <= width:
            x = f(x[:-k], x[k:])
            k *= 2
        return f(x[: len(x) - width + k], x[width - k :]) if k < width else x

    text = np.repeat(np.arange(len(of) - 1), np.diff(of))
    least = slide(h, np.minimum)
    least[text[:n] != text[words - 1 : words - 1 + n]] = 0  # windows that a text's end cuts choose nothing
    pad = np.zeros(width - 1, dtype=U64)
    chosen = np.flatnonzero((slide(np.concatenate((pad, least, pad)), np.maximum) == h) & (h > 0))
    who, value = text[chosen], h[chosen]
    by = np.lexsort((value, who))
    who, value = who[by], value[by]
    new = np.concatenate(([True], (who[1:] != who[:-1]) | (value[1:] != value[:-1]))) if len(who) else np.zeros(0, dtype=bool)
    return who[new], value[new]


def shared_passages(docs: DataFrame, text_col: str = "text", words: int = 51, run: int = 20) -> DataFrame:
    """``text_hash`` (xxhash64 of the text, null: empty) of the documents that share a passage with another row.

    Every text that shares ``words`` words in a row with another row's text is found, none that shares fewer than ``run``
    (but for colliding 64-bit hashes). Words are as in :mod:`clipquery.llm.near_dedup`. Rows of equal texts count as
    several. Texts of fewer than ``words`` words are never given; an empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                b = whole.slice(lo, 512)
                who, value = fingerprints(b.column(1), run, words)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(who)), pa.array(value.astype(np.int64))], ["text_hash", "mark"])

    marks = materialize(docs.select(F.xxhash64(text).alias("text_hash"), text.alias("text")).mapInArrow(choose, "text_hash long, mark long"), "passage-marks")
    shared = marks.groupBy("mark").count().filter("count > 1").select("mark")
    return materialize(marks.join(shared, "mark", "left_semi").select("text_hash").distinct(), "passages")


def with_passages(rows: DataFrame, docs: DataFrame, text_col: str) -> DataFrame:
    """``rows`` with ``repeats_passage`` in place of ``text_hash``."""
    found = shared_passages(docs, text_col).withColumn("repeats_passage", F.lit(True))
    return rows.join(found, "text_hash", "left").withColumn("repeats_passage", F.coalesce("repeats_passage", F.lit(False))).drop("text_hash")
