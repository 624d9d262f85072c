"""Where callers put in their models: each takes a function over a batch and runs it Arrow-batched on the executors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def transcribe(files: DataFrame, model: Callable[[str], list[tuple[float, float | None, str]]]) -> DataFrame:
    """``video_id, chunk_ix, text, ts`` from (video_id, path): ``model`` gives (start, end, text) chunks of a path.

    The last chunk's end may be open (null). A path for which the model raises gives no rows, as a failed download does.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for video, path in zip(b["video_id"], b["path"]):
                try:
                    chunks = model(path)
                except Exception:  # the model is a boundary: one bad file must not end the run
                    chunks = []
                rows += [(video, k, text, {"start": start, "end": end}) for k, (start, end, text) in enumerate(chunks)]
            yield pd.DataFrame(rows, columns=["video_id", "chunk_ix", "text", "ts"])

    kind = dict(files.dtypes)["video_id"]
    return files.select("video_id", "path").mapInPandas(run, f"video_id {kind}, chunk_ix int, text string, ts struct<start: double, end: double>")


def encoder(model: Callable[[list], list[list[float]]]) -> Callable[[Column | str], Column]:
    """A column function for vectors of texts or image paths; nulls stay null. The default is a precomputed column."""

    @F.pandas_udf("array<float>")
    def run(values: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(values), index=values.index, dtype=object)
        there = values.notna()
        if there.any():
            for i, v in zip(values.index[there], model(values[there].tolist())):
                out[i] = [float(x) for x in v]
        return out

    return run


def tagger(model: Callable[[str], list[str]]) -> Callable[[Column | str], Column]:
    """A column function for a text's entities, to be given as ``tag`` to relevance and entity metrics."""

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: list(dict.fromkeys(model(t))) if isinstance(t, str) else [])

    return run


def pair_scorer(model: Callable[[list[str], list[str]], list[float]]) -> Callable[[Column | str, Column | str], Column]:
    """A column function for the similarity of two texts, to be given as ``similarity`` to attribution."""

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(model(a.fillna("").tolist(), b.fillna("").tolist()), dtype="float64")

    return run


def bert_score(pairs: DataFrame, model: Callable[[list[str], list[str]], tuple[list[float], list[float], list[float]]]) -> DataFrame:
    """``pair_id, bert_score_precision, bert_score_recall, bert_score_f1`` by a model; zeros for a batch that fails."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            try:
                scores = model(b["candidate"].fillna("").tolist(), b["reference"].fillna("").tolist())
            except Exception:  # the model is a boundary
                scores = ([0.0] * len(b),) * 3
            yield pd.DataFrame({"pair_id": b["pair_id"]} | {f"bert_score_{n}": list(x) for n, x in zip(("precision", "recall", "f1"), scores)})

    kind = dict(pairs.dtypes)["pair_id"]
    return pairs.select("pair_id", "candidate", "reference").mapInPandas(run, f"pair_id {kind}, bert_score_precision double, bert_score_recall double, bert_score_f1 double")
