"""Quality classifier by supervised subword embeddings, trained by numpy stochastic gradient descent."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipquery.llm.cache import Recent
from clipquery.llm.labelled import sample, texts_of

BUCKETS, DIM = 1 << 16, 8
GRAMS = (2, 3)
#: The feature of a word that repeats the word before it.
AGAIN = BUCKETS


def features(word: str) -> list[int]:
    """Buckets of the word and of its character n-grams, ends marked; very long words count by their n-grams too."""
    w = f"<{word}>".encode("utf-8", "surrogatepass")
    return [zlib.crc32(w) % BUCKETS, *(zlib.crc32(w[i : i + n], n) % BUCKETS for n in GRAMS for i in range(len(w) - n + 1))]


def repeats(words: list[str]) -> int:
    return sum(map(str.__eq__, words, words[1:]))


@dataclass
class Model:
    """Embeddings of features, softmax output rows and their biases (classes 0 and 1)."""

    embeddings: np.ndarray = field(default_factory=lambda: np.zeros((BUCKETS + 1, DIM), dtype=np.float32))
    output: np.ndarray = field(default_factory=lambda: np.zeros((2, DIM), dtype=np.float32))
    bias: np.ndarray = field(default_factory=lambda: np.zeros(2, dtype=np.float32))

    def weights(self) -> tuple[np.ndarray, float]:
        """What each feature adds to the log-odds of class 1, and the log-odds without features."""
        return (self.embeddings @ (self.output[1] - self.output[0])).astype(np.float64), float(self.bias[1] - self.bias[0])


def train(rows: list[tuple[int, np.ndarray, np.ndarray]], epochs: int = 12, rate: float = 0.5, batch: int = 16, seed: int = 7) -> Model:
    """Fit to (label, features, counts) rows: a document is the mean of its features' vectors, a softmax layer reads
    it, and both are learned by stochastic gradient descent with a falling rate."""
    rng = np.random.default_rng(seed)
    m = Model()
    m.embeddings = (rng.random(m.embeddings.shape, dtype=np.float32) - 0.5) / DIM
    rows = [r for r in rows if len(r[1])]
    if len({r[0] for r in rows}) < 2:
        share = (sum(r[0] for r in rows) + 1) / (len(rows) + 2)
        m.bias[1] = math.log(share / (1 - share))
        return m
    share = sum(r[0] for r in rows) / len(rows)
    m.bias[1] = math.log(share / (1 - share))
    steps, done = epochs * math.ceil(len(rows) / batch), 0
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for lo in range(0, len(rows), batch):
            part = [rows[i] for i in order[lo : lo + batch]]
            ids = np.concatenate([r[1] for r in part])
            share_of = np.concatenate([r[2] / r[2].sum() for r in part]).astype(np.float32)
            cuts = np.concatenate(([0], np.cumsum([len(r[1]) for r in part])[:-1]))
            doc = np.add.reduceat(m.embeddings[ids] * share_of[:, None], cuts)
            z = doc @ m.output.T + m.bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(part)), [r[0] for r in part]] -= 1
            lr = rate * (1 - done / steps)
            back = np.repeat(p @ m.output, np.diff(np.append(cuts, len(ids))), axis=0) * share_of[:, None]
            m.output -= lr * p.T @ doc
            m.bias -= lr * 0.1 * p.sum(0)
            np.subtract.at(m.embeddings, ids, np.float32(lr * 20) * back)  # a feature's share of a document is small
            done += 1
    return m


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """A text's distinct features and their counts."""
    words = text.split()
    have: list[int] = []
    for w in words:
        have += features(w)
    ids, n = np.unique(np.array(have + [AGAIN] * repeats(words), dtype=np.int32), return_counts=True)
    return ids, n.astype(np.int32)


def fit(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = 2000) -> Model:
    """Train on at most ``most`` rows of each label for which ``learn`` (over ``labels``) holds.

    Executors turn the sampled texts into feature counts; the driver gets those of at most ``2 * most`` documents.
    Sampling by label shifts the shares of labels, so the biases are set back by the shares among all learnt rows.
    """
    chosen = sample(labels, id_col, label_col, learn, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [counted(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([f[k].tobytes() for f in found], pa.binary()) for k in (0, 1))], ["label", "ids", "n"])

    rows = texts_of(docs, chosen, id_col, text_col).mapInArrow(run, "label int, ids binary, n binary").toArrow()
    data = [(y, np.frombuffer(i, dtype=np.int32), np.frombuffer(n, dtype=np.int32)) for y, i, n in zip(*(rows.column(c).to_pylist() for c in range(3)))]
    data.sort(key=lambda r: (r[0], r[1].tobytes(), r[2].tobytes()))
    model = train(data)
    ones, zeros = labels.filter(learn).agg(F.count(F.when(F.col(label_col) == 1, 1)), F.count(F.when(F.col(label_col) == 0, 1))).first()
    got = sum(y for y, *_ in data)
    if ones and zeros and 0 < got < len(data):
        model.bias[1] += math.log(ones / zeros) - math.log(got / (len(data) - got))
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, score``: the probability of label 1 of every whole text, without a shuffle.

    A text's log-odds is linear in its features, so a word needs one sum, kept in a bounded cache. Null and empty
    texts get the model's score of a text without words. Other columns are ignored; an empty table gives an empty
    result.
    """
    weights, bias = model.weights()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = weights.tolist()

        def summed(word: str) -> complex:
            have = features(word)
            return complex(sum(map(w.__getitem__, have)), len(have))  # their sum and number

        known = Recent(summed)

        def one(text: str) -> float:
            words = text.split()
            total = sum(map(known.__getitem__, words), 0j)
            again = repeats(words)
            x = bias + ((total.real + again * w[AGAIN]) / (total.imag + again) if words else 0.0)
            return 1 / (1 + math.exp(-max(-500.0, min(500.0, x))))

        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([one(t) for t in b.column(1).to_pylist()], pa.float64())], ["id", "score"])

    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, score double").withColumnRenamed("id", id_col)
