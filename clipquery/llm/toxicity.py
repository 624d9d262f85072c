"""Toxicity: Levenshtein automata intersected with a lexicon trie, and scores of the words around each match."""

from __future__ import annotations

import functools
import math
import operator
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipquery.llm.bytes_view import U64, mixed
from clipquery.llm.cache import Recent
from clipquery.llm.common import materialize
from clipquery.llm.labelled import sample, texts_of

WORD = re.compile(r"[^\W_]+")
#: Lengths of stems that are tried as terms, and the least number of sampled toxic documents that hold a term.
STEMS, SUPPORT = range(3, 13), 5
#: Least hashes of a text that is learnt from, and how many of them related texts share: near copies and texts with a
#: long passage in common are no independent evidence.
HASHES, ALIKE = 32, 2
#: Share of learnt patterns that may be there by chance.
CHANCE = 0.05
#: Toxic documents that are taken to hold a misspelling of a word before any is seen.
PRIOR = 4
#: Words on either side of a match that tell quotation from abuse.
WINDOW = 8
QUOTING = frozenset("said says say quote quoted quotes quoting wrote writes called cited reported term word slur example known refers meaning dijo dice citó palabra sagte sagt zitat wort schrieb dit cite mot écrit".split())
ADDRESS = frozenset("you your youre yourself he she they them him her tu te vous toi du dich ihr euch dein usted ustedes eres".split())
_OPEN, _CLOSE = re.compile(r"[\"“„«‘]\s*$|(?:^|\s)'$"), re.compile(r"^\s*[\"”“»’']")


class Trie:
    """A lexicon of terms; a node is (children, number of its term or -1)."""

    def __init__(self, terms: list[str]) -> None:
        self.root: tuple[dict, list[int]] = ({}, [-1])
        for i, t in enumerate(terms):
            node = self.root
            for c in t:
                node = node[0].setdefault(c, ({}, [-1]))
            node[1][0] = i

    def near(self, word: str, most: int) -> tuple[int, int] | None:
        """(distance, term) of the nearest term within ``most`` edits of the word, ties to the smaller number."""
        return min(((d, t) for t, d in self.within(word, most).items()), default=None)

    def within(self, word: str, most: int) -> dict[int, int]:
        """term -> distance of all terms within ``most`` edits of the word.

        The word's Levenshtein automaton is walked together with the trie. A state is the set of (place in the word,
        edits so far) pairs that no other pair makes needless; a branch ends when no pair is left.
        """
        n, found = len(word), {}
        stack = [(self.root, {i: i for i in range(min(most, n) + 1)})]
        while stack:
            (below, term), state = stack.pop()
            if term[0] >= 0 and n in state:
                found[term[0]] = state[n]
            for c, child in below.items():
                new: dict[int, int] = {}
                for i in sorted(state):
                    e = state[i]
                    for j, x in ((i, e + 1), (i + 1, e if i < n and word[i] == c else e + 1)):  # extra in term; match or swap
                        if j <= n and x <= most and x < new.get(j, most + 1):
                            new[j] = x
                for j in range(n):  # missing from term
                    if j in new and new[j] < most and new[j] + 1 < new.get(j + 1, most + 1):
                        new[j + 1] = new[j] + 1
                if new:
                    stack.append((child, new))
        return found


def shortened(word: str) -> set[str]:
    """The word and what is left of it without one of its characters; words within one edit have one in common."""
    return {word} | {word[:i] + word[i + 1 :] for i in range(len(word))}


class Nearby:
    """Terms within one edit of a word, or two for terms of nine letters or more.

    Most words are ruled out before: words within one edit of a term share a shortened form with it, and two edits
    leave a long term's first or last third at the word's start or end or its middle third nearby. Only words that
    pass walk their automaton through the trie.
    """

    def __init__(self, terms: list[str]) -> None:
        self.terms = terms
        self.long = [t for t in terms if len(t) >= 9]
        self.tries = Trie(terms), Trie(self.long)
        self.least, self.most = min(map(len, terms), default=9) - 1, max(map(len, terms), default=-9) + 2
        self.forms = {f for t in terms for f in shortened(t)}
        third = [(t[: len(t) // 3], t[len(t) // 3 : -(len(t) // 3)], t[-(len(t) // 3) :]) for t in self.long]
        self.heads, self.tails = tuple({a for a, _, _ in third}), tuple({c for _, _, c in third})
        self.inner = re.compile("|".join(map(re.escape, sorted({m for _, m, _ in third})))) if third else None

    def all(self, word: str) -> list[tuple[int, str]]:
        """(distance, term) of each term nearby, in ascending order."""
        if not self.least <= len(word) <= self.most:
            return []
        found: dict[str, int] = {}
        if self.long and len(word) >= 7 and (word.startswith(self.heads) or word.endswith(self.tails) or self.inner.search(word)):
            found = {self.long[t]: d for t, d in self.tries[1].within(word, 2).items()}
        if not self.forms.isdisjoint(shortened(word)):
            found |= {self.terms[t]: d for t, d in self.tries[0].within(word, 1).items()}
        return sorted((d, t) for t, d in found.items())

    def best(self, word: str) -> tuple[int, str] | None:
        return next(iter(self.all(word)), None)


@dataclass
class Lexicon:
    """Words and stems with the log-odds of a toxic document that holds them, those of misspelled words by (word,
    distance), and the weights of their sum."""

    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    loose: dict[tuple[str, int], float] = field(default_factory=dict)
    bias: float = -2.0
    slope: float = 1.0

    def exact(self) -> Callable[[str], tuple]:
        """word -> (weight, 0, term) of the word itself or its longest stem, or ()."""
        lengths = sorted({len(x) for x in self.stems}, reverse=True)

        def find(word: str) -> tuple:
            if word in self.words:
                return self.words[word], 0, word
            return next(((self.stems[word[:k]], 0, word[:k]) for k in lengths if word[:k] in self.stems), ())

        return find

    def matcher(self) -> Recent:
        """word -> (weight, distance, term) of its best term, or () without one; of terms nearby the one that its
        misspellings weigh most."""
        exact, near = self.exact(), Nearby(sorted({term for (term, _), x in self.loose.items() if x > 0}))

        def match(word: str) -> tuple:
            if found := exact(word):
                return found
            x, d, term = max(((self.loose.get((t, d), 0.0), -d, t) for d, t in near.all(word)), default=(0.0, 0, ""))
            return (x, -d, term) if x > 0 else ()

        return Recent(match)

    def hits(self, text: str, match: Recent) -> list[tuple[int, str, int, float]]:
        """(place in the lower-cased text, word, distance, weight in its context) of each match."""
        low = text.lower()
        words = WORD.findall(low)
        found = [i for i, m in enumerate(map(match.__getitem__, words)) if m and m[0]]
        if not found:
            return []
        spans = [m.span() for m in WORD.finditer(low)]
        return [(spans[i][0], words[i], match[words[i]][1], match[words[i]][0] * context(low, words, spans, i)) for i in found]

    def feature(self, text: str, match: Recent) -> float:
        """Log sum of the weights of all matches."""
        return math.log1p(sum(x for *_, x in self.hits(text, match)))

    def score(self, text: str, match: Recent) -> float:
        return 1 / (1 + math.exp(-(self.bias + self.slope * self.feature(text, match))))


def context(text: str, words: list[str], spans: list[tuple[int, int]], i: int) -> float:
    """What the words around a match leave of its weight: quotation marks around it or words of quoting lower it to a
    half or a quarter, words that address somebody raise it by a half."""
    a, b = spans[i]
    near = words[max(0, i - WINDOW) : i] + words[i + 1 : i + 1 + WINDOW]
    quoted = bool(_OPEN.search(text[max(0, a - 3) : a]) and _CLOSE.search(text[b : b + 3]))
    reported = any(w in QUOTING for w in near)
    x = 0.25 if quoted and reported else 0.5 if quoted or reported else 1.0
    return x * 1.5 if not quoted and any(w in ADDRESS for w in near) else x


def evidence(t: Any, c: Any, p: float, log: Callable = np.log) -> Any:
    """Chernoff's bound on how likely chance deals ``t`` or more of ``t + c`` documents to toxic ones, whose share is p,
    as a negative logarithm; for numbers, arrays or columns. It holds where t / (t + c) is above p."""
    n = t + c
    return t * log(t / (n * p)) + c * log((c + 1e-9) / (n * (1 - p)))


def least_evidence(t: np.ndarray, c: np.ndarray, many: np.ndarray, p: float) -> float:
    """The evidence from which patterns count, by Benjamini and Hochberg's rule: of those that pass, ``CHANCE`` at most
    are expected to be there by chance. ``many`` patterns have the counts ``t, c``; all compete, so the more terms a
    table has, the rarer ones pass."""
    x = np.where(t > p * (t + c), evidence(np.maximum(t, 1), c, p), 0.0)
    by = np.argsort(-x, kind="stable")
    x, upto = x[by], np.cumsum(many[by])
    passes = np.flatnonzero(np.exp(-x) <= CHANCE * upto / max(1, many.sum()))
    return float(x[passes[-1]]) if len(passes) else math.inf


def signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``label, least, signature``: ``HASHES`` least hashes of a text's five-word strings."""
    odd = mixed(np.arange(1, HASHES + 1, dtype=U64)) | U64(1)
    for b in batches:
        out = []
        for text in b.column(b.schema.get_field_index("text")).to_pylist():
            h = np.array([zlib.crc32(w.encode()) for w in WORD.findall(text.lower())], dtype=U64)
            for _ in range(4):
                h = h[:-1] * U64(0x9E3779B97F4A7C15) + mixed(h[1:]) if len(h) > 1 else h
            out.append([int(mixed(h * k).min().astype(np.int64)) for k in odd] if len(h) else [])
        yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("label")), b.column(b.schema.get_field_index("least")), pa.array(out, pa.list_(pa.int64()))], ["label", "least", "signature"])


def related(rows: list[tuple[int, int, list[int]]]) -> list[tuple[int, int]]:
    """(label, least) of the texts that share ``ALIKE`` least hashes or more with an earlier one of their label that stays."""
    owners: dict[tuple, list[int]] = defaultdict(list)
    drop = []
    for i, (label, least, signature) in enumerate(rows):
        keys = [(label, k, x) for k, x in enumerate(signature)]
        shared = Counter(j for key in keys for j in owners.get(key, ()))
        if max(shared.values(), default=0) >= ALIKE:
            drop.append((label, least))
        else:
            for key in keys:
                owners[key].append(i)
    return drop


def learn_terms(rows: list[tuple[str, int, int]], toxic: int, clean: int, ratio: float) -> tuple[dict[str, float], dict[str, float]]:
    """Words and stems from (pattern, toxic documents, clean documents); stems end in ``*``.

    ``ratio`` is how many clean documents a sampled clean one stands for, against toxic ones. A term's weight is its
    documents' log-odds. A stem counts if no longer one is in as many toxic documents; words and stems that begin with
    a counted stem count only if they weigh clearly more.
    """
    weight = lambda t, c: math.log((t + 0.5) / (c * ratio + 0.5))
    table = {p: (t, c) for p, t, c in rows}
    good = {p: x for p, (t, c) in table.items() if t >= SUPPORT and (x := weight(t, c)) > 1.5 and t / max(1, toxic) > 10 * c / max(1, clean)}
    longer: dict[str, int] = {}
    for p, (t, _) in table.items():
        if p.endswith("*") and len(p) > STEMS[0] + 1:
            longer[p[:-2] + "*"] = max(longer.get(p[:-2] + "*", 0), t)
    stems: dict[str, float] = {}
    over = lambda p, most: max((stems[p[:k]] for k in STEMS if k <= most and p[:k] in stems), default=-9.0)
    for p in sorted((p for p in good if p.endswith("*")), key=len):
        s, t = p[:-1], table[p][0]
        if longer.get(p, 0) < t and good[p] > over(s, len(s) - 1) + 1 and table.get(s, (0, 0))[0] < 0.8 * t:
            stems[s] = min(good[p], 6.0)
    words = {p: min(x, 6.0) for p, x in good.items() if not p.endswith("*") and x > over(p, len(p)) + 0.5}
    return words, stems


def fit(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = 2000) -> Lexicon:
    """Learn a lexicon and weights from at most ``most`` rows of each label for which ``learn`` (over ``labels``) holds.

    Executors count in how many sampled documents each word and stem is, then how often misspellings of each word are
    in them: those that clean documents hold too, as ordinary words, get no weight. A word or stem is a
    term if ``SUPPORT`` toxic documents hold it and clean ones so few that chance is unlikely. The driver gets what the
    sampled documents bound: their signatures, a histogram of counts, the terms and the words under stems, two counts
    per term and distance, and a number per document for the logistic weights. Without rows of both labels the lexicon
    stays empty.
    """
    chosen = sample(labels, id_col, label_col, learn, most)
    # Near copies mostly share the sentence of least hash; one text of each stays, or every word of a text that is
    # often copied would seem a term.
    sentences = F.filter(F.split(F.lower("text"), r"[.!?\n]+"), lambda s: F.length(s) >= 12)
    least = F.coalesce(F.array_min(F.transform(sentences, lambda s: F.xxhash64(F.trim(s)))), F.xxhash64("text"))
    texts = texts_of(docs, chosen, id_col, text_col).withColumn("least", least)
    texts = materialize(texts.groupBy("label", "least").agg(F.min("text").alias("text")), "toxicity-sample").repartition(8)
    signed = texts.mapInArrow(signatures, "label int, least long, signature array<long>").collect()
    drop = related(sorted(map(tuple, signed)))
    texts = texts.join(F.broadcast(docs.sparkSession.createDataFrame(drop, "label int, least long")), ["label", "least"], "left_anti").select("label", "text")

    def patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n: tuple[Counter, Counter] = (Counter(), Counter())
            for y, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = {w for w in WORD.findall(text.lower()) if 3 <= len(w) <= 40}
                n[y].update(words | {w[:k] + "*" for w in words for k in STEMS if k <= len(w)})
            every = list(n[0].keys() | n[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(every, pa.string()), pa.array([n[1][p] for p in every], pa.int64()), pa.array([n[0][p] for p in every], pa.int64())], ["pattern", "t", "c"])

    ones, zeros = labels.filter(learn).agg(F.count(F.when(F.col(label_col) == 1, 1)), F.count(F.when(F.col(label_col) == 0, 1))).first()
    toxic, clean = texts.agg(F.count(F.when(F.col("label") == 1, 1)), F.count(F.when(F.col("label") == 0, 1))).first()
    if not toxic or not clean:
        return Lexicon()
    ratio = (zeros / clean) / (ones / toxic)
    counts = materialize(texts.mapInArrow(patterns, "pattern string, t long, c long").groupBy("pattern").agg(F.sum("t").alias("t"), F.sum("c").alias("c")), "toxicity-patterns")
    tested = counts.filter(F.col("t") + F.col("c") >= SUPPORT)
    sizes = np.array(tested.groupBy("t", "c").count().collect(), dtype=float).reshape(-1, 3)
    share = toxic / (toxic + clean)
    least = least_evidence(*sizes.T, share)
    t, c = F.col("t"), F.col("c")
    found = tested.filter((t >= SUPPORT) & (t / toxic > 10 * c / clean) & (evidence(t, c, share, F.log) >= F.lit(least - 1e-9))).orderBy(t.desc(), "pattern")
    rows = [tuple(r) for r in found.collect()]
    lexicon = Lexicon(*learn_terms(rows, toxic, clean, ratio))
    # Misspellings are looked for of words, stems and, however rare, the full words under a stem.
    learnt = lexicon.stems | lexicon.words
    if lexicon.stems:
        of = defaultdict(list)
        for x in lexicon.stems:
            of[len(x)].append(x)
        under = functools.reduce(operator.or_, (F.substring("pattern", 1, k).isin(xs) for k, xs in of.items()))
        for p, in counts.filter((t / toxic > 10 * c / clean) & ~F.col("pattern").endswith("*") & under).select("pattern").collect():
            learnt.setdefault(p, lexicon.exact()(p)[0])
    lexicon.loose = {(w, d): 0.0 for w in learnt for d in (1, 2)[: 1 + (len(w) >= 9)]}

    def misspelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        exact, near = lexicon.exact(), Nearby(sorted(learnt))
        nearby = Recent(lambda w: () if exact(w) else tuple((t, d) for d, t in near.all(w)))
        for b in batches:
            n: Counter = Counter()
            for y, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                n.update({(*m, y) for w in WORD.findall(text.lower()) for m in nearby[w]})
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in n], pa.string()), pa.array([k[1] for k in n], pa.int32()), pa.array([v * k[2] for k, v in n.items()], pa.int64()), pa.array([v * (1 - k[2]) for k, v in n.items()], pa.int64())], ["term", "distance", "t", "c"])

    seen = texts.mapInArrow(misspelled, "term string, distance int, t long, c long").groupBy("term", "distance").agg(F.sum("t"), F.sum("c"))
    odds = {(term, d): (t, c) for term, d, t, c in seen.collect()}
    for term, d in lexicon.loose:  # at first as if PRIOR toxic documents held a misspelling
        t, c = odds.get((term, d), (0, 0))
        lexicon.loose[term, d] = max(0.0, min(learnt[term] - 1, math.log((min(t, PRIOR) + PRIOR) / (2 * c * ratio + 0.5))))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = lexicon.matcher()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([lexicon.feature(t, match) for t in b.column(1).to_pylist()], pa.float64())], ["label", "x"])

    rows = sorted(tuple(r) for r in texts.mapInArrow(features, "label int, x double").collect())
    y, x = np.array([r[0] for r in rows], dtype=float), np.array([[1.0, r[1]] for r in rows])
    weigh, w = np.where(y == 1, 1.0, ratio), np.array([-2.0, 1.0])
    for _ in range(300):  # Newton's method with a small penalty
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weigh * (p - y)) + 0.5 * (w - [0, 2.0])
        step = np.linalg.solve((x * (weigh * p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(2), g)
        w -= np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-8:
            break
    lexicon.bias, lexicon.slope = float(w[0]), max(0.0, float(w[1]))
    return lexicon


def score(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text", with_hits: bool = False) -> DataFrame:
    """``id_col, score``: the probability of a toxic label of every whole text, without a shuffle; ``with_hits`` adds
    ``hits``, (place, word, distance, weight) of each match.

    Null and empty texts get the score of a text without matches. Other columns are ignored; an empty table gives an
    empty result.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    kind = pa.list_(pa.struct([("place", pa.int32()), ("word", pa.string()), ("distance", pa.int32()), ("weight", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = lexicon.matcher()
        for b in batches:
            texts = b.column(1).to_pylist()
            cols = [b.column(0), pa.array([lexicon.score(t, match) for t in texts], pa.float64())]
            if with_hits:
                cols.append(pa.array([[dict(zip(("place", "word", "distance", "weight"), h)) for h in lexicon.hits(t, match)] for t in texts], kind))
            yield pa.RecordBatch.from_arrays(cols, ["id", "score", *["hits"] * with_hits])

    schema = f"id {dict(rows.dtypes)['id']}, score double" + (", hits array<struct<place: int, word: string, distance: int, weight: double>>" if with_hits else "")
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def drop_toxic(docs: DataFrame, lexicon: Lexicon, text_col: str = "text", limit: float = 0.5) -> DataFrame:
    """The documents whose score is below ``limit``, all columns as they were, without a shuffle."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = lexicon.matcher()
        for b in batches:
            yield b.filter(pa.array([lexicon.score(t or "", match) < limit for t in b.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
