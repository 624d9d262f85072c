"""Licence scans: an Aho-Corasick automaton finds notice phrases and identifier tags, a shunting-yard parser evaluates
licence expressions."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Notice phrases, in words, and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Further phrases of the method, and their labels.
MORE_PHRASES = {
    "gnu lesser general public license": "lgpl", "gnu affero general public license": "agpl", "mozilla public license": "mpl", "bsd 2 clause": "bsd", "bsd 3 clause": "bsd", "bsd license": "bsd",
    "eclipse public license": "epl", "creative commons attribution": "cc-by", "creative commons zero": "cc0", "cc0 1 0": "cc0", "isc license": "isc", "public domain": "public-domain", "all rights reserved": "all-rights-reserved",
}
#: The tag before a licence expression, in words.
TAG = "spdx license identifier"
#: Licence identifiers by their first part, and how permissive they are from 0 to 1.
FAMILIES = {
    "gpl": ("gpl", 0.3), "agpl": ("agpl", 0.1), "lgpl": ("lgpl", 0.5), "apache": ("apache", 1.0), "mit": ("mit", 1.0), "mpl": ("mpl", 0.6), "bsd": ("bsd", 1.0), "epl": ("epl", 0.6), "isc": ("isc", 1.0), "unlicense": ("public-domain", 1.0),
    "cc0": ("cc0", 1.0), "cc-by": ("cc-by", 0.9), "cc-by-sa": ("cc-by", 0.5), "cc-by-nc": ("cc-by", 0.2), "cc-by-nd": ("cc-by", 0.2), "cc-by-nc-sa": ("cc-by", 0.2), "cc-by-nc-nd": ("cc-by", 0.1),
    "public-domain": ("public-domain", 1.0), "all-rights-reserved": ("all-rights-reserved", 0.0),
}
#: What a WITH exception adds, and what an identifier of no known family counts as.
EXCEPTION, UNKNOWN = 0.2, 0.5

#: Bytes of UTF-8 after lower-casing A-Z: other ASCII than digits and letters becomes a space, the rest stays.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_TAG_LINE = re.compile(r"spdx-license-identifier\s*:\s*([^\n\r*#<>\"]+)", re.I)
_PART = re.compile(r"\(|\)|[A-Za-z0-9][A-Za-z0-9.+\-]*")
_RANK = {"or": 1, "and": 2, "with": 3}
#: Prose that follows an identifier and means its own later versions, no second licence.
_LATER = re.compile(r"\s+or\s+(?:\(at\s+your\s+option\)\s+)?(?:any\s+)?later(?:\s+versions?)?(?![\w.+-])", re.I)


def words_of(text: str) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased, in UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split()


def family(identifier: str) -> tuple[str, float]:
    """The label and permissiveness of an identifier such as ``GPL-3.0-only``."""
    name = identifier.lower().removesuffix("+")
    while name:
        if name in FAMILIES:
            return FAMILIES[name]
        name = name.rpartition("-")[0]
    return "other", UNKNOWN


def evaluate(expression: str) -> tuple[set[str], float] | None:
    """Labels and permissiveness of a licence expression, by Dijkstra's shunting yard; None if it is malformed.

    "or any later version" after an identifier belongs to it. WITH binds tighter than AND, AND tighter than OR. AND obliges to both, so it takes the lower value; OR is a
    choice and takes the higher; WITH adds an exception to the licence on its left.
    """
    values: list[tuple[set[str], float]] = []
    waiting: list[str] = []

    def apply(op: str) -> None:
        (right, y), (left, x) = values.pop(), values.pop()
        values.append((left, min(1.0, x + EXCEPTION)) if op == "with" else (left | right, min(x, y) if op == "and" else max(x, y)))

    operand = True  # whether a licence is due next
    for part in _PART.findall(_LATER.sub("", expression)):
        low = part.lower()
        if low == "(":
            if not operand:
                break
            waiting.append(low)
        elif low == ")":
            if operand:
                return None
            while waiting and waiting[-1] != "(":
                apply(waiting.pop())
            if not waiting:
                break
            waiting.pop()
        elif low in _RANK:
            if operand:
                return None
            while waiting and waiting[-1] != "(" and _RANK[waiting[-1]] >= _RANK[low]:
                apply(waiting.pop())
            waiting.append(low)
            operand = True
        else:
            if not operand:
                break  # prose after the expression
            label, x = family(part)
            values.append(({label}, x))
            operand = False
    if operand or "(" in waiting:
        return None
    while waiting:
        apply(waiting.pop())
    return values[0]


@lru_cache(1)
def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for phrase, label in [*MORE_PHRASES.items(), *PHRASES.items(), (TAG, None)]:
        a.add_word(f" {phrase} ", (phrase, len(phrase) + 2, label))
    a.make_automaton()
    return a


def scan(text: str) -> tuple[int, list[tuple[int, str, str]], list[str]]:
    """Number of words; hits (first word, phrase, label); and the expressions after identifier tags."""
    words = words_of(text)
    joined = (b" " + b" ".join(words) + b" ").decode("latin-1")
    hits, tagged = [], False
    at = seen = 0
    for end, (phrase, length, label) in sorted(_automaton().iter(joined), key=lambda x: x[0] - x[1][1]):
        start = end - length + 1
        seen += joined.count(" ", at, start)
        at = start
        if label is None:
            tagged = True
        else:
            hits.append((seen, phrase, label))
    return len(words), hits, [m[1].strip() for m in _TAG_LINE.finditer(text)] if tagged else []


def judge(text: str | None) -> tuple[int, list[int], set[str], set[str], float]:
    """Words, starts of base phrases, base labels, all labels, and the permissiveness score.

    The score is 0 without any licence, else the mean of 1 and the lowest permissiveness of what was found, so that
    any licence scores at least 0.5.
    """
    n, hits, expressions = scan(text or "")
    base = [(w, x) for w, phrase, x in hits if phrase in PHRASES]
    labels = {x for *_, x in hits}
    least = min((FAMILIES[x][1] for x in labels), default=1.0)
    for e in expressions:
        if found := evaluate(e):
            labels |= found[0]
            least = min(least, found[1])
    return n, [w for w, _ in base], {x for _, x in base}, labels, 0.5 + least / 2 if labels else 0.0


_OUT = "id {id}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Licence notices and tags of every whole text, one row per document, without a shuffle.

    Returns ``id_col, n_words, n_base, first_word, last_word, base_labels, labels, score``: words counted from 0,
    ``n_base`` all places of base phrases, labels distinct, sorted and comma-joined (empty strings if none), and
    the score of :func:`judge`. Null and empty texts have 0 words and no labels. Ids may be null or repeated; each
    row is judged alone. Other columns are ignored; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [judge(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array([x[0] for x in found], pa.int64()),
                    pa.array([len(x[1]) for x in found], pa.int64()),
                    pa.array([min(x[1], default=None) for x in found], pa.int64()),
                    pa.array([max(x[1], default=None) for x in found], pa.int64()),
                    pa.array([",".join(sorted(x[2])) for x in found], pa.string()),
                    pa.array([",".join(sorted(x[3])) for x in found], pa.string()),
                    pa.array([x[4] for x in found], pa.float64()),
                ],
                ["id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
            )

    return rows.mapInArrow(run, _OUT.format(id=dict(rows.dtypes)["id"])).withColumnRenamed("id", id_col)
