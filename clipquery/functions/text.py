"""Text functions as column expressions: everything stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters, digits and underscores, hyphens inside; character classes, as \\w and \\b differ between engines.
TOKEN = r"[\p{L}\p{N}_](?:[\p{L}\p{N}_-]*[\p{L}\p{N}_])?"
# Keywords of question types, and those by which a text suits a type.
PROCEDURAL = ("how to", "steps", "procedure", "perform", "examine")
DIAGNOSTIC = ("diagnose", "identify", "assess", "evaluate", "symptoms")
FACTOID = ("what is", "what are", "when", "where", "which")
ALIGNMENT = {
    "procedural": ("step", "first", "then", "next", "finally", "procedure", "method"),
    "diagnostic": ("symptom", "sign", "diagnosis", "assess", "evaluate", "test"),
    "factoid": ("is", "are", "definition", "means", "called", "refers"),
}
NEGATIONS = ("not", "never", "avoid", "no", "cannot")


def tokens(text: Column) -> Column:
    """Search tokens of the lower-cased text."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def words(text: Column) -> Column:
    """White-space separated words."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def contains_any(text: Column, terms: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for t in terms:
        found = found | text.contains(t)
    return found


def question_type(question: Column) -> Column:
    """procedural, diagnostic, factoid or general, by keywords in that order."""
    q = F.lower(question)
    return F.when(contains_any(q, PROCEDURAL), "procedural").when(contains_any(q, DIAGNOSTIC), "diagnostic").when(contains_any(q, FACTOID), "factoid").otherwise("general")


def alignment(kind: Column, text: Column) -> Column:
    """How much of a question type's vocabulary the text has: keywords / 3, at most 1; 0.5 for general ones."""
    t = F.lower(F.coalesce(text, F.lit("")))
    score = F.when(text.isNull(), 0.0)
    for k, terms in ALIGNMENT.items():
        hits = sum((t.contains(x).cast("int") for x in terms), F.lit(0))
        score = score.when(kind == k, F.least(hits / F.lit(3.0), F.lit(1.0)))
    return score.otherwise(0.5)


def entities(text: Column) -> Column:
    """Stand-in for a tagger: the distinct ones of the first 20 ASCII words of four letters or more."""
    plain = F.filter(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), lambda w: w.rlike("^[A-Za-z]{4,}$"))
    return F.array_distinct(F.slice(plain, 1, 20))


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two sets; 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)).cast("double"))


def sentences(text: Column) -> Column:
    """Sentences, abbreviations such as ``Dr.`` or ``MRI.`` kept inside them."""
    marked = F.regexp_replace(F.regexp_replace(text, r"(^|[^\p{L}\p{N}_])([A-Z][a-z]*\.)", "$1$2<PROT>"), r"(^|[^\p{L}\p{N}_])([A-Z]{2,}\.)", "$1$2<PROT>")
    parts = F.filter(F.split(marked, r"[.!?]+\s+"), lambda s: F.trim(s) != "")
    return F.transform(parts, lambda s: F.trim(F.replace(s, F.lit("<PROT>"), F.lit(""))))


def plain_words(text: Column) -> Column:
    """Distinct words of a-z only, as a set."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), lambda w: w.rlike("^[a-z]+$")))


def negation_conflict(a: Column, b: Column, least: int = 20, share: float = 0.5) -> Column:
    """Whether exactly one of two word sets negates, and they share many words."""
    neg = F.array(*(F.lit(n) for n in NEGATIONS))
    one, two = F.arrays_overlap(a, neg), F.arrays_overlap(b, neg)
    common = F.size(F.array_except(F.array_intersect(a, b), neg))
    return (one != two) & (common > least) & (common / F.least(F.size(a), F.size(b)).cast("double") > share)


def measures(text: Column) -> Column:
    """(number, unit) pairs of a text; the unit is the letters after the number."""
    number = r"(\d+\.?\d*)\s*([a-z/%]+)"
    low = F.lower(text)
    value, unit = F.regexp_extract_all(low, F.lit(number), F.lit(1)), F.regexp_extract_all(low, F.lit(number), F.lit(2))
    return F.zip_with(value, unit, lambda v, u: F.struct(v.cast("double").alias("v"), u.alias("u")))


def numeric_conflict(a: Column, b: Column, off: float = 0.2) -> Column:
    """Whether two lists of measures have one unit with values that differ by more than ``off`` of the larger."""
    apart = lambda x, y: (x["u"] == y["u"]) & F.coalesce(F.abs(x["v"] - y["v"]) / F.nullif(F.greatest(x["v"], y["v"]), F.lit(0.0)) > off, F.lit(False))
    return F.exists(a, lambda x: F.exists(b, lambda y: apart(x, y)))


def clock(seconds: Column) -> Column:
    """``mm:ss`` without hours."""
    s = F.floor(seconds).cast("int")
    return F.format_string("%02d:%02d", (s / 60).cast("int"), s % 60)


def clock_range(start: Column, end: Column) -> Column:
    return F.when(start.isNull() | end.isNull(), "unknown").otherwise(F.concat(clock(start), F.lit("-"), clock(end)))


def seconds_range(start: Column, end: Column) -> Column:
    return F.when(start.isNull() | end.isNull(), "unknown time").otherwise(F.format_string("%.2fs - %.2fs", start, end))


def parse_clock(text: Column) -> Column:
    """Seconds of ``MM:SS``, ``HH:MM:SS`` or a plain number; 0 for anything else."""
    p = F.split(text, ":")
    n = lambda i: F.element_at(p, i).try_cast("double")
    return F.coalesce(F.when(F.size(p) == 2, n(1) * 60 + n(2)).when(F.size(p) == 3, n(1) * 3600 + n(2) * 60 + n(3)).otherwise(text.try_cast("double")), F.lit(0.0))


def snippet(text: Column, n: int, mark: str = "...") -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit(mark))).otherwise(text)


def token_estimate(text: Column) -> Column:
    return F.floor(F.length(text) / 4).cast("long")


def file_name(text: Column) -> Column:
    return F.regexp_replace(text, "[^A-Za-z0-9]+", "_")


def evidence_number(claim: Column) -> Column:
    """The number of an ``Evidence N`` or ``Video N`` mark, null without one."""
    n = F.regexp_extract(claim, r"(?i)\[?(?:Evidence|Video)\s+(\d+)\]?", 1)
    return F.when(n != "", n.cast("int"))


def support_level(similarity: Column, claim: Column, evidence: Column) -> Column:
    c, e = F.lower(claim), F.lower(evidence)
    return F.when(similarity < 0.3, "UNSUPPORTED").when(e.contains(c) | c.contains(e) | (similarity >= 0.7), "HIGH").when(similarity >= 0.5, "MEDIUM").otherwise("LOW")
