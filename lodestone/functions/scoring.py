"""Similarities, scores and keywords."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no topic.
STOPWORDS = """
with from this that using study analysis data model results effect effects group patient patients journal paper article
when where which into under over such been have were their than small broad class methods including standard number positive these also
both each more most other some while well many across based novel
""".split()
#: The first 18 of them, for lexical relevance.
TOPIC_STOPWORDS = STOPWORDS[:18]


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 if either has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def relevance_score(similarity: Column) -> Column:
    """0 to 10, two places."""
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(10.0), 10.0 * similarity)), 2)


def relevance_tier(score: Column) -> Column:
    return F.when(score >= 8, "high").when(score >= 6, "moderate").when(score >= 4, "low").otherwise("irrelevant")


def lexical_relevance(target: Column, candidate: Column) -> Column:
    """Share of the target's words (4 letters on, without stop words) that the candidate has; 1 if there are none.

    Words are letters, numbers and underscores of any script; a combining mark ends a word.
    """
    stop = F.array(*map(F.lit, TOPIC_STOPWORDS))
    t = F.array_except(F.array_distinct(F.regexp_extract_all(F.lower(target), F.lit(r"([\p{L}\p{N}_]{4,})"), 1)), stop)
    c = F.array_distinct(F.regexp_extract_all(F.lower(candidate), F.lit(r"([\p{L}\p{N}_]{3,})"), 1))
    return F.when(F.size(t) == 0, 1.0).otherwise(F.size(F.array_intersect(t, c)) / (F.size(t) + F.lit(1e-5)))


def keywords(c: Column, limit: int = 10) -> Column:
    """The first distinct words of 4 letters on that aren't stop words, in their first spelling, joined by a space."""
    words = F.regexp_extract_all(c, F.lit(r"([A-Za-z][A-Za-z\-]{3,})"), 1)
    none = F.array().cast("array<string>")

    def step(acc: Column, w: Column) -> Column:
        low = F.lower(w)
        full = (F.size(acc["low"]) >= limit) | low.isin(STOPWORDS) | F.array_contains(acc["low"], low)
        return F.when(full, acc).otherwise(F.struct(F.array_append(acc["low"], low).alias("low"), F.array_append(acc["out"], w).alias("out")))

    return F.aggregate(words, F.struct(none.alias("low"), none.alias("out")), step, lambda acc: F.array_join(acc["out"], " "))


def _common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    where: dict[str, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for y in b:
        hit = row & where.get(y, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def indel_ratio(a: str, b: str) -> float:
    return 2 * _common_subsequence(a, b) / (len(a) + len(b)) if a or b else 1.0


def token_set_ratio(a: str, b: str) -> float:
    """Likeness of two token sets, 0 to 1: 1 if one holds the other; else the best of their sorted joins."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, left, right = " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and (not left or not right):
        return 1.0
    one, two = f"{both} {left}".strip(), f"{both} {right}".strip()
    best = indel_ratio(one, two)
    if both:
        best = max(best, indel_ratio(both, one), indel_ratio(both, two))
    return best


def title_ratio(a: Column, b: Column) -> Column:
    """token_set_ratio of normalised titles; null if either is null."""

    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else token_set_ratio(p, q) for p, q in zip(x, y, strict=True)], dtype="float64")

    return F.pandas_udf(ratio, "double")(a, b)
