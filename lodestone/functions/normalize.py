"""Identifiers, titles, years and tokens as columns. Empty results are null, so that equality never matches them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DOI = r"10\.\d{4,9}/[-._;()/:A-Za-z0-9]+"
ARXIV = r"\d{4}\.\d{4,5}"


def _none_if_empty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def doi(c: Column) -> Column:
    """Trimmed, in lower case, without resolver prefixes (each taken off once, in this order) and outer slashes and spaces."""
    c = F.lower(F.trim(c))
    for prefix in (r"^https://doi\.org/", r"^http://doi\.org/", r"^doi:"):
        c = F.regexp_replace(c, prefix, "")
    return _none_if_empty(F.regexp_replace(c, r"^[/ ]+|[/ ]+$", ""))


def arxiv(c: Column) -> Column:
    """The first new-style id in the text, without its version; ids of the old style give null."""
    return _none_if_empty(F.regexp_extract(c, ARXIV, 0))


def openalex_id(c: Column) -> Column:
    return _none_if_empty(F.upper(F.regexp_replace(F.regexp_replace(F.trim(c), r"^https://openalex\.org/", ""), "^openalex:", "")))


def s2_id(c: Column) -> Column:
    return _none_if_empty(F.regexp_replace(F.regexp_replace(F.trim(c), r"^https://api\.semanticscholar\.org/", ""), "^CorpusId:", ""))


def title(c: Column) -> Column:
    """Lower case, every run of characters that aren't word characters one space; null: empty."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"(?U)[^\w\s]", " "), r"(?U)\s+", " "))


def year(publication_year: Column, other: Column) -> Column:
    return F.coalesce(F.nullif(publication_year, F.lit(0)), F.nullif(other, F.lit(0)))


def tokens(c: Column) -> Column:
    """White-space tokens."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda t: t != "")


def clean_text(c: Column) -> Column:
    """Without NUL characters."""
    return F.regexp_replace(c, "\\u0000", "")


def dois(c: Column) -> Column:
    """Distinct DOIs of a text, in order, without closing marks."""
    return F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(f"({DOI})"), 1), lambda d: F.regexp_replace(d, r"[.,;]+$", "")))


def arxiv_ids(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(c, F.lit(r"(?i)(?:arXiv:\s*|arxiv/|abs/)?(\d{4}\.\d{4,5}(?:v\d+)?)"), 1))


def identifiers(c: Column) -> Column:
    """Array of (kind, id): a text's DOIs, then its arXiv ids."""
    kind = lambda name, a: F.transform(a, lambda x: F.struct(F.lit(name).alias("kind"), x.alias("id")))
    return F.concat(kind("doi", dois(c)), kind("arxiv", arxiv_ids(c)))


def choice(c: Column, allowed: list[str], otherwise: str = "unknown") -> Column:
    """Trimmed and in lower case if it's allowed, else the other value."""
    x = F.lower(F.trim(c))
    return F.when(x.isin(allowed), x).otherwise(otherwise)


def person(forename: Column, surname: Column) -> Column:
    return _none_if_empty(F.concat_ws(" ", _none_if_empty(F.trim(forename)), _none_if_empty(F.trim(surname))))


def year_of(when: Column) -> Column:
    return F.substring(when, 1, 4).try_cast("int")


def deterministic_id(*parts) -> Column:
    """A stable id from natural keys."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(p).cast("string") if isinstance(p, str) else p.cast("string"), F.lit("\x00")) for p in parts]), 256)
