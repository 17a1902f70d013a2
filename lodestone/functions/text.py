"""Predicates and parsers for running text."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .normalize import tokens

# What marks a bibliography chunk, and how often it must occur.
COMMA_NUMBER = r"(?:^|,)\s*(\d+)\s*(?=,|$)"
SURNAME = r"(?:^|,)\s*([A-Z][a-z]+)\s*,"
MARKERS = (
    (r"(?i)https?://|\.tar\.gz|\.bcf|\.vcf|s3[.-]|\.fasta\b", 2),
    (r"(?i)\bSupplementary (?:Figure|Table|Note|Information|File|Movie)\b", 2),
    (r"(?i)\bet al\b", 2),
    (r"10\.\d{4,9}/", 2),
    (r"\b(?:19|20)\d{2}\s*;\s*\d+", 2),
    (r"(?m)^\s*\d{1,3}\.\s+[A-Z]", 3),
)
MIN_WORDS = 20


def count_matches(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def is_reference(c: Column) -> Column:
    """Whether a chunk reads like a bibliography rather than prose."""
    t = F.trim(F.regexp_replace(c, r"^\s+|\s+$", ""))
    others = F.size(F.filter(F.split(t, r"[,\s]+"), lambda x: (x != "") & ~x.rlike(r"^\d+$")))
    numbers = (count_matches(t, COMMA_NUMBER) >= 5) & (others < 3)
    names = F.regexp_extract_all(t, F.lit(SURNAME), 1)
    most = F.array_max(F.transform(F.array_distinct(names), lambda s: F.size(F.filter(names, lambda x: x == s))))
    repeated = F.when(F.size(names) >= 6, F.coalesce(most, F.lit(0)) >= 4).otherwise(False)
    out = numbers | repeated
    for pattern, least in MARKERS:
        out = out | (count_matches(c, pattern) >= least)
    return F.coalesce(out, F.lit(False))


def is_low_quality(c: Column, min_words: int = MIN_WORDS) -> Column:
    """Too few words of letters, two URLs, or more than half of the tokens without a letter."""
    few = count_matches(c, "[a-zA-Z]{3,}") < min_words
    urls = count_matches(c, r"https?://\S+|s3-\S+") >= 2
    parts = tokens(c)
    noise = F.size(F.filter(parts, lambda t: ~t.rlike("[a-zA-Z]"))) / F.greatest(F.size(parts), F.lit(1))
    return F.coalesce(few | urls | (noise > 0.5), F.lit(True))


def is_clean(c: Column, min_words: int = MIN_WORDS) -> Column:
    return ~is_reference(c) & ~is_low_quality(c, min_words)


#: What a block of tokens is counted for: (name, pattern, whether the next token is seen too, what a match can't do without: one
#: of these, in lower case; none where every block is searched). `years`, `breaks` and `names` find at least as many places as
#: the patterns above that they stand for; `pairs` begin in the block.
COUNTED = (
    ("words", "[a-zA-Z]{3,}", False, ()), ("urls", r"https?://\S+|s3-\S+", False, ("://", "s3-")), ("bare", r"(?<!\S)[^a-zA-Z\s]+(?!\S)", False, ()),
    ("links", MARKERS[0][0], False, ("://", ".tar.gz", ".bcf", ".vcf", "s3.", "s3-", ".fasta")), ("files", MARKERS[1][0], True, ("supplementary ",)),
    ("others", MARKERS[2][0], True, ("et al",)), ("dois", MARKERS[3][0], False, ("10.",)), ("years", r"(?:^|\d ?);", False, (";",)),
    ("breaks", r"[\u0085\u2028\u2029]", False, ("\u0085", "\u2028", "\u2029")), ("names", r"(?<=^|,|, )[A-Z][a-z]+ ?,|^,", False, (",",)),
)


def marks(parts: Column, unit: int) -> Column:
    """White-space tokens counted in blocks of `unit`: an array of structs of COUNTED, for `summed` and `surely_clean`.

    A pattern is run only where what it can't do without is found, as in most blocks it isn't.
    """
    text = lambda b, n: F.array_join(F.slice(parts, b * unit + 1, n), " ")
    both = F.transform(F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / unit).cast("int")), lambda b: F.struct(text(b, unit).alias("own"), text(b, unit + 1).alias("more")))
    both = F.transform(both, lambda x: F.struct(x["own"].alias("own"), x["more"].alias("more"), F.lower(x["more"]).alias("low")))

    def count(x: Column, pattern: str, more: bool, needed: tuple[str, ...]) -> Column:
        found = count_matches(x["more" if more else "own"], pattern)
        return F.when(reduce(or_, [F.contains(x["low"], F.lit(s)) for s in needed]), found).otherwise(0) if needed else found

    return F.transform(both, lambda x: F.struct(*[count(x, pattern, more, needed).alias(name) for name, pattern, more, needed in COUNTED]))


def summed(blocks: Column) -> Column:
    zero = F.struct(*[F.lit(0).alias(name) for name, *_ in COUNTED])
    return F.aggregate(blocks, zero, lambda acc, x: F.struct(*[(acc[name] + x[name]).alias(name) for name, *_ in COUNTED]))


def surely_clean(s: Column, n: Column, min_words: int = MIN_WORDS) -> Column:
    """Whether a window of n tokens with these sums is clean (`is_clean` of it); null where the sums don't tell.

    A pair of words that begins with a window's last token is counted but lies outside, so sums of pairs may be one too many.
    A number is all that stands between commas only where fewer than three tokens have a letter.
    """
    unclean = (s["words"] < min_words) | (s["urls"] >= 2) | (s["bare"] > n * 0.5) | (s["links"] >= MARKERS[0][1]) | (s["dois"] >= MARKERS[3][1])
    unclean = unclean | (s["files"] > MARKERS[1][1]) | (s["others"] > MARKERS[2][1])
    clean = (s["files"] < MARKERS[1][1]) & (s["others"] < MARKERS[2][1]) & (s["years"] < MARKERS[4][1]) & (s["breaks"] + 1 < MARKERS[5][1]) & (s["names"] < 6) & (n - s["bare"] >= 3)
    return F.when(unclean, False).when(clean, True)


def json_object(c: Column) -> Column:
    """What lies between the first { and the last } of a reply, code fences taken off; without braces the trimmed text."""
    c = F.regexp_replace(F.regexp_replace(F.trim(c), r"(?m)^```(?:json)?\s*", ""), r"(?m)\s*```$", "")
    return F.coalesce(F.nullif(F.trim(F.regexp_extract(c, r"(\{[\s\S]*\})", 1)), F.lit("")), F.trim(c))


#: Sections of a written summary, in order, each with the headings that may open it.
SECTIONS = {
    "problem_formulation": ("PROBLEM FORMULATION", "PROBLEM STATEMENT", "PROBLEM"),
    "methodological_novelty": ("METHODOLOGICAL NOVELTY", "METHODOLOGY", "NOVELTY"),
    "empirical_findings": ("EMPIRICAL FINDINGS", "RESULTS", "EMPIRICAL EVALUATION"),
    "paragraph_summary": ("TECHNICAL SYNTHESIS", "SYNTHESIS", "SUMMARY"),
    "relationship_to_target": ("RELATIONSHIP TO TARGET PAPER", "RELATIONSHIP TO TARGET", "RELATIONSHIP TO INPUT PAPER", "RELATIONSHIP"),
}


def sections(c: Column) -> dict[str, Column]:
    """Each section's text with white space collapsed, null if it is missing or has 5 characters or fewer; a summary of over 300 words is cut to 290.

    A section ends at any heading of a later section, in whichever of its spellings, not just at the usual next one: a reply
    that leaves a section out doesn't run two of them together.
    """
    out = {}
    names = list(SECTIONS)
    for i, name in enumerate(names):
        later = "|".join(h for n in names[i + 1 :] for h in SECTIONS[n])
        close = rf"(?=\n\s*(?:\*\*|##|#)?\s*(?:{later})\s*:|\s*\z)" if later else r"(?=\s*\z)"
        found = F.trim(F.regexp_replace(F.regexp_extract(c, rf"(?is)(?:{'|'.join(SECTIONS[name])})\s*:\s*(.*?){close}", 1), r"\s+", " "))
        out[name] = F.when(F.length(found) > 5, found)
    words = F.split(out["paragraph_summary"], " ")
    out["paragraph_summary"] = F.when(F.size(words) > 300, F.array_join(F.slice(words, 1, 290), " ")).otherwise(out["paragraph_summary"])
    return out


def prompt_chunks(c: Column) -> Column:
    """Array of (id, content) of the [CHUNK id=...] blocks of a prompt."""
    pattern = r"(?s)\[CHUNK id=(\S+?)(?:\s[^\]]*)?\]\s*(.*?)(?=\n*\[CHUNK id=|\z)"
    return F.transform(F.arrays_zip(F.regexp_extract_all(c, F.lit(pattern), 1).alias("id"), F.regexp_extract_all(c, F.lit(pattern), 2).alias("content")), lambda x: F.struct(x["id"].alias("id"), F.trim(x["content"]).alias("content")))


def inverted_abstract(index: Column) -> Column:
    """The text of a map from word to positions."""
    pairs = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.array_sort(pairs), lambda x: x["w"]), " ")
