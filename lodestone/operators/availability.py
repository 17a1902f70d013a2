"""Passages that tell where a paper's data are: pattern scores, neighbours, and a token budget."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.normalize import tokens
from .lineage import unused

# Patterns and what each that occurs adds to a chunk's score.
HEADINGS = [
    r"\bdata\s+availability\b",
    r"\bavailability\s+of\s+data(?:\s+and\s+materials)?\b",
    r"\bdata\s+sharing\b",
    r"\bdata\s+access\b",
    r"\bcode\s+and\s+data\s+availability\b",
    r"\bsupplementary\s+data\b",
]
PHRASES = [
    r"\bavailable\s+upon\s+reasonable\s+request\b",
    r"\breasonable\s+request\b",
    r"\bcontrolled\s+access\b",
    r"\bmanaged\s+access\b",
    r"\bdata[- ]use\s+agreement\b",
    r"\bdata\s+access\s+committee\b",
    r"\bapplication\s+required\b",
    r"\bauthorization\b",
    r"\bcredentialed\s+access\b",
    r"\bcannot\s+be\s+shared\b",
    r"\bnot\s+publicly\s+available\b",
    r"\bprivacy\s+restrictions?\b",
    r"\bethical\s+restrictions?\b",
    r"\bdeposited\s+in\b",
    r"\baccession\b",
]
ACCESSIONS = [
    r"\bGSE\d+\b",
    r"\b(?:SRP|SRR|SRS|SRX)\d+\b",
    r"\b(?:PRJNA|PRJEB|PRJDB)\d+\b",
    r"\bphs\d+(?:\.v\d+\.p\d+)?\b",
    r"\b(?:EGAS|EGAD|EGAN)\d+\b",
    r"\bPXD\d+\b",
    r"\bE-[A-Z]{4}-\d+\b",
    r"\bds\d+\b",
    r"\bsyn\d+\b",
    r"\bMTBLS\d+\b",
]
GROUPS = ((HEADINGS, 10.0), (ACCESSIONS, 8.0), (PHRASES, 5.0))


#: What case folding makes a plain letter of, but lower() doesn't: texts with one of these go to every pattern.
ODD_LETTERS = ("\u0130", "\u0131", "\u017f", "\u212a")


def anchors(pattern: str) -> list[list[str]]:
    """Lower-case texts that a match of the pattern can't do without: of each list, one.

    Read from its literals of two characters or more, and from alternatives in brackets; what is optional doesn't count. The
    longest come first, as the fewest texts hold them.
    """
    rest = re.sub(r"\(\?:[^()]*\)\?|\w\?|\\b", "\n", pattern)
    found = [x.lower().split("|") for x in re.findall(r"\(\?:([^()]*)\)", rest) if re.fullmatch(r"[\w|]+", x)]
    rest = re.sub(r"\(\?:[^()]*\)|\[[^]]*\]|\{\d+\}|\\[A-Za-z]|[+*.]", "\n", rest)
    return sorted(found + [[x.lower()] for x in rest.split("\n") if len(x) > 1], key=lambda ways: -min(map(len, ways)))


def pattern_score(text: Column, section: Column | None = None, groups=GROUPS) -> Column:
    """Each pattern that occurs (in either case) adds its group's points once.

    A text is lower-cased once and searched for each pattern's anchors; the pattern itself runs only where all are found.
    """
    t = F.concat(F.coalesce(section, F.lit("")), F.lit("\n"), F.coalesce(text, F.lit(""))) if section is not None else F.coalesce(text, F.lit(""))

    def score(x: Column) -> Column:
        may = lambda p: reduce(lambda a, b: a & b, [reduce(lambda a, b: a | b, [x["low"].contains(w) for w in ways]) for ways in anchors(p)], F.lit(True))
        return reduce(lambda a, b: a + b, [F.when((may(p) | x["odd"]) & x["t"].rlike(f"(?iu){p}"), F.lit(points)).otherwise(0.0) for patterns, points in groups for p in patterns])

    # An array of one: its element is computed once, and named.
    odd = reduce(lambda a, b: a | b, [t.contains(c) for c in ODD_LETTERS])
    return F.element_at(F.transform(F.array(F.struct(t.alias("t"), F.lower(t).alias("low"), odd.alias("odd"))), score), 1)


def with_dense_bonus(scored: DataFrame, ranked: DataFrame, part: str, index: str, places: int = 10) -> DataFrame:
    """Add 10 / rank for the first ranks of a dense list (part, index, rank)."""
    bonus = ranked.filter(F.col("rank") <= places).select(part, index, (F.lit(10.0) / F.col("rank")).alias("__bonus"))
    return scored.join(bonus, [part, index], "left").withColumn("score", F.col("score") + F.coalesce("__bonus", F.lit(0.0))).drop("__bonus")


def neighbours(scored: DataFrame, part: str, index: str) -> DataFrame:
    """part, index, score: rows that score, and the rows just before and after them (by index) where these exist."""
    around = scored.filter("score > 0").select(part, F.explode(F.array(F.col(index) - 1, F.col(index), F.col(index) + 1)).alias(index)).distinct()
    return scored.join(around, [part, index], "left_semi")


def budgeted(df: DataFrame, part: list[str], order: list[Column], size: str, budget: int) -> DataFrame:
    """The longest prefix within the budget, in order; always the first row. It ends at the first row that overflows."""
    w = Window.partitionBy(*part).orderBy(*order)
    running = F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0))
    cum, n = unused(df, "cum"), unused(df, "n")
    return df.withColumn(cum, running).withColumn(n, F.row_number().over(w)).filter((F.col(cum) <= budget) | (F.col(n) == 1)).drop(cum, n)


def context(chunks: DataFrame, part: str = "paper_id", index: str = "chunk_index", text: str = "content", budget: int = 1500, section: str | None = None, groups=GROUPS, fallback: str = "data") -> DataFrame:
    """Chunks with scores and their neighbours, scored ones first, within a token budget for each part.

    Where nothing of a part scores, chunks that hold the fallback word get 1.
    """
    scored = chunks.withColumn("score", pattern_score(F.col(text), F.col(section) if section else None, groups))
    best = scored.groupBy(part).agg(F.max("score").alias("__best"))
    scored = scored.join(best, part).withColumn("score", F.when(F.col("__best") > 0, F.col("score")).when(F.lower(text).contains(fallback), 1.0).otherwise(0.0)).drop("__best")
    size = F.coalesce(F.nullif(F.col("token_count"), F.lit(0)), F.size(tokens(F.col(text)))) if "token_count" in chunks.columns else F.size(tokens(F.col(text)))
    near = neighbours(scored, part, index).withColumn("token_count", size)
    return budgeted(near, [part], [F.col("score") == 0, F.col(index)], "token_count", budget)


def formatted(chunks: DataFrame, part: str, index: str = "chunk_index", key: str = "id", text: str = "content") -> DataFrame:
    """part, context: each chunk under a line [id=.. index=.. section=".." page=..], in order, blank lines between."""
    label = [F.concat(F.lit("id="), F.col(key).cast("string")), F.concat(F.lit("index="), F.col(index).cast("string"))]
    if "section_title" in chunks.columns:
        label.append(F.when(F.coalesce("section_title", F.lit("")) != "", F.concat(F.lit('section="'), "section_title", F.lit('"'))))
    if "page_number" in chunks.columns:
        label.append(F.concat(F.lit("page="), F.col("page_number").cast("string")))
    block = F.concat(F.lit("["), F.concat_ws(" ", *label), F.lit("]\n"), F.trim(text))
    rows = F.array_sort(F.collect_list(F.struct(F.col(index).alias("i"), block.alias("b"))))
    return chunks.groupBy(part).agg(F.array_join(F.transform(rows, lambda r: r["b"]), "\n\n").alias("context"))


def first_half(df: DataFrame, part: list[str], order: list[Column]) -> DataFrame:
    """For a second attempt: the first max(1, n div 2) rows of each part."""
    at, keep = unused(df, "at"), unused(df, "keep")
    n = df.groupBy(*part).agg(F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) / 2)).alias(keep))
    return df.join(n, part).withColumn(at, F.row_number().over(Window.partitionBy(*part).orderBy(*order))).filter(F.col(at) <= F.col(keep)).drop(at, keep)
