"""Exclusion: no discovered paper is the seed or one of its references; without a complete bibliography, nothing passes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .match import matched


class ExclusionIncomplete(ValueError):
    """The cited set isn't known to be complete."""


def guard(status: str, allow_incomplete: bool = False) -> None:
    if status != "complete" and not allow_incomplete:
        raise ExclusionIncomplete(f"exclusion status is {status!r}")


def guarded(df: DataFrame, status: Column) -> DataFrame:
    """The same guard inside a plan: the query fails on the first row whose status isn't complete."""
    return df.filter(F.assert_true(status == "complete", F.lit("exclusion status is not complete")).isNull())


def bibliography_status(papers: DataFrame, references: DataFrame, required: bool = True) -> DataFrame:
    """id, exclusion_status: complete if the paper has a reference, or none is required."""
    n = references.groupBy(F.col("source_paper_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return papers.select("id").join(n, "id", "left").select("id", F.when(F.lit(not required) | (F.coalesce("n", F.lit(0)) > 0), "complete").otherwise("incomplete").alias("exclusion_status"))


def exclude(candidates: DataFrame, seed: DataFrame, cited: DataFrame, status: str = "complete", allow_incomplete: bool = False, key: str = "id") -> DataFrame:
    """Candidates that match neither the seed nor a cited paper."""
    guard(status, allow_incomplete)
    known = seed.unionByName(cited, allowMissingColumns=True)
    return candidates.join(matched(candidates, known, key), key, "left_anti")


def novel(new: DataFrame, accepted: DataFrame, seen: DataFrame, key: str = "id") -> DataFrame:
    """New rows that match nothing accepted or seen."""
    return new.join(matched(new, accepted.unionByName(seen, allowMissingColumns=True), key), key, "left_anti")
