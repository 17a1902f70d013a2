"""Screening by relevance to a seed, with relaxation where nothing reaches the threshold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import cosine, relevance_score, relevance_tier


def missing_abstract(abstract: Column) -> Column:
    """Null, or white space alone."""
    return ~F.coalesce(abstract, F.lit("")).rlike(r"(?U)\S")


def scored(candidates: DataFrame, seed_vector: DataFrame, policy: str = "pass", vector: str = "embedding") -> DataFrame:
    """candidates with abstract_relevance_score and _tier: cosine to the one seed vector; a blank abstract has the policy's.

    pass: 5.0 and moderate (as fixed, though 5.0 alone reads low); drop: 0 and irrelevant, and the row stays in the pool.
    """
    seed = seed_vector.select(F.col(vector).alias("__seed"))
    out = candidates.crossJoin(F.broadcast(seed.limit(1)))  # one row by contract
    blank = missing_abstract(F.col("abstract"))
    score = F.when(blank, F.lit(0.0 if policy == "drop" else 5.0)).otherwise(relevance_score(cosine(F.col(vector), F.col("__seed"))))
    tier = F.when(blank, "irrelevant" if policy == "drop" else "moderate").otherwise(relevance_tier(F.col("abstract_relevance_score")))
    return out.withColumn("abstract_relevance_score", score).withColumn("abstract_relevance_tier", tier).drop("__seed")


def relaxed(df: DataFrame, score: str, least: float, most: int, order: list[Column], partition: list[str] | None = None) -> DataFrame:
    """Rows of at least the threshold; if a pool has none, all of its rows. Then the first `most` by score and order.

    The pool's maximum comes from an aggregate, not a window over all rows, so it combines before any shuffle.
    """
    part = partition or []
    top = df.groupBy(*part).agg(F.max(score).alias("__top"))
    joined = df.join(F.broadcast(top) if not part else top, part) if part else df.crossJoin(F.broadcast(top))
    kept = joined.filter((F.col(score) >= least) | (F.coalesce(F.col("__top"), F.lit(float("-inf"))) < least)).drop("__top")
    if not part:
        first = kept.orderBy(F.desc(score), *order).limit(most)
        return first.withColumn("final_rank", F.row_number().over(Window.orderBy(F.desc(score), *order)))
    return kept.withColumn("final_rank", F.row_number().over(Window.partitionBy(*part).orderBy(F.desc(score), *order))).filter(F.col("final_rank") <= most)


def worth_evaluating(score: Column, floor: float = 3.0) -> Column:
    """Rows scored below the floor are passed over; unscored rows aren't."""
    return F.coalesce(score >= floor, F.lit(True))
