"""Works around a paper: references, related works, relaxed searches, and expansion of the accepted set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.normalize import tokens
from .exclude import exclude, novel
from .fuse import keep_first
from .lineage import unused


def references(works: DataFrame, key: str = "id", limit: int = 100, refs: str = "referenced_works") -> DataFrame:
    """key, ref, pos of each work's first references."""
    return works.select(key, F.posexplode(F.slice(refs, 1, limit)).alias("pos", "ref"))


def related(seeds: DataFrame, edges: DataFrame, limit: int = 100) -> DataFrame:
    """run_id, id, rank: ends of the seeds' edges (src, dst, weight)."""
    hit = seeds.select("run_id", F.col("id").alias("src")).join(edges, "src")
    w = Window.partitionBy("run_id").orderBy(F.desc("weight"), "dst")
    return hit.groupBy("run_id", F.col("dst")).agg(F.max("weight").alias("weight")).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit).select("run_id", F.col("dst").alias("id"), "rank")


def attempts(query: str, most: int = 3) -> list[list[str]]:
    """Term lists of a search that relaxes: each attempt drops the last three terms (the last one if three or fewer are left)."""
    terms, out = query.split(), []
    while terms and len(out) < most:
        out.append(terms)
        terms = terms[:-3] if len(terms) > 3 else terms[:-1]
    return out


def search(works: DataFrame, query: str, text: Column, limit: int = 100, order: list[Column] | None = None) -> DataFrame:
    """Works that hold all terms, by the first attempt that any work answers: attempt, and the first `limit` by order.

    One pass: the first rows by attempt and order hold all that the earliest answered attempt can give.
    """
    tries = attempts(query)
    if not tries:
        return works.limit(0).withColumn("attempt", F.lit(0))
    words = tokens(F.lower(text))
    attempt = F.coalesce(*[F.when(F.size(F.array_except(F.array(*[F.lit(t.lower()) for t in ts]), words)) == 0, F.lit(i)) for i, ts in enumerate(tries)])
    first = works.withColumn("attempt", attempt).filter("attempt is not null").orderBy("attempt", *(order or [F.lit(1)])).limit(limit)
    least = unused(first, "least")
    return first.withColumn(least, F.min("attempt").over(Window.partitionBy())).filter(F.col("attempt") == F.col(least)).drop(least).orderBy(*(order or [F.lit(1)]))  # of `limit` rows


def expansion(accepted: DataFrame, edges: DataFrame, works: DataFrame, seed: DataFrame, cited: DataFrame, seen: DataFrame, status: str = "complete", limit: int = 50, key: str = "id") -> DataFrame:
    """New works around accepted ones: neither seed nor cited nor seen, at most `limit`, strongest edges first."""
    ends = accepted.select(F.col(key).alias("src")).join(edges, "src").groupBy(F.col("dst").alias(key)).agg(F.max("weight").alias("weight"))
    new = keep_first(works.join(ends, key), [key], [F.desc("weight")])
    out = novel(exclude(new, seed, cited, status, key=key), accepted, seen, key)
    return out.orderBy(F.desc("weight"), key).limit(limit)
