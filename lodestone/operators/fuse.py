"""Ranked lists: pooling, merging of records, and reciprocal rank fusion. Order is always an explicit column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import normalize as N
from . import components as stars
from .lineage import unused
from .match import links

K, BOOST = 60, 5.0


def ranked(df: DataFrame, by: list[Column], partition: list[str] | None = None, name: str = "rank") -> DataFrame:
    """1-based places."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*(partition or [])).orderBy(*by)))


def bag(first: DataFrame, second: DataFrame, rank: str = "source_rank") -> DataFrame:
    """Two lists of one source end to end: the second's ranks go on after the first's."""
    n = unused(second, "n")
    last = first.agg(F.coalesce(F.max(rank), F.lit(0)).alias(n))  # one row
    return first.unionByName(second.crossJoin(F.broadcast(last)).withColumn(rank, F.col(rank) + F.col(n)).drop(n))


def source_rank(df: DataFrame, entity: str, source: str, rank: str) -> DataFrame:
    """Each entity's rank in each source; where a source lists it twice, the last one counts."""
    return df.groupBy(entity, source).agg(F.max(rank).alias(rank))


def rrf(df: DataFrame, entity: list[str], rank: str, k: int = K, name: str = "rrf_score") -> DataFrame:
    """Sum of 1 / (k + rank) over the lists that hold the entity."""
    return df.groupBy(*entity).agg(F.sum(F.lit(1.0) / (F.lit(k) + F.col(rank))).alias(name))


def boosted(score: Column, similarity: Column, boost: float = BOOST) -> Column:
    return score * (1 + boost * F.greatest(F.lit(0.0), similarity))


def _filled(c: str, kind: str) -> Column:
    if kind == "string":
        return F.col(c).isNotNull() & (F.col(c) != "")
    if kind.startswith("array"):
        return F.coalesce(F.size(c) > 0, F.lit(False))
    return F.col(c).isNotNull()


def merged(df: DataFrame, group: str, order: list[str], source: str | None = None) -> DataFrame:
    """One record for each group: each field's first value that isn't empty, in order; identifiers normalised after."""
    fields = [(c, t) for c, t in df.dtypes if c not in {group, *order, source}]
    place = F.struct(*order)
    picks = [F.min_by(F.when(_filled(c, t), F.col(c)), F.when(_filled(c, t), place)).alias(c) for c, t in fields]
    if source:
        picks.append(F.array_sort(F.collect_set(source)).alias("source_apis"))
    out = df.groupBy(group).agg(*picks)
    for c, f in (("doi", N.doi), ("arxiv_id", N.arxiv), ("openalex_id", N.openalex_id), ("s2_id", N.s2_id)):
        if c in out.columns:
            out = out.withColumn(c, f(F.col(c)))
    return out


def components(edges: DataFrame, vertices: DataFrame, key: str = "id") -> DataFrame:
    """key, root: the least vertex that each one is linked to by edges (l, r)."""
    roots = stars.components(edges.select(F.col("l").alias("u"), F.col("r").alias("v")), "pool")
    return vertices.select(key).distinct().join(roots.withColumnRenamed("v", key), key, "left").select(key, F.coalesce("root", key).alias("root"))


def deduplicated(pool: DataFrame, order: list[str], key: str = "id", source: str | None = None) -> DataFrame:
    """One merged record for each set of linked rows. Sets are connected components of the match relation: the merge doesn't
    depend on the order of arrival, and joins at least what a first-match pass would."""
    roots = components(links(pool, key), pool, key)
    return merged(pool.join(roots, key).drop(key), "root", order, source).withColumnRenamed("root", key)


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    n = unused(df, "n")
    return df.withColumn(n, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(n) == 1).drop(n)


def within(df: DataFrame, n: int, rank: str = "rank") -> DataFrame:
    return df.filter(F.col(rank) <= n)
