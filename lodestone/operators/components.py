"""Connected components by alternating large and small stars, with hot vertices salted.

A round sends each vertex's larger neighbours, then its smaller ones, to the least neighbour; it ends when a round changes
nothing, and rounds grow with the logarithm of a component's size. Each round is written to the shared folder and the one
before it deleted.

A key is hot if it has more than HOT rows and more than a HOT_KEYS-th of all rows, so fewer than HOT_KEYS keys can be hot and
their list may be broadcast; only their rows are salted, and only their one row on the other side is copied.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import discard, saved, unused

SALTS, HOT, HOT_KEYS = 16, 10_000, 1 << 16


def hot_keys(sizes: DataFrame, key: str, total: int, least: int = HOT) -> DataFrame | None:
    """Of sizes (key, n: rows of that key, `total` in all) the hot keys, fewer than HOT_KEYS; None if there are none."""
    floor = max(least, total // HOT_KEYS)
    if total <= floor:
        return None
    hot = sizes.filter(F.col("n") > floor).select(key)
    return None if hot.isEmpty() else hot


def spread_join(left: DataFrame, right: DataFrame, key: str, by: str, hot: DataFrame | None, how: str = "inner") -> DataFrame:
    """left join right (one row a key) where some keys of left are hot: their rows are dealt to SALTS tasks by a hash of `by`."""
    if hot is None:
        return left.join(right, key, how)
    salt, salts = (unused(left, x, right) for x in ("salt", "salts"))
    known = F.broadcast(hot.select(key, F.lit(SALTS).alias(salts)))
    n = F.coalesce(salts, F.lit(1))
    a = left.join(known, key, "left").withColumn(salt, F.pmod(F.xxhash64(by), n)).drop(salts)
    b = right.join(known, key, "left").withColumn(salt, F.explode(F.sequence(F.lit(0).cast("long"), (n - 1).cast("long")))).drop(salts)
    return a.join(b, [key, salt], how).drop(salt)


def components(edges: DataFrame, name: str = "stars", hot: int = HOT) -> DataFrame:
    """v, root for every vertex of edges (u, v) that isn't its component's least. Ids of any ordered type; nulls aren't allowed."""
    size = lambda d: d.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
    edges = saved(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)
    now = size(edges)
    while True:
        seen, old, total = now, [edges], 2 * now[0]
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        if total > hot:
            least = saved(least, f"{name}-least")
            old.append(least)
        large = spread_join(both.filter("v > u"), least.select("u", "m"), "u", "v", hot_keys(least, "u", total, hot)).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        if total > hot:
            large = saved(large, f"{name}-large")
            old.append(large)
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        joined = spread_join(large, low.select("u", "m"), "u", "v", hot_keys(low, "u", total, hot))
        small = joined.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").filter("u <> v").distinct()
        edges = saved(small, name)
        discard(*old)
        # Stars are done when no round changes them; the sums stand for the sets.
        now = size(edges)
        if now == seen:
            return edges.select(F.col("u").alias("v"), F.col("v").alias("root"))
