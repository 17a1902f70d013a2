"""Retrieval inside one corpus part at a time (a paper's chunks): exact cosine, BM25, and their fusion."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.normalize import tokens
from ..functions.scoring import cosine
from ..functions.text import is_clean
from .lineage import let, saved

K1, B, RRF = 1.5, 0.75, 60
DENSE, SPARSE, FUSED = 30, 30, 8


def counted(t: Column) -> Column:
    """Array of (term, f): a row's different terms, in order, and how often each comes. Runs of the sorted tokens are measured in the
    row itself, so that no token is shuffled."""
    at = lambda s: F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
    runs = lambda s, p: F.transform(p, lambda x, i: F.struct(F.get(s, x).alias("term"), (F.coalesce(F.get(p, i + 1), F.size(s)) - x).cast("long").alias("f")))
    some = let(F.sort_array(t), lambda s: let(at(s), lambda p: runs(s, p)))
    return F.when(F.size(t) > 0, some).otherwise(F.array().cast("array<struct<term:string,f:bigint>>"))


def term_counts(rows: DataFrame, part: str, key: str, text: str) -> DataFrame:
    """part, key, term, f, dl. Texts are shuffled by key (several rows of one are taken together), their terms never."""
    whole = rows.select(part, key, F.col(text).alias("__x")).groupBy(part, key).agg(F.collect_list("__x").alias("__x"))
    t = whole.select(part, key, F.filter(F.transform("__x", lambda x: tokens(F.lower(x))), lambda x: F.size(x) > 0).alias("__t"))
    t = t.select(part, key, F.size(F.get("__t", F.lit(0))).alias("dl"), F.explode(counted(F.flatten("__t"))).alias("__c"))
    return t.select(part, key, F.col("__c.term").alias("term"), F.col("__c.f").alias("f"), "dl")


def bm25(rows: DataFrame, query: str, part: str, key: str, text: str, k1: float = K1, b: float = B, places: int = 9) -> DataFrame:
    """part, key, score of every row, those without a query term scoring 0. Query terms count as often as they occur.

    Texts are read once, for their lengths and the counts of the query's terms, which are written. From these each part's rows,
    lengths and document frequencies are summed (combined before the shuffle, a row a part), and each row is scored by itself.
    Nothing is exploded, and no row's text or hits are shuffled.
    """
    terms = query.lower().split()
    weights = {t: terms.count(t) for t in terms}
    if not weights:
        return rows.select(part, key, F.lit(0.0).alias("score"))
    t = rows.select(part, key, tokens(F.lower(text)).alias("__t")).select(part, key, F.size("__t").alias("__dl"), F.filter("__t", lambda x: x.isin(list(weights))).alias("__q"))
    t = saved(t.select(part, key, "__dl", F.transform(F.array(*map(F.lit, weights)), lambda x: F.size(F.filter("__q", lambda y: y == x))).alias("__f")), "hits")
    has = [F.sum((F.get("__f", F.lit(i)) > 0).cast("long")).alias(f"__df{i}") for i in range(len(weights))]
    stats = t.groupBy(part).agg(F.count(F.lit(1)).alias("__n"), F.avg("__dl").alias("__avgdl"), *has)
    norm = F.lit(k1) * (1 - b + b * F.col("__dl") / F.greatest(F.col("__avgdl"), F.lit(1e-9)))

    def gain(i: int, weight: int) -> Column:
        f, df = F.get("__f", F.lit(i)), F.col(f"__df{i}")
        return F.when(f > 0, weight * F.log((F.col("__n") - df + 0.5) / (df + 0.5) + 1) * f * (k1 + 1) / (f + norm)).otherwise(0.0)

    score = reduce(lambda x, y: x + y, [gain(i, w) for i, w in enumerate(weights.values())])
    return t.join(stats, part, "left").select(part, key, F.round(F.coalesce(score, F.lit(0.0)), places).alias("score"))


def top(df: DataFrame, part: str, score: str, tie: str, k: int, descending: bool = True) -> DataFrame:
    """The k best of each part, with rank; ties by `tie`. Each task keeps its own k best before the shuffle."""
    order = F.desc(score) if descending else F.asc(score)
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(part).orderBy(order, tie))).filter(F.col("rank") <= k)


def dense(rows: DataFrame, query: list[float], part: str, key: str, vector: str = "embedding", k: int = DENSE, places: int = 9) -> DataFrame:
    """part, key, score (cosine), rank."""
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = rows.filter(F.col(vector).isNotNull()).select(part, key, F.round(cosine(F.col(vector), q), places).alias("score"))
    return top(scored, part, "score", key, k)


def fuse(dense_list: DataFrame, sparse_list: DataFrame, part: str, key: str, k: int = RRF) -> DataFrame:
    """part, key, rrf, d_rank, s_rank of the union of two ranked lists."""
    both = dense_list.select(part, key, F.col("rank").alias("d_rank"), F.lit(None).cast("int").alias("s_rank")).unionByName(sparse_list.select(part, key, F.lit(None).cast("int").alias("d_rank"), F.col("rank").alias("s_rank")))
    one = lambda c: F.coalesce(F.lit(1.0) / (F.lit(k) + F.col(c)), F.lit(0.0))
    return both.groupBy(part, key).agg(F.max("d_rank").alias("d_rank"), F.max("s_rank").alias("s_rank")).withColumn("rrf", F.round(one("d_rank") + one("s_rank"), 12))


def picked(few: DataFrame, rows: DataFrame, part: str, key: str, text: str) -> DataFrame:
    """few with the texts of its rows, written before anything is asked of them: a filter by text would else be worked out for all
    texts ahead of the join. few is written too, so that its size is known and no text is shuffled where it is small."""
    return saved(saved(few, "few").join(rows.select(part, key, text), [part, key]), "picked")


def hybrid(rows: DataFrame, query: str, vector: list[float], part: str, key: str, text: str, embedding: str = "embedding", ks: tuple[int, int, int] = (DENSE, SPARSE, FUSED), vectors: DataFrame | None = None) -> DataFrame:
    """part, key, rrf, rank: the best of both lists; three times as many are fused, unclean texts dropped, then k kept.

    `vectors` (part, key, embedding) where the vectors don't stand with the texts, which then needn't be joined.
    """
    d = dense(rows if vectors is None else vectors, vector, part, key, embedding, ks[0])
    s = top(bm25(rows, query, part, key, text), part, "score", key, ks[1])
    order = [F.desc("rrf"), F.col("d_rank").asc_nulls_last(), F.col("s_rank").asc_nulls_last()]
    w = Window.partitionBy(part).orderBy(*order)
    fused = fuse(d, s, part, key).withColumn("place", F.row_number().over(w)).filter(F.col("place") <= 3 * ks[2])
    kept = picked(fused, rows, part, key, text).filter(is_clean(F.col(text)))
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy(part).orderBy("place"))).filter(F.col("rank") <= ks[2]).select(part, key, "rrf", "rank")
