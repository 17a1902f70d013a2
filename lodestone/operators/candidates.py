"""From ranked lists of several sources to a screened list of candidates."""

from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import cosine, keywords, lexical_relevance
from . import fuse, screen
from .exclude import exclude
from .lineage import checkpointed
from .match import links

PRE_LIMIT, LEAST, MOST = 50, 6.0, 20


def search_terms(seed: DataFrame, limit: int = 10) -> DataFrame:
    """seed with search_query: its title; the keywords of its abstract where it has no catalogue id but an abstract with any."""
    words = F.nullif(keywords(F.coalesce("abstract", F.lit("")), limit), F.lit(""))
    return seed.withColumn("search_query", F.when(F.coalesce("openalex_id", F.lit("")) == "", F.coalesce(words, "title")).otherwise(F.col("title")))


def pooled(lists: dict[str, list[DataFrame]], rank: str = "rank") -> DataFrame:
    """All lists with source, source_pos and source_rank; the lists of one source follow one another."""
    out = None
    for i, (source, parts) in enumerate(lists.items()):
        one = parts[0].withColumnRenamed(rank, "source_rank")
        for more in parts[1:]:
            one = fuse.bag(one, more.withColumnRenamed(rank, "source_rank"))
        one = one.withColumn("source", F.lit(source)).withColumn("source_pos", F.lit(i))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def screened(seed_vector: DataFrame, candidates: DataFrame, scorer: Callable[[DataFrame], DataFrame] | None = None, least: float = LEAST, most: int = MOST, policy: str = "pass", vector: str = "embedding", key: str = "id", keep: Callable[[DataFrame], DataFrame] = checkpointed) -> DataFrame:
    """Candidates of at least the threshold, best first, with final_rank; all of them compete where none reaches it.

    scorer adds abstract_relevance_score and abstract_relevance_tier to rows with an abstract. It is run at once, by `keep`;
    if it fails anywhere, a warning says why and all rows are scored by their vectors instead. scored_by tells of each row
    which of the two it was. Ties: key.
    """
    by_vector = screen.scored(candidates, seed_vector, policy, vector).withColumn("scored_by", F.lit("vector"))
    out = by_vector
    if scorer is not None:
        blank = screen.missing_abstract(F.col("abstract"))
        try:
            told = keep(scorer(candidates.filter(~blank)).withColumn("scored_by", F.lit("scorer")))
            out = by_vector.filter(blank).unionByName(told, allowMissingColumns=True)
        except Exception as e:  # noqa: BLE001 - whatever the scorer raises, the vectors answer
            warnings.warn(f"the scorer failed, vectors answer: {e}", stacklevel=2)
            out = by_vector
    return screen.relaxed(out, "abstract_relevance_score", least, most, [F.col(key)])


def build(seed: DataFrame, cited: DataFrame, lists: dict[str, list[DataFrame]], status: str = "complete", allow_incomplete: bool = False, scorer: Callable[[DataFrame], DataFrame] | None = None, screening: bool = True, pre_limit: int = PRE_LIMIT, least: float = LEAST, most: int = MOST, policy: str = "pass", vector: str = "embedding", key: str = "id") -> DataFrame:
    """Pool, merge, exclude, fuse ranks, boost by likeness to the seed, cut, screen, rank.

    seed is one row (title, abstract, identifiers, and a vector where `vector` is to be used); lists give each source's
    DataFrames with key, rank and the fields of a paper. Rows are merged by the connected components of the match relation.
    """
    pool = checkpointed(pooled(lists))
    each = pool.select(key, "source", "source_rank").distinct()
    one = fuse.keep_first(pool, [key], [F.col("source_pos"), F.col("source_rank")])
    roots = checkpointed(fuse.components(links(one, key), one, key))
    records = fuse.merged(pool.join(roots, key).drop(key), "root", ["source_pos", "source_rank"], "source").withColumnRenamed("root", key)
    ranks = fuse.source_rank(each.join(roots, key), "root", "source", "source_rank")
    scores = fuse.rrf(ranks, ["root"], "source_rank").withColumnRenamed("root", key)
    kept = exclude(records, seed, cited, status, allow_incomplete, key).join(scores, key)
    text = lambda t, a: F.trim(F.concat_ws(" ", F.coalesce(t, F.lit("")), F.coalesce(a, F.lit(""))))
    has_vector = vector in records.columns and vector in seed.columns
    about = seed.limit(1).select(text(F.col("title"), F.col("abstract")).alias("__about"), *([F.col(vector).alias("__v")] if has_vector else []))
    kept = kept.crossJoin(F.broadcast(about))  # one row by contract
    words = lexical_relevance(F.col("__about"), text(F.col("title"), F.col("abstract")))
    likeness = F.greatest(F.lit(0.0), cosine(F.col(vector), F.col("__v"))) if has_vector else words
    kept = kept.withColumn("domain_relevance", likeness).withColumn("rrf_score", F.round(fuse.boosted(F.col("rrf_score"), F.col("domain_relevance")), 12)).drop("__about", "__v")
    order = [F.desc("rrf_score"), F.col(key)]
    if not screening:
        first = kept.orderBy(*order).limit(most)
        return first.withColumn("rrf_rank", F.row_number().over(Window.orderBy(*order)))
    first = checkpointed(kept.orderBy(*order).limit(pre_limit))
    return screened(seed, first, scorer, least, most, policy, vector, key).withColumnRenamed("final_rank", "rrf_rank")
