"""A stored inverted index over rows of many parts (a paper's chunks), and many queries at once over it.

Postings are written once, by the tasks that read the texts, in runs of bounded size, each in order of term: nothing is shuffled,
and a search reads the pages of its own terms alone (the list of terms is pushed to the scan). A common term's postings are
spread over all files. Queries are a table (part, query_id, text, and a vector for dense scores): each is asked of the rows of its own part.

Null texts have no terms; rows of a null part are indexed, but no query is asked of them. Repeated rows count each; a query
without terms or with a null text finds no row by words. Vectors must be of one length. An empty table gives an index without
rows. Columns of any other name are ignored; part, key and text are named by the caller.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType

from ..functions.normalize import tokens
from ..functions.scoring import cosine
from ..functions.text import is_clean
from ..ship import ship
from .expand import attempts
from .fuse import keep_first
from .lineage import held_to, saved
from .retrieve import DENSE, FUSED, K1, RRF, SPARSE, B, fuse, picked

#: Terms of all queries that are named to the scan, and queries whose vectors are broadcast; beyond, joins take over.
NAMED, HELD = 1 << 12, 1 << 14
#: Bytes of text in a run of postings, and postings that a task hands on at a time.
RUN, PIECE = 16 << 20, 1 << 16
#: White space of one byte each, as Java's \\s has it; no byte of a longer character is among them.
SPACES = bytes.maketrans(b"\t\n\x0b\f\r", b"     ")


class Index(NamedTuple):
    postings: DataFrame  #: term, part, key, row, f, dl
    dfs: DataFrame  #: term, part, df, counted from the postings of the terms that are asked for
    sizes: DataFrame  #: part, n, avgdl
    rows: DataFrame  #: part, key, row


def build(rows: DataFrame, part: str, key: str, text: str) -> Index:
    """Write the index of all rows, one posting for each different term of a row. Each row itself stands under the term "", which
    no text has, so that rows without terms are found and the texts are read once."""
    spark = rows.sparkSession
    ship(spark)
    held_to(spark, RUN // 2)
    t = rows.select(F.col(part).alias("part"), F.col(key).alias("key"), F.monotonically_increasing_id().alias("row"), F.coalesce(F.lower(text), F.lit("")).alias("text"))
    out = StructType([StructField("term", StringType()), *t.schema.fields[:3], StructField("f", LongType()), StructField("dl", IntegerType())])
    stored = saved(t.mapInArrow(_postings, out), "inverted")
    postings, own = stored.filter("term <> ''"), stored.filter("term = ''")
    sizes = own.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    return Index(postings, postings.groupBy("term", "part").agg(F.count(F.lit(1)).alias("df")), sizes, own.select("part", "key", "row"))


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.nbytes for b in held) >= RUN:
            yield from _run(pa.Table.from_batches(held))
            held = []
    if held:
        yield from _run(pa.Table.from_batches(held))


def _run(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """The postings of some rows (part, key, row, text in lower case) in order of term."""
    n, rows = rows.num_rows, rows.combine_chunks()
    words = _split(rows.column("text"))
    of, words = pc.list_parent_indices(words), words.flatten()
    some = pc.not_equal(words, "")
    of, words = of.filter(some).to_numpy(), words.filter(some).dictionary_encode()
    order = pc.sort_indices(words.dictionary).to_numpy()
    place = np.empty(len(order) + 1, np.int64)
    place[order] = np.arange(1, len(order) + 1)
    found, f = np.unique(place[words.indices.to_numpy()] * n + of, return_counts=True)
    at, f = np.concatenate((np.arange(n), found)), np.concatenate((np.zeros(n, np.int64), f))
    terms = pa.concat_arrays([pa.array([""], words.dictionary.type), words.dictionary.take(pa.array(order))])
    dl = np.bincount(of, minlength=n).astype(np.int32)
    for i in range(0, len(at), PIECE):
        row, x = at[i : i + PIECE] % n, at[i : i + PIECE] // n
        own = rows.select(["part", "key", "row"]).take(pa.array(row)).combine_chunks()
        yield pa.RecordBatch.from_arrays([terms.take(pa.array(x)), *[c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in own.columns], pa.array(f[i : i + PIECE]), pa.array(dl[row])], names=["term", "part", "key", "row", "f", "dl"])


def _split(texts: pa.ChunkedArray) -> pa.Array:
    """Lists of what stands between single white spaces, as `functions.normalize.tokens` knows them; some are empty."""
    whole = pa.concat_arrays([c.cast(pa.string()) for c in texts.chunks])
    validity, offsets, data = whole.buffers()
    plain = data.to_pybytes().translate(SPACES) if data else b""
    return pc.split_pattern(pa.StringArray.from_buffers(len(whole), offsets, pa.py_buffer(plain), validity, whole.null_count, whole.offset), " ")


def _of_terms(table: DataFrame, terms: DataFrame) -> DataFrame:
    """Rows of the terms (column term, distinct): named to the scan if they are few, else joined."""
    few = [r.term for r in terms.limit(NAMED + 1).collect()]
    return table.filter(F.col("term").isin(few)) if len(few) <= NAMED else table.join(terms, "term", "left_semi")


def sparse(index: Index, queries: DataFrame, part: str, key: str, k: int = SPARSE, places: int = 9, k1: float = K1, b: float = B) -> DataFrame:
    """part, query_id, key, score, rank: BM25, the best k of each query in its part; rows without a term of it score 0."""
    asked = saved(queries.select(F.col(part).alias("part"), "query_id", "text"), "asked")
    q = asked.select("part", "query_id", F.explode(tokens(F.lower("text"))).alias("term")).groupBy("part", "query_id", "term").agg(F.count(F.lit(1)).alias("times"))
    terms = q.select("term").distinct()
    # Written, so that their size is known: few weights are broadcast, and postings stay in their tasks.
    weights = saved(q.join(_of_terms(index.dfs, terms), ["term", "part"]).join(index.sizes, "part"), "weights")
    norm = F.lit(k1) * (1 - b + b * F.col("dl") / F.greatest(F.col("avgdl"), F.lit(1e-9)))
    gain = F.col("times") * F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1) * F.col("f") * (k1 + 1) / (F.col("f") + norm)
    hits = _of_terms(index.postings, terms).join(weights, ["term", "part"]).groupBy("part", "query_id", "key", "row").agg(F.round(F.sum(gain), places).alias("score"))
    order = Window.partitionBy("part", "query_id").orderBy(F.desc("score"), "key")
    best = saved(hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).drop("rank"), "hits")
    # Where a part has fewer rows with a hit than k, rows without one follow by key.
    short = asked.select("part", "query_id").distinct().join(best.groupBy("part", "query_id").agg(F.count(F.lit(1)).alias("found")), ["part", "query_id"], "left").filter(F.coalesce("found", F.lit(0)) < k).select("part", "query_id")
    rest = short.join(index.rows, "part").join(best.select("part", "query_id", "key", "row"), ["part", "query_id", "key", "row"], "left_anti").withColumn("score", F.lit(0.0))
    both = best.unionByName(rest.select(best.columns)).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return both.select(F.col("part").alias(part), "query_id", F.col("key").alias(key), "score", "rank")


def dense(rows: DataFrame, queries: DataFrame, part: str, key: str, vector: str = "embedding", k: int = DENSE, places: int = 9) -> DataFrame:
    """part, query_id, key, score (cosine), rank: rows' vectors by the matrix of their part's queries, a batch at a time."""
    ship(rows.sparkSession)
    asked = queries.filter(F.col(vector).isNotNull()).select(part, "query_id", vector)
    own = rows.filter(F.col(vector).isNotNull()).select(F.col(part), F.col(key), F.col(vector))
    held = asked.limit(HELD + 1).toArrow()
    out = StructType([own.schema[part], asked.schema["query_id"], own.schema[key], StructField("score", DoubleType())])
    if held.num_rows > HELD:
        both = own.join(asked.withColumnRenamed(vector, "__asked"), part)
        scored = both.select(part, "query_id", key, F.round(cosine(F.col(vector), F.col("__asked")), places).alias("score"))
    else:
        by_part: dict = {}
        for p, q, v in zip(*(held.column(i).to_pylist() for i in range(3)), strict=True):
            by_part.setdefault(p, []).append((q, v))
        by_part = {p: ([q for q, _ in x], np.array([v for _, v in x], np.float64)) for p, x in by_part.items()}
        sent = rows.sparkSession.sparkContext.broadcast(by_part)

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                parts = batch.column(0).dictionary_encode()
                for at, p in enumerate(parts.dictionary.to_pylist()):
                    if p not in sent.value:
                        continue
                    ids, m = sent.value[p]
                    of = batch.filter(pc.equal(parts.indices, at))
                    v = of.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(of.num_rows, -1)
                    lengths = np.linalg.norm(v, axis=1)[:, None] * np.linalg.norm(m, axis=1)[None, :]
                    scores = np.round(np.where(lengths > 0, (v @ m.T) / np.where(lengths > 0, lengths, 1), 0.0), places)
                    for i, q in enumerate(ids):
                        s = scores[:, i]
                        keep = np.flatnonzero(s >= (np.partition(s, -k)[-k] if len(s) > k else -2))
                        yield pa.RecordBatch.from_arrays([of.column(0).take(pa.array(keep)), pa.array([q] * len(keep), held.schema.field(1).type), of.column(1).take(pa.array(keep)), pa.array(s[keep])], names=[part, "query_id", key, "score"])

        scored = own.mapInArrow(work, out)
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(part, "query_id").orderBy(F.desc("score"), key))).filter(F.col("rank") <= k)


def hybrid(rows: DataFrame, index: Index, queries: DataFrame, part: str, key: str, text: str, vector: str = "embedding", ks: tuple[int, int, int] = (DENSE, SPARSE, FUSED), vectors: DataFrame | None = None) -> DataFrame:
    """part, query_id, key, rrf, rank: each query's best of both lists; three times as many are fused, unclean texts dropped.

    `vectors` (part, key, vector) where the vectors don't stand with the texts, which then needn't be joined.
    """
    d, s = dense(rows if vectors is None else vectors, queries, part, key, vector, ks[0]), sparse(index, queries, part, key, ks[1])
    both = fuse(_asked(d, part), _asked(s, part), "asked", key, RRF)
    each = Window.partitionBy("asked").orderBy(F.desc("rrf"), F.col("d_rank").asc_nulls_last(), F.col("s_rank").asc_nulls_last())
    fused = both.withColumn("place", F.row_number().over(each)).filter(F.col("place") <= 3 * ks[2]).select(F.col("asked.part").alias(part), F.col("asked.query_id").alias("query_id"), key, "rrf", "place")
    kept = picked(fused, rows, part, key, text).filter(is_clean(F.col(text)))
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy(part, "query_id").orderBy("place"))).filter(F.col("rank") <= ks[2]).select(part, "query_id", key, "rrf", "rank")


def _asked(ranked: DataFrame, part: str) -> DataFrame:
    return ranked.withColumn("asked", F.struct(F.col(part).alias("part"), F.col("query_id").alias("query_id")))


def merged(lists: DataFrame, part: str, key: str) -> DataFrame:
    """The lists of a part's queries, one after the other by query_id; a row that several found stands where it came first."""
    first = keep_first(lists, [part, key], [F.col("query_id"), F.col("rank")])
    return first.withColumn("pos", F.row_number().over(Window.partitionBy(part).orderBy("query_id", "rank")))


def search(index: Index, query: str, limit: int = 100) -> DataFrame:
    """key, attempt: rows that hold all terms of the first attempt that any row answers, the first `limit` by key.

    As `expand.search`, but only the postings of the query's terms are read.
    """
    tries = [[t.lower() for t in ts] for ts in attempts(query)]
    terms = sorted({t for ts in tries for t in ts})
    held = index.postings.filter(F.col("term").isin(terms)).groupBy("part", "key", "row").agg(F.collect_set("term").alias("has"))
    holds: Column = F.coalesce(*[F.when(F.size(F.array_except(F.array(*map(F.lit, ts)), "has")) == 0, F.lit(i)) for i, ts in enumerate(tries)], F.lit(None).cast("int")) if tries else F.lit(None).cast("int")
    first = held.select("key", holds.alias("attempt")).filter("attempt is not null").orderBy("attempt", "key").limit(limit)
    return first.withColumn("least", F.min("attempt").over(Window.partitionBy())).filter("attempt = least").select("key", "attempt")  # of `limit` rows
