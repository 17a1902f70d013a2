"""Ranked lexical search by variable-block-max WAND over shards of an inverted index.

Shards. One pass counts the documents with terms (N) and their terms (L). A second one writes the index: each SHARD_BYTES of a
partition's texts make a shard, one row with its documents' ids and sizes, its terms with their document frequencies, and the
posting lists (gaps between documents and occurrences, in byte planes). Every term of every document is there. A shard is a row
group of its own, as readers and writers hold whole row groups: a task holds one shard, however many its files have.

Variable blocks. A posting's impact is its part of the score without the term's weight. Each list is cut into blocks by dynamic
programming over granules of GRANULE postings: the cuts minimise the sum, over blocks, of (largest impact x postings), that is
the error of taking each block's largest impact for all its postings, plus a price for each block; a block has at most
WIDEST granules. Blocks and their largest impacts are stored with the shard.

Search. Queries are a table; a block of them, bounded by its terms, is broadcast, and every task looks it up in its shards.
For a query in a shard the block bounds (weight x largest impact) of all its terms, summed wherever blocks overlap, bound each
document's score. Documents whose bound is below the threshold, the lowest of the best k so far, are skipped with their blocks,
without decoding a posting's impact. WAND's pivot rule then drops documents that only occur in lists whose bounds together
stay below the threshold. What is left is scored exactly, in all lists. The threshold starts at what SEEDS shards alone reach,
and a task carries it on from shard to shard; as it is always a score that k documents reach, no document of the best k is lost.

Null texts have no terms. Documents with equal scores follow by ascending doc_id, null last; repeated rows are documents of their
own. Items with a null id are left out; repeated item_ids are one item with the terms of all its texts. Items without terms
that occur give no row. Very long texts are indexed whole, in a shard of their own. An empty table gives no rows. Other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SLICE_BYTES, WORD_BYTES, map_batches, record, saved, slices
from .terms import Terms

TOP, SHARD_BYTES, SEEDS = 50, 16 << 20, 4
GRANULE, WIDEST, PRICE = 4, 24, 3
#: (item, term) rows of a block of queries.
BLOCK_TERMS = 1 << 18
#: Documents that are scored first where fewer than k are known.
FIRST = 256
#: Different query terms that may be broadcast while document frequencies are summed.
LISTED = 1 << 18

#: How the index is written: a row group for each row, and no statistics of blobs: a writer keeps their least and largest, whole
#: blobs here, until its file ends.
ROW_GROUPS = {"parquet.block.row.count.limit": 1} | {f"parquet.column.statistics.enabled#{c}": "false" for c in ("sizes", "gaps", "tfs", "ends", "maxima")}
INDEX = "shard long, ids array<long>, sizes binary, terms array<string>, dfs array<int>, gaps binary, tfs binary, cuts array<int>, ends binary, maxima binary"


def planes(x: np.ndarray) -> bytes:
    """uint32 values as four planes of bytes, the highest last: mostly zeros, which compress."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def unplanes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[i] to starts[i] + counts[i], one after another."""
    ends = np.cumsum(counts)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


def norms(sizes: np.ndarray, n: int, total: int) -> np.ndarray:
    """m of each document."""
    return 50 + (50 * sizes * n) // max(total, 1)


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def variable_blocks(counts: np.ndarray, impact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Blocks of lists that stand end to end: the number of blocks of each list, and the end of each block (a posting's index).

    best[g]: the least cost of the first g granules of a list, all lists at once, one granule after the other.
    """
    n_lists = len(counts)
    size = -(-counts // GRANULE)
    offset = np.cumsum(size) - size
    starts = np.cumsum(counts) - counts
    if not n_lists:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inner = ranges(np.zeros(n_lists, np.int64), size)
    g_start = np.repeat(starts, size) + inner * GRANULE
    g_end = np.minimum(g_start + GRANULE, np.repeat(starts + counts, size))
    top = np.maximum.reduceat(impact, g_start)
    length = g_end - g_start
    peak, mean = np.maximum.reduceat(impact, starts), np.add.reduceat(impact, starts) / counts
    price = (PRICE * (peak - mean)).astype(np.int64) + 1
    order = np.argsort(-size, kind="stable")
    order = order[size[order] > 1]
    first, price, n = offset[order], price[order], size[order]
    best = np.zeros(int(size.sum()) + n_lists, np.int64)
    slot = first + order  # list i has size[i] + 1 places from offset[i] + i on
    back = np.ones(int(size.sum()), np.int64)
    for g in range(int(n[0]) if len(n) else 0):
        live = int(np.searchsorted(-n, -g, "left"))
        f, s, p = first[:live] + g, slot[:live] + g, price[:live]
        high, wide = top[f], length[f]
        least, step = best[s] + high * wide, np.ones(live, np.int64)
        for k in range(2, min(WIDEST, g + 1) + 1):
            high, wide = np.maximum(high, top[f - k + 1]), wide + length[f - k + 1]
            cost = best[s - k + 1] + high * wide
            better = cost < least
            least[better], step[better] = cost[better], k
        best[s + 1], back[f] = least + p, step
    cut = np.zeros(len(back), bool)  # granules that end a block
    cut[offset[size == 1]] = True
    f, left = first, n.copy()
    while len(left):
        at = f + left - 1
        cut[at] = True
        left = left - back[at]
        more = left > 0
        f, left = f[more], left[more]
    return np.add.reduceat(cut, offset).astype(np.int64), g_end[cut]


def corpus_size(docs: DataFrame) -> tuple[int, int]:
    """Documents with a term, and all their terms with repeats."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = total = 0
        for part in slices(batches, "text"):
            sizes = Terms(part.column("text"), WORD_BYTES).sizes
            n, total = n + int((sizes > 0).sum()), total + int(sizes.sum())
        yield record(n=[n], total=[total])

    found = map_batches(docs.select("text"), work, "n long, total long").agg(F.sum("n"), F.sum("total")).first()
    return int(found[0] or 0), int(found[1] or 0)


def shard(part: pa.RecordBatch, n: int, total: int) -> pa.RecordBatch:
    terms = Terms(part.column("text"), WORD_BYTES)
    code, doc, tf = terms.postings()
    counts = np.bincount(code, minlength=len(terms.dictionary)).astype(np.int64)
    impact = impacts(tf, norms(terms.sizes, n, total)[doc])
    cuts, ends = variable_blocks(counts, impact)
    gaps = np.diff(doc, prepend=-1)
    starts = np.cumsum(counts) - counts
    gaps[starts] = doc[starts] + 1
    maxima = np.maximum.reduceat(impact, np.concatenate(([0], ends[:-1]))) if len(ends) else ends
    lists = lambda x, kind: pa.array([x], pa.list_(kind))
    blob = lambda x: pa.array([planes(x)], pa.binary())
    return record(
        ids=lists(part.column("doc_id").cast(pa.int64()), pa.int64()), sizes=blob(terms.sizes), terms=lists(terms.dictionary.cast(pa.utf8()), pa.utf8()), dfs=lists(counts.astype(np.int32), pa.int32()),
        gaps=blob(gaps), tfs=blob(tf), cuts=lists(cuts.astype(np.int32), pa.int32()), ends=blob(ends), maxima=blob(maxima),
    )


def build(docs: DataFrame) -> tuple[DataFrame, int, int]:
    """The stored index, a row for each shard, with N and L."""
    n, total = corpus_size(docs)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, number = 0, TaskContext.get().partitionId() << 32

        def row() -> pa.RecordBatch:
            x = shard(pa.Table.from_batches(held).combine_chunks().to_batches()[0], n, total)
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *x.columns], names=["shard", *x.schema.names])

        for part in slices(batches, "text", SHARD_BYTES):
            if held and size + part.nbytes > SHARD_BYTES:
                yield row()
                held, size, number = [], 0, number + 1
            held.append(part)
            size += part.nbytes
        if held:
            yield row()

    return saved(map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), work, INDEX), "postings", **ROW_GROUPS), n, total


class Shard:
    """A shard's lists, decoded: which documents, how often, and in which blocks."""

    def __init__(self, row: dict, n: int, total: int):
        self.ids, self.terms = row["ids"], row["terms"]
        self.m = norms(unplanes(row["sizes"]), n, total)
        self.counts = row["dfs"].to_numpy(zero_copy_only=False).astype(np.int64)
        self.starts = np.cumsum(self.counts) - self.counts
        walk = np.cumsum(unplanes(row["gaps"]))
        self.doc = walk - np.repeat(np.concatenate(([0], walk[self.starts[1:] - 1])), self.counts) - 1 if len(walk) else walk
        self.tf = unplanes(row["tfs"])
        self.n_blocks = row["cuts"].to_numpy(zero_copy_only=False).astype(np.int64)
        self.first_block = np.cumsum(self.n_blocks) - self.n_blocks
        self.block_end, self.maximum = unplanes(row["ends"]), unplanes(row["maxima"])
        self.block_start = np.concatenate(([0], self.block_end[:-1])).astype(np.int64)
        if len(self.block_end):
            self.low, self.high = self.doc[self.block_start], self.doc[self.block_end - 1]
        #: Postings whose impact was computed, of all in the lists that were asked.
        self.scored = self.asked = 0

    def _touched(self, blocks: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Which blocks span a wanted document."""
        before = np.concatenate(([0], np.cumsum(wanted)))
        return before[self.high[blocks] + 1] > before[self.low[blocks]]

    def _scores(self, blocks: np.ndarray, weight: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Exact scores of the wanted documents, from the blocks that span one."""
        out = np.zeros(len(self.m), np.int64)
        on = self._touched(blocks, wanted)
        blocks, weight = blocks[on], weight[on]
        counts = self.block_end[blocks] - self.block_start[blocks]
        at, weight = ranges(self.block_start[blocks], counts), np.repeat(weight, counts)
        keep = wanted[self.doc[at]]
        at, weight = at[keep], weight[keep]
        self.scored += len(at)
        doc = self.doc[at]
        np.add.at(out, doc, weight * impacts(self.tf[at], self.m[doc]))
        return out

    def best(self, lists: np.ndarray, weights: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of all that score `least` or more and may be among the best k."""
        self.asked += int(self.counts[lists].sum())
        n = self.n_blocks[lists]
        blocks, weight = ranges(self.first_block[lists], n), np.repeat(weights, n)
        bound = weight * self.maximum[blocks]
        steps = np.zeros(len(self.m) + 1, np.int64)
        np.add.at(steps, self.low[blocks], bound)
        np.subtract.at(steps, self.high[blocks] + 1, bound)
        ceiling = np.cumsum(steps)[:-1]
        if not len(ceiling) or ceiling.max() < least:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        if least <= 1 and len(ceiling) > FIRST:  # no threshold yet: the documents with the highest bounds give one
            wanted = np.zeros(len(ceiling), bool)
            wanted[np.argpartition(-ceiling, FIRST)[:FIRST]] = True
            scores = self._scores(blocks, weight, wanted)
            if len(scores) >= k:
                least = max(least, int(np.partition(scores, -k)[-k]))
        wanted = ceiling >= least
        # The pivot rule: what occurs only in lists whose bounds together stay below the threshold can't reach it.
        edges = np.cumsum(n) - n
        whole = np.maximum.reduceat(bound, edges)
        order = np.argsort(whole, kind="stable")
        rest = np.zeros(len(lists), bool)
        rest[order[np.cumsum(whole[order]) < least]] = True
        if rest.any():
            on = np.repeat(~rest, n)
            on[on] = self._touched(blocks[on], wanted)
            b = blocks[on]
            pivots = np.zeros(len(wanted), bool)
            pivots[self.doc[ranges(self.block_start[b], self.block_end[b] - self.block_start[b])]] = True
            wanted &= pivots
        scores = self._scores(blocks, weight, wanted)
        found = np.flatnonzero(scores >= least)
        return found, scores[found]


def _rank(scores: np.ndarray, ids: np.ndarray, null: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, null, -scores))[:k]


class Queries:
    """A block of queries: items, all their terms, and each item's terms (indexes) with weights."""

    def __init__(self, rows: pa.Table):
        rows = rows.combine_chunks()
        self.items = rows.column("item_id").combine_chunks()
        lists = rows.column("terms").combine_chunks()
        said = lists.flatten()
        self.terms = pc.unique(said.field("term"))
        self.ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))
        self.term = pc.index_in(said.field("term"), value_set=self.terms).to_numpy(zero_copy_only=False)
        self.weight = said.field("w").to_numpy(zero_copy_only=False).astype(np.int64)

    def of(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        part = slice(self.ends[i - 1] if i else 0, self.ends[i])
        return self.term[part], self.weight[part]


def _searched(index: DataFrame, queries, least, n: int, total: int, k: int, item_type: str) -> DataFrame:
    """item_id, doc_id, score: each task's best k of each query of a broadcast block, none below its `least`."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = queries.value
        start = least.value if least is not None else np.ones(len(asked.items), np.int64)
        empty = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))
        held = [empty] * len(asked.items)
        for batch in batches:
            for r in range(batch.num_rows):
                row = {c: (x.slice(r, 1).flatten() if pa.types.is_list(x.type) else x[r].as_py()) for c, x in zip(batch.schema.names, batch.columns, strict=True)}
                part = Shard(row, n, total)
                place = pc.fill_null(pc.index_in(asked.terms, value_set=part.terms.cast(asked.terms.type)), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                null = part.ids.is_null().to_numpy(zero_copy_only=False)
                ids = pc.fill_null(part.ids, 0).to_numpy(zero_copy_only=False)
                for i in range(len(held)):
                    term, weight = asked.of(i)
                    lists = place[term]
                    here = lists >= 0
                    if not here.any():
                        continue
                    scores, old, gone = held[i]
                    floor = max(int(start[i]), int(scores[-1]) if len(scores) == k else 1)
                    docs, new = part.best(lists[here], weight[here], k, floor)
                    if len(docs):
                        scores, old, gone = np.concatenate((scores, new)), np.concatenate((old, ids[docs])), np.concatenate((gone, null[docs]))
                        top = _rank(scores, old, gone, k)
                        held[i] = scores[top], old[top], gone[top]
        sizes = [len(h[0]) for h in held]
        if sum(sizes):
            item = asked.items.take(pa.array(np.repeat(np.arange(len(held)), sizes)))
            scores, ids, null = (np.concatenate(x) for x in zip(*held, strict=True))
            yield record(item_id=item, doc_id=pa.array(ids, mask=null), score=scores)

    return map_batches(index, work, f"item_id {item_type}, doc_id long, score long")


def best_of(found: DataFrame, k: int) -> DataFrame:
    """The best k rows of each item, ranked: in 16 parts of each item first, so that no task sorts all tasks' rows of one."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    parts = found.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(16))).withColumn("rank", F.row_number().over(Window.partitionBy("item_id", "part").orderBy(*order))).filter(F.col("rank") <= k)
    return parts.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def item_terms(items: DataFrame) -> DataFrame:
    """item_id, term: each once."""
    kind = items.schema["item_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", SLICE_BYTES):
            terms = Terms(part.column("text"), WORD_BYTES)
            code, doc, _ = terms.postings()
            yield record(item_id=part.column("item_id").take(pa.array(doc)), term=terms.dictionary.take(pa.array(code)).cast(pa.utf8()))

    return map_batches(items.filter("item_id is not null").select("item_id", "text"), work, f"item_id {kind}, term string").distinct()


def weighted(index: DataFrame, items: DataFrame, n: int) -> DataFrame:
    """item_id, term, w: the items' terms that occur, with their weights."""
    asked = saved(item_terms(items), "asked")
    terms = asked.select("term").distinct()
    held = index.select(F.explode(F.arrays_zip("terms", "dfs")).alias("t")).select(F.col("t.terms").alias("term"), F.col("t.dfs").cast("long").alias("df"))
    few = terms.count() <= LISTED
    kept = held.join(F.broadcast(terms), "term", "left_semi") if few else held.join(terms, "term", "left_semi")
    dfs = kept.groupBy("term").agg(F.sum("df").alias("df"))
    w = F.floor(F.lit(1000.0) * F.log(F.lit(2 * n + 2).cast("double") / (2 * F.col("df") + 1).cast("double"))).cast("long")
    return asked.join(dfs.select("term", w.alias("w")), "term").select("item_id", "term", "w")


def search(index: DataFrame, n: int, total: int, items: DataFrame, k: int = TOP, block: int = BLOCK_TERMS) -> DataFrame:
    """item_id, rank, doc_id, score: the best k documents of each item over a stored index."""
    spark = index.sparkSession
    kind = items.schema["item_id"].dataType.simpleString()
    terms = saved(weighted(index, items, n), "weights")
    n_blocks = max(1, -(-terms.count() // block))
    asked = saved(terms.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(n_blocks))).groupBy("block", "item_id").agg(F.collect_list(F.struct("term", "w")).alias("terms")), "queries")
    found = spark.createDataFrame([], f"item_id {kind}, doc_id long, score long")
    # By number, which row groups are skipped by; a limit would shuffle the first shards of every task.
    few = index.filter(F.col("shard").isin([r.shard for r in index.select("shard").orderBy(F.xxhash64("shard")).limit(SEEDS).collect()]))
    for b in range(n_blocks):
        rows = asked.filter(F.col("block") == b).select("item_id", "terms").orderBy("item_id").toArrow()
        if not rows.num_rows:
            continue
        queries = spark.sparkContext.broadcast(Queries(rows))
        seeds = best_of(_searched(few, queries, None, n, total, k, kind), k).filter(F.col("rank") == k).select("item_id", "score").toArrow()
        reached = dict(zip(seeds.column("item_id").to_pylist(), seeds.column("score").to_pylist(), strict=True))
        least = spark.sparkContext.broadcast(np.array([reached.get(i, 1) for i in rows.column("item_id").to_pylist()], np.int64))
        found = found.unionByName(_searched(index, queries, least, n, total, k, kind))
    return best_of(found, k)


def ranked(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """Index all documents and search them for each item."""
    return search(*build(docs), items, k)
