"""SimHash near-duplicates, linked through BK-trees.

Fingerprints: each word shingle is hashed to 64 bits, and a bit of the fingerprint is 1 if it is set in over half of them.
Links: two fingerprints that differ in at most `radius` bits. Cut into radius + 1 blocks of bits, two linked fingerprints agree
on one whole block at least, so each block deals the distinct fingerprints to shards by its bits (12 or 13 of them), and all
links lie within shards. A shard's BK-tree keys children by their Hamming distance to the parent, and a query follows only
edges within the radius of its own distance: no pair of a shard is compared but those on such edges. All trees of a task are
built and searched together, level by level, in numpy.

The trees of all fingerprints grow with the corpus, so they are not broadcast: a shard's tree and its queries are sent to one
task by the shard's key. A coarse shard of over SHARD fingerprints is dealt again, in the same way, by radius + 1 blocks of
its other bits; one that is still over SHARD is cut into chunks by hash, and each pair of chunks is a task's group of its own
(the tree of one, the queries of the other): exact, but such a shard costs its square. What is broadcast are the dense
shards' keys: of coarse ones there are at most (radius + 1) 2^13, whatever the corpus; of finer ones the list is counted
first and joined with salts if it is long. Tasks emit, for each fingerprint, one link to the smallest of its component in
that group, never all pairs; alternating large and small stars then join these links.

Null texts count as empty. Texts without words have fingerprint zero, which links as any other. Rows with one doc_id count as
rows of their own with equal component. Null doc_ids are never the smallest unless a component has no other: then its id is
null. Very long texts are hashed whole, BLOCK shingles at a time. An empty table gives an empty result; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import HOT, components, hot_keys, spread_join
from .common import discard, map_batches, record, saved, slices, unused

SHINGLE, RADIUS, SEED, SHARD = 4, 4, 42, 4096
#: Rows of a list of dense shards that may be broadcast.
LISTED = 1 << 16
#: Query and node pairs that a search holds at a time.
FRONTIER = 1 << 20
BLOCK = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    width = min(shingle, len(words))
    digest, counts, n = xxhash.xxh64_intdigest, np.zeros(64, np.int64), len(words) - width + 1
    for at in range(0, n, BLOCK):
        stop = min(n, at + BLOCK)
        h = np.array([digest(joined[a:b], seed) for a, b in zip(starts[at:stop].tolist(), ends[at + width - 1 : stop + width - 1].tolist(), strict=True)], "<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id, key (a hash of the text), fp (the fingerprint's 64 bits as a long)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            fps = np.array([fingerprint(x, shingle, seed) for x in part.column("text").to_pylist()], np.uint64)
            yield record(doc_id=part.column("doc_id"), key=part.column("key"), fp=fps.view(np.int64))

    return map_batches(docs.select("doc_id", text_key().alias("key"), "text"), work, "doc_id long, key long, fp long")


def text_key():
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def masks(radius: int) -> list[tuple[int, list[int]]]:
    """For each block of bits: its mask, and the masks of it and one block of the other bits. All are signed longs."""
    n = radius + 1

    def cut(bits: list[int]) -> list[int]:
        edges = [round(len(bits) * i / n) for i in range(n + 1)]
        return [sum(1 << b for b in bits[a:z]) for a, z in zip(edges, edges[1:])]

    coarse = cut(list(range(64)))
    return [(_signed(m), [_signed(m | x) for x in cut([b for b in range(64) if not m >> b & 1])]) for m in coarse]


class Forest:
    """BK-trees over groups of fingerprints (uint64, distinct within a group); tree nodes are indexes into them.

    visited counts the nodes that searches have looked at.
    """

    def __init__(self, fps: np.ndarray, groups: np.ndarray):
        self.fps, self.visited = fps, 0
        n = len(fps)
        self.group_ids, self.roots = np.unique(groups, return_index=True)
        at = self.roots[np.searchsorted(self.group_ids, groups)]
        pending = np.flatnonzero(at != np.arange(n))
        node = at[pending]
        keys, children = [], []
        while len(pending):
            slot = node * 128 + np.bitwise_count(fps[pending] ^ fps[node]).astype(np.int64)
            found, first, inverse = np.unique(slot, return_index=True, return_inverse=True)
            keys.append(found)
            children.append(pending[first])
            node = pending[first][inverse]
            rest = node != pending
            pending, node = pending[rest], node[rest]
        keys = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        children = np.concatenate(children) if children else np.zeros(0, np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.children = keys[order], children[order]

    def search(self, queries: np.ndarray, groups: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query indexes, nodes) of all pairs of one group within the radius."""
        at = np.searchsorted(self.group_ids, groups)
        at[at == len(self.group_ids)] = 0
        live = np.flatnonzero(self.group_ids[at] == groups) if len(self.group_ids) else np.zeros(0, np.int64)
        stack = [(live[i : i + FRONTIER // 16], self.roots[at[live[i : i + FRONTIER // 16]]]) for i in range(0, len(live), FRONTIER // 16)]
        while stack:
            q, node = stack.pop()
            self.visited += len(q)
            d = np.bitwise_count(queries[q] ^ self.fps[node]).astype(np.int64)
            near = d <= radius
            if near.any():
                yield q[near], node[near]
            lo = np.searchsorted(self.keys, node * 128 + np.maximum(d - radius, 0))
            hi = np.searchsorted(self.keys, node * 128 + d + radius, "right")
            n = hi - lo
            has = n > 0
            q, lo, n = q[has], lo[has], n[has]
            total = np.cumsum(n)
            # Cut where the next level would hold more than FRONTIER pairs; a node has at most 65 edges.
            a = 0
            while a < len(q):
                b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + FRONTIER, "right")))
                m, before = n[a:b], total[a:b] - n[a:b] - (total[a - 1] if a else 0)
                pick = np.arange(int(m.sum())) - np.repeat(before, m) + np.repeat(lo[a:b], m)
                stack.append((np.repeat(q[a:b], m), self.children[pick]))
                a = b


def join_labels(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
    """Merge the components of u and v in place: every member's label is its component's least index."""
    while True:
        a, b = label[u], label[v]
        differ = a != b
        if not differ.any():
            return
        u, v, a, b = u[differ], v[differ], a[differ], b[differ]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := label[label], label):
            label[:] = up


def _links(radius: int):
    """From rows (key columns, side, fp), sorted by key: links of one row's fp to the smallest of its component in the group."""

    def solve(keys: np.ndarray, sides: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        tree = sides < 1  # side 0: tree and queries; -1: tree alone; 1: queries alone
        index = np.flatnonzero(tree)
        forest = Forest(fps[tree], keys[tree])
        asks = np.flatnonzero(sides >= 0)
        label = np.arange(len(fps))
        for q, node in forest.search(fps[asks], keys[asks], radius):
            join_labels(label, asks[q], index[node])
        at = np.flatnonzero(label != np.arange(len(label)))
        signed = fps.view(np.int64)
        return record(u=signed[at], v=signed[label[at]])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0

        def columns():
            t = pa.Table.from_batches(held)
            k = [t.column(c).to_numpy() for c in ("c", "shard", "a", "b")]
            change = np.zeros(len(t), bool)
            for x in k:
                change[1:] |= x[1:] != x[:-1]
            return np.cumsum(change), t.column("side").to_numpy(), t.column("fp").to_numpy().view(np.uint64), t

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows >= 1 << 18:
                keys, sides, fps, t = columns()
                stop = int(np.searchsorted(keys, keys[-1]))  # the last group may go on
                if stop:
                    yield solve(keys[:stop], sides[:stop], fps[:stop])
                    held = t.slice(stop).combine_chunks().to_batches()
                    rows -= stop
        if held:
            keys, sides, fps, _ = columns()
            yield solve(keys, sides, fps)

    return work


def _dealt(rows: DataFrame, deals: list[tuple[int, int, int]], of: bool) -> DataFrame:
    """c, shard, fp: each row's fp under the mask of each deal (number, block it refines, mask); with `of`, of its own block alone."""
    every = F.array(*[F.struct(F.lit(i).alias("c"), F.lit(block).alias("of"), F.col("fp").bitwiseAND(F.lit(m)).alias("shard")) for i, block, m in deals])
    return rows.select("fp", F.explode(F.filter(every, lambda x: x["of"] == F.col("c")) if of else every).alias("k")).select("k.c", "k.shard", "fp")


def _split_dense(rows: DataFrame, shard: int, name: str) -> tuple[DataFrame, DataFrame | None]:
    """rows of shards of at most `shard` fingerprints, and the rest with their shard's size n (None if there is none).

    Sizes are summed by task before they are shuffled; no shard is ever gathered.
    """
    sizes = saved(rows.groupBy("c", "shard").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > shard), name)
    n = sizes.count()
    if not n:
        return rows, None
    if n <= LISTED:
        sized = rows.join(F.broadcast(sizes), ["c", "shard"], "left")
    else:
        key = F.struct("c", "shard")
        sized = spread_join(rows.withColumn("k", key), sizes.select(key.alias("k"), "n"), "k", "fp", sizes.select(key.alias("k")), "left").drop("k")
    return sized.filter("n is null").drop("n"), sized.filter("n is not null")


def links(fps: DataFrame, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """u, v: within each shard a star for each component of linked fingerprints. fps: distinct values of fp."""
    blocks = masks(radius)
    whole = lambda d: d.select("c", "shard", F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(0).alias("side"), "fp")
    near, dense = _split_dense(_dealt(fps, [(i, -1, m) for i, (m, _) in enumerate(blocks)], False), shard, "dense")
    groups = whole(near)
    if dense is not None:
        fine = [(len(blocks) * (i + 1) + j, i, m) for i, (_, more) in enumerate(blocks) for j, m in enumerate(more)]
        near, dense = _split_dense(saved(_dealt(dense, fine, True), "fine"), shard, "denser")
        groups = groups.unionByName(whole(near))
    if dense is not None:
        # Chunk x is the tree of every pair (x, y), y >= x, and the queries of every pair (w, x), w <= x.
        chunks = F.ceil(F.col("n") / F.lit(shard)).cast("int")
        large = dense.withColumn("chunks", chunks).withColumn("x", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
        pairs = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda y: F.struct(F.least("x", y).alias("a"), F.greatest("x", y).alias("b"), F.when(y == F.col("x"), 0).when(F.col("x") < y, -1).otherwise(1).alias("side")))
        groups = groups.unionByName(large.select("c", "shard", "fp", F.explode(pairs).alias("p")).select("c", "shard", "p.a", "p.b", "p.side", "fp"))
    placed = groups.repartition("c", "shard", "a", "b").sortWithinPartitions("c", "shard", "a", "b", "side", "fp")
    return map_batches(placed, _links(radius), "u long, v long").distinct()


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, shard: int = SHARD, hot: int = HOT) -> DataFrame:
    """doc_id, key, fp, root (the component's least fingerprint), component_id of each row of docs."""
    fps = saved(fingerprints(docs, shingle), "fps")
    first = saved(fps.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")), "distinct")
    rows, kinds = first.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    roots = components(links(first.select("fp"), radius, shard), "stars", hot)
    placed = saved(first.join(roots.withColumnRenamed("v", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), "placed")
    least = placed.groupBy("root").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("n"))
    by_fp = saved(spread_join(placed, least.select("root", "component_id"), "root", "fp", hot_keys(least, "root", kinds, hot)).select("fp", "root", "component_id"), "components")
    # A copied text's fingerprint is a key that many rows hold.
    spread = spread_join(fps, by_fp, "fp", "doc_id", hot_keys(first, "fp", rows, hot))
    discard(roots, placed)
    return spread.select("doc_id", "key", "fp", "root", "component_id")


def simhash_components(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of each document."""
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """One document of each component, with all its columns: the least doc_id's (null: the last), then the least text key's.

    Groups are reduced to ids before any text moves; rows of equal id and text count as one. Columns of any name are kept.
    """
    null, id_, key = (unused(docs, x) for x in ("null", "id", "key"))
    order = F.struct(F.col("doc_id").isNull().alias(null), F.coalesce("doc_id", F.lit(0)).alias(id_), F.col("key").alias(key))
    first = near_duplicates(docs).groupBy("root").agg(F.min(order).alias("r")).select("r.*")
    placed = docs.select("*", F.col("doc_id").isNull().alias(null), F.coalesce("doc_id", F.lit(0)).alias(id_), text_key().alias(key))
    return placed.join(first, [null, id_, key], "left_semi").dropDuplicates([null, id_, key]).select(*docs.columns)
