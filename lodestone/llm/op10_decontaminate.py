"""Benchmark decontamination by winnowing.

Of the GRAM-word hashes in each window of RUN consecutive ones, winnowing keeps the least; any shared span of
GRAM + RUN - 1 = 10 words then shares a kept fingerprint. Test fingerprints are joined with those of each document, and hits
are extended: a document window that shares its fingerprint is compared with the test windows by their whole hash and then
by their words, and neighbouring windows make up the hit span. Items of fewer than 10 words are one window each; there every
run of that many words is a fingerprint (a window of one).

A benchmark of at most BROADCAST_BYTES of text is a set of queries run against all documents, in blocks of about BLOCK_BYTES
(an item longer than that is a block of its own). Executors build each block's index, plain arrays of some ten times the
block's bytes at most; blocks are written one a file, pass through the driver one at a time and are broadcast.

A larger benchmark is joined by shuffle. Its fingerprints become a filter of fixed size (2^SIEVE_BITS bits, broadcast), which
only saves work: document windows whose fingerprint may be the benchmark's are kept with their words, and windows are joined on
those words. Texts are known by their SHA-256 there, so copies of one text are matched once; windows and texts that hold many
rows are salted. The rows are the same either way.

Null or wordless texts have no words and no hits; null and wordless items never hit, items with a null id are left out.
Repeated rows are scored each; repeated item_ids count once, and an id's texts all count for it. Very long texts are looked
through whole; a document is never cut. Empty tables give empty results, an empty benchmark no hits. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.components import hot_keys, spread_join
from .common import Words, gram_hashes, map_batches, mix, record, saved, slices, unused

WINDOW, GRAM, BLOCK_BYTES, BROADCAST_BYTES = 10, 5, 8 << 20, 32 << 20
#: Bits of the filter for larger benchmarks, and tasks that each make one.
SIEVE_BITS, SIEVE_TASKS = 28, 32
RUN = WINDOW - GRAM + 1
_SIEVE = 20


def window_minima(grams: np.ndarray, run: int) -> np.ndarray:
    """The least of each `run` consecutive hashes."""
    n = len(grams) - run + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    out = grams[:n].copy()
    for j in range(1, run):
        np.minimum(out, grams[j : j + n], out=out)
    return out


class Lookup:
    """Membership in a set of hashes: a table of their low bits first, then a search."""

    def __init__(self, hashes: np.ndarray):
        self.sorted = np.unique(hashes)
        self.sieve = np.zeros(1 << _SIEVE, bool)
        self.sieve[self.sorted & np.uint64((1 << _SIEVE) - 1)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indexes of the hashes that are members, and their places in the sorted set."""
        at = np.flatnonzero(self.sieve[hashes & np.uint64((1 << _SIEVE) - 1)])
        place = np.minimum(np.searchsorted(self.sorted, hashes[at]), max(len(self.sorted) - 1, 0))
        good = self.sorted[place] == hashes[at] if len(self.sorted) else np.zeros(0, bool)
        return at[good], place[good]


def _edges(*columns: np.ndarray) -> np.ndarray:
    """Where a row of sorted columns differs from the one before."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


class Level:
    """All windows of one length as arrays: hashes, each one's different texts, and each text's items.

    The texts of hash k are text_at[k] to text_at[k + 1]; text t begins with word first[t] of the block, and its items are
    items[item_at[t]] to items[item_at[t + 1]].
    """

    def __init__(self, length: int, gram: int, prints, hashes, others, first, items):
        self.length, self.gram, self.run = length, gram, length - gram + 1
        self.lookup = Lookup(prints)
        order = np.lexsort((items, others, hashes))
        hashes, others, first, items = hashes[order], others[order], first[order], items[order]
        kept = _edges(hashes, others, items)
        hashes, others, first, self.items = hashes[kept], others[kept], first[kept], items[kept]
        texts = np.flatnonzero(_edges(hashes, others))
        self.item_at = np.append(texts, len(hashes)).astype(np.int32)
        hashes, self.first = hashes[texts], first[texts]
        self.text_at = np.append(np.flatnonzero(_edges(hashes)), len(hashes)).astype(np.int32)
        self.whole = Lookup(hashes)

    def hits(self, words: Words, block: Index) -> Iterator[tuple[int, np.ndarray]]:
        """(first word, items) of each window of this level that occurs."""
        minima = window_minima(gram_hashes(words.hash, self.gram), self.run)
        shared, _ = self.lookup.find(minima)
        shared = shared[words.doc[shared] == words.doc[shared + self.length - 1]]
        if not len(shared):
            return
        rows = words.hash[shared[:, None] + np.arange(self.length)]
        at, place = self.whole.find(_rows(rows))
        for i, k in zip(shared[at].tolist(), place.tolist(), strict=True):
            said = words.text(i, self.length)
            for t in range(self.text_at[k], self.text_at[k + 1]):
                if block.text(int(self.first[t]), self.length) == said:
                    yield i, self.items[self.item_at[t] : self.item_at[t + 1]]


def _rows(rows: np.ndarray) -> np.ndarray:
    """gram_hashes of each row."""
    return gram_hashes(np.ascontiguousarray(rows).ravel(), rows.shape[1])[:: rows.shape[1]]


def _windows(words: Words, window: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each length of the items' windows, and the words at which such windows begin."""
    size = words.counts[words.doc]  # words of each word's item
    for n in np.unique(np.minimum(words.counts, window)).tolist():
        if n:
            m = len(size) - n + 1
            yield n, np.flatnonzero((words.doc[:m] == words.doc[n - 1 :]) & ((size[:m] >= n) if n == window else (size[:m] == n)))


def _spaced(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words end to end, one space apart, with their starts and ends."""
    lengths = words.ends - words.starts
    ends = np.cumsum(lengths + 1) - 1
    stream = np.full(int(ends[-1]) + 1 if len(ends) else 0, 0x20, np.uint8)
    stream[np.arange(int(lengths.sum())) + np.repeat(np.arange(len(lengths)), lengths)] = words.bytes[words.bytes != 0]
    return stream, ends - lengths, ends


def _prints(words: Words, n: int, window: int = WINDOW, gram: int = GRAM) -> np.ndarray:
    """The fingerprint of the window of n words at each word."""
    gram = gram if n == window else n
    return window_minima(gram_hashes(words.hash, gram), n - gram + 1)


class Index:
    """A block of items: names, the words of all (lower-cased, one space apart) and the levels of window lengths."""

    def __init__(self, window: int = WINDOW, gram: int = GRAM):
        self.window, self.gram, self.size = window, gram, 0
        self.numbers: dict[str, int] = {}
        self.words, self.chars = 0, 0
        self.parts: dict[int, list[tuple]] = {}
        self.held: list[tuple] = []

    def add(self, names: list[str], texts: pa.Array) -> None:
        words = Words(texts)
        self.size += len(words.bytes)
        numbers = np.array([self.numbers.setdefault(x, len(self.numbers)) for x in names], np.int32)
        stream, starts, ends = _spaced(words)
        self.held.append((stream, (starts + self.chars).astype(np.int64), (ends + self.chars).astype(np.int64)))
        other = mix(words.hash ^ np.uint64(0x5851F42D4C957F2D))
        for n, at in _windows(words, self.window):
            prints, hashes = _prints(words, n, self.window, self.gram)[at], gram_hashes(words.hash, n)
            self.parts.setdefault(n, []).append((np.unique(prints), hashes[at], gram_hashes(other, n)[at], (at + self.words).astype(np.int32), numbers[words.doc[at]]))
        self.words += len(words.starts)
        self.chars += len(stream)

    def close(self) -> Index:
        self.names = list(self.numbers)
        self.stream, self.starts, self.ends = (np.concatenate(x) for x in zip(*self.held, strict=True))
        if self.chars < 1 << 31:
            self.starts, self.ends = self.starts.astype(np.int32), self.ends.astype(np.int32)
        self.levels = []
        for n in sorted(self.parts):
            self.levels.append(Level(n, self.gram if n == self.window else n, *(np.concatenate(x) for x in zip(*self.parts[n], strict=True))))
            self.parts[n] = []
        del self.held, self.parts, self.numbers
        return self

    def text(self, i: int, n: int) -> bytes:
        """Words i to i + n, joined by a space."""
        return self.stream[self.starts[i] : self.ends[i + n - 1]].tobytes()


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.filter("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("item_id"), "text")


def blocks(benchmark: DataFrame, limit: int) -> Iterator[Index]:
    """The indexes of the items, in blocks of about `limit` bytes, built on executors and read one at a time."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index()
        for part in slices(batches, "text", min(limit, 1 << 20)):
            if index.size and index.size + part.column("text").nbytes > limit:
                yield record(blob=pa.array([pickle.dumps(index.close(), protocol=5)], pa.binary()))
                index = Index()
            index.add(part.column("item_id").to_pylist(), part.column("text"))
        if index.size:
            yield record(blob=pa.array([pickle.dumps(index.close(), protocol=5)], pa.binary()))

    for row in saved(map_batches(_items(benchmark), work, "blob binary"), "benchmark", maxRecordsPerFile=1).toLocalIterator():
        yield pickle.loads(row.blob)


def matched(docs: DataFrame, benchmark: DataFrame, emit: Callable, schema, limit: int = BLOCK_BYTES) -> DataFrame:
    """Run all blocks over docs; emit(part, words, covered, items): covered marks the hit words, items has each row's item names."""
    spark = docs.sparkSession
    indexes = [spark.sparkContext.broadcast(x) for x in blocks(benchmark, limit)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            words = Words(part.column("text"))
            steps = np.zeros(len(words.hash) + 1, np.int64)
            items: list[set[str]] = [set() for _ in range(part.num_rows)]
            for index in (x.value for x in indexes):
                for level in index.levels:
                    for i, found in level.hits(words, index):
                        steps[i] += 1
                        steps[i + level.length] -= 1
                        items[words.doc[i]].update(index.names[x] for x in found.tolist())
            yield emit(part, words, np.cumsum(steps[:-1]) > 0, items)

    return map_batches(docs, work, schema)


class Sieve:
    """Which hashes may be among those added: two of 2^SIEVE_BITS bits tell of each."""

    def __init__(self, bits: np.ndarray | None = None):
        self.bits = np.zeros(1 << SIEVE_BITS - 3, np.uint8) if bits is None else bits

    @staticmethod
    def _places(hashes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for p in (hashes & np.uint64((1 << SIEVE_BITS) - 1), hashes >> np.uint64(64 - SIEVE_BITS)):
            yield p >> np.uint64(3), np.uint8(1) << (p & np.uint64(7)).astype(np.uint8)

    def add(self, hashes: np.ndarray) -> None:
        for at, bit in self._places(hashes):
            np.bitwise_or.at(self.bits, at, bit)

    def may(self, hashes: np.ndarray) -> np.ndarray:
        return np.logical_and.reduce([(self.bits[at] & bit) != 0 for at, bit in self._places(hashes)])


def _item_windows(benchmark: DataFrame) -> DataFrame:
    """n, said (its words), items (all that hold it, sorted) of each different window of the benchmark."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            words = Words(part.column("text"))
            stream, starts, ends = _spaced(words)
            for n, at in _windows(words, WINDOW):
                said = [stream[starts[i] : ends[i + n - 1]].tobytes() for i in at.tolist()]
                yield record(n=np.full(len(at), n, np.int32), said=pa.array(said, pa.binary()), item=part.column("item_id").take(pa.array(words.doc[at])))

    return map_batches(_items(benchmark), work, "n int, said binary, item string").groupBy("n", "said").agg(F.sort_array(F.collect_set("item")).alias("items"))


def _sieve(benchmark: DataFrame) -> Sieve:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sieve = Sieve()
        for part in slices(batches, "text"):
            words = Words(part.column("text"))
            for n, at in _windows(words, WINDOW):
                sieve.add(np.unique(_prints(words, n)[at]))
        yield record(bits=pa.array([sieve.bits.tobytes()], pa.binary()))

    whole = Sieve()
    for row in saved(map_batches(_items(benchmark).coalesce(SIEVE_TASKS), work, "bits binary"), "sieve", maxRecordsPerFile=1).toLocalIterator():
        whole.bits |= np.frombuffer(row.bits, np.uint8)
    return whole


def _hot(rows: DataFrame, key: str, among: DataFrame | None = None) -> DataFrame | None:
    sizes = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    sizes = saved(sizes if among is None else sizes.join(among, key, "left_semi"), "sizes")
    return hot_keys(sizes, key, sizes.agg(F.sum("n")).first()[0] or 0)


def shared(texts: DataFrame, benchmark: DataFrame) -> DataFrame:
    """key, n_hit, items (sorted) of each text (key, text) that holds a window of the benchmark, by shuffle joins."""
    spark = texts.sparkSession
    known = saved(_item_windows(benchmark), "benchmark-windows")
    lengths = sorted(r.n for r in known.select("n").distinct().collect())  # 1 to WINDOW
    held = spark.sparkContext.broadcast(_sieve(benchmark).bits)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sieve = Sieve(held.value)
        for part in slices(batches, "text"):
            words = Words(part.column("text"))
            stream, starts, ends = _spaced(words)
            first = np.cumsum(words.counts) - words.counts
            for n in lengths:
                at = np.flatnonzero(sieve.may(_prints(words, n)))
                at = at[words.doc[at] == words.doc[at + n - 1]]
                said = [stream[starts[i] : ends[i + n - 1]].tobytes() for i in at.tolist()]
                yield record(key=part.column("key").take(pa.array(words.doc[at])), at=at - first[words.doc[at]], n=np.full(len(at), n, np.int32), said=pa.array(said, pa.binary()))

    windows = saved(map_batches(texts.select("key", "text"), work, "key string, at long, n int, said binary").distinct(), "document-windows")
    hits = saved(spread_join(windows, known.drop("n"), "said", "key", _hot(windows, "said")).select("key", "at", "n", "items"), "window-hits")
    # Words of a window that no window before it covers.
    before = Window.partitionBy("key").orderBy("at", "n")
    end, seen = F.col("at") + F.col("n"), F.coalesce(F.max(F.col("at") + F.col("n")).over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    n_hit = hits.select("key", F.greatest(F.lit(0), end - F.greatest(seen, "at")).alias("new")).groupBy("key").agg(F.sum("new").alias("n_hit"))
    items = hits.select("key", "items").distinct().select("key", F.explode("items").alias("item")).groupBy("key").agg(F.sort_array(F.collect_set("item")).alias("items"))
    return saved(n_hit.join(items, "key"), "shared")


def _large(benchmark: DataFrame, limit: int) -> bool:
    return (_items(benchmark).agg(F.sum(F.octet_length("text"))).first()[0] or 0) > limit


def _key() -> Column:
    return F.sha2(F.coalesce("text", F.lit("")), 256)


def contamination(docs: DataFrame, benchmark: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of each document; benchmarks of over `limit` bytes are joined by shuffle."""
    if _large(benchmark, limit):
        docs = docs.select("doc_id", "text", _key().alias("key"))

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in slices(batches, "text"):
                yield record(doc_id=part.column("doc_id"), key=part.column("key"), n_words=Words(part.column("text")).counts.astype(np.int64))

        counts = saved(map_batches(docs, count, "doc_id long, key string, n_words long"), "counts")
        rows = spread_join(counts, shared(docs, benchmark), "key", "doc_id", _hot(counts, "key"), "left")
        items = F.coalesce("items", F.array().cast("array<string>"))
        n_hit, n_items, names = F.coalesce("n_hit", F.lit(0)).cast("long"), F.size(items), F.array_join(items, ",")
        return rows.select("doc_id", "n_words", n_hit.alias("n_hit"), n_items.cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))

    def emit(part, words, covered, items):
        n_hit = np.bincount(words.doc[covered], minlength=part.num_rows).astype(np.int64)
        digests = [hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in items]
        return record(doc_id=part.column("doc_id"), n_words=words.counts.astype(np.int64), n_hit=n_hit, n_items=np.array([len(x) for x in items], np.int64), items_sha256=digests, contaminated=n_hit > 0)

    return matched(docs.select("doc_id", "text"), benchmark, emit, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def clean(docs: DataFrame, benchmark: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """The documents without a hit, with all their columns."""
    if _large(benchmark, limit):
        key = unused(docs, "key")
        keyed = docs.withColumn(key, _key())
        found = shared(keyed.select(F.col(key).alias("key"), "text"), benchmark).select(F.col("key").alias(key))
        return spread_join(keyed, found, key, "doc_id", _hot(keyed, key, found), "left_anti").drop(key)

    def emit(part, words, covered, items):
        return part.filter(pa.array(np.bincount(words.doc[covered], minlength=part.num_rows) == 0))

    return matched(docs, benchmark, emit, docs.schema)
