"""Helpers that the training-data operators share: written tables, Arrow slices and a vectorised word scanner."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lineage import discard, drop_saved, run_path, saved, shared_dir, unused
from ..ship import ship

__all__ = ["discard", "drop_saved", "run_path", "saved", "shared_dir", "unused"]

#: Bytes of text that one numpy pass takes at a time; it bounds a worker's temporary arrays.
SLICE_BYTES = 1 << 20
#: Bytes of an Arrow batch between the JVM and a worker, as near as whole rows allow.
BATCH_BYTES = 8 << 20
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
U = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def is_held_out(doc_id: str = "doc_id"):
    """crc32 of the id's text, modulo 5, is 0. A null id counts as held out: it can't carry a label."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(True))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, limit: int) -> DataFrame:
    """doc_id, text, label of at most `limit` labelled documents that aren't held out, written once as several passes read them.

    The first `limit` labelled ids by hash are chosen. Of several labels of one id the largest counts, of several rows of
    one id the least text, so rows are bounded by ids; null labels and ids are left out, null texts are empty.
    """
    chosen = labels.filter(~is_held_out() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    return saved(rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label")), "training")


#: What empties a worker's memos that last from task to task.
MEMOS: list[Callable[[], None]] = []


def forget() -> None:
    for clear in MEMOS:
        clear()


def trim() -> None:
    """Give freed memory back to the system: a worker outlives its tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def map_batches(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, keeps_memos: bool = False) -> DataFrame:
    """mapInArrow; batches are cut by bytes, so that long texts don't make large ones, and workers are left tidy.

    The bound is read when the plan runs, which is the caller's doing, so it can't be set for this step alone: it is set on
    the session where the session sets none of its own.
    """
    ship(df.sparkSession)
    if BATCH_SETTING not in df.sparkSession.conf.getAll:
        df.sparkSession.conf.set(BATCH_SETTING, BATCH_BYTES)

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keeps_memos:
            forget()
        try:
            yield from work(batches)
        finally:
            trim()

    return df.mapInArrow(tidy, schema)


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches by rows so that a slice's texts hold about `limit` bytes; one longer text is a slice of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        at = 0
        while at < batch.num_rows:
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, "right")))
            yield batch.slice(at, stop - at)
            at = stop


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' UTF-8 bytes end to end and n + 1 offsets; null counts as empty."""
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    whole = pa.concat_arrays([pc.fill_null(texts, "").cast(pa.large_binary())])
    offsets = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset : whole.offset + len(whole) + 1]
    data = np.frombuffer(whole.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if whole.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of SplitMix."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        with np.errstate(over="ignore"):
            have = np.concatenate(([U(1)], np.cumprod(np.full(size - 1, U(base)), dtype=U)))
        if size <= 4 * SLICE_BYTES:
            _powers[base] = have
    return have[:n]


def _word_table() -> np.ndarray:
    """Byte to its lower-case form; 0 for what no word holds: all ASCII but digits and letters."""
    t = np.arange(256, dtype=np.uint8)
    t[:0x30] = t[0x3A:0x41] = t[0x5B:0x61] = t[0x7B:0x80] = 0
    t[0x41:0x5B] += 32
    return t


WORD_BYTES = _word_table()


class Words:
    """The words of a slice of texts: starts, ends (bytes), doc (row) and hash of each, found without a Python loop."""

    def __init__(self, texts: pa.Array):
        data, offsets = flat(texts)
        self.n_docs, self.offsets = len(offsets) - 1, offsets
        self.bytes = low = WORD_BYTES[data]
        inside = low != 0
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        edges = offsets[1:-1]
        edges = edges[(edges > 0) & (edges < len(low))]
        first[edges] = inside[edges]
        last[edges - 1] = inside[edges - 1]
        self.starts = np.flatnonzero(first)
        self.ends = np.flatnonzero(last) + 1
        self.doc = np.searchsorted(offsets[1:], self.starts, "right")
        with np.errstate(over="ignore"):
            self.sums = np.concatenate(([U(0)], np.cumsum(low * powers(_BASE, len(low)), dtype=U)))
            self.shift = powers(_INVERSE, len(low) + 1)
        self.hash = self.span(self.starts, self.ends)
        self.counts = np.bincount(self.doc, minlength=self.n_docs)

    def span(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of the bytes from starts to ends."""
        with np.errstate(over="ignore"):
            return mix((self.sums[ends] - self.sums[starts]) * self.shift[starts])

    def prefix(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Indexes of the words longer than n bytes, and the hash of their first n bytes."""
        at = np.flatnonzero(self.ends - self.starts > n)
        return at, self.span(self.starts[at], self.starts[at] + n)

    def text(self, i: int, n: int) -> bytes:
        """Words i to i + n, joined by a space."""
        return b" ".join(self.bytes[s:e].tobytes() for s, e in zip(self.starts[i : i + n], self.ends[i : i + n], strict=True))


_STEP = 0xD6E8FEB86659FD93


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n word hashes."""
    if len(words) < n:
        return np.zeros(0, U)
    m = len(words) - n + 1
    with np.errstate(over="ignore"):
        out = words[:m].copy()
        for j in range(1, n):
            out = out * U(_STEP) + words[j : j + m]
        return mix(out)


def word_hash(text: str) -> int:
    return int(Words(pa.array([text])).hash[0])


def record(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns.values()], names=list(columns))
