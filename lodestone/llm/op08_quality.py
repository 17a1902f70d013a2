"""Quality scores by nearest-neighbour voting in a latent-semantic space.

Terms are a text's words (lower-cased, hashed to 2^WORD_BITS places), the runs of three character classes (letters by case,
digits, spaces, each ASCII mark; so they read alike in any language) and steps of how often its words repeat. Term counts are
damped and weighted by rarity, words and classes each to equal length; a truncated singular value decomposition of the labelled
sample over its WORDS commonest words and CLASSES commonest runs gives the latent space. The sample's vectors are broadcast (at
most SAMPLE x RANK floats), every document's cosine with all of them is computed exactly, block by block, and the NEIGHBOURS
nearest vote with the eighth power of their similarity as weight.

Ties: all neighbours within TIE of the NEIGHBOURS-th cosine vote too, so copies in the sample count alike and the order of the
sample doesn't matter; what rounding leaves (a block's shape may change a cosine's last digit) is below TIE. Terms that are
equally common are ordered by number.

Labels: rows whose crc32(doc_id as text) mod 5 is not 0, at most SAMPLE of them, the first by hash of doc_id. SAMPLE, WORDS and
CLASSES are documented bounds on fitting alone; each text is scored whole, however long. Nothing but the text is an input of a
score. Where one doc_id has several labels the largest counts; null labels are left out. With no labelled row every score is 1,
and a warning says so. Null texts count as empty and are scored. Repeated rows give equal scores; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, flat, is_held_out, map_batches, record, slices, training_rows

SAMPLE, RANK, NEIGHBOURS, THRESHOLD = 8192, 48, 15, 0.3
WORD_BITS, WORDS, CLASSES, TIE = 16, 1024, 2048, 1e-5
#: Texts that are turned into dense term rows at a time, and documents in a block of cosine products.
ROWS, BLOCK = 128, 512
_REPEAT = 24


def _classes() -> tuple[np.ndarray, int]:
    """Class of each byte: lower-case letters and all non-ASCII bytes 0, capitals 1, digits 2, white space 3, then each mark."""
    t = np.zeros(256, np.int64)
    t[ord("A") : ord("Z") + 1] = 1
    t[ord("0") : ord("9") + 1] = 2
    t[:0x21] = 3
    t[10] = 4
    marks = [b for b in range(0x21, 0x80) if not chr(b).isalnum()]
    t[marks] = 5 + np.arange(len(marks))
    return t, 5 + len(marks)


CLASS, N_CLASS = _classes()
#: Terms of classes and steps come first, then the places of words.
N_CLASSES = N_CLASS**3 + _REPEAT
N_TERMS = N_CLASSES + (1 << WORD_BITS)


def term_rows(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, term and count of each text's terms. Words that share a place come as often as there are words."""
    data, offsets = flat(texts)
    n = len(offsets) - 1
    c = CLASS[data]
    doc = np.searchsorted(offsets[1:], np.arange(len(c)), "right") if len(c) else np.zeros(0, np.int64)
    if len(c) > 2:
        inside = doc[:-2] == doc[2:]
        key = (doc[:-2] * N_TERMS + (c[:-2] * N_CLASS + c[1:-1]) * N_CLASS + c[2:])[inside]
    else:
        key = np.zeros(0, np.int64)
    found, counts = np.unique(key, return_counts=True)
    # How much the words repeat: the share of words, and of pairs of neighbours, that are not the first of their kind.
    words = Words(texts)
    wdoc = words.doc.astype(np.uint64)
    with np.errstate(over="ignore"):
        apart = (wdoc << np.uint64(40)) * np.uint64(0x9E3779B97F4A7C15)
        pair = words.hash[:-1] * np.uint64(0xD6E8FEB86659FD93) + words.hash[1:]
        both = words.doc[:-1] == words.doc[1:]
        one, times = np.unique(words.hash ^ apart, return_index=True, return_counts=True)[1:]
        two = np.unique(pair[both] ^ apart[:-1][both], return_index=True)[1]
    share = []
    for total, kinds in ((words.counts, np.bincount(words.doc[one], minlength=n)), (np.bincount(words.doc[:-1][both], minlength=n), np.bincount(words.doc[:-1][both][two], minlength=n))):
        share.append(1 - kinds / np.maximum(total, 1))
    rows = np.arange(n)
    extra = [N_CLASS**3 + np.minimum(11, (12 * share[0]).astype(np.int64)), N_CLASS**3 + 12 + np.minimum(11, (12 * share[1]).astype(np.int64))]
    weight = np.maximum(8, np.diff(offsets) // 8)
    place = N_CLASSES + (words.hash[one] >> np.uint64(64 - WORD_BITS)).astype(np.int64)
    return (
        np.concatenate([found // N_TERMS, rows, rows, words.doc[one]]),
        np.concatenate([found % N_TERMS, *extra, place]),
        np.concatenate([counts, weight, weight, times]).astype(np.float64),
    )


def leading(gram: np.ndarray, rank: int, rounds: int = 12) -> np.ndarray:
    """The leading eigenvectors of a symmetric matrix, by subspace iteration from a fixed start."""
    m = len(gram)
    if m <= 4 * rank:
        return np.ascontiguousarray(np.linalg.eigh(gram)[1][:, ::-1][:, :rank])
    q = np.linalg.qr(np.random.default_rng(0).normal(size=(m, 2 * rank)))[0]
    for _ in range(rounds):
        q = np.linalg.qr(gram @ q)[0]
    small = np.linalg.eigh(q.T @ gram @ q)[1][:, ::-1]
    return np.ascontiguousarray((q @ small)[:, :rank])


class Space:
    """Fitted on the sample: kept terms, their weights, the projection, and the labelled vectors."""

    def __init__(self, rows: np.ndarray, terms: np.ndarray, counts: np.ndarray, labels: np.ndarray, rank: int = RANK, prior: float = 1.0):
        n = len(labels)
        self.prior, self.labels = (float(labels.mean()) if n else prior), labels.astype(np.float64)
        df = np.bincount(terms, minlength=N_TERMS)
        parts = []
        for lo, hi, most in ((0, N_CLASSES, CLASSES), (N_CLASSES, N_TERMS, WORDS)):
            kept = lo + np.flatnonzero(df[lo:hi] >= (2 if n > 1 else 1))
            parts.append(kept[np.argsort(-df[kept], kind="stable")][:most])
        kept, self.classes = np.concatenate(parts), len(parts[0])
        self.place = np.full(N_TERMS, -1, np.int32)
        self.place[kept] = np.arange(len(kept))
        self.idf = np.log((1 + n) / (1 + df[kept])) + 1
        # X'X is terms by terms, so fitting needs no more than a block of rows at a time.
        gram = np.zeros((len(kept), len(kept)))
        if len(rows) and (rows[1:] < rows[:-1]).any():
            order = np.argsort(rows, kind="stable")
            rows, terms, counts = rows[order], terms[order], counts[order]
        cut = lambda a: slice(*np.searchsorted(rows, [a, a + BLOCK]))
        for a in range(0, n, BLOCK):
            x = self.dense(rows[cut(a)] - a, terms[cut(a)], counts[cut(a)], min(BLOCK, n - a))
            gram += x.T @ x
        self.axes = leading(gram, rank).astype(np.float32)
        self.known = np.concatenate([self.project(rows[cut(a)] - a, terms[cut(a)], counts[cut(a)], min(BLOCK, n - a)) for a in range(0, n, BLOCK)]) if n else np.zeros((0, self.axes.shape[1]), np.float32)

    def dense(self, rows, terms, counts, n: int) -> np.ndarray:
        at = self.place[terms]
        good = at >= 0
        x = np.bincount(rows[good] * len(self.idf) + at[good], counts[good], n * len(self.idf)).reshape(n, len(self.idf))
        x = np.log1p(x) * self.idf
        for part in (x[:, : self.classes], x[:, self.classes :]):
            part /= np.maximum(np.linalg.norm(part, axis=1, keepdims=True), 1e-9)
        return x

    def project(self, rows, terms, counts, n: int) -> np.ndarray:
        v = self.dense(rows, terms, counts, n).astype(np.float32) @ self.axes
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)

    def vote(self, vectors: np.ndarray, k: int = NEIGHBOURS) -> np.ndarray:
        """Share of label 1 among the k nearest and those that tie with the k-th, weighted by similarity."""
        m = len(self.known)
        if not m:
            return np.full(len(vectors), self.prior)
        k = min(k, m)
        out = np.empty(len(vectors))
        for a in range(0, len(vectors), BLOCK):
            near = vectors[a : a + BLOCK] @ self.known.T
            last = np.partition(near, m - k, axis=1)[:, m - k]
            row, at = np.nonzero(near >= last[:, None] - TIE)
            weight = np.maximum(near[row, at].astype(np.float64), 1e-6) ** 8
            n = len(near)
            out[a : a + BLOCK] = np.bincount(row, weight * self.labels[at], n) / np.bincount(row, weight, n)
        return out

    def score(self, texts: pa.Array) -> np.ndarray:
        out = []
        for a in range(0, len(texts), ROWS):
            part = texts.slice(a, ROWS)
            out.append(self.project(*term_rows(part), len(part)))
        return np.clip(self.vote(np.concatenate(out)), 0, 1) if out else np.zeros(0)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", limit: int = SAMPLE) -> Space:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            rows, terms, counts = term_rows(part.column("text"))
            order = np.argsort(rows, kind="stable")
            ends = np.searchsorted(rows[order], np.arange(part.num_rows + 1))
            t, c = terms[order].astype("<i4"), counts[order].astype("<f4")
            yield record(doc_id=part.column("doc_id"), label=part.column("label"), terms=pa.array([t[a:b].tobytes() for a, b in zip(ends, ends[1:])], pa.binary()), counts=pa.array([c[a:b].tobytes() for a, b in zip(ends, ends[1:])], pa.binary()))

    # Terms are at most N_TERMS a row, some hundreds in practice; the rows are bounded by the sample.
    found = map_batches(training_rows(docs, labels, label, limit), work, "doc_id long, label int, terms binary, counts binary").orderBy("doc_id").toArrow()
    if not len(found):
        warnings.warn("no labelled row to learn from: every document scores 1", stacklevel=3)
    terms, counts = (np.frombuffer(b"".join(found.column(c).to_pylist()), kind) for c, kind in (("terms", "<i4"), ("counts", "<f4")))
    rows = np.repeat(np.arange(len(found), dtype=np.int32), [len(x) // 4 for x in found.column("terms").to_pylist()])
    return Space(rows, terms, counts, np.array(found.column("label").to_pylist(), np.float64))


def scored(docs: DataFrame, space: Space, emit: Callable, schema) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(space)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            yield emit(part, held.value.score(part.column("text")))

    return map_batches(docs, work, schema)


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of each document."""

    def emit(part, score):
        return record(doc_id=part.column("doc_id"), score=score, predicted=(score >= THRESHOLD).astype(np.int32))

    out = scored(docs.select("doc_id", "text"), fit(docs, labels), emit, "doc_id long, score double, predicted int")
    return out.select("doc_id", is_held_out().alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier doesn't reject, with all their columns."""
    return scored(docs, fit(docs, labels), lambda part, score: part.filter(pa.array(score >= THRESHOLD)), docs.schema)
