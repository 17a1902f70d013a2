"""Packing by concatenate and cut: two-pass prefix sums give each document its place in one stream of ids.

Pass one encodes each text once and writes ids with the document's start inside its partition. The partitions' totals (one
number each) give every partition's start in the stream by a prefix sum. Pass two cuts the stream at each multiple of the
sequence length: a document that crosses such a boundary gives a record on either side of it. Nothing is shuffled, and only
the last sequence of the stream can need padding.

Null texts count as empty: such a document still has its end id. Repeated rows and doc_ids are packed as often as they
occur. An empty table gives no piece. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, record, saved, slices
from .tokens import TOKEN_SLICE, encoder, id_type, vocabulary_path, with_end

VOCABULARY, SEQUENCE, END_ID = "byte_bpe_50k.json", 1024, 0
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def tokenize(docs: DataFrame, vocabulary: str, end_id: int, kind: str) -> DataFrame:
    """doc_id, part (partition), at (ids of that partition before the document), n, ids (bytes of the type `kind`)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, at = encoder(vocabulary_path(vocabulary), spaced=True), TaskContext.get().partitionId(), 0
        for piece in slices(batches, "text", TOKEN_SLICE):
            ids, offsets = with_end(*encode(piece.column("text")), end_id)
            yield record(doc_id=piece.column("doc_id"), part=np.full(len(offsets) - 1, part, np.int64), at=at + offsets[:-1].astype(np.int64), n=np.diff(offsets).astype(np.int64), ids=pa.array([ids[a:b].astype(kind).tobytes() for a, b in zip(offsets, offsets[1:])], pa.binary()))
            at += int(offsets[-1])

    return map_batches(docs.select("doc_id", "text"), work, "doc_id long, part long, at long, n long, ids binary", keeps_memos=True)


def pack(docs: DataFrame, vocabulary: str = VOCABULARY, length: int = SEQUENCE, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """A row for each piece of a document; with_ids adds the piece's ids as bytes."""
    kind = id_type(vocabulary_path(vocabulary))
    tokens = saved(tokenize(docs, vocabulary, end_id, kind), "packed")
    totals = tokens.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect()  # one row a partition
    before = np.cumsum([0] + [r[1] for r in totals])
    base = docs.sparkSession.sparkContext.broadcast({r[0]: int(b) for r, b in zip(totals, before[:-1], strict=True)})

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "ids"):
            n = batch.column("n").to_numpy()
            parts, inverse = np.unique(batch.column("part").to_numpy(), return_inverse=True)
            first = np.array([base.value[int(p)] for p in parts], np.int64)[inverse] + batch.column("at").to_numpy()
            pieces = (first + n - 1) // length - first // length + 1
            row = np.repeat(np.arange(len(n)), pieces)
            k = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            sequence = first[row] // length + k
            lo = np.maximum(sequence * length, first[row])
            hi = np.minimum((sequence + 1) * length, first[row] + n[row])
            blobs = [np.frombuffer(x, kind).astype("<u4").tobytes() for x in batch.column("ids").to_pylist()]
            start = lo - first[row]
            cut = [blobs[r][4 * a : 4 * b] for r, a, b in zip(row.tolist(), start.tolist(), (hi - first[row]).tolist(), strict=True)]
            out = {"doc_id": batch.column("doc_id").take(pa.array(row)), "start": start, "length": hi - lo, "ids_crc32": pa.array([zlib.crc32(x) for x in cut], pa.int64()), "doc_tokens": n[row], "sequence_id": sequence, "offset": lo - sequence * length}
            yield record(**out, **({"ids": pa.array(cut, pa.binary())} if with_ids else {}))

    return map_batches(tokens, work, PIECE + (", ids binary" if with_ids else ""))
