"""Token ids in a binary file format: frequency ranks in byte-aligned variable-length code with separate control bytes.

A shard is one blob: a header (with the ids before it in its partition), the document index, the control bytes (two bits for
each id: its bytes less one) and the data bytes (each id's rank, little-endian, 1 to 4 bytes). Ranks order the ids by how
often the corpus has them, so the commonest 255 take one byte. The decoder looks up a control byte's four lengths in a table
and gathers the data with numpy.

The container is part of the format: a folder `shards` of Parquet files with a row for each shard (part, seq, n_ids, blob), in
which part and seq order the shards as doc_id does, and a folder `ranks` of Parquet files (rank, id). Parquet carries the
blobs because executors share no local folder and Spark's writer reaches every store that Spark reads. A shard holds about
SHARD_IDS ids, so any worker holds one shard's worth of memory; a longer document is a shard of its own. Reading takes one
total for each partition to the driver, never one for each shard.

Null texts count as empty; a document has at least the end id. Equal doc_ids stand next to one another, ordered by their
ids' hash. Null doc_ids come first. Very long texts are encoded whole. An empty table gives an empty result. Other columns are
ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, map_batches, record, run_path, saved, slices
from .tokens import TOKEN_SLICE, encoder, id_type, vocabulary_path, with_end

MAGIC, SHARD_IDS, END_ID = b"LSVB0002", 500_000, 2
#: Ids of a partition: fewer where there are few in all, more where that would make more tasks than the session deals to.
PART_IDS, MOST_PART_IDS = 4_000_000, 64_000_000
VOCABULARY = "word_bpe_49k.json"
#: For each control byte the bytes of its four ids.
LENGTHS = np.array([[(c >> 2 * k & 3) + 1 for k in range(4)] for c in range(256)], np.int64)


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of uint32 ranks."""
    sizes = 1 + (ranks > 0xFF).astype(np.int64) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    codes = np.zeros((len(ranks) + 3) // 4 * 4, np.uint8)
    codes[: len(ranks)] = sizes - 1
    quads = codes.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    ends = np.cumsum(sizes)
    data = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(4):
        has = sizes > k
        data[(ends - sizes)[has] + k] = (ranks[has] >> np.uint32(8 * k)).astype(np.uint8)
    return control.tobytes(), data.tobytes()


def decode_ranks(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n ranks, by table lookup of the control bytes."""
    sizes = LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    starts = np.cumsum(sizes) - sizes
    padded = np.concatenate((np.frombuffer(data, np.uint8), np.zeros(4, np.uint8))).astype(np.uint32)
    out = padded[starts]
    for k in range(1, 4):
        has = sizes > k
        out[has] |= padded[starts[has] + k] << np.uint32(8 * k)
    return out


def write_blob(doc_ids: list, counts: np.ndarray, ranks: np.ndarray, before: int = 0) -> bytes:
    control, data = encode_ranks(ranks)
    known = np.array([x is not None for x in doc_ids], np.uint8)
    ids = np.array([x or 0 for x in doc_ids], np.int64)
    head = struct.pack("<8sQQQQQ", MAGIC, len(doc_ids), len(ranks), len(control), len(data), before)
    return b"".join((head, known.tobytes(), ids.tobytes(), counts.astype(np.int64).tobytes(), control, data))


def read_blob(blob: bytes) -> tuple[list, np.ndarray, np.ndarray, int]:
    """doc_ids, ids of each document, all ranks, and the ids before the shard in its partition."""
    magic, n, total, n_control, n_data, before = struct.unpack_from("<8sQQQQQ", blob)
    if magic != MAGIC:
        raise ValueError("not a shard of this format")
    at = struct.calcsize("<8sQQQQQ")
    known = np.frombuffer(blob, np.uint8, n, at)
    ids = np.frombuffer(blob, np.int64, n, at + n)
    counts = np.frombuffer(blob, np.int64, n, at + 9 * n)
    at += 17 * n
    return [int(x) if k else None for x, k in zip(ids, known, strict=True)], counts, decode_ranks(blob[at : at + n_control], blob[at + n_control : at + n_control + n_data], total), before


def tokenize(docs: DataFrame, vocabulary: str, end_id: int, kind: str) -> DataFrame:
    """doc_id, ids (bytes of the type `kind`, the end id last)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary_path(vocabulary), spaced=False)
        for part in slices(batches, "text", TOKEN_SLICE):
            ids, offsets = with_end(*encode(part.column("text")), end_id)
            yield record(doc_id=part.column("doc_id"), ids=pa.array([ids[a:b].astype(kind).tobytes() for a, b in zip(offsets, offsets[1:])], pa.binary()))

    return map_batches(docs.select("doc_id", "text"), work, "doc_id long, ids binary", keeps_memos=True)


def frequencies(tokens: DataFrame, kind: str) -> DataFrame:
    """id, n: how often the corpus has each id. Each task sums its own first; the rows are as many as the vocabulary."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1, np.int64)
        for part in slices(batches, "ids"):
            found = np.bincount(np.frombuffer(b"".join(part.column("ids").to_pylist()), kind))
            if len(found) > len(total):
                found, total = total, found
            total[: len(found)] += found
        at = np.flatnonzero(total)
        yield record(id=at.astype(np.int64), n=total[at])

    return map_batches(tokens.select("ids"), work, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def partitions_of(total: int, spark: SparkSession) -> int:
    """Partitions for that many ids."""
    return max(1, min(total // PART_IDS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // MOST_PART_IDS)))


def write_shards(docs: DataFrame, path: str, vocabulary: str = VOCABULARY, end_id: int = END_ID) -> None:
    """Write the documents' ids under `path`, in ascending order of doc_id."""
    spark = docs.sparkSession
    kind = id_type(vocabulary_path(vocabulary))
    width = np.dtype(kind).itemsize
    tokens = saved(tokenize(docs, vocabulary, end_id, kind), "ids")
    # At most one row for each id of the vocabulary, which bounds what comes to the driver and what is broadcast.
    found = frequencies(tokens, kind).orderBy(F.desc("n"), "id").collect()
    by_rank = np.array([r[0] for r in found], np.uint32)
    rank = np.zeros(int(by_rank.max(initial=0)) + 1, np.uint32)
    rank[by_rank] = np.arange(len(by_rank), dtype=np.uint32)
    spark.createDataFrame(list(enumerate(by_rank.tolist())), "rank long, id long").coalesce(1).write.parquet(f"{path}/ranks")
    ranks = spark.sparkContext.broadcast(rank)
    n = partitions_of(sum(r[1] for r in found), spark)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, held, before = TaskContext.get().partitionId(), 0, 0, 0
        doc_ids: list = []
        ids: list[bytes] = []

        def shard():
            nonlocal seq, before
            blob = write_blob(doc_ids, np.array([len(x) // width for x in ids]), ranks.value[np.frombuffer(b"".join(ids), kind)], before)
            seq, before = seq + 1, before + held
            return record(part=pa.array([part], pa.int64()), seq=pa.array([seq], pa.int64()), n_ids=pa.array([held], pa.int64()), blob=pa.array([blob], pa.binary()))

        for batch in batches:
            for doc_id, x in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if ids and held + len(x) // width > SHARD_IDS:
                    yield shard()
                    doc_ids, ids, held = [], [], 0
                doc_ids.append(doc_id)
                ids.append(x)
                held += len(x) // width
        if ids:
            yield shard()

    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("ids")]
    sorted_ids = tokens.repartitionByRange(n, *order).sortWithinPartitions(*order)
    map_batches(sorted_ids, work, "part long, seq long, n_ids long, blob binary").write.parquet(f"{path}/shards")
    discard(tokens)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, decoded from the files under `path`."""
    shards = spark.read.schema("part long, seq long, n_ids long, blob binary").parquet(f"{path}/shards")
    by_rank = np.array([r[0] for r in spark.read.schema("rank long, id long").parquet(f"{path}/ranks").orderBy("rank").select("id").collect()], np.uint32)
    totals = shards.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()  # one row a partition
    starts = np.zeros(totals[-1][0] + 1 if totals else 0, np.int64)
    starts[[r[0] for r in totals]] = np.cumsum([0] + [r[1] for r in totals])[:-1]
    base, table = spark.sparkContext.broadcast(starts), spark.sparkContext.broadcast(by_rank)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                doc_ids, counts, ranks, before = read_blob(batch.column("blob")[i].as_py())
                data = table.value[ranks].astype("<u4").tobytes()
                ends = np.cumsum(counts)
                crcs = [zlib.crc32(data[4 * (e - c) : 4 * e]) for e, c in zip(ends.tolist(), counts.tolist(), strict=True)]
                first = base.value[batch.column("part")[i].as_py()] + before
                yield record(doc_id=pa.array(doc_ids, pa.int64()), start=first + ends - counts, n_tokens=counts, ids_crc32=pa.array(crcs, pa.int64()))

    return map_batches(shards.select("part", "blob"), work, "doc_id long, start long, n_tokens long, ids_crc32 long")


def binary_ids(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Write all documents' ids as files (under the shared folder where no path is given) and return what reading them gives."""
    path = path or run_path(docs.sparkSession, "binary")
    write_shards(docs, path)
    return read_shards(docs.sparkSession, path)
