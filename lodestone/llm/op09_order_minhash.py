"""Order MinHash fingerprints of documents, in DataFrame functions alone.

A text's units give occurrence-numbered k-mers (k units, the last ones cut short by the text's end). Units are words; a word
of over LONG characters, as in scripts without spaces, gives its overlapping runs of CHARS characters instead, so that an edit
inside it changes few of them. One hash deals k-mers to SIGNATURES buckets by its top bits; each bucket's TUPLE least k-mers
are put back into text order and their hashes are hashed together. So a signature changes with the k-mers at hand and with
their order, and two texts' likeness is the share of equal signatures among the buckets that either has filled. A fingerprint
prints every signature whole (eight hex digits), so likeness can be had from two fingerprints.

A k-mer is one long: 34 bits of hash above 30 bits of position, more than any string has units. Sorting those longs puts equal
k-mers side by side, the first occurrence first. First occurrences keep their hash. Repeats are hashed with their number in a
fold over the repeats alone, which holds each bucket's least so far and no more.

The next document (descending doc_id) is found by one shuffle. Documents are dealt to ranges of about RANGE_BYTES of text, at
most RANGES of them, by cuts of doc_id from a quantile sketch; as in any range partitioning the cuts are part of the plan, and
a row finds its range by bisection. Rows of an id that fills several ranges, and those without an id, are dealt on by a hash
of their text. Each range also gets a copy of the row that follows its last one (a join with one key a range). Null texts
count as empty; an empty text has one k-mer, so equal texts have equal fingerprints throughout. Null doc_ids come last; equal
doc_ids are ordered by their text's hash, so repeated rows follow one another. Very long texts are fingerprinted whole. An
empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KMER, SIGNATURES, TUPLE, LONG, CHARS = 3, 64, 2, 32, 4
POSITIONS = (1 << 30) - 1
RANGE_BYTES, RANGES = 4 << 20, 1 << 16
_BITS = SIGNATURES.bit_length() - 1
#: Bits of a signature's hash under its bucket's number.
_SIGNED = 31 - _BITS


def units(words: str) -> Column:
    """The units of the array column `words`: words, those of over LONG characters as overlapping runs of CHARS characters."""
    runs = F.lit(rf"(?s)(?=(.{{{CHARS}}})).")
    each = F.transform(words, lambda w: F.when(F.length(w) > LONG, F.regexp_extract_all(w, runs, F.lit(1))).otherwise(F.array(w)))
    return F.when(F.exists(words, lambda w: F.length(w) > LONG), F.flatten(each)).otherwise(F.col(words))


def _bucket(packed: Column) -> Column:
    return F.shiftrightunsigned(packed, 64 - _BITS)


def _hash(packed: Column) -> Column:
    return packed.bitwiseAND(F.lit(~POSITIONS))


def with_fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """df and an array of ints under `name`, of the column `text`: a signature (bucket, then hash) for each bucket that has a k-mer."""
    keep, words, packed, ordered, firsts, again, chosen = [*df.columns], *(f"__{name}_{x}" for x in ("w", "p", "s", "f", "r", "c"))
    df = df.withColumn(words, F.split(F.coalesce(F.col(text), F.lit("")), r"\s+")).withColumn(words, units(words))
    hashed = lambda w, i: F.xxhash64(w, *(F.get(F.col(words), i + j) for j in range(1, KMER)))
    df = df.withColumn(packed, F.transform(words, lambda w, i: _hash(hashed(w, i)).bitwiseOR(F.least(i, F.lit(POSITIONS)).cast("long")))).drop(words)
    df = df.withColumn(ordered, F.sort_array(packed)).drop(packed)
    fresh = lambda x, i: (i == 0) | (_hash(x) != _hash(F.get(F.col(ordered), i - 1)))
    df = df.withColumn(firsts, F.filter(ordered, fresh))
    # Repeats, in order: a fold that numbers them and keeps, of each bucket, the TUPLE least hashes of (k-mer, number).
    repeats = F.when(F.size(firsts) < F.size(ordered), F.filter(ordered, lambda x, i: ~fresh(x, i))).otherwise(F.array().cast("array<bigint>"))
    df = df.withColumn(again, repeats).drop(ordered)
    none = F.array().cast("array<bigint>")

    def step(acc: Column, x: Column) -> Column:
        number = F.when(_hash(x) == acc["last"], acc["n"] + 1).otherwise(F.lit(1))
        value = _hash(F.xxhash64(_hash(x), number)).bitwiseOR(x.bitwiseAND(F.lit(POSITIONS)))
        b = _bucket(value).cast("int")
        held = F.get(acc["least"], b)
        better = (F.size(held) < TUPLE) | (value < F.get(held, F.lit(TUPLE - 1)))
        put = F.transform(acc["least"], lambda old, i: F.when(i == b, F.slice(F.sort_array(F.concat(old, F.array(value))), 1, TUPLE)).otherwise(old))
        return F.struct(_hash(x).alias("last"), number.alias("n"), F.when(better, put).otherwise(acc["least"]).alias("least"))

    start = F.struct(F.lit(0).cast("long").alias("last"), F.lit(0).alias("n"), F.array_repeat(none, SIGNATURES).alias("least"))
    numbered = F.when(F.size(again) > 0, F.aggregate(again, start, step, lambda acc: F.flatten(acc["least"]))).otherwise(none)
    # In sorted order a bucket is a run, so its least are those whose TUPLE-th predecessor lies in another bucket.
    head = lambda a: F.filter(a, lambda x, i: (i < TUPLE) | (_bucket(x) != _bucket(F.get(a, i - TUPLE))))
    df = df.withColumn(chosen, F.concat(head(F.col(firsts)), numbered)).drop(firsts, again)
    df = df.withColumn(chosen, F.sort_array(chosen))
    df = df.withColumn(chosen, head(F.col(chosen)))

    def signature(x: Column, i: Column) -> Column:
        run = F.filter(F.slice(chosen, i + 1, TUPLE), lambda y: _bucket(y) == _bucket(x))
        placed = F.sort_array(F.transform(run, lambda y: F.struct(y.bitwiseAND(F.lit(POSITIONS)).alias("at"), _hash(y).alias("h"))))
        value = F.shiftrightunsigned(F.xxhash64(F.transform(placed, lambda y: y["h"])), 64 - _SIGNED)
        return F.when((i == 0) | (_bucket(x) != _bucket(F.get(F.col(chosen), i - 1))), F.shiftleft(_bucket(x), _SIGNED).bitwiseOR(value).cast("int"))

    return df.select(*keep, F.filter(F.transform(chosen, signature), lambda x: x.isNotNull()).alias(name))


def as_text(signatures: str) -> Column:
    """Eight hex digits of each signature, in the order of buckets."""
    return F.array_join(F.transform(signatures, lambda x: F.lower(F.lpad(F.hex(x), 8, "0"))), "")


def likeness(a: str, b: str) -> Column:
    """Share of equal signatures among the buckets that one of the two texts has filled."""
    buckets = lambda c: F.transform(c, lambda x: F.shiftrightunsigned(x, _SIGNED))
    return F.size(F.array_intersect(a, b)).cast("double") / F.size(F.array_union(buckets(a), buckets(b)))


def _values(values: list, kind: str) -> Column:
    """An array as one literal (folded by the optimiser), not an expression for each entry."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>") if values else F.array().cast(f"array<{kind}>")


def _share(h: Column, parts: Column) -> Column:
    """The part, 0 to parts - 1, of a hash: equal parts of all hashes, in their order."""
    return F.least(F.floor((h.cast("double") / F.lit(2.0**64) + 0.5) * parts).cast("int"), parts - 1)


def ranges(docs: DataFrame, n: int, doc_id: str, h: str) -> Column:
    """Number of each row's range, ascending as (doc_id, h) does; null doc_ids have ranges below 0."""
    rows, known = docs.agg(F.count(F.lit(1)), F.count(doc_id)).first()
    cuts = docs.agg(F.percentile_approx(doc_id, _values([i / n for i in range(1, n)], "double"), max(10_000, 4 * n)).alias("c")).first()[0] if n > 1 else []
    cuts = sorted(cuts or [])
    without = max(1, math.ceil(n * (rows - known) / max(rows, 1)))
    at = sorted(set(cuts))
    below = [i for i, x in enumerate(cuts) if i == 0 or x != cuts[i - 1]] + [len(cuts)]  # cuts below each different one
    table, base = _values(at, "bigint"), _values(below, "int")
    start = F.struct(F.lit(0).alias("lo"), F.lit(len(at)).alias("hi"))

    def step(acc: Column, _: Column) -> Column:
        middle = F.shiftright(acc["lo"] + acc["hi"], 1)
        less = F.get(table, middle) < F.col(doc_id)
        return F.when(acc["lo"] < acc["hi"], F.struct(F.when(less, middle + 1).otherwise(acc["lo"]).alias("lo"), F.when(less, acc["hi"]).otherwise(middle).alias("hi"))).otherwise(acc)

    def number(place: Column) -> Column:
        first, same = F.get(base, place), F.get(table, place) == F.col(doc_id)
        return F.when(same, first + _share(F.col(h), F.get(base, place + 1) - first + 1)).otherwise(first)

    found = F.aggregate(F.sequence(F.lit(1), F.lit(max(1, len(at).bit_length() + 1))), start, step, lambda acc: number(acc["lo"])) if at else F.lit(0)
    return F.when(F.col(doc_id).isNull(), _share(F.col(h), F.lit(without)) - without).otherwise(found)


def with_next(docs: DataFrame, columns: list[str], parts: int | None = None) -> DataFrame:
    """docs (doc_id, text and more) and, for each name in columns, next_<name> of the next row in descending order of doc_id."""
    spark, h, none = docs.sparkSession, "__h", F.lit(None)
    if parts is None:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        parts = max(1, min(RANGES, math.ceil(size / RANGE_BYTES)))
    keyed = docs.withColumn(h, F.xxhash64(F.coalesce("text", F.lit(""))))
    placed = keyed.withColumn("__part", ranges(docs, parts, "doc_id", h))
    # The greatest key of each range: one small row a range.
    heads = sorted((r[0], r[1][1], r[1][2]) for r in placed.groupBy("__part").agg(F.max(F.struct(F.col("doc_id").isNotNull().alias("k"), F.coalesce("doc_id", F.lit(0)).alias("d"), h))).collect())
    if not heads:
        return docs.select("*", *(none.cast(docs.schema[c].dataType).alias(f"next_{c}") for c in columns))
    goes = [(part, d, x, heads[(i + 1) % len(heads)][0]) for i, (part, d, x) in enumerate(heads)]  # a range is followed by the head of the one below
    known = F.broadcast(spark.createDataFrame(goes, "g_part int, g_id long, g_h long, g_to int"))
    at = (F.col("__part") == F.col("g_part")) & (F.coalesce("doc_id", F.lit(0)) == F.col("g_id")) & (F.col(h) == F.col("g_h"))
    stays = F.struct(F.col("__part").alias("part"), F.lit(False).alias("guest"))
    visits = F.struct(F.col("g_to").alias("part"), F.lit(True).alias("guest"))
    rows = placed.join(known, at, "left").withColumn("__goes", F.explode(F.when(F.col("g_to").isNull(), F.array(stays)).otherwise(F.array(stays, visits))))
    window = Window.partitionBy("__goes.part").orderBy("__goes.guest", F.col("doc_id").desc_nulls_last(), F.col(h).desc(), F.col("text").desc())
    rows = rows.select(*docs.columns, "__goes", *(F.lead(c).over(window).alias(f"next_{c}") for c in columns))
    return rows.filter(~F.col("__goes.guest")).drop("__goes")


def order_minhash(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of each document."""
    own = with_fingerprint(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "text", "own")
    rows = with_next(own, ["text", "own"]).withColumn("n", F.length("text"))
    half = F.floor(F.col("n") / 2).cast("int")
    edited = F.concat(F.left("text", F.col("n") - half), F.left("next_text", half))
    rows = with_fingerprint(rows.select("doc_id", "n", "own", "next_own", edited.alias("edited")), "edited", "other")
    return rows.select("doc_id", F.col("n").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), as_text("own").alias("fingerprint"), as_text("other").alias("edited_fingerprint"), likeness("own", "other").alias("near_edited"), likeness("own", "next_own").alias("near_next"))
