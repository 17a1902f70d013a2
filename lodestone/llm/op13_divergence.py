"""Source divergence audit: which sources of a language differ from each other, and by which terms.

Two passes with a vocabulary automaton. The first one takes exact document frequencies of all terms of each language (lang) and
keeps those in at least `least` documents. The second one counts the kept terms' occurrences: texts are lower-cased with every
character that no term holds made a space, and pyahocorasick automata over the kept terms, each padded by a space on both sides,
run over them; a padded term can only match a whole one, and neighbours share their space. The vocabulary grows with the
corpus, so it is dealt by hash into blocks of about `block` bytes; a block is broadcast alone, each worker builds its
automata (one for each lang) once, and each block is a pass over the texts.

The counts that aren't 0 are the sparse postings: for each term of a lang its groups (lang, source) with their smoothed shares p.
All kept terms count in a pair of groups, but most have count 0 in one or both. With p0 the share of a term that a group
lacks and f the divergence of two shares, a pair's sum is V f(p0, p0') + the sum over the first group's terms of
f(p, p0') - f(p0, p0') + the same for the second one's + the sum over common terms of f(p, p') - f(p, p0') - f(p0, p') + f(p0, p0').
Common terms come from the postings, a pair for each two groups that share one; terms of one group are counted by their share
first, and each different share meets the other groups once. A term's posting has at most as many entries as its lang has
sources, and the groups' table, which is broadcast, has as many rows as all langs have sources: the result has the square of
these.

Null text, lang and source count as ''. Repeated rows are documents of their own; doc_id isn't read. A lang without kept terms
gives pairs of value 0. Very long texts are read whole. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import MEMOS, map_batches, record, run_path, saved, slices
from .op11_ranked import ranges
from .terms import LETTER_BYTES, Terms

LEAST, TOP, SCALE = 3, 200, 1_000_000_000
#: Bytes of kept terms (with 16 for each) in a block of the vocabulary: their automata take five to ten times as many.
BLOCK_BYTES = 24 << 20
#: Bytes of text in a slice; counts that a task holds before it sums and, if they stay many, emits them.
SLICE, HELD_COUNTS = 8 << 20, 1 << 20
#: Pairs of postings that are worked at a time.
PAIRS = 1 << 18

PADDED = bytes(b or 0x20 for b in LETTER_BYTES.tolist())


def documents(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])


def document_frequencies(docs: DataFrame) -> DataFrame:
    """lang, term, df of all terms; docs as documents() gives them."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", SLICE):
            terms = Terms(part.column("text"), LETTER_BYTES)
            code, doc, _ = terms.postings()
            langs = part.column("lang").dictionary_encode()
            of = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)[doc]
            width = max(len(terms.dictionary), 1)
            keys, n = np.unique(of * width + code, return_counts=True)
            yield record(lang=langs.dictionary.take(pa.array(keys // width)), term=terms.dictionary.take(pa.array(keys % width)).cast(pa.utf8()), n=n.astype(np.int64))

    return map_batches(docs.select("lang", "text"), work, "lang string, term string, n long").groupBy("lang", "term").agg(F.sum("n").alias("df"))


_built: dict[str, dict] = {}
MEMOS.append(_built.clear)


def automata(name: str, lang: pa.Array, term: pa.Array) -> dict:
    """lang to the automaton of its terms in the block, each padded by spaces; a term's value is its place in the block."""
    if name not in _built:
        import ahocorasick

        _built.clear()
        made: dict = {}
        for a in range(0, len(term), 1 << 14):
            for i, (x, t) in enumerate(zip(lang.slice(a, 1 << 14).to_pylist(), term.slice(a, 1 << 14).to_pylist(), strict=True), a):
                if x not in made:
                    made[x] = ahocorasick.Automaton(ahocorasick.STORE_INTS)
                made[x].add_word(f" {t} ", i)
        for x in made.values():
            x.make_automaton()
        _built[name] = made
    return _built[name]


class Counts:
    """Occurrences by group and place in the block, summed whenever there are many."""

    def __init__(self, width: int):
        self.width, self.groups, self.held, self.size = width, {}, [], 0

    def add(self, group: tuple[str, str], found: np.ndarray) -> None:
        at, n = np.unique(found, return_counts=True)
        self.held.append((self.groups.setdefault(group, len(self.groups)) * self.width + at, n))
        self.size += len(at)

    def sum(self) -> None:
        keys, back = np.unique(np.concatenate([k for k, _ in self.held]), return_inverse=True)
        n = np.zeros(len(keys), np.int64)
        np.add.at(n, back, np.concatenate([x for _, x in self.held]))
        self.held, self.size = [(keys, n)], len(keys)

    def taken(self, lang: pa.Array, term: pa.Array) -> pa.RecordBatch:
        self.sum()
        keys, n = self.held[0]
        place = pa.array(keys % self.width)
        source = pa.array([x for _, x in self.groups], pa.utf8()).take(pa.array(keys // self.width))
        self.groups, self.held, self.size = {}, [], 0
        return record(lang=lang.take(place), source=source, term=term.take(place), n=n)


def _recounted(docs: DataFrame, name: str, held) -> DataFrame:
    """lang, source, term, n: each task's occurrences of a broadcast block's terms."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lang, term = held.value
        by_lang, counts = automata(name, lang, term), Counts(len(term))
        for part in slices(batches, "text", SLICE):
            groups: dict[tuple[str, str], list[str]] = {}
            for x, source, text in zip(*(part.column(c).to_pylist() for c in ("lang", "source", "text")), strict=True):
                if x in by_lang:
                    groups.setdefault((x, source), []).append(text)
            for key, texts in groups.items():
                said = f" {' '.join(texts)} ".encode("utf-8", "surrogatepass").translate(PADDED).decode("utf-8", "surrogatepass")
                counts.add(key, np.fromiter(map(itemgetter(1), by_lang[key[0]].iter(said)), np.int64))
            if counts.size > HELD_COUNTS:
                counts.sum()
                if counts.size > HELD_COUNTS // 2:
                    yield counts.taken(lang, term)
        if counts.held:
            yield counts.taken(lang, term)

    return map_batches(docs, work, "lang string, source string, term string, n long", keeps_memos=True)


def occurrences(docs: DataFrame, kept: DataFrame, block: int = BLOCK_BYTES) -> DataFrame:
    """lang, source, term, n: occurrences of the kept terms (lang, term) in each group, where there are any."""
    spark = docs.sparkSession
    size = kept.agg(F.sum(F.octet_length("term") + F.octet_length("lang") + 16)).first()[0] or 0
    n_blocks = max(1, -(-size // block))
    dealt = saved(kept.select("lang", "term", F.pmod(F.xxhash64("lang", "term"), F.lit(n_blocks)).alias("block")).sortWithinPartitions("block"), "vocabulary")
    parts = []
    for b in range(n_blocks):
        rows = dealt.filter(F.col("block") == b).select("lang", "term").toArrow().combine_chunks()
        if rows.num_rows:
            held = spark.sparkContext.broadcast(tuple(rows.column(c).combine_chunks() for c in ("lang", "term")))
            parts.append(_recounted(docs, run_path(spark, "automata"), held))
    if not parts:
        return spark.createDataFrame([], "lang string, source string, term string, n long")
    # Tasks have summed already: one shuffle, without a partial sum before it.
    return reduce(DataFrame.unionByName, parts).repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"))


def share(n, total):
    """1 + SCALE (n + 1) div total, without overflow; null where total is 0."""
    whole = F.lit(SCALE).cast("decimal(10,0)") * (F.coalesce(n, F.lit(0)) + 1).cast("decimal(19,0)")
    return F.when(total > 0, 1 + F.floor((whole - whole % F.when(total > 0, total).cast("decimal(19,0)")) / F.when(total > 0, total).cast("decimal(19,0)")).cast("long"))


def divergence(p, q):
    """(p - q)^2 div q of numpy or Spark longs."""
    return (p - q) * (p - q) // q


class Groups:
    """Each lang's groups by number: p0, the share of a term that a group lacks."""

    def __init__(self, rows: pa.Table):
        self.lacking: dict[str, np.ndarray] = {}
        for lang, at, p0 in zip(*(rows.column(c).to_pylist() for c in ("lang", "at", "p0")), strict=True):
            self.lacking.setdefault(lang, []).append((at, p0))
        self.lacking = {k: np.array([p for _, p in sorted(v)], np.int64) for k, v in self.lacking.items()}


def _common(postings: DataFrame, groups) -> DataFrame:
    """lang, s, o, value: what the terms that two groups share add to the sum of shares they lack."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            sizes = np.diff(batch.column("posting").offsets.to_numpy())
            flat = batch.column("posting").flatten()
            at, p = (flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("at", "p"))
            starts = np.cumsum(sizes) - sizes
            for lang in sorted(set(langs)):
                p0 = groups.value.lacking[lang]
                rows = np.flatnonzero(np.array([x == lang for x in langs]))
                # Entries, each with all entries of its term, in runs of about PAIRS pairs.
                entry = ranges(starts[rows], sizes[rows])
                width, first = np.repeat(sizes[rows], sizes[rows]), np.repeat(starts[rows], sizes[rows])
                done = np.cumsum(width)
                a = 0
                while a < len(entry):
                    z = max(a + 1, int(np.searchsorted(done, (done[a - 1] if a else 0) + PAIRS, "right")))
                    i, j = np.repeat(entry[a:z], width[a:z]), ranges(first[a:z], width[a:z])
                    s, o, x, y = at[i], at[j], p[i], p[j]
                    value = divergence(x, y) - divergence(x, p0[o]) - divergence(p0[s], y) + divergence(p0[s], p0[o])
                    keys, back = np.unique(s * len(p0) + o, return_inverse=True)
                    sums = np.zeros(len(keys), np.int64)
                    np.add.at(sums, back, value)
                    yield record(lang=pa.array([lang] * len(keys), pa.utf8()), s=keys // len(p0), o=keys % len(p0), value=sums)
                    a = z

    return map_batches(postings.select("lang", "posting"), work, "lang string, s long, o long, value long")


def _alone(shares: DataFrame, groups) -> DataFrame:
    """lang, s, o, value: what the terms of one group of a pair add, whether the other has them or not. shares: lang, at, p, n."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: dict[tuple[str, int], list[np.ndarray]] = {}
            for lang, at, p, n in zip(*(batch.column(c).to_pylist() for c in ("lang", "at", "p", "n")), strict=True):
                p0 = groups.value.lacking[lang]
                if (lang, at) not in sums:
                    sums[lang, at] = [np.zeros(len(p0), np.int64), np.zeros(len(p0), np.int64)]
                x = np.int64(p)
                sums[lang, at][0] += n * (divergence(x, p0) - divergence(p0[at], p0))
                sums[lang, at][1] += n * (divergence(p0, x) - divergence(p0, p0[at]))
            for (lang, at), (ahead, behind) in sums.items():
                other, own = np.arange(len(ahead)), np.full(len(ahead), at)
                yield record(lang=pa.array([lang] * (2 * len(other)), pa.utf8()), s=np.concatenate((own, other)), o=np.concatenate((other, own)), value=np.concatenate((ahead, behind)))

    return map_batches(shares, work, "lang string, s long, o long, value long")


def audit(docs: DataFrame, least: int = LEAST, top: int = TOP, block: int = BLOCK_BYTES) -> DataFrame:
    """lang, source, part (pair, term), item, value, rank."""
    spark = docs.sparkSession
    read = documents(docs)
    kept = saved(document_frequencies(read).filter(F.col("df") >= least).select("lang", "term"), "kept")
    counts = saved(occurrences(read, kept, block), "occurrences")
    sizes = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
    sums = counts.groupBy("lang", "source").agg(F.sum("n").alias("n_group"))
    groups = read.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(sizes, "lang", "left").na.fill(0, ["n_group", "v"])
    by_lang = Window.partitionBy("lang")
    groups = groups.withColumn("n_lang", F.sum("n_group").over(by_lang)).withColumn("at", F.row_number().over(by_lang.orderBy("source")) - 1)
    groups = saved(groups.withColumn("p0", F.coalesce(share(F.lit(0), F.col("n_group") + F.col("v")), F.lit(1))), "groups")
    held = spark.sparkContext.broadcast(Groups(groups.select("lang", "at", "p0").toArrow()))

    placed = counts.join(F.broadcast(groups.select("lang", "source", "at", "n_group", "n_lang", "v")), ["lang", "source"])
    entry = F.struct(F.col("at"), share(F.col("n"), F.col("n_group") + F.col("v")).alias("p"), F.col("source"))
    postings = saved(placed.groupBy("lang", "term").agg(F.collect_list(entry).alias("posting"), share(F.sum("n"), F.first("n_lang") + F.first("v")).alias("q")), "postings")
    entries = postings.select("lang", "term", "q", F.explode("posting").alias("e")).select("lang", "term", "q", "e.*")

    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item")))
    f = F.expr("(p - q) * (p - q) div q")
    terms = entries.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), f.alias("value")).withColumn("rank", rank).filter(F.col("rank") <= top)

    shares = entries.groupBy("lang", "at", "p").agg(F.count(F.lit(1)).alias("n")).select("lang", F.col("at").cast("long").alias("at"), "p", "n")
    sums = _common(postings, held).unionByName(_alone(shares, held)).groupBy("lang", "s", "o").agg(F.sum("value").alias("more"))
    one = groups.select("lang", "source", F.col("at").cast("long").alias("s"), "p0", "v")
    other = groups.select("lang", F.col("source").alias("item"), F.col("at").cast("long").alias("o"), F.col("p0").alias("q0"))
    pairs = one.join(other, "lang").filter("s <> o").join(sums, ["lang", "s", "o"], "left")
    value = F.expr("v * ((p0 - q0) * (p0 - q0) div q0) + coalesce(more, 0)")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", value.alias("value")).withColumn("rank", rank)
    return pairs.unionByName(terms)
