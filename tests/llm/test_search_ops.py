"""Ranked search, SentencePiece coding and the divergence audit against plain versions."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from lodestone.llm import op11_ranked as o11
from lodestone.llm import op12_sentencepiece as o12
from lodestone.llm import op13_divergence as o13
from lodestone.llm.terms import LETTER_BYTES, Terms
from tests.llm.helpers import SCHEMA, empty, frame, plain, rows

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(UPPER))


def letters(text):
    return re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(UPPER))


# Ranked search


def ranked(docs, items, k=50):
    said = [(i, Counter(words(t))) for i, t in docs]
    n = sum(1 for _, c in said if c)
    total = sum(sum(c.values()) for _, c in said)
    df = Counter(t for _, c in said for t in c)
    asked = defaultdict(set)
    for i, t in items:
        if i is not None:
            asked[i] |= set(words(t))
    out = []
    for item, terms in asked.items():
        found = []
        for i, c in said:
            m = 50 + (50 * sum(c.values()) * n) // max(total, 1)
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m)) for t in terms if t in c)
            if score > 0:
                found.append((-score, i is None, i or 0))
        out += [(item, r, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


ITEMS = [(1, "the or in be"), (2, None), (3, "one É x日 日本"), (None, "the"), (4, "nothinghere"), (1, "vel os lo"), (5, ""), (6, "the-the THE thelo mira" * 3), (7, " ".join(f"la{i} mi tu" for i in range(300)))]


@pytest.mark.parametrize("k", [1, 3, 50])
@pytest.mark.parametrize("partitions", [1, 5])
def test_ranked(spark, k, partitions):
    pairs = rows(seed=4, n=150)
    items = spark.createDataFrame([(i, t, "s", 1) for i, t in ITEMS], "item_id long, text string, score string, rank int")
    assert plain(o11.ranked(frame(spark, pairs).repartition(partitions), items, k)) == ranked(pairs, ITEMS, k)


def test_ranked_in_blocks_and_small_shards(spark, monkeypatch):
    """Many shards, many blocks of queries, lists of many variable blocks: the same rows."""
    pairs = rows(seed=5, n=120)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    index, n, total = o11.build(frame(spark, pairs).repartition(7))
    assert index.count() == 7
    assert plain(o11.search(index, n, total, items, 5, block=3)) == ranked(pairs, ITEMS, 5)


def test_a_row_group_for_each_shard(spark, monkeypatch):
    """Tasks of many shards: each is a row group of its own, whose writer keeps no blob, under a number of its own; the same rows."""
    monkeypatch.setattr(o11, "SHARD_BYTES", 1 << 12)
    pairs = rows(seed=6, n=150)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    index, n, total = o11.build(frame(spark, pairs).repartition(2))
    kept = [pq.ParquetFile(f).metadata for f in Path(index.__dict__["saved_path"].removeprefix("file://")).glob("*.parquet")]
    count = sum(m.num_rows for m in kept)
    assert count > 10 and [m.num_row_groups for m in kept] == [m.num_rows for m in kept]
    groups = [m.row_group(g) for m in kept for g in range(m.num_row_groups)]
    stats = {g.column(c).path_in_schema: g.column(c).is_stats_set for g in groups for c in range(g.num_columns)}
    assert stats["shard"] and not any(stats[c] for c in ("sizes", "gaps", "tfs", "ends", "maxima"))
    assert index.select("shard").distinct().count() == count
    assert plain(o11.search(index, n, total, items, 5)) == ranked(pairs, ITEMS, 5)


def test_ranked_on_empty_tables(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert o11.ranked(empty(spark), items).count() == 0
    assert o11.ranked(frame(spark, [(1, None), (2, "...")]), items).count() == 0
    assert o11.ranked(frame(spark, rows()), items.limit(0)).columns == ["item_id", "rank", "doc_id", "score"]
    assert o11.ranked(frame(spark, rows()), items.limit(0)).count() == 0


def test_string_items_and_other_columns(spark):
    items = spark.createDataFrame([("a", "one"), ("b", None)], "item_id string, text string")
    assert [(r.item_id, r.rank) for r in o11.ranked(frame(spark, [(4, "one"), (3, "one"), (None, "one"), (5, "two")]), items).collect()] == [("a", 1), ("a", 2), ("a", 3)]


def cheapest(impact, price):
    """Least cost of any cut of one list into granule-aligned blocks."""
    g = o11.GRANULE
    n = -(-len(impact) // g)
    best = [0] + [None] * n
    for i in range(1, n + 1):
        best[i] = min(best[j] + max(impact[j * g : i * g]) * (min(i * g, len(impact)) - j * g) + price for j in range(max(0, i - o11.WIDEST), i))
    return best[n]


def test_blocks_are_the_cheapest():
    rng = np.random.default_rng(3)
    counts = np.array([1, 3, 4, 5, 200, 2, 777, 64, 1])
    impact = (rng.pareto(1.5, counts.sum()) * 1000).astype(np.int64) + 1
    n, ends = o11.variable_blocks(counts, impact)
    assert n.sum() == len(ends) and set(np.cumsum(counts)) <= set(ends.tolist())
    at = 0
    for i, c in enumerate(counts.tolist()):
        mine = impact[at : at + c]
        price = int(o11.PRICE * (mine.max() - mine.sum() / c)) + 1
        cuts = [e - at for e in ends.tolist() if at < e <= at + c]
        assert len(cuts) == n[i]
        cost = sum(int(mine[a:z].max()) * (z - a) + price for a, z in zip([0, *cuts], cuts))
        assert cost == cheapest(mine.tolist(), price)
        at += c


def test_blocks_are_skipped():
    """A threshold that few documents reach leaves most postings of long lists alone."""
    rng = random.Random(1)
    texts = [" ".join(rng.choices(["a", "b", "c"], k=rng.randint(1, 400 if i % 500 < 5 else 3)) + ["q"] * (i % 997 == 3)) for i in range(6000)]
    part = pa.record_batch({"doc_id": pa.array(range(6000), pa.int64()), "text": texts})
    terms = Terms(part.column("text"), o11.WORD_BYTES)
    n, total = 6000, int(terms.sizes.sum())
    row = o11.shard(part, n, total)
    shard = o11.Shard({c: (x.slice(0, 1).flatten() if pa.types.is_list(x.type) else x[0].as_py()) for c, x in zip(row.schema.names, row.columns, strict=True)}, n, total)
    lists = np.array([shard.terms.to_pylist().index(t) for t in ("a", "q")])
    weights = np.array([100, 9000])
    docs, scores = shard.best(lists, weights, 3, 1)
    top = sorted(scores.tolist())[-3:]
    shard.scored = shard.asked = 0
    again, same = shard.best(lists, weights, 3, top[0])
    assert sorted(same.tolist())[-3:] == top
    assert shard.scored < shard.asked / 10


# SentencePiece


@pytest.fixture(scope="module")
def model():
    return o12.Pieces(o12.vocabulary_path(o12.MODEL))


def test_encoding_random_texts(model):
    rng = random.Random(3)
    signs = ["a", "b", "S", " ", "  ", "\n", "▁", "é", "日本", "🙂", "the", "\t", "\x00", "1", "  \n ", "ing", ".", "_.", "²,", "<s>", "<0x0A>", "Ⅳ", "ﬁ", "　", " ", "́", "--", "(x)"]
    for _ in range(4000):
        text = "".join(rng.choices(signs, k=rng.randint(1, 40)))
        ids = model.encode(text)
        assert ids == model.library.encode(text), text


def test_pairs_go_as_the_library_merges_them(model):
    """The verdict on two pieces is what the library makes of their joint text."""
    rng = random.Random(5)
    names = [p for p in model.ids if not p.startswith("▁")]
    spaced = [p for p in model.ids if p[:1] == "▁" and p[1:2] not in ("", "▁")]
    for _ in range(3000):
        before, piece = rng.choice(spaced), rng.choice(names)
        want = model.library.encode(f"{before[1:]}{piece}", out_type=str) == [before, piece]
        assert model.goes(before, piece) == want, (before, piece)


@pytest.mark.parametrize("text", ["a" * 100_000, "ab" * 50_000, " " * 30_000, "日" * 10_000 + "xyz" * 20_000, "no.stop," * 20_000, "e\n" * 40_000], ids=["one", "two", "spaces", "mixed", "marks", "lines"])
def test_long_texts(model, text):
    assert model.encode(text) == model.library.encode(text)


def test_round_trip(spark, model, monkeypatch):
    monkeypatch.setattr(o12, "STRETCH", 500)
    pairs = rows(seed=2)
    ids = {t: model.library.encode(t or "") for _, t in pairs}
    want = [(i, len(ids[t]), hashlib.sha256(",".join(map(str, ids[t])).encode()).hexdigest(), hashlib.sha256(model.library.decode(ids[t]).encode() if ids[t] else b"").hexdigest()) for i, t in pairs]
    assert plain(o12.digests(frame(spark, pairs))) == sorted(want, key=str)
    assert all(model.encode(t or "") == x for t, x in ids.items())
    assert o12.digests(empty(spark)).count() == 0


# Divergence


def audit(docs, least=3, top=200):
    docs = [(x or "", s or "", letters(t)) for x, s, t in docs]
    df = Counter((x, t) for x, _, w in docs for t in set(w))
    kept = defaultdict(set)
    for (x, t), n in df.items():
        if n >= least:
            kept[x].add(t)
    counts, of_lang = Counter(), Counter()
    for x, s, w in docs:
        for t in w:
            if t in kept[x]:
                counts[x, s, t] += 1
                of_lang[x, t] += 1
    groups, out = sorted({(x, s) for x, s, _ in docs}), []

    def shares(x, count):
        total = sum(count(t) for t in kept[x]) + len(kept[x])
        return {t: 1 + 10**9 * (count(t) + 1) // total for t in kept[x]}

    p = {(x, s): shares(x, lambda t: counts[x, s, t]) for x, s in groups}
    q = {x: shares(x, lambda t: of_lang[x, t]) for x in {x for x, _ in groups}}
    for x, s in groups:
        pair = sorted((-sum((p[x, s][t] - p[x, o][t]) ** 2 // p[x, o][t] for t in kept[x]), o.encode(), o) for y, o in groups if y == x and o != s)
        out += [(x, s, "pair", o, -v, r) for r, (v, _, o) in enumerate(pair, 1)]
        term = sorted((-((p[x, s][t] - q[x][t]) ** 2 // q[x][t]), t.encode(), t) for t in kept[x] if counts[x, s, t] and p[x, s][t] > q[x][t])[:top]
        out += [(x, s, "term", t, -v, r) for r, (v, _, t) in enumerate(term, 1)]
    return sorted(out, key=str)


def mixed_rows(seed, n, sources=9):
    rng = random.Random(seed)
    langs, names = ["en", "fr", "", None], [*map("s{}".format, range(sources)), None, ""]
    stock = [f"{a}{b}" for a in ("ba", "é", "日", "Zo", "q") for b in ("", "r", "ß", "mm", "x")]
    out = [(rng.choice(langs), rng.choice(names), " ".join(rng.choices(stock, k=rng.randint(0, 60))) + rng.choice(["", "1ba2ba", "-ba_é.", "\n\n"])) for _ in range(n)]
    return [*out, out[0], out[0], ("xx", "a", None), ("xx", "b", "alone"), ("yy", "only", "one one"), ("en", "quiet", "77 ..."), ("en", "long", "ba qr " * 20_000)]


@pytest.mark.parametrize("block", [1 << 20, 200])
def test_audit(spark, block):
    docs = mixed_rows(6, 150)
    df = spark.createDataFrame([(i, t, x, s, 5, "w", 1.5) for i, (x, s, t) in enumerate(docs)], "doc_id long, text string, lang string, source string, value int, part string, rank double").repartition(3)
    got = o13.audit(df, block=block)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert plain(got) == audit(docs)


def test_audit_keeps_its_top_and_stands_empty_tables(spark):
    docs = mixed_rows(7, 80, sources=2)
    df = spark.createDataFrame([(t, x, s) for x, s, t in docs], "text string, lang string, source string")
    assert plain(o13.audit(df, least=2, top=3)) == audit(docs, 2, 3)
    assert o13.audit(spark.createDataFrame([], SCHEMA)).count() == 0
    rare = spark.createDataFrame([("a b", "en", "x"), ("c", "en", "y")], "text string, lang string, source string")
    assert plain(o13.audit(rare)) == [("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1)]


def test_terms_are_told_apart_by_bytes():
    t = Terms(pa.array(["Ba ba-É", None, "", "é1ba"]), LETTER_BYTES)
    assert t.dictionary.to_pylist() == ["ba", "É", "é"] and t.doc.tolist() == [0, 0, 0, 3, 3] and t.sizes.tolist() == [3, 0, 0, 2]


def test_parts_are_looked_up_once_a_group(model, monkeypatch):
    """Repeated parts of many texts cost one look into the memo; texts in groups of any size come out as the library's."""
    texts = ["the cat, the cat", "", " \n\n the\n ▁ ▁▁x\n", "é, naïve; naïve;", "a\n", "\n", "\t▁", "x" * 50, "日本, 語 the", "the cat, the cat " * 300] * 2
    want = [model.library.encode(t) for t in texts]
    asked = []
    get_all = model.known.get_all
    monkeypatch.setattr(model.known, "get_all", lambda keys: asked.append(len(keys)) or get_all(keys))
    for size in (o12.GROUP, 1, 20):
        monkeypatch.setattr(o12, "GROUP", size)
        asked.clear()
        flat, counts = model.encode_all(texts)
        assert counts.tolist() == list(map(len, want)) and flat.tolist() == [i for x in want for i in x]
        assert size < 100 or sum(asked) < 50
    assert model.encode_all([])[1].size == 0 and model.encode_all([""])[1].tolist() == [0]
