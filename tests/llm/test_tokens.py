"""Ids, packing and counts against the library itself."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from lodestone.llm import op02_binary as o2
from lodestone.llm import op03_packing as o3
from lodestone.llm import op04_counts as o4
from lodestone.llm.tokens import Encoder, Memo, load, vocabulary_path

from .helpers import empty, frame, plain, rows

ODD = ["", " ", "a  b", " a", "a\n\nb", "x\ty", "<|endoftext|> a<|endoftext|>b", "don't it's 'S ''s", "ΑΣ İ ẞ é ́x", "a b c\x00", "a\x0bb\x1cc\x85d", "🙂🙂 x🙂", "Don, Straße. Å ǅ.", "A" * 300]


def odd_texts():
    rng = random.Random(2)
    return ODD + ["".join(rng.choice("aAbBéÉ'sS \n\t  .,!$09<|>日İΣ́") for _ in range(rng.randint(0, 40))) for _ in range(500)]


@pytest.mark.parametrize("name, spaced", [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_encoder(name, spaced):
    texts = odd_texts()
    library, encoder = load(vocabulary_path(name)), Encoder(vocabulary_path(name), spaced)
    for _ in range(2):
        ids, offsets = encoder(pa.array(texts + [None]))
        for i, t in enumerate(texts + [""]):
            assert ids[offsets[i] : offsets[i + 1]].tolist() == library.encode(t, add_special_tokens=False).ids, t


def test_memo():
    m = Memo(2)
    for k in "abc":
        m.put(k, k)
    m.turn()
    assert m.get("a") == "a" and m.get("z") is None and set(m.young) == {"a"}


def test_prefix_counts():
    counter, library = o4.PrefixCounter(vocabulary_path(o4.VOCABULARY)), load(vocabulary_path(o4.VOCABULARY))
    texts = odd_texts()
    assert counter(pa.array(texts)).tolist() == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    for t in texts[:60] + ["unbelievable tokenization of wörds, it's 2024"]:
        assert counter.prefix_counts(t).tolist() == [len(library.encode(t[:i], add_special_tokens=False).ids) for i in range(len(t) + 1)], t
    assert library.encode("hello wonderful wor"[: counter.within("hello wonderful wor", 2)], add_special_tokens=False).ids == library.encode("hello wonderful", add_special_tokens=False).ids


def test_prefix_counts_of_any_script():
    counter = o4.PrefixCounter(vocabulary_path(o4.VOCABULARY))
    library = load(vocabulary_path(o4.VOCABULARY))
    want = lambda t: [len(library.encode(t[:i], add_special_tokens=False).ids) for i in range(len(t) + 1)]
    texts = ["Größe naïve ÉTUDE", "日本語テキスト。東京 плохо СЛОВА", "İstanbul aİb İ̇ 1İ2 éİ!", "🙂🙂ab é🙂 x\u3000y\x85z", "Straße—«été» ΣΟΦΟΣ ﬁ ½²"]
    texts += ["été cafe\u0301 naïve", "é<|endoftext|>x naïve été", "l'été it's qu'il I'LL é're '' 's!'s", "\u0344 a\u0301\u0323 é", "it's-it's-we'll!!'ll''s'", "!!<|endoftext|>!!<|startoftext|>it's", "\u0301\u0301x", "<|endoftext|", "|><|<|endoftext|>>"]
    texts += ["'s\u0301 x'l\u0301 'ls\u0301 'll\u0301 'r\u0301e !'s\u0301", "e\u0301" * 30 + "s\u0301s", "\u212b\u1100\u1161\u11a8\u1100\u1161 \u0958", "ab" * 20 + "e\u0301\u0323" + "!" * 20 + "e\u0301"]
    rng = random.Random(12)
    texts += ["".join(rng.choice(["'", "s", "l", "L", "\u0301", "\u0323", "e", "r", "!", "1", "İ", "é", "\u1161", "\u1100", " ", "<|endoftext|>", "<|end", "zz" * 6]) for _ in range(rng.randint(1, 24))) for _ in range(400)]
    for t in texts:
        assert counter.prefix_counts(t).tolist() == want(t), t


@pytest.mark.parametrize("unit", ["l'été d'Ève, it's “naïf” ", "l'e\u0301te\u0301 d'E\u0300ve, it's nai\u0308f ", "it's-we'll-", "e\u0301te\u0301", "ab<|endoftext|>", "東京都は"])
def test_prefix_counts_of_long_texts(unit):
    """5 MB of accented text with apostrophes, with and without spaces: time in proportion to its length."""
    import time

    counter, library = o4.PrefixCounter(vocabulary_path(o4.VOCABULARY)), load(vocabulary_path(o4.VOCABULARY))
    spaced = " " in unit
    t = unit * ((5_000_000 if spaced else 500_000) // len(unit.encode()))
    began = time.time()
    got = counter.prefix_counts(t)
    assert time.time() - began < 10
    for i in (1, 1001, 20_000):
        assert got[i] == len(library.encode(t[:i], add_special_tokens=False).ids)
    assert got[-1] == counter.of_text(t)


def test_vocabularies_of_other_kinds():
    with pytest.raises(ValueError):
        o4.PrefixCounter(vocabulary_path("byte_bpe_50k.json"))


def test_token_counts(spark):
    pairs, library = rows(), load(vocabulary_path(o4.VOCABULARY))
    size = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    got = o4.token_counts(frame(spark, pairs))
    want = [(i, len((t or "").encode()), n := size(t or ""), n > 2048) for i, t in pairs]
    assert plain(got.select("doc_id", "n_bytes", "n_tokens", "over_limit")) == sorted(want, key=str)
    for limit in (5, 2048):
        for r in o4.token_counts(frame(spark, pairs), limit=limit).collect():
            t = next(t or "" for i, t in pairs if i == r.doc_id and len((t or "").encode()) == r.n_bytes)
            assert size(t[: r.fits_chars]) <= limit and (r.fits_chars == len(t)) == (r.n_tokens <= limit)
            assert all(size(t[:i]) > limit for i in range(r.fits_chars + 1, min(len(t), r.fits_chars + 12) + 1))
    tables = o4.prefix_table(frame(spark, pairs))
    for r in o4.cut(tables, 40).collect():
        texts = [t or "" for i, t in pairs if i == r.doc_id]
        assert any(size(t[: r.chars]) == r.n_tokens <= 40 and (r.chars == len(t) or t[r.chars] in " \n") or r.chars == 0 for t in texts)
    assert plain(o4.token_counts(empty(spark))) == [] and plain(o4.cut(o4.prefix_table(empty(spark)), 5)) == []


def test_stream_of_bytes():
    rng = np.random.default_rng(0)
    ranks = np.concatenate([rng.integers(0, 1 << b, 300, dtype=np.uint32) for b in (1, 8, 16, 24, 31)] + [np.array([0, 255, 256, 65535, 65536, (1 << 24) - 1, 1 << 24, (1 << 32) - 1], np.uint32)])
    for n in (0, 1, 3, 4, 5, len(ranks)):
        assert o2.decode_ranks(*o2.encode_ranks(ranks[:n]), n).tolist() == ranks[:n].tolist()
    ids, counts, got, before = o2.read_blob(o2.write_blob([3, None, 9], np.array([2, 0, 1]), ranks[:3], 17))
    assert before == 17 and ids == [3, None, 9] and counts.tolist() == [2, 0, 1] and got.tolist() == ranks[:3].tolist()
    with pytest.raises(ValueError):
        o2.read_blob(b"x" * 64)


def test_binary_ids(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(o2, "SHARD_IDS", 500)
    monkeypatch.setattr(o2, "PART_IDS", 3000)
    pairs, library = rows(), load(vocabulary_path(o2.VOCABULARY))
    got = o2.binary_ids(frame(spark, pairs)).orderBy("start").collect()
    crc = lambda t: zlib.crc32(np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes())
    assert sorted((str(r.doc_id), r.ids_crc32) for r in got) == sorted((str(i), crc(t)) for i, t in pairs)
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    ids = [r.doc_id for r in got]
    assert ids == [None, None, *sorted(i for i, _ in pairs if i is not None)]
    assert plain(o2.binary_ids(empty(spark))) == []
    # The same from the files alone, without Spark.
    import pyarrow.parquet as pq

    o2.write_shards(frame(spark, pairs), f"file://{tmp_path}/out")
    table = pq.read_table(tmp_path / "out" / "ranks").sort_by("rank")
    assert table.column("rank").to_pylist() == list(range(len(table)))
    by_rank, at, seen = table.column("id").to_numpy(), 0, []
    shards = pq.read_table(tmp_path / "out" / "shards").sort_by([("part", "ascending"), ("seq", "ascending")]).to_pylist()
    assert len({x["part"] for x in shards}) > 1 and len(shards) > 5
    for x in shards:
        ids, counts, ranks, _ = o2.read_blob(x["blob"])
        values = by_rank[ranks].astype("<u4")
        for i, n in zip(ids, counts.tolist(), strict=True):
            seen.append((i, at, n, zlib.crc32(values[:n].tobytes())))
            values, at = values[n:], at + n
    assert seen == [tuple(r) for r in got]


@pytest.mark.parametrize("length", [1024, 7])
def test_packing(spark, length):
    pairs, library = rows(), load(vocabulary_path(o3.VOCABULARY))
    want = defaultdict(list)
    for i, t in pairs:
        want[i].append(np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4"))
    got = o3.pack(frame(spark, pairs), length=length, with_ids=True).collect()
    by, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length
    for i, texts in want.items():
        whole = b"".join(bytes(r.ids) for r in sorted(by[i], key=lambda r: (r.sequence_id, r.offset)))
        assert sorted(whole) == sorted(b"".join(x.tobytes() for x in texts))
        if len(texts) == 1:
            assert whole == texts[0].tobytes() and all(r.doc_tokens == len(texts[0]) for r in by[i])
    assert set(sequences) == set(range(len(sequences)))
    for k, v in sequences.items():
        at = 0
        for r in sorted(v, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == length or k == len(sequences) - 1 and at < length
    assert plain(o3.pack(empty(spark))) == []
