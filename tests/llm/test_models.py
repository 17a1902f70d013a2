"""Classifiers by held-out accuracy, extraction on known pages, and the pipeline."""

import os
import random

import numpy as np
import pyarrow as pa
import pytest

from lodestone.llm import op01_toxicity as o1
from lodestone.llm import op07_html as o7
from lodestone.llm import op08_quality as o8

from .helpers import empty, frame, held_out, labels, rows, sentence

DIR = "/root/testdata/sf0.01"


def classified(spark, n=400):
    rng = random.Random(11)
    pairs, toxic, poor = [], set(), set()
    for i in range(n):
        t = sentence(rng, rng.randint(5, 80))
        if rng.random() < 0.25:
            toxic.add(i)
            w = t.split()
            w.insert(rng.randint(0, len(w)), rng.choice(["idiot", "zorkan", "zorkel", "zorkus"]))
            t = " ".join(w)
        if rng.random() < 0.3:
            poor.add(i)
            t = " | ".join(t.upper().split()) + "!!"
        pairs.append((i, t))
    pairs += [(i + 5000, t) for i, t in rows() if i is not None]
    return pairs, toxic, poor


def test_toxicity(spark):
    pairs, toxic, _ = classified(spark)
    docs, known = frame(spark, pairs), labels(spark, [p for p in pairs if p[0] < 5000], toxic=lambda i, t: int(i in toxic))
    got = o1.toxicity(docs, known).collect()
    assert len(got) == len(pairs) and all(r.held_out == held_out(r.doc_id) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    test = [r for r in got if r.held_out and r.doc_id < 5000]
    assert np.mean([r.predicted == int(r.doc_id in toxic) for r in test]) > 0.93
    shuffled = labels(spark, [p for p in pairs if p[0] < 5000], toxic=lambda i, t: int(i in toxic) if not held_out(i) else 1)
    assert {r.doc_id: r.score for r in o1.toxicity(docs, shuffled).collect()} == {r.doc_id: r.score for r in got}
    assert o1.toxicity(empty(spark), known).count() == 0
    bare = {r.doc_id: r.predicted for r in o1.toxicity(frame(spark, [(1, "you idiot"), (2, "fine"), (3, None)]), known.limit(0)).collect()}
    assert bare == {1: 1, 2: 0, 3: 0}


def test_label_model():
    rng = np.random.default_rng(0)
    y = rng.random(2000) < 0.2
    votes = np.column_stack([rng.random(2000) < np.where(y, 0.5, 0.002) for _ in range(6)])
    votes = np.column_stack([votes, votes[:, 0], votes[:, 0]])  # copies of one voter
    posterior = o1.label_model(votes, 0.2)
    assert ((posterior > 0.5) == y).mean() > 0.97


def slow_information(votes, w):
    """Conditional mutual information of each pair, cell by cell."""
    n, m = votes.shape
    out = np.zeros((m, m))
    for i in range(m):
        for j in range(m):
            for weight in (w, 1 - w):
                total = weight.sum()
                for a in (0, 1):
                    for b in (0, 1):
                        p = weight[(votes[:, i] == a) & (votes[:, j] == b)].sum() / total
                        q = weight[votes[:, i] == a].sum() / total * weight[votes[:, j] == b].sum() / total
                        out[i, j] += total / n * p * np.log(p / q) if p > 1e-12 and i != j else 0
    return out


def test_forest_of_voters():
    """The dependence forest against all pairs in falling order of information, joined where they close no ring."""
    rng = np.random.default_rng(5)
    base = rng.random((500, 7)) < 0.3
    votes = np.column_stack([base, base[:, 0] & (rng.random(500) < 0.9), base[:, 1] | (rng.random(500) < 0.05), base[:, 0] ^ (rng.random(500) < 0.02)]).astype(float)
    w = rng.random(500)
    info, rate, m = slow_information(votes, w), votes.mean(0), votes.shape[1]
    component, edges = list(range(m)), set()
    for x, i, j in sorted(((info[i, j], i, j) for i in range(m) for j in range(i)), reverse=True):
        if x > 0.02 * min(rate[i], rate[j]) and component[i] != component[j]:
            component = [component[i] if c == component[j] else c for c in component]
            edges.add(frozenset((i, j)))
    forest = o1.Forest(votes, w)
    assert {frozenset((i, p)) for i, p in enumerate(forest.parent.tolist()) if i != p} == edges and len(edges) >= 3
    place = {x: k for k, x in enumerate(forest.order)}
    assert all(p == i or place[p] < place[i] for i, p in enumerate(forest.parent.tolist()))


def slow_label_model(votes, balance, rounds, forests):
    """The same estimate, row by row and voter by voter."""
    n, m = votes.shape
    post = [0.9 if votes[r].any() else 0.02 for r in range(n)]
    parent = list(range(m))
    for _ in range(forests):
        for _ in range(rounds):
            rate = {}
            for j in range(m):
                for said in (0, 1):
                    rows_ = [r for r in range(n) if (parent[j] != j and votes[r, parent[j]]) == bool(said)]
                    on = (sum(post[r] for r in rows_ if votes[r, j]) + 0.05) / (sum(post[r] for r in rows_) + 1)
                    off = (sum(1 - post[r] for r in rows_ if votes[r, j]) + 0.05) / (sum(1 - post[r] for r in rows_) + (1 if said else 10))
                    rate[j, said] = max(np.log(on / off), 0)
            silent = [r for r in range(n) if not votes[r].any()]
            quiet = min(np.log((sum(post[r] for r in silent) + 0.05) / (sum(post) + 1) / ((sum(1 - post[r] for r in silent) + 0.05) / (n - sum(post) + 1))), 0)
            new = []
            for r in range(n):
                logit = np.log(balance / (1 - balance)) + sum(rate[j, int(parent[j] != j and votes[r, parent[j]])] for j in range(m) if votes[r, j]) + (0 if votes[r].any() else quiet)
                new.append(1 / (1 + np.exp(-min(max(logit, -30), 30))))
            moved = max(abs(a - b) for a, b in zip(new, post, strict=True))
            post = new
            if moved < 1e-6:
                break
        found = o1.Forest(votes.astype(float), np.array(post)).parent.tolist()
        if found == parent:
            break
        parent = found
    return post


def test_label_model_against_loops():
    rng = np.random.default_rng(3)
    y = rng.random(150) < 0.25
    votes = np.column_stack([rng.random(150) < np.where(y, 0.5, 0.03) for _ in range(5)])
    votes = np.column_stack([votes, votes[:, 0] & (rng.random(150) < 0.9), votes[:, 1]])
    assert o1.label_model(votes, 0.25, 8, 3) == pytest.approx(slow_label_model(votes, 0.25, 8, 3), abs=1e-9)


def test_copied_voter_adds_nothing():
    """A weak voter's copies must not outvote it: with them its posterior stays what it is alone."""
    rng = np.random.default_rng(4)
    y = rng.random(4000) < 0.2
    good = np.column_stack([rng.random(4000) < np.where(y, 0.6, 0.01) for _ in range(4)])
    weak = rng.random(4000) < np.where(y, 0.3, 0.1)
    alone = o1.label_model(np.column_stack([good, weak]), 0.2)
    copied = o1.label_model(np.column_stack([good, weak, *[weak] * 6]), 0.2)
    lone = weak & ~good.any(1)
    assert abs(alone[lone].mean() - copied[lone].mean()) < 0.05


def test_sample_is_bounded_by_rows(spark):
    """20,000 rows under one labelled id are one row of the sample: the one of least text."""
    from lodestone.llm.common import training_rows

    docs = spark.range(20_000).select(o1.F.lit(2).cast("long").alias("doc_id"), o1.F.concat(o1.F.lit("text "), "id").alias("text")).unionByName(spark.createDataFrame([(3, None), (3, "x"), (None, "y")], "doc_id long, text string"))
    known = spark.createDataFrame([(2, 1, 0), (2, 0, 0), (3, 1, 1), (4, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert not held_out(2) and not held_out(3)
    got = sorted(tuple(r) for r in training_rows(docs, known, "quality", 8192).collect())
    assert got == [(2, "text 0", 1), (3, "", 1)]


def test_quality(spark):
    pairs, _, poor = classified(spark)
    docs, known = frame(spark, pairs), labels(spark, [p for p in pairs if p[0] < 5000], quality=lambda i, t: int(i not in poor))
    got = o8.quality(docs, known).collect()
    assert len(got) == len(pairs) and all(r.held_out == held_out(r.doc_id) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    test = [r for r in got if r.held_out and r.doc_id < 5000]
    assert np.mean([r.predicted == int(r.doc_id not in poor) for r in test]) > 0.95
    kept = o8.keep_good(docs, known)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted for r in got)
    assert o8.quality(empty(spark), known).count() == 0
    with pytest.warns(UserWarning, match="no labelled row"):
        assert {r.score for r in o8.quality(docs, known.limit(0)).collect()} == {1.0}


def test_exact_votes():
    rng = np.random.default_rng(2)
    texts = pa.array([sentence(random.Random(i % 50), 20) for i in range(60)])  # ten of them twice
    space = o8.Space(*o8.term_rows(texts), rng.integers(0, 2, 60).astype(float))
    v = space.known[:7]
    for got, row in zip(space.vote(v, 5), (v @ space.known.T).astype(float), strict=True):
        top = [j for j in range(60) if row[j] >= sorted(row)[-5] - o8.TIE]
        w = [max(row[j], 1e-6) ** 8 for j in top]
        assert got == pytest.approx(sum(x * space.labels[j] for x, j in zip(w, top, strict=True)) / sum(w), rel=1e-9)
    # The sample's order and a block's shape change nothing.
    order = rng.permutation(60)
    mixed = o8.Space.__new__(o8.Space)
    mixed.__dict__ |= space.__dict__ | {"known": space.known[order], "labels": space.labels[order]}
    assert mixed.vote(v, 5) == pytest.approx(space.vote(v, 5), abs=1e-6) and space.vote(v[:1], 5) == pytest.approx(space.vote(v, 5)[:1], abs=1e-6)


def slow_terms(text):
    """Term counts of one text, character by character."""
    from collections import Counter

    from lodestone.llm.common import word_hash

    data = (text or "").encode()
    kind = lambda b: 1 if 65 <= b <= 90 else 2 if 48 <= b <= 57 else 4 if b == 10 else 3 if b <= 32 else 0 if 97 <= b <= 122 or b > 127 else 5 + [c for c in range(33, 128) if not chr(c).isalnum()].index(b)
    out = Counter()
    for a, b, c in zip(data, data[1:], data[2:]):
        out[(kind(a) * o8.N_CLASS + kind(b)) * o8.N_CLASS + kind(c)] += 1
    words = __import__("re").findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    for lo, units in ((0, words), (12, list(zip(words, words[1:])))):
        out[o8.N_CLASS**3 + lo + min(11, int(12 * (1 - len(set(units)) / max(len(units), 1))))] += max(8, len(data) // 8)
    for w in words:
        out[o8.N_CLASSES + (word_hash(w) >> 64 - o8.WORD_BITS)] += 1
    return out


def test_terms_projection_and_scores():
    """Terms, latent space, projection and score against loops and a whole decomposition."""
    texts = [t or "" for _, t in rows(n=60) if len(t or "") < 20_000]
    row, term, count = o8.term_rows(pa.array(texts))
    found = [{} for _ in texts]
    for r, t, c in zip(row.tolist(), term.tolist(), count.tolist(), strict=True):
        found[r][t] = found[r].get(t, 0) + c
    assert found == [dict(slow_terms(t)) for t in texts]
    y = np.array([i % 3 == 0 for i in range(len(texts))], float)
    space = o8.Space(row, term, count, y)
    df = {}
    for x in found:
        for t in x:
            df[t] = df.get(t, 0) + 1
    # A word's place that two words of a text share counts once for each of them in the library's df; here there are none.
    kept = [t for lo, hi, most in ((0, o8.N_CLASSES, o8.CLASSES), (o8.N_CLASSES, o8.N_TERMS, o8.WORDS)) for t in sorted((t for t in df if lo <= t < hi and df[t] >= 2), key=lambda t: (-df[t], t))[:most]]
    x = np.array([[np.log1p(f.get(t, 0)) * (np.log((1 + len(texts)) / (1 + df[t])) + 1) for t in kept] for f in found])
    for lo, hi in ((0, o8.N_CLASSES), (o8.N_CLASSES, o8.N_TERMS)):
        at = [i for i, t in enumerate(kept) if lo <= t < hi]
        x[:, at] /= np.maximum(np.linalg.norm(x[:, at], axis=1, keepdims=True), 1e-9)
    u, s, vt = np.linalg.svd(x, full_matrices=False)
    v = u[:, : o8.RANK] * s[: o8.RANK]
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
    assert space.known @ space.known.T == pytest.approx(v @ v.T, abs=2e-2)
    want = []
    for r in v @ v.T:
        top = [j for j in range(len(r)) if r[j] >= sorted(r)[-o8.NEIGHBOURS] - o8.TIE]
        w = [max(r[j], 1e-6) ** 8 for j in top]
        want.append(sum(a * y[j] for a, j in zip(w, top, strict=True)) / sum(w))
    assert np.mean(np.abs(space.score(pa.array(texts)) - want) < 0.05) > 0.9
    g = np.random.default_rng(1).normal(size=(400, 30)) * np.linspace(3, 0.1, 30)
    g = g @ g.T
    q, whole = o8.leading(g, 8), np.linalg.eigh(g)[1][:, ::-1][:, :8]
    assert np.abs(np.linalg.svd(q.T @ whole)[1] - 1).max() < 1e-3


PAGE = """<html><head><title>t</title></head><body><div class='cookie-notice'>We use cookies</div><nav><a href=x>Home</a></nav><div id=content><h1>Big &amp; news</h1>
<p>First para, with text.   More of it here
and more.<p>Second <b>one</b> here.<div class=ad>Buy now</div><ul><li>One thing<li>Two thing</ul><section id=comments><p>Nice post</p></section>
<form><label>mail</label><input><button>Go</button></form><script>var a = "<p>x</p>";</script></div><aside>rel</aside><footer>c 2020</footer>"""


def test_extraction(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "x"), (2, "u", None, "x"), (3, None, "", "x"), (1, "u", PAGE, "x"), (4, "u", "<article>x &eacute;<p>y &#233;", "x")], "page_id long, url string, html string, text string")
    got = sorted((tuple(r) for r in o7.main_text(pages).collect()), key=str)
    text = "Big & news\nFirst para, with text. More of it here and more.\nSecond one here.\nOne thing\nTwo thing"
    assert got == [(1, "u", text, len(text)), (1, "u", text, len(text)), (2, "u", "", 0), (3, None, "", 0), (4, "u", "x é\ny é", 7)]
    assert o7.main_text(pages.limit(0)).count() == 0


BROKEN = {
    "open tags": lambda n: "<a " * 170 * n, "marks": lambda n: "<!" * 250 * n, "end tags": lambda n: "<b>" * 70 * n + "</i>" * 70 * n, "cells": lambda n: "<b>" * 40 * n + "<td></td>" * 40 * n,
    "items": lambda n: "<li><ul>" + "<b>" * 50 * n + "<li></li>" * 35 * n, "quotes": lambda n: '<a ">"' * 80 * n, "one quote": lambda n: "<a '>x" * 70 * n + '"', "raw": lambda n: "<script>" + "</script" * 60 * n,
    "number": lambda n: "<p>&#" + "9" * 500 * n, "names": lambda n: "<x" * 250 * n + ">", "comments": lambda n: "<!-- <" * 80 * n, "attributes": lambda n: "<p " + 'class=" ' * 60 * n + ">x",
}


@pytest.mark.parametrize("kind", sorted(BROKEN))
def test_long_broken_pages(kind):
    """Eight times the page takes some eight times the CPU time, whatever the machine; quadratic work takes 64 times."""
    import time

    model, spent = o7.trained(), []
    for n in (500, 4000):
        page = BROKEN[kind](n)
        began = time.process_time()
        o7.extract_all([page, PAGE], model)
        spent.append(time.process_time() - began)
    assert spent[1] < 24 * spent[0] + 0.5


def test_features_of_subtrees():
    """Sums over runs of elements against sums over descendants."""
    for source in [*(p for p, _ in zip(_pages(), range(20), strict=False)), PAGE, "<a><b></a></b><p>x<p>y<li>z"]:
        page = o7.Page(source)
        m, n = page.measures(), len(page.tags)
        under = lambda i, j: j == i or j > 0 and under(i, page.parents[j])
        for i in range(n):
            inside = [j for j in range(n) if under(i, j)]
            texts = [t for e, _, t in page.chunks if e in set(inside)]
            assert m["inner"][i] == len(inside) - 1 and m["chars"][i] == sum(map(len, texts)) and m["kids"][i] == page.parents.count(i)
            assert m["linked"][i] == sum(len(t) for e, _, t in page.chunks if e in set(inside) and any(page.tags[k] == "a" and under(k, e) for k in range(n)))
        whole = page.features()
        assert np.array_equal(np.concatenate([page.features(m, a, a + 5) for a in range(0, n, 5)]), whole)


def _pages():
    return o7.training_pages(60, 5)


#: Pages of other makes than the training pages: their articles' texts, block by block.
OTHERS = [
    (
        """<html lang=de><body class="home blog"><div id="wrapper"><div id="masthead"><img src=l.png><span>Der Anzeiger</span></div><table class="menu"><tr><td><a href=/>Start</a></td><td><a href=/x>Politik</a></td></tr></table>
<div role="main" class="post-content"><h2>Der Fluss steigt weiter</h2><p>Am Morgen stand das Wasser schon h&ouml;her als am Abend davor, sagte der W&auml;rter, und niemand wusste, wie lange das so gehen w&uuml;rde.</p>
<p>Die Leute trugen ihre S&auml;cke zum Damm, und manche blieben bis in die Nacht, weil sie den Nachrichten nicht trauten.</p></div><div class="sidebar-widget"><ul><li><a href=1>Mehr lesen</a></li><li><a href=2>Archiv</a></li></ul></div>
<div id="footer"><p>Impressum | Kontakt</p></div></div></body></html>""",
        "Der Fluss steigt weiter\nAm Morgen stand das Wasser schon höher als am Abend davor, sagte der Wärter, und niemand wusste, wie lange das so gehen würde.\nDie Leute trugen ihre Säcke zum Damm, und manche blieben bis in die Nacht, weil sie den Nachrichten nicht trauten.",
    ),
    (
        """<!doctype html><body><header><nav><ul><li><a href=a>Home</a><li><a href=b>About</a></ul></nav></header><main><article class="hentry"><h1>A quiet harbour</h1>
<p>The boats came in before the storm, one after another, and were tied to the old wall.</p><figure><img src=x><figcaption>Boats at the wall.</figcaption></figure>
<blockquote><p>We have seen worse, said the master of the smallest boat, and went home.</p></blockquote><aside class="related-posts"><h3>Read on</h3><a href=c>Storms</a></aside>
<p>By night the wind had dropped, and the lamps along the quay were lit again.</p></article><section id="comments" class="comment-list"><div class="comment">Lovely!</div></section></main><footer>All rights reserved</footer></body>""",
        "A quiet harbour\nThe boats came in before the storm, one after another, and were tied to the old wall.\nBoats at the wall.\nWe have seen worse, said the master of the smallest boat, and went home.\nBy night the wind had dropped, and the lamps along the quay were lit again.",
    ),
    (
        """<div class="cookie-banner">We use cookies. <button>OK</button></div><div class="container"><div class="col-8"><div class="entry-content"><h1>How to mend a net</h1><ol><li>Wash the net in fresh water and let it dry.</li><li>Cut the torn meshes back to sound knots.</li></ol>
<div class="ad-slot">Nets half price!</div><pre>knot, pull, turn, knot</pre></div></div><form action=/s><input name=q><button>Search</button></form></div><div class="copyright">Made in 2020</div>""",
        "How to mend a net\nWash the net in fresh water and let it dry.\nCut the torn meshes back to sound knots.\nknot, pull, turn, knot",
    ),
]


def test_pages_of_other_makes():
    """Pages that the rule for training pages didn't shape: no more than one block of all is wrong."""
    wrong = 0
    for (_, want), got in zip(OTHERS, o7.extract_all([p for p, _ in OTHERS], o7.trained()), strict=True):
        wrong += len(set(want.split("\n")) ^ set(got.split("\n")))
    assert wrong <= 1


#: Pages without class names, ids or telling tags.
PLAIN = [
    (
        """<!doctype html><html><head><title>A page</title></head><body><div><a href=/>Home</a> <a href=/n>News</a> <a href=/s>Sport</a></div>
<h1>A bridge for the valley</h1><p>The council met on Monday and agreed, after long talk, to build the bridge that the valley has asked for.</p>
<p>Work will begin in spring, the mayor said, if the river allows it.</p><h2>What it costs</h2><p>Nobody would name a figure.</p><ul><li>Stone from the old mill</li><li>Timber from the north wood</li></ul>
<div>Copyright 2019 The Paper. <a href=/i>Imprint</a></div></body></html>""",
        "A bridge for the valley\nThe council met on Monday and agreed, after long talk, to build the bridge that the valley has asked for.\nWork will begin in spring, the mayor said, if the river allows it.\nWhat it costs\nNobody would name a figure.\nStone from the old mill\nTimber from the north wood",
    ),
    (
        """<html><body><table><tr><td><a href=1>One</a><br><a href=2>Two</a></td><td><div><h1>Salt and iron</h1><div>Ships from the south brought salt, and took iron home again, as they had for two hundred years.</div>
<div>When the mine closed, the salt came by road.</div></div></td></tr></table><div><a href=x>Top</a> | <a href=y>Contact</a></div></body></html>""",
        "Salt and iron\nShips from the south brought salt, and took iron home again, as they had for two hundred years.\nWhen the mine closed, the salt came by road.",
    ),
    (
        """<body><div><div><ul><li><a href=1>Start</a></li><li><a href=2>Archive</a></li></ul></div><div><h1>On bees</h1><div><p>A hive in winter is not asleep, only quiet, and it eats what it has stored.</p><p>Open it late.</p></div></div>
<div><h3>See also</h3><ul><li><a href=3>On wasps</a></li><li><a href=4>On ants</a></li></ul></div><div><p>All rights reserved.</p></div></div></body>""",
        "On bees\nA hive in winter is not asleep, only quiet, and it eats what it has stored.\nOpen it late.",
    ),
    (
        """<html><body><div><div><a href=/>The Lamp</a></div><div><a href=/a>Archive</a><a href=/b>Letters</a><a href=/c>About us</a></div></div><div><div><h1>The last ferryman</h1><p>For forty years Ansel rowed whoever came, and he never asked <i>where</i> they were going.</p>
<p>The new road ends that. It crosses a mile upstream, and nobody, says Ansel, will pay to be slow.</p><blockquote>I don't mind, he says. My back minds less.</blockquote><p>He has sold one boat and kept the other.</p></div><div><div><a href=/1>Roads and rivers</a></div><div><a href=/2>Old trades</a></div></div></div><div>The Lamp, Mill Street 4</div></body></html>""",
        "The last ferryman\nFor forty years Ansel rowed whoever came, and he never asked where they were going.\nThe new road ends that. It crosses a mile upstream, and nobody, says Ansel, will pay to be slow.\nI don't mind, he says. My back minds less.\nHe has sold one boat and kept the other.",
    ),
    (
        """<html><head><title>x</title></head><body><center><a href=/>Index</a> | <a href=/m>Map</a> | <a href=/q>Questions</a></center><h1>Grafting pears</h1><p>Cut the scions in January, while the tree sleeps, and keep them in damp sand.<p>Graft when the sap rises:
<ol><li>Saw the stock off level.</li><li>Split it a thumb deep, no more.</li><li>Set two scions, bark to bark, and seal all with wax.</li></ol><h2>After care</h2><p>Rub off the shoots below the graft, and stake what grows.<p><a href=/>Index</a> | <a href=/top>Top</a></body></html>""",
        "Grafting pears\nCut the scions in January, while the tree sleeps, and keep them in damp sand.\nGraft when the sap rises:\nSaw the stock off level.\nSplit it a thumb deep, no more.\nSet two scions, bark to bark, and seal all with wax.\nAfter care\nRub off the shoots below the graft, and stake what grows.",
    ),
]


def test_pages_without_names():
    """Blocks found and blocks wanted, on pages written by hand and on unseen ones of the training rule."""
    model, right, found, wanted = o7.trained(), 0, 0, 0
    for (_, want), got in zip(PLAIN, o7.extract_all([p for p, _ in PLAIN], model), strict=True):
        want, got = set(want.split("\n")), set(got.split("\n"))
        right, found, wanted = right + len(want & got), found + len(got), wanted + len(want)
    assert right / found >= 0.95 and right / wanted >= 0.95
    right, total = 0, 0
    for source in o7.training_pages(0, 99, bare=60):
        page = o7.Page(source)
        known = [1, *(int(m[2]) for m in o7._KNOWN.finditer(source) if m[1] != "br")]
        right, total = right + int((page.decode(model.score(page.features())) == np.array(known, bool)).sum()), total + len(known)
    assert right / total > 0.98


def test_decoding_is_hierarchical():
    model, good, total = o7.trained(), 0, 0
    for source in o7.training_pages(60, 99):
        page = o7.Page(source)
        known = [1, *(int(m[2]) for m in o7._KNOWN.finditer(source) if m[1] != "br")]
        keep = page.decode(model.score(page.features()))
        assert all(keep[page.parents[i]] for i in np.flatnonzero(keep)[1:])
        good, total = good + sum(int(a) == b for a, b in zip(keep, known, strict=True)), total + len(known)
    assert good / total > 0.99
    rng = np.random.default_rng(3)
    page = o7.Page("<a><b><i></i></b><u></u></a><s></s>")
    for _ in range(50):
        s = rng.normal(size=len(page.tags))
        best = max((sum(s[i] for i in range(1, 6) if k >> i & 1), k) for k in range(2, 64, 2) if all(not k >> i & 1 or page.parents[i] == 0 or k >> page.parents[i] & 1 for i in range(1, 6)))
        keep = page.decode(s)
        assert sum(s[i] for i in range(1, 6) if keep[i]) == pytest.approx(max(best[0], 0))


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables here")
def test_pipeline(spark):
    import corpus_pipeline as c

    from lodestone.llm import op03_packing, op05_simhash, op10_decontaminate
    from lodestone.llm.common import saved, table

    from .test_text_ops import brute_components, brute_fingerprint, brute_hits

    docs = table(spark, DIR, "documents")
    columns = docs.columns
    good = saved(c.STAGES[0][1](spark, docs, DIR), "a")
    kept = saved(c.STAGES[1][1](spark, good, DIR), "b")
    pairs = sorted((r.doc_id, r.text) for r in good.collect())
    comp = brute_components([brute_fingerprint(t) for _, t in pairs], 4)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(pairs[k][0] for k in set(comp))
    clean = saved(c.STAGES[2][1](spark, kept, DIR), "c")
    items = [(r.item_id, r.text) for r in table(spark, DIR, "benchmark").collect()][:5]
    assert not any(brute_hits(r.text, items)[4] for r in clean.collect())
    safe = saved(c.STAGES[3][1](spark, clean, DIR), "d")
    assert good.columns == kept.columns == clean.columns == safe.columns == columns and safe.count() == clean.count()
    packed = c.STAGES[4][1](spark, safe, DIR)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in safe.select("doc_id").collect()}
    assert plain_rows(c.run(spark, DIR)) == plain_rows(packed)
    assert op03_packing and op05_simhash and op10_decontaminate


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables here")
def test_pipeline_rows(spark):
    """run() from the good documents on: near copies, all benchmark items in both directions, redacted texts, pieces and crc32."""
    import re
    import zlib

    import corpus_pipeline as c

    from lodestone.llm import op03_packing as o3
    from lodestone.llm import op06_secrets as o6
    from lodestone.llm.common import saved, table
    from lodestone.llm.tokens import load, vocabulary_path

    from .test_text_ops import WORD, brute_components, brute_fingerprint

    docs = table(spark, DIR, "documents")
    predicted = {r.doc_id: r.predicted for r in o8.quality(docs, table(spark, DIR, "labels")).collect()}
    pairs = sorted((r.doc_id, r.text) for r in docs.collect() if predicted[r.doc_id])
    good = saved(c.quality_classifier(spark, docs, DIR), "rows_a")
    assert sorted((r.doc_id, r.text) for r in good.collect()) == pairs and 0 < len(pairs) < len(predicted)

    comp = brute_components([brute_fingerprint(t) for _, t in pairs], 4)
    pairs = [pairs[k] for k in sorted(set(comp))]
    kept = saved(c.simhash_near_dedup(spark, good, DIR), "rows_b")
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == pairs

    words = lambda t: WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    grams, sizes = set(), set()
    for r in table(spark, DIR, "benchmark").collect():
        v = words(r.text)
        n = min(10, len(v))
        if n and r.item_id is not None:
            sizes.add(n)
            grams |= {tuple(v[i : i + n]) for i in range(len(v) - n + 1)}
    hit = lambda w: any(tuple(w[i : i + n]) in grams for n in sizes for i in range(len(w) - n + 1))
    before, pairs = len(pairs), [(i, t) for i, t in pairs if not hit(words(t))]
    clean = saved(c.benchmark_decontamination(spark, kept, DIR), "rows_c")
    assert sorted((r.doc_id, r.text) for r in clean.collect()) == pairs and len(pairs) < before

    def redacted(t):
        spans = sorted((m.start(), k, m.end()) for k, (_, p, g, least) in enumerate(o6.BASE + o6.MORE) for m in re.finditer(p, t) if len(m[g]) >= least)
        out, close = "", 0
        for a, k, b in spans:
            if a >= close:
                out += t[close:a] + f"[{(o6.BASE + o6.MORE)[k][0]}]"
            close = max(close, b)
        return out + t[close:]

    want = {i: redacted(t) for i, t in pairs}
    safe = saved(c.secret_scans(spark, clean, DIR), "rows_d")
    assert {r.doc_id: (r.text, r.n_chars) for r in safe.collect()} == {i: (t, len(t)) for i, t in want.items()} and want != dict(pairs)

    library, pieces, stream = load(vocabulary_path(o3.VOCABULARY)), {}, []
    for r in c.run(spark, DIR).collect():
        pieces.setdefault(r.doc_id, []).append(r)
        stream.append((r.sequence_id * o3.SEQUENCE + r.offset, r.length))
        assert 0 < r.length and r.offset + r.length <= o3.SEQUENCE
    assert set(pieces) == set(want)
    for i, rows_of in pieces.items():
        ids = [*library.encode(want[i], add_special_tokens=False).ids, o3.END_ID]
        at = 0
        for r in sorted(rows_of, key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids)) and r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    stream.sort()
    assert all(a + n == b for (a, n), (b, _) in zip(stream, stream[1:])) and stream[0][0] == 0


def tables(path, docs, known, benchmark):
    for name, df in (("documents", docs), ("labels", known), ("benchmark", benchmark)):
        df.write.parquet(f"{path}/{name}.parquet")
    return f"file://{path}"


def test_pipeline_on_odd_rows(spark, tmp_path):
    """All five stages on nulls, empty and long texts, repeated rows and columns with clashing names, each against brute force."""
    import zlib

    import corpus_pipeline as c

    from lodestone.llm import op03_packing as o3
    from lodestone.llm.common import saved, table
    from lodestone.llm.tokens import load, vocabulary_path

    from .test_text_ops import brute_components, brute_fingerprint, brute_hits

    rng = random.Random(20)
    item = sentence(rng, 14)
    pairs, _, poor = classified(spark, 150)
    pairs += [(9000, f"so {item} it is"), (9001, "password: abcdefghijkl is mine"), (9002, "password: abcdefghijkl is mine"), (None, "orphan words here"), (None, None), (None, None)]
    docs = frame(spark, pairs).withColumns({"__id": o1.F.lit("x"), "fp": o1.F.lit(1.5), "n": o1.F.lit(None).cast("string"), "text_": o1.F.lit("t")})
    known = labels(spark, [p for p in pairs if p[0] is not None and p[0] < 5000], quality=lambda i, t: int(i not in poor))
    d = tables(str(tmp_path), docs, known, spark.createDataFrame([("a", item), ("b", None), (None, "one"), ("c", "...")], "item_id string, text string"))
    docs = table(spark, d, "documents")
    key = lambda df: sorted(map(str, df.select("doc_id", "text").collect()))
    stage = dict(c.STAGES)
    good = saved(stage["quality_classifier"](spark, docs, d), "a")
    want = [r for r in o8.quality(docs, known).collect() if r.predicted]
    assert sorted(str(r.doc_id) for r in good.select("doc_id").collect()) == sorted(str(r.doc_id) for r in want) and good.count() < len(pairs)
    kept = saved(stage["simhash_near_dedup"](spark, good, d), "b")
    rows_ = [(r.doc_id, r.text) for r in good.collect()]
    comp = brute_components([brute_fingerprint(t) for _, t in rows_], 4)
    least = {}
    for (i, t), g in zip(rows_, comp, strict=True):
        least[g] = min(least.get(g, (True, 0, "")), (i is None, i or 0, str(t))) if g in least else (i is None, i or 0, str(t))
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == sorted(x[:2] for x in least.values())
    clean = saved(stage["benchmark_decontamination"](spark, kept, d), "c")
    assert key(clean) == sorted(str(r) for r in kept.select("doc_id", "text").collect() if not brute_hits(r.text, [("a", item)])[4]) and clean.count() < kept.count()
    safe = saved(stage["secret_scans"](spark, clean, d), "d")
    assert safe.count() == clean.count() and any(r.text == "[assign] is mine" and r.n_chars == 16 for r in safe.collect())
    for x in (good, kept, clean, safe):
        assert x.columns == docs.columns and {(r["__id"], r.fp, r.n, r.text_) for r in x.collect()} == {("x", 1.5, None, "t")}
    library = load(vocabulary_path(o3.VOCABULARY))
    ids = lambda t: np.array([*library.encode(t or "", add_special_tokens=False).ids, o3.END_ID], "<u4")
    packed = stage["packing"](spark, safe, d).collect()
    assert sum(r.length for r in packed) == sum(len(ids(r.text)) for r in safe.collect())
    whole = {(str(r.doc_id), r.ids_crc32) for r in packed if r.length == r.doc_tokens}
    assert all((str(r.doc_id), zlib.crc32(ids(r.text).tobytes())) in whole for r in safe.collect() if len(ids(r.text)) < 100 and sum(p.doc_id == r.doc_id for p in packed) == 1)
    assert sorted((str(r.doc_id), r.length) for r in c.run(spark, d).collect()) and c.run(spark, d).columns == stage["packing"](spark, safe, d).columns


def test_pipeline_on_empty_tables(spark, tmp_path):
    import corpus_pipeline as c

    known = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    benchmark = spark.createDataFrame([], "item_id string, text string")
    d = tables(str(tmp_path / "none"), empty(spark), known, benchmark)
    with pytest.warns(UserWarning):
        assert c.run(spark, d).count() == 0
    docs = frame(spark, rows())
    for name, stage in c.STAGES:
        assert stage(spark, empty(spark), d).count() == 0, name
    with pytest.warns(UserWarning):
        assert c.quality_classifier(spark, docs, d).count() == docs.count()  # no label: all stay
    assert c.benchmark_decontamination(spark, docs, d).count() == docs.count()


def plain_rows(df):
    return sorted((r.doc_id, r.doc_tokens) for r in df.select("doc_id", "doc_tokens").distinct().collect())


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables here")
def test_oracle(spark):
    import duckdb

    from lodestone.llm import queries as q

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    for name, sql in q.ORACLES.items():
        df, want = q.QUERIES[name](spark, DIR), con.sql(sql)
        assert [str(tuple(r)) for r in sorted(df.collect())] == [str(r) for r in sorted(want.select(*df.columns).fetchall())]
