"""Main text of web pages by gradient-boosted trees over DOM nodes.

A page is parsed into elements; each gets features of its subtree (text and link density, punctuation, tags), its attribute
tokens, its depth, its siblings and its ancestors. Boosted trees score how likely an element belongs to the article. Decoding
is hierarchical: the page's labelling is the one of greatest total score in which no element is kept under one that is
dropped, found by one pass from the leaves up. The text of kept elements is joined by blocks.

A page without attribute tokens or telling tags (article, nav, aside, header, footer) is judged by its shape alone, by
trees of its own: density of text and links, place, siblings. Reader comments look like paragraphs there and stay.

The trees are trained here, on pages that training_pages() writes by rule (its elements' places are known), so no page of the
corpus is ever needed as a label; training takes a few seconds on the driver and the model is some kilobytes.

Null pages count as empty and have no text. A page without any kept text gives an empty string. Unclosed tags end where HTML
lets them end. A tag whose quotes never close ends at its first `>`, and from there on the page's quotes are not honoured; a
`<` behind the last `>` is text. Very long pages take time and memory in proportion: the parser never reads a stretch twice,
and elements are scored ELEMENTS at a time. Ties: an element whose subtree scores exactly 0 is dropped. Repeated rows give
equal results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_batches, record, slices

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea iframe noscript template xmp".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main nav ol option p pre section select summary table tbody td tfoot th thead title tr ul button".split()
)
#: What a start tag closes, and where the search for it stops.
CLOSES = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr"}), "th": ({"td", "th"}, {"tr"}), "option": ({"option"}, {"select"})}
_NO_P = {"button", "table", "td", "th", "html", "body"}
_PHRASE = frozenset("option select button legend td th tr tbody thead tfoot title head body html".split())
_OPEN = re.compile(r"<(?:(!--)|([!?])|(/?)([a-zA-Z][^\s/>]*+))")
_QUOTED = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""")
#: References to numbers beyond all characters: as long as the page, if it likes.
_HUGE = re.compile(r"&#(?:[xX]0*+[0-9a-fA-F]{7,}+|0*+[0-9]{8,}+);?")
ELEMENTS = 1 << 16
#: Training pages without any hint, for trees of their own.
BARE = 800
_ATTR = re.compile(r"""(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_TOKEN = re.compile(r"[A-Za-z][a-z]*|[A-Z]+(?![a-z])")

#: Groups of attribute tokens.
TOKENS = {
    "main": "article content main post story entry body text articlebody hentry",
    "nav": "nav menu navigation breadcrumb breadcrumbs pagination pager tabs topbar toc",
    "ad": "ad ads advert advertisement sponsor sponsored promo promotion banner adsense",
    "side": "sidebar aside related widget recommended recommendations trending rail teaser",
    "foot": "footer foot copyright legal colophon bottom",
    "head": "header masthead logo branding site top",
    "comment": "comment comments reply replies discussion respond disqus",
    "notice": "cookie cookies notice consent alert popup modal newsletter subscribe signup gdpr overlay message",
    "form": "form search login signin register contact",
    "share": "share social sharing follow tags meta byline author toolbar print",
}
_GROUP = {w: i for i, words in enumerate(TOKENS.values()) for w in words.split()}
#: Groups of tags.
TAGS = (
    "article main", "section", "div", "p", "h1 h2 h3 h4 h5 h6", "ul ol dl", "li dt dd", "nav menu", "aside", "footer", "header",
    "form input button select option label textarea fieldset legend", "script style noscript template iframe head title link meta xmp", "a",
    "b i em strong span u small sup sub code font mark abbr time cite q", "table tbody thead tfoot tr td th", "figure figcaption img picture", "blockquote pre", "html body",
)
_KIND = {t: i for i, words in enumerate(TAGS) for t in words.split()}
N_GROUPS, N_TAGS = len(TOKENS), len(TAGS)
#: Tags that say what they hold; a page without them or attribute tokens is judged by its shape alone.
_HINTS = frozenset(_KIND[t] for t in "article nav aside footer header".split())


class Page:
    """Elements in page order (0 is the root) and runs of text between block boundaries.

    An element's subtree is the run of elements from it to `last`, as they come in page order.
    """

    def __init__(self, source: str):
        self.tags, self.parents, self.groups = ["#root"], [-1], [0]
        self.above, self.depth, self.linked, self.opened = [0], [0], [False], [0]
        self.last: list[int] = [0]
        self.chunks: list[tuple[int, int, str]] = []  # element, run, text
        self.total = 0  # characters of text so far
        self.stack: list[int] = [0]
        self.places: dict[str, list[int]] = {}  # of each open name its places on the stack
        tags, stack, run, at, seek = self.tags, self.stack, 0, 0, 0
        close, quotes = source.rfind(">"), True
        while m := _OPEN.search(source, seek):
            start = m.start()
            if m[1]:
                end = source.find("-->", m.end())
                end = len(source) if end < 0 else end + 3
            elif start > close:
                break
            elif m[2]:
                end = source.find(">", m.end()) + 1
            else:
                whole = _QUOTED.match(source, m.end()) if quotes else None
                quotes = whole is not None
                end = whole.end() if whole else source.find(">", m.end()) + 1
                if not end:
                    break
            if not end:
                break
            if start > at:
                self._text(run, source[at:start])
            at = seek = end
            if m[1] or m[2]:
                continue
            name = m[4].lower()
            if m[3]:
                if name in BLOCKS:
                    run += 1
                if self.places.get(name):
                    self._pop(self.places[name][-1])
                continue
            if name == "br":
                self._text(run, " ")
                continue
            if name in BLOCKS:
                run += 1
                if name not in _PHRASE:
                    self._close({"p"}, _NO_P)
            if name in CLOSES:
                self._close(*CLOSES[name])
            attrs = source[m.end() : end - 1]
            mask = 0
            if "=" in attrs:
                for a in _ATTR.finditer(attrs):
                    for t in _TOKEN.findall(a[1] or a[2] or a[3] or ""):
                        g = _GROUP.get(t.lower())
                        if g is not None:
                            mask |= 1 << g
            parent, k = stack[-1], _KIND.get(name)
            index = len(tags)
            tags.append(name)
            self.parents.append(parent)
            self.groups.append(mask)
            self.above.append(self.above[parent] | mask | (1 << N_GROUPS + k if k is not None else 0))
            self.depth.append(len(stack))
            self.linked.append(self.linked[parent] or name == "a")
            self.opened.append(self.total)
            self.last.append(index)
            if name in VOID or attrs.endswith("/") and name not in BLOCKS:
                continue
            if name in RAW:
                found = re.compile(f"</{re.escape(name)}", re.I).search(source, at)
                end = source.find(">", found.end()) + 1 if found else 0
                at = seek = end or len(source)
                continue
            self.places.setdefault(name, []).append(len(stack))
            stack.append(index)
        if at < len(source):
            self._text(run, source[at:])
        self._pop(1)
        self.last[0] = len(tags) - 1
        del self.places, self.stack

    def _text(self, run: int, text: str) -> None:
        self.chunks.append((self.stack[-1], run, text))
        self.total += len(text)

    def _pop(self, place: int) -> None:
        """Close the elements from that place of the stack on."""
        n = len(self.tags) - 1
        while len(self.stack) > place:
            index = self.stack.pop()
            self.last[index] = n
            self.places[self.tags[index]].pop()

    def _close(self, names: set[str], stop: set[str]) -> None:
        """Close the nearest open one of `names`, if none of `stop` is nearer."""
        nearest = lambda kinds: max([p[-1] for x in kinds if (p := self.places.get(x))], default=0)
        k = nearest(names)
        if k and k > nearest(stop):
            self._pop(k)

    def measures(self) -> dict[str, np.ndarray]:
        """Counts of each element, from sums over the run of elements that is its subtree."""
        n = len(self.tags)
        own = np.zeros((5, n), np.int64)  # characters, words, marks, characters in links, chunks
        if self.chunks:
            e = np.fromiter((c[0] for c in self.chunks), np.int64, len(self.chunks))
            size = np.fromiter((len(c[2]) for c in self.chunks), np.int64, len(self.chunks))
            np.add.at(own[0], e, size)
            np.add.at(own[1], e, np.fromiter((c[2].count(" ") + 1 for c in self.chunks), np.int64, len(e)))
            np.add.at(own[2], e, np.fromiter((c[2].count(".") + c[2].count(",") for c in self.chunks), np.int64, len(e)))
            np.add.at(own[4], e, 1)
            linked = np.array(self.linked, bool)
            own[3][linked] = own[0][linked]
        sums = np.concatenate((np.zeros((5, 1), np.int64), own.cumsum(1)), axis=1)
        first, after = np.arange(n), np.array(self.last, np.int64) + 1
        chars, words, marks, linked_, chunks = sums[:, after] - sums[:, first]
        parent = np.array(self.parents, np.int64)
        kids = np.bincount(parent[1:], minlength=n)
        order = np.argsort(parent[1:], kind="stable") + 1
        index = np.zeros(n, np.int64)
        index[order] = np.arange(n - 1) - np.repeat(np.cumsum(kids) - kids, kids)
        number: dict[str, int] = {}
        name = np.array([number.setdefault(t, len(number)) for t in self.tags], np.int64)
        _, inverse, count = np.unique(parent * len(number) + name, return_inverse=True, return_counts=True)
        same = count[inverse]
        same[0] = 0
        kind = np.array([_KIND.get(t, N_TAGS) for t in number], np.int64)[name]
        hinted = any(self.groups) or any(_KIND.get(t) in _HINTS for t in number)
        return {
            "chars": chars, "words": words, "marks": marks, "linked": linked_, "inner": after - first - 1, "own": own[0], "depth": np.array(self.depth, np.int64), "kids": kids, "index": index,
            "before": np.where(chunks > 0, np.array(self.opened, np.int64), -1), "above": np.array(self.above, np.int64), "groups": np.array(self.groups, np.int64), "parent": np.maximum(parent, 0), "same": same, "kind": kind, "hinted": hinted,
        }

    def features(self, m: dict[str, np.ndarray] | None = None, a: int = 0, b: int | None = None) -> np.ndarray:
        """Features of the elements from a to b."""
        m = m or self.measures()
        at = slice(a, b)
        chars, words, marks, linked, inner, own, depth, kids, index, before, groups, up, same, kind = (m[k][at] for k in ("chars", "words", "marks", "linked", "inner", "own", "depth", "kids", "index", "before", "groups", "parent", "same", "kind"))
        tot = max(self.total, 1)
        kids_up, above = m["kids"][up], m["above"][up]
        cols = [
            np.log1p(chars), np.log1p(own), chars / tot, linked / np.maximum(chars, 1), np.log1p(chars / (inner + 1)), marks / np.maximum(words, 1), chars / np.maximum(words, 1),
            depth, np.log1p(kids), np.log1p(kids_up), index / np.maximum(kids_up, 1), same, before / tot, chars / np.maximum(m["chars"][up], 1),
        ]
        cols += [kind == k for k in range(N_TAGS)]
        cols += [groups >> k & 1 for k in range(N_GROUPS)]
        cols += [above >> k & 1 for k in range(N_GROUPS + N_TAGS)]
        cols.append(np.full(len(chars), m["hinted"]))
        return np.array([np.asarray(c, np.float32) for c in cols]).T

    def decode(self, scores: np.ndarray) -> np.ndarray:
        """Which elements are kept: the labelling of greatest total score with no kept element under a dropped one."""
        n = len(self.tags)
        best = scores.astype(float).tolist()
        for i in range(n - 1, 0, -1):
            if best[i] > 0:
                best[self.parents[i]] += best[i]
        keep = [True] * n
        for i in range(1, n):
            keep[i] = keep[self.parents[i]] and best[i] > 0
        return np.array(keep)

    def text(self, keep: np.ndarray) -> str:
        out: list[str] = []
        held: list[str] = []
        run = -1
        joined = lambda: " ".join(entities.unescape(_HUGE.sub("\ufffd", "".join(held))).split())
        for e, r, text in self.chunks:
            if r != run:
                if held:
                    out.append(joined())
                held, run = [], r
            if keep[e]:
                held.append(text)
        if held:
            out.append(joined())
        return "\n".join(x for x in out if x)


class Trees:
    """Gradient-boosted regression trees of one depth for a logistic loss, over features cut at quantiles."""

    def __init__(self, depth: int = 3, rounds: int = 60, rate: float = 0.3, bins: int = 24):
        self.depth, self.rounds, self.rate, self.bins = depth, rounds, rate, bins

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        n, m = x.shape
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(m)]
        cuts = [np.unique((np.concatenate((c, np.unique(x[:, j])[:2])))) for j, c in enumerate(cuts)]
        codes = np.stack([np.searchsorted(cuts[j], x[:, j], "left") for j in range(m)], 1)
        width = max(map(len, cuts)) + 1
        self.base = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
        f = np.full(n, self.base)
        nodes = (1 << self.depth) - 1
        self.split = np.zeros((self.rounds, nodes), np.int64)
        self.cut = np.full((self.rounds, nodes), np.inf, np.float32)
        self.leaf = np.zeros((self.rounds, nodes + 1))
        flat = codes + np.arange(m) * width
        for t in range(self.rounds):
            p = 1 / (1 + np.exp(-f))
            g, h = y - p, p * (1 - p)
            node = np.zeros(n, np.int64)
            for level in range(self.depth):
                k = 1 << level
                key = (node[:, None] * (m * width) + flat).ravel()
                sums = [np.bincount(key, np.repeat(v, m), k * m * width).reshape(k, m, width).cumsum(2) for v in (g, h)]
                (gl, hl), (gt, ht) = sums, (s[:, :, -1:] for s in sums)
                gain = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1)
                best = gain.reshape(k, -1).argmax(1)
                j, c = best // width, best % width
                for q in range(k):
                    at = k - 1 + q
                    self.split[t, at] = j[q]
                    self.cut[t, at] = cuts[j[q]][c[q]] if c[q] < len(cuts[j[q]]) else np.inf
                node = 2 * node + (codes[np.arange(n), j[node]] > c[node])
            top = np.bincount(node, g, nodes + 1) / (np.bincount(node, h, nodes + 1) + 1)
            self.leaf[t] = self.rate * top
            f += self.leaf[t][node]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        """Each tree's value from its leaves up, every node on its feature's whole column."""
        x, out = np.asfortranarray(x), np.full(len(x), self.base)
        for split, cut, leaf in zip(self.split.tolist(), self.cut, self.leaf, strict=True):
            values = list(leaf)
            for k in range(len(split) - 1, -1, -1):
                left, right = values[-2:]
                values[-2:] = []
                values.insert(0, np.where(x[:, split[k]] > cut[k], right, left))
            out += values[0]
        return out


def training_pages(n: int = 500, seed: int = 7, bare: int = 0) -> Iterator[str]:
    """Pages written by rule, n with hints and `bare` without. Elements of the article (and all around them) carry data-k=1, all others data-k=0."""
    rng = random.Random(seed)
    syllables = "an the or in be lo mi ra tu sen da kor vel os ti un ach ver ció eau ñe ö ü é".split()

    def words(a, b):
        return " ".join("".join(rng.choices(syllables, k=rng.randint(1, 4))) + rng.choice(["", "", "", "", "", ",", "."]) for _ in range(rng.randint(a, b)))

    def mark(tag, good, inner, attrs="", close=True):
        return f"<{tag} data-k={int(good)}{' ' + attrs if attrs else ''}>{inner}" + (f"</{tag}>" if close else "")

    def named(group):
        t = rng.choice(TOKENS[group].split())
        return rng.choice([f'class="{t}"', f'id="{t}"', f'class="{rng.choice(["c", "box", "js"])}-{t} x{rng.randint(1, 9)}"', f'class="{t}-{rng.choice(["wrap", "inner", "block"])}"'])

    def linklist(k):
        items = "".join(mark("li", 0, mark("a", 0, words(1, 3), f'href="/{i}"'), close=rng.random() > 0.2) for i in range(k))
        return mark(rng.choice(["ul", "ol"]), 0, items)

    def junk(tag_or_group, long=False):
        text = words(15, 60) if long else words(2, 20)
        inner = rng.choice([text, mark("p", 0, text), mark("div", 0, text), mark("h3", 0, words(1, 3)) + mark("p", 0, text), linklist(rng.randint(2, 6))])
        if tag_or_group in ("nav", "aside", "footer", "header", "form"):
            if tag_or_group == "nav" and rng.random() < 0.8:
                inner = linklist(rng.randint(3, 9))
            if tag_or_group == "form":
                inner = mark("label", 0, words(1, 3)) + "<input data-k=0 type=text>" + mark("button", 0, words(1, 2)) + (mark("p", 0, text) if rng.random() < 0.4 else "")
            group = {"nav": "nav", "aside": "side", "footer": "foot", "header": "head", "form": "form"}[tag_or_group]
            return mark(tag_or_group, 0, inner, named(group) if rng.random() < 0.4 else "")
        return mark(rng.choice(["div", "div", "section", "aside", "ul"] if tag_or_group != "comment" else ["div", "section", "ol"]), 0, inner, named(tag_or_group))

    def comments():
        kind = rng.choice(["div", "li", "article"])
        one = lambda: mark(kind, 0, mark("p", 0, words(5, 50)) if rng.random() < 0.7 else words(5, 40), rng.choice(['class="comment"', 'class="comment-body"', 'class="reply"']))
        return mark(rng.choice(["section", "div", "ol"]), 0, mark("h3", 0, words(1, 3)) + "".join(one() for _ in range(rng.randint(1, 4))), named("comment"))

    def paragraph():
        text = words(1, 90) if rng.random() < 0.8 else words(1, 4)
        r = rng.random()
        if r < 0.15:
            text = words(2, 20) + " " + mark("a", 1, words(1, 4), 'href="/x"') + " " + text
        elif r < 0.3:
            text = mark(rng.choice(["b", "em", "span", "strong"]), 1, words(1, 12)) + " " + text
        elif r < 0.38:
            return mark("p", 1, mark("b", 1, text + "<br data-k=1>", close=False), close=False)
        return mark("p", 1, text, close=rng.random() > 0.15)

    def article():
        parts = [mark("h1", 1, words(2, 9))] if rng.random() < 0.8 else []
        for _ in range(rng.randint(1, 9)):
            r = rng.random()
            if r < 0.72:
                parts.append(paragraph())
            elif r < 0.8:
                parts.append(mark(rng.choice(["h2", "h3"]), 1, words(1, 7)))
            elif r < 0.86:
                parts.append(mark(rng.choice(["ul", "ol"]), 1, "".join(mark("li", 1, words(3, 20), close=rng.random() > 0.2) for _ in range(rng.randint(2, 5)))))
            elif r < 0.9:
                parts.append(mark("blockquote", 1, rng.choice([words(5, 30), mark("p", 1, words(5, 30))])))
            elif r < 0.93:
                parts.append(mark("table", 1, "".join(mark("tr", 1, "".join(mark("td", 1, words(1, 4)) for _ in range(3))) for _ in range(2))))
            elif r < 0.96:
                parts.append(mark("div", 1, paragraph() + paragraph()))
            else:
                parts.append(mark("pre", 1, words(5, 20)))
        for kind in ("ad", "share", "notice", "side", "form", "aside"):
            if rng.random() < 0.15:
                parts.insert(rng.randint(0, len(parts)), junk(kind, rng.random() < 0.3))
        if rng.random() < 0.2:
            parts.append(comments())
        if rng.random() < 0.1:
            parts.insert(0, mark("header", 0, words(2, 6)))
        if rng.random() < 0.1:
            parts.append(mark("footer", 0, words(2, 12)))
        inner = "".join(parts)
        r = rng.random()
        if r < 0.6:
            inner = mark("article", 1, inner, named("main") if rng.random() < 0.3 else "")
        elif r < 0.75:
            inner = mark("main", 1, inner)
        else:
            inner = mark(rng.choice(["div", "section"]), 1, inner, named("main"))
        for _ in range(rng.randint(0, 2)):
            if rng.random() < 0.5:
                inner = mark(rng.choice(["div", "main", "section"]), 1, inner, rng.choice(["", named("main"), 'class="wrap"', 'class="row"']))
        return inner

    def links(k):
        between = rng.choice([" ", " | ", "<br data-k=0>", " &middot; "])
        return between.join(mark("a", 0, words(1, 3), f'href="/{i}"') for i in range(k))

    def menu():
        inner = rng.choice([links, linklist])(rng.randint(2, 9))
        return rng.choice([inner, mark("div", 0, inner), mark("p", 0, inner)]) if inner.startswith("<ul") or inner.startswith("<ol") else mark(rng.choice(["div", "p", "center"]), 0, inner)

    def plain_article():
        tag = rng.choice(["p", "p", "p", "div"])
        parts = [mark(rng.choice(["h1", "h1", "h2"]), 1, words(2, 9))] if rng.random() < 0.9 else []
        for _ in range(rng.randint(2, 9)):
            r = rng.random()
            if r < 0.7:
                parts.append(paragraph() if tag == "p" else mark("div", 1, words(4, 80)))
            elif r < 0.82:
                parts.append(mark(rng.choice(["h2", "h3"]), 1, words(1, 7)))
            elif r < 0.92:
                parts.append(mark(rng.choice(["ul", "ol"]), 1, "".join(mark("li", 1, words(3, 16)) for _ in range(rng.randint(2, 5)))))
            else:
                parts.append(mark("blockquote", 1, words(5, 30)))
        if rng.random() < 0.4:  # the heading stands over a box of all else
            first = parts.pop(0) if len(parts) > 1 else ""
            parts = [first, mark("div", 1, "".join(parts))]
        return "".join(parts)

    def related():
        head = mark(rng.choice(["h3", "h4", "b"]), 0, words(1, 3))
        return mark("div", 0, head + rng.choice([linklist, links])(rng.randint(2, 6)))

    def bare_page():
        """No class, id or sectioning tag: a menu, the article in a box, a table cell or the body itself, links and small print."""
        before = [x() for x in (lambda: mark(rng.choice(["div", "center"]), 0, words(1, 6)), menu, menu) if rng.random() < 0.6]
        after = [x() for x in (related, menu) if rng.random() < 0.4]
        small = words(2, 9) + rng.choice(["", " " + links(rng.randint(1, 3))])
        if rng.random() < 0.85:
            after.append(mark("div", 0, rng.choice([small, mark("p", 0, small)])))
        inner, r = plain_article(), rng.random()
        if r < 0.35:
            inner = mark("div", 1, inner)
        elif r < 0.6:
            cell = inner if rng.random() < 0.5 else mark("div", 1, inner)
            cells = [mark("td", 0, rng.choice([links, linklist])(rng.randint(2, 8))), mark("td", 1, cell)]
            if rng.random() < 0.3:
                rng.shuffle(cells)
            inner = mark("table", 1, mark("tr", 1, "".join(cells)))
        inner = "".join([*before, inner, *after])
        for _ in range(rng.randint(0, 2)):
            if rng.random() < 0.4:
                inner = mark("div", 1, inner)
        return f"<html data-k=1>{mark('head', 0, mark('title', 0, words(2, 8)))}<body data-k=1>{inner}</body></html>"

    for i in range(n + bare):
        if i >= n:
            yield bare_page()
            continue
        before = [junk(k) for k in ("header", "nav", "ad", "notice", "form", "side", "nav") if rng.random() < 0.4]
        after = [junk(k, rng.random() < 0.5) for k in ("aside", "ad", "side", "share", "form", "notice") if rng.random() < 0.3]
        if rng.random() < 0.3:
            after.insert(0, comments())
        foot = [junk("footer", rng.random() < 0.4) if rng.random() < 0.7 else mark("div", 0, words(3, 25), named("foot"))] if rng.random() < 0.85 else []
        head = mark("head", 0, mark("title", 0, words(2, 8)) + "<script data-k=0>var a='<p>';</script><style data-k=0>p{}</style>")
        rng.shuffle(before)
        yield f"<!DOCTYPE html><html data-k=1>{head}<body data-k=1>{''.join([*before, article(), *after, *foot])}</body></html>"


_KNOWN = re.compile(r"<([a-zA-Z][^\s/>]*) data-k=([01])")


class Models:
    """Trees for pages with hints and trees for those without; the last feature tells which."""

    def __init__(self, hinted: Trees, bare: Trees):
        self.hinted, self.bare = hinted, bare

    def score(self, x: np.ndarray) -> np.ndarray:
        hinted, x = x[:, -1] > 0, x[:, :-1]
        if hinted.all():
            return self.hinted.score(x)
        out = np.empty(len(x))
        out[hinted], out[~hinted] = self.hinted.score(x[hinted]), self.bare.score(x[~hinted])
        return out


def _fitted(pages: Iterator[str]) -> Trees:
    xs, ys = [], []
    for source in pages:
        known = [int(m[2]) for m in _KNOWN.finditer(source) if m[1] != "br"]
        page = Page(source)
        if len(page.tags) != len(known) + 1:
            raise AssertionError("the parser and the writer differ")
        xs.append(page.features()[1:, :-1])
        ys.append(known)
    return Trees().fit(np.concatenate(xs), np.concatenate(ys).astype(float))


@lru_cache(maxsize=1)
def trained() -> Models:
    return Models(_fitted(training_pages()), _fitted(training_pages(0, bare=BARE)))


def extract_all(sources: list[str | None], model: Models) -> list[str]:
    """The text of each page; pages are scored together until they have ELEMENTS elements, a larger one in parts."""
    out: list[str] = []
    held: list[tuple[Page, dict]] = []
    size = 0

    def flush() -> None:
        nonlocal size
        if len(held) == 1 and size > ELEMENTS:
            page, m = held[0]
            scores = np.concatenate([model.score(page.features(m, a, a + ELEMENTS)) for a in range(0, size, ELEMENTS)])
        else:
            scores = model.score(np.concatenate([p.features(m) for p, m in held]))
        at = 0
        for page, _ in held:
            out.append(page.text(page.decode(scores[at : at + len(page.tags)])))
            at += len(page.tags)
        held.clear()
        size = 0

    for s in sources:
        page = Page(s or "")
        if held and size + len(page.tags) > ELEMENTS:
            flush()
        held.append((page, page.measures()))
        size += len(page.tags)
    if held:
        flush()
    return out


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each page."""
    model = pages.sparkSession.sparkContext.broadcast(trained())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "html"):
            texts = extract_all(part.column("html").to_pylist(), model.value)
            yield record(page_id=part.column("page_id"), url=part.column("url"), text=pa.array(texts, pa.string()), n_chars=pa.array([len(t) for t in texts], pa.int64()))

    return map_batches(pages.select("page_id", "url", "html"), work, "page_id long, url string, text string, n_chars long")
