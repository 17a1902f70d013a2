"""Secret scans through a trigram index.

Each rule's regular expression gives a Boolean query over trigrams that any match must hold. A task indexes its slice of
texts (lower-cased ASCII) by the trigrams that some rule asks for, combines the postings as each query says, and runs the
regular expression only on the candidates. A rule that has no mandatory trigram scans every text of the slice.

The three base kinds come first; further kinds add spans and change none of the base ones. Positions are code points, the end
excluded. Very long texts are scanned whole, in time in proportion to their length. Null texts count as empty. Rows are
independent: repeated rows and ids give repeated results, an empty table an empty one; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from re import _constants as C
from re import _parser as P

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import flat, map_batches, record, slices

#: kind, pattern, group whose length counts, least length.
BASE = (
    ("assign", r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]+", 0, 16),
)
#: A private key: from its BEGIN line through the END line, if no other marker comes first; else its headers and base64 lines
#: (whole lines; where line ends were lost, runs of 40 characters on and a rest with a digit). Line ends may be escaped.
_NL = r"(?:[^\S\r\n]*(?:\r\n?|\n|(?:\\r)?\\n|\\r))"
_STOP = r"(?=\s|\\[rn]|\Z)"
_LINE = r"[^\S\r\n]*[A-Za-z0-9+/=]++(?=[^\S\r\n]*(?:[\r\n]|\\[rn]|\Z))"
_RUN = r"(?:\s|\\[rn])*+[A-Za-z0-9+/=]{40,}+"
_REST = rf"[^\S\r\n]++(?=[A-Za-z]*[0-9+/=])[A-Za-z0-9+/=]++{_STOP}"
_LABEL = r"[A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----"
_KEY = (
    rf"-----BEGIN {_LABEL}(?:(?:[^-]++|-(?!----(?:BEGIN|END) ))*+-----END {_LABEL}"
    rf"|(?:{_NL}++[^\S\r\n]*[A-Z][A-Za-z0-9-]*+:\x20[^\r\n\\]*+)*+(?:{_RUN}|{_NL}++{_LINE})(?:{_RUN}|{_NL}{_LINE}|{_REST})*+)?+"
)
#: A scheme is read once, from its first character on; behind other characters of its class, from 21 characters before its end.
_LOGIN = r"(?:(?<![a-z0-9+.-])[a-z][a-z0-9+.-]++|[a-z][a-z0-9+.-]{1,20})://[^\s/:@]++:[^\s/@]++@"
MORE = (
    ("private_key", _KEY, 0, 1),
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 1),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 1),
    ("google", r"AIza[A-Za-z0-9_-]{35}", 0, 1),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1),
    ("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}", 0, 1),
    ("url_login", _LOGIN, 0, 1),
)
#: Strings that an exact set may hold before it is turned into a query, and characters that a class may.
SET, CLASS = 32, 8

#: A query: True (any text), ("tri", trigram), ("and", ...) or ("or", ...).
Query = bool | tuple


def both(*parts: Query) -> Query:
    kept = tuple(dict.fromkeys(x for x in parts if x is not True))
    return True if not kept else kept[0] if len(kept) == 1 else ("and", *kept)


def either(*parts: Query) -> Query:
    kept = tuple(dict.fromkeys(parts))
    return True if True in kept else kept[0] if len(kept) == 1 else ("or", *kept)


def of_strings(strings: set[str]) -> Query:
    return either(*(both(*(("tri", s[i : i + 3]) for i in range(len(s) - 2))) for s in sorted(strings)))


def _chars(op, arg) -> set[str] | None:
    """The lower-cased ASCII characters that one item matches, if they are few."""
    if op is C.LITERAL:
        return {chr(arg).lower()} if arg < 128 else None
    if op is C.IN:
        out: set[str] = set()
        for kind, x in arg:
            if kind is C.LITERAL and x < 128:
                out.add(chr(x).lower())
            elif kind is C.RANGE and x[1] < 128 and x[1] - x[0] < CLASS:
                out |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
            else:
                return None
        return out if len(out) <= CLASS else None
    return None


def analyse(items) -> tuple[set[str] | None, Query]:
    """All strings that the items match if they are few (else None), and what any match must hold besides."""
    exact: set[str] | None = {""}
    query: Query = True
    tails: set[str] | None = {""}  # what the text reads up to here, since the last unknown part
    for op, arg in items:
        chars = _chars(op, arg)
        if chars is not None:
            part, more = chars, True
        elif op is C.SUBPATTERN:
            part, more = analyse(arg[3])
        elif op is C.BRANCH:
            sides = [analyse(x) for x in arg[1]]
            part = None if any(s[0] is None for s in sides) else set().union(*(s[0] for s in sides))
            more = True if part is not None else either(*(both(s[1], of_strings(s[0]) if s[0] is not None else True) for s in sides))
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
            low, high, body = arg
            part, more = analyse(body)
            if part is not None and low == 0 and high == 1:
                part, more = part | {""}, True
            elif part is not None and low == high and len(part) == 1 and low <= 16:
                part = {next(iter(part)) * low}
            elif low:
                more = both(more, of_strings(part) if part is not None else True)
                part = None
            else:
                part, more = None, True
        elif op is C.AT:
            part, more = {""}, True
        else:
            part, more = None, True
        query = both(query, more)
        joined = {a + b for a in tails for b in part} if part is not None else None
        if joined is None or len(joined) > SET:
            query = both(query, of_strings(tails))
            exact = None
            tails = part if part is not None and len(part) <= SET else {""}
        else:
            tails = joined
    if exact is not None:
        return tails, query
    return None, both(query, of_strings(tails))


def trigram_query(pattern: str) -> Query:
    exact, query = analyse(P.parse(pattern))
    return both(query, of_strings(exact)) if exact is not None else query


def trigrams(query: Query) -> set[str]:
    return set() if query is True else {query[1]} if query[0] == "tri" else set().union(*map(trigrams, query[1:]))


_LOW = np.arange(256, dtype=np.int32)
_LOW[65:91] += 32


class TrigramIndex:
    """Postings (a Boolean row for each wanted trigram) of a slice of texts."""

    def __init__(self, wanted: list[str]):
        self.wanted = {t: i for i, t in enumerate(wanted)}
        self.row = np.full(1 << 24, -1, np.int16)
        for t, i in self.wanted.items():
            a, b, c = t.encode("latin-1")
            self.row[a << 16 | b << 8 | c] = i

    def fill(self, texts: pa.Array) -> None:
        data, offsets = flat(texts)
        low = _LOW[data]
        code = self.row[low[:-2] << 16 | low[1:-1] << 8 | low[2:]] if len(low) > 2 else np.zeros(0, np.int16)
        at = np.flatnonzero(code >= 0)
        self.n = len(offsets) - 1
        # A trigram across two texts only adds a candidate.
        self.has = np.zeros((len(self.wanted), self.n), bool)
        self.has[code[at], np.searchsorted(offsets[1:], at, "right")] = True

    def candidates(self, query: Query) -> np.ndarray:
        if query is True:
            return np.ones(self.n, bool)
        if query[0] == "tri":
            return self.has[self.wanted[query[1]]]
        return (np.logical_and if query[0] == "and" else np.logical_or).reduce([self.candidates(x) for x in query[1:]])


class Scanner:
    def __init__(self, rules=BASE + MORE):
        self.rules = [(kind, re.compile(p), group, least, trigram_query(p)) for kind, p, group, least in rules]
        self.index = TrigramIndex(sorted(set().union(*(trigrams(r[4]) for r in self.rules))))

    def __call__(self, texts: pa.Array) -> list[list[tuple[int, int, int]]]:
        """For each text its spans (start, rule, end), sorted."""
        self.index.fill(texts)
        strings = texts.to_pylist()
        out: list[list[tuple[int, int, int]]] = [[] for _ in strings]
        for k, (_, pattern, group, least, query) in enumerate(self.rules):
            for i in np.flatnonzero(self.index.candidates(query)).tolist():
                for m in pattern.finditer(strings[i] or ""):
                    if m.end(group) - m.start(group) >= least:
                        out[i].append((m.start(), k, m.end()))
        for x in out:
            x.sort()
        return out


def scan(docs: DataFrame, emit: Callable, schema: str, rules=BASE + MORE) -> DataFrame:
    """Run the scanner over docs; emit(part, spans, kinds) makes a batch from a slice and its texts' spans."""
    kinds = [r[0] for r in rules]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for part in slices(batches, "text"):
            yield emit(part, scanner(part.column("text")), kinds)

    return map_batches(docs, work, schema)


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of each document."""

    def emit(part, found, kinds):
        n = np.array([np.bincount([k for _, k, _ in x], minlength=len(kinds))[:3] if x else (0, 0, 0) for x in found], np.int64).reshape(-1, 3)
        said = [[f"{kinds[k]}:{a}:{b}" for a, k, b in x] for x in found]
        base = [",".join(t for t, (_, k, _) in zip(s, x, strict=True) if k < len(BASE)) for s, x in zip(said, found, strict=True)]
        return record(doc_id=part.column("doc_id"), n_assign=n[:, 0], n_access=n[:, 1], n_hex=n[:, 2], base_sha256=[hashlib.sha256(x.encode()).hexdigest() for x in base], spans=[",".join(x) for x in said])

    return scan(docs.select("doc_id", "text"), emit, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(docs: DataFrame, text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """docs with each span replaced by [kind] (overlapping spans by the first's), and n_chars counted anew where it is a column."""
    columns = docs.columns

    def emit(part, found, kinds):
        texts = []
        for old, spans in zip(part.column(text).to_pylist(), found, strict=True):
            if spans:
                bits, at, close = [], 0, 0
                for a, k, b in spans:
                    if a >= close:
                        bits += [old[at:a], f"[{kinds[k]}]"]
                    at = close = max(close, b)
                old = "".join([*bits, old[at:]])
            texts.append(old)
        out = {c: part.column(c) for c in columns}
        out[text] = pa.array(texts, pa.string())
        if n_chars in out:
            changed = np.array([bool(x) for x in found])
            length = [len(t) if c else o for t, c, o in zip(texts, changed, out[n_chars].to_pylist(), strict=True)]
            out[n_chars] = pa.array(length, out[n_chars].type)
        return pa.RecordBatch.from_arrays([out[c] for c in columns], names=columns)

    return scan(docs, emit, docs.schema)
