"""Exact token counts by prefix dynamic programming.

In byte-pair encoding, the encoding of a word's prefix is the encoding of a shorter prefix and one more token, and that
token is the only one that ends there and that the merge order lets stand after the shorter prefix's last token. So one pass
over a word stores, for each of its prefixes, the last token and the exact number of tokens; budget and truncation questions
are then lookups. Word-end vocabularies mark a word's last symbol, so the count for a cut inside a word closes the stored
prefix with one token that carries the mark.

A text's table (`PrefixTable`) holds the exact count at the end of each of its pieces (runs without a space or line feed), each
distinct piece being solved once; a cut inside a piece is answered by that piece's own prefix counts. The query reads the count
(the table's last entry), whether it is over the limit, and where the text would have to be cut (`fits_chars`, code points of
the longest prefix within the limit) from the same table; `prefix_counts` gives all prefixes of a text, `within` a budget's cut.

Only byte-level word-end vocabularies of the tokenizers library are taken; others raise ValueError. Special tokens' strings
count as the library's default counts them. Null texts count as empty (0 tokens). Very long texts, with or without white space,
take time in proportion to their length. Rows are independent: repeated rows and ids give repeated results, an empty table an
empty one; other columns are ignored.
"""

from __future__ import annotations

import json
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from .common import MEMOS, map_batches, record, slices
from .tokens import TOKEN_SLICE, Memo, byte_symbols, load, vocabulary_path

VOCABULARY, LIMIT = "word_bpe_49k.json", 2048
MARK = "</w>"
#: White space as the vocabulary's patterns have it (Unicode's property), inside a character class.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PAIR_MEMO, PIECE_MEMO = 2_000_000, 100_000
#: Characters of a word that are solved again rather than gone on from: more than any contraction has.
SHORT = 8


class PrefixCounter:
    """Counts for a word-end BPE vocabulary file of the tokenizers library."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        self.library = load(path)
        self.vocab: dict[str, int] = spec["model"]["vocab"]
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}  # token: left, right, rank
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            left, right, whole = self.vocab[a], self.vocab[b], self.vocab[a + b]
            self.rank[left, right] = rank
            self.parts.setdefault(whole, (left, right, rank))
        self.longest = max(map(len, self.vocab))
        # By its last two symbols, how long a token can be: inside a word, and at its end.
        self.reach: dict[str, int] = {}
        self.reach_closed: dict[str, int] = {}
        for token in self.vocab:
            self.reach[token[-2:]] = max(len(token), self.reach.get(token[-2:], 1))
            if token.endswith(MARK):
                body = token[: -len(MARK)]
                self.reach_closed[body[-2:]] = max(len(body), self.reach_closed.get(body[-2:], 1))
        special = sorted((x["content"] for x in spec["added_tokens"]), key=len, reverse=True)
        odd = any(x["lstrip"] or x["rstrip"] or x["single_word"] or x["normalized"] or regex.search(r"\s", x["content"]) for x in spec["added_tokens"])
        if spec["model"].get("end_of_word_suffix") != MARK or odd:
            raise ValueError(f"{path}: not a word-end vocabulary with plain special tokens")
        self.special = regex.compile("|".join(map(regex.escape, special)) or r"(?!)")
        self.heads = {x[0] for x in special}
        split = next(x for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        self.words = regex.compile(split["pattern"]["Regex"].replace(r"\s", SPACE))
        self.spaces = regex.compile(f"[{SPACE}]+")
        self.symbols = byte_symbols()
        self.pairs: dict[tuple[int, int], bool] = {}
        self.memo = Memo()

    def stands(self, a: int, b: int) -> bool:
        """Whether the encoding of a's and b's text keeps them apart, as a and b.

        Undo the later of the two tokens' merges step by step; the pair falls if, at some step, the tokens that face each
        other could merge before the merge that hid them.
        """
        key = (a, b)
        known = self.pairs.get(key)
        if known is not None:
            return known
        rank, parts = self.rank, self.parts
        top = len(rank) + 1
        bound, out, held_a, held_b = top, True, top, top
        while True:
            r = rank.get((a, b))
            # The facing pair merges at r: before the last token undone, whose own merge came at bound.
            if r is not None and r < bound:
                out = False
                break
            pa_, pb = parts.get(a), parts.get(b)
            ra = pa_[2] if pa_ and pa_[2] < held_a else -1
            rb = pb[2] if pb and pb[2] < held_b else -1
            if ra < 0 and rb < 0:
                break
            # Of equal ranks the left place merges first, so the right one is the later.
            if ra > rb:
                a, bound = pa_[1], ra
                held_a = ra
            else:
                # A pair of the same rank that starts further left goes first.
                b, bound = pb[0], rb + 1
                held_b = rb
        if len(self.pairs) >= PAIR_MEMO:
            self.pairs.clear()
        self.pairs[key] = out
        return out

    def prefixes(self, symbols: str, last: list[int] | None = None, count: list[int] | None = None) -> tuple[list[int], list[int]]:
        """For each prefix of the symbols without a word end: its last token and its count; index 0 is the empty prefix.

        Given those of a shorter prefix, goes on from there, in place.
        """
        vocab, stands, reach = self.vocab, self.stands, self.reach
        if last is None or count is None:
            last, count = [-1], [0]
        for end in range(len(last), len(symbols) + 1):
            for start in range(max(0, end - reach.get(symbols[max(0, end - 2) : end], 1)), end):
                token = vocab.get(symbols[start:end])
                if token is not None and (start == 0 or stands(last[start], token)):
                    last.append(token)
                    count.append(count[start] + 1)
                    break
        return last, count

    def closed(self, symbols: str, last: list[int], count: list[int], end: int) -> int:
        """Tokens of the prefix up to end, as a whole word."""
        for start in range(max(0, end - self.reach_closed.get(symbols[max(0, end - 2) : end], 1)), end):
            token = self.vocab.get(symbols[start:end] + MARK)
            if token is not None and (start == 0 or self.stands(last[start], token)):
                return count[start] + 1
        raise AssertionError("a byte-level vocabulary covers every word")

    def word_symbols(self, word: str) -> str:
        return "".join([self.symbols[b] for b in word.encode("utf-8", "surrogatepass")])

    def normal(self, piece: str) -> str:
        if piece.isascii():
            return piece.lower()
        return "".join([c.lower() for c in unicodedata.normalize("NFC", piece)])

    def of_piece(self, piece: str) -> int:
        """Tokens of a text that holds no white space."""
        if any(x in piece for x in self.heads) and self.special.search(piece):
            parts = self.special.split(piece)
            return len(parts) - 1 + sum(map(self.of_plain, parts))
        return self.of_plain(piece)

    def of_plain(self, piece: str) -> int:
        """Tokens of a piece without special strings."""
        return self.of_words(self.normal(piece))

    def of_words(self, low: str) -> int:
        """Tokens of a normalised piece."""
        total = 0
        for word in self.words.findall(low):
            n = self.memo.get(word)
            if n is None:
                symbols = self.word_symbols(word)
                last, count = self.prefixes(symbols[:-1])
                n = self.closed(symbols, last, count, len(symbols))
                self.memo.put(word, n)
            total += n
        return total

    def prefix_counts(self, text: str) -> np.ndarray:
        """Exact tokens of text[:i] for each i from 0 to its length, each different piece being solved once for all its prefixes."""
        out, done, at = [], 0, 0
        solved: dict[str, list[int]] = {}
        for m in regex.finditer(f"[^{SPACE}]+", text):
            out += [done] * (m.start() + 1 - at)
            piece = m.group()
            part = solved.get(piece)
            if part is None:
                part = self.prefixes_of_piece(piece)
                if len(solved) < PIECE_MEMO:
                    solved[piece] = part
            out += [done + x for x in part[1:]]
            done, at = done + part[-1], m.end() + 1
        out += [done] * (len(text) + 1 - at)
        return np.array(out, np.int64)

    def prefixes_of_piece(self, piece: str) -> list[int]:
        """prefix_counts of a text that holds no white space."""
        if not any(x in piece for x in self.heads) or not self.special.search(piece):
            return self.prefixes_of_plain(piece)
        # A cut inside a special string leaves plain characters that go on the plain text before it.
        out, done, at = [0], 0, 0
        for m in self.special.finditer(piece):
            part = self.prefixes_of_plain(piece[at : m.end() - 1])
            out += [done + x for x in part[1:]]
            done += part[m.start() - at] + 1
            out.append(done)
            at = m.end()
        return out + [done + x for x in self.prefixes_of_plain(piece[at:])[1:]]

    def prefixes_of_plain(self, piece: str) -> list[int]:
        """prefix_counts of a text that holds no white space and no special string.

        Normalisation works on stretches: a character and what composes with it. A prefix that ends between two stretches is
        a prefix of the normalised text, so the words' stored prefixes answer it. One that ends inside a stretch differs in
        that stretch alone: the word before it goes on from its stored prefixes, or a short one is solved again.
        """
        out = [0] * (len(piece) + 1)
        cuts = stretches(piece)
        lower = [self.normal(piece[a:b]) for a, b in zip(cuts, cuts[1:])]
        low = "".join(lower)
        start = list(accumulate(map(len, lower), initial=0))  # of each stretch in low
        wide = [k for k in range(1, len(cuts)) if cuts[k] - cuts[k - 1] > 1]
        if wide and wide[0] == 1:
            for i in range(1, cuts[1]):
                out[i] = self.of_plain(piece[:i])
            wide = wide[1:]
        wide.reverse()
        done, k, apostrophe = 0, 1, False
        for m in self.words.finditer(low):
            a, b = m.span()
            symbols = self.word_symbols(low[a:b])
            last, count = self.prefixes(symbols)
            plain = len(symbols) == b - a
            size = range(b - a + 1) if plain else list(accumulate((len(c.encode("utf-8", "surrogatepass")) for c in low[a:b]), initial=0))
            # A prefix of a contraction is an apostrophe and letters, words of their own.
            short = b - a > 1 and low[a] == "'" and low[a + 1].isalpha()
            while k < len(start) and start[k] <= b:
                end = start[k] - a
                if end > 0:
                    out[cuts[k]] = done + (self.of_words(low[a : a + end]) if short else self.closed(symbols, last, count, size[end]))
                k += 1
            while wide and start[wide[-1] - 1] <= b:
                w = wide.pop()
                held = start[w - 1] - a  # characters of this word before the stretch
                for i in range(cuts[w - 1] + 1, cuts[w]):
                    tail = self.normal(piece[cuts[w - 1] : i])
                    if held <= SHORT:
                        before = "'" if apostrophe else ""
                        out[i] = done - (self.of_words(before) if before else 0) + self.of_words(before + low[a : a + held] + tail)
                    else:  # a run of letters or of marks
                        near = low[a + held - 4 : a + held]
                        first = self.words.findall(near + tail)[0]
                        more = first[len(near) :]
                        out[i] = done + self.extended(symbols, last, count, size[held], self.word_symbols(more)) + self.of_words(tail[len(more) :])
            done += self.closed(symbols, last, count, len(symbols))
            apostrophe = low[a:b] == "'"
        return out

    def extended(self, symbols: str, last: list[int], count: list[int], n: int, more: str) -> int:
        """Tokens of the word that `more` makes of the first n symbols. Tokens reach back no further than the longest one."""
        w = max(0, n - 2 * self.longest)
        whole = symbols[w:n] + more
        return self.closed(whole, *self.prefixes(whole, last[w : n + 1], count[w : n + 1]), len(whole))

    def of_text(self, text: str) -> int:
        return sum(self.of_piece(x) for x in self.spaces.split(text) if x)

    def within(self, text: str, budget: int) -> int:
        """Characters of the longest prefix of at most `budget` tokens."""
        return int(np.flatnonzero(self.prefix_counts(text) <= budget)[-1])

    def table(self, texts: pa.Array) -> PrefixTable:
        lists = pc.split_pattern(pc.replace_substring(pc.fill_null(texts, ""), "\n", " "), " ")
        pieces = lists.flatten().dictionary_encode()
        n = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        self.memo.turn()
        kinds = pieces.dictionary.to_pylist()
        each = np.fromiter(map(self.of_any, kinds), np.int64, len(kinds))
        return PrefixTable(self, kinds, pieces.indices.to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(n))), each)

    def __call__(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text."""
        return self.table(texts).counts()

    def of_any(self, piece: str) -> int:
        """A piece that may hold white space other than the space and line feed."""
        n = self.memo.get(piece)  # most pieces are one plain word
        if n is not None:
            return n
        parts = piece.split()
        if len(parts) < 2 and (not parts or parts[0] == piece):
            return self.of_piece(piece)
        if self.special.search(piece):
            return len(self.library.encode(piece, add_special_tokens=False).ids)
        return self.of_text(piece)


class PrefixTable:
    """For each of some texts the exact count, and the code points, at the end of each of its pieces."""

    def __init__(self, counter: PrefixCounter, kinds: list[str], codes: np.ndarray, offsets: np.ndarray, each: np.ndarray):
        self.counter, self.kinds, self.codes, self.offsets = counter, kinds, codes, offsets
        self.tokens = np.concatenate(([0], np.cumsum(each[codes])))
        size = np.fromiter(map(len, kinds), np.int64, len(kinds))
        self.chars = np.concatenate(([0], np.cumsum(size[codes] + 1)))  # with the space behind each piece

    def counts(self) -> np.ndarray:
        """Tokens of each text."""
        return self.tokens[self.offsets[1:]] - self.tokens[self.offsets[:-1]]

    def fits(self, budget: int) -> np.ndarray:
        """Code points of each text's longest prefix of at most `budget` tokens; looks into no piece but the one that is cut."""
        a, b = self.offsets[:-1], self.offsets[1:]
        out = self.chars[b] - self.chars[a] - 1
        for i in np.flatnonzero(self.counts() > budget).tolist():
            k = int(np.searchsorted(self.tokens[a[i] + 1 : b[i] + 1], self.tokens[a[i]] + budget, "right")) + a[i]
            left = budget - (self.tokens[k] - self.tokens[a[i]])
            inside = self.counter.prefix_counts(self.kinds[self.codes[k]])
            out[i] = self.chars[k] - self.chars[a[i]] + int(np.flatnonzero(inside <= left)[-1])
        return out

    def rows(self) -> tuple[list[bytes], list[bytes]]:
        """Of each text the ends (code points) and counts of its pieces, as little-endian 64-bit integers."""
        spans = list(zip(self.offsets[:-1].tolist(), self.offsets[1:].tolist(), strict=True))
        return [(self.chars[a + 1 : b + 1] - self.chars[a] - 1).astype("<i8").tobytes() for a, b in spans], [(self.tokens[a + 1 : b + 1] - self.tokens[a]).astype("<i8").tobytes() for a, b in spans]


@lru_cache(maxsize=1)
def _seconds() -> frozenset[str]:
    """Characters that compose with one before them though they aren't marks of a combining class."""
    pairs = (unicodedata.decomposition(chr(c)).split(" ") for c in range(0xA0, sys.maxunicode + 1))
    return frozenset(chr(int(p[1], 16)) for p in pairs if len(p) == 2 and p[0][:1] != "<") | set(map(chr, (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))))


def stretches(piece: str) -> list[int]:
    """Where normalisation can't reach across, from 0 to the length."""
    n = len(piece)
    if piece.isascii() or unicodedata.is_normalized("NFC", piece):
        return list(range(n + 1))
    seconds, combining = _seconds(), unicodedata.combining
    return [0, *(i for i in range(1, n) if piece[i] < "\u0300" or not combining(piece[i]) and piece[i] not in seconds), *([n] if n else [])]


@lru_cache(maxsize=1)
def prefix_counter(path: str) -> PrefixCounter:
    """A worker's counter; what it has solved lasts from task to task."""
    return PrefixCounter(path)


MEMOS.append(prefix_counter.cache_clear)


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, fits_chars of each whole text, answered from its prefix table."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = prefix_counter(vocabulary_path(vocabulary))
        for part in slices(batches, "text", TOKEN_SLICE):
            table = counter.table(part.column("text"))
            n = table.counts()
            size = pc.cast(pc.fill_null(pc.binary_length(part.column("text")), 0), pa.int64())
            yield record(doc_id=part.column("doc_id"), n_bytes=size, n_tokens=n, over_limit=n > limit, fits_chars=table.fits(limit))

    return map_batches(docs.select("doc_id", "text"), work, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fits_chars long", keeps_memos=True)


def prefix_table(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, ends, counts: each text's table, to be written once and asked often (`cut`)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = prefix_counter(vocabulary_path(vocabulary))
        for part in slices(batches, "text", TOKEN_SLICE):
            ends, counts = counter.table(part.column("text")).rows()
            yield record(doc_id=part.column("doc_id"), ends=pa.array(ends, pa.binary()), counts=pa.array(counts, pa.binary()))

    return map_batches(docs.select("doc_id", "text"), work, "doc_id long, ends binary, counts binary", keeps_memos=True)


def cut(tables: DataFrame, budget: int) -> DataFrame:
    """doc_id, chars, n_tokens of the longest run of whole pieces within the budget, from stored tables; no text is read."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "ends"):
            chars, tokens = [], []
            for ends, counts in zip(part.column("ends").to_pylist(), part.column("counts").to_pylist(), strict=True):
                n = np.frombuffer(counts, "<i8")
                k = int(np.searchsorted(n, budget, "right"))
                chars.append(int(np.frombuffer(ends, "<i8")[k - 1]) if k else 0)
                tokens.append(int(n[k - 1]) if k else 0)
            yield record(doc_id=part.column("doc_id"), chars=pa.array(chars, pa.int64()), n_tokens=pa.array(tokens, pa.int64()))

    return map_batches(tables.select("doc_id", "ends", "counts"), work, "doc_id long, chars long, n_tokens long")
