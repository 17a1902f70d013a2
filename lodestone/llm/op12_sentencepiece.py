"""SentencePiece encoding of merge-type models by backtracking, and decoding.

A merge-type (BPE) model joins, again and again, the two neighbours whose joint piece scores highest, the leftmost first. Its
outcome is the one sequence of pieces in which each piece merges to itself and each two neighbours, merged again on their own,
come out as those same two: were a merge ever to cross the border of two pieces, the first such merge would happen in the two
alone as well. So a text's pieces are found from left to right: an Aho-Corasick automaton gives the longest piece at each
position; a piece is taken if it goes with the one before and no failure is known where it ends, else the next shorter one
that begins there is tried; where none is left, the position's bit is set in a field of failures and the last piece is taken
back. Each position fails once at most, so the work grows with the text's length. Which piece may follow which is kept in a bounded memo.

Text is normalised by the library and cut where no piece of the model can reach across: before a run of space marks (U+2581)
that follows other characters, between a letter and a mark that no piece has behind a letter, and around line feeds if no
piece holds one. Parts are numbered by Arrow some megabytes at a time; each different one is looked up once there, encoded if it
is new, and kept in a bounded memo. Characters that are no piece become their bytes' pieces, as the model's byte fallback does, or the unknown id.

Null texts count as empty: no ids, an empty decoded text. Control pieces' names in a text are ordinary text. Repeated rows are
encoded each. Very long texts are encoded whole, part by part. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MEMOS, map_batches, record, slices
from .tokens import Memo, vocabulary_path

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
#: Characters of a text that are cut into parts at a time.
STRETCH = 1 << 20
#: Bytes of normalised text, about, whose parts are taken together.
GROUP = 4 << 20
NEVER = float("-inf")
LETTERS = re.compile(r"[^\W\d_]+")


class Pieces:
    """A model's pieces: encode() gives the library's ids of a whole text."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        special = [i for i in range(sp.get_piece_size()) if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)]
        self.ids = {sp.id_to_piece(i): i for i in sorted(set(range(sp.get_piece_size())) - set(special))}
        self.scores = {p: sp.get_score(i) for p, i in self.ids.items()}
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.fallback = all(sp.is_byte(i) for i in self.bytes)
        self.letters = letters = {c for p in self.ids for c in p}
        if letters - self.ids.keys() or any(sp.is_unused(i) for i in self.ids.values()) or max(map(len, self.ids)) > 255:
            raise ValueError("a model whose pieces hold characters that are no pieces, or that has unused or very long pieces, can't be encoded this way")
        # By id: a piece, its length, and the next shorter piece with which it begins (-1: none).
        self.names, self.sizes, self.shorter = [""] * sp.get_piece_size(), [0] * sp.get_piece_size(), [-1] * sp.get_piece_size()
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for p, i in self.ids.items():
            self.names[i], self.sizes[i] = p, len(p)
            self.shorter[i] = next((self.ids[p[:n]] for n in range(len(p) - 1, 0, -1) if p[:n] in self.ids), -1)
            self.automaton.add_word(p, i)
        self.automaton.make_automaton()
        across = any(SPACE in p.lstrip(SPACE) for p in self.ids)
        feed = "" if "\n" in letters else "\n"
        # Marks that no piece has behind a letter: a word may be cut before them.
        self.marks = {c for c in letters if not (c.isalnum() or c in f"_{SPACE}")}
        self.marks -= {p[i] for p in self.ids for i in range(1, len(p)) if LETTERS.match(p[i - 1])}
        self.borders = re.compile(f"(?=[{''.join(map(re.escape, sorted(self.marks)))}])(?<=[^\\W\\d_])") if self.marks else None
        self.feed = bool(feed)
        ascii_only = lambda test: np.array([test(chr(i)) for i in range(128)] + [False] * 128)
        self.is_letter, self.is_mark = ascii_only(str.isalpha), ascii_only(self.marks.__contains__)
        self.cut = None if across else re.compile(f"(?<=[^{SPACE}]){SPACE}")
        self.known, self.pairs, self.merges = Memo(), Memo(1 << 19), {}

    def next_merge(self, symbols: list[str]) -> tuple[float, int] | None:
        """The score and the negated place of the merge that comes next."""
        return max(((self.scores[j], -i) for i in range(len(symbols) - 1) if (j := symbols[i] + symbols[i + 1]) in self.scores), default=None)

    def history(self, piece: str) -> list[tuple[str, str, float]] | None:
        """How a piece merges on its own: its first and last symbol and the next merge's score, step by step; None if it
        doesn't come out as itself."""
        if piece not in self.merges:
            symbols, steps = list(piece), []
            while (best := self.next_merge(symbols)) is not None:
                steps.append((symbols[0], symbols[-1], best[0]))
                symbols[-best[1] : 2 - best[1]] = [symbols[-best[1]] + symbols[1 - best[1]]]
            self.merges[piece] = [*steps, (symbols[0], symbols[-1], NEVER)] if len(symbols) == 1 else None
        return self.merges[piece]

    def goes(self, before: str, piece: str) -> bool:
        """Whether the piece may follow the one before ("": it stands first): both merge again side by side, always the
        higher score first, of equal ones the left, and no merge may cross their border before both are whole."""
        left, right = self.history(before) if before else None, self.history(piece)
        good = right is not None
        i = j = 0
        while good and left:
            (_, last, a), (first, _, b) = left[i], right[j]
            across = self.scores.get(last + first)
            if across is not None and across > a and across >= b:
                good = False
            elif a == b == NEVER:
                break
            elif a >= b:
                i += 1
            else:
                j += 1
        return good

    def follower(self, before: int, piece: int) -> int:
        """The longest piece that may follow the one before, of this piece and those with which it begins (-1: none); a pair's
        key has 0 where nothing stands before."""
        name, passed, pairs = self.names[before - 1] if before else "", [], self.pairs
        while piece >= 0:
            pair = before << 32 | piece
            passed.append(pair)
            if (known := pairs.get(pair)) is not None:
                piece = known
                break
            if self.goes(name, self.names[piece]):
                break
            piece = self.shorter[piece]
        for pair in passed:
            pairs.put(pair, piece)
        return piece

    def backtrack(self, text: str) -> list[int]:
        """The ids of the pieces of a text all of whose characters are pieces."""
        sizes, shorter, known = self.sizes, self.shorter, self.pairs.young.get
        size = len(text)
        longest = [-1] * (size + 1)
        for end, i in self.automaton.iter(text):
            longest[end - sizes[i] + 1] = i  # ends ascend, so the last one is the longest
        failed, failures = bytearray(size // 8 + 1), False
        taken, before = [], 0
        at, piece = 0, longest[0]
        while at < size:
            while piece >= 0:
                good = known(before << 32 | piece)
                piece = self.follower(before, piece) if good is None else good
                end = at + sizes[piece]
                if piece < 0 or not (failures and failed[end >> 3] >> (end & 7) & 1):
                    break
                piece = shorter[piece]
            if piece >= 0:
                taken.append(piece)
                at, before = end, piece + 1
                piece = longest[at]
            else:
                failed[at >> 3] |= 1 << (at & 7)
                failures = True
                piece = taken.pop()
                at, before = at - sizes[piece], taken[-1] + 1 if taken else 0
                piece = shorter[piece]
        return taken

    def part(self, text: str) -> bytes:
        """Ids (native 32-bit integers) of one part, by its words and marks."""
        found = self.known.get(text)
        if found is None:
            cut = self.borders.split(text) if self.borders else [text]
            if len(cut) > 1:
                found = b"".join(map(self.part, cut))
            else:
                found = array("i", self.backtrack(text) if self.letters.issuperset(text) else self.mixed(text)).tobytes()
            self.known.put(text, found)
        return found

    def mixed(self, text: str) -> Iterator[int]:
        """Ids of a part with characters that are no piece: they go by their bytes, or a run of them as one unknown id."""
        start, unknown = 0, False
        for i, c in enumerate(text):
            if c in self.letters:
                unknown = False
                continue
            if i > start:
                yield from self.backtrack(text[start:i])
            if self.fallback:
                yield from (self.bytes[b] for b in c.encode())
            elif not unknown:
                yield self.library.unk_id()
            start, unknown = i + 1, True
        if start < len(text):
            yield from self.backtrack(text[start:])

    def stretches(self, text: str) -> Iterator[str]:
        """A normalised text in stretches of about STRETCH characters, cut between parts."""
        at = 0
        while self.cut and len(text) - at > STRETCH:
            end = self.cut.search(text, at + STRETCH)
            if end is None:
                break
            yield text[at : end.start()]
            at = end.start()
        yield text[at:] if at else text

    def starts(self, data: bytes, firsts: np.ndarray) -> np.ndarray:
        """Where parts begin in normalised texts that begin at `firsts`; borders of letters beyond ASCII are left to part()."""
        a = np.frombuffer(data, np.uint8)
        cut = np.zeros(len(a), bool)
        if self.cut and len(a) > 2:
            space = np.zeros(len(a), bool)
            space[:-2] = (a[:-2] == 0xE2) & (a[1:-1] == 0x96) & (a[2:] == 0x81)
            cut |= space
            cut[3:] &= ~space[:-3]
            cut[1:] |= self.is_letter[a[:-1]] & self.is_mark[a[1:]]
            if self.feed:
                feed = a == 10
                cut[1:] |= feed[1:] != feed[:-1]
        cut[firsts] = True
        return np.flatnonzero(cut)

    def group(self, held: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some normalised texts, none empty, one after the other, and how many each has."""
        self.known.turn()
        self.pairs.turn()
        data = b"".join(held)
        firsts = np.cumsum([0, *map(len, held)])
        starts = self.starts(data, firsts[:-1])
        offsets = np.append(starts, len(data)).astype(np.int32)
        coded = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data)).dictionary_encode()
        parts = coded.dictionary.to_pylist()
        ids = [self.part(parts[i]) if x is None else x for i, x in enumerate(self.known.get_all(parts))]
        sizes, which = np.array([len(x) for x in ids]) // 4, coded.indices.to_numpy()
        n = sizes[which]
        ends = np.cumsum(n)
        at = np.repeat((np.cumsum(sizes) - sizes)[which] - (ends - n), n) + np.arange(ends[-1])
        until = np.append(0, ends)[np.searchsorted(starts, firsts)]
        return np.frombuffer(b"".join(ids), np.int32)[at], np.diff(until)

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts one after the other, and how many each has."""
        flat, counts, held, of, size = [np.empty(0, np.int32)], np.zeros(len(texts), np.int64), [], [], 0
        stretches = ((i, stretch) for i, text in enumerate(texts) if text for stretch in self.stretches(self.library.normalize(text)) if stretch)
        for i, stretch in chain(stretches, [(-1, "")]):
            if held and (i < 0 or size > GROUP):
                ids, n = self.group(held)
                flat.append(ids)
                np.add.at(counts, of, n)
                held, of, size = [], [], 0
            held.append(stretch.encode())
            of.append(i)
            size += len(held[-1])
        return np.concatenate(flat), counts

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0].tolist()


@lru_cache(maxsize=1)
def pieces(path: str) -> Pieces:
    """A worker's model; its memos last from task to task."""
    return Pieces(path)


MEMOS.append(pieces.cache_clear)


def _map(df: DataFrame, column: str, model: str, work, schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = pieces(model)
        for part in slices(batches, column, GROUP):
            yield work(part, by)

    return map_batches(df, run, schema, keeps_memos=True)


def round_trip(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, ids (array of int), decoded: each text's ids, and the text that the library decodes from them."""

    def work(part: pa.RecordBatch, by: Pieces) -> pa.RecordBatch:
        flat, counts = by.encode_all(part.column("text").to_pylist())
        ends = np.cumsum(counts)
        decoded = [by.library.decode(flat[end - n : end].tolist()) if n else "" for n, end in zip(counts.tolist(), ends.tolist(), strict=True)]
        return record(doc_id=part.column("doc_id"), ids=pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(flat)), decoded=decoded)

    return _map(docs.select("doc_id", "text"), "text", model or vocabulary_path(MODEL), work, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>, decoded string")


def digests(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each document."""
    return round_trip(docs, model).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
