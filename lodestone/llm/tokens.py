"""Whole-text encoding by the tokenizers library, with a memo of pieces that repeat."""

from __future__ import annotations

import os
from array import array
from functools import lru_cache
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import MEMOS

#: Bytes of text in a slice: the larger, the fewer of its pieces are new.
TOKEN_SLICE = 4 << 20
#: Marks that part from the letters before them and stay together; an apostrophe may open a suffix, so it isn't one of them.
MARKS = ".,;:!?#$%&*|()[]{}<>/+=@^~_\"-"
#: Pieces in each of a memo's two generations.
MEMO_PIECES = 250_000


class Memo:
    """A bounded map: what was used since the last turn survives it, the rest goes."""

    def __init__(self, limit: int = MEMO_PIECES):
        self.limit, self.young, self.old = limit, {}, {}

    def get(self, key):
        found = self.young.get(key)
        if found is None and (found := self.old.get(key)) is not None:
            self.young[key] = found
        return found

    def get_all(self, keys: list) -> list:
        found = list(map(self.young.get, keys))
        if self.old:
            for i, x in enumerate(found):
                if x is None and (y := self.old.get(keys[i])) is not None:
                    found[i] = self.young[keys[i]] = y
        return found

    def put(self, key, value) -> None:
        self.young[key] = value

    def turn(self) -> None:
        """Between two slices: start a new generation if this one is full."""
        if len(self.young) > self.limit:
            self.old, self.young = self.young, {}


def byte_symbols() -> list[str]:
    """The printable symbol of each byte in byte-level vocabularies: itself if printable, else the next code from 256."""
    keep = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b if b in keep else next(spare)) for b in range(256)]


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def id_type(path: str) -> str:
    """The narrowest little-endian type that holds each id of the vocabulary."""
    return "<u2" if max(load(path).get_vocab().values()) < 1 << 16 else "<u4"


@lru_cache(maxsize=2)
def encoder(path: str, spaced: bool) -> Encoder:
    """A worker's encoder; its memo lasts from task to task."""
    return Encoder(path, spaced)


MEMOS.append(encoder.cache_clear)


class Encoder:
    """Ids of whole texts, equal to Tokenizer.encode(text, add_special_tokens=False).

    A text is cut at a space or line feed into pieces whose ids don't depend on one another; each distinct piece goes to
    the library once. With spaced=False the vocabulary drops white space (word-end BPE), so any space is such a place.
    With spaced=True (byte-level BPE) a word owns the space before it, so only texts whose white space is single spaces and
    line feeds between other characters are cut; any other text goes to the library whole.
    """

    def __init__(self, path: str, spaced: bool):
        self.tokenizer, self.spaced, self.memo = load(path), spaced, Memo()
        self.model, self.symbols = self.tokenizer.model, byte_symbols()
        self.marks: dict[str, bytes] = {"": b""}

    def _model(self, word: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(word)]).tobytes()

    def _word(self, word: str) -> bytes | None:
        """Ids of a word of letters, with a run of marks behind it or without: the library's model on what the library's own
        normalizer and splitter make of such a piece. None: another kind of piece."""
        head = word.rstrip(MARKS)
        run = word[len(head) :]
        if not head:
            return self._model("\u0120" + run if self.spaced else run) if run else None
        if not head.isalpha():
            return None
        tail = self.marks.get(run)
        if tail is None:
            tail = self.marks[run] = self._model(run)
            if len(self.marks) > 10_000:
                self.marks = {"": b""}
        word = head
        if not self.spaced:
            if word.isascii():
                word = word.lower()
            elif "\u0130" in word or not is_normalized("NFC", word):
                return None
            else:
                word = "".join([c.lower() for c in word])
        if not word.isascii():
            symbols = self.symbols
            word = "".join([symbols[b] for b in word.encode()])
        ids = self._model("\u0120" + word if self.spaced else word)
        return ids + tail

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids end to end (uint32), and n + 1 offsets."""
        texts = pc.fill_null(texts, "")
        n = len(texts)
        whole = np.zeros(n, bool)
        if self.spaced:
            odd = pc.match_substring_regex(texts, r"[^\S \n]|[\x00\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|[ \n][ \n]|^[ \n]|[ \n]\z|^\z")
            whole = odd.to_numpy(zero_copy_only=False)
            cut = pc.replace_substring(pc.if_else(odd, "", texts), "\n", " \n \x00")
            cut = pc.binary_join_element_wise("\x00", cut, "")
        else:
            cut = pc.replace_substring(texts, "\n", " ")
        lists = pc.split_pattern(cut, " ")
        pieces = lists.flatten().dictionary_encode()
        counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        known = pieces.dictionary.to_numpy(zero_copy_only=False).tolist()
        memo = self.memo
        memo.turn()
        found = memo.get_all(known)
        missed = [i for i, x in enumerate(found) if x is None]
        for i in missed:
            found[i] = self._word(known[i])
        rest = [i for i in missed if found[i] is None]
        strings = [known[i] for i in rest]
        as_text = [x if x[:1] == "\n" else x[1:] if x[:1] == "\x00" else " " + x for x in strings] if self.spaced else strings
        for i, ids in zip(rest, self._ids(as_text), strict=True):
            found[i] = array("I", ids).tobytes()
        for i in missed:
            memo.put(known[i], found[i])
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        pool, base = np.frombuffer(b"".join(found), np.uint32), np.concatenate(([0], np.cumsum(sizes)))
        codes = pieces.indices.to_numpy(zero_copy_only=False)
        each = sizes[codes]
        ends = np.cumsum(each)
        total = int(ends[-1]) if len(ends) else 0
        ids = pool[np.arange(total) + np.repeat(base[codes] - (ends - each), each)]
        offsets = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(counts)))]
        if not whole.any():
            return ids, offsets
        rest = iter(self._ids([x for x, w in zip(texts.to_pylist(), whole, strict=True) if w]))
        parts = [np.array(next(rest), np.uint32) if whole[i] else ids[offsets[i] : offsets[i + 1]] for i in range(n)]
        return np.concatenate(parts), np.concatenate(([0], np.cumsum([len(x) for x in parts])))


def with_end(ids: np.ndarray, offsets: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Put the id `end` after each text's ids."""
    n = len(offsets) - 1
    out = np.full(len(ids) + n, end, np.uint32)
    keep = np.ones(len(out), bool)
    keep[offsets[1:] + np.arange(n)] = False
    out[keep] = ids
    return out, offsets + np.arange(n + 1)
