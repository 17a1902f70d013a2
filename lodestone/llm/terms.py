"""Terms of texts as arrays: maximal runs of a set of bytes, ASCII letters lower-cased, each occurrence as a number."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .common import WORD_BYTES, flat

#: Letters and all that isn't ASCII.
LETTER_BYTES = WORD_BYTES.copy()
LETTER_BYTES[0x30:0x3A] = 0


class Terms:
    """A slice of texts: `dictionary` of its different terms, and for each occurrence in order its `code` there and its `doc` (row).

    `table` maps a byte to what stands in a term, 0 for what parts terms; it keeps every byte from 0x80 on, so characters stay
    whole. Terms are told apart by their bytes, not by hashes.
    """

    def __init__(self, texts: pa.Array, table: np.ndarray):
        data, offsets = flat(texts)
        low = table[data]
        inside = low != 0
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        edges = offsets[1:-1]
        edges = edges[(edges > 0) & (edges < len(low))]
        first[edges] = inside[edges]
        last[edges - 1] = inside[edges - 1]
        starts = np.flatnonzero(first)
        lengths = np.flatnonzero(last) + 1 - starts
        self.n_docs = len(offsets) - 1
        self.doc = np.searchsorted(offsets[1:], starts, "right").astype(np.int32)
        ends = np.concatenate(([0], np.cumsum(lengths))).astype(np.int64)
        said = pa.Array.from_buffers(pa.large_utf8(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(low[inside])]).dictionary_encode()
        self.dictionary: pa.Array = said.dictionary
        self.code = said.indices.to_numpy(zero_copy_only=False)
        self.sizes = np.bincount(self.doc, minlength=self.n_docs).astype(np.int64)

    def postings(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(code, doc, occurrences) of each different pair, ordered by code, then doc."""
        pairs, n = np.unique(self.code.astype(np.int64) * max(self.n_docs, 1) + self.doc, return_counts=True)
        return pairs // max(self.n_docs, 1), pairs % max(self.n_docs, 1), n
