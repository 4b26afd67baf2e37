"""Encode every distinct text chunk once and put documents together by array gathers.

A chunk is a stretch of text between two places where the tokenizer's own splitting
can never join left and right, so a document's ids are the ids of its chunks in order.
A Python worker keeps its chunk table between batches and tasks; the table is emptied
when it holds ``limit`` chunks (bounded memory; results don't depend on it).
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np

PIECE_CHARS = 1 << 20


class _Slots(dict):
    """chunk → slot number; chunks met for the first time are remembered in ``fresh``."""

    def __init__(self):
        super().__init__()
        self.fresh = []

    def __missing__(self, chunk):
        slot = self[chunk] = len(self)
        self.fresh.append(chunk)
        return slot


def gather(flat: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The slices flat[starts[i] : starts[i]+lens[i]] end to end."""
    total = int(lens.sum())
    if not total:
        return flat[:0]
    before = np.cumsum(lens) - lens
    return flat[np.repeat(starts - before, lens) + np.arange(total)]


class ChunkTable:
    def __init__(self, encode, limit: int = 1_000_000):
        self.encode, self.limit = encode, limit
        self._clear()

    def _clear(self):
        self.slots = _Slots()
        self.flat = np.zeros(0, np.uint32)
        self.starts = np.zeros(0, np.int64)
        self.lens = np.zeros(0, np.int64)

    def ids(self, chunk_lists: list[list]) -> tuple[np.ndarray, np.ndarray]:
        """All ids end to end, and how many each list of chunks has."""
        if len(self.slots) > self.limit:
            self._clear()
        counts = np.fromiter(map(len, chunk_lists), np.int64, len(chunk_lists))
        slots = np.fromiter(map(self.slots.__getitem__, chain.from_iterable(chunk_lists)),
                            np.int64, int(counts.sum()))
        if self.slots.fresh:
            flat, lens = self.encode(self.slots.fresh)
            self.slots.fresh = []
            self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(lens) - lens])
            self.lens = np.concatenate([self.lens, lens])
            self.flat = np.concatenate([self.flat, flat.astype(np.uint32)])
        lens = self.lens[slots]
        ends = np.concatenate([[0], np.cumsum(lens)])
        at = np.concatenate([[0], np.cumsum(counts)])
        return gather(self.flat, self.starts[slots], lens), ends[at[1:]] - ends[at[:-1]]


def pieces(text: str, cut: re.Pattern, size: int = PIECE_CHARS):
    """The text in pieces of about ``size`` characters, cut only where ``cut`` matches
    (the match itself belongs to no piece when it is a separator of width one)."""
    if len(text) <= size:
        yield text
        return
    start = 0
    while len(text) - start > size:
        m = cut.search(text, start + size)
        if m is None:
            break
        yield text[start:m.start()]
        start = m.end()
    yield text[start:]


def grouped(texts: list[str], size: int = 4 * PIECE_CHARS):
    """(first, last) row ranges of about ``size`` characters of text each."""
    first, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= size:
            yield first, i + 1
            first, held = i + 1, 0
    if first < len(texts):
        yield first, len(texts)
