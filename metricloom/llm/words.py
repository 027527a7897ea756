"""Words of many texts at once, by arrays of their bytes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once, and that are hashed at once.
PORTION = 4 << 20
STRETCH = 1 << 16
MIX = np.uint64(0x9E3779B97F4A7C15)

# Bytes that belong to words (digits, letters, all of non-ASCII), and their lower case.
_CODES = np.arange(256)
_IN_WORD = (((_CODES >= 0x30) & (_CODES <= 0x39)) | ((_CODES >= 0x41) & (_CODES <= 0x5A))
            | ((_CODES >= 0x61) & (_CODES <= 0x7A)) | (_CODES >= 0x80))
#: All bytes but white space, for words that only white space ends.
_NO_SPACE = (_CODES != 0x20) & ((_CODES < 0x09) | (_CODES > 0x0D))
_LOWER = np.where((_CODES >= 0x41) & (_CODES <= 0x5A), _CODES + 32, _CODES).astype(np.uint8)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input moves about half of the output's."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE_HASH = mixed(np.arange(1, 257, dtype=np.uint64) * MIX)


@lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """MIX to the power of each place, from 1 on, and what takes the place before away again."""
    power = np.full(size, MIX, dtype=np.uint64)
    back = np.full(size, pow(int(MIX), -1, 1 << 64), dtype=np.uint64)
    back[:1] = 1
    return np.cumprod(power), np.cumprod(back)


def portions(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = PORTION) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds at most ``size`` bytes of text, or one longer text."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch[text]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(ends):
            done = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, done + size, side="right")))
            yield batch.slice(at, stop - at)
            at = stop


class Words:
    """The words of many texts: their bytes, where they start and end, their text and a hash of each.

    Words are runs of digits, letters and non-ASCII, or, if ``spaced``, whatever white space leaves, or of the bytes that
    ``member`` marks, a space not among them. A-Z are lower-cased.
    """

    def __init__(self, texts: list[str], spaced: bool = False, member: np.ndarray | None = None):
        self.member = member if member is not None else _NO_SPACE if spaced else _IN_WORD
        parts = [t.encode() for t in texts]
        self.bytes = _LOWER[np.frombuffer(b" ".join(parts), dtype=np.uint8)]
        inside = np.zeros(len(self.bytes) + 2, dtype=bool)
        inside[1:-1] = self.member[self.bytes]
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        self.start, self.end = edge[::2], edge[1::2]
        # Of each text, the number of its first word.
        self.first = np.searchsorted(self.start, np.cumsum([0, *(len(p) + 1 for p in parts)]))
        self.counts = np.diff(self.first)
        self.text = np.repeat(np.arange(len(texts)), self.counts)
        self.hash = self._hashes()

    def _hashes(self) -> np.ndarray:
        """Each word's sum of its letters' hashes times powers by their places in it. Powers are by places in a stretch
        at first, so that no letter's place in its word is needed; what separates words adds nothing."""
        out = np.zeros(len(self.start), dtype=np.uint64)
        value = np.where(self.member, _BYTE_HASH, np.uint64(0))
        at = 0
        while at < len(out):  # so many words at once that they fill a stretch, or one longer word
            begin = self.start[at]
            stop = max(at + 1, int(np.searchsorted(self.end, begin + STRETCH, side="right")))
            size = self.end[stop - 1] - begin
            power, back = _powers(STRETCH) if size <= STRETCH else _powers.__wrapped__(size)
            letters = value[self.bytes[begin:begin + size]] * power[:size]
            own = self.start[at:stop] - begin
            out[at:stop] = mixed(np.add.reduceat(letters, own) * back[own])
            at = stop
        return out

    def grams(self, n: int) -> np.ndarray:
        """Hashes of all n neighbouring words, also across texts."""
        if len(self.hash) < n:
            return np.zeros(0, dtype=np.uint64)
        total = np.zeros(len(self.hash) - n + 1, dtype=np.uint64)
        with np.errstate(over="ignore"):
            for i in range(n):
                total = total * MIX + self.hash[i:len(self.hash) - n + 1 + i]
        return mixed(total + np.uint64(n))

    def within(self, n: int) -> np.ndarray:
        """For each place, whether n words from there are of one text."""
        return self.text[:max(0, len(self.text) - n + 1)] == self.text[n - 1:]

    def words(self, a: int, b: int) -> list[str]:
        return [self.bytes[self.start[i]:self.end[i]].tobytes().decode() for i in range(a, b)]
