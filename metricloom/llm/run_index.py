"""A run-length index of byte segments, and the matching statistics of the segments streamed against it.

The Burrows-Wheeler transform of the segments is kept as runs: their symbols, where they start, where a step to the left
(LF) takes their first row, and the text positions of their first and last suffix. A stream reads a segment from its end,
one LF step a byte, and carries how far its suffix agrees with the nearest suffixes above and below. Inside a run these
move left with it and agree in one byte more; at a run's edge the nearest suffix is the sample at the edge of the
run that LF puts beside it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Bytes after which a long segment is entered again, so that streams of about equal length go side by side.
ENTRY = 1024


@dataclass(frozen=True)
class RunIndex:
    """start: first row of each run, and the number of rows behind the last. symbol, left: a run's symbol, and the row
    that LF gives for its first one. head, tail: samples, the text positions of a run's first and last suffix. above,
    below: the runs whose rows LF puts before and behind those of a run (-1: none). joint: how far a run's head agrees
    with the tail of the run ``above`` (-1: their symbols differ already).

    Streams: entry, row: text positions from which texts are read to the left, and their rows. over, under, up, down: the
    positions in the rows above and below, and how far they agree. steps: how many bytes each stream reads.
    """

    size: int
    start: np.ndarray
    symbol: np.ndarray
    left: np.ndarray
    head: np.ndarray
    tail: np.ndarray
    above: np.ndarray
    below: np.ndarray
    joint: np.ndarray
    entry: np.ndarray
    row: np.ndarray
    over: np.ndarray
    under: np.ndarray
    up: np.ndarray
    down: np.ndarray
    steps: np.ndarray

    @property
    def runs(self) -> int:
        return len(self.symbol)


def _ranked(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Dense ranks of keys, and their order."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    rank = np.empty(len(keys), dtype=np.int64)
    rank[order] = np.cumsum(np.concatenate([[0], ordered[1:] != ordered[:-1]]))
    return rank, order


def _agreed(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many symbols the suffixes at a and b share, from ranks of their first 1, 2, 4 ... symbols."""
    n, match = len(levels[0]), np.zeros(len(a), dtype=np.int64)
    for depth in reversed(range(len(levels))):
        fits = (a + match < n) & (b + match < n)
        x, y = np.where(fits, a + match, 0), np.where(fits, b + match, 0)
        match += np.where(fits & (levels[depth][x] == levels[depth][y]), 1 << depth, 0)
    return match


def build(segments: list[bytes]) -> RunIndex:
    """Index segments; each ends in a sign of its own, so that no match leaves its segment."""
    ends = np.cumsum([len(s) + 1 for s in segments]) - 1
    symbols = np.frombuffer(b"\0".join(segments) + b"\0", dtype=np.uint8).astype(np.int64) + len(segments)
    symbols[ends] = np.arange(len(segments))
    n = len(symbols)
    rank, order = _ranked(symbols)
    levels, step = [rank.astype(np.int32)], 1
    while rank[order[-1]] < n - 1:  # prefix doubling until no two suffixes are alike
        behind = np.zeros(n, dtype=np.int64)
        behind[:n - step] = rank[step:] + 1
        rank, order = _ranked(rank * (n + 1) + behind)
        levels.append(rank.astype(np.int32))
        step *= 2

    before = symbols[order - 1]  # the last column; position 0 takes the final sign
    start = np.flatnonzero(np.concatenate([[True], before[1:] != before[:-1], [True]]))
    symbol, length = before[start[:-1]], np.diff(start)
    head, tail = order[start[:-1]], order[start[1:] - 1]
    by_symbol = np.argsort(symbol, kind="stable")
    left = np.empty(len(symbol), dtype=np.int64)
    left[by_symbol] = np.cumsum(length[by_symbol]) - length[by_symbol]
    alike = symbol[by_symbol[1:]] == symbol[by_symbol[:-1]]
    one, two = by_symbol[:-1], by_symbol[1:]
    above, below, joint = (np.full(len(symbol), -1, dtype=np.int64) for _ in range(3))
    above[two], below[one] = one, two
    joint[two[alike]] = _agreed(levels, tail[one[alike]], head[two[alike]])

    opened = np.concatenate([[0], ends[:-1] + 1])
    inner = [np.arange(a + ENTRY, b, ENTRY) for a, b in zip(opened, ends) if b - a > ENTRY]
    entry = np.sort(np.concatenate([ends, *inner]))
    stop = np.concatenate([[0], entry[:-1] + (symbols[entry[:-1]] < len(segments))])
    row = rank[entry]
    over, under = order[np.maximum(row - 1, 0)], order[np.minimum(row + 1, n - 1)]
    up = np.where(row > 0, _agreed(levels, over, entry), 0)
    down = np.where(row < n - 1, _agreed(levels, under, entry), 0)
    return RunIndex(n, start, symbol, left, head, tail, above, below, joint, entry, row, over, under, up, down, entry - stop)


def statistics(index: RunIndex) -> tuple[np.ndarray, np.ndarray]:
    """Of each position: how long a stretch from there occurs elsewhere too, and where (any position if it is 0 long).

    Streams go side by side, the longest first, so that those that still read are always the first ones.
    """
    longest, other = (np.zeros(index.size, dtype=np.int64) for _ in range(2))
    order = np.argsort(-index.steps, kind="stable")
    steps = index.steps[order]
    place, row, higher, lower, up, down = (
        x[order] for x in (index.entry, index.row, index.over, index.under, index.up, index.down))
    active = np.searchsorted(-steps, -np.arange(steps[0] if len(steps) else 0), side="left")
    for k in active:
        place, row, up, down, higher, lower = (x[:k] for x in (place, row, up, down, higher, lower))
        run = np.searchsorted(index.start, row, side="right") - 1
        at_head, at_tail = row == index.start[run], row == index.start[run + 1] - 1
        before, behind = index.above[run], index.below[run]
        up = np.where(at_head, index.joint[run], up) + 1
        down = np.where(at_tail, np.where(behind < 0, -1, index.joint[behind]), down) + 1
        higher = (np.where(at_head, index.tail[before], higher) - 1) % index.size
        lower = (np.where(at_tail, index.head[behind], lower) - 1) % index.size
        row = index.left[run] + row - index.start[run]
        place = place - 1
        longest[place] = np.maximum(up, down)
        other[place] = np.where(up >= down, higher, lower)
    return longest, other


def repeated(index: RunIndex, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Disjoint intervals [from, to) of positions at which a stretch of ``length`` starts that occurs elsewhere too."""
    long = np.concatenate([[False], statistics(index)[0] >= length, [False]]).astype(np.int8)
    edge = np.diff(long)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
