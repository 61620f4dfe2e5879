"""Words and their 64-bit hashes from UTF-8 bytes, whole Arrow batches at a time.

A word is a run of bytes other than space and \\x09-\\x0D, lower-cased for A-Z. Its hash is a polynomial over
per-byte random numbers modulo 2**64, from prefix sums, and mixed: the same in every task and on every run.
"""

from __future__ import annotations

import numpy as np

PIECE = 512 << 10
BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_numbers(seed: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE) + np.uint64(seed))


def space_table() -> np.ndarray:
    found = np.zeros(256, bool)
    found[[32, 9, 10, 11, 12, 13]] = True
    return found


def lower_table() -> np.ndarray:
    found = np.arange(256, dtype=np.uint8)
    found[65:91] += 32
    return found


class Words:
    """Finds words; keeps the powers of the polynomial between calls."""

    def __init__(self, seed: int = 7, lower: bool = True):
        numbers = byte_numbers(seed)
        self.numbers = numbers[lower_table()] if lower else numbers
        self.space = space_table()
        self.powers = self.inverse = np.zeros(0, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            n = max(n, PIECE)
            steps = np.full(n, BASE, np.uint64)
            steps[0] = 1
            self.powers = np.multiply.accumulate(steps)
            steps = np.full(n, pow(BASE, -1, 1 << 64), np.uint64)
            steps[0] = 1
            self.inverse = np.multiply.accumulate(steps)

    def scan(self, offsets: np.ndarray, data: np.ndarray):
        """Starts, ends and hashes of all words, and for each row the number of its first word (one more at the end)."""
        starts, ends, hashes = [], [], []
        at, size = 0, len(data)
        while at < size:
            stop = min(size, at + PIECE)
            if stop < size:  # cut after a space or at the end of a row, so that no word is split
                blank = np.flatnonzero(self.space[data[at:stop]])
                row_end = int(offsets[np.searchsorted(offsets, stop, "right") - 1])
                cut = max(at + int(blank[-1]) + 1 if len(blank) else at, row_end)
                while cut <= at:  # a word longer than the piece
                    more = min(size, stop + PIECE)
                    blank = np.flatnonzero(self.space[data[stop:more]])
                    row_end = int(offsets[np.searchsorted(offsets, stop, "left")])
                    if len(blank):
                        cut = min(stop + int(blank[0]) + 1, row_end)
                    elif row_end <= more:
                        cut = row_end
                    elif more == size:
                        cut = size
                    else:
                        stop = more
                stop = cut
            s, e, h = self._piece(offsets, data[at:stop], at)
            starts.append(s)
            ends.append(e)
            hashes.append(h)
            at = stop
        if not starts:
            empty = np.zeros(0, np.int64)
            return empty, empty, np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
        starts, ends, hashes = np.concatenate(starts), np.concatenate(ends), np.concatenate(hashes)
        return starts, ends, hashes, np.searchsorted(starts, offsets, "left")

    def _piece(self, offsets, data, at):
        n = len(data)
        word = ~self.space[data]
        edge = np.zeros(n + 1, bool)  # a row starts here
        inside = offsets[(offsets >= at) & (offsets <= at + n)] - at
        edge[inside] = True
        edge[0] = edge[n] = True
        before = np.empty(n, bool)
        before[0] = True
        before[1:] = ~word[:-1]
        after = np.empty(n, bool)
        after[-1] = True
        after[:-1] = ~word[1:]
        s = np.flatnonzero(word & (before | edge[:-1]))
        e = np.flatnonzero(word & (after | edge[1:])) + 1
        self._grow(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.numbers[data] * self.powers[:n], out=sums[1:])
        h = mix((sums[e] - sums[s]) * self.inverse[s] + (e - s).astype(np.uint64))
        return s + at, e + at, h
