"""Vectorised text primitives over Arrow string columns.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D; UTF-8 never
uses those bytes inside a longer character, so cutting bytes cuts characters
correctly.  Words carry a 64-bit hash that depends on their bytes only.
Everything here works on one chunk of whole documents at a time, so memory
follows the chunk and the longest single document, not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes (in place when the input is a fresh array)."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _table(seed: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(seed))


class _Lane:
    """One polynomial word hash: byte table and powers of an odd base."""

    def __init__(self, seed: int, base: int):
        self.table, self.base = _table(seed), base
        self.inverse = pow(base, -1, 1 << 64)
        self.powers = self.inverses = np.ones(1, _U)

    def grow(self, n: int) -> None:
        if len(self.powers) < n:
            for name, base in (("powers", self.base), ("inverses", self.inverse)):
                x = np.full(max(n, CHUNK_BYTES), base, _U)
                x[0] = 1
                setattr(self, name, np.multiply.accumulate(x))

    def hashes(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of data[start:end] for words in order, a piece at a time."""
        out = np.empty(len(start), _U)
        at = 0
        while at < len(start):
            low = int(start[at])
            upto = max(at + 1, int(np.searchsorted(end, low + CHUNK_BYTES, "right")))
            piece = data[low : int(end[upto - 1])]
            self.grow(len(piece))
            total = np.empty(len(piece) + 1, _U)
            total[0] = 0
            np.cumsum(self.table[piece] * self.powers[: len(piece)], out=total[1:])
            s, e = start[at:upto] - low, end[at:upto] - low
            x = (total[e] - total[s]) * self.inverses[s]
            out[at:upto] = mix(x + (e - s).astype(_U))
            at = upto
        return out


LANES = (_Lane(11, 0x9FB21C651E98DF25), _Lane(23, 0xD6E8FEB86659FD93))


class Chunk(NamedTuple):
    """Whole documents: rows low..high of the column, their bytes and bounds."""

    low: int
    high: int
    data: np.ndarray  # uint8
    bounds: np.ndarray  # int64, high - low + 1


def chunks(column: pa.Array | pa.ChunkedArray, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Documents in order, cut between documents; null is an empty text."""
    row = 0
    for part in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        part = part.cast(pa.large_string())
        if part.null_count:
            part = part.fill_null("")
        n = len(part)
        _, offsets, values = part.buffers()
        bounds = np.frombuffer(offsets, np.int64)[part.offset : part.offset + n + 1] if n else np.zeros(1, np.int64)
        data = np.frombuffer(values, np.uint8) if values is not None else np.zeros(0, np.uint8)
        i = 0
        while i < n:
            j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + limit, "right")) - 1)
            yield Chunk(row + i, row + j, data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])
            i = j
        row += n


class Words(NamedTuple):
    start: np.ndarray  # byte positions in the chunk
    end: np.ndarray
    doc: np.ndarray  # 0-based document of the chunk
    first: np.ndarray  # index of each document's first word; one more at the end


def words(chunk: Chunk) -> Words:
    data, bounds = chunk.data, chunk.bounds
    inside = ~_SPACE[data]
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    edge = bounds[:-1][bounds[:-1] < len(data)]
    opens[edge] = inside[edge]
    edge = bounds[1:][bounds[1:] > 0] - 1
    closes[edge] = inside[edge]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    first = np.searchsorted(start, bounds)
    return Words(start, end, np.repeat(np.arange(len(bounds) - 1), np.diff(first)), first)


def word_hashes(chunk: Chunk, found: Words, lane: int = 0) -> np.ndarray:
    return LANES[lane].hashes(chunk.data, found.start, found.end)


def runs(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of n consecutive values: out[i] covers hashes[i:i+n].

    Runs of powers of two are composed by doubling, so a run costs about
    2 log n operations whatever its length.
    """
    if n < 1:
        raise ValueError("a run needs at least one value")
    power, size, done, length = hashes, 1, None, 0
    while True:
        if n & size:
            if done is None:
                done, length = power, size
            else:
                m = max(0, min(len(done), len(power) - length))
                done = mix(done[:m] * _U(0x9E6C63D0676A9A99) + power[length : length + m])
                length += size
        if size * 2 > n:
            return done[: max(0, len(hashes) - n + 1)]
        m = max(0, len(power) - size)
        power = mix(power[:m] * _U(0x9E6C63D0676A9A99) + power[size : size + m])
        size *= 2


def windows(found: Words, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of each n-word window that lies in one document."""
    if len(hashes) < n:
        return np.zeros(0, np.int64), np.zeros(0, _U)
    at = np.flatnonzero(found.doc[: len(hashes) - n + 1] == found.doc[n - 1 :])
    return at, runs(hashes, n)[at]


def grouped(keys: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by two hashes, and which places of the order begin a new pair."""
    order = np.argsort(keys)
    one, two = keys[order], checks[order]
    new = np.ones(len(order), bool)
    new[1:] = one[1:] != one[:-1]
    if (~new[1:] & (two[1:] != two[:-1])).any():  # two texts share a 64-bit hash
        order = np.lexsort((checks, keys))
        one, two = keys[order], checks[order]
        new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
    return order, new


def repeated(keys: np.ndarray) -> np.ndarray:
    """Mask of the keys that occur twice or more."""
    if not len(keys):
        return np.zeros(0, bool)
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def covered(at: np.ndarray, n: int, size: int) -> np.ndarray:
    """Mask of positions 0..size covered by runs of n that begin at `at`."""
    step = np.zeros(size + 1, np.int64)
    np.add.at(step, at, 1)
    np.subtract.at(step, np.minimum(at + n, size), 1)
    return np.cumsum(step[:-1]) > 0


def sums(mask: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of mask over each segment first[i]:first[i+1]; empty segments give 0."""
    total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
    return total[first[1:]] - total[first[:-1]]
