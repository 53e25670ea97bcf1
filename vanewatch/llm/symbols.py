"""Words, windows and their hashes over whole Arrow string columns, in numpy.

A block is the UTF-8 bytes of some documents end to end plus their offsets. Everything here works
on a block at once, so the cost per byte is that of a few array passes. Hashes are polynomials
modulo 2**64 with an odd base, taken from running sums, then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes that part words.
GAP = np.zeros(256, dtype=bool)
GAP[[0x20, *range(0x09, 0x0E)]] = True

#: Bytes of a block; a longer document makes a block of its own.
BLOCK_BYTES = 1 << 21

_BASE = 0x9E3779B97F4A7C15
_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n - 1 of the base and of its inverse."""
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(max(n, BLOCK_BYTES), base, dtype=np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps)
    return _powers[0][:n], _powers[1][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread every bit of ``x`` over all bits; one to one."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Sums:
    """Running sums over symbols, from which any stretch is hashed in constant time."""

    def __init__(self, symbols: np.ndarray):
        power, self.inverse = _power_tables(len(symbols) + 1)
        self.total = np.zeros(len(symbols) + 1, dtype=np.uint64)
        np.cumsum((symbols.astype(np.uint64) + np.uint64(1)) * power[:-1], out=self.total[1:])

    def spans(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        lengths = (hi - lo).astype(np.uint64)
        return mixed((self.total[hi] - self.total[lo]) * self.inverse[lo] + lengths)

    def windows(self, width: int) -> np.ndarray:
        """Hash of the ``width`` symbols from each place on."""
        n = len(self.total) - width
        if n <= 0:
            return np.zeros(0, dtype=np.uint64)
        gap = self.total[width:] - self.total[:n]
        return mixed(gap * self.inverse[:n] + np.uint64(width))

    def changes(self, at: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """What the sums over the places ``at`` change by if other symbols stand there."""
        power, _ = _power_tables(len(self.total))
        return (symbols.astype(np.uint64) + np.uint64(1)) * power[at] - (self.total[at + 1] - self.total[at])

    def windows_at(self, lo: np.ndarray, width: int, change: np.ndarray) -> np.ndarray:
        """Hashes of the windows from ``lo`` on with their sums changed."""
        gap = self.total[lo + width] - self.total[lo] + change
        return mixed(gap * self.inverse[lo] + np.uint64(width))


def blocks(column: pa.Array, most: int = BLOCK_BYTES) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) of consecutive documents; null counts as empty."""
    column = pc.fill_null(column, "")
    if len(column) == 0:
        return
    wide = pa.types.is_large_string(column.type)
    starts = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)
    starts = starts[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, dtype=np.uint8)
    row = 0
    while row < len(column):
        stop = int(np.searchsorted(starts, starts[row] + most, side="right")) - 1
        stop = min(max(stop, row + 1), len(column))
        yield slice(row, stop), data[starts[row] : starts[stop]], starts[row : stop + 1] - starts[row]
        row = stop


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and for each document the number of its first word.

    The last entry of the third array is the number of words.
    """
    solid = ~GAP[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    begins, ends = solid.copy(), solid.copy()
    if len(data):
        begins[1:] &= ~solid[:-1] | edge[1:-1]
        ends[:-1] &= ~solid[1:] | edge[1:-1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


def owners(firsts: np.ndarray) -> np.ndarray:
    """Document of each item, from the number of each document's first item."""
    return np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` over each stretch of ``width`` values, by doubling."""
    out, reach = values, 1
    while reach * 2 <= width:
        out = pick(out[:-reach], out[reach:])
        reach *= 2
    rest = width - reach
    return pick(out[:-rest], out[rest:]) if rest else out


def anchors(grams: np.ndarray, ends: np.ndarray, width: int, gram: int) -> np.ndarray:
    """Places whose gram hash is the least of some window of ``width`` symbols.

    ``ends`` holds, for each symbol, where its document ends. Two equal windows have their
    anchors at the same places, so equal stretches can be found by comparing anchors alone.
    """
    n = len(ends) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    reach = width - gram + 1
    keys = grams | np.uint64(1)
    least = _sliding(keys, reach, np.minimum)[:n]
    whole = np.arange(n) + width <= ends[:n]
    least = np.where(whole, least, np.uint64(0))
    padded = np.concatenate([np.zeros(reach - 1, np.uint64), least, np.zeros(reach - 1, np.uint64)])
    return np.flatnonzero(_sliding(padded, reach, np.maximum) == keys[: n + reach - 1])


def merged(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs covered by the half-open spans."""
    if len(lo) == 0:
        return lo, hi
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    fresh = np.concatenate([[True], lo[1:] > hi[:-1]])
    last = np.concatenate([fresh[1:], [True]])
    return lo[fresh], hi[last]
