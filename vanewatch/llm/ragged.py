"""Many short stretches of one array at once: gathered, compared, numbered and packed, in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def gather(data: np.ndarray, lo: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The stretches of ``sizes`` symbols from the places ``lo`` on, end to end."""
    heads = np.cumsum(sizes) - sizes
    return data[np.repeat(lo - heads, sizes) + np.arange(int(sizes.sum()))]


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number; zeros follow the last one."""
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    return np.ndarray(len(data) + 1, dtype="<u8", buffer=padded, strides=(1,))


def same(one: np.ndarray, lo: np.ndarray, two: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Are the bytes of ``one`` from ``lo`` on the bytes of ``two`` from ``at`` on; eight at a time."""
    left, right = _eights(one), _eights(two)
    equal = np.ones(len(sizes), dtype=bool)
    open_ = np.flatnonzero(sizes > 0)
    done = 0
    while len(open_):
        rest = np.minimum(sizes[open_] - done, 8)
        differ = (left[lo[open_] + done] ^ right[at[open_] + done]) << (8 * (8 - rest)).astype(np.uint64)
        equal[open_] = differ == 0
        open_ = open_[equal[open_] & (sizes[open_] > done + 8)]
        done += 8
    return equal


def groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, heads): places sorted by key, and where each key begins."""
    order = np.argsort(keys)
    ordered = keys[order]
    fresh = np.ones(len(keys), dtype=bool)
    fresh[1:] = ordered[1:] != ordered[:-1]
    return order, np.flatnonzero(fresh)


def binaries(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """An Arrow column of the stretches of ``data`` of these sizes."""
    offsets = np.zeros(len(sizes) + 1, dtype=np.int32)
    np.cumsum(sizes, out=offsets[1:])
    return pa.Array.from_buffers(
        pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))]
    )


def contents(column: pa.Array, dtype=np.uint8) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, sizes) of a binary column end to end; null counts as empty."""
    wide = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    kind = np.int64 if wide else np.int32
    _, offsets, raw = column.buffers()
    offsets = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, dtype=np.uint8)
    width = np.dtype(dtype).itemsize
    part = data[offsets[0] : offsets[-1]] if len(offsets) else data[:0]
    return np.frombuffer(part.tobytes(), dtype=dtype), np.diff(offsets) // width


def packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, size of each): numbers below 2**35 in bytes of seven bits, lowest first."""
    values = values.astype(np.uint64)
    sizes = np.ones(len(values), dtype=np.int64)
    for k in range(1, 5):
        sizes += values >= np.uint64(1 << 7 * k)
    heads = np.cumsum(sizes) - sizes
    out = np.zeros(int(sizes.sum()), dtype=np.uint8)
    for k in range(5):
        held = sizes > k
        low = (values[held] >> np.uint64(7 * k)) & np.uint64(127)
        more = (sizes[held] > k + 1).astype(np.uint64) << np.uint64(7)
        out[heads[held] + k] = low | more
    return out, sizes


def unpacked(data: np.ndarray) -> np.ndarray:
    """The numbers that ``packed`` wrote."""
    last = np.flatnonzero(data < 128)
    if len(last) == 0:
        return np.zeros(0, dtype=np.int64)
    heads = np.concatenate([[0], last[:-1] + 1])
    shift = np.arange(len(data)) - np.repeat(heads, last - heads + 1)
    return np.add.reduceat((data & 127).astype(np.int64) << (7 * shift), heads)
