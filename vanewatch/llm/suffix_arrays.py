"""Removal of byte strings that already start in an earlier document, by suffix arrays.

The contexts that :mod:`vanewatch.llm.repeats` deals to a task are joined to shards. Each shard
gets a suffix array by induced sorting: suffixes are classified, the leftmost-smaller substrings
are sorted by a first induction and named, the row of names is ordered, and a second induction
gives the array. All steps are array passes over one byte value at a time. Names are too many
for that, so their row is ordered by doubling. Permuted common
prefixes are measured at irreducible places only; the others follow from their left neighbour.
Neighbours in the array that agree over a whole window form a group, and windows of a group whose
smallest document is not their own are repeats.

Defined results: a null text is empty; a text shorter than the window keeps all bytes; rows
with equal ids are one document and never repeats of each other; a null id comes after all ids.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vanewatch.llm.repeats import Rule, mark_repeats, shards
from vanewatch.llm.symbols import Sums, merged

WINDOW = 50
RULE = Rule(unit="bytes", window=WINDOW, gram=16, within=False)
#: Bytes of contexts in one suffix array; the contexts of one anchor stay together.
SHARD_BYTES = 1 << 21


def _starts_smaller(text: np.ndarray) -> np.ndarray:
    """Is each suffix smaller than the one to its right; the last one is, by convention."""
    n = len(text)
    out = np.ones(n, dtype=bool)
    differ = np.where(text[:-1] != text[1:], np.arange(n - 1), n - 1)
    nearest = np.minimum.accumulate(differ[::-1])[::-1]
    out[:-1] = text[nearest] < text[np.minimum(nearest + 1, n - 1)]
    out[:-1] |= nearest == n - 1
    return out


def _place(array, ends, values, buckets, step: int) -> None:
    """Put ``values`` in turn at the open end of their buckets; ``step`` is the direction."""
    order = np.argsort(buckets, kind="stable")
    ranked = buckets[order]
    counts = np.bincount(ranked, minlength=len(ends))
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])
    array[ends[ranked] + step * (np.arange(len(ranked)) - first[ranked])] = values[order]
    ends += step * counts


def _induce(text: np.ndarray, smaller: np.ndarray, seeds: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Order of all suffixes, given the leftmost-smaller ones in order."""
    n = len(text)
    array = np.full(n, -1, dtype=np.int64)
    begin = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64)
    end = begin + counts
    heads = begin.copy()
    seeds_of = np.searchsorted(text[seeds].astype(np.int64), np.arange(len(counts) + 1))

    def larger_before(suffixes):
        left = suffixes - 1
        left = left[left >= 0]
        return left[~smaller[left]]

    for c in np.flatnonzero(counts):
        done = begin[c]
        while done < heads[c]:  # grows while equal symbols follow one another
            upto = heads[c]
            left = larger_before(array[done:upto])
            _place(array, heads, left, text[left], 1)
            done = upto
        left = larger_before(seeds[seeds_of[c] : seeds_of[c + 1]])
        _place(array, heads, left, text[left], 1)
    larger_end = heads
    tails = end - 1
    array[tails[text[n - 1]]] = n - 1  # nothing to its right could place the last suffix
    tails[text[n - 1]] -= 1
    for c in np.flatnonzero(counts)[::-1]:
        done = end[c] - 1
        while done > tails[c]:
            upto = tails[c]
            block = array[upto + 1 : done + 1][::-1]
            left = block - 1
            left = left[left >= 0]
            left = left[smaller[left]]
            _place(array, tails, left, text[left], -1)
            done = upto
        block = array[begin[c] : larger_end[c]][::-1]
        left = block - 1
        left = left[left >= 0]
        left = left[smaller[left]]
        _place(array, tails, left, text[left], -1)
    return array


def _order_names(names: np.ndarray) -> np.ndarray:
    """Order of the suffixes of a row of names, by doubling the reach until all differ."""
    rank, reach, n = names.astype(np.int64), 1, len(names)
    while reach < n:
        follow = np.zeros(n, dtype=np.int64)
        follow[: n - reach] = rank[reach:] + 1
        found, rank = np.unique(rank * (n + 2) + follow, return_inverse=True)
        if len(found) == n:
            break
        reach *= 2
    return np.argsort(rank, kind="stable")


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix array of small non-negative symbols; the last one must be a lone least symbol."""
    n = len(text)
    smaller = _starts_smaller(text)
    counts = np.bincount(text).astype(np.int64)
    leftmost = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    if len(leftmost) < 2:
        return _induce(text, smaller, leftmost if len(leftmost) else np.array([n - 1]), counts)
    first = _induce(text, smaller, leftmost[np.argsort(text[leftmost], kind="stable")], counts)
    is_left = np.zeros(n, dtype=bool)
    is_left[leftmost] = True
    ranked = first[is_left[first]]
    # a leftmost-smaller substring reaches up to and into the next one
    stop = np.empty(n, dtype=np.int64)
    stop[leftmost] = np.minimum(np.append(leftmost[1:], n - 1) + 1, n)
    hashes = Sums(text).spans(ranked, stop[ranked])
    name = np.empty(n, dtype=np.int64)
    name[ranked] = np.cumsum(np.concatenate([[0], (hashes[1:] != hashes[:-1]).astype(np.int64)]))
    row = name[leftmost]
    order = np.argsort(row) if row.max() + 1 == len(row) else _order_names(row)
    return _induce(text, smaller, leftmost[order], counts)


def permuted_prefixes(text: np.ndarray, array: np.ndarray, fresh: np.ndarray, most: int) -> np.ndarray:
    """Length that each suffix shares with the one before it in the array, up to ``most``.

    Measured where the symbols to the left differ, and at ``fresh`` places; elsewhere it is one
    less than at the left neighbour. ``most`` must exceed what a stretch between fresh places needs.
    """
    n = len(text)
    before = np.empty(n, dtype=np.int64)
    before[array[1:]] = array[:-1]
    before[array[0]] = -1
    differs = np.ones(n, dtype=bool)
    differs[1:] = (before[1:] <= 0) | (text[:-1] != text[np.maximum(before[1:] - 1, 0)])
    at = np.flatnonzero((differs | fresh) & (before >= 0))
    other, length = before[at], np.zeros(len(at), dtype=np.int64)
    sums = Sums(text)
    step = 1 << (most.bit_length() - 1)
    while step:
        reach = length + step
        open_ = np.flatnonzero(np.maximum(at, other) + reach <= n)
        a, b, r = at[open_] + length[open_], other[open_] + length[open_], step
        same = sums.spans(a, a + r) == sums.spans(b, b + r)
        length[open_[same]] += step
        step >>= 1
    shared = np.full(n, 0, dtype=np.int64)
    shared[at] = length + at
    return np.maximum(np.maximum.accumulate(shared) - np.arange(n), 0)


def repeated_windows(
    data: np.ndarray, offsets: np.ndarray, rank: np.ndarray, window: int
) -> tuple[np.ndarray, np.ndarray]:
    """(context, start in it) of windows that also stand in a context of smaller ``rank``."""
    sizes = np.diff(offsets)
    # every context is followed by a least symbol, the last one by two
    text = np.zeros(len(data) + len(sizes) + 1, dtype=np.uint16)
    begins = offsets[:-1] + np.arange(len(sizes))
    owner = np.repeat(np.arange(len(sizes)), sizes)
    text[np.arange(len(data)) + owner] = data.astype(np.uint16) + 2
    separators = begins + sizes
    text[separators] = 1
    array = suffix_array(text)
    fresh = np.zeros(len(text), dtype=bool)
    fresh[begins] = True
    longest = int(sizes.max()) if len(sizes) else 0
    common = permuted_prefixes(text, array, fresh, 2 * longest + 2)[array]
    edge = np.concatenate([[True], common[1:] < window])
    group = np.cumsum(edge) - 1
    heads = np.flatnonzero(edge)
    sizes_of = np.diff(np.append(heads, len(array)))
    many = sizes_of[group] > 1
    start, parts = array[many], group[many]
    held = np.searchsorted(begins, start, side="right") - 1
    whole = start + window <= separators[held]
    start, parts, held = start[whole], parts[whole], held[whole]
    ranks = rank[held]
    cut = np.flatnonzero(np.concatenate([[True], parts[1:] != parts[:-1]])) if len(parts) else parts
    if len(parts) == 0:
        return parts, parts
    least = np.minimum.reduceat(ranks, cut)
    later = ranks > np.repeat(least, np.diff(np.append(cut, len(parts))))
    return held[later], start[later] - begins[held[later]]


def settle(ids, keys, lo, data, offsets, anchor):
    """Repeated windows of the contexts of a task, one suffix array per shard."""
    none = np.zeros(0, dtype=np.int64)
    which, begin = [none], [none]
    for a, b in shards(offsets, anchor, SHARD_BYTES):
        held, start = repeated_windows(
            data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], ids[a:b], WINDOW
        )
        which.append(held + a)
        begin.append(start)
    which, begin = np.concatenate(which), np.concatenate(begin)
    base = which << 32
    start, stop = merged(base + begin, base + begin + WINDOW)
    return start >> 32, start & 0xFFFFFFFF, stop - (start >> 32 << 32)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: dict[str, list] = {n: [] for n in ("n_bytes", "n_removed", "n_spans", "kept_sha256")}
        for text, lo, hi in zip(*(batch.column(n).to_pylist() for n in ("text", "lo", "hi"))):
            raw = (text or "").encode()
            starts = np.frombuffer(lo, dtype=np.int64) if lo else []
            stops = np.frombuffer(hi, dtype=np.int64) if hi else []
            kept, at = [], 0
            for a, b in zip(starts, stops):
                kept.append(raw[at:a])
                at = int(b)
            kept.append(raw[at:])
            rest = b"".join(kept)
            out["n_bytes"].append(len(raw))
            out["n_removed"].append(len(raw) - len(rest))
            out["n_spans"].append(len(starts))
            out["kept_sha256"].append(hashlib.sha256(rest).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array(v, pa.int64() if n != "kept_sha256" else pa.string())
                                       for n, v in out.items())],
            ["doc_id", *out],
        )


def repeated_bytes(docs: DataFrame) -> DataFrame:
    """(doc_id, _id, _key, text, lo, hi): byte stretches of each text that start earlier."""
    return mark_repeats(docs, RULE, settle)


def digest(docs: DataFrame) -> DataFrame:
    """What is left of each text: (doc_id, n_bytes, n_removed, n_spans, kept_sha256)."""
    marked = repeated_bytes(docs).select("doc_id", F.col("text"), "lo", "hi")
    return marked.mapInArrow(
        _digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    )
