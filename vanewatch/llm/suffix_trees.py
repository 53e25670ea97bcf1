"""Removal of word sequences that already start earlier, by prefix-partitioned suffix trees.

The contexts that :mod:`vanewatch.llm.repeats` deals to a task hold suffixes of documents, as
words. Suffixes are split by their first word; a group that is too large for memory is split
again by the next word, and so on, so prefixes are as long as they need to be. The subtree of
each group is then grown level by level: a node is a set of suffixes that agree so far, a suffix
alone in its node is a leaf and drops out. What stands together at the depth of a window is a
deep internal node, a repeat; all but its earliest suffix start earlier elsewhere.

Defined results: a null text has no words; a text shorter than the window keeps all words; rows
with equal ids are one document; a null id comes after all ids.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from vanewatch.llm.repeats import Rule, mark_repeats, shards
from vanewatch.llm.symbols import Sums, merged, owners, word_spans

WINDOW = 20
RULE = Rule(unit="words", window=WINDOW, gram=8, within=True)
#: Suffixes of one subtree.
GROUP_SUFFIXES = 1 << 18
#: Bytes of contexts that are taken up at once.
SHARD_BYTES = 1 << 21

WORDS = re.compile(rb"[^\x20\x09-\x0D]+")


def _split(node: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Children of nodes by the label of the next edge, numbered from 0."""
    return np.unique(node * (label.max() + 1) + label, return_inverse=True)[1]


def deep_nodes(words: np.ndarray, suffixes: np.ndarray, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(suffixes, node) of the subtrees' internal nodes at ``depth`` words.

    ``words`` are numbers below their own count, and each suffix has ``depth`` words at least.
    """
    waiting = [(suffixes, 0)]
    while waiting:
        group, known = waiting.pop()
        if known < depth and len(group) > GROUP_SUFFIXES:
            label = words[group + known]
            order = np.argsort(label, kind="stable")
            group, label = group[order], label[order]
            cuts = np.flatnonzero(np.concatenate([[True], label[1:] != label[:-1], [True]]))
            small = [c for c in range(len(cuts) - 1) if cuts[c + 1] - cuts[c] <= GROUP_SUFFIXES]
            for c in sorted(set(range(len(cuts) - 1)) - set(small)):
                waiting.append((group[cuts[c] : cuts[c + 1]], known + 1))
            held: list[np.ndarray] = []
            for c in small:
                held.append(group[cuts[c] : cuts[c + 1]])
                if sum(map(len, held)) > GROUP_SUFFIXES // 2:
                    yield from _grow(words, np.concatenate(held), known, depth)
                    held = []
            if held:
                yield from _grow(words, np.concatenate(held), known, depth)
        else:
            yield from _grow(words, group, known, depth)


def _grow(words, group, known, depth) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    node = np.zeros(len(group), dtype=np.int64)
    for level in range(known, depth):
        node = _split(node, words[group + level])
        together = np.bincount(node)[node] > 1
        group, node = group[together], node[together]
        if len(group) == 0:
            return
    if len(group) > 1:
        yield group, node


def settle(ids, keys, lo, data, offsets, anchor):
    """Repeated windows of the contexts of a task."""
    none = np.zeros(0, dtype=np.int64)
    which, begin = [none], [none]
    for a, b in shards(offsets, anchor, SHARD_BYTES):
        held, start = _repeated(
            ids[a:b], lo[a:b], data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        )
        which.append(held + a)
        begin.append(start)
    which, begin = np.concatenate(which), np.concatenate(begin)
    base = which << 32
    start, stop = merged(base + begin, base + begin + WINDOW)
    return start >> 32, start & 0xFFFFFFFF, stop - (start >> 32 << 32)


def _repeated(ids, lo, data, offsets) -> tuple[np.ndarray, np.ndarray]:
    """(context, first word in it) of windows that start earlier elsewhere."""
    starts, ends, firsts = word_spans(data, offsets)
    held = owners(firsts)
    words = np.unique(Sums(data).spans(starts, ends), return_inverse=True)[1].astype(np.int64)
    inside = np.arange(len(words)) - firsts[:-1][held]
    fits = np.arange(len(words)) + WINDOW <= firsts[1:][held]
    suffixes = np.flatnonzero(fits)
    which, begin = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    for group, node in deep_nodes(words, suffixes, WINDOW):
        doc, place = ids[held[group]], lo[held[group]] + inside[group]
        order = np.lexsort((place, doc, node))
        group, node, doc, place = group[order], node[order], doc[order], place[order]
        head = np.maximum.accumulate(
            np.where(np.concatenate([[True], node[1:] != node[:-1]]), np.arange(len(node)), 0)
        )
        later = (doc > doc[head]) | (place > place[head])
        which.append(held[group[later]])
        begin.append(inside[group[later]])
    return np.concatenate(which), np.concatenate(begin)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, removed, hashes = [], [], []
        for text, lo, hi in zip(*(batch.column(n).to_pylist() for n in ("text", "lo", "hi"))):
            words = WORDS.findall((text or "").encode())
            counts.append(len(words))
            if lo:
                kept, at = [], 0
                for a, b in zip(np.frombuffer(lo, dtype=np.int64), np.frombuffer(hi, dtype=np.int64)):
                    kept += words[at:a]
                    at = int(b)
                words = kept + words[at:]
            removed.append(counts[-1] - len(words))
            hashes.append(hashlib.sha256(b" ".join(words)).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()),
             pa.array(hashes, pa.string())],
            ["doc_id", "n_words", "n_removed", "kept_sha256"],
        )


def repeated_words(docs: DataFrame) -> DataFrame:
    """(doc_id, _id, _key, text, lo, hi): word stretches of each text that start earlier."""
    return mark_repeats(docs, RULE, settle)


def digest(docs: DataFrame) -> DataFrame:
    """What is left of each text: (doc_id, n_words, n_removed, kept_sha256)."""
    marked = repeated_words(docs).select("doc_id", "text", "lo", "hi")
    return marked.mapInArrow(
        _digest, "doc_id long, n_words long, n_removed long, kept_sha256 string"
    )
