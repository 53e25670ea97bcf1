"""Plain single-threaded versions of the operators, for comparison on small tables."""

from __future__ import annotations

import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def repeated_bytes(rows, window=50):
    """doc_id -> (n_bytes, n_removed, n_spans, sha256) for rows of (doc_id, text)."""
    first = {}
    for doc, text in rows:
        raw = (text or "").encode()
        for i in range(len(raw) - window + 1):
            key = raw[i : i + window]
            first[key] = min(first.get(key, doc), doc)
    out = {}
    for doc, text in rows:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - window + 1):
            if first[raw[i : i + window]] < doc:
                gone[i : i + window] = b"\1" * window
        spans = len(re.findall(b"\1+", bytes(gone)))
        rest = bytes(b for b, g in zip(raw, gone) if not g)
        out[doc] = (len(raw), sum(gone), spans, hashlib.sha256(rest).hexdigest())
    return out


def repeated_words(rows, window=20):
    """doc_id -> (n_words, n_removed, sha256) for rows of (doc_id, text)."""
    split = [(doc, WORD.findall(text or "")) for doc, text in rows]
    first = {}
    for doc, words in split:
        for i in range(len(words) - window + 1):
            key = tuple(words[i : i + window])
            first[key] = min(first.get(key, (doc, i)), (doc, i))
    out = {}
    for doc, words in split:
        gone = [False] * len(words)
        for i in range(len(words) - window + 1):
            if first[tuple(words[i : i + window])] < (doc, i):
                gone[i : i + window] = [True] * window
        rest = " ".join(w for w, g in zip(words, gone) if not g)
        out[doc] = (len(words), sum(gone), hashlib.sha256(rest.encode()).hexdigest())
    return out


def shingle_set(text, n=5):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lower)
    if not words:
        return frozenset()
    if len(words) < n:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1))


def near_components(rows, percent=85):
    """doc_id -> (n_shingles, component) by comparing all pairs that share a shingle."""
    sets = {doc: shingle_set(text) for doc, text in rows}
    root = {doc: doc for doc in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = {}
    for doc, own in sets.items():
        for s in own:
            holders.setdefault(s, []).append(doc)
    seen = set()
    for docs in holders.values():
        for i, a in enumerate(docs):
            for b in docs[:i]:
                if (a, b) in seen or find(a) == find(b):
                    continue
                seen.add((a, b))
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    return {doc: (len(own), find(doc)) for doc, own in sets.items()}
