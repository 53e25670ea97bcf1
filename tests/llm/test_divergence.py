"""Operator 11 against plain code."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from vanewatch.llm import divergence, perfect_hash, ragged

DOCS = "doc_id long, text string, lang string, source string, slot string, n string"


def plain(rows, least):
    """Sorted rows (lang, source, part, item, value, rank)."""
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    held, counts, groups = Counter(), {}, set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        own = term.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        groups.add((lang, source))
        held.update((lang, t) for t in set(own))
        counts.setdefault((lang, source), Counter()).update(own)
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted(t for (a, t), n in held.items() if a == lang and n >= least)
        sources = sorted(s for a, s in groups if a == lang)
        p = {}
        for name, own in [*((s, counts[lang, s]) for s in sources), (None, sum((counts[lang, s] for s in sources), Counter()))]:
            n = sum(own[t] for t in kept)
            p[name] = {t: 1 + 10**9 * (own[t] + 5) // (n + 5 * len(kept)) for t in kept}
        for s in sources:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(p[s][t] - p[None][t], t) for t in kept if counts[lang, s][t] and p[s][t] > p[None][t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, 50)):
                ordered = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, v, i + 1) for i, (v, item) in enumerate(ordered)]
    return sorted(out)


def corpus(seed, n=400):
    rng = random.Random(seed)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)] + ["Été", "漢字", "don't", "X9y", "über"]
    rows = []
    for _ in range(n):
        lang, source = rng.choice(["en", "en", "de", None, "x"]), rng.choice(["a", "b", "Ä", "z9", None])
        k = rng.randint(0, 60)
        text = " ".join(words[min(int(rng.expovariate(0.03)), len(words) - 1)] for _ in range(k))
        rows.append((rng.choice([text, text, text.upper(), None]) if k else "", lang, source))
    rows += [("rare words only", "lone", "a"), ("", "lone", "b"), (None, "lone", None), ("once", "single", "s")]
    rows += [rows[5]] * 40
    return rows


def run(spark, rows, **options):
    frame = spark.createDataFrame([(i, *r, "clash", "clash") for i, r in enumerate(rows)], DOCS).repartition(3)
    got = divergence.audit(frame, **options)
    assert got.dtypes == [("lang", "string"), ("source", "string"), ("part", "string"), ("item", "string"),
                          ("value", "bigint"), ("rank", "int")]
    return sorted(map(tuple, got.collect()))


@pytest.mark.parametrize("seed", [1, 2])
def test_audit_matches_plain_code(spark, seed):
    rows = corpus(seed)
    assert run(spark, rows, least_docs=8) == plain(rows, 8)


def test_small_bounds_change_nothing(spark, monkeypatch):
    """Several rounds of broadcasts, many shards, arrays handed on early, many blocks of slots."""
    monkeypatch.setattr(perfect_hash, "SHARD_KEYS", 16)
    monkeypatch.setattr(divergence, "CELLS", 150)
    monkeypatch.setattr(divergence, "BLOCK_CELLS", 40)
    monkeypatch.setattr(divergence, "GATHERED", 50)
    rows = corpus(3)
    assert run(spark, rows, least_docs=8, broadcast_bytes=3000) == plain(rows, 8)


def test_no_kept_terms_and_empty_table(spark):
    rows = [("a b", "en", "s1"), ("c", "en", "s2"), (None, None, None)]
    assert run(spark, rows) == [("en", "s1", "pair", "s2", 0, 1), ("en", "s2", "pair", "s1", 0, 1)]
    assert run(spark, []) == []


def test_very_long_texts(spark):
    rows = [("word other " * 60_000, "en", "a"), ("word", "en", "b"), ("other " * 9, "en", "b")]
    assert run(spark, rows, least_docs=1) == plain(rows, 1)


@pytest.mark.parametrize("n", [1, 2, 3, 50, 4096])
def test_perfect_hash_fills_every_slot(n):
    keys = [f"key{i}é".encode() for i in range(n)]
    data = np.frombuffer(b"".join(keys), dtype=np.uint8)
    sizes = np.array([len(k) for k in keys])
    lo = np.cumsum(sizes) - sizes
    h = perfect_hash.hashes(data, lo, lo + sizes, 0)
    moves, size = perfect_hash.build(h), np.array([n])
    slots = perfect_hash._slots(h, moves[perfect_hash._buckets(h, size)], size)
    assert sorted(slots) == list(range(n))
    order = np.argsort(slots)
    index = perfect_hash.Index([{
        "shard": 0, "displacements": moves.astype(np.int32).tobytes(), "key_sizes": sizes[order].astype(np.int32).tobytes(),
        "keys": ragged.gather(data, lo[order], sizes[order]).tobytes(),
    }], 1)
    assert [index.keys[a : a + s].tobytes() for a, s in zip(index.lo, index.sizes)] == [keys[k] for k in order]
    assert (index.find(data, lo, lo + sizes, h) == slots).all()
    others = np.frombuffer(b"".join(k.replace(b"k", b"K") for k in keys), dtype=np.uint8)
    assert (index.find(others, lo, lo + sizes, perfect_hash.hashes(others, lo, lo + sizes, 0)) == -1).all()
    assert (index.find(others, lo, lo + sizes, h) == -1).all()


def test_equal_hashes_are_noticed():
    assert perfect_hash.build(np.array([5, 7, 5], dtype=np.uint64)) is None
