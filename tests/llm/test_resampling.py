"""Operator 13 against plain code."""

import random
import re
import zlib
from collections import Counter

import pytest

import math
import hashlib

from vanewatch.llm import resampling

DOCS = "doc_id long, text string, score string, rank string, bucket string"


def plain(docs, target, buckets=10_000, least=20, percent=25):
    """Sorted rows (doc_id, n_features, weight, score, rank)."""
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

    def split(text):
        return word.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))

    def runs(words):
        return [zlib.crc32(f.encode()) % buckets for f in words + [f"{a} {b}" for a, b in zip(words, words[1:])]]

    corpus, wanted = Counter(), Counter()
    for _, text in docs:
        corpus.update(runs(split(text)))
    for text in target:
        wanted.update(runs(split(text)))
    s_all, t_all = sum(corpus.values()), sum(wanted.values())
    gain = [
        math.floor(1000 * math.log((wanted[b] + 1) * (s_all + buckets) / ((corpus[b] + 1) * (t_all + buckets))))
        for b in range(buckets)
    ]
    rows = []
    for doc, text in docs:
        words = split(text)
        own = runs(words)
        weight = sum(gain[b] for b in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"7:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append((doc, len(own), weight, score, len(words) >= least))
    able = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    size = percent * len(able) // 100
    out = [(*r[:4], i + 1 if i < size else None) for i, r in enumerate(able)]
    return sorted(out + [(*r[:4], None) for r in rows if not r[4]], key=str)


def corpus(seed: int):
    rng = random.Random(seed)
    words = ["Alpha", "beta", "GAMMA9", "déjà", "漢字", "x_y", "don't", "7", "Ω", "zed", "été\x00nul", "a\nb"]
    make = lambda n: " ".join(rng.choice(words) for _ in range(n))
    docs = [(i, make(rng.randint(0, 80))) for i in range(120)]
    docs += [(200, None), (201, ""), (202, "--- \n"), (None, make(30)), (None, make(40)), (7, docs[7][1]), (8, make(50))]
    docs += [(300 + i, docs[11][1]) for i in range(40)] + [(400, make(3000))]
    rng.shuffle(docs)
    return docs, [make(12) for _ in range(9)] + [None, ""]


def run(spark, docs, target):
    frame = spark.createDataFrame([(d, t, "clash", "clash", "clash") for d, t in docs], DOCS).repartition(3)
    bench = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(target)], "item_id long, text string, n string")
    got = resampling.resample(frame, bench)
    assert got.dtypes == [(c, "bigint") for c in ("doc_id", "n_features", "weight", "score", "rank")]
    return sorted(map(tuple, got.collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_scores_and_ranks_match_plain_code(spark, seed):
    docs, target = corpus(seed)
    assert run(spark, docs, target) == plain(docs, target)


def test_empty_tables(spark):
    assert run(spark, [], []) == []
    docs, target = corpus(3)
    assert run(spark, docs, []) == plain(docs, [])
    assert run(spark, [(1, None), (2, "few words")], target) == plain([(1, None), (2, "few words")], target)


def test_no_feature_crosses_documents():
    owner, hashes, words = resampling.features([b"One two", b"", b"three", b"four FIVE six"])
    assert words.tolist() == [2, 0, 1, 3]
    want = [(0, b"one"), (0, b"two"), (2, b"three"), (3, b"four"), (3, b"five"), (3, b"six"),
            (0, b"one two"), (3, b"four five"), (3, b"five six")]
    assert list(zip(owner, hashes)) == [(d, zlib.crc32(f)) for d, f in want]


def test_ties_of_score_go_to_the_smaller_id(spark, monkeypatch):
    monkeypatch.setattr(resampling, "draw", lambda doc_id, seed=7: 0)
    text = " ".join(f"w{i}" for i in range(25))
    rows = [(i, text) for i in (9, 4, 7, 1, 12, 30, 2, 5)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    gain = resampling.gains({}, {})
    scored = [r for b in resampling._score(gain, 7)(iter(frame.toArrow().to_batches())) for r in b.to_pylist()]
    assert {r["score"] for r in scored} == {0} and {r["n_words"] for r in scored} == {25}
