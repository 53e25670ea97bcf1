"""Operators 8 and 9 against brute force."""

import random

import brute
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vanewatch.llm import suffix_arrays, suffix_trees
from vanewatch.llm.repeats import LAST_ID

DOCS = "doc_id long, text string, lo string, _key string"


def texts(seed: int) -> list[tuple]:
    """Texts with shared passages, copies, runs of one character, nulls and short ones."""
    rng = random.Random(seed)
    words = ["ab", "the", "Ön", "x", "of", "and", "lorem", "ipsum", "é", "q7"]
    make = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = [make(40) for _ in range(4)]
    rows = [(i, make(rng.randint(0, 60))) for i in range(20)]
    rows += [(20 + i, make(5) + " " + rng.choice(shared) + "\n" + make(9)) for i in range(15)]
    rows += [(35, None), (36, ""), (37, "-" * 300), (38, "-" * 180 + " end"), (39, " " * 80)]
    rows += [(40 + i, rows[rng.randint(0, 34)][1]) for i in range(5)]
    rows += [(50, shared[0] + " " + make(3) + " " + shared[0]), (51, "w " * 200), (52, "x" * 49)]
    rng.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "clash", "clash") for d, t in rows], DOCS)


@pytest.mark.parametrize("seed", [1, 2])
def test_bytes_match_brute_force(spark, seed):
    rows = texts(seed)
    got = {r[0]: tuple(r)[1:] for r in suffix_arrays.digest(frame(spark, rows).repartition(3)).collect()}
    assert got == brute.repeated_bytes(rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_words_match_brute_force(spark, seed):
    rows = texts(seed)
    got = {r[0]: tuple(r)[1:] for r in suffix_trees.digest(frame(spark, rows).repartition(3)).collect()}
    assert got == brute.repeated_words(rows)


def edited(seed: int) -> list[tuple]:
    """One passage in every text, cut, edited and surrounded in many ways, over few characters."""
    rng = random.Random(seed)
    signs = "ab" if seed % 2 else "abc d\n"
    make = lambda n: "".join(rng.choice(signs) for _ in range(n))
    passage = make(70) + " " + " ".join(make(3) for _ in range(30))
    rows = []
    for i in range(60):
        body = passage[rng.randint(0, 60) : len(passage) - rng.randint(0, 60)]
        for _ in range(rng.randint(0, 2)):
            at = rng.randrange(len(body))
            body = body[:at] + make(rng.randint(0, 2)) + body[at + rng.randint(0, 2) :]
        rows.append((i, make(rng.randint(0, 30)) + rng.choice(["", " "]) + body + make(rng.randint(0, 30))))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_passage_with_edits_matches_brute_force(spark, seed):
    rows = edited(seed)
    docs = frame(spark, rows).repartition(3)
    assert {r[0]: tuple(r)[1:] for r in suffix_arrays.digest(docs).collect()} == brute.repeated_bytes(rows)
    assert {r[0]: tuple(r)[1:] for r in suffix_trees.digest(docs).collect()} == brute.repeated_words(rows)


def test_null_and_repeated_ids(spark):
    text = "one two three four five six seven eight nine ten " * 3
    rows = [(None, text), (7, text), (7, text), (None, text + "more")]
    got = sorted((r.doc_id is None, r.n_removed) for r in suffix_arrays.digest(frame(spark, rows)).collect())
    size = len(text.encode())
    assert got == [(False, 0), (False, 0), (True, size), (True, size)]
    own = brute.repeated_words([(7, text)])[7][1]
    words = sorted((r.doc_id or LAST_ID, r.n_removed) for r in suffix_trees.digest(frame(spark, rows)).collect())
    assert words[:2] == [(7, own), (7, own)]
    assert [w for _, w in words[2:]] == [30, 30]


def test_empty_table(spark):
    assert suffix_arrays.digest(frame(spark, [])).count() == 0
    assert suffix_trees.digest(frame(spark, [])).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=120))
def test_suffix_array_and_common_prefixes(symbols):
    text = np.array([*symbols, 0], dtype=np.uint16)
    raw = bytes(text.astype(np.uint8))
    array = suffix_arrays.suffix_array(text)
    assert list(array) == sorted(range(len(raw)), key=lambda i: raw[i:])
    common = suffix_arrays.permuted_prefixes(text, array, np.zeros(len(text), bool), len(text) + 1)
    for before, here in zip(array[:-1], array[1:]):
        same = 0
        while raw[before + same : before + same + 1] == raw[here + same : here + same + 1] != b"":
            same += 1
        assert common[here] == same


def test_subtrees_are_split_by_longer_prefixes(monkeypatch):
    rng = np.random.default_rng(3)
    words = rng.integers(0, 3, 400)
    suffixes = np.arange(380)
    found = lambda: sorted(
        tuple(sorted(group[node == k])) for group, node in suffix_trees.deep_nodes(words, suffixes, 6)
        for k in np.unique(node)
    )
    whole = found()
    monkeypatch.setattr(suffix_trees, "GROUP_SUFFIXES", 8)
    assert found() == whole and whole
