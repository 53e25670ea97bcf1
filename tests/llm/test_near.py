"""Operator 10 against brute force."""

import random

import brute
import pytest

from vanewatch.llm import signatures
from vanewatch.llm.components import components

DOCS = "doc_id long, text string, rep string, n string"


def near(seed: int) -> list[tuple]:
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows, n = [], 0
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.randint(60, 200))]
        for _ in range(rng.randint(1, 9)):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3, 6, 12])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((n, " ".join(copy).upper() if rng.random() < 0.2 else " ".join(copy)))
            n += 1
    rows += [(900, None), (901, ""), (902, "  \n"), (903, "Only three words"), (904, "only three WORDS")]
    rng.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "clash", "clash") for d, t in rows], DOCS)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_components_match_brute_force(spark, seed):
    rows = near(seed)
    got = signatures.near_groups(frame(spark, rows)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute.near_components(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_links_past_the_first_leader(spark):
    """A chain whose least member is close to the next one only."""
    words = [f"v{i}" for i in range(300)]
    rows, text = [], list(words)
    for i in range(12):
        rows.append((i, " ".join(text)))
        for k in range(4):
            text[(i * 24 + k * 6) % 300] = f"new{i}-{k}"
    got = signatures.near_groups(frame(spark, rows)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute.near_components(rows)
    assert {r.component_id for r in got} == {0}


@pytest.mark.parametrize("seed", [4, 5])
def test_long_lists_lose_no_link(spark, seed):
    """Many near copies of one text; some are linked by edits they share, far from the centre."""
    rng = random.Random(seed)
    base = [f"b{i}" for i in range(110)]
    edits = [(rng.randrange(110), f"e{i}") for i in range(40)]
    rows = []
    for n in range(260):
        text = list(base)
        for at, word in rng.sample(edits, rng.choice([0, 1, 2, 3, 4, 5, 6])):
            text[at] = word
        for _ in range(rng.choice([0, 0, 1, 2])):
            text[rng.randrange(110)] = f"x{rng.randrange(500)}"
        if rng.random() < 0.2:
            text = text[: rng.randint(80, 105)]
        if rng.random() < 0.1:
            text += [f"y{n % 7}-{i}" for i in range(rng.randint(5, 60))]
        rows.append((n, " ".join(text)))
    got = signatures.near_groups(frame(spark, rows)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute.near_components(rows)


def test_null_ids_and_repeated_rows(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(None, text), (3, text), (3, text), (9, text)]
    got = sorted(
        (-1 if r.doc_id is None else r.doc_id, r.component_id, r.kept)
        for r in signatures.near_groups(frame(spark, rows)).collect()
    )
    assert got == [(-1, None, True), (3, 3, True), (3, 3, True), (9, 3, False)]


def test_every_text_of_an_id_links(spark):
    """Id 5 stands on two texts: copies of either, near or exact, are copies of the document."""
    one, two = (" ".join(f"{c}{i}" for i in range(60)) for c in "az")
    rows = [(5, one), (5, two), (7, two + " more"), (8, one + " more"), (3, two), (9, "another text of six words")]
    got = {r.doc_id: r.component_id for r in signatures.near_groups(frame(spark, rows)).collect()}
    assert got == {3: 3, 5: 3, 7: 3, 8: 3, 9: 9}


def test_empty_table(spark):
    assert signatures.near_groups(frame(spark, [])).count() == 0


@pytest.mark.parametrize("few", [0, 50_000])
def test_components_in_one_task_and_dealt_out(spark, few):
    rng = random.Random(few)
    pairs = [(rng.randrange(90), rng.randrange(90)) for _ in range(70)]
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long"), few_edges=few).collect()}
    least = {n: n for a, b in pairs if a != b for n in (a, b)}
    for _ in least:
        for a, b in pairs:
            if a != b:
                least[a] = least[b] = min(least[a], least[b])
    assert got == least


def test_members_differ_from_one_centre(spark, monkeypatch):
    """Long lists led from one component are posted under one leader, each member once."""
    rng = random.Random(6)
    base = [f"b{i}" for i in range(110)]
    edits = [(rng.randrange(110), f"e{i}") for i in range(30)]
    rows = []
    for n in range(400):
        text = list(base)
        for at, word in rng.sample(edits, rng.choice([0, 1, 2, 3, 4, 5, 6])):
            text[at] = word
        rows.append((n, " ".join(text)))
    seen, plain = [], signatures._posted_differences

    def spied(led, texts, percent):
        seen.append((led.count(), led.select("rep").distinct().count()))
        return plain(led, texts, percent)

    monkeypatch.setattr(signatures, "_posted_differences", spied)
    got = signatures.near_groups(frame(spark, rows)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute.near_components(rows)
    assert seen and seen[0][0] <= 2 * seen[0][1]


def test_lists_of_one_family_share_a_centre(spark, monkeypatch):
    """Long lists with common members are led from many components, but each member is posted once."""
    rng = random.Random(7)
    base = [f"b{i}" for i in range(110)]
    edits = [(rng.randrange(110), f"e{i}") for i in range(12)]
    rows = []
    for n in range(300):
        text = list(base)
        for at, word in rng.sample(edits, rng.choice([2, 3, 4, 5])):
            text[at] = word
        for _ in range(rng.choice([0, 1, 2, 3])):
            text[rng.randrange(110)] = f"x{rng.randrange(500)}"
        rows.append((n, " ".join(text)))
    seen, plain = [], signatures._posted_differences

    def spied(led, texts, percent):
        seen.append((led.count(), led.select("rep").distinct().count(), led.select("lead").distinct().count()))
        return plain(led, texts, percent)

    monkeypatch.setattr(signatures, "_posted_differences", spied)
    got = signatures.near_groups(frame(spark, rows)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute.near_components(rows)
    assert seen and seen[0][0] == seen[0][1]


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(60)] + [(100, 101)], "a long, b long")
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}
