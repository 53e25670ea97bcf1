"""Operators 1 to 7: defined results on awkward input, and figures against plain code."""

import random
import re

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from vanewatch.llm import benchmark, chat, html, language, lines, mixing, quality

WORD = brute.WORD


# --- 1: benchmark decontamination

ITEMS = [
    (1, "A train with 12 coaches leaves Paris at 9 and reaches Lyon after 4 hours of travel time."),
    (2, "The committee of the harbour town decided in spring that every lamp must be painted green."),
    (3, "too short"), (4, None), (5, "Four plain little words"),
]


def contaminated(spark, rows, items=ITEMS, **options):
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, row string, hash string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = benchmark.contamination(docs, bench, **options)
    assert got.columns == ["doc_id", "text", "row", "hash", "contaminated", "item_ids"]
    return {r.doc_id: list(r.item_ids) for r in got.collect()}


LEAKS = [
    (10, "Words before. " + ITEMS[0][1] + " Words after."),
    (11, "Note: a train with 30 coaches leaves Berlin at 7 and reaches Bonn after 5 hours of travel time."),
    (12, "the committee of the HARBOUR town decided, in spring, that every lamp must be painted green"),
    (13, "Nothing of the kind is found in this text about trains, towns and lamps."),
    (14, None), (15, ""), (16, "Well, four plain little words, then."),
]


def test_leaks_with_other_values_are_found(spark):
    want = {10: [1], 11: [1], 12: [2], 13: [], 14: [], 15: [], 16: [5]}
    assert contaminated(spark, LEAKS) == want


def test_every_window_may_go_to_the_join(spark):
    assert contaminated(spark, LEAKS, filter_bytes=0) == contaminated(spark, LEAKS)


def test_inconsistent_values_are_no_leak(spark):
    item = [(1, "Add 3 and 5 then take 3 from the sum and add 5 again to what is left over now")]
    same = (1, "Add 8 and 2 then take 8 from the sum and add 2 again to what is left over now")
    other = (2, "Add 8 and 2 then take 9 from the sum and add 4 again to what is left over now")
    assert contaminated(spark, [same, other], item) == {1: [1], 2: []}


def test_word_for_word_copies_are_found_whatever_they_hold(spark):
    titles = "THE OLD MAN AND THE SEA IS A SHORT NOVEL"
    names = "Anna 12 Bert 15 Carl 19 Dora 23 Emil 30"
    lower = "which of the planets has the most moons of all"
    han = "下列哪一项是光合作用的主要产物？"
    items = [(1, titles), (2, names), (3, lower), (4, han), (5, "ราคาของแอปเปิล")]
    rows = [(1, f"He wrote {titles} in capitals"), (2, f"so it was: {names} and no more"), (3, f"Quiz. {lower.upper()} Well."),
            (4, f"问题：{han}答案是氧气。"), (5, "ถามว่าราคาของแอปเปิลเท่าไร"), (6, "他们今天去了学校。"), (7, "An old man at sea")]
    assert contaminated(spark, rows, items) == {**{i: [i] for i in range(1, 6)}, 6: [], 7: []}


def test_words_after_a_break_have_both_forms(spark):
    items = [(1, "Name the largest known planet."), (2, "Alice bought 12 red apples yesterday."),
             (3, "Tom has 5 apples left. Ann has 3 pears left. Max has 8 plums left. Eve has 2 figs left."),
             (4, "If it snows, wait. Kim sold 4 hats")]
    rows = [(10 + i, text) for i, text in enumerate((
        "(Q1) Name the largest known planet.", "Well, Name the largest known planet.", "Quiz - Name the largest known planet.",
        "he said \"Name the largest known planet.\"", "Please name the largest known planet.", "Name the largest known planet."))]
    rows += [(20, "Bob bought 9 red apples yesterday."), (21, "It rained. Bob bought 9 red apples yesterday."),
             (22, "and then Bob bought 9 red apples yesterday."),
             (30, "Pia has 6 apples left. Joe has 4 pears left. Ida has 9 plums left. Ulf has 3 figs left."),
             (40, "so if it snows, wait. Lea sold 7 hats"), (50, "The largest known planet is far away.")]
    want = {r[0]: [r[0] // 10] for r in rows if r[0] < 50} | {50: []}
    assert contaminated(spark, rows, items) == want


def test_one_changed_value_does_not_clear_a_copy(spark):
    words = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(100)]
    words[10], words[95] = "5", "5"
    copied = " ".join(words)
    words[95] = "6"
    assert contaminated(spark, [(1, " ".join(words))], [(1, copied)]) == {1: [1]}
    item = [(1, "take 3 of the red pears and 3 of the green pears and then 3 of the blue pears and stop there")]
    other = "take 7 of the red pears and 7 of the green pears and then 8 of the blue pears and stop there"
    assert contaminated(spark, [(1, other)], item) == {1: [1]}


def test_empty_tables(spark):
    assert contaminated(spark, [(1, "some text")], [(1, None)]) == {1: []}
    none = spark.createDataFrame([], "doc_id long, text string")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert benchmark.contamination(none, bench).count() == 0


# --- 2: lines

def line_docs(spark, rows):
    return spark.createDataFrame(
        [(*r, "clash") for r in rows], "doc_id long, source string, text string, _hash string"
    )


def test_shared_lines_go_but_the_first_stays(spark):
    rows = [(i, f"site{i % 9}", f"Own text of page {i} here\n  ACCEPT our cookies please \nend") for i in range(18)]
    rows += [(100, None, "accept our cookies please"), (101, "site1", None), (102, "site2", ""),
             (None, "site3", "x\nAccept our cookies please")]
    out = {r.doc_id: r for r in lines.drop_shared_lines(line_docs(spark, rows)).collect()}
    assert out[0].text == rows[0][2] and out[0].n_removed == 0
    assert out[1].text == "Own text of page 1 here\nend" and (out[1].n_lines, out[1].n_removed) == (3, 1)
    assert out[100].text == "" and out[101].text is None and out[102].text == ""
    assert out[None].text == "x"
    assert out[101].n_lines == 0 and out[102].n_lines == 1


def test_lines_below_the_limit_stay(spark):
    rows = [(i, f"site{i % 7}", "the same line everywhere") for i in range(70)]
    assert lines.drop_shared_lines(line_docs(spark, rows)).where("n_removed > 0").count() == 0
    rows.append((99, "site8", "the same line everywhere"))
    assert lines.drop_shared_lines(line_docs(spark, rows)).where("n_removed > 0").count() == 70
    assert lines.drop_shared_lines(line_docs(spark, [])).count() == 0


# --- 3: quality

def plain_figures(text):
    text = text or ""
    words = WORD.findall(text)
    lines_ = [x for x in text.split("\n") if WORD.search(x)]
    seen, dup = set(), 0
    for x in lines_:
        dup += x in seen
        seen.add(x)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered))


def test_figures_match_plain_code(spark):
    rng = random.Random(4)
    words = ["a", "bé", "c#", "|", "dd", "\n", "e\n", "  ", "ff\t", "ß%"]
    rows = [(i, "s", " ".join(rng.choice(words) for _ in range(rng.randint(0, 60)))) for i in range(60)]
    rows += [(60, None, None), (61, "s", ""), (62, "s", "\n\n"), (63, "s", "x\nx\nx"), (63, "s", "x\nx\nx")]
    got = quality.judge(line_docs(spark, rows)).collect()
    assert len(got) == len(rows)
    by_id = {r[0]: r[2] for r in rows}
    for r in got:
        assert tuple(r)[1:6] == plain_figures(by_id[r.doc_id]), by_id[r.doc_id]
        n, rep = r.n_words, r.n_repeat_words
        assert r.base_failed == (n < 10 or 100 * rep > 20 * n)
    assert quality.judge(line_docs(spark, [])).count() == 0


def test_common_lines_deplete(spark):
    own = lambda i: " ".join(f"own{i}w{k}" for k in range(12))
    common = "this very line stands on every single page of the host again and again and so on for ever and ever"
    rows = [(i, "h", f"{common}\nx{i}") for i in range(30)] + [(99, "h", f"{common}\n{own(1)} {own(2)}")]
    rows += [(200 + i, "other", f"{common}\n{own(i)}") for i in range(3)]
    got = {r.doc_id: r for r in quality.judge(line_docs(spark, rows), min_docs=10).collect()}
    assert not got[0].kept and got[0].removed_words == 21
    assert got[99].kept and got[200].kept and got[200].removed_words == 0


def test_copies_under_many_ids_are_documents(spark):
    page = "this page stands under many ids of one host\nand all of its lines are the same as ever"
    rows = [(i, "h", page) for i in range(20)] * 2 + [(50, "few", page)] * 20 + [(None, "few", page)] * 20
    got = quality.judge(line_docs(spark, rows), min_docs=10).collect()
    assert len(got) == len(rows)
    assert {(r.doc_id is not None and r.doc_id < 20, r.kept, r.removed_words) for r in got} == {
        (True, False, 19), (False, True, 0)
    }


# --- 4: chat

TURNS = "conv_id long, turn long, role string, text string, speaker string, part string"


def test_each_speaker_in_turn(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "ann", "Hi"), (1, 2, "bob", "Hello"), (1, 3, None, "?"),
            (1, None, "ann", None), (2, 0, "system", "alone"), (None, 5, "eve", "lost"), (None, 6, " ", "x")]
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], TURNS)
    got = {(r.conv_id, r.speaker, r.part): r for r in chat.rotate_perspectives(df).collect()}
    assert set(got) == {(1, "ann", 0), (1, "bob", 0), (None, "eve", 0)}
    ann = got[1, "ann", 0]
    assert ann.text == (
        "<|im_start|>system\nBe kind.<|im_end|>\n<|im_start|>assistant\nHi<|im_end|>\n"
        "<|im_start|>user name=bob\nHello<|im_end|>\n<|im_start|>user name=unknown\n?<|im_end|>\n"
        "<|im_start|>assistant\n<|im_end|>\n"
    )
    at, trained = 0, ""
    for run in ann.mask:
        trained += ann.text[at : at + run.chars] if run.trained else ""
        at += run.chars
    assert at == len(ann.text) and trained == "Hi<|im_end|><|im_end|>"
    assert (ann.n_turns, ann.n_trained) == (5, 2)
    assert chat.rotate_perspectives(df.limit(0)).count() == 0
    assert {r.n_turns for r in chat.rotate_perspectives(df, system=()).where("conv_id = 1").collect()} == {5}


def plain_parts(rows, size):
    """(conv, speaker, part) -> (n_turns, n_trained, text) of rows (conv, turn, role, text)."""
    convs, out = {}, {}
    for row in rows:
        convs.setdefault(row[0], []).append(row)
    for conv, turns in convs.items():
        turns.sort(key=lambda r: (r[1] is None, r[1] or 0, r[2] is None, r[2] or "", r[3]))
        for speaker in {r[2] for r in turns} - {None, "system"}:
            for part in range(-(-len(turns) // size)):
                held = [r[2:4] for r in turns[part * size : (part + 1) * size]]
                scenes = [r[2:4] for r in turns[: part * size] if r[2] == "system"]
                held = scenes[-1:] + held
                text = ""
                for role, said in held:
                    name = "assistant" if role == speaker else "system" if role == "system" else f"user name={role or 'unknown'}"
                    text += f"<|im_start|>{name}\n{said}<|im_end|>\n"
                out[conv, speaker, part] = (len(held), sum(role == speaker for role, _ in held), text)
    return out


def test_parts_are_runs_in_order_with_their_setting(spark, monkeypatch):
    monkeypatch.setattr(chat, "PART_TURNS", 10)
    rng = random.Random(4)
    roles = ["a", "b", "b", "system", None]
    rows = [(rng.choice([1, 1, None]), rng.choice([None, 0, 1, 300, 300, 7000]), rng.choice(roles), f"t{i // 3}")
            for i in range(400)]
    rows += [(2, 300 * i, "ab"[i % 2], f"sparse {i}") for i in range(12)] + [(3, 0, "a", "same")] * 25
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], TURNS).repartition(7)
    got = {(r.conv_id, r.speaker, r.part): (r.n_turns, r.n_trained, r.text) for r in chat.rotate_perspectives(df).collect()}
    assert got == plain_parts(rows, 10)


# --- 5: mixing

def test_targets_and_copies(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice(["a", "b", "c", "d", None]), " ".join(["w"] * rng.randint(0, 60))) for i in range(3000)]
    rows += [(3000 + i, "tiny", "w w") for i in range(4)] + [(None, "a", None), (None, "b", "w"), (5, "a", "w")]
    got = mixing.mix(line_docs(spark, rows)).collect()
    assert len(got) == len(rows)
    sizes, targets, taken = {}, {}, {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r["size"]
        targets[r.source] = r.target
        taken[r.source] = taken.get(r.source, 0) + r.taken
        assert r.taken <= 3 * r["size"]
    order = sorted([s for s in sizes if s is not None]) + [None]
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    want, free, total = {}, set(order), sum(sizes.values())
    while True:
        level = (total - sum(want.values())) / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 3 * sizes[s]}
        if not over:
            break
        want |= {s: 3 * sizes[s] for s in over}
        free -= over
    want |= {s: level * weight[s] for s in free}
    assert targets == pytest.approx(want)
    for s in order:
        assert abs(taken[s] - want[s]) <= 0.02 * want[s] + 60
    again = mixing.mix(line_docs(spark, rows).repartition(7)).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got))


def test_mix_emits_as_drawn(spark):
    rows = [(i, f"s{i % 3}", "w " * (i % 40)) for i in range(400)] + [(7, "s1", "w " * 7)] * 3
    docs = line_docs(spark, rows)
    drawn = mixing.mix(docs).agg(F.sum("copies"), F.sum("taken")).first()
    out = mixing.mixed_documents(docs)
    assert out.columns == [*docs.columns, "copy"]
    emitted = out.select(F.count(F.lit(1)), F.sum(F.size(F.expr("filter(split(text, ' '), x -> x <> '')")))).first()
    assert tuple(drawn) == tuple(emitted)
    assert mixing.mix(line_docs(spark, [])).count() == 0


# --- 6: pages

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body>
<nav><a href="/">Home</a></nav><div class="cookie-notice">We use <b>cookies</b></div>
<header><h2>Site name</h2></header><div id="sidebar"><p>Other stories to read</p></div>
<article><h1>Head &amp; line</h1><script>var t="</p><p>not text";</script>
<p>First   <i>para</i>graph &#233;t&eacute; is long enough<br>to read on.</p>
<!-- <p>hidden</p> --><form><p>Your name</p></form><div class="ad">Buy now</div>
<p title="a > b">Second paragraph of the article.<p>Third one, never closed.
<aside>Related things</aside><section class="comments"><p>I disagree with all</p></section></article>
<footer>&copy; someone</footer></body></html>"""
TEXT = ("Head & line\nFirst paragraph été is long enough to read on.\n"
        "Second paragraph of the article.\nThird one, never closed.")


def test_article_text(spark):
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "<p>"), (5, "u", "<nav>menu</nav>"), (None, "u", PAGE)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in html.extract(df).collect()}
    assert got[1].text == got[None].text == TEXT and got[1].n_chars == len(TEXT)
    assert {i: got[i].text for i in (2, 3, 4, 5)} == {2: "", 3: "", 4: "", 5: ""}
    assert html.extract(df.limit(0)).count() == 0


@pytest.mark.parametrize("page, want", [
    ("<div class='content no-sidebar has-ads'><article><p>The whole story is here.</article></div>", "The whole story is here."),
    ("<div class='sidebar-layout'><p>The whole story is here.</div><div class='ad'>Buy</div>", "The whole story is here."),
    ("<div id='social'><main><p>The whole story is here.</main></div><div class='comments'><article class='comment'>No, it is not here at all I say</article></div>",
     "The whole story is here."),
    ("<head><title>T</title><body><article>The whole story is here.</article>", "The whole story is here."),
    ("<head><meta charset=x><title>T</title><p>The whole story is here.", "The whole story is here."),
    ("<body><p class='notice'>Note<p>First one<p>Second one", "First one\nSecond one"),
    ("<body><p title='a class=ad here' data-hidden=x>The whole story is here.", "The whole story is here."),
    ("<body><p>The whole story is here.<div hidden>not</div><div class=ad>Buy</div>", "The whole story is here."),
])
def test_wrappers_and_open_tags_keep_the_article(page, want):
    assert html.main_text(page, {}) == want


def test_best_run_is_the_maximum():
    costs = {"p": 2.0, "td": 3.0}
    rng = random.Random(6)
    for _ in range(50):
        parts = [rng.choice(["<p>", "</p>", "<td>", "</td>", "one two", "w", "a b c d"]) for _ in range(14)]
        tokens = [(k, v) for k, v, _ in html.tokens(" ".join(parts))]
        scores = [len(v.split()) if k == "text" else -costs[v] for k, v in tokens]
        best = max([0] + [sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)])
        text = html.main_text(" ".join(parts), costs)
        words = [w for k, v in tokens if k == "text" for w in v.split()]
        assert (best == 0) == (text == "") and len(text.split()) <= len(words)
        assert len(text.split()) >= best


# --- 7: language

def test_forward_sums_all_segmentations():
    pieces = language.pieces_of(["▁a", "▁ab", "b", "ab", "a", "▁", "ba", "▁aba"])
    rng = np.random.default_rng(7)
    chances = rng.random((pieces.count + 1, 2))
    numbers = {}
    for p in ["▁a", "▁ab", "b", "ab", "a", "ba", "▁aba"]:
        spot = np.searchsorted(pieces.hashes, language._hash(np.array([ord(c) for c in p], dtype=np.uint32)))
        numbers[p] = int(pieces.numbers[spot])

    def total(rest, k):
        if not rest:
            return 1.0
        out = sum(chances[n, k] * total(rest[len(p):], k) for p, n in numbers.items() if rest.startswith(p))
        if rest[0] not in numbers:  # a letter of no piece
            out += chances[pieces.count, k] * total(rest[1:], k)
        return out

    words = ["ab", "aba", "b", "abab", "xa"]
    got = language.Lattice(pieces, words).log_chances(chances, len(words))
    for i, word in enumerate(words):
        for k in range(2):
            assert np.exp(got[i, k]) == pytest.approx(total("▁" + word, k))
    weights = np.ones((len(words), 2))
    counts = language.Lattice(pieces, words).expected(chances, weights)
    letters = sum(len(w) + 1 for w in words)
    held = np.zeros(pieces.count + 1)
    held[pieces.count] = 1
    for p, n in numbers.items():
        held[n] = len(p)
    assert counts[:, 0] @ held == pytest.approx(letters)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 100
    assert sum(r.lang == r.lang_pred for r in got) >= 0.98 * len(got)
    assert all(0 <= r.score <= 1 for r in got)


def test_awkward_texts(spark):
    rows = [(i, "the cat and the dog of the house" if i % 2 else "le chat et le chien de la maison",
             "en" if i % 2 else "fr") for i in range(60)]
    rows += [(100, None, "en"), (101, "", None), (102, "123 !!!", "fr"), (103, "the house and the dog " * 3000, None),
             (None, "le chien et le chat", "fr"), (104, "x" * 5000, None), (105, "ДОМ dom", None)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, lang string, score string")
    got = {r.doc_id: r for r in language.identify(df).collect()}
    assert [got[i].lang_pred for i in (100, 101, 102)] == ["und"] * 3 and got[100].score == 0
    assert got[103].lang_pred == "en" and got[None].lang_pred == "fr" and got[None].held_out
    assert got[104].lang_pred in ("en", "fr")
    kept = language.known_documents(df)
    assert kept.columns == df.columns and {100, 101, 102}.isdisjoint(r.doc_id for r in kept.collect())
    blank = df.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language.identify(blank).collect()} == {"und"}
    assert language.identify(df.limit(0)).count() == 0
