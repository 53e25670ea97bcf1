"""Operator 12 against the tokenizer library."""

import hashlib
import random

import numpy as np
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from vanewatch.llm import bpe
from vanewatch.llm.q_bpe import public_vocabulary

PATH = public_vocabulary("byte_bpe_50k.tiktoken")
DOCS = "doc_id long, text string, word string, ids string, n string"


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as file:
        ranks = bpe.ranks(file.read())
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


def expected(library, text):
    ids = library.encode_ordinary(text or "")
    return (
        len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(),
        hashlib.sha256((text or "").encode()).hexdigest(),
    )


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "clash", "clash", "clash") for d, t in rows], DOCS)


def texts(seed: int) -> list[tuple]:
    rng = random.Random(seed)
    parts = ["the", " of", "  ", "\n", "\n\n", "\t", "it's", "'S", "we'll", "''s", " 'd", "don't", "1234", "½", "é", "Ön",
             " ", "　", "漢字", "!?", "...", "'", "'re", "'vex", "\r\n", "\x00", "🙂", "é", "<|endoftext|>"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 60)))) for i in range(60)]
    rows += [(70, None), (71, ""), (72, " "), (73, "\n \n"), (74, "a" * 20_000), (75, "x y " * 9000), (None, "no id, it's so")]
    rows += [rows[3], (80, rows[4][1]), (5, rows[6][1])]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "small"), [(1, False), (2, True), (3, True)])
def test_ids_are_those_of_the_library(spark, library, seed, small):
    rows = texts(seed)
    docs = frame(spark, rows).repartition(3, "text")
    if small:  # one text is longer than some blocks and pieces
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    coded = bpe.decode(bpe.encode(docs, PATH), PATH).collect()
    got = sorted(
        (str(r.doc_id), len(r.ids) // 4, hashlib.sha256(r.ids).hexdigest(), hashlib.sha256(r.decoded).hexdigest())
        for r in coded
    )
    assert got == sorted((str(d), *expected(library, t)) for d, t in rows)


def test_digest_has_the_columns_of_the_query(spark, library):
    rows = texts(4)
    got = sorted(map(tuple, bpe.digest(frame(spark, rows), PATH).collect()), key=str)
    assert got == sorted(((d, *expected(library, t)) for d, t in rows), key=str)
    assert bpe.digest(frame(spark, []), PATH).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("'strevlmd aAé1½\n\t  !.漢"), max_size=14), min_size=1, max_size=4))
def test_pre_tokens_follow_the_pattern(parts):
    import regex

    data = "".join(parts).encode()
    offsets = np.concatenate([[0], np.cumsum([len(p.encode()) for p in parts])])
    starts, ends, firsts = bpe.words_of(np.frombuffer(data, dtype=np.uint8), offsets)
    got = [[data[a:b].decode() for a, b in zip(starts[i:j], ends[i:j])] for i, j in zip(firsts, firsts[1:])]
    assert got == [regex.findall(bpe.PATTERN, p) for p in parts]


def explode(monkeypatch, texts_of_batches, block):
    import pyarrow as pa

    monkeypatch.setattr(bpe, "BLOCK", block)
    batches = [
        pa.RecordBatch.from_arrays(
            [pa.array(range(len(t)), pa.int64()), pa.array(t), pa.array([3] * len(t), pa.int32())], ["doc_id", "text", "part"]
        )
        for t in texts_of_batches
    ]
    return list(bpe._word_rows(iter(batches))), list(bpe._piece_rows(iter(batches)))


def test_blocks_number_their_words_across_pieces(monkeypatch):
    words, pieces = explode(monkeypatch, [["a b a", " b c"], ["a d"], ["a a a", None]], 14)
    held = [(b.column("block")[0].as_py(), [w.decode() for w in b.column("word").to_pylist()]) for b in words]
    assert held == [(3 << 32, ["a", " b", " a", " c", " d"]), ((3 << 32) + 1, ["a", " a"])]
    opened = [bpe._opened(p.column("data")[0].as_py()) for p in pieces]
    assert [places.tolist() for _, places in opened] == [[0, 1, 2, 1, 3], [0, 4], [0, 1, 1]]
    assert opened[2][0].column("n").to_pylist() == [3, 0]
    assert [p.column("number")[0].as_py() for p in pieces] == [-2, -1, -1]


def test_rows_that_do_not_fit_together_are_an_error(monkeypatch):
    import pyarrow as pa

    words, pieces = explode(monkeypatch, [["a b c"]], 1 << 20)
    ids = pa.array([b"\1", b"\2"], pa.binary())
    short = pa.table({"block": words[0].column("block")[:2], "number": words[0].column("number")[:2], "data": ids})
    table = pa.concat_tables([short, pa.Table.from_batches(pieces)])
    with pytest.raises(RuntimeError):
        bpe._assemble(table)


def test_words_of_one_hash_stay_apart(monkeypatch):
    """With a hash that sees lengths only, different words still get numbers of their own."""
    class Lengths:
        def __init__(self, data):
            pass

        def spans(self, lo, hi):
            return (hi - lo).astype(np.uint64)

    monkeypatch.setattr(bpe, "Sums", Lengths)
    numbering = bpe.Numbering()
    for text in (b" ab cd ab cd ef ab", b" cd ab  x xy"):
        data = np.frombuffer(text, dtype=np.uint8)
        starts = np.arange(0, len(data), 3)
        number = numbering.of(data, starts, starts + 3)
        words = numbering.words().to_pylist()
        assert [words[k] for k in number] == [text[a : a + 3] for a in starts]
