"""Byte-level BPE by one encoding of each distinct word.

Texts are cut into pre-tokens. A block, the documents of one task up to some tens of MB, numbers its
distinct words and explodes into one row per word, beside the places of all words: their numbers in
order of place. The word rows of all blocks meet in a shuffle by word, where each distinct word is
encoded once; its ids go back to the blocks by a second shuffle, on block, and the ids of each
document are put together from its places. A word has one row per block at most, so the most
frequent word weighs no more than the number of blocks. Decoding looks ids up in the table of token
bytes, whose size is that of the vocabulary.

Words are told apart by a 64-bit hash and compared in full: a place whose word differs from the first
one of its hash gets a number of its own.

Defined results: a null text is empty and has no ids; repeated rows give repeated results; a null id
stays null; other columns are left behind.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vanewatch.llm import ragged
from vanewatch.llm.common import arrow_rows, stored
from vanewatch.llm.symbols import Sums, blocks

#: The pattern of the public vocabulary, which ``pre_tokens`` follows.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
ONE_LETTER = "stmd"
TWO_LETTERS = ("re", "ve", "ll")

OTHER, LETTER, NUMBER, SPACE = range(4)

#: Bytes of text that share one numbering of words; a longer document makes a block of its own.
BLOCK = 48 * 1024 * 1024

WORDS = "block long, number int, word binary"
ROWS = "block long, number int, data binary"
IDS = "doc_id long, ids binary"


@lru_cache(1)
def kinds() -> np.ndarray:
    """Kind of every code point, as the pattern engine of the tokenizer library sees it."""
    import tiktoken

    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    single = {bytes([b]): b for b in range(256)}
    table = np.full(0x110000, OTHER, dtype=np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
        engine = tiktoken.Encoding("kind", pat_str=pattern, mergeable_ranks=single, special_tokens={})
        found = bytes(engine.encode_ordinary(every)).decode()
        table[np.frombuffer(found.encode("utf-32-le"), dtype=np.uint32)] = kind
    return table


def pre_tokens(codes: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Where the matches of ``PATTERN`` begin in code points of documents that begin at ``edges``."""
    n = len(codes)
    if n == 0:
        return np.zeros(0, dtype=np.int64)
    kind = kinds()[codes]
    edge = np.zeros(n + 1, dtype=bool)
    edge[edges] = edge[n] = True
    begins = edge[:n].copy()
    begins[1:] |= kind[1:] != kind[:-1]
    # The last white space before anything else stands alone; a blank goes with what follows.
    after = np.flatnonzero(begins[1:] & ~edge[1:n] & (kind[:-1] == SPACE)) + 1
    begins[after - 1] = True
    begins[after[codes[after - 1] == 0x20]] = False
    # An apostrophe that begins a match and the letters of a contraction are one match.
    padded = np.concatenate([codes, np.zeros(3, dtype=codes.dtype)])
    marks = np.flatnonzero((codes == ord("'")) & begins)
    marks = marks[~edge[marks + 1]]
    next_one, next_two = padded[marks + 1], padded[marks + 2]
    one = np.isin(next_one, [ord(c) for c in ONE_LETTER])
    two = np.zeros(len(marks), dtype=bool)
    for a, b in TWO_LETTERS:
        two |= (next_one == ord(a)) & (next_two == ord(b)) & ~edge[np.minimum(marks + 2, n)]
    begins[marks[one | two] + 1] = False
    stop = np.concatenate([marks[one] + 2, marks[two] + 3])
    begins[stop[stop < n]] = True
    return np.flatnonzero(begins)


def _code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes and the place where each one begins, with the end."""
    codes = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), dtype=np.uint32)
    at = np.flatnonzero((data & 0xC0) != 0x80)
    return codes, np.append(at, len(data))


def words_of(data: np.ndarray, offsets: np.ndarray):
    """(starts, ends, firsts) of the pre-tokens of a block, in bytes.

    ``firsts`` holds the number of each document's first one, and at last how many there are.
    """
    codes, at = _code_points(data)
    edges = np.searchsorted(at, offsets)
    begins = pre_tokens(codes, edges[:-1][edges[:-1] < len(codes)])
    starts = at[begins]
    ends = np.append(starts[1:], len(data)).astype(np.int64)
    return starts, ends, np.searchsorted(starts, offsets)


class Numbering:
    """Numbers of the distinct words of a block, in order of first place."""

    def __init__(self):
        self.hashes = np.zeros(0, dtype=np.uint64)  # sorted
        self.numbers = np.zeros(0, dtype=np.int64)
        self.lo, self.sizes = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)  # by number
        self.data = np.zeros(0, dtype=np.uint8)

    def _add(self, data: np.ndarray, lo: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        fresh = np.arange(len(self.sizes), len(self.sizes) + len(sizes))
        self.lo = np.concatenate([self.lo, len(self.data) + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.data = np.concatenate([self.data, ragged.gather(data, lo, sizes)])
        return fresh

    def of(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of each word of a piece; new words are added."""
        hashes, sizes = Sums(data).spans(starts, ends), ends - starts
        order, heads = ragged.groups(hashes)
        first = np.minimum.reduceat(order, heads) if len(order) else order
        keys = hashes[first]
        at = np.minimum(np.searchsorted(self.hashes, keys), max(len(self.hashes) - 1, 0))
        known = self.hashes[at] == keys if len(self.hashes) else np.zeros(len(keys), dtype=bool)
        by_first = np.sort(first[~known])
        number = np.zeros(len(starts), dtype=np.int64)
        number[by_first] = self._add(data, starts[by_first], sizes[by_first])
        found = np.where(known, self.numbers[at] if len(self.hashes) else 0, number[first])
        number[order] = np.repeat(found, np.diff(np.append(heads, len(order))))
        where = np.searchsorted(self.hashes, keys[~known])
        self.hashes = np.insert(self.hashes, where, keys[~known])
        self.numbers = np.insert(self.numbers, where, found[~known])
        alike = np.flatnonzero(self.sizes[number] == sizes)
        right = np.zeros(len(starts), dtype=bool)
        right[alike] = ragged.same(data, starts[alike], self.data, self.lo[number[alike]], sizes[alike])
        other = np.flatnonzero(~right)
        number[other] = self._add(data, starts[other], sizes[other])
        return number

    def words(self) -> pa.Array:
        return ragged.binaries(self.data, self.sizes)


def _explode(batches: Iterator[pa.RecordBatch], with_pieces: bool) -> Iterator[tuple[int, Numbering, list[bytes]]]:
    """(block, its words, its pieces) of a task; a piece is the places of some whole documents."""
    count, size = 0, 0
    numbering, pieces = Numbering(), []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        part = batch.column("part")[0].as_py()
        ids = batch.column("doc_id")
        for rows, data, offsets in blocks(batch.column("text")):
            if pieces and size + len(data) > BLOCK:
                yield (part << 32) + count, numbering, pieces
                numbering, pieces, size, count = Numbering(), [], 0, count + 1
            starts, ends, firsts = words_of(data, offsets)
            numbers = numbering.of(data, starts, ends)
            held = ids[rows.start : rows.stop].cast(pa.int64())
            pieces.append(_piece(held, np.diff(firsts), numbers) if with_pieces else b"")
            size += len(data)
    if pieces:
        yield (part << 32) + count, numbering, pieces


DOCS = pa.schema({"doc_id": pa.int64(), "n": pa.int64()})


def _piece(ids: pa.Array, counts: np.ndarray, numbers: np.ndarray) -> bytes:
    """Documents, how many pre-tokens each has, and the number of each pre-token's word."""
    docs = pa.RecordBatch.from_arrays([ids, pa.array(counts.astype(np.int64))], schema=DOCS).serialize().to_pybytes()
    raw = ragged.packed(numbers)[0].tobytes()
    places = pa.Codec("zstd", 3).compress(raw, asbytes=True)
    return b"".join([len(docs).to_bytes(8, "little"), len(raw).to_bytes(8, "little"), docs, places])


def _opened(piece: bytes) -> tuple[pa.RecordBatch, np.ndarray]:
    size, raw = int.from_bytes(piece[:8], "little"), int.from_bytes(piece[8:16], "little")
    docs = pa.ipc.read_record_batch(pa.py_buffer(piece[16 : 16 + size]), DOCS)
    places = pa.Codec("zstd").decompress(piece[16 + size :], raw, asbytes=True)
    return docs, ragged.unpacked(np.frombuffer(places, dtype=np.uint8))


def _word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block, numbering, _ in _explode(batches, False):
        n = len(numbering.sizes)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, block)), pa.array(np.arange(n, dtype=np.int32)), numbering.words()],
            ["block", "number", "word"],
        )


def _piece_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per piece; its number is negative, so that it goes before the words."""
    for block, _, pieces in _explode(batches, True):
        for k, piece in enumerate(pieces):
            row = [pa.array([block]), pa.array([k - len(pieces)], pa.int32()), pa.array([piece], pa.binary())]
            yield pa.RecordBatch.from_arrays(row, ["block", "number", "data"])


@lru_cache(2)
def _encoder(vocabulary: bytes):
    import tiktoken

    return tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=ranks(vocabulary), special_tokens={})


def ranks(vocabulary: bytes) -> dict[bytes, int]:
    """Token bytes and rank of each line of a rank file."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line)}


def _encode(vocabulary: bytes):
    """Ids of word rows sorted by word; equal words, one after the other, are encoded once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, last = _encoder(vocabulary), None
        coded = np.zeros(0, dtype=np.int64)
        for batch in batches:
            if batch.num_rows == 0:
                continue
            words = batch.column("word")
            fresh = np.ones(len(words), dtype=bool)
            fresh[1:] = pc.not_equal(words[1:], words[:-1]).to_numpy(zero_copy_only=False)
            fresh[0] = words[0].as_py() != last
            distinct = words.filter(pa.array(fresh)).to_pylist()
            found = [coded, *(encoder.encode_ordinary(w.decode()) for w in distinct)]
            sizes = np.array([len(x) for x in found])
            raw, width = ragged.packed(np.concatenate(found))
            heads = np.cumsum(sizes) - sizes
            total = np.concatenate([[0], np.cumsum(width)])
            lo, size = total[heads], total[heads + sizes] - total[heads]
            which = np.cumsum(fresh)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("block"), batch.column("number"),
                    ragged.binaries(ragged.gather(raw, lo[which], size[which]), size[which]),
                ],
                ["block", "number", "data"],
            )
            last, coded = words[-1].as_py(), np.array(found[-1], dtype=np.int64)

    return run


def _assemble(block: pa.Table) -> pa.Table:
    """The ids of each document of one block, from its words' ids and its pieces."""
    block = block.sort_by("number")
    data = pa.concat_arrays([*block.column("data").chunks, pa.array([], pa.binary())])
    n_pieces = int(pc.sum(pc.less(block.column("number"), 0)).as_py() or 0)
    ids, widths = ragged.contents(data[n_pieces:])
    # from bytes to ids, word by word
    per_word = np.add.reduceat(ids < 128, np.cumsum(widths) - widths, dtype=np.int64) if len(widths) else widths
    ids = ragged.unpacked(ids).astype("<u4")
    lo = np.cumsum(per_word) - per_word
    whole = np.array_equal(block.column("number").to_numpy(), np.arange(-n_pieces, len(lo)))
    docs, tokens = [], []
    for piece in data[:n_pieces]:
        held, of = _opened(piece.as_py())
        ends = np.cumsum(held.column("n").to_numpy())
        whole = whole and len(of) == (ends[-1] if len(ends) else 0) and (len(of) == 0 or of.max() < len(lo))
        if not whole:
            break
        upto = np.concatenate([[0], np.cumsum(per_word[of])])[ends]
        docs.append(held.column("doc_id"))
        tokens.append(ragged.binaries(
            ragged.gather(ids, lo[of], per_word[of]).view(np.uint8), 4 * np.diff(upto, prepend=0)
        ))
    if not whole or not n_pieces:
        raise RuntimeError("the words of a block do not match its places: documents were read in another order")
    return pa.table({"doc_id": pa.chunked_array(docs, pa.int64()), "ids": pa.chunked_array(tokens, pa.binary())})


def encode(docs: DataFrame, path: str, is_table: bool = False) -> DataFrame:
    """(doc_id, ids) of every row: ids as little-endian unsigned 32-bit integers.

    ``path`` is a rank file that the driver reads. Blocks are made twice, for the words and for the
    places, so both passes must meet the same rows in the same order. A plain table (``is_table``)
    gives that; anything else is written to one first.
    """
    spark = docs.sparkSession
    arrow_rows(spark)
    with open(path, "rb") as file:
        vocabulary = file.read()
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    narrow = (narrow if is_table else stored(narrow, "texts")).withColumn("part", F.spark_partition_id())
    coded = (
        narrow.mapInArrow(_word_rows, WORDS).repartition("word").sortWithinPartitions("word")
        .mapInArrow(_encode(vocabulary), ROWS)
    )
    rows = coded.unionByName(narrow.mapInArrow(_piece_rows, ROWS))
    return rows.groupBy("block").applyInArrow(_assemble, IDS)


def token_bytes(path: str) -> tuple[np.ndarray, np.ndarray]:
    """The table of token bytes: all bytes end to end, and where each id's begin."""
    with open(path, "rb") as file:
        by_id = {b: a for a, b in ranks(file.read()).items()}
    sizes = np.array([len(by_id.get(i, b"")) for i in range(max(by_id) + 1)], dtype=np.int64)
    data = b"".join(by_id.get(i, b"") for i in range(max(by_id) + 1))
    return np.frombuffer(data, dtype=np.uint8), np.concatenate([[0], np.cumsum(sizes)])


def _decoded(column: pa.Array, data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    ids, sizes = ragged.contents(column, np.uint32)
    lo, wide = offsets[ids], offsets[ids.astype(np.int64) + 1] - offsets[ids]
    total = np.concatenate([[0], np.cumsum(wide)])
    ends = np.cumsum(sizes)
    return ragged.binaries(ragged.gather(data, lo, wide), total[ends] - total[ends - sizes])


def decode(coded: DataFrame, path: str) -> DataFrame:
    """``coded`` with a binary column ``decoded``, the bytes of its ``ids``."""
    data, offsets = token_bytes(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, _decoded(batch.column("ids"), data, offsets)], [*batch.schema.names, "decoded"]
            )

    return coded.mapInArrow(run, coded.select("*", F.lit(b"").alias("decoded")).schema)


def digest(docs: DataFrame, path: str, is_table: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row."""
    return decode(encode(docs, path, is_table), path).select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )
