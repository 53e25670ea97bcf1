"""Language identification by unigrams over a fixed vocabulary, summed over all segmentations.

Each language has a probability for every piece of a public vocabulary. The probability of a word
is the sum, over all ways to cut it into pieces, of the products of their probabilities; a forward
pass gives it without listing the ways. A text is the product of its words. The language under
which it is most probable wins, and the score is that language's share of the probability.

Piece probabilities come from expected counts over all segmentations of training words, gathered
by a forward-backward pass, in a few rounds. Training may use a bounded sample: about
``SAMPLE_DOCS`` labelled documents of each language, chosen by the hash of their ids. Every text
is scored whole: words of a block are scored once each, however often they occur.

Words are lower-cased and reduced to their letters; a word longer than ``STRETCH`` letters is
scored in stretches of that length.

Defined results: a null text and a text without a letter are ``und`` with score 0; so is every
text if there is nothing to learn from; a row with a null id counts as held out; repeated rows
give repeated results; a tie goes to the language that sorts first.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vanewatch.llm.common import arrow_rows
from vanewatch.llm.symbols import Sums, blocks, owners, word_spans

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
SAMPLE_DOCS = 1000
ROUNDS = 3
STRETCH = 24
#: Count added to every piece of every language.
SMOOTHING = 0.05
#: Texts of a block are gathered up to this size, so that words repeat within it.
SCORED_BYTES = 1 << 20
UND = "und"

#: Numerals of any kind, such as fractions and superscripts, are no letters. The class is long and a search
#: tries it at every character, so ``letters_of`` keeps what it leaves, alphabetic characters, by asking for these.
NUMERALS = "".join(c for c in map(chr, range(0x110000)) if c.isnumeric() and not c.isalpha())
NO_LETTER = re.compile(rf"[^\w\n]|[\d_{NUMERALS}]")


@dataclass(frozen=True)
class Pieces:
    """Pieces of a vocabulary as sorted hashes; a piece that starts a word starts with a mark."""

    hashes: np.ndarray
    numbers: np.ndarray
    lengths: tuple[int, ...]
    count: int
    table: np.ndarray  # which values of the lowest bits of a hash occur

    MARK = "▁"


TABLE_BITS = 20


def pieces_of(strings: list[str]) -> Pieces:
    """Pieces of letters, each with or without a word mark in front."""
    usable = sorted({p for p in strings if p.strip(Pieces.MARK).isalpha() and p == p.lower()})
    codes = [np.frombuffer(p.encode("utf-32-le"), dtype=np.uint32) for p in usable]
    hashes = np.array([_hash(c) for c in codes], dtype=np.uint64)
    order = np.argsort(hashes)
    table = np.zeros(1 << TABLE_BITS, dtype=bool)
    table[(hashes & np.uint64((1 << TABLE_BITS) - 1)).astype(np.int64)] = True
    lengths = tuple(sorted({len(c) for c in codes}))
    return Pieces(hashes[order], order.astype(np.int64), lengths, len(usable), table)


def _hash(codes: np.ndarray) -> np.uint64:
    return Sums(codes).spans(np.array([0]), np.array([len(codes)]))[0]


def vocabulary(path: str = VOCABULARY) -> list[str]:
    """All pieces of a sentencepiece model file, read on the driver."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [
        model.id_to_piece(i)
        for i in range(model.get_piece_size())
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))
    ]


def letters_of(words: list[str]) -> list[str]:
    """Each word in lower case with nothing but its letters."""
    lowered = "\n".join(words).lower().split("\n") if words else []
    return [word if word.isalpha() else "".join(filter(str.isalpha, word)) for word in lowered]


class Lattice:
    """All pieces at all places of many words, grouped by word length.

    Letters known to no piece fall back on a piece of their own, numbered ``pieces.count``.
    """

    def __init__(self, pieces: Pieces, words: list[str]):
        self.pieces = pieces
        marked = [Pieces.MARK + w for w in words]
        sizes = np.array([len(w) for w in marked], dtype=np.int64)
        codes = np.frombuffer("".join(marked).encode("utf-32-le"), dtype=np.uint32)
        sums = Sums(codes)
        begin = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
        low = np.uint64((1 << TABLE_BITS) - 1)
        self.groups = []
        for size in np.unique(sizes):
            which = np.flatnonzero(sizes == size)
            steps = []  # (from, to, rows, piece numbers)
            for stop in range(1, size + 1):
                reached = np.zeros(len(which), dtype=bool)
                found = []
                for length in pieces.lengths:
                    if length > stop:
                        break
                    lo = begin[which] + stop - length
                    hashes = sums.spans(lo, lo + length)
                    rows = np.flatnonzero(pieces.table[(hashes & low).astype(np.int64)])
                    at = np.minimum(np.searchsorted(pieces.hashes, hashes[rows]), len(pieces.hashes) - 1)
                    real = pieces.hashes[at] == hashes[rows]
                    rows, at = rows[real], at[real]
                    if length == 1:
                        reached[rows] = True
                    if len(rows):
                        found.append((stop - length, rows, pieces.numbers[at]))
                lone = np.flatnonzero(~reached)
                if len(lone):
                    found.append((stop - 1, lone, np.full(len(lone), pieces.count)))
                steps.append(found)
            self.groups.append((int(size), which, steps))

    def forward(self, chances: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, list]]:
        """(words, forward sums [place, word, language], steps) for each word length."""
        for size, which, steps in self.groups:
            sums = np.zeros((size + 1, len(which), chances.shape[1]))
            sums[0] = 1.0
            for stop, found in enumerate(steps, 1):
                for start, rows, number in found:
                    sums[stop, rows] += sums[start, rows] * chances[number]
            yield which, sums, steps

    def log_chances(self, chances: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros((n, chances.shape[1]))
        for which, sums, _ in self.forward(chances):
            out[which] = np.log(np.maximum(sums[-1], 1e-300))
        return out

    def expected(self, chances: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Expected count of each piece over all segmentations; weights per word and language."""
        counts = np.zeros((self.pieces.count + 1, chances.shape[1]))
        for which, sums, steps in self.forward(chances):
            back = np.zeros_like(sums)
            back[-1] = weights[which] / np.maximum(sums[-1], 1e-300)
            for stop in range(len(steps), 0, -1):
                for start, rows, number in steps[stop - 1]:
                    flow = back[stop, rows] * chances[number]
                    back[start, rows] += flow
                    np.add.at(counts, number, flow * sums[start, rows])
        return counts


def _stretches(word: str) -> list[str]:
    return [word[i : i + STRETCH] for i in range(0, len(word), STRETCH)]


@dataclass(frozen=True)
class Model:
    pieces: Pieces
    languages: tuple[str, ...]
    chances: np.ndarray  # [piece, language]


def learn(
    docs: DataFrame, strings: list[str], sample_docs: int = SAMPLE_DOCS, rounds: int = ROUNDS
) -> Model:
    """Model from rows of (doc_id, text, lang) with a language.

    The driver keeps one count per piece and language; words and their counts stay on executors.
    """
    pieces = pieces_of(strings)
    labelled = docs.where("lang IS NOT NULL AND doc_id IS NOT NULL")
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = tuple(sorted(sizes))
    if not languages:
        return Model(pieces, (), np.zeros((pieces.count + 1, 0)))
    share = F.create_map(*[F.lit(x) for l in languages for x in (l, min(1.0, sample_docs / sizes[l]))])
    draw = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 30)) / F.lit(1 << 30)
    words = (
        labelled.where(draw < F.element_at(share, F.col("lang")))
        .select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("word"))
        .groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
        .persist()
    )
    chances = np.full((pieces.count + 1, len(languages)), 1.0 / (pieces.count + 1))
    for _ in range(rounds):
        total = np.full(chances.shape, SMOOTHING)
        counted = words.mapInArrow(
            _expected(pieces, languages, chances), "piece int, language int, n double"
        )
        for r in counted.groupBy("piece", "language").agg(F.sum("n").alias("n")).toLocalIterator():
            total[r["piece"], r["language"]] += r["n"]
        chances = total / total.sum(axis=0)
    words.unpersist()
    return Model(pieces, languages, chances)


def _expected(pieces: Pieces, languages: tuple[str, ...], chances: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(chances.shape)
        for batch in batches:
            parts: list[str] = []
            spots: list[tuple[int, int, int]] = []
            for lang, word, n in zip(*(batch.column(c).to_pylist() for c in ("lang", "word", "n"))):
                for stretch in _stretches(letters_of([word])[0]):
                    spots.append((len(parts), languages.index(lang), n))
                    parts.append(stretch)
            weights = np.zeros((len(parts), len(languages)))
            for row, column, n in spots:
                weights[row, column] = n
            counts += Lattice(pieces, parts).expected(chances, weights)
        piece, language = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(piece.astype(np.int32)), pa.array(language.astype(np.int32)), pa.array(counts[piece, language])],
            ["piece", "language", "n"],
        )

    return run


def _predict(model: Model, text: str = "text", keep_text: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in blocks(batch.column(text), SCORED_BYTES):
                n = len(offsets) - 1
                starts, ends, firsts = word_spans(data, offsets)
                held = owners(firsts)
                hashes = Sums(data).spans(starts, ends)
                _, first, which = np.unique(hashes, return_index=True, return_inverse=True)
                raw = [data[a:b].tobytes().decode() for a, b in zip(starts[first], ends[first])]
                words = letters_of(raw)
                parts: list[str] = []
                of: list[int] = []
                for i, word in enumerate(words):
                    if len(word) > STRETCH:
                        cut = _stretches(word)
                        parts += cut
                        of += [i] * len(cut)
                    elif word:
                        parts.append(word)
                        of.append(i)
                scored = Lattice(model.pieces, parts).log_chances(model.chances, len(parts))
                total = np.zeros((n, len(model.languages)))
                spelled = np.zeros(len(words), dtype=np.int64)
                spelled[of] = 1
                for k in range(len(model.languages)):
                    each = np.bincount(of, scored[:, k], minlength=len(words)) if of else np.zeros(len(words))
                    total[:, k] = np.bincount(held, each[which], minlength=n)
                lettered = np.bincount(held, spelled[which], minlength=n) > 0
                best, score = _decide(total)
                names = [
                    model.languages[k] if some and model.languages else UND
                    for k, some in zip(best, lettered)
                ]
                score = np.where(lettered & (len(model.languages) > 0), score, 0.0)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c)[rows.start : rows.stop] for c in batch.schema.names if keep_text or c != text),
                     pa.array(names, pa.string()), pa.array(score)],
                    [*(c for c in batch.schema.names if keep_text or c != text), "lang_pred", "score"],
                )

    return run


def _decide(total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if total.shape[1] == 0:
        return np.zeros(len(total), dtype=np.int64), np.zeros(len(total))
    best = np.argmax(total, axis=1)
    chance = np.exp(total - total.max(axis=1, keepdims=True))
    return best, 1.0 / chance.sum(axis=1)


def held_out(doc_id: Column) -> Column:
    rest = F.crc32(doc_id.cast("string").cast("binary")) % 5
    return F.coalesce(rest == 0, F.lit(True))


def identify(docs: DataFrame, path: str = VOCABULARY, **options) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row, learned from the rows not held out."""
    arrow_rows(docs.sparkSession)
    training = docs.select("doc_id", "text", "lang").where(~held_out(F.col("doc_id")))
    model = learn(training, vocabulary(path), **options)
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text"
    ).mapInArrow(_predict(model), "doc_id long, held_out boolean, lang_pred string, score double")


def known_documents(docs: DataFrame, path: str = VOCABULARY, least: float = 0.5, **options) -> DataFrame:
    """Rows whose language is recognised with a score of ``least`` or more, columns unchanged."""
    arrow_rows(docs.sparkSession)
    training = docs.select("doc_id", "text", "lang").where(~held_out(F.col("doc_id")))
    model = learn(training, vocabulary(path), **options)
    types = dict(docs.dtypes)
    plain = {c: f"c{i}" for i, c in enumerate(docs.columns)}  # whatever the columns are called
    inner = docs.select(*[F.col(c).alias(name) for c, name in plain.items()])
    schema = [f"{name} {types[c]}" for c, name in plain.items()]
    named = inner.mapInArrow(_predict(model, plain["text"], True), ", ".join([*schema, "lang_pred string, score double"]))
    return named.where((F.col("lang_pred") != UND) & (F.col("score") >= least)).select(
        *[F.col(name).alias(c) for c, name in plain.items()]
    )
