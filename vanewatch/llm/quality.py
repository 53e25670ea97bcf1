"""Quality rules: figures of each text, and how often its lines recur on its host.

Every text is measured once. Lines are hashed with their words in lower case and white space
folded; per (line, host) the distinct documents that hold the line are counted, rows of one id
and one text once. A line in more documents of a host than its limit is taken out, and a document
that keeps too few words is rejected.

The count is a two-step aggregation on narrow rows with a map-side combine. The limit of a host
is the larger of ``MIN_DOCS`` and ``HOST_SHARE`` of its documents.

Defined results: a null text has no words; a null host is one host; lines without a word are
never counted; null ids count as one id; a null id, repeated rows and equal ids are judged by
their own text and host; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vanewatch.llm.common import stored
from vanewatch.llm.symbols import Sums, blocks, merged, mixed, owners, word_spans
from vanewatch.operators.joins import broadcast_within

MIN_WORDS = 10
REPEAT_PERCENT = 20
REPEAT_WINDOW = 5
MIN_DOCS = 100
HOST_SHARE = 0.02
#: A document whose remaining words are fewer than MIN_WORDS or this share is depleted.
LEFT_PERCENT = 30

SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[list(b"#*$%&|<>")] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

FIGURES = (
    "doc_id long, host string, text_key long, n_words long, word_chars long, n_symbols long, "
    "n_dup_lines long, n_repeat_words long, lines array<long>, line_words array<int>"
)


def _sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _again(owner: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which items equal another item of the same owner, both included."""
    keys = mixed(hashes + mixed(owner.astype(np.uint64) + np.uint64(1)))
    ranked = np.sort(keys)
    twice = np.unique(ranked[1:][ranked[1:] == ranked[:-1]])
    if len(twice) == 0:
        return np.zeros(len(keys), dtype=bool)
    at = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
    return twice[at] == keys


def _earlier(owner: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which items equal an earlier item of the same owner."""
    keys = mixed(hashes + mixed(owner.astype(np.uint64) + np.uint64(1)))
    out = np.ones(len(keys), dtype=bool)
    out[np.unique(keys, return_index=True)[1]] = False
    return out


def _measure(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray | list]:
    n = len(offsets) - 1
    starts, ends, firsts = word_spans(data, offsets)
    owner = owners(firsts)
    raw = Sums(data)
    words = raw.spans(starts, ends)
    heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80, dtype=np.int64)])
    chars = np.concatenate([[0], np.cumsum(heads[ends] - heads[starts])])

    # lines: from each \n or document start to the next
    cuts = np.flatnonzero(data == 0x0A)
    begin = np.sort(np.concatenate([offsets[:-1], cuts + 1]), kind="stable")
    line_owner = np.searchsorted(offsets[1:], begin, side="right")
    # a document that ends in \n has an empty last line which starts where the next one does
    inside = begin < len(data)
    begin, line_owner = begin[inside], line_owner[inside]
    stop = np.minimum(
        np.append(begin[1:], len(data)), offsets[1:][np.minimum(line_owner, n - 1)]
    )
    first_word = np.searchsorted(starts, begin)
    past_word = np.searchsorted(starts, stop)
    real = past_word > first_word
    begin, stop, line_owner = begin[real], stop[real], line_owner[real]
    first_word, past_word = first_word[real], past_word[real]
    tail = stop - ((stop > begin) & (data[np.maximum(stop - 1, 0)] == 0x0A))
    same = _earlier(line_owner, raw.spans(begin, tail))
    folded = Sums(Sums(LOWER[data]).spans(starts, ends)).spans(first_word, past_word)

    # words in windows that occur again
    covered = np.zeros(len(starts) + 1, dtype=np.int64)
    windows = Sums(words).windows(REPEAT_WINDOW)
    if len(windows):
        own = owner[: len(windows)] == owner[REPEAT_WINDOW - 1 :]
        at = np.flatnonzero(own)
        hit = at[_again(owner[at], windows[at])]
        lo, hi = merged(hit, hit + REPEAT_WINDOW)
        covered[lo] += 1
        covered[hi] -= 1
    repeated = np.cumsum(covered[:-1])

    firsts_of_lines = np.searchsorted(line_owner, np.arange(n + 1))
    keys, sizes = [], []
    for i in range(n):
        a, b = firsts_of_lines[i], firsts_of_lines[i + 1]
        found, which = np.unique(folded[a:b], return_inverse=True)
        keys.append(found.view(np.int64))
        sizes.append(np.bincount(which, (past_word - first_word)[a:b]).astype(np.int32))
    return {
        "text_key": raw.spans(offsets[:-1], offsets[1:]).view(np.int64),
        "n_words": np.diff(firsts),
        "word_chars": chars[firsts[1:]] - chars[firsts[:-1]],
        "n_symbols": _sums(SYMBOLS[data], offsets),
        "n_dup_lines": np.bincount(line_owner[same], minlength=n)[:n],
        "n_repeat_words": _sums(repeated, firsts),
        "lines": keys,
        "line_words": sizes,
    }


def _figures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [part.split(" ")[0] for part in FIGURES.split(", ")]
    for batch in batches:
        text = batch.column("text")
        for rows, data, offsets in blocks(text):
            got = _measure(data, offsets)
            columns = {
                "doc_id": batch.column("doc_id")[rows.start : rows.stop],
                "host": batch.column("host")[rows.start : rows.stop],
                **{k: pa.array(v) for k, v in got.items() if not isinstance(v, list)},
                "lines": pa.array(got["lines"], pa.list_(pa.int64())),
                "line_words": pa.array(got["line_words"], pa.list_(pa.int32())),
            }
            yield pa.RecordBatch.from_arrays([columns[c] for c in names], names)


def figures(docs: DataFrame, host: str = "source") -> DataFrame:
    """One row of figures per document, with the hashes of its distinct lines."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(host).alias("host"), "text")
    return narrow.mapInArrow(_figures, FIGURES)


def judge(
    docs: DataFrame,
    host: str = "source",
    min_docs: int = MIN_DOCS,
    host_share: float = HOST_SHARE,
) -> DataFrame:
    """Figures and verdict of every document.

    Columns: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    kept, removed_words.
    """
    known = stored(figures(docs, host), "line-figures")
    held = known.select("host", "doc_id", "text_key", "lines").dropDuplicates(["host", "doc_id", "text_key"])
    limits = broadcast_within(
        held.groupBy("host").agg(F.count(F.lit(1)).alias("_docs")).select(
            F.col("host").alias("_host"),
            F.greatest(F.lit(min_docs), F.floor(F.col("_docs") * F.lit(host_share))).alias("_limit"),
        )
    )
    common = stored(
        held.select("host", F.explode("lines").alias("line"))
        .groupBy("host", "line")
        .agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") > min_docs)
        .join(limits, F.col("host").eqNullSafe(F.col("_host")))
        .where(F.col("_n") > F.col("_limit"))
        .select("_host", F.col("line").alias("_line")),
        "common-lines",
    )
    key = ["doc_id", "host", "text_key"]
    lost = (
        known.select("host", "text_key", F.explode(F.arrays_zip("lines", "line_words")).alias("_l"))
        .join(
            broadcast_within(common),
            F.col("host").eqNullSafe(F.col("_host")) & (F.col("_l.lines") == F.col("_line")),
        )
        .select("host", "text_key", F.col("_l.lines").alias("line"), F.col("_l.line_words").alias("w"))
        .groupBy("host", "text_key", "line")
        .agg(F.max("w").alias("w"))
        .groupBy(F.col("host").alias("_h"), F.col("text_key").alias("_k"))
        .agg(F.sum("w").alias("_lost"))
    )
    left = F.col("n_words") - F.col("removed_words")
    return (
        known.select(*key, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
        .join(lost, F.col("host").eqNullSafe(F.col("_h")) & (F.col("text_key") == F.col("_k")), "left")
        .withColumn("removed_words", F.coalesce("_lost", F.lit(0)))
        .withColumn(
            "base_failed",
            (F.col("n_words") < MIN_WORDS)
            | (F.col("n_repeat_words") * 100 > F.col("n_words") * REPEAT_PERCENT),
        )
        .withColumn(
            "kept",
            ~F.col("base_failed") & (left >= MIN_WORDS) & (left * 100 >= F.col("n_words") * LEFT_PERCENT),
        )
        .select(
            "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
            "base_failed", "kept", "removed_words",
        )
    )
