"""Importance resampling toward a target set, by hashed word features.

The texts of a batch are joined with a sentinel between them, one pass of a regular expression finds
all words, and the document of each word is found by its place among the documents' offsets, so runs
of words that cross a sentinel are masked before features are counted. A first pass counts hashed
features of the documents and of the target texts; the gains of the buckets, a table of fixed size,
score every document in a second pass. A Gumbel draw from the document id makes the highest scores a
sample without replacement.

Ranks come from a count per score: a score is a small integer, so the counts of higher scores are a
small table, and only documents of equal score are put in order of id.

Defined results: a null or wordless text has no features and weight 0; a null id draws as the empty
id and comes after all others of its score; rows with one id are ranked each on its own, fewer
features first; without documents or target texts the sums are 0; other columns are left behind.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vanewatch.llm.common import arrow_rows, stored
from vanewatch.llm.symbols import blocks
from vanewatch.operators.joins import broadcast_within

BUCKETS = 10_000
#: Features are runs of 1 to so many words.
RUN = 2
LEAST_WORDS = 20
PERCENT = 25
SEED = 7

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
SENTINEL = b"\n"

SCORED = "doc_id long, n_words long, n_features long, weight long, score long"


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, hash) of every feature of the texts, and the words of each text."""
    offsets = np.cumsum([0, *(len(t) + len(SENTINEL) for t in texts)])
    joined = SENTINEL.join(texts).translate(LOWER)
    spans = [m.span() for m in WORD.finditer(joined)]
    words = [joined[a:b] for a, b in spans]
    starts = np.fromiter((a for a, _ in spans), dtype=np.int64, count=len(spans))
    owner = np.searchsorted(offsets, starts, side="right") - 1
    runs = list(map(crc32, words))
    held, hashes = [owner], [np.array(runs, dtype=np.int64)]
    for n in range(2, RUN + 1):
        runs = list(map(crc32, words[n - 1 :], map(crc32, repeat(b" "), runs)))
        whole = owner[n - 1 :] == owner[: max(len(owner) - n + 1, 0)]
        held.append(owner[n - 1 :][whole])
        hashes.append(np.array(runs, dtype=np.int64)[whole])
    return np.concatenate(held), np.concatenate(hashes), np.bincount(owner, minlength=len(texts))


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[slice, list[bytes]]]:
    for rows, data, offsets in blocks(batch.column("text")):
        raw = data.tobytes()
        yield rows, [raw[a:b] for a, b in zip(offsets[:-1], offsets[1:])]


def _count(buckets: int):
    """Features in each bucket, summed over a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for _, texts in _texts(batch):
                total += np.bincount(features(texts)[1] % buckets, minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["bucket", "n"])

    return run


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> dict[int, int]:
    """Features of all texts in each bucket; at most ``buckets`` rows reach the driver."""
    counted = texts.select("text").mapInArrow(_count(buckets), "bucket long, n long")
    return {r.bucket: r.n for r in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect()}


def gains(corpus: dict[int, int], target: dict[int, int], buckets: int = BUCKETS) -> np.ndarray:
    """1000 times the logarithm of how much more often the target has the bucket, floored."""
    s_all, t_all = sum(corpus.values()), sum(target.values())
    return np.array([
        math.floor(1000 * math.log(
            (target.get(b, 0) + 1.0) * (s_all + float(buckets)) / ((corpus.get(b, 0) + 1.0) * (t_all + float(buckets)))
        ))
        for b in range(buckets)
    ], dtype=np.int64)


def draw(doc_id: int | None, seed: int = SEED) -> int:
    """A Gumbel draw in thousandths, from the id alone."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _score(gain: np.ndarray, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for rows, texts in _texts(batch):
                owner, hashes, words = features(texts)
                n = np.bincount(owner, minlength=len(texts))
                total = np.zeros(len(texts), dtype=np.int64)
                np.add.at(total, owner, gain[hashes % len(gain)])
                weight = total // np.maximum(n, 1)
                own = ids[rows.start : rows.stop]
                score = weight + np.array([draw(i, seed) for i in own.to_pylist()], dtype=np.int64)
                yield pa.RecordBatch.from_arrays(
                    [own, *(pa.array(x.astype(np.int64)) for x in (words, n, weight, score))],
                    ["doc_id", "n_words", "n_features", "weight", "score"],
                )

    return run


def score(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of every row."""
    arrow_rows(docs.sparkSession)
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    gain = gains(bucket_counts(docs, buckets), bucket_counts(target, buckets), buckets)
    return narrow.mapInArrow(_score(gain, seed), SCORED)


def resample(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, **options
) -> DataFrame:
    """``score`` of every row, with its rank in the sample; null where it is not drawn."""
    scored = stored(score(docs, target, **options), "scores")
    able = F.col("n_words") >= least_words
    size = percent * scored.where(able).count() // 100
    above = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    open_scores = (
        scored.where(able).groupBy("score").agg(F.count(F.lit(1)).alias("n"))
        .withColumn("above", F.coalesce(F.sum("n").over(above), F.lit(0)))
        .where(F.col("above") < size).select("score", "above")
    )
    least = open_scores.agg(F.min("score")).first()[0]
    fields = ["doc_id", "n_features", "weight", "score"]
    no_rank = F.lit(None).cast("long").alias("rank")
    if least is None:
        return scored.select(*fields, no_rank)
    within = Window.partitionBy("score").orderBy(F.asc_nulls_last("doc_id"), "n_features", "weight")
    near = able & (F.col("score") >= least)
    ranked = (
        scored.where(near).join(broadcast_within(open_scores), "score")
        .withColumn("rank", F.col("above") + F.row_number().over(within))
        .withColumn("rank", F.when(F.col("rank") <= size, F.col("rank")))
    )
    return ranked.select(*fields, "rank").unionByName(scored.where(~near).select(*fields, no_rank))

