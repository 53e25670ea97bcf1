"""Audit of the sources of each language: how far their word frequencies lie apart.

A first pass counts in how many documents of its language each term stands; terms in enough of them
are kept. The kept terms of a language become shards of minimal perfect hashes with stored keys. A
second pass over the texts looks every term up in the broadcast shards, compares the stored key, and
adds one to a dense array of slots of the document's (language, source) group. Arrays are summed by
slot, smoothed to parts per billion in exact whole numbers, and compared.

The shards are broadcast in rounds of at most ``broadcast_bytes``, one pass over the texts each, so a
vocabulary of any size is counted in full. Distances between sources come from dense blocks of
sources x slots of bounded size, so no row per pair and term is made.

Defined results: null text, language and source are empty; every row is a document, repeated ones
too; a source without terms has the smoothed share of no term everywhere; a language without kept
terms gives pairs of value 0; other columns are left behind; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vanewatch.llm import perfect_hash, ragged
from vanewatch.llm.common import arrow_rows, stored
from vanewatch.llm.symbols import blocks, word_spans
from vanewatch.operators.joins import broadcast_within

LEAST_DOCS = 30
SMOOTHING = 5
SCALE = 1_000_000_000
TOP = 50
BROADCAST_BYTES = 48 * 1024 * 1024

#: Lower case for A-Z, a blank for every other ASCII sign that is no letter.
TERMS = np.array([c + 32 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256)], np.uint8)

#: Entries that a task gathers before it hands them on.
GATHERED = 300_000
#: Cells of the dense arrays of a task, and of a block of sources x slots.
CELLS = 2_000_000
BLOCK_CELLS = 1 << 16

SHARDS = "lang string, shard int, displacements binary, key_sizes binary, keys binary, clash boolean"


def _narrow(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])


def _document_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, term, n): documents of a task that hold the term."""
    table, held = TERMS.tobytes(), Counter()

    def rows() -> pa.RecordBatch:
        langs, terms = zip(*held) if held else ((), ())
        batch = pa.RecordBatch.from_arrays(
            [pa.array(langs, pa.string()), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(held.values(), pa.int64())],
            ["lang", "term", "n"],
        )
        held.clear()
        return batch

    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
            held.update((lang, term) for term in set(text.translate(table).split()))
            if len(held) >= GATHERED:
                yield rows()
    yield rows()


def kept_terms(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang, term) of the terms in at least ``least_docs`` documents of their language."""
    counted = _narrow(docs).mapInArrow(_document_terms, "lang string, term string, n long")
    return counted.groupBy("lang", "term").agg(F.sum("n").alias("n")).where(F.col("n") >= least_docs).drop("n")


def _dealt(seed: int):
    """Terms with their shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, sizes = ragged.contents(batch.column("term").cast(pa.binary()))
            lo = np.cumsum(sizes) - sizes
            h = perfect_hash.hashes(data, lo, lo + sizes, seed)
            shard = (h % batch.column("n_shards").to_numpy().astype(np.uint64)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(shard), batch.column("term")], ["lang", "shard", "term"])

    return run


def _built(seed: int):
    """One row per (lang, shard) with its terms in order of slot."""

    def run(shard: pa.Table) -> pa.Table:
        column = pa.concat_arrays(shard.column("term").chunks).cast(pa.binary())
        data, sizes = ragged.contents(column)
        lo = np.cumsum(sizes) - sizes
        h = perfect_hash.hashes(data, lo, lo + sizes, seed)
        moves = perfect_hash.build(h)
        clash = moves is None
        if clash:
            moves, order = np.zeros(0, dtype=np.int64), np.arange(0)
        else:
            n = np.array([len(h)])
            order = np.argsort(perfect_hash._slots(h, moves[perfect_hash._buckets(h, n)], n))
        keys = ragged.gather(data, lo[order], sizes[order])
        row = [
            shard.column("lang")[0].as_py(), shard.column("shard")[0].as_py(), moves.astype(np.int32).tobytes(),
            sizes[order].astype(np.int32).tobytes(), keys.tobytes(), clash,
        ]
        names = ["lang", "shard", "displacements", "key_sizes", "keys", "clash"]
        kinds = [pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.bool_()]
        return pa.table([pa.array([v], t) for v, t in zip(row, kinds)], names=names)

    return run


def perfect_shards(kept: DataFrame, sizes: DataFrame) -> tuple[DataFrame, int]:
    """(shards, seed): perfect hashes of the kept terms; ``sizes`` has lang and n_shards."""
    for seed in range(100):
        dealt = kept.join(broadcast_within(sizes), "lang").mapInArrow(_dealt(seed), "lang string, shard int, term string")
        shards = stored(dealt.groupBy("lang", "shard").applyInArrow(_built(seed), SHARDS), "perfect-hashes")
        if shards.where("clash").isEmpty():
            return shards, seed
    raise RuntimeError("equal hashes under every seed")


def _slot_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, slot, term) of every stored key."""
    for batch in batches:
        for row in batch.to_pylist():
            sizes = np.frombuffer(row["key_sizes"], dtype=np.int32)
            terms = ragged.binaries(np.frombuffer(row["keys"], dtype=np.uint8), sizes).cast(pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["lang"]] * len(sizes)), pa.array((row["shard"] << 32) + np.arange(len(sizes))), terms],
                ["lang", "slot", "term"],
            )


def _recount(shared, seed: int):
    """(lang, source, slots, counts): occurrences of the terms of the broadcast shards in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_lang: dict[str, list] = {}
        for row in shared.value:
            by_lang.setdefault(row["lang"], []).append(row)
        indexes = {lang: perfect_hash.Index(rows, rows[0]["n_shards"]) for lang, rows in by_lang.items()}
        dense: dict[tuple[str, str], np.ndarray] = {}
        cells = 0
        for batch in batches:
            batch = pa.Table.from_batches([batch]).sort_by([("lang", "ascending"), ("source", "ascending")])
            batch = batch.combine_chunks().to_batches()[0] if batch.num_rows else None
            if batch is None:
                continue
            runs = batch.column("lang").to_pylist(), batch.column("source").to_pylist()
            for rows, data, offsets in blocks(batch.column("text")):
                data = TERMS[data]
                starts, ends, firsts = word_spans(data, offsets)
                h = perfect_hash.hashes(data, starts, ends, seed)
                langs, sources = (x[rows.start : rows.stop] for x in runs)
                place = np.full(len(starts), -1, dtype=np.int64)
                for a, b, lang, _ in _stretches(langs, langs):
                    if lang in indexes:
                        own = slice(firsts[a], firsts[b])
                        place[own] = indexes[lang].find(data, starts[own], ends[own], h[own])
                for a, b, lang, source in _stretches(langs, sources):
                    if lang not in indexes:
                        continue
                    size = len(indexes[lang])
                    if (lang, source) not in dense:
                        if cells + size > CELLS and dense:
                            yield from _handed_on(dense, indexes)
                            dense, cells = {}, 0
                        dense[lang, source] = np.zeros(size, dtype=np.int64)
                        cells += size
                    own = place[firsts[a] : firsts[b]]
                    np.add.at(dense[lang, source], own[own >= 0], 1)
        yield from _handed_on(dense, indexes)

    return run


def _stretches(langs: list[str], sources: list[str]) -> Iterator[tuple[int, int, str, str]]:
    a = 0
    for b in range(1, len(langs) + 1):
        if b == len(langs) or (langs[b], sources[b]) != (langs[a], sources[a]):
            yield a, b, langs[a], sources[a]
            a = b


def _handed_on(dense: dict, indexes: dict) -> Iterator[pa.RecordBatch]:
    for (lang, source), counts in dense.items():
        held = np.flatnonzero(counts)
        for part in np.array_split(held, len(held) // 20_000 + 1):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang]), pa.array([source]),
                    *(pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), pa.array(x[part]))
                      for x in (indexes[lang].slots, counts)),
                ],
                ["lang", "source", "slots", "counts"],
            )


def recount(docs: DataFrame, shards: DataFrame, seed: int, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(lang, source, slot, n): how often each kept term stands in the texts of each group."""
    spark = docs.sparkSession
    width = F.octet_length("keys") + F.octet_length("key_sizes") + F.octet_length("displacements") + F.lit(200)
    total = shards.agg(F.sum(width).alias("n")).first()["n"] or 0
    rounds = -(-total * 5 // (4 * broadcast_bytes)) or 1  # shards differ a little in size
    parts = []
    for k in range(rounds):
        # within broadcast_bytes, by the sum above
        mine = shards.where(F.pmod(F.xxhash64("lang", "shard"), F.lit(rounds)) == k).drop("clash").collect()
        shared = spark.sparkContext.broadcast([r.asDict() for r in mine])
        counted = _narrow(docs).mapInArrow(
            _recount(shared, seed), "lang string, source string, slots array<long>, counts array<long>"
        )
        parts.append(counted.select("lang", "source", F.inline(F.arrays_zip("slots", "counts")).alias("slot", "n")))
    return reduce(DataFrame.unionByName, parts).groupBy("lang", "source", "slot").agg(F.sum("n").alias("n"))


def _share(n: Column) -> Column:
    """Smoothed parts per billion of ``n`` occurrences; exact, in decimals."""
    whole = lambda c: c.cast("decimal(20,0)")
    above = whole(F.lit(SCALE)) * whole(n + F.lit(SMOOTHING))
    below = whole(F.col("total") + F.lit(SMOOTHING) * F.col("vocabulary"))
    return (F.lit(1) + F.call_function("div", above, below)).cast("long")


def _distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, one, two, value): summed distances of two sources over the slots of one block.

    Rows of a block come one after the other, first one row for each source with its share of no
    occurrences (slot null).
    """
    held: list[pa.RecordBatch] = []
    key = None

    def ended() -> Iterator[pa.RecordBatch]:
        block = pa.Table.from_batches(held)
        source, share = block.column("number").to_numpy(), block.column("share").to_numpy()
        is_base = block.column("slot").is_null().to_numpy()
        base = np.zeros(int(is_base.sum()), dtype=np.int64)
        base[source[is_base]] = share[is_base]
        slots, at = np.unique(block.filter(pc.invert(block.column("slot").is_null())).column("slot").to_numpy(), return_inverse=True)
        dense = np.repeat(base[:, None], max(len(slots), 1), axis=1)[:, : len(slots)]
        dense[source[~is_base], at] = share[~is_base]
        for i in range(len(base) - 1):
            value = np.abs(dense[i + 1 :] - dense[i]).sum(axis=1)
            two = np.arange(i + 1, len(base))
            yield pa.RecordBatch.from_arrays(
                [pa.array([key[0]] * len(two), pa.string()), pa.array(np.full(len(two), i)), pa.array(two), pa.array(value)],
                ["lang", "one", "two", "value"],
            )

    for batch in batches:
        langs, blocks_ = batch.column("lang").to_pylist(), batch.column("block").to_pylist()
        for a, b, *new in _stretches(langs, blocks_):
            if tuple(new) != key and held:
                yield from ended()
                held = []
            key = tuple(new)
            held.append(batch.slice(a, b - a))
    if held:
        yield from ended()


def audit(
    docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """(lang, source, part, item, value, rank) of every group of language and source.

    Part ``pair`` has a row for each other source of the language: its distance over all kept
    terms. Part ``term`` has up to ``top`` terms that the source uses more than its language does.
    """
    arrow_rows(docs.sparkSession)
    kept = stored(kept_terms(docs, least_docs), "kept-terms")
    vocabulary = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("vocabulary"))
    n_shards = F.ceil(F.col("vocabulary") / perfect_hash.SHARD_KEYS).cast("long")
    shards, seed = perfect_shards(kept, vocabulary.select("lang", n_shards.alias("n_shards")))
    shards = shards.join(broadcast_within(vocabulary.select("lang", n_shards.alias("n_shards"))), "lang")
    cells = stored(recount(docs, shards, seed, broadcast_bytes), "cells")

    by_name = Window.partitionBy("lang").orderBy("source")
    figures = stored(
        _narrow(docs).select("lang", "source").distinct()
        .join(cells.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left")
        .join(vocabulary, "lang", "left")
        .select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"),
                F.coalesce("vocabulary", F.lit(0)).alias("vocabulary"),
                (F.row_number().over(by_name) - 1).cast("long").alias("number")),
        "groups",
    )
    shares = cells.join(broadcast_within(figures), ["lang", "source"]).withColumn("share", _share(F.col("n")))
    return _pairs(shares, figures).unionByName(_terms(cells, shares, shards, figures, top))


def _pairs(shares: DataFrame, figures: DataFrame) -> DataFrame:
    langs = figures.groupBy("lang").agg(F.count(F.lit(1)).alias("sources"), F.max("vocabulary").alias("terms"))
    n_blocks = F.greatest(F.lit(1), F.ceil(F.col("terms") * F.col("sources") / BLOCK_CELLS)).cast("int")
    langs = broadcast_within(langs.select("lang", n_blocks.alias("n_blocks")))
    none = F.when(F.col("vocabulary") > 0, _share(F.lit(0))).otherwise(F.lit(0))
    bases = figures.join(langs, "lang").select(
        "lang", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("block"), "number",
        F.lit(None).cast("long").alias("slot"), none.alias("share"),
    )
    dealt = shares.join(langs, "lang").select(
        "lang", F.pmod(F.xxhash64("slot"), F.col("n_blocks")).cast("int").alias("block"), "number", "slot", "share"
    )
    value = (
        bases.unionByName(dealt).repartition("lang", "block").sortWithinPartitions("lang", "block")
        .mapInArrow(_distances, "lang string, one long, two long, value long")
        .groupBy("lang", "one", "two").agg(F.sum("value").alias("value"))
    )
    both = value.unionByName(value.select("lang", F.col("two").alias("one"), F.col("one").alias("two"), "value"))
    names = broadcast_within(figures.select("lang", "source", "number"))
    named = (
        both.join(names.withColumnRenamed("number", "one"), ["lang", "one"])
        .join(names.select("lang", F.col("source").alias("item"), F.col("number").alias("two")), ["lang", "two"])
    )
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return named.select(
        "lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank")
    )


def _terms(cells: DataFrame, shares: DataFrame, shards: DataFrame, figures: DataFrame, top: int) -> DataFrame:
    whole = figures.groupBy("lang").agg(F.sum("total").alias("total"), F.max("vocabulary").alias("vocabulary"))
    common = (
        cells.groupBy("lang", "slot").agg(F.sum("n").alias("n"))
        .join(broadcast_within(whole), "lang")
        .select("lang", "slot", _share(F.col("n")).alias("common"))
    )
    terms = shards.select("lang", "shard", "key_sizes", "keys").mapInArrow(_slot_terms, "lang string, slot long, term string")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return (
        shares.join(broadcast_within(stored(common.join(terms, ["lang", "slot"]), "common-shares")), ["lang", "slot"])
        .where("share > common")
        .select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
                (F.col("share") - F.col("common")).alias("value"))
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= top)
    )
