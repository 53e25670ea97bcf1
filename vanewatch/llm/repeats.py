"""Repeated stretches across all documents: what operators 8 and 9 share.

A text is a row of symbols, bytes or words, and a window is ``window`` of them. The job finds
every window that also starts at an earlier place, in four deals of the data:

1. Each document marks anchors, places whose gram hash is least within some window. Equal windows
   have the same anchors, so whatever repeats meets under an equal anchor. The context of an
   anchor, all windows around it, is hashed too. Within a task, equal contexts fall together:
   only the first travels, the later ones are repeats for certain.
2. Occurrences are dealt out by anchor. Equal contexts fall together again, this time across
   tasks. Different contexts of one anchor may share windows in part. A window holds the gram and
   at least half of its other symbols on one side, so the contexts must agree on the gram with
   that half before it or behind it; both are hashed in step 1. The part of a context around such
   a half is asked for only if a different context agrees on it.
3. Texts meet these requests and send the parts, dealt out by (anchor, side, half). Contexts that
   merely share an anchor never meet, so a common gram is split by what stands beside it.
4. Equal parts fall together; a suffix structure over those that remain, the method of the
   operator, finds the windows that start earlier elsewhere.

Removed stretches are then merged per document. A row's figures travel packed, one row for each
batch and task of the next step, so the shuffles move bytes rather than rows. Rows never outnumber
the items they carry.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vanewatch.llm.common import stored, task_count
from vanewatch.llm.symbols import BLOCK_BYTES, Sums, anchors, blocks, merged, mixed, word_spans

#: Where a null id stands in the order of documents.
LAST_ID = (1 << 63) - 1

OCCURRENCE, REMOVED, WANTED = 0, 1, 2
#: What a packed row may hold for each item besides its document.
ITEMS = {"lo": np.uint32, "span": np.uint32, "anchor": np.uint32, "place": np.uint8,
         "before": np.uint32, "behind": np.uint32, "code": np.uint64}
PACK_NAMES = ["kind", "bucket", "ids", "keys", "counts", *ITEMS]
PACK = ", ".join(f"{name} {'int' if i < 2 else 'binary'}" for i, name in enumerate(PACK_NAMES))
PARTS = "bucket int, ids binary, keys binary, lo binary, span binary, size binary, code binary, data binary"
PART_NAMES = [part.split(" ")[0] for part in PARTS.split(", ")]


@dataclass(frozen=True)
class Rule:
    """What counts as a repeat."""

    unit: str  # "bytes" or "words"
    window: int
    gram: int
    #: Do earlier places of the same document count, or only documents with a smaller id.
    within: bool

    @property
    def slack(self) -> int:
        """Symbols of a window besides the gram."""
        return self.window - self.gram

    @property
    def half(self) -> int:
        """Symbols that every window has before its gram, or else behind it."""
        return -(-self.slack // 2)


#: (ids, keys, lo, data, offsets, code) of parts, ordered by code, to removed stretches as
#: (part number, first symbol, past last symbol), counted inside the part.
Settle = Callable[..., tuple[np.ndarray, np.ndarray, np.ndarray]]


def read_symbols(rule: Rule, data: np.ndarray, offsets: np.ndarray):
    """(symbols, first symbol of each document, byte spans of the symbols or None)."""
    if rule.unit == "bytes":
        return data, offsets, None
    starts, ends, firsts = word_spans(data, offsets)
    return Sums(data).spans(starts, ends), firsts, (starts, ends)


def _ints(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False).astype(np.int64)


def _later(rule: Rule, doc: np.ndarray, lo: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Does each occurrence come after the occurrence ``first`` of its class."""
    after = doc > doc[first]
    if rule.within:
        after |= (doc == doc[first]) & (lo > lo[first])
    return after


def _pack(kind, bucket, ids, keys, row, **items) -> Iterator[pa.RecordBatch]:
    """Rows of one kind, one for each bucket; ``row`` points into ids and keys, equal ones adjoin."""
    if len(row) == 0:
        return
    small = np.uint16 if bucket.max() < 1 << 16 else np.int64
    order = np.argsort(bucket.astype(small), kind="stable")
    bucket, row = bucket[order], row[order]
    items = {name: values[order].astype(ITEMS[name]) for name, values in items.items()}
    cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
    columns: dict[str, list] = {name: [] for name in PACK_NAMES}
    for a, b in zip(cuts[:-1], cuts[1:]):
        heads = np.flatnonzero(np.concatenate([[True], row[a + 1 : b] != row[a : b - 1], [True]]))
        used = row[a:b][heads[:-1]]
        columns["kind"].append(kind)
        columns["bucket"].append(int(bucket[a]))
        columns["ids"].append(ids[used].tobytes())
        columns["keys"].append(keys[used].tobytes())
        columns["counts"].append(np.diff(heads).astype(np.uint32).tobytes())
        for name in ITEMS:
            columns[name].append(items[name][a:b].tobytes() if name in items else None)
    types = [pa.int32(), pa.int32()] + [pa.binary()] * (len(PACK_NAMES) - 2)
    yield pa.RecordBatch.from_arrays(
        [pa.array(columns[n], t) for n, t in zip(PACK_NAMES, types)], PACK_NAMES
    )


def _packs(batches: Iterator[pa.RecordBatch]) -> dict[str, np.ndarray]:
    """All packed rows of a task as flat arrays; ``bucket`` is repeated for each item."""
    kinds = {"ids": np.int64, "keys": np.int64, "counts": np.uint32, **ITEMS}
    parts: dict[str, list] = {name: [] for name in ["bucket", *kinds]}
    for batch in batches:
        for r in range(batch.num_rows):
            for name, kind in kinds.items():
                blob = batch.column(name)[r].as_buffer()
                if blob is not None:
                    parts[name].append(np.frombuffer(blob, dtype=kind))
            parts["bucket"].append(
                np.full(len(parts["lo"][-1]), batch.column("bucket")[r].as_py(), dtype=np.int64)
            )
    flat = {
        name: np.concatenate(got) if got else np.zeros(0, dtype=kinds.get(name, np.int64))
        for name, got in parts.items()
    }
    counts = flat.pop("counts")
    flat["ids"], flat["keys"] = np.repeat(flat["ids"], counts), np.repeat(flat["keys"], counts)
    flat["lo"], flat["span"] = flat["lo"].astype(np.int64), flat["span"].astype(np.int64)
    return flat


def _bucket(codes: np.ndarray, buckets: int) -> np.ndarray:
    return (codes.view(np.uint64) % np.uint64(buckets)).astype(np.int64)


def _around(rule: Rule, place: np.ndarray, span: np.ndarray) -> tuple[tuple, tuple]:
    """Where the parts of contexts begin and how long they are, before and behind their anchors.

    The first part holds the windows with ``half`` symbols or more before the gram, the second
    all others; both count from the begin of the context. A part shorter than a window holds none.
    """
    behind = np.maximum(place - (rule.slack - rule.half), 0)
    before = np.minimum(place - rule.half + rule.window, span)
    return (np.zeros_like(place), behind), (np.where(place < rule.half, 0, before), span - behind)


def _removed(ids, keys, lo, span, buckets: int) -> Iterator[pa.RecordBatch]:
    """Stretches of any documents, merged per document and packed by document."""
    if len(ids) == 0:
        return
    order = np.lexsort((keys, ids))
    ids, keys, lo, span = ids[order], keys[order], lo[order], span[order]
    fresh = np.concatenate([[True], (ids[1:] != ids[:-1]) | (keys[1:] != keys[:-1])])
    row = np.cumsum(fresh) - 1
    base = row << 32
    start, stop = merged(base + lo, base + lo + span)
    row, ids, keys = start >> 32, ids[fresh], keys[fresh]
    yield from _pack(
        REMOVED, _bucket(keys, buckets)[row], ids, keys, row,
        lo=start & 0xFFFFFFFF, span=stop - start,
    )


def _find_occurrences(rule: Rule, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = _ints(batch, "_id"), _ints(batch, "_key")
            found: list[tuple] = []
            for rows, data, offsets in blocks(batch.column("text")):
                symbols, firsts, _ = read_symbols(rule, data, offsets)
                sums = Sums(symbols)
                grams = sums.windows(rule.gram)
                ends = np.repeat(firsts[1:], np.diff(firsts))
                at = anchors(grams, ends, rule.window, rule.gram)
                own = np.searchsorted(firsts, at, side="right") - 1
                lo = np.maximum(at - rule.slack, firsts[own])
                hi = np.minimum(at + rule.window, firsts[own + 1])
                place, span = at - lo, hi - lo
                halves = []
                begin, size = _around(rule, place, span)
                for side, start, stop in (
                    (0, at - rule.half, at + rule.gram), (1, at, at + rule.gram + rule.half)
                ):
                    holds = np.flatnonzero(size[side] >= rule.window)
                    half = np.zeros(len(at), dtype=np.uint32)
                    half[holds] = sums.spans(start[holds], stop[holds]) >> np.uint64(32) | np.uint64(1)
                    halves.append(half)
                context = mixed(sums.spans(lo, hi) + place.astype(np.uint64))
                found.append((
                    grams[at], context, own + rows.start, lo - firsts[own], span, place, *halves
                ))
            if not found:
                continue
            anchor, context, row, lo, span, place, before, behind = map(np.concatenate, zip(*found))
            doc = ids[row]
            if np.any(doc[1:] < doc[:-1]):
                order = np.argsort(doc, kind="stable")
                anchor, context, row, lo, span, place, before, behind, doc = (
                    x[order] for x in (anchor, context, row, lo, span, place, before, behind, doc)
                )
            _, first, which = np.unique(context, return_index=True, return_inverse=True)
            later = _later(rule, doc, lo, first[which])
            yield from _removed(doc[later], keys[row[later]], lo[later], span[later], buckets)
            stay = ~later
            yield from _pack(
                OCCURRENCE, _bucket(anchor[stay], buckets), ids, keys, row[stay], lo=lo[stay],
                span=span[stay], anchor=anchor[stay] >> np.uint64(32), place=place[stay],
                before=before[stay], behind=behind[stay], code=context[stay],
            )

    return run


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Is each value one of the sorted ``known``."""
    if len(known) == 0:
        return np.zeros(len(values), dtype=bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def _compare_contexts(rule: Rule, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = []
        for batch in batches:
            kinds = batch.column("kind").to_numpy()
            done = batch.filter(pa.array(kinds == REMOVED))
            if done.num_rows:
                yield done
            packed.append(batch.filter(pa.array(kinds == OCCURRENCE)))
        got = _packs(packed)
        del packed
        order = np.lexsort((got["lo"], got["ids"]))
        doc, keys, lo, span, place, context = (
            got[n][order] for n in ("ids", "keys", "lo", "span", "place", "code")
        )
        anchor = (got["bucket"] << 32 | got["anchor"].astype(np.int64))[order].view(np.uint64)
        halves = [got[n][order] for n in ("before", "behind")]
        del got
        if len(doc) == 0:
            return
        _, first, which = np.unique(context, return_index=True, return_inverse=True)
        later = _later(rule, doc, lo, first[which])
        yield from _removed(doc[later], keys[later], lo[later], span[later], buckets)
        lone = np.zeros(len(doc), dtype=bool)
        lone[first] = True
        begin, size = _around(rule, place.astype(np.int64), span)
        found: list[tuple] = []
        for side, half in enumerate(halves):
            code = mixed(mixed(anchor + np.uint64(side << 63)) + half)
            seen, counts = np.unique(code[lone & (half > 0)], return_counts=True)
            want = np.flatnonzero(~later & (half > 0))
            want = want[_among(code[want], seen[counts > 1])]
            found.append((want, lo[want] + begin[side][want], size[side][want], code[want]))
        at, lo, span, code = map(np.concatenate, zip(*found))
        order = np.argsort(at, kind="stable")
        doc, keys, lo, span, code = doc[at[order]], keys[at[order]], lo[order], span[order], code[order]
        if len(doc) == 0:
            return
        row = np.cumsum(np.concatenate([[0], (doc[1:] != doc[:-1]) | (keys[1:] != keys[:-1])]))
        heads = np.concatenate([[0], np.flatnonzero(np.diff(row)) + 1])
        yield from _pack(
            WANTED, _bucket(keys, buckets), doc[heads], keys[heads], row, lo=lo, span=span, code=code
        )

    return run


def _per_document(columns: list[str]):
    """One row per document with its packed items in order."""
    names = ["_id", "_key", *columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = _packs(batches)
        if len(got["ids"]) == 0:
            return
        values = {"lo": got["lo"], "hi": got["lo"] + got["span"]}
        ranks = [got["lo"], got["keys"], got["ids"]]
        if "code" in columns:
            values["code"] = got["code"]
            ranks.insert(0, values["code"])
        order = np.lexsort(ranks)
        ids, keys = got["ids"][order], got["keys"][order]
        values = {name: value[order] for name, value in values.items()}
        cuts = np.flatnonzero(
            np.concatenate([[True], (ids[1:] != ids[:-1]) | (keys[1:] != keys[:-1]), [True]])
        )
        for part in range(0, len(cuts) - 1, 4096):
            edges = cuts[part : part + 4097]
            blobs = {
                c: [values[c][a:b].tobytes() for a, b in zip(edges[:-1], edges[1:])] for c in columns
            }
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[edges[:-1]]), pa.array(keys[edges[:-1]])]
                + [pa.array(blobs[c], pa.binary()) for c in columns],
                names,
            )

    return run


def _send_parts(rule: Rule, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = _ints(batch, "_id"), _ints(batch, "_key")
            found: list[tuple] = []
            pieces: list[bytes] = []
            for rows, data, offsets in blocks(batch.column("text")):
                _, firsts, spans = read_symbols(rule, data, offsets)
                for i in range(rows.start, rows.stop):
                    lo, hi = (np.frombuffer(batch.column(n)[i].as_buffer(), dtype=np.int64) for n in ("lo", "hi"))
                    code = np.frombuffer(batch.column("code")[i].as_buffer(), dtype=np.uint64)
                    alone = np.concatenate(  # repeated rows ask twice
                        [[True], (lo[1:] != lo[:-1]) | (code[1:] != code[:-1])]
                    )
                    lo, hi, code = lo[alone], hi[alone], code[alone]
                    base = firsts[i - rows.start]
                    if spans is None:
                        a, b = base + lo, base + hi
                    else:
                        a, b = spans[0][base + lo], spans[1][base + hi - 1]
                    pieces += [data[x:y].tobytes() for x, y in zip(a, b)]
                    found.append((np.full(len(lo), i), lo, hi - lo, b - a, code))
            if not found:
                continue
            row, lo, span, size, code = map(np.concatenate, zip(*found))
            bucket = _bucket(code, buckets)
            order = np.argsort(bucket, kind="stable")
            row, bucket = row[order], bucket[order]
            items = {
                "ids": ids[row], "keys": keys[row], "lo": lo[order], "span": span[order],
                "size": size[order].astype(np.int64), "code": code[order],
            }
            cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
            columns: dict[str, list] = {n: [] for n in PART_NAMES}
            for a, b in zip(cuts[:-1], cuts[1:]):
                columns["bucket"].append(int(bucket[a]))
                for name, values in items.items():
                    columns[name].append(values[a:b].tobytes())
                columns["data"].append(b"".join(pieces[x] for x in order[a:b]))
            types = [pa.int32()] + [pa.binary()] * (len(PART_NAMES) - 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[n], t) for n, t in zip(PART_NAMES, types)], PART_NAMES
            )

    return run


def _settle_parts(rule: Rule, settle: Settle, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"code": np.uint64, "data": np.uint8}
        parts: dict[str, list] = {n: [] for n in PART_NAMES[1:]}
        for batch in batches:
            for r in range(batch.num_rows):
                for name in parts:
                    kind = kinds.get(name, np.int64)
                    parts[name].append(np.frombuffer(batch.column(name)[r].as_buffer(), dtype=kind))
        if not parts["ids"]:
            return
        flat = {n: np.concatenate(v) for n, v in parts.items()}
        parts.clear()
        data = flat.pop("data")
        stop = np.cumsum(flat["size"])
        flat["start"] = stop - flat["size"]
        flat["same"] = mixed(_hashes(data, flat["start"], stop) + mixed(flat["code"]))
        order = np.lexsort((flat["lo"], flat["ids"], flat["code"]))
        flat = {n: values[order] for n, values in flat.items()}
        _, first, which = np.unique(flat["same"], return_index=True, return_inverse=True)
        later = _later(rule, flat["ids"], flat["lo"], first[which])
        yield from _removed(*(flat[n][later] for n in ("ids", "keys", "lo", "span")), buckets)
        seen, counts = np.unique(flat["code"][first], return_counts=True)
        left = ~later & _among(flat["code"], seen[counts > 1])
        ids, keys, lo, size, code, start = (
            flat[n][left] for n in ("ids", "keys", "lo", "size", "code", "start")
        )
        del flat
        if len(ids) == 0:
            return
        offsets = np.concatenate([[0], np.cumsum(size)])
        data = data[np.repeat(start - offsets[:-1], size) + np.arange(offsets[-1])]
        which, a, b = settle(ids, keys, lo, data, offsets, code)
        yield from _removed(ids[which], keys[which], lo[which] + a, b - a, buckets)

    return run


def _hashes(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hash of each of adjoining pieces, a block of them at a time."""
    out = np.zeros(len(start), dtype=np.uint64)
    at = 0
    while at < len(start):
        upto = max(int(np.searchsorted(stop, start[at] + BLOCK_BYTES, side="right")), at + 1)
        sums = Sums(data[start[at] : stop[upto - 1]])
        out[at:upto] = sums.spans(start[at:upto] - start[at], stop[at:upto] - start[at])
        at = upto
    return out


def shards(offsets: np.ndarray, code: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Ranges of parts of about ``size`` bytes; the parts of one code stay together."""
    groups = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1], [True]]))
    at = 0
    while at < len(groups) - 1:
        limit = offsets[groups[at]] + size
        upto = int(np.searchsorted(offsets[groups], limit, side="right")) - 1
        upto = min(max(upto, at + 1), len(groups) - 1)
        yield int(groups[at]), int(groups[upto])
        at = upto


def mark_repeats(docs: DataFrame, rule: Rule, settle: Settle) -> DataFrame:
    """``docs`` as (doc_id, _id, _key, text, lo, hi).

    ``lo`` and ``hi`` hold the removed stretches of symbols as packed 64-bit integers, null if
    there are none.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("_id"),
        F.xxhash64("doc_id", "text").alias("_key"), "text",
    )
    tasks = task_count(docs, F.octet_length("text"))
    occurrences = rows.select("_id", "_key", "text").mapInArrow(_find_occurrences(rule, tasks), PACK)
    compared = stored(
        occurrences.repartitionById(tasks, "bucket").mapInArrow(_compare_contexts(rule, tasks), PACK),
        "repeats",
    )
    wanted = (
        compared.where(F.col("kind") == WANTED)
        .repartitionById(tasks, "bucket")
        .mapInArrow(
            _per_document(["lo", "hi", "code"]),
            "_id long, _key long, lo binary, hi binary, code binary",
        )
    )
    key = ["_id", "_key"]
    settled = (
        rows.join(wanted.hint("merge"), key)
        .select("doc_id", "_id", "_key", "text", "lo", "hi", "code")
        .mapInArrow(_send_parts(rule, tasks), PARTS)
        .repartitionById(tasks, "bucket")
        .mapInArrow(_settle_parts(rule, settle, tasks), PACK)
    )
    removed = (
        compared.where(F.col("kind") == REMOVED)
        .unionByName(settled)
        .repartitionById(tasks, "bucket")
        .mapInArrow(_merge_removed, "_id long, _key long, lo binary, hi binary")
    )
    return rows.join(removed.hint("merge"), key, "left").select("doc_id", *key, "text", "lo", "hi")


def _merge_removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per document with its removed stretches, those that touch made one."""
    got = _packs(batches)
    merged_packs = _removed(got["ids"], got["keys"], got["lo"], got["span"], 1)
    del got
    yield from _per_document(["lo", "hi"])(merged_packs)
