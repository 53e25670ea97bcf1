"""Benchmark decontamination by templates.

Texts are made canonical word by word: numbers, names and units become typed placeholders, other
words lose case and outer punctuation. Windows of the canonical words are templates. Templates of
benchmark items and documents meet in a hash join. What stood in the placeholders is compared
next: along one alignment of a document with an item, each value of the item corresponds to the
value of the document that stands in more than half of its places, and windows with another value
do not count. So a question asked again with other numbers or names is found, and a text that only
shares a pattern of placeholders is not.

A capitalised word that begins a sentence may be a name or not. It has both forms, as have words
after any other break: every window stands under each choice, so that a form agrees with the same
word in mid-sentence, in lower case, and with another name.

Beside the templates the lower-cased words themselves are joined, without placeholders and without
a least number of literal words: a copy word for word is found whatever it consists of. In scripts
without spaces every character is a word.

A document is contaminated by an item if consistent windows cover ``COVER_PERCENT`` of the item's
words, or ``COVER_WORDS`` of them.

Template hashes of the benchmark also thin out the documents' windows before the join, as long as
they measure less than ``FILTER_BYTES``; past that, every window goes to the join.

Defined results: null texts have no words; items with fewer than ``LEAST_WORDS`` words, or
characters of a script without spaces, match nothing, an item shorter than a window is one window; a null id is judged by its own text;
repeated rows, documents or items, give repeated results; an empty benchmark contaminates nothing.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vanewatch.llm.common import stored
from vanewatch.llm.symbols import Sums, blocks, owners, word_spans
from vanewatch.operators.joins import broadcast_within

WINDOW = 8
LEAST_WORDS = 4
#: Words of a window that must stand for themselves; half of them in shorter items.
LITERALS = 4
COVER_PERCENT = 50
COVER_WORDS = 20
FILTER_BYTES = 64 * 1024 * 1024

# Number words and units.
NUMBER_WORDS = frozenset(
    "zero one two three four five six seven eight nine ten eleven twelve twenty thirty forty fifty "
    "sixty seventy eighty ninety hundred thousand million billion".split()
)
UNITS = frozenset(
    "km m cm mm mi mile miles ft foot feet inch inches yd yard yards kg g mg lb lbs oz ounce ounces "
    "pound pounds ton tons l ml liter liters litre litres gallon gallons s sec second seconds min "
    "minute minutes h hr hour hours day days week weeks month months year years kmh mph percent "
    "dollar dollars euro euros cent cents degree degrees meter meters metre metres gram grams "
    "kilogram kilograms kilometer kilometers kilometre kilometres".split()
)

EDGE = re.compile(r"^[\W_]+|[\W_]+$")
DIGIT = re.compile(r"\d")
#: Punctuation at either end of a word parts it from its neighbour.
BEFORE, AFTER = re.compile(r"^[\W_]"), re.compile(r"[\W_]$")
ALNUM = np.array([c for c in range(128) if chr(c).isalnum()], dtype=np.uint8)
PLAIN, NUMBER, UNIT, CAPITAL = range(4)
#: Symbols of the placeholders, in the order of the kinds.
HOLDER = np.array([0, 11, 22, 33], dtype=np.uint64)

#: Code points of scripts without spaces: Thai to Tibetan, Burmese, Khmer, kana, Han.
UNSPACED = ((0x0E00, 0x0FFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x3400, 0x4DBF),
            (0x4E00, 0x9FFF), (0xF900, 0xFAFF))

WINDOWS = (
    "row long, hash long, start int, width int, n_words int, slots array<long>, places array<int>, "
    "owner long"
)
WINDOW_NAMES = [part.split(" ")[0] for part in WINDOWS.split(", ")]


def _kinds(words: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Canonical form, kind, and whether a break stands before or after it, of distinct words."""
    forms, kinds = [], np.zeros(len(words), dtype=np.int64)
    starts, stops = np.zeros(len(words), dtype=bool), np.zeros(len(words), dtype=bool)
    for i, word in enumerate(words):
        bare = EDGE.sub("", word)
        form = bare.lower()
        forms.append(form or word)
        starts[i], stops[i] = BEFORE.search(word) is not None, AFTER.search(word) is not None
        if DIGIT.search(form) or form in NUMBER_WORDS:
            kinds[i] = NUMBER
        elif form in UNITS:
            kinds[i] = UNIT
        elif bare[:1].isupper():
            kinds[i] = CAPITAL
    return forms, kinds, starts, stops


def _parted(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, firsts: np.ndarray):
    """Word spans with every letter of a script without spaces as a word.

    Combining marks start a word too, alike in all texts; punctuation stays with what precedes it.
    """
    lead = np.flatnonzero(data >= 0xE0)
    if len(lead) == 0:
        return starts, ends, firsts
    near = [data[np.minimum(lead + k, len(data) - 1)].astype(np.int64) for k in range(3)]
    code = (near[0] & 15) << 12 | (near[1] & 63) << 6 | near[2] & 63
    own = (near[0] == 0xF0) & (near[1] >= 0xA0)
    for low, high in UNSPACED:
        own |= (near[0] < 0xF0) & (code >= low) & (code <= high)
    if not own.any():
        return starts, ends, firsts
    lead, wide = lead[own], near[0][own] >= 0xF0
    after = lead + 3 + wide
    after = after[after < len(data)]
    one, two = data[after], data[np.minimum(after + 1, len(data) - 1)]
    letter = np.isin(one, ALNUM) | (one >= 0xC3) & ~((one == 0xE2) | (one == 0xE3) & (two == 0x80))
    letter &= ~((one == 0xEF) & ((two == 0xBC) | (two == 0xBD)))
    cuts = np.unique(np.concatenate([starts, lead, after[letter]]))
    word = np.searchsorted(starts, cuts, side="right") - 1
    inside = cuts < ends[word]
    cuts, word = cuts[inside], word[inside]
    stops = np.minimum(np.append(cuts[1:], len(data)), ends[word])
    return cuts, stops, np.append(np.searchsorted(cuts, starts), len(cuts))[firsts]


def canonical(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(symbols, values, is placeholder, may be a name too, first word of each document) of a block.

    A unit is a placeholder only after a number. A capitalised word is a name within a sentence;
    after a break it is literal and may be a name too.
    """
    starts, ends, firsts = _parted(data, *word_spans(data, offsets))
    hashes = Sums(data).spans(starts, ends)
    _, first, which = np.unique(hashes, return_index=True, return_inverse=True)
    words = [data[a:b].tobytes().decode() for a, b in zip(starts[first], ends[first])]
    forms, kinds, parts, stops = _kinds(words)
    raw = [f.encode() for f in forms]
    edges = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    values = Sums(np.frombuffer(b"".join(raw), dtype=np.uint8)).spans(edges[:-1], edges[1:])[which]
    kind, stop = kinds[which], stops[which]
    begins = parts[which]
    n = len(which)
    opens = np.zeros(n, dtype=bool)
    opens[firsts[:-1][np.diff(firsts) > 0]] = True
    before = np.zeros(n, dtype=np.int64)
    before[1:] = kind[:-1]
    begins |= opens
    if n:
        breaks = np.concatenate([[0], np.cumsum(data == 0x0A)])
        begins[1:] |= stop[:-1] | (breaks[starts[1:]] > breaks[ends[:-1]])
    held = np.where(
        kind == NUMBER, True,
        np.where(kind == UNIT, (before == NUMBER) & ~opens, (kind == CAPITAL) & ~begins),
    )
    return np.where(held, HOLDER[kind], values), values, held, (kind == CAPITAL) & begins, firsts


def _among(wanted: np.ndarray):
    """Which hashes are in the sorted ``wanted``; most others are told apart by their first bits."""
    bits = min(24, max(16, len(wanted).bit_length() + 4))
    shift = np.uint64(64 - bits)
    some = np.zeros(1 << bits, dtype=bool)
    some[wanted >> shift] = True

    def run(hashes: np.ndarray) -> np.ndarray:
        maybe = np.flatnonzero(some[hashes >> shift])
        if len(maybe) == 0:
            return maybe
        spot = np.minimum(np.searchsorted(wanted, hashes[maybe]), len(wanted) - 1)
        return maybe[wanted[spot] == hashes[maybe]]

    return run


def _forms(data: np.ndarray, offsets: np.ndarray, widths: list[int]):
    """The words of a block, then (width, places, hashes, turned) of each form of its windows.

    ``turned`` tells the placeholders of the window at a place; it is None for plain words.
    """
    symbols, values, held, either, firsts = canonical(data, offsets)
    doc = owners(firsts)
    templates, plain = Sums(symbols), Sums(values)
    literal = np.concatenate([[0], np.cumsum(~held)])
    open_at = np.flatnonzero(either)
    opened = np.concatenate([[0], np.cumsum(either)])
    changes = templates.changes(open_at, np.full(len(open_at), HOLDER[CAPITAL]))

    def placed(width: int, names: list[int]):
        def run(a: int) -> np.ndarray:
            flags = held[a : a + width].copy()
            flags[open_at[opened[a] + np.array(names, dtype=np.int64)] - a] = True
            return flags

        return run

    def each():
        for width in widths:
            n = len(values) - width + 1
            if n <= 0:
                continue
            whole = doc[:n] == doc[width - 1 :]
            literals = literal[width:] - literal[:-width]
            least = min(LITERALS, -(-width // 2))
            at = np.flatnonzero(whole & (literals >= least))
            yield width, at, templates.windows(width)[at], placed(width, [])
            free = opened[width:] - opened[:-width]
            # every choice of names among the first, second, ... open word of the windows
            for choice in range(1, 1 << min(int(free[at].max(initial=0)), width)):
                names = [j for j in range(choice.bit_length()) if choice >> j & 1]
                if len(names) > width - least:
                    continue
                if len(names) == 1:
                    at = at[free[at] >= choice.bit_length()]
                some = at[literals[at] - len(names) >= least]
                if len(some):
                    change = sum(changes[opened[some] + j] for j in names)
                    yield width, some, templates.windows_at(some, width, change), placed(width, names)
            at = np.flatnonzero(whole & (literals < width))
            yield width, at, plain.windows(width)[at], None

    return values, firsts, doc, each()


def _windows(widths: list[int], wanted: np.ndarray | None):
    """Template and plain windows of (row, owner, text); only hashes in ``wanted`` if given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if wanted is not None and len(wanted) == 0:
            return
        among = None if wanted is None else _among(wanted)
        for batch in batches:
            row_ids = batch.column("row").to_numpy(zero_copy_only=False)
            owner_ids = batch.column("owner")
            for rows, data, offsets in blocks(batch.column("text")):
                values, firsts, doc, forms = _forms(data, offsets, widths)
                sizes = np.diff(firsts)
                for width, at, hashes, turned in forms:
                    if among is not None:
                        hit = among(hashes)
                        at, hashes = at[hit], hashes[hit]
                    if len(at) == 0:
                        continue
                    own = doc[at]
                    heads = at - firsts[own]
                    spots = [
                        np.flatnonzero(turned(a)) if turned else np.zeros(0, dtype=np.int64) for a in at
                    ]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(row_ids[own + rows.start].astype(np.int64)),
                            pa.array(hashes.view(np.int64)),
                            pa.array(heads.astype(np.int32)),
                            pa.array(np.full(len(at), width, dtype=np.int32)),
                            pa.array(sizes[own].astype(np.int32)),
                            pa.array([values[a + s].view(np.int64) for a, s in zip(at, spots)], pa.list_(pa.int64())),
                            pa.array([(h + s).astype(np.int32) for h, s in zip(heads, spots)], pa.list_(pa.int32())),
                            owner_ids.take(pa.array(own + rows.start)),
                        ],
                        WINDOW_NAMES,
                    )

    return run


def _row(df: DataFrame, owner: str) -> DataFrame:
    return df.select(
        F.xxhash64(owner, "text").alias("row"), F.col(owner).cast("long").alias("owner"), "text"
    )


def item_windows(items: DataFrame) -> tuple[DataFrame, list[int]]:
    """Windows of the benchmark; short items have windows of their own length."""
    every = list(range(LEAST_WORDS, WINDOW + 1))
    found = _row(items, "item_id").mapInArrow(_windows(every, None), WINDOWS).where(
        (F.col("width") == WINDOW) | (F.col("width") == F.col("n_words"))
    )
    found = stored(found, "benchmark-windows")
    return found, sorted({r["width"] for r in found.select("width").distinct().collect()})


def _filter(windows: DataFrame, most: int) -> np.ndarray | None:
    """Sorted template hashes if they measure at most ``most`` bytes, else None."""
    distinct = windows.select("hash").distinct()
    if distinct.count() * 8 > most:
        return None
    got = np.array([r["hash"] for r in distinct.toLocalIterator()], dtype=np.int64)
    return np.sort(got.view(np.uint64))


AGREEING = "row long, owner long, item long, item_id long, item_words int, words array<int>"


def _agreeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The item's words that an alignment covers, without windows off the value of the majority."""
    for batch in batches:
        words = []
        for windows in batch.column("windows").to_pylist():
            pairs = {
                (place, a, b)
                for w in windows for place, a, b in zip(w["item_places"], w["item_slots"], w["slots"])
            }
            each, both = Counter(a for _, a, _ in pairs), Counter((a, b) for _, a, b in pairs)
            held: set[int] = set()
            for w in windows:
                if all(2 * both[a, b] > each[a] for a, b in zip(w["item_slots"], w["slots"])):
                    held.update(range(w["item_start"], w["item_start"] + w["width"]))
            words.append(sorted(held))
        names = batch.schema.names[:-1]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in names), pa.array(words, pa.list_(pa.int32()))], [*names, "words"]
        )


def matches(docs: DataFrame, items: DataFrame, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """(row, doc_id, item_id, covered, item_words) of contaminated rows."""
    theirs, widths = item_windows(items)
    wanted = _filter(theirs, filter_bytes)
    ours = _row(docs, "doc_id").mapInArrow(_windows(widths, wanted), WINDOWS)
    right = broadcast_within(
        theirs.select(
            F.col("hash").alias("_hash"), F.col("width").alias("_width"), F.col("row").alias("item"),
            F.col("owner").alias("item_id"), F.col("start").alias("item_start"),
            F.col("n_words").alias("item_words"), F.col("slots").alias("item_slots"),
            F.col("places").alias("item_places"),
        ).distinct()
    )
    line = ["row", "owner", "item", "item_id", "item_words", "shift"]
    aligned = (
        ours.select("row", "owner", "hash", "width", "start", "slots").distinct()
        .join(right, (F.col("hash") == F.col("_hash")) & (F.col("width") == F.col("_width")))
        .withColumn("shift", F.col("start") - F.col("item_start"))
        .groupBy(*line)
        .agg(
            F.collect_set(F.struct("item_start", "width", "item_places", "item_slots", "slots")).alias("windows")
        )
        .drop("shift")
        .mapInArrow(_agreeing, AGREEING)
    )
    words = F.array_distinct(F.flatten(F.collect_list("words")))
    return (
        aligned.groupBy("row", F.col("owner").alias("doc_id"), "item", "item_id", "item_words")
        .agg(F.size(words).cast("long").alias("covered"))
        .where(
            (F.col("covered") * 100 >= F.col("item_words") * COVER_PERCENT)
            | (F.col("covered") >= COVER_WORDS)
        )
        .select("row", "doc_id", "item_id", "covered", "item_words")
    )


def contamination(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """``docs`` with (contaminated, item_ids): the benchmark items each row holds, by id.

    Columns of ``docs`` with one of these names, or ``_row`` or ``_at``, are left behind.
    """
    docs = docs.drop("contaminated", "item_ids", "_row", "_at")
    found = stored(
        matches(docs, items, **options).groupBy(F.col("row").alias("_row"))
        .agg(F.sort_array(F.collect_set("item_id")).alias("item_ids")),
        "contaminated",
    )
    return (
        docs.withColumn("_at", F.xxhash64("doc_id", "text"))
        .join(broadcast_within(found), F.col("_at") == F.col("_row"), "left")
        .select(
            *docs.columns, F.col("_row").isNotNull().alias("contaminated"),
            F.coalesce("item_ids", F.array().cast("array<long>")).alias("item_ids"),
        )
    )
