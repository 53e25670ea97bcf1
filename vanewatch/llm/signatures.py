"""Near-duplicate documents by an inverted join on the coordinates of MinHash signatures.

Each text becomes its set of word shingles and a signature of ``COORDINATES`` minima. Texts with
equal sets fall together first. Every remaining text is posted under its coordinate-value pairs.
Texts similar enough to link agree on at least ``MATCHES`` coordinates (all but about one in a
million do), so each needs posting under its rarest pairs only: with pairs ordered by how many
texts hold them, two such texts share one of their first ``COORDINATES - MATCHES + 1`` pairs.
A pair that nobody else holds counts toward that prefix without a posting, so a text without near
copies posts nothing, however common some of its phrases are.

Lists are merged by leaders, the most central members: those whose coordinates most other texts
hold. Members meet their list's leader, collisions are counted over whole signatures, and what
stays above the threshold is confirmed on the full shingle sets. Confirmed links form components.
A list whose members are all in one component is skipped from then on. The others are completed
across components: lists of up to ``SHORT_LIST`` members are compared in full, members of longer
ones on what they do not have in common with a leader. Long lists that are connected by common
members share one leader, so no member is compared once for each component that leads its lists.

Let D(x) be the shingles that only one of x and the leader holds. Two texts u and v differ in
|D(u)| + |D(v)| - 2 |D(u) & D(v)| shingles, so a link needs a certain overlap of D(u) and D(v). Of
two texts in different components at least one is not linked with the leader; its D is large, and
then the overlap is at least about half of either. Members are posted under a prefix of D, rarest
shingles first. Each such list elects a leader of its own, which takes the members that differ
from the first leader alike into its component. What is then still apart is joined on the posted
shingles; places in the prefixes and bit sets of D, both exact bounds of the overlap, leave only
pairs that may be links.

Defined results: a null text and a text without words have an empty set and link with nothing; a
text shorter than a shingle is one shingle; rows with a null id are linked with nothing and
kept; rows with one id are one document, linked by any of its texts; repeated rows give repeated results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vanewatch.llm.common import stored
from vanewatch.llm.components import components
from vanewatch.llm.symbols import BLOCK_BYTES, Sums, blocks, mixed, owners, word_spans
from vanewatch.operators.joins import broadcast_within

SHINGLE = 5
COORDINATES = 48
#: Of 48 coordinates at similarity 0.85, 41 agree on average and fewer than 28 once in a million.
MATCHES = 28
PERCENT = 85
SHORT_LIST = 32
#: Words of 64 bits in the bit set of a text's differences from its leader.
BIT_WORDS = 8
SLACK = 1e-6

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
_draw = np.random.default_rng(2024)
FACTORS = _draw.integers(1, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SHIFTS = _draw.integers(0, 1 << 63, COORDINATES, dtype=np.uint64)

SIGNATURES = "doc_id long, n_shingles long, set_a long, set_b long, signature binary"


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of every shingle of a block, in order of documents, with repeats."""
    starts, ends, firsts = word_spans(data, offsets)
    words = Sums(Sums(LOWER[data]).spans(starts, ends))
    owner = owners(firsts)
    windows = words.windows(SHINGLE)
    at = np.flatnonzero(owner[: len(windows)] == owner[SHINGLE - 1 :]) if len(windows) else np.zeros(0, int)
    counts = np.diff(firsts)
    short = np.flatnonzero((counts > 0) & (counts < SHINGLE))
    hashes = np.concatenate([windows[at], words.spans(firsts[:-1][short], firsts[1:][short])])
    held = np.concatenate([owner[at], short])
    order = np.argsort(held, kind="stable")
    return hashes[order], held[order]


def _distinct(hashes: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each (shingle, document) once, in order of documents, and one key for the two."""
    keys = mixed(hashes + mixed(held.astype(np.uint64) + np.uint64(1)))
    first = np.sort(np.unique(keys, return_index=True)[1])
    return hashes[first], held[first], keys[first]


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, data, offsets in blocks(batch.column("text")):
            n = len(offsets) - 1
            hashes, held, _ = _distinct(*shingles(data, offsets))
            counts = np.bincount(held, minlength=n)
            full = np.flatnonzero(counts)
            heads = np.concatenate([[0], np.cumsum(counts[full])[:-1]]).astype(np.int64)
            least = np.zeros((n, COORDINATES), dtype=np.uint32)
            sums = np.zeros((2, n), dtype=np.uint64)
            if len(full):
                for i in range(COORDINATES):
                    drawn = np.minimum.reduceat(hashes * FACTORS[i] + SHIFTS[i], heads)
                    least[full, i] = (drawn >> np.uint64(32)).astype(np.uint32)
                sums[0, full] = np.add.reduceat(mixed(hashes), heads)
                sums[1, full] = np.add.reduceat(mixed(hashes + np.uint64(0x5BD1E995)), heads)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id")[rows.start : rows.stop], pa.array(counts.astype(np.int64)),
                    pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)),
                    pa.array([row.tobytes() for row in least], pa.binary()),
                ],
                ["doc_id", "n_shingles", "set_a", "set_b", "signature"],
            )


def _coordinates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings (pair, rep); the pair holds the coordinate in its upper half."""
    base = np.arange(COORDINATES, dtype=np.int64) << 32
    for batch in batches:
        if batch.num_rows == 0:
            continue
        blob = b"".join(batch.column("signature").to_pylist())
        values = np.frombuffer(blob, dtype=np.uint32).reshape(-1, COORDINATES).astype(np.int64)
        reps = batch.column("rep").to_numpy()
        yield pa.RecordBatch.from_arrays(
            [pa.array((values + base).ravel()), pa.array(np.repeat(reps, COORDINATES))],
            ["pair", "rep"],
        )


def _colliding(matches: int):
    """Keeps candidates whose signatures agree on ``matches`` coordinates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            one, two = (
                np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint32).reshape(
                    -1, COORDINATES
                )
                for c in ("sign_a", "sign_b")
            )
            enough = (one == two).sum(axis=1) >= matches
            yield batch.select(["a", "b"]).filter(pa.array(enough))

    return run


def _paired_sets(batch: pa.RecordBatch):
    """(rows, two sides) of stretches of a batch of text pairs.

    A side holds the pair, the hash and the key of each distinct shingle of ``text_a`` or
    ``text_b``; equal keys are equal shingles of one pair.
    """
    sizes = np.zeros(batch.num_rows, dtype=np.int64)
    for c in ("text_a", "text_b"):
        sizes += np.array([len(t) for t in batch.column(c).to_pylist()], dtype=np.int64)
    part = np.cumsum(sizes) // BLOCK_BYTES
    cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]]))
    for a, b in zip(cuts[:-1], cuts[1:]):
        piece = batch.slice(a, b - a)
        sides = []
        for c in ("text_a", "text_b"):
            (_, data, offsets), = blocks(piece.column(c), 1 << 62)
            hashes, held, keys = _distinct(*shingles(data, offsets))
            sides.append((held, hashes, keys))
        yield piece, sides


def _confirmed(percent: int):
    """Keeps links whose full shingle sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, ((held_a, _, keys_a), (held_b, _, keys_b)) in _paired_sets(batch):
                n = piece.num_rows
                both = np.bincount(held_a[np.isin(keys_a, keys_b)], minlength=n)
                either = np.bincount(held_a, minlength=n) + np.bincount(held_b, minlength=n) - both
                yield piece.select(["a", "b"]).filter(pa.array(100 * both >= percent * either))

    return run


DIFFERENCES = "rep long, own long, lead long, apart long, outside boolean, n_rep long, n_lead long, shingle long"


def _differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every shingle that only one of text ``a`` and its leader ``b`` holds, with both set sizes."""
    for batch in batches:
        for piece, ((held_a, hashes_a, keys_a), (held_b, hashes_b, keys_b)) in _paired_sets(batch):
            n = piece.num_rows
            own, lacked = ~np.isin(keys_a, keys_b), ~np.isin(keys_b, keys_a)
            pair = np.concatenate([held_a[own], held_b[lacked]])
            sizes = (np.bincount(held, minlength=n)[pair] for held in (held_a, held_b))
            yield pa.RecordBatch.from_arrays(
                [
                    *(pa.array(piece.column(c).to_numpy()[pair]) for c in ("a", "own", "b", "apart")),
                    pa.array(np.asarray(piece.column("outside").to_pylist(), dtype=bool)[pair]),
                    *(pa.array(size.astype(np.int64)) for size in sizes),
                    pa.array(np.concatenate([hashes_a[own], hashes_b[lacked]]).view(np.int64)),
                ],
                ["rep", "own", "lead", "apart", "outside", "n_rep", "n_lead", "shingle"],
            )


def _bits(i: int):
    """The i-th word of a bit set of an aggregated group's shingles."""
    bit = F.expr("shiftleft(1L, cast(shingle & 63 AS int))")
    return F.coalesce(F.bit_or(F.when(F.expr(f"shiftright(shingle, 6) & {BIT_WORDS - 1}") == i, bit)), F.lit(0))


def _posted_differences(led: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Members under the rarest shingles that only they or their leader hold; see ``_across``.

    ``led`` has rep, apart, lead and outside; the last tells members of another component than
    their leader. A shingle that nobody else differs by, or no member outside, is in no overlap
    that is looked for: it goes first in the order of the prefixes, without a posting, and is
    counted and set in the bits only.
    """
    r = (100 - percent) / (100 + percent)
    spread = stored(
        led.join(texts.select(F.col("doc_id").alias("rep"), F.col("text").alias("text_a")), "rep")
        .join(texts.select(F.col("doc_id").alias("lead"), F.col("text").alias("text_b")), "lead")
        .select(
            F.col("rep").alias("a"), F.xxhash64("text_a", "text_b").alias("own"), F.col("lead").alias("b"),
            "apart", "outside", "text_a", "text_b",
        )
        .mapInArrow(_differences, DIFFERENCES),
        "differences",
    )
    shared = spread.groupBy("lead", "shingle").agg(
        F.count(F.lit(1)).alias("n"), F.bool_or("outside").alias("needed")
    ).where("n > 1 AND needed")
    member = ["rep", "own", "lead"]
    whole = spread.groupBy(*member, "apart", "n_rep", "n_lead", "outside").agg(
        F.count(F.lit(1)).cast("int").alias("size"), *[_bits(i).alias(f"bits{i}") for i in range(BIT_WORDS)]
    )
    ranked = (
        spread.select(*member, "shingle")
        .join(shared.select("lead", "shingle", "n"), ["lead", "shingle"])
        .groupBy(*member)
        .agg(F.sort_array(F.collect_list(F.struct("n", "shingle"))).alias("shares"))
        .join(whole, member)
        .withColumn("alone", F.col("size") - F.size("shares"))
    )
    facing_outside = F.floor((F.col("size") + r * (F.col("n_lead") - F.col("n_rep"))) / 2 - SLACK) + 1
    facing_inside = F.ceil(F.col("size") - r * F.col("n_rep") * (1 + 100 / percent) - SLACK)
    overlap = F.when(F.col("outside"), F.least(facing_outside, facing_inside)).otherwise(facing_outside)
    taken = F.greatest(
        F.lit(0), F.col("size") - F.greatest(F.lit(1), overlap) + 1 - F.col("alone")
    ).cast("int")
    places = F.transform(
        F.slice("shares", F.lit(1), taken),
        lambda p, at: F.struct((F.col("alone") + at).alias("at"), p["shingle"].alias("shingle")),
    )
    kept = ["rep", "lead", "apart", "n_rep", "outside", "size", *[f"bits{i}" for i in range(BIT_WORDS)]]
    return stored(
        ranked.select(*kept, F.explode(places).alias("p")).select(*kept, "p.at", "p.shingle"),
        "difference-postings",
    )


def _across(posted: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components under one leader that may be links; none is missed.

    ``posted`` is made by ``_posted_differences`` and has the component besides. With
    r = (100 - percent) / (100 + percent), u and v are linked if they differ in at most
    r (|u| + |v|) shingles. A text u outside its leader's component is not linked with the leader,
    so |D(u)| > r (|u| + |leader|). Hence the overlap with any v is more than
    (|D(v)| + r (|leader| - |v|)) / 2. It is also at least |D(u)| - r (|u| + |v|), since it is at
    most |D(v)|. Both bound the prefixes. A shingle in D(u) whose bit D(v) lacks is not shared,
    so the bit sets of both bound their overlap before any text is looked at.
    """
    r = (100 - percent) / (100 + percent)
    other = posted.select(*[F.col(c).alias(f"_{c}") for c in posted.columns])
    needed = (F.col("size") + F.col("_size") - r * (F.col("n_rep") + F.col("_n_rep"))) / 2 - SLACK

    def lacked(one: str, two: str):
        terms = [
            F.bit_count(F.col(f"{one}bits{i}").bitwiseAND(F.bitwise_not(f"{two}bits{i}"))) for i in range(BIT_WORDS)
        ]
        return sum(terms[1:], terms[0])

    return (
        posted.where("outside")
        .join(other, (F.col("lead") == F.col("_lead")) & (F.col("shingle") == F.col("_shingle")))
        .where((F.col("component") != F.col("_component")) & (~F.col("_outside") | (F.col("rep") < F.col("_rep"))))
        .where(F.least(F.col("size") - F.col("at"), F.col("_size") - F.col("_at")) >= needed)
        .where(F.col("size") - lacked("", "_") >= needed)
        .where(F.col("_size") - lacked("_", "") >= needed)
        .select(F.col("rep").alias("a"), F.col("_rep").alias("b"))
        .distinct()
    )


def _postings(reps: DataFrame, matches: int) -> DataFrame:
    """(pair, rep, apart): every text under the shared pairs of its prefix, rarest first.

    ``apart`` is the lower, the more texts hold the text's pairs.
    """
    every = reps.mapInArrow(_coordinates, "pair long, rep long")
    shared = every.groupBy("pair").agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumnRenamed(
        "pair", "held"
    )
    ranked = (
        every.join(shared, F.col("pair") == F.col("held"))
        .groupBy("rep")
        .agg(F.sort_array(F.collect_list(F.struct("n", "pair"))).alias("own"))
        .where(F.size("own") >= matches)
    )
    prefix = F.slice("own", F.lit(1), F.size("own") - F.lit(matches - 1))
    apart = F.aggregate("own", F.lit(0).cast("long"), lambda total, p: total - p["n"])
    return ranked.select("rep", apart.alias("apart"), F.explode(prefix).alias("p")).select(
        F.col("p.pair").alias("pair"), "rep", "apart"
    )


def one_document(classes: DataFrame) -> DataFrame:
    """Links (a, b) between the representatives of ids that stand on several texts."""
    held = classes.where("rep IS NOT NULL").select("doc_id", "rep").distinct()
    least = held.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a < z")
    return (
        held.join(broadcast_within(least.select(F.col("doc_id").alias("id"), "a")), F.col("doc_id") == F.col("id"))
        .select("a", F.col("rep").alias("b")).where("a <> b")
    )


def near_links(docs: DataFrame, matches: int = MATCHES, percent: int = PERCENT):
    """(classes, links): every row with the representative of its set, and links of those.

    ``classes`` has doc_id, n_shingles and rep; ``links`` has node and component, for
    representatives that are linked with any other.
    """
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = stored(narrow.mapInArrow(_sign, SIGNATURES), "signatures")
    same = ["set_a", "set_b", "n_shingles"]
    grouped = (
        signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
        .groupBy(*same)
        .agg(F.min("doc_id").alias("rep"), F.min("signature").alias("signature"))
    )
    reps = stored(grouped, "representatives")
    known = reps.select(*[F.col(c).alias(f"_{c}") for c in same], "rep")
    classes = signed.join(
        known,
        (F.col("set_a") == F.col("_set_a")) & (F.col("set_b") == F.col("_set_b"))
        & (F.col("n_shingles") == F.col("_n_shingles")) & F.col("doc_id").isNotNull(),
        "left",
    ).select("doc_id", "n_shingles", "rep")

    signs = reps.select("rep", F.col("signature").alias("sign"))
    lists = stored(_postings(reps.select("rep", "signature"), matches), "postings")
    posted = broadcast_within(lists.select(F.col("rep").alias("r")).distinct())
    texts = stored(
        narrow.join(posted, F.col("doc_id") == F.col("r"))
        .select("doc_id", "text").distinct(),
        "posted-texts",
    )

    def confirm(pairs: DataFrame) -> DataFrame:
        collided = (
            pairs.join(signs.select(F.col("rep").alias("a"), F.col("sign").alias("sign_a")), "a")
            .join(signs.select(F.col("rep").alias("b"), F.col("sign").alias("sign_b")), "b")
            .mapInArrow(_colliding(matches), "a long, b long")
        )
        return (
            stored(collided, "collisions")
            .join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
            .join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
            .mapInArrow(_confirmed(percent), "a long, b long")
        )

    links = found = None

    def link(pairs: DataFrame) -> None:
        nonlocal links, found
        fresh = stored(confirm(pairs), "near-links")
        if links is None:
            links = one_document(classes).unionByName(fresh)
        elif fresh.isEmpty():
            return
        else:
            links = links.unionByName(fresh)
        found = components(links)

    def members(lists: DataFrame) -> DataFrame:
        """Members of the lists that still hold more than one component, with the list's leader."""
        named = (
            lists.withColumn("component", F.col("rep")) if found is None
            else lists.join(found, F.col("rep") == F.col("node"), "left").withColumn(
                "component", F.coalesce("component", "rep"))
        ).select("pair", "rep", "apart", "component")
        lead = F.min_by(F.struct("rep", "apart", "component"), F.struct("apart", "rep"))
        still_open = (
            named.groupBy("pair")
            .agg(F.count(F.lit(1)).alias("n"), F.min("component").alias("lo"), F.max("component").alias("hi"),
                 lead.alias("lead"))
            .where("lo < hi")
            .select(F.col("pair").alias("open"), "n", F.col("lead.rep").alias("lead"),
                    F.col("lead.apart").alias("lead_apart"), F.col("lead.component").alias("lead_component"))
        )
        return named.join(still_open, F.col("pair") == F.col("open")).select(
            "pair", "rep", "apart", "component", "n", "lead", "lead_apart", "lead_component",
            (F.col("component") != F.col("lead_component")).alias("outside"),
        )

    def by_leader(lists: DataFrame) -> None:
        link(members(lists).where("outside").select(F.col("rep").alias("a"), F.col("lead").alias("b")).distinct())

    by_leader(lists)
    left = stored(members(lists).where("n > 2 AND rep <> lead"), "open-lists")
    # Lists led from one component share their members for the most part, and lists led from several
    # components of one family of texts do as well. Lists that are connected by common members form
    # a cluster with one centre, so a member differs from a text once, whoever leads its lists.
    long = stored(
        left.where(F.col("n") > SHORT_LIST)
        .groupBy("rep", "component", "lead", "lead_apart", "lead_component")
        .agg(F.min("apart").alias("apart")),
        "long-lists",
    )
    first = long.groupBy(F.col("rep").alias("of")).agg(F.min("lead_component").alias("b"))
    met = components(
        long.select("rep", F.col("lead_component").alias("a")).distinct()
        .join(first, F.col("rep") == F.col("of")).select("a", "b").distinct(),
        "clusters",
    ).withColumnsRenamed({"node": "held", "component": "cluster"})
    clustered = long.join(broadcast_within(met), F.col("lead_component") == F.col("held"), "left").withColumn(
        "cluster", F.coalesce("cluster", "lead_component")
    ).drop("held")
    centres = clustered.groupBy(F.col("cluster").alias("held")).agg(
        F.min_by(F.struct("lead", "lead_component"), F.struct("lead_apart", "lead")).alias("centre")
    )
    centred = stored(
        clustered.drop("lead", "lead_apart", "lead_component")
        .join(broadcast_within(stored(centres, "centres")), F.col("cluster") == F.col("held"))
        .groupBy("rep", "component", F.col("centre.lead").alias("lead"), F.col("centre.lead_component").alias("around"))
        .agg(F.min("apart").alias("apart"))
        .where("rep <> lead")
        .select("rep", "lead", "apart", (F.col("component") != F.col("around")).alias("outside")),
        "centred",
    )
    short = left.where(F.col("n") <= SHORT_LIST)
    other = short.select(*[F.col(c).alias(f"_{c}") for c in ("pair", "rep", "component")])
    link(
        short.join(other, (F.col("pair") == F.col("_pair")) & (F.col("rep") > F.col("_rep")))
        .where("component <> _component")
        .select(F.col("rep").alias("a"), F.col("_rep").alias("b"))
        .unionByName(centred.where("outside").select(F.col("rep").alias("a"), F.col("lead").alias("b")))
        .distinct()
    )

    def component_of(name: str) -> DataFrame:
        return found.select(F.col("node").alias(name), F.col("component").alias(f"{name}_component"))

    placed = (
        centred.drop("outside").join(component_of("rep"), "rep", "left").join(component_of("lead"), "lead", "left")
        .select("rep", "lead", "apart", (
            F.coalesce("rep_component", "rep") != F.coalesce("lead_component", "lead")).alias("outside"))
    )
    placed = stored(placed, "placed")
    # Members that are all in one component with their centre have nothing left to find.
    needed = placed.where("outside").select("lead").distinct()
    led = stored(placed.join(broadcast_within(needed), "lead", "left_semi"), "led")
    if led.isEmpty():
        return classes, found
    posted = _posted_differences(led, texts, percent)
    # Members that differ from a leader alike often belong together: a leader of their own takes
    # them into its component, and what is left is compared across components only.
    alike = posted.groupBy(F.xxhash64("lead", "shingle").alias("pair"), "rep").agg(F.min("apart").alias("apart"))
    by_leader(alike)
    posted = posted.join(found, F.col("rep") == F.col("node"), "left").withColumn(
        "component", F.coalesce("component", "rep")
    ).drop("node", "apart")
    link(_across(posted, percent))
    return classes, found


def near_groups(docs: DataFrame, matches: int = MATCHES, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row."""
    classes, found = near_links(docs, matches, percent)
    component = F.when(
        F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id")
    )
    return (
        classes.join(found, F.col("rep") == F.col("node"), "left")
        .withColumn("component_id", component)
        .select(
            "doc_id", "n_shingles", "component_id",
            F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"),
        )
    )
