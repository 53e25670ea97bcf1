"""Mixing sources to target weights by systematic sampling.

Every source gets a target number of words. A document of the source is expected
``target / source_size`` times in the mix. Laid out along a line, each document covers that
much of it; one random offset per source shifts the whole numbers, and a document is emitted
once per whole number it covers. Expected and real counts then differ by less than one over any
stretch of the line, so documents are laid out by size: each size class is met in proportion.

Positions come from counts. Documents of a source are numbered inside (size class, hash slot)
and the sizes of the earlier classes and slots are added, so no task sees a whole source.

Defined results: null text has size 0; a null source is one source, ordered last; a null id is
placed by its text; repeated rows are documents of their own; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vanewatch.llm.common import stored, word_count
from vanewatch.operators.joins import broadcast_within

WEIGHTS = (1, 2, 3)
MOST_COPIES = 3


def source_targets(
    sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES
) -> DataFrame:
    """Words each source should give: (source, source_size, target).

    Sources by code point, null last, weigh ``weights`` in turn and share all words. A target
    stops at ``most`` times its source; the excess goes to the others by weight. With sources
    ordered by how soon they reach their limit, the first one that stays below it fixes the
    level of all that follow. One row per source: a table of that size may meet in one task.
    """
    every = Window.partitionBy()
    named = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(named) - 1, F.lit(len(weights)))
    weighed = (
        sizes.withColumn("_weight", F.element_at(F.array(*map(F.lit, weights)), turn + 1))
        .withColumn("_limit", F.col("source_size") * most)
        .withColumn("_reach", F.col("_limit") / F.col("_weight"))
        .withColumn("_total", F.sum("source_size").over(every))
    )
    soonest = Window.orderBy("_reach", F.col("source").asc_nulls_last())
    before = soonest.rowsBetween(Window.unboundedPreceding, -1)
    onward = soonest.rowsBetween(0, Window.unboundedFollowing)
    left = F.col("_total") - F.coalesce(F.sum("_limit").over(before), F.lit(0))
    levelled = (
        weighed.withColumn("_at", F.row_number().over(soonest))
        .withColumn("_level", left / F.sum("_weight").over(onward))
        .withColumn("_below", F.when(F.col("_level") <= F.col("_reach"), F.struct("_at", "_level")))
        .withColumn("_first", F.min("_below").over(every))
    )
    target = F.when(
        F.col("_at") >= F.col("_first._at"), F.col("_first._level") * F.col("_weight")
    ).otherwise(F.col("_limit").cast("double"))
    return levelled.select("source", "source_size", target.alias("target"))


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    most: int = MOST_COPIES,
    seed: str = "mix",
) -> DataFrame:
    """Copies of each document: (doc_id, size, source, source_size, target, copies, taken)."""
    size = word_count(F.col("text"))
    bits = F.length(F.bin("size"))
    spot = F.coalesce(F.col("doc_id").cast("string"), F.col("text"), F.lit(""))
    laid = stored(
        docs.select(
            "doc_id", "source", size.alias("size"), F.substring(F.md5(spot), 1, 2).alias("_slot")
        ).withColumn(
            "_class",
            bits * 16 + F.expr("shiftright(size, greatest(length(bin(size)) - 4, 0))").cast("int"),
        ),
        "mix-sizes",
    )
    cell = ["source", "_class", "_slot"]
    earlier = Window.partitionBy("source").orderBy("_class", "_slot").rowsBetween(
        Window.unboundedPreceding, -1
    )
    cells = (
        laid.groupBy(*cell)
        .agg(F.count(F.lit(1)).alias("_n"), F.sum("size").alias("_words"))
        .withColumn("_offset", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    )
    sizes = cells.groupBy("source").agg(F.sum("_words").alias("source_size"))
    draw = F.conv(
        F.substring(F.md5(F.concat(F.lit(seed), F.coalesce("source", F.lit("")))), 1, 8), 16, 10
    ).cast("long")
    plan = broadcast_within(
        source_targets(sizes, weights, most)
        .withColumn("_rate", F.col("target") / F.col("source_size"))
        .withColumn("_draw", draw / F.lit(2**32))
        .withColumnRenamed("source", "_source")
    )
    inside = Window.partitionBy(*cell).orderBy("size", "doc_id")
    offsets = cells.select(*[F.col(c).alias(f"{c}_") for c in cell], "_offset")
    same_cell = [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in cell]
    placed = (
        laid.withColumn("_local", F.row_number().over(inside))
        .join(offsets, same_cell)
        .withColumn("_rank", F.col("_offset") + F.col("_local"))
        .join(plan, F.col("source").eqNullSafe(F.col("_source")))
    )
    crossed = F.floor(F.col("_rank") * F.col("_rate") + F.col("_draw")) - F.floor(
        (F.col("_rank") - 1) * F.col("_rate") + F.col("_draw")
    )
    copies = F.least(F.coalesce(crossed, F.lit(0)), F.lit(most)).cast("long")
    return placed.withColumn("copies", copies).select(
        "doc_id", "size", "source", "source_size", "target", "copies",
        (F.col("copies") * F.col("size")).alias("taken"),
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every document as often as it was drawn, numbered by ``copy`` from 1.

    Draws are looked up by (doc_id, source, size); documents that agree in all three share the
    copies drawn for them in the order of their texts.
    """
    twin = Window.partitionBy("doc_id", "source", "size")
    draws = mix(docs, **options).withColumn(
        "_twin", F.row_number().over(twin.orderBy("copies"))
    ).select(
        F.col("doc_id").alias("_d"), F.col("source").alias("_s"), F.col("size").alias("_z"),
        F.col("_twin").alias("_t"), "copies",
    )
    rows = docs.withColumn("size", word_count(F.col("text"))).withColumn(
        "_twin", F.row_number().over(twin.orderBy(F.xxhash64("text")))
    )
    return (
        rows.join(
            draws,
            F.col("doc_id").eqNullSafe(F.col("_d"))
            & F.col("source").eqNullSafe(F.col("_s"))
            & (F.col("size") == F.col("_z"))
            & (F.col("_twin") == F.col("_t")),
        )
        .where("copies > 0")
        .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
        .select(*docs.columns, "copy")
    )
