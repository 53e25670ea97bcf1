"""Multi-party dialogues seen by each participant in turn.

For every speaker of a conversation the dialogue is rendered with that speaker as the assistant
and all others as named users. The mask runs over the rendered characters: only what the chosen
speaker says is trained on. System turns set the scene in every rendering; they are no speaker.

A dialogue is rendered in parts of ``PART_TURNS`` turns, so a conversation of any length spreads
over tasks. Turns are numbered in order: all rows are dealt out by ranges of (conversation, order),
numbered range by range, and shifted by the counts of earlier ranges. Every part but the first
opens with the last system turn before it, so each has the setting in force, at a cost that does
not depend on how many system turns there are.

Defined results: turns are ordered by number, nulls last, then role, then text; a null text is
empty; a null or blank role is a user called ``unknown`` and no participant; turns without a
conversation id form one conversation; a conversation without speakers gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vanewatch.llm.common import stored

PART_TURNS = 256
SYSTEM = ("system",)
START, END = "<|im_start|>", "<|im_end|>"


def _is_system(role: Column, system: tuple[str, ...]) -> Column:
    return F.coalesce(role.isin(*system), F.lit(False))


def _head(role: Column, speaker: Column, system: tuple[str, ...]) -> Column:
    name = (
        F.when(role == speaker, F.lit("assistant"))
        .when(_is_system(role, system), F.lit("system"))
        .otherwise(F.concat(F.lit("user name="), F.coalesce(role, F.lit("unknown"))))
    )
    return F.concat(F.lit(START), name, F.lit("\n"))


def _in_order(rows: DataFrame, order: list[Column]) -> DataFrame:
    """``rows`` with ``_at``, from 0 in each conversation, and ``_setting``, the last system text before."""
    # equal turns may go anywhere, so a salt parts them
    dealt = rows.withColumn("_salt", F.xxhash64(F.monotonically_increasing_id())).repartitionByRange(
        "_conv", *order, "_salt"
    )
    ranged = stored(dealt.drop("_salt").withColumn("_range", F.spark_partition_id()), "ordered-turns")
    inside = Window.partitionBy("_conv", "_range").orderBy(*order)
    before = Window.unboundedPreceding, -1
    earlier = Window.partitionBy("_conv").orderBy("_range").rowsBetween(*before)
    scene = F.when(F.col("_system"), F.col("text"))
    ranges = (
        ranged.groupBy("_conv", "_range")
        .agg(
            F.count(F.lit(1)).alias("_n"),
            F.max_by("text", F.when(F.col("_system"), F.struct(*order))).alias("_last"),
        )
        .select(
            "_conv", "_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"),
            F.last("_last", ignorenulls=True).over(earlier).alias("_scene"),
        )
    )
    return (
        ranged.withColumn("_local", F.row_number().over(inside))
        .withColumn("_setting", F.last(scene, ignorenulls=True).over(inside.rowsBetween(*before)))
        .join(ranges, ["_conv", "_range"])
        .withColumn("_at", F.col("_offset") + F.col("_local") - 1)
        .withColumn("_setting", F.coalesce("_setting", "_scene"))
        .drop("_range", "_local", "_offset", "_scene")
    )


def rotate_perspectives(turns: DataFrame, system: tuple[str, ...] = SYSTEM) -> DataFrame:
    """One row per conversation, speaker and part.

    Columns: conv_id, speaker, part, n_turns, n_trained, text, and mask, an array of
    (chars, trained) runs that covers the text from start to end. n_turns counts what is
    rendered, a repeated system turn too.
    """
    blank = F.trim(F.coalesce("role", F.lit(""))) == ""
    rows = (
        turns.select(
            F.struct("conv_id").alias("_conv"), F.col("turn").cast("long").alias("turn"),
            F.when(~blank, F.col("role")).alias("role"),
            F.coalesce("text", F.lit("")).alias("text"),
        )
        .withColumn("_system", _is_system(F.col("role"), system))
    )
    order = [F.col("turn").isNull(), F.col("turn"), F.col("role").isNull(), F.col("role"), F.col("text")]
    opens = (F.col("_at") > 0) & (F.col("_at") % PART_TURNS == 0)
    parts = (
        _in_order(rows, order)
        .withColumn("part", F.floor(F.col("_at") / PART_TURNS))
        .groupBy("_conv", "part")
        .agg(
            F.array_sort(F.collect_list(F.struct("_at", "role", "text"))).alias("_turns"),
            F.max(F.when(opens, F.col("_setting"))).alias("_scene"),
        )
        .withColumn(
            "_turns",
            F.when(F.col("_scene").isNull(), F.col("_turns")).otherwise(
                F.concat(
                    F.array(F.struct(
                        F.lit(-1).cast("long").alias("_at"), F.lit(system[0] if system else None).cast("string").alias("role"),
                        F.col("_scene").alias("text"),
                    )),
                    "_turns",
                )
            ),
        )
    )
    speakers = (
        rows.where(F.col("role").isNotNull() & ~F.col("_system"))
        .select("_conv", F.col("role").alias("speaker"))
        .distinct()
    )
    said = F.transform(
        "_turns",
        lambda t: F.struct(
            _head(t["role"], F.col("speaker"), system).alias("head"),
            F.concat(t["text"], F.lit(END)).alias("body"),
            F.coalesce(t["role"] == F.col("speaker"), F.lit(False)).alias("own"),
        ),
    )
    runs = F.flatten(
        F.transform(
            "_said",
            lambda s: F.array(
                F.struct(F.length(s["head"]).alias("chars"), F.lit(False).alias("trained")),
                F.struct(F.length(s["body"]).alias("chars"), s["own"].alias("trained")),
                F.struct(F.lit(1).alias("chars"), F.lit(False).alias("trained")),
            ),
        )
    )
    whole = F.array_join(
        F.transform("_said", lambda s: F.concat(s["head"], s["body"], F.lit("\n"))), ""
    )
    return (
        parts.join(speakers, "_conv")
        .withColumn("_said", said)
        .select(
            F.col("_conv.conv_id").alias("conv_id"), "speaker", "part",
            F.size("_said").cast("long").alias("n_turns"),
            F.size(F.filter("_said", lambda s: s["own"])).cast("long").alias("n_trained"),
            whole.alias("text"), runs.alias("mask"),
        )
    )
