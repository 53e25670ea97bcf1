"""Connected components of an edge table, by large-star and small-star steps.

Each step is a minimum per node, combined on the map side, and one join back; a node with very
many neighbours is never gathered. Rounds end when the edges no longer change, after a number of
rounds that grows with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vanewatch.llm.common import stored


#: Edges that one task takes through a round without a shuffle; more are dealt out.
FEW_EDGES = 50_000


def _gathered(edges: DataFrame, few: bool) -> DataFrame:
    """One partition needs no exchange for the groups, joins and distinct rows of a round."""
    return edges.coalesce(1) if few else edges


def _large_star(edges: DataFrame, few: bool) -> DataFrame:
    both = _gathered(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), few)
    least = both.groupBy("a").agg(F.min("b").alias("least")).select(
        F.col("a").alias("node"), F.least("a", "least").alias("least")
    )
    return both.where("b > a").join(least, F.col("a") == F.col("node")).select(
        F.col("b").alias("a"), F.col("least").alias("b")
    ).distinct()


def _small_star(edges: DataFrame, few: bool) -> DataFrame:
    """Edges lead from the greater node ``a`` to the lesser one ``b``."""
    least = edges.groupBy("a").agg(F.min("b").alias("least")).withColumnRenamed("a", "node")
    moved = edges.join(least, F.col("a") == F.col("node")).where("b <> least").select(
        F.col("b").alias("a"), F.col("least").alias("b")
    )
    roots = least.select(F.col("node").alias("a"), F.col("least").alias("b"))
    return _gathered(roots.unionByName(moved), few).distinct()


def _state(edges: DataFrame):
    return edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()


def components(edges: DataFrame, label: str = "links", few_edges: int = FEW_EDGES) -> DataFrame:
    """(node, component) of every node with an edge; the component is its least node.

    ``edges`` has two non-null columns ``a`` and ``b`` of one ordered type. The number of edges is
    counted after each round; a round over no more than ``few_edges`` stays in one task, as dealing
    them out costs far more than reading them.
    """
    stars = stored(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        label,
    )
    before = None
    while (now := _state(stars)) != before:
        before = now
        few = now[0] <= few_edges
        stars = stored(_small_star(_large_star(_gathered(stars, few), few), few), label)
    roots = stars.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
