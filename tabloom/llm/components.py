"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import row_count
from tabloom.sources.work import WorkArea, numbers_for_files


def components(edges: DataFrame, area: WorkArea) -> DataFrame:
    """(node, root): the least node of its component for every node of `edges` (a, b).

    Each star ties a node's neighbours to the least of them, until every edge leads to a root. A
    node with a large share of all edges is only ever the unsplit side's single row of a join.
    """
    pairs = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    once = pairs.filter("a <> b").distinct()
    now = area.table(numbers_for_files(once, row_count(edges)), "edges")
    before = None
    while True:
        state = now.agg(
            F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))
        ).first()
        if state == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        before = state
        now = area.table(numbers_for_files(_small_star(_large_star(now)), state[0]), "edges")


def _large_star(pairs: DataFrame) -> DataFrame:
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("least"))
    larger = both.filter("b > a").join(least, "a")
    return larger.select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()


def _small_star(pairs: DataFrame) -> DataFrame:
    least = pairs.groupBy("a").agg(F.min("b").alias("least"))
    moved = pairs.join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    tied = least.select("a", F.col("least").alias("b"))
    return moved.unionByName(tied).filter("a <> b").distinct()
