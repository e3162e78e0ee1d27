"""Exact shares of rows per class when the classes are too many for the driver.

Quotas, running totals and hash thresholds are tables with a row per class. They follow the same
rules as the driver-side forms in `split` and `position`, to the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.operators.lookup import BROADCAST_BYTES, keep_table, look_up, table_bytes
from tabloom.operators.position import HASH, cuts_at_ranks
from tabloom.operators.scan import ROWS_PER_RANGE, running_totals
from tabloom.sources.work import WorkArea

# Hexadecimal digits of the hash each pass looks at: at most 256 cells per class.
DIGITS = 2
HASH_LENGTH = 32
# Cells and open ranks that one task of a pass takes: more rows make more tasks, not larger ones.
ROWS_PER_TASK = 500_000


def class_quotas(classes: DataFrame, draws: int, rows: int) -> DataFrame:
    """Add `quota`: `draws` shared over (label, rows) in proportion, by largest remainder.

    Every class gets its share rounded down. The draws left over go to the classes with the largest
    remainders, ties to the lesser label: one cut in that order, found without sorting it.
    """
    exact = F.col("rows") / F.lit(float(rows)) * F.lit(float(draws))  # as on the driver, to the bit
    short = F.floor(exact) - exact  # minus the remainder
    exact = classes.withColumns({"quota": F.floor(exact).cast("bigint"), "__short": short})
    count, given = exact.agg(F.count(F.lit(1)), F.sum("quota")).first()
    left = draws - given
    if left <= 0:
        return exact.drop("__short")
    keys = ["__short", "label"]
    cut = cuts_at_ranks(exact.select(*keys), keys, [left], count)[left]
    more = cut.covers(exact, keys).cast("bigint")
    return exact.withColumn("quota", F.col("quota") + more).drop("__short")


def class_starts(classes: DataFrame, area: WorkArea, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Add `start`: the rows of all lesser labels."""
    return running_totals(classes, [F.col("label")], {"start": F.col("rows")}, area, rows_per_range)


def hash_bounds(
    rows: DataFrame, wanted: DataFrame, area: WorkArea, rows_per_task: int | None = None
) -> DataFrame:
    """(key, bounds): per class, thresholds on `HASH` covering exactly the wanted numbers of rows.

    `rows` has label and HASH, `wanted` label, rows and ranks (an array). Each pass counts rows by
    two more digits of the hash around the places still open and keeps only the rows there, so
    what is read shrinks by two orders of magnitude a pass.
    """
    rows_per_task = ROWS_PER_TASK if rows_per_task is None else rows_per_task
    asked = wanted.select("label", "rows", F.posexplode("ranks").alias("nth", "rank"))
    bound = F.when(F.col("rank") <= 0, "").when(F.col("rank") >= F.col("rows"), "g")
    asked = area.table(asked.withColumns({"bound": bound, "place": F.lit("")}), "asked")
    solved = [asked.filter("bound IS NOT NULL").select("label", "nth", "bound")]
    open_ = asked.filter("bound IS NULL").select("label", "nth", "rank", "place")
    held = wanted.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    part, length = rows.select("label", HASH), 0
    while ranks := open_.count():
        if length >= HASH_LENGTH:
            raise ValueError("rows share a row key; id columns must identify each row")
        if length:
            part = area.table(_at(part, open_, length), "open")
            held = part.count()
        tasks = -(-(held + ranks) // rows_per_task)
        found = area.table(_narrowed(part, open_, length, tasks), "cells")
        length += DIGITS
        exact = F.col("rank") == F.col("before") + F.col("count")
        solved.append(found.filter(exact).select("label", "nth", F.concat("cell", F.lit("g")).alias("bound")))
        open_ = found.filter(~exact).select(
            "label", "nth", (F.col("rank") - F.col("before")).alias("rank"), F.col("cell").alias("place")
        )
    every = solved[0]
    for more in solved[1:]:
        every = every.unionByName(more)
    listed = F.array_sort(F.collect_list(F.struct("nth", "bound")))
    return every.groupBy(F.col("label").alias("key")).agg(F.transform(listed, lambda b: b["bound"]).alias("bounds"))


def _at(part: DataFrame, open_: DataFrame, length: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Rows at the places still open; label and digits together spread a large class.

    Places are broadcast by their measured size: their files are far smaller.
    """
    places = open_.select("label", "place").distinct()
    places = F.broadcast(places) if table_bytes(open_, "label") <= limit else places.hint("merge")
    placed = part.withColumn("place", F.substring(HASH, 1, length))
    return placed.join(places, ["label", "place"], "left_semi").select("label", HASH)


def _narrowed(part: DataFrame, open_: DataFrame, length: int, tasks: int) -> DataFrame:
    """For each open rank the cell that holds it, the rows before that cell and in it.

    Cells and ranks are dealt to so many tasks once, for the running count and the join alike.
    """
    cells = part.groupBy("label", F.substring(HASH, 1, length + DIGITS).alias("cell")).agg(
        F.count(F.lit(1)).alias("count")
    )
    keys = ["label", "place"]
    cells = cells.withColumn("place", F.substring("cell", 1, length)).repartition(tasks, *keys)
    earlier = Window.partitionBy(*keys).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    counted = cells.withColumn("before", F.coalesce(F.sum("count").over(earlier), F.lit(0)))
    held = (F.col("rank") > F.col("before")) & (F.col("rank") <= F.col("before") + F.col("count"))
    return open_.repartition(tasks, *keys).join(counted.hint("merge"), keys).filter(held)


def pass_bounds(
    df: DataFrame, label: Column, bounds: DataFrame, out: str, area: WorkArea, limit: int = BROADCAST_BYTES
) -> DataFrame:
    """Add, per row, how many of its class's thresholds its hash has passed."""
    table, size = keep_table(bounds.withColumnRenamed("bounds", "__bounds"), area, "bounds")
    joined = look_up(df, label, table, size, limit)
    passed = F.size(F.filter("__bounds", lambda bound: F.col(HASH) >= bound))
    return joined.withColumn(out, passed).drop("__bounds")
