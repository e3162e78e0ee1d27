"""Running totals over an ordered table of any size, and dense positions made of them.

The table is range-partitioned once. Each range sums its own rows in a task of its own; the totals
of the ranges are scanned by the same code, so no task ever orders more than one range.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.sources.work import WorkArea

ROWS_PER_RANGE = 1_000_000
# Totals of so many ranges are sent to every executor; more are joined.
FEW_RANGES = 4096


def running_totals(
    df: DataFrame,
    order: Sequence[Column],
    sums: Mapping[str, Column],
    area: WorkArea,
    rows_per_range: int = ROWS_PER_RANGE,
    rows: int | None = None,
) -> DataFrame:
    """Add, by name, the sum of each expression over all rows before the row.

    `order` must tell all rows apart. `rows`, if known, saves counting them.
    """
    rows = df.agg(F.count(F.lit(1))).first()[0] if rows is None else rows
    if rows <= rows_per_range:
        return _before(df, Window.orderBy(*order), sums)
    ranges = -(-rows // rows_per_range)
    part = f"__range_{ranges}"  # fewer at each level, so names never meet
    placed = df.repartitionByRange(ranges, *order).withColumn(part, F.spark_partition_id())
    held = area.table(placed, "ranges")
    totals = held.groupBy(part).agg(*(F.sum(value).alias(name) for name, value in sums.items()))
    earlier = {f"__{name}": F.col(name) for name in sums}
    offsets = running_totals(totals, [F.col(part)], earlier, area, rows_per_range, ranges).drop(*sums)
    # By id, as hashes of the ids, or merged small partitions, would put several ranges in a task.
    apart = held.repartitionById(ranges, F.col(part))
    within = _before(apart, Window.partitionBy(part).orderBy(*order), sums)
    joined = within.join(F.broadcast(offsets) if ranges <= FEW_RANGES else offsets, part)
    added = {name: F.col(name) + F.col(f"__{name}") for name in sums}
    return joined.withColumns(added).drop(part, *earlier)


def _before(df: DataFrame, window: Window, sums: Mapping[str, Column]) -> DataFrame:
    earlier = window.rowsBetween(Window.unboundedPreceding, -1)
    found = {name: F.coalesce(F.sum(value).over(earlier), F.lit(0)) for name, value in sums.items()}
    return df.withColumns(found)
