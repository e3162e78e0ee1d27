"""Exact dedup by content sort (DataFrame operations only).

Splitters that Spark samples range-partition the normalised bytes, an external sort places equal
texts next to each other, and every row is compared in full with its left neighbour. The hash in
the sort key only keeps the splitters short; equality is decided by comparing bytes.

A text with many copies would fill one range, so its rows are dealt to several ranges by a salt
and their first rows, one per range and text, are sorted and compared once more. The salt is of the row's
place in its input partition, so rows that share an id or have none are dealt out as well; results
don't depend on it. Which texts are
that frequent is counted first: more than `max(ROWS_AT_ONCE, rows / FREQUENT)` rows, so there are
at most FREQUENT of them and at most 2 * FREQUENT ranges, which bounds both broadcast tables.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.functions.columns import quoted
from tabloom.llm.common import SPACES, row_count, whole_text
from tabloom.sources.work import WorkArea, for_files

ROWS_AT_ONCE = 512
FREQUENT = 100_000
PREFIX_BYTES = 16


def normalised(text: Column) -> Column:
    """The text as bytes, each run of white space replaced by one space."""
    return F.regexp_replace(text, SPACES, " ").cast("binary")


def content_sort(
    docs: DataFrame,
    area: WorkArea,
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: Sequence[str] | None = None,
    rows_at_once: int = ROWS_AT_ONCE,
) -> DataFrame:
    """One row per input row: `row`, `keep_id`, `group_size`, `kept`, `text_sha256`.

    Null and empty texts are equal. Of equal texts the smallest id is kept, null ids last; of
    repeated rows with that id exactly one is kept. An empty table gives an empty result. `row`
    holds the columns named by `carry` (all of them by default), so their names never clash. `area` must live until the result
    has been used.
    """
    base = (
        docs.select(
            F.struct(*(quoted(c) for c in carry or docs.columns)).alias("row"),
            quoted(id_col).alias("id"),
            normalised(whole_text(quoted(text_col))).alias("body"),
        )
        .withColumns({"hash": F.xxhash64("body"), "place": F.monotonically_increasing_id()})
    )
    rows = row_count(docs)
    limit = max(rows_at_once, -(-rows // FREQUENT))
    frequent = base.groupBy("hash").agg(F.count(F.lit(1)).alias("copies"))
    frequent = area.held(frequent.filter(F.col("copies") > limit))

    ranges = F.ceil(F.col("copies") / limit)
    salt = F.when(F.col("copies").isNotNull(), F.pmod(F.xxhash64("id", "place"), ranges)).otherwise(-1)
    key = ["prefix", "hash", "salt"]
    placed = (
        base.join(F.broadcast(frequent), "hash", "left")
        .withColumns({"salt": salt, "prefix": F.substring("body", 1, PREFIX_BYTES)})
        .repartitionByRange(*key)
    )
    runs = _runs(placed, key, F.col("id").asc_nulls_last())
    group = Window.partitionBy(*key, "run")
    first = F.when(F.col("opens") & (F.col("salt") >= 0), F.col("body"))
    found = runs.select(
        "row",
        "id",
        *key,
        "run",
        "opens",
        first.alias("body"),
        F.sha2("body", 256).alias("text_sha256"),
    ).withColumns({"least": F.min("id").over(group), "rows": F.count(F.lit(1)).over(group)})
    found = area.table(for_files(found.drop("id"), rows), "runs")

    # The first rows of the dealt-out texts: at most one for each range and text.
    heads = found.filter("body IS NOT NULL").select(*key, "run", "body", "least", "rows")
    heads = _runs(heads, ["prefix", "hash"], F.col("least").asc_nulls_last(), "whole")
    whole = Window.partitionBy("prefix", "hash", "whole")
    heads = heads.select(
        "hash",
        "salt",
        "run",
        F.min("least").over(whole).alias("all_least"),
        F.sum("rows").over(whole).alias("all_rows"),
        F.col("opens").alias("leads"),
    )
    joined = found.join(F.broadcast(heads), ["hash", "salt", "run"], "left")
    dealt = F.col("leads").isNotNull()
    return joined.select(
        "row",
        F.when(dealt, F.col("all_least")).otherwise(F.col("least")).alias("keep_id"),
        F.when(dealt, F.col("all_rows")).otherwise(F.col("rows")).alias("group_size"),
        (F.col("opens") & F.coalesce("leads", F.lit(True))).alias("kept"),
        "text_sha256",
    )


def _runs(df: DataFrame, key: list[str], order: Column, run: str = "run") -> DataFrame:
    """`opens`: the row's bytes differ from its left neighbour's; `run` numbers equal bytes."""
    sorted_rows = Window.partitionBy(*key).orderBy("body", order)
    opens = ~F.lag("body").over(sorted_rows).eqNullSafe(F.col("body"))
    upto = sorted_rows.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("opens", opens).withColumn(
        run, F.sum(F.col("opens").cast("long")).over(upto)
    )
