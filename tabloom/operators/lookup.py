"""Joining a table of unique keys to rows, whatever the size of the table and the skew of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.functions.columns import quoted
from tabloom.sources.work import WorkArea

# Tables up to this many bytes are sent whole to every executor.
BROADCAST_BYTES = 64 * 1024 * 1024
# Keys owning more than a thousandth of the rows: there can be at most a thousand.
HOT_SHARE = 1000
SALTS = 256
ROW_BYTES = 48


def table_bytes(table: DataFrame, key: str = "key") -> int:
    """About how large the table is in memory, by its rows and the length of its keys."""
    size = F.sum(F.coalesce(F.octet_length(F.col(key).cast("string")), F.lit(0)) + F.lit(ROW_BYTES))
    return table.agg(F.coalesce(size, F.lit(0))).first()[0]


def look_up(
    df: DataFrame, key: Column, table: DataFrame, size_bytes: int, limit: int | None = None
) -> DataFrame:
    """Left join of `table` on its column `key`; every row of `df` stays, once.

    A table beyond `limit` bytes is joined by a shuffle in which no key crowds into one task: those
    owning more than a thousandth of the rows are looked up by broadcast, and rows that need
    nothing from the shuffled side are spread by a salt.
    """
    limit = BROADCAST_BYTES if limit is None else limit
    named = table.withColumnRenamed("key", "__key")
    if size_bytes <= limit:
        return df.join(F.broadcast(named), key == F.col("__key"), "left").drop("__key")
    if df.isStreaming:  # rows still to come cannot be counted
        return df.join(named, key == F.col("__key"), "left").drop("__key")
    keyed = df.withColumn("__open", key)
    rows = df.agg(F.count(F.lit(1))).first()[0]
    uses = keyed.filter("__open IS NOT NULL").groupBy("__open").agg(F.count(F.lit(1)).alias("__uses"))
    often = uses.filter(F.col("__uses") * HOT_SHARE > rows).select("__open")
    hot = often.join(named, F.col("__open") == F.col("__key"), "left")
    values = [name for name in table.columns if name != "key"]
    hot = hot.select(F.col("__open").alias("__hot"), *(F.col(v).alias(f"__hot_{v}") for v in values))
    marked = keyed.join(F.broadcast(hot), F.col("__open") == F.col("__hot"), "left")
    plain = [f.name for f in df.schema.fields if isinstance(f.dataType, T.AtomicType)]
    spread = F.pmod(F.xxhash64(*map(quoted, plain)), F.lit(SALTS)).cast("int")
    done = F.col("__hot").isNotNull() | F.col("__open").isNull()
    salted = marked.withColumns({"__far": F.when(~done, F.col("__open")), "__salt": F.when(done, spread).otherwise(0)})
    # Always 0, but no literal: a literal is moved out of the join's keys, and the salt with it.
    zero = F.pmod(F.xxhash64("__key"), F.lit(1)).cast("int")
    joined = salted.join(
        named.withColumn("__zero", zero).hint("merge"),  # its files may be small enough for a broadcast
        (F.col("__far") == F.col("__key")) & (F.col("__salt") == F.col("__zero")),
        "left",
    )
    near = F.col("__far").isNull()  # as `done`, of a column that is shuffled anyway
    found = (F.when(near, F.col(f"__hot_{v}")).otherwise(F.col(v)).alias(v) for v in values)
    return joined.select(*map(quoted, df.columns), *found)


def keep_table(table: DataFrame, area: WorkArea, name: str) -> tuple[DataFrame, int]:
    """Write a table of unique keys and measure it."""
    held = area.table(table, name)
    return held, table_bytes(held)

