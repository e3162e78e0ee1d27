"""Encoding a grouping column by the target rate of the other rows in its group.

Rates are learned from training rows only. A training row is encoded without its own
label (leave-one-out); a new row from all training rows of its group. A missing key, a
group never seen and a group of one have no rate, which the `known` flag records.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.functions.columns import field_type, is_floating, number_of, quoted
from tabloom.sources.work import WorkArea

# Rate tables up to this many bytes are sent whole to every executor.
BROADCAST_BYTES = 64 * 1024 * 1024
# Keys owning more than a thousandth of the rows: there can be at most a thousand.
HOT_SHARE = 1000
SALTS = 256

TOTAL, ROWS, SALT = "__total", "__rows", "__salt"


@dataclass(frozen=True)
class GroupRates:
    """Target sum and row count per key, stored as a table however many keys there are.

    `table` has the columns key, total, rows and a zero salt.
    """

    key: str
    table: DataFrame
    rows: int
    size_bytes: int

    @classmethod
    def from_table(cls, key: str, table: DataFrame) -> GroupRates:
        found = table.agg(
            F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"),
            F.coalesce(
                F.sum(F.octet_length(F.col("key").cast("string")) + F.lit(48)), F.lit(0)
            ).alias("bytes"),
        ).first()
        return cls(key, table, found["rows"], found["bytes"])


def group_totals(df: DataFrame, key: str, target: str) -> DataFrame:
    """Target sum and rows per key value. Rows without a key belong to no group."""
    return (
        df.filter(quoted(key).isNotNull())
        .groupBy(quoted(key).alias("key"))
        .agg(F.sum(number_of(df, target)).alias("total"), F.count(F.lit(1)).alias("rows"))
    )


def fit_rates(
    df: DataFrame, key: str, target: str | None, area: WorkArea | None = None
) -> GroupRates:
    """Learn the rates and store them, so every later use reads the same small table."""
    if target is None or target not in df.columns:
        raise ValueError(f"group rates of {key!r} need the target column")
    totals = group_totals(df, key, target).withColumn("salt", F.lit(0).cast("bigint"))
    area = area or WorkArea.until_exit(df.sparkSession, "rates")
    return GroupRates.from_table(key, area.table(totals, "rates"))


def fit_all_rates(
    df: DataFrame, keys: Sequence[str], target: str | None, area: WorkArea
) -> list[GroupRates]:
    """`fit_rates` of several keys by one scan and one shuffle, stored in one table by key.

    The values of all keys meet as text in one column, told apart by the number of their key.
    """
    types = [field_type(df, key) for key in keys]
    if len(keys) < 2 or target not in df.columns or not all(isinstance(t, _AS_TEXT) for t in types):
        return [fit_rates(df, key, target, area) for key in keys]
    cells = F.array(
        *(
            F.struct(F.lit(number).alias("number"), _as_text(quoted(key), dtype).alias("text"))
            for number, (key, dtype) in enumerate(zip(keys, types, strict=True))
        )
    )
    value = number_of(df, target).alias("value")
    totals = (
        df.select(F.explode(cells).alias("cell"), value)
        .filter("cell.text IS NOT NULL")
        .groupBy("cell.number", "cell.text")
        .agg(F.sum("value").alias("total"), F.count(F.lit(1)).alias("rows"))
    )
    held = area.table(totals.withColumn("salt", F.lit(0).cast("bigint")), "rates", ["number"])
    measured = held.groupBy("number").agg(F.sum("rows"), F.sum(F.octet_length("text") + F.lit(48)))
    sizes = {row[0]: (row[1], row[2]) for row in measured.collect()}
    rates = []
    for number, (key, dtype) in enumerate(zip(keys, types, strict=True)):
        own = held.filter(F.col("number") == number)
        table = own.select(_from_text(F.col("text"), dtype).alias("key"), "total", "rows", "salt")
        rates.append(GroupRates(key, table, *sizes.get(number, (0, 0))))
    return rates


# Types whose values are told apart by their text.
_AS_TEXT = (
    T.StringType, T.IntegralType, T.FractionalType, T.BooleanType, T.DateType, T.TimestampNTZType,
    T.TimestampType,
)


def _as_text(value: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.TimestampType):  # an hour comes twice when clocks go back
        value = F.unix_micros(value)
    elif is_floating(dtype):  # -0.0 and 0.0 are one value
        value = value + F.lit(0).cast(dtype)
    return value.cast("string")


def _from_text(text: Column, dtype: T.DataType) -> Column:
    return F.timestamp_micros(text.cast("bigint")) if isinstance(dtype, T.TimestampType) else text.cast(dtype)


def load_rates(spark: SparkSession, key: str, path: str) -> GroupRates:
    return GroupRates.from_table(key, spark.read.parquet(path))


def encode_leave_one_out(
    df: DataFrame, rates: GroupRates, target: str, rate: str, known: str
) -> DataFrame:
    """Encode the rows the rates were fitted on, each without its own label."""
    found = with_totals(df, rates)
    others = F.col(TOTAL) - number_of(df, target)
    return _encode(found, others, F.col(ROWS) - 1, rate, known)


def encode_rates(df: DataFrame, rates: GroupRates, rate: str, known: str) -> DataFrame:
    """Encode other rows from everything the rates were fitted on."""
    return _encode(with_totals(df, rates), F.col(TOTAL), F.col(ROWS), rate, known)


def _encode(df: DataFrame, total: Column, rows: Column, rate: str, known: str) -> DataFrame:
    seen = F.coalesce(rows, F.lit(0)) > 0
    return (
        df.withColumn(rate, F.when(seen, F.try_divide(total.cast("double"), rows)))
        .withColumn(known, seen.cast("double"))
        .drop(TOTAL, ROWS)
    )


def with_totals(
    df: DataFrame, rates: GroupRates, broadcast_bytes: int | None = None
) -> DataFrame:
    """Left join of the totals; every row of `df` stays, once."""
    limit = BROADCAST_BYTES if broadcast_bytes is None else broadcast_bytes
    totals = rates.table.select(
        F.col("key").alias("__key"), F.col("total").alias(TOTAL), F.col("rows").alias(ROWS), "salt"
    )
    if rates.size_bytes <= limit:
        joined = df.join(F.broadcast(totals), quoted(rates.key) == F.col("__key"), "left")
        return joined.drop("__key", "salt")
    return _skewed_join(df, rates, totals)


def _skewed_join(df: DataFrame, rates: GroupRates, totals: DataFrame) -> DataFrame:
    """Shuffled join in which neither hot nor missing keys crowd into one task.

    Keys above a thousandth of the rows of `df`, at most a thousand of them and known to the
    rates or not, are looked up by broadcast. Their rows and those without a key need nothing
    from the shuffled side, so a salt spreads them evenly; all other rows carry salt 0, as the
    stored table does.
    """
    key = quoted(rates.key)
    if df.isStreaming:  # rows still to come cannot be counted: the training rows stand for them
        found = totals.filter(F.col(ROWS) * HOT_SHARE > rates.rows).select(F.col("__key").alias("__hot"))
    else:
        everything = df.agg(F.count(F.lit(1))).first()[0]
        counted = df.filter(key.isNotNull()).groupBy(key.alias("__hot")).agg(F.count(F.lit(1)).alias("__n"))
        found = counted.filter(F.col("__n") * HOT_SHARE > everything).select("__hot")
    hot = found.join(totals, F.col("__hot") == F.col("__key"), "left").select(
        "__hot", F.col(TOTAL).alias("__hot_total"), F.col(ROWS).alias("__hot_rows")
    )
    first = df.join(F.broadcast(hot), key == F.col("__hot"), "left")
    open_key = F.when(F.col("__hot").isNull(), quoted(rates.key))
    plain = [f.name for f in df.schema.fields if isinstance(f.dataType, T.AtomicType)]
    spread = F.pmod(F.xxhash64(*map(quoted, plain)), F.lit(SALTS))
    salted = first.withColumn("__open", open_key).withColumn(
        SALT, F.when(F.col("__open").isNull(), spread).otherwise(F.lit(0).cast("bigint"))
    )
    same = (F.col("__open") == F.col("__key")) & (F.col(SALT) == F.col("salt"))
    return (
        salted.join(totals, same, "left")
        .withColumn(TOTAL, F.coalesce(TOTAL, "__hot_total"))
        .withColumn(ROWS, F.coalesce(ROWS, "__hot_rows"))
        .drop("__hot", "__hot_total", "__hot_rows", "__open", "__key", "salt", SALT)
    )
