"""Small column expressions: type tests, missing values, row keys."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def field_type(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def quoted(name: str) -> Column:
    """A top-level column by its exact name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_floating(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.FloatType, T.DoubleType))


def is_number(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def is_numeric(dtype: T.DataType) -> bool:
    """Numeric in the sense of the quality checks: booleans count as 0/1."""
    return is_number(dtype) or isinstance(dtype, T.BooleanType)


def number_of(df: DataFrame, name: str) -> Column:
    """The column as a number, booleans as 0/1."""
    column = quoted(name)
    return column.cast("int") if isinstance(field_type(df, name), T.BooleanType) else column


def is_infinite(column: Column) -> Column:
    return F.abs(column) == F.lit(float("inf"))


def is_missing(df: DataFrame, name: str) -> Column:
    """NULL, or NaN in a floating column."""
    value = quoted(name)
    return value.isNull() | F.isnan(value) if is_floating(field_type(df, name)) else value.isNull()


def missing_to_null(df: DataFrame) -> DataFrame:
    """NaN becomes NULL and -0.0 becomes 0.0, so missing and equal each have one form.

    Only floating columns are touched; other columns stay plain references, which keeps
    their filters and projections inside the file scan.
    """
    return df.select(
        *(
            F.nanvl(quoted(f.name) + F.lit(0).cast(f.dataType), F.lit(None).cast(f.dataType)).alias(
                f.name
            )
            if is_floating(f.dataType)
            else quoted(f.name)
            for f in df.schema.fields
        )
    )


def all_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda left, right: left & right, conditions, F.lit(True))


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda left, right: left | right, conditions, F.lit(False))


# Every field, and times to the microsecond, so different rows never have one text.
_WHOLE = {
    "ignoreNullFields": "false",
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}


def row_key(df: DataFrame, id_cols: Sequence[str] = ()) -> Column:
    """Text identifying a row: the id columns if given, else a hash of the whole row.

    NULL where an id column is NULL: such a row cannot be told from others.

    The hash is unique only on a table without identical rows, so take it after
    removing duplicates and before dropping columns.
    """
    if len(id_cols) == 1:
        return quoted(id_cols[0]).cast("string")
    names = list(id_cols) or df.columns
    body = F.to_json(F.struct(*(quoted(n) for n in names)), _WHOLE)
    if not id_cols:
        return F.sha2(body, 256)
    return F.when(all_of([quoted(n).isNotNull() for n in names]), body)


def split_hash(key: Column, seed: int | str) -> Column:
    """Pseudo-random position of a row: a pure function of seed and row key."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key))
