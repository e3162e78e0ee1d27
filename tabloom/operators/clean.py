"""Column checks, label encoding and row cleaning."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import chain
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.functions.columns import (
    all_of,
    field_type,
    is_floating,
    is_infinite,
    is_missing,
    is_number,
    is_numeric,
    missing_to_null,
    number_of,
    quoted,
)
from tabloom.operators.quality import COPIES, count_copies
from tabloom.spec import ValueRange


# Mappings of up to this many labels are an expression; longer ones are a table.
FEW_LABELS = 64


def validate_columns(df: DataFrame, required: Sequence[str]) -> None:
    missing = [name for name in required if name not in df.columns]
    if missing:
        raise ValueError(f"the table lacks required columns: {missing}")


def unmapped_labels(df: DataFrame, target: str, mapping: Mapping[Any, int]) -> DataFrame:
    """Labels present in the table but not in the mapping, with their row counts."""
    known = _usable_keys(field_type(df, target), mapping)
    value = number_of(df, target)
    if len(known) > FEW_LABELS:
        counted = df.filter(value.isNotNull()).groupBy(quoted(target).alias("label")).agg(F.count(F.lit(1)).alias("rows"))
        codes = _code_table(df, target, known, mapping)
        return counted.join(F.broadcast(codes), number_of(counted, "label") == F.col("__known"), "left_anti")
    outside = value.isNotNull() & ~value.isin(*known) if known else value.isNotNull()
    return df.filter(outside).groupBy(quoted(target).alias("label")).agg(F.count(F.lit(1)).alias("rows"))


def encode_target(df: DataFrame, target: str, mapping: Mapping[Any, int]) -> DataFrame:
    """Replace labels by integer codes. A label without a code is an error."""
    if not mapping:
        return df
    validate_columns(df, [target])
    found = unmapped_labels(df, target, mapping).agg(
        F.count(F.lit(1)).alias("labels"), F.sum("rows").alias("rows"), F.min("label").alias("first")
    ).first()
    if found["labels"]:
        raise ValueError(
            f"{found['labels']} labels of {target!r}, in {found['rows']} rows, have no code, the first "
            f"being {found['first']!r}; unmapped_labels() gives the table of them"
        )
    known = _usable_keys(field_type(df, target), mapping)
    if len(known) <= FEW_LABELS:
        return df.withColumn(target, _lookup(df, target, mapping))
    codes = _code_table(df, target, known, mapping)
    joined = df.join(F.broadcast(codes), number_of(df, target) == F.col("__known"), "left")
    return joined.withColumn(target, F.col("__code")).select(*map(quoted, df.columns))


def _code_table(
    df: DataFrame, target: str, known: Sequence[Any], mapping: Mapping[Any, int]
) -> DataFrame:
    """The mapping as a table, as large as the specification that holds it."""
    text = isinstance(field_type(df, target), T.StringType)
    whole = all(isinstance(key, int) for key in known)
    kind = "string" if text else "bigint" if whole else "double"
    rows = {(key if text else int(key) if whole else float(key)): int(mapping[key]) for key in known}
    return df.sparkSession.createDataFrame(list(rows.items()), f"__known {kind}, __code bigint")


def _lookup(df: DataFrame, target: str, mapping: Mapping[Any, int]) -> Column:
    value = number_of(df, target)
    usable = _usable_keys(field_type(df, target), mapping)
    if not usable:
        return F.lit(None).cast("bigint")
    codes = chain.from_iterable((F.lit(key), F.lit(mapping[key])) for key in usable)
    return F.create_map(*codes)[value].cast("bigint")


def _usable_keys(dtype: T.DataType, mapping: Mapping[Any, int]) -> list[Any]:
    """Keys of the column's own kind; text '1' never matches the number 1."""
    if isinstance(dtype, T.StringType):
        return [key for key in mapping if isinstance(key, str)]
    numbers = [key for key in mapping if isinstance(key, (int, float))]
    if isinstance(dtype, T.BooleanType):
        return [key for key in numbers if key in (0, 1)]
    if isinstance(dtype, T.IntegralType):
        return [key for key in numbers if key == int(key)]
    return numbers if is_number(dtype) else []


def drop_missing_target(df: DataFrame, target: str) -> DataFrame:
    return df.filter(~is_missing(df, target))


def valid_values(df: DataFrame, ranges: Mapping[str, ValueRange]) -> Column:
    """Row condition: no infinite number, every bounded number within its bounds.

    Missing values pass; bounds on absent or non-numeric columns are ignored.
    """
    conditions = [
        is_missing(df, f.name) | ~is_infinite(quoted(f.name))
        for f in df.schema.fields
        if is_floating(f.dataType)
    ]
    for name, bounds in ranges.items():
        if name not in df.columns or not is_numeric(field_type(df, name)):
            continue
        value = number_of(df, name)
        if bounds.minimum is not None:
            conditions.append(is_missing(df, name) | (value >= F.lit(bounds.minimum)))
        if bounds.maximum is not None:
            conditions.append(is_missing(df, name) | (value <= F.lit(bounds.maximum)))
    return all_of(conditions)


def drop_invalid_values(df: DataFrame, ranges: Mapping[str, ValueRange]) -> DataFrame:
    return df.filter(valid_values(df, ranges))


def usable_rows(
    df: DataFrame, modelling: Sequence[str], target: str, ranges: Mapping[str, ValueRange]
) -> DataFrame:
    """Rows fit for modelling, judged on the modelling columns only.

    Other columns of `df`, such as a row key, are carried along untouched.
    """
    condition = valid_values(df.select(*map(quoted, modelling)), ranges)
    return drop_missing_target(df, target).filter(condition)


def clean_dataset(
    df: DataFrame,
    features: Sequence[str],
    target: str,
    ranges: Mapping[str, ValueRange] | None = None,
) -> DataFrame:
    """Modelling columns of the distinct rows, without unusable ones.

    Rows count as equal over every column; rows that look equal only after narrowing
    are separate observations and stay. Missing features stay for later imputation.
    """
    modelling = [*features, target]
    validate_columns(df, modelling)
    # Equal rows are usable or not alike, so the filter may stand before the shuffle.
    usable = usable_rows(missing_to_null(df), modelling, target, ranges or {})
    return count_copies(usable, modelling).drop(COPIES)
