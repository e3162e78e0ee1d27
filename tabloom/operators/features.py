"""Statistics learned from training rows: medians, scales, modes and categories."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.functions.columns import (
    field_type,
    is_floating,
    is_number,
    number_of,
    quoted,
)
from tabloom.operators.lookup import look_up, table_bytes
from tabloom.operators.position import spots_of_columns
from tabloom.operators.scan import ROWS_PER_RANGE, running_totals
from tabloom.sources.work import WorkArea

# Columns with fewer distinct values than this get their median from a value count.
COUNTED_VALUES = 200_000
# Vocabularies of up to this many values, all columns together, are kept with the column's
# statistics; larger ones are a table.
FEW_CATEGORIES = 10_000


@dataclass(frozen=True)
class NumericStats:
    """Median to impute with, then mean and population deviation after imputing."""

    name: str
    median: float
    mean: float
    scale: float


@dataclass(frozen=True)
class CategoryStats:
    """Most frequent value to impute with, number of values, and the values in order, as text.

    `values` is None where they are kept in the vocabulary's table.
    """

    name: str
    fill: str
    values: tuple[str, ...] | None
    size: int


@dataclass(frozen=True)
class Vocabulary:
    """What one-hot encoding learns. `table` holds (name, value, place) if the values are many.

    A place is the element of the encoding of all columns together: columns in order, then values.
    """

    columns: list[CategoryStats]
    table: DataFrame | None = None

    @property
    def size(self) -> int:
        return sum(stats.size for stats in self.columns)


def split_features_and_target(
    df: DataFrame, features: Sequence[str], target: str
) -> tuple[DataFrame, DataFrame]:
    return df.select(*map(quoted, features)), df.select(quoted(target))


def present_number(df: DataFrame, name: str) -> Column:
    """The column as double, NaN read as missing."""
    value = number_of(df, name)
    if is_floating(field_type(df, name)):
        value = F.nanvl(value, F.lit(None).cast(field_type(df, name)))
    return value.cast("double")


def exact_medians(
    df: DataFrame,
    names: Sequence[str],
    counts: Mapping[str, int],
    distinct: Mapping[str, int],
    counted_values: int = COUNTED_VALUES,
) -> dict[str, float]:
    """Median of the present values; of an even number, the mean of the middle two.

    Columns with few distinct values are counted by value, all in one job. For the others the
    middle ranks are located together, without collecting or sorting their values.
    """
    present = [name for name in names if counts[name]]
    few = [name for name in present if distinct[name] <= counted_values]
    medians = _counted_medians(df, few)
    many = [name for name in present if name not in medians]
    ranks = [sorted({(counts[name] + 1) // 2, counts[name] // 2 + 1}) for name in many]
    values = [present_number(df, name) for name in many]
    found = spots_of_columns(df, values, ranks, [counts[name] for name in many])
    for name, wanted, spots in zip(many, ranks, found, strict=True):
        medians[name] = sum(spots[rank].value for rank in wanted) / len(wanted)
    return medians


def _counted_medians(df: DataFrame, names: Sequence[str]) -> dict[str, float]:
    if not names:
        return {}
    values = _value_counts(df, {name: present_number(df, name) for name in names})
    middle = values.groupBy("id").agg(F.percentile("value", 0.5, F.col("rows")).alias("median"))
    return {names[row["id"]]: row["median"] for row in middle.collect()}


def _value_counts(df: DataFrame, columns: Mapping[str, Column], *by: str) -> DataFrame:
    """Rows per column (by position) and present value, and per value of `by`, from one scan."""
    cells = F.array(
        *(
            F.struct(F.lit(index).alias("id"), column.alias("value"))
            for index, column in enumerate(columns.values())
        )
    )
    return (
        df.select(F.explode(cells).alias("cell"), *by)
        .select("cell.*", *by)
        .filter(F.col("value").isNotNull())
        .groupBy("id", "value", *by)
        .agg(F.count(F.lit(1)).alias("rows"))
    )


def numeric_stats(
    df: DataFrame, names: Sequence[str], counted_values: int = COUNTED_VALUES
) -> list[NumericStats]:
    """Imputation and scaling constants; columns without any value are left out.

    Mean and deviation after imputing follow from those of the present values and the
    number of copies of the median, so no second pass over imputed data is needed.
    """
    if not names:
        return []
    wanted = [F.count(F.lit(1)).alias("rows")]
    for index, name in enumerate(names):
        value = present_number(df, name)
        wanted += [
            F.count(value).alias(f"count_{index}"),
            F.avg(value).alias(f"mean_{index}"),
            F.var_pop(value).alias(f"spread_{index}"),
            (F.min(value) == F.max(value)).alias(f"constant_{index}"),
            F.approx_count_distinct(value).alias(f"distinct_{index}"),
        ]
    found = df.agg(*wanted).first()
    counts = {name: found[f"count_{index}"] for index, name in enumerate(names)}
    distinct = {name: found[f"distinct_{index}"] for index, name in enumerate(names)}
    medians = exact_medians(df, names, counts, distinct, counted_values)
    stats = []
    for index, name in enumerate(names):
        if name in medians:
            present = (counts[name], found[f"mean_{index}"], found[f"spread_{index}"])
            constant = found[f"constant_{index}"]
            stats.append(numeric_stats_from(name, found["rows"], present, medians[name], constant))
    return stats


def numeric_stats_from(
    name: str, rows: int, present: tuple[int, float, float], median: float, constant: bool
) -> NumericStats:
    """From count, mean and population variance of the present values of so many rows."""
    if constant:  # its median fills any gap, so it stays constant: centred, not scaled
        return NumericStats(name, median, median, 1.0)
    count, mean, spread = present
    filled = rows - count
    overall = (count * mean + filled * median) / rows
    variance = (
        count * (spread + (mean - overall) ** 2) + filled * (median - overall) ** 2
    ) / rows
    return NumericStats(name, median, overall, variance**0.5 or 1.0)


def scaled(df: DataFrame, stats: NumericStats) -> Column:
    value = F.coalesce(present_number(df, stats.name), F.lit(stats.median))
    return (value - F.lit(stats.mean)) / F.lit(stats.scale)


def category_counts(df: DataFrame, names: Sequence[str], *by: str) -> DataFrame:
    """Rows per categorical column (by position) and value, values as text."""
    return _value_counts(df, {name: quoted(name).cast("string") for name in names}, *by)


def category_stats(df: DataFrame, names: Sequence[str]) -> list[CategoryStats]:
    """Mode and sorted values of columns with few of them; ties go to the smallest, empty
    columns are left out."""
    counts = category_counts(df, names) if names else None
    found = [] if counts is None else counts.limit(FEW_CATEGORIES + 1).collect()
    if len(found) > FEW_CATEGORIES:
        raise ValueError(f"{list(names)} hold more than {FEW_CATEGORIES} values; learn a vocabulary of them")
    return _listed_categories(df, names, found)


def learn_vocabulary(
    df: DataFrame,
    names: Sequence[str],
    area: WorkArea,
    few: int | None = None,
    rows_per_range: int = ROWS_PER_RANGE,
) -> Vocabulary:
    """Modes and values of all columns from one scan, however many values there are.

    Many values get their places by a running count over the ordered values, range by range; only
    a row per column reaches the driver. Ties and empty columns are as in `category_stats`.
    """
    if not names:
        return Vocabulary([])
    counts = area.table(category_counts(df, names), "categories")
    return vocabulary_of(counts, df, names, area, few, rows_per_range)


def vocabulary_of(
    counts: DataFrame,
    df: DataFrame,
    names: Sequence[str],
    area: WorkArea,
    few: int | None = None,
    rows_per_range: int = ROWS_PER_RANGE,
) -> Vocabulary:
    """The vocabulary that `category_counts` of the columns of `df` give."""
    total = counts.agg(F.count(F.lit(1))).first()[0]
    if total <= (FEW_CATEGORIES if few is None else few):
        return Vocabulary(_listed_categories(df, names, counts.collect()))
    numbers = [index for index, name in enumerate(names) if is_number(field_type(df, name))]
    number = F.when(F.col("id").isin(numbers), F.col("value").cast("double"))
    counts = counts.withColumn("number", number)
    best = F.min(F.struct((-F.col("rows")).alias("most"), "number", "value"))
    found = counts.groupBy("id").agg(best["value"].alias("fill"), F.count(F.lit(1)).alias("size"))
    stats = [
        CategoryStats(names[row["id"]], row["fill"], None, row["size"])
        for row in sorted(found.collect(), key=lambda row: row["id"])
    ]
    order = [F.col("id"), F.col("number"), F.col("value")]
    placed = running_totals(counts, order, {"place": F.lit(1)}, area, rows_per_range, total)
    named = F.element_at(F.array(*map(F.lit, names)), F.col("id") + 1)
    return Vocabulary(stats, area.table(placed.select(named.alias("name"), "value", "place"), "vocabulary"))


def _listed_categories(df: DataFrame, names: Sequence[str], found: list) -> list[CategoryStats]:
    counts: dict[int, dict[str, int]] = {}
    for row in found:
        counts.setdefault(row["id"], {})[row["value"]] = row["rows"]
    stats = []
    for index, name in enumerate(names):
        if index in counts:
            order = _value_order(field_type(df, name))
            values = tuple(sorted(counts[index], key=order))
            fill = max(values, key=counts[index].__getitem__)
            stats.append(CategoryStats(name, fill, values, len(values)))
    return stats


def _value_order(dtype: T.DataType) -> Any:
    return float if is_number(dtype) else str


def filled(stats: CategoryStats) -> Column:
    return F.coalesce(quoted(stats.name).cast("string"), F.lit(stats.fill))


def places(df: DataFrame, vocabulary: Vocabulary, out: Sequence[str]) -> DataFrame:
    """Add, per column of a vocabulary kept as a table, the place of the row's value in the
    encoding: NULL for values never trained."""
    for stats, name in zip(vocabulary.columns, out, strict=True):
        own = vocabulary.table.filter(F.col("name") == stats.name)
        table = own.select(F.col("value").alias("key"), F.col("place").alias(name))
        df = look_up(df, filled(stats), table, table_bytes(table))
    return df


def one_hot_long(df: DataFrame, key: str, stats: CategoryStats) -> DataFrame:
    """The ones of the encoding: a row for each row of `df` whose value was trained."""
    cells = df.select(quoted(key), filled(stats).alias("category"), F.lit(1).alias("value"))
    trained = df.sparkSession.createDataFrame([(v,) for v in stats.values], "category string")
    return cells.join(trained, "category", "left_semi").select(quoted(key), "category", "value")
