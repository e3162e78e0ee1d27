"""What every fold's training rows teach, learned for all folds together.

Moments, category counts, class sizes and group totals are counted once per fold. The training side
of a fold is put together from the folds it trains on, so nothing is counted again; only medians
need the rows once more, and those of all folds and columns are searched together.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions.columns import number_of, quoted
from tabloom.operators.features import (
    NumericStats,
    Vocabulary,
    category_counts,
    exact_medians,
    numeric_stats_from,
    present_number,
    vocabulary_of,
)
from tabloom.operators.group_rate import ROWS, TOTAL, GroupRates, with_totals
from tabloom.operators.lookup import ROW_BYTES
from tabloom.operators.split import FOLD
from tabloom.sources.work import WorkArea


@dataclass(frozen=True)
class Moments:
    """Rows of a column that have a value: how many, mean, squared deviations, bounds, distinct."""

    count: int
    mean: float
    squares: float
    least: float
    most: float
    distinct: int

    def merged(self, other: Moments) -> Moments:
        if not self.count or not other.count:
            return self if self.count else other
        count, gap = self.count + other.count, other.mean - self.mean
        return Moments(
            count,
            self.mean + gap * other.count / count,
            self.squares + other.squares + gap * gap * self.count * other.count / count,
            min(self.least, other.least),
            max(self.most, other.most),
            self.distinct + other.distinct,
        )


@dataclass(frozen=True)
class EncoderFacts:
    """Statistics of one training side, and its rows with their group rates looked up."""

    numeric: list[NumericStats]
    vocabulary: Vocabulary
    rates: list[GroupRates]
    rate_medians: list[float | None]
    classes: dict[Any, int] | None
    rows: DataFrame


def training_folds(numbers: Sequence[int], fold: int, temporal: bool) -> list[int]:
    return [number for number in numbers if (number < fold if temporal else number != fold)]


def learn_folds(
    assigned: DataFrame,
    numerical: Sequence[str],
    categorical: Sequence[str],
    group_keys: Sequence[str],
    target: str,
    folds: int,
    temporal: bool,
    classified: bool,
    area: WorkArea,
) -> list[EncoderFacts]:
    """The facts of every fold's training side; `assigned` holds the fold of each row."""
    counted, classes = _counted(assigned, numerical, target, classified)
    numbers = sorted(counted)
    sides = [training_folds(numbers, fold, temporal) for fold in range(folds)]
    chosen = [F.col(FOLD).isin(side) for side in sides]
    numeric = _numeric(assigned, numerical, counted, sides, chosen)
    vocabularies = _vocabularies(assigned, categorical, sides, area)
    totals = [_fold_totals(assigned, key, target, numbers, sides, area) for key in group_keys]
    rated = _rated(assigned, totals, [*numerical, *categorical], target, folds)
    if group_keys:
        rated = area.table(rated, "rated")
    medians = _rate_medians(rated, len(group_keys), chosen)
    facts = []
    for fold, side in enumerate(sides):
        names = [n for index in range(len(group_keys)) for n in (f"__tb_rate_{index}", f"__tb_known_{index}")]
        own = (F.col(f"__tb_all_{name[5:]}")[fold].alias(name) for name in names)
        rows = rated.filter(chosen[fold]).select(*map(quoted, dict.fromkeys([*numerical, *categorical, target])), *own)
        sizes = _merged_sizes(classes, side) if classified else None
        rates = [_side_rates(group, fold) for group in totals]
        facts.append(EncoderFacts(numeric[fold], vocabularies[fold], rates, medians[fold], sizes, rows))
    return facts


def _counted(
    assigned: DataFrame, numerical: Sequence[str], target: str, classified: bool
) -> tuple[dict[int, tuple[int, list[Moments]]], dict[int, dict[Any, int]]]:
    """Rows and moments by fold, and class sizes by fold."""
    wanted = [F.count(F.lit(1)).alias("rows")]
    for name in numerical:
        value = present_number(assigned, name)
        wanted += [
            F.count(value), F.avg(value), F.var_pop(value), F.min(value), F.max(value),
            F.approx_count_distinct(value),
        ]
    counted = {}
    for row in assigned.groupBy(FOLD).agg(*wanted).collect():
        cells = list(row)[2:]
        moments = []
        for at in range(0, len(cells), 6):
            count, mean, spread, least, most, distinct = cells[at : at + 6]
            moments.append(Moments(count, mean or 0.0, (spread or 0.0) * count, least, most, distinct))
        counted[row[FOLD]] = (row["rows"], moments)
    sizes: dict[int, dict[Any, int]] = {}
    if classified:
        for row in assigned.groupBy(FOLD, quoted(target).alias("label")).count().collect():
            sizes.setdefault(row[FOLD], {})[row["label"]] = row["count"]
    return counted, sizes


def _merged_sizes(sizes: Mapping[int, Mapping[Any, int]], side: Sequence[int]) -> dict[Any, int]:
    total: dict[Any, int] = {}
    for fold in side:
        for label, rows in sizes.get(fold, {}).items():
            total[label] = total.get(label, 0) + rows
    return dict(sorted(total.items()))


def _numeric(
    assigned: DataFrame,
    names: Sequence[str],
    counted: Mapping[int, tuple[int, list[Moments]]],
    sides: Sequence[Sequence[int]],
    chosen: Sequence[Column],
) -> list[list[NumericStats]]:
    none = Moments(0, 0.0, 0.0, 0.0, 0.0, 0)
    merged = []
    for side in sides:
        total = [none] * len(names)
        for fold in side:
            total = [a.merged(b) for a, b in zip(total, counted[fold][1], strict=True)]
        merged.append(total)

    def value(index: int, fold: int) -> Column:
        return F.when(chosen[fold], present_number(assigned, names[index]))

    medians = _medians_of_sides(assigned, len(names), len(sides), value, merged)
    found = []
    for fold, side in enumerate(sides):
        rows = sum(counted[number][0] for number in side)
        found.append([
            numeric_stats_from(
                name, rows, (m.count, m.mean, m.squares / m.count), medians[index, fold], m.least == m.most
            )
            for index, (name, m) in enumerate(zip(names, merged[fold], strict=True))
            if m.count
        ])
    return found


def _medians_of_sides(
    df: DataFrame,
    columns: int,
    folds: int,
    value: Callable[[int, int], Column],
    merged: Sequence[Sequence[Moments]],
) -> dict[tuple[int, int], float]:
    """Medians of every column on every training side, searched as so many columns at once."""
    places = {f"v{index}_{fold}": (index, fold) for index in range(columns) for fold in range(folds)}
    if not places:
        return {}
    wide = df.select(*(value(*place).alias(name) for name, place in places.items()))
    counts = {name: merged[fold][index].count for name, (index, fold) in places.items()}
    distinct = {name: merged[fold][index].distinct for name, (index, fold) in places.items()}
    found = exact_medians(wide, list(places), counts, distinct)
    return {places[name]: median for name, median in found.items()}


def _vocabularies(
    assigned: DataFrame, names: Sequence[str], sides: Sequence[Sequence[int]], area: WorkArea
) -> list[Vocabulary]:
    if not names:
        return [Vocabulary([])] * len(sides)
    counts = area.table(category_counts(assigned, names, FOLD), "categories")
    sums = [counts.filter(F.col(FOLD).isin(side)).groupBy("id", "value").agg(F.sum("rows").alias("rows")) for side in sides]
    return [vocabulary_of(own, assigned, names, area) for own in sums]


def _fold_totals(
    assigned: DataFrame,
    key: str,
    target: str,
    numbers: Sequence[int],
    sides: Sequence[Sequence[int]],
    area: WorkArea,
) -> GroupRates:
    """Per key value the target sums and rows of all training sides, as arrays by fold."""
    value = number_of(assigned, target)
    of_fold = [F.col(FOLD) == number for number in numbers]
    parts = assigned.filter(quoted(key).isNotNull()).groupBy(quoted(key).alias("key")).agg(
        F.array(*(F.sum(F.when(own, value)) for own in of_fold)).alias("totals"),
        F.array(*(F.count_if(own) for own in of_fold)).alias("counts"),
    )

    def side_sums(name: str) -> Column:
        at = {number: index for index, number in enumerate(numbers)}
        sums = []
        for side in sides:
            cells = [F.coalesce(F.col(name)[at[number]], F.lit(0)) for number in side]
            sums.append(sum(cells[1:], cells[0]) if cells else F.lit(0))
        return F.array(*sums)

    table = parts.select(
        "key", side_sums("totals").alias("total"), side_sums("counts").alias("rows"), F.lit(0).cast("bigint").alias("salt")
    )
    held = area.table(table, "totals")
    width = F.octet_length(F.col("key").cast("string")) + F.lit(ROW_BYTES + 16 * len(sides))
    rows, size = held.agg(F.sum(F.array_max("rows")), F.sum(width)).first()
    return GroupRates(key, held, rows or 0, size or 0)


def _side_rates(group: GroupRates, fold: int) -> GroupRates:
    own = group.table.select("key", F.col("total")[fold].alias("total"), F.col("rows")[fold].alias("rows"), "salt")
    return GroupRates(group.key, own.filter("rows > 0"), group.rows, group.size_bytes)


def _rated(
    assigned: DataFrame, totals: Sequence[GroupRates], features: Sequence[str], target: str, folds: int
) -> DataFrame:
    """Rows with their leave-one-out rate and flag on every training side, by one join a key."""
    found = assigned.select(*map(quoted, dict.fromkeys([*features, *(g.key for g in totals), target])), FOLD)
    value = number_of(assigned, target)
    for index, group in enumerate(totals):
        found = with_totals(found, group)
        rates, flags = [], []
        for fold in range(folds):
            rows = F.coalesce(F.col(ROWS)[fold] - 1, F.lit(0))
            others = (F.col(TOTAL)[fold] - value).cast("double")
            rates.append(F.when(rows > 0, F.try_divide(others, rows)))
            flags.append((rows > 0).cast("double"))
        added = {f"__tb_all_rate_{index}": F.array(*rates), f"__tb_all_known_{index}": F.array(*flags)}
        found = found.withColumns(added).drop(TOTAL, ROWS)
    return found


def _rate_medians(rated: DataFrame, keys: int, chosen: Sequence[Column]) -> list[list[float | None]]:
    if not keys:
        return [[] for _ in chosen]
    places = [(index, fold) for fold in range(len(chosen)) for index in range(keys)]

    def value(index: int, fold: int) -> Column:
        return F.when(chosen[fold], F.col(f"__tb_all_rate_{index}")[fold])

    wanted = [part for place in places for part in (F.count(value(*place)), F.approx_count_distinct(value(*place)))]
    cells = list(rated.agg(*wanted).first())
    sides = [[Moments(0, 0.0, 0.0, 0.0, 0.0, 0)] * keys for _ in chosen]
    for number, (index, fold) in enumerate(places):
        count, distinct = cells[2 * number : 2 * number + 2]
        sides[fold][index] = Moments(count, 0.0, 0.0, 0.0, 0.0, distinct)
    medians = _medians_of_sides(rated, keys, len(chosen), value, sides)
    return [[medians.get((index, fold)) for index in range(keys)] for fold in range(len(chosen))]
