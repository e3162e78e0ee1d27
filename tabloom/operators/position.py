"""Exact cut points in a global order, found without sorting or moving rows.

Splits, folds, deciles and medians all ask which row stands at a given rank. A global
`row_number` would send every row through one task. Here each pass counts the rows
between a few pivots (a small aggregate), keeps the interval holding the wanted rank
and looks closer at it, so the answer is exact while only counts leave the executors.
Pivots come from a sample, but they steer the search only; they never change the answer.
"""

from __future__ import annotations

import itertools
import math
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Collection, Mapping, Sequence
from dataclasses import dataclass
from datetime import datetime, timedelta
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.functions.columns import any_of, field_type, quoted

# More comparisons than this make a generated method too long for the JVM to compile.
MAX_PIVOTS = 31
SAMPLE_ROWS = 10_000
# Sampled values of all columns searched together.
SAMPLE_VALUES = 300_000
# So few rows are counted value by value instead of between pivots.
DIRECT_ROWS = 10_000
# Histogram cells one pass over the hash order may return to the driver.
HASH_CELLS = 131_072
FEW_CELLS = 8192
# So many places are looked for by a condition, more by a join.
FEW_PLACES = 64

HASH = "__hash"


@dataclass(frozen=True)
class Spot:
    """The value at a rank, the rows before that value and the rows sharing it."""

    value: Any
    before: int
    equal: int


@dataclass(frozen=True)
class Cut:
    """A place in the order; `values` bound the leading sort keys."""

    values: tuple[Any, ...]

    def covers(self, df: DataFrame, keys: Sequence[str]) -> Column:
        """Rows at or before the cut."""
        condition = None
        for name, value in reversed(list(zip(keys, self.values, strict=False))):
            column, bound = quoted(name), literal(value, field_type(df, name))
            if condition is None:
                condition = column <= bound
            else:
                condition = (column < bound) | ((column == bound) & condition)
        return condition


@dataclass(frozen=True)
class _Span:
    """Values strictly between two bounds, with the ranks wanted among them."""

    low: Any
    high: Any
    before: int
    rows: int
    ranks: tuple[int, ...]


def sql_literal(value: Any, dtype: T.DataType) -> str:
    """A driver value as a SQL literal of the column's type.

    Literals, unlike casts of text, cost nothing to plan and reach the file scan.
    """
    if isinstance(dtype, T.BooleanType):
        return "TRUE" if value else "FALSE"
    if isinstance(dtype, T.IntegralType):
        return f"{value}L"
    if isinstance(dtype, T.DecimalType):
        return f"{value:f}BD"
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        name, suffix = ("FLOAT", "F") if isinstance(dtype, T.FloatType) else ("DOUBLE", "D")
        return f"{value!r}{suffix}" if math.isfinite(value) else f"{name}('{value}')"
    if isinstance(dtype, T.DateType):
        return f"DATE'{value.isoformat()}'"
    if isinstance(dtype, T.TimestampNTZType):
        return f"TIMESTAMP_NTZ'{value.isoformat(sep=' ')}'"
    if isinstance(dtype, T.TimestampType):
        moment = datetime(1970, 1, 1) + timedelta(microseconds=value)
        return f"TIMESTAMP'{moment.isoformat(sep=' ')}Z'"
    if isinstance(dtype, T.StringType):
        plain = value.isprintable() and not set(value) & set("'\\")
        return f"'{value}'" if plain else f"CAST(X'{value.encode().hex()}' AS STRING)"
    raise TypeError(f"cannot order rows by a column of type {dtype.simpleString()}")


def literal(value: Any, dtype: T.DataType) -> Column:
    return F.expr(sql_literal(value, dtype))


def _to_driver(column: Column, dtype: T.DataType) -> Column:
    return F.unix_micros(column) if isinstance(dtype, T.TimestampType) else column


def spots_at_ranks(
    df: DataFrame, column: str, ranks: Sequence[int], rows: int, direct_rows: int = DIRECT_ROWS
) -> dict[int, Spot]:
    """Value of `column` at each 1-based rank in ascending order. The column has no NULLs."""
    dtype = field_type(df, column)
    value = quoted(column)
    found: dict[int, Spot] = {}
    spans = [_Span(None, None, 0, rows, tuple(sorted(set(ranks))))] if ranks else []
    attempt = 0
    while spans:
        inside = any_of([_within(value, span, dtype) for span in spans])
        part = df.filter(inside).select(value.alias("value"))
        total = sum(span.rows for span in spans)
        if total <= direct_rows:
            counted = _count_values(part, dtype)
            for span in spans:
                _settle(span, counted, found)
            break
        pivots = _choose_pivots(part, dtype, spans, total, attempt)
        histogram = _count_between(part, pivots, dtype)
        spans = [
            inner for span in spans for inner in _narrow(span, pivots, histogram, found)
        ]
        attempt += 1
    return found


def spots_of_columns(
    df: DataFrame,
    columns: Sequence[Column],
    ranks: Sequence[Sequence[int]],
    rows: Sequence[int],
    direct_rows: int = DIRECT_ROWS,
) -> list[dict[int, Spot]]:
    """`spots_at_ranks` for many columns of doubles at once; NULLs have no rank.

    `rows` counts the present values of each column. One aggregate a pass counts the cells of
    all columns still open, so the number of jobs doesn't depend on how many there are.
    """
    dtype = T.DoubleType()
    found: list[dict[int, Spot]] = [{} for _ in columns]
    open_ = {
        index: [_Span(None, None, 0, count, tuple(sorted(set(wanted))))]
        for index, (wanted, count) in enumerate(zip(ranks, rows, strict=True))
        if wanted
    }
    attempt = 0
    while open_:
        held = {index: sum(span.rows for span in spans) for index, spans in open_.items()}
        part = _cells_of(df, columns, open_, dtype)
        if sum(held.values()) <= direct_rows:
            counted = part.groupBy("id", "value").agg(F.count(F.lit(1)).alias("rows")).collect()
            for index, spans in open_.items():
                listed = sorted((row["value"], row["rows"]) for row in counted if row["id"] == index)
                for span in spans:
                    _settle(span, listed, found[index])
            break
        sampled = max(SAMPLE_ROWS // 20, min(SAMPLE_ROWS, SAMPLE_VALUES // len(open_)))
        few = _cells_of(df.sample(min(1.0, sampled / max(held.values())), seed=attempt), columns, open_, dtype)
        samples: dict[int, list[float]] = defaultdict(list)
        for row in few.select("id", "value").toArrow().to_pylist():
            samples[row["id"]].append(row["value"])
        pivots = {index: _pivots_among(sorted(samples[index]), spans) for index, spans in open_.items()}
        histograms = _count_columns(part, pivots, dtype)
        narrowed = {}
        for index, spans in open_.items():
            inner = [s for span in spans for s in _narrow(span, pivots[index], histograms[index], found[index])]
            if inner:
                narrowed[index] = inner
        open_ = narrowed
        attempt += 1
    return found


def _cells_of(
    df: DataFrame, columns: Sequence[Column], open_: Mapping[int, Sequence[_Span]], dtype: T.DataType
) -> DataFrame:
    """(id, value) for the open columns' values inside their spans."""
    cells = F.array(
        *(
            F.struct(
                F.lit(index).alias("id"),
                F.when(any_of([_within(columns[index], span, dtype) for span in spans]), columns[index]).alias("value"),
            )
            for index, spans in open_.items()
        )
    )
    return df.select(F.explode(cells).alias("cell")).select("cell.*").filter("value IS NOT NULL")


def _count_columns(
    part: DataFrame, pivots: Mapping[int, Sequence[float]], dtype: T.DataType
) -> dict[int, dict[int, int]]:
    """`_count_between` for all columns, each with its own pivots, in one aggregate."""
    listed = ", ".join(
        f"{index}, array({', '.join(sql_literal(pivot, dtype) for pivot in values)})" for index, values in pivots.items()
    )
    own = part.withColumn("pivots", F.expr(f"map({listed})[id]"))
    below = F.size(F.filter("pivots", lambda pivot: pivot < F.col("value")))
    cell = 2 * below + F.array_contains("pivots", F.col("value")).cast("int")
    counted = own.select("id", cell.alias("cell")).groupBy("id", "cell").agg(F.count(F.lit(1)).alias("rows"))
    histograms: dict[int, dict[int, int]] = defaultdict(dict)
    for row in counted.collect():
        histograms[row["id"]][row["cell"]] = row["rows"]
    return histograms


def cuts_at_ranks(
    df: DataFrame,
    keys: Sequence[str],
    ranks: Sequence[int],
    rows: int,
    direct_rows: int = DIRECT_ROWS,
) -> dict[int, Cut]:
    """For each 1-based rank, the cut covering exactly that many rows ordered by `keys`."""
    key, *rest = keys
    spots = spots_at_ranks(df, key, ranks, rows, direct_rows)
    cuts: dict[int, Cut] = {}
    inside_ties: dict[Any, list[int]] = defaultdict(list)
    for rank, spot in spots.items():
        if rank == spot.before + spot.equal:
            cuts[rank] = Cut((spot.value,))
        else:
            inside_ties[spot.value].append(rank)
    if inside_ties and not rest:
        raise ValueError(f"rows share all sort keys {list(keys)}; add a column that differs")
    few = direct_rows // max(1, len(inside_ties))
    listed = {v: tied for v, tied in inside_ties.items() if spots[tied[0]].equal <= few}
    cuts |= _cuts_in_short_ties(df, keys, listed, spots)
    for value, tied in inside_ties.items():
        if value not in listed:
            spot = spots[tied[0]]
            ties = df.filter(quoted(key) == literal(value, field_type(df, key)))
            local = [rank - spot.before for rank in tied]
            inner = cuts_at_ranks(ties, rest, local, spot.equal, direct_rows)
            for rank in tied:
                cuts[rank] = Cut((value, *inner[rank - spot.before].values))
    return cuts


def _cuts_in_short_ties(
    df: DataFrame,
    keys: Sequence[str],
    tied: Mapping[Any, Sequence[int]],
    spots: Mapping[int, Spot],
) -> dict[int, Cut]:
    """Cuts within values shared by few rows, all from one job."""
    if not tied:
        return {}
    types = [field_type(df, name) for name in keys]
    sort_keys = [
        _to_driver(quoted(name), dtype).alias(f"k{index}")
        for index, (name, dtype) in enumerate(zip(keys, types, strict=True))
    ]
    names = [f"k{index}" for index in range(len(keys))]
    rows = df.filter(quoted(keys[0]).isin([literal(value, types[0]) for value in tied]))
    counted = rows.select(*sort_keys).groupBy(*names).agg(F.count(F.lit(1)).alias("rows"))
    ordered: dict[Any, list[tuple[tuple[Any, ...], int]]] = defaultdict(list)
    for row in sorted(tuple(row) for row in counted.collect()):
        ordered[row[0]].append((row[:-1], row[-1]))
    cuts = {}
    for value, ranks in tied.items():
        seen = spots[ranks[0]].before
        ends = {}
        for values, count in ordered[value]:
            seen += count
            ends[seen] = values
        for rank in ranks:
            if rank not in ends:
                raise ValueError(
                    f"rows share all sort keys {list(keys)}; add a column that differs"
                )
            cuts[rank] = Cut(ends[rank])
    return cuts


def segment(df: DataFrame, keys: Sequence[str], cuts: Sequence[Cut]) -> Column:
    """How many of the ascending cuts lie before the row."""
    covers = [cut.covers(df, keys) for cut in cuts]

    def search(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(covers[middle], search(low, middle)).otherwise(search(middle + 1, high))

    return search(0, len(covers))


def _within(value: Column, span: _Span, dtype: T.DataType) -> Column:
    condition = F.lit(True)
    if span.low is not None:
        condition = condition & (value > literal(span.low, dtype))
    if span.high is not None:
        condition = condition & (value < literal(span.high, dtype))
    return condition


def _count_values(part: DataFrame, dtype: T.DataType) -> list[tuple[Any, int]]:
    counted = part.groupBy("value").agg(F.count(F.lit(1)).alias("rows"))
    rows = counted.select(_to_driver(F.col("value"), dtype), "rows").collect()
    return sorted((row[0], row[1]) for row in rows)


def _settle(span: _Span, counted: list[tuple[Any, int]], found: dict[int, Spot]) -> None:
    seen = span.before
    wanted = list(span.ranks)
    for value, count in counted:
        if (span.low is not None and value <= span.low) or (
            span.high is not None and value >= span.high
        ):
            continue
        while wanted and wanted[0] <= seen + count:
            found[wanted.pop(0)] = Spot(value, seen, count)
        seen += count


def _choose_pivots(
    part: DataFrame, dtype: T.DataType, spans: Sequence[_Span], total: int, attempt: int
) -> list[Any]:
    """Sampled values close to where the wanted ranks should lie, and the span bounds.

    A rank outside the looked-at neighbourhood only costs a further round.
    """
    fraction = min(1.0, SAMPLE_ROWS / total)
    drawn = part.sample(fraction, seed=attempt).select(_to_driver(F.col("value"), dtype))
    return _pivots_among(sorted(row[0] for row in drawn.collect()), spans)


def _pivots_among(sample: Sequence[Any], spans: Sequence[_Span]) -> list[Any]:
    each = max(3, MAX_PIVOTS // sum(len(span.ranks) for span in spans))
    chosen = {bound for span in spans for bound in (span.low, span.high) if bound is not None}
    for span in spans:
        first = 0 if span.low is None else bisect_right(sample, span.low)
        last = len(sample) if span.high is None else bisect_left(sample, span.high)
        inner = sample[first:last]
        for rank in span.ranks:
            chosen.update(_around(inner, (rank - span.before - 0.5) / span.rows, each))
    return sorted(chosen)


def _around(sample: Sequence[Any], share: float, count: int) -> list[Any]:
    """Elements spread over three standard deviations around a share of a sorted sample."""
    size = len(sample)
    reach = 3 * math.sqrt(size * share * (1 - share)) + 1
    step = 2 * reach / (count - 1)
    places = (round(share * size - reach + index * step) for index in range(count))
    return [sample[min(max(place, 0), size - 1)] for place in places] if size else []


def _count_between(part: DataFrame, pivots: Sequence[Any], dtype: T.DataType) -> dict[int, int]:
    """Rows per cell: cell 2i lies before pivot i, cell 2i+1 equals it."""

    def search(low: int, high: int) -> str:
        if low == high:
            return str(2 * low)
        middle = (low + high) // 2
        pivot = sql_literal(pivots[middle], dtype)
        return (
            f"CASE WHEN value < {pivot} THEN {search(low, middle)} "
            f"WHEN value = {pivot} THEN {2 * middle + 1} "
            f"ELSE {search(middle + 1, high)} END"
        )

    cell = F.expr(search(0, len(pivots))).alias("cell")
    cells = part.groupBy(cell).agg(F.count(F.lit(1)).alias("rows"))
    return {row["cell"]: row["rows"] for row in cells.collect()}


def _narrow(
    span: _Span, pivots: Sequence[Any], histogram: Mapping[int, int], found: dict[int, Spot]
) -> list[_Span]:
    first = 0 if span.low is None else 2 * pivots.index(span.low) + 2
    last = 2 * len(pivots) if span.high is None else 2 * pivots.index(span.high)
    seen = span.before
    inner = []
    for cell in range(first, last + 1):
        count = histogram.get(cell, 0)
        ranks = tuple(rank for rank in span.ranks if seen < rank <= seen + count)
        if ranks and cell % 2:
            for rank in ranks:
                found[rank] = Spot(pivots[cell // 2], seen, count)
        elif ranks:
            low = pivots[cell // 2 - 1] if cell else None
            high = pivots[cell // 2] if cell < 2 * len(pivots) else None
            inner.append(_Span(low, high, seen, count, ranks))
        seen += count
    return inner


def hash_cuts(
    df: DataFrame, group: str, ranks: Mapping[Any, Sequence[int]], sizes: Mapping[Any, int]
) -> dict[Any, list[str]]:
    """Per group, thresholds on `HASH` covering exactly the given numbers of rows.

    The hash is spread evenly over hexadecimal text, so its prefixes serve as pivots and
    no sample is needed. A row is covered when its hash sorts before the threshold.
    """
    thresholds: dict[tuple[Any, int], str] = {}
    active: dict[tuple[Any, str], list[tuple[int, int]]] = defaultdict(list)
    rows = sum(sizes.values())
    for name, wanted in ranks.items():
        for rank in set(wanted):
            if rank <= 0:
                thresholds[name, rank] = ""
            elif rank >= sizes[name]:
                thresholds[name, rank] = "g"
            else:
                active[name, ""].append((rank, rank))
    length = 0
    while active:
        if length >= 32:
            raise ValueError("rows share a row key; id columns must identify each row")
        room = min(HASH_CELLS, max(FEW_CELLS, rows // 16))
        digits = next((d for d in (4, 3, 2) if len(active) * 16**d <= room), 1)
        deeper: dict[tuple[Any, str], list[tuple[int, int]]] = defaultdict(list)
        rows = 0
        # So many places a pass that its cells stay within the bound, however many there are.
        batch = max(1, HASH_CELLS // 16**digits)
        for chosen in itertools.batched(active, batch):
            cells = _count_prefixes(
                df, group, chosen, length, length + digits, whole=len(active) <= batch
            )
            for place in chosen:
                name = place[0]
                for prefix, before, count in cells[place]:
                    for rank, local in active[place]:
                        if local == before + count:
                            thresholds[name, rank] = prefix + "g"
                        elif before < local < before + count:
                            rows += 0 if (name, prefix) in deeper else count
                            deeper[name, prefix].append((rank, local - before))
        length += digits
        active = deeper
    return {name: [thresholds[name, rank] for rank in wanted] for name, wanted in ranks.items()}


def _count_prefixes(
    df: DataFrame,
    group: str,
    active: Collection[tuple[Any, str]],
    length: int,
    longer: int,
    whole: bool = True,
) -> dict[tuple[Any, str], list[tuple[str, int, int]]]:
    """Rows per longer prefix below every active place, in order, with the rows before."""
    part = df.select(quoted(group).alias("name"), F.substring(HASH, 1, longer).alias("prefix"))
    if length or not whole:
        part = _at_places(part.withColumn("place", F.substring("prefix", 1, length)), active)
    counted = part.groupBy("name", "prefix").agg(F.count(F.lit(1)).alias("rows"))
    cells: dict[tuple[Any, str], list[tuple[str, int, int]]] = defaultdict(list)
    seen: dict[tuple[Any, str], int] = defaultdict(int)
    for row in sorted(counted.toArrow().to_pylist(), key=lambda row: row["prefix"]):
        place = (row["name"], row["prefix"][:length])
        cells[place].append((row["prefix"], seen[place], row["rows"]))
        seen[place] += row["rows"]
    return cells


def _at_places(part: DataFrame, places: Collection[tuple[Any, str]]) -> DataFrame:
    """Rows whose name and prefix are among the wanted ones: one per class and cut."""
    name, place = part.schema["name"], T.StructField("place", T.StringType())
    if len(places) > FEW_PLACES:
        table = part.sparkSession.createDataFrame(list(places), T.StructType([name, place]))
        return part.join(F.broadcast(table), ["name", "place"], "left_semi")
    prefixes: dict[Any, list[str]] = defaultdict(list)
    for group, prefix in places:
        prefixes[group].append(prefix)
    return part.filter(
        any_of(
            [
                (F.col("name") == literal(group, name.dataType)) & F.col("place").isin(wanted)
                for group, wanted in prefixes.items()
            ]
        )
    )


def hash_segment(df: DataFrame, group: str, thresholds: Mapping[Any, Sequence[str]], out: str):
    """Add, per row, how many of its group's thresholds its hash has passed."""
    if len(thresholds) == 1:
        (bounds,) = thresholds.values()
        passed = sum((F.col(HASH) >= F.lit(bound)).cast("int") for bound in bounds)
        return df.withColumn(out, passed)
    schema = T.StructType(
        [_field(df, group), T.StructField("__bounds", T.ArrayType(T.StringType()))]
    )
    table = df.sparkSession.createDataFrame(
        [(name, list(bounds)) for name, bounds in thresholds.items()], schema
    ).withColumnRenamed("name", group)
    passed = F.size(F.filter("__bounds", lambda bound: F.col(HASH) >= bound))
    # One row per class, and the caller has bounded the classes.
    return df.join(F.broadcast(table), group).withColumn(out, passed).drop("__bounds")


def _field(df: DataFrame, group: str) -> T.StructField:
    return T.StructField("name", field_type(df, group))
