"""Hold-out splits and cross-validation folds.

Every assignment is a pure function of the rows, the row key and the seed: it does not
depend on partitioning and can be rebuilt later. Rows are never moved to split them.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.functions.columns import field_type, quoted, row_key, split_hash
from tabloom.operators.position import HASH, cuts_at_ranks, hash_cuts, hash_segment, segment
from tabloom.operators.quotas import class_quotas, class_starts, hash_bounds, pass_bounds
from tabloom.sources.work import WorkArea
from tabloom.spec import CLASSIFICATION, TEMPORAL, TableSpec

IS_TEST = "is_test"
FOLD = "fold"
ROW_KEY = "__row_key"
EVERYTHING = "__all"

# Quotas of so many classes are kept on the driver and rows marked by a projection; those of more
# classes are a table, joined.
FEW_CLASSES = 1000


@dataclass(frozen=True)
class Classes:
    """Rows per class: a dictionary in label order if there are few, else only a table."""

    table: DataFrame
    rows: int
    count: int
    least: int
    most: int
    few: dict[Any, int] | None


def count_classes(df: DataFrame, target: str, few: int | None = None) -> Classes:
    """Count the rows of every class; `HASH`, if there, must be present in all of them."""
    few = FEW_CLASSES if few is None else few
    nameless = F.count_if(F.col(HASH).isNull()) if HASH in df.columns else F.lit(0)
    counted = df.groupBy(quoted(target).alias("label")).agg(
        F.count(F.lit(1)).alias("rows"), nameless.alias("nameless")
    )
    found = counted.limit(few + 1).collect()
    if len(found) <= few:
        lost = sum(row["nameless"] for row in found)
        unlabelled = sum(row["rows"] for row in found if row["label"] is None)
        _refuse(lost, unlabelled, target)
        sizes = dict(sorted((row["label"], row["rows"]) for row in found))
        table = df.sparkSession.createDataFrame(list(sizes.items()), _class_schema(df, target))
        bounds = min(sizes.values(), default=0), max(sizes.values(), default=0)
        return Classes(table, sum(sizes.values()), len(sizes), *bounds, sizes)
    table = WorkArea.until_exit(df.sparkSession, "classes").table(counted, "classes")
    rows, count, least, most, lost, unlabelled = table.agg(
        F.sum("rows"), F.count(F.lit(1)), F.min("rows"), F.max("rows"), F.sum("nameless"),
        F.coalesce(F.sum(F.when(F.col("label").isNull(), F.col("rows"))), F.lit(0)),
    ).first()
    _refuse(lost, unlabelled, target)
    return Classes(table.drop("nameless"), rows, count, least, most, None)


def _class_schema(df: DataFrame, target: str) -> T.StructType:
    label = T.StructField("label", field_type(df, target))
    return T.StructType([label, T.StructField("rows", T.LongType())])


def _refuse(nameless: int, unlabelled: int, target: str) -> None:
    if nameless:
        raise ValueError(f"{nameless} rows have no row key: a column of id_cols is empty there")
    if unlabelled:
        raise ValueError(f"{unlabelled} rows have no class in {target!r}, so they cannot be stratified")


def held_out_rows(rows: int, test_size: float) -> int:
    """Rows to hold out, rounded up; both halves must keep at least one."""
    test = math.ceil(rows * test_size)
    if not 0 < test < rows:
        raise ValueError(f"no hold-out of {rows} rows is possible with test_size={test_size}")
    return test


def stratified_quota(sizes: Mapping[Any, int], draws: int) -> dict[Any, int]:
    """Share `draws` over the classes in proportion, by largest remainder, ties to the lesser label."""
    total = sum(sizes.values())
    exact = {label: size / total * draws for label, size in sizes.items()}
    quota = {label: math.floor(value) for label, value in exact.items()}
    by_remainder = sorted(exact, key=lambda label: quota[label] - exact[label])
    for label in by_remainder[: draws - sum(quota.values())]:
        quota[label] += 1
    return quota


def hold_out(df: DataFrame, spec: TableSpec, key: Column | None = None) -> DataFrame:
    """Add `is_test`: the last rows in order, or an exact (stratified) random share."""
    if spec.split_strategy == TEMPORAL:
        return hold_out_latest(df, spec.test_size, spec.order_by, spec.id_cols)
    key = row_key(df, spec.id_cols) if key is None else key
    target = spec.target if spec.task == CLASSIFICATION else None
    return hold_out_random(df, spec.test_size, spec.seed, key, target)


def hold_out_random(
    df: DataFrame, test_size: float, seed: int, key: Column, stratify: str | None = None
) -> DataFrame:
    _check_free(df, IS_TEST)
    hashed, group = _hashed(df, key, seed, stratify)
    classes = count_classes(hashed, group)
    rows = classes.rows
    test = held_out_rows(rows, test_size)
    if stratify is not None:
        _check_strata(classes, rows - test, test)
    if classes.few is None:
        area = WorkArea.until_exit(df.sparkSession, "split")
        wanted = class_quotas(classes.table, rows - test, rows).withColumn(
            "ranks", F.array(F.col("rows") - F.col("quota"))
        )
        marked = _marked_by_table(hashed, group, wanted, IS_TEST, area)
    else:
        sizes = classes.few
        train = stratified_quota(sizes, rows - test)
        ranks = {label: [size - train[label]] for label, size in sizes.items()}
        marked = hash_segment(hashed, group, hash_cuts(hashed, group, ranks, sizes), IS_TEST)
    return marked.select(*map(quoted, df.columns), (F.col(IS_TEST) == 0).alias(IS_TEST))


def _marked_by_table(
    hashed: DataFrame, group: str, wanted: DataFrame, out: str, area: WorkArea
) -> DataFrame:
    """Mark rows by thresholds kept as a table with a row per class."""
    rows = hashed.select(quoted(group).alias("label"), HASH)
    bounds = hash_bounds(rows, wanted.select("label", "rows", "ranks"), area)
    return pass_bounds(hashed, quoted(group), bounds, out, area)


def _check_strata(classes: Classes, train: int, test: int) -> None:
    if classes.least < 2:
        small = [row["label"] for row in classes.table.filter("rows < 2").limit(10).collect()]
        raise ValueError(f"classes with a single row cannot be stratified: {small}")
    if min(train, test) < classes.count:
        raise ValueError(
            f"{train} training and {test} test rows cannot both cover {classes.count} classes"
        )


def hold_out_latest(
    df: DataFrame, test_size: float, order_by: Sequence[str], id_cols: Sequence[str] = ()
) -> DataFrame:
    """Hold out the last rows in order, so training never sees the future."""
    _check_free(df, IS_TEST)
    ordered, keys = _ordered(df, order_by, id_cols)
    rows = _count_ordered(ordered, keys)
    boundary = rows - held_out_rows(rows, test_size)
    cut = cuts_at_ranks(ordered.select(*keys), keys, [boundary], rows)[boundary]
    marked = ordered.withColumn(IS_TEST, ~cut.covers(ordered, keys))
    return marked.select(*map(quoted, df.columns), IS_TEST)


def k_folds(df: DataFrame, folds: int, seed: int, key: Column, repeat: int = 0) -> DataFrame:
    """Add `fold`: equal random parts, the first `rows % folds` of them one larger."""
    hashed, group = _hashed(df, key, f"{seed}:{repeat}", None)
    return _assign_folds(df, hashed, group, count_classes(hashed, group), folds)


def stratified_k_folds(
    df: DataFrame, folds: int, seed: int, key: Column, target: str, repeat: int = 0
) -> DataFrame:
    """Add `fold`: random parts that keep the class shares."""
    hashed, group = _hashed(df, key, f"{seed}:{repeat}", target)
    classes = count_classes(hashed, group)
    if classes.most < folds:
        raise ValueError(f"every class has fewer than {folds} rows, one per fold")
    return _assign_folds(df, hashed, group, classes, folds)


def _assign_folds(
    df: DataFrame, hashed: DataFrame, group: str, classes: Classes, folds: int
) -> DataFrame:
    _check_free(df, FOLD)
    if not 2 <= folds <= classes.rows:
        raise ValueError(f"cannot make {folds} folds of {classes.rows} rows")
    if classes.few is None:
        area = WorkArea.until_exit(df.sparkSession, "folds")
        wanted = class_starts(classes.table, area).withColumn("ranks", _fold_end_column(folds))
        assigned = _marked_by_table(hashed, group, wanted, FOLD, area)
    else:
        ranks, start = {}, 0
        for label, size in classes.few.items():
            ranks[label] = _fold_ends(start, size, folds)
            start += size
        cuts = hash_cuts(hashed, group, ranks, classes.few)
        assigned = hash_segment(hashed, group, cuts, FOLD)
    return assigned.select(*map(quoted, df.columns), F.col(FOLD).cast("int").alias(FOLD))


def _fold_end_column(folds: int) -> Column:
    """`_fold_ends` of the columns start and rows: positions dealt to the folds up to each."""

    def dealt(before: str, last: int) -> str:
        return f"({before}) div {folds} * {last + 1} + least(({before}) % {folds}, {last + 1})"

    ends = (F.expr(f"{dealt('start + rows', k)} - ({dealt('start', k)})") for k in range(folds - 1))
    return F.array(*ends)


def _fold_ends(start: int, size: int, folds: int) -> list[int]:
    """Last rank of every fold but the last, in a class at positions [start, start + size).

    Dealing those positions round-robin fixes each fold's share, which keeps both the
    folds and each class within one row of even.
    """
    ends, taken = [], 0
    for fold in range(folds - 1):
        first = (fold - start) % folds
        taken += max(0, -(-(size - first) // folds))
        ends.append(taken)
    return ends


def rolling_origin(
    df: DataFrame, folds: int, order_by: Sequence[str], id_cols: Sequence[str] = ()
) -> DataFrame:
    """Add `fold`: -1 for rows only trained on, else the fold that tests the row.

    Fold `i` trains on every row with a smaller number, so never on the future.
    """
    _check_free(df, FOLD)
    ordered, keys = _ordered(df, order_by, id_cols)
    rows = _count_ordered(ordered, keys)
    block = rows // (folds + 1)
    if folds < 2 or block < 1:
        raise ValueError(f"cannot make {folds} rolling folds of {rows} rows")
    starts = [rows - (folds - fold) * block for fold in range(folds)]
    cuts = cuts_at_ranks(ordered.select(*keys), keys, starts, rows)
    fold = segment(ordered, keys, [cuts[start] for start in starts]) - 1
    return ordered.withColumn(FOLD, fold.cast("int")).select(*map(quoted, df.columns), FOLD)


def _check_free(df: DataFrame, name: str) -> None:
    if name in df.columns:
        raise ValueError(f"the table already has a column {name!r}; rename it before splitting")


def _hashed(
    df: DataFrame, key: Column, seed: int | str, group: str | None
) -> tuple[DataFrame, str]:
    hashed = df.withColumn(HASH, split_hash(key, seed))
    if group is None:
        return hashed.withColumn(EVERYTHING, F.lit(0)), EVERYTHING
    return hashed, group


def _ordered(
    df: DataFrame, order_by: Sequence[str], id_cols: Sequence[str]
) -> tuple[DataFrame, list[str]]:
    """The table with its full sort key: order columns, then whatever identifies a row."""
    if not order_by:
        raise ValueError("an ordered split needs order_by columns")
    keys = list(dict.fromkeys([*order_by, *id_cols]))
    if id_cols:
        return df, keys
    if ROW_KEY in df.columns:
        return df, [*keys, ROW_KEY]
    return df.withColumn(HASH, row_key(df)), [*keys, HASH]


def _count_ordered(df: DataFrame, keys: Sequence[str]) -> int:
    """Rows of the table; every sort key must have a value, or a row has no side to be on."""
    unplaced = [F.count_if(quoted(name).isNull()) for name in keys]
    rows, *empty = df.agg(F.count(F.lit(1)), *unplaced).first()
    lacking = {name: count for name, count in zip(keys, empty, strict=True) if count}
    if lacking:
        raise ValueError(f"rows without a value in the columns that order or identify them: {lacking}")
    return rows
