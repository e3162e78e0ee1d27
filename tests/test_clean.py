from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tabloom import ValueRange
from tabloom.operators import clean

from tests.conftest import frame

INF = float("inf")


def values(df, column):
    return sorted(row[column] for row in df.collect())


def test_every_missing_column_is_named(spark):
    table = frame(spark, {"a": [1]}, "a int")
    with pytest.raises(ValueError, match=r"\['b', 'c'\]"):
        clean.validate_columns(table, ["a", "b", "c"])
    clean.validate_columns(table, ["a"])


def test_labels_are_replaced_and_missing_ones_stay(spark):
    table = frame(spark, {"y": ["no", "yes", None]}, "y string")
    found = clean.encode_target(table, "y", {"no": 0, "yes": 1}).collect()
    assert [row["y"] for row in found] == [0, 1, None]


def test_an_empty_mapping_changes_nothing(spark):
    table = frame(spark, {"y": ["no"]}, "y string")
    assert clean.encode_target(table, "y", {}) is table


def test_labels_without_a_code_are_counted_and_tabled(spark):
    table = spark.range(900).select(F.concat(F.lit("l"), F.col("id") % 301).alias("y"))
    with pytest.raises(ValueError, match="300 labels of 'y', in 897 rows.*'l1'"):
        clean.encode_target(table, "y", {"l0": 0})
    counted = [r["rows"] for r in clean.unmapped_labels(table, "y", {"l0": 0}).collect()]
    assert len(counted) == 300 and sum(counted) == 897


def test_text_keys_do_not_match_numbers(spark):
    table = frame(spark, {"y": [1, 2]}, "y int")
    with pytest.raises(ValueError, match="2 labels"):
        clean.encode_target(table, "y", {"1": 0, "2": 1})
    found = clean.encode_target(table, "y", {1: 0, 2: 1})
    assert values(found, "y") == [0, 1]


def test_whole_numbers_match_floating_and_boolean_labels(spark):
    floating = frame(spark, {"y": [1.0, 2.5]}, "y double")
    assert values(clean.encode_target(floating, "y", {1: 0, 2.5: 1}), "y") == [0, 1]
    flags = frame(spark, {"y": [True, False]}, "y boolean")
    assert values(clean.encode_target(flags, "y", {1: 7, 0: 3}), "y") == [3, 7]


@pytest.mark.parametrize("seed", range(4))
def test_a_row_counts_once_however_often_it_stands_there(spark, seed):
    """Barrels drawn with repeats; some columns are not modelled, yet tell barrels apart."""
    pick = random.Random(seed)
    barrels = [
        (pick.choice([None, 0.5, 2.25]), pick.choice(["oak", None]), pick.choice([10, 11]), pick.randrange(2))
        for _ in range(40)
    ]
    table = spark.createDataFrame(barrels, "litres double, wood string, cellar int, leaks int").repartition(3)
    whole = clean.clean_dataset(table, ["litres", "wood", "cellar"], "leaks")
    assert sorted(map(str, map(tuple, whole.collect()))) == sorted(map(str, set(barrels)))
    narrow = clean.clean_dataset(table, ["wood"], "leaks")
    assert narrow.columns == ["wood", "leaks"]
    assert sorted(str(tuple(r)) for r in narrow.collect()) == sorted(str((b[1], b[3])) for b in set(barrels))


def test_nan_counts_as_missing(spark):
    table = frame(spark, {"age": [float("nan"), None, 3.0], "y": [0.0, 0.0, float("nan")]},
                  "age double, y double")
    cleaned = clean.clean_dataset(table, ["age"], "y", {"age": ValueRange(0, 5)}).collect()
    assert [tuple(row) for row in cleaned] == [(None, 0.0)]
    kept = clean.drop_invalid_values(table, {"age": ValueRange(0, 5)})
    assert kept.count() == 3
    assert clean.drop_missing_target(table, "y").count() == 2


@pytest.mark.parametrize("low, high", [(None, None), (-3, None), (None, 8), (-3, 8), (2.5, 2.5), (9, 1)])
def test_bounds_are_inclusive_and_skip_missing_values(spark, low, high):
    depths = [*range(-6, 12), 2.5, None]
    table = frame(spark, {"depth": [None if d is None else float(d) for d in depths]}, "depth double")
    kept = clean.drop_invalid_values(table, {"depth": ValueRange(low, high)} if low != high or low else {})
    lower, upper = (-INF if low is None else low), (INF if high is None else high)
    expected = [d for d in depths if d is None or lower <= d <= upper]
    assert [r["depth"] for r in kept.collect()] == [None if d is None else float(d) for d in expected]


def test_infinite_rows_are_dropped_whatever_the_column(spark):
    table = frame(spark, {"a": [1.0, INF, 2.0], "b": [-INF, 0.0, 1.0]}, "a double, b float")
    assert values(clean.drop_invalid_values(table, {}), "a") == [2.0]


def test_bounds_on_text_or_absent_columns_are_ignored(spark):
    table = frame(spark, {"a": ["x", "y"]}, "a string")
    ranges = {"a": ValueRange(0, 1), "gone": ValueRange(0, 1)}
    assert clean.drop_invalid_values(table, ranges).count() == 2


def test_infinity_outside_the_modelling_columns_does_not_matter(spark):
    table = frame(spark, {"a": [1.0, 2.0], "y": [0, 1], "other": [INF, 0.0]},
                  "a double, y int, other double")
    assert clean.clean_dataset(table, ["a"], "y").count() == 2


def test_filters_reach_below_the_deduplication(spark, tmp_path):
    path = str(tmp_path / "t")
    frame(spark, {"a": [1, 2], "y": [0, 1]}, "a int, y int").write.parquet(path)
    table = spark.read.parquet(path)
    cleaned = clean.clean_dataset(table, ["a"], "y", {"a": ValueRange(0, 5)})
    plan = cleaned._jdf.queryExecution().executedPlan().toString()
    assert "IsNotNull(y)" in plan
    assert plan.rindex("Filter") > plan.index("Aggregate")


# --- long label mappings --------------------------------------------------------------


@pytest.mark.parametrize("cast", ["string", "int", "double"])
def test_a_mapping_of_five_thousand_labels_is_a_table(spark, cast):
    table = spark.range(10_000).select("id", (F.col("id") % 5000 * 3).cast(cast).alias("y"))
    label = {"string": str, "int": int, "double": float}[cast]
    mapping = {(f"{3 * k}" if cast == "string" else label(3 * k)): k + 1 for k in range(5000)}
    coded = clean.encode_target(table, "y", mapping)
    assert coded.columns == ["id", "y"] and coded.schema["y"].dataType.simpleString() == "bigint"
    assert coded.filter(F.col("y") != F.col("id") % 5000 + 1).count() == 0
    plan = coded._jdf.queryExecution().analyzed().toString()
    assert "map(" not in plan and len(plan) < 5000
    gone = mapping.copy()
    del gone["6" if cast == "string" else label(6)]
    assert [r["rows"] for r in clean.unmapped_labels(table, "y", gone).collect()] == [2]
    with pytest.raises(ValueError, match="1 labels of 'y', in 2 rows"):
        clean.encode_target(table, "y", gone)
    gaps = table.withColumn("y", F.when(F.col("id") > 7, F.col("y")))
    assert clean.encode_target(gaps, "y", mapping).filter("y IS NULL").count() == 8
