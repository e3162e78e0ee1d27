from __future__ import annotations

import datetime as dt
import decimal

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tabloom import TableSpec
from tabloom.functions.columns import row_key
from tabloom.operators import lookup, position, quotas, scan, split

from tests.conftest import fixed_tasks, frame, rows_by_task


def rows_table(spark, rows, positives=0):
    table = spark.range(rows).withColumnRenamed("id", "k")
    return table.withColumn("y", (F.col("k") < positives).cast("int"))


def key(df):
    return row_key(df, ["k"])


def held(df):
    return sorted(row["k"] for row in df.filter("is_test").collect())


@pytest.mark.parametrize("rows", [2, 7, 64, 101])
@pytest.mark.parametrize("size", [0.07, 1 / 3, 0.5])
def test_the_held_out_count_is_rounded_up(spark, rows, size):
    table = rows_table(spark, rows)
    test = next(n for n in range(rows + 1) if n >= rows * size)
    assert len(held(split.hold_out_random(table, size, 42, key(table)))) == test
    assert held(split.hold_out_latest(table, size, ["k"])) == list(range(rows - test, rows))


def test_no_half_may_be_empty(spark):
    table = rows_table(spark, 8)
    for hold_out in (
        lambda size: split.hold_out_latest(table, size, ["k"]),
        lambda size: split.hold_out_random(table, size, 42, key(table)),
    ):
        assert len(held(hold_out(0.87))) == 7
        with pytest.raises(ValueError, match="no hold-out of 8 rows"):
            hold_out(0.88)


@pytest.mark.parametrize("positives", [13, 50, 97])
def test_class_shares_are_kept(spark, positives):
    """Each class gives its share of the 39 held-out rows, within one row."""
    table = rows_table(spark, 130, positives)
    marked = split.hold_out_random(table, 0.3, 42, key(table), "y").filter("is_test")
    counts = {r["y"]: r["count"] for r in marked.groupBy("y").count().collect()}
    assert sum(counts.values()) == 39
    assert abs(counts[1] - positives * 0.3) < 1


def test_strata_too_small_are_refused(spark):
    table = rows_table(spark, 20, 1)
    with pytest.raises(ValueError, match="single row"):
        split.hold_out_random(table, 0.25, 42, key(table), "y")
    many = spark.range(20).select(F.col("id").alias("k"), (F.col("id") % 10).alias("y"))
    with pytest.raises(ValueError, match="10 classes"):
        split.hold_out_random(many, 0.1, 42, key(many), "y")


def test_same_seed_same_split_whatever_the_partitioning(spark):
    table = rows_table(spark, 500, 100)
    first = held(split.hold_out_random(table, 0.2, 42, key(table), "y"))
    for parts in (1, 7):
        moved = table.orderBy(F.rand(1)).repartition(parts)
        assert held(split.hold_out_random(moved, 0.2, 42, key(moved), "y")) == first
    assert held(split.hold_out_random(table, 0.2, 43, key(table), "y")) != first
    assert first != list(range(400, 500))


def test_a_key_that_does_not_identify_rows_is_refused(spark):
    table = rows_table(spark, 10).withColumn("k", F.lit(1))
    with pytest.raises(ValueError, match="identify"):
        split.hold_out_random(table, 0.25, 42, key(table))
    with pytest.raises(ValueError, match="share all sort keys"):
        split.hold_out_latest(table, 0.25, ["k"], ["k"])


def test_without_id_columns_the_whole_row_is_the_key(spark):
    table = spark.range(40).select((F.col("id") % 4).alias("a"), F.col("id").alias("b"))
    spec = TableSpec(target="y", numerical=("b",), task="regression")
    marked = split.hold_out(table, spec)
    assert marked.filter("is_test").count() == 8
    by_a = split.hold_out_latest(table, 0.2, ["a"])
    assert [r["a"] for r in by_a.filter("is_test").collect()] == [3] * 8


def test_a_column_of_the_result_name_is_refused(spark):
    table = rows_table(spark, 40).withColumn("is_test", F.lit(0)).withColumn("fold", F.lit(0))
    for call in (
        lambda: split.hold_out_random(table, 0.2, 42, key(table)),
        lambda: split.hold_out_latest(table, 0.2, ["k"]),
        lambda: split.k_folds(table, 5, 42, key(table)),
        lambda: split.rolling_origin(table, 5, ["k"]),
    ):
        with pytest.raises(ValueError, match="already has a column"):
            call()


@pytest.mark.parametrize("at", [0, 17_999, 41_999, 42_000, 59_999])
def test_a_row_without_id_is_refused_wherever_it_stands(spark, at):
    """All rows share the order value, so only the id can place them."""
    table = spark.range(60_000).select(
        F.lit(1).alias("day"), F.when(F.col("id") != at, F.col("id")).alias("k"), F.lit("x").alias("part")
    )
    for call in (
        lambda: split.hold_out_latest(table, 0.3, ["day"], ["k"]),
        lambda: split.rolling_origin(table, 4, ["day"], ["k"]),
        lambda: split.rolling_origin(table, 4, ["k"]),
    ):
        with pytest.raises(ValueError, match=r"order or identify them: \{'k': 1\}"):
            call()
    for ids in (["k"], ["part", "k"]):
        with pytest.raises(ValueError, match="1 rows have no row key"):
            split.hold_out_random(table, 0.3, 42, row_key(table, ids))
        with pytest.raises(ValueError, match="1 rows have no row key"):
            split.k_folds(table, 4, 42, row_key(table, ids))


def test_ties_in_time_are_cut_by_id(spark):
    table = spark.range(3000).select((F.col("id") % 3).alias("day"), F.col("id").alias("k"))
    marked = split.hold_out_latest(table, 0.45, ["day"], ["k"])
    order = sorted(range(3000), key=lambda i: (i % 3, i))
    assert held(marked) == sorted(order[-1350:])


@pytest.mark.parametrize("cast", ["int", "double", "decimal(12,3)", "string", "date", "timestamp", "timestamp_ntz"])
def test_order_columns_of_any_type(spark, cast):
    if cast in ("date", "timestamp", "timestamp_ntz"):
        at = F.expr(f"cast(timestamp'2020-01-01 00:00:00.25' + make_interval(0, 0, 0, id) as {cast})")
    elif cast == "string":
        at = F.lpad(F.col("id").cast("string"), 5, "0")
    else:
        at = F.col("id").cast(cast)
    table = spark.range(9000).select(at.alias("at"), F.col("id").alias("k"))
    marked = split.hold_out_latest(table, 0.1, ["at"], ["k"])
    assert held(marked) == list(range(8100, 9000))


def fold_sizes(df, *by):
    return df.groupBy("fold", *by).count()


def test_folds_are_even_and_the_first_ones_larger(spark):
    table = rows_table(spark, 103)
    folded = split.k_folds(table, 5, 42, key(table))
    sizes = {r["fold"]: r["count"] for r in fold_sizes(folded).collect()}
    assert sizes == {0: 21, 1: 21, 2: 21, 3: 20, 4: 20}
    assert folded.count() == folded.select("k").distinct().count() == 103


def test_stratified_folds_differ_by_at_most_one(spark):
    table = spark.range(207).select(F.col("id").alias("k"), (F.col("id") % 7 % 3).alias("y"))
    folded = split.stratified_k_folds(table, 5, 42, key(table), "y")
    total = [r["count"] for r in fold_sizes(folded).collect()]
    assert max(total) - min(total) <= 1
    for label in range(3):
        part = [r["count"] for r in fold_sizes(folded.filter(F.col("y") == label)).collect()]
        assert len(part) == 5 and max(part) - min(part) <= 1


def test_repeats_shuffle_anew(spark):
    table = rows_table(spark, 100)
    folds = [
        {r["k"]: r["fold"] for r in split.k_folds(table, 5, 42, key(table), repeat).collect()}
        for repeat in (0, 0, 1)
    ]
    assert folds[0] == folds[1] != folds[2]


def test_many_classes_and_cuts_are_searched_together(spark, monkeypatch):
    table = spark.range(4000).select(F.col("id").alias("k"), (F.col("id") % 40).alias("y"))
    few = split.stratified_k_folds(table, 5, 42, key(table), "y").collect()
    monkeypatch.setattr(position, "FEW_PLACES", 0)
    monkeypatch.setattr(position, "HASH_CELLS", 320)
    many = split.stratified_k_folds(table, 5, 42, key(table), "y").collect()
    assert sorted(few) == sorted(many)
    sizes = {tuple(r) for r in fold_sizes(split.stratified_k_folds(table, 5, 42, key(table), "y"), "y").collect()}
    assert {size for *_, size in sizes} == {20}


def test_impossible_folds_are_refused(spark):
    table = rows_table(spark, 4, 2)
    with pytest.raises(ValueError, match="5 folds"):
        split.k_folds(table, 5, 42, key(table))
    with pytest.raises(ValueError, match="every class"):
        split.stratified_k_folds(table, 3, 42, key(table), "y")
    with pytest.raises(ValueError, match="rolling"):
        split.rolling_origin(table, 4, ["k"])


def test_rolling_folds_never_train_on_the_future(spark):
    folded = split.rolling_origin(rows_table(spark, 50), 5, ["k"]).toPandas()
    assert list(folded.groupby("fold").size()) == [10, 8, 8, 8, 8, 8]
    for fold in range(5):
        train = folded[folded.fold < fold]
        test = folded[folded.fold == fold]
        assert train.k.max() < test.k.min()


# --- cut points -----------------------------------------------------------------------


def test_ranks_in_a_table_too_large_to_list(spark):
    """Hot values, several rounds of pivots, and ranks at both ends."""
    generator = np.random.default_rng(5)
    values = np.where(generator.random(30_000) < 0.35, 0.25, generator.random(30_000).round(4))
    table = spark.createDataFrame([(float(v),) for v in values], "v double").repartition(6)
    ordered = np.sort(values)
    ranks = [1, 2, 777, 7_500, 9_999, 15_000, 15_001, 29_999, 30_000]
    spots = position.spots_at_ranks(table, "v", ranks, len(values), direct_rows=50)
    for rank in ranks:
        spot = spots[rank]
        assert spot.value == ordered[rank - 1]
        assert spot.before == np.searchsorted(ordered, spot.value, "left")
        assert spot.equal == np.searchsorted(ordered, spot.value, "right") - spot.before


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    values=st.lists(st.integers(-5, 5), min_size=5, max_size=60),
    share=st.floats(0.05, 0.9),
    direct=st.sampled_from([1, 3, 1000]),
)
def test_cuts_cover_exactly_their_rank(spark, values, share, direct):
    rows = len(values)
    rank = max(1, int(rows * share))
    table = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "v int, i int")
    cut = position.cuts_at_ranks(table, ["v", "i"], [rank], rows, direct)[rank]
    covered = {r["i"] for r in table.filter(cut.covers(table, ["v", "i"])).collect()}
    expected = sorted(range(rows), key=lambda index: (values[index], index))[:rank]
    assert covered == set(expected)


def test_literals_compare_as_the_column_does(spark):
    moment = dt.datetime(2020, 1, 2, 3, 4, 5, 678901)
    table = frame(
        spark,
        {"n": [moment], "d": [moment.date()], "x": [decimal.Decimal("1.250")], "b": [True]},
        "n timestamp_ntz, d date, x decimal(9,3), b boolean",
    )
    row = table.first()
    same = [
        F.col(name) == position.literal(row[name], table.schema[name].dataType)
        for name in table.columns
    ]
    assert all(table.select(*same).first())


def test_splitting_does_not_move_rows(spark, tmp_path):
    """Marking the held-out rows is a projection: no exchange, no window over rows."""
    path = str(tmp_path / "t")
    rows_table(spark, 1000, 300).write.parquet(path)
    table = spark.read.parquet(path)
    for marked in (
        split.hold_out_random(table, 0.2, 42, key(table)),
        split.hold_out_random(table, 0.2, 42, key(table), "y"),
        split.hold_out_latest(table, 0.2, ["k"]),
        split.k_folds(table, 5, 42, key(table)),
        split.rolling_origin(table, 5, ["k"]),
    ):
        plan = marked._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan
        assert "Exchange hashpartitioning" not in plan and "SinglePartition" not in plan


def test_the_temporal_cut_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(100).select(
        F.expr("timestamp_ntz'2020-01-01 00:00:00' + make_interval(0, 0, 0, id)").alias("at")
    ).write.parquet(path)
    marked = split.hold_out_latest(spark.read.parquet(path), 0.2, ["at"])
    plan = marked.filter("is_test").select("at")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(at), GreaterThan(at,2020-03-20T00:00)]" in plan


# --- classes kept as a table ----------------------------------------------------------


def both_ways(monkeypatch, build):
    """The same split with quotas on the driver and as a table."""
    few = sorted(map(tuple, build().collect()), key=str)
    monkeypatch.setattr(split, "FEW_CLASSES", 0)
    assert sorted(map(tuple, build().collect()), key=str) == few
    return few


@pytest.mark.parametrize("label", ["k % 7", "'c' || k % 37 % 11", "CAST(k % 5 AS DOUBLE) / 3", "k % 2 = 0", "date_add(date'2020-01-01', CAST(k % 9 AS INT))"])
def test_quotas_as_a_table_equal_those_on_the_driver(spark, monkeypatch, label):
    table = spark.range(900).select(F.col("id").alias("k")).withColumn("y", F.expr(label))
    marked = both_ways(monkeypatch, lambda: split.hold_out_random(table, 0.23, 5, key(table), "y"))
    assert sum(row[-1] for row in marked) == 207
    both_ways(monkeypatch, lambda: split.stratified_k_folds(table, 4, 5, key(table), "y", 1))


def test_quotas_of_uneven_classes_with_a_hot_one(spark, monkeypatch):
    hot = F.when(F.col("k") % 3 == 0, F.lit(-1)).otherwise(F.floor(F.sqrt("k") * 4))
    table = spark.range(100, 6100).select(F.col("id").alias("k")).withColumn("y", hot)
    for size in (0.3, 0.41):
        both_ways(monkeypatch, lambda: split.hold_out_random(table, size, 1, key(table), "y"))
    both_ways(monkeypatch, lambda: split.stratified_k_folds(table, 7, 1, key(table), "y"))


def test_more_classes_than_the_driver_used_to_hold(spark):
    """120,000 classes of two or four rows: every class gives one of two, or two of four."""
    table = spark.range(360_000).select(F.col("id").alias("k"))
    table = table.withColumn("y", F.when(F.col("k") < 240_000, F.floor(F.col("k") / 4)).otherwise(F.floor(F.col("k") / 2)))
    marked = split.hold_out_random(table, 0.5, 42, key(table), "y")
    shares = marked.groupBy("y").agg(F.count(F.lit(1)).alias("rows"), F.count_if("is_test").alias("test"))
    assert {tuple(r) for r in shares.groupBy("rows", "test").count().collect()} == {(4, 2, 60_000), (2, 1, 60_000)}
    folds = split.stratified_k_folds(table, 2, 42, key(table), "y").groupBy("y", "fold").count()
    assert {tuple(r) for r in folds.groupBy("count").agg(F.count(F.lit(1))).collect()} == {(2, 120_000), (1, 120_000)}


def test_tables_of_classes_refuse_what_the_driver_refuses(spark, monkeypatch):
    table = rows_table(spark, 20, 1)
    unlabelled = table.withColumn("y", F.when(F.col("k") > 3, F.col("y")))
    same = table.withColumn("k", F.lit(1))
    nameless = table.withColumn("k", F.when(F.col("k") > 3, F.col("k")))
    for few in (1000, 0):
        monkeypatch.setattr(split, "FEW_CLASSES", few)
        with pytest.raises(ValueError, match=r"single row cannot be stratified: \[1\]"):
            split.hold_out_random(table, 0.25, 42, key(table), "y")
        with pytest.raises(ValueError, match="4 rows have no class in 'y'"):
            split.hold_out_random(unlabelled, 0.25, 42, key(unlabelled), "y")
        with pytest.raises(ValueError, match="4 rows have no row key"):
            split.stratified_k_folds(nameless, 2, 42, key(nameless), "y")
        with pytest.raises(ValueError, match="identify"):
            split.stratified_k_folds(same, 3, 42, key(same), "y")


def test_a_large_class_table_is_joined_without_crowding(spark, monkeypatch, area):
    """Beyond the broadcast limit frequent classes are looked up apart from the shuffled join."""
    label = F.when(F.col("id") % 50 > 0, F.floor(F.greatest("id", F.lit(3000)) / 7))
    table = spark.range(8000).select(F.col("id").alias("k"), label.alias("y"))
    hashed = table.withColumn(position.HASH, F.md5(F.col("k").cast("string")))
    bounds = table.select(F.col("y").alias("key")).distinct().filter("key % 5 > 0").withColumn("bounds", F.array(F.lit("5"), F.lit("a")))
    wide = quotas.pass_bounds(hashed, F.col("y"), bounds, "out", area, limit=0)
    near = quotas.pass_bounds(hashed, F.col("y"), bounds, "out", area)
    assert sorted(map(tuple, wide.collect())) == sorted(map(tuple, near.collect()))
    assert "__salt" in wide._jdf.queryExecution().toString()


def test_running_totals_over_levels_of_ranges(spark, area):
    rows = [(i * 37 % 1009, i % 5) for i in range(1009)]
    table = spark.createDataFrame(rows, "k int, n int")
    for per_range in (2000, 100, 7):
        found = scan.running_totals(table, [F.col("k")], {"before": F.col("n"), "place": F.lit(1)}, area, per_range)
        expected, before = [], 0
        for place, (k, n) in enumerate(sorted(rows)):
            expected.append((k, n, before, place))
            before += n
        assert sorted(map(tuple, found.select("k", "n", "before", "place").collect())) == expected


def test_rows_that_need_no_shuffle_are_spread(spark, monkeypatch):
    """Rows of a frequent key and rows without one make no task of their own."""
    monkeypatch.setattr(lookup, "SALTS", 64)
    rare = F.when(F.col("id") % 10 == 0, F.col("id").cast("string"))
    table = spark.range(16_000).select("id", F.when(F.col("id") % 3 == 0, F.lit("usual")).otherwise(rare).alias("k"))
    known = table.select(F.col("k").alias("key")).distinct().filter("key IS NOT NULL").withColumn("n", F.length("key"))
    with fixed_tasks(spark, 16):
        found = lookup.look_up(table, F.col("k"), known, 1, limit=0)
        crowds = rows_by_task(found, "n")
        assert sum(crowds) == 16_000 and max(crowds) < 4_000
    assert found.filter("n <=> length(k)").count() == 16_000


def test_a_pass_over_the_classes_has_tasks_by_its_rows(spark, area, monkeypatch):
    """Neither the number of tasks nor a broadcast lets a task grow with the classes."""
    table = spark.range(6000).select(F.col("id").alias("k"), F.floor(F.col("id") / 4).alias("y"))
    hashed = table.withColumn(position.HASH, F.md5(F.col("k").cast("string")))
    rows = hashed.select(F.col("y").alias("label"), position.HASH)
    sizes = rows.groupBy("label").agg(F.count(F.lit(1)).alias("rows"))
    wanted = sizes.withColumn("ranks", F.array(*(F.lit(rank).cast("long") for rank in (1, 2, 4))))
    monkeypatch.setattr(quotas, "ROWS_PER_TASK", 1000, raising=False)
    kept = {}

    def table_of(df, name):
        kept.setdefault(name, df)
        return type(area).table(area, df, name)

    spied = type("Spied", (), {"table": staticmethod(table_of)})()
    bounds = quotas.hash_bounds(rows, wanted, spied)
    crowds = rows_by_task(kept["cells"], "before")
    assert sum(crowds) == 3000 and max(crowds) < 600
    assert "BroadcastHashJoin" not in kept["cells"]._jdf.queryExecution().executedPlan().toString()
    passed = F.size(F.filter("bounds", lambda bound: F.col(position.HASH) >= bound))
    dealt = hashed.join(bounds, F.col("y") == F.col("key")).groupBy("y", passed.alias("part")).count()
    found = {tuple(r) for r in dealt.groupBy("part", "count").agg(F.count(F.lit(1))).collect()}
    assert found == {(0, 1, 1500), (1, 1, 1500), (2, 2, 1500)}


def test_every_range_of_running_totals_has_its_own_task(spark, area):
    table = spark.range(1009).select((F.col("id") * 37 % 1009).alias("k"))
    found = scan.running_totals(table, [F.col("k")], {"place": F.lit(1)}, area, 100)
    crowds = rows_by_task(found, "place")
    assert sum(crowds) == 1009 and max(crowds) < 200
    assert found.filter("place = k").count() == 1009
