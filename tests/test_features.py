"""Encoding against plain Python over generated tables."""

from __future__ import annotations

import random
import statistics

import duckdb
import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

import __spark_entry__ as catalog
from tabloom import TableSpec
from tabloom.operators import features, group_rate, lookup
from tabloom.operators.pipeline import FEATURES, LABEL, FeatureEncoder, fit_encoder
from tests.conftest import fixed_tasks, rows_by_task
from tests.oracle import connect, duckdb_result, spark_result

SCHEMA = "row int, load double, spin int, site string, unit string, fails int"
ROLES = {"numerical": ("load", "spin"), "categorical": ("site",), "group_keys": ("unit",)}


def machines(seed: int, rows: int, strange: bool = False) -> list[tuple]:
    """Readings of machines with gaps; strange ones come from sites and units not met before."""
    pick = random.Random(seed)
    out = []
    for row in range(rows):
        load = pick.choice([None, float("nan"), 12.5, pick.gauss(30, 8), pick.gauss(30, 8)])
        site = pick.choice([None, "north", "south", "south"] + ["abroad"] * 3 * strange)
        unit = pick.choice([None, "u1", "u2", f"single{row}"] + ["new"] * 3 * strange)
        out.append((row, load, pick.randrange(5), site, unit, pick.randrange(2)))
    return out


def plain_encoding(train, rows, leave_out):
    """The matrix by columns as nested loops; `leave_out`: rows are the training rows themselves."""
    gap = lambda v: v is None or v != v
    columns = []
    for at in (1, 2):
        present = [r[at] for r in train if not gap(r[at])]
        middle = statistics.median(present)
        filled = [middle if gap(r[at]) else r[at] for r in train]
        mean, spread = statistics.fmean(filled), statistics.pstdev(filled)
        columns.append([((middle if gap(r[at]) else r[at]) - mean) / spread for r in rows])
    sites = sorted({r[3] for r in train if r[3]})
    usual = max(sites, key=lambda s: (sum(r[3] == s for r in train), [-ord(c) for c in s]))
    for site in sites:
        columns.append([float((r[3] or usual) == site) for r in rows])

    def rate(r, own):
        labels = [t[5] for t in train if r[4] and t[4] == r[4] and not (own and t[0] == r[0])]
        return statistics.fmean(labels) if labels else None

    seen = [rate(r, True) for r in train]
    middle = statistics.median([v for v in seen if v is not None])
    rates = [rate(r, leave_out) for r in rows]
    columns.append([middle if v is None else v for v in rates])
    columns.append([float(v is not None) for v in rates])
    return np.array(columns).T


def fitted(spark, area, rows, **roles):
    train = spark.createDataFrame(rows, SCHEMA)
    spec = TableSpec(target="fails", model_type="logistic_regression", **(roles or ROLES))
    return fit_encoder(train.withColumn(LABEL, F.col("fails").cast("double")), spec, area)


def cells(df):
    return np.array([r[0] for r in df.select(vector_to_array(FEATURES)).collect()])


def ordered(matrix):
    return np.array(sorted(matrix.round(9).tolist()))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_training_and_new_rows(spark, area, seed, tmp_path):
    train, new = machines(seed, 60), machines(seed + 100, 40, strange=True)
    encoder, matrix = fitted(spark, area, train)
    assert ordered(cells(matrix)) == pytest.approx(ordered(plain_encoding(train, train, True)))
    table = spark.createDataFrame(new, SCHEMA)
    expected = ordered(plain_encoding(train, new, False))
    assert ordered(cells(encoder.transform(table))) == pytest.approx(expected)
    encoder.write().overwrite().save(str(tmp_path / "encoder"))
    again = FeatureEncoder.load(str(tmp_path / "encoder"))
    assert again.feature_names == encoder.feature_names == [
        "numerical__load", "numerical__spin", "categorical__site_north", "categorical__site_south",
        "group:unit__unit", "group:unit__unit_known",
    ]
    assert ordered(cells(again.transform(table))) == pytest.approx(expected)


@pytest.mark.parametrize("value", [0.1, 1 / 3, -7e9, 0.0])
@pytest.mark.parametrize("present, gaps", [(1, 2), (3, 1), (7, 10), (6, 0)])
def test_a_constant_column_is_centred_and_not_scaled(spark, value, present, gaps):
    table = spark.createDataFrame([(value,)] * present + [(None,)] * gaps, "x double")
    (stats,) = features.numeric_stats(table, ["x"])
    assert (stats.median, stats.mean, stats.scale) == (value, value, 1.0)


@pytest.mark.parametrize("counted_values", [0, 10**6])
@pytest.mark.parametrize("rows", [1, 2, 501, 700])
def test_medians_by_count_and_by_rank(spark, rows, counted_values):
    generator = np.random.default_rng(rows)
    values = np.where(generator.random(rows) < 0.3, 7.0, generator.normal(5, 3, rows))
    table = spark.createDataFrame([(float(v),) for v in values], "x double")
    (stats,) = features.numeric_stats(table, ["x"], counted_values)
    assert stats.median == pytest.approx(np.median(values))
    assert stats.scale == pytest.approx(values.std() or 1.0)


def test_flags_and_whole_numbers_are_numbers(spark):
    rows = [(k % 3 == 0, k * k) for k in range(8)]
    flag, square = features.numeric_stats(spark.createDataFrame(rows, "f boolean, n int"), ["f", "n"])
    assert (flag.median, flag.mean) == (0.0, 3 / 8)
    assert square.median == 12.5


def test_categories_of_every_type_keep_their_order(spark):
    rows = [("pear", 20, True, 1.5), ("fig", 3, True, -2.0), ("pear", 20, False, 1.5), ("fig", 3, None, -2.0)]
    table = spark.createDataFrame([*rows, (None,) * 4], "t string, n int, b boolean, x double")
    found = {s.name: (s.fill, s.values) for s in features.category_stats(table, ["t", "n", "b", "x"])}
    # Equally frequent values: the least fills the gaps, numbers compared as numbers.
    assert found == {
        "t": ("fig", ("fig", "pear")),
        "n": ("3", ("3", "20")),
        "b": ("true", ("false", "true")),
        "x": ("-2.0", ("-2.0", "1.5")),
    }


def test_columns_without_any_value_take_no_place(spark, area):
    rows = [(k, None, k, None, f"alone{k}", k % 2) for k in range(6)]
    encoder, matrix = fitted(spark, area, rows)
    assert encoder.feature_names == ["numerical__spin", "group:unit__unit_known"]
    assert cells(matrix)[:, 1].tolist() == [0.0] * 6


def test_features_and_target_part(spark):
    table = spark.createDataFrame(machines(4, 3), SCHEMA)
    left, right = features.split_features_and_target(table, ["spin", "site"], "fails")
    assert (left.columns, right.columns) == (["spin", "site"], ["fails"])


# --- group rates ----------------------------------------------------------------------


def looped(train, rows, leave_out):
    """Rate and flag of every row, summing the other training rows of its group one by one."""
    out = []
    for i, group, _ in rows:
        others = [y for j, g, y in train if group is not None and g == group and not (leave_out and j == i)]
        out.append((sum(others) / len(others) if others else None, float(bool(others))))
    return out


def grouped(spark, rows):
    return spark.createDataFrame(rows, "i int, room string, y int")


def rates_of(df):
    return [(row["rate"], row["known"]) for row in df.orderBy("i").collect()]


@pytest.mark.parametrize("seed", [1, 2])
def test_rates_against_loops(spark, seed):
    pick = random.Random(seed)
    draw = lambda names, n: [(i, pick.choice(names), pick.randrange(2)) for i in range(n)]
    train = draw([None, "r1", "r2", "r3", "r3", *(f"once{k}" for k in range(9))], 50)
    fresh = draw([None, "r1", "r3", "unknown"], 30)
    rates = group_rate.fit_rates(grouped(spark, train), "room", "y")
    own = group_rate.encode_leave_one_out(grouped(spark, train), rates, "y", "rate", "known")
    assert rates_of(own) == [(pytest.approx(r) if r is not None else None, k) for r, k in looped(train, train, True)]
    other = group_rate.encode_rates(grouped(spark, fresh), rates, "rate", "known")
    assert rates_of(other) == [(pytest.approx(r) if r is not None else None, k) for r, k in looped(train, fresh, False)]


@pytest.mark.parametrize("target", [None, "absent"])
def test_rates_need_their_target(spark, target):
    with pytest.raises(ValueError, match="target"):
        group_rate.fit_rates(grouped(spark, [(1, "r", 1)]), "room", target)


@pytest.fixture
def shuffled(spark, monkeypatch):
    monkeypatch.setattr(group_rate, "BROADCAST_BYTES", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def crowd(spark, hot):
    """A third of the rows on one key, a third without any, the rest in groups of a few."""
    return spark.range(6000).select(
        F.col("id").cast("int").alias("i"),
        F.when(F.col("id") % 3 == 0, hot)
        .when(F.col("id") % 3 == 2, F.concat(F.lit("h"), (F.col("id") / 7).cast("int")))
        .alias("room"),
        (F.col("id") % 2).cast("int").alias("y"),
    )


def largest_share(df):
    """Rows of the fullest partition, in means."""
    sizes = [n for n in df.rdd.mapPartitions(lambda p: [sum(1 for _ in p)]).collect()]
    return max(sizes) / (sum(sizes) / len(sizes))


@pytest.mark.parametrize("known", [True, False])
def test_hot_keys_do_not_crowd_the_shuffled_join(spark, request, known):
    """Hot in the scored table is enough: the key need not occur in training at all."""
    train = crowd(spark, "hot") if known else crowd(spark, "hot").filter("i % 3 <> 0")
    rates = group_rate.fit_rates(train, "room", "y")
    rows = crowd(spark, "hot")
    small = rates_of(group_rate.encode_rates(rows, rates, "rate", "known"))
    request.getfixturevalue("shuffled")
    large = group_rate.encode_rates(rows, rates, "rate", "known")
    assert rates_of(large) == small
    assert "SortMergeJoin" in large._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.adaptive.enabled", False)
    try:
        assert largest_share(group_rate.encode_rates(rows, rates, "rate", "known")) < 2
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


# --- vocabularies kept as a table -----------------------------------------------------


def test_a_vocabulary_as_a_table_encodes_as_a_list_does(spark, area, tmp_path):
    train, new = machines(3, 150), machines(4, 90, strange=True)
    spec = TableSpec(target="fails", numerical=("load",), categorical=("spin", "site"), group_keys=("unit",))
    frames = [spark.createDataFrame(rows, SCHEMA).withColumn(LABEL, F.col("fails").cast("double")) for rows in (train, new)]
    encoders = [fit_encoder(frames[0], spec, area, few) for few in (1000, 2)]
    assert [encoder.vocabulary is None for encoder, _ in encoders] == [True, False]
    assert encoders[0][0].feature_names == encoders[1][0].feature_names
    path = str(tmp_path / "encoder")
    encoders[1][0].write().save(path)
    loaded = FeatureEncoder.load(path)
    assert loaded.feature_names == encoders[0][0].feature_names
    matrices = [encoders[0][0].transform(frames[1]), encoders[1][0].transform(frames[1]), loaded.transform(frames[1])]
    few, many, read = (
        np.array([r["v"] for r in m.orderBy("row").select(vector_to_array(FEATURES).alias("v")).collect()]) for m in matrices
    )
    assert (few == many).all() and (few == read).all()
    sums = [np.array([r[0] for r in m.select(vector_to_array(FEATURES)).collect()]).sum(axis=0) for _, m in encoders]
    assert sums[0] == pytest.approx(sums[1])


@pytest.mark.parametrize("per_range", [3, 1000])
def test_places_of_a_vocabulary_follow_the_order_of_its_columns(spark, area, per_range):
    rows = [("b", 10, 2.5, True), ("a", 9, -1.0, None), ("ä", 100, 0.0, False), (None, 9, 2.5, False), ("b", None, 10.0, False)]
    table = spark.createDataFrame(rows, "t string, n int, x double, b boolean")
    names = ["t", "n", "x", "b"]
    listed = features.learn_vocabulary(table, names, area).columns
    learned = features.learn_vocabulary(table, names, area, 0, per_range)
    assert [(s.name, s.fill, s.size) for s in learned.columns] == [(s.name, s.fill, s.size) for s in listed]
    placed = [(r["name"], r["value"]) for r in learned.table.orderBy("place").collect()]
    assert placed == [(s.name, value) for s in listed for value in s.values]
    assert sorted(r["place"] for r in learned.table.collect()) == list(range(len(placed)))


def test_over_a_million_values_and_a_hot_one(spark, area, monkeypatch):
    """Nothing but a row per column reaches the driver, and the model learns from the vectors."""
    monkeypatch.setattr(lookup, "BROADCAST_BYTES", 1 << 20)
    ticket = F.when(F.col("id") % 3 == 0, F.lit("usual")).otherwise(F.concat(F.lit("t"), F.col("id")))
    table = spark.range(1_600_000).select("id", ticket.alias("ticket"))
    vocabulary = features.learn_vocabulary(table, ["ticket"], area)
    (stats,) = vocabulary.columns
    assert (stats.fill, stats.size, stats.values) == ("usual", 1_066_667, None)
    new = table.filter("id % 1000 < 30").unionByName(spark.createDataFrame([(-1, None), (-2, "never seen")], "id long, ticket string"))
    found = features.places(new, vocabulary, ["place"])
    assert found.filter("place IS NULL").select("id").collect() == [(-2,)]
    wrong = found.join(vocabulary.table, "place").filter("value <> coalesce(ticket, 'usual')")
    assert wrong.count() == 0 and found.count() == 48_002
    span = vocabulary.table.agg(F.min("place"), F.max("place"), F.countDistinct("place")).first()
    assert tuple(span) == (0, 1_066_666, 1_066_667)


def test_a_model_on_a_wide_text_column(spark, area):
    rows = [(k, None, k % 5, f"site{k // 2}", None, int(k // 2 % 3 == 0)) for k in range(240)]
    table = spark.createDataFrame(rows, SCHEMA).withColumn(LABEL, F.col("fails").cast("double"))
    spec = TableSpec(target="fails", categorical=("site",), numerical=("spin",), model_type="logistic_regression")
    _, matrix = fit_encoder(table, spec, area, few_categories=10)
    model = LogisticRegression(featuresCol=FEATURES, labelCol=LABEL, maxIter=30).fit(matrix)
    assert model.numFeatures == 121
    assert model.transform(matrix).filter(F.col("prediction") != F.col(LABEL)).count() == 0


def test_names_of_a_wide_vector_crowd_no_task(spark, tmp_path, monkeypatch):
    """Every order has an entry for its price, but no task gets all of them."""
    monkeypatch.setattr(lookup, "BROADCAST_BYTES", 1000)
    duckdb.sql(
        "COPY (SELECT i AS o_orderkey, i % 9 AS o_custkey, CAST(i * 1.5 AS DOUBLE) AS o_totalprice, "
        "'level ' || i % 3 AS o_orderpriority, TIMESTAMP '1996-01-01' + to_days(CAST(i % 700 AS INTEGER)) AS o_orderdate "
        f"FROM range(1, 6001) AS t(i)) TO '{tmp_path}/orders.parquet' (FORMAT parquet)"
    )
    with fixed_tasks(spark, 16):
        named = catalog.encoded_wide(spark, str(tmp_path))
        crowds = rows_by_task(named, "feature")
        found = spark_result(named)
    assert max(crowds) < sum(crowds) / 4
    assert found == duckdb_result(connect(str(tmp_path)), catalog.oracle_sql()["encoded_wide"])


# --- medians of many columns ----------------------------------------------------------


def test_medians_of_many_columns_are_searched_together(spark):
    """Columns of unlike shape, with gaps, ties, infinities and negative zero."""
    generator = np.random.default_rng(8)
    shapes = [
        lambda n: generator.normal(0, 1e6, n), lambda n: generator.exponential(1e-9, n), lambda n: np.full(n, 3.5),
        lambda n: np.where(generator.random(n) < 0.4, 0.0, generator.normal(0, 1, n)),
        lambda n: np.where(generator.random(n) < 0.2, np.inf, generator.random(n)), lambda n: -np.arange(n, dtype=float),
    ]
    columns = [shapes[k % 6](25_000 + k % 2) for k in range(12)]
    rows = [tuple(float(c[i]) if i < len(c) and (i * 7 + k) % 5 else None for k, c in enumerate(columns)) for i in range(25_001)]
    table = spark.createDataFrame(rows, ", ".join(f"c{k} double" for k in range(12))).repartition(5)
    names = table.columns
    counts = {name: sum(row[k] is not None for row in rows) for k, name in enumerate(names)}
    found = features.exact_medians(table, names, counts, dict.fromkeys(names, 10**9))
    for k, name in enumerate(names):
        assert found[name] == statistics.median(row[k] for row in rows if row[k] is not None)


def test_the_number_of_jobs_does_not_grow_with_the_columns(spark):
    def jobs(count):
        table = spark.range(60_000).select(*(((F.col("id") * 7919 + k) % 59_999).cast("double").alias(f"c{k}") for k in range(count)))
        spark.sparkContext.setJobGroup(f"medians of {count}", "")
        stats = features.numeric_stats(table, table.columns, counted_values=100)
        assert len(stats) == count and all(abs(s.median - 29_999) < 3 for s in stats)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"medians of {count}"))

    few = jobs(2)
    assert jobs(60) <= few + 4  # a pass more at most
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


# --- rates of several keys ------------------------------------------------------------


def test_rates_of_several_keys_come_from_one_aggregate(spark, area):
    """Keys of every type, with shared values and gaps, as `fit_rates` gives them one by one."""
    table = spark.range(400).select(
        F.when(F.col("id") % 7 > 0, F.col("id") % 11).alias("whole"), (F.col("id") % 11).cast("string").alias("text"),
        F.when(F.col("id") % 5 > 0, (F.col("id") % 3 - 1) * -0.1).alias("fraction"), (F.col("id") % 2 == 0).alias("flag"),
        F.expr("date_add(date'2024-01-01', CAST(id % 13 AS INT))").alias("day"),
        F.expr("timestamp_micros(1729990800000000 + (id % 9) * 1800000000)").alias("hour"),
        F.expr("CAST(id % 4 AS DECIMAL(9, 2)) / 3").alias("exact"), F.lit(None).cast("int").alias("nothing"),
        (F.col("id") % 3).alias("y"),
    )
    keys = [name for name in table.columns if name != "y"]
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")  # clocks went back that day
    try:
        together = group_rate.fit_all_rates(table, keys, "y", area)
        for key, ours in zip(keys, together, strict=True):
            theirs = group_rate.fit_rates(table, key, "y", area)
            assert (ours.key, ours.rows) == (theirs.key, theirs.rows)
            assert ours.table.schema["key"].dataType == theirs.table.schema["key"].dataType
            rows = [sorted(map(str, rates.table.select("key", "total", "rows", "salt").collect())) for rates in (ours, theirs)]
            assert rows[0] == rows[1]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_several_keys_are_shuffled_once(spark, area, monkeypatch):
    written = []
    monkeypatch.setattr(type(area), "table", lambda self, df, name, by=(): written.append(df) or df)
    table = spark.createDataFrame(machines(1, 40), SCHEMA)
    group_rate.fit_all_rates(table, ["unit", "site", "spin"], "fails", area)
    plan = written[0]._jdf.queryExecution().executedPlan().toString()
    assert len(written) == 1 and plan.count("Exchange hashpartitioning") == 1


def test_an_encoder_with_several_keys_is_saved_and_read(spark, area, tmp_path):
    rows = machines(5, 80)
    table = spark.createDataFrame(rows, SCHEMA).withColumn(LABEL, F.col("fails").cast("double"))
    spec = TableSpec(target="fails", numerical=("load",), group_keys=("unit", "site", "spin"))
    encoder, _ = fit_encoder(table, spec, area)
    encoder.write().save(str(tmp_path / "e"))
    again = FeatureEncoder.load(str(tmp_path / "e"))
    new = spark.createDataFrame(machines(6, 40, strange=True), SCHEMA)
    assert ordered(cells(again.transform(new))) == pytest.approx(ordered(cells(encoder.transform(new))))
