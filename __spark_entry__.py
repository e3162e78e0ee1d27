"""

The driver tables are clean, so queries about defects read views derived from them
(`_VIEWS`), written once and used by both engines.
"""

from __future__ import annotations

import importlib
import re
from collections.abc import Callable, Sequence
from dataclasses import replace

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.functions.columns import row_key
from tabloom.operators import clean, features, group_rate, lift, metrics, quality, split
from tabloom.operators.lookup import look_up, table_bytes
from tabloom.operators.pipeline import FEATURES, LABEL, fit_encoder, load_pipeline
from tabloom.plans.crossval import cross_validate, summarize
from tabloom.plans.lift_report import lift_report
from tabloom.plans.predict import predict, run_prediction
from tabloom.plans.prepare import prepared_data, stage
from tabloom.plans.train import Outputs, run_training
from tabloom.sources.readers import load_dataset
from tabloom.sources.work import WorkArea, path_exists
from tabloom.sources.writers import save_dataset
from tabloom.spec import TableSpec, ValueRange

Query = Callable[[SparkSession, str], DataFrame]

_VIEWS = {
    # Missing, negative, infinite and repeated values, derived from the order key.
    "orders_dirty": """
        WITH base AS (
          SELECT o_orderkey, o_custkey, o_orderdate,
            CASE WHEN o_orderkey % 17 = 0 THEN NULL
                 WHEN o_orderkey % 101 = 0 THEN -o_totalprice
                 WHEN o_orderkey % 211 = 0 THEN CAST('Infinity' AS DOUBLE)
                 ELSE o_totalprice END AS total_price,
            CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderpriority END AS priority,
            CASE WHEN o_orderkey % 97 = 0 THEN NULL
                 WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS label
          FROM orders)
        SELECT * FROM base UNION ALL SELECT * FROM base WHERE o_orderkey % 29 = 0""",
    "events_scored": """
        SELECT event_id, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS actual,
          least(value, CAST(500 AS DOUBLE)) / CAST(500 AS DOUBLE) AS score,
          CASE WHEN value > 50 THEN 1 ELSE 0 END AS predicted
        FROM events""",
    "orders_pred": """
        SELECT o_orderkey, o_orderstatus AS actual,
          CASE WHEN o_orderkey % 5 < 3 THEN o_orderstatus
               WHEN o_orderkey % 2 = 0 THEN 'F' ELSE 'P' END AS predicted
        FROM orders""",
    "lineitem_pred": """
        SELECT l_extendedprice AS actual, l_quantity * CAST(1500 AS DOUBLE) AS predicted
        FROM lineitem""",
    # Labels that follow from the priority alone, so that SQL can state what a model must find.
    "learnable": """
        SELECT o_orderkey, o_custkey, o_orderdate, o_totalprice, o_orderpriority,
          CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END AS label,
          CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 2
               WHEN o_orderpriority = '3-MEDIUM' THEN 1 ELSE 0 END AS grade,
          o_totalprice / CAST(1000 AS DOUBLE)
            + CASE WHEN o_orderpriority = '1-URGENT' THEN 100 ELSE 0 END AS amount
        FROM orders""",
    # 85 % of a household's four events share its outcome.
    "households": """
        SELECT event_id, event_id - event_id % 4 AS household,
          CASE WHEN event_id % 20 < 17 THEN CAST(floor(event_id / 4) AS BIGINT) % 2
               ELSE 1 - CAST(floor(event_id / 4) AS BIGINT) % 2 END AS label
        FROM events""",
    # Small groups with singletons, and rows without a group.
    "baskets": """
        SELECT DISTINCT o_orderkey, o_orderdate,
          CAST(o_custkey AS VARCHAR(20)) || '/' || priority AS basket, label
        FROM orders_dirty WHERE label IS NOT NULL""",
}
_CLASSED = """
    SELECT o_orderkey, CASE WHEN floor((o_orderkey - (SELECT min(o_orderkey) FROM {orders})) / 30) % 2 = 0
      THEN 'a' || CAST(floor((o_orderkey - (SELECT min(o_orderkey) FROM {orders})) / 3) AS BIGINT)
      ELSE 'b' || CAST(floor((o_orderkey - (SELECT min(o_orderkey) FROM {orders})) / 5) AS BIGINT) END AS class
    FROM {orders}"""
_TICKETS = """
    SELECT o_orderkey, o_custkey, o_orderdate, o_totalprice, o_orderpriority,
      CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 5 = 0 THEN 'open'
           ELSE 'ticket ' || CAST(o_orderkey AS VARCHAR(20)) END AS ticket
    FROM {orders}"""
# How a vector is stored.
_SPARSE = "v struct<type: tinyint, size: int, indices: array<int>, values: array<double>>"
_USES = {"baskets": "orders_dirty"}


def _view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sources = {
        table: _table(spark, sf_dir, table)
        for table in ("orders", "events", "lineitem")
        if re.search(rf"FROM {table}\b", _VIEWS[name])
    }
    if name in _USES:
        sources[_USES[name]] = _view(spark, sf_dir, _USES[name])
    text = _VIEWS[name]
    for table in sources:
        text = re.sub(rf"FROM {table}\b", f"FROM {{{table}}}", text)
    return spark.sql(text, **sources)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _kept(spark: SparkSession, name: str) -> str:
    """A path for files that go when the process ends."""
    return f"{WorkArea.until_exit(spark, name).path}/{name}"


def _with_view(name: str, body: str) -> str:
    chain = [_USES[name], name] if name in _USES else [name]
    views = ", ".join(f"{view} AS ({_VIEWS[view]})" for view in chain)
    return f"WITH {views} {body}"


def _rounded(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.withColumns({name: F.round(name, 6) for name in names})


DIRTY = TableSpec(
    target="label",
    numerical=("total_price",),
    categorical=("priority",),
    group_keys=("o_custkey",),
    id_cols=("o_orderkey",),
    order_by=("o_orderdate", "o_orderkey"),
    min_rows=20_000,
    max_missing_fraction=0.05,
    max_duplicate_fraction=0.03,
    min_class_fraction=0.6,
    value_ranges={"total_price": ValueRange(minimum=0.0)},
)
LEARNABLE = TableSpec(
    target="label",
    numerical=("o_totalprice",),
    categorical=("o_orderpriority",),
    id_cols=("o_orderkey",),
    params={"n_estimators": 5, "max_depth": 3},
    metrics=("accuracy", "precision", "recall", "f1", "roc_auc", "average_precision"),
    seed=42,
)

# --- loading, encoding, cleaning ------------------------------------------------------


def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    dirty = _view(spark, sf_dir, "orders_dirty")
    path = _kept(spark, "csv")
    save_dataset(dirty.withColumn("o_orderdate", F.to_date("o_orderdate")), path, "csv")
    return load_dataset(spark, path)


def encode_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return clean.encode_target(orders, "o_orderstatus", {"F": 0, "O": 1, "P": 2})


def unmapped_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders")
    return clean.unmapped_labels(orders, "o_orderpriority", {"1-URGENT": 1, "2-HIGH": 0})


def clean_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    dirty = _view(spark, sf_dir, "orders_dirty")
    return clean.clean_dataset(dirty, DIRTY.features, DIRTY.target, DIRTY.value_ranges)


def drop_missing_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.drop_missing_target(_view(spark, sf_dir, "orders_dirty"), "label")


def drop_invalid_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.drop_invalid_values(_view(spark, sf_dir, "orders_dirty"), DIRTY.value_ranges)


def distinct_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.count_copies(_view(spark, sf_dir, "orders_dirty")).withColumnRenamed(
        quality.COPIES, "copies"
    )


# --- quality --------------------------------------------------------------------------


def quality_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, found = quality.profile_table(_view(spark, sf_dir, "orders_dirty"), DIRTY, quality.RAW)
    rows = [(name, int(value)) for name, value in found.items()]
    return spark.createDataFrame(rows, "measure string, value bigint")


def _issues(spark: SparkSession, reports: Sequence[quality.StageResult]) -> DataFrame:
    found = quality.issues_frame(spark, reports)
    return _rounded(found.select("stage", "check", "severity", "column", "observed"), ["observed"])


def quality_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    dirty = _view(spark, sf_dir, "orders_dirty")
    return _issues(spark, [quality.validate_dataset(dirty, DIRTY, quality.RAW)])


def quality_processed(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = clean_dataset(spark, sf_dir)
    return _issues(spark, [quality.validate_dataset(cleaned, DIRTY, quality.PROCESSED)])


def quality_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text labels, rare classes, labels not starting at 0, and a text regression target."""
    orders = _table(spark, sf_dir, "orders").withColumn("shifted", F.col("o_custkey") % 3 + 1)
    labels = _table(spark, sf_dir, "labels")
    checks = [check for check in quality.CHECKS if check.name == "target_quality"]
    cases = [
        (orders, "o_orderstatus", "classification", "boosted_trees", 0.05),
        (orders, "o_orderstatus", "classification", "logistic_regression", 0.3335),
        (orders, "o_orderstatus", "regression", "boosted_trees", 0.05),
        (orders, "shifted", "classification", "boosted_trees", 0.05),
        (labels, "quality", "classification", "boosted_trees", 0.9),
        (labels, "toxic", "classification", "boosted_trees", 0.0),
    ]
    reports = []
    for table, target, task, model, share in cases:
        spec = TableSpec(
            target=target,
            numerical=("feature",),
            task=task,
            model_type=model,
            min_class_fraction=share,
        )
        stage_name = f"{target}/{task}/{model}"
        found = quality.validate_dataset(table, spec, stage_name, checks)
        reports.append(found)
    return _issues(spark, reports)


def quality_added_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A further check beside the built-in ones, in the same pass."""

    def counted(context: quality.Context):
        return {"large": context.count_if(F.col("total_price") > 400_000)}

    def verdict(context: quality.Context, profile: quality.Profile):
        share = profile["large"] / profile["rows"]
        yield quality.Finding("large_orders", "warning", "total_price", share, 0.0, "large orders")

    checks = [*quality.CHECKS, quality.Check("large_orders", verdict, counted)]
    dirty = _view(spark, sf_dir, "orders_dirty")
    return _issues(spark, [quality.validate_dataset(dirty, DIRTY, quality.RAW, checks)])


def stage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    with WorkArea(spark, "stages") as area:
        staged = stage(_view(spark, sf_dir, "orders_dirty"), DIRTY, area)
        reports = [staged.raw_report(), staged.processed_report()]
    return quality.stage_summary(spark, reports)


# --- splits and folds -----------------------------------------------------------------


def split_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders").select("o_orderkey")
    return split.hold_out_random(orders, 0.2, 42, row_key(orders, ["o_orderkey"]))


def split_stratified(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    key = row_key(orders, ["o_orderkey"])
    return split.hold_out_random(orders, 0.2, 42, key, "o_orderstatus")


def _many_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with a class for every three or five of them, by turns of thirty."""
    return spark.sql(_CLASSED, orders=_table(spark, sf_dir, "orders"))


def split_many_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotas of far more classes than the driver keeps, with remainders that tie."""
    orders = _many_classes(spark, sf_dir)
    return split.hold_out_random(orders, 0.4, 42, row_key(orders, ["o_orderkey"]), "class")


def folds_many_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _many_classes(spark, sf_dir)
    return split.stratified_k_folds(orders, 4, 42, row_key(orders, ["o_orderkey"]), "class")


def split_temporal(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return split.hold_out_latest(orders, 0.2, ["o_orderdate"], ["o_orderkey"])


def folds_kfold(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events").select("event_id")
    return split.k_folds(events, 7, 42, row_key(events, ["event_id"]))


def folds_stratified(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events").select("event_id", "event_type")
    key = row_key(events, ["event_id"])
    return split.stratified_k_folds(events, 7, 42, key, "event_type")


def folds_repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events").select("event_id")
    key = row_key(events, ["event_id"])
    first, second = (split.k_folds(events, 7, 42, key, repeat) for repeat in (0, 1))
    return first.withColumn("repeat", F.lit(0)).unionByName(second.withColumn("repeat", F.lit(1)))


def folds_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events").select("event_id", "ts")
    return split.rolling_origin(events, 7, ["ts"], ["event_id"]).drop("ts")


# --- features -------------------------------------------------------------------------


def _dirty_halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    dirty = _view(spark, sf_dir, "orders_dirty").distinct()
    usable = clean.usable_rows(dirty, DIRTY.modelling_columns, "label", DIRTY.value_ranges)
    usable = WorkArea.until_exit(spark, "usable").table(usable, "usable")
    return usable.filter("o_orderdate < timestamp_ntz'1997-01-01'"), usable


def impute_scale_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, everything = _dirty_halves(spark, sf_dir)
    stats = features.numeric_stats(train, ["total_price", "o_custkey"])
    columns = [F.round(features.scaled(everything, s), 6).alias(s.name) for s in stats]
    return everything.select("o_orderkey", *columns)


def numeric_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Constants learned from training rows, medians located by rank instead of by count."""
    train, _ = _dirty_halves(spark, sf_dir)
    stats = features.numeric_stats(train, ["total_price", "o_custkey"], counted_values=100)
    rows = [(s.name, s.median, s.mean, s.scale) for s in stats]
    found = spark.createDataFrame(rows, "column string, median double, mean double, scale double")
    return _rounded(found, ["median", "mean", "scale"])


def impute_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, everything = _dirty_halves(spark, sf_dir)
    (stats,) = features.category_stats(train, ["priority"])
    return everything.select("o_orderkey", features.filled(stats).alias("priority"))


def one_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ones of the encoding, trained without '5-LOW', which therefore has none."""
    train, everything = _dirty_halves(spark, sf_dir)
    known = train.filter("priority <> '5-LOW' OR priority IS NULL")
    (stats,) = features.category_stats(known, ["priority"])
    return features.one_hot_long(everything, "o_orderkey", stats)


def _purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    bought = (F.col("event_type") == "purchase").cast("int").alias("label")
    return _table(spark, sf_dir, "events").select("event_id", "ts", "user_id", bought)


def group_rate_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = group_rate.group_totals(_purchases(spark, sf_dir), "user_id", "label")
    return totals.withColumnRenamed("key", "user_id")


def group_rates_together(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of three keys in one pass: two of them share values, one is text."""
    orders = _view(spark, sf_dir, "learnable").withColumn("agent", (F.col("o_custkey") + 7).cast("int"))
    keys = ("o_custkey", "agent", "o_orderpriority")
    rates = group_rate.fit_all_rates(orders, keys, "grade", WorkArea.until_exit(spark, "rates"))
    found = None
    for group in rates:
        own = group.table.select(
            F.lit(group.key).alias("name"), F.col("key").cast("string").alias("key"), "total", "rows"
        )
        found = own if found is None else found.unionByName(own)
    return found


def group_rate_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rate of a target with three codes: the mean code of the other orders of a customer."""
    orders = _view(spark, sf_dir, "learnable").select("o_orderkey", "o_custkey", "grade")
    rates = group_rate.fit_rates(orders, "o_custkey", "grade", WorkArea.until_exit(spark, "rates"))
    encoded = group_rate.encode_leave_one_out(orders, rates, "grade", "rate", "known")
    return _rounded(encoded.select("o_orderkey", "rate", "known"), ["rate"])


def group_rate_loo(spark: SparkSession, sf_dir: str) -> DataFrame:
    purchases = _purchases(spark, sf_dir)
    rates = group_rate.fit_rates(purchases, "user_id", "label")
    encoded = group_rate.encode_leave_one_out(purchases, rates, "label", "rate", "known")
    return _rounded(encoded.select("event_id", "rate", "known"), ["rate"])


def group_rate_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    baskets = _view(spark, sf_dir, "baskets")
    rates = group_rate.fit_rates(baskets, "basket", "label")
    encoded = group_rate.encode_leave_one_out(baskets, rates, "label", "rate", "known")
    return _rounded(encoded.select("o_orderkey", "rate", "known"), ["rate"])


def group_rate_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out rows encoded from training rows, unseen groups imputed."""
    baskets = _view(spark, sf_dir, "baskets")
    area = WorkArea.until_exit(spark, "halves")
    baskets = area.table(baskets, "baskets")
    halves = split.hold_out_latest(baskets, 0.2, ["o_orderdate"], ["o_orderkey"])
    train, test = halves.filter("NOT is_test"), halves.filter("is_test")
    rates = group_rate.fit_rates(train, "basket", "label")
    seen = group_rate.encode_leave_one_out(train, rates, "label", "rate", "known")
    seen = area.table(seen, "seen")
    counts = seen.agg(F.count("rate").alias("rate")).first().asDict()
    fill = features.exact_medians(seen, ["rate"], counts, counts)["rate"]
    encoded = group_rate.encode_rates(test, rates, "rate", "known")
    imputed = encoded.withColumn("rate", F.coalesce("rate", F.lit(fill)))
    return _rounded(imputed.select("o_orderkey", "rate", "known"), ["rate"])


# --- metrics and lift -----------------------------------------------------------------


def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion(_view(spark, sf_dir, "orders_pred"), "actual", "predicted")


def metrics_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _view(spark, sf_dir, "events_scored")
    names = ("f1", "recall", "precision", "accuracy", "roc_auc", "average_precision")
    found = metrics.evaluate_predictions(
        scored, "classification", names, "actual", "predicted", labels=[0, 1]
    )
    return _rounded(metrics.metrics_frame(spark, found), ["value"])


def metrics_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    predicted = _view(spark, sf_dir, "orders_pred")
    found = metrics.classification_metrics(predicted, "actual", "predicted")
    return _rounded(metrics.metrics_frame(spark, found), ["value"])


def metrics_known_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model also knows a class 'X' that no row has: it scores 0 and still counts."""
    predicted = _view(spark, sf_dir, "orders_pred")
    found = metrics.classification_metrics(
        predicted, "actual", "predicted", labels=["F", "O", "P", "X"]
    )
    return _rounded(metrics.metrics_frame(spark, found), ["value"])


def metrics_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    predicted = _view(spark, sf_dir, "lineitem_pred")
    found = metrics.regression_metrics(predicted, "actual", "predicted")
    return _rounded(metrics.metrics_frame(spark, found), ["value"])


def rank_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _view(spark, sf_dir, "events_scored")
    return _rounded(metrics.ranking_frame(scored), ["roc_auc", "average_precision"])


def lift_deciles(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _view(spark, sf_dir, "events_scored")
    table = lift.lift_deciles(scored, "score", "actual", ["event_id"])
    return _rounded(table, ["response_rate", "lift", "cumulative_share"])


def lift_top_fractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _view(spark, sf_dir, "events_scored")
    table = lift.lift_top_fractions(scored, "score", "actual", ["event_id"])
    return _rounded(table, ["reach", "response_rate", "lift"])


# --- models and workflows -------------------------------------------------------------


def _trained(spark: SparkSession, sf_dir: str, spec: TableSpec) -> DataFrame:
    found = run_training(_view(spark, sf_dir, "learnable"), spec)
    return _rounded(metrics.metrics_frame(spark, found), ["value"])


def train_gbt_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trained(spark, sf_dir, LEARNABLE)


def train_gbt_multiclass(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = replace(LEARNABLE, target="grade", metrics=("accuracy", "precision", "recall", "f1"))
    return _trained(spark, sf_dir, spec)


def train_gbt_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One tree deep enough to tell all priorities apart: it predicts their training means."""
    spec = replace(
        LEARNABLE,
        target="amount",
        task="regression",
        numerical=(),
        params={"n_estimators": 1, "max_depth": 5, "learning_rate": 1.0},
        metrics=("mae", "rmse", "r2"),
    )
    return _trained(spark, sf_dir, spec)


def train_logistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trained(spark, sf_dir, replace(LEARNABLE, model_type="logistic_regression", params={}))


def predict_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train, save, reload, and score every order, a customer rate included."""
    spec = replace(LEARNABLE, group_keys=("o_custkey",))
    path = _kept(spark, "model")
    learnable = _view(spark, sf_dir, "learnable")
    run_training(learnable, spec, Outputs(model=path))
    scored = predict(load_pipeline(spark, path), learnable.drop("label"), spec.features)
    return scored.select("o_orderkey", "prediction", (F.col("score") > 0.5).alias("likely"))


def prediction_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole prediction job: rows read from files, scored, written and read again."""
    spec = replace(LEARNABLE, model_type="logistic_regression", params={})
    model, given, done = (_kept(spark, name) for name in ("model", "given", "done"))
    learnable = _view(spark, sf_dir, "learnable")
    run_training(learnable, spec, Outputs(model=model))
    save_dataset(learnable.drop("label", "grade", "amount"), given, "parquet")
    run_prediction(spark, spec, model, given, done, "parquet")
    written = load_dataset(spark, done, "parquet")
    return written.withColumn("likely", F.col("score") > 0.5).drop("score")


def gate_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run that the gate refuses, and the evidence it leaves."""
    issues, stages, model = (_kept(spark, name) for name in ("issues", "stages", "model"))
    try:
        run_training(
            _view(spark, sf_dir, "orders_dirty"),
            DIRTY,
            Outputs(issues=issues, stages=stages, model=model),
        )
        refused = False
    except quality.DataQualityError:
        refused = True
    summary = spark.read.parquet(stages).select("stage", "passed", "rows")
    counted = spark.read.parquet(issues).groupBy("stage").agg(F.count(F.lit(1)).alias("issues"))
    return summary.join(counted, "stage", "left").withColumn(
        "refused", F.lit(refused and not path_exists(spark, model))
    )


def encoded_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The encoder fitted on the older rows, applied to all: non-zero entries by name."""
    train, everything = _dirty_halves(spark, sf_dir)
    spec = replace(DIRTY, numerical=("total_price", "nothing"), categorical=("priority", "nowhere"))
    empty = {"nothing": F.lit(None).cast("double"), "nowhere": F.lit(None).cast("string")}
    train, everything = train.withColumns(empty), everything.withColumns(empty)
    area = WorkArea.until_exit(spark, "encoder")
    encoder, _ = fit_encoder(train.withColumn(LABEL, F.col("label").cast("double")), spec, area)
    names = F.array(*map(F.lit, encoder.feature_names))
    encoded = encoder.transform(everything).select(
        "o_orderkey", F.arrays_zip(names.alias("feature"), vector_to_array(FEATURES).alias("value")).alias("v")
    )
    cells = encoded.select("o_orderkey", F.explode("v").alias("v")).select("o_orderkey", "v.feature", "v.value")
    return _rounded(cells.filter("value <> 0"), ["value"]).filter("value <> 0")


def encoded_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text column with as many values as orders beside a narrow one: non-zero entries by name.

    Fitted on the older orders; tickets of newer ones were never seen and have no entry.
    """
    orders = spark.sql(_TICKETS, orders=_table(spark, sf_dir, "orders"))
    train = orders.filter("o_orderdate < timestamp_ntz'1997-01-01'").withColumn(LABEL, F.lit(0.0))
    spec = TableSpec(target="o_custkey", numerical=("o_totalprice",), categorical=("ticket", "o_orderpriority"))
    area = WorkArea.until_exit(spark, "wide")
    encoder, _ = fit_encoder(train, spec, area, few_categories=100)
    stored = F.to_json(F.struct(F.col(FEATURES).alias("v")))
    vectors = encoder.transform(orders).select("o_orderkey", F.from_json(stored, _SPARSE)["v"].alias("v"))
    entries = vectors.select("o_orderkey", F.explode(F.arrays_zip("v.indices", "v.values")).alias("e"))
    entries = entries.select("o_orderkey", F.col("e.indices").alias("index"), F.col("e.values").alias("value"))
    # Every row has an entry for the number, so a plain join would give that index to one task.
    names = encoder.names_table(spark).withColumnsRenamed({"index": "key", "name": "feature"})
    named = look_up(area.table(entries, "entries"), F.col("index"), names, table_bytes(names, "feature"))
    return _rounded(named.select("o_orderkey", "feature", "value"), ["value"]).filter("value <> 0")


def quality_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Absent columns, wrong types, values above a bound, and targets absent, empty or constant."""
    orders = _table(spark, sf_dir, "orders")
    base = {"target": "o_custkey", "task": "regression", "model_type": "boosted_trees"}
    cases = {
        "absent": (orders, {"numerical": ("o_totalprice", "o_weight"), "categorical": ("o_colour",)}),
        "types": (orders, {"numerical": ("o_orderstatus",), "categorical": ("o_totalprice",)}),
        "above": (
            orders,
            {"numerical": ("o_totalprice",), "value_ranges": {"o_totalprice": ValueRange(maximum=400_000.0)}},
        ),
        "no target": (orders.drop("o_custkey"), {"numerical": ("o_totalprice",)}),
        "empty": (orders.filter("o_orderkey < 0"), {"numerical": ("o_totalprice",)}),
        "constant": (orders.withColumn("o_custkey", F.lit(4)), {"numerical": ("o_totalprice",)}),
    }
    results = [
        quality.validate_dataset(table, TableSpec(**base, **spec), name)
        for name, (table, spec) in cases.items()
    ]
    return _issues(spark, results)


def class_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and share of every class, rare ones marked, however many there are."""
    spec = TableSpec(
        target="o_custkey", numerical=("o_totalprice",), min_class_fraction=0.0008
    )
    return _rounded(quality.class_shares(_table(spark, sf_dir, "orders"), spec), ["share"])


def metrics_number_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels 2 and 10: the positive class is the higher number, not the later text."""
    scored = _view(spark, sf_dir, "events_scored")
    numbered = scored.select(
        *((F.col(n) * 8 + 2).alias(n) for n in ("actual", "predicted")), "score"
    )
    found = metrics.classification_metrics(numbered, "actual", "predicted", "score")
    return _rounded(metrics.metrics_frame(spark, found), ["value"])


def constant_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column that never varies but has gaps is centred, not scaled."""
    orders = _table(spark, sf_dir, "orders")
    table = orders.select(
        "o_orderkey", F.when(F.col("o_orderkey") % 3 > 0, F.lit(0.1)).alias("flat")
    )
    (stats,) = features.numeric_stats(table, ["flat"])
    fresh = orders.select("o_orderkey", (F.col("o_totalprice") / 1000).alias("flat"))
    return _rounded(fresh.withColumn("flat", features.scaled(fresh, stats)), ["flat"])


def prepared_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows training would use, with the key that splits them."""
    with_area = WorkArea.until_exit(spark, "prepared")
    return prepared_data(_view(spark, sf_dir, "orders_dirty"), DIRTY, with_area)


def lift_of_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decile lift of a saved model on the rows its training held out."""
    path = _kept(spark, "model")
    learnable = _view(spark, sf_dir, "learnable")
    run_training(learnable, LEARNABLE, Outputs(model=path))
    area = WorkArea.until_exit(spark, "lift")
    table = lift_report(load_pipeline(spark, path), learnable, LEARNABLE, area)[0]
    return _rounded(table, ["response_rate", "lift", "cumulative_share"])


def cross_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = replace(LEARNABLE, model_type="logistic_regression", params={})
    found = summarize(cross_validate(_view(spark, sf_dir, "learnable"), spec, folds=3))
    return _rounded(found, ["mean", "std", "min", "max"])


def cv_leak_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether rates fitted per fold score below rates computed beforehand, which leak."""
    base = TableSpec(
        target="label",
        group_keys=("household",),
        id_cols=("event_id",),
        model_type="logistic_regression",
        metrics=("accuracy",),
    )
    table = _view(spark, sf_dir, "households")
    with WorkArea(spark, "leak") as area:
        rates = group_rate.fit_rates(table, "household", "label", area)
        leaky = group_rate.encode_leave_one_out(table, rates, "label", "rate", "known")
        fitted = summarize(cross_validate(table, base, folds=3)).first()
        spec = replace(base, group_keys=(), numerical=("rate",))
        leaked = summarize(cross_validate(leaky, spec, folds=3)).first()
    row = (fitted["evaluations"], leaked["evaluations"], fitted["mean"] < leaked["mean"])
    return spark.createDataFrame([row], "per_fold long, precomputed long, leak_shows boolean")


def run_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _kept(spark, "runs")
    spec = replace(LEARNABLE, model_type="logistic_regression", params={"max_iter": 20})
    run_training(_view(spark, sf_dir, "learnable"), spec, Outputs(runs=path))
    return spark.read.parquet(path).select(
        "model_type",
        "task",
        F.col("params")["max_iter"].alias("max_iter"),
        "split_strategy",
        "train_rows",
        "test_rows",
        F.size("metrics").cast("bigint").alias("metrics"),
        (F.col("metrics")["accuracy"] > 0.8).alias("learned"),
    )


def entry(spark: SparkSession) -> DataFrame:
    return lift_deciles(spark, "/root/testdata/sf0.001")


def queries() -> dict[str, Query]:
    listed = (
        csv_roundtrip, encode_target, unmapped_labels, clean_dataset, drop_missing_target,
        drop_invalid_values, distinct_rows, quality_profile, quality_issues, quality_processed,
        quality_target, quality_added_check, stage_summary, split_random, split_stratified,
        split_many_classes, folds_many_classes,
        split_temporal, folds_kfold, folds_stratified, folds_repeated, folds_rolling,
        impute_scale_numeric, numeric_statistics, impute_mode, one_hot, encoded_wide, group_rate_fit,
        group_rates_together, group_rate_codes,
        group_rate_loo, group_rate_sparse, group_rate_apply, confusion, metrics_binary,
        metrics_macro, metrics_known_labels, metrics_regression, rank_metrics, lift_deciles,
        lift_top_fractions, train_gbt_binary, train_gbt_multiclass, train_gbt_regression,
        train_logistic, predict_scores, lift_of_model, cross_validation, cv_leak_check, run_record,
        prediction_files, gate_evidence, encoded_matrix, quality_shapes, class_shares,
        metrics_number_labels, constant_scale, prepared_rows,
    )
    named = {query.__name__: query for query in listed}
    return named | {"cross_validate": named.pop("cross_validation")} | _corpus("QUERIES")


def _corpus(what: str) -> dict:
    """The corpus operators' queries or SQL, and the pipeline's, where those modules exist."""
    found: dict = {}
    for module, take in (
        ("tabloom.llm.queries", lambda m: getattr(m, what)),
        ("corpus_pipeline", lambda m: _pipeline(m)[what]),
    ):
        try:
            found |= take(importlib.import_module(module))
        except ModuleNotFoundError as missing:
            if missing.name not in ("tabloom.llm", "tabloom.llm.queries", "corpus_pipeline"):
                raise
    return found


def _pipeline(module) -> dict[str, dict]:
    sql = {"pipeline": module.ORACLE_SQL} if module.ORACLE_SQL else {}
    return {"QUERIES": {"pipeline": module.run}, "ORACLES": sql}


# --- SQL equivalents ------------------------------------------------------------------

_VALID_PRICE = """(total_price IS NULL
    OR (total_price >= 0 AND total_price < CAST('Infinity' AS DOUBLE)))"""
_USABLE = f"""usable AS (SELECT DISTINCT * FROM orders_dirty
    WHERE label IS NOT NULL AND {_VALID_PRICE}),
  train AS (SELECT * FROM usable WHERE o_orderdate < TIMESTAMP '1997-01-01')"""


def _dirty_usable(body: str) -> str:
    return _with_view("orders_dirty", f", {_USABLE} {body}")


def _numeric_constants(column: str) -> str:
    return f"""(SELECT med, avg(coalesce(x, med)) AS mean, stddev_pop(coalesce(x, med)) AS scale
      FROM (SELECT CAST({column} AS DOUBLE) AS x, (SELECT quantile_cont({column}, 0.5) FROM train)
        AS med FROM train) GROUP BY med)"""


def _ranked(name: str, table: str, key: str, extra: str = "") -> str:
    return f"""{name} AS (SELECT {key}{extra},
      row_number() OVER (ORDER BY md5('42:' || CAST({key} AS VARCHAR))) AS r,
      count(*) OVER () AS n FROM {table})"""


def _even_folds(repeat: int) -> str:
    return f"""SELECT event_id, CAST(CASE WHEN r < m * (q + 1) THEN r // (q + 1)
        ELSE m + (r - m * (q + 1)) // q END AS INTEGER) AS fold, {repeat} AS repeat
      FROM (SELECT event_id, r, n // 7 AS q, n % 7 AS m FROM (SELECT event_id,
        row_number() OVER (ORDER BY md5('42:{repeat}:' || CAST(event_id AS VARCHAR))) - 1 AS r,
        count(*) OVER () AS n FROM events))"""


_LOO = """SELECT {key}, round(CASE WHEN n > 1 THEN (s - label) / (n - 1) END, 6) AS rate,
    CAST(CASE WHEN n > 1 THEN 1 ELSE 0 END AS DOUBLE) AS known FROM {rows}"""

_CLASS_METRICS = """classes AS (
    SELECT label, sum(support) AS support, sum(claimed) AS claimed, sum(hits) AS hits FROM (
      SELECT actual AS label, count(*) AS support, 0 AS claimed,
        count(*) FILTER (actual = predicted) AS hits FROM rows_ GROUP BY 1
      UNION ALL SELECT predicted, 0, count(*), 0 FROM rows_ GROUP BY 1) GROUP BY label),
  scored AS (SELECT label,
      CASE WHEN claimed = 0 THEN 0 ELSE hits / claimed END AS p,
      CASE WHEN support = 0 THEN 0 ELSE hits / support END AS r,
      2 * hits / (support + claimed) AS f FROM classes),
  accuracy AS (SELECT 'accuracy' AS metric, avg(CASE WHEN actual = predicted THEN 1.0 ELSE 0.0 END)
    AS value FROM rows_)"""

_RANKING = """ranks AS (SELECT score, sum(actual) AS p, sum(1 - actual) AS n
    FROM events_scored GROUP BY score),
  sums AS (SELECT p, n, sum(p) OVER w AS cp, sum(n) OVER w AS cn FROM ranks
    WINDOW w AS (ORDER BY score DESC)),
  areas AS (SELECT sum(n * (cp - p / 2)) / (sum(p) * sum(n)) AS roc_auc,
    sum(p * cp / (cp + cn)) / sum(p) AS average_precision FROM sums)"""


def _macro(size: int) -> str:
    return f"""{_CLASS_METRICS} SELECT metric, round(CAST(value AS DOUBLE), 6) AS value FROM (
      SELECT * FROM accuracy UNION ALL SELECT 'precision', sum(p) / {size} FROM scored
      UNION ALL SELECT 'recall', sum(r) / {size} FROM scored
      UNION ALL SELECT 'f1', sum(f) / {size} FROM scored)"""


def _target_issues() -> str:
    """Every case's verdict decided from its class table."""
    cases = [
        ("o_orderstatus/classification/boosted_trees", "orders", "o_orderstatus", "NULL", True, 0.05),
        ("o_orderstatus/classification/logistic_regression", "orders", "o_orderstatus", "NULL", False, 0.3335),
        ("shifted/classification/boosted_trees", "orders", "o_custkey % 3 + 1", "{label}", True, 0.05),
        ("quality/classification/boosted_trees", "labels", "quality", "{label}", True, 0.9),
        ("toxic/classification/boosted_trees", "labels", "toxic", "{label}", True, 0.0),
    ]

    def one(name: str, table: str, label: str, number: str, encoded: bool, limit: float) -> str:
        number = number.format(label=label)
        gapless = "least = 0 AND greatest = classes - 1" if encoded else "true"
        return f"""SELECT '{name}' AS stage, '{name.split("/")[0]}' AS "column",
          coalesce({gapless}, false) AS fits, classes, least_share, CAST({limit} AS DOUBLE) AS share_limit
          FROM (SELECT count(*) AS classes, min(c) / sum(c) AS least_share, min(n) AS least, max(n) AS greatest
            FROM (SELECT {label} AS label, CAST({number} AS BIGINT) AS n, count(*) AS c
              FROM {table} GROUP BY ALL))"""

    found = " UNION ALL ".join(one(*case) for case in cases)
    return f"""WITH cases AS ({found})
      SELECT stage, 'target_quality' AS "check", 'error' AS severity, "column",
        CASE WHEN fits THEN round(least_share, 6) ELSE CAST(classes AS DOUBLE) END AS observed
      FROM cases WHERE NOT fits OR least_share < share_limit
      UNION ALL SELECT 'o_orderstatus/regression/boosted_trees', 'target_quality', 'error',
        'o_orderstatus', NULL FROM (SELECT count(DISTINCT o_orderstatus) AS n,
          count(TRY_CAST(o_orderstatus AS DOUBLE)) AS numbers FROM orders) WHERE n > 1 AND numbers = 0"""


_RAW_COUNTS = """counts AS (SELECT count(*) AS n, count(*) FILTER (total_price IS NULL) AS mp,
    count(*) FILTER (priority IS NULL) AS mo, count(*) FILTER (o_custkey IS NULL) AS mc,
    count(*) FILTER (label IS NULL) AS ml,
    count(*) FILTER (abs(total_price) = CAST('Infinity' AS DOUBLE)) AS inf,
    count(*) FILTER (total_price < 0) AS neg, min(label) AS least, max(label) AS greatest,
    (SELECT count(*) FROM (SELECT DISTINCT * FROM orders_dirty)) AS d FROM orders_dirty)"""

_RAW_ISSUES = """issues AS (
    SELECT 'minimum_rows' AS "check", 'error' AS severity, CAST(NULL AS VARCHAR) AS "column",
      CAST(n AS DOUBLE) AS observed FROM counts WHERE n < 20000
    UNION ALL SELECT 'missingness', 'error', 'total_price', mp / n FROM counts WHERE mp / n > 0.05
    UNION ALL SELECT 'missingness', 'error', 'priority', mo / n FROM counts WHERE mo / n > 0.05
    UNION ALL SELECT 'duplicates', 'error', NULL, (n - d) / n FROM counts WHERE (n - d) / n > 0.03
    UNION ALL SELECT 'invalid_values', 'error', 'total_price', inf FROM counts WHERE inf > 0
    UNION ALL SELECT 'invalid_values', 'error', 'total_price', neg FROM counts WHERE neg > 0
    UNION ALL SELECT 'target_quality', 'error', 'label', ml FROM counts WHERE ml > 0)"""

_PROCESSED_COUNTS = """rest AS (SELECT count(*) AS n, count(*) FILTER (total_price IS NULL) AS mp,
    count(*) FILTER (priority IS NULL) AS mo, least(sum(label), count(*) - sum(label)) AS few
    FROM usable)"""
_PROCESSED_ISSUES = """found AS (
    SELECT 'minimum_rows' AS "check", 'error' AS severity, CAST(NULL AS VARCHAR) AS "column",
      CAST(n AS DOUBLE) AS observed FROM rest WHERE n < 20000
    UNION ALL SELECT 'missingness', 'error', 'total_price', mp / n FROM rest WHERE mp / n > 0.05
    UNION ALL SELECT 'missingness', 'error', 'priority', mo / n FROM rest WHERE mo / n > 0.05
    UNION ALL SELECT 'target_quality', 'error', 'label', few / n FROM rest WHERE few / n < 0.6)"""


def _held_out(target: str | None = None) -> str:
    """`halves`: the learnable rows and whether training holds them out, a fifth by class."""
    group = target or "0"
    return f"""sizes AS (SELECT {group} AS s, count(*) AS c FROM learnable GROUP BY 1),
      total AS (SELECT sum(c) AS n, sum(c) - ceil(sum(c) * CAST(0.2 AS DOUBLE)) AS train FROM sizes),
      exact AS (SELECT s, c, train, c / n * train AS e FROM sizes, total),
      quota AS (SELECT s, c - floor(e) - CASE WHEN row_number() OVER (ORDER BY floor(e) - e, s)
          <= train - sum(floor(e)) OVER () THEN 1 ELSE 0 END AS t FROM exact),
      ranked AS (SELECT *, {group} AS s, row_number() OVER (PARTITION BY {group}
          ORDER BY md5('42:' || CAST(o_orderkey AS VARCHAR))) AS r FROM learnable),
      halves AS (SELECT ranked.*, r <= t AS is_test FROM ranked JOIN quota USING (s))"""


def _usual(target: str, rows: str = "halves WHERE NOT is_test", by: str = "") -> str:
    """`usual`: the most frequent label of every priority among the training rows."""
    return f"""usual AS (SELECT {by} o_orderpriority, arg_max({target}, c) AS predicted
      FROM (SELECT {by} o_orderpriority, {target}, count(*) AS c FROM {rows} GROUP BY ALL) GROUP BY ALL)"""


_BINARY_RESULTS = """SELECT metric, round(CAST(value AS DOUBLE), 6) AS value FROM (
    SELECT * FROM accuracy UNION ALL SELECT 'precision', p FROM scored WHERE label = 1
    UNION ALL SELECT 'recall', r FROM scored WHERE label = 1
    UNION ALL SELECT 'f1', f FROM scored WHERE label = 1
    UNION ALL SELECT 'roc_auc', roc_auc FROM areas
    UNION ALL SELECT 'average_precision', average_precision FROM areas)"""


def _rule_metrics() -> str:
    ranking = _RANKING.replace("events_scored", "(SELECT actual, predicted AS score FROM rows_)")
    return _with_view(
        "learnable",
        f""", {_held_out("label")}, {_usual("label")},
          rows_ AS (SELECT label AS actual, predicted FROM halves JOIN usual USING (o_orderpriority)
            WHERE is_test), {_CLASS_METRICS}, {ranking} {_BINARY_RESULTS}""",
    )


def _model_sql() -> dict[str, str]:
    """What models that have found the rule answer, stated from the tables."""
    folds = """fsizes AS (SELECT label AS t, count(*) AS c FROM learnable GROUP BY 1),
      starts AS (SELECT t, c, sum(c) OVER (ORDER BY t) - c AS start FROM fsizes),
      shares AS (SELECT t, i AS fold, greatest(0, ceil((c - ((i - start) % 3 + 3) % 3) / 3)) AS share
        FROM starts, range(3) AS f(i)),
      ends AS (SELECT t, fold, sum(share) OVER (PARTITION BY t ORDER BY fold) AS last, share FROM shares),
      places AS (SELECT *, row_number() OVER (PARTITION BY label
        ORDER BY md5('42:0:' || CAST(o_orderkey AS VARCHAR))) AS r FROM learnable),
      folded AS (SELECT places.*, fold FROM places JOIN ends ON t = label AND r <= last AND r > last - share),
      others AS (SELECT f.i AS fold, folded.* EXCLUDE (fold) FROM folded JOIN range(3) AS f(i) ON folded.fold <> f.i)"""
    return {
        "train_gbt_binary": _rule_metrics(),
        "train_logistic": _rule_metrics(),
        "train_gbt_multiclass": _with_view(
            "learnable",
            f""", {_held_out("grade")}, {_usual("grade")},
              rows_ AS (SELECT grade AS actual, predicted FROM halves JOIN usual USING (o_orderpriority)
                WHERE is_test), {_macro(3)}""",
        ),
        "train_gbt_regression": _with_view(
            "learnable",
            f""", {_held_out()},
              means AS (SELECT o_orderpriority, avg(amount) AS predicted FROM halves WHERE NOT is_test GROUP BY 1),
              errors AS (SELECT avg(abs(amount - predicted)) AS mae,
                avg((amount - predicted) * (amount - predicted)) AS mse, var_pop(amount) AS spread
                FROM halves JOIN means USING (o_orderpriority) WHERE is_test)
              SELECT metric, round(value, 6) AS value FROM (SELECT 'mae' AS metric, mae AS value FROM errors
                UNION ALL SELECT 'rmse', sqrt(mse) FROM errors UNION ALL SELECT 'r2', 1 - mse / spread FROM errors)""",
        ),
        "predict_scores": _with_view(
            "learnable",
            f""", {_held_out("label")}, {_usual("label")}
              SELECT o_orderkey, predicted AS prediction, predicted = 1 AS likely
              FROM learnable JOIN usual USING (o_orderpriority)""",
        ),
        "prediction_files": _with_view(
            "learnable",
            f""", {_held_out("label")}, {_usual("label")}
              SELECT learnable.* EXCLUDE (label, grade, amount), predicted AS prediction, predicted = 1 AS likely
              FROM learnable JOIN usual USING (o_orderpriority)""",
        ),
        "lift_of_model": _with_view(
            "learnable",
            f""", {_held_out("label")}, {_usual("label")},
              placed AS (SELECT label, ntile(10) OVER (ORDER BY predicted DESC, CAST(o_orderkey AS VARCHAR)) AS decile,
                count(*) OVER () AS n, sum(label) OVER () AS pos
                FROM halves JOIN usual USING (o_orderpriority) WHERE is_test)
              SELECT CAST(decile AS INTEGER) AS decile, count(*) AS rows, CAST(sum(label) AS BIGINT) AS positives,
                round(sum(label) / count(*), 6) AS response_rate,
                round(sum(label) / count(*) / any_value(pos / n), 6) AS lift,
                round(sum(sum(label)) OVER (ORDER BY decile) / any_value(pos), 6) AS cumulative_share
              FROM placed GROUP BY decile""",
        ),
        "cross_validate": _with_view(
            "learnable",
            f""", {folds}, {_usual("label", "others", "fold,")},
              rows_ AS (SELECT fold, label AS actual, predicted FROM folded JOIN usual USING (fold, o_orderpriority)),
              counts AS (SELECT fold, count(*) AS n, sum(actual) AS pos, sum(predicted) AS claimed,
                sum(actual * predicted) AS hits, count(*) FILTER (actual = predicted) AS same FROM rows_ GROUP BY fold),
              parts AS (SELECT fold, predicted AS score, sum(actual) AS p, sum(1 - actual) AS n FROM rows_ GROUP BY ALL),
              sums AS (SELECT *, sum(p) OVER w AS cp, sum(n) OVER w AS cn FROM parts
                WINDOW w AS (PARTITION BY fold ORDER BY score DESC)),
              areas AS (SELECT fold, sum(n * (cp - p / 2)) / (sum(p) * sum(n)) AS roc_auc,
                sum(p * cp / (cp + cn)) / sum(p) AS average_precision FROM sums GROUP BY fold),
              found AS (SELECT 'accuracy' AS metric, same / n AS value FROM counts
                UNION ALL SELECT 'precision', hits / claimed FROM counts
                UNION ALL SELECT 'recall', hits / pos FROM counts
                UNION ALL SELECT 'f1', 2 * hits / (claimed + pos) FROM counts
                UNION ALL SELECT 'roc_auc', roc_auc FROM areas
                UNION ALL SELECT 'average_precision', average_precision FROM areas)
              SELECT metric, count(*) AS evaluations, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std,
                round(min(value), 6) AS min, round(max(value), 6) AS max FROM found GROUP BY metric""",
        ),
        # The rule a rate allows: the majority of the household's other rows, known or not.
        "cv_leak_check": _with_view(
            "households",
            """, sizes AS (SELECT label AS t, count(*) AS c FROM households GROUP BY 1),
              starts AS (SELECT t, c, sum(c) OVER (ORDER BY t) - c AS start FROM sizes),
              shares AS (SELECT t, i AS fold, greatest(0, ceil((c - ((i - start) % 3 + 3) % 3) / 3)) AS share
                FROM starts, range(3) AS f(i)),
              ends AS (SELECT t, fold, sum(share) OVER (PARTITION BY t ORDER BY fold) AS last, share FROM shares),
              places AS (SELECT *, row_number() OVER (PARTITION BY label
                ORDER BY md5('42:0:' || CAST(event_id AS VARCHAR))) AS r FROM households),
              folded AS (SELECT places.*, fold FROM places JOIN ends ON t = label AND r <= last AND r > last - share),
              rates AS (SELECT a.event_id, any_value(a.label) AS label,
                  avg(b.label) FILTER (b.event_id <> a.event_id) AS leaky,
                  avg(b.label) FILTER (b.fold <> a.fold) AS fair
                FROM folded a JOIN folded b USING (household) GROUP BY a.event_id)
              SELECT (SELECT count(DISTINCT fold) FROM folded) AS per_fold,
                (SELECT count(DISTINCT fold) FROM folded) AS precomputed,
                avg(CAST((coalesce(fair, 0.5) > 0.5) = (label = 1) AS INT))
                  < avg(CAST((leaky > 0.5) = (label = 1) AS INT)) AS leak_shows FROM rates""",
        ),
        "gate_evidence": _dirty_usable(
            f""", {_RAW_COUNTS}, {_RAW_ISSUES}, {_PROCESSED_COUNTS}, {_PROCESSED_ISSUES},
              stages AS (SELECT 'raw' AS stage, (SELECT count(*) FROM issues) AS issues, n AS rows,
                  (SELECT count(*) FROM issues WHERE "check" IN ('schema', 'duplicates')) AS stops FROM counts
                UNION ALL SELECT 'processed', (SELECT count(*) FROM found), n,
                  (SELECT count(*) FROM found) FROM rest)
              SELECT stage, issues = 0 AS passed, rows, CASE WHEN issues > 0 THEN issues END AS issues,
                (SELECT sum(stops) > 0 FROM stages) AS refused FROM stages
              WHERE stage = 'raw' OR (SELECT stops = 0 FROM stages WHERE stage = 'raw')"""
        ),
        "quality_shapes": """WITH counts AS (SELECT count(*) AS n,
              count(*) FILTER (o_totalprice > 400000) AS above, count(o_totalprice) AS numbers,
              count(TRY_CAST(o_orderstatus AS DOUBLE)) AS statuses FROM orders),
            columns AS (SELECT column_name AS c FROM (DESCRIBE orders)),
            absent AS (SELECT count(*) AS k FROM (SELECT unnest(['o_totalprice', 'o_weight', 'o_colour', 'o_custkey']) AS c)
              WHERE c NOT IN (SELECT c FROM columns))
          SELECT 'absent' AS stage, 'schema' AS "check", 'error' AS severity, CAST(NULL AS VARCHAR) AS "column",
            CAST(k AS DOUBLE) AS observed FROM absent WHERE k > 0
          UNION ALL SELECT 'types', 'data_types', 'error', 'o_orderstatus', NULL FROM counts WHERE statuses = 0
          UNION ALL SELECT 'types', 'data_types', 'warning', 'o_totalprice', NULL FROM counts WHERE numbers = n
          UNION ALL SELECT 'above', 'invalid_values', 'error', 'o_totalprice', above FROM counts WHERE above > 0
          UNION ALL SELECT 'no target', 'schema', 'error', NULL, count(*) FROM columns WHERE c = 'o_custkey'
          UNION ALL SELECT 'no target', 'target_quality', 'error', 'o_custkey', NULL FROM columns WHERE c = 'o_custkey'
          UNION ALL SELECT 'empty', 'minimum_rows', 'error', NULL, count(*) FROM orders WHERE o_orderkey < 0
          UNION ALL SELECT 'empty', 'target_quality', 'error', 'o_custkey', NULL
            FROM (SELECT count(*) AS k FROM orders WHERE o_orderkey < 0) WHERE k = 0
          UNION ALL SELECT 'constant', 'target_quality', 'error', 'o_custkey', count(DISTINCT 4)
            FROM orders HAVING count(*) > 0""",
        "class_shares": """SELECT CAST(o_custkey AS VARCHAR) AS label, count(*) AS rows,
              round(count(*) / any_value(n), 6) AS share,
              count(*) / any_value(n) < CAST(0.0008 AS DOUBLE) AS rare
            FROM (SELECT o_custkey, count(*) OVER () AS n FROM orders) GROUP BY 1""",
        "metrics_number_labels": _with_view(
            "events_scored",
            f""", rows_ AS (SELECT actual, predicted FROM events_scored), {_CLASS_METRICS},
              {_RANKING} {_BINARY_RESULTS}""",
        ),
        "constant_scale": """SELECT o_orderkey, round(o_totalprice / 1000 - (SELECT CASE WHEN min(x) = max(x)
              THEN min(x) END FROM (SELECT CASE WHEN o_orderkey % 3 > 0 THEN CAST(0.1 AS DOUBLE) END AS x
              FROM orders)), 6) AS flat FROM orders""",
        "prepared_rows": _dirty_usable(
            """SELECT total_price, priority, o_custkey, label, o_orderdate, o_orderkey,
              CAST(o_orderkey AS VARCHAR) AS __row_key FROM usable"""
        ),
        "encoded_wide": f"""
            WITH t AS ({_TICKETS.format(orders="orders")}),
              train AS (SELECT * FROM t WHERE o_orderdate < TIMESTAMP '1997-01-01'),
              cells AS (
                SELECT o_orderkey, 'numerical__o_totalprice' AS feature, (o_totalprice - mean) / scale AS value
                  FROM t, (SELECT avg(o_totalprice) AS mean, stddev_pop(o_totalprice) AS scale FROM train)
                UNION ALL SELECT o_orderkey, 'categorical__ticket_' || coalesce(ticket, 'open'), 1 FROM t
                  WHERE coalesce(ticket, 'open') IN (SELECT ticket FROM train)
                UNION ALL SELECT o_orderkey, 'categorical__o_orderpriority_' || o_orderpriority, 1 FROM t
                  WHERE o_orderpriority IN (SELECT o_orderpriority FROM train))
            SELECT o_orderkey, feature, round(CAST(value AS DOUBLE), 6) AS value FROM cells
            WHERE round(CAST(value AS DOUBLE), 6) <> 0""",
        "encoded_matrix": _dirty_usable(
            f""", sums AS (SELECT o_custkey AS k, sum(label) AS s, count(*) AS n FROM train GROUP BY 1),
              loo AS (SELECT CASE WHEN n > 1 THEN (s - label) / (n - 1) END AS rate FROM train JOIN sums ON k = o_custkey),
              middle AS (SELECT quantile_cont(rate, 0.5) AS rate FROM loo),
              fill AS (SELECT arg_max(priority, (c, hexed)) AS priority FROM (SELECT priority, count(*) AS c,
                -row_number() OVER (ORDER BY priority) AS hexed FROM train WHERE priority IS NOT NULL GROUP BY 1)),
              trained AS (SELECT DISTINCT priority FROM train WHERE priority IS NOT NULL),
              cells AS (
                SELECT o_orderkey, 'numerical__total_price' AS feature,
                  (coalesce(total_price, a.med) - a.mean) / a.scale AS value
                  FROM usable, {_numeric_constants("total_price")} AS a
                UNION ALL SELECT o_orderkey, 'categorical__priority_' || p, 1 FROM (SELECT o_orderkey,
                  coalesce(priority, (SELECT priority FROM fill)) AS p FROM usable)
                  WHERE p IN (SELECT priority FROM trained)
                UNION ALL SELECT o_orderkey, 'group:o_custkey__o_custkey',
                  coalesce(s / n, (SELECT rate FROM middle)) FROM usable LEFT JOIN sums ON k = o_custkey
                UNION ALL SELECT o_orderkey, 'group:o_custkey__o_custkey_known', 1 FROM usable JOIN sums ON k = o_custkey)
              SELECT o_orderkey, feature, round(CAST(value AS DOUBLE), 6) AS value FROM cells
              WHERE round(CAST(value AS DOUBLE), 6) <> 0"""
        ),
    }


def oracle_sql() -> dict[str, str]:
    events_ranked = """SELECT actual, score, event_id,
        row_number() OVER (ORDER BY score DESC, event_id) AS r,
        ntile(10) OVER (ORDER BY score DESC, event_id) AS decile,
        count(*) OVER () AS n, sum(actual) OVER () AS pos FROM events_scored"""
    return {
        "csv_roundtrip": _with_view(
            "orders_dirty",
            """SELECT o_orderkey, o_custkey, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate,
              total_price, priority, CAST(label AS DOUBLE) AS label FROM orders_dirty""",
        ),
        "encode_target": """SELECT o_orderkey, CAST(CASE o_orderstatus WHEN 'F' THEN 0
            WHEN 'O' THEN 1 WHEN 'P' THEN 2 END AS BIGINT) AS o_orderstatus FROM orders""",
        "unmapped_labels": """SELECT o_orderpriority AS label, count(*) AS rows FROM orders
            WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH') GROUP BY 1""",
        "clean_dataset": _dirty_usable(
            "SELECT total_price, priority, o_custkey, label FROM usable"
        ),
        "drop_missing_target": _with_view(
            "orders_dirty", "SELECT * FROM orders_dirty WHERE label IS NOT NULL"
        ),
        "drop_invalid_values": _with_view(
            "orders_dirty", f"SELECT * FROM orders_dirty WHERE {_VALID_PRICE}"
        ),
        "distinct_rows": _with_view(
            "orders_dirty",
            """SELECT o_orderkey, o_custkey, o_orderdate, total_price, priority, label,
              count(*) AS copies FROM orders_dirty GROUP BY ALL""",
        ),
        "quality_profile": _with_view(
            "orders_dirty",
            f""", {_RAW_COUNTS}
              SELECT 'rows' AS measure, n AS value FROM counts
              UNION ALL SELECT 'missing:total_price', mp FROM counts
              UNION ALL SELECT 'missing:priority', mo FROM counts
              UNION ALL SELECT 'missing:o_custkey', mc FROM counts
              UNION ALL SELECT 'distinct_rows', d FROM counts
              UNION ALL SELECT 'infinite:total_price', inf FROM counts
              UNION ALL SELECT 'below:total_price', neg FROM counts
              UNION ALL SELECT 'target_missing', ml FROM counts
              UNION ALL SELECT 'target_least', least FROM counts
              UNION ALL SELECT 'target_greatest', greatest FROM counts""",
        ),
        "quality_issues": _with_view(
            "orders_dirty",
            f""", {_RAW_COUNTS}, {_RAW_ISSUES}
              SELECT 'raw' AS stage, "check", severity, "column", round(observed, 6) AS observed
              FROM issues""",
        ),
        "quality_processed": _dirty_usable(
            f""", {_PROCESSED_COUNTS}, {_PROCESSED_ISSUES}
              SELECT 'processed' AS stage, "check", severity, "column",
                round(observed, 6) AS observed FROM found"""
        ),
        "quality_target": _target_issues(),
        "quality_added_check": _with_view(
            "orders_dirty",
            f""", {_RAW_COUNTS}, {_RAW_ISSUES}
              SELECT 'raw' AS stage, "check", severity, "column", round(observed, 6) AS observed
              FROM issues UNION ALL SELECT 'raw', 'large_orders', 'warning', 'total_price',
                round(count(*) FILTER (total_price > 400000) / count(*), 6) FROM orders_dirty""",
        ),
        "stage_summary": _dirty_usable(
            f""", {_RAW_COUNTS}, {_RAW_ISSUES}, {_PROCESSED_COUNTS}, {_PROCESSED_ISSUES}
              SELECT 'raw' AS stage, (SELECT count(*) = 0 FROM issues) AS passed, n AS rows,
                6 AS columns, CAST((SELECT count(*) FROM issues) AS INTEGER) AS errors,
                0 AS warnings, CAST(NULL AS BIGINT) AS rows_removed FROM counts
              UNION ALL SELECT 'processed', (SELECT count(*) = 0 FROM found), rest.n, 4,
                CAST((SELECT count(*) FROM found) AS INTEGER), 0, counts.n - rest.n
              FROM rest, counts"""
        ),
        "split_random": f"""WITH {_ranked("ranked", "orders", "o_orderkey")}
            SELECT o_orderkey, r <= ceil(n * CAST(0.2 AS DOUBLE)) AS is_test FROM ranked""",
        "split_stratified": """WITH sizes AS (SELECT o_orderstatus AS s, count(*) AS c
              FROM orders GROUP BY 1),
            total AS (SELECT sum(c) AS n, sum(c) - ceil(sum(c) * CAST(0.2 AS DOUBLE)) AS train
              FROM sizes),
            exact AS (SELECT s, c, train, c / n * train AS e FROM sizes, total),
            quota AS (SELECT s, c - floor(e) - CASE WHEN row_number() OVER (
                ORDER BY floor(e) - e, s) <= train - sum(floor(e)) OVER () THEN 1 ELSE 0 END AS t
              FROM exact),
            ranked AS (SELECT o_orderkey, o_orderstatus, row_number() OVER (
                PARTITION BY o_orderstatus ORDER BY md5('42:' || CAST(o_orderkey AS VARCHAR))) AS r
              FROM orders)
            SELECT o_orderkey, o_orderstatus, r <= t AS is_test
            FROM ranked JOIN quota ON s = o_orderstatus""",
        "split_many_classes": f"""WITH classed AS ({_CLASSED.format(orders="orders")}),
            sizes AS (SELECT class AS s, count(*) AS c FROM classed GROUP BY 1),
            total AS (SELECT CAST(sum(c) AS BIGINT) AS n,
              CAST(sum(c) - ceil(sum(c) * CAST(0.4 AS DOUBLE)) AS BIGINT) AS train FROM sizes),
            exact AS (SELECT s, c, train, c / n * train AS e FROM sizes, total),
            quota AS (SELECT s, c - floor(e) - CASE WHEN row_number() OVER (ORDER BY floor(e) - e, s)
                <= train - sum(floor(e)) OVER () THEN 1 ELSE 0 END AS t FROM exact),
            ranked AS (SELECT *, row_number() OVER (PARTITION BY class
                ORDER BY md5('42:' || CAST(o_orderkey AS VARCHAR))) AS r FROM classed)
            SELECT o_orderkey, class, r <= t AS is_test FROM ranked JOIN quota ON s = class""",
        "folds_many_classes": f"""WITH classed AS ({_CLASSED.format(orders="orders")}),
            placed AS (SELECT *, row_number() OVER (PARTITION BY class
                ORDER BY md5('42:0:' || CAST(o_orderkey AS VARCHAR))) - 1 AS r FROM classed),
            starts AS (SELECT class AS s, c, sum(c) OVER (ORDER BY class) - c AS start
              FROM (SELECT class, count(*) AS c FROM classed GROUP BY 1)),
            dealt AS (SELECT s, p % 4 AS fold, row_number() OVER (PARTITION BY s ORDER BY p % 4, p) - 1 AS place
              FROM (SELECT s, unnest(range(CAST(start AS BIGINT), CAST(start + c AS BIGINT))) AS p FROM starts))
            SELECT o_orderkey, class, CAST(fold AS INTEGER) AS fold FROM placed JOIN dealt ON s = class AND place = r""",
        "split_temporal": """SELECT o_orderkey, o_orderdate,
              row_number() OVER (ORDER BY o_orderdate, o_orderkey)
                > count(*) OVER () - ceil(count(*) OVER () * CAST(0.2 AS DOUBLE)) AS is_test
            FROM orders""",
        "folds_kfold": f"SELECT event_id, fold FROM ({_even_folds(0)})",
        "folds_repeated": f"{_even_folds(0)} UNION ALL {_even_folds(1)}",
        "folds_stratified": """WITH sizes AS (SELECT event_type AS t, count(*) AS c FROM events
              GROUP BY 1),
            starts AS (SELECT t, c, sum(c) OVER (ORDER BY t) - c AS start FROM sizes),
            shares AS (SELECT t, i AS fold, greatest(0, ceil(
                (c - ((i - start) % 7 + 7) % 7) / 7)) AS share FROM starts, range(7) AS f(i)),
            ends AS (SELECT t, fold, sum(share) OVER (PARTITION BY t ORDER BY fold) AS last, share
              FROM shares),
            ranked AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type
                ORDER BY md5('42:0:' || CAST(event_id AS VARCHAR))) AS r FROM events)
            SELECT event_id, event_type, CAST(fold AS INTEGER) AS fold FROM ranked
            JOIN ends ON t = event_type AND r <= last AND r > last - share""",
        "folds_rolling": """SELECT event_id, CAST(CASE WHEN p < n - 7 * t THEN -1
                ELSE (p - (n - 7 * t)) // t END AS INTEGER) AS fold
            FROM (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS p,
              count(*) OVER () AS n, count(*) OVER () // 8 AS t FROM events)""",
        "impute_scale_numeric": _dirty_usable(
            f"""SELECT o_orderkey,
                round((coalesce(total_price, a.med) - a.mean) / a.scale, 6) AS total_price,
                round((coalesce(o_custkey, b.med) - b.mean) / b.scale, 6) AS o_custkey
              FROM usable, {_numeric_constants("total_price")} AS a,
                {_numeric_constants("o_custkey")} AS b"""
        ),
        "numeric_statistics": _dirty_usable(
            " UNION ALL ".join(
                f"""SELECT '{name}' AS "column", round(med, 6) AS median, round(mean, 6) AS mean,
                  round(scale, 6) AS scale FROM {_numeric_constants(name)}"""
                for name in ("total_price", "o_custkey")
            )
        ),
        "impute_mode": _dirty_usable(
            """SELECT o_orderkey, coalesce(priority, (SELECT priority FROM train
                WHERE priority IS NOT NULL GROUP BY priority ORDER BY count(*) DESC, priority
                LIMIT 1)) AS priority FROM usable"""
        ),
        "one_hot": _dirty_usable(
            """, known AS (SELECT priority, count(*) AS c FROM train
                WHERE priority <> '5-LOW' GROUP BY 1),
              fill AS (SELECT priority AS f FROM known ORDER BY c DESC, priority LIMIT 1)
              SELECT o_orderkey, coalesce(usable.priority, f) AS category, 1 AS value
              FROM usable, fill WHERE coalesce(usable.priority, f) IN (SELECT priority FROM known)"""
        ),
        "group_rate_fit": """SELECT user_id, CAST(count(*) FILTER (event_type = 'purchase')
              AS BIGINT) AS total, count(*) AS rows FROM events GROUP BY 1""",
        "group_rates_together": _with_view(
            "learnable",
            " UNION ALL ".join(
                f"""SELECT '{name}' AS name, CAST({key} AS VARCHAR) AS key, CAST(sum(grade) AS BIGINT) AS total,
                  count(*) AS rows FROM learnable GROUP BY {key}"""
                for name, key in (
                    ("o_custkey", "o_custkey"), ("agent", "o_custkey + 7"), ("o_orderpriority", "o_orderpriority"),
                )
            ),
        ),
        "group_rate_codes": _with_view(
            "learnable",
            """SELECT o_orderkey, round(CASE WHEN n > 1 THEN (s - grade) / (n - 1) END, 6) AS rate,
                CAST(CASE WHEN n > 1 THEN 1 ELSE 0 END AS DOUBLE) AS known
              FROM (SELECT o_orderkey, grade, count(*) OVER (PARTITION BY o_custkey) AS n,
                sum(grade) OVER (PARTITION BY o_custkey) AS s FROM learnable)""",
        ),
        "group_rate_loo": _LOO.format(
            key="event_id",
            rows="""(SELECT event_id, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS label,
              count(*) OVER (PARTITION BY user_id) AS n, sum(CASE WHEN event_type = 'purchase'
              THEN 1 ELSE 0 END) OVER (PARTITION BY user_id) AS s FROM events)""",
        ),
        "group_rate_sparse": _with_view(
            "baskets",
            _LOO.format(
                key="o_orderkey",
                rows="""(SELECT o_orderkey, label,
                  CASE WHEN basket IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY basket) END AS n,
                  sum(label) OVER (PARTITION BY basket) AS s FROM baskets)""",
            ),
        ),
        "group_rate_apply": _with_view(
            "baskets",
            """, halves AS (SELECT *, row_number() OVER (ORDER BY o_orderdate, o_orderkey)
                  > count(*) OVER () - ceil(count(*) OVER () * CAST(0.2 AS DOUBLE)) AS is_test
                FROM baskets),
              totals AS (SELECT basket AS b, sum(label) AS s, count(*) AS n FROM halves
                WHERE NOT is_test AND basket IS NOT NULL GROUP BY 1),
              loo AS (SELECT (s - label) / (n - 1) AS rate FROM halves JOIN totals ON b = basket
                WHERE NOT is_test AND n > 1)
              SELECT o_orderkey, round(coalesce(s / n, (SELECT quantile_cont(rate, 0.5) FROM loo)),
                  6) AS rate, CAST(CASE WHEN n > 0 THEN 1 ELSE 0 END AS DOUBLE) AS known
              FROM halves LEFT JOIN totals ON b = basket WHERE is_test""",
        ),
        "confusion": _with_view(
            "orders_pred",
            "SELECT actual, predicted, count(*) AS rows FROM orders_pred GROUP BY 1, 2",
        ),
        "metrics_binary": _with_view(
            "events_scored",
            f""", rows_ AS (SELECT actual, predicted FROM events_scored), {_CLASS_METRICS},
              {_RANKING} SELECT metric, round(CAST(value AS DOUBLE), 6) AS value FROM (
                SELECT * FROM accuracy UNION ALL SELECT 'precision', p FROM scored WHERE label = 1
                UNION ALL SELECT 'recall', r FROM scored WHERE label = 1
                UNION ALL SELECT 'f1', f FROM scored WHERE label = 1
                UNION ALL SELECT 'roc_auc', roc_auc FROM areas
                UNION ALL SELECT 'average_precision', average_precision FROM areas)""",
        ),
        "metrics_macro": _with_view(
            "orders_pred", f", rows_ AS (SELECT actual, predicted FROM orders_pred), {_macro(3)}"
        ),
        "metrics_known_labels": _with_view(
            "orders_pred", f", rows_ AS (SELECT actual, predicted FROM orders_pred), {_macro(4)}"
        ),
        "metrics_regression": _with_view(
            "lineitem_pred",
            """, errors AS (SELECT avg(abs(actual - predicted)) AS mae,
                avg((actual - predicted) * (actual - predicted)) AS mse, var_pop(actual) AS spread
                FROM lineitem_pred)
              SELECT metric, round(value, 6) AS value FROM (SELECT 'mae' AS metric, mae AS value
                FROM errors UNION ALL SELECT 'rmse', sqrt(mse) FROM errors
                UNION ALL SELECT 'r2', 1 - mse / spread FROM errors)""",
        ),
        "rank_metrics": _with_view(
            "events_scored",
            f""", {_RANKING} SELECT round(roc_auc, 6) AS roc_auc,
              round(average_precision, 6) AS average_precision FROM areas""",
        ),
        "lift_deciles": _with_view(
            "events_scored",
            f"""SELECT CAST(decile AS INTEGER) AS decile, c AS rows, CAST(p AS BIGINT) AS positives,
                round(p / c, 6) AS response_rate, round(p / c / (pos / n), 6) AS lift,
                round(sum(p) OVER (ORDER BY decile) / pos, 6) AS cumulative_share
              FROM (SELECT decile, count(*) AS c, sum(actual) AS p, any_value(pos) AS pos,
                any_value(n) AS n FROM ({events_ranked}) GROUP BY decile)""",
        ),
        "lift_top_fractions": _with_view(
            "events_scored",
            f"""SELECT fraction, c AS rows, CAST(p AS BIGINT) AS positives,
                round(p / pos, 6) AS reach, round(p / c, 6) AS response_rate,
                round(p / c / (pos / n), 6) AS lift
              FROM (SELECT fraction, count(*) AS c, sum(actual) AS p, any_value(pos) AS pos,
                any_value(n) AS n FROM ({events_ranked}),
                (SELECT CAST(unnest([0.1, 0.2, 0.3, 0.5]) AS DOUBLE) AS fraction)
                WHERE r <= round_even(n * fraction, 0) GROUP BY fraction)""",
        ),
        "run_record": """SELECT 'logistic_regression' AS model_type, 'classification' AS task,
              '20' AS max_iter, 'random' AS split_strategy,
              CAST(count(*) - ceil(count(*) * CAST(0.2 AS DOUBLE)) AS BIGINT) AS train_rows,
              CAST(ceil(count(*) * CAST(0.2 AS DOUBLE)) AS BIGINT) AS test_rows,
              CAST(6 AS BIGINT) AS metrics, true AS learned FROM orders""",
    } | _model_sql() | _corpus("ORACLES")
