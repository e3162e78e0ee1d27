"""Cross-validation: the whole pipeline refitted on every fold's training rows."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.functions.columns import field_type, is_numeric, quoted
from tabloom.operators.fold_stats import EncoderFacts, learn_folds
from tabloom.operators.split import FOLD, k_folds, rolling_origin, stratified_k_folds
from tabloom.plans.prepare import prepared_data, staged_key
from tabloom.plans.train import evaluate_model, fit_pipeline
from tabloom.sources.work import WorkArea
from tabloom.spec import CLASSIFICATION, TEMPORAL, TableSpec

# Fits that run side by side: enough to fill the gaps between small jobs.
FOLDS_AT_ONCE = 3

SCORE_SCHEMA = "repeat int, fold int, metric string, value double"


def assign_folds(df: DataFrame, spec: TableSpec, folds: int, repeat: int = 0) -> DataFrame:
    """Folds matching the split strategy, on rows prepared with a row key."""
    if spec.split_strategy == TEMPORAL:
        return rolling_origin(df, folds, spec.order_by, spec.id_cols)
    if spec.task == CLASSIFICATION:
        return stratified_k_folds(df, folds, spec.seed, staged_key(), spec.target, repeat)
    return k_folds(df, folds, spec.seed, staged_key(), repeat)


def fold_facts(
    assigned: DataFrame, spec: TableSpec, folds: int, area: WorkArea
) -> list[EncoderFacts | None]:
    """What each fold's training rows teach, from common counts.

    Group rates of a text target follow the label indexes, which are each fold's own: such folds
    learn everything themselves.
    """
    if spec.group_keys and not is_numeric(field_type(assigned, spec.target)):
        return [None] * folds
    temporal, classified = spec.split_strategy == TEMPORAL, spec.task == CLASSIFICATION
    roles = (spec.numerical, spec.categorical, spec.group_keys, spec.target)
    return learn_folds(assigned, *roles, folds, temporal, classified, area)


def cross_validate(raw: DataFrame, spec: TableSpec, folds: int = 5, repeats: int = 1) -> DataFrame:
    """One row per repeat, fold and metric. A temporal strategy ignores repeats.

    What folds learn is counted once for all of them. Models are fitted per fold, and folds do not
    wait for each other: FOLDS_AT_ONCE of them share the cluster.
    """
    spark, scores = raw.sparkSession, []
    temporal = spec.split_strategy == TEMPORAL
    with WorkArea(spark, "folds") as area:
        prepared = prepared_data(raw, spec, area)
        for repeat in range(1 if temporal else repeats):
            assigned = area.table(assign_folds(prepared, spec, folds, repeat), "folds", [FOLD])
            facts = fold_facts(assigned, spec, folds, area)

            def score(fold: int, assigned: DataFrame = assigned, facts: list = facts) -> dict[str, float]:
                outside = quoted(FOLD) < fold if temporal else quoted(FOLD) != fold
                with WorkArea(spark, "fold") as fold_area:
                    pipeline = fit_pipeline(assigned.filter(outside), spec, fold_area, facts[fold])
                    held_out = assigned.filter(quoted(FOLD) == fold)
                    return evaluate_model(pipeline, held_out, spec, fold_area)

            with ThreadPoolExecutor(FOLDS_AT_ONCE) as pool:
                for fold, found in enumerate(pool.map(score, range(folds))):
                    scores += [(repeat, fold, name, value) for name, value in found.items()]
    return spark.createDataFrame(scores, SCORE_SCHEMA)


def summarize(scores: DataFrame) -> DataFrame:
    """Mean, population deviation, least and greatest value per metric."""
    return scores.groupBy("metric").agg(
        F.count("value").alias("evaluations"),
        F.avg("value").alias("mean"),
        F.stddev_pop("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
