"""Exact evaluation metrics.

Classification metrics come from one `actual x predicted` count table; ranking metrics
from counts per distinct score with prefix sums; regression metrics from one aggregate.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.functions.columns import field_type, is_floating, is_number, number_of, quoted
from tabloom.operators.scan import running_totals
from tabloom.sources.work import WorkArea
from tabloom.spec import (
    CLASSIFICATION,
    CLASSIFICATION_METRICS,
    REGRESSION,
    REGRESSION_METRICS,
    check_metric_names,
)

# Distinct scores one task ranks.
SCORES_PER_TASK = 200_000

EXACT_IN_DOUBLE = 1 << 53

METRIC_SCHEMA = "metric string, value double"


def confusion(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Rows per pair of actual and predicted label."""
    return df.groupBy(quoted(actual).alias("actual"), quoted(predicted).alias("predicted")).agg(
        F.count(F.lit(1)).alias("rows")
    )


def class_table(pairs: DataFrame) -> DataFrame:
    """Per label: rows with it, rows predicted as it, and rows where both agree."""
    rows, same = F.col("rows"), F.col("actual") == F.col("predicted")
    zero = F.lit(0).cast("bigint")
    # Each pair counts once for its actual and once for its predicted label.
    sides = F.array(
        F.struct(
            F.col("actual").alias("label"),
            rows.alias("support"),
            zero.alias("claimed"),
            F.when(same, rows).otherwise(zero).alias("hits"),
        ),
        F.struct(
            F.col("predicted").alias("label"),
            zero.alias("support"),
            rows.alias("claimed"),
            zero.alias("hits"),
        ),
    )
    return (
        pairs.select(F.explode(sides).alias("side"))
        .select("side.*")
        .groupBy("label")
        .agg(
            F.sum("support").alias("support"),
            F.sum("claimed").alias("claimed"),
            F.sum("hits").alias("hits"),
        )
    )


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, F.lit(0.0)).otherwise(part / whole)


def class_metrics(classes: DataFrame) -> DataFrame:
    """Precision, recall and f1 of every label; an empty denominator scores 0."""
    return classes.select(
        "*",
        _ratio(F.col("hits"), F.col("claimed")).alias("precision"),
        _ratio(F.col("hits"), F.col("support")).alias("recall"),
        _ratio(2 * F.col("hits"), F.col("support") + F.col("claimed")).alias("f1"),
    )


def _common_type(actual: T.DataType, predicted: T.DataType) -> T.DataType:
    """A type that holds labels and predictions unchanged, so 0.9 never equals 1 or 0."""
    if actual == predicted or not (is_number(actual) and is_number(predicted)):
        return actual
    if isinstance(actual, T.IntegralType) and isinstance(predicted, T.IntegralType):
        return T.LongType()
    return T.DoubleType()


def classification_metrics(
    df: DataFrame,
    actual: str,
    predicted: str,
    score: str | None = None,
    labels: Sequence[Any] | None = None,
) -> dict[str, float]:
    """Accuracy, precision, recall and f1; ranking metrics too if binary and scored.

    `labels` are the classes the model knows, by default those seen on either side. With
    two of them the higher one, by value, is the positive class. With any other number
    the per-class metrics are averaged with equal weights over all known classes, absent
    ones scoring 0.
    """
    names = ("precision", "recall", "f1")
    kinds = field_type(df, actual), field_type(df, predicted)
    dtype = _common_type(*kinds)
    # Whole numbers read as double: labels from 2^53 on would melt into their neighbours.
    mixed = isinstance(dtype, T.DoubleType) and any(not is_floating(kind) for kind in kinds)
    typed = df.withColumns({n: quoted(n).cast(dtype) for n in (actual, predicted)})
    scored = class_metrics(class_table(confusion(typed, actual, predicted)))
    if labels is None:
        known, positive = F.lit(True), F.max("label")
        top = F.max_by(F.struct(*names), "label")
    else:
        known, positive = F.col("label").isin(list(labels)), F.lit(max(labels)).cast(dtype)
        top = F.max(F.when(F.col("label") == positive, F.struct(*names)))
    found = scored.agg(
        F.sum("support").alias("rows"),
        F.sum("hits").alias("matches"),
        F.count_if(F.col("support") > 0).alias("observed"),
        F.count(F.lit(1)).alias("seen"),
        *(F.sum(F.when(known, F.col(name))).alias(name) for name in names),
        positive.alias("positive"),
        top.alias("top"),
        (F.max(F.abs("label")) if mixed else F.lit(None).cast("double")).alias("largest"),
    ).first()
    if mixed and (found["largest"] or 0) >= EXACT_IN_DOUBLE:
        raise ValueError(
            f"{actual!r} and {predicted!r} hold whole and fractional numbers beyond {EXACT_IN_DOUBLE}, "
            "which cannot be told apart; cast them to one type"
        )
    if found["observed"] < 2:
        raise ValueError(
            "all evaluated rows have the same label, so class metrics would be meaningless; "
            "hold out more rows or use another seed"
        )
    size = found["seen"] if labels is None else len(labels)
    metrics = {"accuracy": found["matches"] / found["rows"]}
    if size != 2:
        return metrics | {name: (found[name] or 0.0) / size for name in names}
    metrics |= {name: found["top"][name] if found["top"] else 0.0 for name in names}
    if score is not None:
        hits = (quoted(actual) == F.lit(found["positive"]).cast(dtype)).cast("int")
        ranked = typed.select(quoted(score).cast("double").alias("score"), hits.alias("actual"))
        metrics |= ranking_frame(ranked).first().asDict()
    return metrics


def ranking_frame(
    df: DataFrame,
    score: str = "score",
    actual: str = "actual",
    scores_per_task: int = SCORES_PER_TASK,
) -> DataFrame:
    """One row with the ROC area (ties count half) and average precision of 0/1 `actual`.

    Rows are combined per distinct score, once. Running totals over the scores, range by range,
    then give each score the rows above it; a range holds at most `scores_per_task` scores and
    there may be any number of ranges. NULL where a class is absent. Rows without a score, or with
    NaN for one, have no rank and are refused.
    """
    area = WorkArea.until_exit(df.sparkSession, "ranking")
    hit = quoted(actual).cast("bigint")
    counts = df.groupBy(quoted(score).cast("double").alias("score")).agg(
        F.sum(hit).alias("p"), F.sum(1 - hit).alias("n"), F.count(F.lit(1)).alias("rows")
    )
    counts = area.table(counts, "scores")
    nameless = F.col("score").isNull() | F.isnan("score")
    scores, unranked = counts.agg(
        F.count(F.lit(1)), F.coalesce(F.sum(F.when(nameless, F.col("rows"))), F.lit(0))
    ).first()
    _refuse_unranked(unranked, score)
    above = {"p_above": F.col("p"), "n_above": F.col("n")}
    running = running_totals(counts.drop("rows"), [F.col("score").desc()], above, area, scores_per_task, scores)
    p, n = F.col("p").cast("double"), F.col("n").cast("double")
    cum_p = (F.col("p_above") + F.col("p")).cast("double")
    cum_n = (F.col("n_above") + F.col("n")).cast("double")
    sums = running.agg(
        F.sum(p).alias("p"),
        F.sum(n).alias("n"),
        F.sum(n * (cum_p - p / 2)).alias("area"),
        F.sum(F.try_divide(p * cum_p, cum_p + cum_n)).alias("precision"),
    )
    return sums.select(
        F.try_divide("area", F.col("p") * F.col("n")).alias("roc_auc"),
        F.try_divide("precision", "p").alias("average_precision"),
    )


def refuse_unranked(df: DataFrame, score: str) -> None:
    value = quoted(score).cast("double")
    _refuse_unranked(df.agg(F.count_if(value.isNull() | F.isnan(value))).first()[0], score)


def _refuse_unranked(rows: int, score: str) -> None:
    if rows:
        raise ValueError(f"{rows} rows have no score or NaN in {score!r}, so they have no rank")


def regression_metrics(df: DataFrame, actual: str, predicted: str) -> dict[str, float]:
    row = regression_frame(df, actual, predicted).first()
    return row.asDict()


def regression_frame(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """One row with `mae`, `rmse` and `r2`; a constant target has r2 1 if hit exactly, else 0."""
    truth = number_of(df, actual).cast("double")
    error = truth - quoted(predicted).cast("double")
    sums = df.agg(
        F.avg(F.abs(error)).alias("mae"),
        F.avg(error * error).alias("mse"),
        F.var_pop(truth).alias("spread"),
    )
    constant = F.when(F.col("mse") == 0, F.lit(1.0)).otherwise(F.lit(0.0))
    return sums.select(
        "mae",
        F.sqrt("mse").alias("rmse"),
        F.when(F.col("spread") == 0, constant)
        .otherwise(1 - F.try_divide("mse", "spread"))
        .alias("r2"),
    )


@dataclass(frozen=True)
class Evaluation:
    """What one task can be measured by: the names it may be asked for, and how to get them."""

    names: tuple[str, ...]
    measure: Callable[..., dict[str, float]]


def _measure_classes(df, wanted, actual, predicted, score, labels) -> dict[str, float]:
    ranking = {"roc_auc", "average_precision"} & set(wanted)
    scored = score if ranking and score in df.columns else None
    return classification_metrics(df, actual, predicted, scored, labels)


def _measure_numbers(df, wanted, actual, predicted, score, labels) -> dict[str, float]:
    return regression_metrics(df, actual, predicted)


EVALUATIONS = {
    CLASSIFICATION: Evaluation(CLASSIFICATION_METRICS, _measure_classes),
    REGRESSION: Evaluation(REGRESSION_METRICS, _measure_numbers),
}


def evaluate_predictions(
    df: DataFrame,
    task: str,
    names: Sequence[str],
    actual: str,
    predicted: str = "prediction",
    score: str = "score",
    labels: Sequence[Any] | None = None,
) -> dict[str, float]:
    """The metrics called `names`, in that order, by the evaluation registered for the task."""
    evaluation = EVALUATIONS.get(task)
    if evaluation is None:
        raise ValueError(f"no evaluation for task {task!r}; there are {sorted(EVALUATIONS)}")
    wanted = tuple(names)
    check_metric_names(wanted, evaluation.names, task)
    found = evaluation.measure(df, wanted, actual, predicted, score, labels)
    check_metric_names(wanted, found, task)
    return dict(zip(wanted, map(found.__getitem__, wanted), strict=True))


def metrics_frame(spark: SparkSession, metrics: Mapping[str, float]) -> DataFrame:
    return spark.createDataFrame(
        [(name, float(value)) for name, value in metrics.items()], METRIC_SCHEMA
    )
