"""Metrics against plain loops over the rows."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.operators import lift, metrics

from tests.conftest import frame


def drawn(seed, labels, rows, wrong=0.3):
    """Labels, predictions that miss some of them, and scores that lean to the last label."""
    pick = random.Random(seed)
    actual = [pick.choice(labels) for _ in range(rows)]
    predicted = [pick.choice(labels) if pick.random() < wrong else a for a in actual]
    scores = [round(pick.random() * 0.6 + 0.4 * (a == labels[-1]), 2) for a in actual]
    return actual, predicted, scores


def by_hand(actual, predicted, known):
    """Precision, recall and f1 by label, counted one row at a time."""
    out = {}
    for label in known:
        both = sum(a == label and p == label for a, p in zip(actual, predicted))
        claimed, there = predicted.count(label), actual.count(label)
        precision = both / claimed if claimed else 0.0
        recall = both / there if there else 0.0
        total = precision + recall
        out[label] = (precision, recall, 2 * precision * recall / total if total else 0.0)
    return out


def brute_force_ranking(scores, actual):
    """Pairs for the ROC area; precision at each distinct threshold for AP."""
    positive, negative = scores[actual == 1], scores[actual == 0]
    wins = (positive[:, None] > negative).sum() + 0.5 * (positive[:, None] == negative).sum()
    average, reached = 0.0, 0
    for threshold in np.unique(scores)[::-1]:
        above = actual[scores >= threshold]
        average += (above.sum() - reached) * above.mean()
        reached = above.sum()
    return wins / (len(positive) * len(negative)), average / len(positive)


def table_of(spark, columns, dtype):
    kinds = {"actual": dtype, "predicted": dtype, "score": "double"}
    return frame(spark, columns, ", ".join(f"{n} {kinds[n]}" for n in columns))


@pytest.mark.parametrize(
    "labels, dtype",
    [((0, 1), "int"), ((7, 30), "bigint"), (("dry", "wet"), "string"), ((False, True), "boolean"), ((0.5, 2.25), "double")],
)
def test_two_labels(spark, labels, dtype):
    """The higher label by value is the positive one, 30 above 7 included."""
    actual, predicted, scores = drawn(11, labels, 57)
    table = table_of(spark, {"actual": actual, "predicted": predicted, "score": scores}, dtype)
    found = metrics.classification_metrics(table, "actual", "predicted", "score")
    expected = by_hand(actual, predicted, labels)[labels[1]]
    assert (found["precision"], found["recall"], found["f1"]) == pytest.approx(expected)
    assert found["accuracy"] == pytest.approx(np.mean([a == p for a, p in zip(actual, predicted)]))
    positives = np.array([a == labels[1] for a in actual], dtype=int)
    ranking = brute_force_ranking(np.array(scores), positives)
    assert (found["roc_auc"], found["average_precision"]) == pytest.approx(ranking)
    assert metrics.classification_metrics(table, "actual", "predicted", "score", list(labels)) == found


@pytest.mark.parametrize("extra", [(), ("unseen",), ("unseen", "other")])
def test_more_labels_average_over_the_known_ones(spark, extra):
    labels = ("ash", "birch", "cedar", "date")
    actual, predicted, _ = drawn(5, labels, 83)
    known = [*labels, *extra]
    table = table_of(spark, {"actual": actual, "predicted": predicted}, "string")
    found = metrics.classification_metrics(table, "actual", "predicted", labels=known if extra else None)
    expected = np.mean(list(by_hand(actual, predicted, known).values()), axis=0)
    assert [found[n] for n in ("precision", "recall", "f1")] == pytest.approx(list(expected))


def test_predictions_are_compared_unrounded(spark):
    table = frame(spark, {"a": [3, 4, 3, 4, 4], "p": [3.0, 3.9, 3.2, 4.0, 4.4]}, "a int, p double")
    assert metrics.classification_metrics(table, "a", "p")["accuracy"] == pytest.approx(2 / 5)


def test_a_label_never_predicted_scores_zero(spark):
    table = table_of(spark, {"actual": ["n"] * 5 + ["y"] * 2, "predicted": ["n"] * 7}, "string")
    found = metrics.classification_metrics(table, "actual", "predicted")
    assert [found[n] for n in ("precision", "recall", "f1")] == [0.0] * 3


def test_one_label_alone_cannot_be_evaluated(spark):
    table = table_of(spark, {"actual": [1] * 9, "predicted": [1] * 8 + [0]}, "int")
    with pytest.raises(ValueError, match="same label"):
        metrics.classification_metrics(table, "actual", "predicted", labels=[0, 1])


@pytest.mark.parametrize("bad", [None, float("nan")])
@pytest.mark.parametrize("scores_per_task", [3, 10**6])
def test_rows_without_a_rank_are_refused_at_every_size(spark, bad, scores_per_task):
    rows = [(k / 40, k % 2) for k in range(40)] + [(bad, 1)]
    table = spark.createDataFrame(rows, "score double, actual int")
    with pytest.raises(ValueError, match="1 rows have no score"):
        metrics.ranking_frame(table, scores_per_task=scores_per_task)
    keyed = table.withColumn("k", F.monotonically_increasing_id())
    for report in (lift.lift_deciles, lift.lift_top_fractions):
        with pytest.raises(ValueError, match="1 rows have no score"):
            report(keyed, "score", "actual", ["k"])


def test_names_choose_and_order_the_metrics(spark):
    actual, predicted, scores = drawn(2, (0, 1), 30)
    columns = {"actual": actual, "prediction": predicted, "score": scores}
    table = frame(spark, columns, "actual int, prediction int, score double")
    wanted = ["average_precision", "accuracy", "recall"]
    assert list(metrics.evaluate_predictions(table, "classification", wanted, "actual")) == wanted
    with pytest.raises(ValueError, match="r2"):
        metrics.evaluate_predictions(table, "classification", ["recall", "r2"], "actual")
    with pytest.raises(ValueError, match="average_precision"):
        metrics.evaluate_predictions(table.drop("score"), "classification", wanted, "actual")
    with pytest.raises(ValueError, match="no evaluation"):
        metrics.evaluate_predictions(table, "clustering", wanted, "actual")


def test_regression_errors(spark):
    pick = np.random.default_rng(8)
    truth = pick.normal(40, 9, 71)
    guess = truth + pick.normal(0, 3, 71)
    rows = [(float(a), float(p)) for a, p in zip(truth, guess)]
    found = metrics.regression_metrics(spark.createDataFrame(rows, "a double, p double"), "a", "p")
    error = [a - p for a, p in rows]
    around = sum((a - truth.mean()) ** 2 for a, _ in rows)
    assert found["mae"] == pytest.approx(sum(map(abs, error)) / 71)
    assert found["rmse"] == pytest.approx(math.sqrt(sum(e * e for e in error) / 71))
    assert found["r2"] == pytest.approx(1 - sum(e * e for e in error) / around)


@pytest.mark.parametrize("miss, r2", [(0.0, 1.0), (0.25, 0.0)])
def test_r2_of_a_target_that_never_varies(spark, miss, r2):
    table = frame(spark, {"a": [6.5] * 4, "p": [6.5, 6.5, 6.5, 6.5 + miss]}, "a double, p double")
    assert metrics.regression_metrics(table, "a", "p")["r2"] == r2


@pytest.mark.parametrize("scores_per_task", [10, 10**6])
def test_ranking_matches_brute_force(spark, scores_per_task):
    """A third of the rows share one score; many intervals and one give the same."""
    generator = np.random.default_rng(3)
    scores = np.where(generator.random(3000) < 0.33, 0.5, generator.random(3000).round(3))
    actual = (generator.random(3000) < scores).astype(int)
    table = spark.createDataFrame(
        [(float(s), int(a)) for s, a in zip(scores, actual, strict=True)], "score double, actual int"
    )
    row = metrics.ranking_frame(table, scores_per_task=scores_per_task).first()
    assert tuple(row) == pytest.approx(brute_force_ranking(scores, actual))


def test_ranking_plans_no_single_task_over_scores(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(5000).select(
        (F.col("id") / 5000).alias("score"), (F.col("id") % 2).alias("actual")
    ).write.parquet(path)
    found = metrics.ranking_frame(spark.read.parquet(path), scores_per_task=100)
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    # Windows over scores are split by range; the unsplit one reads the totals of ranges.
    assert "windowspecdefinition(__range_50" in plan
    # The rows themselves are read and combined once, before; the plan reads the scores only.
    assert path not in plan


def test_ranking_over_several_levels_of_ranges(spark):
    """Ranges of seven scores: their totals are scanned in three further levels."""
    table = spark.range(4000).select((F.col("id") * 7 % 3989 / 4000).alias("score"), (F.col("id") % 3 % 2).alias("actual"))
    rows = table.toPandas()
    row = metrics.ranking_frame(table, scores_per_task=7).first()
    assert tuple(row) == pytest.approx(brute_force_ranking(rows.score.to_numpy(), rows.actual.to_numpy()))


def test_whole_labels_that_a_double_cannot_tell_apart_are_refused(spark):
    large = frame(spark, {"a": [2**53, 2**53 + 1, 5], "p": [2.0**53, 2.0**53, 5.0]}, "a bigint, p double")
    with pytest.raises(ValueError, match="cannot be told apart"):
        metrics.classification_metrics(large, "a", "p")
    whole = large.withColumn("p", large.a)
    assert metrics.classification_metrics(whole, "a", "p")["accuracy"] == 1.0
    small = frame(spark, {"a": [2**52, 5], "p": [2.0**52, 4.5]}, "a bigint, p double")
    assert metrics.classification_metrics(small, "a", "p")["accuracy"] == 0.5
