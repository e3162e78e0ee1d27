from __future__ import annotations

import pytest
from pyspark.ml.classification import GBTClassifier, LogisticRegression, OneVsRest
from pyspark.ml.regression import GBTRegressor, LinearRegression

from tabloom import TableSpec, ValueRange
from tabloom.operators import models

BASE = {"target": "y", "numerical": ("a", "b"), "categorical": ("c",), "group_keys": ("g",)}


def test_defaults():
    spec = TableSpec(**BASE)
    assert spec.features == ("a", "b", "c", "g")
    assert spec.modelling_columns == ("a", "b", "c", "g", "y")
    assert spec.split_strategy == "random"
    assert spec.metrics == ("accuracy", "precision", "recall", "f1")


@pytest.mark.parametrize(
    ("changes", "message"),
    [
        ({"task": "clustering"}, "task"),
        ({"test_size": 0.0}, "test_size"),
        ({"test_size": 1.0}, "test_size"),
        ({"split_strategy": "sorted"}, "split strategy"),
        ({"split_strategy": "temporal"}, "order_by"),
        ({"target": "a"}, "leaks"),
        ({"target": "g"}, "leaks"),
        ({"categorical": ("a",)}, r"\['a'\]"),
        ({"group_keys": ("c",)}, r"\['c'\]"),
        ({"target_mapping": {True: 1}}, "boolean"),
        ({"min_rows": 0}, "min_rows"),
        ({"max_missing_fraction": 1.5}, "max_missing_fraction"),
        ({"max_duplicate_fraction": -0.1}, "max_duplicate_fraction"),
        ({"min_class_fraction": 2}, "min_class_fraction"),
        ({"value_ranges": {"c": ValueRange(0)}}, r"\['c'\]"),
        ({"value_ranges": {"a": 5}}, "mapping"),
        ({"value_ranges": {"a": {"min": 2, "max": 1}}}, "minimum above"),
        ({"value_ranges": {"a": {"low": 2}}}, "'min' and 'max'"),
        ({"numerical": (), "categorical": (), "group_keys": ()}, "at least one feature"),
        ({"model_type": "unheard-of"}, "unheard-of"),
        ({"model_type": "logistic_regression", "task": "regression"}, "logistic_regression"),
        ({"params": {"depth": 3}}, r"\['depth'\]"),
        ({"metrics": ("accuracy", "mae")}, "mae"),
        ({"task": "regression", "metrics": ("f1",)}, "f1"),
    ],
)
def test_rules_reject(changes, message):
    with pytest.raises(ValueError, match=message):
        TableSpec(**{**BASE, **changes})


@pytest.mark.parametrize("share", [0, 0.0, 1, 1.0])
def test_fractions_include_their_ends(share):
    assert TableSpec(**BASE, max_missing_fraction=share).max_missing_fraction == share


def test_mapping_keys_keep_their_type_and_codes_become_integers():
    spec = TableSpec(**BASE, target_mapping={"1": 0, 2: "1", 3.5: 2.0})
    assert spec.target_mapping == {"1": 0, 2: 1, 3.5: 2}


def test_either_bound_may_be_open():
    spec = TableSpec(**BASE, value_ranges={"a": {"min": 0}, "b": {"max": 3}})
    assert spec.value_ranges == {"a": ValueRange(0.0, None), "b": ValueRange(None, 3.0)}
    equal = TableSpec(**BASE, value_ranges={"a": ValueRange(1, 1)})
    assert equal.value_ranges["a"] == ValueRange(1.0, 1.0)


def build(model_type, task, params=None, classes=2):
    return models.create_model(model_type, task, params or {}, models.Fit(50, classes, 99))


def test_registry_builds_the_estimator_for_type_and_task(spark):
    assert isinstance(build("boosted_trees", "classification"), GBTClassifier)
    assert isinstance(build("boosted_trees", "classification", classes=3), OneVsRest)
    assert isinstance(build("boosted_trees", "regression", classes=None), GBTRegressor)
    assert isinstance(build("logistic_regression", "classification"), LogisticRegression)


def test_parameters_reach_the_estimator(spark):
    params = {"n_estimators": 7, "max_depth": 3, "learning_rate": 0.2, "subsample": 0.9}
    model = build("boosted_trees", "classification", params | {"colsample_bytree": 0.5})
    assert (model.getMaxIter(), model.getMaxDepth(), model.getStepSize()) == (7, 3, 0.2)
    assert (model.getSubsamplingRate(), model.getFeatureSubsetStrategy()) == (0.9, "0.5")
    assert model.getSeed() == 99
    linear = build("logistic_regression", "classification", {"C": 2.0, "max_iter": 500})
    assert linear.getRegParam() == pytest.approx(1 / (2.0 * 50))
    assert linear.getMaxIter() == 500
    assert not linear.getStandardization()


def test_unsupported_model_lists_what_is_supported():
    with pytest.raises(ValueError, match="logistic_regression/classification"):
        models.model_family("boosted_trees", "ranking")


def test_further_models_can_be_registered(spark):
    family = models.ModelFamily(lambda params, fit: LinearRegression(**params))
    models.register_model("linear", "regression", family)
    try:
        spec = TableSpec(**BASE, task="regression", model_type="linear", params={"maxIter": 3})
        built = models.create_model("linear", "regression", spec.params, models.Fit(5, None, 1))
        assert built.getMaxIter() == 3
    finally:
        del models.FAMILIES["linear", "regression"]


def test_fractional_codes_are_refused():
    with pytest.raises(ValueError, match="whole numbers.*1.9"):
        TableSpec(**BASE, target_mapping={"a": 0, "b": 1.9})
