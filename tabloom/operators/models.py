"""Model registry: MLlib estimators by model type and task."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.ml import Estimator
from pyspark.ml.classification import GBTClassifier, LogisticRegression, OneVsRest
from pyspark.ml.regression import GBTRegressor

from tabloom.spec import CLASSIFICATION, REGRESSION


@dataclass(frozen=True)
class Fit:
    """Facts about the training rows a builder may need."""

    rows: int
    classes: int | None
    seed: int


@dataclass(frozen=True)
class ModelFamily:
    """`build` makes an unfitted estimator reading `features` and `label`.

    `params` maps accepted parameter names to the estimator's own; with None any is accepted.
    """

    build: Callable[[dict[str, Any], Fit], Estimator]
    params: Mapping[str, str] | None = None
    encoded_labels: bool = False
    defaults: Mapping[str, Any] = field(default_factory=dict)


TREE_PARAMS = {
    "n_estimators": "maxIter",
    "max_depth": "maxDepth",
    "learning_rate": "stepSize",
    "subsample": "subsamplingRate",
    # A share of the columns per tree node; MLlib has no per-tree choice.
    "colsample_bytree": "featureSubsetStrategy",
    "max_bins": "maxBins",
}
# What an omitted parameter means.
TREE_DEFAULTS = {"n_estimators": 100, "max_depth": 6, "learning_rate": 0.3}
LOGISTIC_PARAMS = {"C": "C", "max_iter": "maxIter", "tol": "tol"}
LOGISTIC_DEFAULTS = {"C": 1.0, "max_iter": 100, "tol": 1e-4}


def _tree_settings(params: dict[str, Any], fit: Fit) -> dict[str, Any]:
    settings = {TREE_PARAMS[name]: value for name, value in params.items()}
    if "featureSubsetStrategy" in settings:
        settings["featureSubsetStrategy"] = str(float(settings["featureSubsetStrategy"]))
    return {**settings, "seed": fit.seed, "featuresCol": "features", "labelCol": "label"}


def _boosted_classifier(params: dict[str, Any], fit: Fit) -> Estimator:
    binary = GBTClassifier(**_tree_settings(params, fit))
    if fit.classes is not None and fit.classes > 2:
        return OneVsRest(
            classifier=binary, featuresCol="features", labelCol="label",
            parallelism=min(4, fit.classes),
        )
    return binary


def _boosted_regressor(params: dict[str, Any], fit: Fit) -> Estimator:
    return GBTRegressor(**_tree_settings(params, fit))


def _logistic(params: dict[str, Any], fit: Fit) -> Estimator:
    """L2-penalised: C weighs the summed loss, MLlib's regParam the mean loss."""
    return LogisticRegression(
        featuresCol="features", labelCol="label", elasticNetParam=0.0, standardization=False,
        regParam=1.0 / (float(params["C"]) * max(1, fit.rows)),
        maxIter=int(params["max_iter"]), tol=float(params["tol"]),
    )


FAMILIES: dict[tuple[str, str], ModelFamily] = {
    ("boosted_trees", CLASSIFICATION): ModelFamily(
        _boosted_classifier, TREE_PARAMS, True, TREE_DEFAULTS
    ),
    ("boosted_trees", REGRESSION): ModelFamily(
        _boosted_regressor, TREE_PARAMS, True, TREE_DEFAULTS
    ),
    # Accepts labels of any type, so they need no integer encoding.
    ("logistic_regression", CLASSIFICATION): ModelFamily(
        _logistic, LOGISTIC_PARAMS, False, LOGISTIC_DEFAULTS
    ),
}


def register_model(model_type: str, task: str, family: ModelFamily) -> None:
    """Make a further MLlib estimator available to specs."""
    FAMILIES[model_type, task] = family


def model_family(model_type: str, task: str) -> ModelFamily:
    family = FAMILIES.get((model_type, task))
    if family is None:
        supported = sorted(f"{kind}/{goal}" for kind, goal in FAMILIES)
        raise ValueError(f"no model {model_type!r} for {task}; supported: {supported}")
    return family


def check_model(model_type: str, task: str, params: Mapping[str, Any]) -> None:
    family = model_family(model_type, task)
    if family.params is not None:
        unknown = sorted(set(params) - set(family.params))
        if unknown:
            raise ValueError(
                f"model {model_type!r} has no parameters {unknown}; known: {sorted(family.params)}"
            )


def needs_encoded_labels(model_type: str) -> bool:
    return any(kind == model_type and f.encoded_labels for (kind, _), f in FAMILIES.items())


def create_model(model_type: str, task: str, params: Mapping[str, Any], fit: Fit) -> Estimator:
    check_model(model_type, task, params)
    family = model_family(model_type, task)
    return family.build({**family.defaults, **params}, fit)
