"""What a table is for: column roles, quality limits, split and model settings.

The rules are checked when a `TableSpec` is built, before any Spark job starts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

CLASSIFICATION = "classification"
REGRESSION = "regression"
TASKS = (CLASSIFICATION, REGRESSION)

RANDOM = "random"
TEMPORAL = "temporal"
SPLIT_STRATEGIES = (RANDOM, TEMPORAL)

CLASSIFICATION_METRICS = ("accuracy", "precision", "recall", "f1", "roc_auc", "average_precision")
REGRESSION_METRICS = ("mae", "rmse", "r2")


@dataclass(frozen=True)
class ValueRange:
    """Inclusive bounds; either side may be left open."""

    minimum: float | None = None
    maximum: float | None = None


@dataclass(frozen=True)
class TableSpec:
    target: str
    numerical: tuple[str, ...] = ()
    categorical: tuple[str, ...] = ()
    # Columns naming a group whose members share outcomes; encoded by target rate.
    group_keys: tuple[str, ...] = ()

    task: str = CLASSIFICATION
    model_type: str = "boosted_trees"
    params: Mapping[str, Any] = field(default_factory=dict)
    metrics: tuple[str, ...] = ()
    target_mapping: Mapping[Any, int] = field(default_factory=dict)

    seed: int = 42
    test_size: float = 0.2
    split_strategy: str = RANDOM
    # Spark tables have no row order: a temporal split needs these columns.
    order_by: tuple[str, ...] = ()
    # Columns that identify a row. Without them the key is a hash of the whole row.
    id_cols: tuple[str, ...] = ()

    min_rows: int = 50
    max_missing_fraction: float = 0.2
    max_duplicate_fraction: float = 0.05
    min_class_fraction: float = 0.05
    value_ranges: Mapping[str, ValueRange] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for name in ("numerical", "categorical", "group_keys", "metrics", "order_by", "id_cols"):
            object.__setattr__(self, name, tuple(getattr(self, name)))
        self._check_task_and_split()
        self._check_roles()
        self._check_target_mapping()
        self._check_limits()
        self._check_model()

    @property
    def features(self) -> tuple[str, ...]:
        return self.numerical + self.categorical + self.group_keys

    @property
    def modelling_columns(self) -> tuple[str, ...]:
        return (*self.features, self.target)

    def _check_task_and_split(self) -> None:
        if self.task not in TASKS:
            raise ValueError(f"unknown task {self.task!r}; choose one of {list(TASKS)}")
        if not 0.0 < self.test_size < 1.0:
            raise ValueError(f"test_size must lie strictly between 0 and 1, not {self.test_size}")
        if self.split_strategy not in SPLIT_STRATEGIES:
            raise ValueError(
                f"unknown split strategy {self.split_strategy!r}; "
                f"choose one of {list(SPLIT_STRATEGIES)}"
            )
        if self.split_strategy == TEMPORAL and not self.order_by:
            raise ValueError("a temporal split needs order_by: a Spark table has no row order")

    def _check_roles(self) -> None:
        if not self.features:
            raise ValueError("declare at least one feature column")
        if self.target in self.features:
            raise ValueError(
                f"target {self.target!r} is also declared as a feature, which leaks the answer"
            )
        repeated = sorted(name for name, uses in Counter(self.features).items() if uses > 1)
        if repeated:
            raise ValueError(f"columns declared in more than one feature role: {repeated}")

    def _check_target_mapping(self) -> None:
        if any(isinstance(label, bool) for label in self.target_mapping):
            raise ValueError("target_mapping keys must not be booleans; write text labels as text")
        uneven = sorted(str(code) for code in self.target_mapping.values() if float(code) % 1)
        if uneven:
            raise ValueError(f"target_mapping codes must be whole numbers, not {uneven}")
        codes = {label: int(float(code)) for label, code in self.target_mapping.items()}
        object.__setattr__(self, "target_mapping", codes)

    def _check_limits(self) -> None:
        if self.min_rows < 1:
            raise ValueError(f"min_rows must be 1 or more, not {self.min_rows}")
        for name in ("max_missing_fraction", "max_duplicate_fraction", "min_class_fraction"):
            if not 0.0 <= getattr(self, name) <= 1.0:
                raise ValueError(f"{name} must lie between 0 and 1, not {getattr(self, name)}")
        stray = sorted(set(self.value_ranges) - set(self.numerical))
        if stray:
            raise ValueError(
                f"value_ranges names {stray}, which are not among the numerical "
                f"features {list(self.numerical)}"
            )
        ranges = {name: _as_range(name, bounds) for name, bounds in self.value_ranges.items()}
        object.__setattr__(self, "value_ranges", ranges)

    def _check_model(self) -> None:
        from tabloom.operators.models import check_model

        check_model(self.model_type, self.task, self.params)
        known = CLASSIFICATION_METRICS if self.task == CLASSIFICATION else REGRESSION_METRICS
        if not self.metrics:
            default = known[:4] if self.task == CLASSIFICATION else known
            object.__setattr__(self, "metrics", default)
        check_metric_names(self.metrics, known, self.task)


def check_metric_names(names: tuple[str, ...], available: Any, task: str) -> None:
    unknown = [name for name in names if name not in available]
    if unknown:
        raise ValueError(
            f"metrics {unknown} do not exist for this {task} task; available: {sorted(available)}"
        )


def _as_range(column: str, bounds: Any) -> ValueRange:
    if isinstance(bounds, Mapping):
        if set(bounds) - {"min", "max"}:
            raise ValueError(f"value_ranges[{column!r}] may only hold 'min' and 'max'")
        bounds = ValueRange(bounds.get("min"), bounds.get("max"))
    if not isinstance(bounds, ValueRange):
        raise ValueError(f"value_ranges[{column!r}] must be a ValueRange or a min/max mapping")
    low = None if bounds.minimum is None else float(bounds.minimum)
    high = None if bounds.maximum is None else float(bounds.maximum)
    if low is not None and high is not None and low > high:
        raise ValueError(f"value_ranges[{column!r}] has its minimum above its maximum")
    return ValueRange(low, high)
