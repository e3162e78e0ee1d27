"""Sinks: cleaned tables, predictions, quality evidence and run records."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

RUN_SCHEMA = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("recorded_at", T.TimestampType()),
        T.StructField("model_type", T.StringType()),
        T.StructField("task", T.StringType()),
        T.StructField("params", T.MapType(T.StringType(), T.StringType())),
        T.StructField("split_strategy", T.StringType()),
        T.StructField("train_rows", T.LongType()),
        T.StructField("test_rows", T.LongType()),
        T.StructField("metrics", T.MapType(T.StringType(), T.DoubleType())),
    ]
)


def save_dataset(df: DataFrame, path: str, fmt: str = "parquet", separator: str = ",") -> None:
    """Write a table, replacing what is there. CSV files carry a header each."""
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer.csv(path, header=True, sep=separator, escape='"')
    else:
        writer.format(fmt).save(path)


def new_run_id() -> str:
    return uuid.uuid4().hex


def run_record(
    spark: SparkSession,
    metrics: Mapping[str, float],
    context: Mapping[str, Any],
    run_id: str | None = None,
) -> DataFrame:
    """One row describing a finished training run."""
    row = {
        "run_id": run_id or new_run_id(),
        "recorded_at": datetime.now(timezone.utc),
        "model_type": context.get("model_type"),
        "task": context.get("task"),
        "params": {str(k): str(v) for k, v in (context.get("params") or {}).items()},
        "split_strategy": context.get("split_strategy"),
        "train_rows": context.get("train_rows"),
        "test_rows": context.get("test_rows"),
        "metrics": {name: float(value) for name, value in metrics.items()},
    }
    return spark.createDataFrame([tuple(row[f.name] for f in RUN_SCHEMA.fields)], RUN_SCHEMA)


def save_metrics(
    spark: SparkSession,
    metrics: Mapping[str, float],
    path: str,
    context: Mapping[str, Any],
    run_id: str | None = None,
) -> DataFrame:
    """Append one record to the runs table and return it."""
    record = run_record(spark, metrics, context, run_id)
    record.coalesce(1).write.mode("append").parquet(path)
    return record


def append_evidence(tables: Sequence[tuple[DataFrame, str]]) -> None:
    """Append quality evidence; called before a gate may raise."""
    for table, path in tables:
        table.write.mode("append").parquet(path)
