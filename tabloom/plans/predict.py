"""Batch scoring with a saved pipeline."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from tabloom.operators.clean import validate_columns
from tabloom.operators.pipeline import load_pipeline
from tabloom.sources.readers import load_dataset
from tabloom.sources.writers import save_dataset
from tabloom.spec import TableSpec


def predict(pipeline: PipelineModel, df: DataFrame, features: Sequence[str]) -> DataFrame:
    """All input columns plus `prediction`, and `score` where the model can rank.

    Needs the features, not the target. No quality gate: every row is scored. An input
    column of either name is read first and then replaced.
    """
    validate_columns(df, features)
    return pipeline.transform(df)


def run_prediction(
    spark: SparkSession,
    spec: TableSpec,
    model_path: str,
    input_path: str,
    output_path: str,
    fmt: str = "csv",
    separator: str = ",",
) -> DataFrame:
    """Read a table, score it and write it with its predictions."""
    pipeline = load_pipeline(spark, model_path)
    predicted = predict(pipeline, load_dataset(spark, input_path, fmt, separator), spec.features)
    save_dataset(predicted, output_path, fmt)
    return predicted
