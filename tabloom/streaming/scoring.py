"""Batch prediction over a folder that keeps receiving files."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tabloom.plans.predict import predict
from tabloom.spec import TableSpec


def score_new_files(
    pipeline: PipelineModel,
    arriving: DataFrame,
    spec: TableSpec,
    output_path: str,
    checkpoint_path: str,
) -> StreamingQuery:
    """Score every file not scored before, append the results, then stop.

    The same pipeline as in batch: group rates are a static side of a left join, so each
    row is handled on its own and no state is kept.
    """
    return (
        predict(pipeline, arriving, spec.features)
        .writeStream.format("parquet")
        .option("path", output_path)
        .option("checkpointLocation", checkpoint_path)
        .trigger(availableNow=True)
        .start()
    )
