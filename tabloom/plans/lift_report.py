"""Lift of a saved model on the rows its training held out."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.functions.columns import quoted
from tabloom.operators.lift import lift_deciles, lift_top_fractions
from tabloom.operators.pipeline import known_labels
from tabloom.operators.split import IS_TEST, ROW_KEY, hold_out
from tabloom.plans.predict import predict
from tabloom.plans.prepare import prepared_data, staged_key
from tabloom.sources.work import WorkArea
from tabloom.spec import TableSpec


def held_out_scores(
    pipeline: PipelineModel, raw: DataFrame, spec: TableSpec, area: WorkArea
) -> DataFrame:
    """Row key, score and 0/1 actual of the rows training held out, rebuilt from the seed."""
    prepared = prepared_data(raw, spec, area)
    held_out = hold_out(prepared, spec, staged_key()).filter(quoted(IS_TEST))
    scored = predict(pipeline, held_out, spec.features)
    if "score" not in scored.columns:
        raise ValueError("this model gives no scores to rank by: lift needs two classes and probabilities")
    positive = F.lit(known_labels(pipeline)[-1])
    actual = (quoted(spec.target) == positive).cast("int").alias("actual")
    return area.table(scored.select(ROW_KEY, "score", actual), "ranked")


def lift_report(
    pipeline: PipelineModel, raw: DataFrame, spec: TableSpec, area: WorkArea
) -> tuple[DataFrame, DataFrame]:
    """Decile table and top-fraction table of the held-out rows."""
    ranked = held_out_scores(pipeline, raw, spec, area)
    return (
        lift_deciles(ranked, "score", "actual", [ROW_KEY]),
        lift_top_fractions(ranked, "score", "actual", [ROW_KEY]),
    )
