"""Training: checks and gate, split, fit, evaluation, records."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.functions.columns import quoted
from tabloom.operators.fold_stats import EncoderFacts
from tabloom.operators.metrics import evaluate_predictions
from tabloom.operators.pipeline import TabularPipeline, known_labels, save_pipeline
from tabloom.operators.quality import StageResult, class_shares, gate, issues_frame, stage_summary
from tabloom.operators.split import IS_TEST, hold_out
from tabloom.plans.predict import predict
from tabloom.plans.prepare import Staged, narrowed, stage, staged_key
from tabloom.sources.work import WorkArea
from tabloom.sources.writers import append_evidence, new_run_id, save_dataset, save_metrics
from tabloom.spec import CLASSIFICATION, TableSpec


@dataclass(frozen=True)
class Outputs:
    """Where a training run leaves its results; None skips one."""

    processed: str | None = None
    model: str | None = None
    runs: str | None = None
    issues: str | None = None
    stages: str | None = None
    classes: str | None = None
    fmt: str = "parquet"


def run_training(raw: DataFrame, spec: TableSpec, outputs: Outputs | None = None) -> dict[str, float]:
    """Train on a raw table and return the requested metrics.

    Quality evidence is written before the gate may raise. Cleaned data and model appear
    only once the gate has passed, run record and model only once evaluation succeeded.
    """
    spark, outputs, run_id = raw.sparkSession, outputs or Outputs(), new_run_id()
    with WorkArea(spark, "train") as area:
        staged = stage(raw, spec, area)
        reports = [staged.raw_report()]
        if not reports[0].refused_for():
            reports.append(staged.processed_report())
        record_evidence(staged, reports, outputs, run_id)
        for report in reports:
            gate(report)

        cleaned = staged.cleaned()
        if outputs.processed:
            save_dataset(narrowed(cleaned, spec), outputs.processed, outputs.fmt)
        halves = area.table(hold_out(cleaned, spec, staged_key()), "split", [IS_TEST])
        pipeline = fit_pipeline(halves.filter(~quoted(IS_TEST)), spec, area)
        metrics = evaluate_model(pipeline, halves.filter(quoted(IS_TEST)), spec, area)

        if outputs.runs:
            sizes = halves.groupBy(IS_TEST).agg(F.count(F.lit(1)).alias("rows")).collect()
            counted = {row[IS_TEST]: row["rows"] for row in sizes}
            context = {
                "model_type": spec.model_type,
                "task": spec.task,
                "params": spec.params,
                "split_strategy": spec.split_strategy,
                "train_rows": counted[False],
                "test_rows": counted[True],
            }
            save_metrics(spark, metrics, outputs.runs, context, run_id)
        if outputs.model:
            save_pipeline(pipeline, outputs.model)
        return metrics


def fit_pipeline(
    train: DataFrame, spec: TableSpec, area: WorkArea | None = None, facts: EncoderFacts | None = None
) -> PipelineModel:
    return TabularPipeline(spec, area, facts).fit(train)


def evaluate_model(
    pipeline: PipelineModel, test: DataFrame, spec: TableSpec, area: WorkArea
) -> dict[str, float]:
    """Requested metrics on held-out rows, against the classes the model was fitted on."""
    scored = predict(pipeline, test, spec.features)
    wanted = [spec.target, "prediction"] + (["score"] if "score" in scored.columns else [])
    kept = area.table(scored.select(*map(quoted, wanted)), "scored")
    return evaluate_predictions(
        kept, spec.task, spec.metrics, spec.target, labels=known_labels(pipeline)
    )


def record_evidence(
    staged: Staged, reports: list[StageResult], outputs: Outputs, run_id: str
) -> None:
    """Append findings, stage totals and, for a classification, the shares of all classes."""
    spark, spec = staged.table.sparkSession, staged.spec
    tables = []
    if outputs.issues:
        tables.append((issues_frame(spark, reports).coalesce(1), outputs.issues))
    if outputs.stages:
        tables.append((stage_summary(spark, reports).coalesce(1), outputs.stages))
    if outputs.classes and spec.task == CLASSIFICATION and spec.target in staged.table.columns:
        tables.append((class_shares(staged.table, spec), outputs.classes))
    append_evidence([(table.withColumn("run_id", F.lit(run_id)), path) for table, path in tables])
