"""From a raw table to usable rows, shared by all workflows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.functions.columns import missing_to_null, quoted, row_key
from tabloom.operators.clean import encode_target, usable_rows, validate_columns
from tabloom.operators.quality import (
    COPIES,
    PROCESSED,
    RAW,
    StageResult,
    count_copies,
    validate_dataset,
)
from tabloom.operators.split import ROW_KEY
from tabloom.sources.work import WorkArea
from tabloom.spec import TableSpec


@dataclass(frozen=True)
class Staged:
    """Distinct rows with copy counts, narrowed to what later steps read."""

    table: DataFrame
    spec: TableSpec
    raw_columns: int

    def raw_report(self) -> StageResult:
        return validate_dataset(self.table, self.spec, RAW, columns=self.raw_columns)

    def cleaned(self) -> DataFrame:
        """Usable rows with their row key and order columns."""
        rows = self.table.drop(COPIES)
        spec = self.spec
        validate_columns(rows, spec.modelling_columns)
        return usable_rows(rows, spec.modelling_columns, spec.target, spec.value_ranges)

    def processed_report(self) -> StageResult:
        return validate_dataset(narrowed(self.cleaned(), self.spec), self.spec, PROCESSED)


def stage(raw: DataFrame, spec: TableSpec, area: WorkArea) -> Staged:
    """Encode labels and shuffle the wide table once, for raw checks and cleaning alike.

    Columns that place or identify rows must exist; absent modelling columns are left for
    the schema check to report.
    """
    validate_columns(raw, [*spec.id_cols, *spec.order_by])
    if spec.target in raw.columns:
        raw = encode_target(raw, spec.target, spec.target_mapping)
    plain = missing_to_null(raw)
    keyed = plain.withColumn(ROW_KEY, row_key(plain, spec.id_cols))
    kept = [
        name
        for name in dict.fromkeys([*spec.modelling_columns, *spec.order_by, *spec.id_cols])
        if name in raw.columns
    ]
    table = area.table(count_copies(keyed, [*kept, ROW_KEY]), "staged")
    return Staged(table, spec, len(raw.columns))


def narrowed(df: DataFrame, spec: TableSpec) -> DataFrame:
    return df.select(*map(quoted, spec.modelling_columns))


def prepared_data(raw: DataFrame, spec: TableSpec, area: WorkArea) -> DataFrame:
    """The rows training would use, without the quality gate."""
    validate_columns(raw, spec.modelling_columns)
    return stage(raw, spec, area).cleaned()


def staged_key():
    return F.col(ROW_KEY)
