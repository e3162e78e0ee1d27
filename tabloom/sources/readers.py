"""Loading tables with pandas-like missing values and column types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.functions.columns import missing_to_null, quoted
from tabloom.sources.work import path_exists

# The texts a CSV cell may hold to mean "missing".
CSV_MISSING = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
# The texts a CSV boolean column may hold.
CSV_TRUE = ("True", "TRUE", "true")
CSV_FALSE = ("False", "FALSE", "false")

# Stands behind the columns of the header and takes what a longer row has there.
SURPLUS = "__surplus"

INTEGER_TEXT = r"^[+-]?[0-9]+$"
NUMBER_TEXT = r"(?i)^[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?|inf|infinity)$"


def load_dataset(
    spark: SparkSession,
    path: str,
    fmt: str = "csv",
    separator: str = ",",
    schema: T.StructType | None = None,
    multiline: bool = False,
) -> DataFrame:
    """Read a table; NaN is NULL afterwards whatever the format.

    A CSV without a schema is read as text and typed by one aggregate over the file.
    Pass `schema` to skip that pass.
    """
    if not path_exists(spark, path):
        raise FileNotFoundError(f"no dataset at {path}")
    if fmt != "csv":
        reader = spark.read.format(fmt)
        return missing_to_null((reader.schema(schema) if schema else reader).load(path))
    text = _read_csv_text(spark, path, separator, multiline)
    if schema is None:
        return _apply_types(text, infer_types(text))
    return _apply_types(text, {f.name: f.dataType for f in schema.fields})


def _read_csv_text(spark: SparkSession, path: str, separator: str, multiline: bool) -> DataFrame:
    """All columns as text. A row with more fields than the header is refused by file name."""
    settings = {"sep": separator, "header": True, "escape": '"', "multiLine": multiline}
    names = spark.read.csv(path, inferSchema=False, **settings).columns
    fields = [T.StructField(name, T.StringType()) for name in (*names, SURPLUS)]
    raw = spark.read.csv(path, schema=T.StructType(fields), enforceSchema=True, **settings)
    ragged = raw.filter(quoted(SURPLUS).isNotNull()).select(F.input_file_name()).limit(1).collect()
    if ragged:
        raise ValueError(f"a row has more than the {len(names)} fields of the header in {ragged[0][0]}")
    return raw.select(
        *(F.when(~quoted(name).isin(*CSV_MISSING), quoted(name)).alias(name) for name in names)
    )


def infer_types(text: DataFrame) -> dict[str, T.DataType]:
    """Type of every text column, from one aggregate over the table.

    Whole numbers become bigint unless some are missing, as a missing value makes the
    column floating; other numbers are double; complete True/False columns are boolean.
    """
    aggregates: list[Column] = [F.count(F.lit(1)).alias("rows")]
    for index, name in enumerate(text.columns):
        value = quoted(name)
        trimmed = F.trim(value)
        whole = trimmed.rlike(INTEGER_TEXT) & trimmed.try_cast("bigint").isNotNull()
        aggregates += [
            F.count(value).alias(f"present_{index}"),
            F.count_if(whole).alias(f"whole_{index}"),
            F.count_if(trimmed.rlike(NUMBER_TEXT)).alias(f"number_{index}"),
            F.count_if(value.isin(*CSV_TRUE, *CSV_FALSE)).alias(f"flag_{index}"),
        ]
    found = text.agg(*aggregates).first()
    return {name: _type_of(found, index) for index, name in enumerate(text.columns)}


def _type_of(found: T.Row, index: int) -> T.DataType:
    present = found[f"present_{index}"]
    complete = present == found["rows"]
    if present == 0:
        return T.DoubleType()
    if found[f"whole_{index}"] == present and complete:
        return T.LongType()
    if found[f"number_{index}"] == present:
        return T.DoubleType()
    if found[f"flag_{index}"] == present and complete:
        return T.BooleanType()
    return T.StringType()


def _apply_types(text: DataFrame, types: dict[str, T.DataType]) -> DataFrame:
    typed = []
    for name in text.columns:
        dtype = types.get(name, T.StringType())
        value = quoted(name)
        if not isinstance(dtype, T.StringType):
            value = F.trim(value).try_cast(dtype)
        typed.append(value.alias(name))
    return missing_to_null(text.select(*typed))
