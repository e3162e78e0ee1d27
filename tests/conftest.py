from __future__ import annotations

import contextlib
import os
import sys
from pathlib import Path

import pandas as pd
import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from tabloom import TableSpec  # noqa: E402
from tabloom.sources.work import WorkArea  # noqa: E402

DATA = Path("/root/testdata")


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master(f"local[{os.environ.get('TEST_CPUS', '8')}]")
        .appName("tests")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture
def area(spark):
    with WorkArea(spark, "test") as held:
        yield held


def batches(rows: int = 210) -> pd.DataFrame:
    """Dairy batches in the order they were made; sour ones follow from vessel, acid and days."""
    i = pd.Series(range(rows))
    vessel = (i * 11 % 17).map(lambda k: ("steel", "glass", "oak")[0 if k < 9 else 1 if k < 13 else 2])
    acid, days = i * 83 % 199 / 20, i * 31 % 23
    sour = ((vessel == "oak") & (days > 7)) | (acid > 7.5)
    return pd.DataFrame({"made": i, "acid": acid, "days": days, "vessel": vessel, "sour": sour.astype(int)})


def batch_spec(**changes) -> TableSpec:
    settings = {
        "target": "sour",
        "numerical": ("acid", "days"),
        "categorical": ("vessel",),
        "id_cols": ("made",),
        "test_size": 0.3,
        "params": {"n_estimators": 8, "max_depth": 3},
        "metrics": ("recall", "accuracy", "average_precision"),
        "min_rows": 40,
    }
    return TableSpec(**{**settings, **changes})


def frame(spark, columns: dict, schema: str):
    return spark.createDataFrame(list(zip(*columns.values(), strict=True)), schema)


@contextlib.contextmanager
def fixed_tasks(spark, tasks: int):
    """So many tasks a shuffle, none merged or split, and no broadcast that was not asked for."""
    wanted = {
        "spark.sql.shuffle.partitions": str(tasks),
        "spark.sql.adaptive.enabled": "false",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
    }
    before = {name: spark.conf.get(name) for name in wanted}
    try:
        for name, value in wanted.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def rows_by_task(df, made: str) -> list[int]:
    """Rows in each task of the last stage; the column `made` there is read, so it is not pruned."""
    counted = df.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("rows"), F.max(made))
    return [row["rows"] for row in counted.collect()]
