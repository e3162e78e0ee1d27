from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tabloom.sources.readers import load_dataset
from tabloom.sources.work import WorkArea, path_exists
from tabloom.sources.writers import save_dataset, save_metrics

from tests.conftest import frame


def write_text(tmp_path, text):
    path = tmp_path / "table.csv"
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_csv_types_follow_the_values(spark, tmp_path):
    path = write_text(
        tmp_path,
        "whole,gaps,real,flag,text,day,empty,big\n"
        "1,1,1.5,True,x,2020-01-01,,1\n"
        "2,NA,inf,False,1d,2020-01-02,NA,99999999999999999999\n"
        '+3, 4 ,-2e3,true,"a, ""b""",2020-01-03,null,2\n',
    )
    table = load_dataset(spark, path)
    assert dict(table.dtypes) == {
        "whole": "bigint", "gaps": "double", "real": "double", "flag": "boolean",
        "text": "string", "day": "string", "empty": "double", "big": "double",
    }
    rows = table.collect()
    assert [row["whole"] for row in rows] == [1, 2, 3]
    assert [row["gaps"] for row in rows] == [1.0, None, 4.0]
    assert [row["real"] for row in rows] == [1.5, float("inf"), -2000.0]
    assert rows[2]["text"] == 'a, "b"'
    assert [row["empty"] for row in rows] == [None] * 3


def test_missing_tokens_become_null(spark, tmp_path):
    path = write_text(tmp_path, "a,b\nN/A,x\n#N/A,None\nNaN,<NA>\n")
    rows = load_dataset(spark, path).collect()
    assert [tuple(row) for row in rows] == [(None, "x"), (None, None), (None, None)]


def test_a_row_longer_than_the_header_is_refused_by_file(spark, tmp_path):
    path = write_text(tmp_path, "a,b\n1,2\n3,4,5\n")
    for schema in (None, spark.createDataFrame([], "a int, b int").schema):
        with pytest.raises(ValueError, match="more than the 2 fields.*table.csv"):
            load_dataset(spark, path, schema=schema)
    short = write_text(tmp_path, "a,b\n1,2\n3\n")
    assert sorted(map(tuple, load_dataset(spark, short).collect())) == [(1, 2.0), (3, None)]


def test_separator_and_given_schema(spark, tmp_path):
    path = write_text(tmp_path, "a;b\n1;2\n3;x\n")
    assert load_dataset(spark, path, separator=";").columns == ["a", "b"]
    schema = spark.createDataFrame([], "a double, b bigint").schema
    rows = load_dataset(spark, path, separator=";", schema=schema).collect()
    assert [tuple(row) for row in rows] == [(1.0, 2), (3.0, None)]


def test_missing_file_is_a_named_error(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="absent.csv"):
        load_dataset(spark, str(tmp_path / "absent.csv"))


@pytest.mark.parametrize("fmt", ["parquet", "json", "orc"])
def test_other_formats_read_nan_as_missing(spark, tmp_path, fmt):
    path = str(tmp_path / fmt)
    table = frame(spark, {"a": [1.0, float("nan"), -0.0], "b": ["x", "y", "z"]}, "a double, b string")
    save_dataset(table, path, fmt)
    schema = table.schema if fmt == "json" else None
    found = load_dataset(spark, path, fmt, schema=schema).orderBy("b").collect()
    assert [row["a"] for row in found] == [1.0, None, 0.0]
    assert str(found[2]["a"]) == "0.0"


def test_csv_and_parquet_round_trips_agree(spark, tmp_path):
    table = frame(
        spark, {"n": [1, 2, 3], "x": [0.5, None, float("inf")], "s": ['q"q', "a,b", None]},
        "n bigint, x double, s string",
    )
    save_dataset(table, str(tmp_path / "p"))
    save_dataset(table, str(tmp_path / "c"), "csv")
    parquet = load_dataset(spark, str(tmp_path / "p"), "parquet").orderBy("n").collect()
    assert parquet == load_dataset(spark, str(tmp_path / "c")).orderBy("n").collect()


def test_runs_accumulate(spark, tmp_path):
    path = str(tmp_path / "runs")
    for value in (0.75, 0.5):
        context = {"task": "classification", "params": {"C": 2}, "train_rows": 3, "test_rows": 1}
        save_metrics(spark, {"accuracy": value}, path, context)
    runs = spark.read.parquet(path)
    assert runs.count() == runs.select("run_id").distinct().count() == 2
    assert {row["metrics"]["accuracy"] for row in runs.collect()} == {0.75, 0.5}
    assert runs.filter(F.col("params")["C"] == "2").count() == 2


def test_work_area_is_deleted_afterwards(spark):
    with WorkArea(spark, "unit") as area:
        table = area.table(spark.range(5), "numbers")
        assert table.count() == 5
        assert path_exists(spark, area.path)
    assert not path_exists(spark, area.path)
