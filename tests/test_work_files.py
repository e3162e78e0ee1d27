"""Work tables: files by rows, not by the partitions a shuffle has dealt them to."""

from __future__ import annotations

import contextlib
import os

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tabloom.llm.queries import mix_sources
from tabloom.sources import work
from tabloom.sources.work import WorkArea, for_files, gathered, numbers_for_files
from tests.llm.odd import prose


@contextlib.contextmanager
def settings(spark, **values):
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def files(folder: str) -> int:
    return sum(name.startswith("part-") for name in os.listdir(folder))


def test_gathered_keeps_rows_and_never_adds_partitions(spark):
    cores = spark.sparkContext.defaultParallelism
    for rows, partitions, each, expected in [
        (500, 211, 100, 2 * cores),
        (100 * 100, 211, 100, max(100, 2 * cores)),
        (0, 211, 100, 2 * cores),
        (10**9, 37, 100, 37),
    ]:
        table = spark.range(500).repartition(partitions, "id")
        found = gathered(table, rows, each)
        assert found.rdd.getNumPartitions() == min(expected, partitions)
        assert found.agg(F.sum("id"), F.count("id")).first() == (500 * 499 // 2, 500)


@pytest.mark.parametrize("name", ["exact", "near", "mixing"])
def test_few_rows_in_many_partitions_make_few_files(spark, tmp_path, monkeypatch, name):
    """A writer of a file on a local disk starts two processes: 3,220 files for 40,000 documents in near."""
    written = {}
    table = WorkArea.table

    def counted(self, df, label, partition_by=()):
        found = table(self, df, label, partition_by)
        folder = found.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file://")
        written[f"{label}-{len(written)}"] = files(folder)
        return found

    monkeypatch.setattr(WorkArea, "table", counted)
    texts = [" ".join(prose(i // 2, 40)) + (" more" if i % 2 else "") for i in range(300)]
    rows = [(i, text, "en", "ab"[i % 2], len(text)) for i, text in enumerate(texts + texts[:50])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    with settings(
        spark,
        spark__sql__shuffle__partitions="61",
        spark__sql__adaptive__coalescePartitions__enabled="false",
    ):
        stage = dict(corpus_pipeline.STAGES)[name]
        found = stage(spark, docs, str(tmp_path))
        found.write.parquet(str(tmp_path / "out"))
        written["result"] = files(str(tmp_path / "out"))
    least = 2 * spark.sparkContext.defaultParallelism
    assert least < 61
    assert {k: n for k, n in written.items() if n > least} == {}
    kept = sorted(r[0] for r in spark.read.parquet(str(tmp_path / "out")).select("doc_id").distinct().collect())
    if name == "exact":
        assert kept == list(range(300))
    elif name == "near":
        assert 0 in kept and set(kept) <= set(range(350)) and len(kept) < 350


def test_mixing_plans_start_no_python_processes(spark, area):
    """The plan and the sources are local tables; lists of rows were an RDD that Python workers pickle."""
    rows = spark.createDataFrame([(1, 5, ["a"]), (2, 3, [None])], "doc_id long, words long, members array<string>")
    mix, sources = mix_sources(area.table(rows, "rows"))
    for found in (mix, sources):
        assert "ExistingRDD" not in found._jdf.queryExecution().executedPlan().toString()
    assert sources.dtypes == [("source", "string"), ("source_size", "bigint"), ("target", "double")]
    assert {r["source"]: r["source_size"] for r in sources.collect()} == {"a": 5, None: 3}
    assert {r["doc_id"]: r["taken"] > 0 for r in mix.collect()} == {1: True, 2: True}


def test_held_tables_are_computed_once_and_make_no_files(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    with WorkArea(spark, "held") as area:
        held = area.held(spark.range(500).repartition(23).mapInArrow(count, "id long"))
        assert seen.value == 500
        for _ in range(2):
            assert held.agg(F.sum("id"), F.count("id")).first() == (500 * 499 // 2, 500)
        assert seen.value == 500
        assert held.storageLevel.useDisk and not held.storageLevel.useMemory
        assert not os.path.exists(area.path)
    assert not held.storageLevel.useDisk
    assert held.count() == 500  # from its lineage


def test_files_are_large_and_never_add_partitions(spark, monkeypatch):
    monkeypatch.setattr(work, "ROWS_PER_FILE", 100)
    monkeypatch.setattr(work, "NUMBERS_PER_FILE", 100)
    cores = spark.sparkContext.defaultParallelism
    for rows, partitions in [(0, 211), (500, 211), (100 * 100, 211), (10**9, 37)]:
        table = spark.range(500).repartition(partitions, "id")
        for make, least in ((for_files, cores), (numbers_for_files, 1)):
            found = make(table, rows)
            assert found.rdd.getNumPartitions() == min(max(least, -(-rows // 100)), partitions)
            assert found.agg(F.sum("id"), F.count("id")).first() == (500 * 499 // 2, 500)


@pytest.mark.parametrize("name, tables", [("exact", 1), ("near", 1), ("mixing", 0), ("packing", 0)])
def test_stages_write_files_for_no_more_than_one_task_a_core(spark, tmp_path, monkeypatch, name, tables):
    """Few documents: `tables` with a file a core besides the result, else one file each.

    Mixing was stopped on 0.1 GB: the child that sets a file's mode counted with all of its executor's memory.
    """
    written = []
    table = WorkArea.table

    def counted(self, df, label, partition_by=()):
        found = table(self, df, label, partition_by)
        written.append((label, len(found.inputFiles())))
        return found

    monkeypatch.setattr(WorkArea, "table", counted)
    texts = [" ".join(prose(i // 2, 40)) + (" more" if i % 2 else "") for i in range(300)]
    rows = [(i, text, "en", "ab"[i % 2], len(text)) for i, text in enumerate(texts + texts[:50])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(61).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    with settings(
        spark,
        spark__sql__shuffle__partitions="61",
        spark__sql__adaptive__coalescePartitions__enabled="false",
        spark__sql__files__openCostInBytes="64m",
        spark__sql__files__maxPartitionBytes="64m",
    ):
        assert docs.rdd.getNumPartitions() == 61
        dict(corpus_pipeline.STAGES)[name](spark, docs, str(tmp_path)).write.parquet(str(tmp_path / "out"))
    cores = spark.sparkContext.defaultParallelism
    assert files(str(tmp_path / "out")) <= cores
    assert [n for _, n in written if n > cores] == []
    assert sum(n > 1 for _, n in written) <= tables, written
    assert len([label for label, _ in written if label != "edges"]) <= 9
    found = spark.read.parquet(str(tmp_path / "out"))
    if name == "packing":
        whole = found.groupBy("sequence_id").agg(F.count_distinct("offset") == F.count(F.lit(1)))
        assert found.filter("start = 0").count() == 350 and whole.filter(f"NOT `{whole.columns[1]}`").isEmpty()
    else:
        assert set(found.columns) == set(docs.columns)


def test_stages_write_small_row_groups(spark, tmp_path, monkeypatch):
    """A row group is held whole by its writer and its reader, however large the file is."""
    monkeypatch.setattr(corpus_pipeline, "ROW_GROUP_BYTES", 1 << 16)
    rows = [(i, " ".join(prose(i, 400)), "en", "a", 1) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "docs"))
    before = spark.conf.get("parquet.block.size", None)
    for given, groups in ((None, True), (str(128 << 20), False)):
        spark.conf.unset("parquet.block.size") if given is None else spark.conf.set("parquet.block.size", given)
        try:
            found = corpus_pipeline.without_copies(spark, spark.read.parquet(str(tmp_path / "docs")), str(tmp_path))
            found.coalesce(1).write.parquet(str(tmp_path / f"out-{groups}"))
        finally:
            spark.conf.unset("parquet.block.size") if before is None else spark.conf.set("parquet.block.size", before)
        (path,) = (tmp_path / f"out-{groups}").glob("part-*")
        assert (pq.ParquetFile(path).num_row_groups > 1) == groups
        assert pq.ParquetFile(path).metadata.num_rows == 900
