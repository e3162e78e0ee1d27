from __future__ import annotations

import re
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from tabloom.llm import content_sort
from tests.llm.odd import dicts, documents, no_documents, odd_documents


def expected(rows):
    """(doc_id, text) -> sorted (doc_id, keep_id, group_size, kept, sha)."""
    plain = [(i, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for i, t in rows]
    groups = {}
    for i, text in plain:
        groups.setdefault(text, []).append(i)
    out = []
    for text, ids in groups.items():
        order = sorted(ids, key=lambda i: (i is None, i))
        digest = sha256(text.encode()).hexdigest()
        out += [(i, order[0], len(ids), k == 0, digest) for k, i in enumerate(order)]
    return sorted(out, key=str)


def found(docs, area, **settings):
    rows = dicts(content_sort.content_sort(docs, area, **settings))
    names = ("keep_id", "group_size", "kept", "text_sha256")
    return sorted(((r["row"]["doc_id"], *(r[n] for n in names)) for r in rows), key=str)


def test_odd_rows(spark, area):
    docs = odd_documents(spark)
    assert found(docs, area) == expected([(r["doc_id"], r["text"]) for r in dicts(docs)])
    assert set(docs.columns) == set(dicts(content_sort.content_sort(docs, area))[0]["row"])


def test_empty_table(spark, area):
    assert found(no_documents(spark), area) == []


@pytest.mark.parametrize("rows_at_once", [1, 3, 1000])
def test_frequent_texts_are_dealt_out(spark, area, rows_at_once):
    texts = [["hot", "warm  text", f"own {i}", "warm text"][min(i % 7, 3) if i % 2 else 0] for i in range(300)]
    docs = documents(spark, texts).repartition(5)
    assert found(docs, area, rows_at_once=rows_at_once) == expected(list(enumerate(texts)))


def test_same_hash_and_prefix_do_not_make_texts_equal(spark, area, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(content_sort.F, "xxhash64", lambda *_: F.lit(1).cast("long"))
    texts = ["a shared beginning, then one"] * 4 + ["a shared beginning, then two"] * 3
    docs = documents(spark, texts)
    for rows_at_once in (2, 100):
        assert found(docs, area, rows_at_once=rows_at_once) == expected(list(enumerate(texts)))


def test_plan_sorts_ranges_and_runs_no_python(spark, area):
    docs = documents(spark, ["a", "b", "a"])
    plan = content_sort.content_sort(docs, area)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("ids", ["null", "one"])
def test_copies_that_share_an_id_or_have_none_are_dealt_out(spark, area, ids):
    """Half of all rows are one text: no range holds much more than its share of them."""
    rows = 20_000
    shared = F.lit(None).cast("long") if ids == "null" else F.lit(5).cast("long")
    text = F.when(F.col("id") % 2 == 0, F.lit("the same text")).otherwise(F.concat(F.lit("text "), F.col("id")))
    docs = spark.range(rows).select(F.when(F.col("id") % 2 == 0, shared).otherwise(F.col("id") + 10).alias("doc_id"), text.alias("text"))
    found = content_sort.content_sort(docs.repartition(6), area, rows_at_once=256)
    whole = found.filter("row.text = 'the same text'").agg(F.count(F.lit(1)), F.min("group_size"), F.max("group_size"), F.count_if("kept")).first()
    assert tuple(whole) == (rows // 2, rows // 2, rows // 2, 1)
    runs = next(p for p in area_tables(area) if "runs" in p)
    dealt = spark.read.parquet(runs).filter("salt >= 0").groupBy("salt").count().agg(F.count(F.lit(1)), F.max("count")).first()
    assert dealt[0] >= 30 and dealt[1] < 2 * rows / 2 / dealt[0]


def area_tables(area):
    from pathlib import Path

    return [str(path) for path in Path(area.path).iterdir()]
