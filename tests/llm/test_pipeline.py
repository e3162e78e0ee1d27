"""The pipeline's stages against plain Python, and all of it end to end."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tabloom.llm import mixing, quality
from tabloom.llm.common import whole_text, word_count
from tabloom.llm.queries import mix_sources
from tests.conftest import DATA
from tests.llm.odd import dicts, no_documents, odd_documents, prose
from tests.llm.test_chosen_path import brute as brute_groups
from tests.llm.test_content_sort import expected as brute_copies

SMALL = str(DATA / "sf0.001")
STAGES = dict(corpus_pipeline.STAGES)

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no driver tables")


def test_stages_keep_the_columns_and_agree_with_plain_python(spark, area):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    model = quality.fit_quality(docs, labels)
    rows = {r["doc_id"]: r for r in dicts(docs)}

    good = area.table(STAGES["quality"](spark, docs, SMALL), "good")
    assert good.columns == docs.columns
    scores = model.probability(quality.table_of([r["text"] or "" for r in rows.values()]))
    kept = {i for i, s in zip(rows, scores) if s >= quality.THRESHOLD}
    assert {r["doc_id"] for r in dicts(good)} == kept

    once = area.table(STAGES["exact"](spark, good, SMALL), "once")
    kept = {r[0] for r in brute_copies([(i, rows[i]["text"]) for i in kept]) if r[3]}
    assert once.columns == docs.columns
    assert sorted(map(str, dicts(once))) == sorted(str(rows[i]) for i in kept)

    apart = area.table(STAGES["near"](spark, once, SMALL), "apart")
    groups = brute_groups([(i, rows[i]["text"]) for i in kept])
    kept = {i for i in kept if next(iter(groups[i]))[2] == i}
    assert sorted(map(str, dicts(apart))) == sorted(str(rows[i]) for i in kept)

    mixed = area.table(STAGES["mixing"](spark, apart, SMALL), "mixed")
    assert mixed.columns == docs.columns
    size = lambda r: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
    times = {}
    for r in dicts(mixed):
        assert r == rows[r["doc_id"]]
        times[r["doc_id"]] = times.get(r["doc_id"], 0) + 1
    assert set(times) <= kept and max(times.values()) <= 2
    total = sum(size(rows[i]) for i in kept)
    largest = max(size(rows[i]) for i in kept)
    sources = {rows[i]["source"] for i in kept}
    assert abs(sum(size(rows[i]) * n for i, n in times.items()) - 1.5 * total) <= largest * len(sources)

    packed = dicts(STAGES["packing"](spark, mixed, SMALL))
    whole = [r for r in packed if r["start"] == 0]
    assert len(whole) == sum(times.values())
    assert sum(r["length"] for r in packed) == sum(r["doc_tokens"] for r in whole)


def test_mixing_counts_rows_that_share_an_id_on_their_own(spark, area):
    ids = [None, 7, 7, 8]
    rows = [(ids[i % 4], " ".join(prose(i, 5 + i % 30)), "en", "abc"[i % 3], i) for i in range(240)]
    rows += [(9, "three equal rows", "en", "a", i) for i in range(3)] + [(10, " ", "en", "a", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    narrow = mixing.sized(docs, word_count(whole_text()), F.array("source"), area, F.col("text"))
    expected = {}
    for r in dicts(mix_sources(narrow)[0]):
        key = (r["doc_id"], r["text"], r["members"][0])
        expected[key] = expected.get(key, 0) + (int(r["taken"] / r["words"] + 0.5) if r["words"] else 0)
    got = {}
    for r in dicts(STAGES["mixing"](spark, docs, SMALL)):
        key = (r["doc_id"], r["text"], r["source"])
        got[key] = got.get(key, 0) + 1
    differ = {k for k in expected.keys() | got.keys() if expected.get(k, 0) != got.get(k, 0)}
    assert not differ
    assert {expected[r[0], r[1], r[3]] for r in rows if r[0] is None} >= {1, 2}


def test_run_gives_sequences(spark):
    rows = dicts(corpus_pipeline.run(spark, SMALL))
    assert rows and {"doc_id", "sequence_id", "offset", "ids"} <= set(rows[0])


@pytest.mark.parametrize("name", STAGES)
def test_odd_rows_and_empty_tables(spark, area, name):
    docs = odd_documents(spark).select("doc_id", "text", "lang", "source", "n_chars")
    for table in (docs, no_documents(spark).select(docs.columns)):
        found = area.table(STAGES[name](spark, table, SMALL), name)
        assert name == "packing" or found.columns == docs.columns
        assert found.count() <= 2 * docs.count() or name == "packing"
    extra = odd_documents(spark)
    found = area.table(STAGES[name](spark, extra, SMALL), name)
    assert name == "packing" or found.columns == extra.columns
