from __future__ import annotations

import itertools

import pytest
from pyspark.sql import functions as F

from tabloom.llm import mixing
from tabloom.llm.common import whole_text, word_count
from tabloom.llm.queries import mix_sources
from tests.llm.odd import dicts, documents, no_documents, odd_documents, prose


def test_targets_are_capped_and_the_excess_reshared():
    targets = mixing.water_fill({"a": 10, "b": 100, "c": 300}, {"a": 5, "b": 2, "c": 1}, 600)
    assert targets == {"a": 20, "b": 200, "c": 380}
    assert mixing.water_fill({}, {}, 0) == {}


def least_cost(capacities, quotas, copies):
    """(most words, least cost) by trying every split, for tiny numbers."""
    arcs = [(p, s, c) for p in capacities for s in p if s in quotas for c in range(copies)]
    best = (0, 0)
    for amounts in itertools.product(*(range(min(capacities[p], quotas[s]) + 1) for p, s, _ in arcs)):
        used, got = {}, {}
        for (p, s, c), n in zip(arcs, amounts):
            used[p, c] = used.get((p, c), 0) + n
            got[s] = got.get(s, 0) + n
        if all(n <= capacities[p] for (p, _), n in used.items()) and all(n <= quotas[s] for s, n in got.items()):
            best = max(best, (sum(got.values()), -sum(n * 4**c for (_, c), n in used.items())))
    return best


@pytest.mark.parametrize(
    "capacities, quotas",
    [
        ({("a",): 1, ("a", "b"): 2}, {"a": 2, "b": 1}),
        ({("a", "b"): 2, ("b",): 1}, {"a": 1, "b": 2}),
        ({("a",): 1, ("b",): 1, ("a", "b"): 1}, {"a": 3, "b": 1}),
    ],
)
def test_flow_is_as_cheap_as_the_best_of_all(capacities, quotas):
    flows = mixing.cheapest_flow(capacities, quotas)
    got = {s: sum(n for _, t, _, n in flows if t == s) for s in quotas}
    cost = sum(n * 4**c for _, _, c, n in flows)
    assert all(got[s] <= quotas[s] for s in quotas)
    assert (sum(got.values()), -cost) == least_cost(capacities, quotas, mixing.MAX_COPIES)


def test_overlapping_sources_meet_their_quotas(spark, area):
    members = [["a"], ["a", "b"], ["b", "c"], ["c"]]
    rows = [(i, 10 + i % 7, members[i % 4]) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, size long, members array<string>")
    narrow = mixing.sized(docs, F.col("size"), F.col("members"), area)
    sizes = mixing.pattern_sizes(narrow)
    quotas = {"a": 900, "b": 1500, "c": 300}
    found = dicts(mixing.select_documents(narrow, mixing.cheapest_flow(sizes, quotas)))
    got = {}
    for row in found:
        assert 0 <= row["taken"] <= 2 * row["words"]
        assert row["taken"] == sum(r["words"] for r in row["routes"])
        for route in row["routes"]:
            assert route["source"] in row["members"]
            got[route["source"]] = got.get(route["source"], 0) + route["words"]
    assert got == quotas


def mix(docs, area):
    rows = mixing.sized(docs, word_count(whole_text()), F.array("source"), area)
    return mix_sources(rows)


def test_odd_rows_and_reruns(spark, area):
    docs = odd_documents(spark)
    first, again = (sorted(map(str, dicts(mix(docs, area)[0]))) for _ in range(2))
    assert first == again
    found = dicts(mix(docs, area)[0])
    assert len(found) == docs.count()
    assert all(r["taken"] <= 2 * r["words"] for r in found)
    assert sum(r["taken"] for r in found) == pytest.approx(1.5 * sum(r["words"] for r in found), abs=2)


def test_empty_table(spark, area):
    mixed, sources = mix(no_documents(spark), area)
    assert dicts(mixed) == [] and dicts(sources) == []


def test_hot_source_and_order_of_partitions(spark, area):
    texts = [" ".join(prose(i, 5 + i % 50)) for i in range(300)]
    docs = documents(spark, texts, ["hot", "hot", "hot", "b", None])
    key = lambda df: sorted((r["doc_id"], r["taken"]) for r in dicts(df))
    assert key(mix(docs, area)[0]) == key(mix(docs.repartition(7), area)[0])
