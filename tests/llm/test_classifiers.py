from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.llm import boosting, quality, toxicity
from tabloom.llm.labelled import training_sample
from tabloom.llm.queries import QUERIES
from tests.conftest import DATA
from tests.llm.odd import dicts, documents, no_documents, odd_documents

LARGE = str(DATA / "sf0.1")


def auc(score, label):
    order = np.argsort(score, kind="stable")
    values, index, counts = np.unique(score[order], return_inverse=True, return_counts=True)
    rank = (counts.cumsum() - (counts - 1) / 2)[index]
    ones = label[order] == 1
    return (rank[ones].sum() - ones.sum() * (ones.sum() + 1) / 2) / (ones.sum() * (~ones).sum())


@pytest.mark.skipif(not DATA.exists(), reason="no driver tables")
@pytest.mark.parametrize("name, label, least", [("op9_quality", "quality", 0.99), ("op7_toxicity", "toxic", 0.9)])
def test_held_out_accuracy(spark, name, label, least):
    scored = QUERIES[name](spark, LARGE)
    docs = spark.read.parquet(f"{LARGE}/documents.parquet")
    assert scored.count() == docs.count()
    labels = spark.read.parquet(f"{LARGE}/labels.parquet").select("doc_id", label)
    held = scored.filter("held_out").join(labels, "doc_id").toPandas()
    assert auc(held["score"].to_numpy(), held[label].to_numpy()) > least
    assert held["score"].between(0, 1).all()


def labels(spark, docs):
    rows = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    return rows.withColumn("toxic", F.col("quality"))


TEXTS = [
    f"the cat number {i} sat on the mat and looked around." if i % 2 else f"$$$ buy{i} NOW!!! trash idiot {i}"
    for i in range(120)
]
FITS = {
    "quality": (lambda d, l, a: quality.fit_quality(d, l), quality.score_quality),
    "toxic": (lambda d, l, a: toxicity.fit_toxicity(d, l, a), toxicity.score_toxicity),
}


@pytest.mark.parametrize("kind", FITS)
def test_odd_rows_get_scores(spark, area, kind):
    fit, score = FITS[kind]
    docs = documents(spark, TEXTS)
    model = fit(docs, labels(spark, docs), area)
    odd = odd_documents(spark)
    found = dicts(score(odd, model))
    assert sorted(str(r["doc_id"]) for r in found) == sorted(str(r["doc_id"]) for r in dicts(odd))
    assert all(0 <= r["score"] <= 1 and r["held_out"] is not None for r in found)
    assert dicts(score(no_documents(spark), model)) == []
    blank = {round(r["score"], 12) for r in found if r["doc_id"] in (0, 1, 9)}
    assert len(blank) == 1


@pytest.mark.parametrize("kind", FITS)
def test_no_labels_and_one_class(spark, area, kind):
    fit, score = FITS[kind]
    docs = documents(spark, TEXTS)
    none = labels(spark, docs).limit(0)
    assert {r["score"] for r in dicts(score(docs, fit(docs, none, area)))} == {0.5}
    ones = labels(spark, docs).withColumns({"quality": F.lit(1), "toxic": F.lit(1)})
    assert all(r["score"] > 0.5 for r in dicts(score(docs, fit(docs, ones, area))))


def test_training_rows_leave_out_the_held_out_and_unlabelled(spark):
    docs = documents(spark, TEXTS)
    marked = labels(spark, docs).withColumn("quality", F.when(F.col("doc_id") < 10, F.col("quality")))
    ids = {r["doc_id"] for r in dicts(training_sample(docs, marked, "quality"))}
    held = {r["doc_id"] for r in dicts(docs.filter("crc32(cast(doc_id as string)) % 5 = 0"))}
    assert ids == set(range(10)) - held


def test_sample_is_bounded(spark):
    docs = documents(spark, [str(i) for i in range(5000)])
    rows = dicts(training_sample(docs, labels(spark, docs), "quality", 500))
    assert 350 < len(rows) < 650
    rare = labels(spark, docs).withColumn("toxic", (F.col("doc_id") % 50 == 1).cast("int"))
    rows = dicts(training_sample(docs, rare, "toxic", 500, balanced=True))
    assert 60 < sum(r["label"] for r in rows) <= 100 and 150 < len(rows) < 420


def test_trees_learn_a_rule_and_match_a_plain_walk():
    pick = np.random.default_rng(1)
    rows = pick.normal(size=(3000, 4))
    label = ((rows[:, 0] > 0.3) ^ (rows[:, 2] < -0.5)).astype(float)
    model = boosting.fit(rows[:2000], label[:2000])
    assert ((model.probability(rows[2000:]) >= 0.5) == label[2000:]).mean() > 0.95

    def walk(row):
        total, inner = model.base, model.feature.shape[1]
        for t in range(len(model.leaf)):
            node = 0
            while node < inner:
                node = 2 * node + 1 + (row[model.feature[t, node]] > model.cut[t, node])
            total += model.leaf[t, node - inner]
        return total

    assert np.allclose(model.margin(rows[:50]), [walk(r) for r in rows[:50]])


def test_windows_cover_the_whole_text():
    text = "äöü " * 50 + "x" * 200 + " end of it"
    joined = b"".join(w.strip() for w in toxicity.windows(text))
    assert joined.replace(b" ", b"") == text.lower().encode().replace(b" ", b"")
    assert toxicity.windows("") == [b""]


def test_copies_do_not_make_their_words_typical(spark, area):
    copied = "qzxword " + " ".join(f"c{i}" for i in range(30))
    rows = [(1, copied)] * 40 + [(1, f"a{i} insult b{i} c{i}") for i in range(40)]
    rows += [(0, f"plain{i} text{i} more") for i in range(80)]
    sample = spark.createDataFrame(rows, "label int, text string")
    ordinary, toxic = toxicity.train_dictionaries(sample, area)
    assert b" insult" in toxic and b"qzx" not in toxic and b" insult" not in ordinary


def test_dictionaries_are_trained_on_their_class_and_repeat(spark, area):
    rows = [(1, f"w{i} insult v{i} odd{i}") for i in range(300)] + [(1, None), (0, None), (0, "")]
    rows += [(0, f"plain{i % 7} text{i} more of it and quite a few words") for i in range(300)]
    sample = spark.createDataFrame(rows, "label int, text string")
    ordinary, toxic = toxicity.train_dictionaries(sample, area)
    again = toxicity.train_dictionaries(sample.repartition(5), area)
    assert (ordinary, toxic) == again and len(ordinary) == len(toxic)
    window = b" that insult and the insult of it "
    plain, marked = toxicity.Distance(ordinary, toxic).compress
    assert len(marked(window)) < len(plain(window))
    assert b" of it and" in ordinary
    only = toxicity.train_dictionaries(sample.filter("label = 0"), area)
    assert only[0] == only[1]
    assert toxicity.train_dictionaries(sample.limit(0), area) == (b"", b"")


def brute_features(text, ordinary, toxic):
    """The features from one compression at a time, without held state."""
    import zstandard

    settings = zstandard.ZstdCompressionParameters(**toxicity._SETTINGS)

    def size(window, content):
        held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return len(zstandard.ZstdCompressor(dict_data=held, compression_params=settings).compress(window))

    saved = [size(w, ordinary) - size(w, toxic) for w in toxicity.windows(text)]
    best = sorted(saved, reverse=True)[:3]
    return [
        max(saved), sum(best), sum(saved) / len(saved),
        sum(s >= 3 for s in saved) / len(saved), sum(s >= 5 for s in saved) / len(saved),
        sum(s >= 3 for s in saved), sum(s >= 5 for s in saved),
        sum(max(0, s - 2) for s in saved), np.log1p(len(saved)),
    ]


def test_features_against_single_compressions():
    ordinary, toxic = b" and the words that all of them use ", b" fool and clown that you are "
    texts = ["", "the words that you use, clown", "fool " * 200, "x" * 5000, "äöü clown " * 30]
    found = toxicity.Distance(ordinary, toxic).table(texts)
    assert np.allclose(found, [brute_features(t, ordinary, toxic) for t in texts])
