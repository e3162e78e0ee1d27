from __future__ import annotations

import random
import re

import numpy as np
import pytest

from tabloom.llm import fm_index
from tests.llm.odd import dicts, documents, no_documents, odd_documents, prose


def brute(rows, width):
    """(doc_id, text) -> doc_id, n_words, n_removed, kept text; every row is a document."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    times = {}
    for ws in words:
        for i in range(len(ws) - width + 1):
            key = tuple(ws[i : i + width])
            times[key] = times.get(key, 0) + 1
    out = []
    for (doc_id, _), ws in zip(rows, words):
        gone = set()
        for i in range(len(ws) - width + 1):
            if times[tuple(ws[i : i + width])] > 1:
                gone.update(range(i, i + width))
        out.append((doc_id, len(ws), len(gone), " ".join(w for i, w in enumerate(ws) if i not in gone)))
    return sorted(out, key=str)


def found(docs, area, width, **settings):
    rows = dicts(fm_index.dedup_substrings(docs, area, width, **settings))
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["text"]) for r in rows), key=str)


def test_wavelet_matrix_ranks():
    pick = np.random.default_rng(1)
    values = pick.integers(0, 37, 500)
    matrix = fm_index.WaveletMatrix(values, 6)
    symbols, places = pick.integers(0, 37, 200), pick.integers(0, 501, 200)
    expected = [int((values[:p] == s).sum()) for s, p in zip(symbols, places)]
    assert matrix.rank(symbols, places).tolist() == expected


@pytest.mark.parametrize("width", [1, 3, 6, 34])
def test_suffix_array_and_classes(width):
    pick = random.Random(width)
    text = np.array([pick.randrange(1, 4) for _ in range(120)] + [0])
    order, classes, _ = fm_index.suffix_array(text, width)
    whole = sorted(range(len(text)), key=lambda i: text[i:].tolist())
    assert order.tolist() == whole
    starts = [tuple(text[i : i + width]) for i in whole]
    same = [a == b for a, b in zip(starts, starts[1:])]
    got = (classes[1:] == classes[:-1]).tolist()
    complete = [i + width < len(text) and j + width < len(text) for i, j in zip(whole, whole[1:])]
    assert [g for g, c in zip(got, complete) if c] == [s for s, c in zip(same, complete) if c]


def test_long_segments_are_searched_in_parts(monkeypatch):
    pick = random.Random(6)
    segments = [np.array([pick.randrange(2, 5) for _ in range(n)]) for n in (300, 90, 12, 9)]
    windows = np.array([len(s) - 8 for s in segments])
    found = []
    for lane in (1, 7, 1000):
        monkeypatch.setattr(fm_index, "LANE", lane)
        index = fm_index.FMIndex(segments, np.array([1, 1, 2, 1]), 9)
        found.append([f.tolist() for f in index.repeated(windows)])
    times = {}
    for s, weight in zip(segments, (1, 1, 2, 1)):
        for i in range(len(s) - 8):
            key = tuple(s[i : i + 9])
            times[key] = times.get(key, 0) + weight
    expected = [[times[tuple(s[i : i + 9])] > 1 for i in range(len(s) - 8)] for s in segments]
    assert found == [expected] * 3


def test_matching_lengths():
    pick = random.Random(5)
    segments = [np.array([pick.randrange(2, 6) for _ in range(30)]) for _ in range(6)]
    index = fm_index.FMIndex(segments, np.ones(6, dtype=int), 8)
    ends = np.concatenate([index.offsets[i] + np.arange(8, 31) for i in range(6)])
    lengths, _, _ = index.match(ends)
    joined = [s.tolist() for s in segments]

    def times(pattern):
        return sum(s[i : i + len(pattern)] == pattern for s in joined for i in range(len(s)))

    for end, length in zip(ends, lengths):
        lane = int(np.searchsorted(index.offsets, end, "right")) - 1
        at = int(end - index.offsets[lane])
        if at == 0 or at > 30:
            continue
        best = max(k for k in range(9) if k <= at and times(joined[lane][at - k : at]) > 1 or k == 0)
        assert length == best


@pytest.mark.parametrize("frequent, shard_words", [(4096, 200_000), (2, 200_000), (3, 40)])
@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, area, seed, frequent, shard_words):
    pick = random.Random(seed)
    passages = [prose(seed * 100 + p, pick.randrange(5, 30)) for p in range(5)]
    texts = []
    for d in range(80):
        words = prose(seed * 1000 + d, pick.randrange(30))
        at = pick.randrange(len(words) + 1)
        words[at:at] = pick.choice(passages)[pick.randrange(3) :]
        if d % 5 == 0:
            words += ["again"] * pick.randrange(25)
        if d % 7 == 0:
            words += ["la", "li", "lo"] * pick.randrange(12)
        texts.append((" " if d % 2 else "\n\t").join(words))
    texts += texts[:10] * 3
    settings = {"gram": 4, "frequent": frequent, "shard_words": shard_words}
    result = found(documents(spark, texts).repartition(4), area, 9, **settings)
    assert result == brute(list(enumerate(texts)), 9)
    assert any(0 < r[2] < r[1] for r in result)


def test_width_of_the_query(spark, area):
    passage = " ".join(prose(1, 60))
    texts = [f"{' '.join(prose(2, 50))} {passage} end", passage, " ".join(prose(3, 80)), " ".join(prose(1, 34))]
    result = found(documents(spark, texts), area, fm_index.WIDTH)
    assert result == brute(list(enumerate(texts)), fm_index.WIDTH)
    assert [r[2] for r in result] == [60, 60, 0, 0]


def test_rows_that_share_an_id_or_have_none_hold_their_own_keys_only(spark, area):
    texts = [" ".join(prose(i // 2, 30)) + f" end {i}" for i in range(80)]
    rows = [(None if i % 4 < 2 else 7, t) for i, t in enumerate(texts)] + [(7, texts[2])] * 20
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(docs, area, 9, gram=4) == brute(rows, 9)
    own = spark.read.parquet(f"{area.path}/own-*")
    lists = dicts(own.selectExpr("size(keys) AS n", "size(array_distinct(keys)) AS distinct"))
    assert len(lists) == len(texts)
    assert all(r["n"] == r["distinct"] <= 24 for r in lists)


def test_odd_rows_and_empty_table(spark, area):
    docs = odd_documents(spark)
    rows = [(r["doc_id"], r["text"]) for r in dicts(docs)]
    assert found(docs, area, fm_index.WIDTH) == brute(rows, fm_index.WIDTH)
    assert found(no_documents(spark), area, fm_index.WIDTH) == []
