from __future__ import annotations

import random

import numpy as np
import pytest

from tabloom.llm import chosen_path
from tabloom.llm.components import components
from tests.llm.odd import dicts, documents, no_documents, odd_documents, prose


def shingles(text):
    words = text.split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    """doc_id -> (class_id, links, group_id), all pairs of texts compared."""
    classes = {}
    for i, text in rows:
        classes.setdefault(" ".join((text or "").split()), []).append(i)
    least = lambda ids: min(ids, key=lambda i: (i is None, i))
    texts = list(classes)
    sets, ids = [shingles(t) for t in texts], [least(classes[t]) for t in texts]
    links, group = [0] * len(texts), list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            union = len(sets[a]) + len(sets[b]) - both
            if union and both >= 0.8 * union - 1e-9:
                links[a] += 1
                links[b] += 1
                group = [group[b] if g == group[a] else g for g in group]
    out = {}
    for k, text in enumerate(texts):
        head = least([ids[j] for j in range(len(texts)) if group[j] == group[k]])
        for i in classes[text]:
            out.setdefault(i, set()).add((ids[k], links[k], head))
    return out


def found(docs, area):
    out = {}
    for r in dicts(chosen_path.join_similar(docs, area)):
        out.setdefault(r["doc_id"], set()).add((r["class_id"], r["links"], r["group_id"]))
    return out


def near_copies(seed: int, groups: int, copies: int, words: int = 120) -> list[str]:
    pick, texts = random.Random(seed), []
    for g in range(groups):
        base = prose(seed * 999 + g, words)
        for _ in range(copies):
            text = list(base)
            for _ in range(pick.randrange(6)):
                text[pick.randrange(len(text))] = f"new{pick.randrange(10**6)}"
            texts.append(" ".join(text))
    return texts


def test_against_brute_force(spark, area):
    texts = near_copies(1, 15, 5) + [" ".join(prose(i, 40)) for i in range(50)]
    texts += ["a b", "a  b", "a c", "", " ", "one two three four five"] * 2
    random.Random(2).shuffle(texts)
    docs = documents(spark, texts).repartition(5)
    assert found(docs, area) == brute(list(enumerate(texts)))


def test_large_leaves_are_compared_in_tiles(spark, area, monkeypatch):
    monkeypatch.setattr(chosen_path, "SMALL", 6)
    monkeypatch.setattr(chosen_path, "TILE", 16)
    texts = near_copies(3, 1, 90) + near_copies(4, 3, 10)
    assert found(documents(spark, texts), area) == brute(list(enumerate(texts)))


def test_shared_passage_does_not_link(spark, area):
    passage = prose(7, 30)
    texts = [" ".join(prose(100 + i, 100) + passage) for i in range(80)]
    assert all(v == {(i, 0, i)} for i, v in found(documents(spark, texts), area).items())


def test_recall_near_the_threshold(spark, area):
    """Pairs of similarity just above 0.8, each a group of its own."""
    texts = []
    for g in range(150):
        base = prose(5000 + g, 204)
        other = list(base)
        for at in (20, 60, 100, 140):  # 20 of 200 shingles differ: 180 / 220
            other[at] = "changed"
        texts += [" ".join(base), " ".join(other)]
    result = found(documents(spark, texts), area)
    linked = sum(next(iter(v))[1] for v in result.values()) / len(texts)
    assert linked >= 0.97


def test_runs_follow_the_target_recall():
    assert chosen_path.survival(0.8) < chosen_path.survival(0.9) < chosen_path.survival(1.0) <= 1
    for recall in (0.5, 0.9, 0.999):
        runs = chosen_path.runs_needed(recall)
        lost = 1 - chosen_path.survival(0.8)
        assert lost**runs <= 1 - recall < lost ** (runs - 1)


def test_runs_over_one_signature_reach_the_target_recall():
    """Trees over drawn sets of equal positions, against the expectation."""
    pick = np.random.default_rng(3)
    runs, pairs = chosen_path.shared_runs(), 20_000
    assert chosen_path.missed(runs) <= 0.001 < chosen_path.missed(runs - 1)
    equal = pick.random((pairs, chosen_path.POSITIONS)) < 0.8
    left = np.zeros((pairs, 64), dtype=np.uint32)
    right = np.where(equal, left, np.uint32(1))
    missed = np.ones(pairs, dtype=bool)
    for _ in range(runs):
        alive = [(np.arange(pairs), pick.integers(0, 2**63, pairs))]
        for _ in range(chosen_path.DEPTH):
            rows, paths = alive[0]
            at, ours = chosen_path.children(paths, left[rows])
            _, theirs = chosen_path.children(paths, right[rows])
            same = ours == theirs
            alive = [(rows[at[same]], ours[same])]
        missed[alive[0][0]] = False
    assert missed.mean() <= 0.0015


def test_signatures_estimate_similarity():
    sets = [chosen_path.shingle_set(t.encode()) for t in near_copies(9, 1, 2, 400)]
    real = len(np.intersect1d(*sets)) / len(np.union1d(*sets))
    own = [chosen_path.signature(s) for s in sets]
    assert abs((own[0] == own[1]).mean() - real) < 0.25


def test_odd_rows_and_empty_table(spark, area):
    docs = odd_documents(spark)
    rows = [(r["doc_id"], r["text"]) for r in dicts(docs)]
    result = dicts(chosen_path.join_similar(docs, area))
    assert len(result) == len(rows)
    assert found(docs, area) == brute(rows)
    assert found(no_documents(spark), area) == {}


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, area, seed):
    pick = random.Random(seed)
    edges = [(pick.randrange(60), pick.randrange(60)) for _ in range(40)]
    edges += [(100 + i, 101 + i) for i in range(30)] + [(200, 200 + i) for i in range(50)] + [(5, 5)]
    group = {n: n for e in edges for n in e}
    for _ in group:
        for a, b in edges:
            group[a] = group[b] = min(group[a], group[b])
    got = dicts(components(spark.createDataFrame(edges, "a long, b long"), area))
    linked = {n for a, b in edges if a != b for n in (a, b)}
    assert {r["node"]: r["root"] for r in got} == {n: group[n] for n in linked}
    assert len(got) == len(linked)
