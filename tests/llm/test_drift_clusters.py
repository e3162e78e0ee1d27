"""K-means against plain rounds over all pairs in exact integers."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest

from tabloom.llm.drift_clusters import cluster_vectors, nearer_by

SCHEMA = "vec_id long, embedding array<double>, cluster string, distance string, inertia string, cells string, id string"


def plain(rows, dimensions, clusters, rounds):
    """(vec_id, cluster, distance, cluster inertia, inertia, digest) of each vector, sorted."""
    kept = []
    for vec_id, vector in rows:
        if vector is not None and len(vector) == dimensions and all(x is not None and math.isfinite(x) for x in vector):
            kept.append((vec_id, [math.floor(64 * x) for x in vector]))

    def place(row):
        return (row[0] is None, hashlib.sha256(f"1:{row[0]}".encode()).hexdigest(), np.array(row[1], "<i4").tobytes())

    centroids = [v for _, v in sorted(kept, key=place)[:clusters]]

    def assigned():
        squared = [[sum((x - c) ** 2 for x, c in zip(v, centre, strict=True)) for centre in centroids] for _, v in kept]
        return [(min(range(len(d)), key=d.__getitem__), min(d)) for d in squared]

    for _ in range(rounds):
        found = assigned()
        for number in range(len(centroids)):
            own = [v for (_, v), (n, _) in zip(kept, found, strict=True) if n == number]
            if own:
                centroids[number] = [sum(column) // len(own) for column in zip(*own, strict=True)]
    found = assigned()
    out = []
    for (vec_id, _), (number, distance) in zip(kept, found, strict=True):
        inertia = sum(d for n, d in found if n == number)
        digest = hashlib.sha256(",".join(map(str, centroids[number])).encode()).hexdigest()
        out.append((vec_id, number, distance, inertia, sum(d for _, d in found), digest))
    return sorted(out, key=str)


def clustered(spark, area, rows, dimensions, clusters=16, rounds=3):
    full = [(*row, "c", "d", "i", "x", "y") for row in rows]
    frame = spark.createDataFrame(full, SCHEMA).repartition(3)
    found = cluster_vectors(frame, area, dimensions=dimensions, clusters=clusters, rounds=rounds)
    assert found.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted((tuple(row) for row in found.collect()), key=str)


def groups(seed, count, dimensions, spread):
    pick = random.Random(seed)
    centres = [[pick.uniform(-2, 2) for _ in range(dimensions)] for _ in range(6)]
    return [(i, [c + pick.gauss(0, spread) for c in pick.choice(centres)]) for i in range(count)]


@pytest.mark.parametrize(("dimensions", "spread", "rounds"), [(2, 0.1, 3), (5, 1.0, 3), (64, 0.3, 3), (3, 0.5, 8)])
def test_equals_plain_rounds(spark, area, dimensions, spread, rounds):
    rows = groups(dimensions, 300, dimensions, spread)
    assert clustered(spark, area, rows, dimensions, rounds=rounds) == plain(rows, dimensions, 16, rounds)


def test_ties_copies_and_clusters_left_empty(spark, area):
    rows = [(i, [float(i % 4), 0.0]) for i in range(60)] + [(7, [1.0, 0.0])] * 30
    found = clustered(spark, area, rows, 2)
    assert found == plain(rows, 2, 16, 3)
    assert len({row[1] for row in found}) <= 4


def test_odd_vectors(spark, area):
    inf, nan = math.inf, math.nan
    rows = [
        (1, None), (2, []), (3, [1.0, None]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [1.0, 2.0, 3.0]),
        (7, [-0.0001, 0.0]), (8, [0.5, -7.3]), (8, [0.5, -7.3]), (None, [9.0, 9.0]), (None, [-3.0, 1.0]), (2**60, [1e-300, 4.0]),
    ]
    found = clustered(spark, area, rows, 2, clusters=3)
    assert found == plain(rows, 2, 3, 3)
    assert len(found) == 6


def test_fewer_vectors_than_clusters_one_cluster_and_none(spark, area):
    rows = groups(1, 5, 3, 0.4)
    assert clustered(spark, area, rows, 3) == plain(rows, 3, 16, 3)
    assert clustered(spark, area, rows, 3, clusters=1) == plain(rows, 3, 1, 3)
    assert clustered(spark, area, [], 3) == []
    assert clustered(spark, area, [(1, None)], 3) == []


def test_large_components_stay_exact_and_larger_ones_are_refused(spark, area):
    big = 2.0**20
    rows = [(i, [big * (i % 3 - 1), -big + i / 64]) for i in range(40)]
    assert clustered(spark, area, rows, 2) == plain(rows, 2, 16, 3)
    for value in (1e300, -(2.0**21)):
        with pytest.raises(ValueError, match="beyond"):
            clustered(spark, area, [(1, [value, 0.0])], 2)


def test_bound_of_a_move_holds_and_is_tighter_than_its_length():
    pick = np.random.default_rng(3)
    tighter = 0
    for _ in range(300):
        centre, before, after = pick.normal(0, 50, (3, 4)).round().astype(np.int64)
        radius = float(pick.uniform(0, 40))
        bound = nearer_by(centre, radius, before, after)
        way = pick.normal(size=(2000, 4))
        points = centre + radius * way / np.linalg.norm(way, axis=1, keepdims=True) * pick.uniform(0, 1, (2000, 1)) ** 0.2
        seen = np.linalg.norm(points - before, axis=1) - np.linalg.norm(points - after, axis=1)
        assert seen.max() <= bound + 1e-9
        tighter += bound < 0.9 * np.linalg.norm(after - before)
    assert tighter > 150


def test_bounds_spare_most_vectors_the_full_scan():
    from tabloom.llm import drift_clusters as d

    rows = np.array([[math.floor(64 * x) for x in v] for _, v in groups(4, 2000, 8, 0.05)])
    centroids = rows[[0, 400, 800, 1200]]
    number, squared, lower = d._scan(rows, centroids)
    after = np.array([rows[number == i].sum(axis=0) // max((number == i).sum(), 1) for i in range(4)])
    upper = np.sqrt(squared)
    radii = np.array([upper[number == i].max(initial=0) for i in range(4)])
    move = d._moved(centroids, after, radii)
    spared = np.sqrt(((rows - after[number]) ** 2).sum(axis=1)) < lower - move.nearer[number]
    full = max(move.farther)
    plainly = np.sqrt(((rows - after[number]) ** 2).sum(axis=1)) < lower - full
    assert spared.sum() > plainly.sum()
