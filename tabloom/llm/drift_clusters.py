"""Exact k-means whose bounds are loosened by the geometry of each centroid's move.

Every vector carries an upper bound on the distance to its own centroid and a lower bound on that
to all others. When centroids move, the lower bounds of a cluster fall by what the geometry allows
instead of by the longest move: all its vectors lie in one sphere, and how much nearer a moved
centroid can be to any point of that sphere is a question in the plane through the sphere's
centre and the way of the centroid (`nearer_by`). Where the bounds leave a doubt, the vector is compared
with all centroids in exact integers, so the result is that of plain k-means.

Vectors and bounds travel together from round to round as a written table; sums change only by the
vectors that changed their cluster. The driver holds the centroids.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.functions.columns import quoted
from tabloom.sources.work import WorkArea

DIMENSIONS = 64
CLUSTERS = 16
ROUNDS = 3
SEED = "1"
#: Components are stored in units of 1 / CELLS.
CELLS = 64
#: Components beyond this are refused: squared distances must fit 64 bits.
LARGEST = 1 << 26
#: Parts into which the way of a centroid is cut; more give tighter bounds.
STEPS = 8
#: What rounding may cost a bound, relative to what it was computed from.
SLACK = 1e-9
NOWHERE = 1e300

_STATE = "id {id}, cells binary, cluster int, was int, upper double, lower double, distance long"


@dataclass(frozen=True)
class Move:
    """Centroids after a move, and what it does to the bounds of each cluster."""

    centroids: np.ndarray
    farther: np.ndarray
    nearer: np.ndarray


def cluster_vectors(
    vectors: DataFrame,
    area: WorkArea,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    dimensions: int = DIMENSIONS,
    clusters: int = CLUSTERS,
    rounds: int = ROUNDS,
    seed: str = SEED,
) -> DataFrame:
    """One row per vector: `id_col`, `cluster`, `distance` (squared), `cluster_inertia`, `inertia`,
    `centroid_sha256`.

    Vectors that are null, hold a null, NaN or infinite component or another number of components
    take no part. Components become floor(64 x); beyond 2^26 they are refused by a ValueError, as
    squared distances would leave 64 bits. The first centroids are the vectors with the least
    sha256 of `seed:id` (ties by the vector, null ids last); with fewer vectors there are fewer
    clusters. Ties between centroids go to the smaller number, a cluster without vectors keeps its
    centroid. Repeated rows count each time; an empty table gives no rows; other columns are not
    read, so their names can't clash. `area` must live until the result has been used.
    """
    kept = area.table(_in_cells(vectors, id_col, vector_col, dimensions), "vectors")
    largest = kept.agg(F.max("largest")).first()[0]
    if largest is not None and largest > LARGEST:
        raise ValueError(f"a component of {vector_col!r} is beyond {LARGEST // CELLS} in size")
    place = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = kept.orderBy(place.asc_nulls_last(), "cells").limit(clusters).select("cells").collect()
    schema = _STATE.format(id=kept.schema["id"].dataType.simpleString())
    centroids = np.array([_components(row["cells"]) for row in first], dtype=np.int64)
    centroids = centroids.reshape(len(first), dimensions)
    state = area.table(kept.select("id", "cells").mapInArrow(_assign(centroids), schema), "round")
    sums, counts = [[0] * dimensions for _ in first], [0] * len(first)
    for number in range(rounds if len(first) else 0):
        _add_changes(state, sums, counts)
        means = [[s // n for s in row] if n else None for row, n in zip(sums, counts, strict=True)]
        after = np.array([old if new is None else new for old, new in zip(centroids, means, strict=True)])
        move = _moved(centroids, after.astype(np.int64), _radii(state, len(first)))
        last = number == rounds - 1
        state = area.table(state.mapInArrow(_reassign(move, last), schema), "round")
        centroids = move.centroids
    return _described(state, centroids, id_col)


def _in_cells(vectors: DataFrame, id_col: str, vector_col: str, dimensions: int) -> DataFrame:
    vector = quoted(vector_col)
    finite = F.forall(vector, lambda x: F.abs(x.cast("double")) < F.lit(math.inf))
    whole = vectors.filter((F.size(vector) == dimensions) & finite)
    read = whole.select(quoted(id_col).alias("id"), vector.cast("array<double>").alias("vector"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch["vector"].flatten().to_numpy(zero_copy_only=False)
            cells = np.floor(flat.reshape(len(batch), dimensions) * CELLS)
            size = np.minimum(np.abs(cells).max(axis=1, initial=0), LARGEST + 1)
            cells = np.clip(cells, -LARGEST, LARGEST).astype("<i4")
            held = pa.array([row.tobytes() for row in cells], pa.binary())
            yield pa.record_batch([batch["id"], held, pa.array(size.astype(np.int64))], ["id", "cells", "largest"])

    kind = read.schema["id"].dataType.simpleString()
    return read.mapInArrow(run, f"id {kind}, cells binary, largest long")


def _components(cells: bytes) -> np.ndarray:
    return np.frombuffer(cells, dtype="<i4").astype(np.int64)


def _matrix(cells: pa.BinaryArray, dimensions: int) -> np.ndarray:
    flat = np.frombuffer(b"".join(cells.to_pylist()), dtype="<i4")
    return flat.reshape(len(cells), dimensions).astype(np.int64)


def _squared(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of each vector to each centroid."""
    out = np.empty((len(vectors), len(centroids)), dtype=np.int64)
    for number, centroid in enumerate(centroids):
        gap = vectors - centroid
        out[:, number] = np.einsum("ij,ij->i", gap, gap)
    return out


def _scan(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centroid (the first of equals), squared distance to it, distance to the next."""
    squared = _squared(vectors, centroids)
    nearest = squared.argmin(axis=1)
    rows = np.arange(len(vectors))
    distance = squared[rows, nearest]
    if len(centroids) == 1:
        return nearest, distance, np.full(len(vectors), NOWHERE)
    others = squared.astype(np.float64)
    others[rows, nearest] = NOWHERE
    return nearest, distance, np.sqrt(others.min(axis=1))


def _batch(like: pa.RecordBatch, cluster, was, upper, lower, distance) -> pa.RecordBatch:
    numbers = [pa.array(cluster, pa.int32()), pa.array(was, pa.int32())]
    bounds = [pa.array(upper, pa.float64()), pa.array(lower, pa.float64()), pa.array(distance, pa.int64())]
    names = ["id", "cells", "cluster", "was", "upper", "lower", "distance"]
    return pa.record_batch([like["id"], like["cells"], *numbers, *bounds], names)


def _assign(centroids: np.ndarray):
    """The first assignment: every vector is compared with every centroid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = _matrix(batch["cells"], centroids.shape[1])
            nearest, distance, lower = _scan(vectors, centroids)
            yield _batch(batch, nearest, np.full(len(batch), -1), np.sqrt(distance), lower, distance)

    return run


def _reassign(move: Move, exact: bool):
    """Later assignments: bounds first, then the own centroid, then all of them.

    `exact` gives the true distance for every row, as the result needs it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = _matrix(batch["cells"], move.centroids.shape[1])
            cluster, distance = batch["cluster"].to_numpy().copy(), batch["distance"].to_numpy().copy()
            was = cluster.copy()
            upper, lower = batch["upper"].to_numpy().copy(), batch["lower"].to_numpy().copy()
            upper += move.farther[cluster]
            upper += SLACK * upper
            fall = move.nearer[cluster]
            lower -= fall + SLACK * (np.abs(lower) + np.abs(fall))
            open_ = np.arange(len(batch)) if exact else np.flatnonzero(upper >= lower)
            gap = vectors[open_] - move.centroids[cluster[open_]]
            distance[open_] = np.einsum("ij,ij->i", gap, gap)
            upper[open_] = np.sqrt(distance[open_]) * (1 + SLACK)
            doubt = np.flatnonzero(upper >= lower)
            if len(doubt):
                cluster[doubt], distance[doubt], lower[doubt] = _scan(vectors[doubt], move.centroids)
                upper[doubt] = np.sqrt(distance[doubt]) * (1 + SLACK)
            yield _batch(batch, cluster, was, upper, lower, distance)

    return run


def _add_changes(state: DataFrame, sums: list[list[int]], counts: list[int]) -> None:
    """Carry the vectors that changed their cluster from one sum to the other."""
    dimensions = len(sums[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = _matrix(batch["cells"], dimensions)
            rows = []
            for column, sign in (("cluster", 1), ("was", -1)):
                numbers = batch[column].to_numpy()
                for number in np.unique(numbers[numbers >= 0]).tolist():
                    part = vectors[numbers == number]
                    rows.append((number, sign * len(part), (sign * part.sum(axis=0)).tolist()))
            if rows:
                number, count, total = zip(*rows, strict=True)
                parts = [pa.array(number, pa.int32()), pa.array(count, pa.int64()), pa.array(total, pa.list_(pa.int64()))]
                yield pa.record_batch(parts, ["cluster", "rows", "total"])

    changed = state.filter("cluster <> was").select("cells", "cluster", "was")
    parts = changed.mapInArrow(run, "cluster int, rows long, total array<long>")
    cells = parts.select("cluster", "rows", F.posexplode("total").alias("place", "part"))
    added = cells.groupBy("cluster", "place").agg(
        F.sum(F.col("part").cast("decimal(38,0)")).alias("part"), F.sum("rows").alias("rows")
    )
    for row in added.collect():  # a row per cluster and component
        sums[row["cluster"]][row["place"]] += int(row["part"])
        if row["place"] == 0:
            counts[row["cluster"]] += row["rows"]


def _radii(state: DataFrame, clusters: int) -> np.ndarray:
    """Radius of the sphere around each centroid that holds its vectors."""
    radii = np.zeros(clusters)
    for row in state.groupBy("cluster").agg(F.max("upper").alias("radius")).collect():
        radii[row["cluster"]] = row["radius"]
    return radii


def _moved(before: np.ndarray, after: np.ndarray, radii: np.ndarray) -> Move:
    count = len(before)
    farther = np.sqrt(((after - before) ** 2).sum(axis=1).astype(np.float64))
    nearer = np.zeros(count)
    for own in range(count):
        falls = [
            nearer_by(before[own], radii[own], before[other], after[other])
            for other in range(count)
            if other != own
        ]
        nearer[own] = max(falls, default=0.0)
    return Move(after, farther, nearer)


def nearer_by(centre: np.ndarray, radius: float, before: np.ndarray, after: np.ndarray) -> float:
    """A bound on |x - before| - |x - after| over all x within `radius` of `centre`.

    Moving a point along a line brings it nearer to x at a rate of the cosine of the angle at which it
    sees x. In the plane through the line and the centre, the least angle to the sphere is the
    angle to its centre less half the angle it fills; it only grows on the way, so the cosine at the
    start of each of `STEPS` parts bounds that part. Negative when the point leaves the sphere behind.
    """
    way = (after - before).astype(np.float64)
    length = float(np.sqrt(way @ way))
    if length == 0:
        return 0.0
    to_centre = (centre - before).astype(np.float64)
    along = float(to_centre @ way) / length
    aside = math.sqrt(max(float(to_centre @ to_centre) - along * along, 0.0))
    total = 0.0
    for step in range(STEPS):
        ahead = along - length * step / STEPS
        distance = math.hypot(ahead, aside)
        if distance <= radius:
            total += 1.0
        else:
            total += math.cos(max(0.0, math.atan2(aside, ahead) - math.asin(radius / distance)))
    # Near a tangent the angle is known to half the digits only.
    return length * min(1.0, total / STEPS + 1e-6)


def _described(state: DataFrame, centroids: np.ndarray, id_col: str) -> DataFrame:
    """Add what belongs to the cluster: one row each, so the table is tiny."""
    totals = state.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total"))
    inertia = {row["cluster"]: int(row["total"]) for row in totals.collect()}
    facts = [
        (number, total, sum(inertia.values()), _digest(centroids[number])) for number, total in inertia.items()
    ]
    table = state.sparkSession.createDataFrame(
        facts, "number int, cluster_inertia long, inertia long, centroid_sha256 string"
    )
    joined = state.join(F.broadcast(table), F.col("cluster") == F.col("number"))
    return joined.select(
        F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )


def _digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()
