"""Exact top-k inner products with a vector-approximation file.

Components become integers. Each dimension's range is cut into cells, and a vector's cell numbers
are its approximation. A query's product with the cells' centres, give or take the query's largest
possible error, bounds the score, so a scan of the approximations ranks candidates; exact vectors
are then read in the order of their bounds until no bound can reach the kth score found.

Candidates are dealt to shards and queries to groups of bounded size; a task joins one shard with
one group, and each query's best of all shards are merged. Tiles number (rows / SHARD_ROWS) *
(queries / GROUP_ROWS), which any exact search without an index over its results has to look at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.llm.common import row_count
from tabloom.sources.work import WorkArea

TOP = 20
CELLS = 32
SCALE = 64.0
SHARD_ROWS = 8192
GROUP_ROWS = 2048
#: Queries whose bounds are held in memory at once.
QUERY_BLOCK = 128
#: No score of the table may be larger.
MOST_SCORE = 2**62


def integers(vectors: DataFrame, scale: float = SCALE) -> DataFrame:
    """(vec_id, size, parts) with parts = floor(scale * component); unusable vectors are left out.

    Unusable are null vectors and those with a null, NaN or infinite component.
    """
    usable = F.col("embedding").isNotNull() & F.forall(
        "embedding", lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False))
    )
    parts = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale))
    return vectors.filter(usable).select(
        "vec_id", F.size("embedding").alias("size"), parts.alias("parts")
    )


def ranges(rows: DataFrame) -> dict[int, np.ndarray]:
    """Per vector size the least and greatest integer of each dimension, shape (2, size)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for size, parts in _by_size(batches):
            found = [[size] * size, range(size), parts.min(0), parts.max(0)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in found], ["size", "at", "low", "high"]
            )

    found = rows.select("size", "parts").filter("size > 0")
    found = found.mapInArrow(run, "size long, at long, low long, high long").groupBy("size", "at")
    found = found.agg(F.min("low").alias("low"), F.max("high").alias("high")).orderBy("size", "at")
    out: dict[int, list] = {}
    for r in found.collect():  # one row per dimension
        out.setdefault(r["size"], []).append((r["low"], r["high"]))
    return {size: np.array(pairs, dtype=np.int64).T for size, pairs in out.items()} | {
        0: np.zeros((2, 0), dtype=np.int64)
    }


def _by_size(batches):
    for batch in batches:
        sizes = batch.column("size").to_numpy()
        parts = batch.column("parts")
        for size in np.unique(sizes):
            chosen = parts.filter(pa.array(sizes == size))
            yield int(size), chosen.flatten().to_numpy().reshape(-1, size)


def cells(parts: np.ndarray, span: np.ndarray, count: int) -> np.ndarray:
    low, high = span
    return ((parts - low) * count // (high - low + 1)).astype(np.uint8)


def cell_centres(span: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """(centres, half widths), each (count, dimensions), of the integers in every cell."""
    low, high = span
    edges = -(-np.arange(count + 1)[:, None] * (high - low + 1) // count) + low
    first, last = edges[:-1], np.maximum(edges[1:] - 1, edges[:-1])
    return (first + last) / 2, (last - first) / 2


def best(
    queries: np.ndarray,
    query_rows: np.ndarray,
    codes: np.ndarray,
    exact: np.ndarray,
    ids: np.ndarray,
    rows: np.ndarray,
    span: np.ndarray,
    top: int,
    count: int = CELLS,
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query number, candidate numbers, scores): the `top` highest, ties to the smaller id.

    `query_rows` and `rows` number the rows of the table: a row is no candidate of itself.
    """
    centres, halves = cell_centres(span, count)
    about = centres[codes, np.arange(codes.shape[1])]
    widest = halves.max(0) if count else halves
    for start in range(0, len(queries), QUERY_BLOCK):
        block = queries[start : start + QUERY_BLOCK]
        scores = block.astype(np.float64) @ about.T
        # Rounding of the sums stays far below one unit of the last place times the terms.
        slack = np.abs(block) @ widest + 1e-9 * (1 + np.abs(block) @ np.abs(span).max(0))
        scores[query_rows[start : start + QUERY_BLOCK, None] == rows[None, :]] = -np.inf
        for q, (bounds, error) in enumerate(zip(scores, slack, strict=True)):
            allowed = np.flatnonzero(bounds > -np.inf)
            if len(allowed) > top:
                kth = np.partition(bounds[allowed], -top)[-top]
                allowed = allowed[bounds[allowed] >= kth - 2 * error]
            order = allowed[np.argsort(-bounds[allowed], kind="stable")]
            read, found = 0, np.zeros(0, dtype=np.int64)
            while read < len(order):
                more = order[read : read + max(4 * top, read)]
                found = np.concatenate([found, exact[more] @ block[q]])
                read += len(more)
                if read < len(order) and len(found) >= top:
                    if bounds[order[read]] + error < np.partition(found, -top)[-top]:
                        break
            seen = order[:read]
            kept = np.lexsort((ids[seen], -found))[:top]
            yield start + q, seen[kept], found[kept]


def search(
    vectors: DataFrame,
    is_query: Column,
    area: WorkArea,
    top: int = TOP,
    scale: float = SCALE,
    shard_rows: int = SHARD_ROWS,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """query_id, rank, vec_id, score: for every query row its `top` best other rows.

    Every row but the query's own is a candidate, others of its id included. Vectors only meet
    vectors of their size. Ids that occur more than once are candidates as often; each query row
    has its own ranks. A null id takes no part. Other columns are not read; an empty table gives an
    empty result. Components so large that a score could leave 64 bits are refused.
    """
    rows = integers(vectors.filter(F.col("vec_id").isNotNull()), scale)
    kind = vectors.schema["vec_id"].dataType.simpleString()
    spans = ranges(rows)
    for size, span in spans.items():
        if sum(max(abs(int(low)), abs(int(high))) ** 2 for low, high in span.T) > MOST_SCORE:
            raise ValueError(f"components of vectors of size {size} are too large: scores would leave 64 bits")

    def approximate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("size").to_numpy()
            for size in np.unique(sizes):
                chosen = batch.filter(pa.array(sizes == size))
                parts = chosen.column("parts").flatten().to_numpy().reshape(len(chosen), size)
                codes = cells(parts, spans[int(size)], CELLS)
                columns = [
                    *(chosen.column(n) for n in ("vec_id", "size", "query", "place")),
                    pa.array([c.tobytes() for c in codes], pa.binary()),
                    pa.array([p.tobytes() for p in parts], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, _FILE)

    placed = rows.select(
        "vec_id",
        "size",
        F.coalesce(is_query, F.lit(False)).alias("query"),
        F.monotonically_increasing_id().alias("place"),
        "parts",
    )
    schema = f"vec_id {kind}, size int, query boolean, place long, codes binary, exact binary"
    file = area.table(placed.mapInArrow(approximate, schema), "approximations")

    queries = file.filter("query")
    shards = max(1, -(-row_count(file) // shard_rows))
    groups = max(1, -(-row_count(queries) // group_rows))
    shard, group = (F.pmod(F.xxhash64("place"), F.lit(n)).cast("int") for n in (shards, groups))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    wanted = queries.select(
        each(shards).alias("shard"), group.alias("group"), F.lit(True).alias("asks"), *_FILE[:2], "place",
        F.lit(None).cast("binary").alias("codes"), "exact",
    )
    offered = file.select(
        shard.alias("shard"), each(groups).alias("group"), F.lit(False).alias("asks"), *_FILE[:2], "place",
        "codes", "exact",
    )

    def tile(table: pa.Table) -> pa.Table:
        asks, sizes = (table.column(n).to_numpy() for n in ("asks", "size"))
        out: list[tuple] = []
        for size in np.unique(sizes):
            q, c = (table.filter(pa.array((sizes == size) & (asks == k))) for k in (True, False))
            if not len(q) or not len(c):
                continue
            matrix = lambda t, n, d: np.frombuffer(
                b"".join(t.column(n).to_pylist()), d
            ).reshape(len(t), size)
            ids = c.column("vec_id").to_numpy()
            found = best(
                matrix(q, "exact", np.int64),
                q.column("place").to_numpy(),
                matrix(c, "codes", np.uint8),
                matrix(c, "exact", np.int64),
                ids,
                c.column("place").to_numpy(),
                spans[int(size)],
                top,
            )
            asked, rows_ = q.column("vec_id").to_numpy(), q.column("place").to_numpy()
            out += [
                (np.full(len(at), asked[i]), np.full(len(at), rows_[i]), ids[at], scores)
                for i, at, scores in found
            ]
        columns = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 4
        kinds = [table.schema.field("vec_id").type, pa.int64(), table.schema.field("vec_id").type, pa.int64()]
        return pa.table(
            [pa.array(c, k) for c, k in zip(columns, kinds)], ["query_id", "asked", "vec_id", "score"]
        )

    tiles = wanted.unionByName(offered).repartition(shards * groups, "shard", "group")
    found = tiles.groupBy("shard", "group").applyInArrow(
        tile, f"query_id {kind}, asked long, vec_id {kind}, score long"
    )
    ranked = Window.partitionBy("asked").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= top)
    return found.select("query_id", "rank", "vec_id", "score")


_FILE = ["vec_id", "size", "query", "place", "codes", "exact"]
