"""Mixing sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources they belong to). A flow routes
each pattern's words to the quotas of its sources; a further copy of a pattern costs more than the
one before, so everything is taken once before anything is taken twice. The graph has one node for
each pattern and source and is solved on the driver: it grows with the sources, not the documents.
Documents then follow each other in seeded order, and each flow is an interval of that order.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.sources.work import WorkArea

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_COPIES = 2
SEED = 17
#: Leading hex digits of the seeded hash: running sums are taken within one prefix at a time.
PREFIX_DIGITS = 3
#: The plan is made as an Arrow table: rows of Python values would start Python processes in every executor.
_SPAN = pa.struct([("source", pa.string()), ("copy", pa.int32()), ("low", pa.int64()), ("high", pa.int64())])
_PLAN = pa.schema([("members", pa.list_(pa.string())), ("spans", pa.list_(_SPAN))])


def water_fill(
    sizes: Mapping, weights: Mapping, total: float, copies: int = MAX_COPIES
) -> dict:
    """Shares of `total` by weight, none above `copies` times its size; the excess is reshared."""
    targets, open_keys, left = {}, list(sizes), float(total)
    while open_keys:
        whole = sum(weights[k] for k in open_keys)
        full = [k for k in open_keys if left * weights[k] / whole > copies * sizes[k]]
        if not full:
            return targets | {k: left * weights[k] / whole for k in open_keys}
        targets |= {k: float(copies * sizes[k]) for k in full}
        left -= sum(targets[k] for k in full)
        open_keys = [k for k in open_keys if k not in targets]
    return targets


def cheapest_flow(
    capacities: Mapping[tuple, int], quotas: Mapping, copies: int = MAX_COPIES
) -> list[tuple[tuple, object, int, int]]:
    """Flows as (pattern, source, copy, words): most words first, then least repetition cost.

    Successive shortest paths over pattern -> source arcs. Copy c of a pattern costs 4**c a word;
    as costs are convex, arcs of a later copy are only used when the earlier one is full.
    """
    used = {(p, c): 0 for p in capacities for c in range(copies)}
    flow: dict[tuple, int] = {}
    left = dict(quotas)
    reach: dict[object, list[tuple]] = {s: [] for s in quotas}
    for pattern in capacities:
        for source in pattern:
            if source in reach:
                reach[source].append(pattern)
    for target in quotas:
        while left[target] > 0:
            path = _shortest(target, capacities, used, flow, reach, copies)
            if path is None:
                break
            steps, (pattern, copy) = path
            amount = min(left[target], capacities[pattern] - used[pattern, copy])
            amount = min([amount, *(flow[back] for _, back in steps if back)])
            used[pattern, copy] += amount
            left[target] -= amount
            for forward, back in steps:
                flow[forward] = flow.get(forward, 0) + amount
                if back:
                    flow[back] -= amount
    return _by_copy(capacities, flow)


def _shortest(target, capacities, used, flow, reach, copies):
    """A cheapest way to bring words to `target`; other sources may hand patterns over.

    Handing over is free, so a search by breadth finds every pattern within reach, and the
    cheapest copy that is still free among them ends the path.
    """
    came: dict[object, tuple] = {target: ()}
    queue, best = deque([target]), None
    while queue:
        source = queue.popleft()
        for pattern in reach[source]:
            copy = next((c for c in range(copies) if used[pattern, c] < capacities[pattern]), None)
            if copy is not None and (best is None or copy < best[0]):
                best = (copy, source, pattern)
                if copy == 0:
                    queue.clear()
                    break
            for other in pattern:
                if other in reach and other not in came and flow.get((pattern, other), 0) > 0:
                    came[other] = (source, pattern)
                    queue.append(other)
    if best is None:
        return None
    copy, source, pattern = best
    steps = [((pattern, source), None)]
    while came[source]:
        to, handed = came[source]
        steps.append(((handed, to), (handed, source)))
        source = to
    return steps, (pattern, copy)


def _by_copy(capacities, flow):
    """Each pattern's flows laid one after the other over its copies."""
    out = []
    for pattern, capacity in capacities.items():
        at = 0
        for source in pattern:
            words = flow.get((pattern, source), 0)
            while words > 0:
                copy, start = divmod(at, capacity)
                piece = min(words, capacity - start)
                out.append((pattern, source, copy, piece))
                at, words = at + piece, words - piece
    return out


def sized(docs: DataFrame, size: Column, members: Column, area: WorkArea, *carry: Column) -> DataFrame:
    """(doc_id, words, members) and `carry`: the table the mix works on; the texts are read once."""
    narrow = docs.select("doc_id", size.alias("words"), F.array_sort(members).alias("members"), *carry)
    return area.held(narrow)


def pattern_sizes(rows: DataFrame) -> dict[tuple, int]:
    found = rows.groupBy("members").agg(F.sum("words").alias("words")).collect()
    order = lambda r: [(m is None, m or "") for m in r["members"]]
    return {tuple(r["members"]): r["words"] for r in sorted(found, key=order)}


def select_documents(
    rows: DataFrame, flows: Sequence[tuple[tuple, object, int, int]], seed: int = SEED
) -> DataFrame:
    """`rows` with `taken` and `routes`, an array of (source, copy, words).

    Within a pattern documents follow each other by md5(seed:doc_id); the order's running sum
    places each on a line of words, and a flow takes an interval of it. The document at an
    interval's end is cut, so quotas are met to the word. Repeated rows share a place in the
    order but not an interval; a null id is the text 'null'. Other columns are carried along.
    """
    carried = [c for c in rows.columns if c not in ("doc_id", "words", "members")]
    spans: dict[tuple, list] = {}
    filled: dict[tuple, int] = {}
    for pattern, source, copy, words in flows:
        start = filled.get((pattern, copy), 0)
        spans.setdefault(pattern, []).append((source, copy, start, start + words))
        filled[pattern, copy] = start + words
    names = ("source", "copy", "low", "high")
    found = [{"members": list(p), "spans": [dict(zip(names, s)) for s in own]} for p, own in spans.items()]
    plan = rows.sparkSession.createDataFrame(pa.Table.from_pylist(found, _PLAN))

    seeded = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    keyed = rows.withColumn("order", seeded).withColumn(
        "prefix", F.substring("order", 1, PREFIX_DIGITS)
    )
    sums = keyed.groupBy("members", "prefix").agg(F.sum("words").alias("prefix_words"))
    before = Window.partitionBy("members").orderBy("prefix").rowsBetween(
        Window.unboundedPreceding, -1
    )
    sums = sums.withColumn("base", F.coalesce(F.sum("prefix_words").over(before), F.lit(0)))
    within = Window.partitionBy("members", "prefix").orderBy("order", "doc_id", "words", *carried)
    within = within.rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        keyed.withColumn("inside", F.coalesce(F.sum("words").over(within), F.lit(0)))
        .join(sums.drop("prefix_words"), ["members", "prefix"])
        .withColumn("low", F.col("base") + F.col("inside"))
        .join(plan, "members", "left")
    )
    low, high = F.col("low"), F.col("low") + F.col("words")
    cut = lambda s: F.greatest(F.lit(0), F.least(s["high"], high) - F.greatest(s["low"], low))
    routes = F.transform(
        F.coalesce("spans", F.array().cast("array<struct<source:string,copy:int,low:bigint,high:bigint>>")),
        lambda s: F.struct(s["source"], s["copy"], cut(s).cast("long").alias("words")),
    )
    routes = F.filter(routes, lambda r: r["words"] > 0)
    return placed.withColumn("routes", routes).select(
        "doc_id",
        "words",
        "members",
        *carried,
        F.aggregate("routes", F.lit(0).cast("long"), lambda a, r: a + r["words"]).alias("taken"),
        "routes",
    )
