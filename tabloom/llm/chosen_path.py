"""N-gram Jaccard join by chosen paths.

Every text becomes the set of its word shingles, and the set a signature of minhash tokens. A run
is a random tree: a node names one or two signature positions, and sets that share the token at
such a position go to the same child. Buckets are split on until they are small; a pair as similar
as the threshold shares a leaf of a run with known probability, and runs are repeated until their
joint probability reaches the target recall. The members of a leaf are compared with each other,
first by signature, then, where a partner is likely, by their exact shingle sets.

Equal texts are one class and joined once. Pairs are counted where they are found: a pair counts
in the least of its common leaves only, so no list of pairs is ever made, and a leaf reports one
row per member. Leaves that stay large (many texts like each other) are compared in tiles.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import SPACES, blocks, row_count, whole_text
from tabloom.llm.components import components
from tabloom.llm.word_hash import mix, shingles, word_hashes
from tabloom.sources.work import NUMBERS_PER_TASK, WorkArea, for_files, gathered, numbers_for_files

WIDTH = 5
THRESHOLD = 0.8
RECALL = 0.999
POSITIONS = 64
#: A node names one position, and with this probability a second one.
SECOND = 0.45
DEPTH = 4
SMALL = 32
TILE = 1024
#: Signatures this many standard deviations below the threshold are not compared exactly.
MARGIN = 4.0
_SEED = np.random.default_rng(20240601)
_FACTORS = _SEED.integers(1, 2**63, POSITIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BLOCK = 1 << 12
#: Bytes of texts that become Python values at once.
_TEXT_BYTES = 1 << 20
#: Rows of a tile whose pairs are judged at once.
_ROWS = 256


def survival(similarity: float, depth: int = DEPTH, second: float = SECOND) -> float:
    """Probability that two sets of this similarity still share a node after `depth` levels."""
    alive = 1.0
    for _ in range(depth):
        lost = 1 - similarity * alive
        alive = 1 - ((1 - second) * lost + second * lost**2)
    return alive


def runs_needed(recall: float = RECALL, similarity: float = THRESHOLD) -> int:
    """Runs for this recall if every run had a signature of its own."""
    return math.ceil(math.log(1 - recall) / math.log(1 - survival(similarity)))


def missed(runs: int, similarity: float = THRESHOLD) -> float:
    """Expected share of pairs of this similarity that runs over one signature miss.

    The equal positions are binomial; pairs below MARGIN are not compared.
    """
    spread = POSITIONS * similarity * (1 - similarity)
    least, found = POSITIONS * similarity - MARGIN * math.sqrt(spread), 0.0
    for equal in range(max(0, math.ceil(least)), POSITIONS + 1):
        chance = math.comb(POSITIONS, equal) * similarity**equal * (1 - similarity) ** (POSITIONS - equal)
        found += chance * (1 - (1 - survival(equal / POSITIONS)) ** runs)
    return 1 - found


def shared_runs(recall: float = RECALL, similarity: float = THRESHOLD) -> int:
    """Runs for this recall over one signature; an error where its positions can't reach it."""
    for runs in range(runs_needed(recall, similarity), 1000):
        if missed(runs, similarity) <= 1 - recall:
            return runs
    raise ValueError(f"{POSITIONS} positions do not reach a recall of {recall} at {similarity}")


def shingle_set(raw: bytes, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct shingle hashes; a text of fewer words has one shingle of all its words."""
    hashes, _, _ = word_hashes(raw)
    return np.unique(shingles(hashes, min(width, len(hashes)))) if len(hashes) else hashes


def signature(tokens: np.ndarray) -> np.ndarray:
    low = np.full(POSITIONS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for start in range(0, len(tokens), _BLOCK):
        block = tokens[None, start : start + _BLOCK] * _FACTORS[:, None]
        np.minimum(low, (block ^ (block >> np.uint64(32))).min(1), out=low)
    return (mix(low) >> np.uint64(32)).astype(np.uint32)


def same_text() -> Column:
    """Digest of the words of `text`, 16 bytes: equal for texts that differ in white space only."""
    words = F.btrim(F.regexp_replace(whole_text(), SPACES, " "))
    return F.substring(F.unhex(F.sha2(words, 256)), 1, 16)


def children(paths: np.ndarray, signatures: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, child path) of every row's one or two children below its node."""
    node = paths.astype(np.uint64)
    first, more = mix(node + np.uint64(1)), mix(node + np.uint64(2))
    two = (mix(node + np.uint64(3)) >> np.uint64(11)).astype(np.float64) * 2.0**-53 < SECOND
    rows = np.arange(len(node))
    a = (first % np.uint64(POSITIONS)).astype(np.int64)
    b = (a + 1 + (more % np.uint64(POSITIONS - 1)).astype(np.int64)) % POSITIONS
    out_rows = np.concatenate([rows, rows[two]])
    positions = np.concatenate([a, b[two]])
    tokens = signatures[out_rows, positions].astype(np.uint64) << np.uint64(8)
    paths = mix(node[out_rows] ^ mix(tokens + positions.astype(np.uint64)))
    return out_rows, paths.view(np.int64)


def _matrix(column, kind, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(-1, width)


def _sketched(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, class, signature) of every row; no signature without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (block for whole in batches for block in blocks(whole, "raw", _TEXT_BYTES)):
            sets = (shingle_set(raw, width) for raw in batch.column("raw").to_pylist())
            found = [signature(s).tobytes() if len(s) else None for s in sets]
            columns = [batch.column(0), batch.column(1), pa.array(found, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "class", "signature"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", same_text().alias("class"), whole_text().cast("binary").alias("raw"))
    return rows.mapInArrow(run, f"doc_id {kind}, class binary, signature binary")


def _leaves(classes: DataFrame, runs: int, area: WorkArea) -> tuple[DataFrame, int, list[DataFrame]]:
    """(bucket, size, cid): the memberships of different leaves with two members or more; their number; held tables."""
    sets = classes.filter("signature IS NOT NULL").select("cid", "signature")

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            own = _matrix(batch.column("signature"), np.uint32, POSITIONS)
            paths = batch.column("path").to_numpy().view(np.uint64)
            rows, paths = children(paths, own)
            columns = [pa.array(paths), batch.column("cid").take(pa.array(rows))]
            yield pa.RecordBatch.from_arrays(columns, ["path", "cid"])

    roots = F.explode(F.transform(F.sequence(F.lit(1), F.lit(runs)), lambda r: F.xxhash64(r)))
    rows = sets.select("cid", "signature", roots.alias("path"))
    levels, leaves = [], []
    parents = runs * row_count(sets)
    for depth in range(1, DEPTH + 1):
        paths = rows.mapInArrow(expand, "path long, cid long")
        number = math.ceil((1 + SECOND) * parents)
        rows = area.held(gathered(paths, number))
        sizes = rows.groupBy("path").agg(
            F.count(F.lit(1)).alias("size"),
            F.bit_xor(F.xxhash64("cid")).alias("one"),
            F.bit_xor(F.xxhash64("cid", F.lit(1))).alias("two"),
        )
        sizes = area.table(numbers_for_files(sizes.filter("size > 1"), number // 2), "sizes")
        levels.append(rows)
        leaves.append(sizes if depth == DEPTH else sizes.filter(F.col("size") <= SMALL))
        large = sizes.filter(F.col("size") > SMALL)
        parents = large.agg(F.sum("size")).first()[0]
        if depth == DEPTH or not parents:
            break
        rows = rows.join(large.select("path"), "path").join(sets, "cid")
    leaf = leaves[0]
    for more in leaves[1:]:
        leaf = leaf.unionByName(more)
    # Leaves with the same members need comparing only once.
    different = leaf.groupBy("size", "one", "two").agg(F.min("path").alias("path")).select("path", "size")
    leaf = area.table(numbers_for_files(different, row_count(leaf)), "leaves")
    members = [rows.join(leaf, "path") for rows in levels]
    found = members[0]
    for more in members[1:]:
        found = found.unionByName(more)
    memberships = leaf.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    return found.select(F.col("path").alias("bucket"), "size", "cid"), memberships, levels


def _tiles(members: DataFrame, *columns: str) -> DataFrame:
    """Members dealt to tiles of at most about TILE x TILE: (bucket, left, right, part, ...).

    Large leaves are dealt into parts; a tile compares one part with itself or with another.
    """
    parts = F.ceil(F.col("size") / TILE).cast("int")
    dealt = members.select(
        "bucket", "cid", *columns, F.pmod(F.xxhash64("cid"), parts).cast("int").alias("part"), parts.alias("parts")
    )
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    dealt = dealt.select("bucket", "cid", *columns, "part", other.alias("other"))
    dealt = dealt.withColumns({"left": F.least("part", "other"), "right": F.greatest("part", "other")})
    keys = ["bucket", "left", "right"]
    return dealt.drop("other").repartition(*keys).sortWithinPartitions(*keys, "cid")


def _by_tile(batches: Iterator[pa.RecordBatch], work: Callable) -> Iterator[pa.RecordBatch]:
    """`work(table of one tile)` over rows sorted by tile, a tile at a time."""
    held: list[pa.RecordBatch] = []
    key = None
    for batch in batches:
        keys = np.stack([batch.column(n).to_numpy() for n in ("bucket", "left", "right")])
        starts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1), len(batch)]
        for start, end in zip(starts, starts[1:]):
            if end > start:
                own = tuple(keys[:, start])
                if held and own != key:
                    yield from work(pa.Table.from_batches(held))
                    held = []
                key = own
                held.append(batch.slice(start, end - start))
    if held:
        yield from work(pa.Table.from_batches(held))


def _comparable(tile: pa.Table) -> np.ndarray:
    """Which pairs of rows this tile is to compare: those of its two parts, each pair once."""
    part = tile.column("part").to_numpy()
    left, right = tile.column("left")[0].as_py(), tile.column("right")[0].as_py()
    cid = tile.column("cid").to_numpy()
    ordered = cid[:, None] < cid[None, :]
    if left == right:
        return ordered
    return (part[:, None] != part[None, :]) & ordered


def _likely(members: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """(bucket, size, cid) of members whose signature resembles another one's in the tile."""
    least = threshold - MARGIN * math.sqrt(threshold * (1 - threshold) / POSITIONS)

    def work(tile: pa.Table) -> Iterator[pa.RecordBatch]:
        own = _matrix(tile.column("signature"), np.uint32, POSITIONS)
        pairs = _comparable(tile)
        alike = np.zeros(pairs.shape, dtype=bool)
        for start in range(0, len(own), 64):
            block = own[start : start + 64, None, :] == own[None, :, :]
            alike[start : start + 64] = block.mean(2) >= least
        alike &= pairs
        chosen = pa.array(alike.any(0) | alike.any(1))
        kept = tile.select(["bucket", "size", "cid"]).filter(chosen)
        yield from kept.combine_chunks().to_batches()

    signed = members.join(classes.select("cid", "signature"), "cid")
    tiles = _tiles(signed, "size", "signature")
    found = tiles.mapInArrow(lambda b: _by_tile(b, work), "bucket long, size long, cid long")
    return found.distinct()


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, by products of membership matrices."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, token, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times[token] > 1
    owner, token = owner[shared], token[shared]
    _, token = np.unique(token, return_inverse=True)
    order = np.argsort(token, kind="stable")
    owner, token = owner[order], token[order]
    out = np.zeros((len(sets), len(sets)), dtype=np.float32)
    for start in range(0, int(token[-1]) + 1 if len(token) else 0, 2048):
        a, b = np.searchsorted(token, [start, start + 2048])
        held = np.zeros((len(sets), 2048), dtype=np.float32)
        held[owner[a:b], token[a:b] - start] = 1
        out += held @ held.T
    return out


def _roots(linked: np.ndarray) -> np.ndarray:
    """The least row of every row's component."""
    root = np.arange(len(linked))
    a, b = np.nonzero(linked)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _verified(members: DataFrame, classes: DataFrame, docs: DataFrame, width: int, threshold: float) -> DataFrame:
    """(cid, links, peer) by tile: links that count here, and the least member it is linked to."""
    lists = members.groupBy("cid").agg(
        F.sort_array(F.collect_set(F.struct("bucket", "size"))).alias("buckets")
    )
    wanted = lists.join(classes.select("cid", "class", F.col("class_id").alias("doc_id")), "cid")
    texts = docs.select("doc_id", same_text().alias("class"), whole_text().cast("binary").alias("raw"))
    same = F.col("t.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("t.class") == F.col("w.class"))
    texts = texts.alias("t").join(wanted.alias("w"), same).select("cid", "buckets", "raw")

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (block for whole in batches for block in blocks(whole, "raw", _TEXT_BYTES)):
            found = [shingle_set(raw, width).tobytes() for raw in batch.column("raw").to_pylist()]
            columns = [batch.column("cid"), batch.column("buckets"), pa.array(found, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["cid", "buckets", "tokens"])

    sets = texts.mapInArrow(
        to_sets, "cid long, buckets array<struct<bucket:bigint,size:bigint>>, tokens binary"
    )
    names = F.transform("buckets", lambda b: b["bucket"])
    rows = sets.select("cid", "tokens", names.alias("names"), F.explode("buckets").alias("b"))
    rows = rows.select("cid", "tokens", "names", F.col("b.bucket"), F.col("b.size"))

    def work(tile: pa.Table) -> Iterator[pa.RecordBatch]:
        cid = tile.column("cid").to_numpy()
        fresh = np.ones(len(cid), dtype=bool)
        fresh[1:] = cid[1:] != cid[:-1]  # a class once, if its document is repeated
        tile, cid = tile.filter(pa.array(fresh)), cid[fresh]
        tokens = [np.frombuffer(t, dtype=np.uint64) for t in tile.column("tokens").to_pylist()]
        sizes = np.array([len(t) for t in tokens], dtype=np.float64)
        common = common_counts(tokens)
        linked = _comparable(tile)
        for start in range(0, len(cid), _ROWS):
            own = slice(start, start + _ROWS)
            both = common[own].astype(np.float64)
            linked[own] &= both + 1e-9 >= threshold * (sizes[own, None] + sizes[None, :] - both)
        del common
        bucket = tile.column("bucket")[0].as_py()
        earlier = [np.array([n for n in names if n < bucket], np.int64) for names in tile.column("names").to_pylist()]
        counted = linked & ~(common_counts(earlier) > 0)
        links = counted.sum(0) + counted.sum(1)
        columns = [pa.array(cid), pa.array(links.astype(np.int64)), pa.array(cid[_roots(linked)])]
        yield pa.RecordBatch.from_arrays(columns, ["cid", "links", "peer"])

    tiles = _tiles(rows, "names", "tokens")
    return tiles.mapInArrow(lambda b: _by_tile(b, work), "cid long, links long, peer long")


def join_similar(
    docs: DataFrame,
    area: WorkArea,
    width: int = WIDTH,
    threshold: float = THRESHOLD,
    recall: float = RECALL,
) -> DataFrame:
    """doc_id, class, class_id, links, group_id and leads for every row of `docs`.

    `class_id` is the smallest id with the same words, `links` the number of other texts whose
    shingle sets have at least the threshold's Jaccard similarity, `group_id` the smallest id that
    links lead to, and `leads` marks the rows of that text under that id. `class` is the text's
    digest (see `same_text`). Texts without words form one class without links. Repeated rows and
    null ids stay; an empty table gives an empty result; other columns are not read.
    """
    sketched = area.held(_sketched(docs, width))
    classes = sketched.groupBy("class").agg(
        F.min("doc_id").alias("class_id"), F.max("signature").alias("signature")
    )
    classes = classes.withColumn("cid", F.monotonically_increasing_id())
    classes = area.table(for_files(classes, row_count(sketched)), "classes")
    members, number, levels = _leaves(classes, shared_runs(recall, threshold), area)
    members = area.numbers(gathered(_likely(members, classes, threshold), number, NUMBERS_PER_TASK), "likely")
    area.release(*levels)
    del levels
    verified = _verified(members, classes, docs, width, threshold)
    found = area.numbers(gathered(verified, row_count(members)), "links")

    edges = found.filter("cid <> peer").selectExpr("cid AS a", "peer AS b")
    groups = components(edges, area)
    ids = groups.join(classes.select(F.col("cid").alias("node"), "class_id", "class"), "node")
    order = F.struct(F.col("class_id").isNull(), "class_id", "class")
    heads = ids.groupBy("root").agg(F.min(order).alias("head"))
    heads = ids.join(heads, "root").select(F.col("node").alias("cid"), "head")
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    known = classes.drop("signature").join(links, "cid", "left").join(heads, "cid", "left")
    alone = F.col("head").isNull()
    known = known.select(
        "class",
        "class_id",
        F.coalesce("links", F.lit(0)).alias("links"),
        F.when(alone, F.col("class_id")).otherwise(F.col("head.class_id")).alias("group_id"),
        (alone | (F.col("head.class") == F.col("class"))).alias("first"),
    )
    joined = sketched.select("doc_id", "class").join(known, "class")
    return joined.select(
        "doc_id",
        "class",
        "class_id",
        "links",
        "group_id",
        (F.col("first") & F.col("doc_id").eqNullSafe(F.col("group_id"))).alias("leads"),
    )
