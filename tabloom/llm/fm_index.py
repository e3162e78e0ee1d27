"""Substring dedup with compressed FM-indexes.

Reports, per document, the words covered by windows of WIDTH words that also start elsewhere.

Texts are cut into segments of neighbouring windows that share their least word n-gram hash, and
segments are routed by that hash: equal windows always meet in one shard, whatever documents they
come from, so no document has to be streamed past all shards. Segments whose hash occurs only
once in the corpus can't hold a repeated window and stay at home. Equal segments travel once, with
their number. A shard concatenates its segments into a suffix array and a wavelet matrix over the
Burrows-Wheeler transform, and streams every segment through it from the right: backward search
computes for every position how far it matches another place, up to WIDTH words.

A hash that occurs very often (a phrase of many documents) would make one large shard; its windows
are routed by their own hashes instead.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import blocks, whole_text
from tabloom.llm.word_hash import rolling, sliding_least, word_hashes
from tabloom.sources.work import WorkArea

WIDTH = 35
#: Words of the n-grams that route windows: more than most phrases, so few windows meet by chance.
GRAM = 16
#: Hashes with more occurrences than this are routed window by window.
FREQUENT = 4096
#: Words of one index; a shard ends with the route that reaches it.
SHARD_WORDS = 200_000
#: Windows of a segment that are searched one after the other; more are searched side by side.
LANE = 32
#: Bytes of text a task works on at once (a longer document is taken whole).
BLOCK_BYTES = 2 << 20


#: Masks of the bits before a place in a 64-bit word.
_BELOW = (np.uint64(1) << np.arange(64, dtype=np.uint64)) - np.uint64(1)


class WaveletMatrix:
    """Rank over a sequence of numbers: a bit vector per binary digit, with counts per 64 bits."""

    def __init__(self, values: np.ndarray, digits: int) -> None:
        self.words, self.counts, self.zeros, self.digits = [], [], [], digits
        for d in range(digits - 1, -1, -1):
            bits = (values >> d) & 1
            padded = np.zeros((len(values) // 64 + 1) * 64, dtype=np.uint8)
            padded[: len(values)] = bits
            words = np.packbits(padded, bitorder="little").view(np.uint64)
            ones = np.bitwise_count(words).astype(np.int64)
            self.words.append(words)
            self.counts.append(np.concatenate([[0], ones.cumsum()[:-1]]))
            self.zeros.append(int(len(values) - bits.sum()))
            values = np.concatenate([values[bits == 0], values[bits == 1]])
        alphabet = np.arange(1 << digits) if digits <= 20 else None
        self.start = self._walk(alphabet, np.zeros_like(alphabet)) if alphabet is not None else None

    def _walk(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level in range(self.digits):
            word = at >> 6
            below = _BELOW[at & 63]
            ones = np.bitwise_count(self.words[level][word] & below) + self.counts[level][word]
            bit = (symbols >> (self.digits - 1 - level)) & 1
            at = np.where(bit == 1, ones + self.zeros[level], at - ones)
        return at

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place."""
        first = self.start[symbols] if self.start is not None else self._walk(symbols, at * 0)
        return self._walk(symbols, at) - first


def suffix_array(
    text: np.ndarray, width: int, seed: int = 1
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(suffixes in order, their classes by the first `width` and by the first `seed` symbols).

    Prefix doubling, so `seed` is a power of two up to `width`; the text's last symbol must
    occur once and be the least.
    """
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    classes, covered, size = np.zeros(n, dtype=np.int64), 0, 1
    seeds = rank
    while True:
        if size == seed:
            seeds = rank
        if width & size:  # this power of two is part of the width
            ahead = np.minimum(np.arange(n) + covered, n - 1)
            classes = classes * (n + 1) + rank[ahead]
            classes = np.unique(classes, return_inverse=True)[1].astype(np.int64)
            covered += size
        done = rank.max() == n - 1
        if done and size * 2 > width:
            break
        if not done:
            follow = np.zeros(n, dtype=np.int64)
            follow[: n - size] = rank[size:] + 1
            rank = np.unique(rank * (n + 1) + follow, return_inverse=True)[1].astype(np.int64)
        size *= 2
    order = np.empty(n, dtype=np.int64)
    order[rank] = np.arange(n)
    return order, classes[order], seeds[order]


class FMIndex:
    """Backward search over weighted segments of symbols 2.. (1 separates, 0 ends)."""

    def __init__(self, segments: list[np.ndarray], weights: np.ndarray, width: int) -> None:
        lengths = np.array([len(s) + 1 for s in segments])
        parts = [x for s in segments for x in (s, [1])]
        self.text = np.concatenate([*parts, [0]]).astype(np.int64)
        self.seed = 1 << (max(1, width // 2).bit_length() - 1)
        order, classes, seeds = suffix_array(self.text, width - 1, self.seed)
        self.width, n = width, len(self.text)
        transform = self.text[order - 1]
        sigma = int(self.text.max()) + 1
        self.matrix = WaveletMatrix(transform, max(1, int(sigma - 1).bit_length()))
        self.before = np.concatenate([[0], np.bincount(self.text, minlength=sigma).cumsum()])
        weight = np.append(np.repeat(weights, lengths), 0)
        self.weight = np.concatenate([[0], weight[order].cumsum()])
        # Where suffixes that agree in width - 1 symbols begin and end, for each place of the array,
        # and the same for the seed, which is where matching starts.
        self.low, self.high = _intervals(classes)
        self.seed_low, self.seed_high = _intervals(seeds)
        self.place = np.empty(n, dtype=np.int64)
        self.place[order] = np.arange(n)
        self.offsets = np.concatenate([[0], lengths.cumsum()[:-1]])

    def extend(self, symbols, low, high):
        """The intervals of symbol + match."""
        both = self.matrix.rank(np.concatenate([symbols, symbols]), np.concatenate([low, high]))
        start = self.before[symbols]
        return start + both[: len(low)], start + both[len(low) :]

    def occurrences(self, low, high) -> np.ndarray:
        return self.weight[high] - self.weight[low]

    def match(self, ends: np.ndarray, most: int | None = None) -> tuple[np.ndarray, ...]:
        """(length, low, high) of the longest repeated match that ends before each place.

        Lengths go up to `most`, the width by default; there must be as many words before.
        """
        most = self.width if most is None else most
        low = np.zeros(len(ends), dtype=np.int64)
        high = np.full(len(ends), len(self.text), dtype=np.int64)
        length = np.zeros(len(ends), dtype=np.int64)
        if self.seed <= most:
            place = self.place[ends - self.seed]
            a, b = self.seed_low[place], self.seed_high[place]
            seeded = self.occurrences(a, b) > 1
            low[seeded], high[seeded], length[seeded] = a[seeded], b[seeded], self.seed
        alive = np.flatnonzero(length < most)
        while len(alive):
            symbol = self.text[ends[alive] - length[alive] - 1]
            a, b = self.extend(symbol, low[alive], high[alive])
            more = self.occurrences(a, b) > 1
            alive, a, b = alive[more], a[more], b[more]
            low[alive], high[alive] = a, b
            length[alive] += 1
            alive = alive[length[alive] < most]
        return length, low, high

    def unrepeated(self, first: np.ndarray, length: np.ndarray) -> np.ndarray:
        """For unrepeated runs from `first` on, an end up to which they are short and unrepeated."""
        end = first + length
        open_ = np.arange(len(first))
        short = 4
        while len(open_):
            open_ = open_[length[open_] > short]
            found = self.match(first[open_] + short, short)[0] < short
            end[open_[found]] = first[open_[found]] + short
            open_ = open_[~found]
            short *= 2
        return end

    def repeated(self, windows: np.ndarray) -> list[np.ndarray]:
        """For every segment which of its windows (their number is given) occur elsewhere.

        Segments go from their last window to their first, all at once, long ones in parts. After
        a full match, the interval of its first width - 1 symbols is known, and one step leads to
        the next window. A window without a match holds a short run that occurs nowhere else;
        windows are passed over until they end before that run, and matched from their end again.
        """
        out = [np.zeros(w, dtype=bool) for w in windows]
        parts = -(-windows // LANE)
        owner = np.repeat(np.arange(len(windows)), parts)
        begin = (np.arange(len(owner)) - np.repeat(parts.cumsum() - parts, parts)) * LANE
        count = np.minimum(windows[owner] - begin, LANE)
        lane = np.argsort(-count, kind="stable")
        owner, count = owner[lane], count[lane]
        begin = begin[lane] + self.offsets[owner]
        full = np.zeros(len(lane), dtype=bool)
        low, high = np.zeros((2, len(lane)), dtype=np.int64)
        limit = begin + count + self.width  # windows must end here or before
        hits: list[np.ndarray] = []
        owners: list[np.ndarray] = []
        for back in range(int(count[0]) if len(count) else 0):
            live = int(np.searchsorted(-count, -back, "left"))  # lanes with more windows than that
            start = begin[:live] + count[:live] - 1 - back
            go = np.flatnonzero(full[:live])
            if len(go):
                a, b = self.extend(self.text[start[go]], self.low[low[go]], self.high[low[go]])
                low[go], high[go] = a, b
                full[go] = self.occurrences(a, b) > 1
            fresh = np.flatnonzero(~full[:live] & (start + self.width <= limit[:live]))
            if len(fresh):
                length, a, b = self.match(start[fresh] + self.width)
                full[fresh] = length == self.width
                low[fresh], high[fresh] = a, b
                lost = fresh[length < self.width]
                length = length[length < self.width]
                first = start[lost] + self.width - length - 1
                limit[lost] = self.unrepeated(first, length + 1) - 1
            hit = np.flatnonzero(full[:live])
            hits.append(start[hit])
            owners.append(owner[hit])
        for i, place in zip(np.concatenate(owners or [[]]), np.concatenate(hits or [[]]), strict=True):
            out[int(i)][int(place) - self.offsets[int(i)]] = True
        return out


def _intervals(classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    opens = np.concatenate([[True], classes[1:] != classes[:-1]])
    first = np.flatnonzero(opens)
    number = opens.cumsum() - 1
    return first[number], np.append(first[1:], len(classes))[number]


def runs_of(flags: np.ndarray) -> list[tuple[int, int]]:
    """(first, end) of the runs of true values."""
    step = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return list(zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist(), strict=True))


def window_keys(hashes: np.ndarray, width: int, gram: int) -> np.ndarray:
    """The least n-gram hash of every window of `width` words."""
    return sliding_least(rolling(hashes, gram), width - gram + 1)


def key_runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last + 1 window of every run of equal keys."""
    edges = np.flatnonzero(keys[1:] != keys[:-1]) + 1
    return np.concatenate([[0], edges]), np.concatenate([edges, [len(keys)]])


def _keys(docs: DataFrame, width: int, gram: int) -> DataFrame:
    """(place, key, times): the keys of a document's windows and how often it has their n-gram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _in_blocks(batches, "raw"):
            at, keys, times = [], [], []
            for i, raw in enumerate(batch.column("raw").to_pylist()):
                hashes = word_hashes(raw)[0]
                if len(hashes) >= width:
                    grams = np.sort(rolling(hashes, gram))
                    own = np.unique(window_keys(hashes, width, gram))
                    at.append(np.full(len(own), i))
                    keys.append(own.view(np.int64))
                    times.append(np.searchsorted(grams, own, "right") - np.searchsorted(grams, own))
            if at:
                columns = [
                    batch.column("place").take(pa.array(np.concatenate(at))),
                    pa.array(np.concatenate(keys)),
                    pa.array(np.concatenate(times)),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["place", "key", "times"])

    return docs.select("place", "raw").mapInArrow(run, "place long, key long, times long")


def _segments(marked: DataFrame, width: int, gram: int, with_words: bool) -> DataFrame:
    """The candidate segments: doc_id, body, start (word), route, and words or their digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _in_blocks(batches, "raw"):
            filled, found = 0, _Segments(batch)
            keys_of, often_of = (batch.column(n).to_pylist() for n in ("keys", "often"))
            for i, raw in enumerate(batch.column("raw").to_pylist()):
                hashes = word_hashes(raw)[0]
                if len(hashes) < width:
                    continue
                words = raw.split()
                keys = window_keys(hashes, width, gram).view(np.int64)
                first, end = key_runs(keys)
                wanted = np.isin(keys[first], keys_of[i])
                often = np.isin(keys[first], often_of[i])
                own = rolling(hashes, width).view(np.int64) if (wanted & often).any() else keys
                for r in np.flatnonzero(wanted):
                    spans = [(first[r], end[r])]
                    if often[r]:
                        spans = [(w, w + 1) for w in range(first[r], end[r])]
                    for a, b in spans:
                        content = b" ".join(words[a : b - 1 + width])
                        route = own[a] if often[r] else keys[a]
                        found.add(i, a, route, content if with_words else digest(content))
                        filled += len(content)
                        if filled > BLOCK_BYTES:  # windows of a frequent key repeat their words
                            yield found.batch()
                            filled, found = 0, _Segments(batch)
            yield found.batch()

    kind = marked.schema["doc_id"].dataType.simpleString()
    return marked.mapInArrow(run, f"doc_id {kind}, body long, start long, route long, content binary")


class _Segments:
    """Segments of a batch's documents, collected by column."""

    def __init__(self, docs: pa.RecordBatch) -> None:
        self.docs = docs
        self.columns: tuple[list, ...] = ([], [], [], [])

    def add(self, *values) -> None:
        for column, value in zip(self.columns, values, strict=True):
            column.append(value)

    def batch(self) -> pa.RecordBatch:
        at, starts, routes, contents = self.columns
        rows = pa.array(at, pa.int64())
        columns = [
            *(self.docs.column(name).take(rows) for name in ("doc_id", "body")),
            pa.array(starts, pa.int64()),
            pa.array(routes, pa.int64()),
            pa.array(contents, pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "body", "start", "route", "content"])


def _in_blocks(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from blocks(batch, column, BLOCK_BYTES)


def digest(content: bytes) -> bytes:
    return blake2b(content, digest_size=16).digest()


def _searched(segments: DataFrame, width: int, shard_words: int) -> DataFrame:
    """(route, content, spans): by shard, the repeated windows of every segment as word spans."""

    def search(routes: list, contents: list[bytes], weights: list) -> pa.RecordBatch:
        numbers: dict[bytes, int] = {}
        coded = [
            np.array([numbers.setdefault(w, len(numbers) + 2) for w in c.split()]) for c in contents
        ]
        index = FMIndex(coded, np.array(weights), width)
        out = []
        for route, content, flags in zip(
            routes, contents, index.repeated(np.array([len(c) - width + 1 for c in coded])), strict=True
        ):
            if flags.any():
                spans = [{"start": a, "end": b - 1 + width} for a, b in runs_of(flags)]
                out.append((route, digest(content), spans))
        kinds = [pa.int64(), pa.binary(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
        columns = list(zip(*out)) or [[], [], []]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds)], ["route", "content", "spans"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[], [], []]
        words = 0
        for batch in _in_blocks(batches, "content"):
            for route, content, times in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if words >= shard_words and route != held[0][-1]:
                    found = search(*held)
                    held, words = [[], [], []], 0
                    yield found
                for column, value in zip(held, (route, content, times)):
                    column.append(value)
                words += content.count(b" ") + 1
        if held[0]:
            yield search(*held)

    weighted = segments.groupBy("route", "content").agg(F.count(F.lit(1)).alias("times"))
    shards = weighted.repartition("route").sortWithinPartitions("route", "content")
    return shards.mapInArrow(
        run, "route long, content binary, spans array<struct<start:bigint,end:bigint>>"
    )


def _raw(docs: DataFrame) -> DataFrame:
    """doc_id, raw, body (the text's hash) and place (that of id and text), by which rows are joined.

    Both joins deal the texts by `place` alone, so Spark shuffles them once.
    """
    raw = docs.select("doc_id", whole_text().cast("binary").alias("raw"))
    return raw.withColumn("body", F.xxhash64("raw")).withColumn("place", _place())


def _place() -> Column:
    return F.xxhash64("doc_id", "body")


def repeated_spans(
    docs: DataFrame,
    area: WorkArea,
    width: int = WIDTH,
    gram: int = GRAM,
    frequent: int = FREQUENT,
    shard_words: int = SHARD_WORDS,
) -> DataFrame:
    """(place, found): `found` lists, by doc_id and text digest `body`, the word spans to remove.

    A span covers windows of `width` words whose words also start at another place of any
    document, the same one included. Rows that repeat an id and a text count as documents each.
    Keys are listed by a hash of id and text; rows that share it by chance get each other's keys
    too, which none of their windows has or which are theirs as well.
    """
    raw = _raw(docs)
    keys = _keys(raw, width, gram)
    known = keys.groupBy("key").agg(F.sum("times").alias("times")).filter("times > 1")
    known = area.table(known, "keys")
    own = keys.drop("times").join(known, "key").groupBy("place").agg(
        F.collect_set("key").alias("keys"),
        F.collect_set(F.when(F.col("times") > frequent, F.col("key"))).alias("often"),
    )
    own = area.table(own, "own")
    marked = raw.join(own, "place").select("doc_id", "raw", "body", "keys", "often")
    searched = _searched(_segments(marked, width, gram, True), width, shard_words)
    places = _segments(marked, width, gram, False)
    spans = places.join(searched, ["route", "content"]).select(
        "doc_id", "body", F.explode("spans").alias("s"), "start"
    )
    spans = spans.select("doc_id", "body", (F.col("start") + F.col("s.start")).alias("start"), (F.col("start") + F.col("s.end")).alias("end"))
    by_text = spans.groupBy("doc_id", "body").agg(
        F.sort_array(F.collect_set(F.struct("start", "end"))).alias("spans")
    )
    found = F.collect_list(F.struct("doc_id", "body", "spans")).alias("found")
    return by_text.groupBy(_place().alias("place")).agg(found)


def without_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and text (kept words, one space between) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _in_blocks(batches, "raw"):
            totals, removed, kept = [], [], []
            for raw, found in zip(batch.column("raw").to_pylist(), batch.column("spans").to_pylist()):
                words, left, at = raw.split(), [], 0
                for span in found or ():
                    left += words[at : max(at, span["start"])]
                    at = max(at, span["end"])
                left += words[at:]
                totals.append(len(words))
                removed.append(len(words) - len(left))
                kept.append(b" ".join(left).decode("utf-8", "replace"))
            columns = [batch.column(0), *(pa.array(c, pa.int64()) for c in (totals, removed)), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_removed", "text"])

    left, right = _raw(docs).alias("d"), spans.alias("o")
    joined = left.join(right, F.col("d.place") == F.col("o.place"), "left")
    same = lambda f: f["doc_id"].eqNullSafe(F.col("d.doc_id")) & (f["body"] == F.col("d.body"))
    own = F.get(F.filter("found", same), F.lit(0))["spans"]
    joined = joined.select("d.doc_id", "raw", own.alias("spans"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(run, f"doc_id {kind}, n_words long, n_removed long, text string")


def dedup_substrings(docs: DataFrame, area: WorkArea, width: int = WIDTH, **settings: int) -> DataFrame:
    """Every row without its repeated word windows; see `without_spans` for the columns.

    A null text has no words; texts shorter than a window lose nothing; an empty table gives an
    empty result; null ids stay; columns besides doc_id and text are not read.
    """
    return without_spans(docs, repeated_spans(docs, area, width, **settings))
