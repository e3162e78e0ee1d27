"""Collocations by prefix-free parsing.

Content cuts the word sequence of a document into chunks: one starts wherever the hash of `OVERLAP`
neighbouring words says so, and ends with the words the next one starts with. Repeated passages
become repeated chunks, so what is counted is the dictionary of distinct chunks, each weighted with
its frequency in the parse. A word belongs to the chunk that holds it before its overlapping end, and
an n-gram to the chunk that owns its first word: every one lies whole in exactly one chunk.

Phrases are counted by sorting: each owned word gives one key, the up to five words from it on, and
in sorted order all occurrences of a phrase stand together as a run of keys it is a prefix of. Keys
are range-partitioned, runs that reach the edge of a partition are added up afterwards. A filter of
saturating pair counts, of at most `MOST_BUCKETS` cells, ends a key before a pair too rare to matter;
it only shortens keys and never changes a count that is asked for.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.functions.columns import quoted
from tabloom.llm.common import blocks, row_count, whole_text
from tabloom.llm.word_hash import mix, word_hashes
from tabloom.sources.work import WorkArea

LONGEST = 5
LEAST = 100
PER_LANG = 2000
NO_LANG = "und"
#: Words two neighbouring chunks share: an n-gram starting before them ends within them.
OVERLAP = LONGEST - 1
#: One of so many places starts a chunk; without one, a chunk ends after `MOST_WORDS`.
SPACING = 16
MOST_WORDS = 256
#: Bytes of text handled at once (a longer document is handled whole).
BLOCK_BYTES = 4 << 20
#: Cells of the pair filter: one per so many bytes of dictionary, within bounds; cells of a segment.
BYTES_A_BUCKET = 32
LEAST_BUCKETS, MOST_BUCKETS = 1 << 16, 1 << 27
SEGMENT = 1 << 16
#: Keys combined before they are shuffled; chunks sampled for key ranges; dictionary bytes a range.
KEYS_AT_ONCE = 1_500_000
SAMPLED_CHUNKS = 4000
BYTES_A_RANGE = 32 << 20
#: Parts of a phrase wanted by more than a thousandth of all cuts: at most a thousand of them.
HOT_SHARE = 1000
#: Totals of so many languages are sent to every executor; more are joined.
FEW_LANGS = 10_000

# Characters between words and characters that end a piece.
BLANKS = b" \t"
BREAKS = b".,;:!?\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_KIND = np.zeros(256, dtype=np.int8)
_KIND[list(BLANKS)] = 1
_KIND[list(BREAKS)] = 2
_SPACE, _BREAK = 0x20, 0x0A
_NEVER = 1 << 40


def mine_collocations(
    docs: DataFrame,
    area: WorkArea,
    text_col: str = "text",
    lang_col: str = "lang",
    least: int = LEAST,
    per_lang: int = PER_LANG,
) -> DataFrame:
    """The best phrases of each language: `lang`, `rank`, `phrase`, `a`, `l`, `r`, `n`, `score`.

    Letters A-Z count as a-z; a phrase of 2 to 5 words never crosses `.,;:!?` or a line end. `a`
    counts it (overlaps included), `n` all words of the language, `l` and `r` the parts of the cut
    with the lowest score floor(1000 a n / (l r)), ties to the shortest first part. A phrase
    inside a longer one that is as frequent goes. Order: score, `a`, then bytes of the phrase.

    Null texts are empty, a null language is `und`; texts of any length are read whole; repeated
    rows count each time; an empty table gives no rows. Other columns are not read, so their names
    can't clash. `area` must live until the result has been used.
    """
    counts = phrase_counts(docs, area, text_col, lang_col, least)
    return rank_phrases(counts, area, per_lang)


def phrase_counts(
    docs: DataFrame, area: WorkArea, text_col: str, lang_col: str, least: int
) -> DataFrame:
    """(lang, key, words, rows): all phrases of up to 5 words with `least` occurrences or more.

    `key` holds the words with NUL between them; no words at all stands for every word of `lang`.
    """
    read = docs.select(
        F.coalesce(quoted(lang_col), F.lit(NO_LANG)).alias("lang"),
        whole_text(quoted(text_col)).cast("binary").alias("text"),
    )
    parsed = read.mapInArrow(_parse, "lang string, chunk binary, rows long")
    chunks = parsed.groupBy("lang", "chunk").agg(F.sum("rows").alias("rows"))
    chunks = area.table(chunks, "dictionary")
    size, entries = chunks.agg(F.sum(F.octet_length("chunk")), F.count(F.lit(1))).first()
    allowed = _frequent(chunks, size or 0, least)
    splits = _splitters(chunks, entries, size or 0, allowed)
    keys = chunks.mapInArrow(_keys_of(allowed, splits), "part int, key binary, rows long")
    ordered = keys.repartitionById(len(splits) + 1, F.col("part")).sortWithinPartitions("key")
    runs = ordered.select("key", "rows").mapInArrow(_runs_of(least), "key binary, rows long")
    found = runs.groupBy("key").agg(F.sum("rows").alias("rows"))
    text = F.col("key").cast("string")
    cut = F.instr(text, "\0")
    named = found.select(
        _plain(F.when(cut > 0, text.substr(F.lit(1), cut - 1)).otherwise(text)).alias("lang"),
        F.when(cut > 0, text.substr(cut + 1, F.length(text))).otherwise("").alias("key"),
        "rows",
    )
    size = F.when(F.col("key") == "", 0).otherwise(F.size(F.split("key", "\0")))
    kept = named.withColumn("words", size).filter((F.col("rows") >= least) | (F.col("words") == 0))
    return area.table(kept, "phrases")


def rank_phrases(counts: DataFrame, area: WorkArea, per_lang: int) -> DataFrame:
    candidates = counts.filter("words > 1").select("lang", "key", "words", F.col("rows").alias("a"))
    cuts = candidates.select(
        "*", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k")
    )
    first = _words_of("key", F.lit(1), F.col("k"))
    rest = _words_of("key", F.col("k") + 1, F.col("words") - F.col("k"))
    cuts = area.table(cuts.withColumns({"first": first, "rest": rest}), "cuts")
    everything = cuts.agg(F.count(F.lit(1))).first()[0]
    scored = _look_up(cuts, counts, "first", "l", everything)
    scored = _look_up(scored, counts, "rest", "r", everything)
    totals = counts.filter("words = 0").select("lang", F.col("rows").alias("n"))
    few = row_count(totals) <= FEW_LANGS
    scored = scored.join(F.broadcast(totals) if few else totals, "lang")
    wide = "decimal(20,0)"
    score = F.expr(f"CAST(1000 * a AS {wide}) * CAST(n AS {wide}) div (CAST(l AS {wide}) * CAST(r AS {wide}))")
    best = scored.withColumn("score", score).groupBy("lang", "key").agg(
        F.min(F.struct("score", "k", "l", "r", "a", "n")).alias("best")
    )
    inside = candidates.filter("words > 2").select(
        "lang",
        F.explode(
            F.flatten(
                F.transform(
                    F.sequence(F.lit(2), F.col("words") - 1),
                    lambda size: F.transform(
                        F.sequence(F.lit(1), F.col("words") - size + 1),
                        lambda start: _words_of("key", start, size),
                    ),
                )
            )
        ).alias("key"),
        F.col("a").alias("longer"),
    )
    covered = inside.groupBy("lang", "key").agg(F.max("longer").alias("longer"))
    left = best.join(covered, ["lang", "key"], "left").filter(
        F.col("longer").isNull() | (F.col("longer") < F.col("best.a"))
    )
    phrase = _plain(F.replace("key", F.lit("\0"), F.lit(" ")))
    rows = left.select("lang", phrase.alias("phrase"), "best.a", "best.l", "best.r", "best.n", "best.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = rows.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= per_lang)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _words_of(key: str, start: Column, size: Column) -> Column:
    return F.array_join(F.slice(F.split(key, "\0"), start, size), "\0")


def _plain(text: Column) -> Column:
    """Undo `_escaped`, once the separators are gone."""
    return F.replace(F.replace(text, F.lit("\1\1"), F.lit("\0")), F.lit("\1\2"), F.lit("\1"))


def _look_up(cuts: DataFrame, counts: DataFrame, part: str, out: str, everything: int) -> DataFrame:
    """Add the occurrences of a part; those wanted very often are few and looked up by broadcast."""
    wanted = counts.filter("words > 0").select("lang", F.col("key").alias(part), F.col("rows").alias(out))
    often = cuts.groupBy("lang", part).agg(F.count(F.lit(1)).alias("uses"))
    often = often.filter(F.col("uses") * HOT_SHARE > everything).join(wanted, ["lang", part])
    often = often.select("lang", part, F.col(out).alias("often"))
    marked = cuts.join(F.broadcast(often), ["lang", part], "left")
    hot = marked.filter("often IS NOT NULL").withColumnRenamed("often", out)
    rest = marked.filter("often IS NULL").drop("often").join(wanted, ["lang", part])
    return hot.unionByName(rest)


# --- Parsing ----------------------------------------------------------------------------


def _summed(names: list[str], arrays: list, rows: pa.Array | pa.ChunkedArray) -> pa.Table:
    """Equal rows as one, their numbers added up."""
    table = pa.table([*arrays, rows], names=[*names, "rows"])
    grouped = table.group_by(names, use_threads=False).aggregate([("rows", "sum")])
    return grouped.select([*names, "rows_sum"]).rename_columns([*names, "rows"]).combine_chunks()


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in blocks(batch, "text", BLOCK_BYTES):
            docs, chunks = parse_texts(block["text"].to_pylist())
            langs = block["lang"].take(pa.array(docs))
            ones = pa.array(np.ones(len(docs), np.int64))
            yield from _summed(["lang", "chunk"], [langs, pa.array(chunks, pa.binary())], ones).to_batches()


def parse_texts(texts: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    """Chunks with the number of their text. The last chunk of a text ends with a line feed."""
    text, first = _one_form(texts)
    hashes, starts, ends = word_hashes(text)
    place = np.arange(len(hashes))
    doc = np.searchsorted(first, place, "right") - 1
    last = first[1:][doc]  # the end of the word's document
    window = np.zeros(len(hashes), np.uint64)
    count = max(len(hashes) - OVERLAP + 1, 0)
    for step in range(OVERLAP if count else 0):
        window[:count] = mix(window[:count] * np.uint64(31) + hashes[step : step + count])
    whole = place + OVERLAP <= last
    opens = (place == first[doc]) | (whole & (window % np.uint64(SPACING) == 0))
    since = place - np.maximum.accumulate(np.where(opens, place, 0))
    opens |= whole & (since > 0) & (since % MOST_WORDS == 0)
    opened = np.flatnonzero(opens)
    follows = np.append(opened[1:], len(hashes))
    final = follows >= last[opened]
    until = np.where(final, last[opened], np.minimum(follows + OVERLAP, len(hashes)))
    spans = zip(starts[opened].tolist(), ends[until - 1].tolist(), final.tolist(), strict=True)
    return doc[opened], [text[s:e] + b"\n" if whole else text[s:e] for s, e, whole in spans]


def _one_form(texts: list[bytes]) -> tuple[bytes, np.ndarray]:
    """All texts in lower case, one space between words and one line feed between pieces.

    Also the number of the first word of each text, and the number of words.
    """
    raw = np.frombuffer(b"\n".join([*texts, b""]).lower(), dtype=np.uint8)
    kind = _KIND[raw]
    word = kind == 0
    after = np.flatnonzero(word[:-1] & ~word[1:]) + 1  # the byte after each word
    opening = np.flatnonzero(word & ~np.concatenate(([False], word[:-1])))
    broken = np.concatenate(([0], np.cumsum(kind == 2)))
    until = np.append(opening[1:], len(raw))
    held = raw.copy()
    held[after] = np.where(broken[until] > broken[after], _BREAK, _SPACE)
    word[after] = True
    sizes = np.array([len(text) + 1 for text in texts], dtype=np.int64)
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    return held[word].tobytes(), np.searchsorted(opening, offsets)


class _Words:
    """The words of a batch of chunks: hashes, places, owner chunk, what follows."""

    def __init__(self, block: pa.RecordBatch) -> None:
        chunks = block["chunk"].to_pylist()
        self.text = b"\n".join([*chunks, b""])
        self.hashes, self.starts, self.ends = word_hashes(self.text)
        offsets = np.concatenate(([0], np.cumsum([len(chunk) + 1 for chunk in chunks])))
        first = np.searchsorted(self.starts, offsets)
        self.chunk = np.repeat(np.arange(len(chunks)), np.diff(first))
        tail = np.array([0 if chunk.endswith(b"\n") else OVERLAP for chunk in chunks], dtype=np.int64)
        self.owned = np.arange(len(self.hashes)) < (first[1:] - tail)[self.chunk]
        self.rows = block["rows"].to_numpy()
        # Does a pair of one piece start here?
        self.pairs = np.frombuffer(self.text, np.uint8)[self.ends] == _SPACE
        langs = block["lang"].to_pylist()
        salts = {lang: zlib.crc32(lang.encode()) for lang in set(langs)}
        self.langs, salt = langs, np.array([salts[lang] for lang in langs], dtype=np.uint64)
        follow = np.append(self.hashes[1:], np.uint64(0))
        self.pair_hash = mix(self.hashes * np.uint64(31) + follow + mix(salt)[self.chunk])


# --- The filter -------------------------------------------------------------------------


def _frequent(chunks: DataFrame, size: int, least: int):
    """Broadcast bits: may a pair of this hash occur `least` times? At most 16 MB, no misses."""
    buckets = LEAST_BUCKETS
    while buckets < min(size // BYTES_A_BUCKET, MOST_BUCKETS):
        buckets *= 2
    enough = min(least, 255)
    counted = chunks.mapInArrow(_count_cells(buckets), "segment int, cells binary")
    merged = (
        counted.repartition("segment")
        .sortWithinPartitions("segment")
        .mapInArrow(_merge_cells(enough), "segment int, bits binary")
    )
    bits = np.zeros(buckets // 8, dtype=np.uint8)
    for row in merged.collect():
        at = row["segment"] * (SEGMENT // 8)
        bits[at : at + SEGMENT // 8] = np.frombuffer(row["bits"], dtype=np.uint8)
    return chunks.sparkSession.sparkContext.broadcast(bits)


def _count_cells(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(buckets, dtype=np.uint8)
        for batch in batches:
            for block in blocks(batch, "chunk", BLOCK_BYTES):
                words = _Words(block)
                at = np.flatnonzero(words.owned & words.pairs)
                bucket = words.pair_hash[at] & np.uint64(buckets - 1)
                order = np.argsort(bucket)
                bucket, rows = bucket[order], words.rows[words.chunk[at[order]]]
                heads = np.flatnonzero(np.diff(bucket, prepend=np.uint64(buckets)))
                if len(heads):
                    found = bucket[heads].astype(np.int64)
                    sums = np.add.reduceat(rows, heads)
                    cells[found] = np.minimum(cells[found] + np.minimum(sums, 255), 255)
        for segment in range(buckets // SEGMENT):
            part = cells[segment * SEGMENT : (segment + 1) * SEGMENT]
            if part.any():
                packed = zlib.compress(part.tobytes(), 1)
                yield pa.record_batch(
                    [pa.array([segment], pa.int32()), pa.array([packed], pa.binary())], ["segment", "cells"]
                )

    return run


def _merge_cells(enough: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = None, None

        def bits():
            packed = np.packbits(total >= enough, bitorder="little").tobytes()
            return pa.record_batch([pa.array([held], pa.int32()), pa.array([packed], pa.binary())], ["segment", "bits"])

        for batch in batches:
            for segment, cells in zip(batch["segment"].to_pylist(), batch["cells"].to_pylist(), strict=True):
                part = np.frombuffer(zlib.decompress(cells), dtype=np.uint8).astype(np.uint16)
                if segment != held:
                    if held is not None:
                        yield bits()
                    held, total = segment, np.zeros(SEGMENT, dtype=np.uint16)
                total = np.minimum(total + part, 255).astype(np.uint16)
        if held is not None:
            yield bits()

    return run


# --- Keys and their runs ----------------------------------------------------------------


def _escaped(text: bytes) -> bytes:
    """Frees NUL, which sorts before every other byte, for separators."""
    return text.replace(b"\1", b"\1\2").replace(b"\0", b"\1\1")


def _splitters(chunks: DataFrame, entries: int, size: int, allowed) -> list[bytes]:
    """Bounds of key ranges of like size, from a bounded sample; they never change a result."""
    spark = chunks.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // BYTES_A_RANGE)
    some = chunks.sample(min(1.0, SAMPLED_CHUNKS / max(entries, 1)), seed=0)
    drawn = some.mapInArrow(_keys_of(allowed, []), "part int, key binary, rows long").select("key").collect()
    keys = sorted(bytes(row["key"]) for row in drawn)
    return sorted({keys[len(keys) * number // parts] for number in range(1, parts)}) if keys else []


def _keys_of(allowed, splits: list[bytes]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, bounds = allowed.value, np.array(splits, dtype=object)
        mask = np.uint64(len(bits) * 8 - 1)

        def held(hashes: np.ndarray) -> np.ndarray:
            bucket = (hashes & mask).astype(np.int64)
            return ((bits[bucket >> 3] >> (bucket & 7).astype(np.uint8)) & 1).astype(bool)

        def combined(tables: list[pa.Table]) -> Iterator[pa.RecordBatch]:
            """Rows of several blocks, those of one key added up, with the range they belong to."""
            table = pa.concat_tables(tables)
            for part in _summed(["key"], [table["key"]], table["rows"]).to_batches():
                to = np.searchsorted(bounds, part["key"].to_numpy(zero_copy_only=False), "right")
                numbers = pa.array(to, pa.int32())
                yield pa.record_batch([numbers, part["key"], part["rows"]], ["part", "key", "rows"])

        tables: list[pa.Table] = []
        for batch in batches:
            for block in blocks(batch, "chunk", BLOCK_BYTES):
                words = _Words(block)
                joins = words.pairs & held(words.pair_hash)
                at = np.flatnonzero(words.owned)
                reach, going = at.copy(), np.ones(len(at), dtype=bool)
                for _ in range(LONGEST - 1):
                    going &= joins[reach]
                    reach = reach + going
                text, chunk = words.text, words.chunk[at]
                heads = [_escaped(lang.encode()) + b"\0" for lang in words.langs]
                spans = zip(chunk.tolist(), words.starts[at].tolist(), words.ends[reach].tolist(), strict=True)
                if b"\0" in text or b"\1" in text:
                    keys = [heads[c] + _escaped(text[s:e]).replace(b" ", b"\0") for c, s, e in spans]
                else:
                    text = text.replace(b" ", b"\0")
                    keys = [heads[c] + text[s:e] for c, s, e in spans]
                rows = pa.array(words.rows[chunk])
                tables.append(_summed(["key"], [pa.array(keys, pa.binary())], rows))
                if sum(map(len, tables)) > KEYS_AT_ONCE:
                    yield from combined(tables)
                    tables = []
        if tables:
            yield from combined(tables)

    return run


def _runs_of(least: int):
    """From sorted keys, the rows of every prefix of whole words with `least` rows or more.

    A run at the first or last row of the partition may go on in another: its part is given
    however small.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = range(LONGEST + 1)
        held: list[bytes | None] = [None] * len(levels)  # the prefix whose run is open
        sums, edge = [0] * len(levels), [False] * len(levels)
        before = None
        for batch in batches:
            if not len(batch):
                continue
            keys, opening = batch["key"], before is None
            ends, shared = _compare(keys, before)
            before = keys[len(batch) - 1].as_py()
            rows = np.concatenate(([0], np.cumsum(batch["rows"].to_numpy())))
            found: list[tuple[bytes, int]] = []
            for level in levels:
                breaks = np.flatnonzero(shared < ends[:, level])
                if not len(breaks):
                    sums[level] += int(rows[-1])
                    continue
                total = sums[level] + int(rows[breaks[0]])
                if held[level] is not None and (edge[level] or total >= least):
                    found.append((held[level], total))
                size = np.diff(rows[np.append(breaks, len(batch))])
                has = ends[breaks, level] < _NEVER
                given = has & (size >= least)
                given[0] |= opening & has[0]
                for at in np.flatnonzero(given[:-1]).tolist():
                    first = int(breaks[at])
                    found.append((keys[first].as_py()[: ends[first, level]], int(size[at])))
                final = int(breaks[-1])
                held[level] = keys[final].as_py()[: ends[final, level]] if has[-1] else None
                sums[level], edge[level] = int(size[-1]), opening and final == 0
            if found:
                yield _pairs(found)
        last = [(prefix, total) for prefix, total in zip(held, sums, strict=True) if prefix is not None]
        if last:
            yield _pairs(last)

    return run


def _pairs(found: list[tuple[bytes, int]]) -> pa.RecordBatch:
    keys, rows = zip(*found, strict=True)
    return pa.record_batch([pa.array(keys, pa.binary()), pa.array(rows, pa.int64())], ["key", "rows"])


def _compare(keys: pa.BinaryArray, before: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """Where each key's prefixes end (language, then 1 to 5 words), and how many leading bytes it
    shares with the key before it. The first key of all shares -1 bytes.

    In sorted order NUL, the least byte, can differ only from the end of the key before: a prefix
    that ends within the shared bytes, or right after them, is a prefix of that key too.
    """
    offsets = np.frombuffer(keys.buffers()[1], np.int32, len(keys) + 1, keys.offset * 4).astype(np.int64)
    data = np.frombuffer(keys.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    offsets -= offsets[0]
    sizes = np.diff(offsets)
    ends = np.full((len(keys), LONGEST + 2), _NEVER, dtype=np.int64)
    nul = np.flatnonzero(data == 0)
    row = np.searchsorted(offsets, nul, "right") - 1
    nth = np.arange(len(nul)) - np.searchsorted(nul, offsets[:-1])[row]
    ends[row, nth] = nul - offsets[row]
    ends[np.arange(len(keys)), np.bincount(row, minlength=len(keys))] = sizes

    earlier = np.frombuffer(before or b"", np.uint8)
    stretch = np.concatenate((earlier, data))
    starts = np.concatenate(([0], offsets[:-1] + len(earlier)))
    lengths = np.concatenate(([len(earlier)], sizes))
    both = np.minimum(lengths[1:], lengths[:-1])
    filled = np.concatenate(([0], np.cumsum(both)))
    inner = np.arange(filled[-1]) - np.repeat(filled[:-1], both)
    differ = stretch[np.repeat(starts[1:], both) + inner] != stretch[np.repeat(starts[:-1], both) + inner]
    wrong = np.flatnonzero(differ)
    first = np.searchsorted(wrong, filled[:-1])
    at = np.append(wrong, _NEVER)[first] - filled[:-1]
    shared = np.minimum(at, both)
    if before is None:
        shared[0] = -1
    return ends[:, : LONGEST + 1], shared
