"""Line dedup by content-defined chunks.

A rolling hash over the hashes of neighbouring lines closes a chunk wherever it hits a chosen
residue, so an inserted line moves the boundaries near it only. No boundary closes a chunk of fewer
than `LEAST_LINES` lines, and a shorter rest at the end belongs to the chunk before it: only a text
that is shorter itself is a chunk of one line. Chunks of several lines that occur more than once, in
any documents, stay at their first place and go everywhere else. Chunks are found by digest and
compared byte by byte: the grouping key holds the chunk's text.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b, md5

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import whole_text
from tabloom.sources.work import WorkArea

#: Lines under the rolling hash, its multiplier and modulus, and the mean lines of a chunk.
WINDOW = 2
MULTIPLIER = 31
MODULUS = 2_147_483_647
MEAN_LINES = 3
LEAST_LINES = 2


def line_hash(line: str) -> int:
    return int(md5(line.encode("utf-8", "replace")).hexdigest()[:8], 16)


def chunks(
    lines: list[str], window: int = WINDOW, mean_lines: int = MEAN_LINES, least_lines: int = LEAST_LINES
) -> list[tuple[int, int]]:
    """(first line, end) of every chunk; together they cover all lines."""
    out, start, recent = [], 0, []
    for at, line in enumerate(lines):
        recent = [line_hash(line), *recent[: window - 1]]
        rolled = sum(h * MULTIPLIER**k for k, h in enumerate(recent)) % MODULUS
        if rolled % mean_lines == 0 and at + 1 - start >= least_lines:
            out.append((start, at + 1))
            start = at + 1
    if start < len(lines):
        if out and len(lines) - start < least_lines:
            start = out.pop()[0]
        out.append((start, len(lines)))
    return out


def _chunk_rows(docs: DataFrame, with_text: bool, least_lines: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, starts, ends, digests, texts = [], [], [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                lines = text.split("\n")
                for start, end in chunks(lines, least_lines=least_lines):
                    if end - start >= least_lines:
                        chunk = "\n".join(lines[start:end])
                        at.append(i)
                        starts.append(start)
                        ends.append(end)
                        digests.append(blake2b(chunk.encode("utf-8", "replace"), digest_size=16).digest())
                        texts.append(chunk if with_text else None)
            columns = [
                *(batch.column(n).take(pa.array(at, pa.int64())) for n in ("doc_id", "body")),
                pa.array(starts, pa.int64()),
                pa.array(ends, pa.int64()),
                pa.array(digests, pa.binary()),
                pa.array(texts, pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, _NAMES)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, body long, start long, end long, digest binary, chunk string"
    return docs.select("doc_id", "body", "text").mapInArrow(run, schema)


_NAMES = ["doc_id", "body", "start", "end", "digest", "chunk"]


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows with the same id but other texts stay apart by `body`."""
    return docs.select("doc_id", whole_text().alias("text")).withColumn("body", F.xxhash64("text"))


def _place() -> Column:
    """Order of occurrences: null ids last, then by id, body and line."""
    return F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "body", "start")


def repeated_chunks(docs: DataFrame, area: WorkArea, least_lines: int = LEAST_LINES) -> DataFrame:
    """(doc_id, body, spans): the line spans to remove, as an array of (start, end) by document.

    `body` is the text's xxhash64. Rows that repeat both are one document written twice: what is
    removed from one is removed from the other.
    """
    keyed = _keyed(docs)
    texts = _chunk_rows(keyed, True, least_lines)
    firsts = texts.groupBy("digest", "chunk").agg(
        F.min(_place()).alias("first"), F.count(F.lit(1)).alias("times")
    )
    known = firsts.groupBy("digest").agg(
        F.max_by("first", "times").alias("first"),
        F.max("times").alias("times"),
        F.count(F.lit(1)).alias("variants"),
    )
    known = area.table(known.filter("times > 1 OR variants > 1"), "chunks")
    places = _chunk_rows(keyed, False, least_lines).drop("chunk")
    removed = places.join(known.filter("variants = 1"), "digest").filter(_place() != F.col("first"))
    removed = removed.select("doc_id", "body", "start", "end")
    clash = known.filter("variants > 1").select("digest")
    if not clash.isEmpty():  # other chunks of equal digest: only equal texts may meet
        mixed = texts.join(clash, "digest", "left_semi")
        ours = firsts.join(clash, "digest", "left_semi").select("digest", "chunk", "first")
        other = mixed.join(ours, ["digest", "chunk"]).filter(_place() != F.col("first"))
        removed = removed.unionByName(other.select("doc_id", "body", "start", "end"))
    spans = removed.groupBy("doc_id", "body").agg(
        F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans")
    )
    return area.table(spans, "spans")


def without_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed and text (what is left) for every row of `docs`.

    A null text counts as empty, and an empty text has one empty line.
    """
    keyed, found = _keyed(docs).alias("d"), spans.alias("s")
    same = F.col("d.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("d.body") == F.col("s.body"))
    # Neither side has a bound, so both are sorted: one plan at every size.
    joined = keyed.hint("merge").join(found, same, "left").select("d.doc_id", "d.text", "s.spans")
    lines = F.split("text", "\n", -1)
    spans_ = F.coalesce("spans", F.array().cast("array<struct<start:bigint,end:bigint>>"))
    inside = lambda i: F.exists("spans", lambda s: (i >= s["start"]) & (i < s["end"]))
    return joined.withColumns({"lines": lines, "spans": spans_}).select(
        "doc_id",
        F.size("lines").cast("long").alias("n_lines"),
        F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"]).alias("n_removed"),
        F.when(F.size("spans") == 0, F.col("text"))
        .otherwise(F.array_join(F.filter("lines", lambda _, i: ~inside(i)), "\n"))
        .alias("text"),
    )


def dedup_lines(docs: DataFrame, area: WorkArea, least_lines: int = LEAST_LINES) -> DataFrame:
    """Documents without the chunks that occurred before; see `without_spans` for the columns.

    Repeated rows keep what the first of them keeps, an empty table gives an empty result, and
    columns besides doc_id and text are not read.
    """
    return without_spans(docs, repeated_chunks(docs, area, least_lines))
