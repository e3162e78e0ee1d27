"""What several corpus operators share: word and text expressions, reading, work tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.sources.work import WorkArea

#: White space is the space and the control characters 9 to 13; a word is a run of anything else.
SPACES = r"[\x20\x09-\x0D]+"
WORDS = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(column: str | Column = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORDS)).cast("long")


def held_out(doc_id: Column) -> Column:
    """Rows kept away from training: crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def blocks(batch: pa.RecordBatch, column: str, size: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose strings or bytes in `column` fill about `size` bytes each."""
    if not len(batch):
        return
    offsets = np.frombuffer(batch[column].buffers()[1], np.int32, len(batch) + 1, batch[column].offset * 4)
    filled, start = offsets[1:].astype(np.int64) - offsets[0], 0
    while start < len(batch):
        before = filled[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(filled, before + size, "right")))
        yield batch.slice(start, end - start)
        start = end


def row_count(df: DataFrame) -> int:
    return df.agg(F.count(F.lit(1))).first()[0]


def session_area(spark: SparkSession, label: str) -> WorkArea:
    """Work tables a lazy result still reads: they go when the Python process ends."""
    return WorkArea.until_exit(spark, label)
