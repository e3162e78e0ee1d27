"""Quality classifier: boosted trees over statistics of the whole text.

The statistics are computed in the tasks, the trees are grown on the driver from a bounded sample
of labelled rows (`labelled.SAMPLE_ROWS`), and the flattened trees travel to the tasks.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm import boosting
from tabloom.llm.common import blocks
from tabloom.llm.labelled import SAMPLE_ROWS, features_of, scored, training_sample

THRESHOLD = 0.3
#: Bytes of texts that become Python strings at once.
_TEXT_BYTES = 1 << 20
_DIGITS, _UPPER, _LOWER = (slice(ord(a), ord(z) + 1) for a, z in ("09", "AZ", "az"))
_PROSE_MARKS = [ord(c) for c in " \t\n\r.,;:?'\"()-"]

STATISTICS = (
    "log_words", "word_length", "letters", "upper", "digits", "marks", "exclaims", "stops",
    "marked_ends", "lone", "distinct", "top_word", "top_ten", "twice_running", "capitalised",
    "log_lines", "line_words", "lines_again", "line_ends", "longest",
)


def statistics(text: str) -> list[float]:
    """Numbers that describe a whole text; a text without words is all zeros.

    Bytes are counted by class; those beyond ASCII count as letters. Words and lines here are
    Python's, since they only describe the text.
    """
    words = text.split()
    if not words:
        return [0.0] * len(STATISTICS)
    raw = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256)
    upper, digits = raw[_UPPER].sum(), raw[_DIGITS].sum()
    letters = upper + raw[_LOWER].sum() + raw[128:].sum()
    marks = raw[:128].sum() - digits - upper - raw[_LOWER].sum() - raw[_PROSE_MARKS].sum()
    n, size = len(words), max(1, raw.sum())
    lengths = np.fromiter(map(len, words), np.int64, n)
    seen = Counter(words)
    often = [c for _, c in seen.most_common(10)]
    lines = [line for line in text.split("\n") if line]
    lasts = "".join([w[-1] for w in words])
    plain = len(lasts) - sum(map(lasts.count, "*$%&#!|+=~^<>{}[]@/\\_"))
    return [
        float(np.log1p(n)),
        lengths.mean(),
        letters / size,
        upper / max(1, letters),
        digits / size,
        marks / size,
        raw[ord("!")] / n,
        raw[ord(".")] / n,
        1 - plain / n,
        (lengths == 1).mean(),
        len(seen) / n,
        often[0] / n,
        sum(often) / n,
        sum(map(str.__eq__, words, words[1:])) / n,
        sum([w[0].isupper() for w in words]) / n,
        float(np.log1p(len(lines))),
        n / max(1, len(lines)),
        1 - len(set(lines)) / max(1, len(lines)),
        sum(line[-1] in ".!?" for line in lines) / max(1, len(lines)),
        float(lengths.max()),
    ]


def table_of(texts) -> np.ndarray:
    return np.array([statistics(t) for t in texts], dtype=np.float64).reshape(-1, len(STATISTICS))


def fit_quality(
    docs: DataFrame, labels: DataFrame, target: str = "quality", sample_rows: int = SAMPLE_ROWS
) -> boosting.Trees:
    """Trees learnt from the labelled sample; without labelled rows every score is 0.5."""

    sample = training_sample(docs, labels, target, sample_rows)
    return boosting.fit(*features_of(sample, STATISTICS, lambda: table_of))


def score_quality(
    docs: DataFrame, model: boosting.Trees, threshold: float = THRESHOLD
) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of `docs`, repeated rows included.

    A null text counts as empty and gets the score of an empty text. A null id is not held out.
    """

    return scored(docs, lambda: lambda texts: model.probability(table_of(texts)), threshold)


def keep_good(docs: DataFrame, model: boosting.Trees, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs` that are not rejected, with all their columns."""

    def probability(text: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([text.fill_null("")], ["text"])
        parts = (block.column("text").to_pylist() for block in blocks(batch, "text", _TEXT_BYTES))
        scores = [model.probability(table_of(part)) for part in parts]
        return pa.array(np.concatenate([np.zeros(0), *scores]))

    predicted = F.arrow_udf(probability, "double")
    return docs.filter(predicted(F.col("text")) >= threshold)
