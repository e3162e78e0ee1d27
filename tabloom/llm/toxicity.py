"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on ordinary and one on toxic text, and each put behind
the same base, which is trained on other ordinary text: common words cost the same under both, so that
a difference in length tells of the class. A window of a text that the toxic dictionary shortens
more than the ordinary one resembles toxic text. The windows' differences are summed up per
document, and small boosted trees, fitted on the training rows, calibrate them into a score.

Most windows of a toxic document are ordinary text. The toxic dictionary is therefore trained on
those words of toxic documents that begin in a way typical of them: with much more different
neighbours in toxic than in ordinary training text. Counting neighbours instead of occurrences keeps
copied documents from making their own words look typical.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm import boosting
from tabloom.llm.common import WORDS
from tabloom.llm.labelled import features_of, scored, training_sample
from tabloom.sources.work import WorkArea

THRESHOLD = 0.5
#: Training rows at most, half of them toxic.
SAMPLE_ROWS = 10_000
SEGMENT = (4, 12)
LEAST_CONTEXTS = 4
LEAST_ODDS = 8.0
#: Of the likelihood ratio test; there are millions of segments, so chance alone reaches about 20.
LEAST_EVIDENCE = 20.0
#: Sizes of the trained dictionaries.
BASE_BYTES = 4096
CLASS_BYTES = 8192
#: Different windows of ordinary training text that the base is trained on, at most; as many more
#: train the ordinary dictionary. A hash chooses them among those of the sampled rows.
TRAIN_WINDOWS = 60_000
#: Lengths of the pieces that zstandard's trainer counts and joins.
_TRAINING = dict(k=16, d=6)
#: Put behind a word it is trained on: the trainer leaves out pieces near the end of a sample.
_PAD = b" " * 6
WINDOW = 32
_SETTINGS = dict(
    window_log=14, hash_log=13, chain_log=13, search_log=5, min_match=5, target_length=16,
    strategy=zstandard.STRATEGY_LAZY2, write_content_size=False, write_checksum=False,
    write_dict_id=False,
)


@dataclass(frozen=True)
class ToxicityModel:
    ordinary: bytes
    toxic: bytes
    trees: boosting.Trees


def windows(text: str, size: int = WINDOW) -> list[bytes]:
    """The whole text in runs of words of about `size` bytes, with a space at either end."""
    raw = text.lower().encode("utf-8", "replace")
    out, start = [], 0
    while start < len(raw):
        end = start + size
        if end < len(raw):
            space = raw.find(b" ", end, end + size)
            end = space if space >= 0 else end + size
        out.append(b" " + raw[start:end].strip() + b" ")
        start = end
    return out or [b""]


class Distance:
    """How much shorter windows get with the toxic than with the ordinary dictionary."""

    def __init__(self, ordinary: bytes, toxic: bytes) -> None:
        settings = zstandard.ZstdCompressionParameters(**_SETTINGS)
        self.compress = []
        for content in (ordinary, toxic):
            held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(compression_params=settings)
            self.compress.append(
                zstandard.ZstdCompressor(dict_data=held, compression_params=settings).compress
            )

    def features(self, text: str) -> list[float]:
        plain, toxic = self.compress
        saved = np.array([len(plain(w)) - len(toxic(w)) for w in windows(text)])
        top = np.sort(saved)[::-1][:3]
        return [
            float(saved.max()),
            float(top.sum()),
            float(saved.mean()),
            float((saved >= 3).mean()),
            float((saved >= 5).mean()),
            float((saved >= 3).sum()),
            float((saved >= 5).sum()),
            float(np.maximum(saved - 2, 0).sum()),
            float(np.log1p(len(saved))),
        ]

    def table(self, texts) -> np.ndarray:
        return np.array([self.features(t) for t in texts], dtype=np.float64).reshape(-1, FEATURES)


FEATURES = 9


def train_dictionaries(sample: DataFrame, area: WorkArea) -> tuple[bytes, bytes]:
    """(ordinary, toxic) contents from (text, label) rows; without toxic text they are equal.

    Windows and words are taken in an order of their own, so reruns give the same bytes. Copies of
    a text add nothing. Null texts count as empty; an empty table gives two empty contents.
    """
    chosen = _ordinary_windows(sample)
    base = _trained(chosen[::2], BASE_BYTES)
    toxic = _trained(_typical_words(sample, area), CLASS_BYTES)
    # Matches further back cost more, so the base lies equally far from the end of both.
    ordinary = _trained(chosen[1::2], max(_LEAST_BYTES, len(toxic)))
    length = min(len(ordinary), len(toxic))
    return base + ordinary[len(ordinary) - length :], base + toxic[len(toxic) - length :]


#: zstandard trains no smaller dictionary.
_LEAST_BYTES = 256


def _trained(samples: list[bytes], size: int) -> bytes:
    """A dictionary that zstandard trains; of samples too few to train on, they themselves."""
    try:
        return zstandard.train_dictionary(size, samples, **_TRAINING).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def _ordinary_windows(sample: DataFrame) -> list[bytes]:
    """Different windows of ordinary rows, at most twice `TRAIN_WINDOWS`, chosen by a hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column("text").to_pylist():
                found = pa.array(sorted(set(windows(text or ""))), pa.binary())
                yield pa.RecordBatch.from_arrays([found], ["part"])

    parts = sample.filter("label = 0").select("text").mapInArrow(run, "part binary").distinct()
    parts = parts.orderBy(F.xxhash64("part"), "part").limit(2 * TRAIN_WINDOWS)
    return [bytes(r["part"]) for r in parts.collect()]


def _typical_words(sample: DataFrame, area: WorkArea) -> list[bytes]:
    """Words of toxic rows with typical beginnings, each once for every different neighbour."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(WORDS), 0)
    following = F.concat(F.slice("words", 2, F.greatest(F.size("words"), F.lit(1))), F.array(F.lit("")))
    pairs = sample.filter("text IS NOT NULL").select("label", words.alias("words")).select(
        "label", F.explode(F.arrays_zip(F.col("words"), following.alias("next"))).alias("p")
    )
    counts = [F.count_if(F.col("label") == k).alias(name) for k, name in ((1, "toxic"), (0, "plain"))]
    words = pairs.select("label", "p.words", "p.next").distinct().groupBy("words").agg(*counts)
    words = area.table(words, "words")
    spaced = F.concat(F.lit(" "), F.col("words"), F.lit(" "))
    least, most = SEGMENT
    starts = F.transform(
        F.sequence(F.lit(least), F.greatest(F.lit(least), F.least(F.lit(most), F.length(spaced)))),
        lambda k: F.substring(spaced, F.lit(1), k),
    )
    begun = words.select("words", F.explode(starts).alias("segment"), "toxic", "plain")
    segments = begun.groupBy("segment").agg(F.sum("toxic").alias("toxic"), F.sum("plain").alias("plain"))
    sums = words.agg(F.sum("toxic").alias("toxic"), F.sum("plain").alias("plain")).first()
    of_toxic, of_plain = max(1, sums["toxic"] or 0), max(1, sums["plain"] or 0)
    odds = (F.col("toxic") / of_toxic) / ((F.col("plain") + 0.5) / of_plain)
    both = F.col("toxic") + F.col("plain")
    evidence = 2 * (
        F.col("toxic") * F.log(F.col("toxic") / both * (of_toxic + of_plain) / of_toxic)
        + F.col("plain") * F.log(F.greatest("plain", F.lit(0.5)) / both * (of_toxic + of_plain) / of_plain)
    )
    enough = (F.col("toxic") >= LEAST_CONTEXTS) & (odds > LEAST_ODDS)
    typical = segments.filter(enough & (evidence > LEAST_EVIDENCE)).select("segment")
    found = begun.filter("toxic > 0").join(typical, "segment", "left_semi")
    found = found.select("words", "toxic").distinct()
    # The trainer looks at stretches of its input: equal words must not lie side by side.
    each = found.select("words", F.explode(F.sequence(F.lit(1), F.col("toxic"))).alias("at"))
    each = each.orderBy(F.md5(F.concat_ws(" ", "at", "words")), "words", "at")
    return [f" {r['words']} ".encode("utf-8", "replace") + _PAD for r in each.collect()]


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    area: WorkArea,
    target: str = "toxic",
    sample_rows: int = SAMPLE_ROWS,
) -> ToxicityModel:
    """Dictionaries and calibration from a bounded sample of labelled rows.

    Without labels every score is 0.5. Other columns are not read.
    """
    sample = area.table(training_sample(docs, labels, target, sample_rows, balanced=True), "sample")
    ordinary, toxic = train_dictionaries(sample, area)
    names = [f"f{i}" for i in range(FEATURES)]
    found = features_of(sample, names, lambda: Distance(ordinary, toxic).table)
    return ToxicityModel(ordinary, toxic, boosting.fit(*found, trees=40, depth=3, rate=0.15))


def score_toxicity(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of `docs`, repeated rows included.

    A null text counts as empty and scores as an empty text. A null id is not held out. Every
    window of a long text is compressed; an empty table gives an empty result; other columns are
    not read.
    """

    def make():
        distance = Distance(model.ordinary, model.toxic)
        return lambda texts: model.trees.probability(distance.table(texts))

    return scored(docs, make, threshold)
