"""Training rows for classifiers: a bounded sample of labelled documents."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import held_out

#: At most about this many labelled rows reach the driver; fewer labelled rows are all used.
SAMPLE_ROWS = 20_000
_PARTS = 1_000_000


def training_sample(
    docs: DataFrame,
    labels: DataFrame,
    target: str,
    sample_rows: int = SAMPLE_ROWS,
    balanced: bool = False,
) -> DataFrame:
    """(doc_id, text, label) of the labelled rows that may be learnt from.

    Rows whose crc32(doc_id) is divisible by 5 are kept away. Where more rows are labelled than
    `sample_rows`, a hash of the id chooses that many; `balanced` takes half of them, or all there
    are, from label 1. A null label counts as unlabelled; of
    contradicting labels of one document the larger holds.
    """
    usable = labels.filter(F.col(target).isNotNull() & F.col("doc_id").isNotNull())
    usable = usable.filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(
        F.max((F.col(target) > 0).cast("int")).alias("label")
    )
    counts = {r["label"]: r["count"] for r in usable.groupBy("label").count().collect()}
    rows = sum(counts.values())
    ones = counts.get(1, 0)
    if balanced:
        shares = sample_rows / 2 / max(1, rows - ones), sample_rows / 2 / max(1, ones)
    else:
        shares = (sample_rows / max(1, rows),) * 2
    limit = F.when(F.col("label") == 1, int(min(1.0, shares[1]) * _PARTS))
    limit = limit.otherwise(int(min(1.0, shares[0]) * _PARTS))
    chosen = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(_PARTS)) < limit
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # About `sample_rows` rows of two numbers, whatever the size of the tables.
    return texts.join(F.broadcast(usable.filter(chosen)), "doc_id")


def scored(docs: DataFrame, make: Callable[[], Callable], threshold: float) -> DataFrame:
    """doc_id, held_out, score and predicted for every row; `make()` gives texts -> scores.

    Ids travel as Arrow columns, so null and large ones stay as they are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = make()
        for batch in batches:
            found = pa.array(np.asarray(score(batch.column("text").to_pylist()), dtype=np.float64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), found], NAMES)

    rows = docs.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double")
    return found.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


NAMES = ["doc_id", "held_out", "score"]


def features_of(sample: DataFrame, names: Sequence[str], make: Callable[[], Callable]):
    """(features, labels) of a bounded sample of rows; `make()` gives texts -> array of features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            found = work(batch.column("text").to_pylist())
            columns = [batch.column("label"), *(pa.array(c) for c in np.ascontiguousarray(found.T))]
            yield pa.RecordBatch.from_arrays(columns, ["label", *names])

    schema = "label int, " + ", ".join(f"{n} double" for n in names)
    found = sample.select("label", "text").mapInArrow(run, schema).toPandas()
    found = found.sort_values(["label", *names], ignore_index=True)
    return found[list(names)].to_numpy(), found["label"].to_numpy(float)
