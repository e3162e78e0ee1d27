"""A training-data pipeline of the corpus operators.

Every stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and returns a
DataFrame that `run` writes as Parquet and reads again for the next one. All stages but the last
return the columns of `documents`.

A stage's result reads work tables until it has been written. The next stage deletes them first,
unless the table it is given still reads them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabloom.llm import chosen_path, content_sort, mixing, packing, quality
from tabloom.llm.common import row_count, session_area, table, whole_text, word_count
from tabloom.llm.queries import mix_sources
from tabloom.sources.work import WorkArea, for_files

#: A task that writes or reads a file of texts holds one row group of it.
ROW_GROUP_BYTES = 16 << 20

_left: list[WorkArea] = []


def _area(spark: SparkSession, docs: DataFrame, label: str) -> WorkArea:
    """Work tables of a stage; those that earlier stages left are deleted.

    The session's row groups become small, unless it sets their size: whoever writes a stage's result uses it.
    """
    if spark.conf.get("parquet.block.size", None) is None:
        spark.conf.set("parquet.block.size", str(ROW_GROUP_BYTES))
    read = _folders(docs)
    for area in [area for area in _left if not any(area.path in folder for folder in read)]:
        area.close()
        _left.remove(area)
    _left.append(session_area(spark, label))
    return _left[-1]


def _folders(docs: DataFrame) -> list[str]:
    """Folders of the tables a DataFrame reads, without listing their files."""
    leaves = docs._jdf.queryExecution().analyzed().collectLeaves()
    found = []
    for number in range(leaves.size()):
        leaf = leaves.apply(number)
        if leaf.nodeName().startswith("LogicalRelation"):
            roots = leaf.relation().location().rootPaths()
            found += [roots.apply(at).toString() for at in range(roots.size())]
    return found


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the quality classifier doesn't reject; it learns from `labels`."""
    _area(spark, docs, "quality")
    good = quality.keep_good(docs, quality.fit_quality(docs, table(spark, sf_dir, "labels")))
    return for_files(good, row_count(docs))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest id, once."""
    found = content_sort.content_sort(docs, _area(spark, docs, "exact"))
    return for_files(found.filter("kept").select("row.*"), row_count(docs))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar texts the document with the smallest id, once."""
    found = chosen_path.join_similar(docs, _area(spark, docs, "near"))
    leading = found.filter("leads").select("class", "group_id").distinct()
    named = docs.select(F.struct("*").alias("row"), chosen_path.same_text().alias("class"))
    kept = named.join(leading, "class").filter(F.col("row.doc_id").eqNullSafe(F.col("group_id")))
    return for_files(kept.dropDuplicates(["class"]).select("row.*"), row_count(docs))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, whole: those that are cut are rounded.

    A document is an id, a text and a source. Rows that repeat all three share out the copies of
    them all. A mix of words takes no document without words, so none of those is left.
    """
    area, body = _area(spark, docs, "mix"), F.xxhash64(whole_text())
    rows = mixing.sized(docs, word_count(whole_text()), F.array("source"), area, body.alias("body"))
    copies = F.coalesce(F.round(F.try_divide("taken", "words")), F.lit(0)).cast("long")
    taken = mix_sources(rows)[0].withColumn("source", F.col("members")[0])
    taken = taken.groupBy(F.struct("doc_id", "body", "source").alias("key")).agg(
        F.sum(copies).alias("copies"), F.count(F.lit(1)).alias("times")
    )
    named = docs.select(F.struct("*").alias("row"), F.struct("doc_id", body.alias("body"), "source").alias("key"))
    joined = named.join(taken.filter("copies > 0"), "key")
    place = F.row_number().over(Window.partitionBy("key").orderBy(F.xxhash64("row")))
    own = F.expr("copies div times + IF(place <= copies % times, 1, 0)").cast("int")
    joined = joined.withColumn("place", place).withColumn("own", own).filter("own > 0")
    joined = joined.select("row", F.explode(F.sequence(F.lit(1), "own"))).select("row.*")
    return for_files(joined, row_count(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences, with their token ids."""
    _area(spark, docs, "packing")
    return packing.pack_documents(for_files(docs, row_count(docs)), packing.byte_bpe_50k())


STAGES = [
    ("quality", good_quality),
    ("exact", without_copies),
    ("near", without_near_copies),
    ("mixing", mixed),
    ("packing", packed),
]

#: The classifier's trees and the tokenizer have no SQL form; tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages one after the other; each one's output goes when the next one's is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        area = session_area(spark, f"pipeline-{name}")
        docs = area.table(stage(spark, docs, sf_dir), name)
        if before is not None:
            before.close()
        before = area
    return docs
