"""Intermediate tables kept on shared storage or on the executors' disks.

A written table cuts lineage, survives lost executors and is re-read with column
pruning, which a cached or checkpointed RDD is not. A narrow table that is read a few
times by one stage is persisted on the executors' disks instead: it makes no files.
"""

from __future__ import annotations

import atexit
import functools
import tempfile
import uuid
from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

#: Rows a task of a work table is worth, and those of a table of a few numbers.
ROWS_PER_TASK = 2_000
NUMBERS_PER_TASK = 20_000
#: Rows a file is worth, likewise: of documents some 40 MB.
ROWS_PER_FILE = 20_000
NUMBERS_PER_FILE = 100_000


def work_root(spark: SparkSession) -> str:
    """Folder for intermediate tables: the cluster's `spark.checkpoint.dir`.

    A folder given to `SparkContext.setCheckpointDir` serves as well.
    """
    given = spark.sparkContext._jsc.sc().getCheckpointDir()
    configured = spark.conf.get("spark.checkpoint.dir", None) or (
        given.get() if given.isDefined() else None
    )
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    return _local_root()


@functools.cache
def _local_root() -> str:
    return tempfile.mkdtemp(prefix="tabloom-")


def work_path(spark: SparkSession, label: str) -> str:
    return f"{work_root(spark)}/tabloom-{label}-{uuid.uuid4().hex}"


def gathered(df: DataFrame, rows: int, each: int = ROWS_PER_TASK) -> DataFrame:
    """`df`, of about `rows` rows, in no more partitions than tasks of `each` rows, two a core at least.

    A shuffle deals few rows to as many partitions as many rows.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.coalesce(max(2 * cores, -(-rows // each)))


def for_files(df: DataFrame, rows: int) -> DataFrame:
    """`df`, of about `rows` rows that hold texts, in no more partitions than large files, one a core at least.

    Every file costs its writer buffers, and on a local disk, without Hadoop's native library, child
    processes that set its mode; until they begin their own program they count with all of the executor's memory.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.coalesce(max(cores, -(-rows // ROWS_PER_FILE)))


def numbers_for_files(df: DataFrame, rows: int) -> DataFrame:
    """`df`, of at most about `rows` rows of a few numbers, in no more partitions than large files."""
    return df.coalesce(max(1, -(-rows // NUMBERS_PER_FILE)))


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write `df` once as Parquet and return a scan of it."""
    df.write.partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class WorkArea:
    """A folder of work tables, deleted when the `with` block ends."""

    def __init__(self, spark: SparkSession, label: str = "run") -> None:
        self.spark = spark
        self.path = work_path(spark, label)
        self._held: list[DataFrame] = []

    @classmethod
    def until_exit(cls, spark: SparkSession, label: str = "run") -> WorkArea:
        """For tables that a lazy result still reads: deleted when the process ends."""
        area = cls(spark, label)
        atexit.register(area.close)
        return area

    def table(self, df: DataFrame, name: str, partition_by: Sequence[str] = ()) -> DataFrame:
        return write_table(df, f"{self.path}/{name}-{uuid.uuid4().hex}", partition_by)

    def held(self, df: DataFrame) -> DataFrame:
        """`df` computed once, on the executors' disks; what a lost executor had is computed again.

        For tables whose rows are the same then, and that are not built on each other without end. The
        shuffles they come from stay on disk with them, until they are released.
        """
        self._held.append(df.persist(StorageLevel.DISK_ONLY))
        df.count()
        return df

    def release(self, *held: DataFrame) -> None:
        for df in held:
            df.unpersist()
            self._held = [other for other in self._held if other is not df]

    def numbers(self, df: DataFrame, name: str) -> DataFrame:
        """Rows of a few numbers that take long to find: computed by all tasks of `df`, written in few files."""
        held = self.held(df)
        found = self.table(numbers_for_files(held, held.count()), name)
        self.release(held)
        return found

    def close(self) -> None:
        if self.spark.sparkContext._jsc is not None:  # else the session has been stopped
            while self._held:
                self._held.pop().unpersist()
            delete_path(self.spark, self.path)

    def __enter__(self) -> WorkArea:
        return self

    def __exit__(self, *exc: object) -> None:
        self.close()


def path_exists(spark: SparkSession, path: str) -> bool:
    filesystem, target = _filesystem(spark, path)
    return bool(filesystem.exists(target))


def delete_path(spark: SparkSession, path: str) -> None:
    filesystem, target = _filesystem(spark, path)
    filesystem.delete(target, True)


def _filesystem(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target
