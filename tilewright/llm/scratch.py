"""Tables written to the shared checkpoint folder, to cut lineage so that a lost executor costs little."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.shared import new_path


#: Python workers get rows in batches of about so many bytes. Spark's 10,000 rows of long texts are tens of MB, which the executor and
#: each of its workers hold several times over.
BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", str(2 << 20))

#: The paths of what is written inside ``collected``, innermost last.
_COLLECTED: list[list[str]] = []


@contextmanager
def collected() -> Iterator[list[str]]:
    """The paths of all tables written inside, to be deleted with ``delete`` once what was made of them is written."""
    _COLLECTED.append([])
    try:
        yield _COLLECTED[-1]
    finally:
        _COLLECTED.pop()


def delete(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


class Scratch:
    """Tables of one operator by name. They go when they are dropped, the others when the application ends."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` as a table written once; later reads do not repeat its work."""
        path, schema = new_path(self.spark, name), df.schema
        df.write.parquet(path)
        self.paths.setdefault(name, []).append(path)
        if _COLLECTED:
            _COLLECTED[-1].append(path)
        return self.spark.read.schema(schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Deletes tables that nothing reads any more: what was made of them must have been written."""
        for name in names:
            delete(self.spark, self.paths.pop(name, []))

    def drop_all_but(self, *names: str) -> None:
        self.drop(*[n for n in self.paths if n not in names])


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table that stays until the application ends."""
    return Scratch(df.sparkSession).write(df, name)


def small_batches(spark: SparkSession) -> None:
    """From now on the session's batches end at BATCH bytes, unless it has a limit of its own; which rows share a batch changes no result."""
    if spark.conf.get(BATCH[0], None) is None:
        spark.conf.set(*BATCH)


def broadcast_if_small(df: DataFrame, size: Column, limit: int) -> DataFrame:
    """``df`` marked for broadcast if the sum of ``size`` (bytes of a row) is checked to be no more than ``limit``; else as it is."""
    total = df.agg(F.coalesce(F.sum(size), F.lit(0)).alias("n")).first()["n"]
    return F.broadcast(df) if total <= limit else df


def dealt_to_all(df: DataFrame) -> DataFrame:
    """``df`` dealt to all cores if its files give tasks for less than half of them (one file with one row group, say)."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    tasks = df.select(F.spark_partition_id().alias("p")).distinct().count()
    return df if 2 * tasks >= cores else df.repartition(cores)
