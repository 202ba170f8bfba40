"""Tables that streams append to exactly once: data folders, and a ledger of those that count.

A batch writes its rows to a folder of its own and then an entry in the ledger. Readers read the folders
that the ledger names and nothing else, so they see whole batches only: what a batch left behind before it
failed is never read, and a batch whose entry is there is not written again. Compaction writes several
folders as one and an entry that puts it in their place.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ENTRY = "batch string, folder string, replaces array<string>, n bigint"


def _entries(spark: SparkSession, path: str) -> DataFrame:
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/ledger")
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], ENTRY)
    return spark.read.schema(ENTRY).option("recursiveFileLookup", "true").json(f"{path}/ledger")


def _enter(spark: SparkSession, path: str, batch: str, folder: str, replaces: list[str], n: int) -> None:
    entry = spark.createDataFrame([(batch, folder, replaces, n)], ENTRY)
    entry.coalesce(1).write.json(f"{path}/ledger/{uuid.uuid4().hex}")


def visible(spark: SparkSession, path: str) -> DataFrame:
    """batch, folder, n of the folders that count: of entries for one batch (two attempts that overlapped) the first by folder, and none that another replaces."""
    entries = _entries(spark, path)
    first = Window.partitionBy("batch").orderBy("folder")
    once = entries.withColumn("_k", F.row_number().over(first)).filter("_k = 1").drop("_k")
    gone = once.select(F.explode("replaces").alias("folder"))
    return once.join(gone, "folder", "left_anti").select("batch", "folder", "n")


def append_batch(rows: DataFrame, path: str, batch: str) -> bool:
    """Appends the rows of a batch unless the ledger has it; false if it does."""
    spark = rows.sparkSession
    known = _entries(spark, path)
    if not known.filter((F.col("batch") == batch) | F.array_contains("replaces", batch)).isEmpty():
        return False
    folder = f"data/{uuid.uuid4().hex}"
    rows.write.parquet(f"{path}/{folder}")
    _enter(spark, path, batch, folder, [], spark.read.parquet(f"{path}/{folder}").count())
    return True


def append_stream(stream: DataFrame, path: str, checkpoint: str, name: str = "stream") -> None:
    """Appends all that a stream has. Batches are numbered by the checkpoint, so each counts once, however often it runs."""

    def write(batch: DataFrame, epoch: int) -> None:
        append_batch(batch, path, f"{name}-{epoch}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of all folders that count."""
    folders = [f"{path}/{r['folder']}" for r in visible(spark, path).collect()]  # a row for each folder: compaction keeps them few
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def compact(spark: SparkSession, path: str, schema: str, rows_per_folder: int = 1_000_000, files: int = 1) -> int:
    """Writes the folders with fewer rows than ``rows_per_folder`` as one; how many there were. Readers see the old ones or the new one."""
    small = [r["folder"] for r in visible(spark, path).filter(F.col("n") < rows_per_folder).collect()]
    if len(small) < 2:
        return 0
    folder = f"data/{uuid.uuid4().hex}"
    spark.read.schema(schema).parquet(*[f"{path}/{f}" for f in small]).coalesce(files).write.parquet(f"{path}/{folder}")
    _enter(spark, path, f"compaction-{uuid.uuid4().hex}", folder, small, spark.read.parquet(f"{path}/{folder}").count())
    return len(small)
