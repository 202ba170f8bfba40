"""A corpus pipeline: documents go through the stages in order; each stage's rows are written as Parquet and read again.

Every stage takes tables without rows, null ids and texts, texts of any length, equal rows, and further
columns of any name, which it keeps; what it makes of them is said at the function that it names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tilewright.llm import decontam, mixing, partenum, quality, sharding
from tilewright.llm.scratch import collected, delete, written

SHARDS = 16


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go: ``quality.accepted``. Null and empty texts are scored as texts without words."""
    return quality.accepted(docs)


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays: ``partenum.one_of_each``. Documents without words all stay."""
    return partenum.one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of the benchmark go: ``decontam.clean``. Null and wordless texts stay."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of sources above their target are left out, those below are repeated, three times at most: ``mixing.mixed_documents``. Documents without words stay once."""
    return mixing.mixed_documents(docs)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row gets a shard and a slot of a reproducible shuffle, beside all its columns: ``sharding.sharded_documents``. Equal rows get a place each."""
    return sharding.sharded_documents(docs, SHARDS)


STAGES = [
    ("quality", quality_stage),
    ("jaccard_join", jaccard_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]

#: SQL cannot state the fitted classifier; the tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. A stage's tables and its predecessor's rows go once its own rows are written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES:
        with collected() as inside:
            found = stage(spark, docs, sf_dir)
            with collected() as own:
                docs = written(found, f"pipeline-{name}")
        delete(spark, [*inside, *before])
        before = own
    return docs
