"""Trials tables: read from text files, appended, imported."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_trials(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """All columns as text. A path that does not exist gives no rows; every other failure is an error."""
    from pyspark.errors import AnalysisException

    schema = ", ".join(f"`{c}` string" for c in columns)
    try:
        return spark.read.schema(schema).csv(path, header=True)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], schema)
        raise


def appended(trials: DataFrame, other: DataFrame, defaults: dict[str, str]) -> DataFrame:
    """Rows of another table added: absent columns are null, blank ones of ``defaults`` get their default."""
    fill = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(defaults[c])).alias(c) if c in defaults else F.col(c)
    for c in defaults:
        if c not in other.columns:
            other = other.withColumn(c, F.lit(""))
    return trials.unionByName(other.select(*[fill(c) for c in other.columns]), allowMissingColumns=True)
