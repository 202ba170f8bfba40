"""Global row numbers and running sums without a one-task window.

Rows are dealt to buckets by a hash. A small table with one row per bucket gives what lies before
each bucket, summed in two levels; a window inside the bucket gives the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilewright.llm.scratch import Scratch

#: Buckets hold about FEW_ROWS rows while there are no more than FEW_BUCKETS of them, and up to MANY_ROWS in larger tables.
FEW_ROWS, FEW_BUCKETS, MANY_ROWS = 64, 65_536, 4_096
#: So many bucket sums are added up in one window.
BLOCK = 4_096
#: The rows of a bucket beyond this number are dealt to SALTS parts. Buckets of different rows stay well below it.
HOT, SALTS = 16_384, 1_024


def bucket_count(rows: int) -> int:
    return max(1, min(-(-rows // FEW_ROWS), max(FEW_BUCKETS, -(-rows // MANY_ROWS))))


def before(counts: DataFrame, keys: list[str], index: str, value: str, name: str) -> DataFrame:
    """``counts`` (a row per keys and index from 0 up) with ``name``: the sum of ``value`` over the smaller indexes of the same keys."""
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    rows = counts.withColumn("_block", F.floor(F.col(index) / BLOCK))
    blocks = rows.groupBy(*keys, "_block").agg(F.sum(value).alias("_sum"))
    blocks = blocks.select(*keys, "_block", F.coalesce(F.sum("_sum").over(earlier(Window.partitionBy(*keys).orderBy("_block"))), zero).alias("_base"))
    inside = earlier(Window.partitionBy(*keys, "_block").orderBy(index))
    return rows.join(blocks, [*keys, "_block"]).withColumn(name, F.col("_base") + F.coalesce(F.sum(value).over(inside), zero)).drop("_block", "_base")


def numbered(df: DataFrame, key: str, order: list[Column], rows: int, name: str = "row_number") -> DataFrame:
    """``df`` with row numbers from 0 without gaps.

    ``key`` is a column with a 64-bit hash of the row; the order is (bucket of the key, ``order``), so
    it depends on the rows alone, not on how they are partitioned. Equal rows are interchangeable; in a
    bucket of more than HOT rows, which only a repeated key makes, rows are ordered by key and those of
    one key are numbered in many tasks.
    """
    scratch, b = Scratch(df.sparkSession), bucket_count(rows)
    dealt = df.withColumn("_bucket", F.pmod(F.col(key), F.lit(b)))
    counts = scratch.write(dealt.groupBy("_bucket").agg(F.count("*").alias("_n")), "buckets")
    base = before(counts, [], "_bucket", "_n", "_first").select("_bucket", "_first")
    full = counts.filter(F.col("_n") > HOT).select("_bucket")
    cold = dealt if full.isEmpty() else dealt.join(full, "_bucket", "left_anti")
    inside = Window.partitionBy("_bucket").orderBy(*order)
    out = cold.join(base, "_bucket").withColumn(name, F.col("_first") + F.row_number().over(inside) - 1).drop("_bucket", "_first")
    if cold is dealt:
        return out
    # Written, so that a row keeps its salt when a task runs again.
    hot = scratch.write(dealt.join(full, "_bucket", "left_semi").withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))), "repeated-rows")
    # A row for each salt of each key of a full bucket.
    salts = hot.groupBy("_bucket", key, "_salt").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy("_bucket").orderBy(key, "_salt").rowsBetween(Window.unboundedPreceding, -1)
    salts = salts.withColumn("_inner", F.coalesce(F.sum("_n").over(earlier), F.lit(0).cast("long"))).drop("_n")
    nth = F.row_number().over(Window.partitionBy("_bucket", key, "_salt").orderBy(*order))
    last = hot.join(salts, ["_bucket", key, "_salt"]).join(base, "_bucket").withColumn(name, F.col("_first") + F.col("_inner") + nth - 1)
    return out.unionByName(last.select(out.columns))
