"""Connected components of a link table by star contraction; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.shared import new_path


def components(links: DataFrame) -> DataFrame:
    """node, label: the least node that links (a, b) lead to. Only nodes with links are there.

    In each round every node hands its larger neighbours to the least around it, and then the smaller
    ones; the rounds follow the logarithm of the number of links and not the length of a chain. One
    table is written in a round.
    """
    spark = links.sparkSession

    def kept(df: DataFrame) -> DataFrame:
        path, schema = new_path(spark, "stars"), df.schema
        df.write.parquet(path)
        return spark.read.schema(schema).parquet(path)

    def least(pairs: DataFrame) -> DataFrame:
        """u, v, m: the least of u and its v."""
        return pairs.join(pairs.groupBy("u").agg(F.min("v").alias("m")), "u").select("u", "v", F.least("u", "m").alias("m"))

    # An edge leads from the larger node u to the smaller v.
    edges = kept(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = least(both).filter("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = least(large).select(F.inline(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v"))))).filter("u <> v").distinct()
        # A shortcut: what hangs on a node with an end of its own goes to that end.
        end = small.groupBy(F.col("u").alias("v")).agg(F.min("v").alias("end"))
        edges = kept(small.join(end, "v", "left").select("u", F.coalesce("end", "v").alias("v")).distinct())
        # Stars: every node has one end, and no end has one itself.
        ends = edges.select(F.col("v").alias("u")).distinct()
        if edges.join(ends, "u", "left_semi").isEmpty() and edges.count() == edges.select("u").distinct().count():
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
