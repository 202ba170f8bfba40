"""Quantiles by mergeable sketches, stored per tile and merged over lists and splits; and exact ones in bounded memory.

A KLL sketch of size K answers a rank with an error of RANK_ERROR of the rows at most, in all but one of
some hundreds of answers; merging adds none. An exact quantile takes a sketch first, and then counts
only the values in a bracket of ranks around it, whose edges the sketch gives.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tilewright.shared import new_path

K, RANK_ERROR = 800, 0.005
#: Half the width of the bracket, in ranks.
BRACKET = 3 * RANK_ERROR


def sketches(values: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """by, n, sketch: a row for each group, a few kilobytes each. Nulls are left out."""
    v = F.col(value).cast("double")
    return values.groupBy(*by).agg(F.count(v).alias("n"), F.kll_sketch_agg_double(v, K).alias("sketch"))


def merged(stored: DataFrame, by: list[str]) -> DataFrame:
    """The sketches of larger groups from stored ones; no value is read again."""
    return stored.groupBy(*by).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", K).alias("sketch"))


def estimated(stored: DataFrame, shares: dict[str, float]) -> DataFrame:
    """The sketches' groups with a column for each share: a value whose rank is within RANK_ERROR of it; null without values."""
    return stored.select("*", *[F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("sketch", F.lit(float(p)))).alias(name) for name, p in shares.items()])


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the folder of spark.checkpoint.dir."""
    path, schema = new_path(df.sparkSession, name), df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def exact_of_counts(counts: DataFrame, shares: dict[str, float]) -> DataFrame:
    """One row: the exact quantiles of values given by their counts (v, n; written or cheap to read), between neighbours in proportion; no row without values.

    Values go to ranges; sums of the ranges, a row each, tell in which one a rank lies, so no task holds all values.
    """
    ranges = written(counts.filter("v IS NOT NULL").select(F.col("v").cast("double").alias("v"), "n").repartitionByRange("v").withColumn("_part", F.spark_partition_id()), "value-ranges")
    sums = ranges.groupBy("_part").agg(F.sum("n").alias("_s"), F.min("v").alias("_first"))
    before = Window.orderBy("_first").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    base = sums.select("_part", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_base"), F.sum("_s").over(Window.partitionBy()).alias("_total"))
    upto = F.col("_base") + F.sum("n").over(Window.partitionBy("_part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    ranked = ranges.join(F.broadcast(base), "_part").withColumn("last", upto - 1).withColumn("first", F.col("last") - F.col("n") + 1)
    place = {name: F.lit(float(p)) * (F.col("_total") - 1) for name, p in shares.items()}
    at = lambda r: F.max(F.when((F.col("first") <= r) & (r <= F.col("last")), F.col("v")))
    found = ranked.agg(F.max("_total").alias("_total"), *[at(f(x)).alias(f"{end}{name}") for name, x in place.items() for end, f in (("_lo", F.floor), ("_hi", F.ceil))]).filter("_total > 0")
    share = {name: x - F.floor(x) for name, x in place.items()}
    return found.select(*[F.when(share[n] == 0, F.col(f"_lo{n}")).otherwise((1 - share[n]) * F.col(f"_lo{n}") + share[n] * F.col(f"_hi{n}")).alias(n) for n in shares])


def exact(values: DataFrame, by: list[str], shares: dict[str, float], value: str = "value") -> DataFrame:
    """by and a column for each share with the exact quantile, between neighbours in proportion; NaN is larger than any number.

    Tasks hold counts of the distinct values in the brackets, which the sketches keep to some percent of
    the ranks. Where a sketch was so far off that a bracket misses its rank, the group's distinct values
    are all counted.
    """
    keys = by or ["_all"]
    rows = values.select(*([F.lit(0).alias("_all")] if not by else by), F.col(value).cast("double").alias("_v")).filter("_v IS NOT NULL")
    names = list(shares)
    at = lambda p: F.kll_sketch_get_quantile_double("sketch", F.lit(float(min(1.0, max(0.0, p)))))
    brackets = F.array(*[F.struct(F.lit(k).alias("k"), at(shares[n] - BRACKET).alias("lo"), at(shares[n] + BRACKET).alias("hi")) for k, n in enumerate(names)])
    known = sketches(rows, keys, "_v").select(*[F.col(c).alias(f"_{c}") for c in keys], F.col("n").alias("_n"), brackets.alias("_b"))
    # Written, since a sketch draws at random: all that follows must see the same brackets.
    known = written(known, "brackets")
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys]
    near = rows.join(known if by else F.broadcast(known), same)  # without groups the sketch is one row

    def picked(counted: DataFrame) -> DataFrame:
        """keys, k, q from values (keys, k, _v, c, below: rows before all of them, _n)."""
        w = Window.partitionBy(*keys, "k").orderBy("_v")
        p = F.element_at(F.array(*[F.lit(float(shares[n])) for n in names]), F.col("k") + 1)
        place = p * (F.col("_n") - 1)
        upto = F.col("below") + F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, 0))
        ranked = counted.withColumns({"last": upto - 1, "first": upto - F.col("c"), "place": place})
        value_at = lambda r: F.max(F.when((F.col("first") <= r) & (r <= F.col("last")), F.col("_v")))
        lo, hi = value_at(F.floor("place")), value_at(F.ceil("place"))
        found = ranked.groupBy(*keys, "k").agg(lo.alias("a"), hi.alias("b"), F.first("place").alias("place"))
        share = F.col("place") - F.floor("place")
        return found.select(*keys, "k", F.when(share == 0, F.col("a")).otherwise((1 - share) * F.col("a") + share * F.col("b")).alias("q"))

    below = near.groupBy(*keys).agg(*[F.count_if(F.col("_v") < F.col("_b")[k]["lo"]).alias(f"_{k}") for k in range(len(names))])
    below = below.select(*[F.col(c).alias(f"_{c}") for c in keys], F.array(*[f"_{k}" for k in range(len(names))]).alias("_below"))
    inside = near.withColumn("k", F.explode(F.transform(F.filter("_b", lambda b: (b["lo"] <= F.col("_v")) & (F.col("_v") <= b["hi"])), lambda b: b["k"]))).groupBy(*keys, "k", "_v").agg(F.count("*").alias("c"), F.first("_n").alias("_n"))
    first = picked(inside.join(below if by else F.broadcast(below), same).withColumn("below", F.element_at("_below", F.col("k") + 1)))
    # Every group and share that the brackets did not answer.
    asked = known.select(*[F.col(f"_{c}").alias(c) for c in keys], "_n", F.explode(F.sequence(F.lit(0), F.lit(len(names) - 1))).alias("k"))
    there = first.filter("q IS NOT NULL").select(*[F.col(c).alias(f"_{c}") for c in keys], F.col("k").alias("_k"), "q")
    open_ = asked.join(there, [*same, F.col("k") == F.col("_k")], "left_anti")
    missed = open_.select(*[F.col(c).alias(f"_{c}") for c in keys], "k", "_n")
    again = picked(rows.join(missed, same).groupBy(*keys, "k", "_v").agg(F.count("*").alias("c"), F.first("_n").alias("_n")).withColumn("below", F.lit(0)))
    both = first.filter("q IS NOT NULL").unionByName(again)
    out = both.groupBy(*keys).agg(*[F.max(F.when(F.col("k") == k, F.col("q"))).alias(n) for k, n in enumerate(names)])
    return out if by else out.drop("_all")
