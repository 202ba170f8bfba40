"""Splits, samples and training sets by hash rank: exact sizes, the same on every run and partitioning."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A bucket has about BUCKET_ROWS rows while there are no more than FEW_BUCKETS, and up to MANY_ROWS in larger tables; BLOCK bucket sums are added up in one window.
BUCKET_ROWS, FEW_BUCKETS, MANY_ROWS, BLOCK = 256, 65_536, 4_096, 4_096


def ranked(df: DataFrame, seed: int, key: str = "tile_id", name: str = "rank") -> DataFrame:
    """Rows numbered from 0 in the order of their hash, without a one-task window: what lies before each hash bucket is summed in two levels."""
    n = df.count()
    buckets = max(1, min(-(-n // BUCKET_ROWS), max(FEW_BUCKETS, -(-n // MANY_ROWS))))
    h = df.withColumn("_h", F.xxhash64(key, F.lit(seed))).withColumn("_b", F.pmod("_h", F.lit(buckets)))
    earlier = lambda w: F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = h.groupBy("_b").agg(F.count("*").alias("_n")).withColumn("_k", F.floor(F.col("_b") / BLOCK))
    blocks = counts.groupBy("_k").agg(F.sum("_n").alias("_n")).select("_k", earlier(Window.orderBy("_k")).alias("_far"))
    base = counts.join(blocks, "_k").select("_b", (F.col("_far") + earlier(Window.partitionBy("_k").orderBy("_b"))).alias("_base"))
    w = Window.partitionBy("_b").orderBy("_h", key)
    return h.join(base, "_b").withColumn(name, F.col("_base") + F.row_number().over(w) - 1).drop("_h", "_b", "_base")


def split_sizes(n: int, train: float, val: float, test: float) -> tuple[int, int, int]:
    if abs(train + val + test - 1) > 1e-6:
        raise ValueError("split fractions must sum to 1")
    a, b = int(n * train), int(n * val)
    return a, b, n - a - b


def split(tiles: DataFrame, train: float, val: float, test: float, seed: int = 42, key: str = "tile_id") -> DataFrame:
    """tiles with split train, val or test of sizes int(n train), int(n val) and the rest."""
    a, b, _ = split_sizes(tiles.count(), train, val, test)
    r = ranked(tiles, seed, key, "_rank")
    return r.withColumn("split", F.when(F.col("_rank") < a, "train").when(F.col("_rank") < a + b, "val").otherwise("test")).drop("_rank")


def sample(tiles: DataFrame, n: int, seed: int, key: str = "tile_id") -> DataFrame:
    """Exactly min(n, rows) rows without replacement."""
    return ranked(tiles, seed, key, "_rank").filter(F.col("_rank") < n).drop("_rank")


def capped(tiles: DataFrame, n: int, always: DataFrame, seed: int = 42, key: str = "tile_id") -> DataFrame:
    """Representatives, all of them, and others up to n."""
    first = tiles.join(always.select(key).distinct(), key, "left_semi")
    rest = tiles.join(always.select(key).distinct(), key, "left_anti")
    return first.unionByName(sample(rest, max(0, n - first.count()), seed, key))


def epoch_sample(tiles: DataFrame, ratio: float, epoch: int, key: str = "tile_id") -> DataFrame:
    """max(1, int(n ratio)) tiles, another draw each epoch."""
    return sample(tiles, max(1, int(tiles.count() * ratio)), epoch, key)


def drawn_again(tiles: DataFrame, k: int, seed: int, key: str = "tile_id") -> DataFrame:
    """k draws with replacement: draw i takes the tile of rank hash(i) mod n."""
    n = tiles.count()
    if not n or not k:
        return tiles.limit(0)
    draws = tiles.sparkSession.range(k).select(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n)).alias("_rank"), F.col("id").alias("draw"))
    return ranked(tiles, seed + 1, key, "_rank").join(draws, "_rank").drop("_rank", "draw")


def extended(lobes: DataFrame, background: DataFrame, n_background: int = 0, n_augmented: int = 0, seed: int = 42, key: str = "tile_id") -> DataFrame:
    """Lobes, sampled background and lobes drawn again with augment set. 0 means as many as there are lobes; background is capped by its candidates."""
    n = lobes.count()
    role = lambda df, r, a: df.select(key, F.lit(r).alias("role"), F.lit(a).alias("augment"))
    return (
        role(lobes, "lobe", False)
        .unionByName(role(sample(background, n_background or n, seed, key), "background", False))
        .unionByName(role(drawn_again(lobes, n_augmented or n, seed, key), "augmented_lobe", True))
    )


def extended_rotations(lobes: DataFrame, background: DataFrame, share: float, ratio: float, seed: int = 42, key: str = "tile_id") -> DataFrame:
    """Lobes, four rotations of a share of them, and round(ratio * (lobes + rotations)) background tiles, capped; illumination is inherited."""
    n = lobes.count()
    k = int(n * share)
    keep = [key, "illumination"]
    base = lobes.select(*keep, F.lit("lobe").alias("role"), F.lit(0).alias("turn"))
    if not k:
        return base
    turned = sample(lobes, k, seed, key).select(*keep, F.lit("augmented_lobe").alias("role"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("turn"))
    back = sample(background, math.floor(ratio * (n + 4 * k) + 0.5), seed + 1, key).select(*keep, F.lit("background").alias("role"), F.lit(0).alias("turn"))
    return base.unionByName(turned).unionByName(back)


def first_or(found: DataFrame, fallback: DataFrame, n: int, order: str = "tile_idx") -> DataFrame:
    """The found tiles, or the first n of the others if none is found."""
    return fallback.orderBy(order).limit(n) if found.isEmpty() else found


def unit(*keys: Column) -> Column:
    """A number in [0, 1) from a hash, the same wherever the row is."""
    return F.pmod(F.xxhash64(*keys), F.lit(1 << 40)) / F.lit(float(1 << 40))
