"""Quality checks and baselines of tiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.operators import quantiles

N_COVERAGE = 0.01


def pivot_bands(cells: DataFrame, bands: tuple[int, ...] = (1, 2, 3), by: tuple[str, ...] = ("r", "c")) -> DataFrame:
    """Bands of the long form as columns b1, b2 ...; a band that a cell lacks is null."""
    return cells.groupBy(*by).agg(*[F.max(F.when(F.col("band") == b, F.col("value"))).alias(f"b{b}") for b in bands])


def binary_mask(v: Column, value: float = 1) -> Column:
    return (v == value).cast("int")


def white(threshold: float = 250, bands: tuple[str, ...] = ("b1", "b2", "b3")) -> Column:
    return F.col(bands[0]).isNotNull() & (F.least(*bands) >= threshold)


def valid_mask(threshold: float = 250, nodata: float | None = None, bands: tuple[str, ...] = ("b1", "b2", "b3")) -> Column:
    """Not all bands at or above the threshold, and none nodata; cells with fewer than three bands are invalid."""
    if len(bands) < 3:
        return F.lit(False)
    ok = F.least(*bands) < threshold
    for b in bands if nodata is not None else ():
        ok = ok & (F.col(b) != nodata)
    for b in bands:
        ok = ok & F.col(b).isNotNull()
    return ok


def rgb_check(cells: DataFrame, by: str = "tile_idx", nodata: float = 0.0, least: float = N_COVERAGE) -> DataFrame:
    """Valid cells have all three bands other than nodata (0 where none is set)."""
    ok = (F.col("b1") != nodata) & (F.col("b2") != nodata) & (F.col("b3") != nodata)
    return cells.groupBy(by).agg(F.count_if(ok).alias("valid_pixels"), F.count("*").alias("total_pixels")).withColumn("coverage_ratio", F.col("valid_pixels") / F.col("total_pixels")).withColumn("rgb_valid", F.col("coverage_ratio") >= least)


def target_check(cells: DataFrame, by: str = "tile_idx", value: str = "target", above: float = 0.0) -> DataFrame:
    return cells.groupBy(by).agg(F.count_if(F.col(value) > above).alias("positive_pixels"), F.count("*").alias("total_pixels"), F.max(value).alias("max_value")).withColumn("coverage_ratio", F.col("positive_pixels") / F.col("total_pixels")).withColumn("has_targets", F.col("positive_pixels") > 0)


def histogram(cells: DataFrame, by: list[str], value: str = "target") -> DataFrame:
    """Group, value and its count: whatever follows costs as many rows as there are different values."""
    return cells.groupBy(*by, F.col(value).cast("double").alias("v")).agg(F.count("*").alias("n"))


def baselines(cells: DataFrame, by: list[str], threshold: float, value: str = "target", empty_union: float = 1.0, accuracy: int | None = None) -> DataFrame:
    """Moments, class balance and errors of constant predictions, from the histogram of values.

    The median is exact. For groups, tiles say, a task holds the distinct values of one; the median of all
    cells (no ``by``) is found in ranges of the distinct values, which are counted once and written. ``accuracy`` takes an approximate one,
    with an error of its rank of 1 / accuracy. The IoU of predicting 0 is ``empty_union`` where nothing is positive, else 0.
    """
    h = histogram(cells, by, value)
    median = F.expr("percentile(v, 0.5, n)") if by and accuracy is None else F.first("_median")
    if not by or accuracy is not None:
        if not by:
            h = quantiles.written(h, "histogram")
        mid = quantiles.exact_of_counts(h, {"_median": 0.5}) if accuracy is None else cells.groupBy(*by).agg(F.percentile_approx(value, 0.5, accuracy).alias("_median"))
        h = h.join(mid, by) if by else h.join(F.broadcast(mid), F.lit(True), "left")  # one row
    n, v, pos = F.col("n"), F.col("v"), F.col("v") >= threshold
    k = [F.col(c) for c in by]
    first = h.groupBy(*k).agg(
        F.sum("n").alias("total"), F.sum(n * v).alias("s1"), F.sum(n * v * v).alias("s2"), F.min("v").alias("min"), F.max("v").alias("max"),
        F.coalesce(F.sum(F.when(pos, n)), F.lit(0)).alias("lobe_pixels"), F.coalesce(F.sum(F.when(pos, n * v)), F.lit(0.0)).alias("lobe_sum"),
        F.sum(n * F.abs(v)).alias("abs_sum"), F.coalesce(F.sum(F.when(pos, n * F.abs(v))), F.lit(0.0)).alias("lobe_abs"), median.alias("median"),
    ).withColumn("mean", F.col("s1") / F.col("total")).withColumn("lobe_mean", F.col("lobe_sum") / F.when(F.col("lobe_pixels") > 0, F.col("lobe_pixels")))
    joined = h.join(first, by) if by else h.crossJoin(F.broadcast(first))
    second = joined.groupBy(*k, "total", "s1", "s2", "min", "max", "lobe_pixels", "abs_sum", "lobe_abs", "median", "mean", "lobe_mean").agg(
        F.sum(n * F.abs(v - F.col("mean"))).alias("dev_mean"), F.sum(n * F.abs(v - F.col("median"))).alias("dev_median"),
        F.sum(n * (v - F.col("mean")) * (v - F.col("mean"))).alias("sq_mean"), F.sum(F.when(pos, n * F.abs(v - F.col("mean")))).alias("lobe_dev"),
    )
    t, lobes = F.col("total"), F.col("lobe_pixels")
    back = F.col("total") - F.col("lobe_pixels")
    over = lambda x, d: x / F.when(d > 0, d)
    zero_lobe, zero_back = over(F.col("lobe_abs"), lobes), over(F.col("abs_sum") - F.col("lobe_abs"), back)
    return second.select(
        *k, t.alias("total_pixels"), "mean", "median", F.sqrt(F.col("sq_mean") / t).alias("std"), "min", "max",
        lobes.alias("lobe_pixels"), back.alias("background_pixels"), (lobes / t).alias("lobe_fraction"),
        (F.col("abs_sum") / t).alias("mae_zero"), (F.col("dev_mean") / t).alias("mae_mean"), (F.col("dev_median") / t).alias("mae_median"),
        F.sqrt(F.col("s2") / t).alias("rmse_zero"), F.sqrt(F.col("sq_mean") / t).alias("rmse_mean"),
        F.when(lobes == 0, F.lit(float(empty_union))).otherwise(0.0).alias("iou_zero"),
        "lobe_mean", zero_lobe.alias("lobe_mae_zero"), over(F.col("lobe_dev"), lobes).alias("lobe_mae_mean"), zero_back.alias("background_mae_zero"),
        ((lobes / t) * F.coalesce(zero_lobe, F.lit(0.0)) + (back / t) * F.coalesce(zero_back, F.lit(0.0))).alias("mae_weighted"),
    )


def status(rgb: DataFrame, targets: DataFrame, include_background: bool = False, least_target: float | None = None) -> DataFrame:
    """tile_idx, status: rgb_invalid, then background_only (also for too little target, background included or not), else valid."""
    j = rgb.select("tile_idx", "rgb_valid", F.col("coverage_ratio").alias("rgb_coverage")).join(targets.select("tile_idx", "has_targets", F.col("coverage_ratio").alias("target_coverage"), "max_value"), "tile_idx")
    low = F.lit(False) if least_target is None else F.col("target_coverage") < least_target
    background = (~F.col("has_targets") & F.lit(not include_background)) | low
    return j.withColumn("status", F.when(~F.col("rgb_valid"), "rgb_invalid").when(background, "background_only").otherwise("valid"))


def counters(statuses: DataFrame) -> DataFrame:
    """One row: total, rgb_invalid, background_only, valid and their percentages (null without tiles)."""
    count = lambda s: F.count_if(F.col("status") == s).alias(s)
    one = statuses.agg(F.count("*").alias("total"), count("rgb_invalid"), count("background_only"), count("valid"))
    return one.select("*", *[(100.0 * F.col(s) / F.when(F.col("total") > 0, F.col("total"))).alias(f"{s}_pct") for s in ("rgb_invalid", "background_only", "valid")])


def white_tiles(cells: DataFrame, by: str = "tile_idx", threshold: float = 250, share: float = 0.6) -> DataFrame:
    return cells.groupBy(by).agg(F.avg(white(threshold).cast("double")).alias("white_fraction")).withColumn("mostly_white", F.col("white_fraction") >= share)


def layer_check(cells: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """min, max, mean without NaN, and whether all values are 0."""
    v = F.when(~F.isnan(value), F.col(value))
    return cells.groupBy(*by).agg(F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.min((v == 0).cast("int")).alias("_z")).withColumn("all_zero", F.col("_z") == 1).drop("_z")


def segment_check(cells: DataFrame, by: str = "tile_idx", value: str = "segment", r: str = "tr", c: str = "tc") -> DataFrame:
    """min, max, number of ids, and how column means follow the column and row means the row; above 0.9 either way is a gradient."""
    base = cells.groupBy(by).agg(F.min(value).alias("min"), F.max(value).alias("max"), F.countDistinct(value).alias("unique_ids"))
    follow = lambda along, name: cells.groupBy(by, along).agg(F.avg(value).alias("m")).groupBy(by).agg(F.corr(F.col(along).cast("double"), "m").alias(name))
    out = base.join(follow(c, "col_corr"), by).join(follow(r, "row_corr"), by)
    strong = lambda x: F.coalesce(F.abs(F.nanvl(x, F.lit(0.0))) > 0.9, F.lit(False))
    return out.withColumn("gradient_like", strong(F.col("col_corr")) | strong(F.col("row_corr")))


def grid_means(cells: DataFrame, by: str, height: int, width: int, n: int = 10, value: str = "value", r: str = "tr", c: str = "tc") -> DataFrame:
    """Means over an n x n grid whose edges are int(i * size / n)."""

    def bucket(x: Column, size: int) -> Column:
        edges = [int(i * size / n) for i in range(n)]
        out = F.lit(0)
        for i, e in enumerate(edges):
            out = F.when(x >= e, i).otherwise(out)
        return out

    return cells.groupBy(by, bucket(F.col(r), height).alias("gr"), bucket(F.col(c), width).alias("gc")).agg(F.avg(value).alias("mean"))


def hsv_means(cells: DataFrame, by: str, h: Column, s: Column, v: Column, least: int = 100) -> DataFrame:
    """Mean hue, saturation and value over cells of middling value; over all cells where fewer than ``least`` are."""
    x = cells.select(by, h.alias("h"), s.alias("s"), v.alias("v")).withColumn("mid", F.col("v").between(0.05, 0.95))
    mid = lambda e: F.avg(F.when(F.col("mid"), F.col(e)))
    few = F.count_if("mid") < least
    return x.groupBy(by).agg(*[F.when(few, F.avg(e)).otherwise(mid(e)).alias(n) for e, n in (("h", "mean_hue"), ("s", "mean_saturation"), ("v", "mean_value"))])


def calibrated(means: DataFrame, examples: tuple[list, list] | None = None, band: float = 0.1, ambiguous: float | None = None, by: str = "tile_idx", accuracy: int | None = None) -> DataFrame:
    """One row (low, high): percentiles (exact, by a sketch and the values near them, or with ranks off by 1 / accuracy at most) around the middle if an ambiguous share is given, else the middle of the examples' means or 0.45, plus and minus half the band; (0.4, 0.6) without tiles."""
    v, n = F.col("mean_value"), F.count("*")
    if ambiguous is not None:
        shares = [0.5 - ambiguous / 2, 0.5 + ambiguous / 2]
        if accuracy is None:
            q = quantiles.exact(means, [], {"_low": shares[0], "_high": shares[1]}, "mean_value")
            one = means.agg(n.alias("n")).join(F.broadcast(q), F.lit(True), "left")  # one row
            return one.select(F.when(F.col("n") == 0, 0.4).otherwise(F.col("_low")).alias("low"), F.when(F.col("n") == 0, 0.6).otherwise(F.col("_high")).alias("high"))
        q = F.percentile_approx("mean_value", shares, accuracy)
        low, high = q[0], q[1]
    else:
        mid = F.lit(0.45)
        if examples:
            mean = lambda ids: F.avg(F.when(F.col(by).isin(ids), v))
            mid = F.coalesce((mean(examples[0]) + mean(examples[1])) / 2, F.lit(0.45))
        low, high = mid - band / 2, mid + band / 2
    return means.agg(F.when(n == 0, 0.4).otherwise(low).alias("low"), F.when(n == 0, 0.6).otherwise(high).alias("high"))


def illuminated(means: DataFrame, thresholds: DataFrame) -> DataFrame:
    """shadow below low, sun above high, else ambiguous."""
    v = F.col("mean_value")
    return means.crossJoin(F.broadcast(thresholds)).withColumn("illumination", F.when(v < F.col("low"), "shadow").when(v > F.col("high"), "sun").otherwise("ambiguous")).drop("low", "high")


def display(cells: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """Values scaled to 0..1 in each group; a constant group and NaN give 0."""
    v = F.when(~F.isnan(value), F.col(value))
    ends = cells.groupBy(*by).agg(F.min(v).alias("_lo"), F.max(v).alias("_hi"))
    gap = F.col("_hi") - F.col("_lo")
    return cells.join(ends, by).withColumn("display", F.when(gap > 0, F.coalesce((v - F.col("_lo")) / F.when(gap > 0, gap), F.lit(0.0))).otherwise(0.0)).drop("_lo", "_hi")


def extrema(cells: DataFrame, by: str, value: str = "value", r: str = "tr", c: str = "tc") -> DataFrame:
    """Least and greatest value with their first place in row-major order."""
    at = F.struct(F.col(r).alias("r"), F.col(c).alias("c"))
    low, high = F.min_by(at, F.struct(value, r, c)), F.min_by(at, F.struct(-F.col(value), F.col(r), F.col(c)))
    return cells.groupBy(by).agg(F.min(value).alias("min"), low.alias("_l"), F.max(value).alias("max"), high.alias("_h")).select(
        by, "min", F.col("_l.r").alias("min_r"), F.col("_l.c").alias("min_c"), "max", F.col("_h.r").alias("max_r"), F.col("_h.c").alias("max_c")
    )
