"""Raster algebra on cells: crops, stacks, resampling, stamps and augmentation."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilewright.functions import draws
from tilewright.functions.scalar import hsv, rgb


def crop(cells: DataFrame, height: int, width: int, x: float, y: float, rows: int, cols: int, a: float = 1.0, e: float = -1.0, x0: float = 0.0, y0: float = 0.0) -> tuple[DataFrame, tuple]:
    """Cells of the window whose upper left corner is at world (x, y), moved to a new origin, and the new transform, whose corner is the one asked for. A window outside the raster is an error, found before any cell is read."""
    r0, c0 = math.floor((y - y0) / e), math.floor((x - x0) / a)
    if r0 < 0 or c0 < 0 or r0 + rows > height or c0 + cols > width:
        raise ValueError("the window leaves the raster")
    inner = cells.filter(F.col("r").between(r0, r0 + rows - 1) & F.col("c").between(c0, c0 + cols - 1))
    return inner.withColumns({"r": F.col("r") - r0, "c": F.col("c") - c0}), (a, 0.0, x, 0.0, e, y)


def all_white(wide: DataFrame, threshold: float = 255, bands: tuple[str, ...] = ("b1", "b2", "b3")) -> DataFrame:
    low = F.min(F.least(*bands))
    return wide.agg(low.alias("min"), F.max(F.greatest(*bands)).alias("max"), (low >= threshold).alias("all_white"))


def split_bands(cells: DataFrame, layers: DataFrame) -> DataFrame:
    """Cells of one stacked raster as layers; layers: band, layer, layer_band."""
    return cells.join(F.broadcast(layers), "band").select("layer", F.col("layer_band").alias("band"), "r", "c", "value")


def stacked(metadata: DataFrame, layers: list[tuple[str, DataFrame, int]]) -> DataFrame:
    """Layers of one shape, transform and reference system as one raster with bands numbered on; no join is needed. metadata: raster_id, height, width, transform, crs."""
    same = F.struct("height", "width", "transform", "crs")
    kinds = metadata.groupBy(same.alias("kind")).agg(F.sort_array(F.collect_list("raster_id")).alias("ids")).collect()  # a row per kind of grid
    if len(kinds) > 1:
        raise ValueError(f"rasters differ in grid: {sorted(r['ids'] for r in kinds)}")
    out, at = None, 0
    for name, cells, bands in layers:
        part = cells.select(F.lit(name).alias("layer"), (F.col("band") + at).cast("int").alias("band"), "r", "c", F.col("value").cast("double").alias("value"))
        out, at = part if out is None else out.unionByName(part), at + bands
    return out


def cubic(t: float) -> float:
    t = abs(t)
    return 1.5 * t**3 - 2.5 * t**2 + 1 if t <= 1 else -0.5 * t**3 + 2.5 * t**2 - 4 * t + 2 if t < 2 else 0.0


def axis_taps(size_in: int, size_out: int, method: str) -> list[tuple[int, int, float]]:
    """(target, source, weight) along one axis over the same extent."""
    s, out = size_in / size_out, []
    for i in range(size_out):
        x = (i + 0.5) * s - 0.5
        if method == "nearest":
            taps = [(min(size_in - 1, int((i + 0.5) * s)), 1.0)]
        elif method == "bilinear":
            taps = [(k, 1 - abs(x - k)) for k in (math.floor(x), math.floor(x) + 1)]
        elif method == "cubic":
            taps = [(k, cubic(x - k)) for k in range(math.floor(x) - 1, math.floor(x) + 3)]
        elif method == "average":
            taps = [(k, min(k + 1, (i + 1) * s) - max(k, i * s)) for k in range(math.floor(i * s), math.ceil((i + 1) * s))]
        else:
            raise ValueError(f"no method {method!r}")
        out += [(i, k, float(w)) for k, w in taps if 0 <= k < size_in and w != 0]
    return out


def resampled(cells: DataFrame, size_in: tuple[int, int], size_out: tuple[int, int], method: str = "bilinear", nodata: float | None = None) -> DataFrame:
    """r, c, value on another grid of the same extent: weights of the source cells around each target cell, renewed over those that are valid; 0 where none is.

    The tap tables have a few rows for each row and column of the rasters, never for their cells.
    """
    spark = cells.sparkSession
    tr, tc = (spark.createDataFrame(axis_taps(i, o, method), f"t{n} long, {n} long, w{n} double") for i, o, n in ((size_in[0], size_out[0], "r"), (size_in[1], size_out[1], "c")))
    v = cells if nodata is None else cells.filter(F.col("value") != nodata)
    w = F.col("wr") * F.col("wc")
    j = v.join(tr, "r").join(tc, "c").groupBy(F.col("tr").alias("r"), F.col("tc").alias("c")).agg(F.sum(w * F.col("value")).alias("s"), F.sum(w).alias("w"))
    got = j.select("r", "c", F.when(F.abs("w") > 1e-12, F.col("s") / F.when(F.abs("w") > 1e-12, F.col("w"))).otherwise(0.0).alias("value"))
    if nodata is None:
        return got
    every = spark.range(size_out[0] * size_out[1]).select(F.floor(F.col("id") / size_out[1]).alias("r"), F.pmod("id", F.lit(size_out[1])).alias("c"))
    return every.join(got, ["r", "c"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))


def placements(wide: DataFrame, inside: DataFrame, height: int, width: int, margin: int, threshold: float = 250) -> DataFrame:
    """Centres in the boundary, not white, and away from the edge."""
    room = F.col("r").between(margin, height - 1 - margin) & F.col("c").between(margin, width - 1 - margin)
    return wide.filter(room & (F.least("b1", "b2", "b3") < threshold)).join(inside.select("r", "c").distinct(), ["r", "c"], "left_semi").select("r", "c")


def stamped_cells(centres: DataFrame, template: DataFrame, height: int, width: int) -> DataFrame:
    """pid, r, c under the template (dr, dc offsets) at each centre (pid, r, c); a placement that leaves the raster is skipped."""
    cells = centres.crossJoin(F.broadcast(template)).select("pid", (F.col("r") + F.col("dr")).alias("r"), (F.col("c") + F.col("dc")).alias("c"))  # a fixed template
    out = (F.col("r") < 0) | (F.col("r") >= height) | (F.col("c") < 0) | (F.col("c") >= width)
    gone = cells.filter(out).select("pid").distinct()
    return cells.join(gone, "pid", "left_anti")


def too_white(cells: DataFrame, wide: DataFrame, most: float, threshold: float = 250) -> DataFrame:
    """pid of placements whose cells are white beyond the share."""
    white = F.avg((F.least("b1", "b2", "b3") >= threshold).cast("double"))
    return cells.join(wide, ["r", "c"]).groupBy("pid").agg(white.alias("white_fraction")).filter(F.col("white_fraction") > most)


def stamped(wide: DataFrame, cells: DataFrame, value: float) -> DataFrame:
    """Bands 0 and the target at value under the cells (r, c)."""
    under = cells.select("r", "c").distinct().withColumn("_s", F.lit(True))
    j = wide.join(under, ["r", "c"], "left")
    on = F.coalesce("_s", F.lit(False))
    return j.withColumns({**{b: F.when(on, 0.0).otherwise(F.col(b)) for b in ("b1", "b2", "b3")}, "target": F.when(on, float(value)).otherwise(F.col("target"))}).drop("_s")


def turned(r: Column, c: Column, size: int, k: int = 0, flip_h: bool = False, flip_v: bool = False) -> tuple[Column, Column]:
    """Places in a square tile after k quarter turns against the clock, then flips."""
    for _ in range(k % 4):
        r, c = size - 1 - c, r
    return (size - 1 - r if flip_v else r), (size - 1 - c if flip_h else c)


def turned_by(r: Column, c: Column, size: int, turns: Column, flip_h: Column, flip_v: Column) -> tuple[Column, Column]:
    """``turned`` with turns and flips from columns."""
    places = [turned(r, c, size, k) for k in range(4)]
    k = F.pmod(turns, F.lit(4))
    pick = lambda n: F.when(k == 0, places[0][n]).when(k == 1, places[1][n]).when(k == 2, places[2][n]).otherwise(places[3][n])
    r, c = pick(0), pick(1)
    return F.when(flip_v, size - 1 - r).otherwise(r), F.when(flip_h, size - 1 - c).otherwise(c)


#: Weights of the bands in the gray that saturation and contrast are blended with.
BLEND = (0.2989, 0.587, 0.114)


def recoloured(
    tiles: DataFrame, by: str, brightness: float | Column = 0.0, contrast: float | Column = 1.0, saturation: float | Column = 1.0, gamma: float | Column = 1.0, hue: float | Column = 0.0,
    noise: float = 0.0, seed: int = 0, bands: tuple[str, ...] = ("b1", "b2", "b3"), contrast_first: bool = False,
) -> DataFrame:
    """Bands (0..1) after hue, saturation, contrast, gamma, brightness and noise; left alone with fewer than three bands.

    Hue, saturation, contrast and gamma give 0..1 each, so the next one starts from clamped bands; the sum
    with brightness and noise is clamped at the end. Contrast turns about the tile's mean gray;
    ``contrast_first`` has it before saturation. Noise is normal with deviation ``noise``, drawn by tile, place and band.
    """
    if len(bands) < 3:
        return tiles
    names, clamp = list(bands[:3]), lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    grey = lambda xs: sum(w * x for w, x in zip(BLEND, xs, strict=True))
    t = tiles
    if isinstance(hue, Column) or hue:
        h, saturated, top = hsv(*map(F.col, names))
        t = t.withColumns(dict(zip(names, rgb(F.pmod(h + hue, F.lit(1.0)), saturated, top), strict=True)))

    def blended(t: DataFrame, factor: float | Column, other: Column) -> DataFrame:
        return t.withColumn("_o", other).withColumns({n: clamp(factor * F.col(n) + (1 - factor) * F.col("_o")) for n in names}).drop("_o")

    for step in ("contrast", "saturation") if contrast_first else ("saturation", "contrast"):
        if step == "saturation":
            t = blended(t, saturation, grey(map(F.col, names)))
        else:
            t = blended(t.join(t.groupBy(by).agg(F.avg(grey(map(F.col, names))).alias("_m")), by), contrast, F.col("_m")).drop("_m")
    power = gamma if isinstance(gamma, Column) else F.lit(float(gamma))
    out = {}
    for k, n in enumerate(names, 1):
        x = clamp(F.pow(F.col(n), power)) + brightness
        out[n] = clamp(x + noise * draws.normal("noise", seed, by, "tr", "tc", F.lit(k)) if noise else x)
    return t.withColumns(out)


@dataclass(frozen=True)
class Augmentation:
    """Which changes are made, and the ranges that their parameters are drawn from."""

    geometric: bool = True
    color: bool = True
    contrast: tuple[float, float] = (0.72, 1.28)
    saturation: tuple[float, float] = (0.72, 1.28)
    brightness: tuple[float, float] = (-0.12, 0.12)
    noise: float = 0.03
    gamma: tuple[float, float] | None = (0.78, 1.22)
    hue: tuple[float, float] | None = (-0.04, 0.04)


def chosen(policy: str, flag: Column) -> Column:
    """The rows that are changed: all of them in training ('train'), or flagged rows only ('lobe')."""
    if policy == "train":
        return F.lit(True)
    if policy == "lobe":
        return F.coalesce(flag, F.lit(False))
    raise ValueError(f"no policy {policy!r}")


def draws_of(by: str, seed: int, kinds: Augmentation) -> dict[str, Column]:
    """turns, flip_h, flip_v and the colour parameters of a tile (a column), each from its own counter."""
    ranges = {"brightness": kinds.brightness, "contrast": kinds.contrast, "saturation": kinds.saturation, "gamma": kinds.gamma or (1.0, 1.0), "hue": kinds.hue or (0.0, 0.0)}
    still = {"brightness": 0.0, "contrast": 1.0, "saturation": 1.0, "gamma": 1.0, "hue": 0.0}
    out = {"turns": F.floor(4 * draws.uniform("turns", seed, by)).cast("int"), **{f: draws.uniform(f, seed, by) > 0.5 for f in ("flip_h", "flip_v")}}
    if not kinds.geometric:
        out = {"turns": F.lit(0), "flip_h": F.lit(False), "flip_v": F.lit(False)}
    return out | {n: draws.between(*r, n, seed, by) if kinds.color else F.lit(still[n]) for n, r in ranges.items()}


def augmented(tiles: DataFrame, by: str, size: int, policy: str, seed: int, kinds: Augmentation | None = None, flag: str = "augment", bands: tuple[str, ...] = ("b1", "b2", "b3")) -> DataFrame:
    """Cells of tiles (``by``, tr, tc, bands 0..1 and any other layers and targets) under an augmentation policy.

    A tile's cells keep all their values and move together, so features and targets are turned and
    flipped alike; only the three bands change colour. The flagged rows alone change with the policy
    'lobe', where both kinds of changes are always made. A tile with fewer than three bands keeps its colours.
    """
    kinds = kinds or Augmentation()
    if policy == "lobe":
        kinds = replace(kinds, geometric=True, color=True)
    use = chosen(policy, F.col(flag) if flag in tiles.columns else F.lit(None).cast("boolean"))
    d = draws_of(by, seed, kinds)
    r, c = turned_by(F.col("tr"), F.col("tc"), size, d["turns"], d["flip_h"], d["flip_v"])
    moved = tiles.withColumn("_use", use).withColumns({"_r": F.when(F.col("_use"), r).otherwise(F.col("tr")), "_c": F.when(F.col("_use"), c).otherwise(F.col("tc"))})
    moved = moved.withColumns({"tr": F.col("_r"), "tc": F.col("_c")}).drop("_r", "_c")
    if not kinds.color or len(bands) < 3:
        return moved.drop("_use")
    colours = {n: d[n] for n in ("brightness", "contrast", "saturation", "gamma", "hue")}
    changed = recoloured(moved.filter("_use"), by, **colours, noise=kinds.noise, seed=seed, bands=bands)
    return changed.unionByName(moved.filter("NOT _use")).drop("_use")


def extended_copies(
    cells: DataFrame, by: str, size: int, seed: int, contrast: tuple[float, float] = (0.8, 1.2), saturation: tuple[float, float] = (0.8, 1.2), bands: tuple[str, ...] = ("b1", "b2", "b3"),
) -> DataFrame:
    """The written copies of tiles (``by``, tr, tc, bands 0..255, other layers and targets): turn (0 to 3 quarter turns) beside the turned cells.

    A tile draws one contrast and one saturation for its four copies; contrast comes first. Bands are cut
    to whole numbers again, where 1e-9 below one is that one.
    """
    coloured = recoloured(
        cells.withColumns({b: F.col(b) / 255 for b in bands}), by, contrast=draws.between(*contrast, "copy contrast", seed, by), saturation=draws.between(*saturation, "copy saturation", seed, by),
        bands=bands, contrast_first=True,
    )
    whole = coloured.withColumns({b: F.floor(F.round(255 * F.col(b), 9)).cast("double") for b in bands}).withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(3))))
    r, c = turned_by(F.col("tr"), F.col("tc"), size, F.col("turn"), F.lit(False), F.lit(False))
    return whole.withColumns({"_r": r, "_c": c}).withColumns({"tr": F.col("_r"), "tc": F.col("_c")}).drop("_r", "_c")


def segment_scaled(cells: DataFrame, by: str, value: str = "segment", nodata: int = -9999) -> DataFrame:
    """Ids divided by the tile's greatest valid id; nodata and tiles without a valid id give 0."""
    top = F.max(F.when(F.col(value) != nodata, F.col(value))).over(Window.partitionBy(by))
    return cells.withColumn("scaled", F.when((F.col(value) != nodata) & (top > 0), F.col(value) / F.when(top > 0, top)).otherwise(0.0))
