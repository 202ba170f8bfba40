"""Neighbourhood operators on cells: proximity, smoothing, gradients, texture, borders and regions."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilewright.functions.scalar import alignment, bearing, decay
from tilewright.operators.blockwise import SIZE, on_blocks, packed
from tilewright.operators.components import components
from tilewright.shared import new_path


#: Up to this reach each positive cell writes to its neighbours, which takes 2 x (2 reach + 1) rows; beyond it the distance map is cheaper.
NEAR = 8


def proximity(positives: DataFrame, height: int, width: int, top: float, reach: int) -> DataFrame:
    """r, c, proximity of the cells within ``reach`` of a positive cell (r, c): top less the exact distance, cut to whole numbers.

    For a small reach, pass 1 finds, in each column, every row's distance to its nearest positive above or
    below; pass 2 spreads that along the row. Only neighbourhoods of positives are touched, and no
    positive gives no row.
    """
    if reach > NEAR:
        far = distances(positives, height, width, reach)
        return far.select("r", "c", decay(F.sqrt("d2"), top, reach).alias("proximity"))
    up = positives.select("c", F.explode(F.sequence(F.col("r") - reach, F.col("r") + reach)).alias("r"), F.col("r").alias("_r"))
    columns = up.filter((F.col("r") >= 0) & (F.col("r") < height)).groupBy("r", "c").agg(F.min(F.abs(F.col("r") - F.col("_r"))).alias("g"))
    spread = columns.select("r", F.col("c").alias("_c"), "g", F.explode(F.sequence(F.col("c") - reach, F.col("c") + reach)).alias("c"))
    d2 = spread.filter((F.col("c") >= 0) & (F.col("c") < width)).groupBy("r", "c").agg(F.min((F.col("c") - F.col("_c")) * (F.col("c") - F.col("_c")) + F.col("g") * F.col("g")).alias("d2"))
    return d2.filter(F.col("d2") <= reach * reach).select("r", "c", decay(F.sqrt("d2"), top, reach).alias("proximity"))


#: Rows are worked on together up to about so many cells.
STRIP_CELLS = 1 << 21
#: Stands for no positive cell; its square still fits.
NONE = 1 << 30


def lower_envelope(g: np.ndarray) -> np.ndarray:
    """For each row of column distances g (NONE: none) the least of (c - k) ** 2 + g[k] ** 2 over k; at least NONE if there is none.

    The parabolas over k that are lowest somewhere are kept on a stack with the places where they begin;
    all rows are taken along together.
    """
    rows, width = g.shape
    f = g.astype(np.float64) ** 2
    stack, begin = np.zeros((rows, width), np.int64), np.full((rows, width + 1), -np.inf)
    top = np.full(rows, -1)
    every = np.arange(rows)
    for q in range(width):
        new = every[g[:, q] < NONE]
        if not len(new):
            continue
        start = np.full(len(new), -np.inf)
        rest = np.flatnonzero(top[new] >= 0)
        while len(rest):
            at = new[rest]
            v = stack[at, top[at]]
            s = (f[at, q] + q * q - f[at, v] - v * v) / (2 * (q - v))
            pop = s <= begin[at, top[at]]
            start[rest] = s
            top[at[pop]] -= 1
            rest = rest[pop]
            empty = top[new[rest]] < 0
            start[rest[empty]] = -np.inf
            rest = rest[~empty]
        top[new] += 1
        stack[new, top[new]] = q
        begin[new, top[new]] = start
    out = np.full((rows, width), float(NONE))
    some = every[top >= 0]
    at = np.zeros(rows, np.int64)
    for q in range(width):
        while True:
            on = some[(at[some] < top[some])]
            on = on[begin[on, at[on] + 1] < q]
            if not len(on):
                break
            at[on] += 1
        v = stack[some, at[some]]
        out[some, q] = f[some, v] + (q - v) ** 2
    return out


def distances(positives: DataFrame, height: int, width: int, reach: int | None = None, block: int = SIZE) -> DataFrame:
    """r, c, d2: the exact squared distance to the nearest positive cell (r, c), of all cells, or of those within ``reach``.

    Blocks of cells: each tells the first and last positive row of its columns; those are carried from
    block to block along the columns, which gives every cell's distance within its column; the lower
    envelope of parabolas over a row gives the distance. No positive gives no row. The rows that are
    shuffled are blocks and strips of the raster, however far the reach. A column of blocks and a strip
    of rows must fit a task.
    """
    blocks = packed(positives.select(F.lit("p").alias("layer"), F.lit(1).alias("band"), "r", "c", F.lit(1.0).alias("value")).distinct(), block)
    far = NONE if reach is None else reach
    count = -(-height // block)
    wide = lambda b: min(block, width - b * block)

    def flags(r: dict) -> np.ndarray:
        there = np.zeros((block, block), bool)
        there[r["r0"] - r["brow"] * block :, r["c0"] - r["bcol"] * block :][: r["h"], : r["w"]] = True if r["mask"] is None else np.unpackbits(np.frombuffer(r["mask"], np.uint8))[: r["h"] * r["w"]].reshape(r["h"], r["w"])
        return there

    def carry(pdf: pd.DataFrame) -> pd.DataFrame:
        """For each block of a column of blocks the nearest positive rows above and below it."""
        bcol = int(pdf["bcol"].iloc[0])
        first, last = np.full((count, wide(bcol)), 2 * NONE), np.full((count, wide(bcol)), -2 * NONE)
        own = {}
        for r in pdf.to_dict("records"):
            there = flags(r)[:, : wide(bcol)]
            some, base = there.any(axis=0), r["brow"] * block
            first[r["brow"], some] = base + there.argmax(axis=0)[some]
            last[r["brow"], some] = base + block - 1 - there[::-1].argmax(axis=0)[some]
            own[r["brow"]] = np.packbits(there).tobytes()
        above, below = np.full_like(last, -2 * NONE), np.full_like(first, 2 * NONE)
        above[1:] = np.maximum.accumulate(last, axis=0)[:-1]
        below[:-1] = np.minimum.accumulate(first[::-1], axis=0)[::-1][1:]
        rows = []
        for b in range(count):
            if b in own or (b * block - above[b]).min() <= far or (below[b] - (b + 1) * block + 1).min() <= far:
                rows.append((b, bcol, above[b].tobytes(), below[b].tobytes(), own.get(b)))
        return pd.DataFrame(rows, columns=["brow", "bcol", "above", "below", "own"])

    strip = max(1, STRIP_CELLS // width)

    def column_distances(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                w, h, base = wide(r["bcol"]), min(block, height - r["brow"] * block), r["brow"] * block
                row = base + np.arange(h)[:, None]
                there = np.zeros((h, w), bool) if r["own"] is None else np.unpackbits(np.frombuffer(r["own"], np.uint8))[: block * w].reshape(block, w)[:h].astype(bool)
                up = np.maximum(np.maximum.accumulate(np.where(there, row, -2 * NONE), axis=0), np.frombuffer(r["above"], np.int64))
                down = np.minimum(np.minimum.accumulate(np.where(there, row, 2 * NONE)[::-1], axis=0)[::-1], np.frombuffer(r["below"], np.int64))
                g = np.minimum(row - up, down - row)
                g = np.where(g <= far, np.minimum(g, NONE), NONE).astype(np.int32)
                for k in range(base // strip, (base + h - 1) // strip + 1):
                    a, b = max(base, k * strip), min(base + h, (k + 1) * strip)
                    out.append({"strip": k, "r0": a, "c0": r["bcol"] * block, "h": b - a, "w": w, "data": g[a - base : b - base].tobytes()})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("strip", pa.int64()), ("r0", pa.int64()), ("c0", pa.int64()), ("h", pa.int32()), ("w", pa.int32()), ("data", pa.binary())]))

    def along_rows(pdf: pd.DataFrame) -> pd.DataFrame:
        r0, h = int(pdf["r0"].min()), int((pdf["r0"] + pdf["h"]).max() - pdf["r0"].min())
        g = np.full((h, width), NONE, np.int32)
        for r in pdf.to_dict("records"):
            g[r["r0"] - r0 : r["r0"] - r0 + r["h"], r["c0"] : r["c0"] + r["w"]] = np.frombuffer(r["data"], np.int32).reshape(r["h"], r["w"])
        use = np.flatnonzero((g < NONE).any(axis=1))
        d2 = lower_envelope(g[use])
        i, j = np.nonzero(d2 <= float(far) * far if reach is not None else d2 < float(NONE) * NONE)
        return pd.DataFrame({"r": use[i] + r0, "c": j, "d2": d2[i, j].astype(np.int64)})

    carried = blocks.groupBy("bcol").applyInPandas(carry, "brow bigint, bcol bigint, above binary, below binary, own binary")
    strips = carried.mapInArrow(column_distances, "strip bigint, r0 bigint, c0 bigint, h int, w int, data binary")
    return strips.groupBy("strip").applyInPandas(along_rows, "r bigint, c bigint, d2 bigint")


def gaussian_taps(sigma: float) -> np.ndarray:
    radius = int(4 * sigma + 0.5)
    t = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    return t / t.sum()


def separable(a: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Correlation with w along rows and columns, edges repeated."""
    k = len(w) // 2
    p = np.pad(a, ((k, k), (0, 0)), mode="edge")
    a = sum(x * p[t : t + a.shape[0]] for t, x in enumerate(w))
    p = np.pad(a, ((0, 0), (k, k)), mode="edge")
    return sum(x * p[:, t : t + a.shape[1]] for t, x in enumerate(w))


def smoothed(cells: DataFrame, height: int, width: int, sigma: float, value: str = "value", block: int = SIZE) -> DataFrame:
    """Gaussian smoothing of r, c, value with edges repeated."""
    w = gaussian_taps(sigma)
    return on_cells({"cells": cells.select("r", "c", F.col(value).alias("value"))}, block, len(w) // 2, lambda cells: separable(cells[0], w), (value,))


def on_cells(layers: dict[str, DataFrame], block: int, halo: int, function: Callable[..., np.ndarray | tuple], outputs: tuple[str, ...], missing: float = 0.0) -> DataFrame:
    """``blockwise.on_blocks`` over layers of one band, given as r, c, value."""
    every = None
    for name, cells in layers.items():
        part = cells.select(F.lit(name).alias("layer"), F.lit(1).alias("band"), "r", "c", "value")
        every = part if every is None else every.unionByName(part)
    return on_blocks(packed(every, block), block, halo, dict.fromkeys(layers, [1]), function, outputs, missing)


def gray(r, g, b, scale: bool = True):
    """0.299 r + 0.587 g + 0.114 b, of bands 0..255 if ``scale``."""
    v = 0.299 * r + 0.587 * g + 0.114 * b
    return v / 255.0 if scale else v


def around(cells: DataFrame, value: str, block: int = 64) -> DataFrame:
    """The cell with its eight neighbours nw, n, ne, w, e, sw, s, se (null outside): rows by lag in column blocks, columns likewise."""
    rows = Window.partitionBy("c", "_b").orderBy("r")
    near = lambda along: F.sequence(F.floor((F.col(along) - 1) / block), F.floor((F.col(along) + 1) / block))
    own = lambda along: F.floor(F.col(along) / block) == F.col("_b")
    at = lambda e, d, along: F.when(F.lag(along, -d).over(e) == F.col(along) + d, F.lag(value, -d).over(e))
    v = cells.select("r", "c", value).withColumn("_b", F.explode(near("r")))
    v = v.withColumn("n", at(rows, -1, "r")).withColumn("s", at(rows, 1, "r")).filter(own("r")).drop("_b")
    cols = Window.partitionBy("r", "_b").orderBy("c")
    v = v.withColumn("_b", F.explode(near("c")))
    for name, d in (("w", -1), ("e", 1)):
        there = F.lag("c", -d).over(cols) == F.col("c") + d
        for src, out in ((value, name), ("n", f"n{name}"), ("s", f"s{name}")):
            v = v.withColumn(out, F.when(there, F.lag(src, -d).over(cols)))
    return v.filter(own("c")).drop("_b")


def gradient(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """gx, gy of the 3 x 3 operator; beyond an edge and for missing cells (NaN) the nearest cell stands in."""
    p = np.pad(a, 1, mode="constant", constant_values=np.nan)
    at = lambda dr, dc: p[1 + dr : 1 + dr + a.shape[0], 1 + dc : 1 + dc + a.shape[1]]
    first = lambda *xs: xs[0] if len(xs) == 1 else np.where(np.isnan(xs[0]), first(*xs[1:]), xs[0])
    n, s, w, e = (first(at(*d), a) for d in ((-1, 0), (1, 0), (0, -1), (0, 1)))
    nw, ne = first(at(-1, -1), at(-1, 0), at(0, -1), a), first(at(-1, 1), at(-1, 0), at(0, 1), a)
    sw, se = first(at(1, -1), at(1, 0), at(0, -1), a), first(at(1, 1), at(1, 0), at(0, 1), a)
    return (ne + 2 * e + se) - (nw + 2 * w + sw), (sw + 2 * s + se) - (nw + 2 * n + ne)


def sobel(cells: DataFrame, value: str = "value", block: int = SIZE) -> DataFrame:
    """r, c, gx, gy with edge cells repeated outward."""
    return on_cells({"cells": cells.select("r", "c", F.col(value).alias("value"))}, block, 1, lambda cells: gradient(cells[0]), ("gx", "gy"), np.nan)


def slope_bearing(a: np.ndarray) -> np.ndarray:
    """atan2(-dy, -dx) by central differences; one that would need a missing cell (NaN, or beyond the array) is 0."""
    p = np.pad(a, 1, mode="constant", constant_values=np.nan)
    dx, dy = (p[1:-1, 2:] - p[1:-1, :-2]) / 2, (p[2:, 1:-1] - p[:-2, 1:-1]) / 2
    dx, dy = np.where(np.isnan(dx), 0.0, dx), np.where(np.isnan(dy), 0.0, dy)
    # Without a vertical part: -pi (flat cells too) or 0, as with a negative zero.
    return np.where((dy == 0) & (dx >= 0), -math.pi, np.arctan2(-dy, -dx))


def aspect(cells: DataFrame, value: str = "value", block: int = SIZE) -> DataFrame:
    """r, c, aspect = atan2(-dy, -dx) by central differences; a difference that would leave the raster is 0."""
    return on_cells({"cells": cells.select("r", "c", F.col(value).alias("value"))}, block, 1, lambda cells: slope_bearing(cells[0]), ("aspect",), np.nan)


def tensor(gradients: tuple[np.ndarray, np.ndarray], sigma: float) -> tuple[np.ndarray, np.ndarray]:
    """coherence, angle (along the stripes) of the structure tensor."""
    gx, gy = gradients
    w = gaussian_taps(sigma)
    jxx, jyy, jxy = (separable(x, w) for x in (gx * gx, gy * gy, gx * gy))
    coherence = np.clip(np.hypot(jxx - jyy, 2 * jxy) / (jxx + jyy + FLAT), 0, 1)
    return coherence, np.arctan2(2 * jxy, jxx - jyy + FLAT) + math.pi / 2


def texture_sweep(grays: DataFrame, dem: DataFrame, sigma_smooth: float, sigmas: tuple[float, ...], block: int = SIZE) -> DataFrame:
    """r, c, aspect, and coherence_0, angle_0, coherence_1 ... of the structure tensor for each of ``sigmas``, in one pass over the blocks."""
    w = gaussian_taps(sigma_smooth)
    halo = len(w) // 2 + 1 + max(len(gaussian_taps(s)) // 2 for s in sigmas)

    def run(gray: np.ndarray, dem: np.ndarray) -> list[np.ndarray]:
        g = gradient(separable(np.nan_to_num(gray[0]), w))
        return [slope_bearing(dem[0]), *(x for s in sigmas for x in tensor(g, s))]

    names = ("aspect", *(f"{n}_{k}" for k in range(len(sigmas)) for n in ("coherence", "angle")))
    return on_cells({"gray": grays.select("r", "c", "value"), "dem": dem.select("r", "c", "value")}, block, halo, run, names, np.nan)


def texture(grays: DataFrame, dem: DataFrame, height: int, width: int, sigma_smooth: float = 1.5, sigma_structure: float = 2.0, power: float = 1.0, block: int = SIZE) -> DataFrame:
    """r, c, coherence, angle (along the stripes), aspect, stripes: structure tensor of the smoothed gray cells, and coherence times its alignment with the slope.

    The gradient's angle is atan2(2 Jxy, Jxx - Jyy), not halved; the stripes lie a quarter turn from it,
    and perpendicular alignment counts 0.5.
    """
    j = texture_sweep(grays, dem, sigma_smooth, (sigma_structure,), block).withColumnsRenamed({"coherence_0": "coherence", "angle_0": "angle"})
    return j.select("r", "c", "coherence", "angle", "aspect", along_slope(F.col("coherence"), F.col("angle"), power).alias("stripes"))


#: Keeps flat places from dividing by 0.
FLAT = 1e-12


def unit_range(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def along_slope(strength: Column, angle: Column, power: float | Column) -> Column:
    """strength times (alignment of the angle with the column aspect) to a power: 0 ignores the slope, above 1 stresses it."""
    p = power if isinstance(power, Column) else F.lit(float(power))
    return unit_range(strength * F.pow(F.greatest(alignment(angle, F.col("aspect")), F.lit(FLAT)), p))


def borders(cells: DataFrame, ident: str = "segment", nodata: int = -9999) -> DataFrame:
    """r, c, border: a cell one of whose four neighbours has another valid id."""
    v = around(cells, ident)
    other = lambda n: F.coalesce((F.col(n) != F.col(ident)) & (F.col(n) != nodata), F.lit(False))
    return v.select("r", "c", ((F.col(ident) != nodata) & (other("n") | other("s") | other("w") | other("e"))).alias("border"))


@dataclass(frozen=True)
class Transform:
    """A derived layer: inputs by name with their band counts, the halo it needs (a number, or a function of the options), a function of arrays (name -> bands x h x w), and the names of what it returns."""

    inputs: dict[str, int]
    halo: int | Callable[..., int]
    function: Callable[..., np.ndarray]
    outputs: tuple[str, ...] = ("value",)


TRANSFORMS: dict[str, Transform] = {}


def register_transform(name: str, transform: Transform) -> None:
    TRANSFORMS[name] = transform


def derived(layers: dict[str, DataFrame], name: str, block: int = 64, **options) -> DataFrame:
    """r, c and the outputs of a named transform over layers (band, r, c, value), block by block with halos.

    A missing layer or a wrong number of bands is an error. A block with its halo must fit a task.
    """
    t = TRANSFORMS[name]
    absent = set(t.inputs) - set(layers)
    if absent:
        raise ValueError(f"{name} needs layers {sorted(absent)}")
    every = None
    for layer in t.inputs:
        part = layers[layer].select(F.lit(layer).alias("layer"), "band", "r", "c", F.col("value").cast("double").alias("value"))
        every = part if every is None else every.unionByName(part)
    found = {layer: [] for layer in t.inputs}
    for r in every.select("layer", "band").distinct().collect():  # a row for each band
        found[r["layer"]].append(r["band"])
    for layer, bands in t.inputs.items():
        if len(found[layer]) != bands:
            raise ValueError(f"{name} needs {bands} bands of {layer}, not {len(found[layer])}")
    halo, function = t.halo(**options) if callable(t.halo) else t.halo, t.function
    return on_blocks(packed(every, block), block, halo, {n: sorted(b) for n, b in found.items()}, lambda **arrays: function(**arrays, **options), t.outputs)


def filtered(a: np.ndarray, kernel: np.ndarray, mode: str = "edge") -> np.ndarray:
    """Correlation with edges repeated, or mirrored (mode 'symmetric')."""
    kr, kc = kernel.shape[0] // 2, kernel.shape[1] // 2
    p = np.pad(a, ((kr, kr), (kc, kc)), mode=mode)
    view = np.lib.stride_tricks.sliding_window_view(p, kernel.shape)
    return np.einsum("ijkl,kl->ij", view, kernel)


def gabor_reach(frequency: float = 0.1, sigma: float = 3.0, orientations: int = 16) -> int:
    """Kernels end at three sigma."""
    return max(1, math.ceil(3 * sigma))


def gabor_kernel(theta: float, frequency: float, sigma: float) -> np.ndarray:
    """A complex wave along theta under a round Gaussian; its box just holds three sigma along the turned axes."""
    reach_x = math.ceil(max(abs(3 * sigma * math.cos(theta)), abs(3 * sigma * math.sin(theta)), 1))
    y, x = np.mgrid[-reach_x : reach_x + 1, -reach_x : reach_x + 1]
    along = x * math.cos(theta) + y * math.sin(theta)
    return np.exp(-(x**2 + y**2) / (2 * sigma**2)) / (2 * math.pi * sigma**2) * np.exp(2j * math.pi * frequency * along)


def gabor_bank(rgb: np.ndarray, frequency: float = 0.1, sigma: float = 3.0, orientations: int = 16) -> np.ndarray:
    """The largest magnitude over the orientations, cell by cell, and the first orientation that has it; the scale is left to a second pass.

    The bank is a product of Fourier transforms with mirrored edges. Magnitudes that differ by rounding only count as equal.
    """
    v = (0.299 * rgb[0] + 0.587 * rgb[1] + 0.114 * rgb[2]) / 255.0
    reach = gabor_reach(frequency, sigma)
    p = np.pad(v, reach, mode="symmetric")
    shape = [1 << (n + 2 * reach - 1).bit_length() for n in p.shape]
    image = np.fft.fft2(p, shape)
    best, which = np.full(v.shape, -1.0), np.zeros(v.shape)
    for k in range(orientations):
        theta = math.pi * k / orientations
        kernel = gabor_kernel(theta, frequency, sigma)
        at = reach + kernel.shape[0] // 2
        size = np.abs(np.fft.ifft2(image * np.fft.fft2(kernel, shape)))[at : at + v.shape[0], at : at + v.shape[1]]
        which[size > best + 1e-9] = theta
        best = np.maximum(best, size)
    return np.stack([best, which])


register_transform("gabor", Transform({"rgb": 3}, gabor_reach, gabor_bank, ("strength", "theta")))
register_transform("mean3", Transform({"rgb": 3}, 1, lambda rgb: filtered(rgb.mean(0), np.full((3, 3), 1 / 9))))


def gabor_stripes(rgb: DataFrame, dem: DataFrame, block: int = 64, power: float = 1.0, norm_scope: str = "raster", **options) -> DataFrame:
    """r, c, strength, angle (along the stripes), aspect, stripes: the bank's magnitude, scaled by the largest of the raster (or of each block with norm_scope 'block'), times its alignment with the slope to a power. dem: r, c, value."""
    raw = _kept(derived({"rgb": rgb}, "gabor", block, **options), "gabor")
    if norm_scope == "block":
        keys = [F.floor(F.col("r") / block).alias("_br"), F.floor(F.col("c") / block).alias("_bc")]
        raw = raw.select("*", *keys)
        raw = raw.withColumn("_top", F.max("strength").over(Window.partitionBy("_br", "_bc"))).drop("_br", "_bc")
    else:
        raw = raw.crossJoin(F.broadcast(raw.agg(F.max("strength").alias("_top"))))  # one row
    scaled = F.when(F.col("_top") > FLAT, unit_range(F.col("strength") / F.when(F.col("_top") > FLAT, F.col("_top")))).otherwise(F.col("strength"))
    known = raw.select("r", "c", scaled.alias("strength"), (F.col("theta") + math.pi / 2).alias("angle")).join(aspect(dem), ["r", "c"])
    return known.withColumn("stripes", along_slope(F.col("strength"), F.col("angle"), power))


def block_regions(there: np.ndarray) -> tuple[np.ndarray, int, np.ndarray]:
    """(label of each cell, -1 without; number of labels; pairs of neighbours by label) by four neighbours: runs of rows, joined where they overlap."""
    h, w = there.shape
    edge = np.diff(np.pad(there, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, first = np.nonzero(edge == 1)
    last = np.nonzero(edge == -1)[1] - 1
    key = row * w
    lo, hi = np.searchsorted(key + last, key + w + first), np.searchsorted(key + first, key + w + last, "right")
    n = np.maximum(hi - lo, 0)
    a = np.repeat(np.arange(len(row)), n)
    b = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + lo[a]
    parent = list(range(len(row)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    _, label = np.unique(np.array([root(x) for x in parent], np.int64), return_inverse=True)
    cells = np.full((h, w), -1, np.int64)
    cells[there] = np.repeat(label, last - first + 1)
    count = int(label.max(initial=-1)) + 1
    pairs = np.bincount(label, last - first, count) + np.bincount(label[a], np.minimum(last[a], last[b]) - np.maximum(first[a], first[b]) + 1, count)
    return cells, count, pairs.astype(np.int64)


def regions(valid: DataFrame, block: int = SIZE) -> DataFrame:
    """Connected valid cells (r, c) by four neighbours: region (its first cell's row and column), area, box and border edges.

    Two levels: regions inside each block, and links between those that touch at a border of blocks. Only
    the links take rounds, by star contraction, so their number follows the number of blocks and not the shape.
    """
    blocks = packed(valid.select(F.lit("v").alias("layer"), F.lit(1).alias("band"), "r", "c", F.lit(1.0).alias("value")).distinct(), block)
    names = ["side", "label", "r", "c", "area", "r1", "c0", "c1", "edges"]

    def label(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                there = np.ones((r["h"], r["w"]), bool) if r["mask"] is None else np.unpackbits(np.frombuffer(r["mask"], np.uint8))[: r["h"] * r["w"]].reshape(r["h"], r["w"]).astype(bool)
                cells, n, pairs = block_regions(there)
                i, j = np.nonzero(there)
                of = cells[i, j]
                i, j = i + r["r0"], j + r["c0"]
                at = np.unique(of, return_index=True)[1]
                ids = (i[at] << 32) + j[at]  # labels are in the order of their first cells
                area = np.bincount(of, minlength=n)
                low = lambda x: np.minimum.reduceat(x[np.argsort(of, kind="stable")], np.cumsum(area) - area)  # noqa: E731, B023
                high = lambda x: np.maximum.reduceat(x[np.argsort(of, kind="stable")], np.cumsum(area) - area)  # noqa: E731, B023
                out += zip(["region"] * n, ids.tolist(), i[at].tolist(), j[at].tolist(), area.tolist(), high(i).tolist(), low(j).tolist(), high(j).tolist(), (4 * area - 2 * pairs).tolist(), strict=True)
                # Cells at the borders of the block; those at its end look at the cell behind it.
                for side, use, dr, dc in (("begin", (i % block == 0) | (j % block == 0), 0, 0), ("end", i % block == block - 1, 1, 0), ("end", j % block == block - 1, 0, 1)):
                    out += ((side, x, y, z, None, None, None, None, None) for x, y, z in zip(ids[of[use]].tolist(), (i[use] + dr).tolist(), (j[use] + dc).tolist(), strict=True))
            yield pa.RecordBatch.from_pylist([dict(zip(names, o, strict=True)) for o in out], pa.schema([("side", pa.string()), *((x, pa.int64()) for x in names[1:])]))

    found = _kept(blocks.mapInArrow(label, "side string, " + ", ".join(f"{n} bigint" for n in names[1:])), "regions")
    at = lambda side, name: found.filter(F.col("side") == side).select(F.col("label").alias(name), "r", "c")
    links = _kept(at("end", "a").join(at("begin", "b"), ["r", "c"]).groupBy("a", "b").agg(F.count("*").alias("n")), "region-links")
    roots = components(links).withColumnRenamed("label", "root")
    shared = links.select(F.col("a").alias("node"), "n").join(roots, "node").groupBy("root").agg(F.sum("n").alias("n"))
    whole = found.filter("side = 'region'").join(roots, F.col("label") == F.col("node"), "left").withColumn("root", F.coalesce("root", "label"))
    whole = whole.groupBy("root").agg(F.sum("area").alias("area"), F.min("r").alias("r0"), F.max("r1").alias("r1"), F.min("c0").alias("c0"), F.max("c1").alias("c1"), F.sum("edges").alias("edges"))
    return whole.join(shared, "root", "left").select(
        F.floor(F.col("root") / (1 << 32)).alias("first_r"), F.pmod("root", F.lit(1 << 32)).alias("first_c"), "area", "r0", "r1", "c0", "c1", (F.col("edges") - 2 * F.coalesce("n", F.lit(0))).alias("border_edges")
    )


def _kept(df: DataFrame, name: str) -> DataFrame:
    """Written to the folder of spark.checkpoint.dir and read again, which cuts the lineage of a loop."""
    path, schema = new_path(df.sparkSession, name), df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)
