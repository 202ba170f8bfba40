"""Scalar expressions over columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def world_to_cell(x: Column, y: Column, a: float, e: float, x0: float, y0: float) -> tuple[Column, Column]:
    """(row, col) of world coordinates under a north-up transform."""
    return F.floor((y - y0) / e), F.floor((x - x0) / a)


def normalized(v: Column, kind: str, mean: Column | None = None, std: Column | None = None) -> Column:
    """rgb (/255), standardize (a spread of 0 counts as 1), clip (to 0..1) or none."""
    if kind == "rgb":
        return v / 255.0
    if kind == "standardize":
        return (v - mean) / F.when(std == 0, 1.0).otherwise(std)
    if kind == "clip":
        return F.least(F.lit(1.0), F.greatest(F.lit(0.0), v))
    if kind == "none":
        return v
    raise ValueError(f"no normalization {kind!r}")


def hsv(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Hue 0..1, saturation and value of bands scaled to 0..1."""
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    gap = top - low
    safe = F.when(gap == 0, 1.0).otherwise(gap)
    sixth = F.when(gap == 0, 0.0).when(top == r, (g - b) / safe).when(top == g, 2.0 + (b - r) / safe).otherwise(4.0 + (r - g) / safe)
    hue = sixth / 6.0 - F.floor(sixth / 6.0)
    return hue, F.when(top == 0, 0.0).otherwise(gap / F.when(top == 0, 1.0).otherwise(top)), top


def rgb(h: Column, s: Column, v: Column) -> tuple[Column, Column, Column]:
    """Bands 0..1 from hue, saturation and value (all 0..1)."""
    def band(n: int) -> Column:
        k = F.pmod(n + h * 6, F.lit(6.0))
        return v - v * s * F.greatest(F.lit(0.0), F.least(k, 4 - k, F.lit(1.0)))

    return band(5), band(3), band(1)


def tile_key(text: Column) -> Column:
    """tile_0007 from 7, '7', 'tile_0007'; other texts stay."""
    t = F.trim(text.cast("string"))
    return F.when(t.rlike(r"^\d+$"), F.format_string("tile_%04d", F.expr("1") * F.when(t.rlike(r"^\d+$"), t).cast("long"))).otherwise(t)


def tile_label(text: Column) -> Column:
    return F.regexp_replace(text, "^tile_", "")


def tile_number(text: Column) -> Column:
    """The digits after the last underscore; null if there are none."""
    return F.nullif(F.regexp_extract(text, r"_([0-9]+)$", 1), F.lit("")).cast("long")


def decay(distance: Column, top: float, reach: float) -> Column:
    """max(0, top - d) up to ``reach``, cut to a whole number; 0 beyond it or without a distance."""
    return F.when(distance <= reach, F.floor(F.greatest(F.lit(0.0), F.lit(float(top)) - distance))).otherwise(0).cast("long")


def proximity_token(path: Column) -> Column:
    """Reach named in a path; 20 is looked for before 10."""
    low = F.lower(path)
    return F.when(low.contains("proximity20"), 20).when(low.contains("proximity10"), 10)


def snapped_reach(top: Column) -> Column:
    """10 or 20 if the maximum is near that (10 is looked for first), else the maximum."""
    return F.when(F.abs(top - 10) <= 1, 10.0).when(F.abs(top - 20) <= 1, 20.0).otherwise(top)


def bearing(dy: Column, dx: Column) -> Column:
    """atan2(-dy, -dx) in -pi to pi; without a vertical part it is -pi (flat cells too) or 0, as with a negative zero."""
    return F.when((dy == 0) & (dx >= 0), -math.pi).otherwise(F.atan2(-dy, -dx))


def alignment(angle: Column, other: Column, power: float = 1.0) -> Column:
    """((cos of the difference + 1) / 2) ^ power."""
    return F.pow((F.cos(angle - other) + 1) / 2, F.lit(float(power)))

