"""Random numbers from counters: what is drawn depends on seed, purpose and keys alone, never on partitions or order."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

BITS = 53


def uniform(purpose: str, seed: int, *keys: Column | str) -> Column:
    """A number in [0, 1). Two rounds of a 64-bit hash (each multiplies, rotates and xors several times): one of the keys, one of the result with seed and purpose."""
    first = F.xxhash64(F.lit(purpose), *[F.col(k) if isinstance(k, str) else k for k in keys])
    second = F.xxhash64(first, F.lit(seed), F.lit(purpose))
    return F.shiftrightunsigned(second, 64 - BITS) / F.lit(float(1 << BITS))


def between(low: float, high: float, purpose: str, seed: int, *keys: Column | str) -> Column:
    """A number in [low, high)."""
    return F.lit(float(low)) + F.lit(float(high - low)) * uniform(purpose, seed, *keys)


def normal(purpose: str, seed: int, *keys: Column | str) -> Column:
    """A number of the standard normal distribution: length and angle of a point of the plane, both drawn."""
    length = F.sqrt(-2 * F.log(1 - uniform(f"{purpose} length", seed, *keys)))
    return length * F.cos(2 * math.pi * uniform(f"{purpose} angle", seed, *keys))
