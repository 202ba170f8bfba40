import random

import pytest
from pyspark.sql import functions as F

from tilewright.operators import grid as g


def loop_starts(length, tile, stride):
    if length < tile:
        return [0]
    starts = [k for k in range(0, length, stride) if k + tile <= length]
    return starts if starts[-1] == length - tile else [*starts, length - tile]


def test_strides():
    assert g.stride_of(256, 0.3) == 179 and g.stride_of(32, 0.3) == 22
    with pytest.raises(ValueError):
        g.stride_of(256, 1.0)


def test_starts_equal_a_loop(spark):
    rng = random.Random(1)
    for _ in range(25):
        length, tile = rng.randrange(1, 120), rng.randrange(2, 40)
        overlap = rng.choice([0.0, 0.25, 0.3, 0.5])
        stride = g.stride_of(tile, overlap)
        axis = g.Axis(length, tile, stride)
        want = loop_starts(length, tile, stride)
        df = spark.range(axis.count).select(axis.start(F.col("id")).alias("s"))
        assert [r.s for r in df.collect()] == want
        places = spark.range(length).select("id", axis.ordinals(F.col("id")).alias("o")).collect()
        for r in places:
            assert r.o == [k for k, s in enumerate(want) if s <= r.id < s + axis.size]


def test_known_grids(spark):
    assert g.tiles(spark, g.Grid.of(1_024, 1_024, 256)).count() == 36
    uneven = g.tiles(spark, g.Grid.of(1_000, 1_000, 256)).collect()
    assert all(t.row_end - t.row_start == 256 and t.col_end <= 1_000 for t in uneven)
    small = g.tiles(spark, g.Grid.of(100, 100, 256)).collect()
    assert [(t.row_start, t.row_end, t.col_end) for t in small] == [(0, 100, 100)]


def test_bounds_mode(spark):
    t = g.tiles(spark, g.Grid.of(64, 64, 32))
    with pytest.raises(ValueError):
        g.bounds(t, mode="middle")
    edge, center = g.bounds(t).first(), g.bounds(t, mode="center").first()
    assert center.minx - edge.minx == 0.5 and edge.maxx == 32
