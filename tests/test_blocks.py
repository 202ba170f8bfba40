"""Block tables, the block store, and neighbourhood operators over blocks of any size."""

import glob

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tilewright.operators import blockwise, components, stencil
from tilewright.shared import new_path
from tilewright.sources import blocks as store


def cells_of(spark, a, present=None):
    rows = [(r, c, float(a[r, c])) for r in range(a.shape[0]) for c in range(a.shape[1]) if present is None or present[r, c]]
    return spark.createDataFrame(rows, "r long, c long, value double")


def array_of(df, shape, name="value"):
    out = np.full(shape, np.nan)
    for r in df.select("r", "c", name).collect():
        out[r.r, r.c] = r[name]
    return out


def layered(cells, layer="a", band=1):
    return cells.select(F.lit(layer).alias("layer"), F.lit(band).alias("band"), "r", "c", "value")


@pytest.mark.parametrize("size", [3, 8, 64])
def test_packed_and_unpacked(spark, size):
    rng = np.random.default_rng(1)
    a, there = rng.random((13, 21)), rng.random((13, 21)) < 0.7
    a[2, 2], there[2, 2] = np.nan, True
    back = blockwise.unpacked(blockwise.packed(layered(cells_of(spark, a, there)), size))
    got = sorted((r.r, r.c, repr(r.value)) for r in back.collect())
    assert got == sorted((r, c, repr(float(a[r, c]))) for r in range(13) for c in range(21) if there[r, c])


@pytest.mark.parametrize("rows", [1, 7, 64, 10_000])
def test_blocks_are_packed_many_to_a_call_in_any_cut(spark, rows):
    rng = np.random.default_rng(2)
    a, there = rng.random((21, 17)), rng.random((21, 17)) < 0.8
    cells = layered(cells_of(spark, a, there)).unionByName(layered(cells_of(spark, -a, there), band=2)).unionByName(layered(cells_of(spark, a), layer=None))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    try:
        blocks = blockwise.packed(cells, 8)
        assert "InPandas" not in blocks._jdf.queryExecution().executedPlan().toString()
        got = sorted(map(repr, map(tuple, blockwise.unpacked(blocks).collect())))
        assert blocks.count() == 3 * 3 * 3
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == sorted(map(repr, map(tuple, cells.select("layer", "band", "r", "c", "value").collect())))


@pytest.mark.parametrize(("size", "halo"), [(4, 0), (4, 1), (4, 9), (64, 3)])
def test_halos_hold_the_neighbourhood(spark, size, halo):
    a = np.arange(11 * 14, dtype=float).reshape(11, 14)
    k = np.ones((2 * halo + 1, 2 * halo + 1))
    total = lambda a: stencil.filtered(np.nan_to_num(a[0]), k)
    got = blockwise.on_blocks(blockwise.packed(layered(cells_of(spark, a)), size), size, halo, {"a": [1]}, total, ("value",))
    assert np.allclose(array_of(got, a.shape), stencil.filtered(a, k))


def test_a_window_reads_few_row_groups(spark, tmp_path):
    a = np.arange(64 * 64, dtype=float).reshape(64, 64)
    cells = layered(cells_of(spark, a)).unionByName(layered(cells_of(spark, -a), band=2))
    store.write_raster(cells, str(tmp_path / "raster"), size=4, files=2, row_group=2_000)
    window = (9, 17, 14, 10)
    got = store.read_window(spark, str(tmp_path / "raster"), *window, layer="a", bands=[2], size=4)
    assert sorted((r.band, r.r, r.c, r.value) for r in got.collect()) == [(2, r, c, -a[r, c]) for r in range(9, 23) for c in range(17, 27)]
    # Row groups whose statistics meet the filters, of all that there are.
    met = total = 0
    for f in glob.glob(f"{tmp_path}/raster/*.parquet"):
        meta = pq.ParquetFile(f).metadata
        for k in range(meta.num_row_groups):
            s = {meta.row_group(k).column(j).path_in_schema: meta.row_group(k).column(j).statistics for j in range(meta.num_columns)}
            total += 1
            met += s["band"].min <= 2 <= s["band"].max and s["brow"].min <= 5 and s["brow"].max >= 2 and s["bcol"].min <= 6 and s["bcol"].max >= 4
    assert total >= 16 and met <= total / 4
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    plan = store.read_blocks(spark, str(tmp_path / "raster"), "a", [2], window, 4)._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "GreaterThanOrEqual(brow" in plan and "GreaterThanOrEqual(morton" in plan and "EqualTo(layer" in plan


def test_morton_order(spark):
    got = spark.range(1).select(*[blockwise.morton(F.lit(r), F.lit(c)).alias(f"m{k}") for k, (r, c) in enumerate(((0, 0), (0, 1), (1, 0), (1, 1), (0, 2), (2**31 - 1, 2**31 - 1)))]).first()
    assert list(got) == [0, 1, 2, 3, 4, 2**62 - 1]


def smooth(x, sigma):
    w = stencil.gaussian_taps(sigma)
    return stencil.filtered(stencil.filtered(x, w[:, None]), w[None, :])


def test_stencils_do_not_depend_on_the_block(spark):
    rng = np.random.default_rng(5)
    a, d = rng.random((37, 29)), rng.random((37, 29))
    cells, dem = cells_of(spark, a), cells_of(spark, d)
    for f, names in (
        (lambda b: stencil.smoothed(cells, 37, 29, 1.5, block=b), ["value"]), (lambda b: stencil.sobel(cells, block=b), ["gx", "gy"]), (lambda b: stencil.aspect(dem, block=b), ["aspect"]),
        (lambda b: stencil.texture(cells, dem, 37, 29, block=b), ["coherence", "angle", "stripes"]),
    ):
        one, two = f(8).cache(), f(64).cache()
        for n in names:
            assert np.allclose(array_of(one, a.shape, n), array_of(two, a.shape, n), equal_nan=True) and not np.isnan(array_of(two, a.shape, n)).any()
    assert np.allclose(array_of(stencil.smoothed(cells, 37, 29, 1.5, block=8), a.shape), smooth(a, 1.5))


def test_missing_cells_have_stand_ins(spark):
    a = np.arange(20, dtype=float).reshape(4, 5) ** 2
    there = np.ones((4, 5), bool)
    there[1, 2] = False
    for block in (2, 64):
        got = {(r.r, r.c): (r.gx, r.gy) for r in stencil.sobel(cells_of(spark, a, there), block=block).collect()}
        assert (1, 2) not in got and len(got) == 19
        # At (1, 1) the cell itself stands in for the one to its right.
        assert got[1, 1][0] == (a[0, 2] + 2 * a[1, 1] + a[2, 2]) - (a[0, 0] + 2 * a[1, 0] + a[2, 0])
        bearing = {(r.r, r.c): r.aspect for r in stencil.aspect(cells_of(spark, a, there), block=block).collect()}
        assert np.isclose(bearing[1, 1], np.arctan2(-(a[2, 1] - a[0, 1]) / 2, -0.0))


def brute_distances(a):
    rs, cs = np.nonzero(a)
    r, c = np.mgrid[: a.shape[0], : a.shape[1]]
    return ((r[..., None] - rs) ** 2 + (c[..., None] - cs) ** 2).min(axis=-1)


@pytest.mark.parametrize(("reach", "block"), [(5, 8), (50, 8), (None, 8), (None, 64), (20, 16)])
def test_distances_against_brute_force(spark, monkeypatch, reach, block):
    monkeypatch.setattr(stencil, "STRIP_CELLS", 400)
    rng = np.random.default_rng(6)
    for share in (0.002, 0.03, 0.9):
        a = rng.random((61, 43)) < share
        a[40, 3] = True
        want = brute_distances(a)
        got = array_of(stencil.distances(cells_of(spark, a, a), 61, 43, reach, block), a.shape, "d2")
        assert np.array_equal(np.nan_to_num(got, nan=-1), np.where(want <= (reach or 1e9) ** 2, want, -1))
    assert stencil.distances(cells_of(spark, a, a & False), 61, 43, reach, block).isEmpty()


def test_proximity_is_the_same_either_way(spark, monkeypatch):
    a = np.random.default_rng(7).random((40, 30)) < 0.02
    near = lambda: sorted(tuple(r) for r in stencil.proximity(cells_of(spark, a, a), 40, 30, 9, 6).collect())
    one = near()
    monkeypatch.setattr(stencil, "NEAR", 0)
    assert near() == one and len(one) > 300


def spiral(n):
    a, r, c, dr, dc = np.zeros((n, n), bool), 0, 0, 0, 1
    a[0, 0] = True
    while True:
        for _ in range(2):
            ahead = (r + 2 * dr, c + 2 * dc)
            if 0 <= r + dr < n and 0 <= c + dc < n and not (0 <= ahead[0] < n and 0 <= ahead[1] < n and a[ahead]) and not a[r + dr, c + dc]:
                r, c = r + dr, c + dc
                a[r, c] = True
                break
            dr, dc = dc, -dr
        else:
            return a


def test_long_shapes_take_few_rounds(spark, monkeypatch):
    snake = np.ones((64, 64), bool)
    for r in range(1, 64, 2):
        snake[r, :] = False
        snake[r, 63 if r % 4 == 1 else 0] = True
    for a in (snake, spiral(64)):
        written = []
        monkeypatch.setattr(components, "new_path", lambda s, name: written.append(name) or new_path(s, name))  # noqa: B023
        got = [tuple(r) for r in stencil.regions(cells_of(spark, a, a), block=8).collect()]
        r, c = np.nonzero(a)
        inner = int((a[1:] & a[:-1]).sum() + (a[:, 1:] & a[:, :-1]).sum())
        assert got == [(0, 0, int(a.sum()), 0, int(r.max()), 0, int(c.max()), int(4 * a.sum() - 2 * inner))]
        assert len(written) <= 8


@pytest.mark.parametrize("seed", [1, 2])
def test_components_of_random_links(spark, seed):
    rng = np.random.default_rng(seed)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 200, (130, 2))] + [(3, 3), (500, 501)]
    label = list(range(600))
    for _ in range(600):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    nodes = {x for a, b in links if a != b for x in (a, b)}
    got = components.components(spark.createDataFrame(links, "a long, b long"))
    assert sorted(tuple(r) for r in got.collect()) == sorted((x, label[x]) for x in nodes)
