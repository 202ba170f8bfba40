import colorsys
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.functions import scalar
from tilewright.operators import losses, qc, raster, registry, runs, sampling, series, stencil, vector
from tilewright.plans import file_queries
from tilewright.sources import documents
from tilewright.sources import trials as trial_source


def cells_of(spark, a):
    return spark.createDataFrame([(r, c, float(a[r, c])) for r in range(a.shape[0]) for c in range(a.shape[1])], "r long, c long, value double")


def array_of(df, shape, value="value"):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r.r, r.c] = r[value]
    return out


# Quality and losses


def test_checks_of_small_tiles(spark):
    rows = [(t, k, *v) for t, v in (("full", (10.0, 20.0, 30.0)), ("empty", (0.0, 0.0, 0.0))) for k in range(100)]
    rows += [("sparse", k, *((9.0, 9.0, 9.0) if k == 0 else (0.0, 5.0, 5.0))) for k in range(100)]
    got = {r.t: r for r in qc.rgb_check(spark.createDataFrame(rows, "t string, k int, b1 double, b2 double, b3 double"), "t", least=0.02).collect()}
    assert (got["full"].coverage_ratio, got["full"].rgb_valid) == (1.0, True) and not got["empty"].rgb_valid
    assert got["sparse"].valid_pixels == 1 and not got["sparse"].rgb_valid
    empty = spark.createDataFrame([], "tile_idx long, status string")
    assert qc.counters(empty).first().valid_pct is None


def test_baselines_against_numpy(spark):
    rng = np.random.default_rng(1)
    v = rng.integers(0, 21, 301).astype(float)
    got = qc.baselines(spark.createDataFrame([(0, float(x)) for x in v], "g int, target double"), ["g"], 5.0).first()
    assert math.isclose(got.std, v.std()) and got.median == np.median(v) and math.isclose(got.mae_median, np.abs(v - np.median(v)).mean())
    assert math.isclose(got.lobe_mae_mean, np.abs(v[v >= 5] - v.mean()).mean()) and got.iou_zero == 0.0
    none = qc.baselines(spark.createDataFrame([(0, 1.0)], "g int, target double"), ["g"], 5.0).first()
    assert none.iou_zero == 1.0 and none.lobe_mean is None


def pairs(spark, seed=0):
    rng = random.Random(seed)
    return spark.createDataFrame([(rng.uniform(0, 20), 10.0 if 4 <= k % 16 < 8 else 0.0) for k in range(256)], "pred double, target double")


def test_loss_rules(spark):
    df = pairs(spark)
    p, t = F.col("pred"), F.col("target")
    names = ["smooth_l1", "weighted_smooth_l1", "dice", "iou", "soft_iou", "encouragement", "focal", "combined", "acl"]
    got = losses.losses_by(df, [], names).first()
    assert all(got[n] >= 0 for n in names) and got["iou"] >= got["dice"] and got["weighted_smooth_l1"] > got["smooth_l1"]
    same = df.select(t.alias("pred"), "target").agg(*[losses.loss_agg(n, p, t).alias(n) for n in names]).first()
    assert all(abs(same[n]) < 1e-6 for n in names if n not in ("soft_iou", "combined")) and got["soft_iou"] > same["soft_iou"]
    total = df.agg(losses.focal(p, t, reduction="sum").alias("s"), losses.focal(p, t).alias("m")).first()
    assert math.isclose(total.s, total.m * 256)
    plain = df.select((p / 20).alias("p"), F.when(t > 0, 1.0).otherwise(0.0).alias("t")).agg(losses.bce_smoothed(F.col("p"), F.col("t")).alias("a"), losses.bce(F.col("p"), F.col("t")).alias("b")).first()
    assert math.isclose(plain.a, plain.b, rel_tol=1e-6)
    for bad in ({"name": None}, {"name": "huber"}, {"name": "bce", "pos_weight": 2.0, "smoothing": 0.1}):
        with pytest.raises(ValueError):
            losses.loss_agg(bad.pop("name"), p, t, **bad)


# Stencils


def test_regions_against_flood_fill(spark):
    rng = np.random.default_rng(4)
    grids = [rng.random((18, 14)) < 0.55, np.zeros((5, 5), bool), np.ones((6, 7), bool)]
    snake = np.ones((15, 15), bool)
    for r in range(1, 15, 2):
        snake[r, :] = False
        snake[r, 14 if r % 4 == 1 else 0] = True
    for a in [*grids, snake]:
        left, want = {(r, c) for r in range(a.shape[0]) for c in range(a.shape[1]) if a[r, c]}, []
        while left:
            todo, seen = [min(left)], {min(left)}
            while todo:
                r, c = todo.pop()
                for q in ((r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)):
                    if q in left and q not in seen:
                        seen.add(q)
                        todo.append(q)
            left -= seen
            rs, cs = [r for r, _ in seen], [c for _, c in seen]
            edges = sum((q not in seen) for r, c in seen for q in ((r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)))
            want.append((*min(seen), len(seen), min(rs), max(rs), min(cs), max(cs), edges))
        valid = spark.createDataFrame([(r, c) for r in range(a.shape[0]) for c in range(a.shape[1]) if a[r, c]], "r long, c long")
        assert sorted(tuple(r) for r in stencil.regions(valid).collect()) == sorted(want)


def smooth(x, sigma):
    w = stencil.gaussian_taps(sigma)
    return stencil.filtered(stencil.filtered(x, w[:, None]), w[None, :])


def stripes_by_definition(gray, dem, smooth_sigma, structure_sigma, power):
    """Coherence and slope stripes of whole arrays, from the definitions."""
    p = np.pad(smooth(gray, smooth_sigma), 1, mode="edge")
    gx = p[:-2, 2:] + 2 * p[1:-1, 2:] + p[2:, 2:] - p[:-2, :-2] - 2 * p[1:-1, :-2] - p[2:, :-2]
    gy = p[2:, :-2] + 2 * p[2:, 1:-1] + p[2:, 2:] - p[:-2, :-2] - 2 * p[:-2, 1:-1] - p[:-2, 2:]
    jxx, jyy, jxy = (smooth(x, structure_sigma) for x in (gx * gx, gy * gy, gx * gy))
    tensor = np.stack([np.stack([jxx, jxy], -1), np.stack([jxy, jyy], -1)], -1)
    low, high = np.moveaxis(np.linalg.eigvalsh(tensor), -1, 0)
    coherence = (high - low) / (high + low + 1e-12)
    return coherence, np.clip(coherence * aligned(np.arctan2(2 * jxy, jxx - jyy + 1e-12) + np.pi / 2, dem) ** power, 0, 1)


def aligned(angle, dem):
    dx, dy = np.zeros_like(dem), np.zeros_like(dem)
    dx[:, 1:-1], dy[1:-1] = (dem[:, 2:] - dem[:, :-2]) / 2, (dem[2:] - dem[:-2]) / 2
    return np.maximum((np.cos(angle - np.arctan2(-dy, -dx)) + 1) / 2, 1e-12)


@pytest.mark.parametrize("power", [1.0, 0.0, 2.5])
def test_texture_against_numpy(spark, power):
    rng = np.random.default_rng(2)
    a, d = rng.random((20, 23)), rng.random((20, 23))
    got = stencil.texture(cells_of(spark, a), cells_of(spark, d), 20, 23, power=power).cache()
    coherence, stripes = stripes_by_definition(a, d, 1.5, 2.0, power)
    assert np.allclose(array_of(got, a.shape, "coherence"), coherence)
    assert np.allclose(array_of(got, a.shape, "stripes"), stripes)


def test_stripes_of_a_turned_raster(spark):
    """Stripes that run down the slope are strong; the same image turned a quarter against the slope is weaker."""
    x = np.arange(32)
    a = np.tile(np.sin(x / 2), (32, 1))  # bright and dark columns
    d = np.tile(x[:, None], (1, 32)).astype(float)  # rises with the row
    turned = raster.turned(F.col("r"), F.col("c"), 32, 1)
    cells, dem = cells_of(spark, a), cells_of(spark, d)
    rot = cells.select(turned[0].alias("r"), turned[1].alias("c"), "value")
    mean = lambda v: array_of(stencil.texture(v, dem, 32, 32), a.shape, "stripes").mean()
    assert np.isclose(mean(cells), stripes_by_definition(a, d, 1.5, 2.0, 1.0)[1].mean())
    assert np.isclose(mean(rot), stripes_by_definition(np.rot90(a), d, 1.5, 2.0, 1.0)[1].mean())


def gabor_by_definition(gray, frequency, sigma, n):
    """Largest magnitude and first orientation that has it, cell by cell, with mirrored edges."""
    h, w = gray.shape
    best, which = np.full(gray.shape, -1.0), np.zeros(gray.shape)
    for k in range(n):
        t = np.pi * k / n
        reach = int(np.ceil(max(3 * sigma * abs(np.cos(t)), 3 * sigma * abs(np.sin(t)), 1)))
        p = np.pad(gray, reach, mode="symmetric")
        total = np.zeros(gray.shape, complex)
        for dy in range(-reach, reach + 1):
            for dx in range(-reach, reach + 1):
                g = np.exp(-(dx * dx + dy * dy) / (2 * sigma**2)) / (2 * np.pi * sigma**2) * np.exp(2j * np.pi * frequency * (dx * np.cos(t) + dy * np.sin(t)))
                total += g * p[reach - dy : reach - dy + h, reach - dx : reach - dx + w]
        size = np.abs(total)
        new = size > best + 1e-12
        which[new], best = t, np.maximum(best, size)
    return best, which


def test_gabor_against_its_definition(spark):
    rng = np.random.default_rng(3)
    rgb, d = rng.integers(0, 256, (3, 30, 27)).astype(float), rng.random((30, 27))
    cells = spark.createDataFrame([(b + 1, r, c, float(rgb[b, r, c])) for b in range(3) for r in range(30) for c in range(27)], "band int, r long, c long, value double")
    strength, theta = gabor_by_definition((0.299 * rgb[0] + 0.587 * rgb[1] + 0.114 * rgb[2]) / 255, 0.15, 2.0, 6)
    options = {"frequency": 0.15, "sigma": 2.0, "orientations": 6}
    whole, cut = (stencil.gabor_stripes(cells, cells_of(spark, d), block, power=1.5, **options).cache() for block in (64, 8))
    want = strength / strength.max() * aligned(theta + np.pi / 2, d) ** 1.5
    for got in (whole, cut):
        assert np.allclose(array_of(got, d.shape, "strength"), strength / strength.max())
        assert np.allclose(array_of(got, d.shape, "angle"), theta + np.pi / 2)
        assert np.allclose(array_of(got, d.shape, "stripes"), want)
    with pytest.raises(ValueError):
        stencil.derived({}, "gabor")
    with pytest.raises(ValueError):
        stencil.derived({"rgb": cells.filter("band < 3")}, "gabor")


def test_proximity_edges(spark):
    none = spark.createDataFrame([], "r long, c long")
    assert stencil.proximity(none, 10, 10, 5, 5).isEmpty()
    got = {(r.r, r.c): r.proximity for r in stencil.proximity(spark.createDataFrame([(0, 0)], "r long, c long"), 10, 10, 5, 3).collect()}
    assert got[0, 0] == 5 and got[0, 3] == 2 and (0, 4) not in got and got[2, 2] == 2 and min(min(k) for k in got) == 0


# Polygons


def test_points_and_masks(spark):
    square = vector.edges_of(spark, {0: [[(1, -1), (5, -1), (5, -5), (1, -5)], [(2, -2), (4, -2), (4, -4), (2, -4)]]})
    cells = {(r.r, r.c) for r in vector.mask(square, 10, 10).collect()}
    assert len(cells) == 12 and (1, 1) in cells and (2, 2) not in cells
    wide = {(r.r, r.c) for r in vector.touched(square, 10, 10).select("r", "c").collect()}
    assert cells < wide
    boxes = spark.createDataFrame([(1, 0.0, -2.0, 2.0, 0.0), (2, 2.5, -3.5, 3.5, -2.5), (3, 9.0, -9.0, 10.0, -8.0), (4, 5.0, -5.0, 6.0, -4.0), (5, None, None, None, None)], "tile_idx long, minx double, miny double, maxx double, maxy double")
    assert sorted(r.tile_idx for r in vector.at_boundary(boxes, square).collect()) == [1, 4, 5]
    assert vector.at_boundary(boxes, square.limit(0)).count() == 5
    part = {r.pid: r.fraction for r in vector.covered_fraction(boxes.withColumnRenamed("tile_idx", "pid"), square).collect()}
    assert math.isclose(part[1], 0.25) and abs(part[2]) < 1e-12 and part[3] == 0 and part[5] is None
    assert not vector.overlapping(square, 10, 10)
    two = square.unionByName(vector.edges_of(spark, {1: [[(0, 0), (3, 0), (3, -3), (0, -3)]]}))
    assert vector.overlapping(two, 10, 10)


@pytest.mark.parametrize("bin_size", [3.0, 16.0, 1_000.0])
def test_boxes_meet_edges_in_any_bins(spark, bin_size):
    draw = random.Random(5)
    at = lambda: draw.randint(-60, 60)
    edges = [(at(), at(), at(), at()) for _ in range(12)] + [(-50, 7, 55, 7), (9, -50, 9, 48), (-60, 31, 60, 32), (4, 4, 4, 4)]
    boxes = [(k, x, y, x + draw.randint(0, 20), y + draw.randint(0, 20)) for k, (x, y) in enumerate((at(), at()) for _ in range(80))]

    def meet(e, b):
        """A segment misses a box just if an axis or the segment's own line parts them; whole numbers, so exact."""
        (x1, y1, x2, y2), (_, left, low, right, top) = e, b
        if max(x1, x2) < left or min(x1, x2) > right or max(y1, y2) < low or min(y1, y2) > top:
            return False
        side = [(x2 - x1) * (y - y1) - (y2 - y1) * (x - x1) for x in (left, right) for y in (low, top)]
        return min(side) <= 0 <= max(side)

    b = spark.createDataFrame([(k, *map(float, r)) for k, *r in boxes], "pid long, minx double, miny double, maxx double, maxy double")
    e = spark.createDataFrame([tuple(map(float, r)) for r in edges], "x1 double, y1 double, x2 double, y2 double")
    want = {b[0] for b in boxes if any(meet(e, b) for e in edges)}
    assert 0 < len(want) < len(boxes) and {r.pid for r in vector.boxes_at_edges(b, e, bin_size).collect()} == want


# Samples


def test_split_and_samples(spark):
    t = spark.range(1_000).select(F.format_string("tile_%04d", "id").alias("tile_id"), F.col("id").alias("tile_idx"))
    s = sampling.split(t, 0.7, 0.15, 0.15)
    assert {r.split: r["count"] for r in s.groupBy("split").count().collect()} == {"train": 700, "val": 150, "test": 150}
    again = sampling.split(t.repartition(9), 0.7, 0.15, 0.15)
    assert sorted(map(tuple, s.select("tile_id", "split").collect())) == sorted(map(tuple, again.select("tile_id", "split").collect()))
    with pytest.raises(ValueError):
        sampling.split(t, 0.7, 0.2, 0.2)
    one, two = ({r.tile_id for r in sampling.epoch_sample(t, 0.1, e).collect()} for e in (1, 2))
    assert len(one) == len(two) == 100 and one != two
    assert sampling.epoch_sample(t, 0.0, 1).count() == 1
    drawn = sampling.drawn_again(t.limit(10), 50, 1)
    assert drawn.count() == 50 and 1 < drawn.distinct().count() <= 10
    ext = {r.role: r["count"] for r in sampling.extended(t.filter("tile_idx < 40"), t.filter("tile_idx >= 990")).groupBy("role").count().collect()}
    assert ext == {"lobe": 40, "background": 10, "augmented_lobe": 40}
    reps = t.filter("tile_idx < 20")
    assert sampling.capped(t, 10, reps).count() == 20 and sampling.capped(t, 30, reps).count() == 30
    lobes = t.filter("tile_idx < 3").withColumn("illumination", F.lit("sun"))
    assert sampling.extended_rotations(lobes, lobes.limit(0), 0.1, 1.0).select("role").distinct().count() == 1


def test_recolouring(spark):
    t = spark.createDataFrame([(k % 2, k // 2, 0, k / 40, 0.5, 1 - k / 40, 7.0) for k in range(40)], "tile_idx long, tr int, tc int, b1 double, b2 double, b3 double, dem double")
    a = raster.recoloured(t, "tile_idx", 0.1, 1.2, 0.9, 1.1, 0.05, 0.05, seed=2)
    b = raster.recoloured(t.repartition(7), "tile_idx", 0.1, 1.2, 0.9, 1.1, 0.05, 0.05, seed=2)
    rows = sorted(tuple(round(x, 9) for x in r) for r in a.collect())
    assert rows == sorted(tuple(round(x, 9) for x in r) for r in b.collect())
    assert all(r.dem == 7.0 and 0 <= min(r.b1, r.b2, r.b3) <= max(r.b1, r.b2, r.b3) <= 1 for r in a.collect())
    assert raster.recoloured(t, "tile_idx", bands=("b1", "b2")) is t


def test_hue_turns_as_in_the_standard_library(spark):
    rng = np.random.default_rng(8)
    rows = [(0, *map(float, x)) for x in [*rng.random((40, 3)), (0.5, 0.5, 0.5), (0, 0, 0), (1, 1, 1), (1, 0, 0), (1, 1, 0)]]
    t = spark.createDataFrame([(0, k, *x[1:]) for k, x in enumerate(rows)], "tile_idx long, k int, b1 double, b2 double, b3 double")
    got = {r.k: (r.b1, r.b2, r.b3) for r in raster.recoloured(t, "tile_idx", hue=0.3).collect()}
    for k, (_, r, g, b) in enumerate(rows):
        h, s, v = colorsys.rgb_to_hsv(r, g, b)
        assert got[k] == pytest.approx(colorsys.hsv_to_rgb((h + 0.3) % 1, s, v), abs=1e-9)


def test_turns_come_full_circle(spark):
    t = spark.range(25).select(F.floor(F.col("id") / 5).alias("r"), F.pmod("id", F.lit(5)).alias("c"))
    r, c = raster.turned(F.col("r"), F.col("c"), 5, 3)
    r, c = raster.turned(r, c, 5, 1)
    assert t.filter((r != F.col("r")) | (c != F.col("c"))).isEmpty()


def test_raster_errors(spark):
    meta = spark.createDataFrame([("a", 4, "t", "x", 4), ("b", 5, "t", "x", 4)], "raster_id string, height int, transform string, crs string, width int")
    cells = spark.createDataFrame([(1, 0, 0, 1.0)], "band int, r long, c long, value double")
    with pytest.raises(ValueError, match="differ"):
        raster.stacked(meta, [("a", cells, 1)])
    with pytest.raises(ValueError):
        raster.crop(cells, 4, 4, 2.0, -2.0, 3, 3)
    layers = spark.createDataFrame([(1, "rgb", 1, True), (2, "dem", 1, True)], "ord int, name string, bands int, enabled boolean")
    tile = spark.createDataFrame([(0, "rgb", 1, 0, 0, 1.0)], "tile_idx long, layer string, band int, r long, c long, value double")
    with pytest.raises(ValueError, match="dem"):
        registry.assembled(tile, layers)
    with pytest.raises(ValueError):
        registry.channels(layers.filter("false"))
    with pytest.raises(ValueError):
        scalar.normalized(F.lit(1.0), "other")


@pytest.mark.parametrize("method", ["nearest", "bilinear", "cubic", "average"])
def test_resampling_keeps_a_constant(spark, method):
    got = raster.resampled(cells_of(spark, np.full((6, 8), 3.5)), (6, 8), (9, 5), method)
    assert np.allclose(array_of(got, (9, 5)), 3.5)
    holes = cells_of(spark, np.where(np.arange(48).reshape(6, 8) % 8 < 4, -1.0, 2.0))
    got = array_of(raster.resampled(holes, (6, 8), (6, 8), method, nodata=-1.0), (6, 8))
    assert np.allclose(got[:, 4:], 2.0) and np.allclose(got[:, :3], 0.0)


# Series and runs


def test_stop_counter_with_delta(spark):
    v = [5.0, 4.9, 4.0, 4.1, 3.95, 3.0, 3.5]
    h = spark.createDataFrame([(1, k, x) for k, x in enumerate(v)] + [(2, 0, 1.0)], "run_id long, step long, value double")
    got = {(r.run_id, r.step): r.counter for r in series.stop_counters(h, min_delta=0.5).collect()}
    assert [got[1, k] for k in range(7)] == [0, 1, 0, 1, 2, 0, 1] and got[2, 0] == 0
    plain = {(r.run_id, r.step): r.counter for r in series.stop_counters(h).collect()}
    assert [plain[1, k] for k in range(7)] == [0, 0, 0, 1, 0, 0, 1]
    stops = {r.run_id: r.stop_step for r in series.stop_steps(series.stop_counters(h, min_delta=0.5), 2).collect()}
    assert stops == {1: 4, 2: None}
    assert all(r.stop_step is None for r in series.stop_steps(series.stop_counters(h), None).collect())


def test_trial_rules(spark):
    t = spark.createDataFrame([("s", 1, "COMPLETE", "0.5", "a"), ("s", 2, "COMPLETE", "0.3", "a"), ("s", 3, "FAIL", "0.1", "a"), ("s", 4, "COMPLETE", "n/a", "b"), ("s", 5, "COMPLETE", "", "b")], "study string, trial_number long, state string, value string, session_id string")
    best = runs.best_trials(t, ["study"]).first()
    assert (best.trial_number, best.value) == (2, 0.3)
    assert runs.best_trials(t.filter("trial_number = 3"), ["study"]).isEmpty()
    only = runs.best_trials(t.filter("trial_number > 3"), ["study"]).first()
    assert only.value == math.inf and only.trial_number == 4


# Files


def test_tile_lists_and_registries(spark, tmp_path):
    (tmp_path / "list.json").write_text(json.dumps({"filter_config": {"min_rgb_coverage": 0.01}, "tile_size": None, "stats": {"total_tiles": 2}, "tiles": [
        {"tile_id": "tile_0000", "rgb_valid": True, "has_targets": False, "rgb_stats": {"valid_pixels": 5, "total_pixels": 10, "coverage_ratio": 0.5}},
        {"tile_id": "tile_0001", "rgb_valid": False, "has_targets": True, "illumination": "sun"},
    ]}))
    tiles = documents.read_filtered_tiles(spark, str(tmp_path / "list.json"))
    rows = {r.tile_id: r for r in tiles.collect()}
    assert rows["tile_0000"].rgb_stats.coverage_ratio == 0.5 and rows["tile_0001"].illumination == "sun" and rows["tile_0000"].target_stats is None
    counts = spark.createDataFrame([(2, 1)], "total_tiles long, valid_tiles long")
    documents.write_filtered_tiles(tiles, counts, str(tmp_path / "out"), {"min_rgb_coverage": 0.01}, 256)
    back = documents.read_filtered_tiles(spark, str(tmp_path / "out"))
    assert back.columns == tiles.columns and sorted(map(repr, back.collect())) == sorted(map(repr, tiles.collect()))
    head = documents.read_list_header(spark, str(tmp_path / "out")).first()
    assert (head.filter_config.min_rgb_coverage, head.tile_size, head.stats.total_tiles, head.stats.rgb_invalid) == (0.01, 256, 2, None)
    (tmp_path / "registry.json").write_text(json.dumps({"metadata": {"tile_size": 256}, "tiles": {"tile_0007": {"tile_id": "tile_0007", "tile_idx": 7, "geographic_bounds": {"minx": 1.0}, "filtering": {"is_valid": True}, "model_metrics": {"r1": {"mae": 0.5}}}}}))
    reg = documents.read_registry(spark, str(tmp_path / "registry.json"))
    assert reg.first().model_metrics["r1"].mae == 0.5 and reg.first().split is None
    documents.write_registry(reg, str(tmp_path / "reg"), {"tile_size": 256})
    assert documents.read_registry(spark, str(tmp_path / "reg")).collect() == reg.collect()
    written = json.loads(next((tmp_path / "reg").rglob("part-*.json")).read_text())
    assert written["metadata"]["tile_size"] == 256 and list(written["tiles"]) == ["tile_0007"]
    (tmp_path / "ext.json").write_text(json.dumps({"config": {"seed": "1"}, "stats": {"lobe": 1}, "tiles": [{"tile_id": "a", "role": "lobe"}, {"tile_id": "a", "role": "augmented_lobe", "augment": True}]}))
    ext = documents.read_extended_tiles(spark, str(tmp_path / "ext.json"))
    assert [r.augment for r in ext.collect()] == [None, True]
    documents.write_extended_tiles(ext, str(tmp_path / "ext"), {"seed": "1"}, {"lobe": 1})
    assert sorted(map(repr, documents.read_extended_tiles(spark, str(tmp_path / "ext")).collect())) == sorted(map(repr, ext.collect()))


def test_geojson(spark, tmp_path):
    square = [[[0, 0], [4, 0], [4, -4], [0, -4], [0, 0]]]
    (tmp_path / "p.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [
        {"type": "Feature", "properties": {"kind": "sun"}, "geometry": {"type": "Polygon", "coordinates": square}},
        {"type": "Feature", "properties": {}, "geometry": {"type": "MultiPolygon", "coordinates": [square, square]}},
    ]}))
    e = documents.read_polygon_edges(spark, str(tmp_path / "p.geojson"))
    assert e.count() == 12 and e.filter("poly_id = 0").first().attrs == {"kind": "sun"}
    assert vector.mask(e.filter("poly_id = 0"), 10, 10).count() == 16
    # Polygons are numbered over all files, files without features included.
    (tmp_path / "many").mkdir()
    for k, features in enumerate(([square, square], [], [[square[0], [[1, -1], [1, -2], [2, -2], [1, -1]]]], [square])):
        (tmp_path / "many" / f"{k}.geojson").write_text(json.dumps({"features": [{"type": "Feature", "properties": {"file": str(k)}, "geometry": {"type": "Polygon", "coordinates": r}} for r in features]}))
    many = documents.read_polygon_edges(spark, str(tmp_path / "many"))
    assert sorted((r.poly_id, r.ring_id, r.f, r.n) for r in many.groupBy("poly_id", "ring_id", many.attrs["file"].alias("f")).agg(F.count("*").alias("n")).collect()) == [(0, 0, "0", 4), (1, 0, "0", 4), (2, 0, "2", 4), (2, 1, "2", 3), (3, 0, "3", 4)]
    assert many.filter("abs(x2 - x1) + abs(y2 - y1) > 4").isEmpty()
    (tmp_path / "none.geojson").write_text('{"features": []}')
    assert documents.read_polygon_edges(spark, str(tmp_path / "none.geojson")).isEmpty()
    with pytest.raises(ValueError):
        documents.read_polygon_edges(spark, str(tmp_path / "none.geojson"), required=True)
    tiles = spark.createDataFrame([(1, 0.0, -1.0, 1.0, 0.0)], "tile_idx long, minx double, miny double, maxx double, maxy double")
    documents.write_tile_index(tiles, ["tile_idx"], str(tmp_path / "index"))
    line = json.loads(spark.read.text(str(tmp_path / "index")).first().value)
    assert line["properties"] == {"tile_idx": 1} and len(line["geometry"]["coordinates"][0]) == 5


@pytest.mark.parametrize("query", ["a9_metric_files", "a10_run_params", "a13_manifest"])
def test_files_of_runs_are_few(spark, tmp_path, monkeypatch, query):
    monkeypatch.setattr(file_queries, "new_path", lambda _, name: str(tmp_path / name))
    assert getattr(file_queries, query)(spark, "/root/testdata/sf0.001").count() >= 20
    assert 1 <= len(list(tmp_path.rglob("part-*"))) <= 8


def test_archives_of_run_files(spark, tmp_path):
    files = [("/runs/r1/metrics/loss", "100 0.5 0\n\n200 0.4 1\r\nbroken line\n300 0.3\n"), ("/runs/r1/params/lr", " 0.01 \n"), ("/runs/r2/params/note", "\ta\nb\n"), ("/runs/r2/params/none", " ")]
    documents.write_archive(spark.createDataFrame(files, "file string, value string"), str(tmp_path / "a"))
    for file, text in files:
        (tmp_path / file[1:]).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / file[1:]).write_bytes(text.encode())
    for read in (documents.read_metric_history, documents.read_run_params):
        got = sorted(tuple(r) for r in read(spark, str(tmp_path / "a"), archive=True).collect())
        assert got == sorted(tuple(r) for r in read(spark, str(tmp_path / "runs")).collect()) and len(got) >= 2
    documents.write_manifests(spark.createDataFrame([(7, "loss", 1, 0.25), (7, "loss", 0, 0.5), (8, "mae", 0, float("nan"))], "run_id long, metric string, step long, value double"), str(tmp_path / "m"))
    assert sorted(map(repr, map(tuple, documents.read_manifest(spark, str(tmp_path / "m"), archive=True).collect()))) == ["('7', 'loss', 0, 0.5)", "('7', 'loss', 1, 0.25)", "('8', 'mae', 0, nan)"]


def test_run_files(spark, tmp_path):
    run = tmp_path / "runs" / "r1"
    (run / "metrics").mkdir(parents=True)
    (run / "params").mkdir()
    (run / "metrics" / "loss").write_text("100 0.5 0\n\n200 0.4 1\nbroken line\n300 0.3\n")
    (run / "params" / "lr").write_text(" 0.01 \n")
    rows = [tuple(r) for r in documents.read_metric_history(spark, str(tmp_path / "runs")).orderBy("step").collect()]
    assert rows == [("r1", "loss", 100, 0.5, 0), ("r1", "loss", 200, 0.4, 1)]
    assert [tuple(r) for r in documents.read_run_params(spark, str(tmp_path / "runs")).collect()] == [("r1", "lr", "0.01")]
    (tmp_path / "m.json").write_text('{"metrics_history": {"val_loss": [0.5, 0.25], "mae": [1.0]}}')
    assert documents.read_manifest(spark, str(tmp_path / "m.json")).count() == 3
    (tmp_path / "t.csv").write_text("trial_number,value\n1,0.5\n2,\n")
    t = trial_source.read_trials(spark, str(tmp_path / "t.csv"), ["trial_number", "value"])
    assert [r.value for r in t.orderBy("trial_number").collect()] == ["0.5", None]
    assert trial_source.read_trials(spark, str(tmp_path / "absent.csv"), ["trial_number"]).isEmpty()
    documents.append_history(t, str(tmp_path / "h"))
    documents.append_history(t, str(tmp_path / "h"))
    assert spark.read.parquet(str(tmp_path / "h")).count() == 4
    cells = spark.createDataFrame([("a", 1, 0, 0, 1.0), ("b", 1, 0, 0, 2.0), ("a", 2, 0, 0, 3.0)], "raster_id string, band int, r long, c long, value double")
    cells.write.partitionBy("raster_id", "band").parquet(str(tmp_path / "cells"))
    assert documents.read_cells(spark, str(tmp_path / "cells"), "a", [2]).first().value == 3.0
