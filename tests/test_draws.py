"""Counter-based draws, augmentation step by step, quantile sketches, exactly-once appends and long folds."""

import colorsys
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.functions import draws
from tilewright.operators import quantiles, raster, series
from tilewright.sources import ledger


def test_moments_and_independence(spark):
    d = spark.range(100_000).repartition(7).select("id", draws.uniform("a", 1, "id").alias("a"), draws.uniform("b", 1, "id").alias("b"), draws.uniform("a", 2, "id").alias("c"), draws.normal("a", 1, "id").alias("n"), draws.normal("b", 1, "id").alias("m"))
    x = d.toPandas().sort_values("id")
    for n in "abc":
        assert abs(x[n].mean() - 0.5) < 0.005 and abs(x[n].std() - 12**-0.5) < 0.005 and 0 <= x[n].min() and x[n].max() < 1
    assert abs(x["n"].mean()) < 0.02 and abs(x["n"].std() - 1) < 0.02 and abs((x["n"] ** 3).mean()) < 0.1 and abs((x["n"] ** 4).mean() - 3) < 0.2
    pairs = np.corrcoef(x[["a", "b", "c", "n", "m"]].T) - np.eye(5)
    # a and n share no counter: purposes differ.
    assert np.abs(pairs).max() < 0.015
    assert abs(np.corrcoef(x["a"][1:], x["a"][:-1])[0, 1]) < 0.015 and abs(np.corrcoef(x["n"][1:], x["n"][:-1])[0, 1]) < 0.015
    again = spark.range(100_000).repartition(3, "id").select("id", draws.normal("a", 1, "id").alias("n")).toPandas().sort_values("id")
    assert np.array_equal(again["n"], x["n"])


def recoloured_by_steps(rgb, hue, saturation, contrast, gamma, brightness, contrast_first=False):
    """bands x cells of one tile, step by step, each clamped."""
    clamp = lambda x: np.clip(x, 0, 1)
    if hue:
        out = []
        for p in rgb.T:
            h, s, v = colorsys.rgb_to_hsv(*p)
            out.append(colorsys.hsv_to_rgb((h + hue) % 1, s, v))
        rgb = np.array(out).T
    gray = lambda x: 0.2989 * x[0] + 0.587 * x[1] + 0.114 * x[2]
    steps = [lambda x: clamp(saturation * x + (1 - saturation) * gray(x)), lambda x: clamp(contrast * x + (1 - contrast) * gray(x).mean())]
    for f in steps[::-1] if contrast_first else steps:
        rgb = f(rgb)
    return clamp(clamp(rgb**gamma) + brightness)


@pytest.mark.parametrize("contrast_first", [False, True])
def test_recolouring_step_by_step(spark, contrast_first):
    rng = np.random.default_rng(1)
    a = rng.random((2, 3, 60))
    t = spark.createDataFrame([(k, c, 0, *map(float, a[k, :, c]), 7.0) for k in range(2) for c in range(60)], "tile_idx long, tr int, tc int, b1 double, b2 double, b3 double, dem double")
    got = raster.recoloured(t, "tile_idx", brightness=0.1, contrast=1.28, saturation=1.28, gamma=0.8, hue=-0.03, contrast_first=contrast_first)
    for r in got.collect():
        want = recoloured_by_steps(a[r.tile_idx], -0.03, 1.28, 1.28, 0.8, 0.1, contrast_first)[:, r.tr]
        assert (r.b1, r.b2, r.b3) == pytest.approx(tuple(want), abs=1e-9) and r.dem == 7.0


def tiles(spark, n=40, size=6):
    rng = np.random.default_rng(2)
    rows = [(t, r, c, *map(float, rng.random(3)), float(rng.random()), int(rng.integers(0, 2)), t % 2 == 0) for t in range(n) for r in range(size) for c in range(size)]
    return spark.createDataFrame(rows, "tile_idx long, tr int, tc int, b1 double, b2 double, b3 double, dem double, target int, augment boolean")


def arrays(df, names, n=40, size=6):
    out = np.full((n, len(names), size, size), np.nan)
    for r in df.collect():
        out[r.tile_idx, :, r.tr, r.tc] = [r[x] for x in names]
    return out


def test_features_and_targets_turn_and_flip_alike(spark):
    t = tiles(spark)
    before, seen = arrays(t, ("dem", "target")), set()
    after = arrays(raster.augmented(t, "tile_idx", 6, "train", 5), ("dem", "target"))
    for k in range(40):
        ways = [(q, h, v) for q in range(4) for h in (0, 1) for v in (0, 1)]
        fits = []
        for q, h, v in ways:
            x = np.rot90(before[k], q, axes=(1, 2))
            x = x[:, :, ::-1] if h else x
            x = x[:, ::-1] if v else x
            if np.array_equal(x, after[k]):
                fits.append((q, h, v))
        assert fits
        seen.add(frozenset(fits))
    assert len(seen) >= 7  # of the eight images of a square


def test_policies_and_switches(spark):
    t = tiles(spark)
    names = ("b1", "b2", "b3", "dem")
    before = arrays(t, names)
    lobe = arrays(raster.augmented(t, "tile_idx", 6, "lobe", 5), names)
    assert np.array_equal(lobe[1::2], before[1::2]) and not any(np.array_equal(lobe[k], before[k]) for k in range(0, 40, 2))
    assert np.nanmin(lobe) >= 0 and np.nanmax(lobe) <= 1
    still = arrays(raster.augmented(t, "tile_idx", 6, "train", 5, raster.Augmentation(geometric=False, color=False)), names)
    assert np.array_equal(still, before)
    turned = arrays(raster.augmented(t, "tile_idx", 6, "train", 5, raster.Augmentation(color=False)), names)
    assert np.allclose(np.sort(turned.reshape(40, 4, -1)), np.sort(before.reshape(40, 4, -1)))
    colour = arrays(raster.augmented(t, "tile_idx", 6, "train", 5, raster.Augmentation(geometric=False)), names)
    assert np.array_equal(colour[:, 3], before[:, 3]) and not np.array_equal(colour[:, :3], before[:, :3])
    one, two = (raster.augmented(t.repartition(n), "tile_idx", 6, "train", 5) for n in (2, 9))
    assert np.allclose(arrays(one, names), arrays(two, names), atol=1e-12)
    assert not np.allclose(arrays(raster.augmented(t, "tile_idx", 6, "train", 6), names), arrays(one, names))
    two_bands = raster.augmented(t, "tile_idx", 6, "train", 5, bands=("b1", "b2"))
    assert np.allclose(np.sort(arrays(two_bands, names).reshape(40, 4, -1)), np.sort(before.reshape(40, 4, -1)))
    with pytest.raises(ValueError):
        raster.augmented(t, "tile_idx", 6, "never", 5)


def test_written_copies(spark):
    t = tiles(spark, 6).withColumns({b: F.floor(255 * F.col(b)).cast("double") for b in ("b1", "b2", "b3")})
    rgb = arrays(t, ("b1", "b2", "b3"), 6)
    got = raster.extended_copies(t, "tile_idx", 6, 3).cache()
    drawn = {r.tile_idx: (r.c, r.s) for r in t.select("tile_idx", draws.between(0.8, 1.2, "copy contrast", 3, "tile_idx").alias("c"), draws.between(0.8, 1.2, "copy saturation", 3, "tile_idx").alias("s")).distinct().collect()}
    assert len({x for x in drawn.values()}) == 6 and all(0.8 <= v < 1.2 for x in drawn.values() for v in x)
    for turn in range(4):
        out = arrays(got.filter(F.col("turn") == turn), ("b1", "b2", "b3", "target"), 6)
        want = arrays(t, ("target",), 6)
        for k in range(6):
            assert np.array_equal(out[k, 3], np.rot90(want[k, 0], turn))
            colour = recoloured_by_steps(rgb[k].reshape(3, -1) / 255, 0, drawn[k][1], drawn[k][0], 1.0, 0.0, True).reshape(3, 6, 6)
            assert np.array_equal(out[k, :3], np.rot90(np.floor(np.round(255 * colour, 9)), turn, axes=(1, 2)))


def test_exact_quantiles(spark):
    rng = np.random.default_rng(3)
    groups = {"normal": rng.normal(size=20_000), "tied": rng.integers(0, 3, 20_000).astype(float), "one": np.array([4.0]), "two": np.array([1.0, 2.0]), None: np.arange(1_000.0)}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("one", None), ("empty", None)]
    df = spark.createDataFrame(rows, "g string, value double").repartition(5)
    shares = {"low": 0.05, "mid": 0.5, "top": 0.999, "min": 0.0, "max": 1.0}
    got = {r.g: r for r in quantiles.exact(df, ["g"], shares).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        for n, p in shares.items():
            assert got[g][n] == pytest.approx(np.quantile(vs, p), abs=1e-12)
    every = np.concatenate(list(groups.values()))
    assert quantiles.exact(df, [], {"mid": 0.5}).first().mid == pytest.approx(np.quantile(every, 0.5))
    assert quantiles.exact(df.limit(0), [], {"mid": 0.5}).isEmpty()


def test_exact_quantiles_of_counts(spark):
    rng = np.random.default_rng(9)
    for vs in (rng.normal(size=5_001), rng.integers(0, 4, 3_000).astype(float), np.array([7.0]), np.array([1.0, 2.0])):
        counts = spark.createDataFrame([(float(v),) for v in vs] + [(None,)], "v double").groupBy("v").agg(F.count("*").alias("n"))
        shares = {"low": 0.05, "mid": 0.5, "top": 0.999, "min": 0.0, "max": 1.0}
        r = quantiles.exact_of_counts(counts, shares).first()
        assert all(r[n] == pytest.approx(np.quantile(vs, p), abs=1e-12) for n, p in shares.items())
    assert quantiles.exact_of_counts(counts.limit(0), {"mid": 0.5}).isEmpty()


def test_exact_quantiles_when_the_sketch_is_off(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "BRACKET", 0.0)
    monkeypatch.setattr(quantiles, "K", 8)
    vs = np.random.default_rng(4).normal(size=5_000)
    df = spark.createDataFrame([(k % 2, float(v)) for k, v in enumerate(vs)], "g long, value double")
    got = {r.g: r.q for r in quantiles.exact(df, ["g"], {"q": 0.37}).collect()}
    assert got == pytest.approx({g: np.quantile(vs[g::2], 0.37) for g in (0, 1)})


def test_merged_sketches_keep_their_rank_error(spark):
    vs = np.random.default_rng(5).exponential(size=60_000)
    df = spark.createDataFrame([(k % 300, float(v)) for k, v in enumerate(vs)], "tile long, value double")
    stored = quantiles.sketches(df, ["tile"])
    shares = {f"q{k}": k / 10 for k in range(1, 10)}
    r = quantiles.estimated(quantiles.merged(stored.withColumn("part", F.lit(0)), ["part"]), shares).first()
    order = np.sort(vs)
    assert r.n == 60_000 and all(abs(np.searchsorted(order, r[n]) / 60_000 - p) <= quantiles.RANK_ERROR for n, p in shares.items())


SCHEMA = "k long, v string"


def test_a_batch_counts_once_whatever_fails(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "table")
    rows = lambda a, b: spark.range(a, b).select(F.col("id").alias("k"), F.lit("x").alias("v"))
    keys = lambda: sorted(r.k for r in ledger.read_table(spark, path, SCHEMA).collect())
    assert keys() == []
    assert ledger.append_batch(rows(0, 5), path, "b0") and not ledger.append_batch(rows(0, 5), path, "b0")

    def lost(*_):
        raise RuntimeError("lost between data and ledger")

    with monkeypatch.context() as m:
        m.setattr(ledger, "_enter", lost)
        with pytest.raises(RuntimeError):
            ledger.append_batch(rows(5, 9), path, "b1")
    assert keys() == [0, 1, 2, 3, 4]
    assert ledger.append_batch(rows(5, 9), path, "b1") and keys() == list(range(9))
    # Two attempts of one batch that overlapped, both entered: one counts.
    spark.range(20, 22).select(F.col("id").alias("k"), F.lit("y").alias("v")).write.parquet(f"{path}/data/zzz")
    ledger._enter(spark, path, "b1", "data/zzz", [], 2)
    assert keys() == list(range(9))
    with monkeypatch.context() as m:
        m.setattr(ledger, "_enter", lost)
        with pytest.raises(RuntimeError):
            ledger.compact(spark, path, SCHEMA)
    assert keys() == list(range(9))
    assert ledger.compact(spark, path, SCHEMA) == 2 and keys() == list(range(9))
    assert not ledger.append_batch(rows(0, 5), path, "b0") and not ledger.append_batch(rows(5, 9), path, "b1")
    assert ledger.visible(spark, path).count() == 1 and ledger.compact(spark, path, SCHEMA) == 0


def test_a_stream_that_fails_and_goes_on(spark, tmp_path, monkeypatch):
    src, path = str(tmp_path / "src"), str(tmp_path / "table")
    for k in range(4):
        spark.range(10 * k, 10 * k + 10).select(F.col("id").alias("k"), F.lit("x").alias("v")).coalesce(1).write.mode("append").parquet(src)
    go = lambda: ledger.append_stream(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src), path, str(tmp_path / "checkpoint"))
    real, left = ledger._enter, [2]

    def sometimes(*a):
        left[0] -= 1
        if left[0] == 0:
            raise RuntimeError("lost")
        real(*a)

    monkeypatch.setattr(ledger, "_enter", sometimes)
    with pytest.raises(Exception, match="lost"):
        go()
    go()
    assert sorted(r.k for r in ledger.read_table(spark, path, SCHEMA).collect()) == list(range(40))


def test_a_million_steps_of_one_run(spark):
    h = spark.range(1_000_000).select(F.lit(1).cast("long").alias("run_id"), F.col("id").alias("step"), (100 - F.col("id") / 1e5 + draws.uniform("v", 1, "id")).alias("value"))
    began = time.perf_counter()
    r = series.stop_counters(h, min_delta=0.05).agg(F.count("*").alias("n"), F.max("counter").alias("top"), F.count_if(F.col("counter") == 0).alias("better")).first()
    assert time.perf_counter() - began < 30 and r.n == 1_000_000 and r.better > 50 and r.top > 1_000


def test_fold_with_ties_nulls_and_many_batches(spark):
    rng = np.random.default_rng(6)
    rows = [(run, k, None if rng.random() < 0.05 else float("nan") if rng.random() < 0.05 else float(rng.integers(0, 40))) for run in range(5) for k in range(700)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    got = {(r.run_id, r.step): r.counter for r in series.stop_counters(spark.createDataFrame(rows, "run_id long, step long, value double"), min_delta=1.5).collect()}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for run in range(5):
        best, counter = None, -1
        for _, k, v in (r for r in rows if r[0] == run):
            if best is None or (v is not None and v == v and (best != best or v < best - 1.5)):
                best, counter = v, 0
            else:
                counter += 1
            assert got[run, k] == counter
