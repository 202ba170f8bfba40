"""Queries over tiles: grid, joins with cells, quality, baselines, metrics and losses."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tilewright.functions import scalar
from tilewright.operators import grid as g
from tilewright.operators import losses, qc, quantiles, stencil
from tilewright.plans import fixtures as fx
from tilewright.registry import register

R = lambda e, n=6: F.round(e, n)


def rounded(df, *names, n=6):
    return df.withColumns({c: F.round(F.col(c).cast("double"), n) for c in names})


@register("t1_stride", "SELECT CAST(floor(s.size * 0.7) AS BIGINT) AS stride, s.size AS size FROM (SELECT DISTINCT p_size AS size FROM part WHERE p_size >= 2) s")
def t1_stride(spark, sf):
    sizes = fx.table(spark, sf, "part").select(F.col("p_size").alias("size")).filter("size >= 2").distinct()
    return sizes.select(F.floor(F.col("size") * F.lit(0.7)).cast("long").alias("stride"), "size")


@register("t2_tile_grid", fx.ALL + " SELECT tile_idx, row_start, row_end, col_start, col_end FROM tiles")
def t2_tile_grid(spark, sf):
    return g.tiles(spark, fx.grid(spark, sf)).drop("tile_id")


@register("t3_tile_ids", fx.ALL + " SELECT tile_idx, printf('tile_%04d', tile_idx) AS tile_id FROM tiles")
def t3_tile_ids(spark, sf):
    return g.tiles(spark, fx.grid(spark, sf)).select("tile_idx", "tile_id")


@register("t4_bounds_edge", fx.ALL + " SELECT tile_idx, CAST(col_start AS DOUBLE) AS minx, CAST(-row_end AS DOUBLE) AS miny, CAST(col_end AS DOUBLE) AS maxx, CAST(-row_start AS DOUBLE) AS maxy FROM tiles")
def t4_bounds_edge(spark, sf):
    return g.bounds(g.tiles(spark, fx.grid(spark, sf))).select("tile_idx", "minx", "miny", "maxx", "maxy")


@register("t4_bounds_center", fx.ALL + " SELECT tile_idx, col_start + 0.5::DOUBLE AS minx, -(row_end + 0.5::DOUBLE) AS miny, col_end + 0.5::DOUBLE AS maxx, -(row_start + 0.5::DOUBLE) AS maxy FROM tiles")
def t4_bounds_center(spark, sf):
    return g.bounds(g.tiles(spark, fx.grid(spark, sf)), mode="center").select("tile_idx", "minx", "miny", "maxx", "maxy")


@register("t5_blocks", fx.ALL + """ SELECT CAST(b.br AS BIGINT) AS brow, CAST(d.bc AS BIGINT) AS bcol, count(*) AS cells, count(*) FILTER (e.r // 48 = b.br AND e.c // 48 = d.bc) AS own_cells
FROM emb e, (SELECT unnest(range(0, (SELECT (h - 1 + 3) // 48 + 1 FROM len))) AS br) b, (SELECT unnest(range(0, 2)) AS bc) d
WHERE e.r >= b.br * 48 - 3 AND e.r < b.br * 48 + 51 AND e.c >= d.bc * 48 - 3 AND e.c < d.bc * 48 + 51 GROUP BY 1, 2""")
def t5_blocks(spark, sf):
    return g.blocks(fx.emb(spark, sf), 48, 3).groupBy("brow", "bcol").agg(F.count("*").alias("cells"), F.count_if("own").alias("own_cells"))


@register("j1_cells_in_tiles", fx.TILED + " SELECT tile_idx, count(*) AS cells, round(sum(x), 6) AS sum_x, CAST(sum(b1) AS BIGINT) AS sum_b1 FROM tw GROUP BY 1")
def j1_cells_in_tiles(spark, sf):
    return fx.tiled(fx.wide(spark, sf), spark, sf).groupBy("tile_idx").agg(F.count("*").alias("cells"), R(F.sum("x")).alias("sum_x"), F.sum("b1").cast("long").alias("sum_b1"))


@register("b1_binary_mask", fx.ALL + " SELECT c, count(*) FILTER (target = 5) AS ones FROM tgt GROUP BY 1")
def b1_binary_mask(spark, sf):
    return fx.target(spark, sf).select("c", qc.binary_mask(F.col("target"), 5).alias("m")).groupBy("c").agg(F.sum("m").alias("ones"))


@register("b2_valid_mask", fx.ALL + " SELECT r, count(*) FILTER (NOT (b1 >= 250 AND b2 >= 250 AND b3 >= 250) AND b1 <> 0 AND b2 <> 0 AND b3 <> 0) AS valid FROM wide GROUP BY 1")
def b2_valid_mask(spark, sf):
    pivoted = qc.pivot_bands(fx.cells(spark, sf))
    return pivoted.groupBy("r").agg(F.count_if(qc.valid_mask(250, 0.0)).alias("valid"))


@register("b10_binary_target", fx.ALL + " SELECT r, count(*) FILTER (target >= 3) AS positives FROM tgt GROUP BY 1")
def b10_binary_target(spark, sf):
    return fx.target(spark, sf).groupBy("r").agg(F.sum((F.col("target") >= 3).cast("long")).alias("positives"))


@register("x1_proximity", fx.CELLS + """, ones AS (SELECT r, c FROM emb WHERE x > 0.30 AND r >= 100), step AS (SELECT CAST(unnest(range(-5, 6)) AS BIGINT) AS d),
near AS (SELECT o.r + a.d AS r, o.c + b.d AS c, a.d * a.d + b.d * b.d AS d2 FROM ones o, step a, step b)
SELECT r, c, CAST(floor(5.0 - sqrt(min(d2))) AS BIGINT) AS proximity FROM near WHERE d2 <= 16 AND c BETWEEN 0 AND 63 AND r BETWEEN 0 AND (SELECT max(vec_id) FROM embeddings) GROUP BY 1, 2""")
def x1_proximity(spark, sf):
    near = stencil.proximity(fx.mask(spark, sf).filter("value = 1").select("r", "c"), fx.height(spark, sf), fx.WIDTH, 5, 5)
    return near.filter("proximity > 0")


@register("x1_distance_map", fx.CELLS + ", ones AS (SELECT r, c FROM emb WHERE x > 0.30 AND r >= 100) SELECT e.r, e.c, min((e.r - o.r) * (e.r - o.r) + (e.c - o.c) * (e.c - o.c)) AS d2 FROM emb e, ones o GROUP BY 1, 2")
def x1_distance_map(spark, sf):
    """Every cell's squared distance to the nearest positive, however far."""
    return stencil.distances(fx.mask(spark, sf).filter("value = 1").select("r", "c"), fx.height(spark, sf), fx.WIDTH)


@register("c8_decay", fx.ALL + " SELECT c, CAST(sum(CASE WHEN abs(x) * 20 <= 5 THEN floor(greatest(0, 7 - abs(x) * 20)) ELSE 0 END) AS BIGINT) AS total FROM emb GROUP BY 1")
def c8_decay(spark, sf):
    return fx.emb(spark, sf).groupBy("c").agg(F.sum(scalar.decay(F.abs("x") * 20, 7, 5)).alias("total"))


G1 = "g1 AS (SELECT tile_idx, count(*) FILTER (b1 <> 0 AND b2 <> 0 AND b3 <> 0) AS valid_pixels, count(*) AS total_pixels FROM tw GROUP BY 1)"
G2 = "g2 AS (SELECT tile_idx, count(*) FILTER (target > 0) AS positive_pixels, count(*) AS total_pixels, max(target) AS max_value FROM tt GROUP BY 1)"
#: Valid from a share of cells at which the fixture has tiles on both sides.
LEAST_RGB = 0.25


@register("g1_rgb_check", fx.TILED + f", {G1} SELECT *, round(valid_pixels / total_pixels, 6) AS coverage_ratio, valid_pixels / total_pixels >= 0.25 AS rgb_valid FROM g1")
def g1_rgb_check(spark, sf):
    return rounded(qc.rgb_check(fx.tiled(fx.wide(spark, sf), spark, sf), least=LEAST_RGB), "coverage_ratio")


@register("g2_target_check", fx.TILED + f", {G2} SELECT *, round(positive_pixels / total_pixels, 6) AS coverage_ratio, positive_pixels > 0 AS has_targets FROM g2")
def g2_target_check(spark, sf):
    return rounded(qc.target_check(fx.tiled(fx.target(spark, sf), spark, sf)), "coverage_ratio")


def baseline_sql(source: str, by: str, t: float, empty: float) -> str:
    k = f"{by}, " if by else ""
    on = f"USING ({by})" if by else "ON true"
    group = f"GROUP BY {by}" if by else ""
    return f"""m AS (SELECT {k}avg(target) AS mean, median(target) AS median FROM {source} {group}),
bl AS (SELECT {k}count(*) AS total_pixels, any_value(m.mean) AS mean, any_value(m.median) AS median, stddev_pop(target) AS std, min(target) AS min, max(target) AS max,
 count(*) FILTER (target >= {t}) AS lobe_pixels, count(*) FILTER (target < {t}) AS background_pixels, count(*) FILTER (target >= {t}) / count(*) AS lobe_fraction,
 avg(abs(target)) AS mae_zero, avg(abs(target - m.mean)) AS mae_mean, avg(abs(target - m.median)) AS mae_median, sqrt(avg(target * target)) AS rmse_zero, stddev_pop(target) AS rmse_mean,
 CASE WHEN count(*) FILTER (target >= {t}) = 0 THEN {empty} ELSE 0.0 END AS iou_zero,
 avg(target) FILTER (target >= {t}) AS lobe_mean, avg(abs(target)) FILTER (target >= {t}) AS lobe_mae_zero, avg(abs(target - m.mean)) FILTER (target >= {t}) AS lobe_mae_mean,
 avg(abs(target)) FILTER (target < {t}) AS background_mae_zero FROM {source} JOIN m {on} {group}),
bq AS (SELECT *, lobe_fraction * coalesce(lobe_mae_zero, 0) + (1 - lobe_fraction) * coalesce(background_mae_zero, 0) AS mae_weighted FROM bl)"""


BASE_FLOATS = ("mean", "std", "lobe_fraction", "mae_zero", "mae_mean", "mae_median", "rmse_zero", "rmse_mean", "lobe_mean", "lobe_mae_zero", "lobe_mae_mean", "background_mae_zero", "mae_weighted")
BASE_ROUND = ", ".join(f"round({c}, 6) AS {c}" for c in BASE_FLOATS)
BASE_REST = "total_pixels, median, min, max, lobe_pixels, background_pixels, CAST(iou_zero AS DOUBLE) AS iou_zero"


@register("g3_baselines", fx.TILED + ", " + baseline_sql("tt", "tile_idx", 3, 1.0) + f" SELECT tile_idx, {BASE_REST}, {BASE_ROUND} FROM bq")
def g3_baselines(spark, sf):
    return rounded(qc.baselines(fx.tiled(fx.target(spark, sf), spark, sf), ["tile_idx"], 3.0), *BASE_FLOATS)


G5 = f"""{G1}, {G2}, g5 AS (SELECT a.tile_idx, CASE WHEN a.valid_pixels / a.total_pixels < 0.25 THEN 'rgb_invalid' WHEN b.positive_pixels = 0 THEN 'background_only' ELSE 'valid' END AS status,
 a.valid_pixels / a.total_pixels AS rgb_coverage, b.positive_pixels / b.total_pixels AS target_coverage FROM g1 a JOIN g2 b USING (tile_idx))"""


def statuses(spark, sf, **options):
    return qc.status(qc.rgb_check(fx.tiled(fx.wide(spark, sf), spark, sf), least=LEAST_RGB), qc.target_check(fx.tiled(fx.target(spark, sf), spark, sf)), **options)


@register("g4_rebaselined", fx.TILED + f", {G5}, " + baseline_sql("tt", "tile_idx", 3, 1.0) + " SELECT tile_idx, status, CASE WHEN status = 'valid' THEN round(mae_mean, 6) END AS mae_mean, CASE WHEN status = 'valid' THEN round(lobe_fraction, 6) END AS lobe_fraction FROM g5 LEFT JOIN bq USING (tile_idx)")
def g4_rebaselined(spark, sf):
    """Baselines computed anew for the valid tiles of a list; the others keep none."""
    s = statuses(spark, sf).select("tile_idx", "status")
    valid = s.filter("status = 'valid'").select("tile_idx")
    fresh = qc.baselines(fx.tiled(fx.target(spark, sf), spark, sf).join(valid, "tile_idx", "left_semi"), ["tile_idx"], 3.0)
    return s.join(fresh.select("tile_idx", R("mae_mean").alias("mae_mean"), R("lobe_fraction").alias("lobe_fraction")), "tile_idx", "left")


@register("g5_tile_filter", fx.TILED + f", {G5}, " + baseline_sql("tt", "tile_idx", 3, 1.0) + f" SELECT g5.tile_idx, status, round(rgb_coverage, 6) AS rgb_coverage, round(target_coverage, 6) AS target_coverage, {BASE_REST}, {BASE_ROUND} FROM g5 JOIN bq USING (tile_idx)")
def g5_tile_filter(spark, sf):
    s = statuses(spark, sf).select("tile_idx", "status", R("rgb_coverage").alias("rgb_coverage"), R("target_coverage").alias("target_coverage"))
    return s.join(g3_baselines(spark, sf), "tile_idx")


@register("g5_min_coverage", fx.TILED + f", {G5} SELECT tile_idx, CASE WHEN status = 'rgb_invalid' THEN status WHEN target_coverage < 0.2 THEN 'background_only' ELSE 'valid' END AS status FROM g5")
def g5_min_coverage(spark, sf):
    return statuses(spark, sf, include_background=True, least_target=0.2).select("tile_idx", "status")


@register("g6_summary", fx.TILED + f", {G5} SELECT count(*) AS total, count(*) FILTER (status = 'rgb_invalid') AS rgb_invalid, count(*) FILTER (status = 'background_only') AS background_only, count(*) FILTER (status = 'valid') AS valid, round(100.0 * count(*) FILTER (status = 'rgb_invalid') / count(*), 6) AS rgb_invalid_pct, round(100.0 * count(*) FILTER (status = 'background_only') / count(*), 6) AS background_only_pct, round(100.0 * count(*) FILTER (status = 'valid') / count(*), 6) AS valid_pct FROM g5")
def g6_summary(spark, sf):
    return rounded(qc.counters(statuses(spark, sf)), "rgb_invalid_pct", "background_only_pct", "valid_pct")


@register("g7_target_coverage", fx.TILED + " SELECT tile_idx, round(count(*) FILTER (target > 0.5) / count(*), 6) AS coverage_ratio FROM tt GROUP BY 1 HAVING count(*) FILTER (target > 0.5) / count(*) >= 0.25")
def g7_target_coverage(spark, sf):
    t = qc.target_check(fx.tiled(fx.target(spark, sf), spark, sf), above=0.5)
    return rounded(t.filter("coverage_ratio >= 0.25").select("tile_idx", "coverage_ratio"), "coverage_ratio")


@register("g8_content_per_split", fx.TILED + " SELECT CASE WHEN tile_idx % 5 < 3 THEN 'train' WHEN tile_idx % 5 = 3 THEN 'val' ELSE 'test' END AS split, count(*) AS tiles, count(*) FILTER (has) AS with_content FROM (SELECT tile_idx, bool_or(target > 0) AS has FROM tt GROUP BY 1) GROUP BY 1")
def g8_content_per_split(spark, sf):
    has = fx.tiled(fx.target(spark, sf), spark, sf).groupBy("tile_idx").agg(F.bool_or(F.col("target") > 0).alias("has"))
    m = F.pmod("tile_idx", F.lit(5))
    return has.groupBy(F.when(m < 3, "train").when(m == 3, "val").otherwise("test").alias("split")).agg(F.count("*").alias("tiles"), F.count_if("has").alias("with_content"))


WHITE = "wh AS (SELECT tile_idx, avg(CASE WHEN b1 >= 250 AND b2 >= 250 AND b3 >= 250 THEN 1.0 ELSE 0.0 END) AS white_fraction FROM tw GROUP BY 1)"


@register("g9_white_tiles", fx.TILED + f", {WHITE} SELECT tile_idx, round(white_fraction, 6) AS white_fraction, white_fraction >= 0.6 AS mostly_white FROM wh")
def g9_white_tiles(spark, sf):
    return rounded(qc.white_tiles(fx.tiled(fx.wide(spark, sf), spark, sf)), "white_fraction")


@register("g10_background_candidates", fx.TILED + f", {G5}, {WHITE} SELECT g5.tile_idx FROM g5 JOIN wh USING (tile_idx) WHERE status <> 'valid' AND white_fraction < 0.6")
def g10_background_candidates(spark, sf):
    """Tiles that are not valid and not mostly white; whiteness is computed for those alone."""
    ids = g.tiles(spark, fx.grid(spark, sf)).select("tile_idx")
    rest = ids.join(statuses(spark, sf).filter("status = 'valid'").select("tile_idx"), "tile_idx", "left_anti")
    return qc.white_tiles(fx.tiled(fx.wide(spark, sf), spark, sf).join(rest, "tile_idx", "left_semi")).filter("NOT mostly_white").select("tile_idx")


@register("g15_normalization", fx.TILED + " SELECT 'dem' AS layer, round(avg(x * 100), 6) AS mean, round(stddev_pop(x * 100), 6) AS std FROM tw UNION ALL SELECT 'slope', round(avg(b1), 6), round(stddev_pop(b1), 6) FROM tw")
def g15_normalization(spark, sf):
    t = fx.tiled(fx.wide(spark, sf), spark, sf)
    layers = F.explode(F.create_map(F.lit("dem"), F.col("x") * 100, F.lit("slope"), F.col("b1"))).alias("layer", "v")
    return t.select(layers).groupBy("layer").agg(R(F.avg("v")).alias("mean"), R(F.stddev_pop("v")).alias("std"))


@register("g16_dataset_baselines", fx.TILED + ", " + baseline_sql("tt", "", 4, 0.0) + f" SELECT {BASE_REST}, {BASE_ROUND} FROM bq")
def g16_dataset_baselines(spark, sf):
    t = fx.tiled(fx.target(spark, sf), spark, sf)
    return rounded(qc.baselines(t, [], 4.0, empty_union=0.0), *BASE_FLOATS)


@register("g16_merged_medians", fx.TILED + " SELECT tile_idx % 3 AS part, count(*) AS n, true AS near FROM tt GROUP BY 1")
def g16_merged_medians(spark, sf):
    """Medians of splits from the sketches of their tiles; near says that the rank is as close as the sketches promise."""
    t = fx.tiled(fx.pred(spark, sf), spark, sf)
    tiles = quantiles.sketches(t, ["tile_idx"], "pred").withColumn("part", F.col("tile_idx") % 3)
    parts = quantiles.estimated(quantiles.merged(tiles, ["part"]), {"median": 0.5}).drop("sketch")
    ranks = t.withColumn("part", F.col("tile_idx") % 3).join(parts, "part").groupBy("part", "n").agg(F.count_if(F.col("pred") < F.col("median")).alias("under"), F.count_if(F.col("pred") <= F.col("median")).alias("upto"))
    slack = quantiles.RANK_ERROR * F.col("n")
    return ranks.select("part", "n", ((F.col("under") <= 0.5 * F.col("n") + slack) & (F.col("upto") >= 0.5 * F.col("n") - slack)).alias("near"))


@register("g17_random_iou", fx.TILED + " SELECT tile_idx, round(f, 6) AS positive_share, round(CASE WHEN 0.1 + f - 0.1 * f > 0 THEN 0.1 * f / (0.1 + f - 0.1 * f) END, 6) AS expected_iou, round(CASE WHEN 0.1 + f / 4 - 0.1 * f / 4 > 0 THEN 0.1 * (f / 4) / (0.1 + f / 4 - 0.1 * f / 4) END, 6) AS quarter_iou FROM (SELECT tile_idx, count(*) FILTER (target >= 3) / count(*) AS f FROM tt GROUP BY 1)")
def g17_random_iou(spark, sf):
    f = fx.tiled(fx.target(spark, sf), spark, sf).groupBy("tile_idx").agg(F.avg((F.col("target") >= 3).cast("double")).alias("f"))
    return f.select("tile_idx", R("f").alias("positive_share"), R(losses.expected_iou(0.1, F.col("f"))).alias("expected_iou"), R(losses.expected_iou(0.1, F.col("f") / 4)).alias("quarter_iou"))


@register("g17_random_iou_drawn")
def g17_random_iou_drawn(spark, sf):
    """In each tile exactly int(n p) cells drawn by hash; their IoU with the positives."""
    t = fx.tiled(fx.target(spark, sf), spark, sf)
    w = Window.partitionBy("tile_idx").orderBy(F.xxhash64("tile_idx", "r", "c", F.lit(42)), "r", "c")
    n = F.count("*").over(Window.partitionBy("tile_idx"))
    drawn = t.withColumn("drawn", F.row_number().over(w) <= F.floor(n * 0.1))
    pos = F.col("target") >= 3
    return drawn.groupBy("tile_idx").agg(F.count_if("drawn").alias("drawn"), losses.ratio(F.count_if(F.col("drawn") & pos).cast("double"), F.count_if(F.col("drawn") | pos).cast("double"), 1.0).alias("iou"))


METRICS = "avg(abs(pred - target)) AS mae, sqrt(avg((pred - target) * (pred - target))) AS rmse, CASE WHEN count(*) FILTER (pred >= 3 OR target >= 3) = 0 THEN 1.0 ELSE count(*) FILTER (pred >= 3 AND target >= 3) / count(*) FILTER (pred >= 3 OR target >= 3) END AS iou"


def tile_metrics(spark, sf):
    p, t = F.col("pred"), F.col("target")
    return fx.tiled(fx.pred(spark, sf), spark, sf).groupBy("tile_idx").agg(losses.mae(p, t).alias("mae"), losses.rmse(p, t).alias("rmse"), losses.iou(p, t, 3.0).alias("iou"))


@register("g18_regression_metrics", fx.TILED + f" SELECT tile_idx, round(mae, 6) AS mae, round(rmse, 6) AS rmse FROM (SELECT tile_idx, {METRICS} FROM tt GROUP BY 1)")
def g18_regression_metrics(spark, sf):
    return rounded(tile_metrics(spark, sf).select("tile_idx", "mae", "rmse"), "mae", "rmse")


@register("g19_iou", fx.TILED + f" SELECT tile_idx, round(iou, 6) AS iou FROM (SELECT tile_idx, {METRICS} FROM tt GROUP BY 1)")
def g19_iou(spark, sf):
    return rounded(tile_metrics(spark, sf).select("tile_idx", "iou"), "iou")


@register("j11_prediction_join", fx.TILED + " SELECT CAST(tile_idx AS BIGINT) AS tile_idx, count(*) AS cells, count(*) FILTER (tile_idx % 4 <> 0) AS predicted, count(*) FILTER (tile_idx % 4 = 0) AS unmatched FROM tt GROUP BY 1")
def j11_prediction_join(spark, sf):
    """Predictions joined to targets by tile and place; cells on one side only show a missing or misshapen prediction."""
    t = fx.tiled(fx.target(spark, sf), spark, sf).select("tile_idx", "tr", "tc", "target")
    p = fx.tiled(fx.pred(spark, sf), spark, sf).filter("tile_idx % 4 <> 0").select("tile_idx", "tr", "tc", "pred")
    return t.join(p, ["tile_idx", "tr", "tc"], "full").groupBy("tile_idx").agg(
        F.count("*").alias("cells"), F.count_if(F.col("pred").isNotNull() & F.col("target").isNotNull()).alias("predicted"), F.count_if(F.col("pred").isNull() | F.col("target").isNull()).alias("unmatched")
    )


@register("g20_validation", fx.TILED + f""", b AS (SELECT tile_idx // 8 AS batch, {METRICS}, avg(abs(target)) AS base FROM tt GROUP BY 1), p AS (SELECT min(pred) AS pred_min, max(pred) AS pred_max, avg(pred) AS pred_mean FROM tt)
SELECT round(avg(mae), 6) AS mae, round(avg(rmse), 6) AS rmse, round(avg(iou), 6) AS iou, round(avg(base), 6) AS baseline_mae, round((avg(base) - avg(mae)) / avg(base) * 100, 6) AS improvement, avg(mae) < avg(base) AS better,
 any_value(round(pred_min, 6)) AS pred_min, any_value(round(pred_max, 6)) AS pred_max, any_value(round(pred_mean, 6)) AS pred_mean FROM b, p""")
def g20_validation(spark, sf):
    """Mean of per-batch values, a batch being consecutive tiles; prediction range over all cells."""
    t = fx.tiled(fx.pred(spark, sf), spark, sf)
    p, y = F.col("pred"), F.col("target")
    b = t.groupBy(F.floor(F.col("tile_idx") / 8).alias("batch")).agg(
        losses.mae(p, y).alias("mae"), losses.rmse(p, y).alias("rmse"), losses.iou(p, y, 3.0).alias("iou"), F.avg(F.abs(y)).alias("base"), F.min(p).alias("lo"), F.max(p).alias("hi"), F.sum(p).alias("s"), F.count("*").alias("n"),
    )
    mae, base = F.avg("mae"), F.avg("base")
    return b.agg(
        R(mae).alias("mae"), R(F.avg("rmse")).alias("rmse"), R(F.avg("iou")).alias("iou"), R(base).alias("baseline_mae"), R((base - mae) / base * 100).alias("improvement"), (mae < base).alias("better"),
        R(F.min("lo")).alias("pred_min"), R(F.max("hi")).alias("pred_max"), R(F.sum("s") / F.sum("n")).alias("pred_mean"),
    )


@register("g21_diagnostics", fx.TILED + " SELECT tile_idx, round(min(pred), 6) AS pred_min, round(max(pred), 6) AS pred_max, round(avg(pred), 6) AS pred_mean, round(median(pred), 6) AS pred_median, round(avg(CASE WHEN pred >= 3 THEN 1.0 ELSE 0.0 END), 6) AS pred_share, round(avg(CASE WHEN target >= 3 THEN 1.0 ELSE 0.0 END), 6) AS target_share FROM tt GROUP BY 1")
def g21_diagnostics(spark, sf):
    p = F.col("pred")
    share = lambda c: R(F.avg((F.col(c) >= 3).cast("double")))
    return fx.tiled(fx.pred(spark, sf), spark, sf).groupBy("tile_idx").agg(
        R(F.min(p)).alias("pred_min"), R(F.max(p)).alias("pred_max"), R(F.avg(p)).alias("pred_mean"), R(F.percentile(p, 0.5)).alias("pred_median"), share("pred").alias("pred_share"), share("target").alias("target_share")
    )


@register("g22_best_tiles", fx.TILED + f", m AS (SELECT tile_idx, {METRICS} FROM tt GROUP BY 1) SELECT (SELECT tile_idx FROM m ORDER BY round(mae, 9), tile_idx LIMIT 1) AS best_by_loss, (SELECT tile_idx FROM m ORDER BY round(iou, 9) DESC, tile_idx LIMIT 1) AS best_by_iou")
def g22_best_tiles(spark, sf):
    m = tile_metrics(spark, sf)
    return m.agg(F.min_by("tile_idx", F.struct(F.round("mae", 9), F.col("tile_idx"))).alias("best_by_loss"), F.min_by("tile_idx", F.struct(-F.round("iou", 9), F.col("tile_idx"))).alias("best_by_iou"))


COMPARED = f""", m AS (SELECT tile_idx, {METRICS}, avg(abs(target)) AS b_zero, count(*) FILTER (target >= 3) / count(*) AS f FROM tt GROUP BY 1),
cmp AS (SELECT tile_idx, mae, rmse, iou, CASE WHEN tile_idx % 7 <> 0 THEN b_zero END AS baseline_mae FROM m)"""


def compared(spark, sf):
    """Tile metrics beside their baselines; every seventh tile has no baseline on record."""
    base = qc.baselines(fx.tiled(fx.target(spark, sf), spark, sf), ["tile_idx"], 3.0).filter("tile_idx % 7 <> 0").select("tile_idx", F.col("mae_zero").alias("baseline_mae"))
    j = tile_metrics(spark, sf).join(base, "tile_idx", "left")
    return j.withColumn("improvement", (F.col("baseline_mae") - F.col("mae")) / F.when(F.col("baseline_mae") > 0, F.col("baseline_mae"))).withColumn("better", F.col("mae") < F.col("baseline_mae")).withColumn("error", F.when(F.col("baseline_mae").isNull(), "no baseline"))


@register("g23_model_vs_baseline", fx.TILED + COMPARED + " SELECT tile_idx, round(mae, 6) AS mae, round(iou, 6) AS iou, round(baseline_mae, 6) AS baseline_mae, round((baseline_mae - mae) / CASE WHEN baseline_mae > 0 THEN baseline_mae END, 6) AS improvement, mae < baseline_mae AS better, CASE WHEN baseline_mae IS NULL THEN 'no baseline' END AS error FROM cmp")
def g23_model_vs_baseline(spark, sf):
    return rounded(compared(spark, sf).drop("rmse"), "mae", "iou", "baseline_mae", "improvement")


@register("g24_fleet_summary", fx.TILED + COMPARED + " SELECT count(*) AS tiles, count(*) FILTER (mae < baseline_mae) AS better, round(count(*) FILTER (mae < baseline_mae) / count(*), 6) AS better_fraction, round(avg(mae), 6) AS avg_mae, round(avg(iou), 6) AS avg_iou, round(avg(baseline_mae), 6) AS avg_baseline FROM cmp")
def g24_fleet_summary(spark, sf):
    return compared(spark, sf).agg(
        F.count("*").alias("tiles"), F.count_if("better").alias("better"), R(F.count_if("better") / F.count("*")).alias("better_fraction"), R(F.avg("mae")).alias("avg_mae"), R(F.avg("iou")).alias("avg_iou"), R(F.avg("baseline_mae")).alias("avg_baseline")
    )


@register("g25_layer_check", fx.TILED + " SELECT tile_idx, round(min(x * 100), 6) AS min, round(max(x * 100), 6) AS max, round(avg(x * 100), 6) AS mean, bool_and(x = 0) AS all_zero FROM tw GROUP BY 1")
def g25_layer_check(spark, sf):
    t = fx.tiled(fx.emb(spark, sf).withColumn("value", F.col("x") * 100), spark, sf)
    return rounded(qc.layer_check(t, ["tile_idx"]), "min", "max", "mean")


SEGMENT = "CASE WHEN r % 50 = 0 THEN -9999 ELSE (r // 7) * 100 + c // 9 END"


def segments(spark, sf):
    return fx.emb(spark, sf).select("r", "c", F.when(F.pmod("r", F.lit(50)) == 0, -9999).otherwise(F.floor(F.col("r") / 7) * 100 + F.floor(F.col("c") / 9)).cast("long").alias("segment"))


@register("g26_segment_check", fx.TILED + f", s AS (SELECT tile_idx, tr, tc, {SEGMENT} AS seg FROM tt), cm AS (SELECT tile_idx, tc, avg(seg) AS m FROM s GROUP BY 1, 2), rm AS (SELECT tile_idx, tr, avg(seg) AS m FROM s GROUP BY 1, 2), cc AS (SELECT tile_idx, corr(m, tc) AS k FROM cm GROUP BY 1), rc AS (SELECT tile_idx, corr(m, tr) AS k FROM rm GROUP BY 1) SELECT s.tile_idx, CAST(min(seg) AS BIGINT) AS min, CAST(max(seg) AS BIGINT) AS max, count(DISTINCT seg) AS unique_ids, any_value(round(cc.k, 5)) AS col_corr, any_value(round(rc.k, 5)) AS row_corr, any_value(abs(cc.k) > 0.9 OR abs(rc.k) > 0.9) AS gradient_like FROM s JOIN cc USING (tile_idx) JOIN rc USING (tile_idx) GROUP BY 1")
def g26_segment_check(spark, sf):
    return rounded(qc.segment_check(fx.tiled(segments(spark, sf), spark, sf)), "col_corr", "row_corr", n=5)


@register("g27_grid_means", fx.TILED + " SELECT tile_idx, CAST((SELECT max(i) FROM range(10) q(i) WHERE CAST(floor(i * 32 / 10) AS BIGINT) <= tr) AS BIGINT) AS gr, CAST((SELECT max(i) FROM range(10) q(i) WHERE CAST(floor(i * 32 / 10) AS BIGINT) <= tc) AS BIGINT) AS gc, round(avg(target), 6) AS mean FROM tt GROUP BY 1, 2, 3")
def g27_grid_means(spark, sf):
    m = qc.grid_means(fx.tiled(fx.target(spark, sf), spark, sf), "tile_idx", 32, 32, value="target")
    return rounded(m.withColumn("gr", F.col("gr").cast("long")).withColumn("gc", F.col("gc").cast("long")), "mean")


@register("g29_display", fx.TILED + ", e AS (SELECT tile_idx, min(target) AS lo, max(target) AS hi FROM tt GROUP BY 1) SELECT tile_idx, round(avg(CASE WHEN hi > lo THEN (target - lo) / (hi - lo) ELSE 0.0 END), 12) AS mean_display, max(CASE WHEN hi > lo THEN (target - lo) / (hi - lo) ELSE 0.0 END) AS top FROM tt JOIN e USING (tile_idx) GROUP BY 1")
def g29_display(spark, sf):
    d = qc.display(fx.tiled(fx.target(spark, sf), spark, sf), ["tile_idx"], "target")
    return d.groupBy("tile_idx").agg(R(F.avg("display"), 12).alias("mean_display"), F.max("display").alias("top"))


@register("g30_extrema", fx.TILED + ", n AS (SELECT *, row_number() OVER (PARTITION BY tile_idx ORDER BY pred, tr, tc) AS lo, row_number() OVER (PARTITION BY tile_idx ORDER BY pred DESC, tr, tc) AS hi FROM tt) SELECT a.tile_idx, round(a.pred, 6) AS min, a.tr AS min_r, a.tc AS min_c, round(b.pred, 6) AS max, b.tr AS max_r, b.tc AS max_c FROM n a JOIN n b ON a.tile_idx = b.tile_idx AND a.lo = 1 AND b.hi = 1")
def g30_extrema(spark, sf):
    return rounded(qc.extrema(fx.tiled(fx.pred(spark, sf), spark, sf), "tile_idx", "pred"), "min", "max")


HSV = """hs AS (SELECT tile_idx, greatest(b1, b2, b3) / 255 AS v, CASE WHEN greatest(b1, b2, b3) = 0 THEN 0 ELSE (greatest(b1, b2, b3) - least(b1, b2, b3)) / greatest(b1, b2, b3) END AS s,
 CASE WHEN greatest(b1, b2, b3) = least(b1, b2, b3) THEN 0.0 WHEN greatest(b1, b2, b3) = b1 THEN (b2 - b3) / (greatest(b1, b2, b3) - least(b1, b2, b3)) WHEN greatest(b1, b2, b3) = b2 THEN 2.0 + (b3 - b1) / (greatest(b1, b2, b3) - least(b1, b2, b3)) ELSE 4.0 + (b1 - b2) / (greatest(b1, b2, b3) - least(b1, b2, b3)) END / 6 AS h6 FROM tw),
hm AS (SELECT tile_idx, count(*) FILTER (v BETWEEN 0.05 AND 0.95) AS n, avg(h6 - floor(h6)) AS ah, avg(s) AS asat, avg(v) AS av, avg(h6 - floor(h6)) FILTER (v BETWEEN 0.05 AND 0.95) AS mh, avg(s) FILTER (v BETWEEN 0.05 AND 0.95) AS ms, avg(v) FILTER (v BETWEEN 0.05 AND 0.95) AS mv FROM hs GROUP BY 1),
hv AS (SELECT tile_idx, CASE WHEN n < 100 THEN ah ELSE mh END AS mean_hue, CASE WHEN n < 100 THEN asat ELSE ms END AS mean_saturation, CASE WHEN n < 100 THEN av ELSE mv END AS mean_value FROM hm)"""


def tile_hsv(spark, sf):
    h, s, v = scalar.hsv(F.col("b1") / 255, F.col("b2") / 255, F.col("b3") / 255)
    return qc.hsv_means(fx.tiled(fx.wide(spark, sf), spark, sf), "tile_idx", h, s, v)


@register("c5_hsv", fx.TILED + f", {HSV} SELECT tile_idx, round(sum(h6 - floor(h6)), 5) AS h, round(sum(s), 5) AS s, round(sum(v), 5) AS v FROM hs GROUP BY 1")
def c5_hsv(spark, sf):
    h, s, v = scalar.hsv(F.col("b1"), F.col("b2"), F.col("b3"))
    return fx.tiled(fx.wide(spark, sf), spark, sf).groupBy("tile_idx").agg(R(F.sum(h), 5).alias("h"), R(F.sum(s), 5).alias("s"), R(F.sum(v / 255), 5).alias("v"))


@register("g11_tile_hsv", fx.TILED + f", {HSV} SELECT tile_idx, round(mean_hue, 6) AS mean_hue, round(mean_saturation, 6) AS mean_saturation, round(mean_value, 6) AS mean_value FROM hv")
def g11_tile_hsv(spark, sf):
    return rounded(tile_hsv(spark, sf), "mean_hue", "mean_saturation", "mean_value")


@register("g12_thresholds", fx.TILED + f", {HSV} SELECT 'percentile' AS rule, round(quantile_cont(mean_value, 0.4), 6) AS low, round(quantile_cont(mean_value, 0.6), 6) AS high FROM hv UNION ALL SELECT 'examples', round(m - 0.05, 6), round(m + 0.05, 6) FROM (SELECT (avg(mean_value) FILTER (tile_idx IN (3, 4)) + avg(mean_value) FILTER (tile_idx IN (40, 41))) / 2 AS m FROM hv) UNION ALL SELECT 'default', 0.4, 0.5")
def g12_thresholds(spark, sf):
    m = tile_hsv(spark, sf)
    out = None
    for rule, options in (("percentile", {"ambiguous": 0.2}), ("examples", {"examples": ([3, 4], [40, 41])}), ("default", {})):
        one = qc.calibrated(m, **options).select(F.lit(rule).alias("rule"), R("low").alias("low"), R("high").alias("high"))
        out = one if out is None else out.unionByName(one)
    return out


@register("g13_illumination", fx.TILED + f", {HSV}, q AS (SELECT quantile_cont(mean_value, 0.4) AS low, quantile_cont(mean_value, 0.6) AS high FROM hv) SELECT tile_idx, CASE WHEN mean_value < low THEN 'shadow' WHEN mean_value > high THEN 'sun' ELSE 'ambiguous' END AS illumination FROM hv, q")
def g13_illumination(spark, sf):
    m = tile_hsv(spark, sf)
    return qc.illuminated(m, qc.calibrated(m, ambiguous=0.2)).select("tile_idx", "illumination")


P, Q = "greatest(1e-7, least(1 - 1e-7, p))", "t"
SOFT = "1 / (1 + exp(-({} - 3)))"
LOSS_SQL = {
    "l1_bce": (f"avg(-(t * ln({P}) + (1 - t) * ln(1 - {P})) * CASE WHEN t >= 0.5 THEN 5.0 ELSE 1.0 END)", "bce", {"pos_weight": 5.0}, True),
    "l2_bce_smoothed": (f"avg(-((t * 0.9 + 0.05) * ln({P}) + (1 - t * 0.9 - 0.05) * ln(1 - {P})))", "bce_smoothed", {"smoothing": 0.1}, True),
    "l3_smooth_l1": ("avg(CASE WHEN abs(p - t) < 1 THEN 0.5 * (p - t) * (p - t) ELSE abs(p - t) - 0.5 END)", "smooth_l1", {}, False),
    "l4_weighted_smooth_l1": ("avg(CASE WHEN abs(p - t) < 1 THEN 0.5 * (p - t) * (p - t) ELSE abs(p - t) - 0.5 END * CASE WHEN t >= 3 THEN 5.0 ELSE 1.0 END)", "weighted_smooth_l1", {"threshold": 3.0}, False),
    "l5_dice": ("1 - (2 * count(*) FILTER (p >= 3 AND t >= 3) + 1e-6) / (count(*) FILTER (p >= 3) + count(*) FILTER (t >= 3) + 1e-6)", "dice", {"threshold": 3.0}, False),
    "l6_iou": ("1 - (count(*) FILTER (p >= 3 AND t >= 3) + 1e-6) / (count(*) FILTER (p >= 3 OR t >= 3) + 1e-6)", "iou", {"threshold": 3.0}, False),
    "l7_soft_iou": (f"1 - (sum({SOFT.format('p')} * {SOFT.format('t')}) + 1e-6) / (sum({SOFT.format('p')}) + sum({SOFT.format('t')}) - sum({SOFT.format('p')} * {SOFT.format('t')}) + 1e-6)", "soft_iou", {"threshold": 3.0}, False),
    "l8_encouragement": ("coalesce(avg((p - t) * (p - t)) FILTER (t >= 3), 0) + 2 * coalesce(avg((3 - p) * (3 - p)) FILTER (t >= 3 AND p < 3), 0)", "encouragement", {"threshold": 3.0}, False),
    "l9_focal": ("avg(0.25 * pow(abs(p - t) / 20, 2) * abs(p - t))", "focal", {}, False),
}
LOSS_SQL["l10_combined"] = (f"0.5 * ({LOSS_SQL['l6_iou'][0]}) + 0.5 * ({LOSS_SQL['l4_weighted_smooth_l1'][0]})", None, {}, False)
LOSS_SQL["l11_acl"] = (f"0.5 * ({LOSS_SQL['l5_dice'][0]}) + 0.5 * ({LOSS_SQL['l9_focal'][0]})", "acl", {"threshold": 3.0}, False)


def _loss_query(name: str, sql: str, loss: str | None, options: dict, binary: bool) -> None:
    p, t = ("pred / 5", "CASE WHEN target >= 3 THEN 1.0 ELSE 0.0 END") if binary else ("pred", "target")

    @register(name, fx.TILED + f" SELECT tile_idx, round({sql}, 6) AS loss FROM (SELECT tile_idx, {p} AS p, {t} AS t FROM tt) GROUP BY 1")
    def query(spark, sf):
        df = fx.tiled(fx.pred(spark, sf), spark, sf)
        y = F.when(F.col("target") >= 3, 1.0).otherwise(0.0) if binary else F.col("target")
        x = F.col("pred") / 5 if binary else F.col("pred")
        if loss is None:
            agg = 0.5 * losses.iou_loss(x, y, 3.0) + 0.5 * losses.weighted_smooth_l1(x, y, 3.0)
        else:
            agg = losses.loss_agg(loss, x, y, **options)
        return df.groupBy("tile_idx").agg(R(agg).alias("loss"))


for _name, _args in LOSS_SQL.items():
    _loss_query(_name, *_args)


@register("l9_focal_cells", fx.ALL + " SELECT r, round(sum(0.25 * pow(abs(pred - target) / 20, 2) * abs(pred - target)), 6) AS total, count(*) AS n FROM pr GROUP BY 1")
def l9_focal_cells(spark, sf):
    """Focal regression without reduction: a value per cell."""
    top = F.max("target").over(Window.partitionBy("r"))
    cells = fx.pred(spark, sf).withColumn("loss", losses.focal_cell(F.col("pred"), F.col("target"), top))
    return cells.groupBy("r").agg(R(F.sum("loss")).alias("total"), F.count("*").alias("n"))


@register("l12_loss_registry", fx.ALL + f""" SELECT 'dice' AS name, round({LOSS_SQL['l5_dice'][0].replace('3', '0.5')}, 6) AS loss FROM (SELECT pred / 5 AS p, CASE WHEN target >= 3 THEN 1.0 ELSE 0.0 END AS t FROM pr)
UNION ALL SELECT 'smooth_l1', round({LOSS_SQL['l3_smooth_l1'][0]}, 6) FROM (SELECT pred AS p, target AS t FROM pr)""")
def l12_loss_registry(spark, sf):
    p = fx.pred(spark, sf)
    y = F.when(F.col("target") >= 3, 1.0).otherwise(0.0)
    one = p.agg(R(losses.loss_agg("dice", F.col("pred") / 5, y, binary=True)).alias("loss")).select(F.lit("dice").alias("name"), "loss")
    return one.unionByName(p.agg(R(losses.loss_agg("smooth_l1", F.col("pred"), F.col("target"))).alias("loss")).select(F.lit("smooth_l1").alias("name"), "loss"))
