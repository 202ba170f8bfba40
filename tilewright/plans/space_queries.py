"""Queries over polygons, raster algebra, registries and samples."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tilewright.functions import scalar
from tilewright.operators import grid as g
from tilewright.operators import qc, raster, registry, sampling, stencil, vector
from tilewright.plans import fixtures as fx
from tilewright.plans.tile_queries import G5, HSV, SEGMENT, rounded, segments, statuses, tile_hsv
from tilewright.registry import register
from tilewright.sources import documents

R = lambda e, n=6: F.round(e, n)
BOUNDARY = {0: [[(4, -20), (60, -20), (60, -300), (40, -300), (40, -150), (4, -150)]]}
SHADOWS = {0: [[(0, -110), (20, -110), (20, -180), (0, -180)]], 1: [[(30, -200), (64, -200), (47, -320)]]}
HOLED = {0: [[(4, -20), (60, -20), (60, -120), (4, -120)], [(20, -40), (40, -40), (40, -80), (20, -80)]]}


def edge_sql(name: str, polygons: dict) -> str:
    rows = [f"({p}, {r}, {k}, {float(a[0])}::DOUBLE, {float(a[1])}::DOUBLE, {float(b[0])}::DOUBLE, {float(b[1])}::DOUBLE)" for p, rings in polygons.items() for r, pts in enumerate(rings) for k, (a, b) in enumerate(zip(pts, pts[1:] + pts[:1], strict=True))]
    return f"{name} AS (SELECT * FROM (VALUES {', '.join(rows)}) v(poly_id, ring_id, edge_seq, x1, y1, x2, y2))"


def held_sql(points: str, edges: str) -> str:
    """(pid, poly_id) by counting crossings over all edges."""
    return f"SELECT p.pid, e.poly_id FROM {points} p JOIN {edges} e ON p.y >= least(e.y1, e.y2) AND p.y < greatest(e.y1, e.y2) WHERE e.x1 + (p.y - e.y1) / (e.y2 - e.y1) * (e.x2 - e.x1) > p.x GROUP BY 1, 2 HAVING count(*) % 2 = 1"


CENTRES = "cen AS (SELECT r * 64 + c AS pid, r, c, c + 0.5::DOUBLE AS x, -(r + 0.5::DOUBLE) AS y FROM emb)"
BOX = "box AS (SELECT tile_idx AS pid, CAST(col_start AS DOUBLE) AS minx, CAST(-row_end AS DOUBLE) AS miny, CAST(col_end AS DOUBLE) AS maxx, CAST(-row_start AS DOUBLE) AS maxy FROM tiles)"


def boxes(spark, sf):
    return g.bounds(g.tiles(spark, fx.grid(spark, sf)))


CROSSED = "JOIN e ON p.y >= least(e.y1, e.y2) AND p.y < greatest(e.y1, e.y2) WHERE e.x1 + (p.y - e.y1) / (e.y2 - e.y1) * (e.x2 - e.x1) > p.x"


@register("j9_polygon_mask", fx.CELLS + f", {CENTRES}, {edge_sql('e', HOLED)} SELECT r, c FROM cen p {CROSSED} GROUP BY r, c HAVING count(*) % 2 = 1")
def j9_polygon_mask(spark, sf):
    return vector.mask(vector.edges_of(spark, HOLED), fx.height(spark, sf), fx.WIDTH).select("r", "c")


#: Cells, closed above and on their left, that an edge passes: the edge clipped to the cell, where an end that a cell does not own must be beyond.
TOUCHED = f"""{CENTRES}, {edge_sql('e', SHADOWS)}, t AS (SELECT emb.r, emb.c, e.poly_id, x2 - x1 AS dx, y1 - y2 AS dy, x1, -y1 AS v1, e.* EXCLUDE (x1, poly_id) FROM emb JOIN e ON emb.c BETWEEN floor(least(x1, x2)) AND floor(greatest(x1, x2)) AND emb.r BETWEEN floor(-greatest(y1, y2)) AND floor(-least(y1, y2))),
b AS (SELECT r, c, poly_id,
 greatest(0.0, CASE WHEN dx > 0 THEN (c - x1) / dx END, CASE WHEN dy > 0 THEN (r - v1) / dy END) AS low, greatest(-1.0, CASE WHEN dx < 0 THEN (c + 1 - x1) / dx END, CASE WHEN dy < 0 THEN (r + 1 - v1) / dy END) AS low_open,
 least(1.0, CASE WHEN dx < 0 THEN (c - x1) / dx END, CASE WHEN dy < 0 THEN (r - v1) / dy END) AS high, least(2.0, CASE WHEN dx > 0 THEN (c + 1 - x1) / dx END, CASE WHEN dy > 0 THEN (r + 1 - v1) / dy END) AS high_open FROM t)
SELECT poly_id, r, c FROM b WHERE low <= high AND low < high_open AND low_open < high AND low_open < high_open
UNION SELECT poly_id, r, c FROM ({held_sql('cen', 'e')}) JOIN cen USING (pid)"""


@register("j9_all_touched", fx.CELLS + f", {TOUCHED}")
def j9_all_touched(spark, sf):
    return vector.touched(vector.edges_of(spark, SHADOWS), fx.height(spark, sf), fx.WIDTH).join(fx.emb(spark, sf), ["r", "c"]).select("poly_id", "r", "c")


@register("j10_raster_spec", "WITH p AS (SELECT CAST(unnest(embedding[1:6:2]) AS DOUBLE) * 100 AS x, CAST(unnest(embedding[2:6:2]) AS DOUBLE) * 100 AS y FROM embeddings), b AS (SELECT min(x) AS minx, min(y) AS miny, max(x) AS maxx, max(y) AS maxy FROM p) SELECT *, CAST(floor((maxx - minx) / 0.7) AS BIGINT) AS width, CAST(floor((maxy - miny) / 0.7) AS BIGINT) AS height FROM b")
def j10_raster_spec(spark, sf):
    """The raster that holds a triangle of each vector."""
    at = lambda k: F.get("embedding", F.lit(k)).cast("double") * 100
    sides = F.explode(F.array(*[F.struct(at(2 * a).alias("x1"), at(2 * a + 1).alias("y1"), at(2 * b).alias("x2"), at(2 * b + 1).alias("y2")) for a, b in ((0, 1), (1, 2), (2, 0))]))
    edges = fx.table(spark, sf, "embeddings").select(F.col("vec_id").alias("poly_id"), F.lit(0).alias("ring_id"), sides.alias("e")).select("poly_id", "ring_id", "e.*")
    return vector.raster_spec(edges, 0.7)


MEETS = f"""{BOX}, {edge_sql('e', BOUNDARY)}, cor AS (SELECT pid, minx AS x, miny AS y FROM box),
seg AS (SELECT pid, x1, y1, x2, y2, minx, miny, maxx, maxy, x2 - x1 AS dx, y2 - y1 AS dy FROM box, e),
tt2 AS (SELECT *, CASE WHEN dx = 0 THEN CASE WHEN x1 < minx OR x1 > maxx THEN 2.0 ELSE 0.0 END ELSE least((minx - x1) / dx, (maxx - x1) / dx) END AS xa, CASE WHEN dx = 0 THEN 1.0 ELSE greatest((minx - x1) / dx, (maxx - x1) / dx) END AS xb,
 CASE WHEN dy = 0 THEN CASE WHEN y1 < miny OR y1 > maxy THEN 2.0 ELSE 0.0 END ELSE least((miny - y1) / dy, (maxy - y1) / dy) END AS ya, CASE WHEN dy = 0 THEN 1.0 ELSE greatest((miny - y1) / dy, (maxy - y1) / dy) END AS yb FROM seg),
meets AS (SELECT DISTINCT pid FROM tt2 WHERE greatest(xa, ya, 0.0) <= least(xb, yb, 1.0) UNION {held_sql('cor', 'e').replace('p.pid, e.poly_id', 'p.pid').replace('GROUP BY 1, 2', 'GROUP BY p.pid, e.poly_id')})"""


@register("j6_boundary_tiles", fx.ALL + f", {MEETS} SELECT pid AS tile_idx FROM meets")
def j6_boundary_tiles(spark, sf):
    return vector.at_boundary(boxes(spark, sf), vector.edges_of(spark, BOUNDARY)).select("tile_idx")


@register("j7_list_in_boundary", fx.TILED + f", {G5}, {MEETS} SELECT tile_idx, status FROM g5 WHERE tile_idx IN (SELECT pid FROM meets)")
def j7_list_in_boundary(spark, sf):
    return statuses(spark, sf).select("tile_idx", "status").join(vector.at_boundary(boxes(spark, sf), vector.edges_of(spark, BOUNDARY)).select("tile_idx"), "tile_idx", "left_semi")


@register("j8_first_polygon", fx.ALL + f", {BOX}, mid AS (SELECT pid, (minx + maxx) / 2 + 0.25 AS x, (miny + maxy) / 2 + 0.25 AS y FROM box), {edge_sql('e', SHADOWS | {2: BOUNDARY[0]})}, f AS (SELECT pid, min(poly_id) AS poly_id FROM ({held_sql('mid', 'e')}) GROUP BY 1) SELECT mid.pid, CASE f.poly_id WHEN 0 THEN 'shadow' WHEN 1 THEN 'sun' ELSE 'ambiguous' END AS label FROM mid LEFT JOIN f USING (pid)")
def j8_first_polygon(spark, sf):
    mid = boxes(spark, sf).select(F.col("tile_idx").alias("pid"), ((F.col("minx") + F.col("maxx")) / 2 + 0.25).alias("x"), ((F.col("miny") + F.col("maxy")) / 2 + 0.25).alias("y"))
    labels = spark.createDataFrame([(0, " Shadow"), (1, "SUN"), (2, "boundary")], "poly_id long, text string")
    return vector.first_holder(mid, vector.edges_of(spark, SHADOWS | {2: BOUNDARY[0]}), labels)


# Exact areas in SQL: the polygons are convex, so each row of cells gives its covered length at its middle only where edges are straight; the
# fraction is therefore taken from a fine scan of 64 lines per cell row and compared to three digits.
FRACTION = f"""{BOX}, {edge_sql('e', SHADOWS)}, scan AS (SELECT pid, minx, maxx, miny, maxy, miny + (k + 0.5) * (maxy - miny) / 2048 AS y FROM box, (SELECT unnest(range(2048)) AS k)),
cross_at AS (SELECT s.pid, s.y, e.poly_id, s.minx, s.maxx, CASE WHEN e.y2 > e.y1 THEN 1 ELSE -1 END * greatest(0.0, least(s.maxx - s.minx, e.x1 + (s.y - e.y1) / (e.y2 - e.y1) * (e.x2 - e.x1) - s.minx)) AS v FROM scan s JOIN e ON s.y >= least(e.y1, e.y2) AND s.y < greatest(e.y1, e.y2)),
fr AS (SELECT b.pid, coalesce(abs(sum(v)) / 2048 / any_value(b.maxx - b.minx), 0.0) AS fraction FROM box b LEFT JOIN cross_at c ON b.pid = c.pid GROUP BY 1)"""


@register("g14_shadow_area", fx.ALL + f", {FRACTION} SELECT pid AS tile_idx, round(fraction, 3) + 0.0 AS fraction, CASE WHEN fraction >= 0.7 THEN 'shadow' WHEN fraction <= 0.3 THEN 'sun' ELSE 'mixed' END AS illumination FROM fr")
def g14_shadow_area(spark, sf):
    b = boxes(spark, sf).select(F.col("tile_idx").alias("pid"), "minx", "miny", "maxx", "maxy")
    f = vector.light_of(vector.covered_fraction(b, vector.edges_of(spark, SHADOWS)))
    return f.select(F.col("pid").alias("tile_idx"), R("fraction", 3).alias("fraction"), "illumination")


#: SHADOWS with one that crosses both, one inside another, one twice, and one with a hole.
UNITED = SHADOWS | {2: [[(10, -150), (40, -150), (40, -260), (10, -260)]], 3: [[(5, -120), (15, -120), (15, -140), (5, -140)]], 4: SHADOWS[0], 5: [[(20, -330), (60, -330), (60, -420), (20, -420)], [(30, -350), (30, -400), (50, -400), (50, -350)]]}
#: Each point counts once: on every line of a fine scan the polygons' stretches are merged.
UNITED_FRACTION = f"""{BOX}, {edge_sql('e', UNITED)}, scan AS (SELECT pid, minx, maxx, miny + (k + 0.5) * (maxy - miny) / 2048 AS y FROM box, (SELECT unnest(range(2048)) AS k)),
cut AS (SELECT s.pid, s.y, s.minx, s.maxx, e.poly_id, e.x1 + (s.y - e.y1) / (e.y2 - e.y1) * (e.x2 - e.x1) AS x FROM scan s JOIN e ON s.y >= least(e.y1, e.y2) AND s.y < greatest(e.y1, e.y2)),
held AS (SELECT pid, y, minx, maxx, x AS a, lead(x) OVER w AS b, row_number() OVER w AS n FROM cut WINDOW w AS (PARTITION BY pid, y, poly_id ORDER BY x)),
clipped AS (SELECT pid, y, minx, maxx, greatest(a, minx) AS a, least(b, maxx) AS b FROM held WHERE n % 2 = 1 AND greatest(a, minx) < least(b, maxx)),
gained AS (SELECT pid, y, maxx - minx AS w, greatest(0.0, b - greatest(a, coalesce(max(b) OVER (PARTITION BY pid, y ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a))) AS v FROM clipped),
fr AS (SELECT b.pid, coalesce(sum(v) / 2048 / any_value(w), 0.0) AS fraction FROM box b LEFT JOIN gained g ON b.pid = g.pid GROUP BY 1)"""


@register("g14_united_shadows", fx.ALL + f", {UNITED_FRACTION} SELECT pid AS tile_idx, round(fraction, 3) + 0.0 AS fraction, CASE WHEN fraction >= 0.7 THEN 'shadow' WHEN fraction <= 0.3 THEN 'sun' ELSE 'mixed' END AS illumination FROM fr")
def g14_united_shadows(spark, sf):
    """Shadows that overlap, cross and hold one another."""
    b = boxes(spark, sf).select(F.col("tile_idx").alias("pid"), "minx", "miny", "maxx", "maxy")
    f = vector.light_of(vector.covered_fraction(b, vector.edges_of(spark, UNITED)))
    return f.select(F.col("pid").alias("tile_idx"), (R("fraction", 3) + 0.0).alias("fraction"), "illumination")


@register("j14_masked_segments", fx.ALL + f", {CENTRES}, {edge_sql('e', BOUNDARY)}, ins AS ({held_sql('cen', 'e')}) SELECT emb.r, CAST(sum(CASE WHEN ins.pid IS NULL THEN -9999 ELSE {SEGMENT.replace('r %', 'emb.r %').replace('(r //', '(emb.r //').replace('+ c //', '+ emb.c //')} END) AS BIGINT) AS total FROM emb LEFT JOIN ins ON ins.pid = emb.r * 64 + emb.c GROUP BY 1")
def j14_masked_segments(spark, sf):
    inside = vector.mask(vector.edges_of(spark, BOUNDARY), fx.height(spark, sf), fx.WIDTH).select("r", "c", F.lit(True).alias("inside"))
    j = segments(spark, sf).join(inside, ["r", "c"], "left")
    return j.groupBy("r").agg(F.sum(F.when(F.col("inside"), F.col("segment")).otherwise(-9999)).alias("total"))


@register("b7_crop", fx.ALL + " SELECT r - 100 AS r, c - 10 AS c, b1, b2 FROM wide WHERE r BETWEEN 100 AND 149 AND c BETWEEN 10 AND 39")
def b7_crop(spark, sf):
    cells, _ = raster.crop(fx.wide(spark, sf), fx.height(spark, sf), fx.WIDTH, 10.4, -100.3, 50, 30)
    return cells.select("r", "c", "b1", "b2")


@register("b8_white_crop", fx.ALL + " SELECT 'white' AS crop, min(least(b1, b2, b3)) AS min, max(greatest(b1, b2, b3)) AS max, min(least(b1, b2, b3)) >= 255 AS all_white FROM wide WHERE r BETWEEN 420 AND 459 AND c BETWEEN 40 AND 59 UNION ALL SELECT 'other', min(least(b1, b2, b3)), max(greatest(b1, b2, b3)), min(least(b1, b2, b3)) >= 255 FROM wide WHERE r BETWEEN 380 AND 419 AND c BETWEEN 40 AND 59")
def b8_white_crop(spark, sf):
    out = None
    for name, y in (("white", -420.0), ("other", -380.0)):
        cells, _ = raster.crop(fx.wide(spark, sf), fx.height(spark, sf), fx.WIDTH, 40.0, y, 40, 20)
        one = raster.all_white(cells).select(F.lit(name).alias("crop"), "min", "max", "all_white")
        out = one if out is None else out.unionByName(one)
    return out


@register("b9_band_split", fx.ALL + " SELECT 'rgb' AS layer, 1 AS band, CAST(sum(b1) AS DOUBLE) AS total FROM wide UNION ALL SELECT 'rgb', 2, CAST(sum(b2) AS DOUBLE) FROM wide UNION ALL SELECT 'dem', 1, CAST(sum(b3) AS DOUBLE) FROM wide")
def b9_band_split(spark, sf):
    layers = spark.createDataFrame([(1, "rgb", 1), (2, "rgb", 2), (3, "dem", 1)], "band int, layer string, layer_band int")
    return raster.split_bands(fx.cells(spark, sf), layers).groupBy("layer", "band").agg(F.sum("value").alias("total"))


@register("j2_layer_stack", fx.ALL + " SELECT band, layer, count(*) AS cells, round(sum(v), 4) AS total FROM (SELECT 1 AS band, 'rgb' AS layer, b1 AS v FROM wide UNION ALL SELECT 2, 'rgb', b2 FROM wide UNION ALL SELECT 3, 'rgb', b3 FROM wide UNION ALL SELECT 4, 'dem', x * 100 FROM wide) GROUP BY 1, 2")
def j2_layer_stack(spark, sf):
    h = fx.height(spark, sf)
    meta = spark.createDataFrame([("rgb", h, 64, "1,0,0,0,-1,0", "local"), ("dem", h, 64, "1,0,0,0,-1,0", "local")], "raster_id string, height int, width int, transform string, crs string")
    dem = fx.emb(spark, sf).select(F.lit(1).alias("band"), "r", "c", (F.col("x") * 100).alias("value"))
    return raster.stacked(meta, [("rgb", fx.cells(spark, sf), 3), ("dem", dem, 1)]).groupBy("band", "layer").agg(F.count("*").alias("cells"), R(F.sum("value"), 4).alias("total"))


GRID_OF = ", size AS (SELECT max(vec_id) + 1 AS h FROM embeddings), o AS (SELECT CAST(r AS BIGINT) AS r, CAST(c AS BIGINT) AS c, h FROM (SELECT h, unnest(range({rows})) AS r FROM size), (SELECT unnest(range({cols})) AS c))"


@register("j15_resample_nearest", fx.CELLS + GRID_OF.format(rows="h // 2", cols=80) + " SELECT o.r, o.c, e.x AS value FROM o JOIN emb e ON e.r = CAST(floor((o.r + 0.5) * o.h / (o.h // 2)) AS BIGINT) AND e.c = CAST(floor((o.c + 0.5) * 64 / 80) AS BIGINT)")
def j15_resample_nearest(spark, sf):
    v, h = fx.emb(spark, sf).withColumnRenamed("x", "value"), fx.height(spark, sf)
    return raster.resampled(v, (h, 64), (h // 2, 80), "nearest")


@register("j15_resample_average", fx.CELLS + " SELECT r // 4 AS r, c // 2 AS c, round(avg(x), 6) AS value FROM emb GROUP BY 1, 2")
def j15_resample_average(spark, sf):
    """Means of 4 x 2 cells; the last row takes the rows that are left, so the grid goes on beyond them."""
    v, rows = fx.emb(spark, sf).withColumnRenamed("x", "value"), -(-fx.height(spark, sf) // 4)
    return rounded(raster.resampled(v, (4 * rows, 64), (rows, 32), "average"), "value")


AT = ", q AS (SELECT r, c, (r + 0.5::DOUBLE) * h / {rows} - 0.5 AS y, (c + 0.5::DOUBLE) * 64 / 100 - 0.5 AS x FROM o)"


@register("j15_resample_bilinear", fx.CELLS + GRID_OF.format(rows="h * 3 // 4", cols=100) + AT.format(rows="(h * 3 // 4)") + """, two AS (SELECT CAST(unnest([0, 1]) AS BIGINT) AS d),
k AS (SELECT q.r, q.c, (1 - abs(q.y - e.r)) * (1 - abs(q.x - e.c)) AS w, e.x AS v FROM q, two a, two b, emb e WHERE e.r = CAST(floor(q.y) AS BIGINT) + a.d AND e.c = CAST(floor(q.x) AS BIGINT) + b.d)
SELECT r, c, round(sum(w * v) / sum(w), 6) AS value FROM k WHERE w <> 0 GROUP BY 1, 2""")
def j15_resample_bilinear(spark, sf):
    v, h = fx.emb(spark, sf).withColumnRenamed("x", "value"), fx.height(spark, sf)
    return rounded(raster.resampled(v, (h, 64), (h * 3 // 4, 100)), "value")


CUBE = "CASE WHEN abs({t}) <= 1 THEN 1.5 * abs({t}) ** 3 - 2.5 * {t} * {t} + 1 WHEN abs({t}) < 2 THEN -0.5 * abs({t}) ** 3 + 2.5 * {t} * {t} - 4 * abs({t}) + 2 ELSE 0 END"


@register("j15_resample_cubic", fx.CELLS + GRID_OF.format(rows="h * 2 // 3", cols=100) + AT.format(rows="(h * 2 // 3)") + f""", four AS (SELECT CAST(unnest([-1, 0, 1, 2]) AS BIGINT) AS d),
k AS (SELECT q.r, q.c, {CUBE.format(t='(q.y - e.r)')} * {CUBE.format(t='(q.x - e.c)')} AS w, e.x AS v FROM q, four a, four b, emb e WHERE e.r = CAST(floor(q.y) AS BIGINT) + a.d AND e.c = CAST(floor(q.x) AS BIGINT) + b.d)
SELECT r, c, round(sum(w * v) / sum(w), 6) + 0.0 AS value FROM k GROUP BY 1, 2""")
def j15_resample_cubic(spark, sf):
    v = fx.emb(spark, sf).withColumnRenamed("x", "value")
    got = rounded(raster.resampled(v, (fx.height(spark, sf), 64), (fx.height(spark, sf) * 2 // 3, 100), "cubic"), "value")
    return got.withColumn("value", F.col("value") + 0.0)


INSIDE = f"{CENTRES}, {edge_sql('e', BOUNDARY)}, ins AS ({held_sql('cen', 'e')})"


@register("t6_placements", fx.CELLS + f", {fx.RGB}, {edge_sql('e', BOUNDARY)}, cen AS (SELECT r, c, c + 0.5::DOUBLE AS x, -(r + 0.5::DOUBLE) AS y FROM wide WHERE least(b1, b2, b3) < 250) SELECT r, c FROM cen p {CROSSED} AND r BETWEEN 12 AND (SELECT max(vec_id) FROM embeddings) - 12 AND c BETWEEN 12 AND 51 GROUP BY r, c HAVING count(*) % 2 = 1")
def t6_placements(spark, sf):
    h = fx.height(spark, sf)
    return raster.placements(fx.wide(spark, sf), vector.mask(vector.edges_of(spark, BOUNDARY), h, fx.WIDTH), h, fx.WIDTH, 12)


TEMPLATE = [(dr, dc) for dr in range(-3, 4) for dc in range(-3, 4) if 4 <= dr * dr + dc * dc <= 10]
STAMPS = f"""ctr AS (SELECT r * 64 + c AS pid, r, c FROM emb WHERE x > 0.35), tpl AS (SELECT * FROM (VALUES {', '.join(map(str, TEMPLATE))}) v(dr, dc)),
sc AS (SELECT pid, ctr.r + dr AS r, ctr.c + dc AS c FROM ctr, tpl), bad AS (SELECT DISTINCT pid FROM sc WHERE r < 0 OR c < 0 OR c > 63 OR r >= (SELECT h FROM len)), ok AS (SELECT * FROM sc WHERE pid NOT IN (SELECT pid FROM bad))"""


def stamp_cells(spark, sf):
    centres = fx.emb(spark, sf).filter("x > 0.35").select((F.col("r") * 64 + F.col("c")).alias("pid"), "r", "c")
    return raster.stamped_cells(centres, spark.createDataFrame(TEMPLATE, "dr int, dc int"), fx.height(spark, sf), fx.WIDTH)


@register("t7_stamped", fx.ALL + f", {STAMPS} SELECT w.r, count(*) FILTER (s.r IS NOT NULL) AS stamped, CAST(sum(CASE WHEN s.r IS NULL THEN b1 ELSE 0 END) AS DOUBLE) AS b1, CAST(sum(CASE WHEN s.r IS NULL THEN 1.0 ELSE 20.0 END) AS DOUBLE) AS target FROM wide w LEFT JOIN (SELECT DISTINCT r, c FROM ok) s ON s.r = w.r AND s.c = w.c GROUP BY 1")
def t7_stamped(spark, sf):
    s = raster.stamped(fx.wide(spark, sf).withColumn("target", F.lit(1.0)), stamp_cells(spark, sf), 20)
    return s.groupBy("r").agg(F.count_if(F.col("target") == 20).alias("stamped"), F.sum("b1").alias("b1"), F.sum("target").alias("target"))


@register("t8_white_placements", fx.ALL + f", {STAMPS} SELECT pid, round(avg(CASE WHEN least(b1, b2, b3) >= 250 THEN 1.0 ELSE 0.0 END), 6) AS white_fraction FROM ok JOIN wide w ON w.r = ok.r AND w.c = ok.c GROUP BY 1 HAVING avg(CASE WHEN least(b1, b2, b3) >= 250 THEN 1.0 ELSE 0.0 END) > 0.2")
def t8_white_placements(spark, sf):
    return rounded(raster.too_white(stamp_cells(spark, sf), fx.wide(spark, sf), 0.2), "white_fraction")


@register("x8_rotated", fx.CELLS + f", {fx.GRID} SELECT tile_idx, 31 - (c - col_start) AS r2, 31 - (r - row_start) AS c2, any_value(x) AS x FROM tiles JOIN emb ON r >= row_start AND r < row_end AND c >= col_start AND c < col_end GROUP BY 1, 2, 3")
def x8_rotated(spark, sf):
    t = fx.tiled(fx.emb(spark, sf), spark, sf)
    r, c = raster.turned(F.col("tr"), F.col("tc"), 32, 1, flip_h=True)
    return t.select("tile_idx", r.alias("r2"), c.alias("c2"), "x")


CLAMPED = "greatest(0.0, least(1.0, {}))"
GRAY = "0.2989 * r + 0.587 * g + 0.114 * b"


def step_sql(name: str, source: str, expression: str) -> str:
    """name: tile_idx, r, g, b after one step, each clamped; x stands for the band."""
    return f"{name} AS (SELECT tile_idx, " + ", ".join(f"{CLAMPED.format(expression.replace('x', band))} AS {band}" for band in "rgb") + f" FROM {source})"


RECOLOURED = f"""n AS (SELECT tile_idx, b1 / 255 AS r, b2 / 255 AS g, b3 / 255 AS b FROM tw), y AS (SELECT *, {GRAY} AS y FROM n), {step_sql('s', 'y', '1.28 * x + (1 - 1.28) * y')},
m AS (SELECT *, avg({GRAY}) OVER (PARTITION BY tile_idx) AS m FROM s), {step_sql('k', 'm', '0.8 * x + (1 - 0.8) * m')}, {step_sql('p', 'k', 'pow(x, 1.1)')}, {step_sql('q', 'p', 'x + 0.05')}"""


@register("x9_recoloured", fx.TILED + f", {RECOLOURED} SELECT tile_idx, round(avg(r), 6) AS r, round(avg(g), 6) AS g, round(avg(b), 6) AS b FROM q GROUP BY 1")
def x9_recoloured(spark, sf):
    return band_means(raster.recoloured(unit_bands(spark, sf), "tile_idx", brightness=0.05, contrast=0.8, saturation=1.28, gamma=1.1))


CONTRAST_FIRST = f"""n AS (SELECT tile_idx, b1 / 255 AS r, b2 / 255 AS g, b3 / 255 AS b FROM tw), m AS (SELECT *, avg({GRAY}) OVER (PARTITION BY tile_idx) AS m FROM n), {step_sql('k', 'm', '1.4 * x + (1 - 1.4) * m')},
y AS (SELECT *, {GRAY} AS y FROM k), {step_sql('s', 'y', '0.7 * x + (1 - 0.7) * y')}"""


@register("x9_contrast_first", fx.TILED + f", {CONTRAST_FIRST} SELECT tile_idx, round(avg(r), 6) AS r, round(avg(g), 6) AS g, round(avg(b), 6) AS b FROM s GROUP BY 1")
def x9_contrast_first(spark, sf):
    """The order of the extended set on disk."""
    return band_means(raster.recoloured(unit_bands(spark, sf), "tile_idx", contrast=1.4, saturation=0.7, contrast_first=True))


def unit_bands(spark, sf):
    return fx.tiled(fx.wide(spark, sf), spark, sf).withColumns({b: F.col(b) / 255 for b in ("b1", "b2", "b3")})


def band_means(t):
    return t.groupBy("tile_idx").agg(R(F.avg("b1")).alias("r"), R(F.avg("b2")).alias("g"), R(F.avg("b3")).alias("b"))


TURN = "greatest(0.0, least((({n} + h * 6) % 6), 4 - (({n} + h * 6) % 6), 1.0))"
HUED = f""", n AS (SELECT tile_idx, greatest(b1, b2, b3) / 255 AS v, CASE WHEN greatest(b1, b2, b3) = 0 THEN 0 ELSE 1 - least(b1, b2, b3) / greatest(b1, b2, b3) END AS s, greatest(b1, b2, b3) - least(b1, b2, b3) AS d, b1, b2, b3 FROM tw),
k AS (SELECT tile_idx, v, s, (CASE WHEN d = 0 THEN 0 WHEN greatest(b1, b2, b3) = b1 THEN (b2 - b3) / d + 6 WHEN greatest(b1, b2, b3) = b2 THEN 2 + (b3 - b1) / d ELSE 4 + (b1 - b2) / d END / 6 + 0.1) % 1 AS h FROM n)
SELECT tile_idx, round(avg(v - v * s * {TURN.format(n=5)}), 6) AS r, round(avg(v - v * s * {TURN.format(n=3)}), 6) AS g, round(avg(v - v * s * {TURN.format(n=1)}), 6) AS b FROM k GROUP BY 1"""


@register("x9_hue", fx.TILED + HUED)
def x9_hue(spark, sf):
    return band_means(raster.recoloured(unit_bands(spark, sf), "tile_idx", hue=0.1))


@register("x9_noise")
def x9_noise(spark, sf):
    return band_means(raster.recoloured(unit_bands(spark, sf), "tile_idx", hue=0.1, noise=0.05, seed=3))


def flagged(spark, sf):
    """Cells of tiles with bands 0..1, the target, and every third tile flagged."""
    t = fx.target(spark, sf).select("r", "c", "target").join(fx.wide(spark, sf).select("r", "c", *[(F.col(b) / 255).alias(b) for b in ("b1", "b2", "b3")]), ["r", "c"])
    return fx.tiled(t, spark, sf).withColumn("augment", F.col("tile_idx") % 3 == 0)


@register("x10_policy", fx.TILED + " SELECT t.tile_idx, count(*) AS cells, round(sum(b1 / 255 * target), 6) AS paired, round(sum(b2 / 255), 6) AS g, round(sum(target), 6) AS target, round(sum(CASE WHEN t.tile_idx % 3 <> 0 THEN tr * 32 + tc ELSE 496 + 15.5 END * target), 4) AS place FROM tt t JOIN wide w ON w.r = t.r AND w.c = t.c GROUP BY 1")
def x10_policy(spark, sf):
    """Turns and flips of flagged tiles: bands and targets stay together, tiles without a flag stay where they are."""
    t = raster.augmented(flagged(spark, sf), "tile_idx", 32, "train", 1, raster.Augmentation(color=False))
    t = t.filter("augment").unionByName(raster.augmented(flagged(spark, sf), "tile_idx", 32, "lobe", 1).filter("NOT augment"))
    place = F.when(F.col("augment"), F.lit(511.5)).otherwise(F.col("tr") * 32 + F.col("tc"))
    return t.groupBy("tile_idx").agg(F.count("*").alias("cells"), R(F.sum(F.col("b1") * F.col("target"))).alias("paired"), R(F.sum("b2")).alias("g"), R(F.sum("target")).alias("target"), R(F.sum(place * F.col("target")), 4).alias("place"))


@register("x10_augmented")
def x10_augmented(spark, sf):
    """The whole policy of training: turns, flips and colours of every tile."""
    return raster.augmented(flagged(spark, sf), "tile_idx", 32, "train", 7).select("tile_idx", "tr", "tc", "b1", "b2", "b3", "target")


@register("c1_world_to_cell", "SELECT vec_id AS id, CAST(floor((CAST(embedding[1] AS DOUBLE) * 100 - 50) / -0.5) AS BIGINT) AS r, CAST(floor((CAST(embedding[2] AS DOUBLE) * 100 + 30) / 0.5) AS BIGINT) AS c FROM embeddings")
def c1_world_to_cell(spark, sf):
    e = fx.table(spark, sf, "embeddings")
    r, c = scalar.world_to_cell(F.col("embedding")[1].cast("double") * 100, F.col("embedding")[0].cast("double") * 100, 0.5, -0.5, -30.0, 50.0)
    return e.select(F.col("vec_id").alias("id"), r.alias("r"), c.alias("c"))


@register("c2_normalized", fx.TILED + ", m AS (SELECT avg(x) AS m, stddev_pop(x) AS s FROM emb) SELECT tile_idx, round(avg(b1 / 255), 6) AS rgb, round(avg((x - m) / s), 6) AS standard, round(avg(least(1.0, greatest(0.0, x))), 6) AS clipped, round(avg(x), 6) AS plain FROM tw, m GROUP BY 1")
def c2_normalized(spark, sf):
    stats = fx.emb(spark, sf).agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    t = fx.tiled(fx.wide(spark, sf), spark, sf).crossJoin(F.broadcast(stats))  # one row
    n = lambda c, kind, **k: R(F.avg(scalar.normalized(F.col(c), kind, **k)))
    return t.groupBy("tile_idx").agg(n("b1", "rgb").alias("rgb"), n("x", "standardize", mean=F.col("m"), std=F.col("s")).alias("standard"), n("x", "clip").alias("clipped"), n("x", "none").alias("plain"))


@register("c3_segment_scaled", fx.TILED + f", s AS (SELECT tile_idx, {SEGMENT} AS seg FROM tt), m AS (SELECT tile_idx, max(seg) FILTER (seg <> -9999) AS top FROM s GROUP BY 1) SELECT tile_idx, round(avg(CASE WHEN seg <> -9999 AND top > 0 THEN seg / top ELSE 0.0 END), 6) AS mean FROM s JOIN m USING (tile_idx) GROUP BY 1")
def c3_segment_scaled(spark, sf):
    return raster.segment_scaled(fx.tiled(segments(spark, sf), spark, sf), "tile_idx").groupBy("tile_idx").agg(R(F.avg("scaled")).alias("mean"))


@register("c4_channels", fx.TILED + " SELECT tile_idx, CAST(k AS INTEGER) AS channel, count(*) AS cells, round(sum(CASE k WHEN 0 THEN b1 WHEN 1 THEN b2 WHEN 2 THEN b3 ELSE x END), 6) AS total FROM tw, (SELECT unnest(range(4)) AS k) GROUP BY 1, 2")
def c4_channels(spark, sf):
    layers = spark.createDataFrame([(1, "rgb", 3, True), (2, "slope", 1, False), (3, "dem", 1, True)], "ord int, name string, bands int, enabled boolean")
    t = fx.tiled(fx.wide(spark, sf), spark, sf)
    bands = F.inline(F.array(*[F.struct(F.lit(n).alias("layer"), F.lit(b).alias("band"), F.col(v).alias("value")) for n, b, v in (("rgb", 1, "b1"), ("rgb", 2, "b2"), ("rgb", 3, "b3"), ("dem", 1, "x"))]))
    ch = registry.assembled(t.select("tile_idx", "r", "c", bands), layers)
    return ch.groupBy("tile_idx", "channel").agg(F.count("*").alias("cells"), R(F.sum("value")).alias("total"))


@register("c6_tile_keys", "SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 2 THEN p_name ELSE printf('tile_%04d', p_partkey) END AS key FROM part")
def c6_tile_keys(spark, sf):
    p = fx.table(spark, sf, "part")
    text = F.when(F.col("p_partkey") % 3 == 0, F.col("p_partkey").cast("string")).when(F.col("p_partkey") % 3 == 1, F.format_string(" tile_%04d", "p_partkey")).otherwise(F.col("p_name"))
    return p.select(F.col("p_partkey").alias("id"), scalar.tile_key(text).alias("key"))


@register("c7_tile_labels", fx.ALL + " SELECT tile_idx, printf('%04d', tile_idx) AS label FROM tiles")
def c7_tile_labels(spark, sf):
    return g.tiles(spark, fx.grid(spark, sf)).select("tile_idx", scalar.tile_label(F.col("tile_id")).alias("label"))


# Registries and samples -----------------------------------------------------------------------------


def registered(spark, sf):
    """The registry of the fixture: every sixth tile is missing from the filtered list."""
    listed = statuses(spark, sf).filter("tile_idx % 6 <> 5").select(g.tile_id(F.col("tile_idx")).alias("tile_id"), F.col("rgb_valid"), "has_targets")
    r = registry.with_filtering(g.tiles(spark, fx.grid(spark, sf)), listed)
    m = F.pmod("tile_idx", F.lit(4))
    return r.withColumn("split", F.when(F.col("is_valid"), F.when(m < 2, "train").when(m == 2, "val").otherwise("test")))


REG = f"""{G5}, rg AS (SELECT t.tile_idx, printf('tile_%04d', t.tile_idx) AS tile_id, t.tile_idx % 6 <> 5 AS is_valid, t.tile_idx % 6 <> 5 AND rgb_coverage >= 0.25 AS rgb_valid, t.tile_idx % 6 <> 5 AND target_coverage > 0 AS has_targets,
 CASE WHEN t.tile_idx % 6 <> 5 THEN CASE WHEN t.tile_idx % 4 < 2 THEN 'train' WHEN t.tile_idx % 4 = 2 THEN 'val' ELSE 'test' END END AS split FROM tiles t JOIN g5 USING (tile_idx))"""


@register("j4_registry_join", fx.TILED + f", {REG} SELECT tile_id, is_valid, rgb_valid, has_targets FROM rg")
def j4_registry_join(spark, sf):
    return registered(spark, sf).select("tile_id", "is_valid", "rgb_valid", "has_targets")


@register("b3_registry_filter", fx.TILED + f", {REG} SELECT tile_id FROM rg WHERE is_valid AND split = 'val'")
def b3_registry_filter(spark, sf):
    return registry.selected(registered(spark, sf), True, "val").select("tile_id")


def lit_tiles(spark, sf):
    m = tile_hsv(spark, sf)
    t = qc.illuminated(m, qc.calibrated(m, ambiguous=0.2)).select("tile_idx", F.nullif("illumination", F.lit("ambiguous")).alias("illumination"))
    return t.withColumn("role", F.when(F.col("tile_idx") % 5 == 0, "background").otherwise("lobe"))


LIT = f"{HSV}, q AS (SELECT quantile_cont(mean_value, 0.4) AS low, quantile_cont(mean_value, 0.6) AS high FROM hv), lit AS (SELECT tile_idx, CASE WHEN mean_value < low THEN 'shadow' WHEN mean_value > high THEN 'sun' END AS illumination FROM hv, q)"


@register("b4_illumination_filter", fx.TILED + f", {LIT} SELECT 'strict' AS rule, tile_idx FROM lit WHERE illumination = 'sun' UNION ALL SELECT 'background', tile_idx FROM lit WHERE illumination = 'sun' OR tile_idx % 5 = 0 UNION ALL SELECT 'none', tile_idx FROM lit")
def b4_illumination_filter(spark, sf):
    t = lit_tiles(spark, sf)
    out = None
    for rule, kind, back in (("strict", "sun", False), ("background", "sun", True), ("none", "all", False)):
        one = registry.of_illumination(t, kind, back).select(F.lit(rule).alias("rule"), "tile_idx")
        out = one if out is None else out.unionByName(one)
    return out


@register("b5_inside_boundary", fx.ALL + f", {MEETS} SELECT tile_idx FROM tiles WHERE tile_idx % 9 <> 0 AND tile_idx IN (SELECT pid FROM meets)")
def b5_inside_boundary(spark, sf):
    b = boxes(spark, sf)
    near = vector.at_boundary(b, vector.edges_of(spark, BOUNDARY)).select("tile_idx", F.lit(True).alias("_in"))
    flag = F.when(F.col("tile_idx") % 9 != 0, F.coalesce("_in", F.lit(False)))
    return registry.inside(b.join(near, "tile_idx", "left").withColumn("inside_boundary", flag)).select("tile_idx")


@register("b6_representatives", fx.ALL + " SELECT printf('tile_%04d', tile_idx) AS tile_id FROM tiles WHERE tile_idx IN (3, 17, 40)")
def b6_representatives(spark, sf):
    """Two tiles by index, one by id; the last id is of no grid, however many tiles it has."""
    t = g.tiles(spark, fx.grid(spark, sf)).select("tile_id")
    return registry.representatives(t, [3, 17, "tile_0040", "tile_none"], scalar.tile_number(F.col("tile_id")))


@register("b11_rewritten_paths", "SELECT p_partkey AS id, replace(p_name, 'e', 'EE') AS path, p_name LIKE '%e%' AS changed FROM part")
def b11_rewritten_paths(spark, sf):
    p = fx.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("targets_path"), F.col("p_name").contains("e").alias("changed"))
    return registry.rewritten_paths(p, "e", "EE")[0].select("id", F.col("targets_path").alias("path"), "changed")


@register("b12_proximity_params", fx.TILED + ", p AS (SELECT tile_idx, CASE tile_idx % 4 WHEN 0 THEN 'a/Proximity20/x' WHEN 1 THEN 'b/proximity10_proximity20' WHEN 2 THEN 'c/proximity10' ELSE 'plain' END AS path FROM tiles), m AS (SELECT max(target) AS top FROM tt WHERE tile_idx < 20) SELECT tile_idx, CASE WHEN contains(lower(path), 'proximity20') THEN 20.0 WHEN contains(lower(path), 'proximity10') THEN 10.0 WHEN abs(top - 10) <= 1 THEN 10.0 WHEN abs(top - 20) <= 1 THEN 20.0 ELSE top END::DOUBLE AS reach FROM p, m")
def b12_proximity_params(spark, sf):
    m = F.pmod("tile_idx", F.lit(4))
    path = F.when(m == 0, "a/Proximity20/x").when(m == 1, "b/proximity10_proximity20").when(m == 2, "c/proximity10").otherwise("plain")
    top = fx.tiled(fx.target(spark, sf), spark, sf).filter("tile_idx < 20").agg(F.max("target").alias("top"))
    t = g.tiles(spark, fx.grid(spark, sf)).crossJoin(F.broadcast(top))  # one row
    return t.select("tile_idx", F.coalesce(scalar.proximity_token(path).cast("double"), scalar.snapped_reach(F.col("top"))).alias("reach"))


@register("b13_train_usage", fx.TILED + f", {REG} SELECT tile_id, CASE WHEN tile_idx % 10 = 0 THEN 'background' WHEN NOT is_valid THEN 'excluded' ELSE split END AS train_usage FROM rg")
def b13_train_usage(spark, sf):
    r = registered(spark, sf)
    return registry.train_usage(r, r.filter("tile_idx % 10 = 0")).select("tile_id", "train_usage")


@register("j3_paired_layers", fx.ALL + " SELECT printf('tile_%04d', tile_idx) AS tile_id, (SELECT count(*) FROM tiles) AS total FROM tiles WHERE tile_idx % 7 <> 0")
def j3_paired_layers(spark, sf):
    t = g.tiles(spark, fx.grid(spark, sf)).select("tile_id", "tile_idx")
    pairs, total = registry.paired_layers(t.select("tile_id"), t.filter("tile_idx % 7 <> 0").select("tile_id"))
    return pairs.withColumn("total", F.lit(total).cast("long"))


@register("j5_excluded", fx.TILED + f", {G5} SELECT printf('tile_%04d', tile_idx) AS tile_id FROM g5 WHERE status <> 'valid'")
def j5_excluded(spark, sf):
    t = g.tiles(spark, fx.grid(spark, sf)).select("tile_id")
    return registry.excluded(t, statuses(spark, sf).filter("status = 'valid'").select(g.tile_id(F.col("tile_idx")).alias("tile_id")))


@register("j12_tag_counts", fx.TILED + f", {LIT} SELECT illumination, count(*) AS n FROM lit GROUP BY 1")
def j12_tag_counts(spark, sf):
    return registry.tagged(g.tiles(spark, fx.grid(spark, sf)), lit_tiles(spark, sf).drop("role"), "tile_idx")[1]


@register("j13_upserted_metrics", fx.ALL + " SELECT printf('tile_%04d', tile_idx) AS tile_id, run_id, CASE WHEN run_id = 2 AND tile_idx % 2 = 0 THEN CASE WHEN tile_idx % 4 = 0 THEN 0.0 ELSE 0.5 END ELSE 1.0 END::DOUBLE AS mae FROM tiles, (SELECT unnest([1, 2]) AS run_id)")
def j13_upserted_metrics(spark, sf):
    t = g.tiles(spark, fx.grid(spark, sf)).select("tile_id", "tile_idx")
    old = t.select("tile_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("run_id"), F.lit(1.0).alias("mae"))
    new = t.filter("tile_idx % 2 = 0").select("tile_id", F.lit(2).alias("run_id"), F.when(F.col("tile_idx") % 4 != 0, 0.5).alias("mae"))
    stranger = new.limit(1).withColumn("tile_id", F.lit("tile_unknown"))
    return registry.upserted_metrics(old, new.unionByName(stranger), t)


@register("s1_split", fx.ALL + ", n AS (SELECT count(*) AS n FROM tiles) SELECT 'train' AS split, CAST(floor(n * 0.7) AS BIGINT) AS tiles FROM n UNION ALL SELECT 'val', CAST(floor(n * 0.15) AS BIGINT) FROM n UNION ALL SELECT 'test', n - CAST(floor(n * 0.7) AS BIGINT) - CAST(floor(n * 0.15) AS BIGINT) FROM n")
def s1_split(spark, sf):
    return sampling.split(g.tiles(spark, fx.grid(spark, sf)), 0.7, 0.15, 0.15).groupBy("split").agg(F.count("*").alias("tiles"))


@register("s2_registry_split", fx.TILED + f", {REG}, n AS (SELECT count(*) AS n FROM rg WHERE is_valid) SELECT 'train' AS split, CAST(floor(n * 0.6) AS BIGINT) AS tiles FROM n UNION ALL SELECT 'val', CAST(floor(n * 0.2) AS BIGINT) FROM n UNION ALL SELECT 'test', n - CAST(floor(n * 0.6) AS BIGINT) - CAST(floor(n * 0.2) AS BIGINT) FROM n UNION ALL SELECT NULL, (SELECT count(*) FROM rg WHERE NOT is_valid) FROM n")
def s2_registry_split(spark, sf):
    r = registered(spark, sf).drop("split")
    s = sampling.split(r.filter("is_valid").select("tile_id"), 0.6, 0.2, 0.2)
    return r.join(s, "tile_id", "left").groupBy("split").agg(F.count("*").alias("tiles"))


@register("s3_capped", fx.ALL + " SELECT CAST(30 AS BIGINT) AS tiles, CAST(3 AS BIGINT) AS representatives FROM len")
def s3_capped(spark, sf):
    t = g.tiles(spark, fx.grid(spark, sf))
    c = sampling.capped(t, 30, t.filter("tile_idx IN (1, 2, 60)"))
    return c.agg(F.count("*").alias("tiles"), F.count_if(F.col("tile_idx").isin(1, 2, 60)).alias("representatives"))


@register("s4_epoch_sample", fx.ALL + " SELECT e AS epoch, CAST(floor((SELECT count(*) FROM tiles) * 0.25) AS BIGINT) AS tiles FROM (SELECT unnest([1, 2]) AS e)")
def s4_epoch_sample(spark, sf):
    t = g.tiles(spark, fx.grid(spark, sf))
    one = lambda e: sampling.epoch_sample(t, 0.25, e).agg(F.lit(e).alias("epoch"), F.count("*").alias("tiles"))
    return one(1).unionByName(one(2))


@register("s5_extended", fx.TILED + f", {G5}, n AS (SELECT count(*) FILTER (status = 'valid') AS v, count(*) FILTER (status <> 'valid') AS b FROM g5) SELECT 'lobe' AS role, v AS tiles FROM n UNION ALL SELECT 'background', least(b, 7) FROM n UNION ALL SELECT 'augmented_lobe', v FROM n")
def s5_extended(spark, sf):
    s = statuses(spark, sf).select(g.tile_id(F.col("tile_idx")).alias("tile_id"), "status")
    return sampling.extended(s.filter("status = 'valid'"), s.filter("status <> 'valid'"), n_background=7).groupBy("role").agg(F.count("*").alias("tiles"))


@register("s6_extended_rotations", fx.TILED + f", {G5}, n AS (SELECT count(*) FILTER (status = 'valid') AS v, count(*) FILTER (status <> 'valid') AS b FROM g5) SELECT 'lobe' AS role, v AS tiles FROM n UNION ALL SELECT 'augmented_lobe', 4 * CAST(floor(v * 0.1) AS BIGINT) FROM n UNION ALL SELECT 'background', least(b, CAST(floor(0.1 * (v + 4 * CAST(floor(v * 0.1) AS BIGINT)) + 0.5) AS BIGINT)) FROM n")
def s6_extended_rotations(spark, sf):
    s = statuses(spark, sf).select(g.tile_id(F.col("tile_idx")).alias("tile_id"), "status", F.lit("sun").alias("illumination"))
    return sampling.extended_rotations(s.filter("status = 'valid'"), s.filter("status <> 'valid'"), 0.1, 0.1).groupBy("role").agg(F.count("*").alias("tiles"))


COPIES = f"""n AS (SELECT tile_idx, w.r, w.c, b1 / 255 AS r, b2 / 255 AS g, b3 / 255 AS b FROM tw w), m AS (SELECT *, avg({GRAY}) OVER (PARTITION BY tile_idx) AS m FROM n), {step_sql('k', 'm', '1.1 * x + (1 - 1.1) * m')},
y AS (SELECT *, {GRAY} AS y FROM k), {step_sql('s', 'y', '0.9 * x + (1 - 0.9) * y')},
colour AS (SELECT tile_idx, CAST(sum(floor(round(255 * r, 9))) AS DOUBLE) AS b1, CAST(sum(floor(round(255 * b, 9))) AS DOUBLE) AS b3 FROM s GROUP BY 1),
place AS (SELECT tile_idx, turn, CAST(sum(target * CASE turn WHEN 0 THEN tr * 32 + tc WHEN 1 THEN (31 - tc) * 32 + tr WHEN 2 THEN (31 - tr) * 32 + 31 - tc ELSE tc * 32 + 31 - tr END) AS DOUBLE) AS place FROM tt, (SELECT CAST(unnest(range(4)) AS INTEGER) AS turn) GROUP BY 1, 2)"""


@register("s6_extended_copies", fx.TILED + f", {COPIES.replace('w.r, w.c, ', '')} SELECT tile_idx, turn, b1, b3, place FROM place JOIN colour USING (tile_idx)")
def s6_extended_copies(spark, sf):
    """The four written copies of every tile, with one contrast and saturation for all."""
    t = fx.tiled(fx.target(spark, sf).select("r", "c", "target").join(fx.wide(spark, sf).drop("x"), ["r", "c"]), spark, sf)
    copies = raster.extended_copies(t, "tile_idx", 32, 1, (1.1, 1.1), (0.9, 0.9))
    return copies.groupBy("tile_idx", "turn").agg(F.sum("b1").alias("b1"), F.sum("b3").alias("b3"), F.sum(F.col("target") * (F.col("tr") * 32 + F.col("tc"))).alias("place"))


@register("s7_background_ids", fx.TILED + f", {G5} SELECT least(count(*), 5) AS tiles FROM g5 WHERE status <> 'valid'")
def s7_background_ids(spark, sf):
    s = statuses(spark, sf).select(g.tile_id(F.col("tile_idx")).alias("tile_id"), "status")
    e = sampling.extended(s.filter("status = 'valid'"), s.filter("status <> 'valid'"), n_background=5)
    return e.filter("role = 'background'").agg(F.count("*").alias("tiles"))


@register("s8_fallback", fx.ALL + " SELECT tile_idx FROM tiles ORDER BY tile_idx LIMIT 4")
def s8_fallback(spark, sf):
    t = g.tiles(spark, fx.grid(spark, sf)).select("tile_idx", "tile_id")
    return sampling.first_or(t.filter("tile_id = 'none'"), t, 4).select("tile_idx")


@register("s9_set_operations", fx.ALL + " SELECT 'both' AS op, count(*) FILTER (tile_idx % 2 = 0 AND tile_idx % 3 = 0) AS n FROM tiles UNION ALL SELECT 'first', count(*) FILTER (tile_idx % 2 = 0 AND tile_idx % 3 <> 0) FROM tiles UNION ALL SELECT 'any', count(*) FILTER (tile_idx % 2 = 0 OR tile_idx % 3 = 0) FROM tiles")
def s9_set_operations(spark, sf):
    t = g.tiles(spark, fx.grid(spark, sf)).select("tile_id", "tile_idx")
    a, b = t.filter("tile_idx % 2 = 0").select("tile_id"), t.filter("tile_idx % 3 = 0").select("tile_id")
    count = lambda name, df: df.agg(F.lit(name).alias("op"), F.count("*").alias("n"))
    return count("both", a.intersect(b)).unionByName(count("first", a.subtract(b))).unionByName(count("any", a.union(b).distinct()))


@register("a7_tile_index", fx.ALL + " SELECT count(*) AS features, CAST(sum(length(CAST(tile_idx AS VARCHAR))) AS BIGINT) AS digits FROM tiles")
def a7_tile_index(spark, sf):
    """Features written as GeoJSON text and read again."""
    f = documents.tile_index(boxes(spark, sf), ["tile_idx", "tile_id"])
    back = f.select(F.from_json("value", "type string, properties struct<tile_idx:bigint,tile_id:string>, geometry struct<coordinates:array<array<array<double>>>>").alias("f"))
    return back.filter("f.type = 'Feature' AND size(f.geometry.coordinates[0]) = 5").agg(F.count("*").alias("features"), F.sum(F.length(F.col("f.properties.tile_idx").cast("string"))).alias("digits"))


@register("a8_illumination_layer", fx.TILED + f", {LIT} SELECT tile_idx, illumination FROM lit WHERE illumination IS NOT NULL")
def a8_illumination_layer(spark, sf):
    t = boxes(spark, sf).join(lit_tiles(spark, sf), "tile_idx").filter("illumination IS NOT NULL")
    f = documents.tile_index(t, ["tile_idx", "illumination"])
    return f.select(F.from_json("value", "properties struct<tile_idx:bigint,illumination:string>").alias("f")).select("f.properties.*")


# Stencils -------------------------------------------------------------------------------------------

AROUND = "nb AS (SELECT e.r, e.c, e.{v} AS v, n.{v} AS n, s.{v} AS s, w.{v} AS w, k.{v} AS e FROM {t} e LEFT JOIN {t} n ON n.r = e.r - 1 AND n.c = e.c LEFT JOIN {t} s ON s.r = e.r + 1 AND s.c = e.c LEFT JOIN {t} w ON w.r = e.r AND w.c = e.c - 1 LEFT JOIN {t} k ON k.r = e.r AND k.c = e.c + 1)"


@register("w11_borders", fx.ALL + f", sg AS (SELECT r, c, {SEGMENT} AS seg FROM emb), {AROUND.format(v='seg', t='sg')} SELECT r, count(*) FILTER (v <> -9999 AND ((n <> v AND n <> -9999) OR (s <> v AND s <> -9999) OR (w <> v AND w <> -9999) OR (e <> v AND e <> -9999))) AS borders FROM nb GROUP BY 1")
def w11_borders(spark, sf):
    return stencil.borders(segments(spark, sf)).groupBy("r").agg(F.count_if("border").alias("borders"))


BEARING = "CASE WHEN dy = 0 AND dx >= 0 THEN -pi() WHEN dy = 0 THEN 0.0 ELSE atan2(-dy, -dx) END"
SLOPES = "sl AS (SELECT r, c, coalesce((lead(x) OVER down - lag(x) OVER down) / 2, 0.0) AS dy, coalesce((lead(x) OVER along - lag(x) OVER along) / 2, 0.0) AS dx FROM emb WINDOW down AS (PARTITION BY c ORDER BY r), along AS (PARTITION BY r ORDER BY c))"


@register("w12_aspect", fx.CELLS + f", {SLOPES} SELECT r, c, any_value(round({BEARING}, 5) + 0.0) AS aspect FROM sl GROUP BY r, c")
def w12_aspect(spark, sf):
    a = stencil.aspect(fx.emb(spark, sf).withColumnRenamed("x", "value"))
    return a.select("r", "c", (R("aspect", 5) + 0.0).alias("aspect"))


def smooth_sql(name: str, source: str, columns: list[str], sigma: float) -> str:
    """name(r, c, columns): two passes of taps over the source, with edges repeated."""
    taps = stencil.gaussian_taps(sigma).tolist()
    values = ", ".join(f"({k - len(taps) // 2}, {w!r}::DOUBLE)" for k, w in enumerate(taps))
    sums = ", ".join(f"sum(g.w * p.{x}) AS {x}" for x in columns)
    clamp = "greatest(0, least((SELECT max(vec_id) FROM embeddings), q.r + g.t))"
    return (
        f"{name}_g AS (SELECT * FROM (VALUES {values}) v(t, w)), {name}_a AS (SELECT q.r, q.c, {sums} FROM {source} q, {name}_g g, {source} p WHERE p.c = q.c AND p.r = {clamp} GROUP BY 1, 2), "
        f"{name} AS (SELECT q.r, q.c, {sums} FROM {name}_a q, {name}_g g, {name}_a p WHERE p.r = q.r AND p.c = greatest(0, least(63, q.c + g.t)) GROUP BY 1, 2)"
    )


@register("x2_smoothed", fx.CELLS + f", {smooth_sql('s', 'emb', ['x'], 1.0)} SELECT r, c, round(x, 6) AS value FROM s")
def x2_smoothed(spark, sf):
    v = fx.emb(spark, sf).withColumnRenamed("x", "value")
    return rounded(stencil.smoothed(v, fx.height(spark, sf), 64, 1.0), "value")


@register("x3_sobel", fx.ALL + ", y AS (SELECT r, c, (0.299 * b1 + 0.587 * b2 + 0.114 * b3) / 255 AS v FROM wide), h AS (SELECT max(r) AS h FROM y), d AS (SELECT a.k AS dr, b.k AS dc FROM (SELECT unnest([-1, 0, 1]) AS k) a, (SELECT unnest([-1, 0, 1]) AS k) b) SELECT y.r, y.c, round(sum(p.v * dc * CASE WHEN dr = 0 THEN 2 ELSE 1 END), 5) + 0.0 AS gx, round(sum(p.v * dr * CASE WHEN dc = 0 THEN 2 ELSE 1 END), 5) + 0.0 AS gy FROM y, d, h, y p WHERE p.r = greatest(0, least(h, y.r + dr)) AND p.c = greatest(0, least(63, y.c + dc)) GROUP BY 1, 2")
def x3_sobel(spark, sf):
    v = fx.wide(spark, sf).select("r", "c", stencil.gray(F.col("b1"), F.col("b2"), F.col("b3")).alias("value"))
    s = rounded(stencil.sobel(v), "gx", "gy", n=5)
    return s.withColumns({"gx": F.col("gx") + 0.0, "gy": F.col("gy") + 0.0})


GRAD = """d AS (SELECT CAST(unnest([-1, 0, 1]) AS BIGINT) AS k),
gr AS (SELECT y.r, y.c, sum(p.v * b.k * (2 - abs(a.k))) AS gx, sum(p.v * a.k * (2 - abs(b.k))) AS gy FROM s1 y, d a, d b, s1 p WHERE p.r = greatest(0, least((SELECT max(vec_id) FROM embeddings), y.r + a.k)) AND p.c = greatest(0, least(63, y.c + b.k)) GROUP BY 1, 2),
j AS (SELECT r, c, gx * gx AS xx, gy * gy AS yy, gx * gy AS xy FROM gr)"""
TENSOR = (
    fx.CELLS + f", {fx.RGB}, y0 AS (SELECT r, c, (0.299 * b1 + 0.587 * b2 + 0.114 * b3) / 255 AS v FROM wide), {smooth_sql('s1', 'y0', ['v'], 1.5)}, {GRAD}, {smooth_sql('s2', 'j', ['xx', 'yy', 'xy'], 2.0)}, {SLOPES}, asp AS (SELECT r, c, {BEARING} AS aspect FROM sl),"
    " t AS (SELECT r, c, least(1.0, sqrt((xx - yy) * (xx - yy) + 4 * xy * xy) / (xx + yy + 1e-12)) AS coherence, atan2(2 * xy, xx - yy + 1e-12) + pi() / 2 AS angle FROM s2)"
    " SELECT t.r, t.c, round(coherence, 4) AS coherence, round(least(1.0, coherence * pow(greatest((cos(angle - aspect) + 1) / 2, 1e-12), {power})), 4) AS stripes FROM t JOIN asp ON asp.r = t.r AND asp.c = t.c"
)


def grays(spark, sf):
    return fx.wide(spark, sf).select("r", "c", stencil.gray(F.col("b1"), F.col("b2"), F.col("b3")).alias("value"))


def dem(spark, sf):
    return fx.emb(spark, sf).withColumnRenamed("x", "value")


@register("x4_texture", TENSOR.format(power=1.0))
def x4_texture(spark, sf):
    return rounded(stencil.texture(grays(spark, sf), dem(spark, sf), fx.height(spark, sf), 64).select("r", "c", "coherence", "stripes"), "coherence", "stripes", n=4)


def taps_sql(frequency: float, sigma: float, n: int) -> str:
    """k, dr, dc, re, im of the bank's kernels, as text of numbers."""
    out = []
    for k in range(n):
        kernel = stencil.gabor_kernel(math.pi * k / n, frequency, sigma)
        reach = kernel.shape[0] // 2
        out += [f"({k}, {i - reach}, {j - reach}, {z.real!r}::DOUBLE, {z.imag!r}::DOUBLE)" for i, row in enumerate(kernel.tolist()) for j, z in enumerate(row)]
    return f"tap AS MATERIALIZED (SELECT * FROM (VALUES {', '.join(out)}) v(k, dr, dc, re, im))"


def mirror_sql(x: str, n: str) -> str:
    return f"CASE WHEN {x} < 0 THEN -1 - ({x}) WHEN {x} >= {n} THEN 2 * {n} - 1 - ({x}) ELSE {x} END"


#: Six orientations of a short kernel: the statement has every tap of every cell.
SHORT = {"frequency": 0.15, "sigma": 1.0, "orientations": 6}
GABOR = f"""y0 AS (SELECT r, c, (0.299 * b1 + 0.587 * b2 + 0.114 * b3) / 255 AS v FROM wide), {taps_sql(0.15, 1.0, 6)}, hh AS (SELECT max(vec_id) + 1 AS h FROM embeddings),
s AS (SELECT q.r, q.c, k, sqrt(sum(re * p.v) ** 2 + sum(im * p.v) ** 2) AS m FROM y0 q, tap, hh, y0 p WHERE p.r = {mirror_sql('q.r + dr', 'h')} AND p.c = {mirror_sql('q.c + dc', '64')} GROUP BY 1, 2, 3),
best AS (SELECT r, c, max(m) AS m FROM s GROUP BY 1, 2), first AS (SELECT r, c, any_value(best.m) AS m, min(k) AS k FROM s JOIN best USING (r, c) WHERE s.m >= best.m - 1e-9 GROUP BY 1, 2),
{SLOPES}, asp AS (SELECT r, c, {BEARING} AS aspect FROM sl), t AS (SELECT r, c, m / (SELECT max(m) FROM best) AS strength, k * pi() / 6 + pi() / 2 AS angle FROM first)
SELECT t.r, t.c, round(strength, 5) AS strength, round(angle, 5) AS angle, round(least(1.0, strength * greatest((cos(angle - aspect) + 1) / 2, 1e-12)), 5) AS stripes FROM t JOIN asp ON asp.r = t.r AND asp.c = t.c"""


@register("x5_gabor_short", fx.CELLS + f", {fx.RGB}, {GABOR}")
def x5_gabor_short(spark, sf):
    """A bank of short kernels, whose every tap SQL can write out."""
    got = stencil.gabor_stripes(fx.cells(spark, sf).drop("raster_id"), dem(spark, sf), **SHORT)
    return rounded(got.select("r", "c", "strength", "angle", "stripes"), "strength", "angle", "stripes", n=5)


@register("x5_gabor")
def x5_gabor(spark, sf):
    return stencil.gabor_stripes(fx.cells(spark, sf).drop("raster_id"), dem(spark, sf))


@register("x6_derived", fx.ALL + ", y AS (SELECT r, c, (b1 + b2 + b3) / 3 AS v FROM wide), h AS (SELECT max(r) AS h FROM y), d AS (SELECT a.k AS dr, b.k AS dc FROM (SELECT unnest([-1, 0, 1]) AS k) a, (SELECT unnest([-1, 0, 1]) AS k) b) SELECT y.r, y.c, round(avg(p.v), 5) AS value FROM y, d, h, y p WHERE p.r = greatest(0, least(h, y.r + dr)) AND p.c = greatest(0, least(63, y.c + dc)) GROUP BY 1, 2")
def x6_derived(spark, sf):
    return rounded(stencil.derived({"rgb": fx.cells(spark, sf).drop("raster_id")}, "mean3"), "value", n=5)


#: Every cell takes the least label beside it until none changes.
REGIONS = """v AS MATERIALIZED (SELECT r, c, r * 4294967296 + c AS k FROM wide WHERE least(b1, b2, b3) < 250 AND b1 <> 0 AND b2 <> 0 AND b3 <> 0 AND b1 > 60),
side AS MATERIALIZED (SELECT a.k AS a, b.k AS b FROM v a JOIN v b ON b.r = a.r AND b.c = a.c + 1 UNION ALL SELECT a.k, b.k FROM v a JOIN v b ON b.r = a.r + 1 AND b.c = a.c),
beside AS MATERIALIZED (SELECT a, b FROM side UNION ALL SELECT b, a FROM side),
lab(k, l) USING KEY (k) AS (SELECT k, k AS l FROM v UNION SELECT s.b AS k, min(n.l) AS l FROM lab n JOIN beside s ON s.a = n.k JOIN recurring.lab o ON o.k = s.b WHERE n.l < o.l GROUP BY s.b),
within AS (SELECT l, count(*) AS n FROM side JOIN lab ON side.a = lab.k GROUP BY 1)
SELECT l // 4294967296 AS first_r, l % 4294967296 AS first_c, count(*) AS area, min(r) AS r0, max(r) AS r1, min(c) AS c0, max(c) AS c1, 4 * count(*) - 2 * coalesce(any_value(n), 0) AS border_edges
FROM v JOIN lab USING (k) LEFT JOIN within USING (l) GROUP BY l"""


@register("x7_regions", fx.CELLS.replace("WITH", "WITH RECURSIVE", 1) + f", {fx.RGB}, {REGIONS}")
def x7_regions(spark, sf):
    return stencil.regions(fx.wide(spark, sf).filter(qc.valid_mask(250, 0.0) & (F.col("b1") > 60)).select("r", "c"))


def swept(df, channel: str, parameter):
    e = F.col("stripes")
    return df.groupBy(F.lit(channel).alias("channel"), parameter.alias("parameter")).agg(F.avg(e).alias("mean"), F.min(e).alias("min"), F.max(e).alias("max"))


@register("g28_sweep")
def g28_sweep(spark, sf):
    """Mean, least and greatest of the texture channel for each structure sigma, and of the Gabor channel for each power of the alignment."""
    sigmas = (1.0, 2.0, 3.0)
    stripes = lambda k: stencil.along_slope(F.col(f"coherence_{k}"), F.col(f"angle_{k}"), 1.0)
    each = F.inline(F.array(*[F.struct(F.lit(sigma).alias("sigma"), stripes(k).alias("stripes")) for k, sigma in enumerate(sigmas)]))
    out = swept(stencil.texture_sweep(grays(spark, sf), dem(spark, sf), 1.5, sigmas).select(each), "texture", F.col("sigma"))
    bank = stencil.gabor_stripes(fx.cells(spark, sf).drop("raster_id"), dem(spark, sf), frequency=0.15, sigma=5.0)
    powers = bank.withColumn("power", F.explode(F.array(*[F.lit(p) for p in (0.0, 0.25, 0.5, 0.75, 1.0)])))
    return out.unionByName(swept(powers.withColumn("stripes", stencil.along_slope(F.col("strength"), F.col("angle"), F.col("power"))), "gabor", F.col("power")))
