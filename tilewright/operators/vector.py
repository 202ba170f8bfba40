"""Polygons as edges: masks on rasters, points in polygons, tiles at boundaries, covered areas.

edges: poly_id, ring_id, edge_seq, x1, y1, x2, y2. Rasters are north up with cell size 1 at (0, 0): x is
the column and -y the row of a cell's upper left corner.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tilewright.shared import new_path

EDGES = pa.schema([("poly_id", pa.int64()), ("ring_id", pa.int64()), ("edge_seq", pa.int64()), *((c, pa.float64()) for c in ("x1", "y1", "x2", "y2"))])


def edges_of(spark: SparkSession, polygons: dict[int, list[list[tuple[float, float]]]]) -> DataFrame:
    """The edges of polygons given as literals, as an Arrow table, whose size the optimizer knows (and so when to broadcast it)."""
    rows = [(p, r, k, *map(float, a), *map(float, b)) for p, rings in polygons.items() for r, pts in enumerate(rings) for k, (a, b) in enumerate(zip(pts, pts[1:] + pts[:1], strict=True))]
    return spark.createDataFrame(pa.table(list(zip(*rows, strict=True)) or [()] * len(EDGES), schema=EDGES))


def mask(edges: DataFrame, height: int, width: int) -> DataFrame:
    """poly_id, r, c of cells whose centre a polygon holds.

    Each edge meets only the rows it spans; the crossings of a row, paired in order, give spans of
    columns, so the cost follows the covered cells.
    """
    top, low = F.greatest("y1", "y2"), F.least("y1", "y2")
    # Row r has its centres at y = -(r + 0.5); an edge counts where low <= y < top.
    first, last = F.greatest(F.floor(-top - 0.5) + 1, F.lit(0)), F.least(F.floor(-low - 0.5), F.lit(height - 1))
    rows = edges.filter("y1 <> y2").withColumn("_f", first).withColumn("_l", last).filter("_f <= _l").withColumn("r", F.explode(F.sequence("_f", "_l")))
    y = -(F.col("r") + 0.5)
    x = F.col("x1") + (y - F.col("y1")) / (F.col("y2") - F.col("y1")) * (F.col("x2") - F.col("x1"))
    w = Window.partitionBy("poly_id", "r").orderBy("x")
    spans = rows.select("poly_id", "r", x.alias("x")).withColumn("n", F.row_number().over(w)).withColumn("x2", F.lead("x").over(w)).filter("n % 2 = 1")
    a, b = F.greatest(F.ceil(F.col("x") - 0.5), F.lit(0)), F.least(F.ceil(F.col("x2") - 0.5) - 1, F.lit(width - 1))
    return spans.select("poly_id", "r", a.alias("a"), b.alias("b")).filter("a <= b").select("poly_id", "r", F.explode(F.sequence("a", "b")).alias("c")).distinct()


def touched(edges: DataFrame, height: int, width: int) -> DataFrame:
    """mask and the cells that an edge passes through."""
    lo, hi = F.least("y1", "y2"), F.greatest("y1", "y2")
    r = F.sequence(F.greatest(F.floor(-hi), F.lit(0)), F.least(F.floor(-lo), F.lit(height - 1)))
    e = edges.filter((-lo >= 0) & (-hi < height)).withColumn("r", F.explode(r))
    # The part of the edge within the row's band of y.
    dy = F.col("y2") - F.col("y1")
    at = lambda y: F.col("x1") + F.when(dy == 0, 0.0).otherwise((F.greatest(lo, F.least(hi, y)) - F.col("y1")) / F.when(dy == 0, 1.0).otherwise(dy)) * (F.col("x2") - F.col("x1"))
    xa, xb = at(-F.col("r").cast("double")), at(-F.col("r") - 1.0)
    flat = dy == 0
    a = F.when(flat, F.least("x1", "x2")).otherwise(F.least(xa, xb))
    b = F.when(flat, F.greatest("x1", "x2")).otherwise(F.greatest(xa, xb))
    cells = e.select("poly_id", "r", F.greatest(F.floor(a), F.lit(0)).alias("a"), F.least(F.floor(b), F.lit(width - 1)).alias("b")).filter("a <= b")
    return mask(edges, height, width).unionByName(cells.select("poly_id", "r", F.explode(F.sequence("a", "b")).alias("c"))).distinct()


def holders(points: DataFrame, edges: DataFrame, side: float = 32.0, levels: int = 4) -> DataFrame:
    """pid, poly_id of the polygons that hold points (pid, x, y): an odd number of edges crosses the ray to the left.

    Points meet the edges of their own square cell only; what lies left of the cell is known from its
    border, so cells that a polygon covers wholly are answered without any edge. Cells with many
    edges are cut into smaller ones, in which the polygons' parts are looked at in the same way.
    """
    cover = _cover(edges, side)
    pieces, left, _ = cover
    p = points.filter("x IS NOT NULL AND y IS NOT NULL").withColumns({"_cr": _cell("y", side), "_cc": _cell("x", side)})
    dense = _dense(edges, pieces) if levels else None
    here = p if dense is None else p.join(dense, ["_cr", "_cc"], "left_anti")
    x = F.col("x1") + (F.col("y") - F.col("y1")) * F.col("m")
    inner = here.join(pieces, ["_cr", "_cc"]).filter((F.col("p") <= F.col("y")) & (F.col("y") < F.col("q")) & (x <= F.col("x"))).select("pid", "poly_id")
    border = here.withColumnRenamed("y", "_y").join(left, ["_cr", "_cc"]).filter("y <= _y").select("pid", "poly_id")
    found = inner.unionByName(border).groupBy("pid", "poly_id").agg(F.count("*").alias("n")).filter("n % 2 = 1").select("pid", "poly_id")
    if dense is None:
        return found
    inside = p.join(dense, ["_cr", "_cc"], "left_semi").select("pid", "x", "y")
    return found.unionByName(holders(inside, _clipped(dense, edges, cover, side), side / SPLIT, levels - 1))


def boxes_at_edges(boxes: DataFrame, edges: DataFrame, bin_size: float = 64.0) -> DataFrame:
    """pid of boxes (pid, minx, miny, maxx, maxy) that an edge touches, by clipping the edge to the box.

    Both meet in square bins: a box in all that it covers, an edge only in those that it passes, so neither
    a long edge nor a band of many tiles is one bin. ``bin_size`` is best about the side of a box.
    """
    bins = lambda a, b: F.explode(F.sequence(F.floor(a / bin_size), F.floor(b / bin_size)))
    b = boxes.withColumn("_bin", bins(F.col("miny"), F.col("maxy"))).withColumn("_col", bins(F.col("minx"), F.col("maxx")))
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    e = edges.withColumn("_bin", bins(low, high))
    # The x of the edge within its bin's band of y, a little wider, so that rounding loses no bin; a flat edge, in two bands
    # at most, has its whole x in both. The clip is exact.
    slope = (F.col("x2") - F.col("x1")) / F.when(high - low > bin_size, F.col("y2") - F.col("y1"))
    at = lambda y: F.col("x1") + (F.greatest(low, F.least(high, y)) - F.col("y1")) * slope
    xa, xb = at(F.col("_bin") * bin_size), at((F.col("_bin") + 1) * bin_size)
    wide = F.lit(bin_size / 1024)
    left, right = F.coalesce(F.least(xa, xb), F.least("x1", "x2")) - wide, F.coalesce(F.greatest(xa, xb), F.greatest("x1", "x2")) + wide
    e = e.withColumn("_col", bins(left, right))
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")

    def clip(p: Column, q: Column, lo: Column, hi: Column) -> tuple[Column, Column]:
        """Liang-Barsky: the part of the edge on the inner side of one border; an empty one has lo > hi."""
        t = q / F.when(p != 0, p)
        lo2 = F.when(p < 0, F.greatest(lo, t)).when((p == 0) & (q < 0), F.lit(2.0)).otherwise(lo)
        return lo2, F.when(p > 0, F.least(hi, t)).otherwise(hi)

    j = b.join(e, ["_bin", "_col"]).withColumns({"_lo": F.lit(0.0), "_hi": F.lit(1.0)})
    for p, q in ((-dx, F.col("x1") - F.col("minx")), (dx, F.col("maxx") - F.col("x1")), (-dy, F.col("y1") - F.col("miny")), (dy, F.col("maxy") - F.col("y1"))):
        lo, hi = clip(p, q, F.col("_lo"), F.col("_hi"))
        j = j.withColumns({"_lo": lo, "_hi": hi})
    return j.filter("_lo <= _hi").select("pid").distinct()


def at_boundary(tiles: DataFrame, edges: DataFrame, key: str = "tile_idx") -> DataFrame:
    """Tiles whose box meets the boundary, touching included. Tiles without bounds stay; without a boundary all stay."""
    if edges.isEmpty():
        return tiles
    box = tiles.filter("minx IS NOT NULL").select(F.col(key).alias("pid"), "minx", "miny", "maxx", "maxy")
    corners = box.select("pid", F.col("minx").alias("x"), F.col("miny").alias("y"))
    meets = boxes_at_edges(box, edges).unionByName(holders(corners, edges).select("pid")).distinct()
    near = tiles.join(meets, tiles[key] == meets["pid"], "left_semi")
    return near.unionByName(tiles.filter("minx IS NULL"))


def first_holder(points: DataFrame, edges: DataFrame, labels: DataFrame) -> DataFrame:
    """pid, label of the first polygon in file order that holds the point; 'ambiguous' without one or for an unknown text. labels: poly_id, text."""
    t = F.lower(F.trim("text"))
    named = labels.select("poly_id", F.when(t.isin("sun", "sunny", "lit"), "sun").when(t.isin("shadow", "shade", "dark"), "shadow").otherwise("ambiguous").alias("label"))
    found = holders(points, edges).join(named, "poly_id").groupBy("pid").agg(F.min_by("label", "poly_id").alias("label"))
    return points.select("pid").join(found, "pid", "left").select("pid", F.coalesce("label", F.lit("ambiguous")).alias("label"))


#: Cells of the sweep start at this share of their side, so that corners of polygons are hardly ever on their borders.
SHIFT = (3 - 5**0.5) / 2


def _cell(v: Column | str, side: float) -> Column:
    return F.floor(((F.col(v) if isinstance(v, str) else v) - side * SHIFT) / side)


def _line(k: Column, side: float) -> Column:
    """The lower border of cell k."""
    return k * F.lit(side) + F.lit(side * SHIFT)


def _cover(edges: DataFrame, side: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Polygons in square cells: pieces (_cr, _cc, poly_id, p, q, x1, y1, m: the part of an edge from y = p to y = q), and what tells how much of a cell's left border lies inside: left (_cr, _cc, poly_id, y), where the border changes sides upwards; y = -inf for a lower left corner inside; and level (_cr, poly_id, x, to: the stretches inside along the lower border of a row of cells).

    A cell with a corner inside and no edge is inside as a whole.
    """
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    slope = (F.col("x2") - F.col("x1")) / F.when(F.col("y1") != F.col("y2"), F.col("y2") - F.col("y1"))
    e = edges.select("poly_id", "x1", "y1", "x2", "y2", slope.alias("m"))
    at = lambda y: F.col("x1") + (y - F.col("y1")) * F.col("m")
    y_at = lambda x: F.col("y1") + (x - F.col("x1")) / F.when(F.col("m") != 0, F.col("m"))
    span = lambda a, b: F.explode(F.sequence(_cell(a, side), _cell(b, side)))

    # The part of each edge in each cell that it passes: from y = p to y = q.
    rows = e.filter("m IS NOT NULL").withColumn("_cr", span(low, high)).withColumns({"_p": F.greatest(low, _line(F.col("_cr"), side)), "_q": F.least(high, _line(F.col("_cr") + 1, side))})
    rows = rows.withColumn("_cc", span(F.least(at(F.col("_p")), at(F.col("_q"))), F.greatest(at(F.col("_p")), at(F.col("_q")))))
    u, v = y_at(_line(F.col("_cc"), side)), y_at(_line(F.col("_cc") + 1, side))
    pieces = rows.withColumns({"p": F.when(F.col("m") == 0, F.col("_p")).otherwise(F.greatest("_p", F.least(u, v))), "q": F.when(F.col("m") == 0, F.col("_q")).otherwise(F.least("_q", F.greatest(u, v)))})
    pieces = pieces.filter("p < q").select("_cr", "_cc", "poly_id", "p", "q", "x1", "y1", "m")

    # Edges that cross the left border of a cell, and lower left corners inside a polygon.
    crossed = e.filter("x1 <> x2").withColumn("_cc", F.explode(_between(_cell(F.least("x1", "x2"), side) + 1, _cell(F.greatest("x1", "x2"), side))))
    crossed = crossed.withColumn("y", F.when(F.col("y1") == F.col("y2"), F.col("y1")).otherwise(y_at(_line(F.col("_cc"), side)))).select(_cell("y", side).alias("_cr"), "_cc", "poly_id", "y")
    level = e.filter("m IS NOT NULL").withColumn("_cr", F.explode(_between(_cell(low, side) + 1, _cell(high, side)))).select("_cr", "poly_id", at(_line(F.col("_cr"), side)).alias("x"))
    w = Window.partitionBy("poly_id", "_cr").orderBy("x")
    level = level.withColumns({"n": F.row_number().over(w), "to": F.lead("x").over(w)}).filter("n % 2 = 1 AND to IS NOT NULL")
    corners = level.withColumn("_cc", F.explode(_between(_cell("x", side) + 1, _cell("to", side)))).select("_cr", "_cc", "poly_id", F.lit(float("-inf")).alias("y"))
    return pieces, corners.unionByName(crossed), level.select("_cr", "poly_id", "x", "to")


#: A cell with more pieces than this is cut into SPLIT x SPLIT cells, and those again, LEVELS times at most.
DENSE, SPLIT, LEVELS = 256, 8, 4


def _dense(edges: DataFrame, pieces: DataFrame) -> DataFrame | None:
    """_cr, _cc of the cells with more than DENSE pieces; None if there are none."""
    if edges.limit(DENSE + 1).count() <= DENSE:
        return None
    found = pieces.groupBy("_cr", "_cc").agg(F.count("*").alias("n")).filter(F.col("n") > DENSE).select("_cr", "_cc")
    return None if found.isEmpty() else found


def _clipped(cells: DataFrame, edges: DataFrame, cover: tuple[DataFrame, DataFrame, DataFrame], side: float) -> DataFrame:
    """The edges of what polygons have in the cells (_cr, _cc): their pieces there, and the stretches of the cells' borders that lie inside."""
    pieces, left, level = cover
    at = lambda y: F.col("x1") + (y - F.col("y1")) * F.col("m")
    edge = lambda *xs: [x.alias(n) for x, n in zip(xs, ("x1", "y1", "x2", "y2"), strict=True)]
    keys = ["_cr", "_cc"]
    inner = pieces.join(cells, keys).select("poly_id", *edge(at(F.col("p")), F.col("p"), at(F.col("q")), F.col("q")))
    # The right border of a cell is the left one of the cell beside it.
    sides = left.select("_cr", F.explode(F.array("_cc", F.col("_cc") - 1)).alias("_cell"), "_cc", "poly_id", "y").join(cells.withColumnRenamed("_cc", "_cell"), ["_cr", "_cell"])
    ys = sides.groupBy("_cr", "_cell", "_cc", "poly_id").agg(F.array_sort(F.collect_list("y")).alias("ys"))
    bottom, top, x = _line(F.col("_cr"), side), _line(F.col("_cr") + 1, side), _line(F.col("_cc"), side)
    spans = F.transform(F.sequence(F.lit(0), F.size("ys") - 1, F.lit(2)), lambda k: F.struct(F.greatest(F.get("ys", k), bottom).alias("a"), F.coalesce(F.get("ys", k + 1), top).alias("b")))
    border = ys.select("poly_id", x.alias("x"), F.explode(spans).alias("s")).select("poly_id", *edge(F.col("x"), F.col("s.a"), F.col("x"), F.col("s.b")))
    # Lower borders, and those of the cells above.
    row = level.withColumn("_cc", F.explode(F.sequence(_cell("x", side), _cell("to", side)))).select(F.explode(F.array("_cr", F.col("_cr") - 1)).alias("_row"), "_cr", "_cc", "poly_id", "x", "to")
    row = row.join(cells.withColumnRenamed("_cr", "_row"), ["_row", "_cc"])
    a, b = F.greatest("x", _line(F.col("_cc"), side)), F.least("to", _line(F.col("_cc") + 1, side))
    floor = row.select("poly_id", *edge(a, bottom, b, bottom)).filter("x1 < x2")
    # Flat edges are no pieces.
    low, high = F.least("x1", "x2"), F.greatest("x1", "x2")
    flat = edges.filter("y1 = y2 AND x1 <> x2").withColumns({"_cr": _cell("y1", side), "_cc": F.explode(F.sequence(_cell(low, side), _cell(high, side)))}).join(cells, keys)
    flat = flat.select("poly_id", *edge(F.greatest(low, _line(F.col("_cc"), side)), F.col("y1"), F.least(high, _line(F.col("_cc") + 1, side)), F.col("y1"))).filter("x1 < x2")
    parts = inner.unionByName(border).unionByName(floor).unionByName(flat)
    # Written, so that a level does not work out again what the ones above it did.
    path, schema = new_path(edges.sparkSession, "clipped"), parts.schema
    parts.write.parquet(path)
    return edges.sparkSession.read.schema(schema).parquet(path)


def united(edges: DataFrame, side: float = 32.0, cover: tuple | None = None, only: DataFrame | None = None) -> DataFrame:
    """The union of polygons as intervals: _cr, _cc, ya, yb, xa, xb, sign. Between ya and yb the union in a square cell ends at the line from (xa, ya) to (xb, yb), on its left (sign 1) or on its right (sign -1).

    A point is in a polygon if a ray from it crosses the polygon's rings an odd number of times, so holes
    and parts need no order or direction; it is in the union if it is in any polygon. A plane sweep in each
    cell: the ends of edges and the crossings of different polygons cut it into slabs; in a slab the
    edges are sorted by x, every edge enters or leaves its polygon, and where the running number of
    polygons begins or ends at 0 the union begins or ends. What lies left of a cell is known from
    its lower left corner and the edges that cross its left border. A polygon's own edges must not cross.
    """
    pieces, left = (t if only is None else t.join(only, ["_cr", "_cc"], "left_anti") for t in (cover or _cover(edges, side))[:2])
    at = lambda y: F.col("x1") + (y - F.col("y1")) * F.col("m")
    other = pieces.select("_cr", "_cc", *[F.col(c).alias(f"{c}_2") for c in ("poly_id", "p", "q", "x1", "y1", "m")])
    meet = F.col("y1") + (F.col("x1_2") + (F.col("y1") - F.col("y1_2")) * F.col("m_2") - F.col("x1")) / (F.col("m") - F.col("m_2"))
    crossings = pieces.join(other, ["_cr", "_cc"]).filter("poly_id < poly_id_2 AND m <> m_2 AND p < q_2 AND p_2 < q").select("_cr", "_cc", meet.alias("y"), F.greatest("p", "p_2").alias("a"), F.least("q", "q_2").alias("b")).filter("a < y AND y < b").select("_cr", "_cc", "y")
    ends = pieces.select("_cr", "_cc", F.explode(F.array("p", "q")).alias("y")).unionByName(left.select("_cr", "_cc", "y")).unionByName(crossings)
    bottom, top = _line(F.col("_cr"), side), _line(F.col("_cr") + 1, side)
    cells = ends.groupBy("_cr", "_cc").agg(F.collect_set("y").alias("ys"))
    cells = cells.select("_cr", "_cc", F.array_sort(F.array_union(F.filter("ys", lambda y: (y > bottom) & (y < top)), F.array(bottom, top))).alias("ys"))

    # The sides of polygons in each slab; a polygon that holds the slab's left end has a side there.
    slab = lambda i: F.struct(F.get("ys", i).alias("ya"), F.get("ys", i + 1).alias("yb"))
    place = lambda y: (F.array_position("ys", y) - 1).cast("int")
    inner = pieces.join(cells, ["_cr", "_cc"]).select("_cr", "_cc", "poly_id", "x1", "y1", "m", F.explode(F.transform(_between(place(F.col("p")), place(F.col("q")) - 1), slab)).alias("s"))
    inner = inner.select("_cr", "_cc", "poly_id", "s.*", at(F.col("s.ya")).alias("xa"), at(F.col("s.yb")).alias("xb"))
    before = left.groupBy("_cr", "_cc", "poly_id").agg(F.collect_list("y").alias("ts")).join(cells, ["_cr", "_cc"])
    before = before.select("_cr", "_cc", "poly_id", "ts", F.explode(F.transform(_between(F.lit(0), F.size("ys") - 2), slab)).alias("s")).filter("size(filter(ts, t -> t <= s.ya)) % 2 = 1")
    border = _line(F.col("_cc"), side)
    sides = inner.unionByName(before.select("_cr", "_cc", "poly_id", "s.*", border.alias("xa"), border.alias("xb")))
    keys = ["_cr", "_cc", "ya", "yb"]
    x = F.col("xa") + F.col("xb")
    own, all_ = Window.partitionBy(*keys, "poly_id").orderBy(x), Window.partitionBy(*keys).orderBy(x, F.col("step").desc(), "poly_id")
    steps = sides.withColumn("step", F.when(F.row_number().over(own) % 2 == 1, 1).otherwise(-1))
    steps = steps.withColumns({"after": F.sum("step").over(all_.rowsBetween(Window.unboundedPreceding, 0)), "last": F.lead("step").over(all_).isNull()})
    ahead, right = F.col("after") - F.col("step"), _line(F.col("_cc") + 1, side)
    end = lambda sign, a, b: F.struct(F.lit(sign).alias("sign"), a.alias("xa"), b.alias("xb"))
    out = F.array(
        F.when((ahead == 0) & (F.col("after") > 0), end(-1, F.col("xa"), F.col("xb"))).when((ahead > 0) & (F.col("after") == 0), end(1, F.col("xa"), F.col("xb"))),
        F.when(F.col("last") & (F.col("after") > 0), end(1, right, right)),
    )
    return steps.select(*keys, F.inline(F.filter(out, lambda o: o.isNotNull())))


def _between(a: Column, b: Column) -> Column:
    """Whole numbers from a to b, none if a > b."""
    return F.when(a <= b, F.sequence(a, F.greatest(a, b)))


def covered_fraction(boxes: DataFrame, edges: DataFrame, side: float = 32.0, levels: int = LEVELS) -> DataFrame:
    """pid, fraction of each box (pid, minx, miny, maxx, maxy) that polygons cover, exactly; what several cover counts once. Null for boxes without an area.

    Boxes meet the union's intervals in square cells, best about the size of a box; the area right of a
    box's left side is added up to each end of an interval, and taken away from each begin. Cells with
    many edges are cut into smaller ones.
    """
    area = covered_area(boxes.filter("minx < maxx AND miny < maxy"), edges, side, levels).groupBy("pid").agg(F.sum("a").alias("area"))
    return boxes.join(area, "pid", "left").select("pid", (F.coalesce("area", F.lit(0.0)) / F.when((F.col("maxx") > F.col("minx")) & (F.col("maxy") > F.col("miny")), (F.col("maxx") - F.col("minx")) * (F.col("maxy") - F.col("miny")))).alias("fraction"))


def covered_area(boxes: DataFrame, edges: DataFrame, side: float, levels: int) -> DataFrame:
    """pid, a: parts of the covered areas of boxes, to be added up."""
    cover = _cover(edges, side)
    dense = _dense(edges, cover[0]) if levels else None
    b = boxes.withColumn("_cr", F.explode(F.sequence(_cell("miny", side), _cell("maxy", side)))).withColumn("_cc", F.explode(F.sequence(_cell("minx", side), _cell("maxx", side))))
    j = b.join(united(edges, side, cover, dense), ["_cr", "_cc"]).withColumns({"_a": F.greatest("ya", "miny"), "_b": F.least("yb", "maxy")}).filter("_a < _b")
    at = lambda y: F.col("xa") + (y - F.col("ya")) / (F.col("yb") - F.col("ya")) * (F.col("xb") - F.col("xa"))
    j = j.withColumns({"_xa": at(F.col("_a")), "_xb": at(F.col("_b"))}).withColumns({"_l": F.least("_xa", "_xb"), "_h": F.greatest("_xa", "_xb"), "_w": F.col("maxx") - F.col("minx")})
    # Mean over the stretch of clamp(x - minx, 0, w): the integral of the clamp over x, divided by the length.
    ramp = lambda x: F.when(x <= 0, 0.0).when(x >= F.col("_w"), F.col("_w") * x - F.col("_w") * F.col("_w") / 2).otherwise(x * x / 2)
    gap = F.col("_h") - F.col("_l")
    straight = F.greatest(F.lit(0.0), F.least(F.col("_w"), F.col("_l") - F.col("minx")))
    mean = F.when(gap < 1e-12, straight).otherwise((ramp(F.col("_h") - F.col("minx")) - ramp(F.col("_l") - F.col("minx"))) / F.when(gap < 1e-12, 1.0).otherwise(gap))
    area = j.select("pid", (F.col("sign") * mean * (F.col("_b") - F.col("_a"))).alias("a"))
    if dense is None:
        return area
    near = boxes.join(b.join(dense, ["_cr", "_cc"], "left_semi").select("pid").distinct(), "pid", "left_semi")
    return area.unionByName(covered_area(near, _clipped(dense, edges, cover, side), side / SPLIT, levels - 1))


def light_of(fractions: DataFrame, threshold: float = 0.3) -> DataFrame:
    """shadow from 1 - threshold up, sun up to threshold, else mixed; mixed too without an area."""
    f = F.col("fraction")
    return fractions.withColumn("illumination", F.when(f.isNull(), "mixed").when(f >= 1 - threshold, "shadow").when(f <= threshold, "sun").otherwise("mixed"))


def overlapping(edges: DataFrame, height: int, width: int) -> bool:
    """Whether two polygons hold one cell centre."""
    return not mask(edges, height, width).groupBy("r", "c").agg(F.count("*").alias("n")).filter("n > 1").isEmpty()


def raster_spec(edges: DataFrame, resolution: float = 1.0) -> DataFrame:
    """One row: bounds and size by int(extent / resolution)."""
    b = edges.agg(F.least(F.min("x1"), F.min("x2")).alias("minx"), F.least(F.min("y1"), F.min("y2")).alias("miny"), F.greatest(F.max("x1"), F.max("x2")).alias("maxx"), F.greatest(F.max("y1"), F.max("y2")).alias("maxy"))
    return b.select("*", F.floor((F.col("maxx") - F.col("minx")) / resolution).alias("width"), F.floor((F.col("maxy") - F.col("miny")) / resolution).alias("height"))
