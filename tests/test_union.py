"""Unions of polygons against a scan of many lines."""

import math
import random

import numpy as np
import pytest

from tilewright.operators import vector


def scanned(polygons, box, lines=4_000):
    """Covered share of a box: on each line, the union of what the polygons hold by the odd-even rule."""
    minx, miny, maxx, maxy = box
    total = 0.0
    for y in miny + (np.arange(lines) + 0.5) / lines * (maxy - miny):
        held = []
        for rings in polygons.values():
            xs = sorted(x1 + (y - y1) / (y2 - y1) * (x2 - x1) for pts in rings for (x1, y1), (x2, y2) in zip(pts, pts[1:] + pts[:1], strict=True) if min(y1, y2) <= y < max(y1, y2))
            held += zip(xs[::2], xs[1::2], strict=True)
        at = minx
        for a, b in sorted(held):
            a, b = max(a, at), min(b, maxx)
            if b > a:
                total += b - a
                at = b
    return total / lines / (maxx - minx)


def fractions(spark, boxes, polygons, side):
    frame = spark.createDataFrame([(k, *map(float, b)) for k, b in enumerate(boxes)], "pid long, minx double, miny double, maxx double, maxy double")
    return {r.pid: r.fraction for r in vector.covered_fraction(frame, vector.edges_of(spark, polygons), side).collect()}


SQUARE = [(0, 0), (10, 0), (10, 10), (0, 10)]


def test_two_equal_squares_count_once(spark):
    half = {0: [[(0, 0), (5, 0), (5, 10), (0, 10)]], 1: [[(0, 0), (5, 0), (5, 10), (0, 10)]]}
    for side in (3.0, 64.0):
        assert math.isclose(fractions(spark, [(0, 0, 10, 10)], half, side)[0], 0.5)


def test_holes_parts_and_nesting(spark):
    hole = [(2, 2), (8, 2), (8, 8), (2, 8)]
    inner = [(4, 4), (6, 4), (6, 6), (4, 6)]
    boxes = [(0, 0, 10, 10), (3, 3, 7, 7), (20, 20, 30, 30), (5, 5, 5, 5), (-5, -5, 5, 5)]
    got = fractions(spark, boxes, {0: [SQUARE, hole], 1: [inner], 2: [[(20, 20), (21, 20), (21, 30), (20, 30)], [(25, 20), (26, 20), (26, 30), (25, 30)]]}, 7.0)
    assert math.isclose(got[0], 0.68) and math.isclose(got[1], 4 / 16) and math.isclose(got[2], 0.2) and got[3] is None and math.isclose(got[4], (25 - 9 + 1) / 100)
    # The hole of one polygon filled by another, drawn the other way round.
    assert math.isclose(fractions(spark, boxes[:1], {0: [SQUARE, hole], 1: [hole[::-1]]}, 4.0)[0], 1.0)
    assert fractions(spark, boxes[:1], {}, 4.0)[0] == 0


@pytest.mark.parametrize(("seed", "side"), [(1, 8.0), (3, 300.0)])
def test_random_overlaps(spark, seed, side):
    rng = random.Random(seed)
    polygons = {}
    for k in range(14):
        cx, cy, n = rng.uniform(-60, 60), rng.uniform(-60, 60), rng.randrange(3, 9)
        turn = sorted(rng.uniform(0, 2 * math.pi) for _ in range(n))
        # Radii of a star-shaped polygon, so that its own edges do not cross.
        polygons[k] = [[(cx + r * math.cos(t), cy + r * math.sin(t)) for t in turn for r in (rng.uniform(5, 40),)]] if max(b - a for a, b in zip(turn, turn[1:] + [turn[0] + 2 * math.pi], strict=True)) < math.pi else [[(cx, cy), (cx + 30, cy), (cx, cy + 30)]]
    polygons[20] = [[(-50, -10), (50, -10), (50, 10), (-50, 10)]]
    polygons[21] = [[(-40, -10), (40, -10), (40, 5), (-40, 5)]]
    boxes = [(x, y, x + w, y + h) for x, y, w, h in ((rng.uniform(-80, 60), rng.uniform(-80, 60), rng.uniform(3, 50), rng.uniform(3, 50)) for _ in range(25))]
    got = fractions(spark, boxes, polygons, side)
    for k, b in enumerate(boxes):
        assert abs(got[k] - scanned(polygons, b)) < 2e-3, (k, b)


def held(rings, x, y):
    """Crossings of the ray to the right, an edge from its lower end up to below its upper end."""
    edges = [e for pts in rings for e in zip(pts, pts[1:] + pts[:1], strict=True)]
    return sum(min(y1, y2) <= y < max(y1, y2) and x1 + (y - y1) / (y2 - y1) * (x2 - x1) > x for (x1, y1), (x2, y2) in edges) % 2 == 1


@pytest.mark.parametrize("side", [3.0, 32.0, 500.0])
def test_points_in_polygons_by_cells(spark, side):
    rng = random.Random(9)
    polygons = {k: [[(rng.randint(-50, 50), rng.randint(-50, 50)) for _ in range(rng.randrange(3, 7))]] for k in range(8)}
    polygons[8] = [[(-40, -40), (40, -40), (40, 40), (-40, 40)], [(-20, -20), (20, -20), (20, 20), (-20, 20)]]
    points = [(k, float(rng.randint(-55, 55)), float(rng.randint(-55, 55))) if k % 2 else (k, rng.uniform(-55, 55), rng.uniform(-55, 55)) for k in range(400)]
    frame = spark.createDataFrame([*points, (900, None, 1.0)], "pid long, x double, y double")
    got = {tuple(r) for r in vector.holders(frame, vector.edges_of(spark, polygons), side).collect()}
    # Points on a sloped edge may fall on either side.
    near = lambda x, y: any(abs((x2 - x1) * (y - y1) - (y2 - y1) * (x - x1)) < 1e-7 for rings in polygons.values() for pts in rings for (x1, y1), (x2, y2) in zip(pts, pts[1:] + pts[:1], strict=True) if x1 != x2)
    clear = {k for k, x, y in points if not near(x, y)}
    assert {g for g in got if g[0] in clear} == {(k, p) for k, x, y in points if k in clear for p, rings in polygons.items() if held(rings, x, y)}
    assert len(clear) > 350


def test_a_comb_in_one_row_of_tiles_is_many_groups(spark):
    """A polygon with all its edges in one band of y: no cell has many more edges than another."""
    teeth = [pt for k in range(400) for pt in ((10 * k, 0), (10 * k + 5, 20))]
    comb = {0: [[*teeth, (4_000, 30), (0, 30)]]}
    pieces, *_ = vector._cover(vector.edges_of(spark, comb), 40.0)
    sizes = sorted(r["count"] for r in pieces.groupBy("_cr", "_cc").count().collect())
    assert len(sizes) > 100 and sizes[-1] <= 2 * sizes[len(sizes) // 2]
    points = spark.createDataFrame([(0, 12.0, 25.0), (1, 15.0, 19.0), (2, 20.0, 1.0), (3, 20.0, 19.0)], "pid long, x double, y double")
    assert {tuple(r) for r in vector.holders(points, vector.edges_of(spark, comb), 40.0).collect()} == {(k, 0) for k, x, y in ((0, 12.0, 25.0), (1, 15.0, 19.0), (2, 20.0, 1.0), (3, 20.0, 19.0)) if held(comb[0], x, y)}


def test_dense_cells_are_cut_further(spark, monkeypatch):
    """Stars of many corners in a few cells, beside a large square: points and areas as without cutting, and no cell of the last level is dense."""
    monkeypatch.setattr(vector, "DENSE", 40)
    rng = random.Random(4)
    polygons = {0: [[(-100, -100), (100, -100), (100, 100), (-100, 100)], [(-50, -50), (50, -50), (50, 50), (-50, 50)]]}
    for k, (cx, cy) in enumerate(((0, 0), (6, 4), (45, 47)), 1):
        polygons[k] = [[(cx + r * math.cos(2 * math.pi * t / 150), cy + r * math.sin(2 * math.pi * t / 150)) for t in range(150) for r in (rng.uniform(6, 9),)]]
    edges = vector.edges_of(spark, polygons)
    points = [(k, rng.uniform(-15, 60), rng.uniform(-15, 60)) for k in range(300)] + [(400, 80.0, 80.0), (401, 0.0, 60.0), (402, 0.0, 30.0)]
    got = {tuple(r) for r in vector.holders(spark.createDataFrame(points, "pid long, x double, y double"), edges, 64.0).collect()}
    assert got == {(k, p) for k, x, y in points for p, rings in polygons.items() if held(rings, x, y)}
    boxes = [(-10, -10, 15, 15), (-2, -3, 4, 5), (40, 40, 60, 60), (-120, -120, 120, 120), (44, 44, 44.5, 44.5), (60, 60, 90, 90)]
    whole = {k: scanned(polygons, b, 6_000) for k, b in enumerate(boxes)}
    share = fractions(spark, boxes, polygons, 64.0)
    assert all(abs(share[k] - whole[k]) < 2e-3 for k in whole)
    sizes, side, levels = [], 64.0, 0
    while True:
        cover = vector._cover(edges, side)
        dense = vector._dense(edges, cover[0])
        sizes.append(cover[0].groupBy("_cr", "_cc").count().agg({"count": "max"}).first()[0])
        if dense is None:
            break
        edges, side, levels = vector._clipped(dense, edges, cover, side), side / vector.SPLIT, levels + 1
    assert levels >= 1 and sizes[0] > 40 >= sizes[-1]
