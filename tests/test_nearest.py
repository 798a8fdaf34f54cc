"""The nearest pixel of many points against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridspark import fixtures as fx
from gridspark.operators import nearest as N
from gridspark.operators import selection as Q

PIXELS = "y int, x int, lat double, lon double"


def brute(pixels, points):
    """Squared distances in one matrix; rows are in the order of the keys, so the first of equals counts."""
    pixels = sorted(p for p in pixels if None not in p)
    lat, lon = (np.array([p[i] for p in pixels]) for i in (2, 3))
    out = []
    for a, o in points:
        d = np.sqrt((lat - a) * (lat - a) + (lon - o) * (lon - o))
        i = int(d.argmin())
        out.append((pixels[i][0], pixels[i][1], float(d[i])))
    return out


def search(spark, pixels, points, **options):
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "id int, lat double, lon double")
    got = N.nearest_pixels(spark.createDataFrame(pixels, PIXELS), df, **options).collect()
    return [(r.y, r.x, r.dist) for r in sorted(got, key=lambda r: r.id)]


def grid(ny, nx, bend=0.0):
    return [(y, x, 25 + 0.125 * y + bend * x, -125 + 0.125 * x + bend * y * y) for y in range(ny) for x in range(nx)]


def test_ten_thousand_points(spark):
    dice = random.Random(1)
    pixels = grid(60, 80, 0.003)
    points = [(dice.uniform(20, 40), dice.uniform(-130, -110)) for _ in range(9000)] + [(p[2], p[3]) for p in pixels[::5]] + [(30.0, -120.0)] * 40
    got, want = search(spark, pixels, points), brute(pixels, points)
    assert [g[:2] for g in got] == [w[:2] for w in want] and [g[2] for g in got] == pytest.approx([w[2] for w in want], abs=1e-12)


@pytest.mark.parametrize("per_cell", [1, 4, 50])
def test_uneven_pixels(spark, per_cell):
    """A dense spot, a few far pixels, empty cells between them, points in between and far outside."""
    dice = random.Random(2)
    pixels = [(0, i, 30 + dice.gauss(0, 0.01), -100 + dice.gauss(0, 0.01)) for i in range(300)]
    pixels += [(1, 0, 50.0, -60.0), (1, 1, 50.0, -140.0), (1, 2, -10.0, -100.0)]
    points = [(dice.uniform(-80, 80), dice.uniform(-180, 0)) for _ in range(400)]
    assert [g[:2] for g in search(spark, pixels, points, per_cell=per_cell)] == [w[:2] for w in brute(pixels, points)]


def test_ties_lines_and_one_pixel(spark):
    corners = [(0, 0, 0.0, 0.0), (0, 1, 0.0, 1.0), (1, 0, 1.0, 0.0), (1, 1, 1.0, 1.0)]
    assert [g[:2] for g in search(spark, corners, [(0.5, 0.5), (0.5, 1.0), (2.0, 0.5)])] == [(0, 0), (0, 1), (1, 0)]
    line = [(0, x, 5.0, float(x)) for x in range(50)]
    points = [(9.0, -3.0), (5.0, 24.4), (-40.0, 70.0), (5.0, 0.5)]
    assert [g[:2] for g in search(spark, line, points)] == [w[:2] for w in brute(line, points)]
    assert [g[:2] for g in search(spark, [(3, 4, 1.0, 1.0)], [(1.0, 1.0), (80.0, 80.0)])] == [(3, 4)] * 2


def test_missing_coordinates(spark):
    pixels = spark.createDataFrame([(0, 0, None, 1.0), (0, 1, 2.0, float("nan")), (0, 2, 2.0, 2.0)], PIXELS)
    points = spark.createDataFrame([(1, None, 1.0, "a"), (2, float("nan"), 1.0, "b"), (3, 0.0, 0.0, "c"), (3, 0.0, 0.0, "c")],
                                   "id int, lat double, lon double, dist string")
    got = sorted((r.id, r.y, r.x) for r in N.nearest_pixels(pixels, points).collect() if r.y is not None)
    assert got == [(3, 0, 2)] * 2 and N.nearest_pixels(pixels, points).count() == 4
    assert N.nearest_pixels(pixels.limit(0), points).where("y IS NOT NULL").count() == 0
    assert N.nearest_pixels(pixels, points.limit(0)).count() == 0


def test_equals_one_point_and_joins_on_cells(spark, sf):
    static = fx.static(spark, sf)
    points = spark.createDataFrame([(25.3, -124.7), (25.0, -124.0)], "lat double, lon double")
    got = N.nearest_pixels(static, points)
    for r in got.collect():
        one = Q.nearest_pixel(static, (r.lat, r.lon)).first()
        assert (r.y, r.x) == (one.y, one.x) and r.dist == pytest.approx(one.dist)
    plan = got._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan and "Join Cross" not in plan
