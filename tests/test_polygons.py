"""Many polygons by the index of edges, against the even-odd rule in Python."""

import random

import pytest
from pyspark.sql import functions as F

from arborspark.operators.points import polygon_crop
from arborspark.operators.polygons import edge_index, points_in_polygons

POLYGONS = "scene_id int, polygon_id long, vertices array<struct<x:double,y:double>>, x string"
POINTS = "scene_id int, pid long, x double, y double, z double"


def _inside(x, y, polygon):
    odd = False
    for (x1, y1), (x2, y2) in zip(polygon, polygon[1:] + polygon[:1]):
        if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
            odd = not odd
    return odd


def _polygon(rng, size, n):
    cx, cy = rng.uniform(-50, 50), rng.uniform(-50, 50)
    return [(cx + rng.uniform(-size, size), cy + rng.uniform(-size, size)) for _ in range(n)]


def test_sizes_from_specks_to_the_whole_plane(spark):
    rng = random.Random(7)
    sizes = [(0.01, 5)] * 20 + [(1.0, 3)] * 60 + [(4.0, 12)] * 60 + [(60.0, 200)] * 5
    polygons = [(i % 2, i, _polygon(rng, size, n)) for i, (size, n) in enumerate(sizes)]
    polygons.append((0, 1000, [(float(p), 40.0 * (p % 2) - 20.0) for p in range(-30, 30)]))  # a comb
    points = [(i % 2, i, rng.uniform(-60, 60), rng.uniform(-60, 60), 0.0) for i in range(1500)]
    points += [(s, 5000 + i, *polygons[i][2][0], 1.0) for i in range(80) for s in (0, 1)]  # on vertices
    found = points_in_polygons(spark.createDataFrame(points, POINTS), spark.createDataFrame([(*p, "other") for p in polygons], POLYGONS), ["scene_id"])
    assert found.columns == ["scene_id", "pid", "x", "y", "z", "polygon_id"]
    got = sorted((r.scene_id, r.pid, r.polygon_id) for r in found.collect())
    want = sorted((s, k, i) for s, k, x, y, _ in points for t, i, v in polygons if s == t and _inside(x, y, v))
    assert got == want and len(want) > 300


def test_one_polygon_agrees_with_the_crop(spark):
    polygon = [(3.0, 2.0), (21.0, 4.0), (23.0, 18.0), (12.0, 11.0), (4.0, 22.0)]
    points = spark.range(900).select(F.lit(0).alias("scene_id"), F.col("id").alias("pid"), (F.col("id") % 30).cast("double").alias("x"), F.floor(F.col("id") / 30).cast("double").alias("y"), F.lit(0.0).alias("z"))
    found = points_in_polygons(points, spark.createDataFrame([(0, 1, polygon, None)], POLYGONS))
    assert {r.pid for r in found.collect()} == {r.pid for r in polygon_crop(points, polygon).collect()}


def test_defined_cases(spark):
    square = [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)]
    rows = [
        (0, 1, square, None), (0, 1, square, None),  # repeated: once
        (0, 1, [(10.0, 10.0), (12.0, 10.0), (11.0, 12.0)], None),  # another polygon of the same id
        (0, 2, None, None), (0, 3, square[:2], None), (0, 4, [(0.0, 0.0), (1.0, None), (1.0, 1.0)], None), (0, 5, [(0.0, 0.0), (float("nan"), 2.0), (2.0, 0.0)], None),
        (0, 6, [(1.0, 0.0), (1.0, 1.0), (1.0, 2.0)], None), (None, 7, square, None), (0, None, square, None),
    ]
    points = [(0, 1, 1.0, 1.0, 0.0), (0, 2, 11.0, 10.5, 0.0), (0, 3, None, 1.0, 0.0), (0, 4, float("nan"), 1.0, 0.0), (None, 5, 1.0, 1.0, 0.0), (0, 1, 1.0, 1.0, 0.0), (0, 6, float("inf"), 1.0, 0.0)]
    found = points_in_polygons(spark.createDataFrame(points, POINTS), spark.createDataFrame(rows, POLYGONS), ["scene_id"])
    assert sorted(((r.pid, r.polygon_id) for r in found.collect()), key=repr) == sorted([(1, 1), (1, 1), (1, None), (1, None), (2, 1)], key=repr)
    none = spark.createDataFrame([], POLYGONS)
    assert points_in_polygons(spark.createDataFrame(points, POINTS), none, ["scene_id"]).count() == 0
    assert points_in_polygons(spark.createDataFrame([], POINTS), spark.createDataFrame(rows, POLYGONS), ["scene_id"]).count() == 0


@pytest.mark.parametrize("n", [100, 1000])
def test_the_index_grows_with_the_edges(spark, n):
    rng = random.Random(n)
    zigzag = [(rng.uniform(0, 100), 50.0 * (i % 2)) for i in range(n)]  # every edge climbs the whole height
    round_ = [(i, i * i / n) for i in range(n)]
    for polygon in (zigzag, round_):
        index = edge_index(spark.createDataFrame([(0, 1, [(float(x), float(y)) for x, y in polygon], None)], POLYGONS))
        assert index.groupBy().agg(F.sum(F.size("edges"))).first()[0] <= 8 * n
