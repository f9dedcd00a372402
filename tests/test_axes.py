"""Axis descent: the last node, ends in the air, and the same axes whatever the tiles."""

import numpy as np

from arborspark.operators import axes
from arborspark.operators import shape as H
from arborspark.plans import detectors, views
from pyspark.sql import functions as F

POINT = "scene_id int, pid long, x double, y double, z double"
START = "scene_id int, axis_id int, x double, y double, z double"


def _nodes(df):
    return {(r.scene_id, r.axis_id, r.step): (round(r.x, 6), round(r.y, 6), round(r.z, 6)) for r in df.collect()}


def test_an_axis_keeps_its_last_node(spark):
    p = spark.createDataFrame([(0, i, 0.0, 0.0, 3.0 - i / 2) for i in range(7)], POINT)
    got = _nodes(axes.crown_axes(spark.createDataFrame([(0, 1, 0.0, 0.0, 3.0)], START), p, 1.0))
    assert got == {(0, 1, 0): (0, 0, 3.0), (0, 1, 1): (0, 0, 2.0), (0, 1, 2): (0, 0, 1.0)}
    alone = spark.createDataFrame([(0, 5, 0.0, 0.0, 40.0), (0, 6, 0.0, 0.0, 0.0)], POINT)
    got = _nodes(axes.crown_axes(spark.createDataFrame([(0, 1, 0.0, 0.0, 40.0), (3, 1, 0.0, 0.0, 9.0)], START), alone, 1.0))
    assert [got[0, 1, s][2] for s in range(4)] == [40.0, 39.0, 38.0, 37.0] and (0, 1, 4) not in got and got[3, 1, 0] == (0, 0, 9.0)


def test_axes_cross_tiles(spark):
    rng = np.random.default_rng(8)
    z = np.concatenate([np.arange(60.0, 0.0, -0.4)] * 4)
    drift = np.concatenate([np.arange(len(z) // 4) * s for s in (0.45, -0.3, 0.2, 0.0)])  # slanted trunks
    p = np.stack([drift, np.repeat([0.0, 30.0, 60.0, 90.0], len(z) // 4), z], axis=1) + rng.normal(0, 0.2, (len(z), 3))
    noise = rng.random((1500, 3)) * [90, 100, 60] - [20, 5, 0]
    rows = [(0, i, *map(float, v)) for i, v in enumerate(np.concatenate([p, noise]).round(3))]
    points = spark.createDataFrame(rows, POINT)
    tops = spark.createDataFrame([(0, i, *rows[i * (len(z) // 4)][2:]) for i in range(4)], START)
    whole, cut = _nodes(axes.crown_axes(tops, points, 1.0)), _nodes(axes.crown_axes(tops, points, 1.0, cap=60))
    assert whole == cut and max(k[2] for k in whole) > 20


def test_a_perfect_cone_is_conical(spark):
    nodes = [(0, 1, 20.0 - d, 0.3 * d) for d in range(1, 15)] + [(0, 2, 20.0 - d, 1.2 * d**0.5) for d in range(1, 15)] + [(0, 3, 5.0, 1.0)]
    df = spark.createDataFrame(nodes, "scene_id int, label int, z double, r double")
    got = H.shape_by_profile(df, df.groupBy("scene_id", "label").agg(F.lit(20.0).alias("height")), ("scene_id", "label"))
    assert {r.label: r["shape"] for r in got.collect()} == {1: "conical", 2: "spherical", 3: "spherical"}


def test_crowns_are_summed_up_once(spark, data, monkeypatch):
    calls = []
    stats = H.cluster_stats
    monkeypatch.setattr(H, "cluster_stats", lambda *args: calls.append(1) or stats(*args))
    assert detectors.crown_axis(views.points(spark, data)).count()
    assert len(calls) == 1
    points = views.points(spark, data).withColumn("label", F.floor(F.col("x") / 5))
    keys = ("scene_id", "label")
    given = stats(points, keys)
    for same, other in ((H.percentile_radius(points, keys, 0.9, given), H.percentile_radius(points, keys)), (H.radial_profile(points, keys, stats=given), H.radial_profile(points, keys))):
        rounded = lambda df: sorted(tuple(round(v, 9) for v in r) for r in df.collect())
        assert rounded(same) == rounded(other)
