"""Hand-computed fixtures and invariants of the core operators."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from arborspark.operators import points as P
from arborspark.operators import raster as R
from arborspark.operators import scoring as S
from arborspark.operators import spatial as X
from arborspark.plans import reports

TREE = "scene_id int, tree_id int, x double, y double, height double, radius double, shape string"
POINT = "scene_id int, pid long, x double, y double, z double, cls int"


def test_similarity_of_two_trees(spark):
    a = spark.createDataFrame([(0, 1, 0.0, 0.0, 10.0, 2.0, "conical")], TREE)
    b = spark.createDataFrame([(0, 7, 3.0, 4.0, 8.0, 2.5, "conical")], TREE)
    r = S.similarity(a, b).first()
    assert (r.s_type, r.s_height, r.s_radius) == (1.0, pytest.approx(0.8), pytest.approx(0.8))
    assert r.s_pos == pytest.approx(1 / 6) and r.avg_sim == pytest.approx(0.6916667)


def test_similarity_of_flat_trees_is_one(spark):
    a = spark.createDataFrame([(0, 1, 0.0, 0.0, 0.0, 0.0, "conical")], TREE)
    assert S.similarity(a, a).first().s_height == 1.0


def test_score_of_a_missed_tree(spark):
    ref = spark.createDataFrame([(0, 1, 0.0, 0.0, 10.0, 2.0, "conical"), (0, 2, 9.0, 9.0, 5.0, 1.0, "spherical")], TREE)
    pred = ref.filter("tree_id = 1")
    r = S.scores(ref, pred, S.matches(ref, pred)).first()
    assert (r.tp, r.fn, r.fp) == (1, 1, 0)
    assert r.score == pytest.approx(29.2893219) and r.score_total == pytest.approx(29.2893219)


def test_score_of_an_empty_side_is_zero(spark):
    ref = spark.createDataFrame([(0, 1, 0.0, 0.0, 10.0, 2.0, "conical")], TREE)
    none = ref.limit(0)
    assert S.scores(ref, none, S.matches(ref, none)).first().score_total == 0.0


@pytest.mark.parametrize("shape", [(1, 1), (3, 3), (2, 5), (5, 2), (5, 5)])
def test_assignment_is_optimal(shape):
    rng = np.random.default_rng(sum(shape))
    for _ in range(20):
        cost = rng.random(shape).round(2)
        i, j = S.assign_rows(cost)
        small, large = sorted(shape)
        c = cost if shape[0] <= shape[1] else cost.T
        best = min(sum(c[a, b] for a, b in enumerate(p)) for p in itertools.permutations(range(large), small))
        assert len(set(i)) == len(set(j)) == small and cost[i, j].sum() == pytest.approx(best)


def test_polygon_keeps_the_inside(spark):
    square = [(0, 0), (10, 0), (10, 10), (0, 10)]
    p = spark.createDataFrame([(0, 1, 5.0, 5.0, 0.0, 2), (0, 2, 11.0, 5.0, 0.0, 2)], POINT)
    assert [r.pid for r in P.polygon_crop(p, square).collect()] == [1]
    assert P.polygon_crop(p, square[:2]).count() == 0


def test_rasterise_fixture(spark):
    p = spark.createDataFrame([(0, 1, 0.0, 0.0, 5.0, 3), (0, 2, 0.4, 0.0, 7.0, 3), (0, 3, 1.0, 1.0, 3.0, 3)], POINT)
    geo = R.extent(p, 0.5)
    assert geo.select("n_cols", "n_rows").first() == (3, 3)
    assert {(r.iy, r.ix): r.h for r in R.rasterise(p, geo, 0.5).collect()} == {(2, 0): 7.0, (0, 2): 3.0}


@pytest.mark.parametrize(("sigma", "radius"), [(1.5, 6), (1.0, 4), (0.8, 3), (0.35, 1)])
def test_gaussian_radius(sigma, radius):
    w = R.gaussian_weights(sigma)
    assert len(w) == 2 * radius + 1 and math.isclose(sum(w), 1)


def test_gaussian_keeps_a_constant(spark):
    geo = spark.createDataFrame([(0, 0.0, 1.0, 4, 3)], "scene_id int, x_min double, y_max double, n_cols int, n_rows int")
    flat = R.densify(spark.createDataFrame([], "scene_id int, iy int, ix int, h double"), geo).withColumn("h", F.lit(2.0))
    assert all(math.isclose(r.h, 2.0) for r in R.gaussian(flat, 1.5).collect())


def test_slices_and_classes(spark):
    p = spark.createDataFrame([(0, i, 0.0, 0.0, z, 3) for i, z in enumerate((10.0, 9.5, 9.4))], POINT)
    assert [r.slice_id for r in P.height_slices(p).orderBy("pid").collect()] == [0, 1, 1]
    z = spark.createDataFrame([(v,) for v in (0.4, 0.5, 2.0, 5.0)], "z double")
    assert [r[0] for r in z.select(P.class_of_height(F.col("z"))).collect()] == [2, 3, 4, 5]


def test_sweep(spark):
    rows = reports.sweep(spark, 0.1)
    assert rows.count() == 51 and tuple(rows.first()) == (0.0,) * 5
    assert reports.sweep(spark, 0.5).count() == 11 and reports.total_operations(rows, 6) == 663
    assert reports.factorial_sweep(spark, 0.5).count() == 3**5
    key = spark.createDataFrame([(0.1, 0.0, 0.0, 0.0, 0.0)], "noise_level double, dropout_rate double, overlap_factor double, mixing_factor double, gap_factor double")
    assert key.select(reports.scene_key()).first()[0] == "N0.10_D0.00_O0.00_M0.00_G0.00"


def test_components_of_a_path_and_a_ring(spark):
    path = [(0, i, i + 1) for i in range(40)]
    ring = [(1, i, (i + 1) % 9) for i in range(9)]
    got = X.components(spark.createDataFrame(path + ring, "scene_id int, a long, b long"))
    assert {tuple(r) for r in got.groupBy("scene_id", "component").count().collect()} == {(0, 0, 41), (1, 0, 9)}


def test_nearest_join_grows_until_complete(spark):
    left = spark.createDataFrame([(0, 1, 0.0, 0.0)], "scene_id int, pid long, x double, y double")
    right = spark.createDataFrame([(0, 5, 100.0, 0.0), (0, 6, 3.0, 0.0)], "scene_id int, pid long, x double, y double")
    got = X.nearest_join(left, right, 5, 1.0, "xy", "pid", "pid").orderBy("rank").collect()
    assert [r.r_pid for r in got] == [6, 5]


def test_empty_points_flow_through(spark):
    none = spark.createDataFrame([], POINT)
    geo = R.extent(none, 1.0)
    assert R.local_maxima(R.densify(R.rasterise(none, geo, 1.0), geo), geo, 2, 2.0).count() == 0
    assert X.dbscan(none, 1.0, 3, "xy").count() == 0


def test_one_far_outlier_ends_in_a_few_rounds(spark, monkeypatch):
    rounds = []
    write = X.written
    monkeypatch.setattr(X, "written", lambda df, name: rounds.append(name) or write(df, name))
    rows = [(0, i, i % 10 * 1.0, i // 10 * 1.0, 0.0) for i in range(100)] + [(0, 1000, 0.0, 0.0, 1000.0)]
    p = spark.createDataFrame(rows, "scene_id int, pid long, x double, y double, z double")
    got = X.nearest_join(p, p, 3, 1.0, "xyz", "pid", "pid").filter("pid = 1000").orderBy("rank").collect()
    assert [r.r_pid for r in got] == [1000, 0, 1] and rounds.count("nearest") <= 12


def test_assignment_of_many_scenes_in_small_batches(spark):
    rng = np.random.default_rng(2)
    rows = [(s, r, p, float(v)) for s in range(30) for r in range(s % 5 + 1) for p, v in enumerate(rng.random(4))]
    pairs = spark.createDataFrame(rows, "scene_id int, ref_id int, pred_id int, avg_sim double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = S.assign(pairs).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for s in range(30):
        v = np.array([r[3] for r in rows if r[0] == s]).reshape(-1, 4)
        i, j = S.assign_rows(1 - v)
        mine = [r for r in got if r.scene_id == s]
        assert len(mine) == len(i) and sum(r.avg_sim for r in mine) == pytest.approx(v[i, j].sum())


def test_running_means_equal_the_batch(spark, data):
    from arborspark.streaming.results import running_means

    batch = spark.read.parquet(f"{data}/events.parquet").groupBy(F.col("event_type").alias("parser")).agg(F.count("*").alias("runs"))
    assert {tuple(r) for r in running_means(spark, data).select("parser", "runs").collect()} == {tuple(r) for r in batch.collect()}


def test_discs_are_those_of_the_midpoint_rule(spark):
    """Filled discs drawn by the integer midpoint rule, row spans in eight octants, are the Euclidean discs of radius 0 to 30."""
    from pyspark.sql import functions as F

    from arborspark.operators import raster as R

    want = set()
    for r in range(31):
        dx, dy = r, 0
        while dx >= dy:
            for row, half in ((dy, dx), (-dy, dx), (dx, dy), (-dx, dy)):
                want |= {(r, 50 + row, 50 + x) for x in range(-half, half + 1)}
            dy += 1
            dx -= dx * dx + dy * dy > r * r
    centres = spark.range(31).select(F.col("id").alias("scene_id"), F.lit(50).alias("iy"), F.lit(50).alias("ix"))
    assert {tuple(x) for x in R.disc_mask(centres, F.col("scene_id")).collect()} == want
