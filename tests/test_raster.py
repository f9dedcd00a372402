"""Smoothing of long and uneven lines; peaks and closings read their raster once."""

import time

import numpy as np

from arborspark.operators import raster as R

PIXEL = "scene_id int, iy int, ix int, h double"


def _smooth(h, sigma):
    w = R.gaussian_weights(sigma)
    i = np.arange(len(h))
    total = np.zeros(len(h))
    for k, x in enumerate(w, -(len(w) // 2)):
        to = (i + k) % (2 * len(h))
        total += x * h[np.where(to < len(h), to, 2 * len(h) - 1 - to)]
    return total


def test_smoothing_takes_time_in_proportion_to_a_line(spark):
    n = 20_000
    line = spark.range(n).selectExpr("0 AS scene_id", "0 AS iy", "CAST(id AS int) AS ix", "CAST(id % 101 AS double) AS h")
    began = time.time()
    found = dict(R.gaussian(line, 0.8).select("ix", "h").collect())
    assert time.time() - began < 40  # a copy of the line for every pixel and weight took about two minutes
    across = sum(x * 1.0 for x in R.gaussian_weights(0.8))
    want = _smooth(np.arange(n) % 101.0, 0.8) * across
    assert np.allclose([found[i] for i in range(n)], want, rtol=1e-12)


def test_smoothing_of_uneven_scenes_over_batches(spark):
    rng = np.random.default_rng(8)
    scenes = {s: rng.random(shape) * 30 for s, shape in enumerate([(1, 1), (1, 2), (3, 1), (7, 400), (150, 9)])}
    rows = [(s, y, x, float(h[y, x])) for s, h in scenes.items() for y in range(h.shape[0]) for x in range(h.shape[1])]
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 64)
    try:
        found = {tuple(r)[:3]: r.h for r in R.gaussian(spark.createDataFrame(rows[::-1], PIXEL), 1.5).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert len(found) == len(rows)
    for s, h in scenes.items():
        want = np.apply_along_axis(_smooth, 0, np.apply_along_axis(_smooth, 1, h, 1.5), 1.5)
        assert all(found[s, y, x] == want[y, x] for y in range(h.shape[0]) for x in range(h.shape[1]))


def test_peaks_read_their_raster_once(spark, monkeypatch):
    plans = []
    write = R.written
    monkeypatch.setattr(R, "written", lambda df, name: plans.append((name, df._jdf.queryExecution().executedPlan().toString())) or write(df, name))
    rng = np.random.default_rng(9)
    h = rng.integers(0, 12, (40, 33)).astype(float)
    raster = spark.createDataFrame([(0, y, x, float(h[y, x])) for y in range(40) for x in range(33)], PIXEL)
    geo = spark.createDataFrame([(0, 33, 40)], "scene_id int, n_cols int, n_rows int")
    found = {(r.iy, r.ix) for r in R.local_maxima(raster, geo, 2, 2.0).collect()}
    tops = [(y, x) for y in range(2, 38) for x in range(2, 31) if h[y, x] == h[y - 2 : y + 3, x - 2 : x + 3].max() > 2]
    beaten = {(y, x) for y, x in tops for v, u in tops if (v, u) < (y, x) and abs(v - y) <= 2 and abs(u - x) <= 2 and h[v, u] == h[y, x]}
    assert found == set(tops) - beaten and beaten
    assert [name for name, _ in plans] == ["maxima"]
    assert plans[0][1].count("Scan ExistingRDD") + plans[0][1].count("LocalTableScan") == 2  # the raster and its grid


def test_a_closing_and_its_smoothing_share_shuffles(spark):
    rng = np.random.default_rng(10)
    h = rng.random((30, 21)) * 30
    raster = spark.createDataFrame([(0, y, x, float(h[y, x])) for y in range(30) for x in range(21)], PIXEL)

    def cross(a, pick, edge):
        p = np.pad(a, 1, constant_values=edge)
        return pick.reduce([p[1:-1, 1:-1], p[:-2, 1:-1], p[2:, 1:-1], p[1:-1, :-2], p[1:-1, 2:]])

    want = cross(cross(h, np.maximum, -np.inf), np.minimum, np.inf)
    closed = R.close_cross(raster)
    assert all(r.h == want[r.iy, r.ix] for r in closed.collect())
    plan = R.gaussian(closed, 0.8)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 4  # rows, columns twice, rows twice, columns


def test_grids_of_one_file_are_dealt_to_tasks(spark):
    geo = spark.createDataFrame([(s, 30, 20) for s in range(3)], "scene_id int, n_cols int, n_rows int").coalesce(1)
    raster = spark.createDataFrame([(1, 2, 3, 4.0)], PIXEL)
    full = R.densify(raster, geo)
    plan = full._jdf.queryExecution().executedPlan().toString()
    assert plan.index("explode(sequence(0, (n_cols") < plan.index("REPARTITION_BY_NUM") < plan.index("explode(sequence(0, (n_rows")  # from the result down: pixels, deal, lines
    rows = full.collect()
    assert len(rows) == 1800 and [(r.scene_id, r.iy, r.ix) for r in rows if r.h] == [(1, 2, 3)]
