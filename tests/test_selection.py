"""Percentiles in bounded state against F.percentile."""

import math
import random

import pytest
from pyspark.sql import functions as F

from arborspark.operators.selection import percentiles


def _same(got, want):
    assert set(got) == set(want)
    for k, values in want.items():
        for a, b in zip(got[k], values, strict=True):
            assert (a is None and b is None) or a == b or (math.isnan(a) and math.isnan(b)), (k, got[k], values)


@pytest.mark.parametrize("held,bins", [(40, 64), (100_000, 16)])
def test_equal_to_percentile(spark, held, bins):
    rng = random.Random(3)
    rows = [(1, rng.uniform(0, 40), i) for i in range(700)]
    rows += [(2, round(rng.gauss(0, 1), 1), i) for i in range(500)]  # ties
    rows += [(3, 5.0, i) for i in range(200)]  # one value
    rows += [(4, 10.0 ** rng.randint(-300, 300) * rng.choice((-1, 1)), i) for i in range(300)]  # far apart
    rows += [(5, None, i) for i in range(5)] + [(6, 1.5, 0)] + [(None, rng.random(), i) for i in range(90)]
    rows += [(7, 1.7e308 * (-1) ** i, i) for i in range(61)]  # wider than a double
    df = spark.createDataFrame(rows, "k int, v double, i int").repartition(5)
    wanted = {"low": (F.when(F.col("v") > 0, F.col("v")), 0.05), "mid": (F.col("v"), 0.5), "high": (F.col("v"), 0.99), "top": (F.col("v"), 1.0), "bottom": (F.col("v"), 0.0)}
    got = {r.k: tuple(r)[1:] for r in percentiles(df, ["k"], wanted, held, bins).collect()}
    plain = df.groupBy("k").agg(*[F.percentile(c, F.lit(p)).alias(n) for n, (c, p) in wanted.items()])
    _same(got, {r.k: tuple(r)[1:] for r in plain.collect()})


def test_infinite_and_not_numbers(spark):
    odd = [float("inf"), float("-inf"), float("nan")]
    rows = [(1, v) for v in odd * 8] + [(1, float(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "k int, v double")
    for p in (0.1, 0.9):
        got = percentiles(df, ["k"], {"p": (F.col("v"), p)}, 20, 8).first().p
        want = sorted((v for _, v in rows), key=lambda v: (math.isnan(v), v))
        at = (len(want) - 1) * p
        if want[math.floor(at)] == want[math.ceil(at)] or math.isnan(want[math.floor(at)]):
            assert got == want[math.floor(at)] or math.isnan(got)


def test_empty_tables_and_several_keys(spark):
    schema = "a int, b string, v double"
    assert percentiles(spark.createDataFrame([], schema), ["a", "b"], {"p": (F.col("v"), 0.5)}, 2).count() == 0
    rows = [(i % 2, "xy"[i % 3 % 2], float(i * i % 37)) for i in range(200)]
    df = spark.createDataFrame(rows, schema)
    got = {(r.a, r.b): (r.p,) for r in percentiles(df, ["a", "b"], {"p": (F.col("v"), 0.9)}, 8, 8).collect()}
    _same(got, {(r.a, r.b): (r.p,) for r in df.groupBy("a", "b").agg(F.percentile("v", F.lit(0.9)).alias("p")).collect()})


def test_ground_levels_of_large_scenes(spark, monkeypatch):
    """Users of percentiles give the same levels when their scenes are narrowed by histograms."""
    from arborspark.operators import points as P
    from arborspark.operators import raster as R
    from arborspark.operators import selection

    rng = random.Random(5)
    rows = [(s, i, rng.uniform(0, 9), rng.uniform(0, 9), rng.uniform(0, 30), 2 + i % 4 if s < 2 else 1 + s % 2) for s in range(4) for i in range(150)]
    points = spark.createDataFrame(rows, "scene_id int, pid long, x double, y double, z double, cls int")
    raster = points.select("scene_id", F.floor("y").alias("iy"), F.col("pid").alias("ix"), (F.col("z") - 10).alias("h"))

    def results():
        return [sorted(map(tuple, df.collect())) for df in (P.ground_level(points), P.normalised_vegetation(points), P.normalised_vegetation(points, bare="lowest"), R.percentile_stretch(raster))]

    plain = results()
    monkeypatch.setattr(selection.percentiles, "__defaults__", (20, 32, ()))
    assert results() == plain
