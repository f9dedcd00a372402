"""Labelled synthetic forest scenes, one row of parameters a scene.

Points are made by Spark: every ground cell, tree and noise point is a row of an
exploded sequence, with uniforms hashed from (seed, scene, object, index), so a
scene is the same on any cluster.  Only the forest plan, which accepts trees one
after another, is a small kernel a scene.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import points as P

PLAN = "scene_id int, tree_id int, x double, y double, height double, radius double, shape string"
PARAMETERS = "scene_id int, seed int, size_x double, size_y double, noise_level double, dropout_rate double, overlap_factor double, mixing_factor double, gap_factor double"


def _u(*key: Column | str | int) -> Column:
    parts = [F.lit(k) if isinstance(k, int) else F.col(k) if isinstance(k, str) else k for k in key]
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 52)) / F.lit(float(1 << 52))


def plan_forest(parameters: DataFrame) -> DataFrame:
    """The trees of every scene: random places that keep their distance and avoid voids, at most five tries a tree."""

    def grow(rows: pd.DataFrame) -> pd.DataFrame:
        p = rows.iloc[0]
        rng = np.random.default_rng(int(p.seed))
        want, trees = int(p.size_x * p.size_y * (0.5 + p.overlap_factor) / 25), []
        lakes = [(rng.uniform(0, p.size_x), rng.uniform(0, p.size_y), rng.uniform(2, max(2.0, 0.1 * p.size_x))) for _ in range(int(4 * p.gap_factor))]
        for _ in range(5 * want):
            if len(trees) >= want:
                break
            h = rng.triangular(4, 25, 35)
            r, x, y = 1.5 + 3.5 * h / 35, rng.uniform(0, p.size_x), rng.uniform(0, p.size_y)
            if any(math.hypot(x - a, y - b) < c for a, b, c in lakes):
                continue
            if any(math.hypot(x - t[2], y - t[3]) < max(0.5, (r + t[5]) * (1 - p.overlap_factor)) for t in trees):
                continue
            cone = (x < p.size_x / 2) != (rng.random() < p.mixing_factor)
            trees.append((int(p.scene_id), len(trees), x, y, h, r, "conical" if cone else "spherical"))
        return pd.DataFrame(trees, columns=["scene_id", "tree_id", "x", "y", "height", "radius", "shape"])

    return parameters.groupBy("scene_id").applyInPandas(grow, PLAN)


def _relief(x: Column, y: Column) -> Column:
    return 1.5 * F.sin(0.05 * x) + 1.5 * F.cos(0.05 * y) + 3.0


def generate(parameters: DataFrame, plan: DataFrame, step: float = 0.25, density: float = 4.0, transparency: float = 0.8) -> DataFrame:
    """points(scene_id, pid, x, y, z, cls) of planned scenes: ground, stems and crowns, noise, then occlusion."""
    s = parameters.withColumn("i", F.explode(F.sequence(F.lit(0), F.floor(F.col("size_x") / step).cast("int"))))
    s = s.withColumn("j", F.explode(F.sequence(F.lit(0), F.floor(F.col("size_y") / step).cast("int"))))
    jitter = lambda k: (_u("seed", "scene_id", "i", "j", k) - 0.5) * 0.1
    s = s.withColumn("x", F.col("i") * step + jitter(1)).withColumn("y", F.col("j") * step + jitter(2))
    ground = s.select("scene_id", F.xxhash64(F.lit("ground"), "i", "j").alias("pid"), "x", "y", (_relief(F.col("x"), F.col("y")) + 0.4 * jitter(3)).alias("z"), F.lit(P.GROUND).alias("cls"))

    t = plan.join(parameters.select("scene_id", "seed", "dropout_rate"), "scene_id").withColumn("stem", F.floor(10 * F.col("height")).cast("int"))
    leaves = F.least(F.lit(50_000), F.floor(density * F.col("radius") * F.col("radius") * F.col("height"))).cast("int")
    t = t.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("stem") + leaves)))
    u = lambda n: _u("seed", "scene_id", "tree_id", "k", n)
    trunk, turn = F.col("k") < F.col("stem"), 2 * math.pi * u(4)
    d = F.when(trunk, 0.15 * u(5)).otherwise(F.col("radius") * u(5))
    up = F.when(trunk, 0.9 * F.col("height") * u(6)).otherwise(F.col("height") * u(6))
    t = t.withColumn("d", d).withColumn("up", up).filter(trunk | P.in_crown(F.col("shape"), F.col("d"), F.col("up"), F.col("height"), F.col("radius"))).filter(u(7) > F.col("dropout_rate"))
    tree = t.select("scene_id", F.xxhash64(F.lit("tree"), "tree_id", "k").alias("pid"), (F.col("x") + F.col("d") * F.cos(turn)).alias("x"), (F.col("y") + F.col("d") * F.sin(turn)).alias("y"), (_relief(F.col("x"), F.col("y")) + F.col("up")).alias("z"), P.class_of_height(F.col("up")).alias("cls"))

    both = ground.unionByName(tree)
    n = both.groupBy("scene_id").count().join(parameters, "scene_id").withColumn("n", F.floor(F.col("count") * F.col("noise_level")).cast("int")).filter("n > 0")
    n = n.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n"))))
    w = lambda i: _u("seed", "scene_id", "k", i)
    noise = n.select("scene_id", F.xxhash64(F.lit("noise"), "k").alias("pid"), (F.col("size_x") * w(8)).alias("x"), (F.col("size_y") * w(9)).alias("y"), (45.0 * w(10)).alias("z"), (3 + F.floor(3 * w(11))).cast("int").alias("cls"))
    return P.occlusion_thin(both.unionByName(noise), _u("scene_id", "pid", 12), transparency, max(step, 0.25))
