"""Point clouds, trees and benchmark results derived from the driver's tables.

Scenes hold a bounded number of rows (2,500 points, 5 trees), so their number
grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table

FACTORS = ("noise_level", "dropout_rate", "overlap_factor", "mixing_factor", "gap_factor")


def uniform(k: Column) -> Column:
    """A reproducible uniform number in [0, 1) for an integer key."""
    return F.conv(F.substring(F.md5(k.cast("string")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scene_id, pid, x, y, z, cls of an airborne scan, 25 m x 25 m a scene."""
    e = table(spark, sf_dir, "events").select("event_id", "value")
    k = F.col("event_id")
    return e.select(
        F.floor(k / 2500).cast("int").alias("scene_id"),
        k.alias("pid"),
        (uniform(k * 2) * 25.0).alias("x"),
        (uniform(k * 2 + 1) * 25.0).alias("y"),
        (F.col("value") / 10.0).alias("z"),
        (2 + (k % 7) % 4).cast("int").alias("cls"),
    )


def polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scene_id, polygon_id, vertices of a polygon a part, 500 a scene: 3 to 12 vertices in a square of 1 to 8 m; most cross themselves."""
    p, k = table(spark, sf_dir, "part").select("p_partkey"), F.col("p_partkey")
    size = 1.0 + uniform(k * 131 + 90) * 7.0
    vertex = lambda i: F.struct(*[(uniform(k * 131 + 91 + j) * 25.0 + uniform(k * 131 + 2 * i + j) * size).alias(c) for j, c in enumerate("xy")])
    return p.select(F.floor(k / 500).cast("int").alias("scene_id"), k.alias("polygon_id"), F.transform(F.sequence(F.lit(0), 2 + k % 10), vertex).alias("vertices"))


def trees_ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k = table(spark, sf_dir, "part").select("p_partkey", "p_size"), F.col("p_partkey")
    height = 4.0 + F.col("p_size") * 0.6
    return p.select(
        F.floor(k / 5).cast("int").alias("scene_id"),
        k.cast("int").alias("tree_id"),
        (uniform(k * 3) * 10.0).alias("x"),
        (uniform(k * 3 + 1) * 10.0).alias("y"),
        height.alias("height"),
        (1.5 + height / 35.0 * 3.5).alias("radius"),
        F.when(k % 2 == 0, "conical").otherwise("spherical").alias("shape"),
    )


def trees_pred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections: every ninth tree is missed, the others are perturbed."""
    p, k = table(spark, sf_dir, "part").select("p_partkey", "p_size"), F.col("p_partkey")
    return p.filter(k % 9 != 0).select(
        F.floor(k / 5).cast("int").alias("scene_id"),
        k.cast("int").alias("tree_id"),
        (uniform(k * 3) * 10.0 + uniform(k * 7 + 5) * 3.0).alias("x"),
        (uniform(k * 3 + 1) * 10.0).alias("y"),
        (4.0 + F.col("p_size") * 0.6 + uniform(k * 11) - 0.5).alias("height"),
        (1.5 + uniform(k * 13) * 3.0).alias("radius"),
        F.when(k % 3 == 0, "conical").otherwise("spherical").alias("shape"),
    )


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark runs: one factor away from zero a row."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "user_id", "value")
    level = (F.col("user_id") % 11) / 10.0
    return e.select(
        F.col("event_id").alias("run_id"),
        F.col("event_type").alias("parser"),
        F.col("value").alias("score"),
        (F.col("value") / 7.0).alias("duration"),
        *[F.when(F.col("event_id") % 5 == i, level).otherwise(F.lit(0.0)).alias(f) for i, f in enumerate(FACTORS)],
    )
