"""Operators on point tables (scene_id, pid, x, y, z, cls): filters, normalisation, projections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .selection import percentiles

GROUND, VEGETATION = 2, (3, 4, 5)
_GROUND = ("CASE WHEN cls = 2 THEN z END", 0.5)


def ground_level(points: DataFrame) -> DataFrame:
    """scene_id, z_ground: the median height of ground returns, else the lowest point."""
    levels = percentiles(points, ["scene_id"], {"_ground": _GROUND}, more=[F.min("z").alias("_low")])
    return levels.select("scene_id", F.coalesce("_ground", "_low").alias("z_ground"))


def height_normalise(points: DataFrame) -> DataFrame:
    """z becomes the height above the scene's ground level."""
    return points.join(ground_level(points), "scene_id").withColumn("z", F.col("z") - F.col("z_ground")).drop("z_ground")


def vegetation(points: DataFrame, min_z: float = 2.0) -> DataFrame:
    """Vegetation returns of normalised points; scenes without any keep all points of at least min_z."""
    has = points.groupBy("scene_id").agg(F.max(F.col("cls").isin(*VEGETATION)).alias("_has"))
    kept = F.when(F.col("_has"), F.col("cls").isin(*VEGETATION)).otherwise(F.col("z") >= min_z)
    return points.join(has, "scene_id").filter(kept).drop("_has")


def normalised_vegetation(points: DataFrame, min_z: float = 2.0, bare: str = "median") -> DataFrame:
    """vegetation(height_normalise(points)) with the same aggregates and one join.

    bare: scenes without vegetation stand on their `median` ground or on their `lowest` point.
    """
    has = F.max(F.col("cls").isin(*VEGETATION)).alias("_has")
    levels = percentiles(points, ["scene_id"], {"_ground": _GROUND}, more=[F.min("z").alias("_low"), has])
    level = F.coalesce("_ground", "_low") if bare == "median" else F.when(F.col("_has"), F.coalesce("_ground", "_low")).otherwise(F.col("_low"))
    p = points.join(levels.select("scene_id", "_has", level.alias("_ground")), "scene_id")
    p = p.withColumn("z", F.col("z") - F.col("_ground"))
    return p.filter(F.when(F.col("_has"), F.col("cls").isin(*VEGETATION)).otherwise(F.col("z") >= min_z)).drop("_has", "_ground")


def min_height(points: DataFrame, h: float) -> DataFrame:
    return points.filter(F.col("z") >= h)


def class_of_height(z: Column) -> Column:
    return F.when(z < 0.5, 2).when(z < 2, 3).when(z < 5, 4).otherwise(5)


def dropout(points: DataFrame, u: Column, rate: float) -> DataFrame:
    """Bernoulli thinning of vegetation: a point stays if its uniform number is above rate."""
    return points.filter(~F.col("cls").isin(*VEGETATION) | (u > rate))


def occlusion_thin(points: DataFrame, u: Column, transparency: float = 0.8, cell: float = 0.25) -> DataFrame:
    """A point d below the top of its column stays with probability transparency ** d."""
    if transparency >= 0.99:
        return points
    top = F.max("z").over(Window.partitionBy("scene_id", F.floor(F.col("x") / cell), F.floor(F.col("y") / cell)))
    return points.withColumn("_d", top - F.col("z")).filter(u <= F.pow(F.lit(transparency), F.col("_d"))).drop("_d")


def in_void(x: Column, y: Column, river: tuple[float, float, float, float, float] | None, lakes: Sequence[tuple[float, float, float]]) -> Column:
    """Inside the river (amplitude, frequency, phase, centre, width) or one of the lakes (x, y, radius)."""
    out = F.lit(False)
    if river:
        amplitude, frequency, phase, centre, width = river
        out = F.abs(y - (amplitude * F.sin(frequency * x + phase) + centre)) < width / 2
    for cx, cy, r in lakes:
        out = out | (F.hypot(x - cx, y - cy) < r)
    return out


def in_crown(shape: Column, d: Column, z: Column, h: Column, r: Column) -> Column:
    """Whether a point at distance d and height z is part of a tree of height h and crown radius r."""
    ball = F.pow(d / r, 2) + F.pow((z - 0.6 * h) / (0.4 * h), 2) <= 1
    stem = (d < 0.3 * r) & (z < 0.2 * h)
    return F.when(shape == "conical", d <= r * (1 - z / h) * 2.6).otherwise(ball | stem)


def polygon_crop(points: DataFrame, polygon: Sequence[tuple[float, float]]) -> DataFrame:
    """Points inside a polygon of at least three vertices, by the even-odd rule."""
    if len(polygon) < 3:
        return points.limit(0)
    x, y, crossings = F.col("x"), F.col("y"), F.lit(0)
    for (x1, y1), (x2, y2) in zip(polygon, [*polygon[1:], polygon[0]], strict=True):
        if y1 != y2:
            crosses = (F.lit(y1) > y).__ne__(F.lit(y2) > y) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)
            crossings = crossings + crosses.cast("int")
    xs, ys = [p[0] for p in polygon], [p[1] for p in polygon]
    box = x.between(min(xs), max(xs)) & y.between(min(ys), max(ys))  # reaches the scan
    return points.filter(box & (crossings % 2 == 1))


def nearest_vertex(x: Column, y: Column, polygon: Sequence[tuple[float, float]], tolerance: float) -> Column:
    """Number of the polygon's vertex nearest to (x, y), the first of equals; null if it is not nearer than tolerance."""
    at = [F.struct(F.hypot(x - vx, y - vy).alias("d"), F.lit(i).alias("i")) for i, (vx, vy) in enumerate(polygon)]
    near = F.array_min(F.array(*at))
    return F.when(near["d"] < tolerance, near["i"])


def height_slices(points: DataFrame, thickness: float = 0.5) -> DataFrame:
    """slice_id from the top of each scene down; a slice holds (bottom, top]."""
    top = points.groupBy("scene_id").agg(F.max("z").alias("_top"))
    return points.join(top, "scene_id").withColumn("slice_id", F.floor((F.col("_top") - F.col("z")) / thickness).cast("int")).drop("_top")


def axis_samples(nodes: DataFrame, spacing: float = 0.5) -> DataFrame:
    """Points along axes of nodes (scene_id, axis_id, step, x, y, z): every segment in equal steps, both ends included."""
    w = Window.partitionBy("scene_id", "axis_id").orderBy("step")
    ends = {f"{c}2": F.lead(c).over(w) for c in "xyz"}
    d = F.sqrt(sum((F.pow(F.col(f"{c}2") - F.col(c), 2) for c in "xyz"), F.lit(0.0)))
    n = F.greatest(F.lit(1), F.floor(d / spacing).cast("int"))
    segments = nodes.withColumns(ends).filter("x2 IS NOT NULL").withColumn("n", n)
    parts = segments.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n"))))
    return parts.select("scene_id", "axis_id", "step", "i", *[(F.col(c) + (F.col(f"{c}2") - F.col(c)) * F.col("i") / F.col("n")).alias(c) for c in "xyz"])
