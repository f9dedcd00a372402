"""Statistics and shapes of point clusters (keys, x, y, z)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONE, BALL, UNKNOWN = "conical", "spherical", "undefined"


def cluster_stats(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """n, centroid, height range, top point and population deviation of heights of every cluster."""
    top = F.max_by(F.struct("x", "y", "pid"), F.struct("z", -F.col("pid")))
    out = points.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.min("z").alias("z_min"), F.max("z").alias("z_max"), F.stddev_pop("z").alias("z_dev"), top.alias("top"))
    return out.select(*keys, "n", "cx", "cy", "z_min", "z_max", "z_dev", F.col("top.x").alias("top_x"), F.col("top.y").alias("top_y"), F.col("top.pid").alias("top_pid"))


def vertical_clusters(stats: DataFrame, least: int = 10, spread: float = 0.10) -> DataFrame:
    """Clusters with enough points whose heights spread enough for a tree."""
    return stats.filter((F.col("n") >= least) & (F.coalesce(F.try_divide("z_dev", "z_max"), F.lit(0.0)) >= spread))


def weighted_centre(points: DataFrame, keys: Sequence[str], power: int = 4) -> DataFrame:
    """Centre of each cluster with weights z ** power."""
    w = F.pow("z", F.lit(float(power)))
    return points.groupBy(*keys).agg(F.try_divide(F.sum(F.col("x") * w), F.sum(w)).alias("wx"), F.try_divide(F.sum(F.col("y") * w), F.sum(w)).alias("wy"))


def mean_of_top(nodes: DataFrame, keys: Sequence[str], p: float = 0.8) -> DataFrame:
    """keys, x, y: mean of each cluster's nodes above percentile p of their heights, else of all."""
    high = nodes.groupBy(*keys).agg(F.percentile("z", F.lit(p)).alias("_high"))
    at = lambda c: F.coalesce(F.avg(F.when(F.col("z") > F.col("_high"), F.col(c))), F.avg(c)).alias(c)
    return nodes.join(high, list(keys)).groupBy(*keys).agg(at("x"), at("y"))


def percentile_radius(points: DataFrame, keys: Sequence[str], p: float = 0.9, stats: DataFrame | None = None) -> DataFrame:
    """radius: percentile p, and r_max: maximum, of the horizontal distance to the centroid.  stats: cluster_stats of the points, where they are at hand."""
    centre = points.groupBy(*keys).agg(F.avg("x").alias("cx"), F.avg("y").alias("cy")) if stats is None else stats.select(*keys, "cx", "cy")
    d = F.hypot(F.col("x") - F.col("cx"), F.col("y") - F.col("cy"))
    return points.join(centre, list(keys)).withColumn("d", d).groupBy(*keys).agg(F.percentile("d", F.lit(p)).alias("radius"), F.max("d").alias("r_max"))


def radial_profile(points: DataFrame, keys: Sequence[str], bins: int = 7, least: int = 3, p: float = 0.85, stats: DataFrame | None = None) -> DataFrame:
    """keys, bin, depth, r: percentile p of the distance to the top point by equal bins of depth below it; bins of more than `least` points.

    stats: cluster_stats of the points, where they are at hand.
    """
    stats = (cluster_stats(points, keys) if stats is None else stats).select(*keys, "top_x", "top_y", "z_max")
    q = points.join(stats, list(keys)).withColumn("dz", F.col("z_max") - F.col("z"))
    q = q.withColumn("bin", F.floor(F.try_divide(F.col("dz"), F.col("z_max") / bins)).cast("int")).filter((F.col("bin") >= 0) & (F.col("bin") < bins))
    d = F.hypot(F.col("x") - F.col("top_x"), F.col("y") - F.col("top_y"))
    out = q.groupBy(*keys, "bin").agg(F.count("*").alias("n"), F.percentile(d, F.lit(p)).alias("r"), F.max("z_max").alias("z_max"))
    return out.filter(F.col("n") > least).select(*keys, "bin", ((F.col("bin") + 0.5) * F.col("z_max") / bins).alias("depth"), "r")


def cone_or_ball(nodes: DataFrame, keys: Sequence[str], depth: str = "depth", r: str = "r", least: int = 3, epsilon: float = 0.0) -> DataFrame:
    """keys, shape: which of r = k depth and r = k sqrt(depth) leaves the smaller squared error."""
    h, v = F.col(depth), F.col(r)
    fit = nodes.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.try_divide(F.sum(v * h), F.sum(h * h) + epsilon).alias("kc"),
        F.try_divide(F.sum(v * F.sqrt(h)), F.sum(h) + epsilon).alias("kb"),
    )
    error = nodes.join(fit, list(keys)).groupBy(*keys).agg(F.first("n").alias("n"), F.sum(F.pow(v - F.col("kc") * h, 2)).alias("cone"), F.sum(F.pow(v - F.col("kb") * F.sqrt(h), 2)).alias("ball"))
    return error.select(*keys, F.when(F.col("n") < least, UNKNOWN).when(F.col("cone") < F.col("ball"), CONE).otherwise(BALL).alias("shape"))


def correlation(x: Column, y: Column) -> Column:
    """Pearson correlation as an aggregate; null where a side is constant."""
    n, sx, sy = F.count(x), F.sum(x), F.sum(y)
    vx, vy = F.sum(x * x) - sx * sx / n, F.sum(y * y) - sy * sy / n
    return F.try_divide(F.sum(x * y) - sx * sy / n, F.when((vx > 1e-12) & (vy > 1e-12), F.sqrt(vx * vy)))


def shape_by_mean(stats: DataFrame) -> DataFrame:
    """Conical where the mean height is under 0.6 of the top."""
    return stats.withColumn("shape", F.when(F.col("mean_h") < 0.6 * F.col("max_h"), CONE).otherwise(BALL))


def shape_by_correlation(points: DataFrame, keys: Sequence[str], least: int = 10) -> DataFrame:
    """Conical where the distance to the weighted centre grows with depth (r > 0.7) or the mass lies low (mean z / top < 0.45).

    The correlation leaves out the top and points at the centre; clusters of fewer than `least` points, or of
    fewer than five after that, are spherical.
    """
    q = points.join(weighted_centre(points, keys), list(keys)).join(points.groupBy(*keys).agg(F.max("z").alias("top")), list(keys))
    q = q.withColumn("r", F.hypot(F.col("x") - F.col("wx"), F.col("y") - F.col("wy"))).withColumn("depth", F.col("top") - F.col("z"))
    fits = (F.col("r") > 0) & (F.col("depth") > 0)
    r, depth = F.when(fits, F.col("r")), F.when(fits, F.col("depth"))
    low = F.coalesce(F.try_divide(F.avg("z"), F.max("top")), F.lit(1.0))
    out = q.groupBy(*keys).agg(F.count("*").alias("n"), F.count(r).alias("fit"), correlation(r, depth).alias("corr"), low.alias("low"))
    cone = (F.coalesce("corr", F.lit(0.0)) > 0.7) | (F.col("low") < 0.45)
    return out.select(*keys, F.when((F.col("n") < least) | (F.col("fit") < 5), BALL).when(cone, CONE).otherwise(BALL).alias("shape"))


def shape_by_profile(nodes: DataFrame, heights: DataFrame, keys: Sequence[str], least: int = 5) -> DataFrame:
    """Conical where the radii of a stack's nodes(keys, z, r) follow the depth below heights(keys, height) better than its root."""
    q = nodes.join(heights.select(*keys, "height"), list(keys)).withColumn("depth", F.col("height") - F.col("z"))
    q = q.join(q.groupBy(*keys).agg(F.max("depth").alias("_deep"), F.max("r").alias("_wide")), list(keys))
    h, r = F.col("depth") / (F.col("_deep") + 0.01), F.col("r") / (F.col("_wide") + 0.01)
    line, root = correlation(r, h), correlation(r, F.sqrt(F.greatest(h, F.lit(0.0))))
    return q.groupBy(*keys).agg(F.when((F.count("*") >= least) & (line > root), CONE).otherwise(BALL).alias("shape"))
