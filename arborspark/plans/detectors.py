"""The six tree detectors as compositions of operators: points(scene_id, pid, x, y, z, cls) -> trees.

Every detector returns scene_id, tree_id, x, y, height, radius, shape.  All of a
table's scenes run in the same jobs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import points as P
from ..operators import raster as R
from ..operators import shape as H
from ..operators import spatial as X
from ..operators.axes import crown_axes
from ..scratch import discard, written

TREE = ("scene_id", "tree_id", "x", "y", "height", "radius", "shape")
LABEL = ("scene_id", "label")


def _vegetation(points: DataFrame, min_z: float = 2.0, bare: str = "median") -> DataFrame:
    return written(P.normalised_vegetation(points, min_z, bare), "vegetation")


def _cleaned(points: DataFrame, min_z: float, k: int, multiplier: float) -> DataFrame:
    """Normalised points from min_z upwards without outliers; heights are written, since the filter reads them five times."""
    high = written(P.min_height(P.height_normalise(points), min_z), "heights")
    p = written(X.outlier_filter(high, k, multiplier), "points")
    discard(high)
    return p


def _rank(height: str) -> Column:
    """Tree numbers of a scene, the tallest first."""
    return F.row_number().over(Window.partitionBy("scene_id").orderBy(F.desc(height), "label")).cast("int")


def _far() -> Column:
    return F.hypot(F.col("t_x") - F.col("q_x"), F.col("t_y") - F.col("q_y"))


def chm_watershed(points: DataFrame, res: float = 0.5) -> DataFrame:
    """Canopy raster, closed and smoothed; the flood from its peaks, about 2 m apart, gives one tree a peak."""
    p = _vegetation(points)
    geo = written(R.extent(p, res), "extent")
    raster = written(R.gaussian(R.close_cross(R.densify(R.rasterise(p, geo, res), geo)), 1.0), "raster")
    peaks = R.local_maxima(raster, geo, int(2.0 / res), 2.0)
    regions = R.region_properties(R.watershed(raster, peaks, 2.0), res).filter("max_h >= 2.0")
    trees = H.shape_by_mean(R.pixel_xy(regions, geo, res, "row", "col"))
    return trees.select("scene_id", _rank("max_h").alias("tree_id"), "x", "y", F.col("max_h").alias("height"), "radius", "shape")


def slice_nodes(points: DataFrame, eps: float, least: int) -> DataFrame:
    """slice_id, cluster_id, x, y, z, r of the clusters of half-metre slices; slices under five points have none."""
    keys = ("scene_id", "slice_id")
    sliced = P.height_slices(points)
    sliced = written(sliced.join(sliced.groupBy(*keys).count().filter("count >= 5").drop("count"), list(keys)), "slices")
    found = written(X.dbscan(sliced, eps, least, "xy", keys), "clusters")  # read twice below
    c = X.shuffled_join(sliced, found, [*keys, "pid"])
    centre = c.groupBy(*keys, "cluster_id").agg(*[F.avg(a).alias(f"c{a}") for a in "xyz"])
    r = F.max(F.hypot(F.col("x") - F.col("cx"), F.col("y") - F.col("cy")))
    nodes = c.join(centre, [*keys, "cluster_id"]).groupBy(*keys, "cluster_id").agg(F.first("cx").alias("x"), F.first("cy").alias("y"), F.first("cz").alias("z"), r.alias("r"))
    return written(nodes.withColumn("pid", F.col("cluster_id")), "nodes")


def _linked(nodes: DataFrame, squeeze: float, eps: float) -> DataFrame:
    """Slice nodes with the label of their stack.  A node's id is its cluster's least point, unique in the scene."""
    flat = nodes.withColumn("z", F.col("z") / squeeze)
    found = X.dbscan(flat, eps, 3, "xyz").withColumnRenamed("cluster_id", "label")
    return written(nodes.join(found, ["scene_id", "pid"]), "stacks")


def layer_stack(points: DataFrame) -> DataFrame:
    """Slices clustered in the plane and linked upwards; one tree a stack at least 2 m high."""
    n = _linked(slice_nodes(_vegetation(points), 0.8, 4), 2.0, 1.5)
    stats = n.groupBy(*LABEL).agg(F.max_by(F.struct("x", "y"), F.struct("z", -F.col("pid"))).alias("top"), F.max("z").alias("height"), F.min("z").alias("low"), F.percentile("r", F.lit(0.9)).alias("radius"))
    stats = stats.filter(F.col("height") - F.col("low") >= 2.0)
    nodes = n.join(stats.select(*LABEL, "height"), list(LABEL)).withColumn("depth", F.col("height") - F.col("z"))
    shape = H.cone_or_ball(nodes, LABEL, epsilon=1e-6)
    return stats.join(shape, list(LABEL)).select("scene_id", _rank("height").alias("tree_id"), F.col("top.x").alias("x"), F.col("top.y").alias("y"), "height", "radius", "shape")


def _crown(points: DataFrame, min_z: float, strict: bool) -> DataFrame:
    """Peaks snap to points, axes descend through the crown, points join the nearest axis."""
    p = _vegetation(points, min_z, "lowest" if strict else "median")
    p = written(p.filter(F.col("z") >= min_z), "points") if strict else p
    geo = written(R.extent(p, 0.5, whole=True), "extent")
    raster = written(R.gaussian(R.densify(R.rasterise(p, geo, 0.5), geo), 1.5), "raster")
    peaks = written(R.pixel_xy(R.local_maxima(raster, geo, 5, min_z), geo, 0.5).select("scene_id", F.col("peak_id").alias("axis_id"), "x", "y", F.col("h").alias("z")), "peaks")
    axes = written(crown_axes(X.snap_to_top(peaks, p, 15, 1.0), p, min_z / 2), "axes")
    samples = P.axis_samples(axes).withColumn("z", F.col("z") * 0.3).withColumn("pid", F.struct("axis_id", "step", "i"))
    flat = p.withColumn("z", F.col("z") * 0.3).select("scene_id", "pid", "x", "y", "z")
    own = X.nearest_join(flat, samples.select("scene_id", "pid", "axis_id", "x", "y", "z"), 1, 1.0, "xyz", "pid", "pid", wanted=("r_axis_id",)).select("scene_id", "pid", F.col("r_axis_id").cast("long").alias("label"))
    c = written(p.join(own, ["scene_id", "pid"]), "crowns")
    whole = written(H.cluster_stats(c, LABEL), "crown-stats")
    stats = whole.filter((F.col("n") >= 30) & (F.col("z_max") >= min_z))
    radius = H.percentile_radius(c, LABEL, 0.9, whole).select(*LABEL, "radius")
    shape = H.cone_or_ball(written(H.radial_profile(c, LABEL, stats=whole), "profiles"), LABEL, epsilon=1e-6 if strict else 0.0)
    out = stats.join(radius, list(LABEL)).join(shape, list(LABEL), "left")
    return out.select("scene_id", F.col("label").cast("int").alias("tree_id"), F.col("top_x").alias("x"), F.col("top_y").alias("y"), F.col("z_max").alias("height"), "radius", F.coalesce("shape", F.lit(H.UNKNOWN)).alias("shape"))


def crown_axis(points: DataFrame) -> DataFrame:
    return _crown(points, 2.0, False)


def crown_axis_strict(points: DataFrame) -> DataFrame:
    return _crown(points, 2.5, True)


def smart_fusion(points: DataFrame, res: float = 0.3) -> DataFrame:
    """Stacked slices, raised to the canopy raster; peaks of the raster that no stack covers are added; duplicates fall."""
    p = _cleaned(points, 2.5, 8, 1.5)
    geo = written(R.extent(p, res), "extent")
    raster = written(R.gaussian(R.close_cross(R.densify(R.rasterise(p, geo, res), geo)), 0.8), "raster")
    n = _linked(slice_nodes(p, 0.9, 5), 4.0, 2.0)
    high = n.groupBy(*LABEL).agg(F.percentile("r", F.lit(0.9)).alias("radius"), F.max("z").alias("height"))
    stacks = H.mean_of_top(n, LABEL).join(high, list(LABEL))
    size = F.least(F.lit(30), F.greatest(F.lit(2), F.floor(F.col("radius") / res))).cast("int")
    placed = stacks.join(geo, "scene_id").withColumn("iy", F.floor((F.col("y_max") - F.col("y")) / res).cast("int")).withColumn("ix", F.floor((F.col("x") - F.col("x_min")) / res).cast("int")).withColumn("size", size)
    placed = written(placed.drop("x_min", "y_max", "n_cols", "n_rows"), "placed")
    canopy = R.window_max(placed, raster, LABEL)
    height = F.when((F.col("canopy") > F.col("height")) & (F.col("canopy") < F.col("height") + 5), F.col("canopy")).otherwise(F.col("height"))
    raised = placed.join(canopy, list(LABEL), "left").withColumn("height", height)
    shapes = H.shape_by_profile(n, raised, LABEL)
    main = raised.join(shapes, list(LABEL)).select("scene_id", _rank("height").alias("tree_id"), "x", "y", "height", "radius", "shape")
    taken = R.dilate_square(R.disc_mask(placed, F.col("size")), 4)
    free = written(R.uncover(raster, taken), "free")
    found = R.pixel_xy(R.local_maxima(free, geo, 10, 2.5), geo, res)
    extra = found.select("scene_id", (100_000 + F.col("peak_id")).cast("int").alias("tree_id"), "x", "y", F.col("h").alias("height"), F.greatest(F.lit(1.5), 0.2 * F.col("h")).alias("radius"), F.lit(H.BALL).alias("shape"))
    both = written(main.unionByName(extra), "trees")
    widest = both.agg(F.max("radius")).first()[0] or 0.0
    return X.suppress(both, (_far() < 2.0) | (_far() < 0.6 * (F.col("t_radius") + F.col("q_radius"))), max(2.0, 1.2 * widest))


def adaptive_fusion(points: DataFrame, res: float = 0.2) -> DataFrame:
    """The flood of the smooth canopy from the peaks of a sharper one owns its points; centres weigh high points; radii come from a height band; conflicts fall."""
    p = _cleaned(points, 1.0, 12, 2.5)
    geo = written(R.extent(p, res), "extent")
    closed = written(R.close_cross(R.densify(R.rasterise(p, geo, res), geo)), "closed")
    peaks = R.local_maxima(written(R.gaussian(closed, 0.35), "sharp"), geo, max(1, int(1.1 / res)), 2.0)
    labels = R.watershed(R.gaussian(closed, 0.8), peaks, 1.0).select("scene_id", "iy", "ix", "label")
    c = written(R.pixel_of(p, geo, res).join(labels, ["scene_id", "iy", "ix"]), "crowns")
    stats = H.vertical_clusters(H.cluster_stats(c, LABEL))
    centre = H.weighted_centre(c, LABEL)
    shape = H.shape_by_correlation(c, LABEL)
    s = stats.join(centre, list(LABEL)).join(shape, list(LABEL)).select(*LABEL, "z_max", "wx", "wy", "shape")
    d = F.hypot(F.col("x") - F.col("wx"), F.col("y") - F.col("wy"))
    low = F.when(F.col("shape") == H.CONE, 0.2).otherwise(0.5) * F.col("z_max")
    high = F.when(F.col("shape") == H.CONE, 0.6).otherwise(0.9) * F.col("z_max")
    band = F.col("z").between(low, high)
    wide = c.join(s, list(LABEL)).groupBy(*LABEL).agg(F.count(F.when(band, 1)).alias("n"), F.percentile(F.when(band, d), F.lit(0.95)).alias("in_band"), F.percentile(d, F.lit(0.9)).alias("all"))
    radius = 1.15 * F.when(F.col("n") > 5, F.col("in_band")).otherwise(F.col("all"))
    trees = s.join(wide, list(LABEL)).select("scene_id", _rank("z_max").alias("tree_id"), F.col("wx").alias("x"), F.col("wy").alias("y"), F.col("z_max").alias("height"), F.least(0.6 * F.col("z_max"), F.greatest(F.lit(1.0), radius)).alias("radius"), "shape")
    trees = written(trees, "trees")
    widest = trees.agg(F.max("radius")).first()[0] or 0.0
    small = (_far() < 0.75 * (F.col("t_radius") + F.col("q_radius"))) & (F.col("t_height") < 0.4 * F.col("q_height"))
    return X.suppress(trees, small | (_far() < 0.8), max(0.8, 1.5 * widest))


DETECTORS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "adaptive_fusion": adaptive_fusion,
    "chm_watershed": chm_watershed,
    "crown_axis": crown_axis,
    "crown_axis_strict": crown_axis_strict,
    "layer_stack": layer_stack,
    "smart_fusion": smart_fusion,
}
