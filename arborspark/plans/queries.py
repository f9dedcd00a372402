"""The registered queries: every operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import labels
from ..operators import axes
from ..operators import points as P
from ..operators import raster as R
from ..operators import scoring as S
from ..operators import shape as H
from ..operators import spatial as X
from ..operators.polygons import points_in_polygons as points_in
from ..scratch import written
from ..streaming import results, stalls
from . import detectors, reports, views
from .views import uniform

XYZ = ("x", "y", "z")
POLYGON = ((3.0, 2.0), (21.0, 4.0), (23.0, 18.0), (12.0, 11.0), (4.0, 22.0))
RES = 1.0


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that sums in another order compare equal; no negative zero."""
    return df.select(*[(F.round(F.col(c), digits) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _canopy(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The dense 1 m canopy raster of normalised vegetation, and its grid."""
    p = P.normalised_vegetation(views.points(spark, sf_dir))
    geo = R.extent(p, RES)
    return R.densify(R.rasterise(p, geo, RES), geo), geo


def ground_level(s, d):
    return rounded(P.ground_level(views.points(s, d)))


def height_normalise(s, d):
    return rounded(P.height_normalise(views.points(s, d)).select("scene_id", "pid", "z"))


def veg_filter(s, d):
    return P.vegetation(P.height_normalise(views.points(s, d))).select("scene_id", "pid")


def min_height(s, d):
    return P.min_height(P.height_normalise(views.points(s, d)), 2.5).select("scene_id", "pid")


def class_from_height(s, d):
    return views.points(s, d).select("pid", P.class_of_height(F.col("z")).alias("cls"))


def dropout_keep(s, d):
    return P.dropout(views.points(s, d), uniform(F.col("pid") * 3 + 7), 0.3).select("pid")


def occlusion_thin(s, d):
    return P.occlusion_thin(views.points(s, d), uniform(F.col("pid") * 5 + 3)).select("pid")


def void_mask(s, d):
    void = P.in_void(F.col("x"), F.col("y"), (4.0, 0.3, 1.0, 12.0, 3.0), ((5.0, 5.0, 3.0), (18.0, 7.0, 2.0)))
    return views.points(s, d).filter(~void).select("pid")


def crown_solid(s, d):
    p = views.points(s, d).withColumn("shape", F.when(F.col("pid") % 2 == 0, "conical").otherwise("spherical"))
    dist = F.hypot(F.col("x") - 12.5, F.col("y") - 12.5)
    return p.filter(P.in_crown(F.col("shape"), dist, F.col("z"), F.lit(30.0), F.lit(8.0))).select("pid")


def polygon_crop(s, d):
    return P.polygon_crop(views.points(s, d), POLYGON).select("scene_id", "pid")


def points_in_polygons(s, d):
    """The polygons of its scene that every point lies in."""
    return points_in(views.points(s, d).select("scene_id", "pid", "x", "y"), written(views.polygons(s, d), "polygons"), ["scene_id"]).select("scene_id", "pid", "polygon_id")


def height_slices(s, d):
    return P.height_slices(views.points(s, d)).groupBy("scene_id", "slice_id").agg(F.count("*").alias("n"))


def axis_densify(s, d):
    """Axes through every eight consecutive points, in order of height."""
    p = views.points(s, d).withColumn("axis_id", F.floor(F.col("pid") / 8).cast("long"))
    step = F.row_number().over(Window.partitionBy("scene_id", "axis_id").orderBy(F.desc("z"), "pid"))
    samples = P.axis_samples(p.withColumn("step", step)).withColumn("z", F.floor(F.col("z") * 10000 + 0.27) / 10000)
    return rounded(samples)


def grid_extent(s, d):
    return rounded(R.extent(views.points(s, d), RES))


def chm_max(s, d):
    p = views.points(s, d)
    return rounded(R.rasterise(p, R.extent(p, RES), RES))


def grey_closing(s, d):
    return rounded(R.close_cross(_canopy(s, d)[0]))


def gaussian_smooth(s, d):
    return rounded(R.gaussian(_canopy(s, d)[0], 0.8), 5)


def canopy_peaks(s, d):
    """Peaks and mean peak height of every scene."""
    raster, geo = _canopy(s, d)
    return rounded(R.local_maxima(raster, geo, 2, 2.0).groupBy("scene_id").agg(F.count("*").alias("peaks"), F.avg("h").alias("mean_height")))


def local_maxima(s, d):
    raster, geo = _canopy(s, d)
    return rounded(R.local_maxima(raster, geo, 2, 2.0))


def basin_labels(s, d):
    return R.basins(_canopy(s, d)[0], 2.0).select("scene_id", "iy", "ix", "label")


def region_props(s, d):
    return rounded(R.region_properties(R.basins(_canopy(s, d)[0], 2.0), RES))


def tall_mask(s, d):
    """Pixels within two of a pixel over 40 m."""
    return R.dilate_square(_canopy(s, d)[0].filter("h > 40"), 2)


def disc_mask(s, d):
    raster, geo = _canopy(s, d)
    return R.disc_mask(R.local_maxima(raster, geo, 2, 2.0), F.least(F.lit(4), F.floor(F.col("h") / 12)))


def minmax_normalise(s, d):
    return rounded(R.minmax(_canopy(s, d)[0]))


def percentile_stretch(s, d):
    return rounded(R.percentile_stretch(_canopy(s, d)[0]))


def eps_neighbours(s, d):
    p = views.points(s, d).select("scene_id", "pid", *XYZ)
    return X.neighbour_counts(p, 1.5, XYZ)


def knn_k8(s, d):
    p = views.points(s, d).select("scene_id", "pid", *XYZ)
    near = X.nearest_join(p, p, 8, 3.2, XYZ, "pid", "pid")
    return rounded(near.select("pid", "rank", F.col("r_pid").alias("near"), "d2"))


def sor_filter(s, d):
    return X.outlier_filter(views.points(s, d), 8, 1.5, 3.2).select("pid")


def nearest_peak(s, d):
    """The nearest ground return of every vegetation return, heights scaled by 0.3."""
    p = views.points(s, d).withColumn("z", F.col("z") * 0.3)
    near = X.nearest_join(p.filter("cls > 2").select("scene_id", "pid", *XYZ), p.filter("cls = 2").select("scene_id", "pid", *XYZ), 1, 2.0, XYZ, "pid", "pid")
    return near.select("pid", F.col("r_pid").alias("ground_pid"))


def descent_step(s, d):
    """From every ground return: the mean of its ball's points up to 2 m below it."""
    p = views.points(s, d).select("scene_id", "pid", *XYZ)
    ball = X.radius_join(p.join(views.points(s, d).filter("cls = 2").select("pid"), "pid"), p, 2.5, XYZ)
    below = ball.filter((F.col("r_z") < F.col("z")) & (F.col("r_z") > F.col("z") - 2.0))
    millimetres = F.sum(F.round(F.col("r_z") * 1000).cast("long")).alias("z_mm")  # heights are whole millimetres, so their sum is exact
    return rounded(below.groupBy("pid").agg(F.count("*").alias("n"), *[F.avg(f"r_{c}").alias(c) for c in "xy"], millimetres))


def connected_components(s, d):
    """Components of points within 0.7 m of each other."""
    p = views.points(s, d).select("scene_id", "pid", *XYZ)
    return X.dbscan(p, 0.7, 1, XYZ).select("pid", F.col("cluster_id").alias("component"))


def dbscan_slice(s, d):
    """Clusters within 2 m height slices."""
    sliced = P.height_slices(views.points(s, d), 2.0)
    return X.dbscan(sliced, 0.9, 4, "xy", ("scene_id", "slice_id")).select("pid", "cluster_id")


def dbscan_link(s, d):
    """Clusters in space, heights halved."""
    p = views.points(s, d).withColumn("z", F.col("z") / 2)
    return X.dbscan(p, 1.2, 5, XYZ).select("pid", "cluster_id")


def _clusters(s, d) -> DataFrame:
    return views.points(s, d).withColumn("label", F.floor(F.col("x") / 5) * 5 + F.floor(F.col("y") / 5))


KEYS = ("scene_id", "label")


def cluster_stats(s, d):
    return rounded(H.cluster_stats(_clusters(s, d), KEYS))


def vertical_clusters(s, d):
    return H.vertical_clusters(H.cluster_stats(_clusters(s, d), KEYS), 38, 0.195).select(*KEYS)


def weighted_centre(s, d):
    return rounded(H.weighted_centre(_clusters(s, d), KEYS))


def radius_percentiles(s, d):
    return rounded(H.percentile_radius(_clusters(s, d), KEYS))


def radial_profile(s, d):
    return rounded(H.radial_profile(_clusters(s, d), KEYS))


def shape_cone_ball(s, d):
    return H.cone_or_ball(H.radial_profile(_clusters(s, d), KEYS), KEYS)


def shape_mean_ratio(s, d):
    stats = _clusters(s, d).groupBy(*KEYS).agg(F.max("z").alias("max_h"), F.avg("z").alias("mean_h"))
    return H.shape_by_mean(stats).select(*KEYS, "shape")


def shape_correlation(s, d):
    return H.shape_by_correlation(_clusters(s, d), KEYS)


def suppress_duplicates(s, d):
    far = F.hypot(F.col("t_x") - F.col("q_x"), F.col("t_y") - F.col("q_y"))
    conflict = (far < 2.0) | (far < 0.6 * (F.col("t_radius") + F.col("q_radius")))
    return X.suppress(views.trees_pred(s, d), conflict, 6.0).select("scene_id", "tree_id")


def suppress_conflicts(s, d):
    far = F.hypot(F.col("t_x") - F.col("q_x"), F.col("t_y") - F.col("q_y"))
    small = (far < 0.75 * (F.col("t_radius") + F.col("q_radius"))) & (F.col("t_height") < 0.4 * F.col("q_height"))
    return X.suppress(views.trees_pred(s, d), small | (far < 0.8), 7.0).select("scene_id", "tree_id")


def tree_similarity(s, d):
    return rounded(S.similarity(views.trees_ref(s, d), views.trees_pred(s, d)))


def optimal_assignment(s, d):
    """Total similarity of a best assignment (the pairs may tie)."""
    best = S.assign(S.similarity(views.trees_ref(s, d), views.trees_pred(s, d)))
    return rounded(best.groupBy("scene_id").agg(F.sum("avg_sim").alias("total")))


def _matched(s, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    ref, pred = views.trees_ref(s, d), views.trees_pred(s, d)
    return ref, pred, S.matches(ref, pred)


def unmatched_ref(s, d):
    ref, _, matched = _matched(s, d)
    return S.unmatched(ref, matched, "ref").select("scene_id", "tree_id")


def scene_scores(s, d):
    return rounded(S.scores(*_matched(s, d)))


def paired_scores(s, d):
    """Scores where every detection is matched to the reference tree of its own id."""
    ref, pred = views.trees_ref(s, d), views.trees_pred(s, d)
    pairs = S.similarity(ref, pred).filter((F.col("ref_id") == F.col("pred_id")) & (F.col("avg_sim") >= S.LEAST))
    return rounded(S.scores(ref, pred, pairs))


def shape_report(s, d):
    return rounded(reports.shape_report(views.trees_ref(s, d)))


def scene_keys(s, d):
    return views.results(s, d).groupBy(reports.scene_key().alias("scene_key")).agg(F.count("*").alias("runs"))


def report_quality(s, d):
    return rounded(reports.quality(views.results(s, d)))


def report_time(s, d):
    return rounded(reports.time(views.results(s, d)))


def report_components(s, d):
    rows = views.results(s, d).select("*", (F.col("score") / 2).alias("type"), (F.col("score") / 3).alias("height"), (F.col("score") / 4).alias("radius"), (F.col("score") / 5).alias("position"))
    return rounded(reports.components(rows, ("type", "height", "radius", "position")))


def chart_nearest_x(s, d):
    return rounded(reports.nearest_level(views.results(s, d), 0.43))


def axis_limits(s, d):
    return rounded(reports.axis_limits(views.results(s, d)))


def las_round_trip(s, d):
    """Points written as LAS files and read back, in whole millimetres from each scene's corner."""
    from ..scratch import new_path
    from ..sources import las

    las.register(s)
    path = new_path(s, "las")
    views.points(s, d).repartition("scene_id").write.format("las").mode("append").save(path)
    back = s.read.format("las").load(path).filter(F.col("cls").isin(2, 3, 4, 5))
    return back.groupBy("scene_id", "cls").agg(F.count("*").alias("n"), F.sum(F.floor(F.col("z") * 10 + 0.2337).cast("long")).alias("z_dm"))


def stream_las(s, d):
    """Points as LAS files that a stream takes, keeps from 10 m upwards and writes to other LAS files, a batch each."""
    from ..scratch import new_path
    from ..sources import las

    las.register(s)
    source, target = new_path(s, "las"), new_path(s, "las-streamed")
    views.points(s, d).repartition("scene_id").write.format("las").mode("append").save(source)
    high = s.readStream.format("las").option("logPath", new_path(s, "las-log")).load(source).filter("z >= 9.9995")
    query = high.writeStream.format("las").option("checkpointLocation", new_path(s, "stream")).trigger(availableNow=True).start(target)
    query.awaitTermination()
    back = s.read.format("las").load(target)
    return back.groupBy("scene_id", "cls").agg(F.count("*").alias("n"), F.sum(F.floor(F.col("z") * 10 + 0.2337).cast("long")).alias("z_dm"))


def las_crop(s, d):
    """Scenes written as LAS files and cropped to the polygon, whole records from file to file."""
    from ..scratch import new_path
    from ..sources import las

    las.register(s)
    path = new_path(s, "las")
    views.points(s, d).repartition("scene_id").write.format("las").mode("append").save(path)
    return las.crop(s, path, new_path(s, "las-crop"), POLYGON).groupBy("scene_id", "cls").agg(F.count("*").alias("n"))


def detected_trees(s, d):
    """Trees of the watershed detector in every scene."""
    return rounded(detectors.chm_watershed(views.points(s, d), RES))


def adaptive_fusion_trees(s, d):
    return rounded(detectors.adaptive_fusion(views.points(s, d), RES))


def layer_stack_trees(s, d):
    """Stacks of a dense scan: the same points on a twenty-fifth of the area."""
    dense = views.points(s, d).withColumn("x", F.col("x") * 0.2).withColumn("y", F.col("y") * 0.2)
    return rounded(detectors.layer_stack(dense))


def crown_axis_trees(s, d):
    return rounded(detectors.crown_axis(views.points(s, d)))


def crown_axis_strict_trees(s, d):
    return rounded(detectors.crown_axis_strict(views.points(s, d)))


def smart_fusion_trees(s, d):
    return rounded(detectors.smart_fusion(views.points(s, d)))


def watershed_labels(s, d):
    """The flood of the smoothed 1 m canopy from its peaks."""
    raster, geo = _canopy(s, d)
    smooth = written(R.gaussian(raster, 0.8), "raster")
    return R.watershed(smooth, R.local_maxima(smooth, geo, 2, 2.0), 2.0).select("scene_id", "iy", "ix", "label")


def pixel_to_xy(s, d):
    """Corner of the pixel of every point."""
    p = views.points(s, d)
    geo = R.extent(p, RES)
    return rounded(R.pixel_xy(R.pixel_of(p, geo, RES).select("scene_id", "pid", "iy", "ix"), geo, RES))


def nearest_vertex(s, d):
    """The vertex of the polygon within 1.5 m of every point."""
    near = P.nearest_vertex(F.col("x"), F.col("y"), POLYGON, 1.5)
    return views.points(s, d).select("pid", near.alias("vertex")).filter("vertex IS NOT NULL")


def peak_snap(s, d):
    """The highest of the 15 points nearest to every canopy peak."""
    raster, geo = _canopy(s, d)
    peaks = written(R.pixel_xy(R.local_maxima(raster, geo, 2, 2.0), geo, RES).select("scene_id", F.col("peak_id").alias("axis_id"), "x", "y", F.col("h").alias("z")), "peaks")
    return rounded(X.snap_to_top(peaks, P.height_normalise(views.points(s, d)), 15, 4.0))


def crown_axes(s, d):
    """The axes that descend from every snapped canopy peak, node by node."""
    raster, geo = _canopy(s, d)
    peaks = written(R.pixel_xy(R.local_maxima(raster, geo, 2, 2.0), geo, RES).select("scene_id", F.col("peak_id").alias("axis_id"), "x", "y", F.col("h").alias("z")), "peaks")
    p = written(P.height_normalise(views.points(s, d)), "points")
    return rounded(axes.crown_axes(written(X.snap_to_top(peaks, p, 15, 4.0), "snapped"), p, 1.0), 5)


def layer_nodes(s, d):
    """Nodes of the clusters of half-metre slices of a dense scan: the same points on a twenty-fifth of the area."""
    dense = P.normalised_vegetation(views.points(s, d)).withColumn("x", F.col("x") * 0.2).withColumn("y", F.col("y") * 0.2)
    return rounded(detectors.slice_nodes(dense, 0.8, 4).drop("pid"))


def smart_shape(s, d):
    """Shapes of columns of points by their radii against the depth below a height that the canopy raised."""
    centre = lambda c: F.floor(F.col(c) / 5) * 5 + 2.5
    nodes = _clusters(s, d).withColumn("r", F.hypot(F.col("x") - centre("x"), F.col("y") - centre("y")))
    heights = nodes.groupBy(*KEYS).agg((F.max("z") + F.col("label") % 3).alias("height"))
    return H.shape_by_profile(nodes, heights, KEYS)


def mean_of_top(s, d):
    return rounded(H.mean_of_top(_clusters(s, d), KEYS))


def points_in_regions(s, d):
    """Vegetation points of every basin."""
    p = P.normalised_vegetation(views.points(s, d))
    geo = R.extent(p, RES)
    labels = R.basins(R.densify(R.rasterise(p, geo, RES), geo), 2.0)
    return R.pixel_of(p, geo, RES).join(labels.select("scene_id", "iy", "ix", "label"), ["scene_id", "iy", "ix"]).groupBy("scene_id", "label").agg(F.count("*").alias("n"))


def _sized_peaks(s, d) -> tuple[DataFrame, DataFrame]:
    raster, geo = _canopy(s, d)
    return raster, R.local_maxima(raster, geo, 2, 2.0).withColumn("size", F.least(F.lit(4), F.floor(F.col("h") / 12)).cast("int"))


def canopy_around(s, d):
    """The highest pixel of a square around every peak."""
    raster, peaks = _sized_peaks(s, d)
    return rounded(R.window_max(peaks, raster, ("scene_id", "peak_id")))


def uncovered_canopy(s, d):
    """The canopy outside the discs of its peaks."""
    raster, peaks = _sized_peaks(s, d)
    return rounded(R.uncover(raster, R.disc_mask(peaks, F.col("size"))))


def run_labels(s, d):
    """Readable labels of every run."""
    name = F.concat(F.col("parser"), F.lit("/"), reports.scene_key())
    return views.results(s, d).select("run_id", labels.number_label(F.col("score")).alias("score_label"), labels.file_name(name).alias("file"), labels.clock(F.col("score") * 37).alias("clock"))


def stream_running_mean(s, d):
    return rounded(results.running_means(s, d))


def stream_distinct_means(s, d):
    """Running means over results of which every third is told again half a minute later."""
    runs = results.event_stream(s, d).select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("parser"), F.col("value").alias("score"))
    again = results.event_stream(s, d).filter("event_id % 3 = 0").select("event_id", (F.col("ts").cast("timestamp") + F.expr("INTERVAL 30 SECONDS")).alias("ts"), F.col("event_type").alias("parser"), F.col("value").alias("score"))
    return rounded(results.caught_up(s, results.means(results.distinct_runs(runs.unionByName(again), "event_id", "ts", "1 hour"))))


def stalled_runs(s, d):
    """Users without an event for 120 s, from the event stream."""
    progress = results.event_stream(s, d).select(F.col("user_id").alias("run"), F.col("ts").cast("timestamp").alias("at"))
    found = stalls.run_to_end(s, stalls.stalls(progress), "stalls")
    return found.select("run", F.unix_micros("last_progress").alias("last_micros"))


ALL: tuple[Callable[[SparkSession, str], DataFrame], ...] = (
    ground_level, height_normalise, veg_filter, min_height, class_from_height, dropout_keep, occlusion_thin, void_mask, crown_solid, polygon_crop, points_in_polygons,
    height_slices, axis_densify, grid_extent, chm_max, grey_closing, gaussian_smooth, canopy_peaks, local_maxima, basin_labels, region_props,
    tall_mask, disc_mask, minmax_normalise, percentile_stretch, eps_neighbours, knn_k8, sor_filter, nearest_peak, descent_step, connected_components,
    dbscan_slice, dbscan_link, cluster_stats, vertical_clusters, weighted_centre, radius_percentiles, radial_profile, shape_cone_ball, shape_mean_ratio,
    shape_correlation, suppress_duplicates, suppress_conflicts, tree_similarity, optimal_assignment, unmatched_ref, scene_scores, paired_scores,
    shape_report, scene_keys, report_quality, report_time, report_components, chart_nearest_x, axis_limits, run_labels, stream_running_mean, stream_distinct_means, stalled_runs, las_round_trip, las_crop, stream_las,
    detected_trees, adaptive_fusion_trees, layer_stack_trees, crown_axis_trees, crown_axis_strict_trees, smart_fusion_trees,
    watershed_labels, pixel_to_xy, nearest_vertex, peak_snap, crown_axes, layer_nodes, smart_shape, mean_of_top, points_in_regions, canopy_around, uncovered_canopy,
)
