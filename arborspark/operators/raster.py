"""Canopy-height rasters as tables (scene_id, iy, ix, h): rasterise, filter, find peaks, label basins.

Row 0 is the northern edge.  Neighbourhood operators are separable windows along
rows and then columns, so a raster is never joined with its own offsets.  Smoothing
takes sorted lines in Arrow batches, a few vector operations a weight.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import discard, written
from .flood import watershed
from .selection import percentiles


def extent(points: DataFrame, res: float, whole: bool = False) -> DataFrame:
    """scene_id, x_min, y_max, n_cols, n_rows; sizes are rounded up and one added, or with `whole` rounded down and one added."""
    cells = F.floor if whole else F.ceil
    w, h = F.max("x") - F.min("x"), F.max("y") - F.min("y")
    return points.groupBy("scene_id").agg(
        F.min("x").alias("x_min"), F.max("y").alias("y_max"), (cells(w / res) + 1).cast("int").alias("n_cols"), (cells(h / res) + 1).cast("int").alias("n_rows")
    )


def pixel_of(points: DataFrame, geo: DataFrame, res: float) -> DataFrame:
    """points with iy, ix; points outside the grid are dropped."""
    p = points.join(geo, "scene_id")
    p = p.withColumn("ix", F.floor((F.col("x") - F.col("x_min")) / res).cast("int")).withColumn("iy", F.floor((F.col("y_max") - F.col("y")) / res).cast("int"))
    return p.filter((F.col("ix") >= 0) & (F.col("ix") < F.col("n_cols")) & (F.col("iy") >= 0) & (F.col("iy") < F.col("n_rows"))).drop(*[c for c in geo.columns if c != "scene_id"])


def pixel_xy(pixels: DataFrame, geo: DataFrame, res: float, row: str = "iy", col: str = "ix") -> DataFrame:
    """pixels with x, y of their corner."""
    g = geo.select("scene_id", "x_min", "y_max")
    return pixels.join(g, "scene_id").withColumn("x", F.col("x_min") + F.col(col) * res).withColumn("y", F.col("y_max") - F.col(row) * res).drop("x_min", "y_max")


def rasterise(points: DataFrame, geo: DataFrame, res: float) -> DataFrame:
    """The highest point of each pixel that has points."""
    return pixel_of(points, geo, res).groupBy("scene_id", "iy", "ix").agg(F.max("z").alias("h"))


def densify(raster: DataFrame, geo: DataFrame) -> DataFrame:
    """Every pixel of every scene's grid, 0 where the raster has none.

    Lines are dealt to tasks before they become pixels: a grid is one small row, so all grids are one task's file.
    """
    rows = geo.select("scene_id", F.explode(F.sequence(F.lit(0), F.col("n_rows") - 1)).alias("iy"), "n_cols")
    rows = rows.repartition(int(geo.sparkSession.conf.get("spark.sql.shuffle.partitions")), "scene_id", "iy")
    cells = rows.select("scene_id", "iy", F.explode(F.sequence(F.lit(0), F.col("n_cols") - 1)).alias("ix"))
    return cells.join(raster, ["scene_id", "iy", "ix"], "left").withColumn("h", F.coalesce("h", F.lit(0.0)))


def _along(line: str, step: str, before: int, after: int):
    return Window.partitionBy("scene_id", line).orderBy(step).rowsBetween(-before, after)


def box(raster: DataFrame, agg, radius: int, column: str = "h") -> DataFrame:
    """agg over the (2 radius + 1)^2 box of every pixel of a dense raster (max or min)."""
    rows = raster.withColumn(column, agg(column).over(_along("iy", "ix", radius, radius)))
    return rows.withColumn(column, agg(column).over(_along("ix", "iy", radius, radius)))


def close_cross(raster: DataFrame) -> DataFrame:
    """Grey closing of a dense raster by the 3 x 3 cross: dilate, then erode; pixels outside are ignored.

    Rows, columns, columns, rows: the inner two share one shuffle, and so do the last one and a smoothing that follows.
    """

    def cross(df: DataFrame, agg, pick, lines: Sequence[str]) -> DataFrame:
        a, b = (agg("h").over(_along(line, "ix" if line == "iy" else "iy", 1, 1)) for line in lines)
        return df.withColumn("_a", a).withColumn("_b", b).withColumn("h", pick("_a", "_b")).drop("_a", "_b")

    return cross(cross(raster, F.max, F.greatest, ("iy", "ix")), F.min, F.least, ("ix", "iy"))


def gaussian_weights(sigma: float) -> list[float]:
    r = int(4 * sigma + 0.5)
    w = [math.exp(-0.5 * (i / sigma) ** 2) for i in range(-r, r + 1)]
    return [x / sum(w) for x in w]


def _smoothed(batches: Iterator[pa.RecordBatch], weights: Sequence[float]) -> Iterator[pa.RecordBatch]:
    """h smoothed along whole lines, whose rows follow each other with _at from 1; a task holds a batch and the line that it ends in."""

    def smooth(rows: pa.RecordBatch) -> pa.RecordBatch:
        at, h = rows["_at"].to_numpy().astype(np.int64) - 1, rows["h"].to_numpy(zero_copy_only=False)
        first = np.flatnonzero(at == 0)
        n = np.diff(np.append(first, len(at)))
        first, n = np.repeat(first, n), np.repeat(n, n)
        total, missing = np.zeros(len(at)), np.zeros(len(at), bool)
        none = rows["h"].is_null().to_numpy(zero_copy_only=False) if rows["h"].null_count else None
        for k, w in enumerate(weights, -(len(weights) // 2)):
            to = (at + k) % (2 * n)
            to = first + np.where(to < n, to, 2 * n - 1 - to)
            total += w * h[to]
            if none is not None:
                missing |= none[to]
        return rows.drop_columns(["_at", "h"]).append_column("h", pa.array(total, mask=missing))

    held: list[pa.RecordBatch] = []
    for batch in batches:
        starts = np.flatnonzero(batch["_at"].to_numpy() == 1)
        if held and len(starts):
            yield smooth(pa.concat_batches([*held, batch.slice(0, starts[-1])]))
            held = []
        elif len(starts) and starts[-1]:
            yield smooth(batch.slice(0, starts[-1]))
        held.append(batch.slice(starts[-1]) if len(starts) else batch)
    if held:
        yield smooth(pa.concat_batches(held))


def gaussian(raster: DataFrame, sigma: float) -> DataFrame:
    """Separable Gaussian smoothing of a dense raster; the edge reflects (the edge pixel repeated)."""
    weights = gaussian_weights(sigma)

    def one(df: DataFrame, line: str, step: str) -> DataFrame:
        lines = df.select("scene_id", line, step, F.row_number().over(Window.partitionBy("scene_id", line).orderBy(step)).alias("_at"), F.col("h").cast("double").alias("h"))
        lines = lines.sortWithinPartitions("scene_id", line, step)  # the window's own order, so no second sort
        return lines.mapInArrow(lambda batches: _smoothed((b for b in batches if b.num_rows), weights), lines.drop("_at").schema)

    return one(one(raster, "iy", "ix"), "ix", "iy").select("scene_id", "iy", "ix", "h")


def local_maxima(raster: DataFrame, geo: DataFrame, d: int, threshold: float) -> DataFrame:
    """Peaks of a dense raster: above threshold, the highest of their box of radius d, at least d from the border.

    peak_id ranks a scene's peaks by height; of equal pixels in a box the first in (iy, ix) order stays.
    """
    own = box(raster.withColumn("top", F.col("h")), F.max, d, "top").join(geo, "scene_id")
    inside = (F.col("iy") >= d) & (F.col("iy") < F.col("n_rows") - d) & (F.col("ix") >= d) & (F.col("ix") < F.col("n_cols") - d)
    peaks = own.filter((F.col("h") == F.col("top")) & (F.col("h") > threshold) & inside).select("scene_id", "iy", "ix", "h")
    peaks = written(peaks, "maxima")  # read three times below
    cell = peaks.withColumn("by", F.floor(F.col("iy") / (d + 1))).withColumn("bx", F.floor(F.col("ix") / (d + 1)))
    around = cell.withColumn("by", F.explode(F.sequence(F.col("by") - 1, F.col("by") + 1))).withColumn("bx", F.explode(F.sequence(F.col("bx") - 1, F.col("bx") + 1)))
    far = cell.select("scene_id", "by", "bx", F.col("iy").alias("jy"), F.col("ix").alias("jx"), F.col("h").alias("jh"))
    beaten = (F.abs(F.col("iy") - F.col("jy")) <= d) & (F.abs(F.col("ix") - F.col("jx")) <= d) & (F.col("jh") == F.col("h")) & (F.struct("jy", "jx") < F.struct("iy", "ix"))
    ties = around.join(far, ["scene_id", "by", "bx"]).filter(beaten).select("scene_id", "iy", "ix").distinct()
    rank = F.row_number().over(Window.partitionBy("scene_id").orderBy(F.desc("h"), "iy", "ix"))
    return peaks.join(ties, ["scene_id", "iy", "ix"], "left_anti").withColumn("peak_id", rank.cast("int"))


def basins(raster: DataFrame, floor: float) -> DataFrame:
    """Label raster by steepest ascent: every pixel above floor climbs to its highest neighbour (of 8, itself included) until a top.

    label is the top's iy * 2^20 + ix, and size grows with pointer doubling, so
    the rounds are logarithmic in the longest climb.
    """
    masked = raster.filter(F.col("h") > floor)
    code = F.col("iy").cast("long") * (1 << 20) + F.col("ix")
    cells = masked.select("scene_id", "iy", "ix", "h", code.alias("cell"))
    step = lambda c: F.explode(F.array(F.col(c) - 1, F.col(c), F.col(c) + 1)).alias(c)
    sent = cells.select("scene_id", step("iy"), "ix", "h", "cell").select("scene_id", "iy", step("ix"), F.struct("h", -F.col("cell")).alias("top"))
    climb = cells.join(sent.groupBy("scene_id", "iy", "ix").agg(F.max("top").alias("top")), ["scene_id", "iy", "ix"])
    now = written(climb.select("scene_id", "iy", "ix", "h", "cell", (-F.col("top.col2")).alias("label")), "climb")
    while True:
        up = now.select("scene_id", F.col("cell").alias("label"), F.col("label").alias("next"))
        old, new = now, written(now.join(up, ["scene_id", "label"]).select("scene_id", "iy", "ix", "h", "cell", F.col("next").alias("label"), (F.col("next") != F.col("label")).alias("moved")), "climb")
        now = new.drop("moved")
        now.scratch_path = new.scratch_path
        discard(old)
        if not new.filter("moved").limit(1).count():
            return now.drop("cell")


def window_max(centres: DataFrame, raster: DataFrame, keys: Sequence[str], size: str = "size") -> DataFrame:
    """keys, canopy: the highest pixel in the square of `size` pixels around each centre (keys, iy, ix)."""
    spread = lambda c: F.explode(F.sequence(F.col(c) - F.col(size), F.col(c) + F.col(size))).alias(c)
    square = centres.select(*keys, size, spread("iy"), "ix").select(*keys, "iy", spread("ix"))
    return square.join(raster, ["scene_id", "iy", "ix"]).groupBy(*keys).agg(F.max("h").alias("canopy"))


def uncover(raster: DataFrame, taken: DataFrame) -> DataFrame:
    """raster with 0 in the pixels of a mask."""
    rows = raster.join(taken.select("scene_id", "iy", "ix").withColumn("_taken", F.lit(True)), ["scene_id", "iy", "ix"], "left")
    return rows.select("scene_id", "iy", "ix", F.when(F.col("_taken").isNull(), F.col("h")).otherwise(0.0).alias("h"))


def region_properties(labels: DataFrame, res: float) -> DataFrame:
    """One row a label: max_h, mean_h, row, col (means), area, radius."""
    n = F.count("*")
    return labels.groupBy("scene_id", "label").agg(
        F.max("h").alias("max_h"), F.avg("h").alias("mean_h"), F.avg("iy").alias("row"), F.avg("ix").alias("col"), n.alias("area"), (F.sqrt(4 * n / math.pi) / 2 * res).alias("radius")
    )


def dilate_square(mask: DataFrame, radius: int) -> DataFrame:
    """The pixels within Chebyshev distance radius of a sparse mask (scene_id, iy, ix)."""
    spread = lambda c: F.explode(F.sequence(F.col(c) - radius, F.col(c) + radius)).alias(c)
    rows = mask.select("scene_id", spread("iy"), "ix").distinct()
    return rows.select("scene_id", "iy", spread("ix")).distinct()


def disc_mask(centres: DataFrame, radius: Column) -> DataFrame:
    """The pixels of filled discs around centres (scene_id, iy, ix)."""
    c = centres.select("scene_id", "iy", "ix", radius.cast("int").alias("r"))
    c = c.withColumn("dy", F.explode(F.sequence(-F.col("r"), F.col("r")))).withColumn("dx", F.explode(F.sequence(-F.col("r"), F.col("r"))))
    c = c.filter(F.col("dy") * F.col("dy") + F.col("dx") * F.col("dx") <= F.col("r") * F.col("r"))
    return c.select("scene_id", (F.col("iy") + F.col("dy")).alias("iy"), (F.col("ix") + F.col("dx")).alias("ix")).distinct()


def minmax(raster: DataFrame) -> DataFrame:
    lim = raster.groupBy("scene_id").agg(F.min("h").alias("lo"), F.max("h").alias("hi"))
    return raster.join(lim, "scene_id").withColumn("h", (F.col("h") - F.col("lo")) / (F.col("hi") - F.col("lo") + 1e-6)).drop("lo", "hi")


def percentile_stretch(raster: DataFrame, low: float = 0.05, high: float = 0.99) -> DataFrame:
    """Heights clipped to [low percentile of the positive pixels, high percentile of all]."""
    lim = percentiles(raster, ["scene_id"], {"lo": ("CASE WHEN h > 0 THEN h END", low), "hi": ("h", high)})
    return raster.join(lim, "scene_id").withColumn("h", F.least(F.greatest("h", F.coalesce("lo", "h")), "hi")).drop("lo", "hi")
