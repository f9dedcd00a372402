"""Flooding a raster from markers, in tiles.

A pixel's key tells when the flood meets it: the level to which the water has sunk by
then (the least height on the best way from a marker), how many pixels of just that
height the way has passed, the last of these pixels in row order, and the steps from it.
The least key comes first, so high ground is met before low ground, and on a plateau
what is nearer.  A pixel takes the label of its neighbour (of 4) with the least key.

Keys only get worse along a way, so they are a fixpoint that tiles can reach apart: a
tile floods itself from its markers and from the keys known along its ring, and tiles
whose ring has improved flood again.  Labels are then followed from pixel to pixel
inside each tile, and from tile to tile by pointer doubling over the border pixels.
A task holds one tile, whatever the raster's size.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import discard, written

_NEXT = ((-1, 0), (0, -1), (0, 1), (1, 0))
#: Pixel number: row * 2^31 + column.
_ROW = 1 << 31
KEY = ("level", "passed", "last", "steps")
_BORDER = "scene_id {}, ty int, tx int, iy int, ix int, level double, passed long, last long, steps long"

Key = tuple[float, int, int, int]


def extend(key: Key, h: float, pixel: int) -> Key:
    """The key of a pixel of height h that the flood meets from a neighbour; the level is negated, so that the least key is first."""
    level, passed, last, steps = key
    if -h > level:
        return (-h, 1, pixel, 0)
    if -h == level:
        return (level, passed + 1, pixel, 0)
    return (level, passed, last, steps + 1)


def keys_of(heights: dict[int, float], marked: dict[int, int], ring: dict[int, Key]) -> dict[int, Key]:
    """Keys of the pixels that the flood meets, from marked pixels and from the known keys of a ring around them."""
    best: dict[int, Key] = {p: (-heights[p], 1, p, 0) for p in marked}
    queue = [(k, p) for p, k in best.items()] + [(k, p) for p, k in ring.items()]
    heapq.heapify(queue)
    while queue:
        key, p = heapq.heappop(queue)
        if p in best and best[p] < key:
            continue
        for dy, dx in _NEXT:
            q = p + dy * _ROW + dx
            h = heights.get(q)
            if h is not None:
                new = extend(key, h, q)
                if q not in best or new < best[q]:
                    best[q] = new
                    heapq.heappush(queue, (new, q))
    return best


def parents_of(best: dict[int, Key], marked: dict[int, int], ring: dict[int, Key]) -> dict[int, int]:
    """The neighbour from which each met pixel is flooded: of the least key, and of these the first in row order."""
    known, out = {**ring, **best}, {}
    for p in best:
        if p not in marked:
            near = [(known[q], q) for q in (p + dy * _ROW + dx for dy, dx in _NEXT) if q in known]
            out[p] = min(near)[1]
    return out


def flood(h: np.ndarray, markers: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Labels of the mask's pixels that the flood from the markers meets, as one tile."""
    at = [(int(y), int(x)) for y, x in zip(*np.nonzero(mask), strict=True)]
    heights = {y * _ROW + x: float(h[y, x]) for y, x in at}
    marked = {y * _ROW + x: int(markers[y, x]) for y, x in at if markers[y, x]}
    best = keys_of(heights, marked, {})
    labels = np.zeros(h.shape, np.int64)
    for p, label in _followed(best, marked, parents_of(best, marked, {})).items():
        labels[divmod(p, _ROW)] = label
    return labels


def _followed(best: dict[int, Key], marked: dict[int, int], parents: dict[int, int]) -> dict[int, int]:
    """What each pixel's way ends at: a label, or (negative, less one) the pixel of the ring where it leaves the tile."""
    out: dict[int, int] = {}
    for p in sorted(best, key=best.__getitem__):  # a parent's key is less
        q = parents.get(p)
        out[p] = marked[p] if q is None else out[q] if q in out else -q - 1
    return out


def _ring_of(cell: pa.Scalar) -> dict[int, Key]:
    if not cell.is_valid:
        return {}
    s = cell.values
    columns = [s.field(c).to_pylist() for c in ("iy", "ix", *KEY)]
    return {y * _ROW + x: tuple(key) for y, x, *key in zip(*columns, strict=True)}


def _tile_of(cell: pa.Scalar) -> tuple[dict[int, float], dict[int, int]]:
    s = cell.values
    code = s.field("iy").to_numpy().astype(np.int64) * _ROW + s.field("ix").to_numpy()
    label = s.field("label").to_numpy()
    return dict(zip(code.tolist(), s.field("h").to_pylist(), strict=True)), {int(c): int(v) for c, v in zip(code[label > 0], label[label > 0], strict=True)}


def watershed(raster: DataFrame, markers: DataFrame, floor: float, size: int = 256) -> DataFrame:
    """scene_id, iy, ix, h, label of the pixels above floor that the flood from markers(scene_id, iy, ix, peak_id) meets.

    Markers at or below floor, and pixels that no marker reaches, are left out; tiles are
    `size` pixels wide, and the labels do not depend on it.
    """
    tile = ["scene_id", "ty", "tx"]
    number = lambda c: F.floor(F.col(c) / size).cast("int")
    rows = raster.filter(F.col("h") > floor).join(markers.select("scene_id", "iy", "ix", F.col("peak_id").cast("long").alias("label")), ["scene_id", "iy", "ix"], "left")
    rows = rows.select("scene_id", number("iy").alias("ty"), number("ix").alias("tx"), "iy", "ix", "h", F.coalesce("label", F.lit(0)).cast("long").alias("label"))
    tiles = written(rows.groupBy(*tile).agg(F.collect_list(F.struct("iy", "ix", "h", "label")).alias("pixels")), "flood-tiles")
    scene = dict(raster.dtypes)["scene_id"]
    schema = _BORDER.format(scene)

    def borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                heights, marked = _tile_of(batch.column(3)[row])
                best = keys_of(heights, marked, _ring_of(batch.column(4)[row]))
                edge = [(p, k) for p, k in best.items() if any(c % size in (0, size - 1) for c in divmod(p, _ROW))]
                own = [pa.array([batch.column(c)[row].as_py()] * len(edge), batch.schema.field(c).type) for c in range(3)]
                at = [pa.array([divmod(p, _ROW)[i] for p, _ in edge], pa.int32()) for i in range(2)]
                types = (pa.float64(), pa.int64(), pa.int64(), pa.int64())
                keys = [pa.array([k[i] for _, k in edge], t) for i, t in enumerate(types)]
                yield pa.RecordBatch.from_arrays([*own, *at, *keys], names=[*tile, "iy", "ix", *KEY])

    def beside(border: DataFrame) -> DataFrame:
        """Border pixels with the tiles that they touch from outside."""
        step = lambda y, x: F.struct(F.floor((F.col("iy") + y) / size).cast("int").alias("y"), F.floor((F.col("ix") + x) / size).cast("int").alias("x"))
        near = border.withColumn("_to", F.explode(F.array_distinct(F.array(*[step(*s) for s in _NEXT])))).filter((F.col("_to.y") != F.col("ty")) | (F.col("_to.x") != F.col("tx")))
        return near.select("scene_id", F.col("_to.y").alias("ty"), F.col("_to.x").alias("tx"), "iy", "ix", *KEY)

    def with_rings(tiles: DataFrame, border: DataFrame) -> DataFrame:
        rings = beside(border).groupBy(*tile).agg(F.collect_list(F.struct("iy", "ix", *KEY)).alias("ring"))
        return tiles.join(rings, tile, "left").select(*tile, "pixels", "ring")

    none = F.lit(None).cast("array<struct<iy:int,ix:int,level:double,passed:bigint,last:bigint,steps:bigint>>")
    known = written(tiles.select(*tile, "pixels", none.alias("ring")).mapInArrow(borders, schema), "flood-borders")
    changed = known
    while True:
        again = beside(changed).select(*tile).distinct().join(tiles.select(*tile), tile, "left_semi")
        if not again.limit(1).count():
            break
        again = written(again, "flood-again")
        new = written(with_rings(tiles.join(again, tile, "left_semi"), known).mapInArrow(borders, schema), "flood-borders")
        changed = written(new.join(known, [*tile, "iy", "ix", *KEY], "left_anti"), "flood-changed")
        old, known = known, written(known.join(again, tile, "left_anti").unionByName(new), "flood-known")
        discard(again, new, old)

    def labels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                heights, marked = _tile_of(batch.column(3)[row])
                ring = _ring_of(batch.column(4)[row])
                best = keys_of(heights, marked, ring)
                ends = _followed(best, marked, parents_of(best, marked, ring))
                pixels = np.fromiter(ends, np.int64, len(ends))
                columns = [pa.array([batch.column(0)[row].as_py()] * len(ends), batch.schema.field(0).type), pa.array((pixels // _ROW).astype(np.int32)), pa.array((pixels % _ROW).astype(np.int32))]
                columns += [pa.array([heights[p] for p in ends], pa.float64()), pa.array(np.fromiter(ends.values(), np.int64, len(ends)))]
                yield pa.RecordBatch.from_arrays(columns, names=["scene_id", "iy", "ix", "h", "label"])

    found = written(with_rings(tiles, known).mapInArrow(labels, f"scene_id {scene}, iy int, ix int, h double, label long"), "flood-labels")
    discard(tiles, known)
    leaves = found.filter("label < 0")
    if not leaves.limit(1).count():
        return found
    pixel: Column = -(F.col("iy").cast("long") * _ROW + F.col("ix")) - 1
    edge = lambda c: (F.col(c) % size).isin(0, size - 1)
    ends = written(found.filter(edge("iy") | edge("ix")).select("scene_id", pixel.alias("from"), F.col("label").alias("to")), "flood-ends")
    while ends.filter("to < 0").limit(1).count():
        jump = ends.select("scene_id", F.col("from").alias("to"), F.col("to").alias("_on"))
        old, ends = ends, written(ends.join(jump, ["scene_id", "to"], "left").select("scene_id", "from", F.coalesce("_on", "to").alias("to")), "flood-ends")
        discard(old)
    ended = leaves.join(ends.withColumnRenamed("from", "label"), ["scene_id", "label"]).select("scene_id", "iy", "ix", "h", F.col("to").alias("label"))
    return found.filter("label > 0").unionByName(ended)
