"""Crown axes: polylines that descend from tree tops through the points below.

A task holds the points of one tile of the plane, with a halo, and follows its axes to
their ends; only an axis that leaves the halo goes on in the tile it has reached, so
the rounds follow the tiles an axis crosses and not its height.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import written
from .tiles import CellIndex, Tiling, member_arrays

#: Tiles are at least so many search radii wide, and their halo is half a tile.
WIDTH, HALO = 4, 0.5


def descend(at: np.ndarray, x: np.ndarray, low: np.ndarray, high: np.ndarray, floor: float, radius: float, step: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Follow nodes `at` through points x: numbers, new nodes and which of them cannot be followed inside [low, high], a step at a time.

    While a node is above floor, the next is the mean of the points within radius that
    lie below it by less than step + 1, else a step straight down; without any point
    within radius the axis ends.
    """
    index, at = CellIndex(x, radius), at.copy()
    inside = lambda q: np.minimum(q - low, high - q).min(axis=1) >= radius
    going = np.flatnonzero((at[:, 2] > floor) & inside(at[:, :2]))
    while len(going):
        found = np.zeros(len(going), bool)
        next_ = np.zeros((len(going), 3))
        for points, near in index.around(at[going]):
            for p in points:  # the nodes of a cell are few
                node = at[going[p]]
                d = x[near] - node
                ball = near[d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1] + d[:, 2] * d[:, 2] <= radius * radius]
                if len(ball):
                    z = x[ball, 2]
                    below = ball[(z < node[2]) & (z > node[2] - step - 1.0)]
                    found[p] = True
                    next_[p] = x[below].mean(axis=0) if len(below) else (node[0], node[1], node[2] - step)
        going, next_ = going[found], next_[found]
        at[going] = next_
        stays = inside(next_[:, :2])
        above = next_[:, 2] > floor
        yield going, next_, above & ~stays
        going = going[above & stays]


def crown_axes(starts: DataFrame, points: DataFrame, floor: float, radius: float = 2.5, step: float = 1.0, cap: int = 20_000) -> DataFrame:
    """scene_id, axis_id, step, x, y, z: the nodes of the axes from starts(scene_id, axis_id, x, y, z), the first at step 0.

    The last node is the first at or below floor, or the last one with points around.
    """
    keys = ["scene_id"]
    base = points.select("scene_id", "pid", "x", "y", "z")
    tiles = Tiling(base, "xy", keys, cap, halo=HALO, least=WIDTH * radius)
    node = "scene_id {}, axis_id {}, step int, x double, y double, z double, _open boolean".format(*(dict(starts.dtypes)[c] for c in ("scene_id", "axis_id")))

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                (s, q), (t, x) = member_arrays(batch.column(1)[row], "xyz"), member_arrays(batch.column(2)[row], "xyz", "r_")
                x = x[np.argsort(t.field("r_pid").to_numpy(), kind="stable")]
                low, high = (np.array(batch.column(c)[row].as_py()) for c in (4, 5))
                count = s.field("step").to_numpy().copy()
                for some, nodes, leaves in descend(q, x, low, high, floor, radius, step):
                    count[some] += 1
                    ids = s.field("axis_id").take(pa.array(some))
                    scene = pa.array([batch.column(0)[row].as_py()] * len(some), batch.schema.field(0).type)
                    columns = [scene, ids, pa.array(count[some].astype(np.int32)), *[pa.array(nodes[:, c]) for c in range(3)], pa.array(leaves)]
                    yield pa.RecordBatch.from_arrays(columns, names=["scene_id", "axis_id", "step", "x", "y", "z", "_open"])

    far = base.select("scene_id", *[F.col(c).alias(f"r_{c}") for c in ("pid", "x", "y", "z")])
    now = starts.select("scene_id", "axis_id", F.lit(0).alias("step"), "x", "y", "z")
    out = now
    while True:
        new = written(tiles.met(now, far, "axis_id", reach=HALO / 2).mapInArrow(follow, node), "axes")
        out = out.unionByName(new.drop("_open"))
        now = new.filter("_open").drop("_open")
        if not now.limit(1).count():
            tiles.discard()
            return out
