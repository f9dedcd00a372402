"""Tiles of about equal numbers of points, and the neighbour search inside one tile.

A group of points (a scene) is cut into cells whose width follows from its own density;
a cell that still holds more than `cap` points is halved in every axis, again and again,
so crowded places get small tiles and empty ones large tiles.  A tile's right side
is its points and those within a halo around it; its left side is dealt into chunks.
A task holds one chunk and one right side, whatever the scene's size.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import discard, written

#: Halvings of a crowded cell at most: 4,096 times finer in every axis; points that equal each other are not parted.
DEPTH = 12
#: Up to so many rows the nearest one is found among all of them sooner than by cells.
DENSE = 8192


class Tiling:
    """Tiles for the points of `rows`, at most `cap` of them a tile where halving can part them; tile columns are `columns`.

    halo is in tile widths; a `least` width keeps tiles larger than a fixed search radius.
    """

    def __init__(self, rows: DataFrame, axes: Sequence[str], keys: Sequence[str], cap: int, halo: float = 0.0, least: float = 0.0):
        self.axes, self.keys, self.cap, self.halo = tuple(axes), list(keys), cap, halo
        ends = [f(a).alias(f"_{n}{i}") for i, a in enumerate(axes) for n, f in (("lo", F.min), ("hi", F.max))]
        geo = rows.groupBy(*keys).agg(F.count("*").alias("_n"), *ends)
        spans = [F.greatest(F.col(f"_hi{i}") - F.col(f"_lo{i}"), F.lit(1e-9)) for i in range(len(axes))]
        volume = F.lit(1.0)
        for s in spans:
            volume = volume * s
        whole = F.greatest(*spans, F.lit(0.0)) * 2 + 1
        width = F.greatest(F.pow(volume * (cap / 2) / F.col("_n"), F.lit(1 / len(axes))), F.lit(least))
        # Flat groups would get cells as thin as they are; no axis needs more than 2^20 cells.
        self.geo = written(geo.withColumn("_w", F.when(F.col("_n") <= cap, whole).otherwise(F.least(whole, F.greatest(width, whole / (1 << 20))))), "tiles-geo")
        self.one = not self.geo.filter(F.col("_n") > cap).limit(1).count()
        self.cells = [f"_t{i}" for i in range(len(axes))]
        self.columns = self.keys if self.one else [*self.keys, "_level", *self.cells]
        self.leaves, self.levels, self.kept = None, [0], [self.geo]
        if not self.one:
            self._split(rows, least)

    def _at(self, i: int, level: Column, prefix: str = "", shift: float = 0.0) -> Column:
        """Cell number of an axis at a level; points outside the grid count as on its edge."""
        x = F.least(F.greatest(F.col(f"{prefix}{self.axes[i]}"), F.col(f"_lo{i}")), F.col(f"_hi{i}"))
        return F.floor((x - F.col(f"_lo{i}")) / F.col("_w") * F.pow(F.lit(2.0), level) + shift).cast("long")

    def _split(self, rows: DataFrame, least: float) -> None:
        """leaves: the tiles.  A round counts the cells of one level, of the places that are still too full."""
        rest, leaves = rows.join(self.geo, self.keys), None
        for level in range(DEPTH + 1):
            at = [*self.keys, *self.cells]
            placed = rest.withColumns({t: self._at(i, F.lit(level)) for i, t in enumerate(self.cells)})
            counts = written(placed.groupBy(*at, "_w").agg(F.count("*").alias("_m")), "tiles")
            self.kept.append(counts)
            # Halving also ends where a tile would be narrower than the least width.
            full = (F.col("_m") > self.cap) & F.lit(level < DEPTH) & (F.col("_w") / 2.0 ** (level + 1) >= least)
            found = counts.filter(~full).select(*self.keys, F.lit(level).alias("_level"), *self.cells)
            leaves = found if leaves is None else leaves.unionByName(found)
            crowded = counts.filter(full).select(*at)
            if not crowded.limit(1).count():
                break
            rest = placed.join(crowded, at, "left_semi").drop(*self.cells)
        self.leaves, self.levels = leaves, list(range(level + 1))

    def own(self, rows: DataFrame, row_id: str = "", reach: float = 0.0) -> DataFrame:
        """rows with the tile they lie in, or with a reach the first tile within so many tile widths; none where no tile is."""
        if self.one:
            return rows
        if reach:
            at = F.min(F.struct("_level", *self.cells)).alias("_at")
            tiles = self._near(rows, reach).groupBy(*self.keys, row_id).agg(at).select(*self.keys, row_id, "_at.*")
            return rows.join(tiles, [*self.keys, row_id])
        return self._near(rows, 0.0)

    def _near(self, rows: DataFrame, reach: float, prefix: str = "") -> DataFrame:
        """rows once for every tile within `reach` tile widths."""
        placed = rows.join(self.geo, self.keys).withColumn("_level", F.explode(F.array(*map(F.lit, self.levels))))
        for i, t in enumerate(self.cells):
            low, high = self._at(i, F.col("_level"), prefix, -reach), self._at(i, F.col("_level"), prefix, reach)
            placed = placed.withColumn(t, F.explode(F.sequence(low, high)) if reach else low)
        return placed.join(self.leaves, self.columns, "left_semi").select(*rows.columns, "_level", *self.cells)

    def around(self, rows: DataFrame, prefix: str = "r_") -> DataFrame:
        """rows once for every tile in whose halo they lie."""
        return rows if self.one else self._near(rows, self.halo, prefix)

    def boxes(self, gathered: DataFrame) -> DataFrame:
        """One row a tile with _low and _high: the ends of its halo in every axis, infinite where no points lie beyond."""
        g = gathered.join(self.geo, self.keys)
        if self.one:
            ends = [(F.lit(float("-inf")), F.lit(float("inf")))] * len(self.axes)
        else:
            w, ends = F.col("_w") / F.pow(F.lit(2.0), F.col("_level")), []
            for i, t in enumerate(self.cells):
                low, high = F.col(f"_lo{i}") + w * (F.col(t) - self.halo), F.col(f"_lo{i}") + w * (F.col(t) + 1 + self.halo)
                ends.append((F.when(low <= F.col(f"_lo{i}"), float("-inf")).otherwise(low), F.when(high > F.col(f"_hi{i}"), float("inf")).otherwise(high)))
        return g.select(*gathered.columns, F.col("_n"), F.array(*[e[0] for e in ends]).alias("_low"), F.array(*[e[1] for e in ends]).alias("_high"))

    def chunks(self, rows: DataFrame, row_id: str, size: int) -> DataFrame:
        """rows of own() gathered into lists (`left`) of about `size` rows of one tile."""
        counts = rows.groupBy(*self.columns).agg(F.ceil(F.count("*") / size).alias("_chunks"))
        dealt = rows.join(counts, self.columns).withColumn("_chunk", F.pmod(F.xxhash64(row_id), F.col("_chunks")))
        inside = [c for c in rows.columns if c not in self.columns]
        return dealt.groupBy(*self.columns, "_chunk").agg(F.collect_list(F.struct(*inside)).alias("left"))

    def met(self, left: DataFrame, right: DataFrame, left_id: str, size: int = 2048, reach: float = 0.0) -> DataFrame:
        """keys, left, right, _n, _low, _high: every chunk of left rows with the rows around its tile (columns prefixed r_)."""
        inside = [c for c in right.columns if c not in self.keys]
        sides = self.boxes(self.around(right).groupBy(*self.columns).agg(F.collect_list(F.struct(*inside)).alias("right")))
        return self.chunks(self.own(left, left_id, reach), left_id, size).join(sides, self.columns).select(*self.keys, "left", "right", "_n", "_low", "_high")

    def discard(self) -> None:
        discard(*self.kept)


def squares(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Squared distances of every row of q to every row of x, added axis by axis."""
    out = np.zeros((len(q), len(x)))
    for a in range(q.shape[1]):
        d = q[:, a, None] - x[None, :, a]
        out += d * d
    return out


def _first(d2: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Columns and values of the k least of each row, ties by ids; inf where a row has fewer."""
    if d2.shape[1] > 8 * k:  # what is beyond the k-th distance cannot be among the first
        limit = np.partition(d2, k - 1, axis=1)[:, k - 1]
        most = int((d2 <= limit[:, None]).sum(axis=1).max(initial=k))
        some = np.argpartition(d2, min(most, d2.shape[1]) - 1, axis=1)[:, :most]
    else:
        some = np.broadcast_to(np.arange(d2.shape[1]), d2.shape)
    part = np.take_along_axis(d2, some, 1)
    order = np.lexsort((ids[some], part), axis=1)[:, :k]
    return np.take_along_axis(some, order, 1), np.take_along_axis(part, order, 1)


class CellIndex:
    """Points sorted by the cells of a grid; cells along the last axis follow each other."""

    def __init__(self, x: np.ndarray, width: float):
        self.low, self.width = x.min(axis=0) - width, width
        self.shape = np.floor((x.max(axis=0) - self.low) / width).astype(np.int64) + 2
        self.code = self._codes(self._cells(x))
        self.order = np.argsort(self.code, kind="stable")
        self.code = self.code[self.order]

    def _cells(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.floor((x - self.low) / self.width).astype(np.int64), 0, self.shape - 1)

    def _codes(self, cells: np.ndarray) -> np.ndarray:
        code = np.zeros(len(cells), np.int64)
        for a in range(cells.shape[1]):
            code = code * self.shape[a] + cells[:, a]
        return code

    def around(self, q: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each cell of q's points: the numbers of those points, and of the index' points in the cells around."""
        if not len(q):
            return
        cells = self._cells(q)
        codes, first, own = np.unique(self._codes(cells), return_index=True, return_inverse=True)
        members = np.split(np.argsort(own, kind="stable"), np.cumsum(np.bincount(own))[:-1])
        last = len(self.shape) - 1
        rows = [s for s in itertools.product((-1, 0, 1), repeat=last)]
        begins, ends = [], []
        for s in rows:
            at = cells[first].copy()
            at[:, :last] += np.array(s, np.int64)[None, :] if last else 0
            inside = ((at[:, :last] >= 0) & (at[:, :last] < self.shape[:last])).all(axis=1)
            left, right = at.copy(), at.copy()
            left[:, last] = np.maximum(left[:, last] - 1, 0)
            right[:, last] = np.minimum(right[:, last] + 1, self.shape[last] - 1)
            b, e = np.searchsorted(self.code, self._codes(left), "left"), np.searchsorted(self.code, self._codes(right), "right")
            begins.append(np.where(inside, b, 0))
            ends.append(np.where(inside, e, 0))
        for i, points in enumerate(members):
            near = [self.order[b[i] : e[i]] for b, e in zip(begins, ends, strict=True) if e[i] > b[i]]
            yield points, np.concatenate(near) if near else np.zeros(0, np.int64)


def _nearest_one(q: np.ndarray, x: np.ndarray, ids: np.ndarray, piece: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """nearest_rows for k = 1 and few finite rows x: all products at once find each row's candidates, whose squared distances are exact."""
    mid = x.mean(axis=0)
    a, b = q - mid, x - mid
    most, half = max(np.abs(a).max(), np.abs(b).max()), np.einsum("ij,ij->i", b, b) / 2
    slack = 1e-12 * most * (most + np.abs(mid).max())  # far above the rounding of products and of differences from mid
    at, d2 = np.empty((len(q), 1), np.int64), np.empty((len(q), 1))
    for c in range(0, len(q), piece):
        far = half[None, :] - a[c : c + piece] @ b.T
        i, j = np.nonzero(far <= far.min(axis=1, keepdims=True) + slack)
        exact = np.zeros(len(i))
        for n in range(q.shape[1]):
            d = q[c + i, n] - x[j, n]
            exact += d * d
        order = np.lexsort((ids[j], exact, i))
        first = order[np.flatnonzero(np.diff(i[order], prepend=-1))]
        at[c : c + piece, 0], d2[c : c + piece, 0] = j[first], exact[first]
    return at, d2


def nearest_rows(q: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int, piece: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and squared distances of the k nearest rows of x for every row of q, ties by ids; -1 and inf where x has fewer."""
    at, d2 = np.full((len(q), k), -1), np.full((len(q), k), np.inf)

    def fill(points: np.ndarray, near: np.ndarray) -> None:
        for c in range(0, len(points), piece):
            some = points[c : c + piece]
            which, far = _first(squares(q[some], x[near]), ids[near], k)
            at[some[:, None], np.arange(which.shape[1])], d2[some[:, None], np.arange(which.shape[1])] = near[which], far

    if not len(x) or not len(q):
        return at, d2
    if k == 1 and len(x) <= DENSE and np.abs(q).max() < 1e100 and np.abs(x).max() < 1e100:  # not so for NaN
        return _nearest_one(q, x, ids)
    span = np.maximum(x.max(axis=0) - x.min(axis=0), 1e-9)
    width = max((span.prod() * k / len(x)) ** (1 / x.shape[1]), span.max() / 1024)
    rest = np.ones(len(q), bool)
    inside = ((q >= x.min(axis=0)) & (q <= x.max(axis=0))).all(axis=1)
    numbers = np.flatnonzero(inside)
    for points, near in CellIndex(x, width).around(q[numbers]):
        if len(near) >= k:
            fill(numbers[points], near)
            rest[numbers[points]] = d2[numbers[points], k - 1] > width * width * (1 - 1e-9)
    left = np.flatnonzero(rest)
    at[left], d2[left] = -1, np.inf
    fill(left, np.arange(len(x)))
    return at, d2


def near_pairs(x: np.ndarray, own: np.ndarray, radius: float, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers (i of own, j of any row of x) within radius of each other, i = j included, in pieces of about `most` candidates.

    Cells lie in one order, in which a cell and its two neighbours along the last axis follow
    each other; runs of empty cells count as one, so numbers of cells follow the rows.
    """
    if len(x) * len(own) <= 1 << 16:
        i, j = np.nonzero(squares(x[own], x) <= radius * radius)
        yield own[i], j
        return
    finite = np.isfinite(x).all(axis=1)
    rows = np.flatnonzero(finite)
    own = own[finite[own]]
    if not len(own):
        return
    code, steps, width = np.zeros(len(x), np.int64), [], radius * (1 + 1e-6)
    for a in range(x.shape[1]):
        cells, at = np.unique(np.floor(x[rows, a] / width), return_inverse=True)
        packed = np.concatenate([[1], 1 + np.cumsum(np.minimum(np.diff(cells), 2.0).astype(np.int64))])
        steps = [s * (packed[-1] + 2) for s in steps] + [1]
        code[rows] = code[rows] * (packed[-1] + 2) + packed[at]
    order = rows[np.argsort(code[rows], kind="stable")]
    ordered = code[order]
    for shifts in itertools.product((-1, 0, 1), repeat=x.shape[1] - 1):
        cell = code[own] + sum(s * step for s, step in zip(shifts, steps[:-1], strict=True))
        begin, end = np.searchsorted(ordered, cell - 1, "left"), np.searchsorted(ordered, cell + 1, "right")
        count = end - begin
        total = np.cumsum(count)
        first = 0
        while first < len(own):
            last = max(first + 1, int(np.searchsorted(total, most + (total[first - 1] if first else 0), "right")))
            n = count[first:last]
            i = np.repeat(own[first:last], n)
            j = order[np.repeat(begin[first:last] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            d2 = np.zeros(len(i))
            for a in range(x.shape[1]):
                d = x[i, a] - x[j, a]
                d2 += d * d
            near = d2 <= radius * radius
            yield i[near], j[near]
            first = last


def merge_roots(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """root, the least number of each row's component, after the rows of i and j were linked too."""
    while True:
        a, b = root[i], root[j]
        low, high = np.minimum(a, b), np.maximum(a, b)
        some = low < high
        if not some.any():
            return root
        i, j = i[some], j[some]
        np.minimum.at(root, high[some], low[some])
        while not (root[root] == root).all():
            root = root[root]


def member_arrays(cell: pa.Scalar, axes: Sequence[str], prefix: str = "") -> tuple[pa.StructArray, np.ndarray]:
    s = cell.values
    return s, np.stack([s.field(prefix + a).to_numpy(zero_copy_only=False) for a in axes], axis=1).astype(np.float64)


def schema_of(*parts: tuple[DataFrame, Sequence[str]]) -> T.StructType:
    return T.StructType([df.schema[c] for df, names in parts for c in names])
