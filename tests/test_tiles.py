"""Neighbour search in tiles against brute force: crowded places, outliers, ties, repeated points, small caps."""

import numpy as np
import pytest

from arborspark.operators import spatial as X
from arborspark.operators import tiles

COLUMNS = "scene_id int, pid long, x double, y double, z double"


def _cloud(seed=0):
    rng = np.random.default_rng(seed)
    spread = rng.random((500, 3)) * [40, 40, 20]
    dense = rng.random((120, 3)) * 0.05 + [10, 10, 5]  # a fifth of the points in one small cell
    same = np.tile([[30.0, 30.0, 1.0]], (40, 1))
    far = np.array([[900.0, 0, 0], [0, 0, -700.0]])
    p = np.concatenate([spread, dense, same, far]).round(2)
    return [(0, i, *map(float, v)) for i, v in enumerate(p)] + [(1, 5000 + i, float(i % 4), float(i // 4), 0.0) for i in range(12)] + [(2, 9000, 1.0, 1.0, 1.0)]


def _brute(left, right, k):
    out = set()
    for s, i, *p in left:
        near = sorted((sum((np.float64(a) - b) ** 2 for a, b in zip(p, q, strict=True)), j) for t, j, *q in right if t == s)
        out |= {(s, i, j, n + 1) for n, (_, j) in enumerate(near[:k])}
    return out


@pytest.mark.parametrize(("cap", "k"), [(40, 6), (4096, 3)])
def test_nearest_join_equals_brute_force(spark, cap, k):
    rows = _cloud()
    p = spark.createDataFrame(rows, COLUMNS)
    got = {(r.scene_id, r.pid, r.r_pid, r["rank"]) for r in X.nearest_join(p, p, k, 2.0, "xyz", "pid", "pid", cap=cap).collect()}
    assert got == _brute(rows, rows, k)


def test_nearest_join_of_rows_outside_the_tiles(spark):
    right, rng = _cloud(), np.random.default_rng(1)
    left = [(0, i, *map(float, v)) for i, v in enumerate((rng.random((60, 3)) * [400, 400, 60] - [180, 180, 20]).round(2))] + [(7, 99, 0.0, 0.0, 0.0)]
    got = X.nearest_join(spark.createDataFrame(left, COLUMNS), spark.createDataFrame(right, COLUMNS), 2, 1.0, "xyz", "pid", "pid", cap=30)
    assert {(r.scene_id, r.pid, r.r_pid, r["rank"]) for r in got.collect()} == _brute(left, right, 2)
    assert got.filter("scene_id = 7").count() == 0  # no right rows in its scene


def test_no_tile_holds_more_than_its_cap_where_points_differ(spark):
    p = spark.createDataFrame([r for r in _cloud() if r[1] < 620 and r[0] == 0], COLUMNS)
    t = tiles.Tiling(p, "xyz", ["scene_id"], 50)
    placed = t.own(p)
    assert placed.count() == p.count() and len(t.levels) > 1
    assert max(r[-1] for r in placed.groupBy(*t.columns).count().collect()) <= 50
    assert tiles.Tiling(p.limit(0), "xyz", ["scene_id"], 50).one


def test_cell_index_finds_all_within_a_cell(spark):
    rng = np.random.default_rng(5)
    x, q = rng.random((400, 2)) * 9, rng.random((150, 2)) * 12 - 1
    seen = {}
    for points, near in tiles.CellIndex(x, 0.7).around(q):
        seen |= {int(i): set(near.tolist()) for i in points}
    for i, row in enumerate(q):
        assert set(np.flatnonzero(((x - row) ** 2).sum(axis=1) <= 0.49).tolist()) <= seen[i]


@pytest.mark.parametrize("shift", [0.0, 5e6])
def test_one_nearest_row_needs_no_cells(monkeypatch, shift):
    monkeypatch.setattr(tiles, "CellIndex", None)  # cells took eight times as long for a scene's points and axes
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.random((300, 3)) * 25, rng.integers(0, 4, (200, 3)), np.full((50, 3), 7.0)]) + shift
    q = np.concatenate([rng.random((400, 3)) * 30 - 2, rng.integers(0, 8, (200, 3)) / 2]) + shift
    ids = rng.permutation(len(x))
    at, d2 = tiles.nearest_rows(q, x, ids, 1)
    far = tiles.squares(q, x)
    assert (d2[:, 0] == far.min(axis=1)).all()
    ties = np.where(far == far.min(axis=1)[:, None], ids, len(x))
    assert (ids[at[:, 0]] == ties.min(axis=1)).all() and ((ties < len(x)).sum(axis=1) > 1).any()


def test_one_nearest_row_beside_rows_that_are_not_numbers():
    x = np.array([[np.nan, 0.0], [1.0, 1.0], [0.0, 3.0]])
    at, d2 = tiles.nearest_rows(np.array([[0.0, 0.0], [0.0, 2.5]]), x, np.arange(3), 1)
    assert at[:, 0].tolist() == [1, 2] and d2[:, 0].tolist() == [2.0, 0.25]
