"""Neighbour counts and density clusters by tiles against brute force; tables that grow with the input are never broadcast."""

import numpy as np
import pytest

from arborspark.operators import spatial as X
from arborspark.operators.tiles import merge_roots, near_pairs
from arborspark.plans import detectors, queries

POINT = "scene_id int, pid long, x double, y double, z double"


def _scenes(n=300, wide=12.0, z=3.0):
    rng = np.random.default_rng(5)
    rows = [(s, int(1000 * s + i), *map(float, rng.random(3) * (wide, wide, z))) for s in range(3) for i in range(n)]
    rows += [(0, 9000 + i, 3.0, 3.0, 1.0) for i in range(6)]  # copies of one place
    return rows + [(1, 9100, float("nan"), 1.0, 1.0), (1, 9101, None, 1.0, 1.0), (2, 9102, float("inf"), 1.0, 1.0), (2, 9103, 500.0, 1.0, 1.0)]


def _near(rows, scene, eps, axes):
    ids = [r[1] for r in rows if r[0] == scene and all(v is not None and np.isfinite(v) for v in r[2:])]
    x = np.array([r[2 : 2 + axes] for r in rows if r[1] in set(ids)])
    d2 = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    return np.array(ids), d2 <= eps * eps


def _clusters(rows, eps, least, axes):
    out = {}
    for scene in {r[0] for r in rows}:
        ids, near = _near(rows, scene, eps, axes)
        core = near.sum(axis=1) >= least
        name = {i: ids[i] for i in np.flatnonzero(core)}
        while True:
            new = {i: min(name[j] for j in np.flatnonzero(near[i] & core)) for i in name}
            if new == name:
                break
            name = new
        for i in range(len(ids)):
            around = [name[j] for j in np.flatnonzero(near[i] & core)]
            if around:
                out[int(ids[i])] = int(name[i] if core[i] else min(around))
    return out


@pytest.mark.parametrize("cap", [4096, 25])
@pytest.mark.parametrize(("eps", "least", "axes"), [(0.4, 3, "xy"), (0.7, 4, "xyz"), (0.6, 1, "xyz")])
def test_clusters_equal_brute_force(spark, cap, eps, least, axes):
    rows = _scenes()
    found = X.dbscan(spark.createDataFrame(rows, POINT), eps, least, axes, cap=cap).collect()
    assert len({r.pid for r in found}) == len(found)
    want = _clusters(rows, eps, least, len(axes))
    assert {r.pid: r.cluster_id for r in found} == want and len(want) > 100


@pytest.mark.parametrize("cap", [4096, 25])
def test_neighbour_counts_equal_brute_force(spark, cap):
    rows = _scenes()
    found = X.neighbour_counts(spark.createDataFrame(rows, POINT), 0.7, "xyz", cap=cap).collect()
    want = {int(i): int(n) for s in range(3) for ids, near in [_near(rows, s, 0.7, 3)] for i, n in zip(ids, near.sum(axis=1), strict=True)}
    assert {r.pid: r.neighbours for r in found} == want and len(found) == len(want)


@pytest.mark.parametrize("n", [40, 700])
def test_near_pairs_in_small_pieces(n):
    rng = np.random.default_rng(n)
    x = rng.random((n, 3)) * 6 + (1e6, -3, 0)
    own = np.arange(0, n, 2)
    pieces = list(near_pairs(x, own, 0.9, most=50))
    d2 = ((x[own][:, None] - x[None]) ** 2).sum(axis=2)
    want = {(int(own[i]), int(j)) for i, j in zip(*np.nonzero(d2 <= 0.9 * 0.9), strict=True)}
    got = [(int(a), int(b)) for i, j in pieces for a, b in zip(i, j, strict=True)]
    assert len(got) == len(set(got)) and set(got) == want


def test_merged_roots_of_a_zigzag():
    i = np.array([5, 0, 4, 1, 3, 8])
    j = np.array([0, 4, 1, 3, 2, 9])
    assert merge_roots(np.arange(10), i, j).tolist() == [0, 0, 0, 0, 0, 0, 6, 7, 8, 8]


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["eps_neighbours", "connected_components", "dbscan_link"])
def test_points_are_not_broadcast(spark, data, name):
    assert "Broadcast" not in _plan(queries.__dict__[name](spark, data))


@pytest.mark.parametrize("name", ["suppress_conflicts", "suppress_duplicates"])
def test_trees_are_not_broadcast(spark, data, monkeypatch, name):
    plans = []
    write = X.written
    monkeypatch.setattr(X, "written", lambda df, label: plans.append(_plan(df)) or write(df, label))
    plans.append(_plan(queries.__dict__[name](spark, data)))
    assert len(plans) > 3 and not any("Broadcast" in p for p in plans)


def test_points_among_polygons_are_not_broadcast(spark, data):
    assert "Broadcast" not in _plan(queries.points_in_polygons(spark, data))


def test_slices_write_no_pairs(spark, monkeypatch):
    written = {}
    for module in (X, detectors):
        write = module.written
        monkeypatch.setattr(module, "written", lambda df, name, write=write: written.setdefault(name, write(df, name)))
    rng = np.random.default_rng(3)
    rows = [(0, i, *map(float, rng.random(2)), 0.1) for i in range(400)]  # all within 0.8 m of most others
    assert detectors.slice_nodes(spark.createDataFrame(rows, POINT), 1.5, 4).count() == 1
    assert max(t.count() for t in written.values()) <= 400


def test_stacks_write_no_pairs(spark, monkeypatch):
    written = {}
    for module in (X, detectors):
        write = module.written
        monkeypatch.setattr(module, "written", lambda df, name, write=write: written.setdefault(name, write(df, name)))
    rng = np.random.default_rng(4)
    rows = [(0, i, float(rng.random()), float(rng.random()), i / 10, 1.0) for i in range(300)]  # nodes of one stack
    nodes = spark.createDataFrame(rows, POINT + ", r double")
    assert [tuple(r) for r in detectors._linked(nodes, 60.0, 1.5).groupBy("label").count().collect()] == [(0, 300)]
    assert max(t.count() for t in written.values()) <= 300
