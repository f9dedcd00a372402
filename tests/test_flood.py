"""The flood in tiles against one that looks at every waiting pixel each time."""

import numpy as np
import pytest

from arborspark.operators import flood as W
from arborspark.operators import raster as R

STEPS = ((-1, 0), (0, -1), (0, 1), (1, 0))


def slow_flood(h, markers, mask):
    """The least key first: level, pixels of that height passed, the last of them, steps from it; then row order."""
    keys = {}
    waiting = {(int(y), int(x)): ((-h[y, x], 1, int(y), int(x), 0), int(markers[y, x])) for y, x in zip(*np.nonzero(markers * mask), strict=True)}
    while waiting:
        at = min(waiting, key=lambda p: (waiting[p][0], p))
        keys[at] = waiting.pop(at)
        (level, passed, ly, lx, steps), label = keys[at]
        for dy, dx in STEPS:
            y, x = at[0] + dy, at[1] + dx
            if 0 <= y < h.shape[0] and 0 <= x < h.shape[1] and mask[y, x] and (y, x) not in keys and not (markers[y, x] and mask[y, x]):
                new = (-h[y, x], 1, y, x, 0) if -h[y, x] > level else (level, passed + 1, y, x, 0) if -h[y, x] == level else (level, passed, ly, lx, steps + 1)
                if (y, x) not in waiting or new < waiting[y, x][0]:
                    waiting[y, x] = (new, label)
    out = np.zeros(h.shape, np.int64)
    for p, (_, label) in keys.items():
        out[p] = label
    return out


def by_height(h, markers, mask):
    """With unlike heights: the highest waiting pixel first."""
    labels, waiting = np.where(mask, markers, 0), []
    waiting = [(-h[y, x], y, x) for y, x in zip(*np.nonzero(labels), strict=True)]
    while waiting:
        first = min(waiting)
        waiting.remove(first)
        _, y, x = first
        for dy, dx in STEPS:
            v, u = y + dy, x + dx
            if 0 <= v < h.shape[0] and 0 <= u < h.shape[1] and mask[v, u] and not labels[v, u]:
                labels[v, u] = labels[y, x]
                waiting.append((-h[v, u], v, u))
    return labels


def _case(seed, levels, shape=(18, 15), marks=6):
    rng = np.random.default_rng(seed)
    h = rng.permutation(shape[0] * shape[1]).reshape(shape).astype(float) if levels is None else rng.integers(0, levels, shape).astype(float)
    m = np.zeros(shape, np.int64)
    for i in range(marks):
        m[rng.integers(0, shape[0]), rng.integers(0, shape[1])] = i + 1
    return h, m, h > (20 if levels is None else 0)


@pytest.mark.parametrize("levels", [None, 2, 3, 6])
def test_flood_of_one_tile(levels):
    for seed in range(25):
        h, m, mask = _case(seed, levels)
        got = W.flood(h, m, mask)
        assert (got == slow_flood(h, m, mask)).all()
        if levels is None:
            assert (got == by_height(h, m, mask)).all()


@pytest.mark.parametrize("size", [15, 9, 6])
def test_tiles_give_the_labels_of_one_raster(spark, size):
    cases = {s: _case(s, levels) for s, levels in enumerate((None, 2, 3, 6, 9, None))}
    serpent = np.zeros((17, 17))  # one long way through many tiles
    serpent[::2], serpent[1::4, -1], serpent[3::4, 0] = 5.0, 5.0, 5.0
    start = np.zeros((17, 17), np.int64)
    start[0, 0], start[16, 16] = 1, 2
    cases[6] = (serpent, start, serpent > 0)
    rows = [(s, y, x, float(h[y, x])) for s, (h, _, _) in cases.items() for y in range(h.shape[0]) for x in range(h.shape[1])]
    peaks = [(s, y, x, int(m[y, x])) for s, (_, m, _) in cases.items() for y in range(m.shape[0]) for x in range(m.shape[1]) if m[y, x]]
    floors = {s: 20.0 if s in (0, 5) else 0.0 for s in cases}
    for floor in (20.0, 0.0):
        mine = [s for s in cases if floors[s] == floor]
        raster = spark.createDataFrame([r for r in rows if r[0] in mine], "scene_id int, iy int, ix int, h double")
        markers = spark.createDataFrame([p for p in peaks if p[0] in mine], "scene_id int, iy int, ix int, peak_id int")
        got = {(r.scene_id, r.iy, r.ix): r.label for r in R.watershed(raster, markers, floor, size).collect()}
        want = {}
        for s in mine:
            labels = slow_flood(*cases[s])
            want |= {(s, int(y), int(x)): int(labels[y, x]) for y, x in zip(*np.nonzero(labels), strict=True)}
        assert got == want
    assert R.watershed(raster.limit(0), markers, 0.0, size).count() == 0
