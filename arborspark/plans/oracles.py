"""DuckDB SQL that gives the same rows as the queries, written without their operators."""

from __future__ import annotations

import math


def _u(k: str) -> str:
    return f"(('0x' || substr(md5(({k})::VARCHAR), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


def r(x: str, digits: int = 6) -> str:
    return f"(round({x}, {digits}) + 0.0::DOUBLE)"


POINTS = f"""p AS (SELECT (event_id // 2500)::INTEGER AS scene_id, event_id AS pid, {_u("event_id * 2")} * 25.0::DOUBLE AS x, {_u("event_id * 2 + 1")} * 25.0::DOUBLE AS y,
  value / 10.0::DOUBLE AS z, (2 + (event_id % 7) % 4)::INTEGER AS cls FROM events)"""

NORMAL = (
    POINTS
    + """, g AS (SELECT scene_id, coalesce(quantile_cont(z, 0.5) FILTER (cls = 2), min(z)) AS z_ground FROM p GROUP BY 1),
n AS (SELECT p.* REPLACE (z - z_ground AS z) FROM p JOIN g USING (scene_id)),
v AS (SELECT * FROM (SELECT *, max((cls IN (3, 4, 5))::INT) OVER (PARTITION BY scene_id) AS has FROM n) WHERE CASE WHEN has = 1 THEN cls IN (3, 4, 5) ELSE z >= 2.0 END)"""
)


def _geo(t: str) -> str:
    return f"geo AS (SELECT scene_id, min(x) AS x_min, max(y) AS y_max, (ceil(max(x) - min(x)) + 1)::INTEGER AS n_cols, (ceil(max(y) - min(y)) + 1)::INTEGER AS n_rows FROM {t} GROUP BY 1)"


def _cells(t: str) -> str:
    return f"chm AS (SELECT scene_id, floor(y_max - y)::INTEGER AS iy, floor(x - x_min)::INTEGER AS ix, max(z) AS h FROM {t} JOIN geo USING (scene_id) GROUP BY ALL)"


CANOPY = (
    NORMAL
    + ", "
    + _geo("v")
    + ", "
    + _cells("v")
    + """, grid AS (SELECT scene_id, n_cols, n_rows, unnest(range(0, n_rows))::INTEGER AS iy FROM geo),
cell AS (SELECT scene_id, n_cols, n_rows, iy, unnest(range(0, n_cols))::INTEGER AS ix FROM grid),
c AS (SELECT cell.*, coalesce(h, 0.0) AS h FROM cell LEFT JOIN chm USING (scene_id, iy, ix))"""
)

PEAKS = (
    CANOPY
    + """, beaten AS (SELECT DISTINCT a.scene_id, a.iy, a.ix FROM c a JOIN c b ON a.scene_id = b.scene_id AND abs(a.iy - b.iy) <= 2 AND abs(a.ix - b.ix) <= 2
  AND (b.h > a.h OR (b.h = a.h AND (b.iy, b.ix) < (a.iy, a.ix)
    AND b.iy >= 2 AND b.iy < b.n_rows - 2 AND b.ix >= 2 AND b.ix < b.n_cols - 2
    AND b.h = (SELECT max(h) FROM c x WHERE x.scene_id = b.scene_id AND abs(x.iy - b.iy) <= 2 AND abs(x.ix - b.ix) <= 2)))),
peaks AS (SELECT scene_id, iy, ix, h, row_number() OVER (PARTITION BY scene_id ORDER BY h DESC, iy, ix)::INTEGER AS peak_id FROM c
  WHERE h > 2.0 AND iy >= 2 AND iy < n_rows - 2 AND ix >= 2 AND ix < n_cols - 2 AND NOT EXISTS (SELECT 1 FROM beaten b WHERE (b.scene_id, b.iy, b.ix) = (c.scene_id, c.iy, c.ix)))"""
)

BASINS = (
    "RECURSIVE "
    + CANOPY
    + """, m AS (SELECT scene_id, iy, ix, h, iy::BIGINT * 1048576 + ix AS id FROM c WHERE h > 2.0),
up AS MATERIALIZED (SELECT a.scene_id, a.id, arg_max(b.id, (b.h, -b.id)) AS nxt FROM m a JOIN m b ON a.scene_id = b.scene_id AND abs(a.iy - b.iy) <= 1 AND abs(a.ix - b.ix) <= 1 GROUP BY 1, 2),
walk(scene_id, id, pos) AS (SELECT scene_id, id, nxt FROM up UNION SELECT w.scene_id, w.id, u.nxt FROM walk w JOIN up u ON u.scene_id = w.scene_id AND u.id = w.pos WHERE u.nxt <> w.pos),
ends AS (SELECT w.scene_id, w.id, w.pos AS label FROM walk w JOIN up u ON u.scene_id = w.scene_id AND u.id = w.pos AND u.nxt = w.pos),
b AS (SELECT m.*, label FROM m JOIN ends USING (scene_id, id))"""
)


def _near(radius: float, t: str = "p", z: str = "1") -> str:
    return f"""e AS MATERIALIZED (SELECT a.scene_id, a.pid AS a, b.pid AS b FROM {t} a JOIN {t} b ON a.scene_id = b.scene_id AND abs(a.x - b.x) <= {radius} AND abs(a.y - b.y) <= {radius}
  AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) * {z} <= {radius} * {radius}::DOUBLE)"""


_DBSCAN = """core AS (SELECT a FROM e GROUP BY a HAVING count(*) >= {k}),
ce AS MATERIALIZED (SELECT a, b FROM e WHERE a IN (SELECT a FROM core) AND b IN (SELECT a FROM core)),
w(pid, lab) AS (SELECT a, a FROM core UNION SELECT ce.b, w.lab FROM w JOIN ce ON ce.a = w.pid WHERE w.lab < ce.b),
comp AS (SELECT pid, min(lab) AS lab FROM w GROUP BY 1)
SELECT e.a AS pid, coalesce(max(own.lab), min(comp.lab)) AS cluster_id FROM e JOIN comp ON comp.pid = e.b LEFT JOIN comp own ON own.pid = e.a GROUP BY 1"""

LABELS = POINTS + ", c AS (SELECT *, (floor(x / 5) * 5 + floor(y / 5))::BIGINT AS label FROM p)"
STATS = LABELS + ", s AS (SELECT scene_id, label, count(*) AS n, avg(x) AS cx, avg(y) AS cy, min(z) AS z_min, max(z) AS z_max, stddev_pop(z) AS z_dev, arg_max((x, y, pid), (z, -pid)) AS top FROM c GROUP BY 1, 2)"
PROFILE = (
    STATS
    + """, q AS (SELECT c.scene_id, c.label, floor((z_max - z) / (z_max / 7))::INTEGER AS bin, sqrt((x - top[1]) * (x - top[1]) + (y - top[2]) * (y - top[2])) AS d, z_max FROM c JOIN s USING (scene_id, label) WHERE z_max <> 0),
pr AS (SELECT scene_id, label, bin, (bin + 0.5::DOUBLE) * max(z_max) / 7 AS depth, quantile_cont(d, 0.85) AS r FROM q WHERE bin BETWEEN 0 AND 6 GROUP BY 1, 2, 3 HAVING count(*) > 3)"""
)

_H = "(4.0::DOUBLE + p_size * 0.6::DOUBLE)"
TREES = f"""ref AS (SELECT (p_partkey // 5)::INTEGER AS scene_id, p_partkey::INTEGER AS tree_id, {_u("p_partkey * 3")} * 10.0::DOUBLE AS x, {_u("p_partkey * 3 + 1")} * 10.0::DOUBLE AS y,
  {_H} AS height, 1.5::DOUBLE + {_H} / 35.0::DOUBLE * 3.5::DOUBLE AS radius, CASE WHEN p_partkey % 2 = 0 THEN 'conical' ELSE 'spherical' END AS shape FROM part),
pred AS (SELECT (p_partkey // 5)::INTEGER AS scene_id, p_partkey::INTEGER AS tree_id, {_u("p_partkey * 3")} * 10.0::DOUBLE + {_u("p_partkey * 7 + 5")} * 3.0::DOUBLE AS x, {_u("p_partkey * 3 + 1")} * 10.0::DOUBLE AS y,
  {_H} + {_u("p_partkey * 11")} - 0.5::DOUBLE AS height, 1.5::DOUBLE + {_u("p_partkey * 13")} * 3.0::DOUBLE AS radius, CASE WHEN p_partkey % 3 = 0 THEN 'conical' ELSE 'spherical' END AS shape FROM part WHERE p_partkey % 9 <> 0)"""
SIM = (
    TREES
    + """, s0 AS (SELECT a.scene_id, a.tree_id AS ref_id, b.tree_id AS pred_id, (a.shape = b.shape)::INT::DOUBLE AS s_type,
  greatest(0, 1 - abs(a.height - b.height) / greatest(a.height, b.height)) AS s_height, greatest(0, 1 - abs(a.radius - b.radius) / greatest(a.radius, b.radius)) AS s_radius,
  1 / (1 + sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))) AS s_pos FROM ref a JOIN pred b USING (scene_id)),
sim AS MATERIALIZED (SELECT *, (s_type + s_height + s_radius + s_pos) / 4 AS avg_sim FROM s0)"""
)
#: Best assignment by enumeration: scenes have at most five trees a side.
BEST = (
    SIM
    + """, k AS MATERIALIZED (SELECT *, dense_rank() OVER (PARTITION BY scene_id ORDER BY ref_id) AS i, dense_rank() OVER (PARTITION BY scene_id ORDER BY pred_id) AS j FROM sim),
nr AS (SELECT scene_id, max(i) AS n FROM k GROUP BY 1),
a(scene_id, i, mask, tot, pairs) AS (
  SELECT scene_id, 0::BIGINT, 0::BIGINT, 0::DOUBLE, []::STRUCT(r INTEGER, p INTEGER)[] FROM nr
  UNION ALL
  SELECT * FROM (
    SELECT a.scene_id, a.i + 1, a.mask | (1::BIGINT << (k.j - 1)), a.tot + k.avg_sim, list_append(a.pairs, {'r': k.ref_id, 'p': k.pred_id}) FROM a JOIN k ON k.scene_id = a.scene_id AND k.i = a.i + 1 WHERE (a.mask & (1::BIGINT << (k.j - 1))) = 0
    UNION ALL
    SELECT a.scene_id, a.i + 1, a.mask, a.tot, a.pairs FROM a JOIN nr ON nr.scene_id = a.scene_id WHERE a.i < nr.n)),
best AS (SELECT a.scene_id, max(tot) AS total, arg_max(pairs, tot) AS pairs FROM a JOIN nr ON nr.scene_id = a.scene_id AND a.i = nr.n GROUP BY 1),
ok AS (SELECT sim.* FROM sim JOIN (SELECT scene_id, unnest(pairs) AS u FROM best) b ON b.scene_id = sim.scene_id AND sim.ref_id = b.u.r AND sim.pred_id = b.u.p WHERE avg_sim >= 0.15)"""
)


def _scores(pairs: str) -> str:
    part = lambda c: f"CASE WHEN n_ref = 0 AND n_pred = 0 THEN 100 ELSE greatest(0, 100 * (1 - sqrt((coalesce(e_{c}, 0) + n_ref - tp + n_pred - tp) / greatest(n_ref, n_pred)))) END"
    names = {"avg_sim": "score", "s_type": "score_type", "s_height": "score_height", "s_radius": "score_radius", "s_pos": "score_pos"}
    errors = ", ".join(f"sum(power(1 - {c}, 2)) AS e_{c}" for c in names)
    total = " + ".join(part(c) for c in list(names)[1:])
    return f""", m AS (SELECT scene_id, count(*) AS c, avg(avg_sim) AS a, min(avg_sim) AS w, {errors} FROM {pairs} GROUP BY 1),
z AS (SELECT *, coalesce(c, 0) AS tp FROM (SELECT scene_id, count(*) AS n_ref FROM ref GROUP BY 1) FULL JOIN (SELECT scene_id, count(*) AS n_pred FROM pred GROUP BY 1) USING (scene_id) LEFT JOIN m USING (scene_id))
SELECT scene_id, n_ref, n_pred, tp, n_ref - tp AS fn, n_pred - tp AS fp, {r("coalesce(a, 0)")} AS avg_similarity, {r("coalesce(w, 0)")} AS worst,
  {", ".join(f"{r(part(c))} AS {n}" for c, n in names.items())}, {r(f"({total}) / 4")} AS score_total FROM z"""


def _suppress(conflict: str) -> str:
    return f"""WITH RECURSIVE {TREES}, t AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY height DESC, tree_id) AS rk FROM pred),
n AS (SELECT scene_id, max(rk) AS m FROM t GROUP BY 1),
k(scene_id, rk, kept) AS (SELECT scene_id, 0::BIGINT, []::BIGINT[] FROM n UNION ALL
  SELECT k.scene_id, t.rk, CASE WHEN EXISTS (SELECT 1 FROM t q WHERE q.scene_id = t.scene_id AND list_contains(k.kept, q.rk) AND ({conflict})) THEN k.kept ELSE list_append(k.kept, t.rk) END
  FROM k JOIN t ON t.scene_id = k.scene_id AND t.rk = k.rk + 1),
done AS (SELECT k.scene_id, unnest(k.kept) AS rk FROM k JOIN n ON n.scene_id = k.scene_id AND k.rk = n.m)
SELECT t.scene_id, t.tree_id FROM t JOIN done USING (scene_id, rk)"""


_FAR = "sqrt((t.x - q.x) * (t.x - q.x) + (t.y - q.y) * (t.y - q.y))"

_FACTORS = ("noise_level", "dropout_rate", "overlap_factor", "mixing_factor", "gap_factor")
RESULTS = "res AS (SELECT event_id AS run_id, event_type AS parser, value AS score, value / 7.0::DOUBLE AS duration, " + ", ".join(
    f"CASE WHEN event_id % 5 = {i} THEN (user_id % 11) / 10.0::DOUBLE ELSE 0.0::DOUBLE END AS {f}" for i, f in enumerate(_FACTORS)
) + " FROM events)"
_UNPIVOT = " UNION ALL ".join(f"SELECT '{f}' AS param, parser, {f} AS val, score FROM res" for f in _FACTORS)
_COMPLEXITY = f"round({' + '.join(_FACTORS)}, 2)"


def oracle_sql() -> dict[str, str]:
    void = "abs(y - (4.0 * sin(0.3::DOUBLE * x + 1.0) + 12.0)) < 1.5 OR sqrt((x - 5) * (x - 5) + (y - 5) * (y - 5)) < 3 OR sqrt((x - 18) * (x - 18) + (y - 7) * (y - 7)) < 2"
    poly = ((3.0, 2.0), (21.0, 4.0), (23.0, 18.0), (12.0, 11.0), (4.0, 22.0))
    edges = ", ".join(f"({a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE, {d}::DOUBLE)" for (a, b), (c, d) in zip(poly, [*poly[1:], poly[0]], strict=True))
    sigma, radius = 0.8, 3
    weights = [math.exp(-0.5 * (i / sigma) ** 2) for i in range(-radius, radius + 1)]
    gauss = ", ".join(f"({i}, {w / sum(weights)!r}::DOUBLE)" for i, w in zip(range(-radius, radius + 1), weights, strict=True))

    def blur(line: str, step: str, n: str, t: str) -> str:
        at = f"((a.{step} + k.o + 2 * {n}) % (2 * {n}))"
        return f"(SELECT a.scene_id, a.iy, a.ix, a.n_rows, a.n_cols, sum(b.h * k.w) AS h FROM {t} a, k JOIN {t} b ON b.scene_id = a.scene_id AND b.{line} = a.{line} AND b.{step} = CASE WHEN {at} < {n} THEN {at} ELSE 2 * {n} - 1 - {at} END GROUP BY ALL)"

    cross = "a.scene_id = b.scene_id AND abs(a.iy - b.iy) + abs(a.ix - b.ix) <= 1"
    return {
        "ground_level": f"WITH {NORMAL} SELECT scene_id, {r('z_ground')} AS z_ground FROM g",
        "height_normalise": f"WITH {NORMAL} SELECT scene_id, pid, {r('z')} AS z FROM n",
        "veg_filter": f"WITH {NORMAL} SELECT scene_id, pid FROM v",
        "min_height": f"WITH {NORMAL} SELECT scene_id, pid FROM n WHERE z >= 2.5",
        "class_from_height": f"WITH {POINTS} SELECT pid, CASE WHEN z < 0.5 THEN 2 WHEN z < 2 THEN 3 WHEN z < 5 THEN 4 ELSE 5 END AS cls FROM p",
        "dropout_keep": f"WITH {POINTS} SELECT pid FROM p WHERE cls NOT IN (3, 4, 5) OR {_u('pid * 3 + 7')} > 0.3",
        "occlusion_thin": f"WITH {POINTS}, t AS (SELECT *, max(z) OVER (PARTITION BY scene_id, floor(x / 0.25), floor(y / 0.25)) - z AS d FROM p) SELECT pid FROM t WHERE {_u('pid * 5 + 3')} <= power(0.8::DOUBLE, d)",
        "void_mask": f"WITH {POINTS} SELECT pid FROM p WHERE NOT ({void})",
        "crown_solid": f"""WITH {POINTS}, d AS (SELECT *, sqrt((x - 12.5) * (x - 12.5) + (y - 12.5) * (y - 12.5)) AS d FROM p)
SELECT pid FROM d WHERE CASE WHEN pid % 2 = 0 THEN d <= 8.0 * (1 - z / 30.0) * 2.6 ELSE power(d / 8.0, 2) + power((z - 18.0) / 12.0, 2) <= 1 OR (d < 2.4 AND z < 6.0) END""",
        "polygon_crop": f"""WITH {POINTS}, e(x1, y1, x2, y2) AS (VALUES {edges})
SELECT scene_id, pid FROM p, e GROUP BY ALL HAVING sum(((y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / nullif(y2 - y1, 0) + x1)::INT) % 2 = 1""",
        "points_in_polygons": f"""WITH {POINTS}, k AS (SELECT (p_partkey // 500)::INTEGER AS scene_id, p_partkey AS polygon_id, p_partkey * 131 AS k, (3 + p_partkey % 10)::BIGINT AS n, unnest(range(0, 3 + p_partkey % 10)) AS i FROM part),
v AS (SELECT scene_id, polygon_id, n, i, {_u("k + 91")} * 25.0::DOUBLE + {_u("k + 2 * i")} * (1.0::DOUBLE + {_u("k + 90")} * 7.0::DOUBLE) AS x, {_u("k + 92")} * 25.0::DOUBLE + {_u("k + 2 * i + 1")} * (1.0::DOUBLE + {_u("k + 90")} * 7.0::DOUBLE) AS y FROM k),
e AS (SELECT a.scene_id, a.polygon_id, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM v a JOIN v b ON a.polygon_id = b.polygon_id AND b.i = (a.i + 1) % a.n)
SELECT p.scene_id, pid, polygon_id FROM p JOIN e ON p.scene_id = e.scene_id AND (y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / nullif(y2 - y1, 0) + x1 GROUP BY ALL HAVING count(*) % 2 = 1""",
        "height_slices": f"WITH {POINTS}, t AS (SELECT scene_id, max(z) AS m FROM p GROUP BY 1) SELECT scene_id, floor((m - z) / 0.5)::INTEGER AS slice_id, count(*) AS n FROM p JOIN t USING (scene_id) GROUP BY ALL",
        "axis_densify": f"""WITH {POINTS}, s AS (SELECT *, pid // 8 AS axis_id, row_number() OVER (PARTITION BY scene_id, pid // 8 ORDER BY z DESC, pid)::INTEGER AS step FROM p),
b AS (SELECT a.*, b.x AS x2, b.y AS y2, b.z AS z2 FROM s a JOIN s b ON a.scene_id = b.scene_id AND a.axis_id = b.axis_id AND b.step = a.step + 1),
n AS (SELECT *, greatest(1, floor(sqrt((x2 - x) * (x2 - x) + (y2 - y) * (y2 - y) + (z2 - z) * (z2 - z)) / 0.5))::INTEGER AS n FROM b),
i AS (SELECT *, unnest(range(0, n + 1))::INTEGER AS i FROM n)
SELECT scene_id, axis_id, step, i, {r('x + (x2 - x) * i / n')} AS x, {r('y + (y2 - y) * i / n')} AS y, {r('floor((z + (z2 - z) * i / n) * 10000 + 0.27::DOUBLE) / 10000')} AS z FROM i""",
        "grid_extent": f"WITH {POINTS}, {_geo('p')} SELECT scene_id, {r('x_min')} AS x_min, {r('y_max')} AS y_max, n_cols, n_rows FROM geo",
        "chm_max": f"WITH {POINTS}, {_geo('p')}, {_cells('p')} SELECT scene_id, iy, ix, {r('h')} AS h FROM chm",
        "grey_closing": f"""WITH {CANOPY}, u AS (SELECT a.scene_id, a.iy, a.ix, max(b.h) AS h FROM c a JOIN c b ON {cross} GROUP BY ALL)
SELECT a.scene_id, a.iy, a.ix, {r('min(b.h)')} AS h FROM u a JOIN u b ON {cross} GROUP BY ALL""",
        "gaussian_smooth": f"WITH {CANOPY}, k(o, w) AS (VALUES {gauss}), g1 AS {blur('iy', 'ix', 'a.n_cols', 'c')}, g2 AS {blur('ix', 'iy', 'a.n_rows', 'g1')} SELECT scene_id, iy, ix, {r('h', 5)} AS h FROM g2",
        "canopy_peaks": f"WITH {PEAKS} SELECT scene_id, count(*) AS peaks, {r('avg(h)')} AS mean_height FROM peaks GROUP BY 1",
        "local_maxima": f"WITH {PEAKS} SELECT scene_id, iy, ix, {r('h')} AS h, peak_id FROM peaks",
        "basin_labels": f"WITH {BASINS} SELECT scene_id, iy, ix, label FROM b",
        "region_props": f"WITH {BASINS} SELECT scene_id, label, {r('max(h)')} AS max_h, {r('avg(h)')} AS mean_h, {r('avg(iy)')} AS row, {r('avg(ix)')} AS col, count(*) AS area, {r('sqrt(4 * count(*) / pi()) / 2')} AS radius FROM b GROUP BY 1, 2",
        "tall_mask": f"WITH {CANOPY} SELECT DISTINCT scene_id, iy + dy AS iy, ix + dx AS ix FROM c, (SELECT unnest(range(-2, 3))::INTEGER AS dy) a, (SELECT unnest(range(-2, 3))::INTEGER AS dx) b WHERE h > 40",
        "disc_mask": f"""WITH {PEAKS}, o AS (SELECT *, least(4, floor(h / 12))::INTEGER AS rad FROM peaks)
SELECT DISTINCT scene_id, iy + dy AS iy, ix + dx AS ix FROM o, (SELECT unnest(range(-4, 5))::INTEGER AS dy) a, (SELECT unnest(range(-4, 5))::INTEGER AS dx) b WHERE dy * dy + dx * dx <= rad * rad""",
        "minmax_normalise": f"WITH {CANOPY}, m AS (SELECT scene_id, min(h) AS lo, max(h) AS hi FROM c GROUP BY 1) SELECT scene_id, iy, ix, {r('(h - lo) / (hi - lo + 1e-6)')} AS h FROM c JOIN m USING (scene_id)",
        "percentile_stretch": f"WITH {CANOPY}, m AS (SELECT scene_id, quantile_cont(h, 0.05) FILTER (h > 0) AS lo, quantile_cont(h, 0.99) AS hi FROM c GROUP BY 1) SELECT scene_id, iy, ix, {r('least(greatest(h, coalesce(lo, h)), hi)')} AS h FROM c JOIN m USING (scene_id)",
        "eps_neighbours": f"WITH {POINTS}, {_near(1.5)} SELECT scene_id, a AS pid, count(*) AS neighbours FROM e GROUP BY 1, 2",
        "knn_k8": f"""WITH {POINTS}, d AS (SELECT a.pid, b.pid AS near, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) AS d2 FROM p a JOIN p b USING (scene_id)),
k AS (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY d2, near)::INTEGER AS rank FROM d) SELECT pid, rank, near, {r('d2')} AS d2 FROM k WHERE rank <= 8""",
        "sor_filter": f"""WITH {POINTS}, d AS (SELECT scene_id, a.pid, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) AS d2, b.pid AS near FROM p a JOIN p b USING (scene_id)),
k AS (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY d2, near) AS rank FROM d), m AS (SELECT scene_id, pid, avg(sqrt(d2)) AS m FROM k WHERE rank <= 8 GROUP BY 1, 2),
s AS (SELECT scene_id, count(*) AS n, avg(m) + 1.5 * stddev_pop(m) AS lim FROM m GROUP BY 1) SELECT pid FROM m JOIN s USING (scene_id) WHERE n < 100 OR m < lim""",
        "nearest_peak": f"""WITH {POINTS}, d AS (SELECT a.pid, b.pid AS g, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z * 0.3::DOUBLE - b.z * 0.3::DOUBLE) * (a.z * 0.3::DOUBLE - b.z * 0.3::DOUBLE) AS d2
FROM p a JOIN p b ON a.scene_id = b.scene_id AND a.cls > 2 AND b.cls = 2) SELECT pid, arg_min(g, (d2, g)) AS ground_pid FROM d GROUP BY 1""",
        "descent_step": f"""WITH {POINTS}, {_near(2.5)} SELECT a.pid, count(*) AS n, {r('avg(b.x)')} AS x, {r('avg(b.y)')} AS y, sum(round(b.z * 1000)::BIGINT)::BIGINT AS z_mm
FROM e JOIN p a ON a.pid = e.a JOIN p b ON b.pid = e.b WHERE a.cls = 2 AND b.z < a.z AND b.z > a.z - 2.0 GROUP BY 1""",
        "connected_components": f"WITH RECURSIVE {POINTS}, {_near(0.7)}, w(pid, lab) AS (SELECT pid, pid FROM p UNION SELECT e.b, w.lab FROM w JOIN e ON e.a = w.pid WHERE w.lab < e.b) SELECT pid, min(lab) AS component FROM w GROUP BY 1",
        "dbscan_slice": f"""WITH RECURSIVE {POINTS}, t AS (SELECT p.*, floor((m - z) / 2.0) AS sl FROM p JOIN (SELECT scene_id, max(z) AS m FROM p GROUP BY 1) USING (scene_id)),
e AS MATERIALIZED (SELECT a.pid AS a, b.pid AS b FROM t a JOIN t b ON a.scene_id = b.scene_id AND a.sl = b.sl AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 0.9::DOUBLE * 0.9::DOUBLE), """
        + _DBSCAN.format(k=4),
        "dbscan_link": f"WITH RECURSIVE {POINTS}, t AS (SELECT * REPLACE (z / 2 AS z) FROM p), {_near(1.2, 't')}, " + _DBSCAN.format(k=5),
        "cluster_stats": f"WITH {STATS} SELECT scene_id, label, n, {r('cx')} AS cx, {r('cy')} AS cy, {r('z_min')} AS z_min, {r('z_max')} AS z_max, {r('z_dev')} AS z_dev, {r('top[1]')} AS top_x, {r('top[2]')} AS top_y, top[3] AS top_pid FROM s",
        "vertical_clusters": f"WITH {STATS} SELECT scene_id, label FROM s WHERE n >= 38 AND coalesce(z_dev / nullif(z_max, 0), 0) >= 0.195",
        "weighted_centre": f"WITH {LABELS} SELECT scene_id, label, {r('sum(x * power(z, 4)) / nullif(sum(power(z, 4)), 0)')} AS wx, {r('sum(y * power(z, 4)) / nullif(sum(power(z, 4)), 0)')} AS wy FROM c GROUP BY 1, 2",
        "radius_percentiles": f"WITH {STATS}, d AS (SELECT c.scene_id, c.label, sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy)) AS d FROM c JOIN s USING (scene_id, label)) SELECT scene_id, label, {r('quantile_cont(d, 0.9)')} AS radius, {r('max(d)')} AS r_max FROM d GROUP BY 1, 2",
        "radial_profile": f"WITH {PROFILE} SELECT scene_id, label, bin, {r('depth')} AS depth, {r('r')} AS r FROM pr",
        "shape_cone_ball": f"""WITH {PROFILE}, f AS (SELECT scene_id, label, count(*) AS n, sum(r * depth) / nullif(sum(depth * depth), 0) AS kc, sum(r * sqrt(depth)) / nullif(sum(depth), 0) AS kb FROM pr GROUP BY 1, 2)
SELECT scene_id, label, CASE WHEN max(n) < 3 THEN 'undefined' WHEN sum(power(r - kc * depth, 2)) < sum(power(r - kb * sqrt(depth), 2)) THEN 'conical' ELSE 'spherical' END AS shape FROM pr JOIN f USING (scene_id, label) GROUP BY 1, 2""",
        "shape_mean_ratio": f"WITH {LABELS} SELECT scene_id, label, CASE WHEN avg(z) < 0.6 * max(z) THEN 'conical' ELSE 'spherical' END AS shape FROM c GROUP BY 1, 2",
        "shape_correlation": f"""WITH {LABELS}, m AS (SELECT scene_id, label, sum(x * power(z, 4)) / nullif(sum(power(z, 4)), 0) AS wx, sum(y * power(z, 4)) / nullif(sum(power(z, 4)), 0) AS wy, max(z) AS top FROM c GROUP BY 1, 2),
q AS (SELECT scene_id, label, z, top, top - z AS depth, sqrt((x - wx) * (x - wx) + (y - wy) * (y - wy)) AS r FROM c JOIN m USING (scene_id, label)),
n AS (SELECT scene_id, label, count(*) AS n, count(*) FILTER (r > 0 AND depth > 0) AS fit, coalesce(avg(z) / nullif(max(top), 0), 1) AS low FROM q GROUP BY 1, 2),
o AS (SELECT scene_id, label, CASE WHEN var_pop(r) > 0 AND var_pop(depth) > 0 THEN corr(r, depth) END AS co FROM q WHERE r > 0 AND depth > 0 GROUP BY 1, 2)
SELECT scene_id, label, CASE WHEN n < 10 OR fit < 5 THEN 'spherical' WHEN coalesce(co, 0) > 0.7 OR low < 0.45 THEN 'conical' ELSE 'spherical' END AS shape FROM n LEFT JOIN o USING (scene_id, label)""",
        "smart_shape": f"""WITH {LABELS}, q AS (SELECT scene_id, label, z, sqrt(power(x - floor(x / 5) * 5 - 2.5, 2) + power(y - floor(y / 5) * 5 - 2.5, 2)) AS r, max(z) OVER w + label % 3 - z AS d FROM c WINDOW w AS (PARTITION BY scene_id, label)),
o AS (SELECT scene_id, label, r, d / (max(d) OVER w + 0.01) AS h FROM q WINDOW w AS (PARTITION BY scene_id, label))
SELECT scene_id, label, CASE WHEN count(*) >= 5 AND corr(r, h) > corr(r, sqrt(h)) THEN 'conical' ELSE 'spherical' END AS shape FROM o GROUP BY 1, 2""",
        "layer_nodes": f"""WITH RECURSIVE {NORMAL}, t0 AS (SELECT scene_id, pid, x * 0.2::DOUBLE AS x, y * 0.2::DOUBLE AS y, z, floor((max(z) OVER (PARTITION BY scene_id) - z) / 0.5)::INTEGER AS sl FROM v),
t AS MATERIALIZED (SELECT * FROM t0 QUALIFY count(*) OVER (PARTITION BY scene_id, sl) > 4),
e AS MATERIALIZED (SELECT a.pid AS a, b.pid AS b FROM t a JOIN t b ON a.scene_id = b.scene_id AND a.sl = b.sl AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 0.8::DOUBLE * 0.8::DOUBLE), """
        + _DBSCAN.format(k=4).replace("SELECT e.a AS pid", ", f AS (SELECT e.a AS pid")
        + f"""), k AS (SELECT scene_id, sl, cluster_id, x, y, z, avg(x) OVER w AS cx, avg(y) OVER w AS cy FROM t JOIN f USING (pid) WINDOW w AS (PARTITION BY cluster_id))
SELECT scene_id, sl AS slice_id, cluster_id, {r('avg(x)')} AS x, {r('avg(y)')} AS y, {r('avg(z)')} AS z, {r('max(sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy)))')} AS r FROM k GROUP BY 1, 2, 3""",
        "suppress_duplicates": _suppress(f"{_FAR} < 2.0 OR {_FAR} < 0.6 * (t.radius + q.radius)"),
        "suppress_conflicts": _suppress(f"({_FAR} < 0.75 * (t.radius + q.radius) AND t.height < 0.4 * q.height) OR {_FAR} < 0.8"),
        "tree_similarity": f"WITH {SIM} SELECT scene_id, ref_id, pred_id, {', '.join(f'{r(c)} AS {c}' for c in ('s_type', 's_height', 's_radius', 's_pos', 'avg_sim'))} FROM sim",
        "optimal_assignment": f"WITH RECURSIVE {BEST} SELECT scene_id, {r('total')} AS total FROM best WHERE len(pairs) > 0",
        "unmatched_ref": f"WITH RECURSIVE {BEST} SELECT scene_id, tree_id FROM ref WHERE (scene_id, tree_id) NOT IN (SELECT scene_id, ref_id FROM ok)",
        "scene_scores": f"WITH RECURSIVE {BEST}{_scores('ok')}",
        "paired_scores": f"WITH {SIM}, ok AS (SELECT * FROM sim WHERE ref_id = pred_id AND avg_sim >= 0.15){_scores('ok')}",
        "shape_report": f"WITH {TREES} SELECT scene_id, shape, count(*) AS n, {r('avg(height)')} AS height, {r('avg(radius)')} AS radius FROM ref GROUP BY ROLLUP (scene_id, shape)",
        "scene_keys": f"WITH {RESULTS} SELECT printf('N%.2f_D%.2f_O%.2f_M%.2f_G%.2f', {', '.join(_FACTORS)}) AS scene_key, count(*) AS runs FROM res GROUP BY 1",
        "report_quality": f"WITH {RESULTS}, u AS ({_UNPIVOT}) SELECT param, parser, val, {r('avg(score)')} AS score FROM u GROUP BY 1, 2, 3",
        "report_time": f"WITH {RESULTS} SELECT parser, {_COMPLEXITY} AS complexity, {r('avg(duration)')} AS time FROM res GROUP BY 1, 2",
        "report_components": f"WITH {RESULTS}, u AS ("
        + " UNION ALL ".join(f"SELECT '{m}' AS metric, parser, {_COMPLEXITY} AS complexity, score / {k} AS part FROM res" for m, k in (("type", 2), ("height", 3), ("radius", 4), ("position", 5)))
        + f") SELECT metric, parser, complexity, {r('avg(part)')} AS score FROM u GROUP BY 1, 2, 3",
        "chart_nearest_x": f"WITH {RESULTS}, l AS (SELECT parser, {_COMPLEXITY} AS level, avg(score) AS score FROM res GROUP BY 1, 2) SELECT parser, {r('arg_min(level, (round(abs(level - 0.43), 6), level))')} AS level, {r('arg_min(score, (round(abs(level - 0.43), 6), level))')} AS score FROM l GROUP BY 1",
        "axis_limits": f"WITH {RESULTS} SELECT parser, {r('min(score) - 0.05 * (max(score) - min(score))')} AS low, {r('max(score) + 0.05 * (max(score) - min(score))')} AS high FROM res GROUP BY 1",
        "run_labels": f"""WITH {RESULTS} SELECT run_id, regexp_replace(printf('%.4f', score), '\\.?0+$', '') AS score_label,
  regexp_replace(parser || '/' || printf('N%.2f_D%.2f_O%.2f_M%.2f_G%.2f', {', '.join(_FACTORS)}), '[^A-Za-z0-9 _-]', '_', 'g') AS file,
  printf('%02d:%02d:%02d', (floor(score * 37)::BIGINT // 3600) % 24, (floor(score * 37)::BIGINT // 60) % 60, floor(score * 37)::BIGINT % 60) AS clock FROM res""",
        "las_round_trip": f"WITH {POINTS} SELECT scene_id, cls, count(*) AS n, sum(floor(z * 10 + 0.2337::DOUBLE)::BIGINT)::BIGINT AS z_dm FROM p GROUP BY 1, 2",
        "stream_las": f"""WITH {POINTS}, low AS (SELECT scene_id, min(z) AS lz FROM p GROUP BY 1),
m AS (SELECT scene_id, cls, round((z - lz) / 0.001::DOUBLE) * 0.001::DOUBLE + lz AS z FROM p JOIN low USING (scene_id))
SELECT scene_id, cls, count(*) AS n, sum(floor(z * 10 + 0.2337::DOUBLE)::BIGINT)::BIGINT AS z_dm FROM m WHERE z >= 9.9995::DOUBLE GROUP BY 1, 2""",
        "las_crop": f"""WITH {POINTS}, low AS (SELECT scene_id, min(x) AS lx, min(y) AS ly FROM p GROUP BY 1), e(x1, y1, x2, y2) AS (VALUES {edges}),
m AS (SELECT scene_id, pid, cls, round((x - lx) / 0.001::DOUBLE) * 0.001::DOUBLE + lx AS x, round((y - ly) / 0.001::DOUBLE) * 0.001::DOUBLE + ly AS y FROM p JOIN low USING (scene_id)),
i AS (SELECT scene_id, pid, cls FROM m, e GROUP BY ALL HAVING sum(((y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / nullif(y2 - y1, 0) + x1)::INT) % 2 = 1)
SELECT scene_id, cls, count(*) AS n FROM i GROUP BY 1, 2""",
        "pixel_to_xy": f"WITH {POINTS}, {_geo('p')}, q AS (SELECT scene_id, pid, floor(y_max - y)::INTEGER AS iy, floor(x - x_min)::INTEGER AS ix, x_min, y_max FROM p JOIN geo USING (scene_id)) SELECT scene_id, pid, iy, ix, {r('x_min + ix')} AS x, {r('y_max - iy')} AS y FROM q",
        "nearest_vertex": f"WITH {POINTS}, e(x1, y1, x2, y2) AS (VALUES {edges}), v AS (SELECT (row_number() OVER () - 1)::INTEGER AS i, x1, y1 FROM e), d AS (SELECT pid, i, sqrt((x - x1) * (x - x1) + (y - y1) * (y - y1)) AS d FROM p, v) SELECT pid, arg_min(i, (d, i)) AS vertex FROM d GROUP BY 1 HAVING min(d) < 1.5",
        "peak_snap": f"""WITH {PEAKS}, d AS (SELECT k.scene_id, k.peak_id AS axis_id, n.pid, n.x, n.y, n.z,
  row_number() OVER (PARTITION BY k.scene_id, k.peak_id ORDER BY power(n.x - (x_min + ix), 2) + power(n.y - (y_max - iy), 2) + power(n.z - h, 2), n.pid) AS rank
FROM peaks k JOIN geo USING (scene_id) JOIN n ON n.scene_id = k.scene_id), t AS (SELECT scene_id, axis_id, arg_max((x, y, z), (z, -pid)) AS t FROM d WHERE rank <= 15 GROUP BY 1, 2)
SELECT scene_id, axis_id, {r('t[1]')} AS x, {r('t[2]')} AS y, {r('t[3]')} AS z FROM t""",
        "crown_axes": f"""WITH RECURSIVE {PEAKS}, d AS (SELECT k.scene_id, k.peak_id AS axis_id, n.pid, n.x, n.y, n.z,
  row_number() OVER (PARTITION BY k.scene_id, k.peak_id ORDER BY power(n.x - (x_min + ix), 2) + power(n.y - (y_max - iy), 2) + power(n.z - h, 2), n.pid) AS rank
FROM peaks k JOIN geo USING (scene_id) JOIN n ON n.scene_id = k.scene_id), t AS (SELECT scene_id, axis_id, arg_max((x, y, z), (z, -pid)) AS t FROM d WHERE rank <= 15 GROUP BY 1, 2),
a(scene_id, axis_id, step, x, y, z) AS (SELECT scene_id, axis_id, 0, t[1], t[2], t[3] FROM t UNION ALL
  SELECT a.scene_id, a.axis_id, a.step + 1, coalesce(avg(q.x) FILTER (q.z < a.z AND q.z > a.z - 2.0), a.x), coalesce(avg(q.y) FILTER (q.z < a.z AND q.z > a.z - 2.0), a.y), coalesce(avg(q.z) FILTER (q.z < a.z AND q.z > a.z - 2.0), a.z - 1.0)
  FROM a JOIN n q ON q.scene_id = a.scene_id AND (q.x - a.x) * (q.x - a.x) + (q.y - a.y) * (q.y - a.y) + (q.z - a.z) * (q.z - a.z) <= 6.25::DOUBLE WHERE a.z > 1.0 GROUP BY a.scene_id, a.axis_id, a.step, a.x, a.y, a.z)
SELECT scene_id, axis_id, step, {r('x', 5)} AS x, {r('y', 5)} AS y, {r('z', 5)} AS z FROM a""",
        "mean_of_top": f"WITH {LABELS}, h AS (SELECT scene_id, label, quantile_cont(z, 0.8) AS high FROM c GROUP BY 1, 2) SELECT scene_id, label, {r('coalesce(avg(x) FILTER (z > high), avg(x))')} AS x, {r('coalesce(avg(y) FILTER (z > high), avg(y))')} AS y FROM c JOIN h USING (scene_id, label) GROUP BY 1, 2",
        "points_in_regions": f"WITH {BASINS}, q AS (SELECT scene_id, floor(y_max - y)::INTEGER AS iy, floor(x - x_min)::INTEGER AS ix FROM v JOIN geo USING (scene_id)) SELECT scene_id, label, count(*) AS n FROM q JOIN b USING (scene_id, iy, ix) GROUP BY 1, 2",
        "canopy_around": f"WITH {PEAKS}, o AS (SELECT *, least(4, floor(h / 12))::INTEGER AS rad FROM peaks) SELECT o.scene_id, peak_id, {r('max(c.h)')} AS canopy FROM o JOIN c ON c.scene_id = o.scene_id AND abs(c.iy - o.iy) <= rad AND abs(c.ix - o.ix) <= rad GROUP BY 1, 2",
        "uncovered_canopy": f"""WITH {PEAKS}, o AS (SELECT *, least(4, floor(h / 12))::INTEGER AS rad FROM peaks)
SELECT scene_id, iy, ix, {r('CASE WHEN EXISTS (SELECT 1 FROM o WHERE o.scene_id = c.scene_id AND power(o.iy - c.iy, 2) + power(o.ix - c.ix, 2) <= rad * rad) THEN 0 ELSE h END')} AS h FROM c""",
        "stream_distinct_means": f"SELECT event_type AS parser, count(*) AS runs, {r('avg(value)')} AS score FROM events GROUP BY 1",
        "stalled_runs": """WITH t AS (SELECT DISTINCT user_id AS run, epoch_us(ts) AS us FROM events)
SELECT run, us AS last_micros FROM t QUALIFY coalesce(lead(us) OVER (PARTITION BY run ORDER BY us), (SELECT max(us) FROM t)) - us > 120000000""",
        "stream_running_mean": f"SELECT event_type AS parser, count(*) AS runs, {r('avg(value)')} AS score FROM events GROUP BY 1",
    }
