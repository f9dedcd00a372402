"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

#: Every seat is ranked here, where the operator ranks only the open ones.
OP5 = r"""
WITH d0 AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         'mix-1|' || coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, '')) AS name
  FROM documents),
d AS (
  SELECT doc_id, source, size, name, md5(name || '|' || CASE WHEN count(*) OVER w > 250 THEN row_number() OVER w2 ELSE 0 END) AS h
  FROM d0 WINDOW w AS (PARTITION BY source, name), w2 AS (PARTITION BY source, name ORDER BY size)),
k AS (SELECT greatest(1, (count(*) + 249) // 250) AS shards FROM d),
r AS (
  SELECT doc_id, name, source IS NULL AS src_null, coalesce(source, '') AS src, size,
         ('0x' || substr(h, 1, 8))::BIGINT % shards AS shard, ('0x' || substr(h, 9, 15))::BIGINT AS pos
  FROM d, k),
s AS (SELECT src_null, src, sum(size)::BIGINT AS source_size FROM r GROUP BY ALL),
w AS (SELECT *, ((row_number() OVER (ORDER BY src_null, src) - 1) % 3 + 1)::DOUBLE AS weight FROM s),
lv AS (
  SELECT *, (sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER p, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER p, 0)) AS lev
  FROM w WINDOW p AS (ORDER BY 3 * source_size / weight, src_null, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT src_null, src, source_size, least(3 * source_size::DOUBLE, max(lev) OVER () * weight) AS target FROM lv),
seat AS (
  SELECT src_null, src, row_number() OVER (ORDER BY target / (2 * i + 1) DESC, src_null, src) AS place
  FROM t, LATERAL (SELECT unnest(range(0, ceil(target)::BIGINT + 3)) AS i) WHERE target > 0),
sq AS (
  SELECT t.*, coalesce(q.seats, 0) AS seats
  FROM t LEFT JOIN (SELECT src_null, src, count(*) AS seats FROM seat WHERE place <= (SELECT sum(source_size) FROM t) GROUP BY ALL) q USING (src_null, src)),
sh AS (SELECT src_null, src, shard, sum(size)::BIGINT AS shard_size FROM r GROUP BY ALL),
seat2 AS (
  SELECT src_null, src, shard, seats, row_number() OVER (PARTITION BY src_null, src ORDER BY shard_size::DOUBLE / (2 * i + 1) DESC, shard) AS place
  FROM sh JOIN sq USING (src_null, src), LATERAL (SELECT unnest(range(0, (3 * shard_size + 3)::BIGINT)) AS i) WHERE shard_size > 0),
quota AS (SELECT src_null, src, shard, count(*) AS quota FROM seat2 WHERE place <= seats GROUP BY ALL),
run AS (
  SELECT sh.*, least(3, coalesce(quota, 0) // shard_size) AS passes, coalesce(quota, 0) AS quota,
         ('0x' || substr(md5('mix-1|run|' || src || '|' || shard), 1, 15))::BIGINT % shard_size AS a
  FROM sh LEFT JOIN quota USING (src_null, src, shard) WHERE shard_size > 0),
run2 AS (SELECT *, CASE WHEN passes = 3 THEN 0 ELSE quota - passes * shard_size END AS rest FROM run),
placed AS (SELECT *, sum(size) OVER (PARTITION BY src_null, src, shard ORDER BY pos, doc_id, name) AS e FROM r)
SELECT p.doc_id, p.size, sq.source_size, sq.target,
       (coalesce(passes, 0) * size + coalesce(greatest(0, least(e, a + rest) - greatest(e - size, a))
        + greatest(0, least(e, greatest(0, a + rest - shard_size)) - (e - size)), 0))::BIGINT AS taken
FROM placed p JOIN sq USING (src_null, src) LEFT JOIN run2 USING (src_null, src, shard)
"""

OP6 = r"""
WITH p AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 2, 's'), '') AS path
  FROM pages),
rules(rule, verdict, rhost, rpath) AS (VALUES
  ('org/', 'allow', 'org', '/'), ('example.org/es/', 'block', 'example.org', '/es/'), ('example.org/en/1', 'block', 'example.org', '/en/1'),
  ('com/fr/', 'allow', 'com', '/fr/'), ('com/de/', 'block', 'com', '/de/')),
hostpath AS (SELECT DISTINCT host, path FROM p),
fit AS (
  SELECT host, path, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
  FROM hostpath JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY ALL),
j AS (SELECT p.*, rule, verdict FROM p LEFT JOIN fit USING (host, path)),
h0 AS (SELECT host, count(verdict)::DOUBLE AS n, count(*) FILTER (verdict = 'block')::DOUBLE AS bad, regexp_replace(host, ':\d*$', '') AS name FROM j GROUP BY host),
h1 AS (
  SELECT *, CASE WHEN regexp_matches(name, '^\d+(\.\d+){3}$') THEN name
    WHEN array_to_string(string_split(name, '.')[-2:], '.') IN ('ac.uk', 'co.jp', 'co.nz', 'co.uk', 'co.za', 'com.au', 'com.br', 'com.cn', 'gov.uk', 'ne.jp', 'net.au', 'or.jp', 'org.au', 'org.uk')
    THEN array_to_string(string_split(name, '.')[-2:], '.') ELSE string_split(name, '.')[-1] END AS suffix FROM h0),
h AS (SELECT *, CASE WHEN name = suffix THEN name ELSE array_to_string(string_split(name, '.')[-(len(string_split(suffix, '.')) + 1):], '.') END AS domain FROM h1),
m0 AS (SELECT coalesce(sum(bad) / nullif(sum(n), 0), 0) AS m FROM h),
s AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, m FROM h, m0 WHERE n > 0 GROUP BY ALL),
ks AS (SELECT ((sum(n * power(bad / n - m, 2)) / nullif(sum(n * m * (1 - m)), 0)) - count(*) / sum(n)) / nullif(1 - count(*) / sum(n), 0) AS rho FROM s),
ks2 AS (SELECT least(1000, greatest(1, coalesce(CASE WHEN rho > 0 THEN (1 - rho) / rho END, 1000))) AS k FROM ks),
sm AS (SELECT suffix, (bad + k * m) / (n + k) AS m_suffix FROM s, ks2),
d AS (SELECT domain, suffix, sum(h.n) AS n, sum(h.bad) AS bad, m_suffix FROM h JOIN sm USING (suffix) WHERE h.n > 0 GROUP BY ALL),
kd AS (SELECT ((sum(n * power(bad / n - m_suffix, 2)) / nullif(sum(n * m_suffix * (1 - m_suffix)), 0)) - count(*) / sum(n)) / nullif(1 - count(*) / sum(n), 0) AS rho FROM d),
kd2 AS (SELECT least(1000, greatest(1, coalesce(CASE WHEN rho > 0 THEN (1 - rho) / rho END, 1000))) AS k FROM kd),
dm AS (SELECT domain, (bad + k * m_suffix) / (n + k) AS m_domain FROM d, kd2),
hd AS (SELECT h.n, h.bad, m_domain AS m FROM h JOIN dm USING (domain) WHERE n > 0),
kh AS (SELECT ((sum(n * power(bad / n - m, 2)) / nullif(sum(n * m * (1 - m)), 0)) - count(*) / sum(n)) / nullif(1 - count(*) / sum(n), 0) AS rho FROM hd),
kh2 AS (SELECT least(1000, greatest(1, coalesce(CASE WHEN rho > 0 THEN (1 - rho) / rho END, 1000))) AS k FROM kh),
post AS (
  SELECT host, bad + k * coalesce(m_domain, m_suffix, m) AS a, n - bad + k * (1 - coalesce(m_domain, m_suffix, m)) AS b
  FROM h LEFT JOIN dm USING (domain) LEFT JOIN sm USING (suffix), kh2, m0),
v AS (SELECT host, a / (a + b) - 1.645 * sqrt(a / (a + b) * (1 - a / (a + b)) / (a + b + 1)) > 0.5 AS blocked FROM post)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN blocked THEN 'block' ELSE 'allow' END) AS verdict
FROM j JOIN v USING (host)
"""


OP8 = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
e AS (SELECT vec_id, len(x) AS dim, generate_subscripts(x, 1) AS i, unnest(x) AS x FROM v),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id, sum(q.x * c.x)::BIGINT AS score
  FROM e q JOIN e c ON q.i = c.i AND q.dim = c.dim AND q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0 GROUP BY ALL)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p) WHERE rank <= 5
"""


OP11 = r"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.x, b.x)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE a.vec_id % 100 = 0),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score
  FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, row_number() OVER w::INTEGER AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) QUALIFY row_number() OVER w <= 10
"""


def _clusters() -> str:
    """Three rounds, unrolled; e has one row a vector and dimension, c one a centroid and dimension."""
    steps = []
    for i in range(4):
        steps.append(
            f"""d{i} AS MATERIALIZED (SELECT e.vec_id, c.cluster, sum((e.x - c.x) * (e.x - c.x))::BIGINT AS distance FROM e JOIN c{i} c USING (i) GROUP BY ALL),
a{i} AS MATERIALIZED (SELECT vec_id, cluster, distance FROM d{i} QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY distance, cluster) = 1)"""
        )
        if i < 3:
            steps.append(f"""m{i} AS (SELECT cluster, i, sum(x)::BIGINT AS s, count(*) AS n FROM a{i} JOIN e USING (vec_id) GROUP BY ALL),
c{i + 1} AS MATERIALIZED (SELECT c.cluster, i, coalesce((s - ((s % n) + n) % n) // n, c.x) AS x FROM c{i} c LEFT JOIN m{i} USING (cluster, i))""")
    return f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS x
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
e AS MATERIALIZED (SELECT vec_id, generate_subscripts(x, 1) AS i, unnest(x) AS x FROM v),
c0 AS MATERIALIZED (
  SELECT cluster, generate_subscripts(x, 1) AS i, unnest(x) AS x
  FROM (SELECT x, (row_number() OVER (ORDER BY sha256('1:' || vec_id::VARCHAR)) - 1)::INTEGER AS cluster FROM v QUALIFY cluster < 16)),
{", ".join(steps)},
h AS (SELECT cluster, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM c3 GROUP BY 1)
SELECT vec_id, cluster, distance, sum(distance) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia, sum(distance) OVER ()::BIGINT AS inertia, centroid_sha256
FROM a3 JOIN h USING (cluster)
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_mixing": OP5, "op6_url_filters": OP6, "op8_topk_search": OP8, "op11_hard_negatives": OP11, "op12_centroid_clusters": _clusters()}
