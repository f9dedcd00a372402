"""Spark rows against DuckDB rows on the same Parquet tables."""

from __future__ import annotations

from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(folder: str):
    c = duckdb.connect()
    for t in TABLES:
        p = Path(folder, f"{t}.parquet")
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p if p.is_file() else f'{p}/*.parquet'}')")
    return c


def table(rows, columns) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    fixed = lambda v: round(v, 6) if isinstance(v, float) else v
    return sorted((tuple(fixed(r[i]) for i in order) for r in rows), key=repr)


def assert_same(spark_df, connection, sql: str) -> None:
    r = connection.execute(sql)
    columns = [c[0] for c in r.description]
    assert sorted(spark_df.columns) == sorted(columns)
    assert table([tuple(x) for x in spark_df.collect()], spark_df.columns) == table(r.fetchall(), columns)
