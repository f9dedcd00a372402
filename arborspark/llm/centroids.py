"""Centroid clustering of integer vectors, with distances read from tables of squared differences.

A round tabulates, for every dimension, integer value that occurs and centroid, the
squared difference; a vector's distances are the sums of the table rows that its
values point at.  Tables are made for each Arrow batch from the values that occur in
it, so their size is bounded by the batch, however many values the column holds.

A task adds up its batches and gives one partial sum a centroid; Spark adds
these, so the driver sees k rows of sums a round and broadcasts nothing but the k
centroids.  A round is one deterministic job over the table: a lost executor costs the
lost tasks.

Defined cases: null vectors, vectors of another length and vectors with null or
non-finite components take no part and are not returned; rows without a vec_id take
part, but start a centroid only where fewer than k others exist; repeated rows count
each; rows that share a start hash are ordered by their vectors; of equally near
centroids the smaller number wins; an empty centroid stays where it is; fewer rows
than k give as many centroids; an empty table gives an empty result.  Distances
are exact where they fit in 63 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged
from .vectors import usable

SUMS = "cluster int, n long, sums array<long>"
ASSIGNED = "vec_id long, cluster int, distance long"


def square_tables(values: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """(dimension, value, centroid): squared differences of the values that occur and the centroids' components."""
    return (values[None, :, None] - centroids.T[:, None, :]) ** 2


def nearest(x: np.ndarray, centroids: np.ndarray, slab: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid (of equals the first) and the squared distance of every row of integers x."""
    cluster, distance = np.empty(len(x), np.int32), np.empty(len(x), np.int64)
    for at in range(0, len(x), slab):
        part = x[at : at + slab]
        values, codes = np.unique(part, return_inverse=True)
        codes, total = codes.reshape(part.shape), np.zeros((len(part), len(centroids)), np.int64)
        if len(values) <= 4 * slab:
            tables = square_tables(values, centroids)
            for d in range(part.shape[1]):
                total += tables[d][codes[:, d]]
        else:  # few values repeat, so each dimension tabulates only its own
            for d in range(part.shape[1]):
                own, code = np.unique(part[:, d], return_inverse=True)
                total += square_tables(own, centroids[:, d : d + 1])[0][code]
        cluster[at : at + slab] = total.argmin(axis=1)
        distance[at : at + slab] = total.min(axis=1)
    return cluster, distance


def _integers(column: pa.ListArray, scale: int, dim: int) -> np.ndarray:
    return np.floor(column.flatten().to_numpy() * scale).astype(np.int64).reshape(-1, dim)


def cluster(rows: DataFrame, *, k: int = 16, rounds: int = 3, dim: int = 64, scale: int = 64, seed: int = 1) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 over rows(vec_id, embedding)."""
    v = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(F.size("embedding") == dim, usable(F.col("embedding"))).alias("v")).filter("v IS NOT NULL")
    spark = v.sparkSession
    start = F.coalesce(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256), F.lit("~"))  # after every hex digit
    ints = F.transform("v", lambda x: F.floor(x * scale).cast("long"))
    first = v.select(start.alias("start"), ints.alias("x")).orderBy("start", "x").limit(k).collect()
    centroids = np.array([r.x for r in first], np.int64).reshape(len(first), dim)
    if not len(centroids):
        return spark.createDataFrame([], ASSIGNED + ", cluster_inertia long, inertia long, centroid_sha256 string")

    def summing(c: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            count, sums = np.zeros(len(c), np.int64), np.zeros(c.shape, np.int64)
            for batch in batches:
                x = _integers(batch.column(0), scale, dim)
                own, _ = nearest(x, c)
                count += np.bincount(own, minlength=len(c))
                np.add.at(sums, own, x)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(c), dtype=np.int32)), pa.array(count), pa.array(list(sums), pa.list_(pa.int64()))], names=["cluster", "n", "sums"])

        return run

    def naming(c: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own, distance = nearest(_integers(batch.column(1), scale, dim), c)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own), pa.array(distance)], names=["vec_id", "cluster", "distance"])

        return run

    total = lambda c: F.sum(c.cast("decimal(20,0)"))  # noqa: E731  (exact beyond 63 bits)
    for _ in range(rounds):
        parts = v.select("v").mapInArrow(summing(centroids), SUMS)
        sums = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[total(F.get("sums", F.lit(d))) for d in range(dim)]).alias("sums")).filter("n > 0")
        for r in sums.collect():  # at most k rows
            centroids[r.cluster] = [int(s) // r.n for s in r.sums]
    assigned = staged(v.select("vec_id", "v").mapInArrow(naming(centroids), ASSIGNED), "clusters")
    inertia = {r.cluster: int(r.d) for r in assigned.groupBy("cluster").agg(total(F.col("distance")).alias("d")).collect()}
    names = [(i, inertia.get(i, 0), sum(inertia.values()), hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for i, c in enumerate(centroids)]
    table = spark.createDataFrame(names, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows
