"""Embedding near-duplicates by product quantisation.

1. Equal vectors collapse to one representative with a count.
2. Codebooks, fitted on at most `sample` representatives (a documented bound):
   coarse centroids, and 256 codes for each subspace of the residuals.  Every
   representative is indexed: its list, its codes, and the length of what the
   codes leave out.
3. Every representative probes its `probes` nearest lists.  In a list, table
   look-ups give its distance to each coded member; a pair survives unless the
   coded distance minus the member's coding error passes the radius of the
   threshold, which loses no pair of the list.
4. Survivors get their exact cosine in double precision.

Lists are cut into cells of at most about `members` x `queries` vectors, so a
list with a third of all vectors is many tasks.  A cell returns one row a linked
vector (its links, and the least vector of its component in the cell), never
pairs.  Recall is limited by the probes alone; see the tests for the measure.
probes=None is exact: a list is probed unless its radius, or the plane between
its centroid and the vector's own, puts all its members beyond the threshold.

Defined cases: vectors that are null, zero, or hold null or non-finite
components link with nothing; vectors of different dimensions do not link; a
repeated row is another vector; a row without vec_id is no vector for others to
link with, and has the links of its equals that have one (its component_id is
theirs); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.spatial import components, hot_join
from .common import staged
from .vectors import usable

CODED = "rep long, copies long, dim int, list int, codes binary, error double, probes array<int>, v array<double>"
LINKED = "rep long, links long, root long"


def kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """At most k centroids of the rows of x (Lloyd)."""
    c = x[np.sort(rng.choice(len(x), min(k, len(x)), replace=False))].astype(np.float32)
    x = x.astype(np.float32)
    for _ in range(rounds):
        near = nearest(x, c)
        counts = np.bincount(near, minlength=len(c))
        order = np.argsort(near, kind="stable")
        full = np.flatnonzero(counts)
        sums = np.add.reduceat(x[order], np.concatenate([[0], np.cumsum(counts[full])[:-1]]), axis=0)
        c[full] = sums / counts[full, None]
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), np.int64)
    norms = (c * c).sum(axis=1)
    for at in range(0, len(x), 4096):
        out[at : at + 4096] = (norms - 2 * (x[at : at + 4096] @ c.T)).argmin(axis=1)
    return out


@dataclass(frozen=True)
class Codebook:
    """Coarse centroids, and for each subspace of the residuals its codes."""

    coarse: np.ndarray
    parts: tuple[np.ndarray, ...]
    codes: tuple[np.ndarray, ...]

    @classmethod
    def fit(cls, sample: np.ndarray, lists: int, subspaces: int = 8, seed: int = 11) -> Codebook:
        rng = np.random.default_rng(seed)
        coarse = kmeans(sample, lists, 8, rng)
        residual = sample - coarse[nearest(sample.astype(np.float32), coarse)]
        parts = tuple(np.array_split(np.arange(sample.shape[1]), min(subspaces, sample.shape[1])))
        return cls(coarse, parts, tuple(kmeans(residual[:, p], 256, 6, rng) for p in parts))

    def home(self, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """List of unit rows, and their distance to its centroid."""
        lists = nearest(u.astype(np.float32), self.coarse)
        return lists, np.linalg.norm(u - self.coarse[lists], axis=1)

    def open_lists(self, u: np.ndarray, radii: np.ndarray, reach: float) -> list[np.ndarray]:
        """For each unit row all lists that may hold a row within reach: neither the list's radius nor the plane between two centroids excludes it."""
        lists, own = self.home(u)
        c = self.coarse.astype(np.float64)
        squares = np.maximum(0, (u * u).sum(axis=1)[:, None] - 2 * (u @ c.T) + (c * c).sum(axis=1))
        apart = np.linalg.norm(c[lists][:, None] - c[None], axis=2)
        may = (np.sqrt(squares) <= reach + radii + 1e-6) & (squares - (own * own)[:, None] <= 2 * reach * apart + 1e-6)
        may[np.arange(len(u)), lists] = False
        return [np.concatenate([[h], np.flatnonzero(m)]) for h, m in zip(lists, may, strict=True)]

    def encode(self, u: np.ndarray, probes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """List, codes, coding error and probed lists (the own one first) of unit rows."""
        d = (self.coarse * self.coarse).sum(axis=1) - 2 * (u.astype(np.float32) @ self.coarse.T)
        p = min(probes, d.shape[1])
        near = np.argpartition(d, p - 1, axis=1)[:, :p]
        near = np.take_along_axis(near, np.argsort(np.take_along_axis(d, near, 1), axis=1, kind="stable"), 1)
        near[:, 0], swapped = nearest(u.astype(np.float32), self.coarse), near[:, 0].copy()
        near[:, 1:][near[:, 1:] == near[:, :1]] = np.broadcast_to(swapped[:, None], near[:, 1:].shape)[near[:, 1:] == near[:, :1]]
        residual = u - self.coarse[near[:, 0]]
        codes = np.stack([nearest(residual[:, s].astype(np.float32), c) for s, c in zip(self.parts, self.codes, strict=True)], axis=1)
        left = residual - np.concatenate([c[codes[:, i]] for i, c in enumerate(self.codes)], axis=1)
        return near[:, 0], codes.astype(np.uint8), np.sqrt((left * left).sum(axis=1)), near

    def coded_distances(self, u: np.ndarray, list_: int, codes: np.ndarray) -> np.ndarray:
        """Distances of unit rows to the coded members of a list, by look-up tables."""
        residual = u - self.coarse[list_]
        out = np.zeros((len(u), len(codes)))
        for i, (s, c) in enumerate(zip(self.parts, self.codes, strict=True)):
            q, c = residual[:, s], c.astype(np.float64)
            table = (q * q).sum(axis=1)[:, None] - 2 * (q @ c.T) + (c * c).sum(axis=1)
            out += table[:, codes[:, i]]
        return np.sqrt(np.maximum(out, 0))


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.linalg.norm(v, axis=1)[:, None]


def _matrix(column: pa.ListArray, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)


def cell_links(book: Codebook, list_: int, q: dict, m: dict, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """rep, links, root of every linked vector of a cell: queries q against members m of a list.

    A pair counts for its query, and for its member only where the member does
    not meet the query in the query's own list.
    """
    radius = np.sqrt(2 - 2 * threshold)
    u, w = _unit(q["v"]), _unit(m["v"])
    near = book.coded_distances(u, list_, m["codes"]) <= radius + m["error"] + 1e-6
    i, j = np.nonzero(near & (q["rep"][:, None] != m["rep"]))
    keep = [np.einsum("ij,ij->i", u[i[c : c + 65536]], w[j[c : c + 65536]]) >= threshold for c in range(0, len(i), 65536)]
    keep = np.concatenate(keep) if keep else np.zeros(0, bool)
    i, j = i[keep], j[keep]
    back = ~m["met"](j, q["list"][i])
    reps = np.concatenate([q["rep"], m["rep"]])
    nodes, at = np.unique(reps, return_inverse=True)
    a, b = at[: len(q["rep"])][i], at[len(q["rep"]) :][j]
    links = np.bincount(a, m["copies"][j], len(nodes)) + np.bincount(b[back], q["copies"][i][back], len(nodes))
    root = np.arange(len(nodes))
    while True:
        new = root.copy()
        np.minimum.at(new, a, root[b])
        np.minimum.at(new, b, root[a])
        new = np.minimum(new, new[new])
        if (new == root).all():
            break
        root = new
    linked = np.union1d(a, b)
    return nodes[linked], links[linked].astype(np.int64), nodes[root[linked]]


def _met(probes: list[list[int]]):
    """(rows, lists) -> whether each row probes the list beside it."""
    sizes = np.array([len(p) for p in probes])
    pairs = np.repeat(np.arange(len(probes)), sizes) << 32 | np.concatenate([np.array(p, np.int64) for p in probes])
    pairs.sort()

    def met(rows: np.ndarray, lists: np.ndarray) -> np.ndarray:
        wanted = rows.astype(np.int64) << 32 | lists
        return pairs[np.minimum(np.searchsorted(pairs, wanted), len(pairs) - 1)] == wanted

    return met


def _home_distances(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                lists, d = shared.value[int(dim)].home(_unit(_matrix(part.column("v"), part.num_rows)))
                yield pa.RecordBatch.from_arrays([part.column("dim"), pa.array(lists, pa.int32()), pa.array(d)], names=["dim", "list", "d"])

    return run


def near_duplicates(rows: DataFrame, *, threshold: float = 0.9, sample: int = 16_384, probes: int | None = 12, most_lists: int = 2048, members: int = 256, queries: int = 512) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of rows(vec_id, embedding)."""
    spark = rows.sparkSession
    v = usable(F.col("embedding"))
    fine = rows.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    fine = fine.withColumn("v", F.when(F.exists("v", lambda x: x != 0), F.col("v")))
    keyed = fine.select("vec_id", "v", F.xxhash64("v").alias("k1"), F.xxhash64(F.lit(1), "v").alias("k2"))
    names = staged(keyed.select("vec_id", F.when(F.col("v").isNotNull(), F.col("k1")).alias("k1"), F.when(F.col("v").isNotNull(), F.col("k2")).alias("k2")), "vector-keys")
    reps = keyed.filter("v IS NOT NULL AND vec_id IS NOT NULL").groupBy("k1", "k2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("v").alias("v"))
    reps = staged(reps.withColumn("dim", F.size("v")), "vectors")

    books: dict[int, Codebook] = {}
    for dim, n in reps.groupBy("dim").count().orderBy("dim").collect():
        share = min(1.0, sample / n)
        some = reps.filter((F.col("dim") == dim) & (F.pmod(F.xxhash64("rep"), F.lit(1 << 20)) < max(1, int(share * (1 << 20))))).select("rep", "v").limit(2 * sample).toPandas().sort_values("rep")
        x = _unit(np.array(some["v"].tolist(), np.float64)) if len(some) else np.eye(1, dim)
        books[dim] = Codebook.fit(x, min(most_lists, max(1, int(4 * np.sqrt(n)))))
    shared = spark.sparkContext.broadcast(books)  # bounded by most_lists
    reach = float(np.sqrt(2 - 2 * threshold))
    radii: dict[int, np.ndarray] = {}
    if probes is None:
        for r in reps.select("dim", "v").mapInArrow(_home_distances(shared), "dim int, list int, d double").groupBy("dim", "list").agg(F.max("d").alias("d")).collect():  # at most most_lists rows a dimension
            radii.setdefault(r.dim, np.full(len(books[r.dim].coarse), -1.0))[r.list] = r.d

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                vectors = _matrix(part.column("v"), part.num_rows)
                book, u = shared.value[int(dim)], _unit(vectors)
                lists, codes, error, near = book.encode(u, probes or 1)
                near = near.astype(np.int32).tolist() if probes else [x.tolist() for at in range(0, len(u), 256) for x in book.open_lists(u[at : at + 256], radii[int(dim)], reach)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("rep"), part.column("copies"), part.column("dim"), pa.array(lists, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error), pa.array(near, pa.list_(pa.int32())), part.column("v")],
                    names=[c.split()[0] for c in CODED.split(", ")],
                )

    coded = staged(reps.select("rep", "copies", "dim", "v").mapInArrow(index, CODED), "vector-index")
    sizes = coded.groupBy("dim", "list").agg(F.ceil(F.count("*") / members).cast("int").alias("blocks"))
    probed = coded.select("dim", F.explode("probes").alias("list")).groupBy("dim", "list").agg(F.ceil(F.count("*") / queries).cast("int").alias("turns"))
    cells = F.broadcast(staged(sizes.join(probed, ["dim", "list"]), "vector-lists"))  # at most most_lists rows a dimension

    part = lambda n: F.pmod(F.xxhash64("rep"), n.cast("long")).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    columns = ["rep", "copies", "v", "error", "codes", "probes"]
    side = coded.join(cells, ["dim", "list"]).select("dim", "list", part(F.col("blocks")).alias("block"), every(F.col("turns")).alias("turn"), F.lit(False).alias("asks"), F.col("list").alias("home"), *columns)
    asks = (
        coded.withColumnRenamed("list", "home")
        .withColumn("list", F.explode("probes"))
        .join(cells, ["dim", "list"])
        .select("dim", "list", every(F.col("blocks")).alias("block"), part(F.col("turns")).alias("turn"), F.lit(True).alias("asks"), "home", "rep", "copies", "v", F.lit(0.0).alias("error"), F.lit(None).cast("binary").alias("codes"), F.lit(None).cast("array<int>").alias("probes"))
    )

    def meet(key: tuple, table: pa.Table) -> pa.Table:
        dim, list_ = key[0].as_py(), key[1].as_py()
        out = [np.zeros(0, np.int64)] * 3
        asking = np.array(table.column("asks").to_pylist(), bool)
        if asking.any() and not asking.all():
            def take(mask):
                t = table.filter(pa.array(mask)).combine_chunks()
                n = t.num_rows
                got = {"rep": t.column("rep").to_numpy(), "copies": t.column("copies").to_numpy(), "list": t.column("home").to_numpy(), "v": np.concatenate([_matrix(c, len(c)) for c in t.column("v").chunks])}
                return t, n, got

            _, _, q = take(asking)
            t, n, m = take(~asking)
            m["codes"] = np.frombuffer(b"".join(t.column("codes").to_pylist()), np.uint8).reshape(n, -1)
            m["error"] = t.column("error").to_numpy()
            m["met"] = _met(t.column("probes").to_pylist())
            out = cell_links(shared.value[dim], list_, q, m, threshold)
        return pa.table({"rep": pa.array(out[0], pa.int64()), "links": pa.array(out[1], pa.int64()), "root": pa.array(out[2], pa.int64())})

    linked = staged(side.unionByName(asks).groupBy("dim", "list", "block", "turn").applyInArrow(meet, LINKED), "vector-links")
    counts = linked.groupBy("rep").agg(F.sum("links").alias("links"))
    roots = components(linked.select(F.col("rep").alias("a"), F.col("root").alias("b")), keys=()).withColumnRenamed("node", "rep")
    found = reps.select("k1", "k2", "rep", "copies").join(counts, "rep", "left").join(roots, "rep", "left")
    found = staged(found.select("k1", "k2", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")), "vector-classes")
    hot = found.join(F.broadcast(found.agg((F.sum("copies") / 1000).alias("least"))), F.col("copies") > F.col("least")).select("k1", "k2")  # under 1000
    linked = hot_join(names.filter("k1 IS NOT NULL"), found.drop("copies"), ["k1", "k2"], hot)
    none = names.filter("k1 IS NULL").select("vec_id", F.lit(None).cast("long").alias("n_links"), F.lit(None).cast("long").alias("component_id"))
    out = linked.select("vec_id", "n_links", "component_id").unionByName(none).select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("component_id") == F.col("vec_id"), F.lit(True)))
