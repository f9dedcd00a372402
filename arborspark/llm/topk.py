"""Exact top-k inner products by multi-resolution segment statistics.

Every vector is cut into segments, a few long ones (coarse) and more short ones
(fine).  With segment means m and deviations s over width w,

    q.x  <=  sum over segments of w (m_q m_x + s_q s_x)

which is the segment lower bound of the distance, written for inner products.
Candidates are dropped coarse to fine when the bound stays below the k-th score
found so far; survivors get the exact integer score.

The k-th score of a query starts from its exact scores in one block of rows, so
every other block prunes from its first candidate on.

The stated queries meet all rows in blocks: rows are dealt into blocks of about
`block` vectors, each block of queries is sent to every block of rows of the
same dimension, and each pair of blocks gives at most k rows a query.  Neither
side is broadcast or collected, and memory is two blocks.

Defined cases: unusable vectors (null, or with null or non-finite components)
take no part; vectors of another dimension are not comparable with a query;
ties go to the smaller vec_id; rows with the query's own vec_id are its own;
repeated rows are candidates each, and repeated queries share k ranks; scores
are exact where the product of two vectors' lengths stays below 2^62, and are not
defined beyond; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged
from .vectors import valid_vectors

FOUND = "query_id long, vec_id long, score long"
#: Components a segment at each level, coarse to fine.
WIDTHS = (16, 4, 2)
_NONE = np.iinfo(np.int64).min


def segment_statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """sqrt(w) times the mean and deviation of each segment; the product of two rows bounds their inner product."""
    parts = np.array_split(np.arange(x.shape[1]), min(segments, x.shape[1]))
    out = []
    for p in parts:
        s = x[:, p]
        out += [s.mean(axis=1) * np.sqrt(len(p)), s.std(axis=1) * np.sqrt(len(p))]
    return np.stack(out, axis=1)


def bounds_of(q: np.ndarray, x: np.ndarray, widths: tuple[int, ...] = WIDTHS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each level, coarse to fine, the statistics of both sides; products of their rows bound the inner products."""
    for w in widths:
        n = -(-x.shape[1] // w)
        yield segment_statistics(q, n), segment_statistics(x, n)


def alive_shares(q: np.ndarray, x: np.ndarray, least: np.ndarray, widths: tuple[int, ...] = WIDTHS) -> list[float]:
    """The share of pairs that each level leaves alive against the scores `least` of the queries."""
    alive, out = np.ones((len(q), len(x)), bool), []
    for a, b in bounds_of(q, x, widths):
        alive &= a @ b.T >= least[:, None]
        out.append(float(alive.mean()))
    return out


def block_topk(
    query_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int, least: np.ndarray | None = None, widths: tuple[int, ...] = WIDTHS, chunk: int = 1024
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """query_id, vec_id, score of the k best of one block for each query, none under `least`; x and q hold integers as doubles."""
    levels = list(bounds_of(q, x, widths))
    lengths = np.linalg.norm(x, axis=1)
    reach = np.linalg.norm(q, axis=1) * max(1.0, float(lengths.max(initial=0)))
    scale = 1e-9 * (1 + reach)
    whole = bool((reach >= 2.0**52).any())  # doubles would round
    best = np.full((len(q), k), _NONE)
    who = np.full((len(q), k), np.iinfo(np.int64).max)
    floor = np.full(len(q), _NONE) if least is None else least
    order = np.argsort(-lengths, kind="stable")
    for at in range(0, len(x), chunk):
        rows = order[at : at + chunk]
        alive = np.ones((len(q), len(rows)), bool)
        needed = np.maximum(best[:, -1], floor).astype(np.float64)[:, None] - scale[:, None]
        for a, b in levels:
            columns = np.flatnonzero(alive.any(axis=0))
            if not len(columns):
                break
            alive[:, columns] &= a @ b[rows[columns]].T >= needed
        columns = np.flatnonzero(alive.any(axis=0))
        if not len(columns):
            continue
        alive, rows = alive[:, columns], rows[columns]
        score = np.full(alive.shape, _NONE)
        if whole:
            score[alive] = (q.astype(np.int64) @ x[rows].astype(np.int64).T)[alive]
        elif alive.mean() > 0.05:
            score[alive] = np.rint((q @ x[rows].T)[alive]).astype(np.int64)
        else:
            i, j = np.nonzero(alive)
            for c in range(0, len(i), 1 << 16):
                part = slice(c, c + (1 << 16))
                score[i[part], j[part]] = np.rint(np.einsum("ij,ij->i", q[i[part]], x[rows[j[part]]])).astype(np.int64)
        score[query_ids[:, None] == ids[rows][None, :]] = _NONE
        scores = np.concatenate([best, score], axis=1)
        names = np.concatenate([who, np.broadcast_to(ids[rows], score.shape)], axis=1)
        top = np.lexsort((names, -np.maximum(scores, -np.iinfo(np.int64).max)), axis=1)[:, :k]
        best, who = np.take_along_axis(scores, top, 1), np.take_along_axis(names, top, 1)
    found = (best > _NONE) & (best >= floor[:, None])
    return np.broadcast_to(query_ids[:, None], best.shape)[found], who[found], best[found]


def exact_topk(rows: DataFrame, *, k: int = 5, every: int = 50, scale: int = 256, block: int = 2048, query_block: int = 512) -> DataFrame:
    """query_id, rank, vec_id, score over rows(vec_id, embedding); queries are the rows whose vec_id is divisible by `every`."""
    v = valid_vectors(rows)
    ints = v.select("vec_id", "dim", F.transform("v", lambda x: F.floor(x * scale).cast("double")).alias("x"))
    n, components = ints.agg(F.count("*"), F.coalesce(F.sum("dim"), F.lit(0))).first()
    n = max(n, components // 64)  # long vectors make smaller blocks
    blocks, query_blocks = max(1, -(-n // block)), max(1, -(-n // (every * query_block)))

    def dealt(df: DataFrame, parts: int, seed: int) -> DataFrame:  # by row, so that rows of one vec_id part
        return df.withColumn("part", F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id(), F.lit(seed)), F.lit(parts)).cast("int"))

    members = lambda *columns: F.collect_list(F.struct("vec_id", "x", *columns)).alias("members")
    asking = ints.filter(F.col("vec_id") % every == 0).withColumn("least", F.lit(_NONE))
    right = dealt(ints, blocks, 2).groupBy("dim", "part").agg(members()).withColumnRenamed("members", "candidates")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def unpack(cell: pa.ListScalar) -> tuple[pa.StructArray, np.ndarray, np.ndarray]:
            s = cell.values
            ids = s.field(0).to_numpy()
            return s, ids, s.field(1).flatten().to_numpy().reshape(len(ids), -1)

        for batch in batches:
            for a, b in zip(batch.column(0), batch.column(1), strict=True):
                s, q_ids, q = unpack(a)
                _, ids, x = unpack(b)
                if x.shape[1] == 0:
                    continue
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in block_topk(q_ids, q, ids, x, k, s.field(2).to_numpy())], names=["query_id", "vec_id", "score"])

    def met(queries: DataFrame, parts: list[int]) -> DataFrame:
        left = dealt(queries, query_blocks, 1).groupBy("dim", F.col("part").alias("query_part")).agg(members("least"))
        left = left.withColumn("part", F.explode(F.sequence(F.lit(parts[0]), F.lit(parts[-1]))))
        return left.join(right.hint("shuffle_hash"), ["dim", "part"]).select("members", "candidates").mapInArrow(run, FOUND)

    found = staged(met(asking, [0]), "first-block")
    if blocks > 1:
        least = found.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("found")).filter(F.col("n") >= k)
        known = asking.drop("least").join(least.select(F.col("query_id").alias("vec_id"), "found"), "vec_id", "left")
        found = found.unionByName(met(known.withColumn("least", F.coalesce("found", F.lit(_NONE))).drop("found"), [1, blocks - 1]))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
