"""Hard negatives of anchors by exact integer inner products, multiplied in tiles by Strassen's recursion.

Anchors are the rows whose vec_id is divisible by `every`.  Two passes meet the
anchors with the rows, both in blocks, so a task holds one block of each:

1. Positives: anchors meet the rows of their own label only; a label is cut into
   blocks by its size, so a label with most rows is many blocks.
2. Negatives: anchors with their positives meet all rows; each positive opens a
   window of scores, and the first rows of another label inside it stay.

A block is multiplied tile by tile in int64.  Additions and products wrap modulo
2^64, which is a ring, so Strassen's sums are exact whenever the inner product
itself fits in 63 bits.  A tile's rows are merged into heaps of fixed size, one an
anchor (positives) or one an anchor and positive (windows); heaps of different
blocks are merged by Spark, which keeps each side's first rows before the shuffle
and again after it.

Defined cases: rows with a null vec_id, label or vector, or with a null or
non-finite component, take no part; vectors of another length are not comparable
with an anchor; rows with the anchor's own vec_id are its own and no partners; of
several rows with one anchor's vec_id the least (label, vector) is the anchor;
other repeated rows count each; ties go to the smaller vec_id; an anchor without
positives, or a window without rows, gives nothing, and so does an empty table.
Scores are defined where the product of two vectors' lengths stays below 2^62.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.spatial import hot_join, hot_keys
from .common import staged
from .vectors import valid_vectors

POSITIVES = "anchor_id long, positive_id long, positive_score long"
NEGATIVES = "anchor_id long, place int, positive_id long, positive_score long, negative_id long, negative_score long"
_NONE = np.iinfo(np.int64).min


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = 16) -> np.ndarray:
    """a @ b of int64 matrices by seven half-size products a level; odd sides are padded with zeros."""
    (m, k), n = a.shape, b.shape[1]
    if min(m, k, n) <= leaf:
        return a @ b
    a, b = np.pad(a, ((0, m % 2), (0, k % 2))), np.pad(b, ((0, k % 2), (0, n % 2)))
    i, j, l = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2  # noqa: E741
    a11, a12, a21, a22 = a[:i, :j], a[:i, j:], a[i:, :j], a[i:, j:]
    b11, b12, b21, b22 = b[:j, :l], b[:j, l:], b[j:, :l], b[j:, l:]
    p1 = strassen(a11 + a22, b11 + b22, leaf)
    p2 = strassen(a21 + a22, b11, leaf)
    p3 = strassen(a11, b12 - b22, leaf)
    p4 = strassen(a22, b21 - b11, leaf)
    p5 = strassen(a11 + a12, b22, leaf)
    p6 = strassen(a21 - a11, b11 + b12, leaf)
    p7 = strassen(a12 - a22, b21 + b22, leaf)
    out = np.empty((2 * i, 2 * l), np.int64)
    out[:i, :l], out[:i, l:] = p1 + p4 - p5 + p7, p3 + p5
    out[i:, :l], out[i:, l:] = p2 + p4, p1 - p2 + p3 + p6
    return out[:m, :n]


def merged(best: np.ndarray, who: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The first k (highest score, then least id) of each row's heap and further scores; _NONE is an empty place."""
    scores, ids = np.concatenate([best, scores], axis=1), np.concatenate([who, ids], axis=1)
    order = np.lexsort((ids, ~scores), axis=1)[:, :k]  # ~s falls as s rises, without overflow
    return np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)


def _tiles(a: np.ndarray, x: np.ndarray, tile: int) -> Iterator[tuple[slice, np.ndarray]]:
    for at in range(0, len(x), tile):
        rows = slice(at, at + tile)
        yield rows, strassen(a, x[rows].T)


def block_positives(anchors: np.ndarray, a: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int, tile: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Scores and ids of each anchor's first k of one block, itself left out."""
    best, who = np.full((len(a), k), _NONE), np.zeros((len(a), k), np.int64)
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], x[order]
    for rows, scores in _tiles(a, x, tile):
        scores[anchors[:, None] == ids[rows][None, :]] = _NONE
        top = np.argsort(~scores, axis=1, kind="stable")[:, :k]  # stable: the smaller id first
        best, who = merged(best, who, np.take_along_axis(scores, top, 1), ids[rows][top], k)
    return best, who


def block_windows(
    anchors: np.ndarray, labels: np.ndarray, a: np.ndarray, low: np.ndarray, high: np.ndarray, ids: np.ndarray, others: np.ndarray, x: np.ndarray, k: int, tile: int = 512
) -> tuple[np.ndarray, np.ndarray]:
    """Scores and ids (anchor, window, place) of the first k rows of another label with low <= score <= high, of one block."""
    windows = low.shape[1]
    best, who = np.full((len(a), windows, k), _NONE), np.zeros((len(a), windows, k), np.int64)
    order = np.argsort(ids, kind="stable")
    ids, others, x = ids[order], others[order], x[order]
    for rows, scores in _tiles(a, x, tile):
        scores[(labels[:, None] == others[rows][None, :]) | (anchors[:, None] == ids[rows][None, :])] = _NONE
        order = np.argsort(~scores, axis=1, kind="stable")
        falling, names = np.take_along_axis(scores, order, 1), ids[rows][order]
        for w in range(windows):
            first = (falling > high[:, w, None]).sum(axis=1)  # the window is one run of the sorted scores
            at = first[:, None] + np.arange(k)[None, :]
            inside = at < falling.shape[1]
            at = np.minimum(at, falling.shape[1] - 1)
            found = np.take_along_axis(falling, at, 1)
            found = np.where(inside & (found >= low[:, w, None]), found, _NONE)
            best[:, w], who[:, w] = merged(best[:, w], who[:, w], found, np.take_along_axis(names, at, 1), k)
    return best, who


def share(score: np.ndarray, percent: int, up: bool) -> np.ndarray:
    """score * percent / 100 rounded down or up, without overflow."""
    whole, rest = np.divmod(score, 100)
    part = rest * percent
    return whole * percent + (-(-part // 100) if up else part // 100)


def _members(cell: pa.Scalar) -> tuple[pa.StructArray, np.ndarray, np.ndarray]:
    s = cell.values
    ids = s.field("vec_id").to_numpy()
    return s, ids, s.field("x").flatten().to_numpy().reshape(len(ids), -1)


def _gathered(*columns: str) -> Column:
    return F.collect_list(F.struct("vec_id", "x", *columns))


def mine(
    rows: DataFrame, *, positives: int = 5, negatives: int = 10, every: int = 100, scale: int = 256, low: int = 30, high: int = 90, block: int = 2048, anchor_block: int = 512
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score over rows(vec_id, embedding, label).

    A negative's score lies from `low` to `high` percent of the positive's; percentages of a negative score leave an empty window.
    """
    v = valid_vectors(rows.filter("label IS NOT NULL").select("vec_id", "embedding", "label"), "label")
    ints = v.select("vec_id", "label", "dim", F.transform("v", lambda x: F.floor(x * scale).cast("long")).alias("x")).filter("dim > 0")
    first = F.min(F.struct("label", "x")).alias("a")
    asking = ints.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(first).select("vec_id", F.col("a.label").alias("label"), F.size("a.x").alias("dim"), F.col("a.x").alias("x"))

    def dealt(df: DataFrame, parts: Column, name: str, seed: int) -> DataFrame:  # by row, so that rows of one vec_id part
        return df.withColumn(name, F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id(), F.lit(seed)), parts).cast("int"))

    # A block holds about `block` vectors of 64 components, or as many numbers of longer ones.
    weight = lambda size: F.ceil(F.greatest(F.count("*"), F.sum("dim") / 64) / size)
    sizes = staged(ints.groupBy("dim", "label").agg(weight(block).alias("parts"), weight(every * anchor_block).alias("anchor_parts")), "label-sizes")
    keys, hot = ["dim", "label"], hot_keys(ints, ["dim", "label"])
    right = dealt(hot_join(ints, sizes, keys, hot), F.col("parts"), "part", 2).groupBy(*keys, "part").agg(_gathered().alias("candidates"))
    left = dealt(hot_join(asking, sizes, keys, hot), F.col("anchor_parts"), "anchor_part", 1).groupBy(*keys, "parts", "anchor_part").agg(_gathered().alias("anchors"))
    left = left.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts").cast("int") - 1)))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some, others in zip(batch.column(0), batch.column(1), strict=True):
                (_, names, a), (_, ids, x) = _members(some), _members(others)
                best, who = block_positives(names, a, ids, x, positives)
                at = np.nonzero(best > _NONE)
                yield pa.RecordBatch.from_arrays([pa.array(names[at[0]]), pa.array(who[at]), pa.array(best[at])], names=["anchor_id", "positive_id", "positive_score"])

    met = left.join(right.hint("shuffle_hash"), [*keys, "part"]).select("anchors", "candidates").mapInArrow(nearest, POSITIVES)
    place = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id"))
    ranked = staged(met.withColumn("place", place).filter(F.col("place") <= positives), "positives")
    lists = ranked.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.sort_array(F.collect_list(F.struct("place", "positive_id", "positive_score"))).alias("positives"))

    dims = ints.groupBy("dim").agg(weight(block).alias("parts"), weight(every * anchor_block).alias("anchor_parts"))
    dims = staged(dims, "dim-sizes")
    hot_dims = hot_keys(ints, ["dim"])
    right = dealt(hot_join(ints, dims, ["dim"], hot_dims), F.col("parts"), "part", 4).groupBy("dim", "part").agg(_gathered("label").alias("candidates"))
    left = hot_join(asking.join(lists, "vec_id"), dims, ["dim"], hot_dims)
    left = dealt(left, F.col("anchor_parts"), "anchor_part", 3).groupBy("dim", "parts", "anchor_part").agg(_gathered("label", "positives").alias("anchors"))
    left = left.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts").cast("int") - 1)))

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some, others in zip(batch.column(0), batch.column(1), strict=True):
                (s, names, a), (t, ids, x) = _members(some), _members(others)
                codes = pa.concat_arrays([s.field("label"), t.field("label")]).dictionary_encode().indices.to_numpy()
                lists = s.field("positives")
                own, each = lists.value_parent_indices().to_numpy(), lists.flatten()
                at = each.field("place").to_numpy() - 1
                who, score = np.zeros((len(a), positives), np.int64), np.full((len(a), positives), -1)  # no positive: an empty window
                who[own, at], score[own, at] = each.field("positive_id").to_numpy(), each.field("positive_score").to_numpy()
                floor, ceiling = share(score, low, True), share(score, high, False)
                floor[score < 0], ceiling[score < 0] = 1, 0
                found, names_of = block_windows(names, codes[: len(a)], a, floor, ceiling, ids, codes[len(a) :], x, negatives)
                i, w, p = np.nonzero(found > _NONE)
                columns = [names[i], (w + 1).astype(np.int32), who[i, w], score[i, w], names_of[i, w, p], found[i, w, p]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["anchor_id", "place", "positive_id", "positive_score", "negative_id", "negative_score"])

    met = left.join(right.hint("shuffle_hash"), ["dim", "part"]).select("anchors", "candidates").mapInArrow(inside, NEGATIVES)
    rank = F.row_number().over(Window.partitionBy("anchor_id", "place").orderBy(F.desc("negative_score"), "negative_id"))
    return met.withColumn("rank", rank).filter(F.col("rank") <= negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
