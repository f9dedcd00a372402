"""Matching detected trees to the reference and scoring the match.

Trees meet only within their scene.  The optimal assignment is a small NumPy
kernel on one scene's similarity matrix (hundreds of trees); everything around
it is joins and aggregates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PARTS = ("s_type", "s_height", "s_radius", "s_pos")
LEAST = 0.15


def _ratio(a: Column, b: Column) -> Column:
    top = F.greatest(a, b)
    return F.when(top == 0, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - F.try_divide(F.abs(a - b), top)))


def similarity(ref: DataFrame, pred: DataFrame) -> DataFrame:
    """scene_id, ref_id, pred_id, the four component similarities and their mean, for every pair of a scene."""
    p = pred.select("scene_id", *[F.col(c).alias(f"p_{c}") for c in ("tree_id", "x", "y", "height", "radius", "shape")])
    dx, dy = F.col("x") - F.col("p_x"), F.col("y") - F.col("p_y")
    out = ref.join(p, "scene_id").select(
        "scene_id",
        F.col("tree_id").alias("ref_id"),
        F.col("p_tree_id").alias("pred_id"),
        (F.col("shape") == F.col("p_shape")).cast("double").alias("s_type"),
        _ratio(F.col("height"), F.col("p_height")).alias("s_height"),
        _ratio(F.col("radius"), F.col("p_radius")).alias("s_radius"),
        (1 / (1 + F.sqrt(dx * dx + dy * dy))).alias("s_pos"),
    )
    return out.withColumn("avg_sim", (F.col("s_type") + F.col("s_height") + F.col("s_radius") + F.col("s_pos")) / 4)


def assign_rows(cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of a least-cost one-to-one assignment of the smaller side (successive shortest paths)."""
    if cost.shape[0] > cost.shape[1]:
        j, i = assign_rows(cost.T)
        return i, j
    n, m = cost.shape
    u, v, owner = np.zeros(n), np.zeros(m), np.full(m, -1)
    for row in range(n):
        least, previous, seen = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        at, column = row, -1
        while at >= 0:
            slack = np.where(seen, np.inf, cost[at] - u[at] - v)
            better = ~seen & (slack < least)
            least[better], previous[better] = slack[better], column
            column = int(np.where(seen, np.inf, least).argmin())
            step = least[column]
            u[row] += step
            u[owner[seen]] += step
            v[seen] -= step
            least[~seen] -= step
            seen[column] = True
            at = owner[column]
        while column >= 0:
            before = previous[column]
            owner[column] = row if before < 0 else owner[before]
            column = before
    columns = np.flatnonzero(owner >= 0)
    return owner[columns], columns


def assign(pairs: DataFrame) -> DataFrame:
    """The pairs of a best one-to-one assignment of every scene.  A task holds one batch and one scene."""

    def best(refs: np.ndarray, preds: np.ndarray, similar: np.ndarray) -> np.ndarray:
        refs, i = np.unique(refs, return_inverse=True)
        preds, j = np.unique(preds, return_inverse=True)
        cost, at = np.ones((len(refs), len(preds))), np.full((len(refs), len(preds)), -1)
        cost[i, j], at[i, j] = 1 - similar, np.arange(len(similar))
        chosen = at[assign_rows(cost)]
        return chosen[chosen >= 0]

    def solve(table: pa.Table, starts: np.ndarray) -> pa.Table:
        refs, preds, similar = (table.column(c).to_numpy() for c in ("ref_id", "pred_id", "avg_sim"))
        kept = [a + best(refs[a:b], preds[a:b], similar[a:b]) for a, b in zip(starts[:-1], starts[1:], strict=True)]
        return table.take(pa.array(np.concatenate(kept)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            scenes = table.column("scene_id").to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], scenes[1:] != scenes[:-1]])) if len(scenes) else np.zeros(0, int)
            if len(starts) > 1:
                yield from solve(table, starts).to_batches()
            held = table.slice(starts[-1]) if len(starts) else table
        if held is not None and held.num_rows:
            yield from solve(held, np.array([0, held.num_rows])).to_batches()

    return pairs.repartition("scene_id").sortWithinPartitions("scene_id", "ref_id", "pred_id").mapInArrow(run, pairs.schema)


def matches(ref: DataFrame, pred: DataFrame) -> DataFrame:
    """Assigned pairs that are similar enough."""
    return assign(similarity(ref, pred)).filter(F.col("avg_sim") >= LEAST)


def unmatched(trees: DataFrame, matched: DataFrame, side: str) -> DataFrame:
    """Trees of the side (ref or pred) that no accepted match uses."""
    used = matched.select("scene_id", F.col(f"{side}_id").alias("tree_id"))
    return trees.join(used, ["scene_id", "tree_id"], "left_anti")


def scores(ref: DataFrame, pred: DataFrame, matched: DataFrame) -> DataFrame:
    """One row a scene: counts, mean and least similarity, the total score, and a score of each component.

    A score is 100 (1 - sqrt((squared misses of the matches + unmatched trees) /
    larger side)), at least 0; 100 where both sides are empty.
    """
    n_ref = ref.groupBy("scene_id").agg(F.count("*").alias("n_ref"))
    n_pred = pred.groupBy("scene_id").agg(F.count("*").alias("n_pred"))
    misses = [F.sum(F.pow(1 - F.col(c), 2)).alias(f"_{c}") for c in (*PARTS, "avg_sim")]
    found = matched.groupBy("scene_id").agg(F.count("*").alias("tp"), F.avg("avg_sim").alias("avg_similarity"), F.min("avg_sim").alias("worst"), *misses)
    s = n_ref.join(n_pred, "scene_id", "full").join(found, "scene_id", "full").na.fill(0)

    def score(part: str) -> Column:
        most = F.greatest("n_ref", "n_pred")
        lost = F.col(f"_{part}") + F.col("n_ref") - F.col("tp") + F.col("n_pred") - F.col("tp")
        return F.when(most == 0, 100.0).otherwise(F.greatest(F.lit(0.0), 100 * (1 - F.sqrt(F.try_divide(lost, most)))))

    parts = {c: score(c) for c in PARTS}
    return s.select(
        "scene_id", "n_ref", "n_pred", "tp", (F.col("n_ref") - F.col("tp")).alias("fn"), (F.col("n_pred") - F.col("tp")).alias("fp"), "avg_similarity", "worst",
        score("avg_sim").alias("score"), *[v.alias(k.replace("s_", "score_")) for k, v in parts.items()], ((parts["s_type"] + parts["s_height"] + parts["s_radius"] + parts["s_pos"]) / 4).alias("score_total"),
    )
