"""The benchmark: sweep -> scenes -> detectors -> scores -> report tables."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import scoring as S
from ..scratch import written
from ..sources import scenes
from . import reports
from .detectors import DETECTORS
from .views import FACTORS


def parameters(tasks: DataFrame, size_x: float, size_y: float, seed: int = 42) -> DataFrame:
    """One row of scene parameters for each task of a sweep."""
    number = F.row_number().over(Window.orderBy(*FACTORS)) - 1
    return tasks.select(number.cast("int").alias("scene_id"), F.lit(seed).alias("seed"), F.lit(size_x).alias("size_x"), F.lit(size_y).alias("size_y"), *FACTORS)


def run(params: DataFrame, detectors: Iterable[str] = tuple(DETECTORS), **scene) -> DataFrame:
    """One row for each scene and detector: its factors, key, complexity, counts and scores.  All scenes share each detector's jobs."""
    params = written(params, "parameters")
    plan = written(scenes.plan_forest(params), "plan")
    points = written(scenes.generate(params, plan, **scene), "points")
    rows = []
    for name in detectors:
        trees = written(DETECTORS[name](points), "trees")
        rows.append(S.scores(plan, trees, S.matches(plan, trees)).withColumn("parser", F.lit(name)))
    out = reduce(DataFrame.unionByName, rows).join(params.select("scene_id", *FACTORS), "scene_id")
    return out.withColumn("scene_key", reports.scene_key()).withColumn("complexity", reports.complexity())


def tables(results: DataFrame) -> dict[str, DataFrame]:
    """The report tables of a run."""
    parts = ("score_type", "score_height", "score_radius", "score_pos")
    total = results.withColumn("score", F.col("score_total"))
    return {"quality": reports.quality(total.select("parser", "score", *FACTORS)), "components": reports.components(total.select("parser", *FACTORS, *parts), parts)}
