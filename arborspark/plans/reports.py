"""Benchmark sweeps and their report tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .views import FACTORS


def _levels(step: float) -> Column:
    n = int((1 + 1e-9) / step)
    return F.transform(F.sequence(F.lit(0), F.lit(n)), lambda i: F.round(i * step, 2))


def sweep(spark: SparkSession, step: float) -> DataFrame:
    """One factor at a time: the base row and every factor alone at every level, each once, in order."""
    one = spark.range(1)
    parts = [one.select(*[(F.explode(_levels(step)) if g == f else F.lit(0.0)).alias(g) for g in FACTORS]) for f in FACTORS]
    return reduce(DataFrame.unionByName, parts).distinct().orderBy(*FACTORS)


def factorial_sweep(spark: SparkSession, step: float) -> DataFrame:
    """All combinations of levels."""
    return reduce(lambda df, f: df.withColumn(f, F.explode(_levels(step))), FACTORS, spark.range(1)).drop("id")


def scene_key(n: str = FACTORS[0], d: str = FACTORS[1], o: str = FACTORS[2], m: str = FACTORS[3], g: str = FACTORS[4]) -> Column:
    return F.format_string("N%.2f_D%.2f_O%.2f_M%.2f_G%.2f", n, d, o, m, g)


def complexity() -> Column:
    return F.round(sum((F.col(f) for f in FACTORS), F.lit(0.0)), 2)


def _unpivot(results: DataFrame, keys: list[str], columns: tuple[str, ...], name: str, value: str) -> DataFrame:
    return results.unpivot(keys, list(columns), name, value)


def quality(results: DataFrame) -> DataFrame:
    """Mean score by (factor, parser, level); every run counts for all five factors."""
    return _unpivot(results, ["parser", "score"], FACTORS, "param", "val").groupBy("param", "parser", "val").agg(F.avg("score").alias("score"))


def time(results: DataFrame) -> DataFrame:
    """Mean duration by (parser, complexity)."""
    return results.groupBy("parser", complexity().alias("complexity")).agg(F.avg("duration").alias("time"))


def total_operations(tasks: DataFrame, parsers: int) -> int:
    """Operations of a run: each task is generated once, and each parser detects and is compared once."""
    return tasks.count() * (1 + 2 * parsers)


def components(results: DataFrame, parts: tuple[str, ...]) -> DataFrame:
    """Mean component score by (metric, parser, complexity)."""
    rows = results.withColumn("complexity", complexity())
    return _unpivot(rows, ["parser", "complexity"], parts, "metric", "part").filter("part IS NOT NULL").groupBy("metric", "parser", "complexity").agg(F.avg("part").alias("score"))


def shape_report(trees: DataFrame) -> DataFrame:
    """Count, mean height and mean radius by scene and shape, with totals."""
    return trees.rollup("scene_id", "shape").agg(F.count("*").alias("n"), F.avg("height").alias("height"), F.avg("radius").alias("radius"))


def nearest_level(results: DataFrame, x: float) -> DataFrame:
    """For every parser the level of complexity nearest to x, with its mean score (ties to the smaller level)."""
    rows = results.groupBy("parser", complexity().alias("level")).agg(F.avg("score").alias("score"))
    return rows.groupBy("parser").agg(F.min_by(F.struct("level", "score"), F.struct(F.round(F.abs(F.col("level") - x), 6), "level")).alias("p")).select("parser", F.col("p.level").alias("level"), F.col("p.score").alias("score"))


def axis_limits(results: DataFrame) -> DataFrame:
    """Score range by parser, widened by 5 %."""
    lo, hi = F.min("score"), F.max("score")
    return results.groupBy("parser").agg((lo - 0.05 * (hi - lo)).alias("low"), (hi + 0.05 * (hi - lo)).alias("high"))
