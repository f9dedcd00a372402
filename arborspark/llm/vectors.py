"""Usable vectors and their blocks, shared by the two vector operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """A vector without null or non-finite components, as doubles; else null."""
    v = vector.cast("array<double>")
    fine = vector.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(fine, v)


def valid_vectors(rows: DataFrame, *carry: str) -> DataFrame:
    """vec_id, v (array<double>), carried columns and dim of the rows that take part."""
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), usable(F.col("embedding")).alias("v"), *carry).filter("v IS NOT NULL AND vec_id IS NOT NULL").withColumn("dim", F.size("v"))
