"""Scratch tables in the folder that driver and executors share (spark.checkpoint.dir)."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


@functools.cache
def _local_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="arborspark-")


def shared_dir(spark: SparkSession) -> str:
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if path:
        return path.rstrip("/")
    if spark.sparkContext.master.split("[")[0] == "local":
        return _local_folder()
    raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/arborspark/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df and read it back: iterations start from a table instead of a growing lineage."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.scratch_path = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete written tables that no later plan reads."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.scratch_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
