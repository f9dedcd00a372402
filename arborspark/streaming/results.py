"""The result feed as a stream: running mean scores that equal the batch report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import new_path


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of `events` as a stream."""
    folder = sf_dir.rstrip("/")
    events = spark.read.parquet(f"{folder}/events.parquet")
    schema, files = events.schema, events.inputFiles()
    whole = any(f.rstrip("/").endswith("/events.parquet") for f in files)  # one file, not a folder of parts
    source = f"{folder}/events.parque[t]" if whole else f"{folder}/events.parquet"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).parquet(source)


def distinct_runs(results: DataFrame, run: str, at: str, late: str) -> DataFrame:
    """A stream of results in which a run that is told again within `late` counts once, the first time."""
    return results.withWatermark(at, late).dropDuplicatesWithinWatermark([run])


def means(results: DataFrame) -> DataFrame:
    """parser, runs, score of a stream or table of results (parser, score)."""
    return results.groupBy("parser").agg(F.count("*").alias("runs"), F.avg("score").alias("score"))


def running_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """parser, runs, score after the stream over the event files has caught up.

    The aggregate is in complete mode; every batch replaces the written report.
    """
    runs = event_stream(spark, sf_dir).select(F.col("event_type").alias("parser"), F.col("value").alias("score"))
    return caught_up(spark, means(runs))


def caught_up(spark: SparkSession, report: DataFrame) -> DataFrame:
    """A streamed report in complete mode once the stream has read all that is there."""
    out = new_path(spark, "running-means")
    query = (
        report.writeStream.outputMode("complete")
        .option("checkpointLocation", new_path(spark, "stream"))
        .foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(out))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(report.schema).parquet(out)
