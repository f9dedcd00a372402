"""Stalled runs in a stream of progress reports: a run without progress for a while is reported once."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..scratch import new_path

STALL = "run long, last_progress timestamp"


def _row(run: int, micros: int) -> dict:
    return {"run": run, "last_progress": pd.Timestamp(micros, unit="us")}


class Watch(StatefulProcessor):
    """A run's last progress and whether its silence since then has been told; a timer stands at the end of its patience."""

    def __init__(self, patience_s: int):
        self.patience = patience_s * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("progress", "last long, told boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        times = sorted(int(t) for part in rows for t in part["micros"])
        last, told = self.state.get() if self.state.exists() else (times[0], False)
        stalls, seen = [], last
        for t in times:
            if t <= last:
                continue
            if t - last > self.patience and not told:
                stalls.append(_row(key[0], last))
            last, told = t, False
        if last != seen or not self.state.exists():
            self.state.update((last, told))
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.handle.registerTimer((last + self.patience) // 1000 + 1)
        if stalls:
            yield pd.DataFrame(stalls)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last, told = self.state.get()
        if not told:
            self.state.update((last, True))
            yield pd.DataFrame([_row(key[0], last)])

    def close(self) -> None:
        pass


def stalls(progress: DataFrame, patience_s: int = 120, late: str = "0 seconds") -> DataFrame:
    """run, last_progress of every silence longer than patience_s in a stream progress(run long, at timestamp).

    Silences end with the run's next report or are open when the stream's watermark
    passes them; reports later than `late` behind the newest are dropped by the watermark,
    and reports older than their run's last one tell nothing new.
    """
    rows = progress.withWatermark("at", late).select("run", "at", F.unix_micros("at").alias("micros"))
    return rows.groupBy("run").transformWithStateInPandas(statefulProcessor=Watch(patience_s), outputStructType=STALL, outputMode="Append", timeMode="eventTime")


def stalls_batch(progress: DataFrame, patience_s: int = 120) -> DataFrame:
    """The same of a finished table: silences longer than patience_s, the last of a run measured to the newest report of all."""
    newest = F.broadcast(progress.agg(F.max("at").alias("_newest")))  # one row
    times = progress.select("run", "at").distinct()
    next_ = F.lead("at").over(Window.partitionBy("run").orderBy("at"))
    rows = times.withColumn("_next", next_).join(newest)
    silent = F.unix_micros(F.coalesce("_next", "_newest")) - F.unix_micros("at") > patience_s * 1_000_000
    return rows.filter(silent).select("run", F.col("at").alias("last_progress"))


def run_to_end(spark: SparkSession, result: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """The rows that a stream has given once it has read all that is there."""
    out = new_path(spark, name)
    store = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(store, None)
    spark.conf.set(store, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")  # timers need it
    try:
        query = result.writeStream.outputMode(mode).option("checkpointLocation", new_path(spark, "stream")).foreachBatch(
            lambda batch, i: batch.write.mode("overwrite").parquet(f"{out}/batch={i}")  # a batch that is replayed replaces itself
        ).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(store, before) if before else spark.conf.unset(store)
    return spark.read.schema(result.schema).parquet(out).drop("batch")
