"""Streams in several triggers against the batch."""

import datetime as dt


from arborspark.scratch import new_path
from arborspark.streaming import results, stalls

T0 = dt.datetime(2024, 1, 1)


def _stream(spark, parts, schema):
    """A stream that reads one part a trigger."""
    path = new_path(spark, "stream-input")
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}/part={i}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path).drop("part"), spark.read.schema(schema).parquet(path).drop("part")


def _at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def test_stalls_are_told_once(spark):
    parts = [
        [(1, _at(0)), (1, _at(60)), (2, _at(0)), (3, _at(10))],  # 3 never comes back
        [(1, _at(400)), (2, _at(100)), (2, _at(100))],  # 1 was silent between two triggers
        [(1, _at(450)), (2, _at(221)), (2, _at(600)), (1, _at(1000))],  # 2 within one trigger
    ]
    stream, table = _stream(spark, parts, "run long, at timestamp")
    got = stalls.run_to_end(spark, stalls.stalls(stream, 120), "stalls").collect()
    want = stalls.stalls_batch(table, 120).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    seconds = sorted((r.run, int((r.last_progress - T0).total_seconds())) for r in got)
    assert seconds == [(1, 60), (1, 450), (2, 100), (2, 221), (2, 600), (3, 10)]


def test_a_run_told_again_counts_once(spark):
    first = [(i, _at(i), "a" if i % 2 else "b", float(i)) for i in range(40)]
    again = [(i, _at(i + 20), p, s) for i, _, p, s in first if i % 4 == 0]
    stream, _ = _stream(spark, [first[:20], again[:3] + first[20:], again[3:]], "run long, at timestamp, parser string, score double")
    got = results.caught_up(spark, results.means(results.distinct_runs(stream, "run", "at", "10 minutes"))).collect()
    want = results.means(spark.createDataFrame(first, "run long, at timestamp, parser string, score double")).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    assert results.means(results.distinct_runs(stream, "run", "at", "10 minutes")).isStreaming
