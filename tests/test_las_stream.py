"""LAS files that arrive in several triggers, against the batch; batches that come again."""

import json
from pathlib import Path

import pytest

from arborspark.scratch import new_path
from arborspark.sources import las

SCHEMA = las.SCHEMA


def _local(path):
    return Path(path.removeprefix("file://"))


def _points(spark, first, n):
    return spark.range(first, first + n).selectExpr("cast(id % 3 as int) AS scene_id", "id AS pid", "id * 0.25D AS x", "id * 0.5D AS y", "cast(id % 9 as double) AS z", "2 AS cls")


def _run(spark, source, target, log, checkpoint, **options):
    stream = spark.readStream.format("las").option("logPath", log).options(**options).load(source)
    query = stream.writeStream.format("las").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(target)
    query.awaitTermination()


def _rows(df):
    return sorted((r.scene_id, round(r.x, 3), round(r.y, 3), round(r.z, 3), r.cls) for r in df.collect())


def test_three_arrivals_and_a_batch_told_again(spark):
    las.register(spark)
    source, target, log, checkpoint = (new_path(spark, n) for n in ("las-in", "las-out", "las-log", "las-checkpoint"))
    for i in range(3):
        _points(spark, i * 50, 50).repartition(2, "scene_id").write.format("las").mode("append").save(source)
        _run(spark, source, target, log, checkpoint)
        assert _rows(spark.read.format("las").load(target)) == _rows(spark.read.format("las").load(source))
    assert len(_rows(spark.read.format("las").load(target))) == 150
    entries = sorted(_local(log).glob("*.json"))
    named = [p for e in entries for p in json.loads(e.read_text())["files"]]
    assert len(entries) == 3 and len(named) == len(set(named))

    _run(spark, source, target, log, checkpoint)  # nothing new
    assert len(sorted(_local(log).glob("*.json"))) == 3

    before, files = _rows(spark.read.format("las").load(target)), sorted(_local(target).glob("*.las"))
    for done in _local(checkpoint).glob("commits/*"):  # as if the driver had died before it noted the last batch
        if done.name.strip(".").startswith("2"):
            done.unlink()
    _run(spark, source, target, log, checkpoint)
    assert _rows(spark.read.format("las").load(target)) == before
    assert sorted(_local(target).glob("*.las")) == files


def test_a_lost_output_entry_reads_the_same_files_again(spark):
    """The last batch was planned and never written: its files come again though others have arrived since."""
    las.register(spark)
    source, target, log, checkpoint = (new_path(spark, n) for n in ("las-in", "las-out", "las-log", "las-checkpoint"))
    _points(spark, 0, 30).repartition(1).write.format("las").mode("append").save(source)
    _run(spark, source, target, log, checkpoint)
    first = _rows(spark.read.format("las").load(source))
    for done in [*_local(checkpoint).glob("commits/*"), *_local(target).glob("_batches/*.json")]:
        done.unlink()
    _points(spark, 30, 30).repartition(1).write.format("las").mode("append").save(source)
    _run(spark, source, target, log, checkpoint)  # availableNow does one batch a start: the planned one
    assert _rows(spark.read.format("las").load(target)) == first and len(first) == 30
    _run(spark, source, target, log, checkpoint)
    assert _rows(spark.read.format("las").load(target)) == _rows(spark.read.format("las").load(source))
    assert len(list(_local(target).glob("_batches/*.json"))) == 2


def test_empty_folders_and_small_files(spark):
    las.register(spark)
    source, target, log, checkpoint = (new_path(spark, n) for n in ("las-in", "las-out", "las-log", "las-checkpoint"))
    _local(source).mkdir(parents=True)
    _run(spark, source, target, log, checkpoint)
    assert not list(_local(target).glob("*.las"))
    _points(spark, 0, 3).repartition(1).write.format("las").mode("append").save(source)
    _run(spark, source, target, log, checkpoint, minBytes="1000000")
    assert not list(_local(target).glob("*.las"))


def test_a_stream_without_a_log_is_refused(spark):
    las.register(spark)
    with pytest.raises(Exception, match="logPath"):
        query = spark.readStream.format("las").load("/nowhere").writeStream.format("noop").trigger(availableNow=True).start()
        query.awaitTermination()


def test_batches_beside_streams(spark):
    """A batch append keeps what a stream has written; a batch overwrite is refused."""
    las.register(spark)
    source, target, log, checkpoint = (new_path(spark, n) for n in ("las-in", "las-out", "las-log", "las-checkpoint"))
    _points(spark, 0, 20).repartition(1).write.format("las").mode("append").save(source)
    _run(spark, source, target, log, checkpoint)
    _points(spark, 20, 20).repartition(1).write.format("las").mode("append").save(target)
    assert len(_rows(spark.read.format("las").load(target))) == 40
    with pytest.raises(Exception, match="stream"):
        _points(spark, 0, 5).write.format("las").mode("overwrite").save(target)
