"""Synthetic scenes through files, detectors and scores."""

from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from arborspark.operators import scoring as S
from arborspark.plans.detectors import DETECTORS
from arborspark.scratch import new_path, written
from arborspark.sources import las, scenes


@pytest.fixture(scope="module")
def forest(spark):
    p = spark.createDataFrame([(0, 42, 24.0, 24.0, 0.0, 0.0, 0.0, 0.0, 0.0)], scenes.PARAMETERS)
    plan = written(scenes.plan_forest(p), "plan")
    return plan, written(scenes.generate(p, plan, step=0.5, density=1.5), "scene")


def test_scene_is_reproducible_and_labelled(spark, forest):
    plan, points = forest
    assert plan.count() >= 4 and points.filter("cls = 2").count() > 1000 and points.filter("cls > 2").count() > 1000
    p = spark.createDataFrame([(0, 42, 24.0, 24.0, 0.0, 0.0, 0.0, 0.0, 0.0)], scenes.PARAMETERS)
    again = scenes.generate(p, scenes.plan_forest(p), step=0.5, density=1.5)
    assert again.count() == points.count() and again.select("pid").distinct().count() == points.count()


def test_las_keeps_points_to_the_millimetre(spark, forest):
    las.register(spark)
    path = new_path(spark, "las")
    forest[1].repartition(1).write.format("las").mode("append").save(path)
    back = spark.read.format("las").option("recordsPerTask", 1000).load(path)
    assert back.rdd.getNumPartitions() > 1 and back.count() == forest[1].count()
    a = forest[1].agg(F.avg("x"), F.avg("z"), F.sum("cls")).first()
    b = back.agg(F.avg("x"), F.avg("z"), F.sum("cls")).first()
    assert a[0] == pytest.approx(b[0], abs=1e-3) and a[1] == pytest.approx(b[1], abs=1e-3) and a[2] == b[2]
    assert back.filter("cls = 2 AND x < 5").count() == forest[1].filter("cls = 2 AND x < 5").count() or abs(back.filter("cls = 2 AND x < 5").count() - forest[1].filter("cls = 2 AND x < 5").count()) < 3


def test_las_reads_only_committed_files(spark, forest):
    las.register(spark)
    path = new_path(spark, "las")
    few = forest[1].limit(500).coalesce(1)
    few.write.format("las").mode("append").save(path)
    folder = Path(path.removeprefix("file://"))
    first = next(folder.glob("*.las"))
    (folder / "scene-000000-failed.las").write_bytes(first.read_bytes())  # as a lost executor leaves it
    assert spark.read.format("las").load(path).count() == 500
    few.write.format("las").mode("append").save(path)
    assert spark.read.format("las").load(path).count() == 1000


def las_file(path, minor, form, points, legacy):
    """Two header sizes, and records of 67 bytes at most with x = 1, 2, ... and class 2 (formats to 5) or 200."""
    head = np.zeros(1, las.HEADER)
    size = 375 if minor >= 4 else las.HEADER.itemsize
    for k, v in {"signature": b"LASF", "major": 1, "minor": minor, "format": form, "header_size": size, "offset_to_points": size, "record_length": las.LENGTHS[form], "points": legacy, "scale": 1.0}.items():
        head[k] = v
    body = bytearray(head.tobytes().ljust(size, b"\0"))
    if minor >= 4:
        body[247:255] = points.to_bytes(8, "little")
    for i in range(points):
        r = bytearray(las.LENGTHS[form])
        r[0:4] = (i + 1).to_bytes(4, "little")
        r[16 if form >= 6 else 15] = 200 if form >= 6 else 2
        body += r
    path.write_bytes(bytes(body))


def rows_of(path):
    reader = las.LasReader({"path": f"file://{path}"})
    return [(r["x"], r["cls"]) for part in reader.partitions() for b in reader.read(part) for r in b.to_pylist()]


@pytest.mark.parametrize(("minor", "form", "legacy", "cls"), [(2, 3, 3, 2), (0, 0, 3, 2), (4, 6, 0, 200), (4, 10, 0, 200), (4, 3, 0, 2)])
def test_las_versions(tmp_path, minor, form, legacy, cls):
    las_file(tmp_path / "a.las", minor, form, 3, legacy)
    assert rows_of(tmp_path) == [(1.0, cls), (2.0, cls), (3.0, cls)]


def test_las_unknown_versions_are_an_error(tmp_path):
    las_file(tmp_path / "a.las", 5, 3, 1, 1)
    with pytest.raises(ValueError, match="not supported"):
        rows_of(tmp_path)


@pytest.mark.parametrize(("minor", "form", "legacy"), [(2, 3, 4), (4, 7, 0)])
def test_las_crop_keeps_whole_records(spark, tmp_path, minor, form, legacy):
    las.register(spark)
    (tmp_path / "in").mkdir()
    las_file(tmp_path / "in" / "a.las", minor, form, 4, legacy)
    data = bytearray((tmp_path / "in" / "a.las").read_bytes())
    start, length = int.from_bytes(data[96:100], "little"), las.LENGTHS[form]
    for i in range(4):  # marks in the bytes that are not decoded: intensity, return number, the last byte
        at = start + i * length
        data[at + 12], data[at + 14], data[at + length - 1] = 7 + i, 1 + i % 2, 90 + i
    (tmp_path / "in" / "a.las").write_bytes(data)
    (tmp_path / "in" / "far.las").write_bytes(data[:start] + b"".join((99).to_bytes(4, "little") + bytes(data[start + 4 : start + length]) for _ in range(4)))
    source, target = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    kept = las.crop(spark, source, target, [(1.5, -1.0), (3.5, -1.0), (3.5, 1.0), (1.5, 1.0)])
    assert sorted(r.x for r in kept.collect()) == [2.0, 3.0]
    (made,) = (tmp_path / "out").glob("*.las")
    out = made.read_bytes()
    head = np.frombuffer(out, las.HEADER, 1)[0]
    assert out[start:] == bytes(data[start + length : start + 3 * length])
    assert (head["min_x"], head["max_x"], head["format"], head["points"]) == (2.0, 3.0, form, 2 if form < 6 else 0)
    if minor >= 4:
        more = np.frombuffer(out, las.HEADER_14, 1, las.HEADER.itemsize)[0]
        assert more["points"] == 2 and list(more["by_return"][:3]) == [1, 1, 0]
    else:
        assert list(head["by_return"][:3]) == [1, 1, 0]
    none = las.crop(spark, source, f"file://{tmp_path}/none", [(50.0, 0.0), (51.0, 0.0), (51.0, 1.0)])
    assert none.count() == 0 and not list((tmp_path / "none").glob("*.las"))


def test_las_small_files_are_skipped_where_asked(tmp_path):
    las_file(tmp_path / "a.las", 2, 3, 3, 3)
    las_file(tmp_path / "b.las", 2, 3, 40, 40)
    reader = las.LasReader({"path": f"file://{tmp_path}", "minBytes": "1024"})
    assert [p.count for p in reader.partitions()] == [40]


@pytest.mark.parametrize("name", sorted(DETECTORS))
def test_detectors_find_trees(spark, forest, name):
    plan, points = forest
    trees = written(DETECTORS[name](points), "trees")
    assert trees.columns == ["scene_id", "tree_id", "x", "y", "height", "radius", "shape"]
    assert trees.count() >= 1 and trees.select("tree_id").distinct().count() == trees.count()
    score = S.scores(plan, trees, S.matches(plan, trees)).first().score_total
    assert 0 <= score <= 100


def test_benchmark_run_and_reports(spark):
    from arborspark.plans import benchmark, reports

    tasks = reports.sweep(spark, 1.0).filter("gap_factor = 0 AND overlap_factor = 0 AND mixing_factor = 0 AND dropout_rate = 0")
    results = written(benchmark.run(benchmark.parameters(tasks, 16.0, 16.0), ["chm_watershed"], step=0.5, density=1.0), "results")
    assert results.count() == 2 and {r.scene_key for r in results.collect()} == {"N0.00_D0.00_O0.00_M0.00_G0.00", "N1.00_D0.00_O0.00_M0.00_G0.00"}
    assert all(0 <= r.score_total <= 100 for r in results.collect())
    made = benchmark.tables(results)
    assert made["quality"].filter("param = 'noise_level'").count() == 2 and made["components"].count() == 8
