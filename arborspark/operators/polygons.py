"""Points in many polygons: an index of edges by rows, joined with the points of the same cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import written


def _level(size: Column) -> Column:
    """The least even power of two of at least `size`, as its exponent."""
    return (F.ceil(F.log2(size) / 2) * 2).cast("int")


def _cell(at: Column, level: Column) -> Column:
    return F.floor(at / F.pow(F.lit(2.0), level))


def edge_index(polygons: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """by, polygon_id, its box, level_x, level_y, cx, cy, edges of polygons(by, polygon_id, vertices array<struct<x, y>>).

    A polygon lies in at most two columns of its own level, as wide as the polygon or
    up to four times that, and in so many rows that all of them together hold about
    twice as many edges as it has.  A row of the index holds the edges that a point
    of that cell may cross, so the index grows with the edges, not with areas.
    """
    v = F.col("vertices")
    n = F.size("vertices")
    lim = {f"{c}_{name}": agg(F.col(f"vertices.{c}").cast("array<double>")) for c in "xy" for name, agg in (("min", F.array_min), ("max", F.array_max))}
    whole = F.forall(v, lambda p: p["x"].isNotNull() & p["y"].isNotNull() & (F.abs(p["x"].cast("double")) < float("inf")) & (F.abs(p["y"].cast("double")) < float("inf")))
    p = polygons.select(*by, "polygon_id", "vertices").filter(v.isNotNull() & (n >= 3)).filter(whole).dropDuplicates()
    p = p.withColumns(lim).filter("x_min < x_max AND y_min < y_max").withColumn("_shape", F.xxhash64("vertices"))
    following = lambda i: F.get(v, F.pmod(i + 1, n))
    edge = lambda a, i: F.struct(*[q[c].cast("double").alias(f"{c}{k}") for k, q in ((1, a), (2, following(i))) for c in "xy"])
    p = p.withColumn("edges", F.filter(F.transform(v, edge), lambda e: e["y1"] != e["y2"])).drop("vertices")
    climbed = F.aggregate("edges", F.lit(0.0), lambda s, e: s + F.abs(e["y1"] - e["y2"]))
    height = F.col("y_max") - F.col("y_min")
    rows = F.greatest(F.lit(1.0), F.floor(F.size("edges") * height / climbed))
    p = p.withColumn("level_x", _level(F.col("x_max") - F.col("x_min"))).withColumn("level_y", _level(height / rows))
    e = p.withColumn("edge", F.explode("edges")).drop("edges")
    ends = [_cell(f("edge.y1", "edge.y2"), F.col("level_y")) for f in (F.least, F.greatest)]
    e = e.withColumn("cy", F.explode(F.sequence(*ends)))
    box = ["x_min", "x_max", "y_min", "y_max"]
    cells = e.groupBy(*by, "polygon_id", "_shape", *box, "level_x", "level_y", "cy").agg(F.collect_list("edge").alias("edges")).drop("_shape")
    return cells.withColumn("cx", F.explode(F.sequence(_cell(F.col("x_min"), F.col("level_x")), _cell(F.col("x_max"), F.col("level_x")))))


def points_in_polygons(points: DataFrame, polygons: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """points with polygon_id, one row for each polygon that a point lies in by the even-odd rule; `by` columns are equal.

    The join is on cells; a point meets only polygons of its column and only the
    edges of its row.  It is repeated once for each pair of levels in the index, of
    which there are few: the driver sees these pairs alone.

    Defined cases: polygons that are null, of fewer than three vertices, without
    width or height, or with null or non-finite coordinates hold no point; a polygon that is repeated with its id
    counts once, and unlike polygons of one id count each; points with null or non-finite x or y lie nowhere; nulls in
    `by` meet nothing; other columns of polygons are left out.
    """
    index = written(edge_index(polygons, by), "edge-index")
    levels = [(r.level_x, r.level_y) for r in index.select("level_x", "level_y").distinct().collect()]
    at = F.array(*[F.struct(F.lit(a).alias("level_x"), F.lit(b).alias("level_y")) for a, b in levels]) if levels else F.expr("array_remove(array(named_struct('level_x', 0, 'level_y', 0)), named_struct('level_x', 0, 'level_y', 0))")
    finite = (F.abs("x") < float("inf")) & (F.abs("y") < float("inf"))
    x, y = F.col("p.x").cast("double"), F.col("p.y").cast("double")
    spread = points.filter(finite).select(*[F.col(c).alias(f"_{c}") for c in by], F.struct(*points.columns).alias("p"), F.inline(at))
    spread = spread.withColumn("cx", _cell(x, F.col("level_x"))).withColumn("cy", _cell(y, F.col("level_y")))
    i = index.select(*[F.col(c).alias(f"_{c}") for c in by], *[c for c in index.columns if c not in by])
    met = spread.join(i.hint("merge"), [*[f"_{c}" for c in by], "level_x", "level_y", "cx", "cy"])  # else Spark may broadcast every point once a pair of levels

    def crosses(e: Column) -> Column:
        spans = (e["y1"] > y) != (e["y2"] > y)
        return (spans & (x < (e["x2"] - e["x1"]) * (y - e["y1"]) / (e["y2"] - e["y1"]) + e["x1"])).cast("int")

    inside = F.aggregate("edges", F.lit(0), lambda s, e: s + crosses(e)) % 2 == 1
    return met.filter(x.between(F.col("x_min"), F.col("x_max")) & inside).select("p.*", "polygon_id")
