"""Exact percentiles of groups of any size: state a group is a constant number of bins, never its values."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import discard, written

#: Values a group may hold in one buffer; larger groups are narrowed by histograms of so many bins first.
HELD, BINS = 10_000, 1_024


def percentiles(rows: DataFrame, keys: Sequence[str], wanted: Mapping[str, tuple[Column | str, float]], held: int = HELD, bins: int = BINS, more: Sequence[Column] = ()) -> DataFrame:
    """keys and a column for each name of wanted: the interpolated percentile p of a numeric column or SQL expression, like F.percentile.

    `more` are further aggregates of a group, named, which follow.
    One aggregate finds how many values each group has.  Where all have at most
    `held`, F.percentile does the rest.  Otherwise each wanted rank starts from
    its group's range; a round counts the values of that range in `bins` equal
    bins, of which each is a partial aggregate, and goes on with the bin that
    holds the rank.  A bin's range is that of its values, and the least and the
    greatest value lie in unlike bins, so every round narrows.  Every third round takes
    bins of the logarithm, so with 1,024 bins any set of doubles needs at most about eight rounds, and
    even ones of a million values one.  Ranges of at most `held` values are sorted.  Rows meet
    the ranges by a join whose small side Spark measures.

    Defined cases: nulls count nowhere, groups without values get null, as do
    null keys their own row; NaN is the greatest value, as in Spark; an empty table gives
    no rows; rounding of the interpolation is that of Spark.  Keys must not be called `_v`, `_name` or the like.
    """
    keys = list(keys)
    columns = {name: (F.expr(c) if isinstance(c, str) else c).cast("double") for name, (c, _) in wanted.items()}
    counts = rows.groupBy(*keys).agg(*[F.count(c).alias(name) for name, c in columns.items()], *more)
    sizes = written(counts, "group-sizes")
    most = sizes.agg(F.max(F.greatest(F.lit(0), *[F.col(name) for name in wanted]))).first()[0] or 0
    if most <= held:
        discard(sizes)
        return rows.groupBy(*keys).agg(*[F.percentile(c, F.lit(wanted[name][1])).alias(name) for name, c in columns.items()], *more)

    values = F.array(*[F.struct(F.lit(name).alias("_name"), c.alias("_v")) for name, c in columns.items()])
    values = rows.select(*keys, F.inline(values)).filter("_v IS NOT NULL")
    at = F.create_map(*[F.lit(x) for name, (_, p) in wanted.items() for x in (name, float(p))])
    group = [*keys, "_name"]
    ends = values.groupBy(*group).agg(F.count("*").alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high")).withColumn("_at", (F.col("_n") - 1) * at[F.col("_name")])
    ranks = F.array_distinct(F.array(F.floor("_at"), F.ceil("_at")))
    # _rank: how many values of the range come before the wanted one
    open_ = written(ends.select(*group, "_at", F.explode(ranks).alias("_k"), "_n", "_low", "_high").withColumn("_rank", F.col("_k")), "ranges")
    target, turn = [*group, "_at", "_k"], 0
    while open_.filter((F.col("_n") > held) & (F.col("_low") < F.col("_high"))).limit(1).count():
        wide = (F.col("_n") > held) & (F.col("_low") < F.col("_high"))
        # halves keep the width finite; what has no place (infinite ends, NaN) takes bin 1 and is narrowed without the ends
        v, low, high = (_scaled(F.col(c)) if turn % 3 == 1 else F.col(c) / 2 for c in ("_v", "_low", "_high"))
        part = F.try_divide(v - low, high - low) * (bins - 1)
        inner = F.when(part.isNull() | F.isnan(part), 1).otherwise(F.least(F.lit(bins - 2), F.floor(part)))
        bin_ = F.when(F.col("_v") == F.col("_high"), bins - 1).when(F.col("_v") == F.col("_low"), 0).otherwise(inner).alias("_bin")
        met = _met(values, open_.filter(wide), keys).select(*target, "_rank", "_v", bin_)
        found = met.groupBy(*target, "_rank", "_bin").agg(F.count("*").alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
        row = F.sort_array(F.collect_list(F.struct("_bin", "_n", "_low", "_high")))
        step = lambda s, b: F.when(s["bin"].isNotNull() | (s["before"] + b["_n"] > s["rank"]), F.struct(s["rank"].alias("rank"), s["before"].alias("before"), F.coalesce(s["bin"], b).alias("bin"))).otherwise(F.struct(s["rank"].alias("rank"), (s["before"] + b["_n"]).alias("before"), s["bin"].alias("bin")))
        none = F.lit(None).cast("struct<_bin:bigint,_n:bigint,_low:double,_high:double>")
        start = F.struct(F.col("_rank").alias("rank"), F.lit(0).cast("long").alias("before"), none.alias("bin"))
        one = found.withColumn("_bin", F.col("_bin").cast("long")).groupBy(*target, "_rank").agg(row.alias("_bins")).withColumn("_s", F.aggregate("_bins", start, step))
        narrowed = one.select(*target, F.col("_s.bin._n").alias("_n"), F.col("_s.bin._low").alias("_low"), F.col("_s.bin._high").alias("_high"), (F.col("_rank") - F.col("_s.before")).alias("_rank"))
        old, open_ = open_, written(open_.filter(~wide).unionByName(narrowed), "ranges")
        discard(old)
        turn += 1
    flat = open_.filter("_low = _high").select(*target, F.col("_low").alias("_value"))
    rest = _met(values, open_.filter("_low < _high"), keys).groupBy(*target, "_rank").agg(F.sort_array(F.collect_list("_v")).alias("_all"))
    values_at = written(flat.unionByName(rest.select(*target, F.get("_all", F.col("_rank").cast("int")).alias("_value"))), "ranks")
    low, high = F.min_by("_value", "_k"), F.max_by("_value", "_k")
    share = F.first("_at") - F.floor(F.first("_at"))
    between = F.when(low == high, low).otherwise((F.ceil(F.first("_at")) - F.first("_at")) * low + share * high)
    out = values_at.groupBy(*group).agg(between.alias("_value"))
    wide = out.groupBy(*keys).agg(*[F.first(F.when(F.col("_name") == name, F.col("_value")), ignorenulls=True).alias(name) for name in wanted])
    return _left(wide, sizes.drop(*wanted), keys)


def _scaled(v: Column) -> Column:
    """Signed logarithms, in the order of the values: doubles of any size in a range of about 4,400."""
    size = F.log2(F.abs(v)) + 1100
    return F.when(v > 0, size).when(v < 0, -size).when(v == 0, 0.0)


def _met(values: DataFrame, ranges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Values within the ranges of their group and name."""
    v, r = values.alias("v"), ranges.alias("r")
    same = F.col("v._name") == F.col("r._name")
    for k in keys:
        same = same & F.col(f"v.{k}").eqNullSafe(F.col(f"r.{k}"))
    return v.join(r, same & (F.col("v._v") >= F.col("r._low")) & (F.col("v._v") <= F.col("r._high"))).select("r.*", "v._v")


def _left(found: DataFrame, groups: DataFrame, keys: Sequence[str]) -> DataFrame:
    """groups with what was found of them: keys, the columns of found, then those of groups."""
    f, g = found.alias("f"), groups.alias("g")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"f.{k}").eqNullSafe(F.col(f"g.{k}"))
    rest = [[F.col(f"{t}.{c}") for c in df.columns if c not in keys] for t, df in (("f", found), ("g", groups))]
    return g.join(f, same, "left").select(*[F.col(f"g.{k}") for k in keys], *rest[0], *rest[1])
