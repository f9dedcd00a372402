"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Every source gets a target (a share of all words by weight, at most `cap` times
its own words).  The words of the mix are seats of equal-token blocks: seats go
to sources, and then to the hash shards of each source, by the highest
quotients v / (2k + 1).  Within a shard the documents stand in a seeded order
and the seats select a seeded circular run of blocks, after as many whole
passes as the quota holds.

Whole documents are written, and a run cuts at most two documents of its shard.
A cut document is written with the probability of its part in the run, by one
systematic draw over all cut documents of a source from long to short: every
prefix of them counts as many written documents as the sum of its parts, within
one, so the words written and taken of a source differ by less than its longest
cut document.

Only DataFrame functions are used.  A window never holds more than one shard
of one source (about `rows_per_shard` rows of the table), so a source with a
third of all rows is dealt over as many tasks as its size asks for.  Seats reach
the shards of a source in levels of at most `fan` parties each.  Only small rows
meet in one window: one a source, and the cut documents of a source, two a shard
at most, without texts.

Defined cases: a null text has size 0 and is never taken; null sources form
one source, sorted last; repeated rows are separate documents; an empty table
gives an empty result; columns of the input are read by name and carried in
the struct column `doc`, so they cannot clash with the computed ones.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, staged


def _hex(text: Column, first: int, digits: int) -> Column:
    return F.conv(F.substring(F.md5(text), first, digits), 16, 10).cast("long")


def fair_targets(sources: DataFrame, weights: Sequence[int], cap: int) -> DataFrame:
    """Add `target` to one row per source (src_null, src, source_size); targets sum to all words.

    A source that would pass cap * size stops there and the rest is shared
    again by weight.  In the order of size / weight the capped sources come
    first, so one running sum finds the level at which sharing ends.
    """
    by_name = Window.orderBy("src_null", "src")
    before = Window.orderBy("full_at", "src_null", "src").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    level = (F.sum("source_size").over(everything) - cap * F.coalesce(F.sum("source_size").over(before), F.lit(0))).cast("double") / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    )
    return (
        sources.withColumn("weight", weight)
        .withColumn("full_at", (cap * F.col("source_size")).cast("double") / F.col("weight"))
        .withColumn("level", level)
        .withColumn("level", F.max("level").over(everything))
        .withColumn("target", F.when(F.col("full_at") < F.col("level"), (cap * F.col("source_size")).cast("double")).otherwise(F.col("level") * F.col("weight")))
        .drop("weight", "full_at", "level")
    )


def sainte_lague(parties: DataFrame, group: Sequence[str], order: Sequence[str], votes: str, seats: str) -> DataFrame:
    """Add `quota`: the seats of each party when `seats` (equal within a group) go by highest quotients.

    With S parties a party's quota differs from its exact share by at most
    S/2 * share + 3/2, so all seats below that are certain and only the
    quotients of about 3 S further seats are ranked.
    """
    g = Window.partitionBy(*group)
    share = F.col(votes).cast("double") / F.col("_all")
    p = (
        parties.withColumn("_all", F.sum(F.col(votes).cast("double")).over(g))
        .withColumn("_n", F.count("*").over(g))
        .withColumn("_sure", F.when(F.col(votes) > 0, F.greatest(F.lit(0), F.floor(share * F.col(seats) - share * F.col("_n") / 2 - 1.5))).otherwise(F.lit(0)).cast("long"))
        .withColumn("_open", F.col(seats) - F.sum("_sure").over(g))
        .withColumn("_span", F.when(F.col(votes) > 0, F.ceil(share * F.col("_n")) + 4).otherwise(F.lit(0)).cast("long"))
    )
    seat = p.withColumn("_k", F.explode_outer(F.when(F.col("_span") > 0, F.sequence(F.col("_sure"), F.col("_sure") + F.col("_span")))))
    quotient = F.when(F.col("_k").isNotNull(), F.col(votes).cast("double") / (2 * F.col("_k") + 1))
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc_nulls_last("_q"), *order))
    won = seat.withColumn("_q", quotient).withColumn("_won", ((rank <= F.col("_open")) & F.col("_q").isNotNull()).cast("long"))
    kept = [c for c in parties.columns if c not in ("quota",)]
    return won.groupBy(*kept).agg((F.first("_sure") + F.sum("_won")).alias("quota"))


def dealt(docs: DataFrame, carry: Sequence[str], seed: str, shards: int, rows_per_shard: int) -> DataFrame:
    """docs with size and shard; rows go to shards by the hash of their id and text.

    Rows that equal each other in id, text and source, where there are more of them
    than a shard holds, are numbered, and the number is hashed too.  Numbers are drawn
    within salted parts first and then moved on by the parts before, so no window holds
    all copies of a row.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    name = F.concat(F.lit(seed + "|"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), F.md5(text))
    rows = docs.select(
        F.struct(*carry).alias("doc"),
        F.col("source").isNull().alias("src_null"),
        F.coalesce(F.col("source"), F.lit("")).alias("src"),
        F.col("doc_id").alias("_id"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        name.alias("_name"),
    )
    same = ["src_null", "src", "_name"]
    many = staged(rows.groupBy(*same).count().filter(F.col("count") > rows_per_shard).select(*same), "mix-repeated")
    held = rows.join(many, same, "left_semi").withColumn("_salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1024)))
    own = held.withColumn("_n", F.row_number().over(Window.partitionBy(*same, "_salt").orderBy(F.lit(0))))
    before = Window.partitionBy(*same).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    own = staged(own, "mix-numbered")  # a number must not change between two readings
    moved = own.groupBy(*same, "_salt").agg(F.count("*").alias("_c")).withColumn("_first", F.coalesce(F.sum("_c").over(before), F.lit(0))).drop("_c")
    numbered = own.join(moved, [*same, "_salt"]).withColumn("_n", (F.col("_n") + F.col("_first")).cast("long")).drop("_salt", "_first")
    rest = rows.join(many, same, "left_anti").withColumn("_n", F.lit(0).cast("long"))
    h = F.concat(F.col("_name"), F.lit("|"), F.col("_n").cast("string"))
    return rest.unionByName(numbered).withColumn("shard", _hex(h, 1, 8) % shards).withColumn("_at", _hex(h, 9, 15))


def mix(
    docs: DataFrame,
    carry: Sequence[str],
    *,
    weights: Sequence[int] = (1, 2, 3),
    cap: int = 3,
    block_tokens: int = 64,
    seed: str = "mix-1",
    rows_per_shard: int = 250,
    fan: int = 20_000,
    whole: bool = True,
) -> DataFrame:
    """One row per document: doc (the carried columns), size, source_size, target, taken, copies.

    taken counts words; copies is the whole documents that the mix writes (a
    document cut by the edge of the run counts as the source's draw falls); it is
    left out, with the work it takes, unless `whole`.
    """
    shards = max(1, -(-docs.count() // rows_per_shard))
    key = ["src_null", "src", "shard"]
    rows = dealt(docs, carry, seed, shards, rows_per_shard)
    sizes = rows.groupBy(*key).agg(F.sum("size").alias("shard_size"))
    sources = fair_targets(sizes.groupBy("src_null", "src").agg(F.sum("shard_size").alias("source_size")), weights, cap)
    sources = sources.withColumn("seats", F.floor(F.sum("source_size").over(Window.partitionBy()) / block_tokens).cast("long"))
    sources = sainte_lague(sources, [], ["src_null", "src"], "target", "seats").select("src_null", "src", "source_size", "target", F.col("quota").alias("source_quota"))
    width = 1  # shards under one party of the level
    while width * fan < shards:
        width *= fan
    above, seats = ["src_null", "src"], sources.select("src_null", "src", F.col("source_quota").alias("seats"))
    while width > 1:
        group = F.floor(F.col("shard") / width).alias("group")
        parties = sizes.groupBy("src_null", "src", group).agg(F.sum("shard_size").alias("size"))
        parties = parties.withColumn("above", F.floor(F.col("group") / fan)) if "above" in above else parties
        seats = sainte_lague(parties.join(seats, above), above, ["group"], "size", "seats").select("src_null", "src", F.col("group").alias("above"), F.col("quota").alias("seats"))
        above, width = ["src_null", "src", "above"], width // fan
    parties = sizes.withColumn("above", F.floor(F.col("shard") / fan)) if "above" in above else sizes
    quotas = sainte_lague(parties.join(seats, above), above, ["shard"], "shard_size", "seats")

    blocks = F.ceil(F.col("shard_size") / block_tokens).cast("long")
    passes = F.least(F.lit(cap), F.floor(F.col("words") / F.col("shard_size"))).cast("long")
    start = F.pmod(_hex(F.concat(F.lit(seed + "|run|"), F.col("src"), F.lit("|"), F.col("shard").cast("string")), 1, 15), F.col("blocks"))
    runs = (
        quotas.filter("shard_size > 0")
        .withColumn("blocks", blocks)
        .withColumn("words", F.col("quota") * block_tokens)  # the last block of a shard may be short, so passes count words
        .withColumn("passes", passes)
        .withColumn("rest", F.when(F.col("passes") == cap, F.lit(0)).otherwise(F.col("words") - F.col("passes") * F.col("shard_size")))
        .withColumn("from", start * block_tokens)
        .withColumn("to", F.col("from") + F.col("rest"))
        .withColumn("wrap", F.greatest(F.lit(0), F.col("to") - F.col("shard_size")))
        .select(*key, "passes", "from", "to", "wrap")
    )
    running = Window.partitionBy(*key).orderBy("_at", "_id", "_name", "_n").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("end", F.sum("size").over(running)).withColumn("begin", F.col("end") - F.col("size"))

    def overlap(a, b):
        return F.greatest(F.lit(0), F.least(F.col("end"), b) - F.greatest(F.col("begin"), a))

    part = F.coalesce(overlap(F.col("from"), F.col("to")) + overlap(F.lit(0), F.col("wrap")), F.lit(0))
    passes = F.coalesce(F.col("passes"), F.lit(0))
    placed = placed.join(runs, key, "left").withColumn("_part", part)
    taken = (passes * F.col("size") + F.col("_part")).cast("long").alias("taken")
    out = ["doc", "size", "source_size", "target", taken]
    sources = sources.drop("source_quota")
    if not whole:
        return placed.join(sources, ["src_null", "src"]).select(*out)

    # Words before a document are its own within a shard, so they name it.
    cut = placed.filter((F.col("_part") > 0) & (F.col("_part") < F.col("size"))).select(*key, "begin", "size", "_part")
    longest = Window.partitionBy("src_null", "src").orderBy(F.desc("size"), "shard", "begin")
    reach = lambda last: F.coalesce(F.sum(F.col("_part") / F.col("size")).over(longest.rowsBetween(Window.unboundedPreceding, last)), F.lit(0.0))
    draw = _hex(F.concat(F.lit(seed + "|cut|"), F.col("src_null").cast("string"), F.lit("|"), F.col("src")), 1, 8) / F.lit(2.0**32)
    cut = cut.withColumn("_until", F.floor(reach(0) + draw)).withColumn("_before", F.floor(reach(-1) + draw)).filter("_until > _before")
    drawn = cut.groupBy(*key).agg(F.collect_list("begin").alias("drawn"))
    inside = (F.col("size") > 0) & (F.col("_part") == F.col("size"))
    once = inside | ((F.col("_part") > 0) & F.coalesce(F.array_contains("drawn", F.col("begin")), F.lit(False)))
    return placed.join(drawn, key, "left").join(sources, ["src_null", "src"]).select(*out, (passes + once.cast("long")).alias("copies"))
