"""Document fingerprints from closed syncmers, compared with an edited text and with the next document.

A text is cut into words; a k-mer (five words) is a closed syncmer where the least hash
of its inner two-word substrings lies at its first or last place.  Whether it is one
depends on its own words alone, so texts that share a passage share its anchors,
wherever the passage stands.  The fingerprint keeps the `size` least anchor hashes of
the whole text with the word at which each first stands; likeness is the share of
common anchors among the least `size` of both (Jaccard's index of all anchors, exact
for texts with at most `size` anchors), and the displacement of the common anchors
tells how far a passage moved.

The next document is the one that follows in descending doc_id.  Rows are dealt into
ranges of the order, found from a bounded sample of its keys; the first row of a
range is also sent to the range before it, so one shuffle of the texts is enough and
no window holds more than a range.

Everything is DataFrame functions.  Defined cases: a null text is empty; rows without
doc_id come last; equal ids are ordered by the text's hash; repeated rows
(same id and text) follow each other and are each other's next document, and where
they hold over a thousandth of the table they are counted before the shuffle; a text
without any syncmer, as every text under five words, has one anchor made of all its
words, and a text without words has none; two empty fingerprints have likeness 1; a
single document is its own next; an empty table gives an empty result.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.spatial import hot_keys
from .common import staged

#: In texts of two bytes a character or more: scripts without spaces give a word a character; longer runs of others are cut.
_SINGLE = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}"
DENSE_WORDS = rf"[{_SINGLE}]|[^\s{_SINGLE}]{{1,16}}"
SPACE = r"[ \n\t\r]+"
KMER, INNER, SIZE = 5, 2, 128

#: Ranges are found from so many keys each, and there are at most so many.
KEYS_A_RANGE, MOST_RANGES = 8, 65_536


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def anchors(text: Column) -> Column:
    """array<bigint>: hash * 2^32 + word number of the closed syncmers of a text in its order, else of one anchor for the whole text."""
    trimmed = F.trim(text, F.lit(" \n\t\r"))
    dense = F.regexp_extract_all(text, F.lit(DENSE_WORDS), F.lit(0))
    words = F.when(F.octet_length(text) >= 2 * F.length(text), dense).otherwise(F.split(trimmed, SPACE))
    code = lambda h, i: F.shiftleft(h.bitwiseAND(F.lit(0x7FFFFFFF)), 32) + i

    def of_words(w: Column) -> Column:
        def of_inner(s: Column) -> Column:
            at = lambda i, d: F.get(s, i + d) if d else F.get(s, i)
            edge = lambda i: F.least(at(i, 0), at(i, 3)) <= F.least(at(i, 1), at(i, 2))
            found = F.filter(F.sequence(F.lit(0), F.size(w) - KMER), edge)
            return F.transform(found, lambda i: code(F.xxhash64(at(i, 0), at(i, 2), at(i, 3)), i))

        inner = F.zip_with(w, F.slice(w, INNER, F.size(w) - 1), lambda a, b: F.xxhash64(a, b))
        found = F.when(F.size(w) >= KMER, _let(inner, of_inner))
        whole = F.when(trimmed == "", F.array().cast("array<bigint>")).otherwise(F.array(code(F.xxhash64(w), F.lit(0))))
        return _let(found, lambda f: F.when(F.size(f) > 0, f).otherwise(whole))

    return _let(words, of_words)


def sketch(text: Column, size: int = SIZE) -> Column:
    """struct<hashes, words>: the least `size` distinct anchor hashes, ascending, and the word at which each first stands."""

    def of(a: Column) -> Column:
        new = lambda x, i: (i == 0) | (F.shiftright(x, 32) > F.shiftright(F.get(a, i - 1), 32))
        return F.slice(F.filter(a, new), 1, size)

    least = _let(F.sort_array(anchors(text)), of)
    return _let(least, lambda a: F.struct(F.transform(a, lambda x: F.shiftright(x, 32)).alias("hashes"), F.transform(a, lambda x: x.bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")).alias("words")))


def fingerprint(s: Column) -> Column:
    """The hashes of a sketch as hexadecimal digits, eight a hash."""
    return F.array_join(F.transform(s["hashes"], lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def likeness(a: Column, b: Column, size: int = SIZE) -> Column:
    """Share of common anchors among the least `size` of two sketches: 0 to 1."""
    union = F.slice(F.sort_array(F.array_union(a["hashes"], b["hashes"])), 1, size)
    share = _let(union, lambda u: F.size(F.array_intersect(F.array_intersect(a["hashes"], b["hashes"]), u)) / F.size(u))
    return F.when((F.size(a["hashes"]) == 0) & (F.size(b["hashes"]) == 0), 1.0).otherwise(share)


def displacement(a: Column, b: Column) -> Column:
    """The median number of words by which the common anchors of b stand after those of a; null without any."""
    at = lambda s, x: F.get(s["words"], F.array_position(s["hashes"], x).cast("int") - 1)
    moves = F.sort_array(F.transform(F.array_intersect(a["hashes"], b["hashes"]), lambda x: at(b, x) - at(a, x)))
    return _let(moves, lambda m: F.get(m, F.floor((F.size(m) - 1) / 2).cast("int")))


def _ranges(keys: DataFrame, rows: int) -> list:
    """Keys of rows at which ranges of the order begin, ascending, without the first."""
    spark = keys.sparkSession
    volume = keys.agg(F.sum("bytes")).first()[0]
    parts = min(MOST_RANGES, rows, max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), volume >> 25))
    wanted = KEYS_A_RANGE * parts
    some = keys if rows <= wanted else keys.sample(min(1.0, wanted / rows), 7)
    found = sorted({tuple(r) for r in some.select("last", "falling", "h").collect()})  # about `wanted` rows
    return sorted({found[i * len(found) // parts] for i in range(1, parts) if found} - {found[0]} if found else set())


def compare_next(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, edited_shift of docs(doc_id, text).

    The edited text is the text with its last third replaced by as much of the next document's beginning.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.col("doc_id").isNull().alias("last"), F.coalesce(F.bitwise_not(F.col("doc_id").cast("long")), F.lit(0)).alias("falling"), F.xxhash64(text).alias("h"))
    key = ["last", "falling", "h"]
    keys = staged(rows.select(*key, F.octet_length("text").cast("long").alias("bytes")), "order-keys")
    n = keys.count()
    bounds = _ranges(keys, n) if n else []
    first = keys.agg(F.min(F.struct(*key)).alias("k")).select("k.*").first()
    of = "last boolean, falling bigint, h bigint"
    steps = F.from_json(F.lit(json.dumps([dict(zip(key, b, strict=True)) for b in bounds])), f"array<struct<{of.replace(' boolean', ':boolean').replace(' bigint', ':bigint')}>>")

    # Repeated rows of which there are many go through the order once, with their number.
    hot = F.broadcast(hot_keys(keys, key))  # under a thousand keys
    many = rows.join(hot, key, "left_semi").groupBy(*key).agg(F.any_value("doc_id").alias("doc_id"), F.any_value("text").alias("text"), F.count("*").alias("copies"))
    flow = rows.join(hot, key, "left_anti").withColumn("copies", F.lit(1).cast("long")).unionByName(many)

    own = F.struct(*key)

    def halve(s: Column, _: Column) -> Column:
        middle = F.floor((s["low"] + s["high"]) / 2).cast("int")
        right = F.struct((middle + 1).alias("low"), s["high"].alias("high"))
        return F.when(s["low"] >= s["high"], s).when(F.get(steps, middle) <= own, right).otherwise(F.struct(s["low"].alias("low"), middle.alias("high")))

    found = F.aggregate(F.sequence(F.lit(0), F.lit(max(1, len(bounds)).bit_length())), F.struct(F.lit(0).alias("low"), F.lit(len(bounds)).alias("high")), halve, lambda s: s["low"])
    flow = flow.withColumn("at", found)
    place = lambda r, guest: F.struct(r.alias("range"), F.lit(guest).alias("guest"))
    opens = F.when((F.col("at") > 0) & (F.get(steps, F.col("at") - 1) == own), F.array(place(F.col("at") - 1, True)))
    wraps = F.when(own == F.struct(*[F.lit(x).cast(t) for x, t in zip(first or (None,) * 3, ("boolean", "bigint", "bigint"), strict=True)]), F.array(place(F.lit(len(bounds)), True)))
    none = F.array().cast("array<struct<range:int,guest:boolean>>")
    places = F.concat(F.array(place(F.col("at"), False)), F.coalesce(opens, none), F.coalesce(wraps, none))
    dealt = flow.select("last", "falling", "h", "doc_id", "text", "copies", F.inline(places))
    order = Window.partitionBy("range").orderBy("guest", *key, "text")
    after = dealt.withColumn("next", F.lead("text").over(order)).withColumn("sketch", sketch(F.col("text"))).withColumn("next_sketch", F.lead("sketch").over(order)).filter("NOT guest")
    # The copies of a repeated row but the last are followed by themselves.
    follow = lambda t, s, times: F.struct(t.alias("next"), s.alias("next_sketch"), times.cast("long").alias("times"))
    once = follow(F.col("next"), F.col("next_sketch"), F.lit(1))
    pairs = F.when(F.col("copies") > 1, F.array(once, follow(F.col("text"), F.col("sketch"), F.col("copies") - 1))).otherwise(F.array(once))
    after = after.select("doc_id", "text", "sketch", F.inline(pairs))
    n_chars = F.length("text")
    third = F.floor(n_chars / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n_chars - third), F.substring(F.col("next"), F.lit(1), third))
    after = after.select("doc_id", n_chars.cast("long").alias("n_chars"), "sketch", "next_sketch", "times", edited.alias("edited"))
    after = after.select("doc_id", "n_chars", F.sha2(F.col("edited"), 256).alias("edited_sha256"), "sketch", "next_sketch", "times", sketch(F.col("edited")).alias("edited_sketch"))
    s, e = F.col("sketch"), F.col("edited_sketch")
    out = after.select("doc_id", "n_chars", "edited_sha256", fingerprint(s).alias("fingerprint"), fingerprint(e).alias("edited_fingerprint"), likeness(s, e).alias("near_edited"), likeness(s, F.col("next_sketch")).alias("near_next"), displacement(s, e).alias("edited_shift"), "times")
    return out.withColumn("_", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).drop("times", "_")
