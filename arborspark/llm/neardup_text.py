"""Text near-duplicates by order MinHash, verified by banded alignment.

Words are lower-cased runs between white space; a k-mer is five words, labelled
with its occurrence number so that repeats stay apart.

1. Every text gives a content key and its sketches: each sketch takes the
   `length` least labelled k-mers under its own hash and keeps their text order,
   so it agrees with the edit similarity and not only with shared content.
   Texts of few k-mers also get single-k-mer sketches.
2. Texts with equal keys (two 64-bit hashes) collapse to one.  Texts that share a sketch are
   candidates of the most popular text in it (the one that meets most others),
   never of each other.
3. A candidate pair is verified by aligning its labelled k-mers: matches off the
   diagonal by more than the threshold allows are cut, and the longest chain in
   order counts.  aligned / (a + b - aligned) >= threshold makes a link.
4. Links make components; then texts that share a sketch but stand in different
   components are verified too, so that a text unlike the popular one keeps its
   links to others: small buckets as pairs, large ones in cells of two blocks,
   inside a task, returning only links that join components.

No step holds a bucket or a class in one task: buckets are aggregated or cut,
stars are salted, and joins run on written tables that Spark can split.

Defined cases: texts without words (null, empty, white space) are alone in their
class; texts of fewer than five words are near-duplicates only if equal; repeated
rows are copies; class_id is the least doc_id of the class (null ids last); a key
is 128 bits, so two of n texts share one by chance with probability n^2 / 2^129.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..operators.spatial import components, hot_join, hot_keys
from .common import bounded_batches, discard, release_memory, staged

K = 5
_MIX = np.uint64(0x9E3779B97F4A7C15)
_AT_ONCE = 1 << 20


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(29))
    return x


_rng = np.random.default_rng(20)
_POWERS = _rng.integers(1, 2**63, 1 << 12, dtype=np.uint64) | np.uint64(1)
_SEEDS = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash of every word; words are cut at ASCII white space."""
    if not text:
        return np.zeros(0, np.uint64)
    b = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8)
    gap = (b == 32) | ((b >= 9) & (b <= 13))
    inside = ~gap
    starts = np.flatnonzero(inside & np.concatenate([[True], gap[:-1]]))
    if not len(starts):
        return np.zeros(0, np.uint64)
    at = np.flatnonzero(inside)
    values = b[at].astype(np.uint64) + np.uint64(1)
    first = np.searchsorted(at, starts)
    sizes = np.diff(np.append(first, len(at)))
    place = np.arange(len(at)) - np.repeat(first, sizes)
    values = values * _POWERS[place & 4095] * (np.uint64(1) + np.uint64(2) * (place >> 12).astype(np.uint64))
    return _mixed(np.add.reduceat(values, first) + sizes.astype(np.uint64) * _MIX)


def content_key(words: np.ndarray) -> tuple[int, int]:
    """Two 64-bit hashes of the words in order."""
    place = np.arange(len(words), dtype=np.uint64) * _MIX + np.uint64(1)
    one = _mixed(words + place)
    two = _mixed(words * np.uint64(0xD6E8FEB86659FD93) ^ _mixed(place))
    k1, k2 = _mixed(np.array([np.add.reduce(one), np.add.reduce(two)], np.uint64)).view(np.int64)
    return int(k1), int(k2)


def _key_columns(keys: list[tuple[int, int] | None]) -> list[pa.Array]:
    return [pa.array([k and k[i] for k in keys], pa.int64()) for i in range(2)]


def labelled_kmers(words: np.ndarray) -> np.ndarray:
    """One hash for each k-mer and its occurrence number; a shorter text is one k-mer."""
    n = max(1, len(words) - K + 1)
    x = np.zeros(n, np.uint64)
    for i in range(min(K, len(words))):
        x = x * np.uint64(0xD6E8FEB86659FD93) + words[i : i + n]
    x = _mixed(x + np.uint64(min(K, len(words))))
    order = np.argsort(x, kind="stable")
    s = x[order]
    new = np.concatenate([[True], s[1:] != s[:-1]])
    if new.all():
        return x
    at = np.arange(n)
    label = np.empty(n, np.uint64)
    label[order] = (at - np.maximum.accumulate(np.where(new, at, 0))).astype(np.uint64)
    return _mixed(x + label * _MIX)


def sketches(x: np.ndarray, length: int, count: int, short: int, short_count: int) -> np.ndarray:
    """Order MinHash sketches of labelled k-mers, as signed 64-bit bucket names; of a long text, a few seeds at a time."""

    def of(length: int, seeds: np.ndarray, salt: int) -> np.ndarray:
        some = max(1, _AT_ONCE // len(x))
        return np.concatenate([at_once(length, seeds[at : at + some], salt) for at in range(0, len(seeds), some)])

    def at_once(length: int, seeds: np.ndarray, salt: int) -> np.ndarray:
        h = x[None, :] * seeds[:, None]
        h ^= h >> np.uint64(32)
        least = np.argpartition(h, length - 1, axis=1)[:, :length] if length < h.shape[1] else np.broadcast_to(np.arange(h.shape[1]), h.shape)
        least = np.sort(least, axis=1)  # text order
        out = np.full(len(seeds), np.uint64(salt)) * _MIX + seeds
        for i in range(least.shape[1]):
            out = _mixed(out * np.uint64(0xD6E8FEB86659FD93) + x[least[:, i]])
        return out

    found = of(length, _SEEDS[:count], 1)
    if len(x) <= short:
        found = np.concatenate([found, of(1, _SEEDS[count : count + short_count], 2)])
    return found.view(np.int64)


def similarity(a: np.ndarray, b: np.ndarray, threshold: float) -> float:
    """Aligned share of two texts' labelled k-mers (0 if the threshold is out of reach)."""
    total = len(a) + len(b)
    if min(len(a), len(b)) < threshold * max(len(a), len(b)):
        return 0.0
    _, i, j = np.intersect1d(a, b, assume_unique=False, return_indices=True)
    need = threshold * total / (1 + threshold)
    band = total - 2 * need  # unmatched k-mers of both sides, at most
    near = np.abs(i - j) <= band + 1e-9
    i, j = i[near], j[near]
    if len(i) < need - 1e-9:
        return 0.0
    j = j[np.argsort(i)]
    if len(j) > 1 and not (j[1:] > j[:-1]).all():
        tails: list[int] = []
        for v in j.tolist():
            at = bisect_left(tails, v)
            tails[at : at + 1] = [v]
        aligned = len(tails)
    else:
        aligned = len(j)
    return aligned / (total - aligned)


def sketch_documents(docs: DataFrame, length: int, count: int, short: int, short_count: int) -> DataFrame:
    """doc_id, k1, k2, n, bands of docs(doc_id, text); k1 and k2 are null for a text without words."""
    bounded_batches(docs.sparkSession)
    schema = "doc_id long, k1 long, k2 long, n int, bands array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sizes, bands = [], [], []
            for text in batch.column(1):
                w = word_hashes(text.as_py())
                x = labelled_kmers(w) if len(w) else None
                keys.append(content_key(w) if len(w) else None)
                sizes.append(len(x) if len(w) else 0)
                bands.append(sketches(x, length, count, short, short_count) if len(w) else [])
            pa.default_memory_pool().release_unused()
            columns = [batch.column(0), *_key_columns(keys), pa.array(sizes, pa.int32()), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "k1", "k2", "n", "bands"])
        release_memory()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def with_key(docs: DataFrame) -> DataFrame:
    """docs (text last) with the content key of the text added: _k1, _k2."""
    bounded_batches(docs.sparkSession)
    schema = StructType([*docs.schema.fields, StructField("_k1", LongType()), StructField("_k2", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = (word_hashes(t.as_py()) for t in batch.column(batch.num_columns - 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, *_key_columns([content_key(w) if len(w) else None for w in words])], names=[f.name for f in schema])
        release_memory()

    return docs.mapInArrow(run, schema)


def kmers_of(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """key, kmers (32 bits each) of the chosen (key, k1, k2, lead, rows) texts; one row a text, though `rows` rows may hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, out = [], []
            for text in batch.column(1):
                w = word_hashes(text.as_py())
                keys.append(content_key(w) if len(w) else None)
                out.append((labelled_kmers(w) >> np.uint64(32)).astype("<u4").tobytes() if len(w) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), *_key_columns(keys), pa.array(out, pa.binary())], names=["doc_id", "k1", "k2", "kmers"])
        release_memory()

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, k1 long, k2 long, kmers binary")
    same = (rows.k1 == chosen.k1) & (rows.k2 == chosen.k2) & rows.doc_id.eqNullSafe(chosen.lead)
    found = staged(rows.join(chosen, same).select("key", "rows", "kmers"), "kmers-of-rows")
    once = found.filter("rows > 1").groupBy("key").agg(F.first("kmers").alias("kmers"))
    return found.filter("rows = 1").select("key", "kmers").unionByName(once)


def verify(pairs: DataFrame, kmers: DataFrame, threshold: float, star: int = 256) -> DataFrame:
    """The pairs(a, b) whose texts reach the threshold.  Stars around b are dealt into salts of about `star` pairs."""
    sizes = staged(pairs.groupBy("b").agg(F.ceil(F.count("*") / star).cast("int").alias("salts")), "stars")
    dealt = pairs.join(sizes, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("salts").cast("long")).cast("int").alias("salt"))
    leaves = dealt.join(kmers.withColumnRenamed("key", "a"), "a").select("b", "salt", F.lit(1).alias("leaf"), "a", "kmers")
    centres = sizes.join(kmers.withColumnRenamed("key", "b"), "b").select("b", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("leaf"), F.lit(None).cast("long").alias("a"), "kmers")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre = np.zeros(0, "<u4")
        for batch in batches:
            a, b = [], []
            for to, leaf, who, data in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4), strict=True):
                x = np.frombuffer(data.as_buffer(), "<u4")
                if not leaf:
                    centre = x
                elif similarity(x, centre, threshold) >= threshold:
                    a.append(who)
                    b.append(to)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
        release_memory()

    met = centres.unionByName(leaves).repartition("b", "salt").sortWithinPartitions("b", "salt", "leaf")
    return met.mapInArrow(run, "a long, b long")


def cell_links(component: np.ndarray, turn: np.ndarray, texts: list[np.ndarray], threshold: float) -> list[tuple[int, int]]:
    """Pairs (positions) that join the components of a cell: each at or over the threshold, between its two blocks.

    Overlaps of all texts come from one incidence matrix, a few thousand k-mers
    at a time; only pairs whose overlap could reach the threshold are aligned.
    """
    n = np.array([len(t) for t in texts])
    words, inverse, count = np.unique(np.concatenate(texts), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(texts)), n)
    common = count > 1
    name = np.cumsum(common) - 1
    keep = common[inverse]
    order = np.argsort(name[inverse[keep]], kind="stable")
    column, owner = name[inverse[keep]][order], owner[keep][order]
    overlap = np.zeros((len(texts), len(texts)), np.float32)
    width = 4096
    for at in range(0, int(common.sum()), width):
        i, j = np.searchsorted(column, [at, at + width])
        part = np.zeros((len(texts), width), np.float32)
        part[owner[i:j], column[i:j] - at] = 1
        overlap += part @ part.T
    both = n[:, None] + n[None, :]
    apart = component[:, None] != component[None, :]
    if turn.any() and not turn.all():
        apart &= turn[:, None] != turn[None, :]
    found: list[tuple[int, int]] = []
    parent = {c: c for c in component.tolist()}

    def top(c: int) -> int:
        while parent[c] != c:
            parent[c] = c = parent[parent[c]]
        return c

    for i, j in zip(*np.nonzero(np.triu(apart & (overlap >= threshold * both / (1 + threshold) - 1e-3), 1)), strict=True):
        a, b = top(int(component[i])), top(int(component[j]))
        if a != b and similarity(texts[i], texts[j], threshold) >= threshold:
            parent[a] = b
            found.append((i, j))
    return found


def verify_cells(members: DataFrame, kmers: DataFrame, threshold: float, block: int = 256, block_kmers: int = 1 << 20) -> DataFrame:
    """Links (a, b) that join components within the buckets of members(band, size, total, key, component).

    A bucket is cut into blocks, of about `block` texts and `block_kmers` k-mers
    at most, and every pair of its blocks is one cell, so a bucket with a large
    part of all texts is many tasks; no pairs are written but the links found.
    """
    blocks = F.ceil(F.greatest(F.col("size") / block, F.col("total") / block_kmers)).cast("int")
    own = F.pmod(F.xxhash64("key"), blocks.cast("long")).cast("int")
    rows = members.select("band", "key", "component", blocks.alias("blocks"), own.alias("own"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("band", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), (F.col("own") > F.col("other")).alias("turn"), "key", "component").join(kmers, "key")

    def meet(table: pa.Table) -> pa.Table:
        texts = [np.frombuffer(k.as_buffer(), "<u4") for k in table.column("kmers")]
        turn = np.array(table.column("turn").to_pylist(), bool)
        keys = table.column("key").to_pylist()
        links = cell_links(table.column("component").to_numpy(), turn, texts, threshold)
        return pa.table({"a": pa.array([keys[i] for i, _ in links], pa.int64()), "b": pa.array([keys[j] for _, j in links], pa.int64())})

    return rows.groupBy("band", "x", "y").applyInArrow(meet, "a long, b long")


def near_duplicates(docs: DataFrame, *, threshold: float = 0.8, length: int = 4, count: int = 18, short: int = 25, short_count: int = 8, small: int = 8) -> tuple[DataFrame, DataFrame]:
    """(documents, texts): doc_id, k1, k2 of every row, and k1, k2, lead, copies, class_id, component of every distinct text with words.

    component names one class only; class_id may name several, if ids are null or repeated.
    """
    rows = staged(sketch_documents(docs, length, count, short, short_count), "sketches")
    own = F.struct(F.col("doc_id").isNull(), "doc_id")
    texts = rows.filter("k1 IS NOT NULL").groupBy("k1", "k2", "doc_id").agg(F.count("*").alias("rows"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    texts = texts.groupBy("k1", "k2").agg(F.min(own).alias("own"), F.min_by("rows", own).alias("rows"), F.sum("rows").alias("copies"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    texts = staged(texts.select(F.monotonically_increasing_id().alias("key"), "k1", "k2", F.col("own.doc_id").alias("lead"), "rows", "copies", "n", "bands"), "texts")

    bands = texts.select("key", "n", F.explode("bands").alias("band"))
    shared = bands.groupBy("band").agg(F.count("*").alias("size"), F.sum("n").alias("total")).filter("size > 1")
    members = staged(bands.join(shared, "band"), "members")
    popular = staged(members.groupBy("key").agg(F.sum("size").alias("meets")), "popular")
    ranked = members.join(popular, "key")
    centres = staged(ranked.groupBy("band").agg(F.max(F.struct("meets", "key", "n")).alias("c")).select("band", F.col("c.key").alias("centre"), F.col("c.n").alias("centre_n")), "centres")

    fits = lambda a, b: F.least(a, b) >= threshold * F.greatest(a, b)
    stars = members.join(centres, "band").filter((F.col("key") != F.col("centre")) & fits(F.col("n"), F.col("centre_n")))
    pairs = staged(stars.select(F.least("key", "centre").alias("lo"), F.greatest("key", "centre").alias("hi"), F.col("key").alias("a"), F.col("centre").alias("b")).dropDuplicates(["lo", "hi"]), "pairs")
    kmers = staged(kmers_of(docs, texts.join(popular.select("key"), "key", "left_semi").select("key", "k1", "k2", "lead", "rows")), "kmers")
    links = staged(verify(pairs.select("a", "b"), kmers, threshold), "verified")
    found = components(links, keys=())

    # What a star left apart: small buckets as pairs, a bounded number a text; large ones in cells.
    placed = members.join(found.withColumnRenamed("node", "key"), "key", "left").select("band", "size", "total", "key", "n", F.coalesce("component", "key").alias("component"))
    placed = staged(placed, "placed")
    split = placed.groupBy("band").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y").select("band")
    left = staged(placed.join(split, "band"), "open")
    few = left.filter(F.col("size") <= small)
    right = few.select("band", F.col("key").alias("key_b"), F.col("n").alias("n_b"), F.col("component").alias("component_b"))
    across = few.join(right, "band").filter((F.col("component") < F.col("component_b")) & fits(F.col("n"), F.col("n_b")))
    across = across.select(F.least("key", "key_b").alias("lo"), F.greatest("key", "key_b").alias("hi")).distinct()
    rest = staged(across.join(pairs.select("lo", "hi"), ["lo", "hi"], "left_anti").select(F.col("lo").alias("a"), F.col("hi").alias("b")), "rest")
    both = links.unionByName(verify(rest, kmers, threshold)).unionByName(verify_cells(left.filter(F.col("size") > small), kmers, threshold))
    found = components(both, keys=()).withColumnRenamed("node", "key")

    joined = staged(texts.select("key", "k1", "k2", "lead", "copies").join(found, "key", "left").withColumn("component", F.coalesce("component", "key")), "joined")
    classes = joined.groupBy("component").agg(F.min("lead").alias("class_id"))
    out = staged(hot_join(joined, classes, ["component"], hot_keys(joined, ["component"])).select("k1", "k2", "lead", "copies", "class_id", "component"), "text-classes")
    discard(texts, members, popular, centres, pairs, kmers, links, placed, left, rest, joined)
    return rows.select("doc_id", "k1", "k2"), out


def classify(docs: DataFrame, **parameters) -> DataFrame:
    """doc_id, class_id, kept for every row of docs(doc_id, text)."""
    rows, texts = near_duplicates(docs, **parameters)
    classes = texts.select("k1", "k2", "class_id")
    hot = texts.join(F.broadcast(texts.agg((F.sum("copies") / 1000).alias("least"))), F.col("copies") > F.col("least")).select("k1", "k2")  # under 1000
    worded = hot_join(rows.filter("k1 IS NOT NULL"), classes, ["k1", "k2"], hot).select("doc_id", "class_id")
    alone = rows.filter("k1 IS NULL").select("doc_id", F.col("doc_id").alias("class_id"))
    return worded.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("class_id")))
