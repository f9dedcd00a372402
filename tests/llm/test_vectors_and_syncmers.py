"""Hard negatives, centroid clusters and fingerprints: kernels, defined cases, brute force."""

import hashlib
from collections import Counter

import numpy as np
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from arborspark.llm import centroids, hardnegatives, queries, syncmers

VECTORS = "vec_id long, embedding array<float>, label int, rank string, x string, part int, v string"


@pytest.mark.parametrize("shape", [(1, 1, 1), (7, 64, 33), (64, 64, 64), (65, 63, 70), (40, 3, 200), (0, 8, 8)])
def test_strassen_is_exact(shape):
    rng = np.random.default_rng(sum(shape))
    m, k, n = shape
    a, b = rng.integers(-(2**28), 2**28, (m, k)), rng.integers(-(2**28), 2**28, (k, n))
    assert (hardnegatives.strassen(a, b, 4) == a @ b).all()


def test_heaps_merge_in_any_order():
    rng = np.random.default_rng(3)
    score, ids = rng.integers(-4, 4, (5, 60)), np.argsort(rng.random((5, 60)), axis=1)
    want = [sorted(zip((-s).tolist(), i.tolist(), strict=True))[:6] for s, i in zip(score, ids, strict=True)]
    best, who = np.full((5, 6), np.iinfo(np.int64).min), np.zeros((5, 6), np.int64)
    for part in (slice(40, 60), slice(0, 25), slice(25, 40)):
        best, who = hardnegatives.merged(best, who, score[:, part], ids[:, part], 6)
    assert [[(-s, i) for s, i in zip(b.tolist(), w.tolist(), strict=True)] for b, w in zip(best, who, strict=True)] == want


def test_shares_round_towards_the_window():
    s = np.array([0, 1, 3, 10, 101, 2**62])
    assert hardnegatives.share(s, 30, True).tolist() == [-(-30 * int(x) // 100) for x in s]
    assert hardnegatives.share(s, 90, False).tolist() == [90 * int(x) // 100 for x in s]


def _mined(rows, every, scale=256):
    """Every window of every anchor, one pair at a time."""
    good = [(i, tuple(int(np.floor(scale * np.float64(np.float32(x)))) for x in e), c) for i, e, c, *_ in rows if i is not None and c is not None and e and all(x is not None and np.isfinite(x) for x in e)]
    anchors = {}
    for i, e, c in good:
        if i % every == 0:
            anchors[i] = min(anchors.get(i, (c, e)), (c, e))
    out = Counter()
    for a, (label, e) in anchors.items():
        scored = sorted((-sum(p * q for p, q in zip(e, f, strict=True)), i, c) for i, f, c in good if i != a and len(f) == len(e))
        for ps, p, _ in [s for s in scored if s[2] == label][:5]:
            inside = [(s, i) for s, i, c in scored if c != label and 30 * -ps <= 100 * -s <= 90 * -ps][:10]
            out.update((a, p, rank + 1, n, -ps, -ns) for rank, (ns, n) in enumerate(inside))
    return out


@pytest.mark.parametrize("block", [3, 2048])
def test_hard_negative_cases(spark, block):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 5) / 4], int(rng.integers(0, 3))) for i in range(90)]
    rows += [(10, [0.5] * 5, 1), (10, [0.25] * 5, 1), (11, [0.5] * 5, 1), (11, [0.5] * 5, 1)]  # repeated ids and rows
    rows += [(20, None, 1), (30, [1.0, None, 1.0, 1.0, 1.0], 1), (40, [float("nan")] * 5, 0), (50, [float("inf")] * 5, 0), (None, [0.5] * 5, 1), (60, [0.5] * 5, None), (70, [], 1), (80, [0.5] * 3, 2), (81, [0.5] * 3, 2), (82, [0.25] * 3, 0)]
    rows += [(200 + i, [0.5, 0.25, 0.5, 0.25, 0.5], 0) for i in range(60)]  # a hot label, all ties
    df = spark.createDataFrame([(*r, "r", "x", 1, "v") for r in rows], VECTORS)
    got = hardnegatives.mine(df, every=10, block=block, anchor_block=2 if block == 3 else 512)
    assert Counter(tuple(r) for r in got.collect()) == _mined(rows, 10)
    assert hardnegatives.mine(df.limit(0)).count() == 0


def _clustered(x, starts, rounds):
    """k-means with plain Python integers."""
    c = [list(s) for s in starts]
    near = lambda v: min((sum((p - q) ** 2 for p, q in zip(v, m, strict=True)), i) for i, m in enumerate(c))
    for _ in range(rounds):
        own = [near(v)[1] for v in x]
        for i in range(len(c)):
            part = [v for v, o in zip(x, own, strict=True) if o == i]
            if part:
                c[i] = [sum(column) // len(part) for column in zip(*part, strict=True)]
    return [near(v) for v in x], c


def test_centroid_cases(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.integers(-9, 9, 4) / 16]) for i in range(40)]
    rows += [(40, [50_000.0, -3.0, 2.0, 1e4]), (41, [0.5] * 4), (41, [0.5] * 4), (None, [0.25] * 4)]
    bad = [(50, None), (51, [0.5] * 3), (52, [0.5, None, 0.5, 0.5]), (53, [float("nan")] * 4), (54, [])]
    df = spark.createDataFrame([(*r, 1, "r", "x", 1, "v") for r in rows + bad], VECTORS)
    x = [tuple(int(np.floor(64 * np.float64(np.float32(v)))) for v in e) for _, e in rows]
    order = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest() if i is not None else "~", e) for (i, _), e in zip(rows, x, strict=True))
    for k in (6, 100):
        found, c = _clustered(x, [e for _, e in order[:k]], 3)
        sums = Counter()
        for d, o in found:
            sums[o] += d
        digest = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in c]
        want = Counter((i, o, d, sums[o], sum(sums.values()), digest[o]) for (i, _), (d, o) in zip(rows, found, strict=True))
        assert Counter(tuple(r) for r in centroids.cluster(df, k=k, dim=4).collect()) == want
    assert centroids.cluster(df.limit(0)).count() == 0 and centroids.cluster(df.limit(0)).columns == centroids.cluster(df, dim=4).columns


def test_nearest_tabulates_many_values():
    rng = np.random.default_rng(4)
    x, c = rng.integers(-(2**26), 2**26, (300, 64)), rng.integers(-(2**26), 2**26, (5, 64))
    full = ((x[:, None, :] - c[None]) ** 2).sum(axis=2)
    own, distance = centroids.nearest(x, c, slab=16)
    assert (own == full.argmin(axis=1)).all() and (distance == full.min(axis=1)).all()


def _hash(parts, seed=42):
    for p in parts:
        seed = xxhash.xxh64_intdigest(p.encode() if isinstance(p, str) else (p % 2**64).to_bytes(8, "little"), seed)
    return seed if seed < 2**63 else seed - 2**64


def _sketch(text, size=syncmers.SIZE):
    """Least hash -> first word, by looking at every window of every text."""
    text = text or ""
    if len(text.encode()) >= 2 * len(text):
        words = [m.group() for m in regex.finditer(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}]|[^\s\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}]{1,16}", text)] or ([] if not text.strip(" \n\t\r") else [text])
    else:
        words = regex.split(r"[ \n\t\r]+", text.strip(" \n\t\r"))
    if not text.strip(" \n\t\r"):
        return {}
    first = {}
    for i in range(len(words) - 4):
        inner = [_hash(words[j : j + 2]) for j in range(i, i + 4)]
        if min(inner) in (inner[0], inner[3]):
            first.setdefault(_hash([inner[0], inner[2], inner[3]]) & 0x7FFFFFFF, i)
    if not first:
        first = {_hash(words) & 0x7FFFFFFF: 0}
    return dict(sorted(first.items())[:size])


def _likeness(a, b, size=syncmers.SIZE):
    if not a and not b:
        return 1.0
    union = sorted({*a, *b})[:size]
    return sum(h in a and h in b for h in union) / len(union)


def _compared(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, 0 if r[0] is None else -r[0], _hash([r[1] or ""])))
    out = []
    for (i, t), (_, n) in zip(order, [*order[1:], order[0]] if order else [], strict=True):
        t, n = t or "", n or ""
        cut = len(t) // 3
        edited = t[: len(t) - cut] + n[:cut]
        s, e = _sketch(t), _sketch(edited)
        digits = lambda s: "".join(f"{h:08x}" for h in s)
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), digits(s), digits(e), round(_likeness(s, e), 9), round(_likeness(s, _sketch(n)), 9)))
    return Counter(out)


def _rows(df):
    return Counter((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in df.collect())


def test_fingerprints_of_the_table(spark, data):
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    assert _rows(queries.op13_document_fingerprints(spark, data)) == _compared(rows)


def test_fingerprint_cases(spark):
    words = [f"w{i * 7919 % 1000}" for i in range(900)]
    rows = [(1, None), (2, ""), (3, " \n "), (4, "one two"), (5, " ".join(words)), (6, " ".join(words)), (7, "a a a a a a a a a"), (-8, "ß É 日本 x"), (9, "日本語の文章" * 9), (10, "one\ttwo  three\nfour five six seven")]
    rows += [(None, f"no id {i} at all in here {i}") for i in range(40)] + [(11, "same row again and again and again")] * 30 + [(12, "word " * 60_000)]
    clash = "doc_id long, text string, h string, falling int, `last` int, `at` int, `range` string, copies int, sketch string, `next` string, times int, guest int"
    df = spark.createDataFrame([(*r, "h", 1, 2, 3, "r", 4, "s", "n", 5, 6) for r in rows], clash)
    assert _rows(syncmers.compare_next(df)) == _compared(rows)
    assert syncmers.compare_next(df.limit(0)).count() == 0
    assert [r.near_next for r in syncmers.compare_next(df.filter("doc_id = 5")).collect()] == [1.0]


def test_repeated_rows_are_counted_first(spark, monkeypatch):
    rows = [(i, f"text number {i} of some more words {i}") for i in range(2000)] + [(5, "always the same row of seven words")] * 700
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert _rows(syncmers.compare_next(df)) == _compared(rows)


def test_shared_passages_keep_their_anchors_and_their_distance(spark):
    passage = " ".join(f"p{i * 31 % 97}q" for i in range(60))
    rows = spark.createDataFrame([(passage + " and then the end", "ten more words stand here before it, so it moves " + passage)], "a string, b string")
    s = rows.select(syncmers.sketch(F.col("a")).alias("a"), syncmers.sketch(F.col("b")).alias("b"))
    r = s.select(syncmers.likeness(F.col("a"), F.col("b")).alias("like"), syncmers.displacement(F.col("a"), F.col("b")).alias("moved")).first()
    assert r.like > 0.6 and r.moved == 10
