"""Every operator on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, and against brute force."""

import functools
import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from arborspark.llm import html, mixing, neardup_text, neardup_vectors, packing, quality, queries, tokenfiles, topk, toxicity, urls
from arborspark.llm.common import new_path
from tests.compare import assert_same, duck

DOCS = "doc_id long, text string, source string, size int, score string, `key` int, bands string"
PAGES = "page_id long, url string, html string, host string, verdict int"
VECTORS = "vec_id long, embedding array<float>, rank int, rep string, v string"
LONG = "word " * 30_000


@pytest.fixture(scope="module")
def docs(spark):
    rows = [
        (1, "alpha beta gamma", "b"), (2, None, "b"), (3, "", None), (4, " \n ", "a"), (5, LONG, "a"), (6, "alpha beta gamma", None),
        (6, "alpha beta gamma", None), (None, "no id here at all", "c"), (7, "ß É 日本 <|endoftext|>", "c"), (8, LONG, "a"), (9, "x", "z"),
    ]
    return spark.createDataFrame([(*r, 1, "s", 2, "b") for r in rows], DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@functools.cache
def tokenizer(name):
    return Tokenizer.from_file(queries.vocabulary(name))


def ids_of(name, text):
    return [*tokenizer(name).encode(text or "", add_special_tokens=False).ids, 2]


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_oracle(spark, data, name):
    assert_same(queries.queries()[name](spark, data), duck(data), queries.oracle_sql()[name])


def test_every_operator_has_its_query():
    assert [q.split("_")[0] for q in queries.queries()] == [f"op{n}" for n in range(1, 14)]


def test_html_cases(spark):
    page = "<article><p>A &amp; b</p></article>"
    rows = [(1, None, page, "h", 1), (2, "u", None, None, 2), (2, "u", None, None, 2), (3, "u", "", None, 3), (None, "u", page, None, 4)]
    got = html.extract(spark.createDataFrame(rows, PAGES)).collect()
    assert Counter((r.page_id, r.text, r.n_chars) for r in got) == Counter([(1, "A & b", 5), (2, "", 0), (2, "", 0), (3, "", 0), (None, "A & b", 5)])
    assert html.extract(spark.createDataFrame([], PAGES)).count() == 0


def test_packing_cases(spark, docs, none):
    rows = packing.pack(docs, queries.vocabulary("word_bpe_49k.json"), sequence=1024, group_tokens=5000).collect()
    expected = Counter((r.doc_id, zlib.crc32(np.array(ids_of("word_bpe_49k.json", r.text), "<u4").tobytes())) for r in docs.collect())
    by_sequence = {}
    for r in rows:
        assert len(r.ids) == 4 * r.length
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in by_sequence.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end == 1024 or end & (end - 1) == 0
    whole = Counter((r.doc_id, zlib.crc32(r.ids)) for r in rows if r.length == r.doc_tokens)
    assert all(expected[k] >= n for k, n in whole.items())
    assert sum(r.length for r in rows) == sum(len(ids_of("word_bpe_49k.json", r.text)) for r in docs.collect())
    assert packing.pack(none, queries.vocabulary("word_bpe_49k.json")).count() == 0


def test_token_file_cases(spark, docs, none):
    path = queries.vocabulary("byte_bpe_50k.json")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)  # so that tasks begin new files
    try:
        got = tokenfiles.encode_and_read(docs, path, new_path(spark, "test"), file_ids=4).orderBy("start").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    start = 0
    for g, w in zip(got, want, strict=True):
        ids = ids_of("byte_bpe_50k.json", w.text)
        assert (g.doc_id, g.start, g.n_tokens) == (w.doc_id, start, len(ids))
        assert g.ids == np.array(ids, "<u4").tobytes()
        start += len(ids)
    assert tokenfiles.encode_and_read(none, path, new_path(spark, "test")).count() == 0


def test_packing_of_the_table(spark, data):
    """Every piece of the query holds the ids that it names, and every id lies in one piece."""
    texts = {r.doc_id: ids_of("word_bpe_49k.json", r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    pieces = sorted(map(tuple, queries.op2_packing(spark, data).collect()))
    until = Counter()
    for doc_id, start, length, crc, doc_tokens, _, _ in pieces:
        ids = texts[doc_id]
        assert start == until[doc_id] and doc_tokens == len(ids)
        assert crc == zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes())
        until[doc_id] += length
    assert until == {k: len(v) for k, v in texts.items()}


def test_token_files_of_one_repeated_row(spark):
    rows = [(5, "the same row")] * 3000 + [(i, f"another {i}") for i in range(10)] + [(None, "no id")] * 20
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = tokenfiles.encode_and_read(docs, queries.vocabulary("byte_bpe_50k.json"), new_path(spark, "test")).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda i: -1 if i is None else i)
    assert all(b.start == a.start + a.n_tokens for a, b in itertools.pairwise(got))


def test_token_files_of_the_table(spark, data):
    rows = spark.read.parquet(f"{data}/documents.parquet").orderBy("doc_id").collect()
    got = queries.op7_token_files(spark, data).orderBy("doc_id").collect()
    start = 0
    for g, w in zip(got, rows, strict=True):
        ids = ids_of("byte_bpe_50k.json", w.text)
        assert tuple(g) == (w.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def labelled(spark):
    good = [(i, f"The town by river {i} was small and it had many old houses. People of the town were kind.", 1, 0) for i in range(60)]
    bad = [(100 + i, f"BUY!! {i} $$$ ### NOW!! %%% *** &&& {i}", 0, 0) for i in range(60)]
    mean = [(200 + i, f"The town by river {i} was small and you are a scumbag and it had many old houses.", 1, 1) for i in range(40)]
    rows = good + bad + mean
    return spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2], r[3]) for r in rows], "doc_id long, quality int, toxic int")


def test_quality_learns_and_covers_odd_texts(spark, docs, none):
    train, labels = labelled(spark)
    odd = docs.select(F.col("doc_id") + 1000, "text").toDF("doc_id", "text")
    both = train.unionByName(odd)
    got = quality.score_quality(both, labels).select("doc.doc_id", "held_out", "score", "predicted").collect()
    assert len(got) == both.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    truth = {r.doc_id: r.quality for r in labels.collect()}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    assert quality.score_quality(none, labels).count() == 0
    blind = quality.score_quality(train, labels.limit(0)).select("score").distinct().collect()
    assert [r.score for r in blind] == [0.5]


def test_tree_paths_read_the_public_form():
    debug = "RandomForest\n  Tree 0 (weight 1.0):\n    If (feature 2 <= 0.5)\n     If (feature 0 <= 1.0)\n      Predict: 0.0\n     Else (feature 0 > 1.0)\n      Predict: 1.0\n    Else (feature 2 > 0.5)\n     Predict: 1.0\n"
    assert quality.tree_paths(debug) == [(("2", True, 0.5),), (("0", True, 1.0), ("2", True, 0.5)), (("0", False, 1.0), ("2", True, 0.5)), (("2", False, 0.5),)]


def test_learnable_rows_are_bounded_though_ids_repeat(spark):
    _, labels = labelled(spark)
    docs = spark.range(30_000).select((F.col("id") % 20).alias("doc_id"), F.xxhash64("id").alias("hash"), F.col("id").cast("string").alias("text"))
    chosen = quality.sampled_labels(labels.unionByName(labels), "quality", 1000)
    assert chosen.count() == chosen.select("doc_id").distinct().count()
    rows = quality.learnable(docs.unionByName(docs), chosen, 500, "test").collect()
    assert 800 <= len(rows) <= 1200 and len({r.text for r in rows}) == len(rows)


def test_statistics_of_the_table(spark, data):
    """Every statistic of every whole text, counted again in Python."""
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(-1, None), (-2, ""), (-3, " \n "), (-4, LONG)], docs.schema))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in quality.with_statistics(docs)[0].collect():
        t = texts[r.doc_id]
        words = [w for w in regex.split(r"[\x20\x09-\x0D]+", t) if w]
        lines = [x for x in t.split("\n") if x]
        count = lambda pattern: len(regex.findall(pattern, t))  # noqa: B023, E731
        of = lambda top, bottom: top / bottom if bottom else 0.0
        want = {
            "log_words": math.log1p(len(words)), "word_length": of(len(t), len(words)), "distinct_words": of(len(set(words)), len(words)), "distinct_lines": of(len(set(lines)), len(lines)),
            "words_per_line": of(len(words), len(lines)), "marks": of(count(r"[^\p{L}\p{N} \t\n\x0B\f\r]"), len(t)), "odd_marks": of(sum(t.count(c) for c in "#$%&*|<>{}[]\\^~_=+@"), len(t)),
            "loud_marks": of(t.count("!") + t.count("?"), len(t)), "capitals": of(count(r"\p{Lu}"), len(t)), "digits": of(count(r"\p{N}"), len(t)),
        }
        assert all(r[f"stat_{k}"] == pytest.approx(v, abs=1e-12) for k, v in want.items()), r.doc_id


def test_rules_compile_to_their_score(spark):
    rows = [(0.1, 5.0), (0.9, 5.0), (0.5, 1.0), (float("0"), 9.0)]
    rules = [((("0", True, 0.5), ("1", False, 2.0)), 1.25), ((("1", True, 5.0),), -0.5), ((("0", False, 0.0), ("0", True, 0.9)), 2.0)]
    got = spark.createDataFrame(rows, "a double, b double").select(quality.rule_score(-0.3, rules, ["a", "b"])).collect()
    for r, (score,) in zip(rows, got, strict=True):
        total = -0.3 + sum(w for rule, w in rules if all(r[int(f)] <= x if below else r[int(f)] > x for f, below, x in rule))
        assert score == pytest.approx(1 / (1 + math.exp(-total)))


def test_evidence_of_the_table(spark, data):
    """Every document's evidence with its task's memo, against one word at a time without any."""
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    lexicon = toxicity.Lexicon(frozenset({"idiot", "scum", "worthless", "there"}), frozenset({"moro"}), frozenset({"these"}))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in toxicity.with_evidence(docs, lexicon).collect():
        assert tuple(r)[1:] == toxicity.evidence(texts[r.doc_id], lexicon, {})


def test_hits_of_the_table_by_edit_distance(spark, data):
    """Every word of the table against the terms, one pair at a time."""

    def distance(a, b):
        d = {(i, j): max(i, j) for i in range(len(a) + 1) for j in range(len(b) + 1) if not i or not j}
        for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
        return d[len(a), len(b)]

    words, stems, exceptions = {"there", "which", "house", "idiot"}, {"strea", "morn"}, {"these", "where"}
    lexicon = toxicity.Lexicon(frozenset(words), frozenset(stems), frozenset(exceptions))

    def expected(w):
        if w in words:
            return "word"
        if any(w.startswith(s) for s in stems):
            return "stem"
        if len(w) < 4 or w in exceptions:
            return ""
        near = any(abs(len(w) - len(t)) < 2 and distance(w, t) <= 1 for t in words)
        begins = any(distance(w[:n], "strea") <= 1 for n in (4, 5, 6))
        short = (len(w) == 4 and distance(w, "morn") == 1) or (len(w) == 5 and any(w[:i] + w[i + 1 :] == "morn" for i in (1, 2, 3)))
        return "near" if near or begins or short else ""

    seen = {w for r in spark.read.parquet(f"{data}/documents.parquet").select("text").collect() for w in regex.findall(r"[^\W_]+", (r.text or "").lower())}
    assert {w: lexicon.hit(w) for w in seen} == {w: expected(w) for w in seen}
    assert {"word", "near", ""} <= {lexicon.hit(w) for w in seen}


def test_toxicity_learns_and_covers_odd_texts(spark, docs, none):
    train, labels = labelled(spark)
    odd = docs.select(F.col("doc_id") + 1000, "text").toDF("doc_id", "text")
    more = spark.createDataFrame([(5001, "You are a scunbag, really."), (5002, "A clean line about the town.")], "doc_id long, text string")
    both = train.unionByName(odd).unionByName(more)
    got = toxicity.score_toxicity(both, labels).select("doc.doc_id", "held_out", "score", "predicted").collect()
    assert len(got) == both.count() and all(0 <= r.score <= 1 for r in got)
    truth = {r.doc_id: r.toxic for r in labels.collect()} | {5001: 1, 5002: 0}
    assert all(r.predicted == truth[r.doc_id] for r in got if r.doc_id in truth)
    assert toxicity.score_toxicity(none, labels).count() == 0
    assert toxicity.score_toxicity(train, labels.limit(0)).select("score").distinct().count() == 1


def test_packing_does_not_depend_on_its_slices(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").limit(60).coalesce(1).cache()
    whole = packing.pack(docs, queries.vocabulary("word_bpe_49k.json"), group_tokens=20_000)
    sliced = packing.pack(docs, queries.vocabulary("word_bpe_49k.json"), group_tokens=20_000, slice_bytes=2_000, memo=50)
    assert Counter(map(tuple, whole.collect())) == Counter(map(tuple, sliced.collect()))


def test_mixing_parts_rows_without_ids_and_repeated_rows(spark, monkeypatch):
    """Shards stay small though a third of the rows has no id, one id is repeated and one row too."""
    rows = [(None, f"text {i} here", "a") for i in range(900)] + [(7, f"other {i}", "b") for i in range(900)] + [(8, "one and the same", "a")] * 900
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    largest = mixing.dealt(df, ["doc_id"], "mix-1", 28, 100).groupBy("shard").count().agg(F.max("count")).first()[0]
    assert largest < 160
    got = mixing.mix(df, ["doc_id"], block_tokens=1, rows_per_shard=100, whole=False)
    again = mixing.mix(df.repartition(3), ["doc_id"], block_tokens=1, rows_per_shard=100, whole=False)
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, again.collect()))


def test_mixing_cases(spark, docs, none):
    rows = mixing.mix(docs, ["doc_id", "size"], block_tokens=1, rows_per_shard=2).collect()
    assert len(rows) == docs.count() and all(0 <= r.taken <= 3 * r.size for r in rows)
    total = sum(r.size for r in rows)
    taken, target = Counter(), {}
    for r in rows:
        taken[r.source_size, r.target] += r.taken
        target[r.source_size, r.target] = r.target
    assert math.isclose(sum(target.values()), total) and all(abs(taken[k] - v) <= 2 for k, v in target.items())
    assert all(v <= 3 * k[0] + 1e-6 for k, v in target.items())
    again = mixing.mix(docs.repartition(3), ["doc_id", "size"], block_tokens=1, rows_per_shard=2).collect()
    assert Counter(rows) == Counter(again)
    deep = mixing.mix(docs, ["doc_id", "size"], block_tokens=1, rows_per_shard=1, fan=2).collect()
    assert sum(r.taken for r in deep) == total and all(0 <= r.taken <= 3 * r.size for r in deep)
    blank = docs.withColumn("text", F.lit(None).cast("string"))
    assert [(r.size, r.taken, r.target) for r in mixing.mix(blank, ["doc_id"]).collect()] == [(0, 0, 0.0)] * docs.count()
    assert mixing.mix(none, ["doc_id"]).count() == 0


@pytest.mark.parametrize("seats", [0, 1, 7, 1000, 12345])
def test_sainte_lague_equals_the_highest_quotients(spark, seats):
    votes = [0, 1, 2, 2, 50, 333, 333, 1000, 7]
    got = mixing.sainte_lague(spark.createDataFrame([(i, v, seats) for i, v in enumerate(votes)], "i int, v long, s long"), [], ["i"], "v", "s")
    quotients = sorted(((-v / (2 * k + 1), i) for i, v in enumerate(votes) if v for k in range(seats + 1)))[:seats]
    want = Counter(i for _, i in quotients)
    assert {r.i: r.quota for r in got.collect()} == {i: want[i] for i in range(len(votes))}


def test_url_cases(spark):
    urls_ = [None, "", "no scheme", "HTTP://A.Example.ORG", "http://a.example.org/", "x://example.org/es/1", "x://notexample.org/es/1", "x://b.example.org/en/12?q#f", "x://com/fr/", "x://u.co.uk:80/a\nb", "a://b://c/d"]
    rows = [(i, u, None, "h", 1) for i, u in enumerate(urls_)]
    got = {r.page_id: r for r in urls.judge(spark.createDataFrame(rows, PAGES), queries.RULES).collect()}
    assert [(got[i].host, got[i].path, got[i].rule) for i in range(len(rows))] == [
        ("", "", None), ("", "", None), ("", "", None), ("a.example.org", "", None), ("a.example.org", "/", "org/"), ("example.org", "/es/1", "example.org/es/"),
        ("notexample.org", "/es/1", "org/"), ("b.example.org", "/en/12", "example.org/en/1"), ("com", "/fr/", "com/fr/"), ("u.co.uk:80", "/a\nb", None), ("b:", "//c/d", None),
    ]
    assert {r.verdict for r in got.values()} == {"allow", "block"} and got[5].verdict == "block"
    assert urls.judge(spark.createDataFrame([], PAGES), queries.RULES).count() == 0


def test_reputation_shrinks_towards_its_domain(spark):
    outcomes = spark.createDataFrame([(f"h{i}.bad.com", 40, 38) for i in range(8)] + [(f"h{i}.good.com", 40, 1) for i in range(8)], "host string, n long, bad long")
    hosts = spark.createDataFrame([("new.bad.com",), ("new.good.com",), ("other.net",)], "host string")
    rate = {r.host: r for r in urls.host_reputation(outcomes, hosts).collect()}
    assert rate["new.bad.com"].bad_rate > 0.8 > 0.2 > rate["new.good.com"].bad_rate
    assert not rate["other.net"].blocked and not rate["new.good.com"].blocked


def test_topk_cases(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [(0, [1.0, 0.5]), (50, [0.5, 0.5]), (1, [1.0, 0.5]), (2, [1.0, 0.5]), (3, None), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [1.0]), (7, [-1.0, -1.0]), (100, None), (150, [1.0]), (8, [None, 1.0])]
    df = spark.createDataFrame([(*v, 1, "a", "b") for v in vectors], VECTORS)
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in topk.exact_topk(df).collect()}
    assert got[0, 1] == (1, 256 * 256 + 128 * 128) and got[0, 2][0] == 2 and got[0, 3][0] == 50 and got[0, 4][0] == 7
    assert got[150, 1] == (6, 65536) and (150, 2) not in got and not any(q == 100 for q, _ in got)
    assert topk.exact_topk(df.limit(0)).count() == 0


def test_topk_of_many_rows_of_one_id(spark):
    rows = [(50, [1.0, float(i)]) for i in range(300)] + [(i, [float(i % 7), 1.0]) for i in range(1, 40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.exact_topk(df, block=32).collect()
    best = sorted((-(65536 * (x[0] + 299 * x[1]) if i % 7 else 65536 * 299), i) for i, x in rows[300:])[:5]
    assert [(r["rank"], r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"])] == [(k + 1, i, int(-v)) for k, (v, i) in enumerate(best)]


def test_vector_near_duplicates_cases(spark):
    nan = float("nan")
    vectors = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 0.3]), (4, [0.0, 1.0]), (5, [0.0, 0.0]), (6, None), (7, [nan, 1.0]), (8, [1.0, 0.0]), (9, [1.0, 0.0, 0.0]), (10, [None, 1.0])]
    df = spark.createDataFrame([(*v, 1, "a", "b") for v in vectors], VECTORS)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in neardup_vectors.near_duplicates(df).collect()}
    group = {i: (3, 1, i == 1) for i in (1, 2, 3, 8)}
    assert got == group | {i: (0, i, True) for i in (4, 5, 6, 7, 9, 10)}
    assert neardup_vectors.near_duplicates(df.limit(0)).count() == 0


def linked(rows):
    """n_links, component_id, kept of (vec_id, vector or None) by comparing all pairs."""
    fine = [(i, np.array(v, np.float64)) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    ids = [i for i, _ in fine]
    u = np.array([v / np.linalg.norm(v) for _, v in fine])
    near = u @ u.T >= 0.9
    root = list(range(len(fine)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in zip(*np.nonzero(np.triu(near, 1)), strict=True):
        root[find(i)] = find(j)
    least = {}
    for k, i in enumerate(ids):
        least[find(k)] = min(i, least.get(find(k), i))
    out = {i: (0, i, True) for i, _ in rows}
    return out | {i: (int(near[k].sum()) - 1, least[find(k)], least[find(k)] == i) for k, i in enumerate(ids)}


def planted():
    rng = np.random.default_rng(4)
    base = rng.normal(size=(1200, 32))
    copies = base[rng.integers(0, 300, 600)] + rng.normal(size=(600, 32)) * rng.choice([0.1, 0.3, 0.45], (600, 1))
    return [(i, v.tolist()) for i, v in enumerate(np.concatenate([base, copies]).astype(np.float32).astype(np.float64))]


def test_vector_near_duplicates_recall(spark):
    rows = planted()
    got = {r.vec_id: r.n_links for r in neardup_vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    true = {i: v[0] for i, v in linked(rows).items()}
    assert all(got[i] <= true[i] for i in true) and sum(got.values()) >= 0.95 * sum(true.values())


def test_vector_near_duplicates_exact_probes(spark):
    rows = planted()
    got = neardup_vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), probes=None).collect()
    assert {r.vec_id: tuple(r)[1:] for r in got} == linked(rows)


def test_vector_near_duplicates_of_the_table(spark, data):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{data}/embeddings.parquet").collect()]
    got = {r.vec_id: tuple(r)[1:] for r in queries.op9_vector_neardup(spark, data).collect()}
    assert got == linked(rows)


def test_vector_near_duplicates_without_ids(spark):
    rows = [(None, [1.0, 0.0]), (None, [1.0, 0.0]), (4, [1.0, 0.0]), (5, [1.0, 0.1]), (None, [0.0, 1.0]), *[(7, [0.5, 0.5])] * 500]
    got = Counter(tuple(r) for r in neardup_vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert got == Counter({(None, 1, 4, True): 2, (4, 1, 4, True): 1, (5, 1, 4, False): 1, (None, 0, None, True): 1, (7, 499, 7, True): 500})


def test_text_near_duplicates_cases(spark, docs, none):
    got = Counter(tuple(r) for r in neardup_text.classify(docs).collect())
    assert got == Counter([(1, 1, True), (6, 1, False), (6, 1, False), (2, 2, True), (3, 3, True), (4, 4, True), (5, 5, True), (8, 5, False), (None, None, True), (7, 7, True), (9, 9, True)])
    assert neardup_text.classify(none).count() == 0


def test_one_row_repeated_beside_a_near_copy(spark):
    text = " ".join(f"w{i}" for i in range(200))
    other = " ".join(f"v{i}" for i in range(200))
    rows = [(3, text)] * 10_000 + [(1, text + " end"), (2, other), (None, "two words")] + [(None, "")] * 3000
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = Counter(tuple(r) for r in neardup_text.classify(docs).collect())
    assert got == Counter({(3, 1, False): 10_000, (1, 1, True): 1, (2, 2, True): 1, (None, None, True): 3001})


def test_sketches_of_long_texts_are_made_in_parts(monkeypatch):
    x = neardup_text.labelled_kmers(neardup_text.word_hashes(" ".join(f"w{i % 700}" for i in range(5000))))
    whole = neardup_text.sketches(x, 4, 18, 25, 8)
    monkeypatch.setattr(neardup_text, "_AT_ONCE", 6000)
    assert (neardup_text.sketches(x, 4, 18, 25, 8) == whole).all()


def test_text_near_duplicates_equal_brute_force(spark, data):
    rows = spark.read.parquet(f"{data}/documents.parquet").collect()
    x = [neardup_text.labelled_kmers(neardup_text.word_hashes(r.text)) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if neardup_text.similarity(x[i], x[j], 0.8) >= 0.8:
            root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        least[find(i)] = min(least.get(find(i), r.doc_id), r.doc_id)
    got = {r.doc_id: r.class_id for r in queries.op10_text_neardup(spark, data).collect()}
    assert got == {r.doc_id: least[find(i)] for i, r in enumerate(rows)}


def test_pipeline_stages_take_effect(spark, data):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{data}/documents.parquet")
    before = docs
    for name, stage in p.STAGES:
        path = new_path(spark, "test-stage")
        stage(spark, docs, data).write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        if name != "packing":
            assert set(docs.columns) == set(p.COLUMNS)
        if name in ("quality classifier", "toxicity", "near duplicates"):
            assert docs.join(before, "doc_id", "left_anti").count() == 0 and docs.count() < before.count()
        if name == "near duplicates":
            assert neardup_text.classify(docs).filter("NOT kept").count() == 0
    assert docs.agg(F.sum("length")).first()[0] == sum(len(ids_of("word_bpe_49k.json", r.text)) for r in before.collect())


def test_pipeline_stages_on_odd_tables(spark, docs, data):
    """Nulls, blank and long texts and repeated rows, and no rows at all, through every stage."""
    import corpus_pipeline as p

    odd = docs.select("doc_id", "text", F.lit(None).cast("string").alias("lang"), "source", F.lit(1).cast("long").alias("n_chars"))
    for rows in (odd, odd.limit(0)):
        n = rows.count()
        for name, stage in p.STAGES:
            out = stage(spark, rows, data)
            if name == "packing":
                whole = out.groupBy("doc_id").agg(F.sum("length").alias("n")).agg(F.sum("n")).first()[0] or 0
                assert whole == sum(len(ids_of("word_bpe_49k.json", r.text)) for r in rows.collect())
            else:
                assert set(out.columns) == set(p.COLUMNS) and (n or out.count() == 0)


def test_near_duplicate_stage_cases(spark, docs):
    import corpus_pipeline as p

    rows = docs.select("doc_id", "text", F.lit("en").alias("lang"), "source", F.lit(1).cast("long").alias("n_chars"))
    got = Counter(r.doc_id for r in p.drop_near_duplicates(spark, rows, "").collect())
    assert got == Counter([1, 2, 3, 4, 5, None, 7, 9])


def test_near_duplicate_stage_tells_classes_apart_without_ids(spark):
    import corpus_pipeline as p

    a, b, c, d = (" ".join(f"{name}{i}" for i in range(60)) for name in "abcd")
    rows = [(None, a), (None, a), (None, a + " end"), (None, b), (6, c), (6, d), (6, d), (7, d + " end"), (None, d), (None, " ")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = Counter((r.doc_id, r.text[:1]) for r in p.drop_near_duplicates(spark, docs, "").collect())
    assert got == Counter([(None, "a"), (None, "b"), (6, "c"), (6, "d"), (None, " ")])


def test_mixing_writes_the_words_it_takes(spark):
    """Each source with one document of 200 times the length, and sources of about one document a shard."""
    import corpus_pipeline as p

    few = [(i, "w " * (12_000 if i % 100 == 7 else 60), "en", f"s{i % 3}", 1) for i in range(3000)]
    many = [(i, "w " * (40 + i * 37 % 400), "en", f"s{i % 400:03}", 1) for i in range(1200)]
    for rows in (few, many):
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
        mixed = mixing.mix(docs, p.COLUMNS).collect()
        taken, written, target, longest = Counter(), Counter(), {}, Counter()
        weight = {s: i % 3 for i, s in enumerate(sorted({r[3] for r in rows}))}
        for r in mixed:
            s = r.doc.source
            taken[s] += r.taken
            written[s] += r.copies * r.size
            target[s] = r.target
            longest[s] = max(longest[s], r.size)
        assert all(abs(written[s] - taken[s]) < longest[s] for s in target)
        for w in range(3):
            of = lambda c: sum(v for s, v in c.items() if weight[s] == w)  # noqa: B023, E731
            assert abs(of(written) - of(target)) <= 0.05 * of(target)
        again = p.mix_sources(spark, docs.repartition(3), "")
        assert again.count() == sum(r.copies for r in mixed)
