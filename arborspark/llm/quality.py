"""Quality classifier: a sparse ensemble of rules over text statistics.

1. Statistics of the whole text are Spark column expressions.
2. A random forest on the statistics of labelled documents gives tree paths;
   each path is a conjunctive rule.
3. A lasso logistic regression over the rules keeps few of them.
4. The kept rules are compiled into one Spark column expression, the score.

Models are fitted on about `sample` labelled ids, and twice as many rows at most
(a documented bound, picked by hash); scoring covers every row and shuffles nothing.

Defined cases: a null text counts as empty; empty texts have all-zero statistics
and get the score of such a text; without labels of both kinds the score is the
share of good labels (0.5 without any); repeated rows score alike; other columns
are carried only if asked for.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, held_out, staged

Rule = tuple[tuple[str, bool, float], ...]


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a whole text, each 0 for a text without words."""
    t = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(t, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split(t, r"\n"), lambda x: x != "")
    n, chars, n_lines = F.size(words), F.length(t), F.size(lines)

    def of(top: Column, bottom: Column) -> Column:
        return F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(0.0))

    count = lambda pattern: F.regexp_count(t, F.lit(pattern))
    return {
        "log_words": F.log1p(n.cast("double")),
        "word_length": of(chars, n),
        "distinct_words": of(F.size(F.array_distinct(words)), n),
        "distinct_lines": of(F.size(F.array_distinct(lines)), n_lines),
        "words_per_line": of(n, n_lines),
        "marks": of(count(r"[^\p{L}\p{N}\s]"), chars),
        "odd_marks": of(count(r"[#$%&*|<>{}\[\]\\^~_=+@]"), chars),
        "loud_marks": of(count(r"[!?]"), chars),
        "capitals": of(count(r"\p{Lu}"), chars),
        "digits": of(count(r"\p{N}"), chars),
        "short_words": of(count(r"(?<![^\s])[\p{L}]{1,3}(?![^\s])"), n),
        "sentence_ends": of(count(r"[.!?](?=\s|$)"), n),
    }


def with_statistics(docs: DataFrame, text: str = "text") -> tuple[DataFrame, list[str]]:
    s = statistics(F.col(text))
    return docs.select(*[c for c in docs.columns if c != text], *[c.alias(f"stat_{k}") for k, c in s.items()]), [f"stat_{k}" for k in s]


_SHARES = 1 << 20


def sampled_labels(labels: DataFrame, label: str, sample: int) -> DataFrame:
    """doc_id, label of about `sample` learnable ids, chosen by hash; an id with several labels has the highest."""
    rows = labels.filter(~held_out("doc_id") & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(F.col(label).cast("double")).alias("label"))
    share = min(1.0, sample / max(1, rows.count()))
    return rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(_SHARES)) < int(share * _SHARES))


def learnable(docs: DataFrame, chosen: DataFrame, sample: int, name: str) -> DataFrame:
    """Staged label and columns of docs(doc_id, hash, columns...) that chosen labels cover: equal rows once, about 2 * sample at most, though ids repeat."""
    columns = [c for c in docs.columns if c not in ("doc_id", "hash")]
    rows = docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "hash", "label").agg(*[F.first(c).alias(c) for c in columns])
    rows = staged(rows, name)
    share = min(1.0, 2 * sample / max(1, rows.count()))
    return rows.filter(F.pmod(F.xxhash64("doc_id", "hash"), F.lit(_SHARES)) < int(share * _SHARES)).select("label", *columns)


def tree_paths(debug: str) -> list[Rule]:
    """Every path of a forest, from the public text form of its trees: tuples of (feature, at most, threshold)."""
    rules: dict[Rule, None] = {}
    path: list[tuple[str, bool, float]] = []
    for line in debug.splitlines():
        depth = (len(line) - len(line.lstrip())) // 1
        if m := re.match(r"\s*(?:If|Else) \(feature (\d+) (<=|>) ([-\d.eE]+)\)", line):
            while path and path[-1][3] >= depth:
                path.pop()
            path.append((m[1], m[2] == "<=", float(m[3]), depth))
            conditions: dict[tuple[str, bool], float] = {}
            for f, below, x, _ in path:
                known = conditions.get((f, below))
                conditions[f, below] = x if known is None else min(known, x) if below else max(known, x)
            rules[tuple(sorted((f, b, x) for (f, b), x in conditions.items()))] = None
        elif line.strip().startswith("Tree"):
            path = []
    return list(rules)


def rule_column(rule: Rule, names: Sequence[str]) -> Column:
    out = F.lit(True)
    for f, below, x in rule:
        c = F.col(names[int(f)])
        out = out & (c <= x if below else c > x)
    return out


def fit_rules(rows: DataFrame, names: Sequence[str], *, trees: int = 20, depth: int = 3, lasso: float = 0.002, seed: int = 7) -> tuple[float, list[tuple[Rule, float]]]:
    """Intercept and weighted rules from rows(label, statistics)."""
    n, good = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if n == 0 or good in (0, n):
        p = 0.5 if n == 0 else min(0.98, max(0.02, good / n))
        return math.log(p / (1 - p)), []
    balance = F.when(F.col("label") == 1, F.lit(n / (2 * good))).otherwise(F.lit(n / (2 * (n - good))))
    rows = VectorAssembler(inputCols=list(names), outputCol="features").transform(rows.withColumn("weight", balance)).select("features", "label", "weight", *names)
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, weightCol="weight", featureSubsetStrategy="onethird", minInstancesPerNode=5).fit(rows)
    rules = tree_paths(forest.toDebugString)
    fired = rows.select("label", "weight", F.array(*[rule_column(r, names).cast("double") for r in rules]).alias("fired"))
    from pyspark.ml.functions import array_to_vector

    fired = fired.select("label", "weight", array_to_vector("fired").alias("features")).cache()
    model = LogisticRegression(elasticNetParam=1.0, regParam=lasso, maxIter=60, weightCol="weight", standardization=False).fit(fired)
    fired.unpersist()
    weights = model.coefficients.toArray()
    return float(model.intercept), [(r, float(w)) for r, w in zip(rules, weights, strict=True) if abs(w) > 1e-6]


def rule_score(intercept: float, rules: Sequence[tuple[Rule, float]], names: Sequence[str]) -> Column:
    """The compiled ensemble: a probability between 0 and 1."""
    total = F.lit(intercept)
    for rule, w in rules:
        total = total + F.when(rule_column(rule, names), F.lit(w)).otherwise(F.lit(0.0))
    return 1 / (1 + F.exp(-total))


def score_quality(docs: DataFrame, labels: DataFrame, *, carry: Sequence[str] = ("doc_id",), threshold: float = 0.3, sample: int = 20_000) -> DataFrame:
    """doc (the carried columns), held_out, score, predicted for every row of docs(doc_id, text)."""
    chosen = sampled_labels(labels, "quality", sample)
    stats, names = with_statistics(docs.select("doc_id", F.xxhash64("text").alias("hash"), "text").join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi"))
    learn = learnable(stats, chosen, sample, "quality-sample").coalesce(6)
    intercept, rules = fit_rules(learn, names)
    rows, names = with_statistics(docs.select(F.struct(*carry).alias("doc"), held_out("doc_id").alias("held_out"), F.col("text").alias("text")))
    score = rule_score(intercept, rules, names)
    return rows.select("doc", "held_out", score.alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
