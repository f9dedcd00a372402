"""URL filtering: rules first, then empirical-Bayes host reputation.

The pages that a rule judges are the labelled outcomes (block = bad).  A host's
bad rate is shrunk through beta-binomial priors: all pages -> public suffix ->
registered domain -> host, with the prior strength of each level estimated from
the spread of its members (method of moments).  A host is blocked when the lower
posterior bound of its bad rate passes `threshold`; the bound is the normal
approximation of the beta posterior, mean - z deviations.

Only DataFrame functions are used.  Counts are aggregated per host and written
once; pages then meet their verdicts, hosts with many of them by broadcast, so
one host with a third of all pages is never one task.

Defined cases: a null url or one without :// has empty host and path, fits no
rule, and is judged by the overall prior; a table without outcomes allows what
no rule blocks; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.spatial import hot_join
from .common import staged

#: Suffixes of two labels under which names are registered.
TWO_LABEL_SUFFIXES = ("ac.uk", "co.jp", "co.nz", "co.uk", "co.za", "com.au", "com.br", "com.cn", "gov.uk", "ne.jp", "net.au", "or.jp", "org.au", "org.uk")

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest rule (verdict, "host/path") that fits, as struct(rule, verdict), else null.  Rules are a bounded list."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def suffix_of(host: Column, long_suffixes: Sequence[str] = TWO_LABEL_SUFFIXES) -> Column:
    """The public suffix: one label, or two where `long_suffixes` lists them; an address is its own."""
    name = F.regexp_replace(host, r":\d*$", "")
    two, one = F.substring_index(name, ".", -2), F.substring_index(name, ".", -1)
    return F.when(name.rlike(r"^\d+(\.\d+){3}$"), name).when(two.isin(*long_suffixes), two).otherwise(one)


def domain_of(host: Column, long_suffixes: Sequence[str] = TWO_LABEL_SUFFIXES) -> Column:
    """The registered domain: one label more than the suffix."""
    name, suffix = F.regexp_replace(host, r":\d*$", ""), suffix_of(host, long_suffixes)
    labels = F.size(F.split(suffix, r"\.")) + 1
    return F.when(name == suffix, name).when(labels == 2, F.substring_index(name, ".", -2)).otherwise(F.substring_index(name, ".", -3))


def _strength(parent_mean: Column) -> Column:
    """Prior strength of a level: an aggregate over units with bad, n and their parent's mean; kept between 1 and 1000."""
    n, bad, m = F.col("n").cast("double"), F.col("bad").cast("double"), parent_mean
    spread = F.sum(n * F.pow(bad / n - m, 2))
    binomial = F.sum(n * m * (1 - m))
    crowd = F.count("*") / F.sum(n)
    rho = F.try_divide(F.try_divide(spread, binomial) - crowd, 1 - crowd)
    return F.least(F.lit(1000.0), F.greatest(F.lit(1.0), F.coalesce(F.try_divide(1 - rho, F.when(rho > 0, rho)), F.lit(1000.0))))


def host_reputation(outcomes: DataFrame, hosts: DataFrame, *, z: float = 1.645, threshold: float = 0.5, long_suffixes: Sequence[str] = TWO_LABEL_SUFFIXES) -> DataFrame:
    """hosts(host) -> host, bad_rate, lower, blocked, from outcomes(host, n, bad), one row per host in each.

    The four scalars of the priors are read by the driver; everything else is joined.
    """
    o = outcomes.filter("n > 0").select("host", "n", "bad").withColumn("domain", domain_of(F.col("host"), long_suffixes)).withColumn("suffix", suffix_of(F.col("host"), long_suffixes))
    m0 = o.agg((F.sum("bad") / F.sum("n")).alias("m")).first().m
    m0 = 0.0 if m0 is None else m0
    sums = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]
    suffixes = o.groupBy("suffix").agg(*sums)
    k = suffixes.agg(_strength(F.lit(m0)).alias("k")).first().k
    suffixes = suffixes.select("suffix", ((F.col("bad") + k * m0) / (F.col("n") + k)).alias("m_suffix"))
    domains = o.groupBy("suffix", "domain").agg(*sums).join(suffixes, "suffix")
    k = domains.agg(_strength(F.col("m_suffix")).alias("k")).first().k
    domains = domains.select("domain", ((F.col("bad") + k * F.col("m_suffix")) / (F.col("n") + k)).alias("m_domain"))
    judged = o.select("host", "n", "bad", "domain").join(domains, "domain")
    k = judged.agg(_strength(F.col("m_domain")).alias("k")).first().k

    prior = F.coalesce(F.col("m_domain"), F.col("m_suffix"), F.lit(m0))
    n, bad = F.coalesce(F.col("n"), F.lit(0)), F.coalesce(F.col("bad"), F.lit(0))
    a, b = bad + k * F.col("prior"), n - bad + k * (1 - F.col("prior"))
    mean = a / (a + b)
    lower = mean - z * F.sqrt(mean * (1 - mean) / (a + b + 1))
    return (
        hosts.withColumn("domain", domain_of(F.col("host"), long_suffixes))
        .withColumn("suffix", suffix_of(F.col("host"), long_suffixes))
        .join(o.select("host", "n", "bad"), "host", "left")
        .join(domains, "domain", "left")
        .join(suffixes, "suffix", "left")
        .withColumn("prior", prior)
        .select("host", mean.alias("bad_rate"), lower.alias("lower"), (lower > threshold).alias("blocked"))
    )


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]], *, z: float = 1.645, threshold: float = 0.5, long_suffixes: Sequence[str] = TWO_LABEL_SUFFIXES) -> DataFrame:
    """page_id, host, path, rule, verdict for every row of pages(page_id, url)."""
    p = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    p = p.withColumn("fit", fitting_rule(F.col("host"), F.col("path"), rules))
    bad = F.coalesce(F.sum((F.col("fit.verdict") == "block").cast("long")), F.lit(0))
    per_host = staged(p.groupBy("host").agg(F.count("*").alias("pages"), F.count("fit").alias("n"), bad.alias("bad")), "hosts")
    verdicts = host_reputation(per_host, per_host.select("host"), z=z, threshold=threshold, long_suffixes=long_suffixes).select("host", "blocked")
    least = F.broadcast(per_host.agg((F.sum("pages") / 1000).alias("least")))
    hot = per_host.join(least, F.col("pages") > F.col("least")).select("host")  # under 1000
    method = F.when(F.col("blocked"), "block").otherwise("allow")
    return hot_join(p, verdicts, ["host"], hot).select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce(F.col("fit.verdict"), method).alias("verdict"))
