"""URL filtering: longest-prefix rules, and an empirical-Bayes reputation of hosts where no rule fits.

Labelled pages give each host a count of bad pages and of all. A beta prior is fitted at each level (whole table,
public suffix, registered domain) and the next level's rates are shrunk towards it: the prior mean of a host is its
domain's posterior mean, that of a domain its suffix's, that of a suffix the table's. The prior's strength is fitted by
the method of moments to the spread of the rates at that level. A page is blocked if the lower bound of its host's
posterior bad rate is above the limit; hosts without labels take the posterior of the nearest level that has some.

Counts are aggregated in each task before the shuffle, so one host with most of the pages is one row per task, and
pages meet the reputation table in a plain join, which Spark can split or broadcast by size.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import pick

#: (verdict, host, path prefix); a rule fits the host and all its subdomains.
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
#: Bounds of a prior's strength in pseudo-counts, and the share of bad pages a host may have.
STRENGTH, LIMIT, Z = (2.0, 1000.0), 0.5, 1.645


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or no ``://``."""
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as ``host`` + ``path prefix``, and its verdict; null for none. Ties: the first given."""
    order = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    fits = lambda r: ((host == r[1]) | host.endswith("." + r[1])) & path.startswith(r[2])
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in reversed(order):
        name, verdict = F.when(fits(r), r[1] + r[2]).otherwise(name), F.when(fits(r), r[0]).otherwise(verdict)
    return name, verdict


def domain_of(host: Column) -> Column:
    """The last two labels of a host, its registered domain."""
    return F.substring_index(host, ".", -2)


def suffix_of(host: Column) -> Column:
    return F.substring_index(host, ".", -1)


def _strength(counts: DataFrame, parent: list[str]) -> DataFrame:
    """Per parent, the strength of a beta prior for its children's rates: method of moments, within STRENGTH.

    ``counts`` has a row per child: bad, n, and the parent's mean as ``prior``.
    """
    rate = F.col("bad") / F.col("n")
    spread = counts.groupBy(*parent).agg(F.count("*").alias("k"), F.first("prior").alias("mean"), F.sum(F.col("n") * (rate - F.col("prior")) * (rate - F.col("prior"))).alias("ss"), F.sum("n").alias("total"))
    noise = F.col("mean") * (1 - F.col("mean"))
    excess = F.greatest((F.col("ss") - F.col("k") * noise) / F.col("total"), F.lit(1e-9))
    return spread.select(*parent, F.least(F.greatest(noise / excess - 1, F.lit(STRENGTH[0])), F.lit(STRENGTH[1])).alias("strength"))


def _level(counts: DataFrame, parent: list[str]) -> DataFrame:
    """Posterior alpha, beta and mean of each child."""
    with_prior = counts.join(_strength(counts, parent), parent) if parent else counts.crossJoin(_strength(counts, parent))
    a = F.col("bad") + F.col("strength") * F.col("prior")
    b = F.col("n") - F.col("bad") + F.col("strength") * (1 - F.col("prior"))
    return with_prior.withColumn("alpha", a).withColumn("beta", b).withColumn("mean", a / (a + b)).drop("strength", "prior")


def lower_bound(alpha: Column, beta: Column, z: float = Z) -> Column:
    mean = alpha / (alpha + beta)
    return mean - z * F.sqrt(mean * (1 - mean) / (alpha + beta + 1))


def reputation(outcomes: DataFrame) -> DataFrame:
    """Posterior alpha and beta by level and key from rows of (host, bad 0/1); null outcomes are left out.

    Levels are ``host``, ``domain``, ``suffix`` and ``all`` (key ''). No labelled rows: one ``all`` row with alpha 1, beta 1.
    """
    hosts = outcomes.filter("bad is not null").groupBy("host").agg(F.sum("bad").alias("bad"), F.count("*").alias("n"))
    hosts = hosts.withColumn("domain", domain_of(F.col("host"))).withColumn("suffix", suffix_of(F.col("host")))
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"))
    suffixes = domains.groupBy("suffix").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"))
    whole = suffixes.agg((F.coalesce(F.sum("bad"), F.lit(0)) + 1).cast("double").alias("alpha"), (F.coalesce(F.sum(F.col("n") - F.col("bad")), F.lit(0)) + 1).cast("double").alias("beta"))

    s = _level(suffixes.crossJoin(whole.select((F.col("alpha") / (F.col("alpha") + F.col("beta"))).alias("prior"))), [])  # one row each side at most per suffix
    d = _level(domains.join(s.select("suffix", F.col("mean").alias("prior")), "suffix"), ["suffix"])
    h = _level(hosts.drop("suffix").join(d.select("domain", F.col("mean").alias("prior")), "domain"), ["domain"])
    level = lambda df, name, key: df.select(F.lit(name).alias("level"), key.alias("key"), "alpha", "beta")
    return reduce(DataFrame.unionByName, [level(h, "host", F.col("host")), level(d, "domain", F.col("domain")), level(s, "suffix", F.col("suffix")), level(whole, "all", F.lit(""))])


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules=RULES, limit: float = LIMIT, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: id, host, path, rule, verdict, bad_bound, level.

    ``outcomes`` has (page_id, bad): 1 for a page found bad, 0 for a good one, null for unknown; ids without a page are
    left out, an id labelled twice counts twice. A null URL has an empty host and path, fits no rule and is judged like any other. Rows that
    repeat are judged alike. Other columns of either table aren't read. Empty tables give no rows.
    """
    p = pick(pages, id=id_col, url=url_col).select("id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    o = pick(outcomes, id="page_id", bad="bad").filter("bad is not null").select("id", F.col("bad").cast("long").alias("bad"))
    rep = reputation(p.select("id", "host").join(o, "id").select("host", "bad"))
    at = lambda name: rep.filter(F.col("level") == name).select(F.col("key").alias(name), F.struct(lower_bound(F.col("alpha"), F.col("beta")).alias("bound"), F.lit(name).alias("level")).alias(f"r_{name}"))

    hosts = p.select("host").distinct().withColumn("domain", domain_of(F.col("host"))).withColumn("suffix", suffix_of(F.col("host"))).withColumn("all", F.lit(""))
    for name in ("host", "domain", "suffix", "all"):
        hosts = hosts.join(at(name), name, "left")
    hosts = hosts.select("host", F.coalesce("r_host", "r_domain", "r_suffix", "r_all").alias("r"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    judged = p.join(hosts, "host")
    return judged.select(F.col("id").alias(id_col), "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("r.bound") > limit, "block").otherwise("allow")).alias("verdict"), F.col("r.bound").alias("bad_bound"), F.col("r.level").alias("level"))
