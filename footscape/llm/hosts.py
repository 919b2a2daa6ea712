"""URL filter: fixed rules, and empirical-Bayes reputation of hosts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footscape.llm.common import LOWER, UPPER, fold_of, stored

#: The rules of the contract, (host, path, verdict).
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
#: A host is blocked when the lower posterior bound of its share of bad pages is above this.
BAD_SHARE, Z = 0.5, 1.645
#: Strength of the prior above all hosts, in pages.
BASE_STRENGTH = 2.0
LEVELS = ("suffix", "domain", "host")


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url; both empty for a null one and one without ://."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(F.substr(rest, F.char_length(host) + 1), r"^([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null."""
    out = None
    for h, p, verdict in sorted(rules, key=lambda r: -len(r[0] + r[1])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        value = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out


def levels(host: Column) -> dict[str, Column]:
    """The host, its registered domain (its last two labels) and its suffix (the last one)."""
    return {"host": host, "domain": F.substring_index(host, ".", -2), "suffix": F.substring_index(host, ".", -1)}


def _moments(child: DataFrame, parent: str | None) -> DataFrame:
    """Mean and strength of a beta prior for the children of each parent, by the method of moments."""
    share = F.col("bad") / F.col("n")
    by = child.groupBy(parent) if parent else child.groupBy()
    m = by.agg(F.sum("bad").alias("b"), F.sum("n").alias("t"), F.count(F.lit(1)).alias("k"), F.var_pop(share).alias("var"), F.avg(1 / F.col("n")).alias("inv"))
    return m.withColumn("rate", F.col("b") / F.col("t"))


def _fitted(outcomes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """From outcomes (host, bad 0/1): hosts (host, n, bad, domain, suffix), and the beta priors that each level gives to hosts
    below it: (domain, a, b), (suffix, a, b) and (a, b) of all, with a / (a + b) as their rate."""
    own = levels(F.col("host"))
    hosts = (outcomes.filter(F.col("host").isNotNull() & F.col("bad").isNotNull()).groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("bad").cast("long")).alias("bad"))
             .withColumn("domain", own["domain"]).withColumn("suffix", own["suffix"]))
    hosts = stored(hosts)
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    total = suffixes.agg(((F.coalesce(F.sum("bad"), F.lit(0)) + 1) / (F.coalesce(F.sum("n"), F.lit(0)) + 2)).alias("base"))

    def strength(stats: DataFrame) -> DataFrame:
        within = F.col("rate") * (1 - F.col("rate"))
        extra = F.col("var") - within * F.col("inv")
        s = F.when((F.col("k") > 1) & (extra > 0), within / extra - 1).otherwise(F.when(F.col("k") > 1, 1000.0).otherwise(BASE_STRENGTH))
        return stats.withColumn("strength", F.greatest(F.lit(1.0), F.least(F.lit(1000.0), s)))

    def shrunk(df: DataFrame, prior: str, strength_col: Column | float, out: str) -> DataFrame:
        s = F.lit(strength_col) if isinstance(strength_col, float) else strength_col
        return df.withColumn(out, (F.col("bad") + s * F.col(prior)) / (F.col("n") + s))

    def prior(df: DataFrame, keys: list[str], rate: str, strength: Column) -> DataFrame:
        return df.select(*keys, (strength * F.col(rate)).alias("a"), (strength * (1 - F.col(rate))).alias("b"))

    top = shrunk(suffixes.join(F.broadcast(total)), "base", BASE_STRENGTH, "suffix_rate").select("suffix", "suffix_rate")
    of_suffix = strength(_moments(domains, "suffix")).select("suffix", F.col("strength").alias("ss"))
    top = top.join(of_suffix, "suffix")
    mid = shrunk(domains.join(top, "suffix"), "suffix_rate", F.col("ss"), "domain_rate").select("domain", "domain_rate")
    of_domain = strength(_moments(hosts, "domain")).select("domain", F.col("strength").alias("ds"))
    return hosts, prior(mid.join(of_domain, "domain"), ["domain"], "domain_rate", F.col("ds")), prior(top, ["suffix"], "suffix_rate", F.col("ss")), prior(total, [], "base", F.lit(BASE_STRENGTH))


def _lower(a: Column, b: Column) -> Column:
    """The mean of a beta distribution less Z of its deviations, 0 at least."""
    return F.greatest(F.lit(0.0), a / (a + b) - Z * F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))))


def _posterior(hosts: DataFrame, of_domain: DataFrame) -> DataFrame:
    post = hosts.join(of_domain, "domain").withColumn("a", F.col("bad") + F.col("a")).withColumn("b", F.col("n") - F.col("bad") + F.col("b"))
    return post.select("host", "n", "bad", (F.col("a") / (F.col("a") + F.col("b"))).alias("mean"), _lower(F.col("a"), F.col("b")).alias("lower"))


def reputations(outcomes: DataFrame) -> DataFrame:
    """(host, n, bad, mean, lower) from labelled page outcomes (host, bad 0/1).

    Outcomes of a host are binomial, with a beta prior that its registered domain gives; the domain's own
    rate is shrunk to its suffix's, and that to the rate of all. The strength of a prior is that which its
    children's spread, beyond what their sizes explain, shows; it is between 1 and 1000 pages. `lower`
    is the posterior mean less Z posterior deviations.
    """
    return _posterior(*_fitted(outcomes)[:2])


def judged(pages: DataFrame, outcomes: DataFrame, bad_share: float = BAD_SHARE) -> DataFrame:
    """(page_id, host, path, rule, verdict, lower), one row per row of `pages` (page_id, url, ...).

    A rule's verdict stands; other pages are blocked when the lower posterior bound of their host's share of
    bad pages is above `bad_share`, and allowed otherwise. A host without labelled pages has the prior that its
    registered domain gives, else its suffix, else all. A null or malformed url has an empty host and is
    allowed. Extra columns are ignored; no pages give no rows.
    """
    host, path = url_parts(F.col("url"))
    parts = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path")).withColumn("_r", rule_of(F.col("host"), F.col("path")))
    hosts, *priors = _fitted(outcomes)
    of_domain, of_suffix, of_all = (stored(p.select(*p.columns[:-2], _lower(F.col("a"), F.col("b")).alias(f"lower_{k}"))) for k, p in enumerate(priors))
    own = levels(F.col("host"))
    named = pages.select(host.alias("host")).filter(F.col("host") != "").distinct().withColumn("domain", own["domain"]).withColumn("suffix", own["suffix"])
    known = (named.join(_posterior(hosts, priors[0]).select("host", "lower"), "host", "left").join(of_domain, "domain", "left").join(F.broadcast(of_suffix), "suffix", "left").join(F.broadcast(of_all))
             .select("host", F.coalesce("lower", "lower_0", "lower_1", "lower_2").alias("lower")))
    both = parts.join(stored(known), "host", "left")
    method = F.when(F.coalesce(F.col("lower"), F.lit(0.0)) > bad_share, "block").otherwise("allow")
    return both.select("page_id", "host", "path", F.col("_r.rule").alias("rule"), F.coalesce("_r.verdict", method).alias("verdict"), "lower")


def labelled_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(host, bad): outcomes of pages whose url's path ends in the number of a labelled document; low quality or toxicity
    is bad. Labels of the held-out fold aren't read."""
    host, path = url_parts(F.col("url"))
    number = F.regexp_extract(path, r"/(\d{1,18})(?:\.html)?/?$", 1)
    numbered = pages.select(host.alias("host"), F.when(number != "", number.cast("long")).alias("doc_id")).filter(F.col("doc_id").isNotNull() & (F.col("host") != ""))
    bad = labels.filter(fold_of(F.col("doc_id")) != 0).groupBy("doc_id").agg(F.max(((F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1)).cast("int")).alias("bad"))
    return numbered.join(bad, "doc_id").select("host", "bad")
