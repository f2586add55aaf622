"""URL filters: explicit host and path rules, and for all other pages an empirical-Bayes reputation of the host.

Labelled page outcomes (1 good, 0 bad) are counted by host, registered domain and suffix. The share of good pages at each
level has a beta prior whose mean is the posterior mean of the level above and whose weight is fitted to that level by
the method of moments for the beta-binomial. A page is allowed when a lower bound of its host's posterior reaches a
threshold; hosts without labels fall back to their domain's, suffix's or the overall prior. All of it is DataFrame
expressions. Hosts and their outcomes are counted once, by partial sums, and written; levels, and the rules that fit a host,
are tables over hosts. Pages meet the hosts' table by a broadcast if it is small, and otherwise salted by page, so one host
with a third of the rows is no single task's.

The suffix is a host's last label, or the last two if they are among ``long_suffixes``; the registered domain has one
label more. A port is no part of either.

Defined results: a null url, or one without ``://``, has an empty host and path, fits no rule and is judged by the empty
host's reputation. Repeated page rows are judged each, and count each. Labels of a page that differ all count. Labels
that are null, or neither 0 nor 1, or of no page, don't count. Without any label the prior is ``base``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, joined, staged


@dataclass(frozen=True)
class Rule:
    verdict: str
    site: str  # host, then the start of a path, as in ``example.com/en/``

    @property
    def host(self) -> str:
        return self.site.partition("/")[0]

    @property
    def path(self) -> str:
        return self.site[len(self.host) :]


def url_host(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_rules(hosts: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """``hosts`` (host, one row each) with ``rules``: those whose host it is or is under, the longest site first, as an array of site, path, verdict.

    Of rules with one site the first counts. Hosts' parents are looked up by a join, so any number of rules will do.
    """
    first = {r.site: r for r in reversed(rules)}
    kind = "array<struct<size:int,site:string,path:string,verdict:string>>"
    if not first:
        return hosts.withColumn("rules", F.array().cast(kind))
    table = hosts.sparkSession.createDataFrame([(r.host, r.site, r.path, r.verdict) for r in first.values()], "parent string, site string, path string, verdict string")
    parents = F.transform(F.sequence(F.lit(1), F.size(F.split("host", "\\."))), lambda i: F.call_function("substring_index", F.col("host"), F.lit("."), -i))
    fits = hosts.select("host", F.explode(F.array_distinct(parents)).alias("parent")).join(table, "parent")
    # Sorted by size from the largest, then by site.
    own = fits.groupBy("host").agg(F.sort_array(F.collect_list(F.struct((-F.char_length("site")).alias("size"), "site", "path", "verdict"))).alias("rules"))
    return hosts.join(own, "host", "left").withColumn("rules", F.coalesce("rules", F.array().cast(kind)))


def _levels(host: Column, long_suffixes: Sequence[str]) -> tuple[Column, Column]:
    """Registered domain and suffix."""
    host = F.regexp_replace(host, ":[0-9]*$", "")
    last2 = F.substring_index(host, ".", -2)
    two = last2.isin(*long_suffixes) if long_suffixes else F.lit(False)
    return F.when(two, F.substring_index(host, ".", -3)).otherwise(last2), F.when(two, last2).otherwise(F.substring_index(host, ".", -1))


def _weight(units: DataFrame, prior: str) -> DataFrame:
    """One row: the weight of a beta-binomial prior by the method of moments, from each unit's n, good and prior mean.

    With r = p(1 - p) under the prior, the expected sum of n (good/n - p)^2 is r (1 + (n - 1) rho); rho = 1 / (weight + 1).
    """
    p = F.col(prior)
    over = F.sum(F.col("n") * F.pow(F.col("good") / F.col("n") - p, 2) - p * (1 - p))
    under = F.sum((F.col("n") - 1) * p * (1 - p))
    rho = F.when(under > 0, F.least(F.greatest(F.try_divide(over, under), F.lit(1e-3)), F.lit(0.5)))
    return units.agg(F.coalesce(1 / rho - 1, F.lit(10.0)).alias("weight"))


def host_counts(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """host, n, good: each host of ``pages`` with its labelled outcomes. ``pages`` has page_id and host, ``labels`` page_id and good (0 or 1)."""
    valid = labels.filter(F.col("good").isin(0, 1)).groupBy("page_id").agg(F.count("good").alias("n"), F.sum("good").alias("good"))
    none = F.lit(0).cast("long")
    # Hosts of all pages, and outcomes of the labelled ones; both sums are partial before they are shuffled.
    both = pages.select("host", none.alias("n"), none.alias("good")).union(pages.join(valid, "page_id").select("host", "n", "good"))
    return both.groupBy("host").agg(F.sum("n").cast("double").alias("n"), F.sum("good").cast("double").alias("good"))


def host_reputation(seen: DataFrame, long_suffixes: Sequence[str] = (), base: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """host, good_a, good_b for each host of ``seen`` (host, n, good): the parameters of the beta posterior of its share of good pages."""
    domain, suffix = _levels(F.col("host"), long_suffixes)
    hosts = seen.select("host", domain.alias("domain"), suffix.alias("suffix"), "n", "good")
    total = lambda df, *keys: df.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    domains = staged(total(hosts, "domain", "suffix"), "domains")
    suffixes = total(domains, "suffix")
    overall = suffixes.agg(((F.coalesce(F.sum("good"), F.lit(0.0)) + base[0]) / (F.coalesce(F.sum("n"), F.lit(0.0)) + sum(base))).alias("p0"))

    def shrunk(units: DataFrame, prior: str, name: str) -> DataFrame:
        """One row joined to all: a cross join with an aggregate of one row."""
        w = F.broadcast(_weight(units.filter("n > 0"), prior))
        out = units.crossJoin(w)
        return out.withColumn(name, (F.col("good") + F.col("weight") * F.col(prior)) / (F.col("n") + F.col("weight")))

    s = shrunk(suffixes.crossJoin(F.broadcast(overall)), "p0", "p1").select("suffix", "p1")
    d = shrunk(domains.join(s, "suffix"), "p1", "p2").select("domain", "p2")
    h = shrunk(hosts.join(d, "domain"), "p2", "p3")
    return h.select("host", (F.col("good") + F.col("weight") * F.col("p2")).alias("good_a"), (F.col("n") - F.col("good") + F.col("weight") * (1 - F.col("p2"))).alias("good_b"))


def posterior_bound(a: Column, b: Column, z: float) -> Column:
    """Mean of a beta less ``z`` standard deviations."""
    return a / (a + b) - z * F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))


def filter_urls(pages: DataFrame, labels: DataFrame, rules: Sequence[Rule] = (), threshold: float = 0.5, z: float = 1.645, long_suffixes: Sequence[str] = ()) -> DataFrame:
    """page_id, host, path, rule, verdict, bound: ``allow`` or ``block`` by the rule, else by whether ``bound`` reaches ``threshold``."""
    own = pages.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    seen = staged(host_counts(own, labels), "hosts")
    bound = F.round(posterior_bound(F.col("good_a"), F.col("good_b"), z), 9).alias("bound")
    known = staged(host_rules(host_reputation(seen, long_suffixes).select("host", bound), rules), "reputation")
    judged = joined(own, known, ["host"], "left", F.struct("page_id", "path")).withColumn("fits", F.get(F.filter("rules", lambda r: F.startswith(F.col("path"), r["path"])), F.lit(0)))
    by_host = F.when(F.col("bound") >= threshold, F.lit("allow")).otherwise(F.lit("block"))
    return judged.select("page_id", "host", "path", F.col("fits.site").alias("rule"), F.coalesce("fits.verdict", by_host).alias("verdict"), "bound")
