"""URL filter: fixed rules, then empirical-Bayes reputation of the host. DataFrame functions only.

Labelled pages are outcomes, bad or not. The bad rate of a public suffix is shrunk to the overall rate, that of a registered domain
to its suffix's, that of a host to its domain's: each level is a beta-binomial whose prior mean is the level above and whose
prior strength is found by the method of moments over all groups of the level. A host is blocked when the lower bound of its
posterior bad rate passes LIMIT, so that few outcomes never block.

Edge cases: a null url, or one without "://", has an empty host and path; empty hosts are one host. Hosts without outcomes have
the posterior of their domain, suffix or all pages. Without any outcome every rate is 0 and all is allowed. Null outcomes are
none. Repeated rows count as often as they occur. An empty table gives no rows. Other columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import sized
from faultline.session import materialize

#: Bad rate a host must surpass, and standard deviations between its mean and its bound.
LIMIT, DEVIATIONS = 0.4, 1.645
#: Bounds of a prior's strength, in outcomes.
STRENGTH = (1.0, 10_000.0)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    after = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    host = F.regexp_extract(after, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.regexp_replace(after, r"(?s)^[^/?#]*", ""), r"^[^?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), path


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule whose host is the page's or a parent of it and whose path begins the page's."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: len(r[1])):  # the longest is asked first
        its_host, slash, rest = text.partition("/")
        fits = ((host == its_host) | host.endswith(f".{its_host}")) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def domain_parts(host: Column, suffixes: list[str]) -> tuple[Column, Column]:
    """(registered domain, public suffix). The suffix is the longest listed one, else the last label."""
    last = F.substring_index(host, ".", -1)
    suffix = last
    for s in sorted(suffixes, key=len):
        suffix = F.when((host == s) | host.endswith(f".{s}"), F.lit(s)).otherwise(suffix)
    labels = F.size(F.split(suffix, r"\.")) + 1
    return F.array_join(F.slice(F.split(host, r"\."), -F.least(labels, F.size(F.split(host, r"\."))), labels), "."), suffix


def _strength(groups: DataFrame, mean: float) -> float:
    """Method of moments: prior strength from the spread of the groups' bad rates around ``mean``, beyond binomial noise."""
    one = groups.where("n > 0").agg(
        F.count("*").alias("k"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.sum(F.col("n") * F.pow(F.col("bad") / F.col("n") - mean, F.lit(2.0))).alias("spread")
    ).first()
    noise = mean * (1 - mean)
    room = (one["n"] or 0) - (one["nn"] or 0) / one["n"] if one["n"] else 0
    if room <= 0 or noise <= 0:
        return STRENGTH[1]
    between = (one["spread"] - (one["k"] - 1) * noise) / room
    return STRENGTH[1] if between <= 0 else min(max(noise / between - 1, STRENGTH[0]), STRENGTH[1])


def host_reputation(outcomes: DataFrame, suffixes: list[str]) -> DataFrame:
    """(host, rate, bound): posterior mean and lower bound of the bad rate of every host in (host, bad), bad 0, 1 or null."""
    hosts = outcomes.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    domain, suffix = domain_parts(F.col("host"), suffixes)
    hosts = materialize(hosts.withColumn("domain", domain).withColumn("suffix", suffix))
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    tops = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    total = tops.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    mean = total["bad"] / total["n"] if total["n"] else 0.0
    top, mid, low = (_strength(level, mean) for level in (tops, domains, hosts))
    # The level above a group is taken without the group's own outcomes: they would count twice.
    tops = tops.select("suffix", F.col("n").alias("n_top"), F.col("bad").alias("bad_top"))
    up = (F.lit(top * mean) + F.col("bad_top") - F.col("bad")) / (top + F.col("n_top") - F.col("n"))
    domains = domains.join(tops, "suffix").select("domain", "suffix", F.col("n").alias("n_mid"), F.col("bad").alias("bad_mid"), up.alias("up"))
    hosts = hosts.join(domains, ["domain", "suffix"])
    prior = (mid * F.col("up") + F.col("bad_mid") - F.col("bad")) / (mid + F.col("n_mid") - F.col("n"))
    a, b = low * prior + F.col("bad"), low * (1 - prior) + F.col("n") - F.col("bad")
    rate = a / (a + b)
    bound = rate - DEVIATIONS * F.sqrt(rate * (1 - rate) / (a + b + 1))
    return hosts.select("host", rate.alias("rate"), bound.alias("bound"))


def judge(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str]], suffixes: list[str], page_key: Column, outcome_key: str = "doc_id") -> DataFrame:
    """Per page: page_id, host, path, rule, verdict, and the host's rate and bound. outcomes: (outcome_key, bad); page_key gives a
    page's outcome."""
    host, path = host_and_path(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    known = outcomes.where(F.col("bad").isNotNull()).groupBy(F.col(outcome_key).alias("_key")).agg(F.max("bad").alias("bad"))
    keyed = pages.select(host.alias("host"), page_key.alias("_key"))
    scored = host_reputation(keyed.join(sized(materialize(known)), "_key", "left").select("host", "bad"), suffixes)
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    judged = parts.join(sized(materialize(scored)), "host")
    method = F.when(F.col("bound") > LIMIT, F.lit("block")).otherwise(F.lit("allow"))
    return judged.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"), "rate", "bound")
