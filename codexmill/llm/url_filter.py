"""URL filter: Empirical-Bayes host reputation behind explicit rules.

Labelled page outcomes (1 good, 0 bad) are summed per host and shrunk through
beta-binomial priors: the overall rate is the prior mean of a suffix, the
posterior mean of a suffix that of its registered domains, and that of a
registered domain the prior mean of its hosts. The prior strength of each level
is estimated from the data (moments of the between-group variance inside the
parents). A host passes if the lower bound of its posterior,
``mean - z * standard deviation``, is at least ``min_rate``; a host without
labels is judged by its prior, so by its registered domain.

Explicit rules come first; the longest that fits wins.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, written

#: Limits of an estimated prior strength, and its value where no level has two groups.
STRENGTH_MIN, STRENGTH_MAX, STRENGTH_DEFAULT = 2.0, 1000.0, 10.0
#: Up to so many rules are expressions of the plan, more are a table that the pages join; both give the same.
EXPRESSION_RULES = 1000
# Labels under which countries register domains.
COUNTRY_LABELS = "ac co com edu go gob gouv gov mil ne net nom or org sch".split()
COUNTRY_SUFFIX = rf"(^|\.)({'|'.join(COUNTRY_LABELS)})\.[a-z]{{2}}\z"
IPV4 = r"\A[0-9]+(\.[0-9]+){3}\z"


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


def host_of(url: Column) -> Column:
    """From after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def site_of(host: Column) -> Column:
    """The host without user info, port and the final dot of a full name."""
    return F.regexp_replace(F.regexp_replace(host, r"(?s)\A.*@", ""), r"\.?(:[0-9]*)?\z", "")


def suffix(site: Column) -> Column:
    """The last label, with the label before it where countries register domains below that (``co.uk``); none of an IPv4 address."""
    return F.when(site.rlike(IPV4), "").when(site.rlike(COUNTRY_SUFFIX), F.substring_index(site, ".", -2)).otherwise(F.substring_index(site, ".", -1))


def registered_domain(site: Column) -> Column:
    """The suffix and the label before it; an IPv4 address is its own."""
    return F.when(site.rlike(IPV4), site).when(site.rlike(COUNTRY_SUFFIX), F.substring_index(site, ".", -3)).otherwise(F.substring_index(site, ".", -2))


def _longest_first(rules: list[Rule]) -> list[Rule]:
    return sorted(rules, key=lambda r: -len(r.host + r.path))


def rule_column(host: Column, path: Column, rules: list[Rule], value) -> Column:
    """``value(rule)`` of the longest rule that fits, of equally long ones the first, else null. A rule fits its host and all subdomains by path prefix."""
    out = None
    for r in _longest_first(rules):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        out = F.when(fits, value(r)) if out is None else out.when(fits, value(r))
    return F.lit(None).cast("string") if out is None else out


def _ruled_by_table(parsed: DataFrame, rules: list[Rule]) -> DataFrame:
    """``parsed`` with ``_hit``, the fitting rule as ``rule_column`` chooses it, by equality of host suffix and path prefix.

    Each distinct host and path asks for its suffixes, as many labels as rules have,
    and for its prefixes of the lengths that the rules of such a host have.
    """
    spark = parsed.sparkSession
    listed = spark.createDataFrame([(at, r.verdict, r.host, r.path) for at, r in enumerate(_longest_first(rules))], "at int, verdict string, rule_host string, rule_path string")
    listed = listed.groupBy("rule_host", "rule_path").agg(F.min_by(F.struct("at", "verdict"), "at").alias("hit"))
    lengths = listed.groupBy("rule_host").agg(F.collect_set(F.length("rule_path")).alias("lengths"))
    labels = max(r.host.count(".") for r in rules) + 1
    pages = parsed.select("host", "path").distinct()
    parts = F.split("host", r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.least(F.lit(labels), F.size(parts))), lambda i: F.array_join(F.slice(parts, -i, i), "."))
    asked = pages.select("host", "path", F.explode(ends).alias("rule_host")).join(lengths, "rule_host")
    fitting = F.filter("lengths", lambda n: n <= F.length("path"))
    asked = asked.select("host", "path", "rule_host", F.explode(fitting).alias("n")).withColumn("rule_path", F.substring("path", F.lit(1), F.col("n")))
    best = asked.join(listed, ["rule_host", "rule_path"]).withColumn("rule", F.concat("rule_host", "rule_path"))
    best = best.groupBy("host", "path").agg(F.min_by(F.struct("rule", "hit.verdict"), "hit.at").alias("_hit"))
    return parsed.join(best, ["host", "path"], "left")


def prior_strength(groups: DataFrame, parent: str) -> float:
    """Strength of the beta prior that ``parent`` lends its groups ``(n, s)``; one row reaches the driver."""
    own = F.col("s") * F.col("s") / F.col("n")
    by = groups.where("n > 0").groupBy(parent).agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("sn"), F.sum("s").alias("ss"), F.sum(F.col("n") * F.col("n")).alias("q"), F.sum(own).alias("own"))
    r = by.agg(
        F.sum(F.col("k") - 1).alias("between"),
        F.sum(F.col("sn") - F.col("k")).alias("within"),
        F.sum(F.col("own") - F.col("ss") * F.col("ss") / F.col("sn")).alias("ssb"),
        F.sum(F.col("ss") - F.col("own")).alias("ssw"),
        F.sum(F.col("sn") - F.col("q") / F.col("sn")).alias("n0"),
    ).first()
    if not r["between"] or not r["within"]:
        return STRENGTH_DEFAULT
    msb, msw, n0 = r["ssb"] / r["between"], r["ssw"] / r["within"], r["n0"] / r["between"]
    spread = msb + (n0 - 1) * msw
    rho = (msb - msw) / spread if spread > 0 else 0.0
    return min(STRENGTH_MAX, max(STRENGTH_MIN, 1 / rho - 1)) if rho > 0 else STRENGTH_MAX


def host_reputation(outcomes: DataFrame, z: float = 1.645) -> DataFrame:
    """One row per host (without user info and port) of ``outcomes(host, good)`` with its posterior.

    ``good`` is 1, 0 or null (not labelled). Columns: host, n, s, mean, sd, bound.
    Hosts are aggregated on the map side first, so one host may hold any share of
    the rows. An empty table gives no rows.
    """
    hosts = outcomes.withColumn("host", site_of(F.col("host"))).groupBy("host").agg(F.count("good").cast("double").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).cast("double").alias("s"))
    hosts = written(hosts.withColumns({"domain": registered_domain(F.col("host")), "suffix": suffix(F.col("host"))}), "hosts")
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).withColumn("everything", F.lit(1))
    all_in = suffixes.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    rate = ((all_in["s"] or 0) + 1) / ((all_in["n"] or 0) + 2)
    of_suffix, of_domain, of_host = prior_strength(suffixes, "everything"), prior_strength(domains, "suffix"), prior_strength(hosts, "domain")

    suffixes = suffixes.select("suffix", ((of_suffix * rate + F.col("s")) / (of_suffix + F.col("n"))).alias("suffix_mean"))
    domains = domains.join(suffixes, "suffix").select("domain", "suffix", ((of_domain * F.col("suffix_mean") + F.col("s")) / (of_domain + F.col("n"))).alias("domain_mean"))
    total = F.col("n") + of_host
    out = hosts.join(domains, ["domain", "suffix"]).withColumn("mean", (of_host * F.col("domain_mean") + F.col("s")) / total)
    out = out.withColumn("sd", F.sqrt(F.col("mean") * (1 - F.col("mean")) / (total + 1)))
    return out.select("host", "n", "s", "mean", "sd", (F.col("mean") - z * F.col("sd")).alias("bound"))


def judge_urls(pages: DataFrame, rules: list[Rule], url: str = "url", good: str = "good", min_rate: float = 0.5, z: float = 1.645) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule``, ``bound`` and ``verdict`` (``allow`` or ``block``).

    A null url, or one without ``://``, has an empty host and path and is judged
    as the host ``''``. User info and port belong to the host of a rule, but not to
    that of a reputation. Repeated pages each keep their row and each count as an
    outcome. Any number of rules is taken; of equally long ones that fit the first
    in the list decides. Columns named like the added ones are replaced.
    """
    names = ["host", "path", "rule", "bound", "verdict"]
    rest = [F.col(f"`{c}`") for c in pages.columns if c not in names]
    parsed = pages.select(F.struct(*rest).alias("_row"), host_of(F.col(f"`{url}`")).alias("host"), path_of(F.col(f"`{url}`")).alias("path"), F.col(f"`{good}`").alias("good"))
    reputation = host_reputation(parsed.select("host", "good"), z).select(F.col("host").alias("_site"), "bound")
    host, path = F.col("host"), F.col("path")
    if len(rules) > EXPRESSION_RULES:
        ruled = _ruled_by_table(parsed, rules)
    else:
        hit = rule_column(host, path, rules, lambda r: F.struct(F.lit(r.host + r.path).alias("rule"), F.lit(r.verdict).alias("verdict")))
        ruled = parsed.withColumn("_hit", hit if rules else F.lit(None).cast("struct<rule:string,verdict:string>"))
    judged = ruled.withColumn("_site", site_of(host)).join(reputation, "_site", "left")
    by_bound = F.when(F.col("bound") >= min_rate, "allow").otherwise("block")
    return judged.select("_row.*", "host", "path", F.col("_hit.rule").alias("rule"), "bound", F.coalesce("_hit.verdict", by_bound).alias("verdict"))
