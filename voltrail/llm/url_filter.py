"""URL filter: rules first, then the reputation of the host by empirical Bayes.

A rule is a host and the start of a path; it fits the host and its subdomains, and the longest rule wins. Pages that no
rule judges are judged by their host. Labelled page outcomes (1 bad, 0 good) are counted by host, registered domain and
public suffix. Each level's rate is shrunk to its parent's by a beta-binomial prior: suffix to all pages, domain to
suffix, host to domain. The strength of each prior comes from the spread of the rates below it (method of moments).
A host is blocked when the lower bound of its posterior bad rate exceeds ``threshold``.
Everything runs in DataFrame functions; rules and suffixes are short lists given by the caller and become expressions.

Defined results: a null url, or one without ``://``, has an empty host and an empty path, fits no rule, and shares the
reputation of the empty host. Without any label every page is allowed. An empty table gives no rows.
Repeated rows and ids stay and are judged each by its url; very long urls are read whole.
Other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from voltrail.llm.common import lower_ascii, store, text_of
from voltrail.llm.empirical_bayes import overall_rate, shrunk

Rule = tuple[str, str, str]  # host, start of the path, allow or block

#: Public suffixes of more than one label; any other last label is a suffix by itself.
LONG_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "org.au", "co.nz", "co.jp", "co.in", "co.kr", "co.za",
                 "com.br", "com.mx", "com.ar", "com.tr", "com.cn", "github.io", "blogspot.com")
#: A host is blocked when its bad rate is above the threshold with this many standard deviations to spare.
THRESHOLD, DEVIATIONS = 0.5, 1.645


def host_of(url: Column) -> Column:
    return lower_ascii(F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1)


def matched_rule(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; null where none fits."""
    rule = verdict = F.lit(None).cast("string")
    for site, start, result in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):
        fits = ((host == site) | host.endswith("." + site)) & path.startswith(start)
        rule, verdict = F.when(fits, site + start).otherwise(rule), F.when(fits, result).otherwise(verdict)
    return rule, verdict


def suffix_of(host: Column, long_suffixes: Sequence[str] = LONG_SUFFIXES) -> Column:
    last = F.substring_index(host, ".", -1)
    return reduce(lambda rest, s: F.when((host == s) | host.endswith("." + s), F.lit(s)).otherwise(rest), long_suffixes, last)


def domain_of(host: Column, suffix: Column) -> Column:
    """The label before the suffix, with the suffix; the host itself where there is none."""
    labels = F.size(F.split(suffix, "\\.")) + 1
    parts = F.split(host, "\\.")
    return F.when(F.size(parts) <= labels, host).otherwise(F.array_join(F.slice(parts, F.size(parts) - labels + 1, labels), "."))


def reputation(outcomes: DataFrame, deviations: float = DEVIATIONS) -> DataFrame:
    """``outcomes``: (host, bad), bad 1, 0 or null for a page without label. One row per host: host, n, rate, low, high."""
    suffix = suffix_of(F.col("host"))
    hosts = store(outcomes.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")) \
        .withColumn("suffix", suffix).withColumn("domain", domain_of(F.col("host"), F.col("suffix"))), "hosts")
    counts = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]
    domains = hosts.groupBy("suffix", "domain").agg(*counts)
    suffixes = domains.groupBy("suffix").agg(*counts)
    overall = suffixes.agg(overall_rate().alias("all_rate"))
    suffixes = shrunk(suffixes.crossJoin(F.broadcast(overall)), "all_rate", "suffix_rate").select("suffix", "suffix_rate")
    domains = shrunk(domains.join(suffixes, "suffix"), "suffix_rate", "domain_rate").select("suffix", "domain", "domain_rate")
    scored = shrunk(hosts.join(domains, ["suffix", "domain"]), "domain_rate", "rate")
    margin = deviations * F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("weight") + 1))
    return scored.select("host", "n", "rate", F.greatest(F.col("rate") - margin, F.lit(0.0)).alias("low"),
                         F.least(F.col("rate") + margin, F.lit(1.0)).alias("high"))


def judge(pages: DataFrame, rules: Sequence[Rule], id_col: str = "page_id", url_col: str = "url", label: Column | None = None,
          threshold: float = THRESHOLD) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, bad_rate, low, high.

    ``label``: 1 bad, 0 good, null unknown, computed from the columns of ``pages``. By default the pages that a rule
    judges are the labelled ones: blocked is bad, allowed is good.
    """
    url = text_of(url_col)
    named = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"),
                         (F.lit(None).cast("int") if label is None else label.cast("int")).alias("label"))
    rule, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    ruled = named.withColumn("rule", rule).withColumn("ruled", verdict)
    bad = F.when(F.col("ruled") == "block", 1).when(F.col("ruled") == "allow", 0) if label is None else F.col("label")
    known = reputation(ruled.select("host", bad.alias("bad")))
    by_host = F.when(F.col("low") > threshold, "block").otherwise("allow")
    return ruled.join(known, "host", "left") \
        .select("page_id", "host", "path", "rule", F.coalesce("ruled", by_host).alias("verdict"),
                F.col("rate").alias("bad_rate"), "low", "high")
