"""URL filter: fixed rules first, then the reputation of the host.

Reputation is empirical Bayes over labelled page outcomes. A beta prior comes
down from all pages to the public suffix, the registered domain and the host,
each time from the parent's other pages. Its strength at each level is fitted by
the method of moments from how much the members of that level differ, and never
exceeds what is known of the parent. A host is blocked when the upper posterior bound
of its share of good pages is under the threshold, so only hosts with evidence
against them go.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.llm.common import pinned

# (verdict, host, path). The longest rule that fits wins.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
# Public suffixes of two labels under which anyone may register.
TWO_LABEL_SUFFIXES = ("ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.au", "com.br", "com.cn",
                      "com.mx", "com.tr", "gov.uk", "ne.jp", "net.au", "or.jp", "org.au", "org.br", "org.uk")
GOOD_SHARE = 0.5
Z = 1.6449  # one-sided 95 %
MIN_STRENGTH, MAX_STRENGTH = 1.0, 1000.0


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): both empty for a null url or one without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.coalesce(F.regexp_extract(rest, r"^([^/?#]*)", 1), F.lit(""))
    path = F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))
    return F.translate(host, ascii_uppercase, ascii_lowercase), path


def rule_column(host: Column, path: Column, rules=RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, else null. ``rules`` is a short fixed list."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        found = F.when(
            fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))
        ).otherwise(found)
    return found


def host_levels(hosts: DataFrame) -> DataFrame:
    """Adds the registered domain and the public suffix of ``host``."""
    two = F.substring_index("host", ".", -2)
    labels = F.when(two.isin(*TWO_LABEL_SUFFIXES), 2).otherwise(1)
    suffix = F.when(labels == 2, two).otherwise(F.substring_index("host", ".", -1))
    domain = F.when(labels == 2, F.substring_index("host", ".", -3)).otherwise(two)
    return hosts.withColumn("domain", domain).withColumn("suffix", suffix)


def _under(level: DataFrame, a: Column, b: Column) -> DataFrame:
    """Adds the parent's mean ``m`` and weight ``others``, both without the member's own pages."""
    good, bad = a - F.col("good"), b - (F.col("n") - F.col("good"))
    return level.withColumn("others", good + bad).withColumn("m", good / (good + bad))


def _strength(level: DataFrame) -> float:
    """Method-of-moments prior strength of one level: members (good, n) against their parent's mean ``m``.

    With S = sum n (share - m)^2, E[S] = N + (I - N) / (strength + 1), where N
    sums m (1 - m) over the members and I sums it over their pages.
    """
    noise = F.col("m") * (1 - F.col("m"))
    row = level.filter("n > 0").agg(
        F.count(F.lit(1)).alias("members"), F.sum("n").alias("pages"), F.sum(noise).alias("noise"),
        F.sum(F.col("n") * noise).alias("inner"),
        F.sum(F.col("n") * F.pow(F.col("good") / F.col("n") - F.col("m"), 2)).alias("spread"),
    ).first()
    if row.members < 2 or row.pages <= row.members or row.spread <= row.noise:
        return MAX_STRENGTH
    return min(max((row.inner - row.noise) / (row.spread - row.noise) - 1, MIN_STRENGTH), MAX_STRENGTH)


def host_reputation(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per host: host, n_labelled, good_mean, good_upper.

    ``pages`` has page_id and host, ``labels`` page_id and good (0/1). Counts
    shrink from pages to hosts before anything else, so a host with a third of
    all pages is one row from the first map-side aggregate on.
    """
    outcome = labels.filter(F.col("good").isNotNull() & F.col("page_id").isNotNull()).groupBy("page_id").agg(
        F.max("good").alias("good")
    )
    seen = (
        pages.join(outcome, "page_id", "left").groupBy("host")
        .agg(F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).cast("double").alias("good"))
    )
    hosts = pinned(host_levels(seen))
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    # All pages: one pseudo page each way.
    world = hosts.agg(F.coalesce(F.sum("good"), F.lit(0.0)).alias("good"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    top = F.lit(world.good + 1.0), F.lit(world.n - world.good + 1.0)
    level = _under(suffixes, *top)
    for below, key in ((domains, "suffix"), (hosts, "domain"), (None, "host")):
        strength = F.least(F.lit(_strength(level)), F.col("others"))
        level = level.withColumn("a", F.col("m") * strength + F.col("good")).withColumn(
            "b", (1 - F.col("m")) * strength + F.col("n") - F.col("good")
        )
        if below is not None:
            above = level.select(key, F.col("a").alias("up_a"), F.col("b").alias("up_b"))
            level = _under(below.join(above, key), F.col("up_a"), F.col("up_b"))
    mean, total = F.col("a") / (F.col("a") + F.col("b")), F.col("a") + F.col("b")
    sd = F.sqrt(mean * (1 - mean) / (total + 1))
    return level.select(
        "host", F.col("n").alias("n_labelled"), mean.alias("good_mean"), F.least(mean + Z * sd, F.lit(1.0)).alias("good_upper")
    )


def filter_urls(pages: DataFrame, labels: DataFrame, rules=RULES, good_share: float = GOOD_SHARE) -> DataFrame:
    """Verdict per row of ``pages`` (page_id, url): page_id, host, path, rule, verdict, n_labelled, good_mean, good_upper.

    ``labels`` has page_id and good. A null or malformed url has empty host
    and path and is judged like any other host (the empty one). Repeated rows
    stay repeated. Without any labels every host keeps the flat prior and
    passes. An empty table gives no rows; other columns are ignored.
    """
    host, path = url_parts(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    known = host_reputation(parts.select("page_id", "host"), labels)
    judged = parts.withColumn("found", rule_column(F.col("host"), F.col("path"), rules)).join(known, "host", "left")
    method = F.when(F.col("good_upper") < good_share, "block").otherwise("allow")
    return judged.select(
        "page_id", "host", "path", F.col("found.rule").alias("rule"),
        F.coalesce(F.col("found.verdict"), method).alias("verdict"), "n_labelled", "good_mean", "good_upper",
    )
