"""URL filter: rules first, else the empirical-Bayes reputation of the host.

Labelled page outcomes are counted for each host.  Three levels of beta-binomial models shrink
them: a suffix towards all pages, a registered domain towards its suffix, a host towards its
registered domain.  The strength of each level's prior is fitted by moments over the groups of
that level.  A page is blocked when the lower bound of its host's posterior share of bad pages
is above a threshold, so hosts with little evidence are judged by what stands above them.

Everything is built-in expressions.  Counts are pre-aggregated before every shuffle.  Pages are
shuffled once, by host; hosts that hold at least a thousandth of all pages (at most a thousand
hosts) are answered from a broadcast instead, and their pages are dealt by page, so no host can
fill one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, written

#: (host, path, verdict)
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
#: Suffixes of two labels, by default; every other suffix is the last label.  A fuller list is a parameter of ``judge``.
TWO_LABEL_SUFFIXES = ["ac.uk", "co.jp", "co.uk", "com.au", "com.br", "gov.uk", "org.uk"]
#: A posterior bound above this share of bad pages blocks.
THRESHOLD = 0.5
#: Standard deviations below the posterior mean.
Z = 1.645
#: Limits of a prior's strength in pages.
STRENGTH = (2.0, 1000.0)
#: A host is hot from this share of all pages; there are at most 1 / HOT of them.
HOT = 0.001


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return lower_ascii(host), path


def rule_for(host: Column, path: Column, rules: list) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none fits."""
    rule, verdict = None, None
    for h, p, v in sorted(rules, key=lambda r: -len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule.otherwise(none), verdict.otherwise(none))


def suffix_of(host: Column, suffixes: list[str] = TWO_LABEL_SUFFIXES) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(suffixes), two).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column, suffixes: list[str] = TWO_LABEL_SUFFIXES) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(suffixes), F.substring_index(host, ".", -3)).otherwise(two)


def _strength(groups: DataFrame, mean: str) -> DataFrame:
    """One row: the prior strength by moments over (n, bad, mean of what stands above)."""
    m = F.col(mean)
    spread = F.sum(F.pow(F.col("bad") / F.col("n") - m, 2) * F.col("n")) / F.sum("n")
    within = F.sum(m * (1 - m) * F.col("n")) / F.sum("n")
    size = F.sum("n") / F.count(F.lit(1))
    s = (within - spread) / (spread - within / size)
    fitted = F.when(spread <= within / size, F.lit(STRENGTH[1])).otherwise(F.least(F.greatest(s, F.lit(STRENGTH[0])), F.lit(STRENGTH[1])))
    return groups.agg(F.coalesce(fitted, F.lit(STRENGTH[1])).alias("s"))


def _shrunk(groups: DataFrame, mean: str, out: str) -> DataFrame:
    return groups.crossJoin(F.broadcast(_strength(groups, mean))).withColumn(out, (F.col("s") * F.col(mean) + F.col("bad")) / (F.col("s") + F.col("n"))).withColumnRenamed("s", f"s_{out}")


def reputation(pages: DataFrame, outcomes: DataFrame, suffixes: list[str] = TWO_LABEL_SUFFIXES) -> DataFrame:
    """Posterior of every host of ``pages(id, host)``: host, n_pages, n, bad, bound.

    ``outcomes(id, bad)`` has 0 or 1 for some pages; of repeated ids the worst counts.  Without
    any outcome the share of bad pages is 0 everywhere.  The one-row products are scalars
    (fitted strengths and the overall share), not joins of tables.
    """
    known = outcomes.where(F.col("id").isNotNull() & F.col("bad").isNotNull()).groupBy("id").agg(F.max("bad").alias("bad"))
    hosts = written(
        pages.join(known, "id", "left")
        .groupBy("host")
        .agg(F.count(F.lit(1)).alias("n_pages"), F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
        .withColumns({"domain": domain_of(F.col("host"), suffixes), "suffix": suffix_of(F.col("host"), suffixes)}),
        "host-counts",
    )
    seen = hosts.where("n > 0")
    suffixes = seen.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    overall = suffixes.agg(F.coalesce(F.sum("bad") / F.sum("n"), F.lit(0.0)).alias("m0"))
    suffixes = _shrunk(suffixes.crossJoin(F.broadcast(overall)), "m0", "m1").select("suffix", "m1")
    domains = seen.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).join(suffixes, "suffix")
    domains = _shrunk(domains, "m1", "m2").select("domain", "m2")
    strength = _strength(seen.join(domains, "domain"), "m2")
    m = F.coalesce("m2", "m1", "m0")
    a = F.col("s") * m + F.col("bad")
    b = F.col("s") * (1 - m) + F.col("n") - F.col("bad")
    return (
        hosts.join(domains, "domain", "left").join(suffixes, "suffix", "left").crossJoin(F.broadcast(overall)).crossJoin(F.broadcast(strength))
        .select("host", "n_pages", "n", "bad", (a / (a + b) - Z * F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))).alias("bound"))
    )


def judge(pages: DataFrame, outcomes: DataFrame, rules: list = RULES, suffixes: list[str] = TWO_LABEL_SUFFIXES, *, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``id_col, host, path, rule, verdict`` for every row of ``pages``.

    Null urls and urls without ``://`` have empty host and path and are judged as the host ''.
    Repeated ids and rows are all kept; very long urls are read whole; no other column is read.
    ``suffixes`` are the public suffixes of two labels.
    """
    host, path = host_and_path(F.coalesce(F.col(url_col), F.lit("")))
    rows = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    bound = reputation(rows.select("id", "host"), outcomes, suffixes)
    method = F.when(F.round("bound", 9) > THRESHOLD, "block").otherwise("allow")
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    hosts = written(bound.crossJoin(F.broadcast(total)).select("host", method.alias("method"), (F.col("n_pages") >= HOT * F.col("total")).alias("hot")), "hosts")
    hot = hosts.where("hot").select("host", F.col("method").alias("hot_method"))
    cold = hosts.where("NOT hot").select(F.col("host").alias("cold_host"), F.col("method").alias("cold_method"))
    # a space can't be in the key of a cold host's page by accident: it is the page's own key
    key = F.when(F.col("hot_method").isNull(), F.col("host")).otherwise(F.concat(F.lit(" "), F.xxhash64("id", "path").cast("string")))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    return (
        rows.join(F.broadcast(hot), "host", "left").withColumn("key", key)
        .join(cold, F.col("key") == F.col("cold_host"), "left")
        .select(F.col("id").alias(id_col), "host", "path", rule.alias("rule"), F.coalesce(verdict, "hot_method", "cold_method").alias("verdict"))
    )
