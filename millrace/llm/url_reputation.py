"""URL filter: explicit rules first, then empirical-Bayes reputation of the host. DataFrame functions only.

Labelled page outcomes (bad or not) are counted by host. Rates are shrunk level by level: all pages, public suffix,
registered domain, host. Each level's beta prior has the mean of the level above and a strength, the same for the whole
level, fitted by the method of moments to the spread of its members' rates. A host is blocked if even a low quantile of
its posterior bad rate (mean minus z standard deviations) exceeds the limit, so little evidence never blocks by itself.

Nulls: a null url, or one without ``://``, has an empty host and path; no rule fits it, and the empty host is judged by its
labels like any other. Rows of `labels` with a null id or null outcome teach nothing. Repeated pages each get a row; repeated labels of one page
each count. Empty tables: no pages, no rows; no labels, everything without a rule is allowed.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: host/path -> verdict
RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
#: Public suffixes of more than one label; any other host's suffix is its last label.
SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "net.au", "co.jp", "co.nz", "com.br", "co.in", "co.za")

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_of(url: Column) -> Column:
    after = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(after, F.lit("")), _UPPER, _UPPER.lower())


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def suffix_of(host: Column, suffixes: Sequence[str] = SUFFIXES) -> Column:
    last = F.substring_index(host, ".", -1)
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*suffixes) & (two != host), two).otherwise(last) if suffixes else last


def domain_of(host: Column, suffixes: Sequence[str] = SUFFIXES) -> Column:
    two, three = F.substring_index(host, ".", -2), F.substring_index(host, ".", -3)
    return F.when(two.isin(*suffixes), three).otherwise(two) if suffixes else two


def rule_of(host: Column, path: Column, rules: Mapping[str, str] = RULES) -> Column:
    """The longest rule that fits, else null."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit("/" + rest))
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def _shrunk(own: DataFrame, above: DataFrame, key: str, up: str, least: float, most: float) -> DataFrame:
    """own: key, up, n, bad. above: up, mean. Adds the strength of the level's prior and the posterior's a and b."""
    joined = own.join(above, up, "left") if up else own.withColumn("mean", above.scalar())
    # Moments of a beta-binomial level: with r_i the rates and m_i the prior means,
    # E[n_i (r_i - m_i)^2] = m_i (1 - m_i) (1 + (n_i - 1) / (k + 1)), summed over the level and solved for k.
    spread = F.col("mean") * (1 - F.col("mean"))
    sums = joined.agg(
        F.sum(F.col("n") * F.pow(F.col("bad") / F.col("n") - F.col("mean"), 2)).alias("seen"),
        F.sum(spread).alias("base"),
        F.sum(spread * (F.col("n") - 1)).alias("slope"),
    )
    rho = F.least(F.greatest((F.col("seen") - F.col("base")) / F.col("slope"), F.lit(1.0 / (most + 1))), F.lit(1.0 / (least + 1)))
    strength = sums.select(F.round(F.coalesce(F.when(F.col("slope") > 0, 1 / rho - 1), F.lit(most)), 6).alias("strength"))
    joined = joined.withColumn("strength", strength.scalar())
    a = F.col("bad") + F.col("mean") * F.col("strength")
    return joined.select(key, (a / (F.col("n") + F.col("strength"))).alias("mean"), (F.col("n") + F.col("strength")).alias("weight"))


def reputation(outcomes: DataFrame, *, least: float = 2.0, most: float = 1000.0, suffixes: Sequence[str] = SUFFIXES) -> dict[str, DataFrame]:
    """outcomes: host, bad (0 or 1). By level (all, suffix, domain, host): the name, posterior mean and weight.

    A hot host is summed map-side before its counts move, and later levels sum the level below, so no level has a row
    for each page. No table is broadcast but those of exactly one row.
    """
    host = outcomes.where(F.col("bad").isNotNull()).groupBy("host").agg(F.count("*").alias("n"), F.sum("bad").cast("long").alias("bad"))
    host = host.withColumn("domain", domain_of(F.col("host"), suffixes)).withColumn("suffix", suffix_of(F.col("host"), suffixes))
    domain = host.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffix = domain.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    top = suffix.agg(((F.coalesce(F.sum("bad"), F.lit(0)) + 0.5) / (F.coalesce(F.sum("n"), F.lit(0)) + 1.0)).alias("mean"), F.lit(most).alias("weight"))
    by_suffix = _shrunk(suffix, top.select("mean"), "suffix", "", least, most)
    by_domain = _shrunk(domain, by_suffix.select("suffix", "mean"), "domain", "suffix", least, most)
    by_host = _shrunk(host, by_domain.select("domain", "mean"), "host", "domain", least, most)
    return {"all": top, "suffix": by_suffix, "domain": by_domain, "host": by_host}


def judge(pages: DataFrame, outcomes: DataFrame, *, rules: Mapping[str, str] = RULES, limit: float = 0.5, z: float = 1.645, url: str = "url", keep: Sequence[str] = ("page_id",), suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """keep, host, path, rule, verdict, bad_rate, bad_bound for each page.

    outcomes: host, bad. A host without labels takes its domain's posterior, else its suffix's, else that of all pages.
    Posteriors are looked up once for each distinct host, then joined to pages by host: an equi-join whose hot keys Spark
    can split, as nothing above it needs the pages of a host together.
    """
    base = pages.select(*[F.col(c) for c in keep], host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    levels = reputation(outcomes, suffixes=suffixes)
    hosts = base.groupBy("host").agg(domain_of(F.first("host"), suffixes).alias("domain"), suffix_of(F.first("host"), suffixes).alias("suffix"))
    known = hosts
    for level in ("host", "domain", "suffix"):
        known = known.join(levels[level].select(level, F.col("mean").alias(f"{level}_mean"), F.col("weight").alias(f"{level}_weight")), level, "left")
    pick = lambda what: F.coalesce(*[F.col(f"{level}_{what}") for level in ("host", "domain", "suffix")], levels["all"].select(what).scalar())
    mean, weight = pick("mean"), pick("weight")
    known = known.select("host", F.round(mean, 9).alias("bad_rate"), F.round(mean - z * F.sqrt(mean * (1 - mean) / (weight + 1)), 9).alias("bad_bound"))
    rule = rule_of(F.col("host"), F.col("path"), rules)
    verdict = F.coalesce(*[F.when(F.col("rule") == r, F.lit(v)) for r, v in rules.items()], F.when(F.col("bad_bound") > limit, F.lit("block")).otherwise(F.lit("allow")))
    judged = base.join(known, "host", "left").withColumn("rule", rule)
    return judged.select(*keep, "host", "path", "rule", verdict.alias("verdict"), "bad_rate", "bad_bound")


def outcomes_from_labels(pages: DataFrame, labels: DataFrame, *, url: str = "url") -> DataFrame:
    """host, bad of labelled pages: a page is bad if its label says poor quality or toxic. Labels meet pages by id."""
    bad = ((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int")
    marks = labels.select(F.col("doc_id").alias("page_id"), bad.alias("bad"))
    return pages.select("page_id", host_of(F.col(url)).alias("host")).join(marks, "page_id").select("host", "bad")
