"""URL verdicts by rules and by empirical-Bayes host reputation.

Page outcomes are beta-binomial in their host. The prior of a host is centred on the posterior mean
of its registered domain, the domain's on that of its suffix, and the suffix's on the overall rate;
the weight of each level's priors is estimated from how far its units stray from their centres. A
host is blocked when the lower bound of its posterior bad rate exceeds a limit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .line_dedup import LOWER, UPPER
from .storage import materialise

#: Standard deviations below the posterior mean, and the bad rate beyond which a host is blocked.
Z, LIMIT = 1.645, 0.5
#: Intraclass correlations outside these bounds are no use as priors.
LEAST_RHO, MOST_RHO = 0.001, 0.5
#: Rules are broadcast up to this many; beyond it, they are joined by a shuffle.
BROADCAST_RULES = 100_000
#: Second-level labels under which names are registered with two-letter suffixes.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "org")


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path, empty if the url is null or has no `://`."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def _parents(host: Column) -> tuple[Column, Column]:
    """Registered domain and suffix: the last two labels, or three under a second-level suffix; a single label is its own domain."""
    labels = F.split(host, "\\.", -1)
    n = F.size(labels)
    tail = lambda k: F.array_join(F.slice(labels, F.greatest(F.lit(1), n - k + 1), F.lit(k)), ".")
    double = (n >= 3) & (F.length(F.element_at(labels, -1)) == 2) & F.get(labels, n - 2).isin(*SECOND_LEVEL)
    domain = F.when(double, tail(3)).otherwise(tail(2))
    suffix = F.when(double, tail(2)).when(n > 1, tail(1)).otherwise("")
    return domain, suffix


def _posteriors(units: DataFrame, key: str) -> DataFrame:
    """units (key, n, bad, centre) with the posterior mean and weight of each, by the method of moments."""
    spread = F.col("centre") * (1 - F.col("centre"))
    stray = F.pow(F.col("bad") - F.col("n") * F.col("centre"), 2) - F.col("n") * spread
    rho = F.coalesce(F.try_divide(F.sum(stray), F.sum(F.col("n") * (F.col("n") - 1) * spread)), F.lit(LEAST_RHO))
    rho = units.agg(F.greatest(F.lit(LEAST_RHO), F.least(F.lit(MOST_RHO), rho)).alias("rho")).first()[0]
    weight = 1 / rho - 1
    total = F.col("n") + weight
    return units.select(key, ((F.col("bad") + weight * F.col("centre")) / total).alias("mean"), total.alias("weight"))


def reputations(hosts: DataFrame) -> DataFrame:
    """(host, mean, weight) of hosts (host, n, bad): the posterior bad rate and how many outcomes it is worth."""
    overall = hosts.agg(((F.coalesce(F.sum("bad"), F.lit(0)) + 0.5) / (F.coalesce(F.sum("n"), F.lit(0)) + 1.0)).alias("m")).first()[0]
    domain, suffix = _parents(F.col("host"))
    tree = materialise(hosts.withColumn("domain", domain).withColumn("suffix", suffix), "hosts")
    counts = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]
    suffixes = _posteriors(tree.groupBy("suffix").agg(*counts).withColumn("centre", F.lit(overall)), "suffix")
    domains = tree.groupBy("domain", "suffix").agg(*counts).join(suffixes.withColumnRenamed("mean", "centre").drop("weight"), "suffix")
    domains = materialise(_posteriors(domains, "domain"), "domains").withColumnRenamed("mean", "centre").drop("weight")
    return _posteriors(tree.join(domains, "domain"), "host")


def _with_rules(hosts: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """(host, rules): the rules (path, rule, verdict) of each host and of all domains above it."""
    rows = [(r.partition("/")[0], "/" + r.partition("/")[2], r, v) for v, r in rules]
    table = hosts.sparkSession.createDataFrame(rows, "at string, path string, rule string, verdict string")
    by_host = table.groupBy("at").agg(F.collect_set(F.struct("path", "rule", "verdict")).alias("own"))
    if len(rows) <= BROADCAST_RULES:
        by_host = F.broadcast(by_host)
    labels = F.split("host", "\\.", -1)
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    found = hosts.select("host", F.explode(above).alias("at")).join(by_host, "at")
    return found.groupBy("host").agg(F.flatten(F.collect_list("own")).alias("rules"))


def judge(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url: str = "url") -> DataFrame:
    """(id_col, host, path, rule, verdict, bad_rate) of every page.

    outcomes (id, bad): labelled pages, bad 0 or 1; an id that is labelled more than once is bad if
    any label is, and null ids and labels are ignored. rules: (verdict, `host/path`); a rule fits its
    host and all subdomains if the page's path starts with the rule's; the longest wins, and of two
    of the same text the one that blocks. Without a rule the host's reputation decides; a host
    without outcomes has that of its domain. Null urls have an empty host, which is a host like any
    other. Rows that repeat an id are judged each; empty tables give no rows; other columns are
    ignored.
    """
    source = pages.select(F.col(id_col).alias("id"), F.col(url).alias("url"))
    host, path = split_url(F.col("url"))
    split = source.select("id", host.alias("host"), path.alias("path"))
    known = outcomes.where("id is not null and bad is not null").groupBy("id").agg(F.max("bad").alias("bad"))
    labelled = split.join(known, "id", "left").groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    hosts = materialise(labelled, "outcomes")
    found = reputations(hosts).join(_with_rules(hosts.select("host"), rules), "host", "left")
    bound = F.col("mean") - Z * F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("weight") + 1))
    found = materialise(found.select("host", "rules", "mean", (bound > LIMIT).alias("blocked")), "reputations")
    fits = F.filter(F.coalesce("rules", F.array()), lambda r: F.startswith(F.col("path"), r["path"]))
    longest = F.array_max(F.transform(fits, lambda r: F.struct(F.length(r["rule"]), r["rule"].alias("rule"), r["verdict"].alias("verdict"))))
    judged = split.join(found, "host").withColumn("best", longest)
    verdict = F.coalesce("best.verdict", F.when(F.col("blocked"), "block").otherwise("allow"))
    return judged.select(
        F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), verdict.alias("verdict"), F.round("mean", 6).alias("bad_rate")
    )
