"""Registered domains under public-suffix rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.net import clean_name, is_ip


def suffix_rules(rules: DataFrame, rule: str) -> DataFrame:
    """(tail, depth, exception) of rules as public lists have them: `co.uk`, `*.ck`, `!www.ck`.

    tail is what a name has to end in, depth the number of labels of the public suffix then.
    """
    text = F.lower(F.trim(rule))
    tail = F.regexp_replace(text, r"^(!|\*\.)", "")
    labels = F.size(F.split(tail, r"\."))
    exception, wild = F.startswith(text, F.lit("!")), F.startswith(text, F.lit("*."))
    depth = F.when(exception, labels - 1).when(wild, labels + 1).otherwise(labels)
    known = rules.where((tail != "") & ~F.startswith(text, F.lit("//")) & (text != "*"))
    return known.select(tail.alias("tail"), depth.alias("depth"), exception.alias("exception")).distinct()


def registered_domains(df: DataFrame, column: str, rules: DataFrame, rule: str) -> DataFrame:
    """df with `subdomain`, `registered_domain` and `suffix` of a name.

    A name's tails of every depth are joined to the rules. Of those that fit, an exception counts
    before others, then the rule of most labels; without any, the last label is the suffix. All
    three are blank for addresses and blank names, and the registered domain is for a bare suffix.
    """
    probes = df.select(F.col(column).alias("_probe")).distinct()
    probes = probes.withColumn("_name", clean_name(F.col("_probe"))).where(F.col("_name").isNotNull() & ~is_ip(F.col("_name"))).withColumn("_labels", F.split("_name", r"\."))
    n = F.size("_labels")
    tail = lambda k: F.array_join(F.slice("_labels", F.greatest(n - k + 1, F.lit(1)), k), ".")
    each = probes.select("_probe", n.alias("_n"), F.explode(F.transform(F.sequence(F.lit(1), n), tail)).alias("tail"))
    best = each.join(suffix_rules(rules, rule), "tail").where(F.col("depth") <= F.col("_n")).groupBy("_probe").agg(F.max(F.struct("exception", "depth")).alias("_best"))
    found = probes.join(best, "_probe", "left").withColumn("_depth", F.greatest(F.coalesce("_best.depth", F.lit(1)), F.lit(1)))
    d = F.col("_depth")
    parts = found.select(
        "_probe",
        F.when(n > d + 1, F.array_join(F.slice("_labels", F.lit(1), n - d - 1), ".")).otherwise("").alias("subdomain"),
        F.when(n > d, tail(d + 1)).otherwise("").alias("registered_domain"),
        tail(d).alias("suffix"),
    )
    out = df.join(parts, df[column].eqNullSafe(parts["_probe"]), "left").drop("_probe")
    return out.fillna("", ["subdomain", "registered_domain", "suffix"])
