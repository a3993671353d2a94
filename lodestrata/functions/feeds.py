"""Fields of vulnerability feeds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def product_of(name: Column) -> Column:
    """struct(vendor, product) of a CPE 2.3 name; escaped colons stay in their field, escapes are taken off."""
    hidden = F.replace(name, F.lit("\\:"), F.lit("\u0001"))
    fields = F.split(hidden, ":")
    at = lambda i: F.translate(F.replace(F.get(fields, F.lit(i)), F.lit("\u0001"), F.lit(":")), "\\", "")
    whole = F.size(fields) >= 5
    return F.struct(F.when(whole, at(3)).alias("vendor"), F.when(whole, at(4)).alias("product"))


def best_score(v31: Column, v30: Column, v2: Column) -> Column:
    """struct(version, score, severity) of the newest metric, its primary entry first.

    Entries are struct(type, version, score, severity); a missing version is that of the metric.
    """

    def pick(entries: Column, version: str) -> Column:
        chosen = F.coalesce(F.get(F.filter(entries, lambda e: e["type"] == "Primary"), F.lit(0)), F.get(entries, F.lit(0)))
        found = F.struct(
            F.coalesce(chosen["version"], F.lit(version)).alias("version"),
            chosen["score"].try_cast("double").alias("score"),
            F.upper(chosen["severity"]).alias("severity"),
        )
        return F.when(F.size(entries) > 0, found)

    return F.coalesce(pick(v31, "3.1"), pick(v30, "3.0"), pick(v2, "2.0"))
