"""Builds of rule tables from their sources."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ids import uuid5
from ..operators.joins import cascade, overlaid, two_hops
from ..operators.merges import conflict_merge, last_by_priority, united

API_KEY = ["framework", "package_name", "class_name", "method_name", "api_type"]


def privacy_apis(sources: Sequence[DataFrame]) -> DataFrame:
    """API rules of all sources as one row per API, with a stable id."""
    rows = sources[0]
    for s in sources[1:]:
        rows = rows.unionByName(s, allowMissingColumns=True)
    whole = F.lit(True)
    for k in API_KEY:
        whole = whole & (F.coalesce(F.col(k), F.lit("")) != "")
    merged = united(rows.where(whole), API_KEY, ["sources", "source_versions", "android_versions"], "category", "pos", "min_level", "max_level")
    return merged.withColumn("record_id", uuid5(F.concat(F.lit("privacy-api://"), F.concat_ws("/", *API_KEY))))


def source_rows(found: DataFrame, framework: str, source: str, version: str, confidence: str, pos: int = 0) -> DataFrame:
    """Rows (package_name, class_name, method_name, permission, level) of one source as API rules with where they come from; of several sources that of the least pos counts first."""
    return found.select(
        F.lit(framework).alias("framework"), "package_name", "class_name", "method_name", F.lit("method").alias("api_type"), "permission", F.array(F.lit(source)).alias("sources"),
        F.array(F.lit(version)).alias("source_versions"), F.array(F.col("level")).alias("android_versions"), F.lit("unknown").alias("category"), F.col("level").alias("min_level"),
        F.col("level").alias("max_level"), F.lit(confidence).alias("confidence"), F.lit(pos).alias("pos"),
    )


def enabled(artifacts: DataFrame, flag: str = "enabled") -> DataFrame:
    """Artifacts whose flag is true, whatever its case (F16)."""
    return artifacts.where(F.lower(F.trim(flag)) == "true")


def categorised(apis: DataFrame, methods: DataFrame, classes: DataFrame, packages: DataFrame, keywords: DataFrame) -> DataFrame:
    """APIs with the category of the most specific rule that agrees."""
    name = F.concat_ws(".", "package_name", "class_name")
    known = apis.drop("category").withColumn("_class", name).withColumn("_method", F.concat_ws(".", name, "method_name"))
    out = cascade(known, [("_method", methods), ("_class", classes), ("package_name", packages)], "_method", keywords)
    return out.drop("_class", "_method")


def permission_categories(apis: DataFrame, groups: DataFrame, categories: DataFrame) -> DataFrame:
    """APIs with the privacy category of their permission's group."""
    return two_hops(apis, "permission", groups, categories, "privacy_category")


def trackers(sources: DataFrame) -> DataFrame:
    """Tracker rules of several data sets by domain: by priority, blanks filled, conflicts marked."""
    return conflict_merge(sources, "domain_suffix", ["canonical_vendor", "vendor", "category"], "source_dataset", "priority")


def resolvers(listed: DataFrame, checked: DataFrame) -> DataFrame:
    """Resolver rules with the checked ones laid over the listed."""
    return overlaid(listed, checked, "ip_address", ["provider", "canonical_provider", "resolver_name", "provider_country", "confidence"], ["supports_doh", "supports_dot", "supports_dnscrypt"])


def patterns(sources: DataFrame) -> DataFrame:
    """Personal-data patterns, those of the highest confidence kept."""
    rank = F.when(F.col("confidence") == "HIGH", 2).when(F.col("confidence") == "MEDIUM", 1).otherwise(0)
    return last_by_priority(sources.withColumn("rank", rank), ["pattern_name"], ["rank", "regex"]).drop("rank")
