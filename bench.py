"""Times the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line.

Each time is the median of three runs in a warm session. The last three, of one run each, are lookups
against rule tables of the size of published ones: 47,217 name suffixes, 588 prefixes and 9,336 keywords.
"""

import json
import os
import time
from statistics import median

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions.net import url_host
from lodestrata.operators import joins, matching
from lodestrata.queries import QUERIES

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = [
    "cve_app_summary", "tracker_longest_suffix", "longest_prefix", "contains_best_match", "cidr_lookup", "ip_range_lookup", "cascade_rules", "keyword_search", "geo_rules", "pii_master",
    "secret_patterns", "endpoint_extract", "entropy_text", "flow_buckets", "session_volume", "member_distribution", "topk_share", "findings_merge", "canonical_merge", "set_union_merge", "gap_clusters", "det_id_sha16",
]


def suffixes_47217(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.range(47_217).select(F.concat(F.lit("t"), "id", F.lit(".example.com")).alias("suffix"), (F.col("id") % 41).alias("vendor"))
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(url_host(F.col("url")).alias("host"))
    return joins.longest_suffix(pages, "host", rules, "suffix")


def prefixes_588(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.range(588).select(F.concat(F.lit("com.lib"), "id", F.lit(".")).alias("prefix"), F.col("id").alias("rule"))
    names = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.concat(F.lit("com.lib"), F.col("l_partkey") % 1000, F.lit(".core.A"), F.col("l_suppkey")).alias("name"))
    return joins.longest_prefix(names, "name", rules, "prefix")


def keywords_9336(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.range(9_336).select(F.concat(F.lit("Manager"), "id", F.lit(".getValue"), "id").alias("token"), F.lit("c").alias("category"), F.lit("").alias("subcategory"))
    rules = rules.unionByName(spark.createDataFrame([("token", "c", ""), ("licensed under", "c", "")], rules.schema))
    return matching.keyword_search(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text", rules)


RULES = {f.__name__: f for f in (suffixes_47217, prefixes_588, keywords_9336)}


def seconds(spark: SparkSession, query, runs: int = 3) -> float:  # noqa: ANN001
    """The median of the runs, writing all rows to nowhere."""
    took = []
    for _ in range(runs):
        began = time.time()
        query(spark, SF).write.format("noop").mode("overwrite").save()
        took.append(time.time() - began)
    return round(median(took), 3)


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").config("spark.driver.memory", "8g").config("spark.sql.shuffle.partitions", CPUS).config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["det_id_sha16"](spark, SF).write.format("noop").mode("overwrite").save()
    took = {name: seconds(spark, QUERIES[name]) for name in HEADLINE} | {name: seconds(spark, query, 1) for name, query in RULES.items()}
    facts = {"cpus": int(CPUS), "runs": "median of 3, rule tables once"}
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": SF.rsplit("sf", 1)[-1], **facts}))


if __name__ == "__main__":
    main()
