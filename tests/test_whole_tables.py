"""The vulnerability queries over whole tables leave out no line item and no part."""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from lodestrata.queries import QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_vulnerability_queries(spark):
    items, parts = spark.read.parquet(f"{SF}/lineitem.parquet"), spark.read.parquet(f"{SF}/part.parquet")
    assert QUERIES["cve_outcomes"](spark, SF).count() == items.count()
    assert QUERIES["run_totals"](spark, SF).first()["rows"] == items.count()
    found = QUERIES["version_range_match"](spark, SF)
    # a part that was shipped with a readable version lies in its own range
    own = items.join(parts, F.col("l_partkey") == F.col("p_partkey")).where("p_partkey % 11 <> 0 and p_partkey % 13 <> 0")
    own = own.select(F.concat(F.lit("app"), "l_orderkey").alias("sample_id"), F.concat(F.lit("CVE-"), F.substring("p_brand", 7, 1), F.lit("-"), F.element_at(F.split(F.lower("p_name"), " "), -1)).alias("cve_id"))
    assert own.join(found, ["sample_id", "cve_id"], "left_anti").count() == 0
    apps = found.select("sample_id").distinct().count()
    assert QUERIES["cve_app_summary"](spark, SF).count() == __spark_entry__.entry(spark).count() == apps
