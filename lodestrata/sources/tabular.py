"""Readers of delimited and line-based tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ids import region_of
from ..operators.checks import rejected
from ..schemas import RESOLVERS, TRACKERS, schema_of


def csv(spark: SparkSession, path: str, schema: str, required: Sequence[str] = (), null_if_blank: Sequence[str] = (), positioned: bool = False, quoted_lines: bool = True) -> DataFrame:
    """A CSV with a header, by name: columns that the schema lacks are left out, missing ones are null.

    Texts are trimmed; blanks stay blank but for null_if_blank. Raises ValueError if a required column is missing.
    positioned: with `pos`, which orders rows by file and by place in it, whatever the partitions: files with quoted
    line ends are not split, so the ids that Spark gives to the rows of one file rise with their place.
    quoted_lines: values may hold line ends, so a file is read by one task; without them (and without positions) large
    files are split.
    """
    raw = spark.read.csv(path, header=True, multiLine=quoted_lines or positioned, escape='"')
    if lacking := [c for c in required if c not in raw.columns]:
        raise ValueError(f"{path} lacks {', '.join(lacking)}")

    def column(f: T.StructField) -> Column:
        if f.name not in raw.columns:
            return F.lit(None).cast(f.dataType).alias(f.name)
        text = F.trim(F.coalesce(F.col(f"`{f.name}`"), F.lit("")))
        kind = f.dataType.typeName()
        if kind == "array":
            return F.from_json(text, f.dataType).alias(f.name)
        if kind == "boolean":
            return F.when(text != "", F.lower(text) == "true").alias(f.name)
        if kind != "string":
            return text.try_cast(f.dataType).alias(f.name)
        return (F.nullif(text, F.lit("")) if f.name in null_if_blank else text).alias(f.name)

    pos = [F.struct(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("row")).alias("pos")] if positioned else []
    return raw.select(*map(column, schema_of(schema)), *pos)


def sample_index(spark: SparkSession, path: str, schema: str, regions: dict[str, list[str]]) -> DataFrame:
    """The sample index with `reject` for bad rows and the region of good ones (S3)."""
    rows = csv(spark, path, schema, ["sample_id", "source_path"], positioned=True)
    rules = {
        "no_id": F.col("sample_id") == "",
        "bad_hash": (F.col("apk_sha256") != "") & ~F.col("apk_sha256").rlike("^[0-9a-fA-F]{64}$"),
        "no_path": F.col("source_path") == "",
    }
    out = rejected(rows, rules, ["sample_id"], "pos").withColumn("app_country_code", F.upper("app_country_code"))
    return out.withColumn("region", region_of(F.col("app_country_code"), regions))


def names(spark: SparkSession, path: str) -> DataFrame:
    """Lines that are neither blank nor comments."""
    return name_rows(spark.read.text(path))


def name_rows(rows: DataFrame) -> DataFrame:
    """`names` of lines (value)."""
    return rows.select(F.trim("value").alias("name")).where("name <> '' and not startswith(name, '#')")


def properties(text: Column) -> Column:
    """map of the `key=value` lines of a text, comments aside, the last of a key winning."""
    lines = F.filter(F.transform(F.split(text, r"\r?\n"), lambda x: F.trim(x)), lambda x: F.contains(x, F.lit("=")) & ~x.rlike("^[#!]"))
    pairs = F.transform(lines, lambda x: F.struct(F.trim(F.substring_index(x, "=", 1)).alias("k"), F.trim(F.regexp_replace(x, "^[^=]*=", "")).alias("v")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(last)


def device_captures(spark: SparkSession, path: str) -> DataFrame:
    """Connections that an on-device capture lists as CSV (S13); numbers that cannot be read are 0."""
    kinds = {"FirstSeen": "string", "LastSeen": "string", "Info": "string", "DstIp": "string", "DstPort": "int", "Proto": "string", "BytesSent": "long", "BytesRcvd": "long", "Status": "string"}
    schema = ", ".join(f"{c} string" for c in kinds)
    rows = csv(spark, path, schema, list(kinds)[:7])
    out = rows.select(*(F.coalesce(F.col(c).try_cast(k), F.lit(0)).cast(k).alias(c) if k != "string" else F.col(c) for c, k in kinds.items()))
    return out.withColumn("is_dns", (F.upper("Proto") == "DNS") | (F.col("DstPort") == 53))


def resolver_overrides(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Resolver rows that people have checked."""
    return csv(spark, path, schema, ["ip_address"]).withColumn("confidence", F.lit("HIGH"))


def pattern_rules(spark: SparkSession, path: str) -> DataFrame:
    """Personal-data patterns with the default data set and confidence filled in."""
    schema = "pattern_name string, category string, regex string, source_reference string, source_dataset string, confidence string"
    rows = csv(spark, path, schema, ["pattern_name", "regex"], ["source_dataset", "confidence"])
    return rows.select("pattern_name", "category", "regex", "source_reference", F.coalesce("source_dataset", F.lit("Custom")).alias("source_dataset"), F.coalesce("confidence", F.lit("MEDIUM")).alias("confidence"))


def traffic_rules(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The rule tables of traffic below root, with their types: trackers, resolvers, patterns and places.

    Resolvers keep their place in `pos`. Without the table of places, addresses cannot be placed: Spark's error for a missing path is raised.
    """
    places = "ip_from string, ip_to string, country_code string, continent string, asn string, organization string"
    return {
        "trackers": csv(spark, f"{root}/trackers.csv", TRACKERS, ["domain_suffix"]),
        "resolvers": csv(spark, f"{root}/resolvers.csv", RESOLVERS, ["ip_address"], positioned=True),
        "patterns": pattern_rules(spark, f"{root}/patterns.csv"),
        "places": csv(spark, f"{root}/places.csv", places, ["ip_from", "ip_to"]),
    }


def verified(spark: SparkSession, path: str, sha256: str) -> DataFrame:
    """The content of a file, if its SHA-256 is the expected one; raises ValueError otherwise."""
    found = spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"), "content")
    if [r[0] for r in found.select("sha256").limit(2).collect()] != [sha256.lower()]:
        raise ValueError(f"{path} is not the file that was expected")
    return found
