"""Trees of decoded app files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.android import class_to_package
from ..operators.merges import capped


def file_kind(path: Column) -> Column:
    """What a file of a decoded app is, by its path within it."""
    return (
        F.when(path == "AndroidManifest.xml", "manifest")
        .when(path.rlike(r"^smali(_classes\d+)?/.*\.smali$"), "smali")
        .when(path.rlike(r"^res/values[^/]*/.*\.xml$"), "res_values")
        .when(path.rlike(r"^res/xml[^/]*/.*\.xml$"), "res_xml")
        .when(path.rlike(r"^assets/.*\.json$"), "assets_json")
        .when(path.rlike(r"^assets/.*\.(txt|properties|cfg)$"), "assets_txt")
        .when(path.rlike(r"(^|/)pom\.(xml|properties)$"), "pom")
        .when(path.rlike(r"^META-INF/.*\.version$|(^|/)[^/]*\.properties$"), "metadata")
        .otherwise("other")
    )


def tree(spark: SparkSession, root: str) -> DataFrame:
    """(sample_id, path, kind, length, content) of every file under root/<sample_id>/."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = F.regexp_extract("path", r"^.*?" + root.rstrip("/").split(":")[-1].replace(".", r"\.") + r"/([^/]+)/(.*)$", 1)
    rest = F.regexp_extract("path", r"^.*?" + root.rstrip("/").split(":")[-1].replace(".", r"\.") + r"/([^/]+)/(.*)$", 2)
    return found.select(base.alias("sample_id"), rest.alias("path"), file_kind(rest).alias("kind"), "length", "content")


def package_prefixes(files: DataFrame) -> DataFrame:
    """(sample_id, prefix, depth): packages of code files, cut at 3 and 4 names and whole, each once."""
    code = files.where("kind = 'smali'")
    names = F.split(F.regexp_replace(class_to_package(F.col("path")), r"\.[^.]+$", ""), r"\.")
    cuts = F.array_distinct(F.transform(F.array(F.lit(3), F.lit(4), F.size("names")), lambda n: F.least(n, F.size("names"))))
    spread = code.select("sample_id", names.alias("names")).select("sample_id", "names", F.explode(cuts).alias("depth"))
    return spread.select("sample_id", F.array_join(F.slice("names", F.lit(1), F.col("depth")), ".").alias("prefix"), "depth").distinct()


def first_files(files: DataFrame, kind: str, n: int) -> DataFrame:
    """The first n files of a kind of each sample, by path, for those who want a limit."""
    return capped(files.where(F.col("kind") == kind), ["sample_id"], F.lit(True), ["path"], n)


def main_packages(files: DataFrame) -> DataFrame:
    """The first app file of each folder (folder, name) that is no configuration split."""
    good = files.where(F.lower("name").rlike(r"\.apk$") & ~F.startswith("name", F.lit("config.")))
    return good.groupBy("folder").agg(F.min("name").alias("name"))
