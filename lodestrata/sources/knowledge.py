"""Readers of published rule sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.android import signature_parts
from ..functions.strings import camel_words


def permission_maps(spark: SparkSession, path: str) -> DataFrame:
    """Lines `package.Class.method(args)type  ::  permission, ...` of files in folders named by API level."""
    return permission_map_rows(spark.read.option("recursiveFileLookup", "true").text(path).select("value", "_metadata.file_path"))


def permission_map_rows(rows: DataFrame) -> DataFrame:
    """`permission_maps` of lines (value, file_path)."""
    cut = F.split("value", r"\s*::\s*")
    parts = signature_parts(F.trim(cut[0]))
    level = F.regexp_extract("file_path", r"/(?:api-?)?(\d+)/[^/]*$", 1).try_cast("int")
    found = rows.where(F.size(cut) == 2).select(parts["package"].alias("package_name"), parts["class"].alias("class_name"), parts["method"].alias("method_name"), F.explode(F.split(cut[1], r"\s*,\s*")).alias("permission"), level.alias("level"))
    return found.where("permission <> '' and method_name <> ''")


def permission_definitions(files: DataFrame) -> DataFrame:
    """(class_name, target, permission, kind): definitions in XML files (content)."""
    schema = "permissionDef array<struct<_className:string,_target:string,_targetKind:string,permission:array<struct<_name:string>>>>"
    parsed = files.select(F.from_xml(F.decode("content", "utf-8"), schema).alias("x")).select(F.explode("x.permissionDef").alias("d"))
    spread = parsed.select("d._className", "d._target", "d._targetKind", F.explode("d.permission").alias("p"))
    return spread.select(F.col("_className").alias("class_name"), F.col("_target").alias("target"), F.col("p._name").alias("permission"), F.col("_targetKind").alias("kind"))


def permission_calls(spark: SparkSession, path: str, prefix: str = "android.permission.") -> DataFrame:
    """Lines `<package.Class: type method(args)> -> P1, P2`; a permission without a dot gets the prefix."""
    return permission_call_rows(spark.read.text(path), prefix)


def permission_call_rows(rows: DataFrame, prefix: str = "android.permission.") -> DataFrame:
    """`permission_calls` of lines (value)."""
    line = r"^<([\w.$]+): [\w.$\[\]]+ ([\w$<>]+)\([^)]*\)>\s*->\s*(.+)$"
    rows = rows.where(F.col("value").rlike(line))
    grab = lambda i: F.regexp_extract("value", line, i)
    spread = rows.select(grab(1).alias("owner"), grab(2).alias("method_name"), F.explode(F.split(grab(3), r"\s*,\s*")).alias("p"))
    permission = F.when(F.contains("p", F.lit(".")), F.col("p")).otherwise(F.concat(F.lit(prefix), F.trim("p")))
    package, name = F.regexp_extract("owner", r"^(.*)\.[^.]+$", 1), F.regexp_extract("owner", r"([^.]+)$", 1)
    return spread.select(package.alias("package_name"), name.alias("class_name"), "method_name", permission.alias("permission")).distinct()


def detector_patterns(files: DataFrame) -> DataFrame:
    """(detector, provider, secret_type, regex) of the patterns that detector sources compile (path, content).

    The detector is the folder; its camel-case words name the provider and what is left of the
    variable the kind. Patterns of key-word helpers are skipped.
    """
    line = r"(?m)(\w+)\s*:?=\s*regexp\.MustCompile\(\s*(?:detectors\.PrefixRegex\([^)]*\)\s*\+\s*)?`([^`]*)`"
    text = F.decode("content", "utf-8")
    pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(line), F.lit(1)).alias("name"), F.regexp_extract_all(text, F.lit(line), F.lit(2)).alias("regex"))
    rows = files.select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("detector"), F.explode(pairs).alias("p")).select("detector", "p.name", "p.regex")
    rows = rows.where("not lower(name) like 'keyword%' and regex <> ''")
    words = camel_words(F.col("name"))
    kind = F.lower(F.array_join(F.filter(words, lambda w: ~F.lower(w).isin("pat", "re", "regex")), "_"))
    return rows.select("detector", F.initcap("detector").alias("provider"), F.coalesce(F.nullif(kind, F.lit("")), F.lit("key")).alias("secret_type"), "regex").distinct()


def flow_signatures(spark: SparkSession, path: str) -> DataFrame:
    """(class_name, method_name, role) of lines `<Class: type method(args)> -> _SOURCE_`."""
    return flow_signature_rows(spark.read.text(path))


def flow_signature_rows(rows: DataFrame) -> DataFrame:
    """`flow_signatures` of lines (value)."""
    line = r"^<([\w.$]+): [\w.$\[\]]+ ([\w$<>]+)\([^)]*\)>.*->\s*_(SOURCE|SINK|BOTH)_"
    rows = rows.where(F.col("value").rlike(line))
    grab = lambda i: F.regexp_extract("value", line, i)
    return rows.select(grab(1).alias("class_name"), grab(2).alias("method_name"), F.lower(grab(3)).alias("role")).distinct()


def tracker_signatures(files: DataFrame, text: str = "text", signature: str = "network_signature") -> DataFrame:
    """(name, category, domain): trackers of JSON maps id -> struct, one row for each alternative of a signature."""
    kind = "struct<trackers:map<string,struct<name:string,network_signature:string,code_signature:string,categories:array<string>>>>"
    spread = files.select(F.explode(F.from_json(text, kind)["trackers"]).alias("id", "t"))
    parts = spread.select("t.name", F.coalesce(F.get("t.categories", F.lit(0)), F.lit("")).alias("category"), F.explode(F.split(f"t.{signature}", r"\|")).alias("s"))
    return parts.select("name", "category", F.trim(F.replace("s", F.lit("\\"), F.lit(""))).alias("domain")).where("domain <> ''").distinct()


def blocked_domains(spark: SparkSession, path: str) -> DataFrame:
    """(domain, version): whole-domain rules `||domain^` of a filter list; others are passed over."""
    return blocked_domain_rows(spark.read.text(path, wholetext=True))


def blocked_domain_rows(rows: DataFrame) -> DataFrame:
    """`blocked_domains` of whole lists (value)."""
    version = F.coalesce(F.nullif(F.regexp_extract("value", r"(?m)^!\s*Version:\s*(\S+)", 1), F.lit("")), F.lit("unknown"))
    found = F.regexp_extract_all("value", F.lit(r"(?m)^\|\|([a-z0-9.-]+)\^(?:\$third-party)?\s*$"), F.lit(1))
    return rows.select(version.alias("version"), F.explode(found).alias("domain")).select("domain", "version").distinct()


def stamp_parts(stamp: Column) -> Column:
    """struct(protocol, address) of an `sdns://` stamp (S23, M13): the first byte is the protocol, after eight of flags a length and a text."""
    body = F.translate(F.regexp_replace(stamp, "^sdns://", ""), "-_", "+/")
    raw = F.unbase64(F.rpad(body, (F.ceil(F.length(body) / 4) * 4).cast("int"), F.lit("=")))
    byte = lambda i: F.conv(F.hex(F.substring(raw, i, 1)), 16, 10).cast("int")
    protocol = F.element_at(F.create_map(*(x for k, v in {0: "plain", 1: "dnscrypt", 2: "doh", 3: "dot", 4: "doq"}.items() for x in (F.lit(k), F.lit(v)))), byte(1))
    address = F.decode(F.substring(raw, F.lit(11), byte(10)), "utf-8")
    return F.struct(protocol.alias("protocol"), F.regexp_replace(address, r":\d+$", "").alias("address"))


def resolver_list(spark: SparkSession, path: str) -> DataFrame:
    """(resolver_name, protocol, address) of Markdown lists: a `## name` heading and the stamps below it."""
    return resolver_rows(spark.read.text(path, wholetext=True))


def resolver_rows(rows: DataFrame) -> DataFrame:
    """`resolver_list` of whole lists (value)."""
    sections = rows.select(F.explode(F.split("value", r"(?m)^## ")).alias("s"))
    stamps = F.regexp_extract_all("s", F.lit(r"(?m)^(sdns://[A-Za-z0-9_-]+)"), F.lit(1))
    named = sections.select(F.trim(F.regexp_extract("s", r"^([^\r\n]*)", 1)).alias("resolver_name"), F.explode(stamps).alias("stamp"))
    return named.select("resolver_name", stamp_parts(F.col("stamp")).alias("p")).select("resolver_name", "p.protocol", "p.address")
