"""Readers of JSON feeds and XML documents."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.android import tri_state
from ..functions.feeds import best_score, product_of

_METRIC = "array<struct<type:string,baseSeverity:string,cvssData:struct<version:string,baseScore:string,baseSeverity:string>>>"
_MATCH = "array<struct<criteria:string,versionStartIncluding:string,versionStartExcluding:string,versionEndIncluding:string,versionEndExcluding:string>>"
FEED = (
    "vulnerabilities array<struct<cve:struct<id:string,published:string,lastModified:string,"
    f"metrics:struct<cvssMetricV31:{_METRIC},cvssMetricV30:{_METRIC},cvssMetricV2:{_METRIC}>,"
    f"configurations:array<struct<nodes:array<struct<cpeMatch:{_MATCH}>>>>>>>"
)


def zipped_members(spark: SparkSession, path: str, suffix: str = ".json") -> DataFrame:
    """(file, member, text) of the members of every zip file under path; broken files and members are left out."""
    return members(spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", "true").load(path), suffix)


def members(files: DataFrame, suffix: str = ".json") -> DataFrame:
    """`zipped_members` of a table of zip files (path, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    archive = zipfile.ZipFile(io.BytesIO(bytes(content)))
                except zipfile.BadZipFile:
                    continue
                for member in sorted(n for n in archive.namelist() if n.endswith(suffix)):
                    try:
                        text = archive.read(member).decode()
                    except (zipfile.BadZipFile, UnicodeDecodeError, RuntimeError):
                        continue
                    yield pd.DataFrame({"file": [file], "member": [member], "text": [text]})

    return files.select("path", "content").mapInPandas(run, "file string, member string, text string")


def vulnerabilities(feeds: DataFrame, text: str = "text") -> DataFrame:
    """(cve_id, vendor, product, severity, score, published, version_ranges): one row for each product of a feed entry.

    Ranges without any bound are kept. An entry without products has one row with null vendor and
    product and no ranges; a missing id is `UNKNOWN`; text that is no feed gives no rows.
    """
    entry = feeds.select(F.explode(F.from_json(text, FEED)["vulnerabilities"]).alias("v")).select("v.cve.*")
    scores = lambda metric: F.transform(
        F.col(f"metrics.{metric}"),
        lambda m: F.struct(
            m["type"].alias("type"), m["cvssData"]["version"].alias("version"), m["cvssData"]["baseScore"].alias("score"),
            F.coalesce(m["cvssData"]["baseSeverity"], m["baseSeverity"]).alias("severity"),
        ),
    )
    best = best_score(*(F.coalesce(scores(m), F.array()) for m in ("cvssMetricV31", "cvssMetricV30", "cvssMetricV2")))
    base = entry.select(F.coalesce("id", F.lit("UNKNOWN")).alias("cve_id"), best.alias("best"), "published", F.xxhash64(F.to_json(F.struct("*"))).alias("entry"), "configurations")
    match = base.withColumn("c", F.explode_outer("configurations")).withColumn("n", F.explode_outer("c.nodes")).withColumn("m", F.explode_outer("n.cpeMatch"))
    product = product_of(F.col("m.criteria"))
    span = F.struct(
        F.col("m.versionStartIncluding").alias("start_including"), F.col("m.versionStartExcluding").alias("start_excluding"),
        F.col("m.versionEndIncluding").alias("end_including"), F.col("m.versionEndExcluding").alias("end_excluding"),
    )
    flat = match.select("cve_id", "entry", "best", "published", product["vendor"].alias("vendor"), product["product"].alias("product"), F.when(product["product"].isNotNull(), span).alias("span"))
    some = F.max(F.col("product").isNotNull()).over(Window.partitionBy("entry"))
    flat = flat.withColumn("some", some).where("product is not null or not some")
    out = flat.groupBy("cve_id", "entry", "vendor", "product").agg(
        F.first("best").alias("best"), F.first("published").alias("published"), F.array_sort(F.collect_list("span")).alias("version_ranges")
    )
    return out.select("cve_id", "vendor", "product", "best.severity", "best.score", "published", "version_ranges")


_COMPONENT = (
    "array<struct<`_android:name`:string,`_android:exported`:string,`_android:permission`:string,`_android:authorities`:string,"
    "`meta-data`:array<struct<`_android:name`:string,`_android:value`:string,`_android:resource`:string>>,"
    "`intent-filter`:array<struct<`_android:autoVerify`:string,action:array<struct<`_android:name`:string>>,"
    "category:array<struct<`_android:name`:string>>,data:array<struct<`_android:scheme`:string,`_android:host`:string>>>>>>"
)
_NAMED = "array<struct<`_android:name`:string,`_android:value`:string,`_android:resource`:string,`_android:protectionLevel`:string,`_android:authorities`:string>>"
MANIFEST = (
    "_package string, `_android:versionName` string, `uses-sdk` struct<`_android:minSdkVersion`:string,`_android:targetSdkVersion`:string>, "
    f"`uses-permission` {_NAMED}, `uses-permission-sdk-23` {_NAMED}, permission {_NAMED}, `permission-group` {_NAMED}, `permission-tree` {_NAMED}, "
    f"queries array<struct<package:{_NAMED},provider:{_NAMED},intent:array<struct<action:array<struct<`_android:name`:string>>>>>>, "
    "application struct<`_android:allowBackup`:string,`_android:usesCleartextTraffic`:string,`_android:networkSecurityConfig`:string,"
    f"`_android:debuggable`:string,activity:{_COMPONENT},`activity-alias`:{_COMPONENT},service:{_COMPONENT},receiver:{_COMPONENT},"
    f"provider:{_COMPONENT},`meta-data`:{_NAMED},`uses-library`:{_NAMED}>"
)
KINDS = ["activity", "activity-alias", "service", "receiver", "provider"]


def manifests(files: DataFrame) -> DataFrame:
    """(sample_id, sha256, readable, m): parsed manifests of files (sample_id, content) (S5); m is null where the XML is broken."""
    text = F.decode("content", "utf-8")
    parsed = F.from_xml(text, f"{MANIFEST}, _broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    # as a generator, so that no filter on what was parsed is pushed below it and parses once more
    rows = files.select("sample_id", F.sha2("content", 256).alias("sha256"), F.coalesce(text.rlike(r"<manifest\b"), F.lit(False)).alias("named"), F.explode(F.array(parsed)).alias("m"))
    good = F.coalesce(F.col("named") & F.col("m").isNotNull() & F.col("m._broken").isNull(), F.lit(False))
    return rows.select("sample_id", "sha256", good.alias("readable"), F.when(good, F.col("m")).alias("m"))


def components(parsed: DataFrame) -> DataFrame:
    """One row per declared component (manifest_components): kind, position, name, attributes, filters and meta-data."""

    def of_kind(k: str) -> Column:
        own = F.coalesce(F.col(f"m.application.`{k}`"), F.array().cast(_COMPONENT))
        return F.transform(own, lambda c, i: F.struct(F.lit(k).alias("kind"), i.alias("pos"), c.alias("c")))

    spread = parsed.where("readable").select("sample_id", F.col("m._package").alias("package"), F.col("m.`uses-sdk`.`_android:targetSdkVersion`").try_cast("int").alias("target"), F.explode(F.concat(*map(of_kind, KINDS))).alias("x"))
    names = lambda xs: F.transform(F.coalesce(xs, F.array()), lambda a: a["_android:name"])
    filters = F.transform(
        F.coalesce(F.col("x.c.`intent-filter`"), F.array()),
        lambda f: F.struct(
            names(f["action"]).alias("actions"), names(f["category"]).alias("categories"), (F.lower(f["_android:autoVerify"]) == "true").alias("auto_verify"),
            F.transform(F.coalesce(f["data"], F.array()), lambda d: F.struct(d["_android:scheme"].alias("scheme"), d["_android:host"].alias("host"))).alias("data"),
        ),
    )
    return spread.select(
        "sample_id", "package", "target", F.col("x.kind").alias("kind"), F.col("x.pos").alias("pos"), F.col("x.c.`_android:name`").alias("name"),
        tri_state(F.col("x.c.`_android:exported`"), F.lit(None)).alias("exported"), F.col("x.c.`_android:permission`").alias("permission"),
        F.col("x.c.`_android:authorities`").alias("authorities"), filters.alias("filters"),
    )


def permissions(parsed: DataFrame) -> DataFrame:
    """(sample_id, record, name, level): requested and declared permissions, groups and trees (manifest_permissions)."""
    kinds = {"uses-permission": "requested", "uses-permission-sdk-23": "requested_sdk_23", "permission": "declared", "permission-group": "declared_group", "permission-tree": "declared_tree"}

    def of_kind(k: str) -> Column:
        own = F.coalesce(F.col(f"m.`{k}`"), F.array().cast(_NAMED))
        return F.transform(own, lambda p: F.struct(F.lit(kinds[k]).alias("record"), p["_android:name"].alias("name"), p["_android:protectionLevel"].alias("level")))

    return parsed.where("readable").select("sample_id", F.explode(F.concat(*map(of_kind, kinds))).alias("p")).select("sample_id", "p.record", "p.name", "p.level")


def meta_data(parsed: DataFrame) -> DataFrame:
    """(sample_id, name, value): meta-data of the application and of its components, resources standing for missing values."""
    part = "array<struct<name:string,value:string>>"
    pairs = lambda xs: F.transform(F.coalesce(xs, F.array()), lambda n: F.struct(n["_android:name"].alias("name"), F.coalesce(F.nullif(n["_android:value"], F.lit("")), n["_android:resource"]).alias("value"))).cast(part)
    inner = lambda k: F.flatten(F.transform(F.coalesce(F.col(f"m.application.`{k}`"), F.array().cast(_COMPONENT)), lambda c: pairs(c["meta-data"])))
    every = F.concat(pairs(F.col("m.application.`meta-data`")), *(inner(k) for k in KINDS))
    return parsed.where("readable").select("sample_id", F.explode(every).alias("d")).select("sample_id", "d.name", "d.value")


def evidence(parsed: DataFrame) -> DataFrame:
    """(sample_id, source, value): names in a manifest that may show an embedded component (X10, S33); each manifest is gone through once."""
    of_kind = lambda k, value: F.transform(F.coalesce(F.col(f"m.application.`{k}`"), F.array().cast(_COMPONENT)), value)
    each = lambda field, part: F.transform(F.coalesce(F.col(f"m.application.`{field}`"), F.array().cast(_NAMED)), lambda n: n[f"_android:{part}"])
    names = F.concat(*(of_kind(k, lambda c: c["_android:name"]) for k in KINDS))
    authorities = F.flatten(F.concat(*(of_kind(k, lambda c: F.coalesce(F.split(c["_android:authorities"], ";"), F.array().cast("array<string>"))) for k in KINDS)))
    found = {"component": names, "authority": authorities, "library": each("uses-library", "name"), **{f"meta_{p}": each("meta-data", p) for p in ("name", "value", "resource")}}
    tagged = lambda source, xs: F.transform(xs, lambda v: F.struct(F.lit(source).alias("source"), v.alias("value")))
    every = F.concat(*(tagged(source, xs) for source, xs in found.items()))
    out = parsed.where("readable").select("sample_id", F.explode(every).alias("e")).select("sample_id", "e.source", "e.value")
    return out.where("value is not null and value <> ''")


_DOMAINS = "array<struct<_includeSubdomains:string,_VALUE:string>>"
_RULES = f"struct<_cleartextTrafficPermitted:string,domain:{_DOMAINS},`trust-anchors`:struct<certificates:array<struct<_src:string>>>,`pin-set`:struct<_expiration:string,pin:array<struct<_digest:string,_VALUE:string>>>>"
NETWORK_CONFIG = f"`base-config` {_RULES}, `debug-overrides` {_RULES}, `domain-config` array<{_RULES}>"


def network_domains(files: DataFrame) -> DataFrame:
    """(sample_id, file, rule, cleartext, domain, subdomains, anchors, pins) of network security files (sample_id, path, content)."""
    parsed = files.select("sample_id", F.col("path").alias("file"), F.from_xml(F.decode("content", "utf-8"), NETWORK_CONFIG).alias("n"))
    one = lambda rule, c: F.struct(F.lit(rule).alias("rule"), c.alias("c"))
    kind = f"array<{_RULES}>"
    every = F.concat(
        F.when(F.col("n.`base-config`").isNotNull(), F.array(one("base", F.col("n.`base-config`")))).otherwise(F.array()),
        F.when(F.col("n.`debug-overrides`").isNotNull(), F.array(one("debug", F.col("n.`debug-overrides`")))).otherwise(F.array()),
        F.transform(F.coalesce(F.col("n.`domain-config`"), F.array().cast(kind)), lambda c: one("domain", c)),
    )
    spread = parsed.select("sample_id", "file", F.explode(every).alias("x")).select("sample_id", "file", "x.rule", "x.c", F.explode_outer("x.c.domain").alias("d"))
    texts = lambda xs, f: F.array_join(F.array_sort(F.array_distinct(F.transform(F.coalesce(xs, F.array()), f))), ";")
    return spread.select(
        "sample_id", "file", "rule", tri_state(F.col("c._cleartextTrafficPermitted"), F.lit(None)).alias("cleartext"),
        F.lower(F.trim("d._VALUE")).alias("domain"), tri_state(F.col("d._includeSubdomains"), F.lit(None)).alias("subdomains"),
        texts(F.col("c.`trust-anchors`.certificates"), lambda x: x["_src"]).alias("anchors"),
        texts(F.col("c.`pin-set`.pin"), lambda x: F.concat_ws(":", x["_digest"], F.trim(x["_VALUE"]))).alias("pins"),
    )


def proxy_items(spark: SparkSession, path: str) -> DataFrame:
    """(time, url, host, ip, method, request, response, request_size) of an intercepting proxy's XML export."""
    part = "struct<_base64:string,_VALUE:string>"
    schema = f"time string, url string, host struct<_ip:string,_VALUE:string>, method string, request {part}, response {part}"
    rows = spark.read.format("xml").option("rowTag", "item").schema(schema).load(path)
    body = lambda c: F.when(F.col(f"{c}._base64") == "true", F.decode(F.unbase64(F.col(f"{c}._VALUE")), "utf-8")).otherwise(F.coalesce(F.col(f"{c}._VALUE"), F.lit("")))
    out = rows.select("time", "url", F.col("host._VALUE").alias("host"), F.col("host._ip").alias("ip"), "method", body("request").alias("request"), body("response").alias("response"))
    return out.withColumn("request_size", F.octet_length("request"))


def attribute_values(text: Column, tag: str, attribute: str) -> Column:
    """Values of an attribute of all tags of a name in a page, in order; for pages that are no XML."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"""(?is)<{tag}\b[^>]*?\s{attribute}\s*=\s*["']([^"']*)["']"""), F.lit(1))
