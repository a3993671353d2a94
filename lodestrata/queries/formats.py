"""Readers, writers and field functions: their inputs are made from the shared tables, as texts of the formats in question."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import sinks
from ..functions.bound import bound
from ..functions import android, feeds, ids, net, strings
from ..functions.values import DANGEROUS_PERMISSIONS, KNOWN_ADDRESSES, REGIONS
from ..operators import joins, matching, merges
from ..plans import knowledge as builds
from ..plans import manifests as plan
from ..schemas import conform
from ..tables import dealt, written
from ..sources import captures, documents, files, knowledge, tabular
from .base import PACKETS, packets, query, scratch, sql_values, table, values

def _k() -> Column:
    return F.col("p_partkey")


def _pick(xs: list, n: Column | None = None) -> Column:
    n = _k() if n is None else n
    return F.element_at(F.array(*map(F.lit, xs)), (n % len(xs) + 1).cast("int"))


def _text(template: str, **columns: Column | str) -> Column:
    """A text with the columns put in the place of their names in braces."""
    out, rest = [], template
    while "{" in rest:
        head, _, tail = rest.partition("{")
        name, _, rest = tail.partition("}")
        out += [F.lit(head), (columns[name] if not isinstance(columns[name], str) else F.col(columns[name])).cast("string")]
    return F.concat(*out, F.lit(rest))


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part")


@query("""
SELECT p_partkey AS id, trim(p_name) AS name, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_size || '.0' END AS version, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_size END AS level,
  p_partkey % 2 = 0 AS flag, p_brand || '|' || p_type AS tags, CAST(NULL AS VARCHAR) AS missing FROM part""")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written in a fixed column order and sorted, nulls as blanks and lists as JSON; read by name."""
    path = scratch(spark, "csv")
    rows = _parts(spark, sf_dir).select(
        _k().alias("id"), F.concat(F.lit("  "), "p_name").alias("name"), F.when(_k() % 3 != 0, F.concat(F.col("p_size").cast("string"), F.lit(".0"))).alias("version"),
        F.when(_k() % 4 != 0, F.col("p_size").cast("string")).otherwise("none").alias("level"), (_k() % 2 == 0).alias("flag"), F.array("p_brand", "p_type").alias("tags"),
    )
    sinks.csv(rows, path, ["tags", "id", "version", "name", "flag", "level"], ["version", "id"])
    back = tabular.csv(spark, path, "id long, name string, version string, level int, flag boolean, tags array<string>, missing string", ["id", "name"], ["version"])
    return back.withColumn("tags", F.array_join("tags", "|"))


@query(f"""
WITH r AS (SELECT o_orderkey, 's' || o_custkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN 'zz' WHEN o_orderkey % 5 = 1 THEN '' ELSE repeat('a', 64) END AS hash, CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE 'p' END AS path,
    ['us', 'De', 'in', '', 'xx'][o_orderkey % 5 + 1] AS country FROM orders),
j AS (SELECT *, CASE WHEN hash = 'zz' THEN 'bad_hash' WHEN path = '' THEN 'no_path' END AS bad FROM r),
n AS (SELECT *, row_number() OVER (PARTITION BY id, bad IS NULL ORDER BY lpad(CAST(o_orderkey AS VARCHAR), 12, '0')) AS n FROM j)
SELECT o_orderkey, id AS sample_id, coalesce(bad, CASE WHEN n > 1 THEN 'duplicate' END) AS reject,
  CASE upper(country) WHEN '' THEN '' WHEN 'US' THEN 'north_america' WHEN 'DE' THEN 'eu_member' WHEN 'IN' THEN 'south_asia' ELSE 'other' END AS region FROM n""")
def index_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of an index with what is wrong with them, the first of a sample by its place in the file (S3)."""
    path = scratch(spark, "index")
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("s"), "o_custkey").alias("sample_id"), F.when(k % 7 == 0, "").otherwise("p").alias("source_path"),
        F.when(k % 5 == 0, "zz").when(k % 5 == 1, "").otherwise("a" * 64).alias("apk_sha256"), _pick(["us", "De", "in", "", "xx"], k).alias("app_country_code"), F.lpad(k.cast("string"), 12, "0").alias("notes"),
    )
    sinks.csv(rows, path, sort=["notes"])
    schema = "sample_id string, source_path string, apk_sha256 string, app_country_code string, notes string"
    return tabular.sample_index(spark, path, schema, REGIONS).select(F.col("notes").cast("long").alias("o_orderkey"), "sample_id", "reject", "region")


_FEED = """
WITH c AS (SELECT 'CVE-' || p_partkey AS cve_id, CAST(p_size / 10 AS DOUBLE) AS score, lower(replace(p_brand, '#', '')) AS vendor, string_split(lower(p_name), ' ') AS w, p_size FROM part WHERE p_partkey % 10 <> 0),
p AS (SELECT cve_id, score, p_size, vendor, unnest([w[1], w[2]]) AS product FROM c)
"""


@query(f"""{_FEED} SELECT cve_id, vendor, product, 'HIGH' AS severity, score, count(*) AS ranges, p_size || '.0' AS starts FROM p GROUP BY ALL
UNION ALL SELECT 'CVE-' || p_partkey, NULL, NULL, 'LOW', 1.5, 0, NULL FROM part WHERE p_partkey % 10 = 0""")
def vulnerability_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zipped JSON feeds, one for each brand and one that is broken, as a row for each product of an entry."""
    criteria = lambda i: F.concat(F.lit("cpe:2.3:a:"), F.lower(F.replace("p_brand", F.lit("#"), F.lit(""))), F.lit(":"), F.get(F.split(F.lower("p_name"), " "), F.lit(i)), F.lit(":*"))
    match = lambda i: F.struct(criteria(i).alias("criteria"), F.concat(F.col("p_size").cast("string"), F.lit(".0")).alias("versionStartIncluding"))
    metric = lambda score, severity: F.array(F.struct(F.lit("Primary").alias("type"), F.struct(score.alias("baseScore"), F.lit(severity).alias("baseSeverity")).alias("cvssData")))
    new = F.struct(metric(F.col("p_size") / 10, "high").alias("cvssMetricV31"))
    old = F.struct(metric(F.lit(1.5), "low").alias("cvssMetricV2"))
    nodes = F.array(F.struct(F.array(F.struct(F.array(match(0), match(1)).alias("cpeMatch"))).alias("nodes")))
    named = F.concat(F.lit("CVE-"), _k().cast("string"))
    full = F.to_json(F.struct(F.struct(named.alias("id"), new.alias("metrics"), nodes.alias("configurations")).alias("cve")))
    bare = F.to_json(F.struct(F.struct(named.alias("id"), old.alias("metrics")).alias("cve")))
    entries = _parts(spark, sf_dir).select("p_brand", F.when(_k() % 10 == 0, bare).otherwise(full).alias("e"))
    texts = entries.groupBy("p_brand").agg(F.concat(F.lit('{"vulnerabilities":['), F.array_join(F.array_sort(F.collect_list("e")), ","), F.lit("]}")).alias("text"))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, text in zip(batch["p_brand"], batch["text"], strict=True):
                raw = io.BytesIO()
                with zipfile.ZipFile(raw, "w") as z:
                    z.writestr("a.json", text)
                    z.writestr("b.json", "{")
                yield pd.DataFrame({"path": [name], "content": [raw.getvalue()]})

    packed = texts.mapInPandas(pack, "path string, content binary")
    broken = values(spark, "path string, content binary", [("x", bytearray(b"PK no"))])
    found = documents.vulnerabilities(documents.members(packed.unionByName(broken)))
    return found.select("cve_id", "vendor", "product", "severity", "score", F.size("version_ranges").cast("long").alias("ranges"), F.get("version_ranges", F.lit(0))["start_including"].alias("starts"))


_PERMISSIONS = ["ACCESS_FINE_LOCATION", "CAMERA", "INTERNET", "VIBRATE", "SEND_SMS", "ACCESS_ADSERVICES_TOPICS"]
_SCHEMES = ["https", "http", "market", "myapp", "content"]
_MANIFEST = """<?xml version="1.0"?><manifest xmlns:android="http://schemas.android.com/apk/res/android" package="com.app{k}">
<uses-sdk android:minSdkVersion="21" android:targetSdkVersion="{target}"/>
<uses-permission android:name="android.permission.{p}"/><uses-permission android:name="android.permission.{p}"/><uses-permission android:name="com.app.OWN{k}"/><permission android:name="com.app.X" android:protectionLevel="signature"/>
<queries><package android:name="com.other"/><provider android:authorities="a;b"/><intent><action android:name="x"/></intent></queries>
<application android:allowBackup="{backup}">
<activity android:name=".Main{k}"><intent-filter android:autoVerify="true"><action android:name="android.intent.action.MAIN"/><category android:name="android.intent.category.LAUNCHER"/><category android:name="android.intent.category.BROWSABLE"/><data android:scheme="{scheme}" android:host="h"/></intent-filter></activity>
<service android:name="com.lib.Service" android:exported="true"/><provider android:name="P" android:authorities="a{k};b"/>
<receiver android:name="R" android:exported="true"><meta-data android:name="inner" android:resource="@string/r"/></receiver>
<meta-data android:name="com.maps.API_KEY" android:value="{secret}"/><uses-library android:name="org.lib"/></application></manifest>"""


def _manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest for each part; every twentieth is broken off."""
    secret = F.when(_k() % 4 == 0, F.lpad(_k().cast("string"), 12, "1")).when(_k() % 4 == 1, F.concat(F.lit("AIza"), F.lpad(_k().cast("string"), 35, "x"))).when(_k() % 4 == 2, F.rpad(_k().cast("string"), 20, "~")).otherwise("short")
    whole = _text(_MANIFEST, k=_k(), target=F.lit(28) + _k() % 6, p=_pick(_PERMISSIONS), backup=_pick(["true", "false"]), scheme=_pick(_SCHEMES), secret=secret)
    body = F.when(_k() % 20 == 0, F.substring(whole, 1, 400)).otherwise(whole)
    return documents.manifests(dealt(_parts(spark, sf_dir).select("p_partkey")).select(F.concat(F.lit("s"), _k().cast("string")).alias("sample_id"), body.cast("binary").alias("content")))


_GOOD = "SELECT 's' || p_partkey AS sample_id, p_partkey AS k, 28 + p_partkey % 6 AS target FROM part WHERE p_partkey % 20 <> 0"


@query(f"""
WITH g AS ({_GOOD}), c AS (
  SELECT *, 'activity' AS kind, '.Main' || k AS name, CASE WHEN target >= 31 THEN NULL ELSE true END AS exported, target >= 31 AS violation, true AS filtered FROM g UNION ALL
  SELECT *, 'service', 'com.lib.Service', true, false, false FROM g UNION ALL SELECT *, 'provider', 'P', NULL, false, false FROM g UNION ALL SELECT *, 'receiver', 'R', true, false, false FROM g)
SELECT sample_id, kind, CASE WHEN name LIKE '.%' THEN 'com.app' || k || name WHEN name NOT LIKE '%.%' THEN 'com.app' || k || '.' || name ELSE name END AS qualified_name,
  exported AS exported_effective, violation AS export_violation, filtered AS launcher, filtered AS browsable, filtered AS verified FROM c""")
def manifest_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared components of manifests, broken ones aside."""
    return plan.component_table(_manifests(spark, sf_dir)).select("sample_id", "kind", "qualified_name", "exported_effective", "export_violation", "launcher", "browsable", "verified")


@query(f"""
WITH g AS ({_GOOD}) SELECT sample_id, 'component' AS source, unnest(['.Main' || k, 'com.lib.Service', 'P', 'R']) AS value FROM g UNION ALL
SELECT sample_id, 'authority', unnest(['a' || k, 'b']) FROM g UNION ALL SELECT sample_id, 'library', 'org.lib' FROM g UNION ALL SELECT sample_id, 'meta_name', 'com.maps.API_KEY' FROM g UNION ALL
SELECT sample_id, 'meta_value', CASE k % 4 WHEN 0 THEN lpad(CAST(k AS VARCHAR), 12, '1') WHEN 1 THEN 'AIza' || lpad(CAST(k AS VARCHAR), 35, 'x') WHEN 2 THEN rpad(CAST(k AS VARCHAR), 20, '~') ELSE 'short' END FROM g""")
def manifest_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in manifests that may show an embedded component."""
    return documents.evidence(_manifests(spark, sf_dir))


@query(f"""
WITH g AS (SELECT *, {_PERMISSIONS}[k % 6 + 1] AS p, {_SCHEMES}[k % 5 + 1] AS s FROM ({_GOOD}))
SELECT sample_id, target, k % 2 = 0 AS backup, 4 AS components, CASE WHEN target >= 31 THEN 2 ELSE 3 END AS exported_count, CASE WHEN target >= 31 THEN 0 ELSE 1 END AS exported_activities, 1 AS exported_receivers_no_perm,
  1 AS deep_links, CASE WHEN s = 'myapp' THEN 1 ELSE 0 END AS deep_links_custom, CASE WHEN s = 'https' THEN 1 ELSE 0 END AS deep_links_https,
  2 AS permissions, CASE WHEN p IN ('ACCESS_FINE_LOCATION', 'CAMERA', 'SEND_SMS') THEN 1 ELSE 0 END AS dangerous_permissions, CASE WHEN p = 'ACCESS_ADSERVICES_TOPICS' THEN 1 ELSE 0 END AS sandbox_permissions,
  CASE WHEN p = 'ACCESS_FINE_LOCATION' THEN 1 ELSE 0 END AS perm_location, CASE WHEN p IN ('VIBRATE', 'ACCESS_ADSERVICES_TOPICS') THEN 2 ELSE 1 END AS perm_other, 1 AS declared_signature,
  1 AS queries_package_count, 1 AS queries_intent_count, 1 AS queries_provider_count FROM g""")
def manifest_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide counts of an app: components, deep links by scheme, permissions by family, queries."""
    wide = plan.app_table(_manifests(spark, sf_dir)).where("readable")
    names = ["components", "exported_count", "exported_activities", "exported_receivers_no_perm", "deep_links", "deep_links_custom", "deep_links_https", "permissions", "dangerous_permissions", "sandbox_permissions", "perm_location", "perm_other", "declared_signature", "queries_package_count", "queries_intent_count", "queries_provider_count"]
    return wide.select("sample_id", "target", "backup", *(F.col(n).cast("int").alias(n) for n in names))


@query(f"""
WITH g AS ({_GOOD}) SELECT CASE k % 4 WHEN 0 THEN 'public_id' WHEN 1 THEN 'sensitive_token' WHEN 2 THEN 'possible_credential' ELSE 'none' END AS tier, count(*) AS n FROM g GROUP BY 1
UNION ALL SELECT 'none', count(*) FROM g""")
def secret_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of manifest meta-data by tier, one of a component among them."""
    rows = documents.meta_data(_manifests(spark, sf_dir))
    tier = F.coalesce(strings.secret_tier(F.col("name"), F.col("value"))["tier"], F.lit("none"))
    return rows.groupBy("name", tier.alias("tier")).agg(F.count("*").alias("n")).select("tier", "n")


@query("""
SELECT 's' || p_partkey AS sample_id, 'base' AS rule, p_partkey % 2 = 0 AS cleartext, CAST(NULL AS VARCHAR) AS domain, CAST(NULL AS BOOLEAN) AS subdomains, 'system;user' AS anchors, '' AS pins FROM part UNION ALL
SELECT 's' || p_partkey, 'domain', NULL, 'h' || p_partkey || '.example.com', p_partkey % 3 = 0, '', 'SHA-256:abc' FROM part""")
def network_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules of network security files by domain."""
    text = _text(
        '<network-security-config><base-config cleartextTrafficPermitted="{c}"><trust-anchors><certificates src="user"/><certificates src="system"/><certificates src="user"/></trust-anchors></base-config>'
        '<domain-config><domain includeSubdomains="{s}">H{k}.Example.com</domain><pin-set><pin digest="SHA-256">abc</pin></pin-set></domain-config></network-security-config>',
        c=(_k() % 2 == 0).cast("string"), s=(_k() % 3 == 0).cast("string"), k=_k(),
    )
    rows = _parts(spark, sf_dir).select(F.concat(F.lit("s"), _k().cast("string")).alias("sample_id"), F.lit("res/xml/n.xml").alias("path"), text.cast("binary").alias("content"))
    return documents.network_domains(rows).drop("file")


_PATHS = ["AndroidManifest.xml", "smali/com/face/book/core/A.smali", "smali_classes2/com/face/B.smali", "res/values-de/strings.xml", "res/xml/n.xml", "assets/d/x.json", "assets/a.txt", "META-INF/maven/g/pom.xml", "META-INF/l.version", "lib/x.so"]
_KINDS = ["manifest", "smali", "smali", "res_values", "res_xml", "assets_json", "assets_txt", "pom", "metadata", "other"]


@query(f"SELECT {_KINDS}[p_partkey % 10 + 1] AS kind, count(*) AS n FROM part GROUP BY 1")
def file_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of decoded apps by kind."""
    return _parts(spark, sf_dir).groupBy(files.file_kind(_pick(_PATHS)).alias("kind")).agg(F.count("*").alias("n"))


@query("""
SELECT sample_id, prefix, depth FROM (SELECT p_size AS sample_id, p_partkey % 10 AS k FROM part), (VALUES (1, 'com.face.book', 3), (1, 'com.face.book.core', 4), (2, 'com.face', 2)) v(k2, prefix, depth) WHERE k = k2 GROUP BY ALL""")
def code_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packages of code files at three depths."""
    rows = _parts(spark, sf_dir).select(F.col("p_size").alias("sample_id"), _pick(_PATHS).alias("path"))
    return files.package_prefixes(rows.withColumn("kind", files.file_kind(F.col("path"))))


@query("""
SELECT p_size AS folder, min('app' || lpad(CAST(p_partkey AS VARCHAR), 7, '0') || '.apk') AS name FROM part WHERE p_partkey % 3 = 1 GROUP BY 1""")
def main_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The app of each folder that is no configuration split."""
    name = F.concat(_pick(["config.", "app", "app"]), F.lpad(_k().cast("string"), 7, "0"), _pick([".apk", ".apk", ".txt"]))
    return files.main_packages(_parts(spark, sf_dir).select(F.col("p_size").alias("folder"), name.alias("name")))


@query("SELECT sample_id, path FROM (SELECT p_size AS sample_id, 'smali/' || lpad(CAST(p_partkey AS VARCHAR), 7, '0') AS path, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) AS n FROM part) WHERE n <= 2")
def first_code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most two code files of each app, by path: a limit that is asked for."""
    rows = _parts(spark, sf_dir).select(F.col("p_size").alias("sample_id"), F.concat(F.lit("smali/"), F.lpad(_k().cast("string"), 7, "0")).alias("path"), F.lit("smali").alias("kind"))
    return files.first_files(rows, "smali", 2).select("sample_id", "path")


@query("""
SELECT event_id, 'host' || user_id AS host, CASE WHEN event_id % 3 = 0 THEN 53 ELSE 443 END AS port, CASE WHEN event_id % 5 = 0 THEN 0 ELSE event_id END AS sent, event_id % 3 = 0 OR event_id % 2 = 0 AS is_dns FROM events""")
def device_capture_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connections listed by a capture on the device; numbers that cannot be read are 0."""
    path, i = scratch(spark, "device"), F.col("event_id")
    rows = table(spark, sf_dir, "events").select(
        i.alias("FirstSeen"), F.lit("x").alias("LastSeen"), F.concat(F.lit("host"), "user_id").alias("Info"), F.lit("1.1.1.1").alias("DstIp"), F.when(i % 3 == 0, 53).otherwise(443).alias("DstPort"),
        F.when(i % 2 == 0, "dns").otherwise("TCP").alias("Proto"), F.when(i % 5 == 0, "bad").otherwise(i.cast("string")).alias("BytesSent"), F.lit(1).alias("BytesRcvd"), F.lit("ok").alias("Status"),
    )
    sinks.csv(rows, path)
    return tabular.device_captures(spark, path).select(F.col("FirstSeen").cast("long").alias("event_id"), F.col("Info").alias("host"), F.col("DstPort").alias("port"), F.col("BytesSent").alias("sent"), "is_dns")


@query("""
SELECT event_id, ['http', 'dns', 'tls'][event_id % 3 + 1] AS event_type, 'h' || user_id || '.example.com' AS domain, '10.0.0.' || (event_id % 250) AS dst_ip, CASE WHEN event_id % 3 = 0 THEN '/p' || event_id ELSE '' END AS url,
  event_id % 3 = 1 AS udp FROM events""")
def packet_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of HTTP requests, DNS questions and TLS greetings, byte by byte."""
    i, name = F.col("event_id"), F.concat(F.lit("h"), F.col("user_id").cast("string"), F.lit(".example.com"))
    wide = lambda n, digits: F.lpad(F.hex(n), digits, "0")
    label = lambda x: F.concat(wide(F.length(x), 2), F.hex(x))
    size = lambda x: F.floor(F.length(x) / 2).cast("long")
    http = F.hex(F.concat(F.lit("GET /p"), i.cast("string"), F.lit(" HTTP/1.1\r\nHost: "), name, F.lit(":80\r\n\r\n")))
    dns = F.concat(F.lit("000701000001000000000000"), label(F.concat(F.lit("h"), F.col("user_id").cast("string"))), label(F.lit("example")), label(F.lit("com")), F.lit("0000010001"))
    n = F.length(name)
    extension = F.concat(F.lit("00170000"), F.lit("0000"), wide(n + 5, 4), wide(n + 3, 4), F.lit("00"), wide(n, 4), F.hex(name))
    hello = bound(extension, lambda x: F.concat(F.lit("0303" + "72" * 32 + "00" + "0002" + "1301" + "0100"), wide(size(x), 4), x))
    tls = bound(hello, lambda x: F.concat(F.lit("160301"), wide(size(x) + 4, 4), F.lit("01"), wide(size(x), 6), x))
    udp = i % 3 == 1
    built = F.when(udp, dns).when(i % 3 == 0, http).otherwise(tls)
    events = written(table(spark, sf_dir, "events").select("event_id", built.alias("payload")), "built")  # later sizes would otherwise write it out again
    payload = F.col("payload")
    part = F.when(udp, F.concat(F.lit("13880035"), wide(size(payload) + 8, 4), F.lit("0000"), payload)).otherwise(F.concat(F.lit("1388"), F.when(i % 3 == 0, "0050").otherwise("01BB"), F.lit("0" * 16 + "5018" + "0" * 12), payload))
    frame = F.concat(F.lit("4500"), wide(size(part) + 20, 4), F.lit("0000000040"), F.when(udp, "11").otherwise("06"), F.lit("0000" + "0A000002"), F.lit("0A0000"), wide(i % 250, 2), part)
    frames = events.select(F.lit("f").alias("file"), i.alias("number"), F.lit(1.0).alias("time"), F.lit(101).alias("link"), F.unhex(frame).alias("frame"))
    found = captures.packets(frames)
    return found.select(F.col("number").alias("event_id"), "event_type", "domain", "dst_ip", F.col("http_url").alias("url"), (F.col("protocol") == "UDP").alias("udp"))


@query("SELECT page_id, url, 'h' || page_id AS host, 'GET ü ' || page_id AS request, octet_length(encode('GET ü ' || page_id)) AS request_size FROM pages")
def proxy_export_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of a proxy's XML export with encoded bodies."""
    path = scratch(spark, "proxy")
    body = F.base64(F.concat(F.lit("GET ü "), F.col("page_id").cast("string")).cast("binary"))
    escaped = F.replace(F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    item = _text('<item><time>{i}</time><url>{u}</url><host ip="1.2.3.4">h{i}</host><method>GET</method><request base64="true">{b}</request><response base64="false">ok</response></item>', i="page_id", u=escaped, b=body)
    items = table(spark, sf_dir, "pages").select(F.floor(F.col("page_id") / 1000).alias("g"), item.alias("value"))
    exports = items.groupBy("g").agg(F.concat(F.lit("<items>"), F.array_join(F.array_sort(F.collect_list("value")), "\n"), F.lit("</items>")).alias("value"))
    exports.write.partitionBy("g").text(path)
    return documents.proxy_items(spark, path).select(F.col("time").cast("long").alias("page_id"), "url", "host", "request", F.col("request_size").cast("long").alias("request_size"))


@query("""
SELECT 'android.app' AS package_name, 'C' || p_partkey AS class_name, 'set' AS method_name, unnest(['android.permission.A', 'android.permission.B' || (p_partkey % 3)]) AS permission, CAST(16 + p_size % 10 AS INT) AS level FROM part
UNION ALL SELECT 'a.b', 'C' || p_partkey, 'm', CASE WHEN p_partkey % 2 = 0 THEN 'android.permission.SEND' ELSE 'x.y.Z' END, NULL FROM part""")
def permission_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two published forms of permission lists."""
    p = _parts(spark, sf_dir)
    maps = p.select(_text("android.app.C{k}.set(long)void  ::  android.permission.A, android.permission.B{b}", k=_k(), b=_k() % 3).alias("value"), _text("/m/api-{l}/map.txt", l=F.lit(16) + F.col("p_size") % 10).alias("file_path"))
    calls = p.select(_text("<a.b.C{k}: void m(int)> -> {p}", k=_k(), p=_pick(["SEND", "x.y.Z"])).alias("value"))
    noise = values(spark, "value string, file_path string", [("no rule", "/m/api-1/map.txt")])
    one = knowledge.permission_map_rows(maps.unionByName(noise))
    return one.unionByName(knowledge.permission_call_rows(calls.unionByName(noise.select("value"))), allowMissingColumns=True)


@query("SELECT 'C' || p_partkey AS class_name, 'T' AS target, unnest(['P' || p_size, 'Q']) AS permission, 'Method' AS kind FROM part")
def permission_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definitions in XML, one row for each permission."""
    text = _text('<r><permissionDef className="C{k}" target="T" targetKind="Method"><permission name="P{s}"/><permission name="Q"/></permissionDef></r>', k=_k(), s="p_size")
    return knowledge.permission_definitions(_parts(spark, sf_dir).select(text.cast("binary").alias("content")))


@query("""
SELECT DISTINCT 'd' || p_size AS detector, 'D' || p_size AS provider, CASE WHEN p_partkey % 2 = 0 THEN 'key' ELSE 'client_secret' END AS secret_type, '[0-9a-f]{' || (p_partkey % 5 + 10) || '}' AS regex FROM part""")
def detector_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patterns in the sources of detectors, helpers aside."""
    text = _text("package x\nvar (\n {v} = regexp.MustCompile(`[0-9a-f]LEFT{n}RIGHT`)\n keyword = regexp.MustCompile(`k`)\n)", v=_pick(["keyPat", "clientSecretPat"]), n=_k() % 5 + 10)
    text = F.replace(F.replace(text, F.lit("LEFT"), F.lit("{")), F.lit("RIGHT"), F.lit("}"))
    return knowledge.detector_patterns(_parts(spark, sf_dir).select(_text("d/d{s}/a.go", s="p_size").alias("path"), text.cast("binary").alias("content")))


@query("""
SELECT 'a.L' || p_partkey AS class_name, 'get' AS method_name, CASE WHEN p_partkey % 2 = 0 THEN 'source' ELSE 'sink' END AS role FROM part""")
def flow_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signatures of sources and sinks."""
    return knowledge.flow_signature_rows(_parts(spark, sf_dir).select(_text("<a.L{k}: double get()> -> _{r}_", k=_k(), r=_pick(["SOURCE", "SINK"])).alias("value")))


@query("""
SELECT DISTINCT 'T' || p_size AS name, CASE WHEN p_size % 2 = 0 THEN 'Ads' ELSE '' END AS category, unnest(['a' || p_size || '.com', 'b.com']) AS domain FROM part UNION ALL
SELECT DISTINCT 'list 7', '', 'd' || p_size || '.com' FROM part WHERE p_size % 2 = 0""")
def tracker_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trackers of a JSON map, and whole-domain rules of a filter list."""
    p = _parts(spark, sf_dir).select("p_size").distinct()
    one = F.struct(F.concat(F.lit("T"), "p_size").alias("name"), _text("a{s}\\.com|b\\.com", s="p_size").alias("network_signature"), F.when(F.col("p_size") % 2 == 0, F.array(F.lit("Ads"), F.lit("X"))).otherwise(F.array().cast("array<string>")).alias("categories"))
    json = p.select(F.to_json(F.struct(F.create_map(F.col("p_size").cast("string"), one).alias("trackers"))).alias("text"))
    lists = p.select(F.concat(F.lit("! Version: 7\n##.cosmetic\n"), F.when(F.col("p_size") % 2 == 0, _text("||d{s}.com^$third-party\n||p.com/x\n", s="p_size")).otherwise("||o.com^$image\n")).alias("value"))
    two = knowledge.blocked_domain_rows(lists).select(F.concat(F.lit("list "), "version").alias("name"), F.lit("").alias("category"), "domain")
    return knowledge.tracker_signatures(json).unionByName(two)


@query("SELECT 'r' || p_partkey AS resolver_name, CASE WHEN p_partkey % 2 = 0 THEN 'doh' ELSE 'dnscrypt' END AS protocol, '10.0.0.' || (p_partkey % 250) AS address FROM part")
def resolver_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resolvers of a Markdown list, their stamps taken apart byte by byte."""
    address = _text("10.0.0.{b}:443", b=_k() % 250)
    raw = F.concat(F.when(_k() % 2 == 0, F.unhex(F.lit("02"))).otherwise(F.unhex(F.lit("01"))), F.unhex(F.lit("00" * 8)), F.unhex(F.lpad(F.hex(F.length(address)), 2, "0")), address.cast("binary"))
    stamp = F.rtrim(F.translate(F.base64(raw), "+/=", "-_"))
    return knowledge.resolver_rows(_parts(spark, sf_dir).select(F.concat(F.lit("# list\n## r"), _k().cast("string"), F.lit("\nnote\nsdns://"), stamp, F.lit("\n")).alias("value")))


@query("""
SELECT 'tracker' AS rule, 'd' || s_suppkey || '.com' AS name, 'V' AS value FROM supplier UNION ALL SELECT 'resolver', '1.1.' || s_suppkey || '.1', CASE WHEN s_suppkey % 2 = 0 THEN 'true' ELSE 'false' END FROM supplier UNION ALL
SELECT 'override', '1.1.' || s_suppkey || '.1', 'HIGH' FROM supplier UNION ALL SELECT 'pattern', 'P' || s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'MEDIUM' ELSE 'HIGH' END FROM supplier UNION ALL
SELECT 'place', '2.0.' || s_suppkey || '.0', 'DE' FROM supplier""")
def rule_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The typed rule tables of traffic, with defaults filled in."""
    root, k = scratch(spark, "rules"), F.col("s_suppkey")
    s = table(spark, sf_dir, "supplier")
    sinks.csv(s.select(_text("d{k}.com", k=k).alias("domain_suffix"), F.lit("V").alias("vendor")), f"{root}/trackers.csv")
    sinks.csv(s.select(_text("1.1.{k}.1", k=k).alias("ip_address"), (k % 2 == 0).alias("supports_doh")), f"{root}/resolvers.csv")
    sinks.csv(s.select(_text("P{k}", k=k).alias("pattern_name"), F.lit("x").alias("regex"), F.when(k % 2 == 1, "HIGH").alias("confidence")), f"{root}/patterns.csv")
    sinks.csv(s.select(_text("2.0.{k}.0", k=k).alias("ip_from"), _text("2.0.{k}.9", k=k).alias("ip_to"), F.lit("DE").alias("country_code")), f"{root}/places.csv")
    rules = tabular.traffic_rules(spark, root)
    override = tabular.resolver_overrides(spark, f"{root}/resolvers.csv", "ip_address string")
    one = lambda rule, df, name, value: df.select(F.lit(rule).alias("rule"), F.col(name).alias("name"), F.col(value).cast("string").alias("value"))
    out = one("tracker", rules["trackers"], "domain_suffix", "vendor").unionByName(one("resolver", rules["resolvers"], "ip_address", "supports_doh"))
    out = out.unionByName(one("override", override, "ip_address", "confidence")).unionByName(one("pattern", rules["patterns"], "pattern_name", "confidence"))
    return out.unionByName(one("place", rules["places"], "ip_from", "country_code"))


@query("SELECT p_partkey, 'v' || p_size AS version, 'b=c' AS a, 2 AS entries FROM part WHERE p_partkey % 5 <> 0")
def properties_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of a list, comments aside, and the properties of each."""
    lines = _parts(spark, sf_dir).select(F.when(_k() % 5 == 0, F.lit("# comment")).otherwise(F.concat(F.lit("  "), _k().cast("string"), F.lit(" "))).alias("value"), F.col("p_size"))
    named = tabular.name_rows(lines.select("value")).select(F.col("name").cast("long").alias("p_partkey"))
    text = _text("#x=1\na = b=c\n!y=2\nversion=old\nversion=v{s}\nnone", s="p_size")
    found = _parts(spark, sf_dir).select("p_partkey", tabular.properties(text).alias("m"))
    return named.join(found, "p_partkey").select("p_partkey", F.col("m")["version"].alias("version"), F.col("m")["a"].alias("a"), F.size("m").alias("entries"))


@query("SELECT r_name AS value FROM region ORDER BY 1")
def verified_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file that is read only if its hash is the expected one."""
    path = scratch(spark, "verified")
    table(spark, sf_dir, "region").select(F.array_join(F.array_sort(F.collect_list("r_name")), "\n").alias("value")).coalesce(1).write.text(path)
    want = table(spark, sf_dir, "region").select(F.sha2(F.concat(F.array_join(F.array_sort(F.collect_list("r_name")), "\n"), F.lit("\n")), 256)).first()[0]
    found = tabular.verified(spark, f"{path}/part-*.txt", want)
    return found.select(F.explode(F.split(F.decode("content", "utf-8"), "\n")).alias("value")).where("value <> ''")


@query("""
SELECT 'orders' AS name, count(*) AS rows, 'run-1' AS run, 'trace' AS source FROM orders UNION ALL SELECT 'customer', count(*), 'run-1', 'trace' FROM customer UNION ALL
SELECT 'orders', count(*), 'run-1', 'table' FROM orders UNION ALL SELECT 'customer', count(*), 'run-1', 'table' FROM customer UNION ALL SELECT 'rules', count(*), 'ab', 'stats' FROM supplier""")
def checked_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables that are written once their checks pass, the trace of the run, and a rule table with its statistics."""
    root = scratch(spark, "tables")
    frames = {n: table(spark, sf_dir, n) for n in ("orders", "customer")}
    sinks.tables(frames, f"{root}/t", {"parents": lambda f: f["orders"].join(f["customer"], F.col("o_custkey") == F.col("c_custkey"), "left_anti")})
    sinks.trace({"run": "run-1"}, frames, f"{root}/trace")
    s = table(spark, sf_dir, "supplier")
    sinks.knowledge(s, f"{root}/k", ["s_suppkey"], s.agg(F.count("*").alias("n")), "ab")
    traced = spark.read.schema("run string, rows map<string,long>").json(f"{root}/trace").select("run", F.explode("rows").alias("name", "rows"))
    out = traced.select("name", "rows", "run", F.lit("trace").alias("source"))
    for n in frames:
        again = sinks.current(spark, f"{root}/t", n).agg(F.count("*").alias("rows"))
        out = out.unionByName(again.select(F.lit(n).alias("name"), "rows", *ids.stamped({"run": "run-1"}), F.lit("table").alias("source")))
    stats = spark.read.json(f"{root}/k/stats")
    return out.unionByName(stats.select(F.lit("rules").alias("name"), F.col("n").alias("rows"), F.col("source_sha256").alias("run"), F.lit("stats").alias("source")))


@query(f"""
WITH {PACKETS} SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'sni.example' WHEN event_id % 3 = 0 THEN 'host.example' ELSE domain END AS name,
  CASE WHEN dst_port = 53 THEN 'dns' WHEN event_id % 3 = 0 THEN 'http' WHEN event_id % 2 = 0 THEN 'tls' WHEN protocol = 'UDP' AND dst_port = 443 THEN 'quic' ELSE 'unknown' END AS discovery,
  CASE WHEN dst_port = 53 THEN dst_ip ELSE '9.9.9.9' END AS resolver, CASE WHEN event_id % 2 = 0 THEN 'AAAA' ELSE 'A' END AS qtype, dst_ip <> '' AS literal,
  substr(md5(dst_ip), 1, 8) AS tag, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS seen FROM packets""")
def packet_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of packets: name, how it became known, resolver, kind of question, address, time."""
    i, port = F.col("event_id"), F.col("dst_port")
    sni, host = F.when(i % 2 == 0, "sni.example").otherwise(""), F.when(i % 3 == 0, "host.example").otherwise("")
    answers = F.array(F.lit("1.2.3.4"), F.when(i % 2 == 0, "2001:db8::1").otherwise("5.6.7.8"))
    quic = net.is_quic(F.col("protocol"), F.lit(4000), port)
    return packets(spark, sf_dir).select(
        "event_id", net.event_domain(sni, host, F.col("domain")).alias("name"), net.discovery_source(port == 53, i % 3 == 0, i % 2 == 0, quic).alias("discovery"),
        net.resolver_of(port, F.col("dst_ip"), F.lit("9.9.9.9")).alias("resolver"), net.query_type(answers).alias("qtype"), net.is_ip(F.col("dst_ip")).alias("literal"), ids.short_md5(F.col("dst_ip")).alias("tag"),
        ids.iso_time(F.unix_micros(F.col("ts").cast("timestamp")).cast("decimal(30,6)") / 1_000_000).alias("seen"),
    )


_VENDORS = [("google", "Google"), ("cloudflare", "Cloudflare")]


@query("""
SELECT p_partkey, ['get', 'Last', 'Location'] [p_partkey % 3 + 1] AS word, CASE p_partkey % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS confidence,
  CASE p_partkey % 3 WHEN 0 THEN 'Google' WHEN 1 THEN 'Cloudflare' ELSE 'Community' END AS provider, '{"a":1,"b":' || p_size || '}' AS details, left(repeat(p_name, 30), 500) AS snippet,
  p_partkey % 3 <> 2 AS phone, p_partkey % 2 = 0 AS subset, coalesce('', '') AS blank, 0 AS zero FROM part""")
def field_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small text functions: words, confidences, providers, sorted JSON, snippets, phone numbers, subsets, defaults."""
    phone = _pick(["+49 (30) 1234-567", "+1 555 123 4567", "+12"])
    sets = joins.is_subset(F.array(F.lit("a"), F.when(_k() % 2 == 0, "b").otherwise("z")), F.array(F.lit("a"), F.lit("b"), F.lit("c")))
    out = _parts(spark, sf_dir).select(
        "p_partkey", F.get(strings.camel_words(F.lit("getLastLocation")), (_k() % 3).cast("int")).alias("word"), strings.plain_confidence(_pick(["VERY_HIGH", "high", "Medium", "x"])).alias("confidence"),
        strings.cleaned_keyword(_pick(["dns.google", "CloudFlare-dns", "other"]), _VENDORS, F.lit("Community")).alias("provider"),
        ids.sorted_json(F.create_map(F.lit("b"), F.col("p_size"), F.lit("a"), F.lit(1))).alias("details"), F.substring(F.repeat("p_name", 30), 1, merges.SNIPPET).alias("snippet"), strings.is_e164(phone).alias("phone"), sets.alias("subset"),
    )
    return conform(out, "p_partkey long, word string, confidence string, provider string, details string, snippet string, phone boolean, subset boolean, blank string, zero int")


@query(f"""
WITH v(vendor, canonical) AS ({sql_values([("Supplier#000000001", "One"), ("Supplier#000000002", "Two")])}) SELECT s_suppkey, coalesce(canonical, s_name) AS vendor FROM supplier LEFT JOIN v ON vendor = s_name""")
def exact_vendors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vendors by exact name, else themselves."""
    rules = values(spark, "vendor string, canonical string", [("Supplier#000000001", "One"), ("Supplier#000000002", "Two")])
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    named = joins.dimension(s, "s_name", rules, "vendor", {"canonical": None})
    return named.select("s_suppkey", F.coalesce("canonical", "s_name").alias("vendor"))


@query("""
WITH d AS (SELECT 's' || p_size AS s, p_name AS n, 'pkg.' || p_partkey AS p, CASE WHEN p_partkey % 3 = 0 THEN '1.' || p_size WHEN p_partkey % 3 = 1 THEN 'bad' ELSE '' END AS h, p_partkey FROM part),
v AS (SELECT *, CASE WHEN p_partkey % 3 = 0 THEN h ELSE '' END AS v FROM d)
SELECT s AS sample_id, substr(sha256(s || '|' || n || '|' || p || '|' || v), 1, 16) AS sdk_id, n AS sdk_name, v AS sdk_version, CASE WHEN v <> '' THEN 'high' ELSE 'none' END AS sdk_version_confidence, p_partkey % 2 = 0 AS in_manifest FROM v""")
def detector_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A detector's rows as rows of the library table."""
    hint = F.when(_k() % 3 == 0, F.concat(F.lit("1."), F.col("p_size").cast("string"))).when(_k() % 3 == 1, "bad").otherwise("")
    found = _parts(spark, sf_dir).select(F.concat(F.lit("s"), "p_size").alias("sample_id"), F.col("p_name").alias("name"), _text("pkg.{k}", k=_k()).alias("package"), hint.alias("version_hint"), _pick(["manifest", "smali"]).alias("source"), F.lit("e").alias("evidence"))
    return plan.detected_rows(found).select("sample_id", "sdk_id", "sdk_name", "sdk_version", "sdk_version_confidence", "in_manifest")


@query("""
WITH f AS (SELECT p_partkey, ['com', 'example', 'local', 'xyz'][p_partkey % 4 + 1] AS tld, p_partkey % 3 AS m FROM part),
n AS (SELECT p_partkey, m, tld, ['a' || p_partkey || '.', 'com.android.', 'theme.'][m + 1] || 'host.' || tld AS name FROM f)
SELECT p_partkey, name, m = 0 AND tld IN ('com', 'xyz') AS domain_ok, p_partkey % 6 IN (0, 1, 2, 4) AS address_ok FROM n""")
def plausible_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and addresses of texts that may be endpoints."""
    name = F.concat(F.when(_k() % 3 == 0, _text("a{k}.", k=_k())).when(_k() % 3 == 1, "com.android.").otherwise("theme."), F.lit("host."), _pick(["com", "example", "local", "xyz"]))
    address = _pick(["10.1.2.3", "192.168.0.1", KNOWN_ADDRESSES[2], "8.8.4.5", "9.9.9.9", "999.1.1.1"])
    return _parts(spark, sf_dir).select("p_partkey", name.alias("name"), net.plausible_domain(name).alias("domain_ok"), net.plausible_endpoint(address, _k() % 6 == 4).alias("address_ok"))


_TOKENS = ["tok3n-Value/x9Qz7Lm2", "ACTION_VIEW_12345678", "R.string.name12Abc", "getValueForKey12", "0123456789abcdefXY", "ab__cdEF12", "Xk9-pQ2vL8mZ4tR7", "aaaaaaaA1-aaaaaaa", "Zx8.Yw7.Vu6.Ts5-Rq4"]


@query("SELECT p_partkey, p_partkey % 9 IN (0, 6) AS by_entropy, p_partkey % 9 IN (0, 6, 7, 8) AS by_pattern FROM part")
def secret_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens that may be secrets, by their entropy alone and as matches of a pattern (F8, M2)."""
    token = _pick(_TOKENS)
    return _parts(spark, sf_dir).select("p_partkey", strings.plausible_secret(token).alias("by_entropy"), strings.plausible_secret(token, False).alias("by_pattern"))


@query(r"""
WITH e AS (SELECT page_id, 'url' AS kind, 'h' || (page_id % 50) || '.example.com' AS host, 'high' AS confidence FROM pages UNION ALL SELECT page_id, 'ip', '10.0.0.' || (page_id % 200), 'medium' FROM pages UNION ALL
SELECT page_id, 'ip', '93.184.216.34', 'medium' FROM pages UNION ALL SELECT page_id, 'domain', 'api' || (page_id % 9) || '.shop.io', 'high' FROM pages) SELECT * FROM e""")
def endpoint_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts of URLs, addresses and bare domains of a text; a bare public address and a package name are none."""
    i = F.col("page_id")
    text = _text("see https://user@h{a}.example.com:8443/x?q and 10.0.0.{b}, 93.184.216.34:443 but not 93.184.216.35 or com.android.View; api{c}.shop.io", a=i % 50, b=i % 200, c=i % 9)
    return matching.endpoints(table(spark, sf_dir, "pages").select("page_id", text.alias("text")), ["page_id"], "text")


@query(r"""
WITH v AS (SELECT conv_id, turn, 'u' || conv_id || '@mail.example.com' AS mail, '192.168.1.' || (conv_id % 250) AS ip FROM conversations)
SELECT DISTINCT conv_id, turn, 'url' AS location, 'Email Address' AS pattern_name, 'Identity' AS category, mail AS value FROM v UNION ALL SELECT DISTINCT conv_id, turn, 'body', 'IPv4', 'Network', ip FROM v
UNION ALL SELECT DISTINCT conv_id, turn, 'body', 'Session ID', 'Authentication', 'sid=abc' FROM v""")
def personal_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in several fields, each value once."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", _text("/p?mail=u{k}@mail.example.com", k="conv_id").alias("url"), _text("from 192.168.1.{b} and 192.168.1.{b} sid=abc", b=F.col("conv_id") % 250).alias("body"))
    return matching.personal_data_in_fields(c, ["conv_id", "turn"], {"url": "url", "body": "body"})


@query(f"""
WITH {PACKETS}, f AS (SELECT DISTINCT sample_id, session_id, event_id % 40 AS connection, CASE WHEN event_id % 3 = 0 THEN 'Email Address' ELSE 'IPv4' END AS p, CASE WHEN event_id % 3 = 0 THEN 'Identity' ELSE 'Network' END AS c, event_id % 7 AS v FROM packets)
SELECT sample_id, session_id, count(*) AS pii_matches, count(DISTINCT c) AS pii_categories_keys, count(DISTINCT p) AS pii_patterns_keys, count(*) FILTER (WHERE c = 'Identity') AS identities FROM f GROUP BY ALL""")
def personal_data_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of personal data of an app session, each fact of a connection once."""
    from ..plans.traffic import personal_data_counts

    i = F.col("event_id")
    facts = packets(spark, sf_dir).select(
        "sample_id", "session_id", (i % 40).alias("connection"), F.lit("url").alias("location"), F.when(i % 3 == 0, "Email Address").otherwise("IPv4").alias("pattern_name"),
        F.when(i % 3 == 0, "Identity").otherwise("Network").alias("category"), (i % 7).alias("value"),
    )
    out = personal_data_counts(facts)
    return out.select("sample_id", "session_id", "pii_matches", "pii_categories_keys", "pii_patterns_keys", F.coalesce(F.try_element_at("pii_categories", F.lit("Identity")), F.lit(0)).alias("identities"))


@query(f"""
WITH {PACKETS}, p AS (SELECT DISTINCT sample_id, domain, upper(['us', 'LOCAL', '', 'de'][user_id % 4 + 1]) AS place FROM packets WHERE domain <> '')
SELECT sample_id, place, count(*) AS n FROM p WHERE place NOT IN ('PRIVATE', 'LOCAL', 'UNKNOWN', '') GROUP BY ALL""")
def real_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names by place, texts that stand for none left out."""
    from ..functions.values import NO_LOCATION

    p = packets(spark, sf_dir).withColumn("place", F.upper(_pick(["us", "LOCAL", "", "de"], F.col("user_id"))))
    return merges.distribution(p.where((F.col("domain") != "") & ~F.col("place").isin(NO_LOCATION)), ["sample_id"], "place", "domain")


@query("""
WITH f AS (SELECT p_size AS sample_id, p_brand AS sdk, p_partkey % 2 = 0 AS m, 'f' || (p_partkey % 5) AS file, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE 'id' || p_partkey END AS ident, p_partkey AS pos, p_partkey % 4 AS trust,
  CASE WHEN p_partkey % 5 = 0 THEN 'bad' ELSE '1.' || p_partkey END AS v FROM part)
SELECT sample_id, sdk, bool_or(m) AS in_manifest, bool_or(NOT m) AS in_code, count(DISTINCT file) AS files, arg_min(ident, pos) FILTER (WHERE ident <> '') AS identifier,
  arg_max(v, trust * 1000000000 - pos) FILTER (WHERE v <> 'bad') AS version, CASE WHEN bool_or(m) THEN 'manifest' ELSE 'code' END AS primary FROM f GROUP BY ALL""".replace("AS primary", 'AS "primary"'))
def evidence_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence of a library as one row: distinct files, first identifier, most trusted good version."""
    version = F.when(_k() % 5 == 0, "bad").otherwise(F.concat(F.lit("1."), _k().cast("string")))
    rows = _parts(spark, sf_dir).select(
        F.col("p_size").alias("sample_id"), F.col("p_brand").alias("sdk"), (_k() % 2 == 0).alias("in_manifest"), (_k() % 2 == 1).alias("in_code"), _text("f{f}", f=_k() % 5).alias("file"),
        F.when(_k() % 3 == 0, "").otherwise(_text("id{k}", k=_k())).alias("identifier"), _k().alias("pos"), (_k() % 4).alias("trust"), version.alias("version"),
    )
    return merges.component_evidence(rows, ["sample_id", "sdk"], ["in_manifest", "in_code"], "file", "identifier", "version", strings.plausible_version(F.col("version")), "trust", "pos")


@query("""
SELECT p_brand AS provider, count(DISTINCT 'd_' || (p_size % 4)) AS detectors, count(*) AS patterns, count(*) FILTER (WHERE p_partkey % 2 = 0) AS verified FROM part GROUP BY 1""")
def provider_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pattern rules by provider."""
    rows = _parts(spark, sf_dir).select(F.col("p_brand").alias("provider"), _text("d_{a}_{k}", a=F.col("p_size") % 4, k=_k()).alias("pattern_id"), (_k() % 2 == 0).alias("ok"))
    return merges.provider_stats(rows, "provider", "pattern_id", F.col("ok"))


@query("""
WITH r AS (SELECT p_brand, p_type, p_size, CASE WHEN p_partkey % 9 = 0 THEN '' ELSE p_type END AS t FROM part)
SELECT a.p_brand, a.rows, a.distinct_p_size, a.blank_keys, b.repeated_keys FROM (SELECT p_brand, count(*) AS rows, count(DISTINCT p_size) AS distinct_p_size, count(*) FILTER (WHERE t = '') AS blank_keys FROM r GROUP BY 1) a
JOIN (SELECT p_brand, count(*) FILTER (WHERE n > 1) AS repeated_keys FROM (SELECT p_brand, t, p_size, count(*) AS n FROM r GROUP BY ALL) GROUP BY 1) b USING (p_brand)""")
def import_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was imported, by artifact: rows, distinct values, blank and repeated keys."""
    rows = _parts(spark, sf_dir).select("p_brand", "p_size", F.when(_k() % 9 == 0, "").otherwise(F.col("p_type")).alias("t"))
    return merges.profile(rows, ["p_brand"], ["p_size"], ["t", "p_size"])


@query("""
WITH a AS (SELECT DISTINCT p_size FROM part WHERE lower(['True', 'false', 'TRUE', ''][p_partkey % 4 + 1]) = 'true'), r AS (SELECT * FROM part SEMI JOIN a USING (p_size))
SELECT p_brand AS package_name, count(*) AS rules, 'gms' AS source FROM r WHERE p_partkey % 6 <> 0 GROUP BY ALL""")
def enabled_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules of enabled artifacts with where they come from; those without a whole key are left out."""
    p = _parts(spark, sf_dir)
    on = builds.enabled(p.select("p_size", _pick(["True", "false", "TRUE", ""]).alias("enabled"))).select("p_size").distinct()
    found = p.join(on, "p_size", "left_semi").select(F.col("p_brand").alias("package_name"), F.when(_k() % 6 != 0, _text("C{k}", k=_k())).otherwise("").alias("class_name"), F.lit("m").alias("method_name"), F.lit("p").alias("permission"), F.lit(1).alias("level"))
    merged = builds.privacy_apis([builds.source_rows(found, "android", "gms", "1", "high").drop("confidence")])
    return merged.groupBy("package_name").agg(F.count("*").alias("rules"), F.min(F.get("sources", F.lit(0))).alias("source"))


@query("""
SELECT p_partkey, CASE WHEN p_partkey % 4 IN (0, 1) THEN 'location' WHEN p_partkey % 4 = 2 THEN 'maps' END AS category, p_partkey % 4 = 0 AS known FROM part""")
def geo_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """APIs by the first keyword of their name, excluded ones aside, and the keyword test of texts."""
    name = _pick(["android.location.Manager", "x.GpsLocation", "a.MapView", "location.LocaleHelper"])
    kind = matching.geo_category(name, F.lit("get"), [("location", "location"), ("map", "maps")], ["locale"])
    return _parts(spark, sf_dir).select("p_partkey", kind.alias("category"), matching.contains_keywords(name, ["android.location"]).alias("known"))


@query("""
SELECT CASE WHEN p_partkey % 2 = 0 THEN 'a.C' || p_partkey || '.m' ELSE 'a.C' || p_partkey END AS token, 'cat' AS category, '' AS subcategory FROM part WHERE p_partkey % 3 <> 0""")
def api_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword rules of APIs, those without a category left out."""
    apis = _parts(spark, sf_dir).select(_text("a.C{k}", k=_k()).alias("class_name"), _pick(["m", "<init>"]).alias("method_name"), _pick(["Unknown", "cat", "cat"]).alias("category"), F.lit(None).cast("string").alias("subcategory"))
    return matching.api_tokens(apis)


@query("""
SELECT 's' AS sample_id, 'f' || p_partkey AS path, 'pom' AS source, 0 AS place, '1.' || p_size AS version FROM part WHERE p_partkey % 3 = 0 UNION ALL
SELECT 's', 'f' || p_partkey, 'buildconfig', 1, '2.' || p_size FROM part WHERE p_partkey % 3 = 1 UNION ALL SELECT 's', 'f' || p_partkey, 'metadata', 4, '3.' || p_size FROM part WHERE p_partkey % 3 = 2""")
def version_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of files, by where they stand."""
    text = F.when(_k() % 3 == 0, _text("<version>1.{s}</version>", s="p_size")).when(_k() % 3 == 1, _text('VERSION_NAME:Ljava/lang/String; = "2.{s}"', s="p_size")).otherwise(_text("3.{s}", s="p_size"))
    rows = _parts(spark, sf_dir).select(F.lit("s").alias("sample_id"), _text("f{k}", k=_k()).alias("path"), _pick(["pom", "smali", "metadata"]).alias("kind"), text.alias("text"))
    return matching.version_candidates(rows)


@query("""
SELECT 's' || p_size AS sample_id, 'endpoint' AS kind, 'api.shop.io' AS value, count(*) AS occurrences, count(DISTINCT p_partkey) AS files FROM part GROUP BY ALL UNION ALL
SELECT 's' || p_size, 'pii', 'u' || p_size || '@mail.example.com', count(*), count(DISTINCT p_partkey) FROM part GROUP BY ALL""")
def layered_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of code: endpoints in string constants, personal data in the code as it is."""
    code = _text('invoke u{s}@mail.example.com\nconst-string v0, "see api.shop.io"\n', s="p_size")
    rows = _parts(spark, sf_dir).select(_text("s{s}", s="p_size").alias("sample_id"), _text("smali/{k}.smali", k=_k()).alias("path"), F.lit("smali").alias("kind"), code.alias("text"))
    rules = matching.supported_patterns([("none", "never-there", "HIGH")], spark)
    return plan.findings(plan.layered(rows), rules).select("sample_id", "kind", "value", "occurrences", "files")


@query("SELECT DISTINCT o_custkey AS id FROM orders WHERE o_custkey IN (SELECT user_id FROM events)")
def common_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that two tables share."""
    return joins.common(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id")), table(spark, sf_dir, "events").select(F.col("user_id").alias("id")), ["id"])


_LISTED = [f"android.permission.{x}" for x in DANGEROUS_PERMISSIONS]


@query(f"""
WITH p AS (SELECT p_partkey, ({_LISTED + ["android.permission.NONE", "com.own.X"]})[p_partkey % {len(_LISTED) + 2} + 1] AS name FROM part)
SELECT p_partkey, name, p_partkey % {len(_LISTED) + 2} < {len(_LISTED)} AS dangerous, name LIKE 'android.%' AS android FROM p""")
def permission_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is known of a permission by its name."""
    name = _pick([*_LISTED, "android.permission.NONE", "com.own.X"])
    facts = android.permission_facts(name)
    return _parts(spark, sf_dir).select("p_partkey", name.alias("name"), facts["dangerous"].alias("dangerous"), (facts["namespace"] == "android").alias("android"))


@query("""
SELECT p_partkey, 'com/lib' || (p_partkey % 7) || '/x/A.smali' AS path, CASE WHEN p_partkey % 7 IN (1, 2) THEN 'lib' || (p_partkey % 7) END AS sdk FROM part""")
def path_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose path contains a library's token, by the longest."""
    rules = values(spark, "token string, sdk string, at int", [("com/lib1", "lib1", 1), ("com/lib2", "lib2", 2), ("com/li", None, 3), ("nowhere", "lib9", 4)])
    rows = _parts(spark, sf_dir).select("p_partkey", _text("com/lib{n}/x/A.smali", n=_k() % 7).alias("path"))
    return joins.best_contained(rows, "path", rules.where("sdk is not null"), "token", "at").select("p_partkey", "path", "sdk")


@query("""
SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'Kb ' || (p_partkey % 5) WHEN p_partkey % 5 <> 4 THEN 'Old ' || (p_partkey % 5) END AS vendor, CASE WHEN p_partkey % 5 <> 4 THEN 'IN' END AS country,
  p_partkey % 2 = 0 OR p_partkey % 5 <> 4 AS matched FROM part""")
def tier_country(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tiers of tracker rules, the country always that of the second."""
    first = values(spark, "suffix string, vendor string, country string", [(f"h{n}.new.com", f"Kb {n}", "US") for n in range(5)])
    second = values(spark, "suffix string, vendor string, country string", [(f"h{n}.{x}.com", f"Old {n}", "IN") for n in range(4) for x in ("new", "old")])
    rows = _parts(spark, sf_dir).select("p_partkey", _text("x.h{n}.{t}.com", n=_k() % 5, t=_pick(["new", "old"])).alias("domain"))
    return joins.two_tier(rows, "domain", first, second, "suffix", ["vendor"], ["country"]).select("p_partkey", "vendor", "country", "matched")


@query("SELECT p_partkey, array_to_string(list_sort(list_distinct([p_brand, p_type, p_brand])), '|') AS members FROM part")
def member_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unions of the sets of a key as sorted texts."""
    p = _parts(spark, sf_dir)
    every = p.select("p_partkey", F.col("p_brand").alias("m")).unionByName(p.select("p_partkey", F.col("p_type").alias("m"))).unionByName(p.select("p_partkey", F.col("p_brand").alias("m")))
    return every.groupBy("p_partkey").agg(merges.joined_set("m", "|").alias("members"))


@query("SELECT CASE p_partkey % 3 WHEN 0 THEN 'V31' WHEN 1 THEN 'V30' ELSE 'none' END AS picked, count(*) AS n FROM part GROUP BY 1")
def score_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of several scores of an entry counts."""
    entry = lambda v: F.array(F.struct(F.lit("Primary").alias("type"), F.lit(v).alias("version"), F.lit("5").alias("score"), F.lit("low").alias("severity")))
    none = F.slice(entry("V2"), 1, 0)
    best = feeds.best_score(F.when(_k() % 3 == 0, entry("V31")).otherwise(none), F.when(_k() % 3 == 1, entry("V30")).otherwise(none), none)
    return _parts(spark, sf_dir).groupBy(F.coalesce(best["version"], F.lit("none")).alias("picked")).agg(F.count("*").alias("n"))


@query("SELECT p_partkey, p_name FROM part ORDER BY length(p_name) DESC, p_name, p_partkey LIMIT 20")
def longest_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A top-k report of the longest names, ties in order."""
    return merges.longest(_parts(spark, sf_dir).select("p_partkey", "p_name"), "p_name", ["p_partkey"], 20)
