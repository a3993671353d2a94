"""Ids, names, tri-state facts and feed fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.android import effective_backup, effective_cleartext, effective_export, name_form, permission_facts, qualified_name, scheme_kind
from ..functions.feeds import best_score, product_of
from ..functions.ids import region_of, short_id, uuid5
from ..functions.net import event_type, is_doh, is_private, is_probe, is_quic, is_resolver, is_unusual_port, suffix_parts, url_host
from ..functions.strings import duration, entropy, luhn, plausible_version, search_tokens, vendor_name
from ..functions.values import REGIONS, SECOND_LEVEL_SUFFIXES
from .base import HOST_SQL, PACKETS, packets, query, table


@query("""SELECT o_orderkey, substr(sha256(concat_ws('|', CAST(o_orderkey AS VARCHAR), CAST(o_custkey AS VARCHAR), coalesce(nullif(o_orderstatus, 'P'), 'None'))), 1, 16) AS id FROM orders""")
def det_id_sha16(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", short_id(F.col("o_orderkey"), F.col("o_custkey"), F.nullif(F.col("o_orderstatus"), F.lit("P"))).alias("id"))


@query("""
WITH h AS (SELECT p_partkey, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('privacy-api://' || p_brand || '/' || p_partkey)) AS h FROM part)
SELECT p_partkey, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' ||
       substr('89ab', CAST(('0x' || substr(h, 17, 1)) AS INT) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS id FROM h""")
def uuid5_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", uuid5(F.concat(F.lit("privacy-api://"), "p_brand", F.lit("/"), F.col("p_partkey").cast("string"))).alias("id"))


@query(f"""
SELECT CASE {" ".join(f"WHEN code IN ({', '.join(repr(c) for c in cs)}) THEN '{r}'" for r, cs in REGIONS.items())} ELSE 'other' END AS region, count(*) AS n
FROM (SELECT ['US', 'DE', 'IN', 'CN', 'XX'][n_nationkey % 5 + 1] AS code FROM customer JOIN nation ON c_nationkey = n_nationkey) GROUP BY 1""")
def region_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    code = F.element_at(F.array(*map(F.lit, ["us", "DE", "in", "CN", "XX"])), (F.col("n_nationkey") % 5 + 1).cast("int"))
    return c.groupBy(region_of(code, REGIONS).alias("region")).agg(F.count("*").alias("n"))


@query(f"""
WITH h AS (SELECT page_id, {HOST_SQL} AS host, string_split({HOST_SQL}, '.') AS l FROM pages),
w AS (SELECT *, CASE WHEN array_to_string(l[-2:], '.') IN ({", ".join(map(repr, SECOND_LEVEL_SUFFIXES))}) THEN 2 ELSE 1 END AS w FROM h)
SELECT page_id, host, array_to_string(l[-w:], '.') AS suffix, CASE WHEN len(l) > w THEN array_to_string(l[-(w + 1):], '.') ELSE '' END AS registered_domain,
       CASE WHEN len(l) > w + 1 THEN array_to_string(l[1:len(l) - w - 1], '.') ELSE '' END AS subdomain FROM w""")
def url_host_decompose(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = url_host(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", host.alias("host"), suffix_parts(host).alias("p")).select("page_id", "host", "p.*")


@query("""
WITH x AS (SELECT l_orderkey, l_linenumber, CASE l_linenumber % 3 WHEN 0 THEN NULL WHEN 1 THEN true ELSE false END AS e,
       ['activity', 'service', 'receiver', 'provider'][l_suppkey % 4 + 1] AS kind, CAST(l_quantity AS INT) % 3 AS f, CASE WHEN l_partkey % 40 = 0 THEN NULL ELSE l_partkey % 40 END AS t FROM lineitem)
SELECT l_orderkey, l_linenumber, coalesce(e, true) AS backup, CASE WHEN e IS NULL THEN 'default' ELSE 'explicit' END AS backup_source,
       coalesce(e, CASE WHEN t >= 28 THEN false WHEN t BETWEEN 1 AND 27 THEN true END) AS cleartext,
       coalesce(e, CASE WHEN kind = 'provider' THEN NULL WHEN f = 0 THEN false WHEN t >= 31 THEN NULL ELSE true END) AS exported,
       coalesce(e IS NULL AND kind <> 'provider' AND f > 0 AND t >= 31, false) AS violation FROM x""")
def effective_default_tristate(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber") % 3
    explicit = F.when(n == 1, F.lit(True)).when(n == 2, F.lit(False))
    kind = F.element_at(F.array(*map(F.lit, ["activity", "service", "receiver", "provider"])), (F.col("l_suppkey") % 4 + 1).cast("int"))
    target = F.nullif(F.col("l_partkey") % 40, F.lit(0).cast("long"))
    x = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", explicit.alias("e"), kind.alias("kind"), (F.col("l_quantity").cast("int") % 3).alias("f"), target.alias("t"))
    backup, source = effective_backup(F.col("e"))
    return x.select(
        "l_orderkey", "l_linenumber", backup.alias("backup"), source.alias("backup_source"), effective_cleartext(F.col("e"), F.col("t")).alias("cleartext"),
        effective_export(F.col("e"), F.col("kind"), F.col("f"), F.col("t")).alias("x"),
    ).select("l_orderkey", "l_linenumber", "backup", "backup_source", "cleartext", "x.exported", "x.violation")


@query("""
SELECT p_partkey, CASE WHEN left(n, 1) = '.' THEN 'relative' WHEN n NOT LIKE '%.%' THEN 'simple' ELSE 'fully_qualified' END AS form,
       CASE WHEN left(n, 1) = '.' THEN 'com.app' || n WHEN n NOT LIKE '%.%' THEN 'com.app.' || n ELSE n END AS full_name,
       CASE WHEN s IN ('http', 'https', 'market') THEN s WHEN s IN ('content', 'file', 'android-app') THEN 'known' ELSE 'custom' END AS scheme,
       CASE WHEN p IN ('android.permission.ACCESS_ADSERVICES_TOPICS') THEN 'privacy_sandbox' WHEN p LIKE 'android.permission.%' THEN 'standard' ELSE 'custom' END AS space
FROM (SELECT p_partkey, ['.Main', 'Main', 'com.lib.Main'][p_partkey % 3 + 1] AS n, ['HTTP', 'market', 'content', 'https'][p_partkey % 4 + 1] AS s,
      ['android.permission.CAMERA', 'android.permission.ACCESS_ADSERVICES_TOPICS', 'com.app.MINE'][p_partkey % 3 + 1] AS p FROM part)""")
def component_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda xs: F.element_at(F.array(*map(F.lit, xs)), (F.col("p_partkey") % len(xs) + 1).cast("int"))
    n, p = pick([".Main", "Main", "com.lib.Main"]), pick(["android.permission.CAMERA", "android.permission.ACCESS_ADSERVICES_TOPICS", "com.app.MINE"])
    facts = permission_facts(p)
    return table(spark, sf_dir, "part").select(
        "p_partkey", name_form(n).alias("form"), qualified_name(n, F.lit("com.app")).alias("full_name"), scheme_kind(pick(["HTTP", "market", "content", "https"])).alias("scheme"), F.when(facts["sandbox"], "privacy_sandbox").when(facts["standard"], "standard").otherwise("custom").alias("space")
    )


@query(r"""
WITH c AS (SELECT p_partkey, replace('cpe:2.3:a:' || lower(replace(p_brand, '#', '\:')) || ':' || replace(p_name, ' ', '\-') || ':' || p_size, '\:', chr(1)) AS c FROM part)
SELECT p_partkey, replace(replace(string_split(c, ':')[4], chr(1), ':'), '\', '') AS vendor, replace(replace(string_split(c, ':')[5], chr(1), ':'), '\', '') AS product FROM c""")
def cpe_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    brand = F.lower(F.replace("p_brand", F.lit("#"), F.lit("\\:")))
    name = F.concat(F.lit("cpe:2.3:a:"), brand, F.lit(":"), F.replace("p_name", F.lit(" "), F.lit("\\-")), F.lit(":"), F.col("p_size").cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", product_of(name).alias("x")).select("p_partkey", "x.*")


@query("""
SELECT event_id, CASE WHEN k % 3 = 0 THEN '3.1' WHEN k % 3 = 1 THEN '3.0' ELSE '2.0' END AS version, CAST(CASE WHEN k % 2 = 0 THEN k / 10 ELSE 1.5 END AS DOUBLE) AS score,
       CASE WHEN k % 2 = 0 THEN 'HIGH' ELSE 'LOW' END AS severity FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)""")
def cvss_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))
    entry = lambda kind, score, severity: F.struct(F.lit(kind).alias("type"), F.lit(None).cast("string").alias("version"), score.cast("string").alias("score"), F.lit(severity).alias("severity"))
    both = F.array(entry("Secondary", F.lit(1.5), "low"), entry("Primary", F.col("k") / 10, "high"))
    own = F.when(F.col("k") % 2 == 0, both).otherwise(F.slice(both, 1, 1))
    none = F.slice(both, 1, 0)
    v31, v30 = F.when(F.col("k") % 3 == 0, own).otherwise(none), F.when(F.col("k") % 3 == 1, own).otherwise(none)
    return e.select("event_id", best_score(v31, v30, own).alias("x")).select("event_id", "x.*")


@query(f"""
WITH {PACKETS} SELECT event_id, CASE WHEN dst_port = 53 THEN 'dns' WHEN domain LIKE 'api%' THEN 'tls' WHEN domain LIKE 'cdn%' THEN 'http' ELSE lower(protocol) END AS kind,
  protocol = 'UDP' AND dst_port = 443 AS quic, dst_port NOT IN (53, 80, 443, 8008, 8080, 8443) AS unusual,
  dst_ip IN ('8.8.8.8', '1.1.1.1') AS resolver, domain = 'dns.google' AS doh,
  domain IN ('captive.apple.com', 'ads.track.example.com', 'cdn.example.org') AS probe, user_id % 5 IN (1, 3) OR false AS private FROM packets""")
def dns_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = packets(spark, sf_dir)
    sni, host = F.when(F.startswith("domain", F.lit("api")), F.col("domain")).otherwise(""), F.when(F.startswith("domain", F.lit("cdn")), F.col("domain")).otherwise("")
    port = F.col("dst_port")
    return p.select(
        "event_id", event_type(F.col("protocol"), F.lit(40000), port, sni, host).alias("kind"), is_quic(F.col("protocol"), F.lit(40000), port).alias("quic"), is_unusual_port(port).alias("unusual"),
        is_resolver(F.col("dst_ip")).alias("resolver"), is_doh(F.col("domain")).alias("doh"), is_probe(F.col("domain")).alias("probe"), is_private(F.col("dst_ip")).alias("private"),
    )


@query("""
SELECT s_suppkey, CASE WHEN s % 4 = 0 THEN '' WHEN s % 4 = 1 THEN 'Google' WHEN s % 4 = 2 THEN 'Meta' ELSE 'Acme' END AS vendor,
  CASE WHEN s >= 3600 THEN (s // 3600) || 'h ' || (s // 60 % 60) || 'm ' || (s % 60) || 's' WHEN s >= 60 THEN (s // 60) || 'm ' || (s % 60) || 's' ELSE s || 's' END AS took,
  s % 3 = 0 AS version_ok FROM (SELECT s_suppkey, s_suppkey * 37 AS s FROM supplier)""")
def small_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_suppkey") * 37).alias("s"))
    pick = lambda xs: F.element_at(F.array(*map(F.lit, xs)), (F.col("s") % len(xs) + 1).cast("int"))
    vendor = vendor_name(pick(["Unknown", "google llc", " Facebook Ireland", "Acme Corp"]), [("google", "Google"), ("facebook", "Meta")])
    return s.select("s_suppkey", vendor.alias("vendor"), duration(F.col("s")).alias("took"), plausible_version(pick(["4.12.0", "0.0", "v1.xml"])).alias("version_ok"))


@query(r"""
WITH t AS (SELECT p_partkey, regexp_split_to_array(lower(p_name || '/' || replace(p_type, ' ', '-')), '[:./ ]+') AS a FROM part),
u AS (SELECT p_partkey, unnest(list_concat(a, flatten(list_transform(a, lambda x: regexp_split_to_array(x, '[-_\s]+'))))) AS w FROM t),
r AS (SELECT DISTINCT p_partkey, w FROM u WHERE w <> '' AND w NOT IN ('co','com','edu','gov','io','mil','net','org','squareup','unity3d','ads','android','client','common','core','google','library','mobile','play','sdk')),
v AS (SELECT p_partkey, w FROM r UNION SELECT p_partkey, replace(w, '-', '_') FROM r UNION SELECT p_partkey, replace(w, '_', '-') FROM r)
SELECT p_partkey, array_to_string(list_sort(list(w)), ',') AS tokens FROM v GROUP BY p_partkey""")
def search_token_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = search_tokens(F.col("p_name"), F.translate("p_type", " ", "-"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(tokens, ",").alias("tokens"))


@query(r"""
WITH c AS (SELECT doc_id, unnest(regexp_extract_all(text, '\b\d{13,16}\b')) AS v FROM documents),
d AS (SELECT doc_id, v, list_reverse(list_transform(string_split(v, ''), lambda x: CAST(x AS INT))) AS d FROM c)
SELECT doc_id, v AS value, list_sum(list_transform(range(1, len(d) + 1), lambda i: CASE WHEN i % 2 = 1 THEN d[i] WHEN d[i] > 4 THEN d[i] * 2 - 9 ELSE d[i] * 2 END)) % 10 = 0 AS good FROM d""")
def luhn_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"\b\d{13,16}\b"), F.lit(0))).alias("value"))
    return found.select("doc_id", "value", luhn(F.col("value")).alias("good"))


@query("""
WITH w AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM conversations),
c AS (SELECT conv_id, turn, pos, c, count(*) AS n FROM (SELECT conv_id, turn, pos, unnest(string_split(line, '')) AS c FROM w WHERE line <> '') GROUP BY ALL),
s AS (SELECT *, n / sum(n) OVER (PARTITION BY conv_id, turn, pos) AS p FROM c)
SELECT w.conv_id, w.turn, w.pos - 1 AS pos, round(coalesce(-sum(p * log2(p)), 0), 6) AS bits FROM w LEFT JOIN s USING (conv_id, turn, pos) GROUP BY ALL""")
def entropy_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return lines.select("conv_id", "turn", "pos", F.round(entropy(F.col("line")), 6).alias("bits"))
