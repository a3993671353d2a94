"""Queries with hot keys, large rule tables and IPv6 addresses, each derived from the shared tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import sinks
from ..functions.net import url_host
from ..functions.versions import sort_key
from ..operators import cache, joins, matching, merges, names, ranks
from ..plans import traffic
from ..tables import dealt
from .base import HOST_SQL, PACKETS, packets, query, scratch, sql_values, table, values

# --- addresses ---


def _addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An address for each event: IPv4, or IPv6 in one of several spellings."""
    i, u = F.col("event_id"), F.col("user_id")
    low = F.lower(F.hex(i % 4096))
    six = F.concat(F.lit("2600:"), F.lower(F.hex(u % 8)), F.lit("::"), low)
    whole = F.concat(F.lit("2600:0"), F.upper(F.hex(u % 8)), F.lit(":0:0:0000:0:0:"), F.upper(F.lpad(low, 4, "0")))
    mapped = F.concat(F.lit("::ffff:23.5."), u % 4, F.lit("."), i % 256)
    four = F.concat(F.lit("23.5."), u % 4, F.lit("."), i % 256)
    ip = F.when(i % 5 == 0, six).when(i % 5 == 1, whole).when(i % 5 == 2, mapped).when(i % 5 == 3, four).otherwise(F.concat(F.lit("fe80::"), low))
    return table(spark, sf_dir, "events").select("event_id", "user_id", ip.alias("ip"))


_ADDRESS_SQL = """e AS (SELECT event_id, event_id % 5 AS kind, user_id % 8 AS a, event_id % 4096 AS b, user_id % 4 AS c, event_id % 256 AS d FROM events)"""

SIX_BLOCKS = [("2600:3::/32", "Net3", 5), ("2600:3::/120", "Part3", 4), ("2600:3::7", "Host", 9), ("2600::/29", "All", 1), ("23.5.1.0/24", "Four", 3), ("23.5.1.128/25", "Half", 2), ("::ffff:23.5.1.7", "HostFour", 8)]


@query(f"""
WITH {_ADDRESS_SQL},
m AS (
  SELECT event_id, CASE WHEN kind < 2 AND a = 3 AND b = 7 THEN 'Host' WHEN kind < 2 THEN 'All'
                        WHEN kind < 4 AND c = 1 AND d = 7 THEN 'HostFour' WHEN kind < 4 AND c = 1 AND d >= 128 THEN 'Half' WHEN kind < 4 AND c = 1 THEN 'Four' END AS owner FROM e),
r(block, owner, pos) AS ({sql_values(SIX_BLOCKS)})
SELECT event_id, r.owner, block FROM m LEFT JOIN r ON r.owner = m.owner""")
def ipv6_block_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of both versions, however they are written, in the first block by position that holds them."""
    rules = values(spark, "block string, owner string, pos int", SIX_BLOCKS)
    return joins.cidr_lookup(_addresses(spark, sf_dir), "ip", rules, "block", "pos").select("event_id", "owner", "block")


SIX_RANGES = [("2600:2::", "2600:4:ffff:ffff:ffff:ffff:ffff:ffff", "Wide"), ("2600:3::10", "2600:3::7ff", "Narrow"), ("2600:3::20", "2600:3::20", "One"), ("23.5.0.0", "23.5.1.127", "Low"), ("23.5.1.0", "23.5.1.9", "Few"), ("fe80::", "fe80::ffff", "Local")]


@query(f"""
WITH {_ADDRESS_SQL}
SELECT event_id, CASE WHEN kind < 2 AND a = 3 AND b = 32 THEN 'One' WHEN kind < 2 AND a = 3 AND b BETWEEN 16 AND 2047 THEN 'Narrow' WHEN kind < 2 AND a BETWEEN 2 AND 4 THEN 'Wide'
  WHEN kind IN (2, 3) AND c = 1 AND d <= 9 THEN 'Few' WHEN kind IN (2, 3) AND (c = 0 OR (c = 1 AND d <= 127)) THEN 'Low' END AS place FROM e""")
def ipv6_range_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The narrowest range of a public address of either version; local ones have none."""
    ranges = values(spark, "low string, high string, place string", SIX_RANGES)
    return joins.range_lookup(_addresses(spark, sf_dir), "ip", ranges, "low", "high").select("event_id", "place")


def _dotted(n):  # noqa: ANN001, ANN202
    part = lambda k: F.floor(n / 256**k) % 256
    return F.concat_ws(".", 23 + F.floor(n / 256**3), part(2), part(1), part(0))


@query("""
WITH r AS (SELECT o_orderkey AS id, o_orderkey * 40 + o_custkey % 40 AS low, o_orderkey * 40 + o_custkey % 40 + CASE o_orderkey % 7 WHEN 0 THEN 4000 WHEN 1 THEN 0 ELSE o_custkey % 60 END AS high FROM orders),
p AS (SELECT DISTINCT l_orderkey * 40 + l_partkey % 50 AS n FROM lineitem),
m AS (SELECT n, arg_min(id, {'w': high - low, 'l': low, 'i': id}) AS id FROM p JOIN r ON n BETWEEN low AND high GROUP BY n)
SELECT l_orderkey, l_linenumber, l_partkey, id FROM lineitem LEFT JOIN m ON m.n = l_orderkey * 40 + l_partkey % 50""")
def range_table_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of line items in ranges of orders, some within others: the narrowest of each (J8 with a rule table that grows)."""
    low = F.col("o_orderkey") * 40 + F.col("o_custkey") % 40
    size = F.when(F.col("o_orderkey") % 7 == 0, 4000).when(F.col("o_orderkey") % 7 == 1, 0).otherwise(F.col("o_custkey") % 60)
    ranges = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), _dotted(low).alias("low"), _dotted(low + size).alias("high"))
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", _dotted(F.col("l_orderkey") * 40 + F.col("l_partkey") % 50).alias("ip"))
    return joins.range_lookup(items, "ip", ranges, "low", "high").select("l_orderkey", "l_linenumber", "l_partkey", "id")


SUFFIX_RULES = [("com",), ("org",), ("net",), ("example.com",), ("*.example.org",), ("!city.example.org",), ("*.net",), ("// a comment",)]


@query(f"""
WITH h AS (SELECT DISTINCT host, string_split(host, '.') AS l FROM (SELECT {HOST_SQL} AS host FROM pages) WHERE host IS NOT NULL),
d AS (SELECT host, l, CASE WHEN host = 'city.example.org' OR ends_with(host, '.city.example.org') THEN 2
  WHEN ends_with(host, '.example.org') THEN 3 WHEN host = 'example.com' OR ends_with(host, '.example.com') THEN 2 WHEN ends_with(host, '.net') THEN 2 ELSE 1 END AS d FROM h)
SELECT page_id, p.host, coalesce(CASE WHEN len(l) > d + 1 THEN array_to_string(l[1:len(l) - d - 1], '.') ELSE '' END, '') AS subdomain, coalesce(CASE WHEN len(l) > d THEN array_to_string(l[len(l) - d:], '.') ELSE '' END, '') AS registered_domain,
       coalesce(array_to_string(l[greatest(len(l) - d + 1, 1):], '.'), '') AS suffix
FROM (SELECT page_id, {HOST_SQL} AS host FROM pages) p LEFT JOIN d ON d.host = p.host""")
def public_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts under plain, wildcard and exception rules of public suffixes."""
    hosts = table(spark, sf_dir, "pages").select("page_id", url_host(F.col("url")).alias("host"))
    return names.registered_domains(hosts, "host", values(spark, "rule string", SUFFIX_RULES), "rule")


# --- versions ---


@query("""
WITH v AS (SELECT p_partkey, p_size AS a, p_partkey % 12 AS b, p_partkey % 5 AS s,
  CASE p_partkey % 5 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 3 ELSE 3 END AS stage, CASE WHEN p_partkey % 5 = 4 THEN p_partkey % 11 ELSE -1 END AS post,
  CASE WHEN p_partkey % 5 < 3 THEN p_partkey % 13 ELSE 0 END AS pre FROM part)
SELECT p_partkey, rank() OVER (ORDER BY a, b, stage, pre, post) AS place FROM v""")
def version_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of versions by their keys' bytes, which order as the versions do (M6)."""
    k = F.col("p_partkey")
    plain = F.concat_ws(".", F.col("p_size").cast("string"), (k % 12).cast("string"))
    tail = F.when(k % 5 == 0, F.concat(F.lit("a"), k % 13)).when(k % 5 == 1, F.concat(F.lit("-beta."), k % 13)).when(k % 5 == 2, F.concat(F.lit(".RC"), k % 13)).when(k % 5 == 3, ".0").otherwise(F.concat(F.lit(".post"), k % 11))
    keyed = table(spark, sf_dir, "part").select("p_partkey", sort_key(F.concat(plain, tail)).alias("key"))
    own = ranks.ranked(keyed.withColumn("all", F.lit(0)), ["all"], ["key"], "nth")
    first = own.groupBy("key").agg(F.min("nth").alias("place"))  # equal versions share a place
    return merges.joined_by(own, first, ["key"]).select("p_partkey", "place")


# --- hot keys ---


@query("""
WITH g AS (SELECT ts, CASE WHEN epoch(ts) - lag(epoch(ts)) OVER (ORDER BY ts) <= 20 THEN 0 ELSE 1 END AS s FROM events),
r AS (SELECT ts, sum(s) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING) AS burst FROM g)
SELECT 'all' AS network, burst, count(*) AS events, min(ts) AS first_seen, max(ts) AS last_seen FROM r GROUP BY burst""")
def hot_key_bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bursts of one key that has all events, cut in slices of an hour and stitched."""
    return merges.bursts(table(spark, sf_dir, "events").select(F.lit("all").alias("network"), "ts"), ["network"], "ts", 20, 3600)


@query("SELECT l_orderkey, l_linenumber, l_partkey, 'all_' || row_number() OVER (ORDER BY l_partkey, l_orderkey, l_linenumber, l_suppkey) AS rule_id FROM lineitem")
def one_category_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of all line items in one category."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.lit("all").alias("category"))
    out = ranks.numbered(items, "category", ["l_partkey", "l_orderkey", "l_linenumber", "l_suppkey"])
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "rule_id")


@query("""
WITH i AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_partkey % 3 = 0 THEN 'the' ELSE 'part' || l_partkey END AS token, l_suppkey FROM lineitem),
p AS (SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN 'the' ELSE 'part' || (s_suppkey * 7) END AS product FROM supplier)
SELECT l_orderkey, l_linenumber, l_partkey, s_suppkey FROM i JOIN p ON token = product AND (l_suppkey + s_suppkey) % 10 = 0 GROUP BY ALL""")
def hot_token_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates where a third of the items and a quarter of the products share one token, which is dealt to several tasks."""
    token = F.when(F.col("l_partkey") % 3 == 0, "the").otherwise(F.concat(F.lit("part"), "l_partkey"))
    items = table(spark, sf_dir, "lineitem").select(F.struct("l_orderkey", "l_linenumber", "l_partkey").alias("item"), "l_suppkey", F.array(token).alias("tokens"))
    product = F.when(F.col("s_suppkey") % 4 == 0, "the").otherwise(F.concat(F.lit("part"), F.col("s_suppkey") * 7))
    products = table(spark, sf_dir, "supplier").select("s_suppkey", product.alias("product"))
    whole = F.pmod(-F.col("l_suppkey"), F.lit(10)), F.pmod("s_suppkey", F.lit(10))  # equal where the sum of the two is divisible
    found = joins.token_candidates(items, "item", "tokens", products, "product", ["s_suppkey"], equal=[whole])
    return found.select("item.*", "s_suppkey")


# --- texts ---


@query("""
WITH w AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[A-Za-z]{6,}'))) AS token FROM benchmark),
t AS (SELECT conv_id, turn, lower(text) AS text FROM conversations)
SELECT conv_id, turn, token, CAST(strpos(text, token) - 1 AS BIGINT) AS first_at FROM t JOIN w ON contains(text, token)""")
def keywords_of_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every longer word of the benchmark, as a keyword within the words of conversations."""
    words = F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{6,}"), F.lit(0)))
    rules = table(spark, sf_dir, "benchmark").select(words.alias("token"), F.lit("benchmark").alias("category"), F.lit("").alias("subcategory"))
    turns = table(spark, sf_dir, "conversations").select(F.struct("conv_id", "turn").alias("at"), "text")
    return matching.keyword_search(turns, "at", "text", rules).select("at.*", "token", "first_at")


@query("""
WITH t AS (SELECT p_partkey, translate(substr(md5('m' || p_partkey), 1, 12), '0123456789', 'abcdefabcd') AS h, translate(substr(md5('a' || p_partkey), 1, 16), '0123456789', 'abcdefabcd') AS a,
                  translate(md5('u' || p_partkey), '0123456789', 'abcdefabcd') AS u FROM part)
SELECT p_partkey, 'MAC Address' AS pattern_name, concat_ws(':', h[1:2], h[3:4], h[5:6], h[7:8], h[9:10], h[11:12]) AS value FROM t UNION ALL
SELECT p_partkey, 'Android ID', a FROM t UNION ALL
SELECT p_partkey, 'UUID', concat_ws('-', u[1:8], u[9:12], u[13:16], u[17:20], u[21:32]) FROM t""")
def personal_data_in_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hardware addresses and identifiers that hold no digit, each in a text of its own."""
    hex_ = lambda mark: F.translate(F.md5(F.concat(F.lit(mark), "p_partkey").cast("binary")), "0123456789", "abcdefabcd")
    cut = lambda h, by, *sizes: F.concat_ws(by, *(F.substring(h, 1 + sum(sizes[:i]), n) for i, n in enumerate(sizes)))
    texts = F.array(*(F.concat(F.lit("seen "), c, F.lit(" there")) for c in (cut(hex_("m"), ":", *[2] * 6), F.substring(hex_("a"), 1, 16), cut(hex_("u"), "-", 8, 4, 4, 4, 12))))
    rows = dealt(table(spark, sf_dir, "part").select("p_partkey")).select("p_partkey", F.explode(texts).alias("text"))
    return rows.select("p_partkey", F.explode(matching.personal_data(F.col("text"))).alias("m")).select("p_partkey", "m.pattern_name", "m.value")


# --- kept and published results ---


@query("""
SELECT 'first' AS run, count(*) AS asked, count(DISTINCT p_name) FILTER (WHERE p_partkey % 2 = 0) AS computed, sum(length(p_name)) FILTER (WHERE p_partkey % 2 = 0) AS total FROM part WHERE p_partkey % 2 = 0
UNION ALL SELECT 'second', count(*), (SELECT count(*) FROM (SELECT p_name FROM part EXCEPT SELECT p_name FROM part WHERE p_partkey % 2 = 0)), sum(length(p_name)) FROM part""")
def kept_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs over names, of which the second computes only what the first has not kept."""
    path = scratch(spark, "kept")
    asked: list[int] = []

    def work(new: DataFrame) -> DataFrame:
        asked.append(new.count())
        return new.select("input_hash", F.length("p_name").cast("long").alias("size"))

    out = None
    for run, rows in (("first", table(spark, sf_dir, "part").where("p_partkey % 2 = 0")), ("second", table(spark, sf_dir, "part"))):
        done = cache.with_results(rows.select("p_partkey", "p_name"), ["p_name"], work, "size bigint", path, "v1")
        one = done.agg(F.lit(run).alias("run"), F.count("*").alias("asked"), F.lit(asked[-1]).cast("long").alias("computed"), F.sum("size").alias("total"))
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT 'orders' AS name, count(*) AS rows FROM orders UNION ALL SELECT 'customer', count(*) FROM customer")
def published_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables that are published together; a second version fails its check, and readers keep the first (K2)."""
    root = scratch(spark, "published")
    frames = {n: table(spark, sf_dir, n) for n in ("orders", "customer")}
    orphans = {"parents": lambda f: f["orders"].join(f["customer"], F.col("o_custkey") == F.col("c_custkey"), "left_anti")}
    sinks.tables(frames, root, orphans)
    try:
        sinks.tables(frames | {"customer": frames["customer"].where("c_custkey % 2 = 0")}, root, orphans)
    except ValueError:
        pass  # the version before stays
    there = [sinks.current(spark, root, n).agg(F.lit(n).alias("name"), F.count("*").alias("rows")) for n in frames]
    return there[0].unionByName(there[1])


# --- traffic ---

VENDORS = [("track.example.com", "Track", "Advertising"), ("example.org", "Org", "Analytics")]
RESOLVER_ROWS = [("8.8.8.8", "Google"), ("1.1.1.0/24", "Cloudflare")]
NETWORKS = [("8.8.8.0", "8.8.8.255", "US", "NA", "15169", "Google LLC"), ("1.0.0.0", "1.255.255.255", "AU", "OC", "13335", "Cloudflare"), ("23.5.113.0", "23.5.113.99", "JP", "AS", "64500", "Test Net")]

_TRAFFIC = f"""{PACKETS},
e AS (SELECT *, dst_port = 53 AS dns, dst_port = 443 AND protocol = 'TCP' AS tls, dst_port IN (80, 8080) AND domain <> '' AS http, protocol = 'UDP' AND dst_port = 443 AS quic FROM packets),
f AS (SELECT sample_id, session_id, domain, dst_ip, dst_port, protocol, count(*) AS n, sum(size) AS bytes, min(epoch(ts)) AS t0, max(epoch(ts)) AS t1, bool_or(tls) AS tls, bool_or(http AND NOT dns AND NOT tls) AS http, bool_or(quic) AS quic,
      domain = 'track.example.com' OR ends_with(domain, '.track.example.com') OR domain = 'example.org' OR ends_with(domain, '.example.org') AS tracker,
      CASE WHEN starts_with(dst_ip, '8.8.8.') THEN 'US' WHEN starts_with(dst_ip, '1.') THEN 'AU' WHEN starts_with(dst_ip, '23.5.113.') AND CAST(string_split(dst_ip, '.')[4] AS INT) <= 99 THEN 'JP' END AS country
      FROM e GROUP BY ALL),
a AS (SELECT sample_id, session_id, count(*) AS connections, sum(n) AS packets, sum(bytes) AS bytes, round(max(t1) - min(t0), 3) AS duration, coalesce(sum(n) FILTER (tracker), 0) AS tracker_packets, coalesce(sum(n) FILTER (quic), 0) AS quic_packets,
      coalesce(sum(n) FILTER (http AND NOT quic), 0) AS cleartext_packets, count(DISTINCT domain) FILTER (domain <> '') AS domains, count(DISTINCT domain) FILTER (domain <> '' AND tracker) AS tracker_domains, count(DISTINCT domain) FILTER (domain <> '' AND tls) AS tls_domains,
      count(DISTINCT domain) FILTER (domain <> '' AND country = 'US') AS us_domains, count(DISTINCT country) FILTER (domain <> '') AS countries FROM f GROUP BY ALL),
d AS (SELECT sample_id, session_id, count(*) AS dns_packets FROM e WHERE dns GROUP BY ALL)"""


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as decoded packets: the table that traffic plans take."""
    p = packets(spark, sf_dir)
    port, named = F.col("dst_port"), F.col("domain") != ""
    kind = F.when(port == 53, "dns").when((port == 443) & (F.col("protocol") == "TCP"), "tls").when(port.isin(80, 8080) & named, "http").otherwise(F.lower("protocol"))
    answers = F.slice(F.array(F.lit("8.8.8.8"), F.lit("2600::1")), F.lit(1), (F.col("event_id") % 3).cast("int"))
    return p.select(
        "sample_id", "session_id", F.col("ts").cast("timestamp").cast("double").alias("time"), kind.alias("event_type"), "domain", F.lit("10.0.0.2").alias("src_ip"), "dst_ip", "dst_port", "protocol", F.col("size").alias("payload_size"),
        F.when(port == 53, F.col("domain")).otherwise("").alias("dns_query"), F.when(port == 53, answers).otherwise(F.slice(answers, 1, 0)).alias("dns_answers"), ((F.col("protocol") == "UDP") & (port == 443)).alias("is_quic"),
    )


def _summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = traffic.Rules(
        values(spark, "domain_suffix string, canonical_vendor string, category string", VENDORS),
        values(spark, "ip_address string, canonical_provider string", RESOLVER_ROWS),
        values(spark, "ip_from string, ip_to string, country_code string, continent string, asn string, organization string", NETWORKS),
    )
    events = _events(spark, sf_dir)
    return traffic.app_summary(traffic.connections(events, rules), traffic.dns_records(events, rules))


@query(f"""
WITH {_TRAFFIC}
SELECT a.*, coalesce(dns_packets, 0) AS dns_packets FROM a LEFT JOIN d ON d.sample_id = a.sample_id AND d.session_id = a.session_id""")
def traffic_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From packets to connections, places, resolvers and one row for each app session."""
    s = _summary(spark, sf_dir)
    return s.select(
        "sample_id", "session_id", "connections", "packets", "bytes", F.round("duration", 3).alias("duration"), "tracker_packets", "quic_packets", "cleartext_packets", "domains", "tracker_domains", "tls_domains",
        F.coalesce(F.get(F.map_values(F.map_filter("countries", lambda k, _: k == "US")), F.lit(0)), F.lit(0)).alias("us_domains"), F.coalesce(F.size(F.map_keys("countries")), F.lit(0)).cast("long").alias("countries"),
        F.coalesce("dns_packets", F.lit(0)).alias("dns_packets"),
    )
