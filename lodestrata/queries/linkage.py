"""Lookup joins: suffixes, prefixes, containment, addresses, tokens, dimensions and cascades."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.net import url_host
from ..operators import joins
from ..plans.cross import universal
from .base import HOST_SQL, PACKETS, packets, query, sql_values, table, values

TRACKERS = [("example.com", "Example Ads", "Advertising"), ("therti.example.org", "Therti", "Analytics"), ("m.example.com", "", "Crash"), ("example.org", "Example Org", "Social"), ("spam-farm.example.org", "Spam Farm", "Advertising")]
LEGACY = [("example.net", "Old Net", "Profiling"), ("m.ththth.example.net", "Old M", "Crash"), ("example.com", "Old Example", "Location")]


def _hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", url_host(F.col("url")).alias("host"))


_SUFFIX = "(h.host = {t}.suffix OR ends_with(h.host, '.' || {t}.suffix))"


@query(f"""
WITH h AS (SELECT page_id, {HOST_SQL} AS host FROM pages), r(suffix, vendor, category) AS ({sql_values(TRACKERS)}),
m AS (SELECT page_id, suffix, vendor, category, row_number() OVER (PARTITION BY page_id ORDER BY length(suffix) DESC) AS n FROM h JOIN r ON {_SUFFIX.format(t='r')})
SELECT h.page_id, host, suffix, vendor, category FROM h LEFT JOIN m ON m.page_id = h.page_id AND n = 1""")
def tracker_longest_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = values(spark, "suffix string, vendor string, category string", TRACKERS)
    return joins.longest_suffix(_hosts(spark, sf_dir), "host", rules, "suffix")


@query(f"""
WITH h AS (SELECT page_id, {HOST_SQL} AS host FROM pages), r(suffix, vendor, category) AS ({sql_values(TRACKERS)}), o(suffix, vendor, category) AS ({sql_values(LEGACY)}),
a AS (SELECT page_id, r.*, row_number() OVER (PARTITION BY page_id ORDER BY length(suffix) DESC) AS n FROM h JOIN r ON {_SUFFIX.format(t='r')}),
b AS (SELECT page_id, o.*, row_number() OVER (PARTITION BY page_id ORDER BY length(suffix) DESC) AS n FROM h JOIN o ON {_SUFFIX.format(t='o')})
SELECT h.page_id, host, a.suffix IS NOT NULL OR b.suffix IS NOT NULL AS matched, coalesce(nullif(a.vendor, ''), b.vendor) AS vendor, coalesce(nullif(a.category, ''), b.category) AS category
FROM h LEFT JOIN a ON a.page_id = h.page_id AND a.n = 1 LEFT JOIN b ON b.page_id = h.page_id AND b.n = 1""")
def tracker_two_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = "suffix string, vendor string, category string"
    return joins.two_tier(_hosts(spark, sf_dir), "host", values(spark, kind, TRACKERS), values(spark, kind, LEGACY), "suffix", ["vendor", "category"])


@query(f"""
WITH h AS (SELECT page_id, {HOST_SQL} AS host FROM pages), d AS (SELECT DISTINCT host FROM h), r(suffix, vendor, category) AS ({sql_values(TRACKERS)})
SELECT count(*) AS domains, count(*) FILTER (EXISTS (SELECT 1 FROM r WHERE d.host = r.suffix OR ends_with(d.host, '.' || r.suffix))) AS matched,
       count(*) FILTER (NOT EXISTS (SELECT 1 FROM r WHERE d.host = r.suffix OR ends_with(d.host, '.' || r.suffix))) AS unmatched FROM d""")
def batch_domain_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct names only, with the numbers of those that match and do not."""
    rules = values(spark, "suffix string, vendor string, category string", TRACKERS)
    found = joins.longest_suffix(_hosts(spark, sf_dir).select("host").distinct(), "host", rules, "suffix")
    return found.agg(F.count("*").alias("domains"), F.count("suffix").alias("matched"), F.count_if(F.col("suffix").isNull()).alias("unmatched"))


PREFIXES = [("Brand#1", "first"), ("Brand#13", "thirteenth"), ("brand#2", "second"), ("Brand#25", "last")]


@query(f"""
WITH r(prefix, label) AS ({sql_values(PREFIXES)}),
m AS (SELECT p_partkey, prefix, label, row_number() OVER (PARTITION BY p_partkey ORDER BY length(prefix) DESC, prefix) AS n FROM part JOIN r ON starts_with(lower(p_brand), lower(prefix)))
SELECT p.p_partkey, p_brand, prefix, label FROM part p LEFT JOIN m ON m.p_partkey = p.p_partkey AND n = 1""")
def longest_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.longest_prefix(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), "p_brand", values(spark, "prefix string, label string", PREFIXES), "prefix")


NAMES = [("Supplier#1", "com.supplier.one", 1), ("Supplier Two", "com.supplier.two", 2), ("Sub", "com.supplier.one.sub", 3)]
ALIASES = [("s-three", "Supplier Two", 1), ("s-three", "Supplier#1", 2), ("com.alias", "Sub", 3)]
_PROBE = "['Supplier#1', 's-three', 'com.supplier.one/x', 'com.supplier.onex', 'com.supplier.one.sub.y', 'com.alias'][s_suppkey % 6 + 1]"


@query(f"""
WITH s AS (SELECT s_suppkey, {_PROBE} AS v FROM supplier), n(name, prefix, pos) AS ({sql_values(NAMES)}), a(alias, name, pos) AS ({sql_values(ALIASES)}),
o AS (SELECT alias, arg_min(name, pos) AS name FROM a GROUP BY alias),
p AS (SELECT s_suppkey, name, row_number() OVER (PARTITION BY s_suppkey ORDER BY length(prefix) DESC, prefix) AS k FROM s JOIN n ON v = prefix OR starts_with(v, prefix || '.') OR starts_with(v, prefix || '/'))
SELECT s.s_suppkey, v, coalesce(n.name, o.name, p.name, v) AS resolved FROM s LEFT JOIN n ON n.name = v LEFT JOIN o ON o.alias = v LEFT JOIN p ON p.s_suppkey = s.s_suppkey AND k = 1""")
def canonical_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    probes = ["Supplier#1", "s-three", "com.supplier.one/x", "com.supplier.onex", "com.supplier.one.sub.y", "com.alias"]
    v = F.element_at(F.array(*map(F.lit, probes)), (F.col("s_suppkey") % 6 + 1).cast("int"))
    s = table(spark, sf_dir, "supplier").select("s_suppkey", v.alias("v"))
    return joins.resolve_name(s, "v", values(spark, "name string, prefix string, pos int", NAMES), values(spark, "alias string, name string, pos int", ALIASES))


CONTAINED = [("steel", 1), ("small", 2), ("promo", 3), ("tin", 4), ("plated tin", 5), ("brass", 6)]


@query(f"""
WITH r(pattern, pos) AS ({sql_values(CONTAINED)}),
m AS (SELECT p_partkey, pattern, pos, row_number() OVER (PARTITION BY p_partkey ORDER BY length(pattern) DESC, pos) AS n FROM part JOIN r ON contains(lower(p_type), pattern))
SELECT p.p_partkey, p_type, pattern, pos FROM part p LEFT JOIN m ON m.p_partkey = p.p_partkey AND n = 1""")
def contains_best_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.best_contained(table(spark, sf_dir, "part").select("p_partkey", "p_type"), "p_type", values(spark, "pattern string, pos int", CONTAINED), "pattern", "pos")


BLOCKS = [("23.5.113.0/24", "Net", 1), ("23.5.113.7", "Host", 2), ("23.5.113.0/28", "Part", 3), ("8.8.8.8", "Google", 4), ("192.168.0.0/16", "Home", 5)]
_IP = "list_reduce(list_transform(string_split({}, '.'), lambda x: CAST(x AS BIGINT)), lambda a, x: a * 256 + x)"


@query(f"""
WITH {PACKETS}, r(block, owner, pos) AS ({sql_values(BLOCKS)}),
b AS (SELECT block, owner, pos, CASE WHEN block LIKE '%/%' THEN CAST(string_split(block, '/')[2] AS INT) ELSE 32 END AS bits, {_IP.format("string_split(block, '/')[1]")} AS low FROM r),
d AS (SELECT dst_ip, {_IP.format("dst_ip")} AS n FROM (SELECT DISTINCT dst_ip FROM packets)),
m AS (SELECT dst_ip, block, owner, pos, row_number() OVER (PARTITION BY dst_ip ORDER BY bits < 32, pos) AS k FROM d JOIN b ON n BETWEEN low AND low + (1 << (32 - bits)) - 1)
SELECT event_id, p.dst_ip, block, owner, pos FROM packets p LEFT JOIN m ON m.dst_ip = p.dst_ip AND m.k = 1""")
def cidr_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.cidr_lookup(packets(spark, sf_dir).select("event_id", "dst_ip"), "dst_ip", values(spark, "block string, owner string, pos int", BLOCKS), "block", "pos")


PLACES = [("8.8.8.0", "8.8.8.255", "US", "15169"), ("1.0.0.0", "1.255.255.255", "AU", "13335"), ("1.1.1.0", "1.1.1.127", "XX", "13335"), ("23.5.113.0", "23.5.113.99", "JP", "64500"), ("10.0.0.0", "10.255.255.255", "ZZ", "0")]


@query(f"""
WITH {PACKETS}, r(ip_from, ip_to, country, asn) AS ({sql_values(PLACES)}),
d AS (SELECT dst_ip, {_IP.format("dst_ip")} AS n FROM (SELECT DISTINCT dst_ip FROM packets) WHERE dst_ip NOT LIKE '10.%' AND dst_ip NOT LIKE '192.168.%'),
m AS (SELECT dst_ip, r.*, row_number() OVER (PARTITION BY dst_ip ORDER BY {_IP.format("ip_to")} - {_IP.format("ip_from")}) AS k FROM d JOIN r ON n BETWEEN {_IP.format("ip_from")} AND {_IP.format("ip_to")})
SELECT event_id, p.dst_ip, ip_from, ip_to, country, asn FROM packets p LEFT JOIN m ON m.dst_ip = p.dst_ip AND m.k = 1""")
def ip_range_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranges = values(spark, "ip_from string, ip_to string, country string, asn string", PLACES)
    return joins.range_lookup(packets(spark, sf_dir).select("event_id", "dst_ip"), "dst_ip", ranges, "ip_from", "ip_to")


STARTS = [("standard", ["std", "usual"]), ("promo brushed", ["sale"]), ("promo", ["offer", "sale"])]


@query("""
WITH r(starts, also) AS (VALUES ('standard', ['std', 'usual']), ('promo brushed', ['sale']), ('promo', ['offer', 'sale'])),
t AS (SELECT p_partkey, lower(p_type) AS v FROM part),
w AS (SELECT p_partkey, unnest(string_split(v, ' ')) AS w FROM t UNION SELECT p_partkey, unnest(also) FROM t JOIN r ON starts_with(v, starts))
SELECT p_partkey, v, array_to_string(list_sort(list(w)), ',') AS tokens FROM w JOIN t USING (p_partkey) GROUP BY ALL""")
def alias_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.lower("p_type")
    t = table(spark, sf_dir, "part").select("p_partkey", v.alias("v"), F.array_distinct(F.split(v, " ")).alias("tokens"))
    out = joins.expanded_aliases(t, "v", "tokens", values(spark, "starts string, also array<string>", STARTS))
    return out.select("p_partkey", "v", F.array_join("tokens", ",").alias("tokens"))


@query("""
WITH t AS (SELECT DISTINCT p_partkey, unnest(string_split(lower(p_name), ' ')) AS w FROM part), n AS (SELECT n_nationkey, lower(string_split(t.p_name, ' ')[1]) AS product FROM nation JOIN part t ON t.p_partkey = n_nationkey + 1)
SELECT DISTINCT p_partkey, n_nationkey, product FROM t JOIN n ON w = product""")
def token_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    items = part.select("p_partkey", F.split(F.lower("p_name"), " ").alias("tokens"))
    first = part.select(F.col("p_partkey").alias("pk"), F.split(F.lower("p_name"), " ")[0].alias("product"))
    products = table(spark, sf_dir, "nation").join(first, F.col("pk") == F.col("n_nationkey") + 1).select("n_nationkey", "product")
    return joins.token_candidates(items, "p_partkey", "tokens", products, "product", ["n_nationkey"]).select("p_partkey", "n_nationkey", "product")


@query("""
SELECT c_custkey, coalesce(CASE WHEN n_nationkey % 7 = 0 THEN NULL ELSE r_name END, 'Unknown') AS area FROM customer
LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""")
def taxonomy_two_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = table(spark, sf_dir, "nation").where("n_nationkey % 7 <> 0").select(F.col("n_nationkey").alias("key"), F.col("n_regionkey").alias("value"))
    second = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("value"))
    return joins.two_hops(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), "c_nationkey", first, second, "area").drop("c_nationkey")


@query("""
SELECT c_custkey AS sample_id, coalesce(n_name, 'nowhere') AS place, orders, events FROM customer LEFT JOIN nation ON n_nationkey + 5 = c_nationkey
JOIN (SELECT o_custkey, count(*) AS orders FROM orders GROUP BY 1) ON o_custkey = c_custkey JOIN (SELECT user_id, count(*) AS events FROM events GROUP BY 1) ON user_id = c_custkey""")
def universal_key_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("sample_id"), "c_nationkey")
    n = table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 5).alias("n_nationkey"), F.col("n_name").alias("place"))
    apps = joins.dimension(c, "c_nationkey", n, "n_nationkey", {"place": "nowhere"}).drop("c_nationkey")
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("sample_id")).agg(F.count("*").alias("orders"))
    e = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("sample_id")).agg(F.count("*").alias("events"))
    return universal(apps, o, e)


@query("""
SELECT l_orderkey, l_linenumber FROM (SELECT l_orderkey + CASE WHEN l_partkey % 50 = 0 THEN 1000000000 ELSE 0 END AS l_orderkey, l_linenumber FROM lineitem)
WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)""")
def fk_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.checks import missing_parents

    parents = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"))
    moved = F.col("l_orderkey") + F.when(F.col("l_partkey") % 50 == 0, 1_000_000_000).otherwise(0)
    return missing_parents(table(spark, sf_dir, "lineitem").select(moved.alias("l_orderkey"), "l_linenumber"), parents, "l_orderkey")


@query("""
(SELECT 'only_orders' AS side, o_custkey AS id FROM orders EXCEPT SELECT 'only_orders', user_id FROM events) UNION ALL
(SELECT 'only_events' AS side, user_id AS id FROM events EXCEPT SELECT 'only_events', o_custkey FROM orders)""")
def semi_anti_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, e = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id")), table(spark, sf_dir, "events").select(F.col("user_id").alias("id"))
    one, two = joins.only_in(o, e, ["id"]), joins.only_in(e, o, ["id"])
    return one.select(F.lit("only_orders").alias("side"), "id").unionByName(two.select(F.lit("only_events").alias("side"), "id"))


@query("""
SELECT coalesce(a, b) AS id, CASE WHEN a IS NULL THEN 'only_right' WHEN b IS NULL THEN 'only_left' ELSE 'both' END AS side
FROM (SELECT DISTINCT l_partkey + 60 AS a FROM lineitem) FULL JOIN (SELECT p_partkey AS b FROM part) ON a = b""")
def detector_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") + 60).alias("id"))
    return joins.compared(a, table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id")), ["id"])


@query("""
WITH b AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE s_name END AS name, s_nationkey % 2 = 0 AS flag FROM supplier),
o AS (SELECT s_suppkey * 2 AS id, CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE 'checked ' || s_suppkey END AS name, s_suppkey % 6 = 0 AS flag FROM supplier)
SELECT coalesce(b.id, o.id) AS id, coalesce(nullif(o.name, ''), b.name) AS name, coalesce(o.flag, false) OR coalesce(b.flag, false) AS flag FROM b FULL JOIN o ON b.id = o.id""")
def overlay_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, k = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    base = s.select(k.alias("id"), F.when(k % 3 == 0, "").otherwise(F.col("s_name")).alias("name"), (F.col("s_nationkey") % 2 == 0).alias("flag"))
    over = s.select((k * 2).alias("id"), F.when(k % 4 == 0, "").otherwise(F.concat(F.lit("checked "), k)).alias("name"), (k % 6 == 0).alias("flag"))
    return joins.overlaid(base, over, "id", ["name"], ["flag"])


_BY_BRAND = [("Brand#11", "a"), ("Brand#11", "b"), ("Brand#12", "twelve"), ("Brand#21", "twentyone")]
_BY_SIZE = [(str(n), f"size{n % 3}") for n in range(1, 20)]
_BY_WORD = [("^promo", "promo"), ("steel$", "steel"), ("brass$", "metal")]


@query(f"""
WITH b(pattern, category) AS ({sql_values(_BY_BRAND)}), z(pattern, category) AS ({sql_values(_BY_SIZE)}), w(pattern, category) AS ({sql_values(_BY_WORD)}),
bb AS (SELECT pattern, min(category) AS c FROM b GROUP BY 1 HAVING count(DISTINCT category) = 1), zz AS (SELECT pattern, min(category) AS c FROM z GROUP BY 1 HAVING count(DISTINCT category) = 1),
ww AS (SELECT p_partkey, min(category) AS c FROM part JOIN w ON regexp_matches(lower(p_type), pattern) GROUP BY 1 HAVING count(DISTINCT category) = 1)
SELECT p.p_partkey, coalesce(bb.c, zz.c, ww.c, 'unknown') AS category FROM part p LEFT JOIN bb ON bb.pattern = p_brand LEFT JOIN zz ON zz.pattern = CAST(p_size AS VARCHAR) LEFT JOIN ww ON ww.p_partkey = p.p_partkey""")
def cascade_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = "pattern string, category string"
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", F.col("p_size").cast("string").alias("size"))
    levels = [("p_brand", values(spark, kind, _BY_BRAND)), ("size", values(spark, kind, _BY_SIZE))]
    return joins.cascade(p, levels, "p_type", values(spark, kind, _BY_WORD)).select("p_partkey", "category")


CATALOG = [("Supplier#000000001", "First", "maven", 2), ("Supplier#000000001", "Other", "npm", 3), ("Supplier#000000002", "Second", "gradle", 1)]


@query(f"""
WITH c(name, vendor, ecosystem, pos) AS ({sql_values(CATALOG)}), f AS (SELECT name, arg_min(vendor, pos) AS vendor, arg_min(ecosystem, pos) AS ecosystem FROM c GROUP BY name)
SELECT s_suppkey, s_name, CASE WHEN s_suppkey % 2 = 0 THEN 'own' ELSE coalesce(f.vendor, '') END AS vendor, coalesce(f.ecosystem, 'custom') AS ecosystem FROM supplier LEFT JOIN f ON f.name = s_name""")
def fill_blank_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", F.when(F.col("s_suppkey") % 2 == 0, "own").otherwise("").alias("vendor"), F.lit("custom").alias("ecosystem"))
    return joins.filled_blanks(s, "s_name", values(spark, "name string, vendor string, ecosystem string, pos int", CATALOG), "name", "pos", ["vendor", "ecosystem"], {"ecosystem": "custom"})


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)")
def resume_not_done(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "customer").where("c_nationkey = 3").select(F.col("c_custkey").alias("o_custkey"))
    return joins.not_done(table(spark, sf_dir, "orders"), done, ["o_custkey"]).select("o_orderkey")


@query("""
WITH f AS (SELECT l_orderkey AS app, l_linenumber AS name, ['arm64', 'armv7', 'x86', NULL][l_suppkey % 4 + 1] AS abi FROM lineitem), p(abi, rank) AS (VALUES ('arm64', 1), ('armv7', 2)),
b AS (SELECT app, min(rank) AS rank FROM f JOIN p USING (abi) GROUP BY app)
SELECT app, name, abi FROM f WHERE abi IS NULL UNION ALL SELECT f.app, f.name, f.abi FROM f JOIN p USING (abi) JOIN b ON b.app = f.app AND b.rank = p.rank""")
def abi_split_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    abi = F.when(F.col("l_suppkey") % 4 == 0, "arm64").when(F.col("l_suppkey") % 4 == 1, "armv7").when(F.col("l_suppkey") % 4 == 2, "x86")
    files = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("app"), F.col("l_linenumber").alias("name"), abi.alias("abi"))
    return joins.preferred_splits(files, values(spark, "abi string, rank int", [("arm64", 1), ("armv7", 2)]))
