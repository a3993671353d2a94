"""Aggregations, windows, merges and integrity checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import checks, merges, ranks
from ..plans.cross import rolled_up
from ..streaming.flows import stream_bursts, stream_flows
from .base import PACKETS, packets, query, scratch, table

_FLOW = ["sample_id", "session_id", "domain", "dst_ip", "dst_port", "protocol"]


@query(f"""
WITH {PACKETS} SELECT sample_id, session_id, domain, dst_ip, dst_port, protocol, count(*) AS packets, CAST(sum(size) AS BIGINT) AS bytes, min(ts) AS first_seen, max(ts) AS last_seen, bool_or(dst_port NOT IN (53, 80, 443, 8008, 8080, 8443)) AS odd_port
FROM packets GROUP BY ALL""")
def flow_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = packets(spark, sf_dir).withColumn("odd_port", ~F.col("dst_port").isin(53, 80, 443, 8008, 8080, 8443))
    return merges.flows(p, _FLOW, "ts", "size", ["odd_port"])


@query(f"""
WITH {PACKETS} SELECT sample_id, domain, dst_ip, event_id, size FROM (SELECT *, row_number() OVER (PARTITION BY sample_id, domain, dst_ip ORDER BY event_id) AS n FROM packets WHERE domain <> '') WHERE n = 1""")
def domain_ip_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = packets(spark, sf_dir).where("domain <> ''")
    return merges.first_seen(p, ["sample_id", "domain", "dst_ip"], ["event_id"]).select("sample_id", "domain", "dst_ip", "event_id", "size")


@query(f"""
WITH {PACKETS} SELECT sample_id, session_id, count(*) AS events, CAST(sum(size) AS BIGINT) AS bytes, min(ts) AS first_seen, max(ts) AS last_seen, CAST(epoch_us(max(ts)) - epoch_us(min(ts)) AS BIGINT) AS duration_us FROM packets GROUP BY ALL""")
def session_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    duration = F.unix_micros(F.max("t")) - F.unix_micros(F.min("t"))
    p = packets(spark, sf_dir).withColumn("t", F.col("ts").cast("timestamp"))
    return p.groupBy("sample_id", "session_id").agg(
        F.count("*").alias("events"), F.sum("size").alias("bytes"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), duration.alias("duration_us")
    )


@query(f"""
WITH {PACKETS} SELECT sample_id, count(DISTINCT CASE WHEN domain <> '' THEN domain END) AS domains, count(DISTINCT CASE WHEN protocol = 'UDP' AND domain <> '' THEN domain END) AS udp_domains,
  count(DISTINCT CASE WHEN dst_port = 443 AND domain <> '' THEN domain END) AS tls_domains, CAST(coalesce(sum(size) FILTER (WHERE dst_port = 53), 0) AS BIGINT) AS dns_bytes,
  CAST(coalesce(sum(size) FILTER (WHERE domain = ''), 0) AS BIGINT) AS nameless_bytes FROM packets GROUP BY sample_id""")
def conditional_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = {"domains": F.lit(True), "udp_domains": F.col("protocol") == "UDP", "tls_domains": F.col("dst_port") == 443}
    summed = {"dns_bytes": F.col("dst_port") == 53, "nameless_bytes": F.col("domain") == ""}
    p = packets(spark, sf_dir)
    counts = merges.distinct_counts(p, ["sample_id"], named, "domain")
    return counts.join(p.groupBy("sample_id").agg(*merges.sum_where(summed, "size")), "sample_id")


@query("""
SELECT o_orderpriority AS app, n_name AS place, count(DISTINCT c_custkey) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL""")
def member_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    o = o.join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return merges.distribution(o.select(F.col("o_orderpriority").alias("app"), F.col("n_name").alias("place"), "c_custkey"), ["app"], "place", "c_custkey")


@query(f"WITH {PACKETS} SELECT sample_id, domain, CAST(sum(size) AS BIGINT) AS n FROM packets WHERE domain <> '' GROUP BY ALL")
def weighted_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merges.distribution(packets(spark, sf_dir), ["sample_id"], "domain", weight="size")


@query("""
WITH d AS (SELECT o_orderstatus, o_custkey, count(*) AS n, min(o_orderkey) AS first FROM orders GROUP BY ALL),
t AS (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY n DESC, first, o_custkey) AS place, n / sum(n) OVER (PARTITION BY o_orderstatus) AS share FROM d)
SELECT o_orderstatus, o_custkey, n, first, place, share FROM t WHERE place <= 5""")
def topk_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "orders").groupBy("o_orderstatus", "o_custkey").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first"))
    return merges.top_shares(d, ["o_orderstatus"], "o_custkey", 5, "first")


@query("""
SELECT l_returnflag, avg(n) AS avg_answers, max(n) AS max_answers FROM (SELECT l_returnflag, l_partkey, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY ALL) GROUP BY 1""")
def fanout_avg_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_partkey", F.array("l_suppkey").alias("answers"))
    return merges.fan_out(rows, ["l_returnflag"], "l_partkey", "answers")


@query("""
SELECT p_brand, count(DISTINCT CASE WHEN regexp_matches(lower(p_type), 'steel|tin') AND p_name <> '' THEN p_name END) AS metal, count(DISTINCT CASE WHEN regexp_matches(lower(p_type), 'promo') AND p_name <> '' THEN p_name END) AS promo FROM part GROUP BY 1""")
def keyword_bucket_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    buckets = {"metal": F.lower("p_type").rlike("steel|tin"), "promo": F.lower("p_type").rlike("promo")}
    return merges.distinct_counts(table(spark, sf_dir, "part"), ["p_brand"], buckets, "p_name")


@query("""
WITH f AS (SELECT l_partkey % 500 AS sample_id, l_shipmode AS kind, l_suppkey AS file, l_linenumber % 3 AS rank, l_linenumber % 4 AS layer, l_orderkey * 10 + l_linenumber AS pos, l_returnflag AS subtype
  FROM (SELECT *, l_linestatus AS l_shipmode FROM lineitem)),
d AS (SELECT sample_id, kind, json_group_object(k, v) AS x FROM (SELECT sample_id, kind, k, arg_max(v, pos) AS v FROM (SELECT sample_id, kind, pos, 's' || (pos % 3) AS k, CAST(pos AS VARCHAR) AS v FROM f) GROUP BY ALL ORDER BY k) GROUP BY ALL)
SELECT f.sample_id, f.kind, count(*) AS occurrences, count(DISTINCT file) AS files, max(rank) AS rank, arg_min(file, layer * 10000000000 + pos) AS file, 'snippet of ' || arg_min(pos, layer * 10000000000 + pos) AS snippet, arg_min(subtype, pos) AS subtype,
  any_value(json_extract_string(x, '$.s0')) AS s0, any_value(json_extract_string(x, '$.s1')) AS s1, any_value(json_extract_string(x, '$.s2')) AS s2
FROM f JOIN d ON d.sample_id = f.sample_id AND d.kind = f.kind GROUP BY ALL""")
def findings_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    pos = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    rows = table(spark, sf_dir, "lineitem").select(
        (F.col("l_partkey") % 500).alias("sample_id"), F.col("l_linestatus").alias("kind"), F.col("l_suppkey").alias("file"), (F.col("l_linenumber") % 3).alias("rank"), (F.col("l_linenumber") % 4).alias("layer"),
        pos.alias("pos"), F.col("l_returnflag").alias("subtype"), F.create_map(F.concat(F.lit("s"), pos % 3), pos.cast("string")).alias("details"),
    )
    out = merges.merged_findings(rows.withColumn("snippet", F.concat(F.lit("snippet of "), "pos")), ["sample_id", "kind"], "file", "rank", "layer", "pos", "details", "subtype", "snippet")
    return out.select("*", *(F.col("details")[f"s{i}"].alias(f"s{i}") for i in range(3))).drop("details")


@query("""
SELECT l_partkey, bool_or(l_returnflag = 'R') AS in_manifest, bool_or(l_linestatus = 'O') AS in_code, CAST(sum(l_linenumber) AS BIGINT) AS evidence_count,
  arg_min(v, l_orderkey * 10 + l_linenumber) FILTER (WHERE v IS NOT NULL) AS version, CASE WHEN count(DISTINCT l_linestatus) > 1 THEN 'both' ELSE min(l_linestatus) END AS source
FROM (SELECT *, CASE WHEN l_linenumber % 2 = 0 THEN l_suppkey || '.0' END AS v FROM lineitem) GROUP BY 1""")
def canonical_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(
        "l_partkey", (F.col("l_returnflag") == "R").alias("in_manifest"), (F.col("l_linestatus") == "O").alias("in_code"), F.col("l_linenumber").alias("evidence_count"),
        F.when(F.col("l_linenumber") % 2 == 0, F.concat("l_suppkey", F.lit(".0"))).alias("version"), F.col("l_linestatus").alias("source"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"),
    )
    return merges.merged_components(rows, ["l_partkey"], ["in_manifest", "in_code"], ["evidence_count"], "version", "source", "pos")


@query("""
SELECT l_partkey, l_suppkey AS version FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_linenumber DESC, l_returnflag, l_orderkey) AS n FROM lineitem WHERE l_quantity > 10) WHERE n = 1""")
def best_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumn("version", F.col("l_suppkey"))
    return merges.best_candidate(rows, ["l_partkey"], "version", F.col("l_quantity") > 10, [F.desc("l_linenumber"), F.col("l_returnflag"), F.col("l_orderkey")])


@query("""
WITH x AS (SELECT p_brand, string_split(p_type, ' ') AS s, CASE WHEN p_partkey % 3 = 0 THEN p_name WHEN p_partkey % 3 = 1 THEN 'unknown' ELSE '' END AS c, p_partkey AS pos, p_size FROM part)
SELECT p_brand, array_to_string(list_sort(list_distinct(flatten(list(s)))), ',') AS sources, coalesce(arg_min(c, pos) FILTER (WHERE c NOT IN ('', 'unknown')), 'unknown') AS category, min(p_size) AS low, max(p_size) AS high,
  CASE WHEN len(list_distinct(flatten(list(s)))) >= 3 THEN 'VERY_HIGH' WHEN len(list_distinct(flatten(list(s)))) = 2 THEN 'HIGH' ELSE 'MEDIUM' END AS confidence FROM x GROUP BY 1""")
def set_union_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 3
    rows = table(spark, sf_dir, "part").select("p_brand", F.split("p_type", " ").alias("sources"), F.when(k == 0, F.col("p_name")).when(k == 1, "unknown").otherwise("").alias("category"), F.col("p_partkey").alias("pos"), F.col("p_size").alias("low"), F.col("p_size").alias("high"))
    return merges.united(rows, ["p_brand"], ["sources"], "category", "pos", "low", "high").withColumn("sources", F.array_join("sources", ","))


@query("SELECT p_brand, array_to_string(list_sort(list(DISTINCT p_size)), ',') AS levels, min(p_size) AS least, max(p_size) AS most FROM part GROUP BY 1")
def version_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = merges.version_span(table(spark, sf_dir, "part"), ["p_brand"], "p_size")
    return out.withColumn("levels", F.array_join(F.transform("levels", lambda x: x.cast("string")), ","))


@query("SELECT o_custkey, o_orderkey, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderdate, o_orderkey) AS n FROM orders) WHERE n = 1")
def sort_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merges.first_seen(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderpriority", "o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_orderpriority")


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1")
def override_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merges.last_by_priority(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderpriority", "o_orderkey"]).select("o_custkey", "o_orderkey")


@query("""
WITH x AS (SELECT p_size AS domain, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE '' END AS vendor, CASE WHEN p_partkey % 3 = 0 THEN p_type ELSE '' END AS category, p_type[1:5] AS dataset, p_partkey AS pr FROM part)
SELECT domain, arg_min(vendor, pr) FILTER (WHERE vendor <> '') AS vendor, arg_min(category, pr) FILTER (WHERE category <> '') AS category, array_to_string(list_sort(list(DISTINCT dataset)), ';') AS datasets, count(*) AS rows, count(DISTINCT nullif(vendor, '')) > 1 AS conflict FROM x GROUP BY 1""")
def conflict_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    x = table(spark, sf_dir, "part").select(F.col("p_size").alias("domain"), F.when(k % 2 == 0, F.col("p_brand")).otherwise("").alias("vendor"), F.when(k % 3 == 0, F.col("p_type")).otherwise("").alias("category"), F.substring("p_type", 1, 5).alias("dataset"), k.alias("pr"))
    return merges.conflict_merge(x, "domain", ["vendor", "category"], "dataset", "pr")


@query("""
SELECT o_custkey, count(*) AS orders, count(*) FILTER (WHERE o_orderstatus = 'F') AS done, count(*) FILTER (WHERE o_orderpriority LIKE '1%') AS urgent, count(*) FILTER (WHERE o_totalprice > 100000) AS large,
  count(*) FILTER (WHERE CASE WHEN o_totalprice > 200000 THEN 3 WHEN o_totalprice > 50000 THEN 2 ELSE 1 END = 2) AS tier_two, array_to_string(list_sort(list(DISTINCT o_orderpriority)), ';') AS kinds FROM orders GROUP BY 1""")
def wide_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("o_totalprice")
    tier = F.when(price > 200000, 3).when(price > 50000, 2).otherwise(1)
    conditions = {"done": F.col("o_orderstatus") == "F", "urgent": F.startswith("o_orderpriority", F.lit("1")), "large": price > 100000, "tier_two": tier == 2}
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("orders"), *merges.count_where(conditions), merges.joined_set("o_orderpriority").alias("kinds"))


@query("SELECT lang, count(*) AS docs, count(l.doc_id) AS labelled, CAST(round(CAST(100.0 * count(l.doc_id) / count(*) AS DECIMAL(18, 6)), 1) AS DECIMAL(18, 1)) AS pct FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY 1")
def coverage_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id", F.lit(1).alias("there")), "doc_id", "left")
    return d.groupBy("lang").agg(F.count("*").alias("docs"), F.count("there").alias("labelled"), merges.percent(F.count("there"), F.count("*")).alias("pct"))


@query("SELECT w AS word, count(*) AS n FROM (SELECT unnest(string_split(p_type, ' ')) AS w FROM part) GROUP BY 1 ORDER BY n DESC, word LIMIT 10")
def freq_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merges.frequent(table(spark, sf_dir, "part").select(F.explode(F.split("p_type", " ")).alias("word")), "word", 10)


@query("SELECT m AS member, count(*) AS n FROM (SELECT unnest(string_split(p_type, ' ')) AS m FROM part) WHERE m <> '' GROUP BY 1")
def contribution_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merges.exploded_counts(table(spark, sf_dir, "part"), "p_type", " ")


@query("""
SELECT CAST(count(*) AS BIGINT) AS rows, 0 AS blank_keys, count(*) FILTER (WHERE l_discount > 0.05) AS discounted, count(*) FILTER (WHERE l_shipdate IS NULL) AS undated,
  (SELECT count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_partkey, l_suppkey HAVING count(*) > 1)) AS duplicate_keys FROM lineitem""")
def integrity_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.counters(table(spark, sf_dir, "lineitem"), ["l_partkey", "l_suppkey"], {"discounted": F.col("l_discount") > 0.05, "undated": F.col("l_shipdate").isNull()})


@query("""
SELECT count(*) FILTER (WHERE b IS NULL) AS lost, count(*) FILTER (WHERE a IS NULL) AS unknown, count(*) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL AND bs <> s) AS changed, count(*) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL AND bc <> c) AS recategorised
FROM (SELECT p_partkey AS a, p_size AS s, p_type AS c FROM part) FULL JOIN
     (SELECT p_partkey + 3 AS b, CASE WHEN p_partkey % 50 = 1 THEN 0 ELSE p_size END AS bs, CASE WHEN p_partkey % 7 = 0 THEN 'x' ELSE p_type END AS bc FROM part) ON a = b""")
def identity_preserved(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    before = p.select("p_partkey", "p_size", "p_type")
    after = p.select((k + 3).alias("p_partkey"), F.when(k % 50 == 1, 0).otherwise(F.col("p_size")).alias("p_size"), F.when(k % 7 == 0, "x").otherwise(F.col("p_type")).alias("p_type"))
    return checks.identity_kept(before, after, "p_partkey", ["p_size"], "p_type")


@query("SELECT p_partkey, lower(p_brand) || '_' || row_number() OVER (PARTITION BY p_brand ORDER BY p_name, p_partkey) AS rule_id FROM part")
def rule_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranks.numbered(table(spark, sf_dir, "part"), "p_brand", ["p_name", "p_partkey"]).select("p_partkey", "rule_id")


@query("SELECT p_brand, p_partkey, p_size, before FROM (SELECT *, lag(p_size) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS before FROM part) WHERE p_size < before")
def order_violation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.out_of_order(table(spark, sf_dir, "part"), ["p_brand"], "p_partkey", "p_size").select("p_brand", "p_partkey", "p_size", "before")


@query("SELECT p_brand, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY CASE WHEN p_size > 30 THEN 0 ELSE 1 END, p_partkey) AS n FROM part) WHERE n <= 20")
def capped_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merges.capped(table(spark, sf_dir, "part"), ["p_brand"], F.col("p_size") > 30, ["p_partkey"], 20).select("p_brand", "p_partkey")


@query("""
WITH s AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) <= 1800000000 THEN 0 ELSE 1 END AS s FROM events),
b AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS burst FROM s)
SELECT user_id, CAST(burst AS BIGINT) AS burst, count(*) AS events, min(ts) AS first_seen, max(ts) AS last_seen FROM b GROUP BY ALL""")
def gap_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merges.bursts(table(spark, sf_dir, "events"), ["user_id"], "ts", 1800)


@query("""
SELECT r_name, n_name, o_orderpriority, CAST(grouping(r_name, n_name, o_orderpriority) AS BIGINT) AS level, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS total
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name, o_orderpriority)""")
def cube_region_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    o = o.join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rolled_up(o, ["r_name", "n_name", "o_orderpriority"], "o_orderkey")


def _streamed(spark: SparkSession, sf_dir: str, transform) -> DataFrame:  # noqa: ANN001
    """What a stream over the events has given once all are in: the windows that the watermark has closed, each once."""
    path = scratch(spark, "stream")
    events = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))
    out = transform(events)
    sink = out.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{path}/state").option("path", f"{path}/rows")
    sink.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{path}/rows")


def _plain_times(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


@query("""
SELECT date_trunc('day', ts) AS window_start, user_id, event_type, count(*) AS packets, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS bytes, min(ts) AS first_seen, max(ts) AS last_seen FROM events GROUP BY ALL
HAVING date_trunc('day', min(ts)) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def stream_flow_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _streamed(spark, sf_dir, lambda e: stream_flows(e.withColumn("size", F.round(F.col("value") * 100).cast("long")), ["user_id", "event_type"], "ts", "size", "1 day"))
    return _plain_times(out, "window_start", "first_seen", "last_seen")


@query("""
WITH s AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) < 1800000000 THEN 0 ELSE 1 END AS s FROM events),
b AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS burst FROM s)
SELECT user_id, count(*) AS events, min(ts) AS first_seen, max(ts) AS last_seen FROM b GROUP BY user_id, burst
HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def stream_gap_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain_times(_streamed(spark, sf_dir, lambda e: stream_bursts(e, ["user_id"], "ts")), "first_seen", "last_seen")
