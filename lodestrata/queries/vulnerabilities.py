"""Components against vulnerability ranges: parts are components, their sizes versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.versions import in_any_range, version_key
from ..operators.merges import count_where, first_seen
from ..plans import vulnerabilities as plan
from ..tables import written
from .base import query, table


#: Parts that each task may hold whole; more are shuffled, so that they never pass through the driver.
MOST_PARTS = 2_000_000


def _sdks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of apps: a line item ships a part; its version is size.line, missing or unreadable at times.

    What a part alone decides is worked out once for each part, not for each line item.
    """
    l, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    fixed = F.when(F.col("p_partkey") % 11 == 0, "").when(F.col("p_partkey") % 13 == 0, "not-a-version")
    identifier = F.concat(F.lit("pkg."), F.translate(F.lower("p_name"), " ", "."))
    parts = p.select("p_partkey", identifier.alias("sdk_identifier"), F.col("p_name").alias("sdk_name"), fixed.alias("_fixed"), F.col("p_size").cast("string").alias("_size"))
    parts = F.broadcast(parts) if p.count() <= MOST_PARTS else parts.hint("shuffle_hash")
    version = F.coalesce("_fixed", F.concat_ws(".", "_size", F.col("l_linenumber").cast("string")))
    return l.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(
        F.concat(F.lit("app"), F.col("l_orderkey").cast("string")).alias("sample_id"), "sdk_identifier", "sdk_name", version.alias("sdk_version")
    )


def _cves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An entry for each maker and last name word of parts: vulnerable from the sizes of all its parts on and two versions up."""
    p = table(spark, sf_dir, "part")
    none = F.lit(None).cast("string")
    span = F.struct(F.col("p_size").cast("string").alias("start_including"), none.alias("start_excluding"), none.alias("end_including"), (F.col("p_size") + 2).cast("string").alias("end_excluding"))
    low = F.struct(none.alias("start_including"), F.lit("0").alias("start_excluding"), F.lit("1.3").alias("end_including"), none.alias("end_excluding"))
    product = F.element_at(F.split(F.lower("p_name"), " "), -1)
    each = p.select(
        F.concat(F.lit("CVE-"), F.substring("p_brand", 7, 1), F.lit("-"), product).alias("cve_id"), F.substring(F.lower("p_brand"), 1, 7).alias("vendor"), product.alias("product"), "p_partkey",
        F.explode(F.when(F.col("p_partkey") % 40 == 1, F.array(span, low)).otherwise(F.array(span))).alias("span"),
    )
    # a part's size is one of fifty, so there are few distinct ranges of an entry
    entry = each.groupBy("cve_id", "vendor", "product").agg(F.array_sort(F.collect_set("span")).alias("version_ranges"), (F.min("p_partkey") % 100 / 10).alias("score"))
    return entry.select("cve_id", "vendor", "product", F.lit("HIGH").alias("severity"), "score", F.lit("2024-01-01").alias("published"), "version_ranges")


_SQL = """s AS (
  SELECT 'app' || l_orderkey AS sample_id, 'pkg.' || replace(lower(p_name), ' ', '.') AS sdk_identifier, p_name AS sdk_name,
         CASE WHEN p_partkey % 11 = 0 THEN '' WHEN p_partkey % 13 = 0 THEN 'not-a-version' ELSE p_size || '.' || l_linenumber END AS sdk_version, p_size AS major, l_linenumber AS minor,
         p_partkey % 11 <> 0 AND p_partkey % 13 <> 0 AS ok
  FROM lineitem JOIN part ON l_partkey = p_partkey),
c AS (SELECT 'CVE-' || substr(p_brand, 7, 1) || '-' || string_split(lower(p_name), ' ')[-1] AS cve_id, string_split(lower(p_name), ' ')[-1] AS product, p_size AS low, bool_or(p_partkey % 40 = 1) AS two FROM part GROUP BY ALL),
e AS (SELECT 'CVE-' || substr(p_brand, 7, 1) || '-' || string_split(lower(p_name), ' ')[-1] AS cve_id, min(p_partkey) % 100 / 10 AS score FROM part GROUP BY 1),
t AS (SELECT DISTINCT sdk_identifier, unnest(string_split(sdk_identifier, '.')) AS w FROM s),
v AS (SELECT DISTINCT sdk_identifier, major, minor FROM s WHERE ok),
h AS (
  SELECT DISTINCT v.sdk_identifier, major, minor, cve_id FROM v JOIN t ON t.sdk_identifier = v.sdk_identifier JOIN c ON c.product = w
  WHERE (major >= low AND major < low + 2) OR (two AND (major > 0 OR (major = 0 AND minor > 0)) AND (major < 1 OR (major = 1 AND minor <= 3)))),
m AS (SELECT DISTINCT sample_id, s.sdk_identifier, h.cve_id, score FROM s JOIN h ON h.sdk_identifier = s.sdk_identifier AND h.major = s.major AND h.minor = s.minor JOIN e ON e.cve_id = h.cve_id WHERE ok)"""


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan.matches(written(_sdks(spark, sf_dir), "sdks"), _cves(spark, sf_dir))


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan.judged(written(_sdks(spark, sf_dir), "sdks"), _cves(spark, sf_dir))


@query(f"WITH {_SQL} SELECT sample_id, sdk_identifier, cve_id FROM m")
def version_range_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir).select("sample_id", "sdk_identifier", "cve_id")


@query(f"WITH {_SQL} SELECT sample_id, count(*) AS matches, count(DISTINCT cve_id) AS cves, count(DISTINCT sdk_identifier) AS components, max(score) AS worst_score FROM m GROUP BY 1")
def cve_app_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan.app_summary(_found(spark, sf_dir))


_OUTCOME = """SELECT s.sample_id, s.sdk_identifier, s.sdk_version, CASE WHEN sdk_version = '' THEN 'no_version' WHEN NOT ok THEN 'parse_error' WHEN x.sample_id IS NOT NULL THEN 'matched' ELSE 'no_nvd_entry' END AS outcome
FROM s LEFT JOIN (SELECT DISTINCT sample_id, sdk_identifier FROM m) x ON x.sample_id = s.sample_id AND x.sdk_identifier = s.sdk_identifier"""


@query(f"WITH {_SQL} {_OUTCOME}")
def cve_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir).select("sample_id", "sdk_identifier", "sdk_version", "outcome")


@query(f"""WITH {_SQL}, o AS ({_OUTCOME})
SELECT count(*) AS rows, count(*) FILTER (WHERE outcome = 'matched') AS matched, count(*) FILTER (WHERE outcome = 'no_version') AS no_version, count(*) FILTER (WHERE outcome = 'parse_error') AS parse_error, count(*) FILTER (WHERE outcome = 'no_nvd_entry') AS no_nvd_entry FROM o""")
def run_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = ["matched", "no_version", "parse_error", "no_nvd_entry"]
    return _judged(spark, sf_dir).agg(F.count("*").alias("rows"), *count_where({k: F.col("outcome") == k for k in kinds}))


@query("""
WITH c AS (SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'androidx.core' WHEN 1 THEN 'com.x.AndroidX' WHEN 2 THEN 'com.android' END AS ident, CASE WHEN s_suppkey % 3 = 0 THEN 'AndroidX Core' ELSE s_name END AS name FROM supplier)
SELECT s_suppkey FROM c WHERE NOT coalesce(starts_with(ident, 'androidx.'), false) AND NOT contains(lower(name), 'androidx')""")
def excluded_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey") % 4
    ident = F.when(k == 0, "androidx.core").when(k == 1, "com.x.AndroidX").when(k == 2, "com.android")
    name = F.when(F.col("s_suppkey") % 3 == 0, "AndroidX Core").otherwise(F.col("s_name"))
    return plan.without_family(table(spark, sf_dir, "supplier").select("s_suppkey", ident.alias("sdk_identifier"), name.alias("sdk_name")), "androidx").select("s_suppkey")


@query("""
WITH v AS (SELECT p_partkey, p_brand, p_size AS a, p_partkey % 7 AS b, p_size || '.' || (p_partkey % 7) || CASE WHEN p_partkey % 2 = 0 THEN '.0' ELSE '' END AS v FROM part)
SELECT p_brand, p_partkey, v FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY a DESC, b DESC, p_partkey) AS n FROM v) WHERE n = 1""")
def newest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    v = F.concat_ws(".", F.col("p_size").cast("string"), (k % 7).cast("string"), F.when(k % 2 == 0, F.lit("0")))
    p = table(spark, sf_dir, "part").select("p_brand", "p_partkey", v.alias("v"))
    return first_seen(p, ["p_brand"], [F.desc(version_key(F.col("v"))), F.col("p_partkey")])


@query("SELECT p_partkey, p_size >= 10 AND p_size < 20 OR p_size > 40 AS hit FROM part")
def any_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("string")
    fields = ["start_including", "start_excluding", "end_including", "end_excluding"]
    span = lambda *xs: F.struct(*((none if x is None else F.lit(x)).alias(f) for x, f in zip(xs, fields, strict=True)))
    ranges = F.array(span("10.0", None, None, "20"), span(None, "40.0.0", None, None), span(None, None, None, None))
    return table(spark, sf_dir, "part").select("p_partkey", in_any_range(F.col("p_size").cast("string"), ranges).alias("hit"))
