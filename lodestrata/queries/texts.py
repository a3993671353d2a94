"""Text mining over documents, pages and conversations, and analyses of its results."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.net import url_host
from ..functions.strings import plausible_secret
from ..functions.values import (
    BUILD_NAMES, CODE_WORDS, CONSTANT_STARTS, METHOD_STARTS, NAME_ENDS, NAME_STARTS, NO_SECRETS, PII_PATTERNS, RESOURCE_STARTS, RUNS_OF_SIGNS, TEXT_TLDS, WEBSOCKET_GUID,
)
from ..operators import joins, matching
from ..sources.documents import attribute_values
from .base import HOST_SQL, query, sql_values, table, values
from .linkage import TRACKERS

#: DuckDB knows no lookaheads; the numbers that they rule out are taken out of its matches.
_PLAIN = [(n, p.replace("(?!(?:000|666|9))", "").replace("(?!00)", "").replace("(?!0000)", "")) for n, _, p, _ in PII_PATTERNS]
_MASTER = "(?i)" + "|".join(f"(?:{p})" for _, p in _PLAIN)
_CLASSES = " ".join(f"WHEN regexp_full_match(v, '(?i)(?:{p.removeprefix(chr(92) + 'b') if p.startswith(chr(92) + 'b' + chr(92) + '+') else p})') THEN '{n}'" for n, p in _PLAIN).replace("\\/", "/")
_LUHN = """list_sum(list_transform(range(1, length(v) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(reverse(v)[i] AS INT) WHEN CAST(reverse(v)[i] AS INT) > 4 THEN CAST(reverse(v)[i] AS INT) * 2 - 9 ELSE CAST(reverse(v)[i] AS INT) * 2 END)) % 10 = 0"""
_PII = """m AS (SELECT {key}, unnest(regexp_extract_all(text, '{master}')) AS v FROM {t}), k AS (SELECT {key}, v, CASE {classes} END AS pattern_name FROM m),
g AS (SELECT * FROM k WHERE CASE WHEN pattern_name IN ('Credit Card', 'IMEI', 'ICCID') THEN {luhn} WHEN pattern_name = 'US SSN' THEN NOT regexp_matches(v, '^(000|666|9)|-00-|-0000$') ELSE true END)"""


def _pii(key: str, source: str) -> str:
    return _PII.format(key=key, t=source, master=_MASTER.replace("'", "''").replace("\\/", "/"), classes=_CLASSES, luhn=_LUHN)


@query(f"WITH {_pii('doc_id', 'documents')} SELECT doc_id, pattern_name, v AS value, count(*) AS n FROM g GROUP BY ALL")
def pii_master(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "documents").select("doc_id", F.explode(matching.personal_data(F.col("text"))).alias("m"))
    return found.groupBy("doc_id", "m.pattern_name", "m.value").agg(F.count("*").alias("n"))


_SAID = "(SELECT conv_id, turn, role, text || ' u' || conv_id || '@mail.example.com' AS text FROM conversations)"


@query(f"WITH {_pii('conv_id, turn, role', _SAID)} SELECT DISTINCT conv_id, turn, role AS location, pattern_name, v AS value FROM g")
def conversation_fields_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").withColumn("text", F.concat("text", F.lit(" u"), F.col("conv_id").cast("string"), F.lit("@mail.example.com")))
    sides = c.select("conv_id", "turn", *(F.when(F.col("role") == r, F.col("text")).alias(r) for r in ("user", "assistant", "system")))
    return matching.personal_data_in_fields(sides, ["conv_id", "turn"], {r: r for r in ("user", "assistant", "system")}).drop("category")


@query(f"WITH {_pii('doc_id, lang', 'documents')} SELECT d.lang, count(DISTINCT d.doc_id) AS docs, count(DISTINCT g.doc_id) AS with_pii FROM documents d LEFT JOIN g ON g.doc_id = d.doc_id GROUP BY 1")
def pii_rate_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", (F.size(matching.personal_data(F.col("text"))) > 0).alias("hit"))
    return d.groupBy("lang").agg(F.count_distinct("doc_id").alias("docs"), F.count_distinct(F.when(F.col("hit"), F.col("doc_id"))).alias("with_pii"))


@query(r"""
SELECT doc_id, v AS value FROM (SELECT doc_id, unnest(regexp_extract_all(text, '\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b')) AS v FROM documents)
WHERE len(list_filter(string_split(v, '.'), lambda x: CAST(x AS INT) > 255 OR (length(x) > 1 AND x[1] = '0'))) = 0""")
def ipv4_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.net import ip_number

    found = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b"), F.lit(0))).alias("value"))
    return found.where(ip_number(F.col("value")).isNotNull())


KEYWORDS = [("token", "Authentication", "secret"), ("password", "Authentication", "secret"), ("licensed under", "Legal", "license"), ("mail", "Contact", "mail"), ("shared", "Data", "sharing")]


@query(f"""
WITH k(token, category, subcategory) AS ({sql_values(KEYWORDS)})
SELECT doc_id, token, category, subcategory, strpos(lower(text), token) - 1 AS first_at, strpos(lower(text), token) + length(token) - 2 AS last_at FROM documents JOIN k ON contains(lower(text), token)""")
def keyword_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = values(spark, "token string, category string, subcategory string", KEYWORDS)
    return matching.keyword_search(table(spark, sf_dir, "documents"), "doc_id", "text", rules)


GEO = [("r1", "Apache", "License"), ("r2", "GNU", ""), ("r3", "token", "From")]


@query(r"""
SELECT DISTINCT doc_id, 'r1' AS rule_id, unnest(regexp_extract_all(text, '(?i)(?:Apache[.;>/-]*)?License\b')) AS value FROM documents UNION
SELECT doc_id, 'r2', unnest(regexp_extract_all(text, '(?i)\bGNU\b')) FROM documents UNION SELECT doc_id, 'r3', unnest(regexp_extract_all(text, '(?i)(?:token[.;>/-]*)?From\b')) FROM documents""")
def geo_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.rule_patterns(table(spark, sf_dir, "documents"), ["doc_id"], "text", values(spark, "rule_id string, class_name string, method_name string", GEO))


SECRETS = [("hex_token", r"\b[0-9a-f]{40}\b", "HIGH"), ("mail", r"[a-z0-9.]+@mail\d+\.example\.com", "MEDIUM"), ("word", r"\bthe\b", "LOW"), ("high_entropy_token", r'"[^"\s]{16,}"', "MEDIUM")]


@query(r"""
SELECT DISTINCT doc_id, 'hex_token' AS pattern_id, 'high' AS confidence, unnest(regexp_extract_all(text, '\b[0-9a-f]{40}\b')) AS value FROM documents UNION
SELECT doc_id, 'mail', 'medium', unnest(regexp_extract_all(text, '[a-z0-9.]+@mail\d+\.example\.com')) FROM documents UNION
SELECT doc_id, 'high_entropy_token', 'medium', v FROM (SELECT doc_id, unnest(regexp_extract_all(text, '"[^"\s]{16,}"')) AS v FROM documents)
WHERE length(v) >= 16 AND regexp_matches(v, '[0-9]') AND CAST(regexp_matches(v, '[a-z]') AS INT) + CAST(regexp_matches(v, '[A-Z]') AS INT) + 1 + CAST(regexp_matches(v, '[^A-Za-z0-9]') AS INT) >= 3
  AND NOT regexp_matches(v, '^(https?://|/|\.)|^[a-z]+(\.[a-z0-9]+)+$|(?i:example|placeholder|your_|test_key)')
  AND (SELECT -sum(n / t * log2(n / t)) FROM (SELECT count(*) AS n, length(v) AS t FROM (SELECT unnest(string_split(v, '')) AS c) GROUP BY c)) >= 3.8""")
def secret_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = matching.supported_patterns([*SECRETS, ("broken", "(?P<x>a", "HIGH")], spark)
    return matching.secrets(table(spark, sf_dir, "documents"), ["doc_id"], "text", rules)


_STARTS = "|".join(re.escape(x) for x in [*NAME_STARTS, *RESOURCE_STARTS])

@query(rf"""
WITH t AS (SELECT unnest(regexp_extract_all(text || ' Zx9-' || substr(md5(text), 1, 14) || 'Q', '[A-Za-z0-9+/_=-]{{16,}}')) AS v FROM documents),
s AS (SELECT v, regexp_matches(v, '[0-9]') AND CAST(regexp_matches(v, '[a-z]') AS INT) + CAST(regexp_matches(v, '[A-Z]') AS INT) + 1 + CAST(regexp_matches(v, '[^A-Za-z0-9]') AS INT) >= 3 AS mixed,
  (SELECT -sum(n / t * log2(n / t)) FROM (SELECT count(*) AS n, length(v) AS t FROM (SELECT unnest(string_split(v, '')) AS c) GROUP BY c)) AS bits,
  regexp_matches(lower(v), '^({_STARTS}|action\.|android\.permission)|res/|__|_.*_.*_|_$|({"|".join(NAME_ENDS)})$|abcdefghijklmnopqrstuvwxyz|0123456789|9876543210')
  OR regexp_matches(upper(v), '^({"|".join(CONSTANT_STARTS)})|ACTION_|PERMISSION') OR regexp_matches(v, '^u[0-9a-fA-F]{{4}}|^[A-Z0-9_]+$|/.*/|^[0-9a-fA-F]{{8}}(-[0-9a-fA-F]{{4}}){{3}}-[0-9a-fA-F]{{12}}$')
  OR (regexp_matches(lower(v), '^({"|".join(METHOD_STARTS)})') AND regexp_matches(v, '[A-Z]') AND length(regexp_replace(v, '[^0-9]', '', 'g')) < 3) AS none FROM t)
SELECT count(*) AS tokens, count(*) FILTER (WHERE mixed) AS mixed, count(*) FILTER (WHERE mixed AND bits >= 3.8 AND NOT none) AS secrets FROM s""")
def secret_plausible(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("v")
    text = F.concat("text", F.lit(" Zx9-"), F.substring(F.md5(F.col("text").cast("binary")), 1, 14), F.lit("Q"))
    tokens = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all(text, F.lit("[A-Za-z0-9+/_=-]{16,}"), F.lit(0))).alias("v"))
    classes = sum((v.rlike(p).cast("int") for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]")), F.lit(0))
    judged = tokens.select((v.rlike("[0-9]") & (classes >= 3)).alias("mixed"), plausible_secret(v).alias("secret"))
    return judged.agg(F.count("*").alias("tokens"), F.count_if("mixed").alias("mixed"), F.count_if("secret").alias("secrets"))


#: Beginnings and ends of tokens, of which the rules know most, and the plain sets that the rules look up.
_HEADS = ["", "x", *NAME_STARTS, *RESOURCE_STARTS, *METHOD_STARTS, *CONSTANT_STARTS, "@", "R.", "res/", "Zq", "-----BEGIN ", "action.", "my_ACTION_", "a.b."]
_TAILS = ["", "Z", *NAME_ENDS, "_", "__k", "_a_b_c", "/d/e", ";", "+Q", *RUNS_OF_SIGNS]


def _secret_sql(v: str) -> str:
    """Whether a token may be a secret for what it looks like, by the rules one after another."""
    starts = lambda c, xs: " OR ".join(f"starts_with({c}, '{x}')" for x in xs)
    low, up = f"lower({v})", f"upper({v})"
    return f"""NOT ({v} = '' OR {low} IN {tuple(NO_SECRETS)} OR {up} IN {tuple(BUILD_NAMES)} OR {up} = '{WEBSOCKET_GUID}' OR regexp_matches({v}, '^[0-9a-fA-F]{{8}}(-[0-9a-fA-F]{{4}}){{3}}-[0-9a-fA-F]{{12}}$')
  OR contains({low}, '{RUNS_OF_SIGNS[0]}') OR contains({v}, '{RUNS_OF_SIGNS[1]}') OR contains({v}, '{RUNS_OF_SIGNS[2]}') OR contains({v}, '-----BEGIN ') OR regexp_matches({up}, 'BEGIN (CERTIFICATE|PUBLIC KEY|RSA PRIVATE KEY)')
  OR {starts(up, CONSTANT_STARTS)} OR contains({up}, 'ACTION_') OR contains({up}, 'PERMISSION') OR contains({low}, 'android.intent') OR {starts(low, ["action.", "android.permission"])}
  OR {starts(v, ["R.", "@"])} OR contains({low}, 'res/') OR {starts(low, NAME_STARTS + RESOURCE_STARTS)} OR regexp_matches({v}, '^u[0-9a-fA-F]{{4}}')
  OR contains({v}, '__') OR length({v}) - length(replace({v}, '_', '')) >= 3 OR regexp_matches({low}, '({"|".join(NAME_ENDS)})$') OR ends_with({v}, '_')
  OR (({starts(low, METHOD_STARTS)}) AND regexp_matches({v}, '[A-Z]') AND length(regexp_replace({v}, '[^0-9]', '', 'g')) < 3))"""


def _mixed_sql(v: str) -> str:
    """Whether a token is mixed enough to be one for that alone, but for its entropy, in bits."""
    kinds = " + ".join(f"CAST(regexp_matches({v}, '{p}') AS INT)" for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    return f"""regexp_matches({v}, '[0-9]') AND {kinds} >= 3 AND NOT regexp_matches({v}, '^[A-Z0-9_]+$') AND length({v}) - length(replace({v}, '.', '')) <= 1 AND length({v}) - length(replace({v}, '/', '')) <= 1 AND NOT regexp_matches({v}, '[;$]')"""


@query(f"""
WITH t AS (SELECT o_orderkey, ({_HEADS})[o_orderkey % {len(_HEADS)} + 1] || substr(md5('s' || o_custkey), 1, 6 + o_orderkey % 5) || upper(substr(md5('u' || o_custkey), 1, o_orderkey % 4)) || ({_TAILS})[o_orderkey // {len(_HEADS)} % {len(_TAILS)} + 1] AS v FROM orders),
e AS (SELECT o_orderkey, -sum(n / t * log2(n / t)) AS bits FROM (SELECT o_orderkey, c, count(*) AS n, any_value(t) AS t FROM (SELECT o_orderkey, length(v) AS t, unnest(string_split(v, '')) AS c FROM t) GROUP BY o_orderkey, c) GROUP BY o_orderkey)
SELECT o_orderkey, v, {_secret_sql('v')} AS plausible, {_secret_sql('v')} AND {_mixed_sql('v')} AND bits >= 3.8 AS strong FROM t JOIN e USING (o_orderkey)""")
def secret_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of many shapes, a beginning, a body and an end for each order, judged with and without the rule of mixed characters (F8)."""
    k = F.col("o_orderkey")
    pick = lambda xs, n: F.element_at(F.array(*map(F.lit, xs)), (n + 1).cast("int"))
    body = lambda mark, n: F.substr(F.md5(F.concat(F.lit(mark), "o_custkey").cast("binary")), F.lit(1), n.cast("int"))
    v = F.concat(pick(_HEADS, k % len(_HEADS)), body("s", 6 + k % 5), F.upper(body("u", k % 4)), pick(_TAILS, F.floor(k / len(_HEADS)) % len(_TAILS)))
    tokens = table(spark, sf_dir, "orders").select("o_orderkey", v.alias("v"))
    return tokens.select("o_orderkey", "v", plausible_secret(F.col("v"), False).alias("plausible"), plausible_secret(F.col("v")).alias("strong"))


@query(rf"""
WITH u AS (SELECT page_id, regexp_replace(lower(regexp_extract(unnest(regexp_extract_all(url || ' ' || coalesce(html, ''), '(?i)\b(?:https?|wss?|ftp)://[^\s"''<>\\)\]]+')), '^[A-Za-z]+://(?:[^/?#@]*@)?\[?([^/?#:\]]+)', 1)), '', '') AS host FROM pages)
SELECT DISTINCT page_id, 'url' AS kind, host, 'high' AS confidence FROM u WHERE host <> ''""")
def endpoint_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", F.concat_ws(" ", "url", "html").alias("text"))
    return matching.endpoints(pages, ["page_id"], "text").where("kind = 'url'")


@query(rf"""
SELECT page_id, host FROM (SELECT page_id, {HOST_SQL} AS host FROM pages) WHERE string_split(host, '.')[-1] IN ({", ".join(map(repr, TEXT_TLDS))}) AND NOT regexp_matches(host, '{"|".join(CODE_WORDS)}')
  AND regexp_full_match(host, '[a-z0-9-]+(\.[a-z0-9-]+)+')""")
def bare_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts of pages as bare words of a text."""
    text = F.concat(F.lit("see "), F.regexp_replace("url", "^[A-Za-z]+://", ""))
    return matching.endpoints(table(spark, sf_dir, "pages").select("page_id", text.alias("text")), ["page_id"], "text").where("kind = 'domain'").select("page_id", "host")


@query("""SELECT page_id, unnest(regexp_extract_all(html, '(?is)<a\\b[^>]*?\\shref\\s*=\\s*["'']([^"'']*)["'']', 1)) AS link FROM pages""")
def html_attr_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.explode(attribute_values(F.col("html"), "a", "href")).alias("link"))


@query(f"""
WITH h AS (SELECT page_id, {HOST_SQL} AS host FROM pages), r(suffix, vendor, category) AS ({sql_values(TRACKERS)}),
m AS (SELECT page_id, arg_max(category, length(suffix)) AS category FROM h JOIN r ON h.host = r.suffix OR ends_with(h.host, '.' || r.suffix) GROUP BY 1)
SELECT regexp_extract(url, '^[^:]+://[^/]+/([a-z]+)/', 1) AS lang, count(*) AS pages, count(category) AS tracked, count(*) FILTER (WHERE category = 'Advertising') AS ads FROM pages LEFT JOIN m ON m.page_id = pages.page_id GROUP BY 1""")
def tracker_share_by_country(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id", url_host(F.col("url")).alias("host"), F.regexp_extract("url", "^[^:]+://[^/]+/([a-z]+)/", 1).alias("lang"))
    found = joins.longest_suffix(p, "host", values(spark, "suffix string, vendor string, category string", TRACKERS), "suffix")
    return found.groupBy("lang").agg(F.count("*").alias("pages"), F.count("category").alias("tracked"), F.count_if(F.col("category") == "Advertising").alias("ads"))
