"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    bin_packing, grid_order_join, language_id, license_scan, line_dedup, minhash_join, periodic_runs, rule_ensemble, seed_decontamination, sentencepiece_codec, token_store, url_reputation,
    whitening,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """The place of a public tokenizer's file on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_grid_order_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid_order_join.near_duplicates(_table(spark, sf_dir, "embeddings"), threshold=0.9)


def op2_seed_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seed_decontamination.overlaps(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


#: The rules of the pages contract.
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def op3_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's outcome is the label of the same number: bad if toxic or of quality 0."""
    labels = _table(spark, sf_dir, "labels")
    bad = F.when((F.col("toxic") == 1) | (F.col("quality") == 0), 1).otherwise(0)
    outcomes = labels.where("toxic is not null or quality is not null").select(F.col("doc_id").alias("id"), bad.alias("bad"))
    return url_reputation.judge(_table(spark, sf_dir, "pages"), outcomes, RULES)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_table(spark, sf_dir, "documents"), license_scan.templates(spark))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third of the ids whose crc32 leaves the remainder 1 is held out of the fit."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    docs = _table(spark, sf_dir, "documents")
    model = language_id.fit(docs.where(fold != 1))
    out = language_id.predict(docs, model)
    return out.select("doc_id", F.coalesce(fold == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "accepted")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.drop_repeated_lines(_table(spark, sf_dir, "documents"), min_docs=10, least_chars=1)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op7_sentencepiece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode(_table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op8_bin_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bin_packing.shard_by_bytes(_table(spark, sf_dir, "documents"), shards=40)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op9_minhash_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_join.near_duplicates(_table(spark, sf_dir, "documents"), words=5, similarity=0.75)


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.store_and_read(_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end_id=2, by_word=True)


def op11_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of the third of the ids whose crc32 leaves the remainder 1 are held out of the fit."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    counted = rule_ensemble.statistics(_table(spark, sf_dir, "documents"))
    model = rule_ensemble.fit(counted, _table(spark, sf_dir, "labels").where(fold != 1))
    return rule_ensemble.score(counted, model).withColumn("held_out", F.coalesce(fold == 1, F.lit(False)))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"), components=16)


def with_cycles(docs: DataFrame) -> DataFrame:
    """doc_id and text, in which one text of ten, by the crc32 of its id, repeats a stretch from some word on to its end."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "")
    rows = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(h % 10 == 0, words).alias("w"))
    rows = rows.withColumn("n", F.size("w")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    rows = rows.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    cycle = F.slice("w", (F.col("a") + 1).cast("int"), F.col("p").cast("int"))
    times = F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")
    rest = F.slice(F.flatten(F.array_repeat(cycle, times)), F.lit(1), (F.col("n") - F.col("a")).cast("int"))
    cycled = F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a").cast("int")), rest), " ")
    return rows.select("doc_id", F.when(F.col("a").isNotNull(), cycled).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.collapse(with_cycles(_table(spark, sf_dir, "documents")))
    top = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    return found.withColumn("top", top).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("top.start")).alias("start"),
        F.col("top.length").alias("length"),
        (-F.col("top.period")).alias("period"),
        F.floor(1000 * F.col("top.length") / -F.col("top.period")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_grid_order_join": op1_grid_order_join,
    "op2_seed_decontamination": op2_seed_decontamination,
    "op3_url_reputation": op3_url_reputation,
    "op4_license_scan": op4_license_scan,
    "op5_language_id": op5_language_id,
    "op6_line_dedup": op6_line_dedup,
    "op7_sentencepiece_codec": op7_sentencepiece_codec,
    "op8_bin_packing": op8_bin_packing,
    "op9_minhash_join": op9_minhash_join,
    "op10_token_store": op10_token_store,
    "op11_rule_ensemble": op11_rule_ensemble,
    "op12_embedding_whitening": op12_embedding_whitening,
    "op13_periodic_runs": op13_periodic_runs,
}

LINES_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
k AS (
  SELECT doc_id, pos, line, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(f.key) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE f.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN f ON k.key = f.key GROUP BY doc_id
"""

NEAR_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (
  SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE
         list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' '))) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS id, doc_id AS root FROM documents UNION SELECT e.b, r.root FROM r JOIN both_ways e ON e.a = r.id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.root AS component_id, d.doc_id = c.root AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT id, min(root) AS root FROM r GROUP BY id) c ON c.id = d.doc_id
"""

VECTORS_SQL = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
ok AS (
  SELECT vec_id, x FROM v WHERE len(x) > 0 AND len(list_filter(x, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0
  AND len(list_filter(x, lambda c: c <> 0)) > 0),
e AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE list_dot_product(a.x, b.x) / sqrt(list_dot_product(a.x, a.x) * list_dot_product(b.x, b.x)) >= 0.9),
r AS (SELECT vec_id AS id, vec_id AS root FROM v UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id),
c AS (SELECT id, min(root) AS root FROM r GROUP BY id),
n AS (SELECT a, count(*) AS n FROM e GROUP BY a)
SELECT v.vec_id, coalesce(n.n, 0) AS n_links, c.root AS component_id, v.vec_id = c.root AS kept
FROM v JOIN c ON c.id = v.vec_id LEFT JOIN n ON n.a = v.vec_id
"""

#: Without seeds: every word that text and item have in common counts on its diagonal, and every window is summed up.
#: A window of most equal words may begin at an equal word, or ends with the diagonal, where the frame is cut short.
SEEDS_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS h FROM documents),
t AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS g FROM benchmark),
a AS (SELECT doc_id, len(h) AS nh, unnest(h) AS word, generate_subscripts(h, 1) AS p FROM w),
b AS (SELECT item_id, len(g) AS ng, least(20, len(g)) AS n_words, unnest(g) AS word, generate_subscripts(g, 1) AS q FROM t),
e AS (SELECT doc_id, item_id, n_words, p - q AS shift, q FROM a JOIN b USING (word) WHERE least(ng, nh - (p - q)) - greatest(0, q - p) >= n_words),
d AS (SELECT doc_id, item_id, shift FROM e GROUP BY ALL HAVING 100 * count(*) >= 75 * max(n_words)),
x AS (
  SELECT doc_id, item_id, n_words, count(*) OVER (PARTITION BY doc_id, item_id, shift ORDER BY q RANGE BETWEEN CURRENT ROW AND (n_words - 1) FOLLOWING) AS n_equal
  FROM e SEMI JOIN d USING (doc_id, item_id, shift))
SELECT doc_id, item_id, n_words, max(n_equal) AS n_equal FROM x
WHERE 100 * n_equal >= CASE WHEN n_words < 5 THEN 100 ELSE 75 END * n_words GROUP BY ALL
"""

RULES_SQL = r"""
WITH p AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
s AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
k AS (SELECT doc_id, max(CASE WHEN toxic = 1 OR quality = 0 THEN 1 ELSE 0 END) AS bad FROM labels
      WHERE toxic IS NOT NULL OR quality IS NOT NULL GROUP BY doc_id),
h AS (SELECT host, count(bad) AS n, coalesce(sum(bad), 0) AS bad, string_split(host, '.') AS l
      FROM s LEFT JOIN k ON k.doc_id = page_id GROUP BY host),
d AS (SELECT *, len(l) >= 3 AND length(l[-1]) = 2 AND l[-2] IN ('ac', 'co', 'com', 'edu', 'gov', 'net', 'org') AS two FROM h),
t AS (SELECT host, n, bad, array_to_string(CASE WHEN two THEN l[-3:] ELSE l[-2:] END, '.') AS domain,
      CASE WHEN two THEN array_to_string(l[-2:], '.') WHEN len(l) > 1 THEN l[-1] ELSE '' END AS suffix FROM d),
m AS (SELECT (sum(bad) + 0.5::DOUBLE) / (sum(n) + 1.0::DOUBLE) AS c FROM t),
s0 AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, any_value(c) AS c FROM t, m GROUP BY suffix),
s1 AS (SELECT 1 / greatest(0.001, least(0.5, coalesce(sum((bad - n * c) ** 2 - n * c * (1 - c)) / nullif(sum(n * (n - 1) * c * (1 - c)), 0), 0.001))) - 1 AS w FROM s0),
s2 AS (SELECT suffix, (bad + w * c) / (n + w) AS c FROM s0, s1),
d0 AS (SELECT domain, sum(n) AS n, sum(bad) AS bad, any_value(c) AS c FROM t JOIN s2 USING (suffix) GROUP BY domain, suffix),
d1 AS (SELECT 1 / greatest(0.001, least(0.5, coalesce(sum((bad - n * c) ** 2 - n * c * (1 - c)) / nullif(sum(n * (n - 1) * c * (1 - c)), 0), 0.001))) - 1 AS w FROM d0),
d2 AS (SELECT domain, (bad + w * c) / (n + w) AS c FROM d0, d1),
h0 AS (SELECT host, n, bad, c FROM t JOIN d2 USING (domain)),
h1 AS (SELECT 1 / greatest(0.001, least(0.5, coalesce(sum((bad - n * c) ** 2 - n * c * (1 - c)) / nullif(sum(n * (n - 1) * c * (1 - c)), 0), 0.001))) - 1 AS w FROM h0),
h2 AS (SELECT host, (bad + w * c) / (n + w) AS mean, n + w AS w FROM h0, h1),
rules(verdict, rule) AS (VALUES ('allow', 'com/'), ('block', 'example.com/en/'), ('allow', 'www.example.com/en/'), ('block', 'net/es/'), ('block', 'net/fr/')),
f AS (
  SELECT page_id, rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC) AS k FROM s JOIN rules
  ON (host = string_split(rule, '/')[1] OR ends_with(host, '.' || string_split(rule, '/')[1])) AND starts_with(path, substr(rule, strpos(rule, '/'))))
SELECT s.page_id, s.host, path, f.rule,
       coalesce(f.verdict, CASE WHEN mean - 1.645 * sqrt(mean * (1 - mean) / (w + 1)) > 0.5 THEN 'block' ELSE 'allow' END) AS verdict,
       round(mean, 6) AS bad_rate
FROM s JOIN h2 USING (host) LEFT JOIN f ON f.page_id = s.page_id AND f.k = 1
"""

#: Periods with a point of the grid at which the first and last of the words come again are tried at every word; a cyclic redundancy check is
#: taken bit by bit.
RUNS_SQL = r"""
WITH k AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
         list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
           lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)), lambda v, i: xor(v >> 1, (v & 1) * 3988292384))) AS crc
  FROM documents),
h AS (SELECT doc_id, ws, len(ws) AS n, xor(crc, 4294967295) AS h, xor(crc, 4294967295) // 10 AS g FROM k),
s AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN g % n END AS a FROM h),
t AS (SELECT doc_id, n, i, ws[CASE WHEN a IS NULL OR i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END + 1] AS word
      FROM (SELECT *, unnest(range(n)) AS i FROM s)),
e AS MATERIALIZED (SELECT doc_id, n, i, dense_rank() OVER (ORDER BY word) AS w, word FROM t),
d AS (SELECT DISTINCT doc_id, n FROM e WHERE n >= 6),
q AS (SELECT doc_id, n, unnest(range(1, n // 4 + 1)) AS q FROM d),
g AS (SELECT doc_id, q, unnest(range(0, n - 2 * q + 1, 2 * q)) AS g FROM q),
f AS (SELECT DISTINCT g.doc_id, q FROM g
      JOIN e a ON a.doc_id = g.doc_id AND a.i = g.g JOIN e b ON b.doc_id = g.doc_id AND b.i = g.g + q AND b.w = a.w
      JOIN e c ON c.doc_id = g.doc_id AND c.i = g.g + q - 1 JOIN e z ON z.doc_id = g.doc_id AND z.i = g.g + 2 * q - 1 AND z.w = c.w),
m AS (SELECT f.doc_id, q, a.i, a.i - row_number() OVER (PARTITION BY f.doc_id, q ORDER BY a.i) AS island
      FROM f JOIN e a ON a.doc_id = f.doc_id JOIN e b ON b.doc_id = f.doc_id AND b.i = a.i + q AND b.w = a.w),
r AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM m GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(6, 4 * q)),
u AS (SELECT doc_id, start, length, min(q) AS period FROM r GROUP BY ALL),
o AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines,
      arg_max({'start': start, 'length': length, 'period': period}, {'l': length, 's': -start, 'p': -period}) AS top FROM u GROUP BY doc_id),
c AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM e
      WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.doc_id = e.doc_id AND e.i >= u.start + u.period AND e.i < u.start + u.length) GROUP BY doc_id)
SELECT s.doc_id, coalesce(n_runs, 0) AS n_runs, top.start AS start, top.length AS length, top.period AS period, 1000 * top.length // top.period AS exponent_milli,
       sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM s LEFT JOIN o ON o.doc_id = s.doc_id LEFT JOIN c ON c.doc_id = s.doc_id
"""


def _license_sql() -> str:
    """Every window of every template's length is compared exactly, without bands."""
    rows = ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in license_scan.TEMPLATES.items())
    split = "list_filter(regexp_split_to_array(lower(coalesce({}, '')), '[^a-z0-9]+'), lambda x: x <> '')"
    grams = "list_transform(range(1, len({0}) - 3), lambda i: array_to_string({0}[i:i+4], ' '))"
    return f"""
WITH l(license, body) AS (VALUES {rows}),
lw AS (SELECT license, {split.format("body")} AS g FROM l),
t AS (SELECT license, len(g) AS len, list_distinct({grams.format("g")}) AS t, greatest(1, (len(g) - 4) // 8) AS stride FROM lw),
dw AS (SELECT doc_id, {split.format("text")} AS h FROM documents),
ds AS (SELECT doc_id, len(h) AS n, unnest(range(len(h) - 4)) AS p, unnest({grams.format("h")}) AS s FROM dw WHERE len(h) >= 5),
hits AS (SELECT doc_id, n, license, len, stride, p, s, len(t) AS n_shingles FROM ds JOIN (SELECT *, unnest(t) AS s FROM t) USING (s)),
w AS (
  SELECT DISTINCT doc_id, license, unnest(range(greatest(0, CAST(ceil((p - (len - 5)) / stride) AS BIGINT)), greatest(greatest(0, CAST(ceil((p - (len - 5)) / stride) AS BIGINT)), p // stride) + 1)) AS w
  FROM hits),
c AS (
  SELECT doc_id, license, w, n_shingles, count(DISTINCT s) AS n_matched FROM w JOIN hits USING (doc_id, license)
  WHERE p >= greatest(0, (w - 1) * stride) AND p + 5 <= least(n, (w + 1) * stride + len) GROUP BY ALL)
SELECT doc_id, license, n_shingles, max(n_matched) AS n_matched FROM c WHERE 100 * n_matched >= 75 * n_shingles GROUP BY ALL
"""


ORACLE_SQL: dict[str, str] = {"op3_url_reputation": RULES_SQL, "op4_license_scan": _license_sql(), "op2_seed_decontamination": SEEDS_SQL, "op1_grid_order_join": VECTORS_SQL, "op6_line_dedup": LINES_SQL, "op9_minhash_join": NEAR_SQL, "op13_periodic_runs": RUNS_SQL}
