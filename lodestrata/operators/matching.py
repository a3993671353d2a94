"""Text mining: keywords, personal data, secrets, endpoints and rule patterns."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.net import IPV4, plausible_domain, plausible_endpoint
from ..functions.strings import is_e164, is_email, is_uuid, luhn, plausible_secret, plausible_version, within
from ..functions.values import PII_HINTS, PII_PATTERNS
from .grams import containing
from .joins import as_literals

#: Checks of matched text by name.
VALIDATORS = {
    "luhn": luhn,
    "email": is_email,
    "ipv4": lambda x: x.rlike(IPV4),
    "e164": is_e164,
    "latitude": lambda x: within(x, 90.0),
    "longitude": lambda x: within(x, 180.0),
    "uuid": is_uuid,
}


def keyword_search(df: DataFrame, key: str, text: str, rules: DataFrame) -> DataFrame:
    """(key, token, category, subcategory, first_at, last_at) of each rule token that a text contains, whatever its case.

    rules (token, category, subcategory). Texts and tokens meet by pieces of a few characters;
    positions are those of the first occurrence, counted from 0, the last one inclusive.
    """
    known = rules.select("token", "category", "subcategory").distinct().withColumn("_token", F.lower("token"))
    texts = df.select(F.col(key).alias("_key"), F.lower(text).alias("_text"))
    first = F.instr(F.col("_text"), F.col("_token")).cast("long") - 1
    met = containing(texts, "_text", known, "_token").withColumn("first_at", first)
    return met.select(F.col("_key").alias(key), "token", "category", "subcategory", "first_at", (F.col("first_at") + F.length("_token") - 1).cast("long").alias("last_at"))


def contains_keywords(text: Column, keywords: Sequence[str]) -> Column:
    """Whether a text contains any keyword, whatever its case: the cheap test before costly ones."""
    return F.coalesce(text.rlike("(?i)" + "|".join(re.escape(k) for k in keywords)), F.lit(False))


_EDGE = re.compile(r"^\\b(?=\\\+)")


def personal_data(text: Column, patterns: Sequence[tuple[str, str, str, str | None]] = PII_PATTERNS, hints: str = PII_HINTS) -> Column:
    """array<struct(pattern_name, category, value)> of the personal data in a text.

    All patterns make one expression. At each place the first pattern that fits wins, matches do
    not overlap, and a match that its validator turns down is not tried with later patterns. hints:
    an expression that every text with a match fits, blank for none.
    """
    master = "(?i)" + "|".join(f"(?:{p})" for _, _, p, _ in patterns)

    def classify(value: Column) -> Column:
        out = F.lit(None).cast("struct<pattern_name:string,category:string,value:string>")
        for name, category, pattern, check in reversed(patterns):
            found = F.struct(F.lit(name).alias("pattern_name"), F.lit(category).alias("category"), value.alias("value"))
            good = F.when(VALIDATORS[check](value), found) if check else found
            # where a match begins with a sign, the word's end that has to be before it is not part of it
            out = F.when(value.rlike(f"(?i)^(?:{re.sub(_EDGE, '', pattern)})$"), good).otherwise(out)
        return out

    # a text without any of these holds none of the patterns, and most texts are none the slower for them
    may = F.coalesce(text, F.lit("")).rlike(hints) if hints else F.lit(True)
    matches = F.when(may, F.regexp_extract_all(text, F.lit(master), F.lit(0)))
    return F.coalesce(F.filter(F.transform(matches, classify), lambda m: m.isNotNull()), F.array().cast("array<struct<pattern_name:string,category:string,value:string>>"))


def personal_data_in_fields(df: DataFrame, key: Sequence[str], fields: dict[str, str]) -> DataFrame:
    """(key, location, pattern_name, category, value) over several columns {location: column}, each value once."""
    parts = F.array(*(F.struct(F.lit(loc).alias("location"), F.col(c).cast("string").alias("text")) for loc, c in fields.items()))
    spread = df.select(*key, F.explode(parts).alias("part")).where("part.text is not null")
    found = spread.select(*key, F.col("part.location").alias("location"), F.explode(personal_data(F.col("part.text"))).alias("m"))
    return found.select(*key, "location", "m.pattern_name", "m.category", "m.value").distinct()


def supported_patterns(rules: Sequence[tuple[str, str, str]], spark: SparkSession) -> DataFrame:
    """(pattern_id, regex, severity, supported): whether Spark's regular expressions know the pattern."""
    rows = []
    for ident, pattern, severity in rules:
        try:
            spark._jvm.java.util.regex.Pattern.compile(pattern)
            good = True
        except IllegalArgumentException:  # of which Java's syntax error is one
            good = False
        rows.append((ident, pattern, severity, good))
    return spark.createDataFrame(rows, "pattern_id string, regex string, severity string, supported boolean")


def secrets(df: DataFrame, key: Sequence[str], text: str, rules: DataFrame) -> DataFrame:
    """(key, pattern_id, confidence, value): all matches of all supported patterns; low confidence is left out.

    All matches have to look like secrets, those of `high_entropy_token` the more so (F8). rules is a small table.
    """
    known = as_literals(rules.where("supported and lower(severity) <> 'low'"), "pattern_id", "regex", "severity")
    found = _all_matches(df, key, text, [(ident, regex, F.lit(severity.lower())) for ident, regex, severity in known])
    found = found.select(*key, F.col("id").alias("pattern_id"), F.col("extra").alias("confidence"), "value")
    return found.where(plausible_secret(F.col("value"), F.col("pattern_id") == "high_entropy_token")).distinct()


def _all_matches(df: DataFrame, key: Sequence[str], text: str, patterns: list[tuple[str, str, Column]]) -> DataFrame:
    """(key, id, extra, value): all matches of patterns (id, expression, extra), each a literal that is compiled once."""
    body = F.coalesce(F.col(text), F.lit(""))
    kind = "array<struct<id:string,extra:string,value:string>>"

    def of(ident: str, pattern: str, extra: Column) -> Column:
        found = F.regexp_extract_all(body, F.lit(pattern), F.lit(0))
        return F.transform(found, lambda v: F.struct(F.lit(ident).alias("id"), extra.alias("extra"), v.alias("value")))

    each = [of(*p) for p in patterns]
    every = F.flatten(F.array(*each)) if each else F.array().cast(kind)
    return df.select(*key, F.explode(every).alias("m")).select(*key, "m.id", "m.extra", "m.value")


def rule_patterns(df: DataFrame, key: Sequence[str], text: str, rules: DataFrame) -> DataFrame:
    """(key, rule_id, value): matches of `Class.method` rules, the class optional before the method.

    rules (rule_id, class_name, method_name); an upper-case name without a method is a constant. A
    small table.
    """
    patterns = []
    for ident, name, method in as_literals(rules, "rule_id", "class_name", "method_name"):
        pattern = rf"(?i)(?:{re.escape(name)}[.;>/-]*)?{re.escape(method)}\b" if method else rf"(?i)\b{re.escape(name)}\b"
        patterns.append((ident, pattern, F.lit(None).cast("string")))
    found = _all_matches(df, key, text, patterns)
    return found.select(*key, F.col("id").alias("rule_id"), "value").distinct()


_URL = r"""(?i)\b(?:https?|wss?|ftp)://[^\s"'<>\\)\]]+"""
_ADDRESS = r"\b(?:\d{1,3}\.){3}\d{1,3}(?::\d{1,5})?\b"
_DOMAIN = r"(?i)(?<![/@\w.-])(?:[a-z0-9](?:[a-z0-9-]*[a-z0-9])?\.)+[a-z]{2,}\b"


def endpoints(df: DataFrame, key: Sequence[str], text: str) -> DataFrame:
    """(key, kind, host, confidence): hosts of URLs, bare addresses and bare domains of a text, each once."""
    host = lambda u: F.lower(F.regexp_extract(u, r"^[A-Za-z]+://(?:[^/?#@]*@)?\[?([^/?#:\]]+)", 1))
    found = lambda kind, pattern: F.transform(
        F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(pattern), F.lit(0)), lambda m: F.struct(F.lit(kind).alias("kind"), m.alias("m"))
    )
    every = F.concat(found("url", _URL), found("ip", _ADDRESS), found("domain", _DOMAIN))
    spread = df.select(*key, F.explode(every).alias("e")).select(*key, "e.kind", "e.m")
    name = F.when(F.col("kind") == "url", host(F.col("m"))).when(F.col("kind") == "ip", F.substring_index("m", ":", 1)).otherwise(F.lower("m"))
    good = (
        F.when(F.col("kind") == "url", F.col("host") != "")
        .when(F.col("kind") == "ip", plausible_endpoint(F.col("host"), F.contains("m", F.lit(":"))))
        .otherwise(plausible_domain(F.col("host")))
    )
    out = spread.withColumn("host", name).where(good).withColumn("confidence", F.when(F.col("kind") == "ip", "medium").otherwise("high"))
    return out.select(*key, "kind", "host", "confidence").distinct()


def string_constants(text: Column) -> Column:
    """The string constants of disassembled code, under 1000 characters, one per line."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r'const-string(?:/jumbo)? [vp]\d+, "([^"]*)"'), F.lit(1))
    return F.array_join(F.filter(found, lambda x: F.length(x) < 1000), "\n")


def geo_category(class_name: Column, method: Column, include: Sequence[tuple[str, str]], exclude: Sequence[str]) -> Column:
    """Category of an API by the first keyword in its class or method; null for excluded and other APIs."""
    both = F.lower(F.concat_ws(".", class_name, method))
    out = F.coalesce(*(F.when(F.contains(both, F.lit(k)), c) for k, c in include))
    return F.when(~contains_keywords(both, exclude), out) if exclude else out


def code_text(text: Column) -> Column:
    """Disassembled calls `Class;->method` as `Class.method`, the form of keyword rules."""
    return F.replace(text, F.lit(";->"), F.lit("."))


def api_tokens(apis: DataFrame) -> DataFrame:
    """(token, category, subcategory) rules of APIs: `Class.method`, or `Class` for constructors."""
    token = F.when(F.col("method_name").isin("<init>", ""), F.col("class_name")).otherwise(F.concat_ws(".", "class_name", "method_name"))
    known = apis.where(~F.coalesce(F.lower("category"), F.lit("")).isin("", "unknown"))
    return known.select(token.alias("token"), "category", F.coalesce("subcategory", F.lit("")).alias("subcategory")).distinct()


_NUMBER = r"(\d+(?:\.\d+)+[0-9A-Za-z.+-]*)"
#: Where a version may stand, from the most to the least trusted: (source, file kinds, pattern of one group).
VERSION_PLACES = [
    ("pom", ("pom",), rf"(?:<version>|(?m:^)version=)\s*{_NUMBER}"),
    ("buildconfig", ("smali",), rf'VERSION\w*:Ljava/lang/String; = "{_NUMBER}"'),
    ("const", ("smali",), r'const-string(?:/jumbo)? ([vp]\d+), "VALUE"(?:(?!const-string)[\s\S]){0,200}?sput-object \1, L[^;]+;->\w*VERSION'.replace("VALUE", _NUMBER)),
    ("resource", ("res_values",), rf'name="[^"]*version[^"]*"[^>]*>\s*{_NUMBER}'),
    ("metadata", ("metadata",), rf"(?m:^)(?:version\s*=\s*)?{_NUMBER}\s*$"),
]


def version_candidates(files: DataFrame, text: str = "text") -> DataFrame:
    """(sample_id, path, source, place, version) of files (sample_id, path, kind, text).

    A string constant counts if its register is then stored in a field named for a version. place
    orders the sources by trust, for `merges.best_candidate`.
    """

    def found(place: int, source: str, kinds: Sequence[str], pattern: str) -> Column:
        group = 2 if source == "const" else 1
        values = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(pattern), F.lit(group))
        each = F.transform(values, lambda v: F.struct(F.lit(source).alias("source"), F.lit(place).alias("place"), v.alias("version")))
        return F.when(F.col("kind").isin(*kinds), each).otherwise(F.slice(each, 1, 0))

    every = F.concat(*(found(i, *p) for i, p in enumerate(VERSION_PLACES)))
    spread = files.select("sample_id", "path", F.explode(every).alias("c")).select("sample_id", "path", "c.source", "c.place", "c.version")
    return spread.where(plausible_version(F.col("version"))).distinct()
