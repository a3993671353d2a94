"""Text measures, validators, tokens and small text conversions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .bound import bound
from .values import (
    BUILD_NAMES,
    CONSTANT_STARTS,
    METHOD_STARTS,
    NAME_ENDS,
    NAME_STARTS,
    NO_SECRETS,
    RESOURCE_STARTS,
    RUNS_OF_SIGNS,
    SECRET_TIERS,
    SENSITIVE_NAMES,
    TOKEN_PREFIXES,
    TOKEN_STOPWORDS,
    WEBSOCKET_GUID,
)


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(text: Column) -> Column:
    """Luhn check of the digits of a text; false without any (M3)."""
    return F.coalesce((digits(text) != "") & F.call_function("luhn_check", digits(text)), F.lit(False))


#: Distinct characters up to which each is counted by itself.
FEW_CHARACTERS = 256


def entropy(text: Column) -> Column:
    """Shannon entropy of the characters in bits; 0 for null and empty texts (M2).

    Each character is counted by what its removal takes from the text. A text of very many different
    ones is sorted instead, and its runs are gone over once.
    """
    bits = lambda k, n: k / n * F.log2(k / n)

    def by_character(t: Column, n: Column, chars: Column) -> Column:
        return F.aggregate(chars, F.lit(0.0), lambda a, c: a - bits((n - F.char_length(F.replace(t, c, F.lit("")))).cast("double"), n))

    def by_runs(t: Column, n: Column) -> Column:
        run = lambda k: F.when(k > 0, bits(k, n)).otherwise(0.0)
        state = lambda sum_, last, k: F.struct(sum_.alias("sum"), last.alias("last"), k.alias("run"))
        step = lambda a, c: F.when(a["last"] == c, state(a["sum"], a["last"], a["run"] + 1)).otherwise(state(a["sum"] - run(a["run"]), c, F.lit(1.0)))
        return F.aggregate(F.array_sort(F.split(t, "")), state(F.lit(0.0), F.lit(""), F.lit(0.0)), step, lambda a: a["sum"] - run(a["run"]))

    def of(s: Column) -> Column:
        t, n, chars = s["t"], s["n"], s["chars"]
        return F.when(F.size(chars) <= FEW_CHARACTERS, by_character(t, n, chars)).otherwise(by_runs(t, n))

    facts = lambda t: F.struct(t.alias("t"), F.char_length(t).cast("double").alias("n"), F.array_distinct(F.split(t, "")).alias("chars"))
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, 0.0).otherwise(bound(text, lambda t: bound(facts(t), of)))


def is_e164(text: Column) -> Column:
    """`+` and 6 to 15 digits, white space, hyphens and brackets aside (M4)."""
    return F.regexp_replace(text, r"[\s\-()]", "").rlike(r"^\+\d{6,15}$")


def is_email(text: Column) -> Column:
    return text.rlike(r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$")


def is_uuid(text: Column) -> Column:
    """With or without hyphens and braces, as common parsers accept."""
    return F.regexp_replace(text, r"[{}-]", "").rlike("^[0-9a-fA-F]{32}$")


def within(text: Column, limit: float) -> Column:
    """Whether the number at the end of the text, `name=` aside, lies within +-limit (M5)."""
    number = F.regexp_extract(text, r"(-?\d+(?:\.\d+)?)$", 1).try_cast("double")
    return F.coalesce(F.abs(number) <= limit, F.lit(False))


def collapse_spaces(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def cleaned_keyword(text: Column, rules: list[tuple[str, str]], otherwise: Column) -> Column:
    """The name of the first rule (keyword, name) whose keyword the lower-cased text contains."""
    low = F.lower(text)
    return F.coalesce(*(F.when(F.contains(low, F.lit(k)), name) for k, name in rules), otherwise)


def vendor_name(text: Column, rules: list[tuple[str, str]]) -> Column:
    """A vendor's usual name, else its first word; empty for blank and `unknown`."""
    first = F.split(F.trim(text), r"\s+")[0]
    blank = F.coalesce(F.trim(text), F.lit("")).isin("", "Unknown", "unknown")
    return F.when(blank, "").otherwise(cleaned_keyword(text, rules, first))


def search_tokens(*texts: Column) -> Column:
    """Sorted distinct search tokens of identifiers and names.

    Texts are cut at `:`, `.`, `/` and spaces, and the pieces at `-` and `_` as well; what names no
    product is left out, and a piece with `-` or `_` also appears with the other.
    """
    pieces = F.flatten(F.array(*(F.split(F.lower(F.coalesce(t, F.lit(""))), "[:./ ]+") for t in texts)))
    parts = F.concat(pieces, F.flatten(F.transform(pieces, lambda p: F.split(p, r"[-_\s]+"))))
    real = F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: (p != "") & ~p.isin(*TOKEN_PREFIXES, *TOKEN_STOPWORDS))
    swapped = F.concat(real, F.transform(real, lambda p: F.translate(p, "-", "_")), F.transform(real, lambda p: F.translate(p, "_", "-")))
    return F.array_sort(F.array_distinct(swapped))


def camel_words(text: Column) -> Column:
    """`getLastLocation` to `get`, `Last`, `Location` (P20)."""
    return F.split(text, r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])")


def duration(seconds: Column) -> Column:
    """`1h 2m 3s`, `2m 3s` or `3s` (M9)."""
    s = F.floor(seconds).cast("int")
    h, m, r = F.floor(s / 3600), F.floor(s / 60) % 60, s % 60
    return (
        F.when(h > 0, F.format_string("%dh %dm %ds", h, m, r)).when(m > 0, F.format_string("%dm %ds", m, r)).otherwise(F.format_string("%ds", r))
    )


def _any(tests: list[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def plausible_secret(text: Column, high_entropy: Column | bool = True) -> Column:
    """Whether a matched text may be a secret (F8).

    Words for nothing, ids and runs of signs, keys that are public, constants and resources of apps
    and names of code are none. A match for its entropy alone (high_entropy) also needs a digit,
    three kinds of characters, 3.8 bits a character, and few separators.
    """
    v = F.trim(text)
    low, up = F.lower(v), F.upper(v)
    has = lambda c, x: F.contains(c, F.lit(x))
    starts = lambda c, xs: _any([F.startswith(c, F.lit(x)) for x in xs])
    count = lambda pattern: F.regexp_count(v, F.lit(pattern))
    alphabet = _any([has(low if x[0].isalpha() else v, x) for x in RUNS_OF_SIGNS])
    public = has(v, "-----BEGIN ") | up.rlike("BEGIN (CERTIFICATE|PUBLIC KEY|RSA PRIVATE KEY)")
    constant = starts(up, CONSTANT_STARTS) | has(up, "ACTION_") | has(up, "PERMISSION") | has(low, "android.intent") | starts(low, ["action.", "android.permission"]) | up.isin(BUILD_NAMES)
    resource = starts(v, ["R.", "@"]) | has(low, "res/") | starts(low, NAME_STARTS + RESOURCE_STARTS) | v.rlike("^u[0-9a-fA-F]{4}")
    name = has(v, "__") | (count("_") >= 3) | _any([F.endswith(low, F.lit(x)) for x in NAME_ENDS]) | F.endswith(v, F.lit("_"))
    method = starts(low, METHOD_STARTS) & v.rlike(r"\p{Lu}") & (count(r"\p{Nd}") < 3)
    uuid = v.rlike("^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$") | (up == WEBSOCKET_GUID)
    none = (v == "") | low.isin(NO_SECRETS) | uuid | alphabet | public | constant | resource | name | method
    kinds = sum((v.rlike(p).cast("int") for p in (r"\p{Ll}", r"\p{Lu}", r"\p{Nd}", r"[^\p{L}\p{N}]")), F.lit(0))
    separated = (count(r"\.") > 1) | (count("/") > 1) | v.rlike("[;$]")
    mixed = v.rlike(r"\p{Nd}") & (kinds >= 3) & ~v.rlike("^[A-Z0-9_]+$") & ~separated & (entropy(v) >= 3.8)
    only_mixed = F.lit(high_entropy) if isinstance(high_entropy, bool) else high_entropy
    return F.coalesce(~none & (~only_mixed | mixed), F.lit(False))


def secret_tier(name: Column, value: Column) -> Column:
    """struct(tier, label) of a value of manifest meta-data, null for one that is no secret.

    The first pattern that fits says which; else a value of 16 characters or more under a name that
    credentials have is a possible credential.
    """
    kind = lambda tier, label: F.struct(F.lit(tier).alias("tier"), F.lit(label).alias("label"))
    fits = [F.when(value.rlike(p), kind(tier, label)) for tier, p, label in SECRET_TIERS]
    named = _any([F.contains(F.lower(name), F.lit(x)) for x in SENSITIVE_NAMES]) & (F.length(value) >= 16)
    return F.coalesce(*fits, F.when(named, kind("possible_credential", "sensitive_meta_key")))


def plausible_version(text: Column) -> Column:
    """Dotted digits, neither zero nor a file name or resource reference."""
    return F.coalesce(text.rlike(r"^\d+(\.\d+)+([-+.][0-9A-Za-z.-]+)?$") & ~text.rlike(r"^[0.]+$|\.(xml|json|txt|so|dex)$|^@"), F.lit(False))


def plain_confidence(text: Column) -> Column:
    """high, medium or low."""
    up = F.upper(text)
    return F.when(up.isin("VERY_HIGH", "HIGH"), "high").when(up == "MEDIUM", "medium").otherwise("low")
