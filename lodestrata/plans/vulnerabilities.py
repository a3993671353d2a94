"""Which apps have which known-vulnerable components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bound import bound
from ..functions.strings import search_tokens
from ..functions.versions import key_intervals, sort_key, version_key
from ..operators.joins import expanded_aliases, token_candidates
from ..operators.merges import first_seen
from ..tables import written

# Tokens that products of an identifier prefix are also listed under.
ALIASES = {
    "com.google.firebase": ["firebase", "firebase_android_sdk"],
    "com.google.android.gms": ["google_play_services", "play_services"],
    "com.facebook": ["facebook", "facebook_android_sdk", "android_sdk"],
    "com.squareup.okhttp3": ["okhttp"],
    "com.squareup.retrofit2": ["retrofit"],
    "com.google.code.gson": ["gson"],
    "com.unity3d.ads": ["unity", "unity_ads"],
    "com.applovin": ["applovin"],
    "com.bytedance.sdk": ["pangle", "bytedance"],
    "com.mbridge": ["mbridge", "mintegral"],
}


def without_family(sdks: DataFrame, family: str) -> DataFrame:
    """sdks without those whose identifier begins with the family's name and a dot, or whose name contains it."""
    starts = F.coalesce(F.startswith("sdk_identifier", F.lit(f"{family}.")), F.lit(False))
    return sdks.where(~starts & ~F.coalesce(F.contains(F.lower("sdk_name"), F.lit(family)), F.lit(False)))


def with_tokens(sdks: DataFrame, aliases: dict[str, list[str]] = ALIASES) -> DataFrame:
    """sdks with `tokens` of the identifier and the name, aliases among them."""
    names = sdks.select("sdk_identifier", "sdk_name").distinct()
    each = names.withColumn("tokens", search_tokens(F.col("sdk_identifier"), F.col("sdk_name")))
    table = sdks.sparkSession.createDataFrame(list(aliases.items()), "starts string, also array<string>")
    each = expanded_aliases(each, "sdk_identifier", "tokens", table).toDF("_identifier", "_name", "tokens")
    same = sdks["sdk_identifier"].eqNullSafe(each["_identifier"]) & sdks["sdk_name"].eqNullSafe(each["_name"])
    return sdks.join(each, same).drop("_identifier", "_name")


#: What makes a component, of whichever app; rows about components that each task may hold whole; and rows of apps that a task takes on.
_OWN, MOST_HELD, TASK_ROWS = ["sdk_identifier", "sdk_name", "sdk_version"], 1_000_000, 100_000


def _same(sdks: DataFrame, kinds: DataFrame, by: list[str]) -> DataFrame:
    """sdks with the other columns of kinds, whose components are distinct; null parts are equal."""
    named = kinds.select(*(F.col(c).alias(f"_k_{c}") for c in by), *(c for c in kinds.columns if c not in by))
    same = F.lit(True)
    for c in by:
        same = same & sdks[c].eqNullSafe(named[f"_k_{c}"])
    return sdks.join(_held(named, kinds), same).drop(*(f"_k_{c}" for c in by))


def _held(df: DataFrame, table: DataFrame) -> DataFrame:
    """df, for each task to hold whole if its written table has few rows."""
    return F.broadcast(df) if table.count() <= MOST_HELD else df


def _components(sdks: DataFrame) -> tuple[DataFrame, list[str]]:
    """(kind, *key, tokens) of the distinct components of sdks, numbered and written, and the key: their tokens, if given, are part of it."""
    given = "tokens" in sdks.columns
    by = [*_OWN, "tokens"] if given else _OWN
    # written, as the steps of the tokens would each go through all rows of sdks again
    each = written(sdks.select(*by).distinct(), "components")
    return written((each if given else with_tokens(each)).withColumn("kind", F.monotonically_increasing_id()), "kinds"), by


def _entries(kinds: DataFrame, cves: DataFrame) -> DataFrame:
    """(place, entry, kind, sdk_identifier, sdk_name, sdk_version, cve_id, vendor, product, severity, score, published): the entries of each
    component, each once, by the first product by name; places go by product, vendor, name and version, and `entry` numbers cve_id. Written."""
    keys = written(kinds.select("sdk_version").distinct().withColumn("version_key", sort_key(F.col("sdk_version"))), "keys").where("version_key is not null")
    spread = kinds.join(keys, "sdk_version").withColumn("token", F.explode("tokens"))
    bounded = written(cves.where(F.col("product").isNotNull()).withColumn("intervals", key_intervals(F.col("version_ranges"))).drop("version_ranges"), "intervals")
    listed = bounded.withColumn("range", F.explode("intervals")).drop("intervals")
    # intervals are tried once for each product and version, however many components have them
    tried = written(spread.select("token", "sdk_version", "version_key").distinct(), "versions").withColumn("asked", F.struct("token", "sdk_version"))
    fits = (F.col("version_key") >= F.col("range.low")) & (F.col("version_key") < F.col("range.high"))
    held = token_candidates(tried.withColumn("tokens", F.array("token")), "asked", "tokens", listed, "product", ["cve_id", "vendor", "product"], fits)
    held = held.select("asked.sdk_version", "token", "cve_id", "vendor", "product", "severity", "score", "published")
    first = first_seen(spread.select("kind", *_OWN, "token").join(held, ["token", "sdk_version"]), ["kind", "cve_id"], ["product", "vendor"])
    # a sorted table numbers its rows in order
    placed = first.orderBy("product", "vendor", "sdk_name", "sdk_version", "kind", "cve_id").withColumn("place", F.monotonically_increasing_id())
    number = F.min("place").over(Window.partitionBy("cve_id")).alias("entry")
    return written(placed.select("place", number, "kind", *_OWN, "cve_id", "vendor", "product", "severity", "score", "published"), "entries")


def matches(sdks: DataFrame, cves: DataFrame) -> DataFrame:
    """(sample_id, sdk_identifier, sdk_name, sdk_version, cve_id, vendor, product, severity, score, published): one row for each
    sample, identifier and entry (J9, J10, A40). Of several products, the first by name counts.

    sdks are gone through twice, so they are best given as a written table; they need no `tokens`,
    which are worked out for each distinct component then. Only (sample_id, numbers of the component and
    its identifier) is shuffled: entries meet the rows of a sample where they are, so that no pair is moved.
    Rows are grouped and not pairs; the entries of components are compared only where a sample has an
    identifier in several forms, and there a component keeps those that it is the first to have.
    """
    kinds, by = _components(sdks)
    held = _entries(kinds, cves)
    lists = held.groupBy("kind").agg(F.min("sdk_identifier").alias("_of"), F.collect_list(F.struct("entry", "place")).alias("entries"))
    number = F.min("kind").over(Window.partitionBy("_of")).alias("of")
    lists = written(lists.select("kind", number, "entries"), "lists")
    listed = kinds.join(_held(lists.select("kind", "of"), lists), "kind")
    rows = _same(sdks, written(listed.select("kind", "of", *by), "listed"), by).select("sample_id", "of", "kind")
    # each row meets several entries, so that the size of the rows says little about the work
    rows = rows.repartition(-(-sdks.count() // TASK_ROWS) or 1, "sample_id").distinct()
    forms = rows.join(_held(lists.select("kind", "entries"), held), "kind").groupBy("sample_id", "of").agg(F.collect_list(F.struct("kind", "entries")).alias("forms"))
    kept = F.when(F.size("forms") > 1, _first_places(F.col("forms.entries")))
    met = forms.select("sample_id", F.explode("forms.kind").alias("kind"), kept.alias("kept")).join(_held(held, held), "kind")
    found = met.where(F.col("kept").isNull() | F.array_contains("kept", F.col("place")))
    return found.select("sample_id", "sdk_identifier", "sdk_name", "sdk_version", "cve_id", "vendor", "product", "severity", "score", "published")


def _first_places(lists: Column) -> Column:
    """The first place of each entry in lists of (entry, place)."""
    first = lambda x: lambda e, i: (i == 0) | (e["entry"] != F.get(x, i - 1)["entry"])
    return bound(F.array_sort(F.flatten(lists)), lambda x: F.filter(x, first(x))["place"])


def judged(sdks: DataFrame, cves: DataFrame) -> DataFrame:
    """`outcomes` of sdks and of what `matches` finds for them, without the pairs.

    Whether a component matches is known of each distinct one. Rows are compared only where another
    version of the same identifier in the same sample may have matched.
    """
    kinds, by = _components(sdks)
    held = _entries(kinds, cves)
    hit = held.select(F.col("kind").alias("_kind")).distinct().withColumn("_hit", F.lit(True))
    marked = kinds.join(_held(hit, held), F.col("kind") == F.col("_kind"), "left")
    own = _outcome(F.col("_hit"), F.lit(None))
    marked = written(marked.select(*by, own.alias("outcome")), "outcomes")
    mixed = marked.groupBy(F.col("sdk_identifier").alias("_i")).agg(F.bool_or(F.col("outcome").isNull()).alias("some"), F.bool_or(F.coalesce(F.col("outcome") == "matched", F.lit(False))).alias("hit"))
    mixed = written(mixed.where("some and hit").select("_i", F.lit(True).alias("_mixed")), "mixed")
    rows = _same(sdks, marked, by)
    if mixed.isEmpty():
        return rows.fillna("no_nvd_entry", ["outcome"])
    rows = rows.join(_held(mixed, mixed), F.col("sdk_identifier").eqNullSafe(F.col("_i")), "left").drop("_i")
    asked = F.col("outcome").isNull() & F.col("_mixed").isNotNull()
    settled, open_ = rows.where(~asked).fillna("no_nvd_entry", ["outcome"]), rows.where(asked)
    there = rows.where((F.col("outcome") == "matched") & F.col("_mixed")).select(F.col("sample_id").alias("_s"), F.col("sdk_identifier").alias("_i"))
    same = F.col("sample_id").eqNullSafe(F.col("_s")) & F.col("sdk_identifier").eqNullSafe(F.col("_i"))
    asked_of = open_.select("sample_id", "sdk_identifier").distinct()
    saved = asked_of.join(there, same, "left_semi").select(F.col("sample_id").alias("_s"), F.col("sdk_identifier").alias("_i"), F.lit("matched").alias("_found"))
    open_ = open_.join(saved, same, "left").withColumn("outcome", F.coalesce("_found", F.lit("no_nvd_entry")))
    return settled.drop("_mixed").unionByName(open_.select(*sdks.columns, "outcome"))


def _outcome(hit: Column, otherwise: Column) -> Column:
    return (
        F.when(F.coalesce(F.trim("sdk_version"), F.lit("")) == "", "no_version")
        .when(version_key(F.col("sdk_version")).isNull(), "parse_error")
        .when(hit, "matched")
        .otherwise(otherwise)
    )


def outcomes(sdks: DataFrame, found: DataFrame) -> DataFrame:
    """sdks with `outcome`: no_version, parse_error, matched or no_nvd_entry (A34), by whether a match exists."""
    hit = found.select(F.col("sample_id").alias("_s"), F.col("sdk_identifier").alias("_i")).distinct().withColumn("_hit", F.lit(True))
    joined = sdks.join(hit, F.col("sample_id").eqNullSafe(F.col("_s")) & F.col("sdk_identifier").eqNullSafe(F.col("_i")), "left")
    return joined.select(*sdks.columns, _outcome(F.col("_hit"), F.lit("no_nvd_entry")).alias("outcome"))


def app_summary(found: DataFrame) -> DataFrame:
    """(sample_id, matches, cves, components, worst_score) of each app with matches.

    The entries and components of an app are sets of its own: two counts of distinct values would
    write every match out three times.
    """
    number = lambda c: F.size(F.collect_set(c)).cast("long")
    return found.groupBy("sample_id").agg(F.count("*").alias("matches"), number("cve_id").alias("cves"), number("sdk_identifier").alias("components"), F.max("score").alias("worst_score"))
