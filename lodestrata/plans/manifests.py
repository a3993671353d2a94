"""From decoded apps to component, permission, library and finding tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.android import effective_backup, effective_cleartext, effective_export, filter_flags, name_form, permission_facts, qualified_name, scheme_kind, tri_state
from ..functions.ids import short_id
from ..functions.strings import luhn, plausible_version, secret_tier
from ..functions.values import PERMISSION_FAMILIES
from ..operators.joins import best_contained, resolve_name
from ..operators.matching import endpoints, personal_data_in_fields, secrets, string_constants
from ..operators.merges import count_where, merged_components, merged_findings
from ..sources.documents import KINDS, components, evidence, meta_data, permissions
from ..sources.files import package_prefixes

RANKS = {"high": 3, "medium": 2, "low": 1}


def component_table(parsed: DataFrame) -> DataFrame:
    """Declared components with effective export, name form and filter flags."""
    own = components(parsed)
    export = effective_export(F.col("exported"), F.col("kind"), F.size("filters"), F.col("target"))
    flags = filter_flags(F.col("filters"))
    return own.select(
        "*", export["exported"].alias("exported_effective"), export["violation"].alias("export_violation"), name_form(F.col("name")).alias("name_form"),
        qualified_name(F.col("name"), F.col("package")).alias("qualified_name"), flags["launcher"].alias("launcher"), flags["browsable"].alias("browsable"), flags["verified"].alias("verified"),
    )


def app_table(parsed: DataFrame) -> DataFrame:
    """One row per manifest: identity, effective switches, and counts of components, permissions, deep links, queries and secrets."""
    target = F.col("m.`uses-sdk`.`_android:targetSdkVersion`").try_cast("int")
    backup, source = effective_backup(tri_state(F.col("m.application.`_android:allowBackup`"), F.lit(None)))
    clear = effective_cleartext(tri_state(F.col("m.application.`_android:usesCleartextTraffic`"), F.lit(None)), target)
    asked = lambda field, part: F.flatten(F.transform(F.coalesce(F.col("m.queries"), F.array()), lambda q: F.coalesce(q[field][f"_android:{part}"], F.array().cast("array<string>"))))
    filled = lambda xs: F.size(F.filter(xs, lambda x: F.coalesce(x, F.lit("")) != ""))
    intents = F.aggregate(F.coalesce(F.col("m.queries"), F.array()), F.lit(0), lambda n, q: n + F.coalesce(F.size(F.coalesce(q["intent"], F.array())), F.lit(0)))
    base = parsed.select(
        "sample_id", "sha256", "readable", F.col("m._package").alias("package"), target.alias("target"), backup.alias("backup"), source.alias("backup_source"), clear.alias("cleartext"),
        filled(asked("package", "name")).alias("queries_package_count"), intents.alias("queries_intent_count"), filled(asked("provider", "authorities")).alias("queries_provider_count"),
    )
    for part in (component_counts(component_table(parsed)), permission_counts(permissions(parsed)), secret_counts(meta_data(parsed))):
        base = base.join(part, "sample_id", "left")
    return base.fillna(0)


def component_counts(own: DataFrame) -> DataFrame:
    """Components by kind, exported ones, missing export values, browsable ones and deep links by kind of scheme, by sample."""
    exported, kind, filters = F.col("exported_effective"), F.col("kind"), F.size("filters")
    schemes = F.filter(F.flatten(F.transform("filters", lambda f: F.transform(f["data"], lambda d: d["scheme"]))), lambda s: F.coalesce(s, F.lit("")) != "")
    kinds = F.transform("schemes", scheme_kind)
    links = lambda k: F.sum(F.when(kind.startswith("activity"), F.size(F.filter("scheme_kinds", lambda x: x == k)) if k else F.size("schemes")).otherwise(0))
    rows = own.withColumn("schemes", schemes).withColumn("scheme_kinds", kinds)
    return rows.groupBy("sample_id").agg(
        F.count("*").alias("components"),
        *count_where({f"{k.replace('-', '_')}_count": kind == k for k in KINDS}),
        *count_where({
            "exported_count": exported, "exported_activities": exported & kind.startswith("activity"), "exported_services": exported & (kind == "service"),
            "exported_receivers": exported & (kind == "receiver"), "exported_providers": exported & (kind == "provider"),
            "exported_receivers_no_perm": exported & (kind == "receiver") & (F.coalesce("permission", F.lit("")) == ""), "violations": F.col("export_violation"),
            "exported_with_filter": exported & (filters > 0), "exported_with_custom_scheme": exported & F.array_contains("scheme_kinds", "custom"), "browsable_count": F.col("browsable"),
        }),
        links("").alias("deep_links"), *(links(k).alias(f"deep_links_{k}") for k in ("custom", "https", "http", "market")),
    )


def permission_counts(rows: DataFrame) -> DataFrame:
    """Requested permissions, each once, in all, by family, dangerous and custom ones; declared ones by kind; by sample."""
    facts = permission_facts(F.col("name"))
    once = rows.where("record like 'requested%'").select("sample_id", "name").distinct().select("sample_id", facts.alias("p"))
    families = {f: F.col("p.family") == f for f in [*PERMISSION_FAMILIES, "perm_other"]}
    asked = once.groupBy("sample_id").agg(
        F.count("*").alias("permissions"), *count_where({"custom_permissions": F.col("p.custom"), "dangerous_permissions": F.col("p.dangerous"), "sandbox_permissions": F.col("p.sandbox"), **families})
    )
    level = F.lower(F.coalesce("level", F.lit("normal")))
    kind = F.col("record")
    declared = rows.groupBy("sample_id").agg(*count_where({
        "declared_permissions": kind == "declared", "declared_groups": kind == "declared_group", "declared_trees": kind == "declared_tree",
        "declared_signature": (kind == "declared") & level.contains("signature"), "declared_normal": (kind == "declared") & (level == "normal"),
    }))
    return declared.join(asked, "sample_id", "left").fillna(0)


def secret_counts(rows: DataFrame) -> DataFrame:
    """Values of meta-data by tier of secret, by sample."""
    tier = secret_tier(F.col("name"), F.col("value"))["tier"]
    real = rows.where("coalesce(value, '') <> ''").withColumn("tier", tier)
    return real.groupBy("sample_id").agg(*count_where({f"secret_{t}_count": F.col("tier") == t for t in ("public_id", "sensitive_token", "possible_credential")}))


def detected_rows(detected: DataFrame) -> DataFrame:
    """Rows of a detector (sample_id, name, package, version_hint, source, evidence) as rows of the library table, with their ids.

    A hint becomes the version if it looks like one; its confidence is high then, else none.
    """
    good = plausible_version(F.col("version_hint"))
    version = F.when(good, F.col("version_hint")).otherwise("")
    return detected.select(
        "sample_id", short_id(F.col("sample_id"), F.col("name"), F.col("package"), version).alias("sdk_id"), F.col("name").alias("sdk_name"), F.col("package").alias("sdk_prefix"),
        version.alias("sdk_version"), F.when(good, "high").otherwise("none").alias("sdk_version_confidence"), (F.col("source") == "manifest").alias("in_manifest"),
        (F.col("source") == "smali").alias("in_code"), F.col("evidence").alias("evidence_value"), F.lit(1).alias("evidence_count"),
    )


def sdk_table(parsed: DataFrame, files: DataFrame, catalog: DataFrame, aliases: DataFrame) -> DataFrame:
    """(sample_id, sdk_id, sdk_name, in_manifest, in_code, evidence_count, source): libraries that manifests or code show.

    catalog (name, prefix, pos), aliases (alias, name, pos).
    """
    declared = evidence(parsed).select("sample_id", "value", F.lit("manifest").alias("source"))
    code = package_prefixes(files).select("sample_id", F.col("prefix").alias("value"), F.lit("smali").alias("source"))
    found = best_contained(declared.unionByName(code), "value", catalog.select(F.col("name").alias("sdk"), "prefix", "pos"), "prefix", "pos").where("sdk is not null")
    named = resolve_name(found.drop("prefix", "pos"), "sdk", catalog, aliases)
    order = F.row_number().over(Window.partitionBy("sample_id", "resolved").orderBy("source", "value"))
    rows = named.select(
        "sample_id", F.col("resolved").alias("sdk_name"), (F.col("source") == "manifest").alias("in_manifest"), (F.col("source") == "smali").alias("in_code"),
        F.lit(1).alias("evidence_count"), F.lit(None).cast("string").alias("version"), "source", order.alias("pos"),
    )
    merged = merged_components(rows, ["sample_id", "sdk_name"], ["in_manifest", "in_code"], ["evidence_count"], "version", "source", "pos")
    return merged.withColumn("sdk_id", short_id(F.col("sample_id"), F.col("sdk_name"), F.col("version")))


#: Which scanners go over which layer of an app: code is scanned for what it calls, its string constants for what they say.
LAYERS = {"endpoint": ["constants", "resource"], "pii": ["code", "resource"], "secret": ["constants", "resource"]}


def layered(files: DataFrame) -> DataFrame:
    """(sample_id, file, layer, text) of files (sample_id, path, kind, text): code twice, as it is and as its string constants; what else has text is a resource."""
    code = F.col("kind") == "smali"
    constants = string_constants(F.col("text"))
    parts = F.when(code, F.array(F.struct(F.lit("code").alias("layer"), F.col("text").alias("text")), F.struct(F.lit("constants").alias("layer"), constants.alias("text"))))
    parts = F.coalesce(parts, F.array(F.struct(F.lit("resource").alias("layer"), F.col("text").alias("text"))))
    spread = files.where("text is not null").select("sample_id", F.col("path").alias("file"), F.explode(parts).alias("p"))
    return spread.select("sample_id", "file", "p.layer", "p.text").where("text <> ''")


def findings(texts: DataFrame, rules: DataFrame) -> DataFrame:
    """Endpoints, personal data and secrets of texts (sample_id, file, layer, text), one row per sample, kind and value.

    Each scanner goes over its LAYERS, and over texts of no known layer.
    """
    key = ["sample_id", "file", "layer"]
    known = sorted({x for xs in LAYERS.values() for x in xs})
    of = lambda scanner: texts.where(F.col("layer").cast("string").isin(LAYERS[scanner]) | ~F.col("layer").cast("string").isin(known))
    hosts = endpoints(of("endpoint"), key, "text").select(*key, F.lit("endpoint").alias("kind"), F.col("host").alias("value"), F.col("kind").alias("subtype"), "confidence")
    personal = personal_data_in_fields(of("pii"), key, {"text": "text"}).select(*key, F.lit("pii").alias("kind"), "value", F.col("pattern_name").alias("subtype"), F.lit("high").alias("confidence"))
    secret = secrets(of("secret"), key, "text", rules).select(*key, F.lit("secret").alias("kind"), "value", F.col("pattern_id").alias("subtype"), "confidence")
    every = hosts.unionByName(personal).unionByName(secret)
    rank = F.element_at(F.create_map(*(x for k, v in RANKS.items() for x in (F.lit(k), F.lit(v)))), F.col("confidence"))
    details = F.create_map(F.lit("luhn"), luhn(F.col("value")).cast("string"), F.lit("subtype"), F.col("subtype"))
    rows = every.select("*", rank.alias("rank"), details.alias("details"), F.col("value").alias("snippet"), F.struct("file", "subtype").alias("pos"))
    return merged_findings(rows, ["sample_id", "kind", "value"], "file", "rank", "layer", "pos", "details", "subtype", "snippet")
