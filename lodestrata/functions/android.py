"""Facts of app manifests. Booleans are tri-state: null means that nothing is known."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import BROWSABLE, DANGEROUS_PERMISSIONS, KNOWN_SCHEMES, LAUNCHER, MAIN_ACTION, PERMISSION_FAMILIES, SANDBOX_PERMISSIONS


def tri_state(plain: Column, qualified: Column) -> Column:
    """An attribute given plainly or with a namespace; null where it is missing."""
    return F.lower(F.coalesce(plain, qualified)) == "true"


def effective_backup(explicit: Column) -> tuple[Column, Column]:
    """Backups are on unless said otherwise; with the source of the value (P10)."""
    return F.coalesce(explicit, F.lit(True)), F.when(explicit.isNull(), "default").otherwise("explicit")


def effective_cleartext(explicit: Column, target: Column) -> Column:
    """Cleartext traffic is on up to target 27, off from 28, unknown without a target (P10)."""
    return F.coalesce(explicit, F.when(target >= 28, False).when(target.between(1, 27), True))


def effective_export(explicit: Column, kind: Column, filters: Column, target: Column) -> Column:
    """struct(exported, violation) of a component.

    An explicit value counts; without one, a provider's is unknown, a component without filters is
    not exported, and one with filters is exported up to target 30; from 31 on the value is
    required, and its absence a violation.
    """
    due = explicit.isNull() & (kind != "provider") & (filters > 0) & (target >= 31)
    exported = F.coalesce(explicit, F.when(kind == "provider", F.lit(None)).when(filters == 0, False).when(target >= 31, F.lit(None)).otherwise(True))
    return F.struct(exported.cast("boolean").alias("exported"), F.coalesce(due, F.lit(False)).alias("violation"))


def name_form(name: Column) -> Column:
    """relative, simple or fully_qualified."""
    return F.when(F.startswith(name, F.lit(".")), "relative").when(~F.contains(name, F.lit(".")), "simple").otherwise("fully_qualified")


def qualified_name(name: Column, package: Column) -> Column:
    """A component's full class name."""
    form = name_form(name)
    return F.when(form == "relative", F.concat(package, name)).when(form == "simple", F.concat_ws(".", package, name)).otherwise(name)


def scheme_kind(scheme: Column) -> Column:
    """http, https, market, known (schemes of the system) or custom."""
    return F.when(scheme.isin("http", "https", "market"), scheme).when(scheme.isin(KNOWN_SCHEMES), "known").otherwise("custom")


def filter_flags(filters: Column) -> Column:
    """struct(launcher, browsable, verified) of array<struct(actions, categories, auto_verify)>."""
    launcher = lambda f: F.array_contains(f["actions"], MAIN_ACTION) & F.array_contains(f["categories"], LAUNCHER)
    return F.struct(
        F.exists(filters, launcher).alias("launcher"),
        F.exists(filters, lambda f: F.array_contains(f["categories"], BROWSABLE)).alias("browsable"),
        F.exists(filters, lambda f: F.coalesce(f["auto_verify"], F.lit(False))).alias("verified"),
    )


def permission_family(name: Column) -> Column:
    """The family of a permission, perm_other for those of none."""
    out = F.coalesce(*(F.when(name.isin([f"android.permission.{x}" for x in xs]), family) for family, xs in PERMISSION_FAMILIES.items()))
    return F.coalesce(out, F.lit("perm_other"))


def is_dangerous(name: Column) -> Column:
    """Whether users are asked for a permission."""
    return name.isin([f"android.permission.{x}" for x in DANGEROUS_PERMISSIONS])


def permission_facts(name: Column) -> Column:
    """struct(family, namespace, standard, custom, sandbox, dangerous) of a permission's name."""
    standard = F.startswith(name, F.lit("android.permission."))
    return F.struct(
        permission_family(name).alias("family"),
        F.when(F.startswith(name, F.lit("android.")), "android").otherwise("custom").alias("namespace"),
        standard.alias("standard"),
        (~standard).alias("custom"),
        name.isin(list(SANDBOX_PERMISSIONS)).alias("sandbox"),
        is_dangerous(name).alias("dangerous"),
    )


def class_to_package(descriptor: Column) -> Column:
    """`Lcom/a/b;` or `smali/com/a/B.smali` to a dotted name."""
    bare = F.regexp_replace(F.regexp_replace(descriptor, r"^L(.*);$", "$1"), r"^smali(?:_classes\d+)?/|\.smali$", "")
    return F.translate(bare, "/", ".")


def signature_parts(signature: Column) -> Column:
    """struct(package, class, method) of `a.b.C.m(x)`: cut at the last dots before the bracket."""
    path = F.substring_index(signature, "(", 1)
    grab = lambda i: F.regexp_extract(path, r"^(?:(.*)\.)?([^.]+)\.([^.]+)$", i)
    return F.struct(grab(1).alias("package"), grab(2).alias("class"), grab(3).alias("method"))
