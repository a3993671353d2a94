"""Versions as ordered keys (M6) and version ranges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .bound import bound

_VERSION = (
    r"^\s*v?(?:(\d+)!)?(\d+(?:\.\d+)*)(?:[-_.]?(alpha|a|beta|b|preview|pre|c|rc)[-_.]?(\d*))?"
    r"(?:-(\d+)|[-_.]?(post|rev|r)[-_.]?(\d*))?(?:[-_.]?(dev)[-_.]?(\d*))?(?:\+([a-z0-9]+(?:[-_.][a-z0-9]+)*))?\s*$"
)
#: Stands for the absence of a pre or dev part, which comes after all of them.
_LAST = 9223372036854775807
#: Bounds of a range, with the comparison of the version's key.
BOUNDS = {
    "start_including": lambda v, b: v >= b,
    "start_excluding": lambda v, b: v > b,
    "end_including": lambda v, b: v <= b,
    "end_excluding": lambda v, b: v < b,
}


def version_key(text: Column) -> Column:
    """A struct that orders as the versions do by PEP 440; null if the text is no version.

    Structs and arrays compare field by field, as the specification does: epoch, release without
    trailing zeros, pre-release, post-release, development release, local label.
    """
    low = F.lower(text)
    fields = F.split(F.regexp_replace(low, _VERSION, "\u0001".join(f"${i}" for i in range(1, 11))), "\u0001", -1)
    number = lambda x: F.when(x == "", 0).otherwise(x.try_cast("long"))

    def key(p: Column) -> Column:
        part = lambda i: F.get(p, F.lit(i - 1))
        release = F.transform(F.split(F.regexp_replace(part(2), r"(\.0+)+$", ""), r"\."), lambda x: x.try_cast("long"))
        stage = (
            F.when(part(3).isin("a", "alpha"), 0).when(part(3).isin("b", "beta"), 1).when(part(3) != "", 2)
            .when((part(5) == "") & (part(6) == "") & (part(8) != ""), -1).otherwise(3)
        )
        post = F.when(part(5) != "", part(5).try_cast("long")).when(part(6) != "", number(part(7))).otherwise(-1)
        dev = F.when(part(8) != "", number(part(9))).otherwise(_LAST)
        labels = F.filter(F.split(part(10), "[-_.]"), lambda x: x != "")
        local = F.transform(labels, lambda x: F.struct(F.coalesce(x.try_cast("long"), F.lit(-1)).alias("n"), x.alias("s")))
        whole = F.struct(
            number(part(1)).alias("epoch"), release.alias("release"), stage.alias("stage"), number(part(4)).alias("pre"),
            post.alias("post"), dev.alias("dev"), local.alias("local"),
        )
        return F.when(~F.exists(release, lambda x: x.isNull()), whole)

    # one element, so that the expression is matched once and not once for each field
    return F.when(low.rlike(_VERSION), F.get(F.transform(F.array(fields), key), F.lit(0)))


def sort_key(text: Column) -> Column:
    """The key of a version as a text whose bytes order as versions do; null if the text is no version (M6).

    Numbers stand behind the number of their digits; lists end in a mark that comes before any of
    their members; no key is the beginning of another.
    """
    size = lambda d: F.lpad(F.length(d).cast("string"), 2, "0")
    number = lambda n: bound(n.cast("string"), lambda d: F.concat(size(d), d))

    def encoded(k: Column) -> Column:
        release = F.concat(F.array_join(F.transform(k["release"], number), ""), F.lit("00"))
        post = F.when(k["post"] < 0, "00").otherwise(number(k["post"]))
        dev = F.when(k["dev"] == _LAST, "99").otherwise(number(k["dev"]))
        label = lambda x: F.when(x["n"] < 0, F.concat(F.lit("1"), x["s"], F.lit("!"))).otherwise(F.concat(F.lit("2"), number(x["n"]), x["s"], F.lit("!")))
        local = F.concat(F.array_join(F.transform(k["local"], label), ""), F.lit("0"))
        return F.concat(number(k["epoch"]), release, (k["stage"] + 1).cast("string"), number(k["pre"]), post, dev, local)

    return bound(version_key(text), lambda k: F.when(k.isNotNull(), encoded(k)))


#: Comes after every key, and behind a key before all others that come after it.
_AFTER = "~"


def key_intervals(ranges: Column) -> Column:
    """array<struct(low, high)> of the ranges that have a bound and are readable, in order and apart: a version lies in one at most, if low <= its sort_key < high."""

    def interval(r: Column) -> Column:
        keys = F.struct(*(sort_key(r[b]).alias(b) for b in BOUNDS), F.lit(True).alias("there"))
        given = F.coalesce(*(r[b] for b in BOUNDS)).isNotNull()

        def of(k: Column) -> Column:
            good = given
            for b in BOUNDS:
                good = good & (r[b].isNull() | k[b].isNotNull())
            after = lambda b: F.concat(k[b], F.lit(_AFTER))
            low = F.greatest(F.coalesce(k["start_including"], F.lit("")), F.coalesce(after("start_excluding"), F.lit("")))
            high = F.least(F.coalesce(after("end_including"), F.lit(_AFTER)), F.coalesce(k["end_excluding"], F.lit(_AFTER)))
            return F.when(good, F.struct(low.alias("low"), high.alias("high")))

        return bound(keys, of)

    found = F.filter(F.transform(ranges, interval), lambda x: x.isNotNull() & (x["low"] < x["high"]))
    none = F.array().cast("array<struct<low:string,high:string>>")

    def joined(done: Column, x: Column) -> Column:
        last = F.element_at(done, -1)
        longer = F.struct(last["low"].alias("low"), F.greatest(last["high"], x["high"]).alias("high"))
        return F.when((F.size(done) > 0) & (x["low"] <= last["high"]), F.array_append(F.slice(done, F.lit(1), F.size(done) - 1), longer)).otherwise(F.array_append(done, x))

    return F.aggregate(F.array_sort(found), none, joined)


def has_bound(ranges: Column) -> Column:
    """Whether any range has any bound."""
    return F.exists(ranges, lambda r: F.coalesce(*(r[b] for b in BOUNDS)).isNotNull())


def keyed_ranges(ranges: Column) -> Column:
    """Ranges with the keys of their bounds, and `good`: whether there is a bound and all are readable."""

    def keyed(r: Column) -> Column:
        keys = {b: version_key(r[b]) for b in BOUNDS}
        readable = F.coalesce(*(r[b] for b in BOUNDS)).isNotNull()
        for b in BOUNDS:
            readable = readable & (r[b].isNull() | keys[b].isNotNull())
        return F.struct(*(k.alias(b) for b, k in keys.items()), readable.alias("good"))

    return F.transform(ranges, keyed)


def key_in_any(key: Column, ranges: Column) -> Column:
    """Whether a version's key lies in one of the keyed ranges."""

    def holds(r: Column) -> Column:
        out = r["good"]
        for b, fits in BOUNDS.items():
            out = out & (r[b].isNull() | F.coalesce(fits(key, r[b]), F.lit(False)))
        return out

    return F.coalesce(key.isNotNull() & F.exists(ranges, holds), F.lit(False))


def in_any_range(version: Column, ranges: Column) -> Column:
    """Whether a version lies in one of the ranges.

    A range without bounds holds nothing, and one with an unreadable bound neither. Where many
    versions meet the same ranges, keep the keys of both as columns and use `key_in_any`.
    """
    return key_in_any(version_key(version), keyed_ranges(ranges))
