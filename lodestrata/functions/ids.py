"""Deterministic ids and their renderings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rendered(c: Column, boolean: bool = False) -> Column:
    """A value as text, with `None` for null, and True or False for booleans. concat_ws would skip nulls."""
    if boolean:
        return F.when(c, "True").when(~c, "False").otherwise("None")
    return F.coalesce(c.cast("string"), F.lit("None"))


def short_id(*parts: Column) -> Column:
    """The first 16 hex digits of the SHA-256 of the parts joined by `|`."""
    return F.substring(F.sha2(F.concat_ws("|", *(rendered(p) for p in parts)), 256), 1, 16)


#: The URL namespace of name-based UUIDs.
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def uuid5(name: Column) -> Column:
    """The name-based SHA-1 UUID of a URL."""
    digest = F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE)), F.encode(name, "utf-8")))
    at = lambda i, n: F.substring(digest, i, n)
    variant = F.lower(F.hex(F.conv(at(17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat(at(1, 8), F.lit("-"), at(9, 4), F.lit("-5"), at(14, 3), F.lit("-"), variant, at(18, 3), F.lit("-"), at(21, 12))


def short_md5(text: Column) -> Column:
    """The first 8 hex digits of a text's MD5 (M1)."""
    return F.substring(F.md5(text.cast("binary")), 1, 8)


def stamped(columns: dict[str, str]) -> list[Column]:
    """Constants of a run, as columns."""
    return [F.lit(v).alias(k) for k, v in columns.items()]


def sorted_json(entries: Column) -> Column:
    """A map as a JSON text with its keys in order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(entries))))


def iso_time(epoch: Column) -> Column:
    """Epoch seconds as an ISO-8601 UTC text (K5, M10); the session's time zone is UTC."""
    return F.date_format(F.timestamp_micros((epoch * 1_000_000).cast("long")), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def region_of(country: Column, regions: dict[str, list[str]]) -> Column:
    """Region of a country code: empty for none, `other` for one that no region has."""
    code = F.upper(F.trim(F.coalesce(country, F.lit(""))))
    out = F.when(code == "", "")
    for region, codes in regions.items():
        out = out.when(code.isin(codes), region)
    return out.otherwise("other")
