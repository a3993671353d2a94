import itertools
import uuid

import pytest
from packaging.version import InvalidVersion, Version
from pyspark.sql import functions as F

from lodestrata.functions import android, feeds, ids, net, strings, versions

VERSIONS = [
    "1.0", "1.0.0", "1", "1.0rc1", "1.0a2", "1.0b1", "1.0.post1", "1.0.dev1", "1.0a1.dev2", "2!0.1", "1.10", "1.9.9", "v2.0", "1.0-3", "1.0+local.1",
    "1.0+local.2", "1.0+abc", "0", "0.0.0", "1.0.post2.dev1", "20.4.1", "21.0.0", "not-a-version", "", "1..2", "1.0c3",
]


def parsed(text):
    try:
        return Version(text)
    except InvalidVersion:
        return None


def test_versions_order_as_specified(spark):
    pairs = [p for p in itertools.product(VERSIONS, repeat=2)]
    df = spark.createDataFrame(pairs, "a string, b string")
    a, b = versions.version_key(F.col("a")), versions.version_key(F.col("b"))
    for r in df.select("a", "b", (a < b).alias("lt"), (a == b).alias("eq")).collect():
        x, y = parsed(r.a), parsed(r.b)
        if x is None or y is None:
            assert r.lt is None
        else:
            assert (r.lt, r.eq) == (x < y, x == y), (r.a, r.b)


@pytest.mark.parametrize(
    ("version", "ranges", "hit"),
    [
        ("20.4.1", [("20.0.0", None, None, "21.0.0")], True),
        ("21.0.0", [("20.0.0", None, None, "21.0.0")], False),
        ("20.0.0", [(None, "20.0.0", None, None)], False),
        ("5.0.0", [(None, None, None, "6.2.2")], True),
        ("5.0.0", [], False),
        ("5.0.0", [(None, None, None, None)], False),
        ("1.5.0", [("1.0", None, None, "2.0"), ("3.0", None, "4.0", None)], True),
        ("2.5.0", [("1.0", None, None, "2.0"), ("3.0", None, "4.0", None)], False),
        ("1.0", [("bad bound", None, None, None)], False),
        (None, [("1.0", None, None, None)], False),
    ],
)
def test_ranges(spark, version, ranges, hit):
    kind = "v string, r array<struct<start_including:string,start_excluding:string,end_including:string,end_excluding:string>>"
    df = spark.createDataFrame([(version, ranges)], kind)
    assert df.select(versions.in_any_range(F.col("v"), F.col("r"))).first()[0] is hit


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x"))).first()[0]


def test_ids(spark):
    import hashlib

    got = spark.range(1).select(ids.short_id(F.lit("a"), F.lit(None).cast("string"), F.lit(3))).first()[0]
    assert got == hashlib.sha256(b"a|None|3").hexdigest()[:16]
    name = "privacy-api://android/x"
    assert one(spark, ids.uuid5, name) == str(uuid.uuid5(uuid.NAMESPACE_URL, name))
    assert one(spark, ids.iso_time, 1.5, "double") == "1970-01-01T00:00:01.500000Z"


@pytest.mark.parametrize(
    ("check", "value", "good"),
    [
        (strings.luhn, "4111 1111 1111 1111", True),
        (strings.luhn, "4111111111111112", False),
        (strings.luhn, "", False),
        (strings.luhn, None, False),
        (strings.is_e164, "+14155552671", True),
        (strings.is_e164, "14155552671", False),
        (strings.is_email, "user@example.com", True),
        (strings.is_email, "user@example", False),
        (strings.is_uuid, "{550e8400-e29b-41d4-a716-446655440000}", True),
        (lambda c: strings.within(c, 90), "lat=12.5", True),
        (lambda c: strings.within(c, 90), "lat=99.5", False),
        (strings.plausible_version, "4.12.0", True),
        (strings.plausible_version, "0.0", False),
        (net.is_private, "10.0.0.1", True),
        (net.is_private, "8.8.8.8", False),
        (net.is_private, "172.31.255.255", True),
        (net.is_private, None, True),
        (net.is_private, "bad", True),
        (net.is_private, "224.0.0.1", True),
        (net.is_private, "::1", True),
        (net.is_ip, "2001:db8::1", True),
        (net.is_ip, "example.com", False),
        (net.is_probe, "www.example.com", True),
        (net.is_probe, "notexample.com", False),
        (net.plausible_domain, "api.example.com", True),
        (net.plausible_domain, "android.app.com", False),
        (net.plausible_domain, "1.2.3.com", False),
        (net.plausible_domain, "file.xmlx", False),
    ],
)
def test_checks(spark, check, value, good):
    assert one(spark, check, value) is good


def test_entropy(spark):
    assert one(spark, strings.entropy, "abcd") == 2.0
    assert one(spark, strings.entropy, "") == 0.0
    assert one(spark, strings.entropy, None) == 0.0


def test_names(spark):
    parts = lambda h: tuple(one(spark, net.suffix_parts, h))
    assert parts("a.b.example.co.uk") == ("a.b", "example.co.uk", "co.uk")
    assert parts("Example.com.") == ("", "example.com", "com")
    assert parts("8.8.8.8") == ("", "", "") == parts(None)
    assert parts("localhost") == ("", "", "localhost")
    low, bits = spark.range(1).select(net.block_key(F.lit("192.168.2.10/24")).alias("b")).select("b.*").first()
    assert (low, bits) == ("0" * 20 + "ffffc0a80200", 120)


def test_products_and_scores(spark):
    assert tuple(one(spark, feeds.product_of, "cpe:2.3:a:google:firebase_android_sdk:*:*")) == ("google", "firebase_android_sdk")
    assert tuple(one(spark, feeds.product_of, r"cpe:2.3:a:a\:b:c\-d:1")) == ("a:b", "c-d")
    assert tuple(one(spark, feeds.product_of, "broken")) == (None, None)


def test_manifest_facts(spark):
    rows = [(None, "provider", 1, 31), (None, "activity", 0, 31), (None, "activity", 1, 31), (None, "activity", 1, 30), (True, "activity", 0, 31)]
    df = spark.createDataFrame(rows, "e boolean, k string, f int, t int")
    got = [tuple(r[0]) for r in df.select(android.effective_export(F.col("e"), F.col("k"), F.col("f"), F.col("t"))).collect()]
    assert got == [(None, False), (False, False), (None, True), (True, False), (True, False)]
    assert one(spark, lambda c: android.effective_cleartext(F.lit(None).cast("boolean"), c), 27, "int") is True
    assert one(spark, lambda c: android.effective_cleartext(F.lit(None).cast("boolean"), c), 28, "int") is False
    assert one(spark, lambda c: android.effective_cleartext(F.lit(None).cast("boolean"), c), None, "int") is None
    assert one(spark, android.class_to_package, "Lcom/a/B;") == "com.a.B"
    assert tuple(one(spark, android.signature_parts, "a.b.C.m(int)")) == ("a.b", "C", "m")


def test_tokens(spark):
    got = one(spark, lambda c: strings.search_tokens(c, F.lit("Firebase-Core SDK")), "com.google.firebase:firebase-core")
    assert got == ["firebase", "firebase-core", "firebase_core"]
    assert one(spark, strings.search_tokens, None) == []


def test_tokens_keep_their_digits(spark):
    """The place of a piece is not taken for characters to cut off."""
    from lodestrata.functions.strings import search_tokens

    names = " ".join(f"lib{i}" for i in range(12))
    row = spark.range(1).select(search_tokens(F.lit(names)).alias("t")).first()
    assert set(row.t) == {f"lib{i}" for i in range(12)}


def test_secret_tiers(spark):
    from lodestrata.functions.strings import secret_tier

    rows = [("x", "ca-app-pub-1~2"), ("x", "fb1234567890"), ("x", "a" * 32), ("x", "AKIA" + "A" * 16), ("my.api_key", "q" * 16), ("my.api_key", "q" * 15), ("x", "q" * 16), (None, None)]
    got = spark.createDataFrame(rows, "n string, v string").select(secret_tier(F.col("n"), F.col("v"))["label"].alias("l")).collect()
    assert [r.l for r in got] == ["admob_id", "facebook_app_id", "hex_token_32", "aws_access_key", "sensitive_meta_key", None, None, None]
