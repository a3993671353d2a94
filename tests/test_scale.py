"""Operators that hold hot keys, large rule tables and addresses of both versions, against plain loops."""

import ipaddress
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodestrata import sinks
from lodestrata.functions import net, values, versions
from lodestrata.functions.strings import entropy
from lodestrata.operators import cache, checks, grams, joins, matching, merges, names, ranges, ranks


def plain_private(ip):
    try:
        a = ipaddress.ip_address(ip)
    except ValueError:
        return True
    return a.is_private or a.is_loopback or a.is_multicast or a.is_unspecified or a.is_link_local


def test_address_keys(spark):
    rng = random.Random(2)
    ips = ["", "x", "1.2.3", "1.2.3.4.5", "256.1.1.1", "::", "::1", ":::", "1::2::3", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7::", "::1.2.3.4", "64:ff9b::8.8.8.8", "12345::", "g::", "1:2:3:4:5:6:1.2.3.4", "1:2:3:4:5:6:7:1.2.3.4", "::256.1.1.1", ":1", "1:", None]
    for block in net.PRIVATE_BLOCKS + net.PUBLIC_WITHIN:
        n = ipaddress.ip_network(block)
        kind = ipaddress.IPv4Address if n.version == 4 else ipaddress.IPv6Address
        edges = (int(n.network_address) - 1, int(n.network_address), int(n.broadcast_address), int(n.broadcast_address) + 1)
        ips += [str(kind(x)) for x in edges if 0 <= x < 1 << n.max_prefixlen]
    ips += [str(ipaddress.IPv4Address(rng.getrandbits(32))) for _ in range(200)] + [ipaddress.IPv6Address(rng.getrandbits(128)).exploded for _ in range(100)]
    ip = F.col("ip")
    rows = spark.createDataFrame([(x,) for x in ips], "ip string").select("ip", net.ip_key(ip).alias("k"), net.is_private(ip).alias("p"), net.ip_number(ip).alias("n")).collect()
    for r in rows:
        try:
            a = ipaddress.ip_address(r.ip)
            assert r.k == f"{int(a) + (0xFFFF << 32 if a.version == 4 else 0):032x}" and r.n == (int(a) if a.version == 4 else None)
        except ValueError:
            assert r.k is None and r.n is None
        assert r.p == plain_private(r.ip), r.ip
    mapped = spark.createDataFrame([("::ffff:10.0.0.1",), ("::FFFF:8.8.8.8",), ("fe80::1%eth0",)], "ip string").select(net.is_private(ip), net.ip_key(ip)).collect()
    assert [r[0] for r in mapped] == [True, False, True] and mapped[1][1] == "0" * 20 + "ffff08080808"


@pytest.mark.parametrize("six", [False, True])
def test_address_lookups(spark, monkeypatch, six):
    rng = random.Random(six)
    some = lambda: str(ipaddress.IPv6Address((0x2600 << 112) + rng.getrandbits(12))) if six and rng.random() < 0.7 else str(ipaddress.IPv4Address((8 << 24) + rng.getrandbits(10)))
    probes = [some() for _ in range(200)] + [None, "", "10.0.0.1"]
    df = spark.createDataFrame([(p,) for p in probes], "ip string")
    rules = [(f"{a}/{(128 if ':' in a else 32) - rng.randrange(0, 12)}" if rng.random() < 0.7 else a, i) for i, a in enumerate(some() for _ in range(80))]
    nets = [(ipaddress.ip_network(b, strict=False), i) for b, i in rules]

    def block(ip):
        a = ipaddress.ip_address(ip) if ip else None
        return min(((n.num_addresses > 1, i) for n, i in nets if a and a.version == n.version and a in n), default=(0, None))[1]

    got = {(r.ip, r.pos) for r in joins.cidr_lookup(df, "ip", spark.createDataFrame(rules, "block string, pos int"), "block", "pos").collect()}
    assert got == {(p, block(p)) for p in probes}
    spans = []
    for i in range(120):
        a = ipaddress.ip_address(some())
        spans.append((str(a), str(type(a)(int(a) + rng.choice([0, 1, 5, 50, 300, 5000]))), i))
    spans += [(spans[0][0], spans[0][1], -1), ("8.0.0.9", "8.0.0.1", -2), ("x", "8.0.0.1", -3)]
    key = lambda a: int(a) + (0xFFFF << 32 if a.version == 4 else 0)

    def narrowest(ip):
        if plain_private(ip):
            return None
        at = key(ipaddress.ip_address(ip))
        ends = [(key(ipaddress.ip_address(lo)), key(ipaddress.ip_address(hi)), lo, hi, i) for lo, hi, i in spans if lo != "x"]
        return min(((hi - lo, lo, *rest) for lo, hi, *rest in ends if lo <= at <= hi), default=(None,))[-1]

    table = spark.createDataFrame(spans, "lo string, hi string, id int")
    for rows in (200_000, 50):  # one part, and several with ranges across their borders
        monkeypatch.setattr(ranges, "PART_ROWS", rows)
        got = {(r.ip, r.id) for r in joins.range_lookup(df, "ip", table, "lo", "hi").collect()}
        assert got == {(p, narrowest(p)) for p in probes}


@pytest.mark.parametrize(("literals", "anchors"), [(200, 1 << 20), (0, 1 << 20), (0, 40)])
def test_containing(spark, monkeypatch, literals, anchors):
    monkeypatch.setattr(grams, "LITERALS", literals)
    monkeypatch.setattr(grams, "SLICE", anchors)
    rng = random.Random(1)
    word = lambda low, high: "".join(rng.choice("abcd é漢.") for _ in range(rng.randrange(low, high)))
    texts = [word(0, 60) for _ in range(120)] + [None, "", "x" * 50_000 + "abcd.é"]
    patterns = sorted({word(1, 12) for _ in range(120)})
    got = grams.containing(
        spark.createDataFrame(list(enumerate(texts)), "k int, t string"), "t", spark.createDataFrame([(p,) for p in [*patterns, "", None]], "p string"), "p"
    )
    assert sorted((r.k, r.p) for r in got.collect()) == sorted((k, p) for k, t in enumerate(texts) for p in patterns if t and p in t)


def test_entropy(spark):
    texts = ["", "a", "abab", "😀é漢a", "".join(chr(0x4E00 + i % 700) for i in range(2000)), "the quick brown fox" * 50]
    plain = lambda t: -sum(c / len(t) * math.log2(c / len(t)) for c in Counter(t).values()) if t else 0.0
    rows = spark.createDataFrame([(t,) for t in [*texts, None]], "t string").select("t", entropy(F.col("t")).alias("h")).collect()
    assert all(abs(r.h - plain(r.t)) < 1e-9 for r in rows)


def test_hints_lose_no_personal_data(spark):
    rng = random.Random(3)
    letters = lambda n: "".join(rng.choice("abcdefABCDEF") for _ in range(n))
    texts = [letters(16) for _ in range(20)] + [":".join(letters(2) for _ in range(6)) for _ in range(20)] + ["-".join(letters(2) for _ in range(6)) for _ in range(20)]
    texts += ["-".join(letters(n) for n in (8, 4, 4, 4, 12)) for _ in range(20)] + ["Bearer abc", "eyJab.eyJcd.ef", "ssid=home", "sid=abc", "lat=1.5", "a@b.cd", "tel+491712345678", "plain words only"]
    texts += ["".join(rng.choice("abcdef09:-@=. ") for _ in range(40)) for _ in range(300)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    both = rows.select("t", matching.personal_data(F.col("t")).alias("a"), matching.personal_data(F.col("t"), hints="").alias("b")).collect()
    assert all(r.a == r.b for r in both) and all(r.a for r in both[:80])
    assert {m.pattern_name for r in both for m in r.a} >= {"Android ID", "MAC Address", "UUID", "Bearer Token", "JWT Token", "SSID", "Session ID", "Latitude", "Email Address", "Phone Number"}
    assert values.PII_HINTS


def test_registered_domains(spark):
    rules = ["com", "uk", "co.uk", "*.ck", "!www.ck", "*.kawasaki.jp", "!city.kawasaki.jp", "jp", "// note", ""]
    want = {
        "a.b.example.co.uk": ("a.b", "example.co.uk", "co.uk"), "co.uk": ("", "", "co.uk"), "example.com.": ("", "example.com", "com"), "x.y.ck": ("", "x.y.ck", "y.ck"), "y.ck": ("", "", "y.ck"), "ck": ("", "", "ck"),
        "www.ck": ("", "www.ck", "ck"), "a.www.ck": ("a", "www.ck", "ck"), "a.b.c.kawasaki.jp": ("a", "b.c.kawasaki.jp", "c.kawasaki.jp"), "a.city.kawasaki.jp": ("a", "city.kawasaki.jp", "kawasaki.jp"), "host.unlisted": ("", "host.unlisted", "unlisted"),
        "8.8.8.8": ("", "", ""), "::1": ("", "", ""), "": ("", "", ""), None: ("", "", ""), "localhost": ("", "", "localhost"),
    }
    got = names.registered_domains(spark.createDataFrame([(h,) for h in want], "host string"), "host", spark.createDataFrame([(r,) for r in rules], "rule string"), "rule")
    assert {r.host: (r.subdomain, r.registered_domain, r.suffix) for r in got.collect()} == want


def test_version_keys_order_as_versions(spark):
    rng = random.Random(4)
    part = lambda *xs: rng.choice(xs)

    def version():
        release = ".".join(str(part(0, 0, 1, 2, 9, 10, 99, 100, 12345678901)) for _ in range(rng.randrange(1, 4)))
        return f"{part('', '', '1!')}{release}{part('', '', 'a1', '-beta.2', 'rc', 'c10', 'a')}{part('', '', '.post3', '-4', 'r10')}{part('', '', '.dev1', 'dev20')}{part('', '', '', '+ab.1', '+ab.01', '+ab', '+10.b', '+9')}"

    texts = sorted({version() for _ in range(400)}) + ["junk", "", None]
    v = F.col("v")
    rows = [r for r in spark.createDataFrame([(t,) for t in texts], "v string").select("v", versions.sort_key(v).alias("s"), versions.version_key(v).alias("k")).orderBy("k").collect()]
    known = [r for r in rows if r.k is not None]
    assert len(known) > 300 and all((r.s is None) == (r.k is None) for r in rows)
    for a, b in zip(known[:-1], known[1:], strict=True):
        assert a.s < b.s if a.k != b.k else a.s == b.s, (a.v, b.v)
    keys = {r.s for r in known}
    assert not any(b.startswith(a) for a, b in zip(sorted(keys)[:-1], sorted(keys)[1:], strict=True))


def test_intervals_equal_ranges(spark):
    rng = random.Random(5)
    one = lambda: rng.choice(["1", "1.0", "1.5", "2", "2.0.1", "2rc1", "10", None, None, "junk"])
    rows = [(i, rng.choice(["1", "1.0.0", "1.5", "1.9", "2", "2a1", "2.0.1", "3", "10.post1", "x"]), [(one(), one(), one(), one()) for _ in range(rng.randrange(0, 3))]) for i in range(400)]
    bound = "struct<start_including:string,start_excluding:string,end_including:string,end_excluding:string>"
    df = spark.createDataFrame(rows, f"i int, v string, r array<{bound}>")
    key = versions.sort_key(F.col("v"))
    both = df.withColumn("s", key).withColumn("iv", versions.key_intervals(F.col("r"))).select(
        "i", versions.in_any_range(F.col("v"), F.col("r")).alias("a"), F.coalesce(F.exists("iv", lambda x: (F.col("s") >= x["low"]) & (F.col("s") < x["high"])), F.lit(False)).alias("b")
    )
    got = both.collect()
    assert all(r.a == r.b for r in got) and 20 < sum(r.a for r in got) < 380


def test_bursts_of_a_hot_key(spark):
    rng = random.Random(6)
    rows = [(k, round(rng.random() * 16000) / 4) for k in [1] * 400 + [2] * 30] + [(3, 0.0), (3, 10.0), (3, 20.0), (None, 5.0)]
    df = spark.createDataFrame(rows, "k int, t double").withColumn("ts", F.timestamp_seconds("t"))
    want = []
    for k in (1, 2, 3, None):
        times, burst = sorted(t for x, t in rows if x == k), 0
        for i, t in enumerate(times):
            if i == 0 or round(t - times[i - 1], 6) > 10:
                burst += 1
                want.append([k, burst, 0, t, t])
            want[-1][2] += 1
            want[-1][4] = t
    for slice_ in (86_400, 60, 7):  # slices shorter than a gap, too
        got = merges.bursts(df, ["k"], "ts", 10, slice_).select("k", "burst", "events", F.col("first_seen").cast("double"), F.col("last_seen").cast("double")).collect()
        assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, want), key=repr)


def test_ranks_of_one_group(spark):
    rows = [("a", i % 7, i) for i in range(500)] + [("b", 1, 1), (None, 2, 2), (None, 1, 3)] + [("a", 3, 3)] * 5
    df = spark.createDataFrame(rows, "g string, o int, i int").repartition(3)
    got = ranks.ranked(df, ["g"], ["o", "i"], "n").collect()
    for g in ("a", "b", None):
        own = sorted((r.n, r.o, r.i) for r in got if r.g == g)
        assert [n for n, _, _ in own] == list(range(1, len(own) + 1)) and [x[1:] for x in own] == sorted((o, i) for x, o, i in rows if x == g)
    assert {r.rule_id for r in ranks.numbered(df, "g", ["o", "i"]).where("g = 'b'").collect()} == {"b_1"}


def test_blank_keys_are_rejected_apart(spark):
    df = spark.createDataFrame([("", i) for i in range(50)] + [("x", 60), ("x", 55), ("y", 70), (None, 80), (None, 81)], "id string, pos int")
    got = {r.pos: r.reject for r in checks.rejected(df, {"no_id": F.col("id") == ""}, ["id"], "pos").collect()}
    assert all(got[i] == "no_id" for i in range(50)) and [got[p] for p in (55, 60, 70, 80, 81)] == [None, "duplicate", None, None, "duplicate"]


def test_publication_is_whole(spark, tmp_path):
    root, a, b = str(tmp_path / "out"), spark.range(5), spark.range(7)
    first = sinks.tables({"a": a, "b": b}, root, {})
    broken = b.select(F.raise_error(F.lit("lost")).alias("id"))
    with pytest.raises(Exception, match="lost"):
        sinks.tables({"a": a.limit(1), "b": broken}, root, {})
    with pytest.raises(ValueError, match="check failed: few"):
        sinks.tables({"a": a.limit(1), "b": b}, root, {"few": lambda f: f["a"].groupBy().count().where("count < 3")})
    assert (sinks.current(spark, root, "a").count(), sinks.current(spark, root, "b").count()) == (5, 7)
    assert [p.name for p in (tmp_path / "out" / "versions").iterdir()] == [first.rsplit("/", 1)[1]]
    for n in (8, 9, 10):
        sinks.tables({"a": spark.range(n), "b": b}, root, {}, form="csv")
    assert sinks.current(spark, root, "a", "csv", a.schema).count() == 10 and len(list((tmp_path / "out" / "versions").iterdir())) == 2


def test_results_are_kept_by_content(spark, tmp_path):
    path, seen = str(tmp_path / "kept"), []

    def work(new):
        seen.append(sorted(r.text for r in new.collect()))
        return new.select("input_hash", F.length("text").alias("size"), F.upper("text").alias("big"))

    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "bc"), (4, None)], "i int, text string")
    run = lambda rows, version="1": sorted(map(tuple, cache.with_results(rows, ["text"], work, "size int, big string", path, version).collect()))
    work_on_text = [(1, "a", 1, "A"), (2, "a", 1, "A"), (3, "bc", 2, "BC")]
    assert run(df.where("i < 4")) == work_on_text and run(df.where("i < 4")) == work_on_text
    more = run(spark.createDataFrame([(5, "bc"), (6, "new")], df.schema))
    assert more == [(5, "bc", 2, "BC"), (6, "new", 3, "NEW")]
    run(df.where("i = 1"), "2")
    assert seen == [["a", "bc"], [], ["new"], ["a"]]
    with pytest.raises(Exception, match="tool"):
        cache.with_results(spark.createDataFrame([(7, "late")], df.schema), ["text"], lambda n: n.select("input_hash", F.raise_error(F.lit("tool")).cast("int").alias("size"), F.lit("").alias("big")), "size int, big string", path, "1")
    assert run(df.where("i < 3")) == work_on_text[:2]


def test_hot_tokens(spark, monkeypatch):
    monkeypatch.setattr(joins, "HOT_TOKEN", 20)
    rng = random.Random(7)
    items = [(i, ["the"] + [f"w{rng.randrange(30)}"] * (i % 2)) for i in range(300)]
    products = [(j, "the" if j % 3 else f"w{j % 40}") for j in range(90)]
    got = joins.token_candidates(spark.createDataFrame(items, "item int, tokens array<string>"), "item", "tokens", spark.createDataFrame(products, "j int, product string"), "product", ["j"], (F.col("item") + F.col("j")) % 2 == 0)
    assert sorted((r.item, r.j) for r in got.collect()) == sorted({(i, j) for i, ts in items for j, p in products if p in ts and (i + j) % 2 == 0})
    assert got.columns == ["item", "tokens", "j", "product"]


def test_hot_tokens_of_many_pairs(spark, monkeypatch):
    """Only pairs whose further columns are equal are made, in tasks of so many pairs, though both sides are few rows; repeated and null ones too."""
    monkeypatch.setattr(joins, "TASK_PAIRS", 500)
    items = [(i % 390 if i % 50 else None, i % 7 if i % 11 else None, ["the", None, f"w{i % 20}"][: 1 + i % 3]) for i in range(400)]
    products = [(j % 85, j % 5 if j % 13 else None, "the" if j % 3 else f"w{j % 20}") for j in range(90)]
    want = {(i, j) for i, x, ts in items for j, y, p in products if p in ts and x is not None and y is not None and (x + y) % 3 == 0}
    left, right = spark.createDataFrame(items, "item int, x int, tokens array<string>"), spark.createDataFrame(products, "j int, y int, product string")
    equal = (F.pmod(-F.col("x"), F.lit(3)), F.pmod("y", F.lit(3)))
    for most in (joins.KNOWN_TOKENS, 3):
        monkeypatch.setattr(joins, "KNOWN_TOKENS", most)
        got = joins.token_candidates(left, "item", "tokens", right, "product", ["j"], equal=[equal])
        rows = [(r.item, r.j) for r in got.collect()]
        assert len(rows) == len(want) and set(rows) == want and got.columns == ["item", "x", "tokens", "j", "y", "product"]
        tasks = got.withColumn("task", F.spark_partition_id()).groupBy("task").count().collect()
        assert len(tasks) > 6 and max(t["count"] for t in tasks) < len(want) / 2
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Cartesian" not in plan and "NestedLoop" not in plan
