import random

from pyspark.sql import functions as F

from lodestrata.operators import checks, joins, matching, merges


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def test_longest_suffix(spark):
    rules = spark.createDataFrame([("vungle.com", "V"), ("ads.vungle.com", "VA"), ("branch.io", "B")], "suffix string, vendor string")
    names = ["ads.vungle.com", "logs.ads.vungle.com", "sdk.api.branch.io", "google.com", "notvungle.com", " VUNGLE.com. ", None, "", "a..com"]
    df = spark.createDataFrame([(n,) for n in names], "host string")
    got = {r.host: r.vendor for r in joins.longest_suffix(df, "host", rules, "suffix").collect()}
    assert got == {"ads.vungle.com": "VA", "logs.ads.vungle.com": "VA", "sdk.api.branch.io": "B", "google.com": None, "notvungle.com": None, " VUNGLE.com. ": "V", None: None, "": None, "a..com": None}
    plan = joins.longest_suffix(df, "host", F.broadcast(rules), "suffix")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoop" not in plan and "Cartesian" not in plan


def test_prefix_boundaries(spark):
    rules = spark.createDataFrame([("com.adjust", "Adjust")], "prefix string, name string")
    df = spark.createDataFrame([("com.adjust.sdk",), ("com.adjuster",), ("COM.ADJUST",), (None,)], "p string")
    raw = {r.p: r.name for r in joins.longest_prefix(df, "p", rules, "prefix").collect()}
    assert raw == {"com.adjust.sdk": "Adjust", "com.adjuster": "Adjust", "COM.ADJUST": "Adjust", None: None}
    strict = {r.p: r.name for r in joins.longest_prefix(df, "p", rules, "prefix", boundary=True).collect()}
    assert strict["com.adjuster"] is None and strict["com.adjust.sdk"] == "Adjust"


def test_addresses(spark):
    rules = spark.createDataFrame([("192.168.2.0/24", "lan", 1), ("8.8.8.8", "dns", 2), ("8.0.0.0/8", "wide", 0), ("bad", "x", 3)], "block string, owner string, pos int")
    df = spark.createDataFrame([("8.8.8.8",), ("192.168.2.10",), ("192.168.1.1",), ("8.1.1.1",), (None,), ("x",)], "ip string")
    got = {r.ip: r.owner for r in joins.cidr_lookup(df, "ip", rules, "block", "pos").collect()}
    assert got == {"8.8.8.8": "dns", "192.168.2.10": "lan", "192.168.1.1": None, "8.1.1.1": "wide", None: None, "x": None}
    ranges = spark.createDataFrame([("8.8.8.0", "8.8.8.255", "US"), ("10.0.0.0", "10.255.255.255", "ZZ")], "low string, high string, cc string")
    got = {r.ip: r.cc for r in joins.range_lookup(df, "ip", ranges, "low", "high").collect()}
    assert got["8.8.8.8"] == "US" and got["192.168.2.10"] is None
    assert joins.range_lookup(spark.createDataFrame([("10.0.0.1",)], "ip string"), "ip", ranges, "low", "high").first().cc is None


def test_conflicts_and_merges(spark):
    rules = spark.createDataFrame(
        [("conflict.com", "Exodus Co", "", "exodus", 1), ("conflict.com", "List Co", "Ads", "list", 2), ("only.com", "", "", "list", 2)], "d string, vendor string, category string, ds string, pr int"
    )
    got = {r.d: (r.vendor, r.category, r.datasets, r.conflict) for r in merges.conflict_merge(rules, "d", ["vendor", "category"], "ds", "pr").collect()}
    assert got == {"conflict.com": ("Exodus Co", "Ads", "exodus;list", True), "only.com": (None, None, "list", False)}
    apis = spark.createDataFrame([("k", ["b"], "unknown", 1, 5), ("k", ["a"], "Location", 2, 3), ("k", ["a"], "Camera", 3, 9)], "k string, s array<string>, c string, p int, l int")
    r = merges.united(apis.withColumn("h", F.col("l")), ["k"], ["s"], "c", "p", "l", "h").first()
    assert (r.s, r.c, r.l, r.h, r.confidence) == (["a", "b"], "Location", 3, 9, "HIGH")


def test_findings_keep_the_best_layer(spark):
    data = [(1, "e", "f2", 2, 1, 20, {"a": "x"}, "late", "s2"), (1, "e", "f1", 3, 1, 10, {"a": "y", "b": "z"}, "early", "s1"), (1, "e", "f1", 1, 2, 5, {"c": "w"}, "first", "s0")]
    df = spark.createDataFrame(data, "k int, kind string, file string, rank int, layer int, pos int, details map<string,string>, subtype string, snippet string")
    r = merges.merged_findings(df, ["k", "kind"], "file", "rank", "layer", "pos", "details", "subtype", "snippet").first()
    assert (r.occurrences, r.files, r["rank"], r.file, r.snippet, r.subtype) == (3, 2, 3, "f1", "s1", "first")
    assert r.details == {"a": "x", "b": "z", "c": "w"}


def test_personal_data(spark):
    texts = ["mail user@example.com now", "id 490154203237518 x", "Authorization: Bearer abc.def", "Hello World", "card 4111111111111111", "bad 490154203237519", None, "lat=12.5 lat=99.9"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [[(m.pattern_name, m.value) for m in r[0]] for r in df.select(matching.personal_data(F.col("t"))).collect()]
    assert got[0] == [("Email Address", "user@example.com")]
    assert got[1] == [("IMEI", "490154203237518")]
    assert got[2] == [("Bearer Token", "Bearer abc.def")]
    assert got[3] == [] == got[6]
    assert got[4] == [("Android ID", "4111111111111111")]  # sixteen digits are an Android ID first
    assert got[5] == []  # a bad check digit is not tried as an IMSI
    assert got[7] == [("Latitude", "lat=12.5")]


def test_keyword_search(spark):
    rules = spark.createDataFrame([("Build.MODEL", "Device", "Model"), ("model", "Device", "Any")], "token string, category string, subcategory string")
    df = spark.createDataFrame([(1, "x BUILD.model y"), (2, None), (3, "")], "id int, t string")
    assert rows(matching.keyword_search(df, "id", "t", rules), "token") == [(1, "Build.MODEL", "Device", "Model", 2, 12), (1, "model", "Device", "Any", 8, 12)]
    assert matching.keyword_search(df, "id", "t", rules.limit(0)).count() == 0


def test_endpoints(spark):
    df = spark.createDataFrame([(1, "see https://API.example.com:8080/x and 8.8.8.8, 9.9.9.1 or 5.6.7.8:80 at cdn.example.org.")], "id int, t string")
    got = {(r.kind, r.host) for r in matching.endpoints(df, ["id"], "t").collect()}
    assert got == {("url", "api.example.com"), ("ip", "8.8.8.8"), ("ip", "5.6.7.8"), ("domain", "cdn.example.org")}


def test_checks(spark):
    df = spark.createDataFrame([("a", 1, "p"), ("a", 2, "p"), ("", 3, "p"), ("b", 4, "")], "id string, pos int, path string")
    got = rows(checks.rejected(df, {"no_id": F.col("id") == "", "no_path": F.col("path") == ""}, ["id"], "pos"), "pos")
    assert [r[-1] for r in got] == [None, "duplicate", "no_id", "no_path"]
    assert checks.counters(df, ["id"], {"late": F.col("pos") > 2}).first().asDict() == {"rows": 4, "blank_keys": 1, "late": 2, "duplicate_keys": 1}
    assert checks.counters(df.limit(0), ["id"], {}).first().rows == 0


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "host string, n int")
    rules = spark.createDataFrame([], "suffix string, vendor string")
    assert joins.longest_suffix(empty, "host", rules, "suffix").count() == 0
    assert joins.longest_prefix(empty, "host", rules, "suffix").count() == 0
    assert joins.compared(empty, empty, ["host"]).count() == 0
    assert merges.top_shares(empty.withColumn("k", F.lit("x")), ["host"], "k", 3).count() == 0


def test_version_candidates(spark):
    smali = 'const-string v0, "4.12.0"\n\n    sput-object v0, Lokhttp3/OkHttp;->VERSION:Ljava/lang/String;\nconst-string v1, "9.9.9"\nconst-string v2, "x"\nsput-object v1, La;->VERSION'
    data = [
        ("s", "a.smali", "smali", smali), ("s", "B.smali", "smali", '.field public static final VERSION_NAME:Ljava/lang/String; = "1.2.3"'), ("s", "pom.xml", "pom", "<version>2.0.1</version>"),
        ("s", "v.xml", "res_values", '<string name="lib_version">3.4</string>'), ("s", "x.version", "metadata", "1.6.1\n"), ("s", "zero", "metadata", "0.0"), ("s", "none", "smali", None),
    ]
    df = spark.createDataFrame(data, "sample_id string, path string, kind string, text string")
    found = matching.version_candidates(df)
    assert {(r.source, r.version) for r in found.collect()} == {("const", "4.12.0"), ("buildconfig", "1.2.3"), ("pom", "2.0.1"), ("resource", "3.4"), ("metadata", "1.6.1")}
    best = merges.best_candidate(found, ["sample_id"], "version", F.lit(True), [F.col("place"), F.col("path")])
    assert best.first().version == "2.0.1"


def test_api_rules(spark):
    apis = spark.createDataFrame([("Build", "<init>", "Device", None), ("L", "get", "Location", "GPS"), ("X", "y", "unknown", "")], "class_name string, method_name string, category string, subcategory string")
    rules = matching.api_tokens(apis)
    assert {r.token for r in rules.collect()} == {"Build", "L.get"}
    code = spark.createDataFrame([(1, "invoke Landroid/L;->get()")], "id int, t string").withColumn("t", matching.code_text(F.col("t")))
    assert [r.token for r in matching.keyword_search(code, "id", "t", rules).collect()] == ["L.get"]


def test_lookups_against_plain_loops(spark):
    """Random names, prefixes and addresses against the shortest spec that says the same."""
    import ipaddress
    import random

    rng = random.Random(12)
    label = lambda: rng.choice(["a", "b", "c", "ad", "x1"])
    names = sorted({".".join(label() for _ in range(rng.randrange(1, 6))) for _ in range(300)})
    suffixes = sorted({".".join(label() for _ in range(rng.randrange(1, 4))) for _ in range(25)})
    df = spark.createDataFrame([(n,) for n in names], "v string")
    rules = spark.createDataFrame([(s,) for s in suffixes], "s string")
    got = {r.v: r.s for r in joins.longest_suffix(df, "v", rules, "s").collect()}
    assert got == {n: max((s for s in suffixes if n == s or n.endswith("." + s)), key=len, default=None) for n in names}
    got = {r.v: r.s for r in joins.longest_prefix(df, "v", rules, "s").collect()}
    assert got == {n: max((s for s in suffixes if n.startswith(s)), key=len, default=None) for n in names}
    ips = sorted({str(ipaddress.IPv4Address(rng.randrange(1 << 24, 1 << 27))) for _ in range(300)} | {"200.1.2.3"})
    blocks = [(str(ipaddress.ip_network((rng.randrange(1 << 24, 1 << 27) >> (32 - b) << (32 - b), b))), i) for i, b in enumerate(rng.choices(range(4, 31), k=40))]
    blocks += [(ips[3], 100), (ips[3], 101)]
    nets = [(ipaddress.ip_network(b), b, i) for b, i in blocks]
    df = spark.createDataFrame([(x,) for x in ips], "ip string")
    got = {r.ip: r.pos for r in joins.cidr_lookup(df, "ip", spark.createDataFrame(blocks, "block string, pos int"), "block", "pos").collect()}
    want = {}
    for x in ips:
        held = [(n.prefixlen < 32, i) for n, _, i in nets if ipaddress.ip_address(x) in n]
        want[x] = min(held)[1] if held else None
    assert got == want


def test_pieces_find_what_texts_contain(spark):
    """Against plain loops: short rules, repeated ones, line ends, letters beyond ASCII; and beginnings."""
    from lodestrata.operators import grams

    rng = random.Random(4)
    texts = ["".join(rng.choice("abé\n.x") for _ in range(rng.randrange(0, 40))) for _ in range(40)] + [None, "", "a.b", "abababab"]
    rules = sorted({"".join(rng.choice("abé\n.x") for _ in range(rng.randrange(1, 9))) for _ in range(60)}) + ["", None]
    t, r = spark.createDataFrame(list(enumerate(texts)), "i long, t string"), spark.createDataFrame(list(enumerate(rules)), "j long, r string")
    want = {(i, j) for i, x in enumerate(texts) for j, y in enumerate(rules) if x and y and y in x}
    for size in (grams.SLICE, 7):
        grams.SLICE, kept = size, grams.SLICE
        got = [(x.i, x.j) for x in grams.containing(t, "t", r, "r").collect()]
        grams.SLICE = kept
        assert len(got) == len(set(got)) and set(got) == want
    got = {(x.i, x.j) for x in grams.starting(t, "t", r, "r").collect()}
    assert got == {(i, j) for i, x in enumerate(texts) for j, y in enumerate(rules) if x and y and x.startswith(y)}
    assert grams.containing(t, "t", r.limit(0), "r").count() == 0
