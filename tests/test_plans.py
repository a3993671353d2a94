from pyspark.sql import functions as F

from lodestrata.plans import cross, knowledge, manifests, traffic, vulnerabilities
from lodestrata.sources import captures, documents
from lodestrata.streaming.flows import stream_bursts, stream_flows
from test_sources import MANIFEST, frames


def test_vulnerabilities(spark):
    sdks = spark.createDataFrame(
        [("a1", "com.squareup.okhttp3:okhttp", "OkHttp", "4.0.1"), ("a1", "com.google.code.gson", "Gson", "2.8.0"), ("a2", "com.squareup.okhttp3:okhttp", "OkHttp", ""), ("a3", "com.squareup.okhttp3", "X", "junk"), ("a4", "com.other", "Other", "1.0"), (None, None, None, None)],
        "sample_id string, sdk_identifier string, sdk_name string, sdk_version string",
    )
    bound = ("4.0.0", None, None, "4.9.0")
    cves = spark.createDataFrame(
        [("C1", "s", "okhttp", "HIGH", 7.5, "2024", [bound]), ("C2", "s", "okhttp", "LOW", 2.0, "2024", [(None, None, None, None)]), ("C3", "g", "gson", "HIGH", 9.0, "2023", [(None, None, "2.8.0", None)])],
        "cve_id string, vendor string, product string, severity string, score double, published string, version_ranges array<struct<start_including:string,start_excluding:string,end_including:string,end_excluding:string>>",
    )
    known = vulnerabilities.with_tokens(sdks)
    found = vulnerabilities.matches(known, cves)
    assert {(r.sample_id, r.cve_id) for r in found.collect()} == {("a1", "C1"), ("a1", "C3")}
    assert {(r.sample_id, r.sdk_name): r.outcome for r in vulnerabilities.outcomes(sdks, found).collect()} == {
        ("a1", "OkHttp"): "matched", ("a1", "Gson"): "matched", ("a2", "OkHttp"): "no_version", ("a3", "X"): "parse_error", ("a4", "Other"): "no_nvd_entry", (None, None): "no_version",
    }
    assert tuple(vulnerabilities.app_summary(found).first()) == ("a1", 2, 2, 2, 9.0)


def rules(spark):
    return traffic.Rules(
        spark.createDataFrame([("doubleclick.net", "Google", "Advertising")], "domain_suffix string, canonical_vendor string, category string"),
        spark.createDataFrame([("1.1.1.1", "Cloudflare")], "ip_address string, canonical_provider string"),
        spark.createDataFrame([("8.8.8.0", "8.8.8.255", "US", "NA", "15169", "Google LLC"), ("9.0.0.0", "9.255.255.255", "CH", "EU", "19281", "Quad9")], "ip_from string, ip_to string, country_code string, continent string, asn string, organization string"),
    )


def test_traffic(spark):
    events = captures.packets(frames(spark)).withColumn("sample_id", F.lit("s")).withColumn("session_id", F.lit("x"))
    dns = traffic.dns_records(events, rules(spark))
    assert sorted((r.query_name, r.response_count, r.query_type, r.resolver_ip, r.dns_provider, r.is_anti_analysis_probe) for r in dns.collect())[1:] == [("example.com", 0, "A", "1.1.1.1", "Cloudflare", True), ("example.com", 2, "AAAA", "1.1.1.1", "Cloudflare", True)]
    found = traffic.connections(events, rules(spark))
    by = {(r.domain, r.dst_ip): r for r in found.collect()}
    ad = by["ad.doubleclick.net", "8.8.8.8"]
    assert (ad.tracker_matched, ad.canonical_vendor, ad.country_code, ad.asn, ad.is_tls, ad.is_hardcoded_dns, ad.registered_domain) == (True, "Google", "US", "15169", True, True, "doubleclick.net")
    assert by["example.com", "10.0.0.2"].is_nonstandard_port and by["example.com", "10.0.0.2"].country_code is None
    r = traffic.app_summary(found, dns).first()
    assert (r.domains, r.tracker_domains, r.vendors, r.categories, r.countries, r.asns) == (3, 1, {"Google": 1}, {"Advertising": 1}, {"CH": 1, "US": 1}, {"15169": 1, "19281": 1})
    assert (r.top_organizations, r.google_domains, r.dns_packets, r.max_answers, r.uses_hardcoded_dns, r.probes) == (["Google LLC", "Quad9"], 1, 3, 2, True, True)
    assert traffic.domain_places(found).count() == 4


def test_manifest_tables(spark):
    parsed = documents.manifests(spark.createDataFrame([("s1", bytearray(MANIFEST.encode())), ("s2", bytearray(b"<x"))], "sample_id string, content binary"))
    app = {r.sample_id: r for r in manifests.app_table(parsed).collect()}
    one = app["s1"]
    assert (one.package, one.target, one.backup, one.backup_source, one.cleartext, one.components, one.activity_count, one.provider_count, one.violations, one.permissions, one.custom_permissions) == ("com.app", 33, True, "default", True, 3, 2, 1, 1, 2, 1)
    assert (app["s2"].readable, app["s2"].components) == (False, 0)
    names = {r.qualified_name: r.launcher for r in manifests.component_table(parsed).collect()}
    assert names == {"com.app.Main": True, "com.facebook.Login": False, "com.app.P": False}
    code = spark.createDataFrame([("s1", "smali/com/bytedance/sdk/A.smali", "smali"), ("s1", "smali/com/app/B.smali", "smali")], "sample_id string, path string, kind string")
    catalog = spark.createDataFrame([("Facebook", "com.facebook", 1), ("Pangle", "com.bytedance", 2)], "name string, prefix string, pos int")
    aliases = spark.createDataFrame([("fb", "Facebook", 1)], "alias string, name string, pos int")
    got = {r.sdk_name: (r.in_manifest, r.in_code, r.source, len(r.sdk_id)) for r in manifests.sdk_table(parsed, code, catalog, aliases).collect()}
    assert got == {"Facebook": (True, False, "manifest", 16), "Pangle": (False, True, "smali", 16)}


def test_findings(spark):
    from lodestrata.operators.matching import supported_patterns

    texts = spark.createDataFrame([("s", "f1", 2, "call https://api.example.com/x mail u@example.com"), ("s", "f2", 1, "https://api.example.com"), ("s", "f3", 1, None)], "sample_id string, file string, layer int, text string")
    got = {(r.kind, r.value): (r.occurrences, r.files, r.file) for r in manifests.findings(texts, supported_patterns([("m", r"\bmail\b", "HIGH")], spark)).collect()}
    assert got[("endpoint", "api.example.com")] == (2, 2, "f2") and got[("pii", "u@example.com")][0] == 1 and ("secret", "mail") in got


def test_knowledge(spark):
    kind = "framework string, package_name string, class_name string, method_name string, api_type string, sources array<string>, source_versions array<string>, android_versions array<int>, category string, pos int, min_level int, max_level int"
    a = spark.createDataFrame([("android", "p", "C", "m", "method", ["one"], ["1"], [23], "unknown", 1, 23, 23), ("android", "", "C", "m", "method", ["one"], ["1"], [23], "x", 2, 1, 1)], kind)
    b = spark.createDataFrame([("android", "p", "C", "m", "method", ["two"], ["2"], [21, 23], "Location", 3, 21, 23)], kind)
    merged = knowledge.privacy_apis([a, b])
    r = merged.first()
    assert merged.count() == 1 and (r.sources, r.android_versions, r.category, r.min_level, r.max_level, r.confidence) == (["one", "two"], [21, 23], "Location", 21, 23, "HIGH") and r.record_id[14] == "5"
    pair = "pattern string, category string"
    none = spark.createDataFrame([], pair)
    classes = spark.createDataFrame([("p.C", "X"), ("p.C", "Y")], pair)
    packages = spark.createDataFrame([("p", "Pkg")], pair)
    assert knowledge.categorised(merged, none, classes, packages, none).first().category == "Pkg"  # the class rules disagree
    listed = spark.createDataFrame([("1.1.1.1", "", "Cloudflare", "", "", "", True, False, False)], "ip_address string, provider string, canonical_provider string, resolver_name string, provider_country string, confidence string, supports_doh boolean, supports_dot boolean, supports_dnscrypt boolean")
    r = knowledge.resolvers(listed, listed.withColumn("canonical_provider", F.lit("CF")).withColumn("supports_dot", F.lit(True))).first()
    assert (r.canonical_provider, r.supports_doh, r.supports_dot) == ("CF", True, True)
    patterns = spark.createDataFrame([("A", "old", "MEDIUM"), ("A", "new", "HIGH")], "pattern_name string, regex string, confidence string")
    assert knowledge.patterns(patterns).first().regex == "new"
    trackers = spark.createDataFrame([("d", "", "v", "c", "x", 1), ("d", "w", "u", "", "y", 2)], "domain_suffix string, canonical_vendor string, vendor string, category string, source_dataset string, priority int")
    r = knowledge.trackers(trackers).first()
    assert (r.canonical_vendor, r.vendor, r.category, r.datasets) == ("w", "v", "c", "x;y")


def test_cross(spark):
    a = spark.createDataFrame([("s", "v1"), ("s", "v2")], "sample_id string, vendor string")
    b = spark.createDataFrame([("s", "v2"), ("s", "v3")], "sample_id string, vendor string")
    assert {(r.vendor, r.side) for r in cross.declared_against_seen(a, b).collect()} == {("v1", "only_left"), ("v2", "both"), ("v3", "only_right")}


def test_streams_equal_batches(spark, tmp_path):
    from lodestrata.operators.merges import bursts

    rows = [(1, "2024-01-01 00:00:00", 5), (1, "2024-01-01 00:10:00", 6), (1, "2024-01-01 02:00:00", 7), (2, "2024-01-01 00:00:30", 8)]
    df = spark.createDataFrame(rows, "u int, t string, size int").withColumn("ts", F.to_timestamp("t")).drop("t")
    df.write.parquet(f"{tmp_path}/in")

    def run(transform):
        out = f"{tmp_path}/out{id(transform)}"
        stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
        transform(stream).writeStream.outputMode("complete").foreachBatch(lambda b, _: b.write.mode("overwrite").parquet(out)).trigger(availableNow=True).start().awaitTermination()
        return spark.read.parquet(out)

    got = run(lambda s: stream_bursts(s, ["u"], "ts"))
    want = bursts(df, ["u"], "ts", 1800).drop("burst")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert {(r.u, r.packets, r.bytes) for r in run(lambda s: stream_flows(s, ["u"], "ts", "size")).collect()} == {(1, 2, 11), (1, 1, 7), (2, 1, 8)}
