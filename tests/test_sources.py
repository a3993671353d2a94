import base64
import io
import json
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from lodestrata import schemas, sinks
from lodestrata.functions.values import REGIONS
from lodestrata.sources import captures, documents, files, knowledge, tabular


def ip_packet(protocol, src, dst, sport, dport, payload):
    body = struct.pack(">HHHH", sport, dport, 8 + len(payload), 0) + payload if protocol == 17 else struct.pack(">HHIIBBHHH", sport, dport, 0, 0, 5 << 4, 24, 0, 0, 0) + payload
    head = struct.pack(">BBHHHBBH", 0x45, 0, 20 + len(body), 0, 0, 64, protocol, 0)
    return head + bytes(map(int, src.split("."))) + bytes(map(int, dst.split("."))) + body


def dns(name, answers=()):
    question = b"".join(bytes([len(x)]) + x.encode() for x in name.split(".")) + b"\0" + struct.pack(">HH", 1, 1)
    out = struct.pack(">HHHHHH", 7, 0x8180, 1, len(answers), 0, 0) + question
    for a in answers:
        raw = bytes(map(int, a.split("."))) if "." in a else struct.pack(">8H", *(int(x, 16) for x in a.split(":")))
        out += b"\xc0\x0c" + struct.pack(">HHIH", 1 if len(raw) == 4 else 28, 1, 60, len(raw)) + raw
    return out


def hello(name):
    host = name.encode()
    sni = struct.pack(">HHHBH", 0, len(host) + 5, len(host) + 3, 0, len(host)) + host
    extensions = struct.pack(">HH", 23, 0) + sni
    body = b"\x03\x03" + b"r" * 32 + b"\0" + struct.pack(">H", 2) + b"\x13\x01" + b"\x01\x00" + struct.pack(">H", len(extensions)) + extensions
    return b"\x16\x03\x01" + struct.pack(">H", len(body) + 4) + b"\x01" + len(body).to_bytes(3, "big") + body


PACKETS = [
    ip_packet(17, "10.0.0.2", "1.1.1.1", 5000, 53, dns("example.com")),
    ip_packet(17, "1.1.1.1", "10.0.0.2", 53, 5000, dns("example.com", ["93.184.216.34", "2606:2800:220:1:248:1893:25c8:1946"])),
    ip_packet(6, "10.0.0.2", "8.8.8.8", 5001, 443, hello("Ad.DoubleClick.net")),
    ip_packet(6, "10.0.0.2", "9.9.9.9", 5002, 80, b"POST /a?b HTTP/1.1\r\nHost: Api.Test:80\r\nX-Y: z\r\n\r\nmail=u@example.com"),
    ip_packet(17, "10.0.0.2", "8.8.4.4", 5003, 443, b"quic"),
    ip_packet(1, "10.0.0.2", "8.8.4.4", 0, 0, b"an echo"),
    ip_packet(17, "10.0.0.2", "1.1.1.1", 5000, 53, b"\x00\x01broken"),
]


def frames(spark, link=101, packets=PACKETS):
    """The table that a splitter of capture files gives."""
    prefix = b"\0" * 12 + b"\x08\x00" if link == 1 else b""
    rows = [("a", i, 1000 + i + 0.5, link, bytearray(prefix + f)) for i, f in enumerate(packets)]
    rows += [("b", 0, 1.0, 1, bytearray(b"\0" * 12 + b"\x86\xdd" + packets[0])), ("b", 1, 1.0, 101, bytearray(b"E")), ("b", 2, 1.0, 101, bytearray()), ("b", 3, 1.0, 999, bytearray(packets[0])), ("b", 4, 1.0, 101, None)]
    return spark.createDataFrame(rows, "file string, number long, time double, link int, frame binary")


@pytest.mark.parametrize("link", [101, 12, 1])
def test_captures(spark, link):
    got = captures.packets(frames(spark, link)).orderBy("number").collect()
    assert [(r.event_type, r.domain, r.is_quic) for r in got] == [
        ("dns", "example.com", False), ("dns", "example.com", False), ("tls", "ad.doubleclick.net", False), ("http", "api.test", False), ("udp", "", True), ("dns", "", False),
    ]
    assert got[1].dns_answers == ["93.184.216.34", "2606:2800:220:1:248:1893:25c8:1946"] and got[0].dns_answers == []
    assert (got[3].http_url, got[3].http_headers["x-y"], got[3].http_body) == ("/a?b", "z", "mail=u@example.com")
    assert got[0].time == 1000.5 and got[2].dst_port == 443 and got[4].payload_size == 4


def test_broken_packets(spark):
    """Every cut of every packet is a row of blanks or no row, and raises nothing."""
    cut = [p[:n] for p in PACKETS[:4] for n in range(0, len(p), 3)]
    got = captures.packets(frames(spark, packets=[*cut, *PACKETS])).where("file = 'a'").collect()
    assert len(got) <= len(cut) + len(PACKETS) and {r.domain for r in got} >= {"example.com", "ad.doubleclick.net", "api.test", ""}


def test_feeds(spark, tmp_path):
    metric = {"type": "Primary", "cvssData": {"version": "3.1", "baseScore": 9.8, "baseSeverity": "critical"}}
    match = lambda name, **x: {"criteria": f"cpe:2.3:a:{name}:*:*", **x}
    entries = [
        {"id": "CVE-1", "published": "2024", "metrics": {"cvssMetricV31": [{**metric, "type": "Secondary", "cvssData": {"baseScore": 1}}, metric]},
         "configurations": [{"nodes": [{"cpeMatch": [match("v:p", versionStartIncluding="1.0", versionEndExcluding="2.0"), match("v:p"), match("w:q", versionEndIncluding="3")]}]}]},
        {"id": "CVE-2", "published": "2023", "metrics": {"cvssMetricV2": [{"type": "Primary", "baseSeverity": "low", "cvssData": {"baseScore": 2.5}}]}},
        {"published": "2022", "configurations": []},
    ]
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("a.json", json.dumps({"vulnerabilities": [{"cve": e} for e in entries]}))
        z.writestr("bad.json", "{")
        z.writestr("other.txt", "x")
    (tmp_path / "feed.zip").write_bytes(raw.getvalue())
    (tmp_path / "broken.zip").write_bytes(b"PK no")
    got = {(r.cve_id, r.vendor, r["product"]): r for r in documents.vulnerabilities(documents.zipped_members(spark, str(tmp_path))).collect()}
    assert set(got) == {("CVE-1", "v", "p"), ("CVE-1", "w", "q"), ("CVE-2", None, None), ("UNKNOWN", None, None)}
    one = got["CVE-1", "v", "p"]
    assert (one.severity, one.score, len(one.version_ranges)) == ("CRITICAL", 9.8, 2)
    assert (got["CVE-2", None, None].severity, got["CVE-2", None, None].version_ranges) == ("LOW", [])


MANIFEST = """<?xml version="1.0"?><manifest xmlns:android="http://schemas.android.com/apk/res/android" package="com.app">
<uses-sdk android:minSdkVersion="21" android:targetSdkVersion="33"/>
<uses-permission android:name="android.permission.CAMERA"/><uses-permission android:name="com.app.MINE"/><permission android:name="com.app.OWN"/>
<application android:usesCleartextTraffic="true">
<activity android:name=".Main"><intent-filter android:autoVerify="true"><action android:name="android.intent.action.MAIN"/><category android:name="android.intent.category.LAUNCHER"/><data android:scheme="https" android:host="x.y"/></intent-filter></activity>
<activity android:name="com.facebook.Login" android:exported="false"/>
<provider android:name="P" android:authorities="a.b;c.d"/>
<meta-data android:name="com.facebook.sdk.ApplicationId" android:value="1"/>
<uses-library android:name="org.apache.http.legacy"/></application></manifest>"""


def test_manifests(spark):
    rows = [("s1", bytearray(MANIFEST.encode())), ("s2", bytearray(b"<manifest package='x'><broken"))]
    parsed = documents.manifests(spark.createDataFrame(rows, "sample_id string, content binary"))
    assert {r.sample_id: r.readable for r in parsed.collect()} == {"s1": True, "s2": False}
    own = documents.components(parsed).orderBy("kind", "pos").collect()
    assert [(r.kind, r.name, r.exported, r.target) for r in own] == [("activity", ".Main", None, 33), ("activity", "com.facebook.Login", False, 33), ("provider", "P", None, 33)]
    assert own[0].filters[0].actions == ["android.intent.action.MAIN"] and own[0].filters[0].auto_verify and own[0].filters[0].data[0].host == "x.y"
    assert {(r.record, r.name) for r in documents.permissions(parsed).collect()} == {("requested", "android.permission.CAMERA"), ("requested", "com.app.MINE"), ("declared", "com.app.OWN")}
    found = {(r.source, r.value) for r in documents.evidence(parsed).collect()}
    assert {("authority", "c.d"), ("meta_name", "com.facebook.sdk.ApplicationId"), ("library", "org.apache.http.legacy"), ("component", ".Main")} <= found


def test_network_security(spark):
    text = """<network-security-config><base-config cleartextTrafficPermitted="false"><trust-anchors><certificates src="user"/><certificates src="system"/></trust-anchors></base-config>
<domain-config cleartextTrafficPermitted="true"><domain includeSubdomains="true">Insecure.Example.com</domain><domain>b.example</domain><pin-set><pin digest="SHA-256">abc</pin></pin-set></domain-config></network-security-config>"""
    df = spark.createDataFrame([("s", "res/xml/n.xml", bytearray(text.encode()))], "sample_id string, path string, content binary")
    got = {(r.rule, r.domain): (r.cleartext, r.subdomains, r.anchors, r.pins) for r in documents.network_domains(df).collect()}
    assert got == {("base", None): (False, None, "system;user", ""), ("domain", "insecure.example.com"): (True, True, "", "SHA-256:abc"), ("domain", "b.example"): (True, None, "", "SHA-256:abc")}


def test_proxy_export(spark, tmp_path):
    body = base64.b64encode("gét".encode()).decode()
    (tmp_path / "x.xml").write_text(f'<items><item><time>t</time><url>u</url><host ip="1.2.3.4">h</host><method>GET</method><request base64="true">{body}</request><response base64="false">ok</response></item></items>')
    r = documents.proxy_items(spark, str(tmp_path / "x.xml")).first()
    assert (r.host, r.ip, r.request, r.response, r.request_size) == ("h", "1.2.3.4", "gét", "ok", 4)


def test_tables(spark, tmp_path):
    hash64 = "a" * 64
    (tmp_path / "i.csv").write_text(f"sample_id,source_path,apk_sha256,app_country_code,extra\n s1 ,p,{hash64},de,1\ns1,p,,us,\n,p,,,\ns2,p,{hash64[1:]},,\ns3,,,,\ns4,p,,xx,\n")
    got = {(r.sample_id, r.reject, r.region) for r in tabular.sample_index(spark, str(tmp_path / "i.csv"), schemas.SAMPLE_INDEX, REGIONS).collect()}
    assert got == {("s1", None, "eu_member"), ("s1", "duplicate", "north_america"), ("", "no_id", ""), ("s2", "bad_hash", ""), ("s3", "no_path", ""), ("s4", None, "other")}
    with pytest.raises(ValueError, match="lacks nothing"):
        tabular.csv(spark, str(tmp_path / "i.csv"), schemas.SAMPLE_INDEX, ["nothing"])
    (tmp_path / "n.txt").write_text("# c\n\n com.a \ncom.b\n")
    assert [r.name for r in tabular.names(spark, str(tmp_path / "n.txt")).collect()] == ["com.a", "com.b"]
    text = "#x=1\na = b=c\n!y=2\nversion=1\nversion=2\nnone"
    assert spark.createDataFrame([(text,)], "t string").select(tabular.properties(F.col("t"))).first()[0] == {"a": "b=c", "version": "2"}
    (tmp_path / "c.csv").write_text("FirstSeen,LastSeen,Info,DstIp,DstPort,Proto,BytesSent,BytesRcvd,Status\n1,2,x.com,1.1.1.1,53,UDP,bad,7,ok\n")
    r = tabular.device_captures(spark, str(tmp_path / "c.csv")).first()
    assert (r.DstPort, r.BytesSent, r.BytesRcvd, r.is_dns) == (53, 0, 7, True)
    import hashlib

    assert tabular.verified(spark, str(tmp_path / "n.txt"), hashlib.sha256((tmp_path / "n.txt").read_bytes()).hexdigest()).count() == 1
    with pytest.raises(ValueError, match="not the file"):
        tabular.verified(spark, str(tmp_path / "n.txt"), "0" * 64)


def test_file_tree(spark, tmp_path):
    for path in ("s1/AndroidManifest.xml", "s1/smali/com/face/book/core/A.smali", "s1/smali_classes2/com/face/book/B.smali", "s1/res/values/strings.xml", "s1/assets/x.json"):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text("x")
    tree = files.tree(spark, str(tmp_path))
    assert {r.path: r.kind for r in tree.collect()}["res/values/strings.xml"] == "res_values"
    assert {(r.prefix, r.depth) for r in files.package_prefixes(tree).collect()} == {("com.face.book", 3), ("com.face.book.core", 4)}
    listing = spark.createDataFrame([("f", "config.arm.apk"), ("f", "b.apk"), ("f", "c.apk"), ("g", "x.txt")], "folder string, name string")
    assert [tuple(r) for r in files.main_packages(listing).collect()] == [("f", "b.apk")]


def test_knowledge_sources(spark, tmp_path):
    (tmp_path / "api-23").mkdir()
    (tmp_path / "api-23" / "map.txt").write_text("android.app.Alarm.set(long)void  ::  android.permission.A, android.permission.B\nbad line\n")
    got = {tuple(r) for r in knowledge.permission_maps(spark, str(tmp_path / "api-23")).collect()}
    assert got == {("android.app", "Alarm", "set", "android.permission.A", 23), ("android.app", "Alarm", "set", "android.permission.B", 23)}
    (tmp_path / "p.txt").write_text("<a.b.C: void m(int)> -> SEND, x.y.Z\n")
    assert {r.permission for r in knowledge.permission_calls(spark, str(tmp_path / "p.txt")).collect()} == {"android.permission.SEND", "x.y.Z"}
    xml = b'<r><permissionDef className="C" target="T" targetKind="K"><permission name="P"/><permission name="Q"/></permissionDef></r>'
    assert knowledge.permission_definitions(spark.createDataFrame([(bytearray(xml),)], "content binary")).count() == 2
    go = b'package x\nvar (\n keyPat = regexp.MustCompile(`[0-9a-f]{32}`)\n keyword = regexp.MustCompile(`k`)\n)'
    r = knowledge.detector_patterns(spark.createDataFrame([("d/stripe/stripe.go", bytearray(go))], "path string, content binary")).collect()
    assert [(x.detector, x.secret_type, x.regex) for x in r] == [("stripe", "key", "[0-9a-f]{32}")]
    (tmp_path / "s.txt").write_text("<a.L: double getLatitude()> -> _SOURCE_\n% note\n")
    assert [tuple(r) for r in knowledge.flow_signatures(spark, str(tmp_path / "s.txt")).collect()] == [("a.L", "getLatitude", "source")]
    exodus = json.dumps({"trackers": {"1": {"name": "T", "network_signature": r"a\.com|b\.com", "categories": ["Ads", "X"]}}})
    assert {(r.domain, r.category) for r in knowledge.tracker_signatures(spark.createDataFrame([(exodus,)], "text string")).collect()} == {("a.com", "Ads"), ("b.com", "Ads")}
    (tmp_path / "e.txt").write_text("! Version: 7\n||track.com^\n||third.com^$third-party\n##.cosmetic\n||path.com/x\n||opt.com^$image\n")
    assert {tuple(r) for r in knowledge.blocked_domains(spark, str(tmp_path / "e.txt")).collect()} == {("track.com", "7"), ("third.com", "7")}
    stamp = base64.urlsafe_b64encode(b"\x02" + b"\0" * 8 + bytes([11]) + b"1.1.1.1:443" + b"\0").decode().rstrip("=")
    (tmp_path / "r.md").write_text(f"# list\n## cloud\nnote\nsdns://{stamp}\n")
    assert [tuple(r) for r in knowledge.resolver_list(spark, str(tmp_path / "r.md")).collect()] == [("cloud", "doh", "1.1.1.1")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("b", None, [1, 2], {"k": 1}), (None, True, [], {})], "id string, flag boolean, xs array<int>, m map<string,int>")
    sinks.csv(df, f"{tmp_path}/c", ["id", "xs", "flag", "m"], ["id"])
    assert [tuple(r) for r in spark.read.csv(f"{tmp_path}/c", header=True, escape='"').collect()] == [(None, "[]", "true", "{}"), ("b", "[1,2]", None, '{"k":1}')]
    with pytest.raises(ValueError, match="check failed: parents"):
        sinks.tables({"t": df}, str(tmp_path / "t"), {"parents": lambda f: f["t"].where("id is null")})
    with pytest.raises(FileNotFoundError):
        sinks.current(spark, str(tmp_path / "t"), "t")
    sinks.tables({"t": df}, str(tmp_path / "t"), {})
    assert sinks.current(spark, str(tmp_path / "t"), "t").count() == 2
    sinks.trace({"run": "1"}, {"t": df}, f"{tmp_path}/trace")
    assert spark.read.json(f"{tmp_path}/trace").first().rows.t == 2
    sinks.knowledge(df, f"{tmp_path}/k", ["id"], df.agg(F.count("*").alias("n")), "ab")
    assert spark.read.json(f"{tmp_path}/k/stats").first().source_sha256 == "ab"


def test_conform(spark):
    df = spark.createDataFrame([("1", None)], "n string, flag boolean")
    r = schemas.conform(df, "n int, name string, flag boolean, xs array<string>").first()
    assert tuple(r) == (1, "", None, None)
