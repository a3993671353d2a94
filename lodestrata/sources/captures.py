"""Captured packets as rows of fields (S9-S12), in column functions over the hexadecimal text of each frame.

Whatever cuts capture files into frames gives the table (file, number, time, link, frame); one frame
is one row, so files of any size are dealt to as many tasks as the table has partitions. IPv4 with
TCP or UDP, raw or in Ethernet frames; what cannot be decoded above that stays blank. The packets are
written as a table, and plans take that: no filter or join above it reaches into the decoding.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bound import bound
from ..functions.net import event_domain, event_type, is_quic
from ..schemas import EVENTS, schema_of
from ..tables import written

ETHERNET, RAW = 1, (12, 14, 101, 228)


def _number(text: Column, at: Column, size: int) -> Column:
    """The number of so many bytes at a place, null beyond the end."""
    return F.conv(F.nullif(F.substr(text, at * 2 + 1, F.lit(2 * size)), F.lit("")), 16, 10).cast("int")


def _bytes(text: Column, at: Column, size: Column) -> Column:
    return F.substr(text, at * 2 + 1, size * 2)


def _latin(text: Column) -> Column:
    return F.decode(F.unhex(text), "ISO-8859-1")


def _times(n: Column) -> Column:
    return F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))


def _fitting(text: Column, at: int, least: int) -> Column:
    """As many turns as a count in a message says, and no more than entries of so many bytes find room in it."""
    return _times(F.least(_number(text, F.lit(at), 2), F.floor(F.length(text) / (2 * least)).cast("int")))


def _dotted(text: Column, at: Column) -> Column:
    return F.concat_ws(".", *(_number(text, at + i, 1).cast("string") for i in range(4)))


def _after_name(text: Column, start: Column) -> Column:
    """Where a name of a DNS message ends: after its last label, or after a pointer."""
    state = lambda at, done: F.struct(at.alias("at"), done.alias("done"))

    def step(s: Column, _: Column) -> Column:
        one = lambda size: F.when(size >= 192, state(s["at"] + 2, F.lit(True))).when(size > 0, state(s["at"] + 1 + size, F.lit(False))).otherwise(state(s["at"] + 1, F.lit(True)))
        return F.when(s["done"], s).otherwise(bound(_number(text, s["at"], 1), one))

    return F.aggregate(F.sequence(F.lit(1), F.lit(128)), state(start, F.lit(False)), step, lambda s: s["at"])


def dns_name(text: Column) -> Column:
    """The name of the first question of a DNS message, blank if it is broken."""
    state = lambda at, name: F.struct(at.alias("at"), name.alias("name"))

    def step(s: Column, _: Column) -> Column:
        label = lambda size: _latin(_bytes(text, s["at"] + 1, size))
        longer = lambda size: state(s["at"] + 1 + size, F.concat(s["name"], F.when(s["name"] == "", "").otherwise("."), label(size)))
        return bound(_number(text, s["at"], 1), lambda size: F.when(size.between(1, 63), longer(size)).otherwise(s))

    return F.aggregate(F.sequence(F.lit(1), F.lit(128)), state(F.lit(12), F.lit("")), step, lambda s: F.coalesce(F.when(_number(text, s["at"], 1) == 0, s["name"]), F.lit("")))


def dns_addresses(text: Column) -> Column:
    """The addresses among the answers of a DNS message."""
    none = F.array().cast("array<string>")
    state = lambda at, found: F.struct(at.alias("at"), found.alias("found"))
    start = F.aggregate(_fitting(text, 4, 5), F.lit(12), lambda at, _: _after_name(text, at) + 4)

    def answer(s: Column, at: Column) -> Column:
        kind, size = _number(text, at, 2), _number(text, at + 8, 2)
        group = lambda i: F.lower(F.coalesce(F.nullif(F.ltrim(F.substr(text, (at + 10 + 2 * i) * 2 + 1, F.lit(4)), F.lit("0")), F.lit("")), F.lit("0")))
        found = F.when((kind == 1) & (size == 4), _dotted(text, at + 10)).when((kind == 28) & (size == 16), F.concat_ws(":", *(group(i) for i in range(8))))
        more = F.when(found.isNotNull() & (F.length(text) >= (at + 10 + size) * 2), F.array_append(s["found"], found)).otherwise(s["found"])
        return F.when(size.isNull(), s).otherwise(state(at + 10 + size, more))

    step = lambda s, _: bound(_after_name(text, s["at"]), lambda at: answer(s, at))
    return F.coalesce(F.aggregate(_fitting(text, 6, 12), state(start, none), step, lambda s: s["found"]), none)


def server_name(text: Column) -> Column:
    """The server name of a TLS ClientHello, blank for anything else."""
    # the session id, the cipher suites and the compression methods each begin with their size
    skip = lambda at, size: at + size + _number(text, at, size)
    at = F.aggregate(F.array(*map(F.lit, (1, 2, 1))), F.lit(43), skip) + 2
    state = lambda at, name: F.struct(at.alias("at"), name.alias("name"))

    def step(s: Column, _: Column) -> Column:
        kind, size = _number(text, s["at"], 2), _number(text, s["at"] + 2, 2)
        name = F.lower(_latin(_bytes(text, s["at"] + 9, _number(text, s["at"] + 7, 2))))
        return F.when((s["name"] != "") | size.isNull(), s).when((kind == 0) & (size > 5), state(s["at"], name)).otherwise(state(s["at"] + 4 + size, F.lit("")))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(128)), state(at, F.lit("")), step, lambda s: s["name"])
    return F.coalesce(F.when(text.rlike("^16.{8}01"), found), F.lit(""))


def http_request(text: Column) -> Column:
    """struct(host, url, headers, body) of an HTTP/1 request, blank for anything else (S12); of repeated headers the last counts."""
    return bound(F.struct(text.alias("text"), _latin(text).alias("plain")), lambda s: _request(s["text"], s["plain"]))


def _request(text: Column, plain: Column) -> Column:
    first = F.regexp_extract(plain, r"^\S+ (\S+) HTTP/1\.[^\r\n]*(?:\r\n|$)", 1)
    is_request = plain.rlike(r"^\S+ \S+ HTTP/1\.[^\r\n]*(?:\r\n|$)")
    lines = F.split(F.substring_index(plain, "\r\n\r\n", 1), "\r\n")
    pairs = F.transform(
        F.filter(F.slice(lines, 2, 1000), lambda x: F.contains(x, F.lit(":"))),
        lambda x: F.struct(F.lower(F.trim(F.substring_index(x, ":", 1))).alias("k"), F.trim(F.regexp_replace(x, "^[^:]*:", "")).alias("v")),
    )
    last = lambda ps: F.filter(ps, lambda p, i: ~F.exists(F.slice(ps, i + 2, F.size(ps)), lambda q: q["k"] == p["k"]))
    named = bound(pairs, lambda ps: F.map_from_entries(last(ps)))
    end = F.instr(plain, "\r\n\r\n")
    raw = F.when(end > 0, F.unhex(F.substr(text, (end + 3) * 2 + 1)))
    body = bound(raw, lambda r: F.coalesce(F.try_validate_utf8(r.cast("string")), F.decode(r, "ISO-8859-1"), F.lit("")))

    def whole(headers: Column) -> Column:
        host = F.lower(F.coalesce(F.try_element_at(headers, F.lit("host")), F.lit("")))
        host = F.when(F.startswith(host, F.lit("[")), F.regexp_extract(host, r"^\[([^\]]*)", 1)).otherwise(F.substring_index(host, ":", 1))
        return F.struct(host.alias("host"), first.alias("url"), headers.alias("headers"), body.alias("body"))

    none = F.struct(F.lit("").alias("host"), F.lit("").alias("url"), F.create_map().cast("map<string,string>").alias("headers"), F.lit("").alias("body"))
    return F.when(F.coalesce(is_request, F.lit(False)), bound(named, whole)).otherwise(none)


def packets(frames: DataFrame) -> DataFrame:
    """One row per IPv4 TCP or UDP packet of frames (file, number, time, link, frame), with its type and name."""
    h = F.hex("frame")
    ip = F.when((F.col("link") == ETHERNET) & (F.substring(h, 25, 4) == "0800"), F.substring(h, 29, 1 << 20)).when(F.col("link").isin(*RAW), h)
    rows = frames.select("file", "number", "time", ip.alias("ip")).where(F.col("ip").rlike("^4.{17}(06|11)"))
    head, total = _number(F.col("ip"), F.lit(0), 1) % 16 * 4, _number(F.col("ip"), F.lit(2), 2)
    body = F.when(total > 0, _bytes(F.col("ip"), head, F.greatest(total - head, F.lit(0)))).otherwise(F.substr("ip", head * 2 + 1))
    rows = rows.select("file", "number", "time", _dotted(F.col("ip"), F.lit(12)).alias("src_ip"), _dotted(F.col("ip"), F.lit(16)).alias("dst_ip"), (_number(F.col("ip"), F.lit(9), 1) == 6).alias("tcp"), body.alias("part"))
    part = F.col("part")
    skip = F.when(F.col("tcp"), F.floor(_number(part, F.lit(12), 1) / 16).cast("int") * 4).otherwise(8)
    rows = rows.where(F.length("part") >= 16).select(
        "file", "number", "time", "src_ip", "dst_ip", _number(part, F.lit(0), 2).alias("src_port"), _number(part, F.lit(2), 2).alias("dst_port"), "tcp",
        F.coalesce(F.substr(part, skip * 2 + 1), F.lit("")).alias("payload"),
    )
    rows = written(rows, "payloads")
    dns = ~F.col("tcp") & ((F.col("src_port") == 53) | (F.col("dst_port") == 53))
    data = F.col("payload")
    found = rows.select(
        "file", "number", "time", "src_ip", "dst_ip", "src_port", "dst_port", "tcp", "payload", F.when(dns, bound(data, dns_name)).otherwise("").alias("dns_query"),
        F.when(dns, bound(data, dns_addresses)).otherwise(F.array().cast("array<string>")).alias("dns_answers"), F.when(F.col("tcp"), bound(data, server_name)).otherwise("").alias("tls_sni"),
    )
    found = written(found, "names").withColumn("http", http_request(F.when(F.col("tcp") & (F.col("tls_sni") == ""), data).otherwise("")))
    rows = found.select(
        "file", "number", "time", "src_ip", "dst_ip", "src_port", "dst_port", F.when(F.col("tcp"), "TCP").otherwise("UDP").alias("protocol"), (F.length(data) / 2).cast("long").alias("payload_size"),
        "dns_query", "dns_answers", "tls_sni", F.col("http.host").alias("http_host"), F.col("http.url").alias("http_url"), F.col("http.headers").alias("http_headers"), F.col("http.body").alias("http_body"),
    )
    ports = (F.col("src_port"), F.col("dst_port"))
    out = rows.withColumn("domain", event_domain(F.col("tls_sni"), F.col("http_host"), F.col("dns_query")))
    out = out.withColumn("event_type", event_type(F.col("protocol"), *ports, F.col("tls_sni"), F.col("http_host")))
    return written(out.select(*schema_of(EVENTS).fieldNames(), is_quic(F.col("protocol"), *ports).alias("is_quic")), "packets")
