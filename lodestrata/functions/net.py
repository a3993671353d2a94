"""Addresses, names and traffic events."""

from __future__ import annotations

from functools import reduce
from ipaddress import ip_network
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .bound import bound
from .values import CODE_WORDS, DOH_NAMES, KNOWN_ADDRESSES, PROBE_NAMES, RESOLVERS, SECOND_LEVEL_SUFFIXES, SYSTEM_PREFIXES, TEXT_TLDS, USUAL_PORTS

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
IPV4 = rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"

# Address blocks that are not public, and those within them that are.
PRIVATE_BLOCKS = [
    "0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/4", "240.0.0.0/4",
    "::/128", "::1/128", "64:ff9b:1::/48", "100::/64", "2001::/23", "2001:db8::/32", "2002::/16", "fc00::/7", "fe80::/10", "ff00::/8",
]
PUBLIC_WITHIN = ["192.0.0.9/32", "192.0.0.10/32", "2001:1::1/128", "2001:1::2/128", "2001:3::/32", "2001:4:112::/48", "2001:20::/28", "2001:30::/28"]

#: What stands before the eight digits of an IPv4 address in a key.
_MAPPED = "0" * 20 + "ffff"


def ip_number(ip: Column) -> Column:
    """An IPv4 address as a number, null for anything else (M7)."""
    octet = lambda o, i: F.get(o, F.lit(i)).try_cast("long") * 256 ** (3 - i)
    return F.when(ip.rlike(IPV4), bound(F.split(ip, r"\."), lambda o: octet(o, 0) + octet(o, 1) + octet(o, 2) + octet(o, 3)))


def _dotted_hex(ip: Column) -> Column:
    octet = lambda i: F.substring_index(F.substring_index(ip, ".", i), ".", -1).try_cast("long") * 256 ** (4 - i)
    return F.lpad(F.lower(F.hex(octet(1) + octet(2) + octet(3) + octet(4))), 8, "0")


def ip_key(ip: Column) -> Column:
    """An address as 32 hexadecimal digits that order as addresses do, null for anything else (M7).

    IPv4 addresses are those of ::ffff:0:0/96, with which they share their keys; a zone behind `%` is left out.
    """
    none = F.array().cast("array<string>")
    groups = lambda side: F.when(side == "", none).otherwise(F.split(side, ":"))
    padded = lambda g: F.array_join(F.transform(g, lambda x: F.lpad(x, 4, "0")), "")

    def joined(sides: Column) -> Column:
        left, right = groups(F.get(sides, F.lit(0))), groups(F.coalesce(F.get(sides, F.lit(1)), F.lit("")))
        both = F.struct(left.alias("left"), right.alias("right"), F.size(sides).alias("n"))

        def whole(s: Column) -> Column:
            missing = 8 - F.size(s["left"]) - F.size(s["right"])
            good = F.when(s["n"] == 1, missing == 0).otherwise((s["n"] == 2) & (missing >= 1)) & F.forall(F.concat(s["left"], s["right"]), lambda x: x.rlike("^[0-9a-f]{1,4}$"))
            return F.when(good, F.concat(padded(s["left"]), F.repeat(F.lit("0000"), missing), padded(s["right"])))

        return bound(both, whole)

    def six(text: Column) -> Column:
        last = F.regexp_extract(text, r"([0-9.]+)$", 1)  # an address may end in an IPv4 one
        dotted = F.when(last.rlike(IPV4), bound(_dotted_hex(last), lambda h: F.concat(F.regexp_replace(text, r"[0-9.]+$", ""), F.substring(h, 1, 4), F.lit(":"), F.substring(h, 5, 4))))
        return bound(F.when(F.contains(text, F.lit(".")), dotted).otherwise(text), lambda t: joined(F.split(t, "::", -1)))

    return F.when(ip.rlike(IPV4), F.concat(F.lit(_MAPPED), _dotted_hex(ip))).when(F.contains(ip, F.lit(":")), six(F.lower(F.substring_index(ip, "%", 1))))


def masked(key: Column, bits: Column, ones: bool = False) -> Column:
    """A key whose digits behind the first bits are those of the lowest (ones: the highest) address of the block."""
    whole, rest = F.floor(bits / 4).cast("int"), (bits % 4).cast("int")
    step = F.call_function("shiftright", F.lit(16), rest)
    digit = F.conv(F.substr(key, whole + 1, F.lit(1)), 16, 10).cast("int")
    digit = F.lower(F.hex(F.floor(digit / step) * step + (step - 1 if ones else 0)))
    short = F.concat(F.substr(key, F.lit(1), whole), digit, F.repeat(F.lit("f" if ones else "0"), 31 - whole))
    return F.when(bits >= 128, key).otherwise(short)


def block_key(block: Column) -> Column:
    """struct(low, bits): the lowest key of an address or a CIDR block, and the bits of its keys that are fixed; null if it is neither."""
    base = F.substring_index(block, "/", 1)
    most = F.when(F.contains(base, F.lit(":")), 128).otherwise(32)
    bits = F.when(F.contains(block, F.lit("/")), F.substring_index(block, "/", -1).try_cast("int")).otherwise(most)
    bits = F.when(bits.between(0, most), bits + 128 - most)
    return bound(F.struct(ip_key(base).alias("key"), bits.alias("bits")), lambda s: F.when(s["key"].isNotNull() & s["bits"].isNotNull(), F.struct(masked(s["key"], s["bits"]).alias("low"), s["bits"].alias("bits"))))


def _bounds(block: str) -> tuple[str, str]:
    """First and last key of a block."""
    net = ip_network(block)
    start = (0xFFFF << 32) if net.version == 4 else 0
    return f"{start + int(net.network_address):032x}", f"{start + int(net.broadcast_address):032x}"


def is_ip(text: Column) -> Column:
    """An IPv4 or IPv6 literal."""
    return F.coalesce(text.rlike(IPV4) | (F.contains(text, F.lit(":")) & text.rlike(r"^[0-9a-fA-F:.]+$")), F.lit(False))


def is_private(ip: Column) -> Column:
    """Null, empty, malformed and non-public addresses are private."""
    return bound(ip_key(ip), private_key)


def private_key(key: Column) -> Column:
    """Whether the key of an address is null or one of a block that is not public."""
    within = lambda blocks: reduce(or_, (key.between(*_bounds(b)) for b in blocks))
    return key.isNull() | (within(PRIVATE_BLOCKS) & ~within(PUBLIC_WITHIN))


def is_name_or_below(name: Column, names: list[str]) -> Column:
    """Whether a name is one of names or a subdomain of one (F2); case matters."""
    each = [(name == x) | F.endswith(name, F.lit("." + x)) for x in names]
    out = F.lit(False)
    for e in each:
        out = out | e
    return F.coalesce(out, F.lit(False))


def is_resolver(ip: Column) -> Column:
    return F.coalesce(ip.isin(RESOLVERS), F.lit(False))


def is_doh(name: Column) -> Column:
    return is_name_or_below(name, DOH_NAMES)


def is_probe(name: Column) -> Column:
    return is_name_or_below(name, PROBE_NAMES)


def is_unusual_port(port: Column) -> Column:
    return ~port.isin(USUAL_PORTS)


def clean_name(text: Column) -> Column:
    """Lower case without white space and dots at the ends; null for blank."""
    return F.nullif(F.btrim(F.lower(F.trim(text)), F.lit(".")), F.lit(""))


def url_host(url: Column) -> Column:
    return F.lower(F.nullif(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))


def suffix_parts(host: Column, suffixes: list[str] = SECOND_LEVEL_SUFFIXES) -> Column:
    """struct(subdomain, registered_domain, suffix); all blank for addresses and blank names.

    The suffix is the last label, or the last two where those are a listed suffix.
    """
    name = clean_name(host)
    labels = F.split(name, r"\.")
    n = F.size(labels)
    tail = lambda k: F.array_join(F.slice(labels, F.greatest(n - k + 1, F.lit(1)), F.lit(k)), ".")
    width = F.when((n >= 2) & tail(2).isin(suffixes), 2).otherwise(1)
    known = name.isNotNull() & ~is_ip(name)
    text = lambda c: F.coalesce(F.when(known, c), F.lit("")).cast("string")
    suffix = F.when(width == 2, tail(2)).otherwise(tail(1))
    registered = F.when(n > width, F.when(width == 2, tail(3)).otherwise(tail(2))).otherwise("")
    below = F.when(n > width + 1, F.array_join(F.slice(labels, F.lit(1), n - width - 1), ".")).otherwise("")
    return F.struct(text(below).alias("subdomain"), text(registered).alias("registered_domain"), text(suffix).alias("suffix"))


def event_domain(sni: Column, host: Column, query: Column) -> Column:
    """The name of a packet: server name, then HTTP host, then DNS question, then blank."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in (sni, host, query)), F.lit(""))


def event_type(protocol: Column, port_a: Column, port_b: Column, sni: Column, host: Column) -> Column:
    """dns before tls before http before the bare protocol (P5)."""
    dns = (port_a == 53) | (port_b == 53)
    return F.when(dns, "dns").when(sni != "", "tls").when(host != "", "http").otherwise(F.lower(protocol))


def is_quic(protocol: Column, port_a: Column, port_b: Column) -> Column:
    return (F.upper(protocol) == "UDP") & ((port_a == 443) | (port_b == 443))


def discovery_source(dns: Column, http: Column, tls: Column, quic: Column) -> Column:
    """How a destination became known."""
    return F.when(dns, "dns").when(http, "http").when(tls, "tls").when(quic, "quic").otherwise("unknown")


def resolver_of(dst_port: Column, dst_ip: Column, src_ip: Column) -> Column:
    """The resolver of a DNS packet: where a question goes to or an answer comes from."""
    return F.when(dst_port == 53, dst_ip).otherwise(src_ip)


def query_type(answers: Column) -> Column:
    """AAAA if any answer is an IPv6 address."""
    return F.when(F.exists(answers, lambda x: F.contains(x, F.lit(":"))), "AAAA").otherwise("A")


def plausible_domain(text: Column, tlds: list[str] = TEXT_TLDS) -> Column:
    """Whether a dotted word of a text may be a domain.

    It ends in one of tlds, has a letter before that, labels of letters, digits, `-` and `_` without
    `-` at an end, and neither a package's or system's prefix nor a word of code in it.
    """
    low = F.lower(F.trim(text))
    labels = F.split(low, r"\.")
    system = F.lit(False)
    for p in SYSTEM_PREFIXES:
        system = system | F.startswith(low, F.lit(p))
    before = F.slice(labels, F.lit(1), F.greatest(F.size(labels) - 1, F.lit(0)))
    return F.coalesce(
        F.contains(low, F.lit("."))
        & ~system
        & ~low.rlike("|".join(CODE_WORDS))
        & F.element_at(labels, -1).isin(tlds)
        & F.forall(labels, lambda x: x.rlike("^[a-z0-9_-]+$") & ~x.rlike("^-|-$"))
        & F.exists(before, lambda x: x.rlike("[a-z]")),
        F.lit(False),
    )


def plausible_endpoint(ip: Column, explicit: Column) -> Column:
    """Addresses with a protocol or port are endpoints; bare ones only if well known or of a private network.

    Numbers may have leading zeros, as long as they are no more than 255.
    """
    parts = F.transform(F.split(ip, r"\."), lambda x: F.when(x.rlike(r"^\d{1,9}$"), x).try_cast("int"))
    whole = (F.size(parts) == 4) & F.forall(parts, lambda x: x.isNotNull() & (x <= 255))
    one, two = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    private = (one == 10) | ((one == 192) & (two == 168)) | ((one == 172) & two.between(16, 31))
    return F.coalesce(whole & (explicit | ip.isin(KNOWN_ADDRESSES) | private), F.lit(False))
