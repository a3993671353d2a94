"""From packets to connections, DNS records, places and app summaries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.net import is_doh, is_probe, is_resolver, is_unusual_port, query_type, resolver_of, suffix_parts
from ..functions.values import CLOUD_OWNERS, NO_LOCATION
from ..operators.joins import cidr_lookup, longest_suffix, range_lookup
from ..operators.merges import as_map, distinct_counts, distribution, fan_out, first_seen, flows, sum_where, top_shares

APP = ["sample_id", "session_id"]
FLOW = [*APP, "domain", "dst_ip", "dst_port", "protocol"]


@dataclass
class Rules:
    """The rule tables that traffic is held against."""

    trackers: DataFrame
    resolvers: DataFrame
    places: DataFrame


def dns_records(events: DataFrame, rules: Rules) -> DataFrame:
    """One row per DNS packet with its resolver and what is known of it.

    Of several blocks that hold an address the first by the rules' `pos` counts, as `tabular.positioned` gives it, else by text.
    """
    dns = events.where("event_type = 'dns'").withColumn("resolver_ip", resolver_of(F.col("dst_port"), F.col("dst_ip"), F.col("src_ip")))
    known = rules.resolvers.select(F.col("ip_address").alias("rule_ip"), "canonical_provider", (F.col("pos") if "pos" in rules.resolvers.columns else F.col("ip_address")).alias("rule_pos"))
    out = cidr_lookup(dns, "resolver_ip", known, "rule_ip", "rule_pos")
    return out.select(
        *APP, "time", F.col("dns_query").alias("query_name"), "resolver_ip", F.col("dns_answers").alias("response_ips"),
        F.size("dns_answers").alias("response_count"), query_type(F.col("dns_answers")).alias("query_type"),
        is_resolver(F.col("resolver_ip")).alias("is_hardcoded_resolver"), is_doh(F.col("dns_query")).alias("is_doh_resolver"),
        is_probe(F.col("dns_query")).alias("is_anti_analysis_probe"), F.col("canonical_provider").alias("dns_provider"),
    )


def connections(events: DataFrame, rules: Rules) -> DataFrame:
    """Flows with tracker, place, network and resolver facts."""
    flagged = events.select(
        *FLOW, "time", "payload_size", "is_quic", (F.col("event_type") == "tls").alias("is_tls"), (F.col("event_type") == "dns").alias("is_dns"), (F.col("event_type") == "http").alias("is_http")
    )
    out = flows(flagged, FLOW, "time", "payload_size", ["is_quic", "is_tls", "is_dns", "is_http"])
    out = longest_suffix(out, "domain", rules.trackers.select("domain_suffix", "canonical_vendor", F.col("category").alias("tracker_category")), "domain_suffix")
    out = range_lookup(out, "dst_ip", rules.places, "ip_from", "ip_to")
    parts = suffix_parts(F.col("domain"))
    return out.select(
        *FLOW, "packets", "bytes", "first_seen", "last_seen", "is_quic", "is_tls", "is_dns", "is_http", parts["registered_domain"].alias("registered_domain"),
        F.col("domain_suffix").isNotNull().alias("tracker_matched"), "canonical_vendor", "tracker_category", "country_code", "continent", "asn", "organization",
        is_unusual_port(F.col("dst_port")).alias("is_nonstandard_port"), is_resolver(F.col("dst_ip")).alias("is_hardcoded_dns"), is_probe(F.col("domain")).alias("is_anti_analysis_probe"),
    )


def domain_places(found: DataFrame) -> DataFrame:
    """The first of each sample's (name, address) pairs, with its place (A3)."""
    named = found.where("domain <> '' and dst_ip <> ''")
    return first_seen(named, ["sample_id", "domain", "dst_ip"], ["first_seen", "dst_port", "protocol"]).select("sample_id", "domain", "dst_ip", "country_code", "continent", "asn", "organization")


def personal_data_counts(facts: DataFrame) -> DataFrame:
    """(APP, pii_matches, pii_categories, pii_patterns and how many of each): of facts (APP, connection, location, pattern_name, category, value), each counted once."""
    once = facts.dropDuplicates([*APP, "connection", "location", "pattern_name", "value"])
    total = once.groupBy(*APP).agg(F.count("*").alias("pii_matches"))
    for column, name in (("category", "pii_categories"), ("pattern_name", "pii_patterns")):
        total = total.join(as_map(distribution(once, APP, column), APP, column, name), APP)
    return total


def app_summary(found: DataFrame, dns: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """One wide row per app session (A4-A13), with counts of personal data where its facts are given."""
    named, tracker = F.col("domain") != "", F.col("tracker_matched")
    volume = found.groupBy(*APP).agg(
        F.count("*").alias("connections"), F.sum("packets").alias("packets"), F.sum("bytes").alias("bytes"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
        (F.max("last_seen") - F.min("first_seen")).alias("duration"),
        *sum_where({"tracker_packets": tracker, "quic_packets": F.col("is_quic"), "unusual_port_packets": F.col("is_nonstandard_port"), "cleartext_packets": F.col("is_http") & ~F.col("is_quic")}, "packets"),
        F.bool_or("is_hardcoded_dns").alias("uses_hardcoded_dns"), F.bool_or("is_anti_analysis_probe").alias("probes"),
    )
    kinds = {"domains": named, "tracker_domains": tracker, "first_party_domains": ~tracker, "tls_domains": F.col("is_tls"), "http_domains": F.col("is_http")}
    kinds |= {f"{k}_domains": F.lower("organization").rlike("|".join(v)) for k, v in CLOUD_OWNERS.items()}
    real = lambda c: found.where(named & ~F.upper(F.coalesce(F.col(c).cast("string"), F.lit(""))).isin(NO_LOCATION))
    placed = real("country_code")
    parts = [
        distinct_counts(found, APP, kinds, "domain"),
        as_map(distribution(placed, APP, "country_code", "domain"), APP, "country_code", "countries"),
        as_map(distribution(real("asn"), APP, "asn", "domain"), APP, "asn", "asns"),
        as_map(distribution(found.where(tracker), APP, "canonical_vendor", "domain"), APP, "canonical_vendor", "vendors"),
        as_map(distribution(found.where(tracker), APP, "tracker_category", weight="packets"), APP, "tracker_category", "categories"),
        top_shares(distribution(real("organization"), APP, "organization", "domain"), APP, "organization", 5).groupBy(*APP).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "organization"))), lambda x: x["organization"]).alias("top_organizations")),
        fan_out(dns.where("query_name <> ''"), APP, "query_name", "response_ips"),
        dns.groupBy(*APP).agg(F.count("*").alias("dns_packets"), F.bool_or("is_doh_resolver").alias("uses_doh")),
    ]
    if facts is not None:
        parts.append(personal_data_counts(facts))
    for p in parts:
        volume = volume.join(p, APP, "left")
    return volume
