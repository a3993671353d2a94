"""Table schemas, and tables made to conform to them (P29, 1.3)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def schema_of(ddl: str) -> T.StructType:
    """The schema; Spark parses it, so a session must be there."""
    return T.StructType.fromDDL(ddl)


SAMPLE_INDEX = "sample_id string, package_name string, app_country_code string, source_path string, apk_sha256 string, app_country_name string, app_store string, collection_batch string, notes string"
SDKS = "sample_id string, package_name string, sdk_name string, sdk_identifier string, sdk_version string, sdk_version_source string, sdk_version_confidence string"
RANGE = "struct<start_including:string,start_excluding:string,end_including:string,end_excluding:string>"
CVES = f"cve_id string, vendor string, product string, severity string, score double, published string, version_ranges array<{RANGE}>"
EVENTS = (
    "file string, number long, time double, event_type string, domain string, src_ip string, dst_ip string, src_port int, dst_port int, "
    "protocol string, payload_size long, dns_query string, dns_answers array<string>, tls_sni string, http_host string, http_url string, "
    "http_headers map<string,string>, http_body string"
)
RESOLVERS = "ip_address string, provider string, canonical_provider string, resolver_name string, provider_country string, supports_doh boolean, supports_dot boolean, supports_dnscrypt boolean, source_dataset string, confidence string"
TRACKERS = "domain_suffix string, vendor string, canonical_vendor string, category string, source_dataset string, source_version string"
API_RULES = "framework string, package_name string, class_name string, method_name string, api_type string, permission string, sources array<string>, source_versions array<string>, android_versions array<int>, category string, min_level int, max_level int"
_EMPTY = {"string": "", "long": 0, "int": 0, "bigint": 0, "double": 0.0}


def conform(df: DataFrame, schema: str, keep_null: tuple[str, ...] = ()) -> DataFrame:
    """Exactly the schema's columns in its order: missing ones are added, and nulls become the type's default.

    Booleans, arrays, maps and structs stay null, as do the columns of keep_null.
    """
    out = []
    for f in schema_of(schema):
        kind = f.dataType.simpleString()
        value = F.col(f.name).try_cast(f.dataType) if f.name in df.columns and f.dataType.typeName() not in ("array", "map", "struct") else F.col(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType)
        default = _EMPTY.get(kind)
        out.append((value if default is None or f.name in keep_null else F.coalesce(value, F.lit(default))).alias(f.name))
    return df.select(*out)
