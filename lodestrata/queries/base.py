"""Registration of queries, and the columns that several of them derive from the shared tables.

The shared tables hold no apps or packets, so identifiers, hosts, addresses and versions are made
from their keys by the same integer arithmetic in Spark and in SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import scratch  # noqa: F401

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its name, with the SQL that gives the same rows."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def values(spark: SparkSession, schema: str, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def sql_values(rows: list[tuple]) -> str:
    """Rows as a VALUES list."""
    one = lambda x: "NULL" if x is None else str(x).lower() if isinstance(x, bool) else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    return "VALUES " + ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows)


HOSTS = ["ads.track.example.com", "cdn.example.org", "dns.google", "", "api.shop.co.uk", "captive.apple.com"]
PORTS = [443, 53, 80, 8080, 5228, 6000]


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as packets: sample, session, host, address, port, protocol and size."""
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    u, i = F.col("user_id"), F.col("event_id")
    ip = (
        F.when(u % 5 == 0, F.lit("8.8.8.8")).when(u % 5 == 1, F.concat(F.lit("10.1.2."), i % 250))
        .when(u % 5 == 2, F.concat(F.lit("23.5.113."), i % 200)).when(u % 5 == 3, F.concat(F.lit("192.168.2."), i % 100)).otherwise("1.1.1.1")
    )
    pick = lambda xs, n: F.element_at(F.array(*map(F.lit, xs)), (n + 1).cast("int"))
    return e.select(
        F.concat(F.lit("app"), u % 20).alias("sample_id"), F.col("event_type").alias("session_id"), "event_id", "user_id", "ts", "k",
        pick(HOSTS, (i + u) % 6).alias("domain"), ip.alias("dst_ip"), pick(PORTS, F.col("k") % 6).alias("dst_port"),
        F.when(i % 4 == 0, "UDP").otherwise("TCP").alias("protocol"), F.round(F.col("value") * 100).cast("long").alias("size"),
    )


PACKETS = f"""packets AS (
  SELECT 'app' || (user_id % 20) AS sample_id, event_type AS session_id, event_id, user_id, ts, k,
         ({HOSTS})[(event_id + user_id) % 6 + 1] AS domain,
         CASE user_id % 5 WHEN 0 THEN '8.8.8.8' WHEN 1 THEN '10.1.2.' || (event_id % 250) WHEN 2 THEN '23.5.113.' || (event_id % 200)
              WHEN 3 THEN '192.168.2.' || (event_id % 100) ELSE '1.1.1.1' END AS dst_ip,
         ({PORTS})[k % 6 + 1] AS dst_port, CASE WHEN event_id % 4 = 0 THEN 'UDP' ELSE 'TCP' END AS protocol,
         CAST(round(value * 100) AS BIGINT) AS size
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events))"""

#: The host of a page.
HOST_SQL = r"""nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '')"""
