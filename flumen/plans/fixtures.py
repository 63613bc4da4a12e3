"""Flow and packet views over the driver's tables, in Spark and, for checking, in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_EPOCH = "timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {})"


def flows_of_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows from ``events``: 150 users (every tenth with IPv6) talking to fifteen servers."""
    return (
        spark.read.parquet(f"{sf_dir}/events.parquet")
        .selectExpr(
            f"(CAST(floor({_EPOCH.format('ts')} / 300.0D) AS BIGINT) + 1) * 300 AS time",
            """unhex(CASE WHEN user_id % 10 = 0 THEN concat('20010db8', lpad(hex(user_id), 24, '0'))
                 ELSE concat('0A00', lpad(hex(CAST(user_id / 100 AS BIGINT)), 2, '0'), lpad(hex(user_id % 100), 2, '0'), repeat('0', 24)) END) AS sip""",
            "unhex(concat('C0A8', lpad(hex(event_id % 3), 2, '0'), lpad(hex(event_id % 5), 2, '0'), repeat('0', 24))) AS dip",
            "CASE event_type WHEN 'view' THEN 443 WHEN 'click' THEN 80 WHEN 'purchase' THEN 8080 WHEN 'signup' THEN 53 ELSE 0 END AS dport",
            "CASE event_type WHEN 'signup' THEN 17 WHEN 'error' THEN 1 ELSE 6 END AS proto",
            "CAST(floor(value * 100 + 0.5D) AS BIGINT) AS bytes_rcvd",
            "CAST(floor(value * 37 + 0.5D) AS BIGINT) AS bytes_sent",
            "CAST(floor(value) AS BIGINT) + 1 AS pkts_rcvd",
            "event_id % 5 AS pkts_sent",
            "concat('eth', CAST(user_id % 4 AS STRING)) AS iface",
        )
        .selectExpr("*", "time - pmod(time, 86400) AS day")
    )


SQL_FLOWS = """flows AS (
  SELECT time, time - time % 86400 AS day, iface, sip, dip, dport, proto, bytes_rcvd, bytes_sent, pkts_rcvd, pkts_sent FROM (
  SELECT (CAST(floor(epoch(ts) / 300.0) AS BIGINT) + 1) * 300 AS time, 'eth' || (user_id % 4) AS iface,
    CASE WHEN user_id % 10 = 0 THEN '20010db8' || lpad(lower(to_hex(user_id)), 24, '0')
         ELSE '0a00' || lpad(lower(to_hex(user_id // 100)), 2, '0') || lpad(lower(to_hex(user_id % 100)), 2, '0') || repeat('0', 24) END AS sip,
    'c0a8' || lpad(lower(to_hex(event_id % 3)), 2, '0') || lpad(lower(to_hex(event_id % 5)), 2, '0') || repeat('0', 24) AS dip,
    CASE event_type WHEN 'view' THEN 443 WHEN 'click' THEN 80 WHEN 'purchase' THEN 8080 WHEN 'signup' THEN 53 ELSE 0 END AS dport,
    CASE event_type WHEN 'signup' THEN 17 WHEN 'error' THEN 1 ELSE 6 END AS proto,
    CAST(floor(value * 100 + 0.5) AS BIGINT) AS bytes_rcvd, CAST(floor(value * 37 + 0.5) AS BIGINT) AS bytes_sent,
    CAST(floor(value) AS BIGINT) + 1 AS pkts_rcvd, event_id % 5 AS pkts_sent FROM events))"""


def flows_of_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A larger view for timing: one flow a line item, dealt over thirty days."""
    return (
        spark.read.parquet(f"{sf_dir}/lineitem.parquet")
        .selectExpr(
            f"(CAST(floor({_EPOCH.format('l_shipdate')} / 86400.0D) AS BIGINT) % 30 + 19723) * 86400 + (1 + l_orderkey % 287) * 300 AS time",
            "unhex(concat('0A', lpad(hex(l_suppkey), 6, '0'), repeat('0', 24))) AS sip",
            "unhex(concat('AC', lpad(hex(l_partkey), 6, '0'), repeat('0', 24))) AS dip",
            "CAST(element_at(array(443, 80, 53, 22, 8080), CAST(l_orderkey % 5 AS INT) + 1) AS INT) AS dport",
            "IF(l_orderkey % 5 = 2, 17, 6) AS proto",
            "CAST(l_extendedprice * 10 AS BIGINT) AS bytes_rcvd",
            "CAST(l_extendedprice AS BIGINT) AS bytes_sent",
            "CAST(l_quantity AS BIGINT) AS pkts_rcvd",
            "CAST(l_quantity / 2 AS BIGINT) AS pkts_sent",
            "concat('eth', CAST(l_linenumber % 4 AS STRING)) AS iface",
        )
        .selectExpr("*", "time - pmod(time, 86400) AS day")
    )


def packets_of_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets from ``events``; every seventh runs from server to user."""
    flows = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(
        "event_id", "ts", f"{_EPOCH.format('ts')} AS epoch", "concat('eth', CAST(user_id % 4 AS STRING)) AS iface",
        "unhex(concat('0A00', lpad(hex(CAST(user_id / 100 AS BIGINT)), 2, '0'), lpad(hex(user_id % 100), 2, '0'), repeat('0', 24))) AS a",
        "unhex(concat('C0A8', lpad(hex(event_id % 3), 2, '0'), lpad(hex(event_id % 5), 2, '0'), repeat('0', 24))) AS b",
        "CAST(20001 + event_id % 40000 AS INT) AS p",
        "CASE event_type WHEN 'view' THEN 443 WHEN 'click' THEN 80 WHEN 'purchase' THEN 8080 WHEN 'signup' THEN 53 ELSE 0 END AS q",
        "CASE event_type WHEN 'signup' THEN 17 WHEN 'error' THEN 1 ELSE 6 END AS proto",
        "CAST(pmod(floor(value * 10), 65536) AS INT) AS num_bytes", "event_id % 7 = 0 AS swap",
    )
    return flows.selectExpr(
        "event_id", "iface", "CAST(ts AS TIMESTAMP) AS ts", "epoch", "IF(swap, b, a) AS sip", "IF(swap, a, b) AS dip", "IF(swap, q, p) AS sport", "IF(swap, p, q) AS dport", "proto", "num_bytes",
        "IF(proto = 6, element_at(array(2, 18, 16, 1, 17), CAST(event_id % 5 AS INT) + 1), 0) AS tcp_flags", "event_id % 2 = 0 AS inbound",
    )


SQL_PACKETS = """raw AS (SELECT event_id, epoch(ts) AS epoch, 'eth' || (user_id % 4) AS iface,
    '0a00' || lpad(lower(to_hex(user_id // 100)), 2, '0') || lpad(lower(to_hex(user_id % 100)), 2, '0') || repeat('0', 24) AS a,
    'c0a8' || lpad(lower(to_hex(event_id % 3)), 2, '0') || lpad(lower(to_hex(event_id % 5)), 2, '0') || repeat('0', 24) AS b,
    CAST(20001 + event_id % 40000 AS INT) AS p,
    CASE event_type WHEN 'view' THEN 443 WHEN 'click' THEN 80 WHEN 'purchase' THEN 8080 WHEN 'signup' THEN 53 ELSE 0 END AS q,
    CASE event_type WHEN 'signup' THEN 17 WHEN 'error' THEN 1 ELSE 6 END AS proto,
    CAST(floor(value * 10) AS BIGINT) % 65536 AS num_bytes, event_id % 7 = 0 AS swap FROM events),
packets AS (SELECT event_id, epoch, iface, CASE WHEN swap THEN b ELSE a END AS sip, CASE WHEN swap THEN a ELSE b END AS dip,
    CASE WHEN swap THEN q ELSE p END AS sport, CASE WHEN swap THEN p ELSE q END AS dport, proto, num_bytes,
    CASE WHEN proto = 6 THEN [2, 18, 16, 1, 17][event_id % 5 + 1] ELSE 0 END AS tcp_flags, event_id % 2 = 0 AS inbound FROM raw)"""
