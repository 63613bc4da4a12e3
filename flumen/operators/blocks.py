"""Statistics of blocks and interfaces."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import BLOCK_SECONDS, DAY_SECONDS


def day_of(column: str = "time"):
    """Start of the UTC day of an epoch time."""
    return F.col(column) - F.pmod(F.col(column), F.lit(DAY_SECONDS))


def block_meta(flows: DataFrame) -> DataFrame:
    """A row for each interface and block: flows and traffic; capture counters are unknown (-1) here."""
    unknown = [F.lit(-1).cast("long").alias(f"pcap_packets_{k}") for k in ("received", "dropped", "if_dropped")]
    counted = flows.groupBy("iface", "time").agg(
        F.sum(F.col("pkts_rcvd") + F.col("pkts_sent")).alias("packets_logged"), F.count("*").alias("flowcount"), F.sum(F.col("bytes_rcvd") + F.col("bytes_sent")).alias("traffic")
    )
    return counted.select("iface", day_of("time").alias("day"), F.col("time").alias("timestamp"), *unknown, "packets_logged", "flowcount", "traffic")


def summary(meta: DataFrame) -> DataFrame:
    """A row for each interface, from block metadata only."""
    return meta.groupBy("iface").agg(F.sum("flowcount").alias("flowcount"), F.sum("traffic").alias("traffic"), F.min("timestamp").alias("begin"), F.max("timestamp").alias("end"))


def listing(summaries: DataFrame) -> DataFrame:
    """Interfaces by name, then the grand total."""
    total = summaries.agg(F.sum("flowcount").alias("flowcount"), F.sum("traffic").alias("traffic")).selectExpr(
        "'Total' AS iface", "flowcount", "traffic", "CAST(NULL AS BIGINT) AS begin", "CAST(NULL AS BIGINT) AS end", "1 AS last"
    )
    return summaries.withColumn("last", F.lit(0)).unionByName(total).orderBy("last", "iface").drop("last")


def covered_span(meta: DataFrame) -> DataFrame:
    return meta.agg((F.min("timestamp") - BLOCK_SECONDS).alias("span_first"), F.max("timestamp").alias("span_last"))


def counter_deltas(stats: DataFrame, counters: tuple[str, ...], key: str = "iface", time: str = "time") -> DataFrame:
    """Differences of monotone counters between successive rows of a source; the first row keeps its value.

    Null counters (no statistics that time) give null and are passed over by the next difference.
    """
    w = Window.partitionBy(key).orderBy(time)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    return stats.select(key, time, *[(F.col(c) - F.coalesce(F.last(c, ignorenulls=True).over(before), F.lit(0))).alias(f"delta_{c}") for c in counters])


def error_counts(packets: DataFrame, error: str = "error") -> DataFrame:
    """Packets for each distinct decode error."""
    return packets.where(F.col(error).isNotNull()).groupBy(error).agg(F.count("*").alias("n"))
