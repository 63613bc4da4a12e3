"""Who opened a conversation: direction of a packet, and sums of packets into flows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import BLOCK_SECONDS, COUNTERS

# Ports of services above 1023 that count as server ports; start of client ports; flag verdicts.
SPECIAL_PORTS = (5222, 5353, 8080, 8612, 17500, 1352)
CLIENT_PORTS_ABOVE = 20_000
SERVER_PORTS_BELOW = 1024
FLAG_VERDICTS = {0x02: "keep", 0x12: "revert", 0x01: "keep", 0x11: "revert"}


def classify(dip: bytes, sport: int, dport: int, proto: int, flags: int) -> str:
    """keep, revert or unknown, for one packet."""
    if flags in FLAG_VERDICTS:
        return FLAG_VERDICTS[flags]
    if dip[:2] == b"\xe0\x00" and dip[2] in (0, 1) or dip[:4] == b"\xff\xff\xff\xff":
        return "keep"
    if proto in (6, 17):
        if (sport, dport) in ((68, 67), (67, 68)):
            return "keep" if dport == 67 else "revert"
        serves = lambda p: p < SERVER_PORTS_BELOW or p in SPECIAL_PORTS
        if serves(dport) and sport > CLIENT_PORTS_ABOVE:
            return "keep"
        if serves(sport) and dport > CLIENT_PORTS_ABOVE:
            return "revert"
    return "unknown"


def direction_column() -> Column:
    """The same over packet columns, inside whole-stage code generation."""
    sport, dport = F.col("sport"), F.col("dport")
    head = F.substring("dip", 1, 4)
    serves = lambda p: (p < SERVER_PORTS_BELOW) | p.isin(*SPECIAL_PORTS)
    ports = F.col("proto").isin(6, 17)
    case = F.when(F.lit(False), F.lit(""))
    for flags, verdict in FLAG_VERDICTS.items():
        case = case.when(F.col("tcp_flags") == flags, verdict)
    return (
        case.when(F.substring("dip", 1, 3).isin(F.lit(bytearray(b"\xe0\x00\x00")), F.lit(bytearray(b"\xe0\x00\x01"))), "keep")
        .when(head == F.lit(bytearray(b"\xff\xff\xff\xff")), "keep")
        .when(ports & (dport == 67) & (sport == 68), "keep")
        .when(ports & (dport == 68) & (sport == 67), "revert")
        .when(ports & serves(dport) & (sport > CLIENT_PORTS_ABOVE), "keep")
        .when(ports & serves(sport) & (dport > CLIENT_PORTS_ABOVE), "revert")
        .otherwise("unknown")
    )


def oriented(packets: DataFrame) -> DataFrame:
    """Packets with both ends swapped where the direction reverts, and the verdict."""
    back = F.col("direction") == "revert"
    return packets.withColumn("direction", direction_column()).withColumns(
        {a: F.when(back, F.col(b)).otherwise(F.col(a)) for a, b in (("sip", "dip"), ("dip", "sip"), ("sport", "dport"), ("dport", "sport"))}
    )


def packet_sums() -> list[Column]:
    inbound, size = F.col("inbound"), F.col("num_bytes").cast("long")
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    return [
        F.sum(F.when(inbound, size).otherwise(zero)).alias("bytes_rcvd"),
        F.sum(F.when(inbound, zero).otherwise(size)).alias("bytes_sent"),
        F.sum(F.when(inbound, one).otherwise(zero)).alias("pkts_rcvd"),
        F.sum(F.when(inbound, zero).otherwise(one)).alias("pkts_sent"),
    ]


def packets_to_flows(packets: DataFrame, seconds: int = BLOCK_SECONDS) -> DataFrame:
    """Stateless sums by block (stamped with its end) and five-tuple; ``epoch`` is the packet's time."""
    block = ((F.floor(F.col("epoch") / seconds) + 1) * seconds).cast("long")
    return oriented(packets).groupBy(block.alias("time"), "iface", "sip", "dip", "sport", "dport", "proto").agg(*packet_sums())


def roll_up(flows: DataFrame) -> DataFrame:
    """Flows without the source port, merged."""
    return flows.groupBy("time", "iface", "sip", "dip", "dport", "proto").agg(*[F.sum(c).alias(c) for c in COUNTERS])
