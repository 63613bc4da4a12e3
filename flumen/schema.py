"""Schemas and constants of the flow model. No column is ever null."""

from __future__ import annotations

from pyspark.sql import types as T

BLOCK_SECONDS = 300
DAY_SECONDS = 86_400
DEFAULT_LIMIT = 1000

KEYS = ("sip", "dip", "dport", "proto")
COUNTERS = ("bytes_rcvd", "bytes_sent", "pkts_rcvd", "pkts_sent")


def _schema(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, False) for n, t in fields])


_LONG, _INT, _TEXT, _BYTES = T.LongType(), T.IntegerType(), T.StringType(), T.BinaryType()

#: One row a flow and block. ``time`` is the end of the block; addresses have 16 bytes, IPv4 in the first four.
FLOWS = _schema(
    ("time", _LONG), ("sip", _BYTES), ("dip", _BYTES), ("dport", _INT), ("proto", _INT), *[(c, _LONG) for c in COUNTERS], ("iface", _TEXT), ("day", _LONG)
)
BLOCK_META = _schema(
    ("iface", _TEXT), ("day", _LONG), ("timestamp", _LONG), ("pcap_packets_received", _LONG), ("pcap_packets_dropped", _LONG),
    ("pcap_packets_if_dropped", _LONG), ("packets_logged", _LONG), ("flowcount", _LONG), ("traffic", _LONG),
)
SUMMARY = _schema(("iface", _TEXT), ("flowcount", _LONG), ("traffic", _LONG), ("begin", _LONG), ("end", _LONG))
PACKETS = _schema(
    ("iface", _TEXT), ("ts", T.TimestampType()), ("sip", _BYTES), ("dip", _BYTES), ("sport", _INT), ("dport", _INT), ("proto", _INT),
    ("num_bytes", _INT), ("tcp_flags", _INT), ("inbound", T.BooleanType()),
)
