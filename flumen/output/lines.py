"""Line formats that are written by the executors: CSV rows, line protocol, syslog lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.net import ip_text
from ..functions.protocols import protocol_name
from ..plans.query import Planned

#: Default name of the measurement; a parameter, so that existing series can be continued.
MEASUREMENT = "flows"
# The columns that are tags.
TAGS = ("iface", "proto")


def escaped(c: Column) -> Column:
    return F.regexp_replace(c, r"([\\, ])", r"\\$1")


def influx_lines(planned: Planned, measurement: str = MEASUREMENT) -> DataFrame:
    """Line protocol of all groups: tags by name, text fields escaped, counters with an ``i``, nanoseconds."""
    rows = planned.rows
    tags = [F.concat(F.lit(f",{t}="), F.col(t)) for t in TAGS if t in rows.columns]
    fields = []
    for name in rows.columns:
        if name in ("sip", "dip"):
            fields.append(F.concat(F.lit(f"{name}="), escaped(F.col(name))))
        elif name == "dport":
            fields.append(F.concat(F.lit("dport="), F.col(name).cast("string")))
        elif name.startswith(("packets", "bytes")) and not name.endswith("percent"):
            fields.append(F.concat(F.lit(f"{name}="), F.col(name).cast("string"), F.lit("i")))
    parts = [F.lit(measurement), *tags, F.lit(" "), F.concat_ws(",", *fields)]
    if "time" in rows.columns:
        parts += [F.lit(" "), (F.col("time") * 1_000_000_000).cast("string")]
    return rows.select(F.concat(*parts).alias("line"))


def syslog_lines(flows: DataFrame) -> DataFrame:
    """One line a flow: time, iface, sip, dip, dport, proto, packets and bytes received and sent."""
    cols = [F.col("time"), F.col("iface"), ip_text("sip"), ip_text("dip"), F.col("dport"), protocol_name(F.col("proto"))]
    cols += [F.col(c) for c in ("pkts_rcvd", "pkts_sent", "bytes_rcvd", "bytes_sent")]
    return flows.select(F.concat_ws(",", *[c.cast("string") for c in cols]).alias("line"))


def csv_lines(planned: Planned) -> DataFrame:
    """Rows of the CSV output, in print order of the columns."""
    rows = planned.rows
    order = [c for c in rows.columns if not c.startswith(("packets", "bytes"))]
    order += [c for c in rows.columns if c.startswith("packets") and c != "packets_percent"] + ["packets_percent"]
    order += [c for c in rows.columns if c.startswith("bytes") and c != "bytes_percent"] + ["bytes_percent"]
    text = [F.format_string("%.2f", F.col(c)) if c.endswith("percent") else F.col(c).cast("string") for c in order]
    return rows.select(F.concat_ws(",", *text).alias("line"))
