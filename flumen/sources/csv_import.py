"""Import of flows from CSV.

Columns are named by a header line or a given schema; names that are not known are ignored. Rows with a
field that cannot be read, or with too few fields, are set aside. Rows with the same interface, time
and key are summed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.net import ip_bytes
from ..functions.protocols import NUMBERS
from ..operators.blocks import day_of
from ..schema import COUNTERS, FLOWS

# Names of counters in exports.
COUNTER_NAMES = {"packets sent": "pkts_sent", "data vol. sent": "bytes_sent", "packets received": "pkts_rcvd", "data vol. received": "bytes_rcvd"}
_KNOWN = ("time", "iface", "sip", "dip", "dport", "proto", *COUNTER_NAMES)


def _whole(column: str, most: int | None = None):
    value = F.expr(f"try_cast(trim(`{column}`) AS BIGINT)")
    ok = value >= 0
    return F.when(ok & (value <= most) if most is not None else ok, value)


def _parsers() -> dict:
    names = F.create_map(*[F.lit(x) for pair in NUMBERS.items() for x in pair])
    return {
        "time": ("time", lambda c: F.expr(f"try_cast(trim(`{c}`) AS BIGINT)")),
        "iface": ("iface", lambda c: F.when(F.trim(c) != "", F.trim(c))),
        "sip": ("sip", ip_bytes),
        "dip": ("dip", ip_bytes),
        "dport": ("dport", lambda c: _whole(c, 65_535).cast("int")),
        "proto": ("proto", lambda c: F.coalesce(_whole(c, 255).cast("int"), F.try_element_at(names, F.lower(F.trim(c))))),
    } | {name: (target, _whole) for name, target in COUNTER_NAMES.items()}


def read_csv(spark: SparkSession, path: str, schema: str | None = None, iface: str | None = None, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(flows, rejected lines). ``schema`` is a comma-separated list of names for files without a header."""
    if schema is None:
        first = spark.read.text(path).first()
        if first is None:
            raise ValueError("the file is empty")
        names = [n.strip().strip('"') for n in first["value"].split(",")]
    else:
        names = [n.strip() for n in schema.split(",")]
    if not any(n in _KNOWN for n in names):
        raise ValueError("none of the columns is known")
    # fields by place: titles may repeat and hold dots; the first of a known title counts
    columns = [f"c{k}" for k in range(len(names))]
    known = {c: n for k, (c, n) in enumerate(zip(columns, names, strict=True)) if n in _KNOWN and names.index(n) == k}
    shape = T.StructType([T.StructField(c, T.StringType()) for c in columns] + [T.StructField("_corrupt", T.StringType())])
    raw = spark.read.schema(shape).option("header", schema is None).option("enforceSchema", "true").option("columnNameOfCorruptRecord", "_corrupt").option("mode", "PERMISSIVE").csv(path)
    if limit is not None:
        raw = raw.limit(limit)
    parsers = _parsers()
    parsed = [parsers[n][1](c).alias(parsers[n][0]) for c, n in known.items()]
    have = {parsers[n][0] for n in known.values()}
    defaults = {"dport": F.lit(0), "proto": F.lit(0), "sip": F.lit(bytearray(16)), "dip": F.lit(bytearray(16))} | {c: F.lit(0).cast("long") for c in COUNTERS}
    if iface is not None and "iface" not in have:
        defaults["iface"] = F.lit(iface)
    if missing := {"time", "iface"} - have - set(defaults):
        raise ValueError(f"no column gives {', '.join(sorted(missing))}")
    rows = raw.select(*parsed, *[v.alias(k) for k, v in defaults.items() if k not in have], F.concat_ws(",", *columns).alias("_line"), "_corrupt")
    fields = [f.name for f in FLOWS if f.name != "day"]
    good = F.col("_corrupt").isNull()
    for name in fields:
        good = good & F.col(name).isNotNull()
    flows = rows.where(good).groupBy("time", "iface", "sip", "dip", "dport", "proto").agg(*[F.sum(c).alias(c) for c in COUNTERS]).withColumn("day", day_of())
    rejected = rows.where(~good).select(F.coalesce("_corrupt", "_line").alias("line"))
    return flows.select(*FLOWS.fieldNames()), rejected
