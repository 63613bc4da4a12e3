"""Flow queries: which groups, over which flows, in which order.

A query is one DataFrame expression: filter, partial and final sums by the asked keys, totals as a one-row
aggregate of the groups, top-k. What Catalyst cannot derive is added here: the day predicate that
follows from the time bounds, so that partitions are pruned.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.net import ip_text
from ..functions.protocols import protocol_name
from ..functions.timeparse import parse_time
from ..schema import BLOCK_SECONDS, COUNTERS, DAY_SECONDS, DEFAULT_LIMIT, KEYS
from .condition import compile_condition

# Names of query types and columns.
PRESETS = {
    "talk_conv": ("sip", "dip"),
    "talk_src": ("sip",),
    "talk_dst": ("dip",),
    "apps_port": ("dport", "proto"),
    "agg_talk_port": ("sip", "dip", "dport", "proto"),
    "raw": ("time", "iface", "sip", "dip", "dport", "proto"),
}
ALIASES = {"src": "sip", "dst": "dip"}
SORTS = ("bytes", "packets", "time")
DIRECTIONS = ("both", "in", "out", "sum")
FOREVER = 9_999_999_999_999_999


def parse_columns(text: str) -> tuple[str, ...]:
    """A preset or a list of columns: aliases replaced, repeats dropped, time and iface first."""
    if not text:
        raise ValueError("no query type given")
    if text in PRESETS:
        return PRESETS[text]
    found: list[str] = []
    for name in text.split(","):
        name = ALIASES.get(name, name)
        if name not in (*KEYS, "time", "iface"):
            raise ValueError(f"unknown column {name!r}")
        if name not in found:
            found.append(name)
    return tuple([c for c in ("time", "iface") if c in found] + [c for c in found if c in KEYS])


def parse_ifaces(text: str) -> tuple[str, ...] | None:
    """Interface names, None for any."""
    if text.lower() == "any":
        return None
    if not text:
        raise ValueError("no interface given")
    if "-" in text:
        raise ValueError("interface names have no '-'")
    return tuple(text.split(","))


@dataclass(frozen=True)
class FlowQuery:
    columns: str
    ifaces: str = "any"
    where: str = ""
    first: str | int = "-30d"
    last: str | int = FOREVER
    sort: str = "bytes"
    ascending: bool = False
    direction: str = "both"
    limit: int = DEFAULT_LIMIT
    format: str = "txt"
    external: bool = False
    now: float | None = None
    resolver: Callable[[str], list[str]] | None = field(default=None, compare=False)
    extra: Callable[[], Column] | None = field(default=None, compare=False)  # management filter

    def checked(self) -> FlowQuery:
        """Time bounds in epoch seconds, rules between options applied; errors raise."""
        if self.sort not in SORTS:
            raise ValueError(f"sort by one of {SORTS}")
        if self.direction not in DIRECTIONS:
            raise ValueError(f"direction is one of {DIRECTIONS}")
        if self.format not in ("txt", "json", "csv", "influxdb"):
            raise ValueError("format is one of txt, json, csv, influxdb")
        if self.limit < 0:
            raise ValueError("the limit is negative")
        q = replace(self, first=parse_time(self.first, self.now), last=parse_time(self.last, self.now))
        if q.last <= q.first:
            raise ValueError("the last time is not after the first")
        names = parse_ifaces(q.ifaces)
        columns = parse_columns(q.columns)
        if (names is None or len(names) > 1) and "iface" not in columns:
            columns = tuple([c for c in ("time",) if c in columns] + ["iface"] + [c for c in columns if c != "time"])
        q = replace(q, columns=",".join(columns))
        if "time" in columns or q.format == "influxdb":
            q = replace(q, sort="time", ascending=True, limit=FOREVER)
        if q.external and q.direction == "both":
            q = replace(q, direction="sum")
        return q

    @property
    def keys(self) -> tuple[str, ...]:
        return parse_columns(self.columns)


def time_predicate(first: int, last: int) -> Column:
    """Blocks are stamped with their end, so the bound reaches one block on; both ends are strict."""
    until = last + BLOCK_SECONDS
    day = F.col("day")
    return (F.col("time") > first) & (F.col("time") < until) & (day > first - DAY_SECONDS) & (day < until)


def select_flows(flows: DataFrame, q: FlowQuery) -> DataFrame:
    """The flows of a checked query, before its condition."""
    rows = flows.where(time_predicate(q.first, q.last))
    names = parse_ifaces(q.ifaces)
    return rows if names is None else rows.where(F.col("iface").isin(list(names)))


def aggregate(flows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    return flows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in COUNTERS])


def totals_of(groups: DataFrame) -> DataFrame:
    """One row: number of groups and sums over all of them."""
    return groups.agg(F.count("*").alias("hits"), *[F.coalesce(F.sum(c), F.lit(0)).alias(f"total_{c}") for c in COUNTERS])


def measures(direction: str) -> list[tuple[str, Column]]:
    """Output counters in print order."""
    c = F.col
    return {
        "in": [("packets", c("pkts_rcvd")), ("bytes", c("bytes_rcvd"))],
        "out": [("packets", c("pkts_sent")), ("bytes", c("bytes_sent"))],
        "sum": [("packets", c("pkts_rcvd") + c("pkts_sent")), ("bytes", c("bytes_rcvd") + c("bytes_sent"))],
        "both": [("packets_rcvd", c("pkts_rcvd")), ("packets_sent", c("pkts_sent")), ("bytes_rcvd", c("bytes_rcvd")), ("bytes_sent", c("bytes_sent"))],
    }[direction]


def _amount(kind: str, direction: str, prefix: str = "") -> Column:
    sides = {"in": ("rcvd",), "out": ("sent",)}.get(direction, ("rcvd", "sent"))
    parts = [F.col(f"{prefix}{kind}_{s}") for s in sides]
    return parts[0] if len(parts) == 1 else parts[0] + parts[1]


def percent(kind: str, direction: str) -> Column:
    """100 * x / total; 0 where the total is 0. The product is taken in whole numbers first."""
    total = _amount(kind, direction, "total_")
    return F.when(total == 0, F.lit(0.0)).otherwise((F.lit(100) * _amount(kind, direction)).cast("double") / total.cast("double"))


def ordering(q: FlowQuery) -> list[Column]:
    """Sort key, then the group keys, so that ties have one order."""
    if q.sort == "time":
        key = F.col("time") if "time" in q.keys else F.lit(0)
    else:
        key = _amount({"bytes": "bytes", "packets": "pkts"}[q.sort], q.direction)
    return [key.asc() if q.ascending else key.desc(), *[F.col(k).asc() for k in q.keys]]


@dataclass
class Planned:
    """A query's DataFrames: all groups, their one-row totals, the rows to show, the span covered."""

    query: FlowQuery
    groups: DataFrame
    totals: DataFrame
    rows: DataFrame
    span: DataFrame


def plan(flows: DataFrame, query: FlowQuery) -> Planned:
    q = query.checked()
    predicate = compile_condition(q.where, q.resolver)
    chosen = select_flows(flows, q)
    span = chosen.agg((F.min("time") - BLOCK_SECONDS).alias("span_first"), F.max("time").alias("span_last"))
    if predicate is not None:
        chosen = chosen.where(predicate)
    if q.extra is not None:
        chosen = chosen.where(q.extra())
    groups = aggregate(chosen, q.keys)
    totals = totals_of(groups)
    # top-k first: totals join and text rendering touch the shown rows only
    shown = groups
    if q.format != "influxdb":
        shown = shown.orderBy(*ordering(q))
    if q.limit != FOREVER:
        shown = shown.limit(q.limit)
    shown = shown.crossJoin(F.broadcast(totals))  # one row
    render = {"sip": ip_text("sip"), "dip": ip_text("dip"), "proto": protocol_name(F.col("proto"))}
    out = [render.get(k, F.col(k)).alias(k) for k in q.keys]
    out += [c.alias(n) for n, c in measures(q.direction)]
    out += [percent("pkts", q.direction).alias("packets_percent"), percent("bytes", q.direction).alias("bytes_percent")]
    rows = shown.select(*[F.col(k).alias(f"_{k}") for k in q.keys], *[F.col(c).alias(f"_{c}") for c in COUNTERS], *out)
    if q.format != "influxdb":
        sort = replace(q, columns=q.columns)
        keys = [F.col(f"_{k}").asc() for k in q.keys]
        amount = {"time": F.col("_time") if "time" in q.keys else F.lit(0)}.get(sort.sort)
        if amount is None:
            amount = _amount({"bytes": "bytes", "packets": "pkts"}[q.sort], q.direction, "_")
        rows = rows.orderBy(amount.asc() if q.ascending else amount.desc(), *keys)
    return Planned(q, groups, totals, rows.drop(*[f"_{k}" for k in q.keys], *[f"_{c}" for c in COUNTERS]), span)


def lookup_names(rows: DataFrame, names: DataFrame) -> DataFrame:
    """Shown addresses replaced by their names where (ip, name) has one; unresolved ones stay."""
    for column in [c for c in ("sip", "dip") if c in rows.columns]:
        known = F.broadcast(names.select(F.col("ip").alias(column), F.col("name").alias("_name")))  # at most the shown rows
        rows = rows.join(known, column, "left").withColumn(column, F.coalesce("_name", column)).drop("_name").select(rows.columns)
    return rows
