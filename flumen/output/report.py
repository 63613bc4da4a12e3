"""Reports of the shown rows: aligned text, CSV with a summary, JSON.

The rows of a report are those after the limit, fetched once; totals, hits and span are one-row frames.
"""

from __future__ import annotations

import csv
import io
import json
import time as clock
from dataclasses import dataclass
from datetime import UTC, datetime, tzinfo

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.human import count_text, duration_text, size_text, time_text
from ..plans.query import FlowQuery, Planned
from .lines import csv_lines, influx_lines

#: Rows that a report may bring to the driver; queries by time have no limit of their own.
MOST_ROWS = 100_000

# Column titles and labels of the formats.
_LABELS = {
    "both": (("packets_rcvd", "packets_sent", "packets_percent"), ("bytes_rcvd", "bytes_sent", "bytes_percent")),
    "one": (("packets", "packets_percent"), ("bytes", "bytes_percent")),
}
_SIDE = {"in": "in", "out": "out", "sum": "in+out"}
_CSV_TITLES = {
    "packets": "packets", "bytes": "data vol.", "packets_rcvd": "packets received", "packets_sent": "packets sent",
    "bytes_rcvd": "data vol. received", "bytes_sent": "data vol. sent", "packets_percent": "%", "bytes_percent": "%",
}
_CSV_TOTALS = {
    "packets": "Overall packets", "bytes": "Overall data volume (bytes)", "packets_rcvd": "Received packets", "packets_sent": "Sent packets",
    "bytes_rcvd": "Received data volume (bytes)", "bytes_sent": "Sent data volume (bytes)",
}
EMPTY = {"status": "empty", "statusMessage": "Query returned no results"}


def describe(sort: str, direction: str) -> str:
    if sort == "time":
        return "first packet time"
    what = {"packets": "packets", "bytes": "data volume"}[sort]
    side = {"in": "received only", "out": "sent only"}.get(direction, "sent and received")
    return f"accumulated {what} ({side})"


@dataclass
class Report:
    query: FlowQuery
    columns: list[str]  # in print order
    rows: list[dict]
    totals: dict
    ifaces: str
    span: tuple[int, int] | None
    seconds: float

    @property
    def hits(self) -> int:
        return self.totals["hits"]

    def total(self, name: str) -> int:
        kind = "pkts" if name.startswith("packets") else "bytes"
        sides = {"in": ("rcvd",), "out": ("sent",), "sum": ("rcvd", "sent")}.get(self.query.direction) or (name.rpartition("_")[2],)
        return sum(self.totals[f"total_{kind}_{s}"] for s in sides)


def _shown(planned: Planned, totals: dict, most: int) -> None:
    """Raises where a report would bring more rows to the driver than ``most``."""
    shown = min(totals["hits"], planned.query.limit)
    if shown > most:
        raise ValueError(f"{shown} rows are too many for a report; write them to a folder")


def make_report(planned: Planned, ifaces: str | None = None, span: DataFrame | None = None, most: int = MOST_ROWS) -> Report:
    """``span`` is the covered time, if block metadata tells it; else the flows are scanned for it."""
    started = clock.time()
    totals = planned.totals.first().asDict()
    _shown(planned, totals, most)
    rows = [r.asDict() for r in planned.rows.collect()]
    span = (planned.span if span is None else span).first()
    packets, volume = _LABELS["both" if planned.query.direction == "both" else "one"]
    return Report(
        planned.query, [*planned.query.keys, *packets, *volume], rows, totals, ifaces or planned.query.ifaces,
        None if span["span_last"] is None else (span["span_first"], span["span_last"]), clock.time() - started,
    )


def resolve_addresses(report: Report, lookup, most: int = 25) -> dict[str, str]:
    """Names of the addresses of the first rows, by ``lookup``; rows show the name where there is one."""
    names: dict = {}
    for row in report.rows[:most]:
        for column in ("sip", "dip"):
            if column in row and row[column] not in names and (name := lookup(row[column])):
                names[row[column]] = name
    for row in report.rows[:most]:
        row |= {c: names.get(row[c], row[c]) for c in ("sip", "dip") if c in row}
    return names


def _aligned(table: list[list[str]]) -> str:
    """Columns flush right, two blanks before each."""
    widths = [max(len(r[k]) for r in table) for k in range(len(table[0]))]
    return "\n".join("".join(f"  {cell:>{w}}" for cell, w in zip(r, widths, strict=True)) for r in table)


def text_report(report: Report, condition: str = "", zone: tzinfo = UTC, resolve_seconds: float = 0, resolve_timeout: float = 1) -> str:
    cols, q = report.columns, report.query
    is_count = lambda c: c.startswith(("packets", "bytes")) and not c.endswith("percent")
    number = lambda c, v: count_text(v) if c.startswith("packets") else size_text(v)

    def cell(c: str, v) -> str:
        if c.endswith("percent"):
            return f"{v:.2f}"
        return number(c, v) if is_count(c) else time_text(v, zone) if c == "time" else str(v)

    def title(c: str) -> str:
        if c.endswith("percent"):
            return "%"
        return {"_rcvd": "in", "_sent": "out"}.get(c[-5:], _SIDE.get(q.direction, "")) if is_count(c) else c

    table = [[c.partition("_")[0] if is_count(c) else "" for c in cols], [title(c) for c in cols]]
    table += [[cell(c, r[c]) for c in cols] for r in report.rows]
    more = len(report.rows) < report.hits
    table += [["..." if is_count(c) and more else "" for c in cols], [number(c, report.total(c)) if is_count(c) else "" for c in cols]]
    if q.direction == "both":
        table.append([""] * len(cols))
        both = lambda c: report.total(c) + report.total(c.replace("_sent", "_rcvd"))
        table.append(["Totals:", *[number(c, both(c)) if c.endswith("_sent") else "" for c in cols[1:]]])
    stamp = lambda t: datetime.fromtimestamp(t, zone).strftime("%Y-%m-%d %H:%M:%S")
    foot = []
    if report.span:
        foot.append(("Timespan / Interface", f"[{stamp(report.span[0])}, {stamp(report.span[1])}] / {report.ifaces}"))
    foot.append(("Sorted by", describe(q.sort, q.direction)))
    if resolve_seconds > 0:
        foot.append(("Reverse DNS stats", f"RDNS took {duration_text(resolve_seconds)}, timeout was {duration_text(resolve_timeout)}"))
    foot.append(("Query stats", f"{count_text(report.hits)} hits in {duration_text(report.seconds)}"))
    if condition:
        foot.append(("Conditions:", condition))
    width = max(len(k) for k, _ in foot)
    return f"\n{_aligned(table)}\n\n" + "\n".join(f"{k:<{width}} : {v}" for k, v in foot) + "\n\n"


def csv_report(report: Report) -> str:
    out = io.StringIO()
    writer = csv.writer(out, lineterminator="\n")
    writer.writerow([_CSV_TITLES.get(c, c) for c in report.columns])
    for r in report.rows:
        writer.writerow([f"{r[c]:.2f}" if c.endswith("percent") else r[c] for c in report.columns])
    for c in report.columns:
        if c in _CSV_TOTALS:
            writer.writerow([_CSV_TOTALS[c], report.total(c)])
    writer.writerow(["Sorting and flow direction", describe(report.query.sort, report.query.direction)])
    writer.writerow(["Interface", report.ifaces])
    return out.getvalue()


def json_report(report: Report, query_type: str) -> str:
    """Times and ports are strings, percentages have full precision."""
    rows = [{c: str(r[c]) if c in ("time", "dport") else r[c] for c in report.columns} for r in report.rows]
    summary: dict = {"interface": report.ifaces}
    for c in report.columns:
        if c in _CSV_TOTALS:
            kind, _, side = c.partition("_")
            summary[f"total_{kind}{f'_{side}' if side else ''}"] = report.total(c)
    return json.dumps({"status": "ok", "ext_ips": [], "summary": summary, query_type: rows})


def error_status(message: str, external: bool) -> str:
    """Details are for people; programs get the status only."""
    return json.dumps({"status": "error", "statusMessage": "An error occurred during query execution" if external else message})


def influx_report(planned: Planned, measurement: str = "flows", most: int = MOST_ROWS) -> str:
    _shown(planned, planned.totals.first().asDict(), most)
    return "".join(r["line"] + "\n" for r in influx_lines(planned, measurement).toLocalIterator())


def write_query(planned: Planned, path: str, measurement: str = "flows") -> None:
    """The rows of a query, however many, written by the executors: text for csv and influxdb, JSON lines else."""
    if planned.query.format in ("csv", "influxdb"):
        (csv_lines(planned) if planned.query.format == "csv" else influx_lines(planned, measurement)).write.text(path)
    else:
        planned.rows.write.json(path)


def list_report(summaries, external: bool = False, zone: tzinfo = UTC, tunnels: dict[str, tuple[str, str]] | None = None) -> str:
    """The interfaces of a summary, one row each, with totals; JSON for programs."""
    rows = [r.asDict() for r in summaries.orderBy("iface").collect()]
    if external:
        return json.dumps({"interfaces": {r["iface"]: {k: r[k] for k in ("flowcount", "traffic", "begin", "end")} for r in rows}}) + "\n"
    stamp = lambda t: datetime.fromtimestamp(t, zone).strftime("%Y-%m-%d %H:%M:%S")
    named = lambda i: f"{i} ({tunnels[i][0]}: {tunnels[i][1]})" if tunnels and i in tunnels else i
    table = [["Iface", "# of flows", "Traffic", "From", "Until"], ["-" * 9, "-" * 10, "-" * 9, "-" * 19, "-" * 19]]
    table += [[named(r["iface"]), count_text(r["flowcount"]), size_text(r["traffic"]), stamp(r["begin"]), stamp(r["end"])] for r in rows]
    table += [[""] * 5, ["Total", count_text(sum(r["flowcount"] for r in rows)), size_text(sum(r["traffic"] for r in rows)), "", ""]]
    return f"\n{_aligned(table)}\n"


def run_query(planned: Planned, query_type: str, condition: str = "", ifaces: str | None = None, measurement: str = "flows", span: DataFrame | None = None) -> str:
    """Output of a query in its format; a status where nothing was found."""
    if planned.query.format == "influxdb":
        return influx_report(planned, measurement)
    report = make_report(planned, ifaces, span)
    if not report.hits:
        return json.dumps(EMPTY) + "\n"
    if planned.query.format == "json":
        return json_report(report, query_type) + "\n"
    return csv_report(report) if planned.query.format == "csv" else text_report(report, condition)


def hits(planned: Planned) -> int:
    return planned.groups.agg(F.count("*")).first()[0]
