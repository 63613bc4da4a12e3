"""Command line over a flow store: queries, listing, cleaning, import."""

from __future__ import annotations

import argparse
import socket
import sys
import time as clock
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as Late

from pyspark.sql import SparkSession

from .functions.timeparse import parse_time
from .output import report as reports
from .plans.query import FOREVER, FlowQuery, parse_ifaces, plan
from .schema import DEFAULT_LIMIT
from .sources.csv_import import read_csv
from .sources.store import FlowStore

VERSION = "0.1"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="flumen", description="Top talkers and applications of network flows.", prefix_chars="-")
    p.add_argument("columns", nargs="?", default="", help="query type or list of sip,dip,dport,proto,time,iface (src, dst)")
    p.add_argument("-d", dest="store", default="./flows", help="place of the store")
    p.add_argument("-i", dest="ifaces", default="", help="interfaces, or any")
    p.add_argument("-c", dest="where", default="", help="condition")
    p.add_argument("-f", dest="first", default="-30d", help="first time")
    p.add_argument("-l", dest="last", default=str(FOREVER), help="last time")
    p.add_argument("-s", dest="sort", default="bytes", help="bytes, packets or time")
    p.add_argument("-n", dest="limit", type=int, default=DEFAULT_LIMIT, help="rows shown")
    p.add_argument("-e", dest="format", default="txt", help="txt, json, csv or influxdb")
    for flag, name, text in (("-a", "ascending", "ascending"), ("-in", "inward", "received only"), ("-out", "outward", "sent only"), ("-sum", "sum", "received and sent added"),
                             ("-x", "external", "output for programs"), ("-list", "list", "list interfaces"), ("-wipe", "wipe", "delete all flows"), ("-resolve", "resolve", "names for addresses")):
        p.add_argument(flag, dest=name, action="store_true", help=text)
    p.add_argument("-resolve-rows", dest="resolve_rows", type=int, default=25)
    p.add_argument("-resolve-timeout", dest="resolve_timeout", type=float, default=1.0)
    p.add_argument("-clean", dest="clean", default="", help="delete days before this time")
    p.add_argument("-import", dest="csv", default="", help="CSV file to import")
    p.add_argument("-measurement", dest="measurement", default="flows", help="name of the series in line protocol")
    p.add_argument("-o", dest="out", default="", help="folder to write all rows to, for results too large to show")
    p.add_argument("-schema", dest="schema", default=None, help="column names of a CSV file without header")
    p.add_argument("-version", action="version", version=VERSION)
    return p


def direction(inward: bool, outward: bool, summed: bool) -> str:
    return "sum" if summed else "both" if inward == outward else "in" if inward else "out"


def _names_of(host: str) -> list[str]:
    return sorted({a[4][0] for a in socket.getaddrinfo(host, None)})


def lookups(timeout: float):
    """Reverse lookup whose calls share one time limit."""
    pool, until = ThreadPoolExecutor(16), clock.time() + timeout

    def lookup(address: str) -> str | None:
        try:
            return pool.submit(lambda: socket.gethostbyaddr(address)[0]).result(max(0.0, until - clock.time()))
        except (OSError, Late):
            return None

    return lookup


def run(spark: SparkSession, argv: list[str], now: float | None = None) -> tuple[int, str]:
    """(exit code, output)."""
    a = parser().parse_args(argv)
    try:
        store = FlowStore(spark, a.store)
        if a.list:
            return 0, reports.list_report(store.summary(), a.external)
        if a.wipe:
            store.wipe()
            return 0, ""
        if a.clean:
            store.clean(parse_time(a.clean, now), now)
            return 0, ""
        if a.csv:
            flows, rejected = read_csv(spark, a.csv, a.schema, a.ifaces or None)
            store.write(flows)
            return 0, f"{rejected.count()} lines were set aside\n"
        if not a.ifaces:
            raise ValueError("no interface given")
        if (names := parse_ifaces(a.ifaces)) is None:
            names = tuple(store.interfaces())
        query = FlowQuery(
            a.columns, a.ifaces if len(names) != 1 else names[0], a.where, a.first, a.last, a.sort, a.ascending, direction(a.inward, a.outward, a.sum), a.limit, a.format, a.external, now, _names_of
        )
        planned = plan(store.flows(), query)
        if a.out:
            reports.write_query(planned, a.out, a.measurement)
            return 0, ""
        span = store.span(planned.query.first, planned.query.last, names)
        if not a.resolve or a.format == "influxdb":
            return 0, reports.run_query(planned, a.columns, a.where, ",".join(names), a.measurement, span)
        report = reports.make_report(planned, ",".join(names), span)
        began = clock.time()
        reports.resolve_addresses(report, lookups(a.resolve_timeout), a.resolve_rows)
        if a.format == "json":
            return 0, reports.json_report(report, a.columns) + "\n"
        return 0, reports.csv_report(report) if a.format == "csv" else reports.text_report(report, a.where, resolve_seconds=clock.time() - began, resolve_timeout=a.resolve_timeout)
    except ValueError as e:
        return 1, reports.error_status(str(e), a.external) + "\n" if a.external or a.format == "json" else f"{e}\n"


def main() -> None:
    spark = SparkSession.builder.appName("flumen").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    code, text = run(spark, sys.argv[1:])
    (sys.stdout if code == 0 else sys.stderr).write(text)
    sys.exit(code)


if __name__ == "__main__":
    main()
