import json

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from flumen.functions.net import parse_ip
from flumen.operators import blocks
from flumen.output import report as reports
from flumen.plans import catalog, fixtures
from flumen.plans.query import FOREVER, FlowQuery, lookup_names, parse_columns, parse_ifaces, plan
from flumen.schema import FLOWS

from .conftest import SF


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_as_sql(name, same_as_sql):
    same_as_sql(catalog.QUERIES[name], catalog.ORACLES[name])


@pytest.mark.parametrize("name", ["P07_raw", "A06_group_time", "P09_group_time_iface", "O03_sort_time"])
def test_time_grouped_queries_cover_the_whole_table(name, spark, duck):
    iface = catalog.SPECS[name][0].get("ifaces")
    where = f"WHERE iface = '{iface}'" if iface else ""
    whole = duck.execute(f"WITH {fixtures.SQL_FLOWS} SELECT min(time), max(time) FROM flows {where}").fetchone()
    assert tuple(catalog.QUERIES[f"q_{name}"](spark, SF).agg(F.min("time"), F.max("time")).first()) == whole


def test_entry(spark):
    assert len(__spark_entry__.entry(spark).collect()) > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_columns():
    assert parse_columns("raw") == ("time", "iface", "sip", "dip", "dport", "proto")
    assert parse_columns("dst,src,dip,iface,time") == ("time", "iface", "dip", "sip")
    for bad in ("", "talk_src,dip", "sport", "sip,"):
        with pytest.raises(ValueError):
            parse_columns(bad)
    assert parse_ifaces("ANY") is None and parse_ifaces("a,b") == ("a", "b")
    for bad in ("", "eth0,-eth1"):
        with pytest.raises(ValueError):
            parse_ifaces(bad)


@pytest.mark.parametrize("options", [{"sort": "size"}, {"direction": "up"}, {"limit": -1}, {"format": "xml"}, {"first": 10, "last": 10}, {"columns": "sport"}])
def test_bad_options(options):
    with pytest.raises(ValueError):
        FlowQuery(**({"columns": "sip", "first": 0} | options)).checked()


def test_rules_between_options():
    q = FlowQuery("time,sip", "eth0", first=0, limit=3, sort="packets").checked()
    assert (q.sort, q.ascending, q.limit) == ("time", True, FOREVER)
    assert FlowQuery("sip", "eth0,eth1", first=0).checked().keys == ("iface", "sip")
    assert FlowQuery("sip", "eth0", first=0, external=True).checked().direction == "sum"


def _flow(time, sip="1.1.1.1", dip="2.2.2.2", dport=80, proto=6, counters=(1, 2, 3, 4), iface="eth0"):
    return (time, bytearray(parse_ip(sip)), bytearray(parse_ip(dip)), dport, proto, *counters, iface, time - time % 86400)


def test_time_bounds_are_strict_and_reach_one_block(spark):
    flows = spark.createDataFrame([_flow(t, sip=f"1.1.1.{k}") for k, t in enumerate((1000, 1300, 1600))], FLOWS)
    seen = lambda first, last: {r["sip"] for r in plan(flows, FlowQuery("sip", "eth0", first=first, last=last)).rows.collect()}
    assert seen(1000, 1300) == {"1.1.1.1"}
    assert seen(999, 1300) == {"1.1.1.0", "1.1.1.1"}
    assert seen(999, 1301) == {"1.1.1.0", "1.1.1.1", "1.1.1.2"}


def test_day_predicate_prunes(spark, tmp_path):
    flows = fixtures.flows_of_events(spark, SF)
    flows.write.partitionBy("iface", "day").parquet(str(tmp_path / "f"))
    stored = spark.read.parquet(str(tmp_path / "f"))
    rows = plan(stored, FlowQuery("dport", "eth1", "dport = 443", first=1_705_017_600, last=1_705_104_000)).rows
    text = rows._jdf.queryExecution().toString()
    scan = text[text.index("== Physical Plan ==") :]
    assert "iface#" in scan.partition("PartitionFilters: [")[2].partition("]")[0]
    assert "day#" in scan.partition("PartitionFilters: [")[2]
    assert "EqualTo(dport,443)" in scan and "sip" not in scan.partition("ReadSchema: ")[2].partition(">")[0]


def test_reports(spark):
    flows = spark.createDataFrame([_flow(1000), _flow(1000, sip="1.1.1.2", counters=(100, 0, 1, 0)), _flow(1300, sip="2001:db8::1", counters=(5, 5, 1, 1))], FLOWS)
    p = plan(flows, FlowQuery("sip,dport", "eth0", first=0, limit=2))
    r = reports.make_report(p)
    assert [x["sip"] for x in r.rows] == ["1.1.1.2", "2001:db8::1"] and r.hits == 3 and r.span == (700, 1300)
    text = reports.text_report(r, "dport = 80")
    assert "..." in text and "Totals:" in text and "accumulated data volume (sent and received)" in text and "3.00   hits" in text and "dport = 80" in text
    lines = reports.csv_report(r).splitlines()
    assert lines[0] == "sip,dport,packets received,packets sent,%,data vol. received,data vol. sent,%"
    assert lines[1] == "1.1.1.2,80,1,0,10.00,100,0,88.50" and "Received packets,5" in lines and lines[-1] == "Interface,eth0"
    data = json.loads(reports.json_report(r, "sip,dport"))
    assert data["status"] == "ok" and data["summary"]["total_bytes_rcvd"] == 106 and data["sip,dport"][0]["dport"] == "80"
    assert data["sip,dport"][0]["bytes_percent"] == 100 * 100 / 113
    assert reports.resolve_addresses(r, {"1.1.1.2": "host.test"}.get) == {"1.1.1.2": "host.test"}
    assert r.rows[0]["sip"] == "host.test"
    empty = plan(flows, FlowQuery("sip", "eth0", "dport = 1", first=0))
    assert json.loads(reports.run_query(empty, "sip"))["status"] == "empty"
    summed = reports.make_report(plan(flows, FlowQuery("proto", "eth0", first=0, direction="sum")))
    assert "in+out" in reports.text_report(summed) and summed.total("bytes") == 113
    assert json.loads(reports.error_status("secret", True))["statusMessage"] != "secret"


def test_line_outputs(spark):
    flows = spark.createDataFrame([_flow(1300)], FLOWS)
    assert reports.run_query(plan(flows, FlowQuery("raw", "eth0", first=0, format="influxdb")), "raw") == (
        "flows,iface=eth0,proto=TCP sip=1.1.1.1,dip=2.2.2.2,dport=80,packets_rcvd=3i,packets_sent=4i,bytes_rcvd=1i,bytes_sent=2i 1300000000000\n"
    )
    from flumen.output.lines import csv_lines, escaped, syslog_lines

    assert syslog_lines(flows).first()["line"] == "1300,eth0,1.1.1.1,2.2.2.2,80,TCP,3,4,1,2"
    assert csv_lines(plan(flows, FlowQuery("dport", "eth0", first=0, direction="in"))).first()["line"] == "80,3,100.00,1,100.00"
    odd = spark.createDataFrame([("a b,c\\d",)], "s string")
    assert odd.select(escaped(F.col("s")).alias("e")).first()["e"] == "a\\ b\\,c\\\\d"


def test_lookup_join(spark):
    rows = spark.createDataFrame([("1.1.1.1", "2.2.2.2", 5)], "sip string, dip string, packets long")
    names = spark.createDataFrame([("2.2.2.2", "b.test")], "ip string, name string")
    assert lookup_names(rows, names).collect() == [("1.1.1.1", "b.test", 5)]


def test_list_and_deltas(spark):
    flows = spark.createDataFrame([_flow(1000), _flow(1300, iface="eth1")], FLOWS)
    s = blocks.summary(blocks.block_meta(flows))
    text = reports.list_report(s, tunnels={"eth1": ("wan0", "peer")})
    assert "eth1 (wan0: peer)" in text and "Total" in text
    assert json.loads(reports.list_report(s, external=True))["interfaces"]["eth0"] == {"flowcount": 1, "traffic": 3, "begin": 1000, "end": 1000}
    stats = spark.createDataFrame([("e", 1, 5), ("e", 2, None), ("e", 3, 9)], "iface string, time long, received long")
    assert [r["delta_received"] for r in blocks.counter_deltas(stats, ("received",)).orderBy("time").collect()] == [5, None, 4]
