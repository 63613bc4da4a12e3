import json
import os

import pytest

from flumen import cli
from flumen.completion import complete, next_in_condition, split_words
from flumen.config import Config, Interface
from flumen.functions.net import parse_ip
from flumen.output import report as reports
from flumen.plans import fixtures
from flumen.plans.query import FlowQuery, plan
from flumen.sources import metadata
from flumen.sources.csv_import import read_csv
from flumen.sources.store import FlowStore

from .conftest import SF, rows_by_name


@pytest.fixture
def store(spark, tmp_path):
    s = FlowStore(spark, str(tmp_path / "store"))
    s.write(fixtures.flows_of_events(spark, SF))
    return s


def test_round_trip(spark, store):
    flows = fixtures.flows_of_events(spark, SF)
    q = FlowQuery("raw", first=0)
    a, b = plan(flows, q).rows, plan(store.flows(), q).rows
    assert rows_by_name(a.collect(), a.columns) == rows_by_name(b.collect(), b.columns)
    assert store.interfaces() == ["eth0", "eth1", "eth2", "eth3"]
    assert store.summary().agg({"flowcount": "sum"}).first()[0] == flows.count()


def test_clean_and_wipe(spark, store):
    os.makedirs(f"{store.root}/flows/iface=eth0/day=notes")
    days = sorted(r["day"] for r in store.block_meta().select("day").distinct().collect())
    gone = store.clean(days[3] + 5, now=days[-1] + 10**6)
    assert gone >= 3 and min(r["day"] for r in store.block_meta().select("day").distinct().collect()) == days[3]
    assert store.summary().agg({"begin": "min"}).first()[0] >= days[3]
    assert os.path.isdir(f"{store.root}/flows/iface=eth0/day=notes")
    with pytest.raises(ValueError):
        store.clean(10**12, now=10**9)
    store.wipe()
    assert store.flows().count() == 0 and store.summary().count() == 0


def test_compact(spark, store):
    day = store.flows().first()["day"]
    before = store.flows().count()
    store.compact(day)
    assert store.flows().count() == before


def test_damaged_file_is_skipped(spark, store):
    with open(f"{store.root}/flows/iface=eth0/day=1704067200/part-bad.parquet", "wb") as f:
        f.write(b"not parquet")
    assert store.flows().count() > 0


def test_metadata_files(spark, tmp_path):
    block = {"timestamp": 90_000, "pcap_packets_received": -1, "pcap_packets_dropped": -1, "pcap_packets_if_dropped": -1, "packets_logged": 7, "flowcount": 2, "traffic": 30}
    for iface, text in (("eth0", json.dumps({"blocks": [block]})), ("eth1", "{broken")):
        os.makedirs(tmp_path / "db" / iface / "86400")
        (tmp_path / "db" / iface / "86400" / "meta.json").write_text(text)
    rows = metadata.read_block_files(spark, str(tmp_path / "db" / "*" / "*" / "meta.json")).collect()
    assert [(r["iface"], r["day"], r["flowcount"]) for r in rows] == [("eth0", 86_400, 2)]
    old = spark.createDataFrame([("a", 1, 10, 100, 200)], "iface string, flowcount long, traffic long, begin long, end long")
    new = spark.createDataFrame([("a", 2, 5, 50, 150), ("b", 1, 1, 1, 1)], old.schema)
    text = metadata.summary_json(metadata.merge_summaries(old, new))
    (tmp_path / "summary.json").write_text(text)
    assert {tuple(r) for r in metadata.read_summary(spark, str(tmp_path / "summary.json")).collect()} == {("a", 3, 15, 50, 200), ("b", 1, 1, 1, 1)}


def test_csv_import(spark, tmp_path):
    path = tmp_path / "flows.csv"
    path.write_text(
        "time,iface,sip,dip,dport,proto,packets received,packets sent,%,data vol. received,data vol. sent,%\n"
        "300,eth0,1.2.3.4,::1,80,TCP,1,2,5.5,10,20,9\n"
        "300,eth0,1.2.3.4,::1,80,6,1,2,5.5,10,20,9\n"
        "300,eth0,1.2.3.999,::1,80,TCP,1,2,5.5,10,20,9\n"
        "300,eth0,1.2.3.4,::1,80000,TCP,1,2,5.5,10,20,9\n"
        "short,line\n"
    )
    flows, rejected = read_csv(spark, str(path))
    row = flows.collect()
    assert len(row) == 1 and (row[0]["time"], row[0]["iface"], row[0]["dport"], row[0]["proto"], row[0]["bytes_sent"], row[0]["pkts_rcvd"]) == (300, "eth0", 80, 6, 40, 2)
    assert bytes(row[0]["dip"]) == parse_ip("::1") and rejected.count() == 3
    bare = tmp_path / "bare.csv"
    bare.write_text("300,1.2.3.4,7\n")
    flows, rejected = read_csv(spark, str(bare), schema="time,sip,packets sent", iface="eth9")
    assert flows.first()["iface"] == "eth9" and flows.first()["pkts_sent"] == 7 and rejected.count() == 0
    with pytest.raises(ValueError):
        read_csv(spark, str(bare), schema="x,y,z")


def test_command_line(spark, store, tmp_path):
    at = ["-d", store.root]
    code, text = cli.run(spark, [*at, "-i", "eth0", "-c", "dport = 443", "-f", "0", "-n", "3", "sip,dip"])
    assert code == 0 and "Timespan / Interface" in text and "dport = 443" in text
    code, text = cli.run(spark, [*at, "-i", "any", "-f", "0", "-e", "json", "-sum", "dport"])
    assert code == 0 and json.loads(text)["dport"][0]["iface"].startswith("eth")
    code, text = cli.run(spark, [*at, "-i", "eth0", "-f", "0", "-e", "csv", "-in", "proto"])
    assert code == 0 and text.startswith("proto,packets,%")
    for form, read in (("csv", spark.read.text), ("json", spark.read.json), ("influxdb", spark.read.text)):
        out = str(tmp_path / form)
        assert cli.run(spark, [*at, "-i", "eth0", "-f", "0", "-e", form, "-o", out, "raw"]) == (0, "")
        assert read(out).count() == plan(store.flows(), FlowQuery("raw", "eth0", first=0)).groups.count()
    assert cli.run(spark, [*at, "-list"])[1].count("eth") == 4
    assert cli.run(spark, [*at, "-i", "eth0", "-c", "dport ="])[0] == 1
    code, text = cli.run(spark, [*at, "-x", "-i", "eth0", "nosuch"])
    assert code == 1 and json.loads(text)["status"] == "error"
    assert cli.run(spark, [*at, "-clean", "1704200000"])[0] == 0
    assert cli.run(spark, [*at, "-wipe"])[0] == 0 and json.loads(cli.run(spark, [*at, "-list", "-x"])[1]) == {"interfaces": {}}
    assert cli.direction(True, True, False) == "both" and cli.direction(True, False, True) == "sum"


def test_reports_are_bounded(store, tmp_path):
    planned = plan(store.flows(), FlowQuery("time", first=0))
    with pytest.raises(ValueError, match="too many"):
        reports.make_report(planned, most=5)
    with pytest.raises(ValueError, match="too many"):
        reports.influx_report(planned, most=5)
    assert reports.make_report(planned, span=store.span()).span == reports.make_report(planned).span
    assert reports.make_report(plan(store.flows(), FlowQuery("time,dport", first=0, sort="bytes")), most=10**6).hits > 5


def test_completion():
    assert split_words("flumen -i 'eth0 x' si") == ["flumen", "-i", "eth0 x", "si"]
    assert complete("flumen -i et", ["eth0", "eth1", "wan"]) == ["eth0", "eth1"]
    assert complete("flumen -i eth0,", ["eth0", "eth1"]) == ["eth0,eth1"]
    assert complete("flumen talk_s", []) == ["talk_src"] and complete("flumen sip,d", []) == ["sip,dip", "sip,dport", "sip,dst"]
    assert complete("flumen -e ", []) == ["txt", "json", "csv", "influxdb"] and "-list" in complete("flumen -l", [])
    assert next_in_condition("dp") == ["dport"] and "=" in next_in_condition("dport ") and next_in_condition("(dport = 80 ") == ["&", ")", "|"]


def test_config():
    a = Config.parse('{"db_path": "/x", "interfaces": {"eth0": {"buf_size": 2048}, "eth1": {}}}')
    b = Config("/x", {"eth0": Interface(), "eth2": Interface()})
    assert a.changed(b) == {"add": ["eth2"], "remove": ["eth1"], "restart": ["eth0"]}
    for bad in ('{"db_path": ""}', '{"db_path": "/x", "interfaces": {"e": {"buf_size": 5}}}'):
        with pytest.raises(ValueError):
            Config.parse(bad)
