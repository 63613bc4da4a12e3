import os
import random
import time
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flumen.config import Config, Interface
from flumen.functions.net import parse_ip
from flumen.operators.direction import classify, direction_column
from flumen.plans import catalog, round_trips
from flumen.schema import COUNTERS, PACKETS
from flumen.sources.store import FlowStore
from flumen.streaming.flowlog import FlowLog, Rotation, flow_blocks, stream_flow_blocks
from flumen.streaming.packets import FRAMES, decode_packets, first_of_each_error, ordered_files, packet_files, parse_packets
from flumen.streaming.pipeline import Sources, flush, split_errors, start_dead_letters, start_store, stateless_blocks, status

C, S = parse_ip("10.0.0.1"), parse_ip("10.0.0.2")


def test_direction_rules():
    assert classify(S, 1, 2, 6, 0x02) == "keep" and classify(S, 1, 2, 6, 0x12) == "revert"
    assert classify(parse_ip("224.0.1.9"), 1, 2, 99, 0) == "keep" and classify(parse_ip("224.0.2.9"), 1, 2, 99, 0) == "unknown"
    assert classify(parse_ip("255.255.255.255"), 1, 2, 17, 0) == "keep"
    assert classify(S, 68, 67, 17, 0) == "keep" and classify(S, 67, 68, 17, 0) == "revert"
    assert classify(S, 40000, 5222, 6, 0x10) == "keep" and classify(S, 443, 40000, 6, 0x10) == "revert" and classify(S, 443, 20000, 6, 0x10) == "unknown"


def test_direction_column_is_the_same(spark):
    rng = random.Random(1)
    ips = [parse_ip(x) for x in ("224.0.0.1", "224.0.1.1", "255.255.255.255", "1.2.3.4", "224.0.2.1")]
    rows = [(bytearray(rng.choice(ips)), rng.choice([67, 68, 53, 5222, 20000, 20001, 50000]), rng.choice([67, 68, 53, 5222, 20000, 20001, 50000]), rng.choice([1, 6, 17]), rng.choice([0, 2, 18, 1, 17, 16])) for _ in range(500)]
    got = spark.createDataFrame(rows, "dip binary, sport int, dport int, proto int, tcp_flags int").select(direction_column().alias("d")).collect()
    assert [r["d"] for r in got] == [classify(bytes(r[0]), *r[1:]) for r in rows]


def test_matching_and_orientation():
    log = FlowLog()
    log.add(S, C, 443, 40000, 6, 100, 0x12, True)  # a reply is seen first: ends are put in order
    log.add(C, S, 40000, 443, 6, 50, 0x10, False)
    assert log.rotate() == [(C, S, 443, 6, 100, 50, 1, 1)]
    assert len(log.flows) == 1 and log.rotate() == [] and not log.flows  # kept while active, then dropped


def test_later_direction_does_not_turn_a_flow():
    log = FlowLog()
    log.add(S, C, 3000, 4000, 6, 10, 0x10, True)  # unknown: ends stay as seen
    log.add(S, C, 3000, 4000, 6, 10, 0x12, True)
    assert log.rotate() == [(S, C, 4000, 6, 20, 0, 2, 0)] and len(log.flows) == 1


def test_dns_requests_share_a_flow():
    log = FlowLog()
    log.add(C, S, 40000, 53, 17, 1, 0, False)
    log.add(C, S, 40001, 53, 17, 1, 0, False)
    log.add(S, C, 53, 40001, 17, 5, 0, True)  # a reply finds the flow whatever the client's port
    assert log.rotate() == [(C, S, 53, 17, 5, 2, 1, 2)]


def test_unknown_direction_is_dropped():
    log = FlowLog()
    log.add(C, S, 3000, 4000, 17, 1, 0, True)
    log.add(C, S, 40000, 80, 6, 1, 2, True)
    assert len(log.rotate()) == 2 and len(log.flows) == 1


def _packets(n=400, seed=2):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        a, b = rng.sample([parse_ip(f"10.0.0.{i}") for i in range(4)], 2)
        sport, dport = rng.choice([(40000, 443), (443, 40000), (40001, 53), (53, 40001), (3000, 4000)])
        rows.append(("eth0", datetime.fromtimestamp(1_700_000_000 + k * 7, UTC).replace(tzinfo=None), bytearray(a), bytearray(b), sport, dport, rng.choice([6, 17]), rng.randint(40, 1500), rng.choice([0, 2, 16, 18]), rng.random() < 0.5))
    return rows


def _brute(rows):
    """One log over all packets, rotated at the ends of blocks."""
    r, out = Rotation(FlowLog(), None, 300), []
    pdf = pd.DataFrame([(x[1].replace(tzinfo=UTC).timestamp(), *map(bytes, x[2:4]), *x[4:]) for x in rows], columns=["epoch", "sip", "dip", "sport", "dport", "proto", "num_bytes", "tcp_flags", "inbound"])
    for row in pdf.to_dict("records"):
        out += r.feed(pd.DataFrame([row]))
    out += [(r.end, *x) for x in r.log.rotate()]
    total: dict = {}
    for t, sip, dip, dport, proto, *v in out:
        old = total.setdefault((t, sip, dip, dport, proto), [0] * 4)
        for k in range(4):
            old[k] += v[k]
    return {(*k, *v) for k, v in total.items()}


def _set(rows):
    return {(r["time"], bytes(r["sip"]), bytes(r["dip"]), r["dport"], r["proto"], r["bytes_rcvd"], r["bytes_sent"], r["pkts_rcvd"], r["pkts_sent"]) for r in rows}


def test_grouped_batch_equals_one_log(spark):
    rows = _packets()
    df = spark.createDataFrame(rows, PACKETS).withColumn("epoch", F.col("ts").cast("double"))
    assert _set(flow_blocks(df).collect()) == _brute(rows)


def test_many_groups_of_one_packet_cost_what_their_packets_do(spark):
    n = 12_000
    packets = "CAST(1700000000 + id AS DOUBLE) AS epoch", "'eth0' AS iface", "unhex(lpad('0A000001', 32, '0')) AS sip", "unhex(lpad('0A000002', 32, '0')) AS dip", "443 AS dport", "6 AS proto", "100 AS num_bytes", "2 AS tcp_flags", "id % 2 = 0 AS inbound"

    def seconds(sport):
        began = time.time()
        rows = flow_blocks(spark.range(n).selectExpr(*packets, f"{sport} AS sport")).agg(F.sum(F.col("pkts_rcvd") + F.col("pkts_sent"))).first()
        assert rows[0] == n
        return time.time() - began

    seconds("30000")  # starts the workers
    assert seconds("CAST(20001 + id AS INT)") < 4 * seconds("30000") + 2


def test_packets_that_lack_a_field_are_in_no_flow(spark):
    rows = _packets(60)
    broken = [tuple(None if j == k else x for j, x in enumerate(rows[0])) for k in range(len(rows[0]))]
    nullable = T.StructType([T.StructField(f.name, f.dataType) for f in PACKETS])
    df = spark.createDataFrame(rows + broken, nullable).withColumn("epoch", F.col("ts").cast("double"))
    assert _set(flow_blocks(df).collect()) == _brute(rows)


def test_stream_equals_batch(spark, tmp_path):
    rows = _packets(300)
    late = [("eth0", datetime.fromtimestamp(1_700_100_000, UTC).replace(tzinfo=None), bytearray(parse_ip("1.1.1.1")), bytearray(parse_ip("1.1.1.2")), 1, 2, 99, 1, 0, True)]
    for k, part in enumerate((rows[:150], rows[150:], late)):  # the last packet moves the watermark past all blocks
        spark.createDataFrame(part, PACKETS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"{k}"))
    packets = spark.readStream.schema(PACKETS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    store = FlowStore(spark, str(tmp_path / "store"))
    query = start_store(packets, store, str(tmp_path / "check"), syslog=str(tmp_path / "syslog"))
    assert query.awaitTermination(120)
    assert status(query)["error"] is None
    got = store.flows().groupBy("time", "sip", "dip", "dport", "proto").agg(*[F.sum(c).alias(c) for c in ("bytes_rcvd", "bytes_sent", "pkts_rcvd", "pkts_sent")])
    assert _set(got.collect()) == _brute(rows)
    assert spark.read.text(str(tmp_path / "syslog" / "*")).count() > 0


def test_stateless_stream(spark, tmp_path):
    rows = _packets(100)
    spark.createDataFrame(rows, PACKETS).write.parquet(str(tmp_path / "in"))
    blocks = stateless_blocks(spark.readStream.schema(PACKETS).parquet(str(tmp_path / "in")), start=275)
    query = blocks.writeStream.format("memory").queryName("blocks").outputMode("complete").trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    got = spark.sql("SELECT min(pmod(time, 300)) AS r, sum(pkts_rcvd + pkts_sent) AS n FROM blocks").first()
    assert (got["r"], got["n"]) == (275, 100)
    assert stream_flow_blocks.__doc__


def test_flush_closes_the_open_block(spark, tmp_path):
    rows, store = _packets(200), FlowStore(spark, str(tmp_path / "store"))
    folder = str(tmp_path / "in")
    spark.createDataFrame(rows, PACKETS).coalesce(1).write.parquet(folder)

    def run():
        packets, _ = split_errors(packet_files(spark, folder, max_files=1))
        assert start_store(packets, store, str(tmp_path / "check")).awaitTermination(120)

    sums = lambda: _set(store.flows().groupBy("time", "sip", "dip", "dport", "proto").agg(*[F.sum(c).alias(c) for c in COUNTERS]).collect())
    run()
    last = max(r["time"] for r in [{"time": x[0]} for x in _brute(rows)])
    assert max((x[0] for x in sums()), default=0) < last
    flush(spark, folder, int(rows[-1][1].replace(tzinfo=UTC).timestamp()))
    run()
    assert sums() == _brute(rows) and store.interfaces() == ["eth0"]


def test_streamed_packets_come_in_bounded_slices_in_order_of_time(spark, same_as_sql, monkeypatch):
    made, began = [], time.time()

    def small(packets, folder, n):
        slices = ordered_files(packets, folder, n, file_packets=-(-n // 10), slice_packets=-(-n // 2))
        for k, file in enumerate(x for files in slices for x in files):  # the times of the files say the opposite
            os.utime(file.removeprefix("file:"), (began - k, began - k))
        made.append((n, [[spark.read.parquet(x).agg(F.count("*"), F.min("ts"), F.max("ts")).first() for x in files] for files in slices]))
        return slices

    monkeypatch.setattr(round_trips, "ordered_files", small)
    same_as_sql(catalog.QUERIES["q_T06_stream_blocks"], catalog.ORACLES["q_T06_stream_blocks"])
    [(n, slices)] = made
    files = [x for part in slices for x in part]
    assert len(slices) == 2 and sum(x[0] for x in files) == n and max(x[0] for x in files) < n / 5
    assert all(x[2] <= y[1] for x, y in zip(files, files[1:], strict=False))


def test_batches_that_are_tried_again_count_once(spark, tmp_path):
    store = FlowStore(spark, str(tmp_path / "store"))
    flows = spark.createDataFrame([(300, C, S, 443, 6, 1, 2, 3, 4, "eth0"), (86_700, C, S, 443, 6, 1, 2, 3, 4, "eth1")], "time long, sip binary, dip binary, dport int, proto int, bytes_rcvd long, bytes_sent long, pkts_rcvd long, pkts_sent long, iface string")
    store.write_batch(flows, "s-0")
    store.write_batch(flows, "s-1")
    for _ in range(2):
        store.write_batch(flows.where("iface = 'eth0'").repartition(2), "s-1")
    assert store.flows().groupBy("iface").count().orderBy("iface").collect() == [("eth0", 2), ("eth1", 1)]
    assert store.summary().agg(F.sum("flowcount")).first()[0] == 3 and store.damaged_blocks().count() == 0
    os.remove(next((tmp_path / "store" / "flows" / "iface=eth1" / "day=86400").glob("*.parquet")))
    store.compact(0)
    assert [tuple(r) for r in store.damaged_blocks().collect()] == [("eth1", 86_700, "no rows")] and store.flows().count() == 2
    assert not list((tmp_path / "store").glob(".compact*")) and not list((tmp_path / "store").glob(".staged*"))


def _frame(version, proto, src, dst, body=b"", offset=0):
    if version == 4:
        head = bytes([0x45, 0, 0, 0, 0, 0, offset >> 8, offset & 255, 64, proto, 0, 0]) + src[:4] + dst[:4]
    else:
        head = bytes([0x60, 0, 0, 0, 0, 0, proto, 64]) + src + dst
    return bytearray(14) + head + body


def test_frames_are_decoded(spark):
    ports, v6 = (443).to_bytes(2, "big") + (50000).to_bytes(2, "big"), parse_ip("2001:db8::1")
    tcp = ports + bytes(9) + b"\x12" + bytes(6)
    frames = [
        _frame(4, 6, C, S, tcp), _frame(6, 17, v6, S[:4] + bytes(12), ports + bytes(4)), _frame(4, 50, C, S, offset=100), _frame(4, 17, C, S, ports, offset=100), _frame(4, 6, C, S, tcp[:10]),
        _frame(4, 17, C, S, b"ab"), bytearray(20), _frame(4, 1, C, S), bytearray(14) + b"\x45\x00", bytearray(14) + b"\xf0" + bytes(40),
    ]
    rows = [("eth0", datetime(2024, 1, 1), bytearray(f), 70_000, k % 2 == 0) for k, f in enumerate(frames)]
    got = [(r["sip"] and bytes(r["sip"]), r["sport"], r["dport"], r["proto"], r["num_bytes"], r["tcp_flags"], r["error"]) for r in decode_packets(spark.createDataFrame(rows, FRAMES)).collect()]
    bad = lambda why: (None,) * 6 + (why,)
    assert got == [
        (C, 443, 50000, 6, 4464, 0x12, None), (v6, 443, 50000, 17, 4464, 0, None), (C, 0, 0, 50, 4464, 0, None), bad("fragment at offset 100"), bad("incomplete TCP header"),
        bad("transport header not available"), (C, 0, 0, 1, 4464, 0, None), bad("network header not available"),
    ]


def test_json_records(spark):
    import base64
    import json

    good = {"iface": "eth0", "ts": "2024-01-01T00:00:00Z", "sip": base64.b64encode(C).decode(), "dip": base64.b64encode(S).decode(), "sport": 1, "dport": 2, "proto": 6, "num_bytes": 3, "tcp_flags": 2, "inbound": True}
    rows = parse_packets(spark.createDataFrame([(json.dumps(good),), ("{broken",), (json.dumps(good | {"sport": None}),), (None,)], "value string")).collect()
    assert [r["error"] for r in rows] == [None] + ["unreadable record"] * 3 and bytes(rows[0]["sip"]) == C


def test_first_packet_of_each_error_is_kept(spark, tmp_path):
    shape = T.StructType([*PACKETS, T.StructField("error", T.StringType())])
    rows = [(*r, [None, "fragment", "short"][k % 3]) for k, r in enumerate(_packets(30))]
    nullable = T.StructType([T.StructField(f.name, f.dataType) for f in shape])
    for k, part in enumerate((rows[:3], rows[3:], [(*rows[0][:-1], "new")])):
        spark.createDataFrame(part, nullable).coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    packets = spark.readStream.schema(nullable).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    for _ in range(2):  # the second run finds nothing new
        assert start_dead_letters(packets, str(tmp_path / "dead"), str(tmp_path / "check")).awaitTermination(120)
    found = spark.read.parquet(str(tmp_path / "dead")).collect()
    count = {e: sum(r["n"] for r in found if r["error"] == e) for e in ("fragment", "short", "new")}
    kept = {e: [r["ts"] for r in found if r["error"] == e and r["ts"] is not None] for e in count}
    assert count == {"fragment": 10, "short": 10, "new": 1} and all(len(v) == 1 for v in kept.values())
    assert [r["ts"] for r in first_of_each_error(spark.createDataFrame(rows, nullable)).orderBy("error").collect()] == [rows[1][1], rows[2][1]]


class _Query:
    """Stands for a stream."""

    def __init__(self, fails):
        self.fails, self.stopped = fails, False
        self.isActive = not fails
        self.lastProgress, self.status = {"batchId": 1}, {"message": "testing"}

    def exception(self):
        return ValueError("decoder broke\nmore") if self.fails else None

    def stop(self):
        self.stopped, self.isActive = True, False


def test_sources_fail_and_change_alone():
    made = []

    def start(name, options):
        made.append((name, _Query(name == "eth1"), options))
        return made[-1][1]

    sources = Sources(start, tries=2)
    old = Config("/db", {"eth0": Interface(), "eth1": Interface(), "eth2": Interface()})
    for name, options in old.interfaces.items():
        sources.add(name, options)
    assert [sources.tend() for _ in range(4)] == [["eth1"], ["eth1"], [], []]
    assert sources.status()["eth1"]["given_up"] and not sources.status()["eth0"]["given_up"] and sources.errors == [("eth1", "decoder broke")] * 2
    first = sources.running["eth0"]
    changes = sources.apply(old, Config("/db", {"eth0": Interface(), "eth2": Interface(promisc=True), "eth3": Interface()}))
    assert changes == {"add": ["eth3"], "remove": ["eth1"], "restart": ["eth2"]} and sorted(sources.running) == ["eth0", "eth2", "eth3"]
    assert sources.running["eth0"] is first and sources.running["eth2"] is made[-1][1] and made[-1][2].promisc
    sources.stop()
    assert not sources.running and first.stopped


def test_dead_letters(spark):
    df = spark.createDataFrame([(1, None), (2, "fragment")], "x int, error string")
    good, bad = split_errors(df)
    assert [r["x"] for r in good.collect()] == [1] and [r["x"] for r in bad.collect()] == [2]
