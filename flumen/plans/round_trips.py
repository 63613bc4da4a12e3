"""Registered queries that go through the flow store, an import, a stream or a decoder, and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.net import ip_bytes, ip_text, sql_ip_text
from ..operators.blocks import block_meta, summary
from ..output.lines import escaped
from ..schema import COUNTERS, PACKETS
from ..sources.csv_import import read_csv
from ..sources.metadata import merge_summaries, read_summary
from ..sources.places import work_folder
from ..sources.store import FlowStore
from ..streaming.flowlog import flow_blocks, grouped_packets
from ..streaming.packets import arriving, decode_packets, first_of_each_error, ordered_files, packet_files, split_errors
from ..streaming.pipeline import flush, start_store
from . import fixtures
from .query import FlowQuery, lookup_names, plan

_KEYS = ("time", "iface", "sip", "dip", "dport", "proto")
#: A day in the middle of the test events.
DAY = 1_705_363_200
_SHOWN = [f"lower(hex({c})) AS {c}" if c in ("sip", "dip") else c for c in (*_KEYS, *COUNTERS)]


def _store(spark: SparkSession, sf_dir: str) -> FlowStore:
    """A new store that holds the test flows."""
    store = FlowStore(spark, work_folder(spark, "store"))
    store.write(fixtures.flows_of_events(spark, sf_dir))
    return store


def store_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All flows as they were written."""
    return _store(spark, sf_dir).flows().selectExpr(*_SHOWN)


def store_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan(_store(spark, sf_dir).flows(), FlowQuery("agg_talk_port", first=0, limit=10**9)).groups.select(F.lower(F.hex("sip")).alias("sip"), F.lower(F.hex("dip")).alias("dip"), "iface", "dport", "proto", *COUNTERS)


def day_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three days of the store: other days' partitions are not read."""
    return plan(_store(spark, sf_dir).flows(), FlowQuery("time,dport", first=DAY, last=DAY + 3 * 86_400)).groups


def block_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks that lack rows: the store's flows without those of port 0, its metadata with them."""
    flows, store = fixtures.flows_of_events(spark, sf_dir), FlowStore(spark, work_folder(spark, "store"))
    store.write(flows.where("dport <> 0"), block_meta(flows))
    return store.damaged_blocks()


def summary_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _store(spark, sf_dir)
    path = f"{store.root}/summary.json"
    store.write_summary(path)
    return read_summary(spark, path)


def merged_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries of earlier and of later days, merged."""
    meta = _store(spark, sf_dir).block_meta()
    return merge_summaries(summary(meta.where(F.col("day") < DAY)), summary(meta.where(F.col("day") >= DAY)))


def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summary after the days before ``DAY`` were deleted."""
    store = _store(spark, sf_dir)
    store.clean(DAY + 5)
    return store.summary()


_TITLES = {"pkts_rcvd": "packets received", "pkts_sent": "packets sent", "bytes_rcvd": "data vol. received", "bytes_sent": "data vol. sent"}


def imported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows written as CSV with addresses as text, and imported; rows of one key are summed."""
    path = work_folder(spark, "csv")
    rows = fixtures.flows_of_events(spark, sf_dir).select("time", "iface", ip_text("sip").alias("sip"), ip_text("dip").alias("dip"), "dport", "proto", *[F.col(c).alias(t) for c, t in _TITLES.items()])
    rows.write.option("header", True).csv(path)
    return read_csv(spark, path)[0].selectExpr(*_SHOWN)


def read_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    flows = fixtures.flows_of_events(spark, sf_dir).select(ip_text("sip").alias("ip")).distinct()
    return flows.select("ip", F.lower(F.hex(ip_bytes("ip"))).alias("bytes"))


def flow_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flow log over all packets: matching depends on their order, which SQL cannot express."""
    return flow_blocks(fixtures.packets_of_events(spark, sf_dir)).selectExpr(*_SHOWN)


def flow_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets by what makes them candidates for one flow."""
    groups = grouped_packets(fixtures.packets_of_events(spark, sf_dir)).groupBy("iface", "low", "high", "proto", "ports").agg(F.count("*").alias("n"))
    return groups.select("iface", F.lower(F.hex("low")).alias("low"), F.lower(F.hex("high")).alias("high"), "proto", "ports", "n")


def streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets written as files in order of time, read as a stream in bounded micro-batches into a store, and flushed."""
    folder = work_folder(spark, "stream")
    packets = fixtures.packets_of_events(spark, sf_dir)
    last, n = packets.agg(F.max("epoch"), F.count("*")).first()
    slices = ordered_files(packets.withColumn("ts", F.timestamp_seconds("epoch")).select(*PACKETS.fieldNames()), f"{folder}/ordered", n)
    store = FlowStore(spark, f"{folder}/store")

    def run():
        good, _ = split_errors(packet_files(spark, f"{folder}/in"))
        start_store(good, store, f"{folder}/check", stateful=False).awaitTermination()

    for _ in arriving(spark, slices, f"{folder}/in"):
        run()
    flush(spark, f"{folder}/in", int(last or 0))
    run()
    return store.flows().selectExpr(*_SHOWN)


def dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First packet and number of each test error."""
    packets = fixtures.packets_of_events(spark, sf_dir)
    packets = packets.select(F.col("epoch").alias("ts"), "event_id", F.expr("CASE WHEN event_id % 11 = 0 THEN 'short packet' WHEN event_id % 13 = 0 THEN 'fragment' END AS error"))
    return first_of_each_error(packets)


def decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames made of the test packets and decoded again; every 19th is a later fragment, every 23rd cut off."""
    two = lambda c: f"lpad(hex({c}), 4, '0')"
    head = "'45', repeat('00', 5), IF(event_id % 19 = 0, '0064', '0000'), '40', lpad(hex(proto), 2, '0'), '0000', substr(hex(sip), 1, 8), substr(hex(dip), 1, 8)"
    body = f"{two('sport')}, {two('dport')}, repeat('00', 9), lpad(hex(tcp_flags), 2, '0'), repeat('00', 6)"
    frames = fixtures.packets_of_events(spark, sf_dir).selectExpr(
        "iface", "timestamp_seconds(epoch) AS ts", f"unhex(concat(repeat('00', 14), IF(event_id % 23 = 0, '4500', concat({head}, {body})))) AS frame", "num_bytes + 65536 AS length", "inbound"
    )
    shown = [F.lower(F.hex(c)).alias(c) if c in ("sip", "dip") else F.unix_seconds("ts").alias("epoch") if c == "ts" else F.col(c) for c in (*PACKETS.fieldNames(), "error")]
    return decode_packets(frames).select(*shown)


def named_servers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top destinations, with names where a table of names has one."""
    rows = plan(fixtures.flows_of_events(spark, sf_dir), FlowQuery("talk_dst", first=0, direction="sum", limit=25)).rows.select("iface", "dip", "packets", "bytes")
    names = fixtures.flows_of_events(spark, sf_dir).where("dport = 53").select(ip_text("dip").alias("ip")).distinct().where("ip LIKE '%.1'")
    return lookup_names(rows, names.withColumn("name", F.concat(F.lit("server "), "ip")))


def escaped_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("event_id", r"concat(event_type, ', ', props, '\\') AS text")
    return rows.select("event_id", escaped(F.col("text")).alias("text"))


_WITH = f"WITH {fixtures.SQL_FLOWS}"
_PACKETS = f"WITH {fixtures.SQL_PACKETS}"
_SUMS = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in COUNTERS)
_META = "SELECT iface, time, count(*) AS flowcount, sum(pkts_rcvd + pkts_sent) AS packets_logged, sum(bytes_rcvd + bytes_sent) AS traffic FROM flows"
_SUMMARY = 'SELECT iface, count(*) AS flowcount, CAST(sum(bytes_rcvd + bytes_sent) AS BIGINT) AS traffic, min(time) AS "begin", max(time) AS "end" FROM flows'
_FLAGS_BROKEN = "event_id % 23 = 0", "event_id % 19 = 0"


def _decoded_sql() -> str:
    fields = {c: c for c in ("sip", "dip", "proto", "num_bytes")} | {c: f"CASE WHEN proto IN (6, 17) THEN {c} ELSE 0 END" for c in ("sport", "dport")} | {"tcp_flags": "tcp_flags"}
    cut, fragment = _FLAGS_BROKEN
    shown = ", ".join(f"CASE WHEN NOT ({cut} OR {fragment}) THEN {e} END AS {c}" for c, e in fields.items())
    return f"{_PACKETS} SELECT iface, CAST(floor(epoch) AS BIGINT) AS epoch, {shown}, inbound, CASE WHEN {cut} THEN 'network header not available' WHEN {fragment} THEN 'fragment at offset 100' END AS error FROM packets"


def made(roll_up_sql: str) -> dict[str, tuple[Callable, str | None]]:
    """id -> (Spark, DuckDB or None); ``roll_up_sql`` makes flows of packets."""
    return {
        "S01_store_scan": (store_scan, f"{_WITH} SELECT {', '.join((*_KEYS, *COUNTERS))} FROM flows"),
        "S03_store_query": (store_query, f"{_WITH} SELECT sip, dip, iface, dport, proto, {_SUMS} FROM flows GROUP BY ALL"),
        "S05_day_pruned": (day_pruned, f"{_WITH} SELECT time, iface, dport, {_SUMS} FROM flows WHERE time > {DAY} AND time < {DAY + 3 * 86_400 + 300} GROUP BY ALL"),
        "S06_block_check": (
            block_check,
            f"""{_WITH}, a AS ({_META} GROUP BY ALL), b AS ({_META} WHERE dport <> 0 GROUP BY ALL)
            SELECT a.iface, a.time AS "timestamp", CASE WHEN b.iface IS NULL THEN 'no rows' ELSE 'unequal flowcount' END AS problem FROM a LEFT JOIN b ON a.iface = b.iface AND a.time = b.time WHERE a.flowcount IS DISTINCT FROM b.flowcount""",
        ),
        "S07_store_span": (lambda spark, sf_dir: _store(spark, sf_dir).span(ifaces=["eth0"]), f"{_WITH} SELECT min(time) - 300 AS span_first, max(time) AS span_last FROM flows WHERE iface = 'eth0'"),
        "S09_store_block_meta": (
            lambda spark, sf_dir: _store(spark, sf_dir).block_meta().select("iface", "day", "timestamp", "flowcount", "packets_logged", "traffic"),
            f'{_WITH}, m AS ({_META} GROUP BY ALL) SELECT iface, time - time % 86400 AS day, time AS "timestamp", flowcount, CAST(packets_logged AS BIGINT) AS packets_logged, CAST(traffic AS BIGINT) AS traffic FROM m',
        ),
        "S11_summary_file": (summary_file, f"{_WITH} {_SUMMARY} GROUP BY iface"),
        "S12_summary_merge": (merged_summary, f"{_WITH} {_SUMMARY} GROUP BY iface"),
        "D01_clean_before": (cleaned, f"{_WITH} {_SUMMARY} WHERE day >= {DAY} GROUP BY iface"),
        "S14_csv_import": (imported, f"{_WITH} SELECT {', '.join(_KEYS)}, {_SUMS} FROM flows GROUP BY ALL"),
        "X02_ip_bytes": (read_addresses, f"{_WITH} SELECT DISTINCT {sql_ip_text('sip')} AS ip, sip AS bytes FROM flows"),
        "T01_decode": (decoded, _decoded_sql()),
        "T02_flow_identity": (
            flow_groups,
            f"""{_PACKETS} SELECT iface, least(sip, dip) AS low, greatest(sip, dip) AS high, proto,
            CASE WHEN proto = 6 AND sport <> 53 AND dport <> 53 THEN least(sport, dport)::BIGINT * 65536 + greatest(sport, dport) ELSE -1 END AS ports, count(*) AS n FROM packets GROUP BY ALL""",
        ),
        "T03_flow_log": (flow_log, None),
        "T06_stream_blocks": (streamed, roll_up_sql),
        "S23_dead_letters": (
            dead_letters,
            f"""{_PACKETS}, e AS (SELECT CAST(floor(epoch) AS BIGINT) AS ts, event_id, CASE WHEN event_id % 11 = 0 THEN 'short packet' WHEN event_id % 13 = 0 THEN 'fragment' END AS error FROM packets)
            SELECT error, count(*) AS n, min(ts) AS ts, (min(struct_pack(ts := ts, event_id := event_id))).event_id AS event_id FROM e WHERE error IS NOT NULL GROUP BY error""",
        ),
        "J09_reverse_dns": (
            named_servers,
            f"""{_WITH}, g AS (SELECT iface, dip, CAST(sum(pkts_rcvd + pkts_sent) AS BIGINT) AS packets, CAST(sum(bytes_rcvd + bytes_sent) AS BIGINT) AS bytes FROM flows GROUP BY ALL ORDER BY bytes DESC, iface, dip LIMIT 25),
            n AS (SELECT DISTINCT {sql_ip_text('dip')} AS ip FROM flows WHERE dport = 53) SELECT iface, coalesce('server ' || ip, {sql_ip_text('dip')}) AS dip, packets, bytes FROM g LEFT JOIN n ON ip LIKE '%.1' AND ip = {sql_ip_text('dip')}""",
        ),
        "X12_influx_escape": (escaped_texts, r"SELECT event_id, regexp_replace(event_type || ', ' || props || '\', '([\\, ])', '\\\1', 'g') AS text FROM events"),
    }
