"""Registered flow queries and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.net import ip_text, parse_ip, sql_ip_text
from ..functions.protocols import protocol_name, sql_protocol_name
from ..operators import blocks
from ..operators.direction import direction_column, packets_to_flows, roll_up
from ..output import lines
from ..schema import COUNTERS
from . import fixtures, round_trips
from .query import FOREVER, FlowQuery, parse_columns, plan, totals_of

#: All test events lie in January 2024; the queries' clock stands at its end.
NOW = 1_706_745_600
_hex = lambda text: parse_ip(text).hex()
_net = lambda column, low, high: f"{column} BETWEEN '{low.ljust(32, '0')}' AND '{high.ljust(32, 'f')}'"
_A, _B = _hex("10.0.0.7"), _hex("192.168.1.2")

#: id -> (options, condition in SQL over hex addresses); every option not given has its default.
SPECS: dict[str, tuple[dict, str]] = {
    "P07_talk_conv": ({"columns": "talk_conv"}, ""),
    "P07_talk_src": ({"columns": "talk_src"}, ""),
    "P07_talk_dst": ({"columns": "talk_dst"}, ""),
    "P07_apps_port": ({"columns": "apps_port"}, ""),
    "P07_agg_talk_port": ({"columns": "agg_talk_port"}, ""),
    "P07_raw": ({"columns": "raw"}, ""),
    "P06_aliases": ({"columns": "src,dst,sip"}, ""),
    "A05_group_sip_dport": ({"columns": "sip,dport"}, ""),
    "A05_group_dip_proto": ({"columns": "dip,proto"}, ""),
    "A06_group_time": ({"columns": "time"}, ""),
    "P05_group_iface": ({"columns": "iface"}, ""),
    "P09_group_time_iface": ({"columns": "iface,time"}, ""),
    "P11_direction_in": ({"columns": "talk_src", "direction": "in"}, ""),
    "P12_direction_out": ({"columns": "talk_src", "direction": "out"}, ""),
    "P13_direction_sum": ({"columns": "talk_src", "direction": "sum"}, ""),
    "P14_direction_both": ({"columns": "talk_dst", "direction": "both"}, ""),
    "O01_sort_bytes": ({"columns": "talk_conv", "sort": "bytes", "limit": 25}, ""),
    "O02_sort_packets_in": ({"columns": "talk_conv", "sort": "packets", "direction": "in", "limit": 25}, ""),
    "O02_sort_packets_out": ({"columns": "talk_conv", "sort": "packets", "direction": "out", "limit": 25}, ""),
    "O03_sort_time": ({"columns": "time,proto", "sort": "time"}, ""),
    "O04_ascending": ({"columns": "agg_talk_port", "ascending": True, "limit": 40}, ""),
    "O05_time_lifts_limit": ({"columns": "time,sip", "limit": 3}, ""),
    "O06_top_10": ({"columns": "sip,dip", "where": "dport = 443", "limit": 10}, "dport = 443"),
    "O06_limit_0": ({"columns": "sip,dip", "limit": 0}, ""),
    "O07_influx_unsorted": ({"columns": "dport,proto", "format": "influxdb"}, ""),
    "S04_one_iface": ({"columns": "talk_src", "ifaces": "eth3"}, ""),
    "S04_any_iface": ({"columns": "dport", "ifaces": "ANY"}, ""),
    "P10_implicit_iface": ({"columns": "dport", "ifaces": "eth0,eth2"}, ""),
    "U01_multi_iface": ({"columns": "iface,proto", "ifaces": "eth0,eth1,eth2"}, ""),
    "S05_strict_low": ({"columns": "time", "ifaces": "eth0", "first": 1_705_017_600, "last": 1_705_104_000}, ""),
    "S05_plus_interval": ({"columns": "time,sip", "ifaces": "eth1", "first": 1_704_999_900, "last": 1_705_000_199}, ""),
    "F01_dport_eq": ({"columns": "sip,dport", "where": "dport = 80"}, "dport = 80"),
    "F01_dport_ne": ({"columns": "sip,dport", "where": "dport != 80"}, "dport <> 80"),
    "F01_dport_lt": ({"columns": "sip,dport", "where": "dport < 443"}, "dport < 443"),
    "F01_dport_le": ({"columns": "sip,dport", "where": "dport <= 443"}, "dport <= 443"),
    "F01_dport_gt": ({"columns": "sip,dport", "where": "dport > 443"}, "dport > 443"),
    "F01_dport_ge": ({"columns": "sip,dport", "where": "dport >= 443"}, "dport >= 443"),
    "F02_proto_name": ({"columns": "sip,proto", "where": "proto = UDP"}, "proto = 17"),
    "F02_proto_range": ({"columns": "sip,proto", "where": "proto >= 1 and proto < 17"}, "proto >= 1 AND proto < 17"),
    "F03_sip_eq": ({"columns": "agg_talk_port", "where": "sip = 10.0.0.7"}, f"sip = '{_A}'"),
    "F03_sip_ne": ({"columns": "talk_src", "where": "sip != 10.0.0.7"}, f"sip <> '{_A}'"),
    "F03_dip_eq": ({"columns": "talk_src", "where": "dip = 192.168.1.2"}, f"dip = '{_B}'"),
    "F03_sip_v6": ({"columns": "talk_conv", "where": "sip = 2001:db8::14"}, f"sip = '{_hex('2001:db8::14')}'"),
    "F04_snet_8": ({"columns": "talk_src", "where": "snet = 10.0.0.0/8"}, _net("sip", "0a", "0a")),
    "F04_snet_26": ({"columns": "talk_src", "where": "snet = 10.0.0.70/26"}, _net("sip", "0a000040", "0a00007f")),
    "F04_snet_v6": ({"columns": "talk_src", "where": "snet = 2001:db8::/121"}, _net("sip", "20010db8" + "0" * 22 + "00", "20010db8" + "0" * 22 + "7f")),
    "F04_snet_3_mixes_versions": ({"columns": "talk_src", "where": "snet = 32.0.0.0/3"}, _net("sip", "2", "3")),
    "F04_snet_0": ({"columns": "talk_src", "where": "snet = 0.0.0.0/0"}, "true"),
    "F04_dnet_32": ({"columns": "talk_dst", "where": "dnet = 192.168.1.2/32"}, _net("dip", "c0a80102", "c0a80102")),
    "F04_dnet_ne": ({"columns": "talk_dst", "where": "dnet != 192.168.2.0/24"}, f"NOT {_net('dip', 'c0a802', 'c0a802')}"),
    "F05_host_eq": ({"columns": "talk_conv", "where": "host = 10.0.0.7"}, f"sip = '{_A}' OR dip = '{_A}'"),
    "F05_host_ne": ({"columns": "talk_conv", "where": "host != 192.168.1.2"}, f"sip <> '{_B}' AND dip <> '{_B}'"),
    "F06_net_eq": ({"columns": "talk_conv", "where": "net = 192.168.0.0/23"}, f"{_net('sip', 'c0a800', 'c0a801')} OR {_net('dip', 'c0a800', 'c0a801')}"),
    "F06_net_ne": ({"columns": "talk_conv", "where": "net != 192.168.0.0/23"}, f"NOT ({_net('sip', 'c0a800', 'c0a801')} OR {_net('dip', 'c0a800', 'c0a801')})"),
    "F07_and": ({"columns": "talk_conv", "where": "dport = 443 & sip = 10.0.0.7"}, f"dport = 443 AND sip = '{_A}'"),
    "F07_or": ({"columns": "sip,dport", "where": "dport = 53 | dport = 80"}, "dport IN (53, 80)"),
    "F07_not": ({"columns": "sip,dport", "where": "!(dport = 53 | dport = 80)"}, "dport NOT IN (53, 80)"),
    "F07_precedence": ({"columns": "sip,dport,proto", "where": "dport = 80 | dport = 443 & ! sip = 10.0.0.7"}, f"dport = 80 OR (dport = 443 AND sip <> '{_A}')"),
    "F08_brackets": ({"columns": "sip,dport", "where": "{dport = 80 | [dport = 443]} & (proto = tcp)"}, "dport IN (80, 443) AND proto = 6"),
    "F09_synonyms": ({"columns": "sip,dport", "where": "not dport eq 80 and (dport -leq 443 or dport greater 8000) * proto neq icmp"}, "dport <> 80 AND (dport <= 443 OR dport > 8000) AND proto <> 1"),
    "F10_case": ({"columns": "sip,dport", "where": "DPORT = 443 AND PROTO = TCP"}, "dport = 443 AND proto = 6"),
    "F11_hostname": ({"columns": "talk_conv", "where": "dst = server.test", "resolver": {"server.test": ["192.168.1.2", "192.168.0.1"]}.get}, f"dip IN ('{_B}', '{_hex('192.168.0.1')}')"),
    "F12_extra_predicate": ({"columns": "talk_src", "extra": lambda: F.col("dport") != 53}, "dport <> 53"),
    "F07_contradiction": ({"columns": "talk_src", "where": "dport < 100 & dport > 100"}, "false"),
    "P15_zero_total": ({"columns": "talk_src", "direction": "out", "where": "dip = 192.168.0.0 & sip = 10.0.0.7"}, f"dip = '{_hex('192.168.0.0')}' AND sip = '{_A}'"),
}


def spec_query(options: dict) -> FlowQuery:
    return FlowQuery(**({"now": NOW, "first": 0} | options))


def _of_spec(options: dict) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: plan(fixtures.flows_of_events(spark, sf_dir), spec_query(options)).rows


def _sql_of_spec(options: dict, where: str) -> str:
    """Written from the query's meaning: plain sums, scalar subqueries for totals, rendered keys."""
    o = {"ifaces": "any", "direction": "both", "sort": "bytes", "ascending": False, "limit": 1000, "first": 0, "last": FOREVER, "format": "txt"} | options
    names = None if o["ifaces"].lower() == "any" else o["ifaces"].split(",")
    keys = list(parse_columns(o["columns"]))
    if (names is None or len(names) > 1) and "iface" not in keys:
        keys.insert(1 if "time" in keys else 0, "iface")
    timed = "time" in keys
    condition = [f"time > {o['first']} AND time < {o['last'] + 300}"] + ([f"iface IN ({', '.join(map(repr, names))})"] if names else []) + ([f"({where})"] if where else [])
    by = ", ".join(keys)
    amount = {"in": "{0}_rcvd", "out": "{0}_sent"}.get(o["direction"], "{0}_rcvd + {0}_sent")
    order = "time" if timed else amount.format({"bytes": "bytes", "packets": "pkts", "time": "bytes"}[o["sort"]])
    way = "ASC" if timed or o["ascending"] else "DESC"
    show = {"sip": sql_ip_text("g.sip"), "dip": sql_ip_text("g.dip"), "proto": sql_protocol_name("g.proto")}
    cols = [f"{show.get(k, 'g.' + k)} AS {k}" for k in keys]
    if o["direction"] == "both":
        cols += ["pkts_rcvd AS packets_rcvd", "pkts_sent AS packets_sent", "bytes_rcvd", "bytes_sent"]
    else:
        cols += [f"{amount.format('pkts')} AS packets", f"{amount.format('bytes')} AS bytes"]
    for kind, name in (("pkts", "packets_percent"), ("bytes", "bytes_percent")):
        total = f"(SELECT sum({amount.format(kind)}) FROM g)"
        cols.append(f"CASE WHEN {total} = 0 THEN 0.0 ELSE CAST(100 * ({amount.format(kind)}) AS DOUBLE) / CAST({total} AS DOUBLE) END AS {name}")
    limit = "" if timed or o["format"] == "influxdb" else f" LIMIT {o['limit']}"
    sums = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in COUNTERS)
    return f"WITH {fixtures.SQL_FLOWS}, g AS (SELECT {by}, {sums} FROM flows WHERE {' AND '.join(condition)} GROUP BY {by}) SELECT {', '.join(cols)} FROM g ORDER BY {order} {way}, {by}{limit}"


def _flows(f):
    return lambda spark, sf_dir: f(fixtures.flows_of_events(spark, sf_dir))


def _packets(f):
    return lambda spark, sf_dir: f(fixtures.packets_of_events(spark, sf_dir))


_META_SQL = """meta AS (SELECT iface, day, time AS "timestamp", CAST(-1 AS BIGINT) AS pcap_packets_received, CAST(-1 AS BIGINT) AS pcap_packets_dropped,
  CAST(-1 AS BIGINT) AS pcap_packets_if_dropped, CAST(sum(pkts_rcvd + pkts_sent) AS BIGINT) AS packets_logged, count(*) AS flowcount,
  CAST(sum(bytes_rcvd + bytes_sent) AS BIGINT) AS traffic FROM flows GROUP BY iface, day, time)"""
_SUMMARY_SQL = 'summary AS (SELECT iface, CAST(sum(flowcount) AS BIGINT) AS flowcount, CAST(sum(traffic) AS BIGINT) AS traffic, min("timestamp") AS "begin", max("timestamp") AS "end" FROM meta GROUP BY iface)'
_WITH = f"WITH {fixtures.SQL_FLOWS}"
_VERDICT_SQL = """CASE WHEN tcp_flags IN (2, 1) THEN 'keep' WHEN tcp_flags IN (18, 17) THEN 'revert' WHEN substr(dip, 1, 6) IN ('e00000', 'e00001') THEN 'keep' WHEN substr(dip, 1, 8) = 'ffffffff' THEN 'keep'
  WHEN proto IN (6, 17) AND dport = 67 AND sport = 68 THEN 'keep' WHEN proto IN (6, 17) AND dport = 68 AND sport = 67 THEN 'revert'
  WHEN proto IN (6, 17) AND (dport < 1024 OR dport IN (5222, 5353, 8080, 8612, 17500, 1352)) AND sport > 20000 THEN 'keep'
  WHEN proto IN (6, 17) AND (sport < 1024 OR sport IN (5222, 5353, 8080, 8612, 17500, 1352)) AND dport > 20000 THEN 'revert' ELSE 'unknown' END"""
_P2F_SQL = f"""WITH {fixtures.SQL_PACKETS}, v AS (SELECT *, {_VERDICT_SQL} AS direction FROM packets),
o AS (SELECT (CAST(floor(epoch / 300.0) AS BIGINT) + 1) * 300 AS time, iface, CASE WHEN direction = 'revert' THEN dip ELSE sip END AS sip, CASE WHEN direction = 'revert' THEN sip ELSE dip END AS dip,
  CASE WHEN direction = 'revert' THEN dport ELSE sport END AS sport, CASE WHEN direction = 'revert' THEN sport ELSE dport END AS dport, proto, num_bytes, inbound FROM v),
f AS (SELECT time, iface, sip, dip, sport, dport, proto, CAST(sum(CASE WHEN inbound THEN num_bytes ELSE 0 END) AS BIGINT) AS bytes_rcvd, CAST(sum(CASE WHEN inbound THEN 0 ELSE num_bytes END) AS BIGINT) AS bytes_sent,
  count(*) FILTER (inbound) AS pkts_rcvd, count(*) FILTER (NOT inbound) AS pkts_sent FROM o GROUP BY ALL)"""
_SHOWN = "lower(hex(sip)) AS sip", "lower(hex(dip)) AS dip"
_STATS = "SELECT iface, time, CAST(sum(n) OVER (PARTITION BY iface ORDER BY time) AS BIGINT) AS received FROM (SELECT iface, time, count(*) AS n FROM {flows} GROUP BY iface, time)"


def _packet_rows(df: DataFrame) -> DataFrame:
    return df.selectExpr(*[{"sip": _SHOWN[0], "dip": _SHOWN[1]}.get(c, c) for c in df.columns])


def _stat_deltas(flows: DataFrame) -> DataFrame:
    flows.createOrReplaceTempView("_flows_for_stats")
    return blocks.counter_deltas(flows.sparkSession.sql(_STATS.format(flows="_flows_for_stats")), ("received",))


def _error_rows(packets: DataFrame) -> DataFrame:
    """Test decode errors: by the event number."""
    return blocks.error_counts(packets.selectExpr("CASE WHEN event_id % 11 = 0 THEN 'short packet' WHEN event_id % 13 = 0 THEN 'fragment' END AS error"))


#: id -> (Spark, DuckDB or None)
MORE: dict[str, tuple[Callable, str | None]] = {
    "A03_totals": (_flows(lambda f: totals_of(plan(f, spec_query({"columns": "talk_conv"})).groups).drop("hits")), f"{_WITH} SELECT {', '.join(f'CAST(sum({c}) AS BIGINT) AS total_{c}' for c in COUNTERS)} FROM flows"),
    "A04_hits": (_flows(lambda f: plan(f, spec_query({"columns": "talk_conv", "limit": 5})).totals.select("hits")), f"{_WITH} SELECT count(*) AS hits FROM (SELECT DISTINCT iface, sip, dip FROM flows)"),
    "A07_block_meta": (_flows(blocks.block_meta), f"{_WITH}, {_META_SQL} SELECT * FROM meta"),
    "A08_iface_summary": (_flows(lambda f: blocks.summary(blocks.block_meta(f))), f"{_WITH}, {_META_SQL}, {_SUMMARY_SQL} SELECT * FROM summary"),
    "A09_list_with_total": (
        _flows(lambda f: blocks.listing(blocks.summary(blocks.block_meta(f)))),
        f"""{_WITH}, {_META_SQL}, {_SUMMARY_SQL} SELECT * FROM summary UNION ALL SELECT 'Total', CAST(sum(flowcount) AS BIGINT), CAST(sum(traffic) AS BIGINT), NULL, NULL FROM summary""",
    ),
    "S07_covered_span": (_flows(lambda f: plan(f, spec_query({"columns": "sip", "ifaces": "eth0", "where": "dport = 1"})).span), f"{_WITH} SELECT min(time) - 300 AS span_first, max(time) AS span_last FROM flows WHERE iface = 'eth0'"),
    "X05_day_timestamp": (_flows(lambda f: f.select("time", blocks.day_of().alias("day_start")).distinct()), f"{_WITH} SELECT DISTINCT time, time - time % 86400 AS day_start FROM flows"),
    "X04_protocol_names": (_flows(lambda f: f.select("proto", protocol_name(F.col("proto")).alias("name")).distinct()), f"{_WITH} SELECT DISTINCT proto, {sql_protocol_name('proto')} AS name FROM flows"),
    "P01_ip_text_v4": (_flows(lambda f: f.where("lower(hex(sip)) LIKE '0a%'").select(ip_text("sip").alias("ip")).distinct()), f"{_WITH} SELECT DISTINCT {sql_ip_text('sip')} AS ip FROM flows WHERE sip LIKE '0a%'"),
    "P01_ip_text_v6": (_flows(lambda f: f.where("lower(hex(sip)) LIKE '2%'").select(ip_text("sip").alias("ip")).distinct()), f"{_WITH} SELECT DISTINCT {sql_ip_text('sip')} AS ip FROM flows WHERE sip LIKE '2%'"),
    "S18_csv_rows": (
        _flows(lambda f: lines.csv_lines(plan(f, spec_query({"columns": "dport,proto", "direction": "sum"})))),
        f"""{_WITH}, g AS (SELECT iface, dport, proto, CAST(sum(pkts_rcvd + pkts_sent) AS BIGINT) AS p, CAST(sum(bytes_rcvd + bytes_sent) AS BIGINT) AS b FROM flows GROUP BY ALL)
          SELECT iface || ',' || dport || ',' || {sql_protocol_name('proto')} || ',' || p || ',' || printf('%.2f', 100.0 * p / (SELECT sum(p) FROM g)) || ',' || b || ',' || printf('%.2f', 100.0 * b / (SELECT sum(b) FROM g)) AS line FROM g""",
    ),
    "S20_influx_lines": (
        _flows(lambda f: lines.influx_lines(plan(f, spec_query({"columns": "raw", "format": "influxdb"})))),
        f"""{_WITH} SELECT 'flows,iface=' || iface || ',proto=' || {sql_protocol_name('proto')} || ' sip=' || {sql_ip_text('sip')} || ',dip=' || {sql_ip_text('dip')} || ',dport=' || dport
          || ',packets_rcvd=' || sum(pkts_rcvd) || 'i,packets_sent=' || sum(pkts_sent) || 'i,bytes_rcvd=' || sum(bytes_rcvd) || 'i,bytes_sent=' || sum(bytes_sent) || 'i ' || time || '000000000' AS line
          FROM flows GROUP BY time, iface, sip, dip, dport, proto""",
    ),
    "S21_syslog_lines": (
        _flows(lambda f: lines.syslog_lines(f)),
        f"""{_WITH} SELECT time || ',' || iface || ',' || {sql_ip_text('sip')} || ',' || {sql_ip_text('dip')} || ',' || dport || ',' || {sql_protocol_name('proto')} || ',' || pkts_rcvd || ',' || pkts_sent
          || ',' || bytes_rcvd || ',' || bytes_sent AS line FROM flows""",
    ),
    "T04_direction": (_packets(lambda p: p.groupBy(direction_column().alias("direction"), "proto").agg(F.count("*").alias("n"))), f"WITH {fixtures.SQL_PACKETS} SELECT {_VERDICT_SQL} AS direction, proto, count(*) AS n FROM packets GROUP BY ALL"),
    "A10_packet_to_flow": (_packets(lambda p: _packet_rows(packets_to_flows(p))), f"{_P2F_SQL} SELECT * FROM f"),
    "A11_flow_roll_up": (
        _packets(lambda p: _packet_rows(roll_up(packets_to_flows(p)))),
        f"{_P2F_SQL} SELECT time, iface, sip, dip, dport, proto, {', '.join(f'CAST(sum({c}) AS BIGINT) AS {c}' for c in COUNTERS)} FROM f GROUP BY ALL",
    ),
    "A12_error_counts": (_packets(_error_rows), "SELECT CASE WHEN event_id % 11 = 0 THEN 'short packet' ELSE 'fragment' END AS error, count(*) AS n FROM events WHERE event_id % 11 = 0 OR event_id % 13 = 0 GROUP BY ALL"),
    "A13_stat_deltas": (_flows(_stat_deltas), f"{_WITH}, s AS ({_STATS.format(flows='flows')}) SELECT iface, time, received - coalesce(lag(received) OVER (PARTITION BY iface ORDER BY time), 0) AS delta_received FROM s"),
}
MORE |= round_trips.made(MORE["A11_flow_roll_up"][1])

QUERIES = {f"q_{k}": _of_spec(options) for k, (options, _) in SPECS.items()} | {f"q_{k}": f for k, (f, _) in MORE.items()}
ORACLES = {f"q_{k}": _sql_of_spec(options, where) for k, (options, where) in SPECS.items()} | {f"q_{k}": sql for k, (_, sql) in MORE.items() if sql}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top talkers over HTTPS, of all interfaces."""
    return QUERIES["q_O06_top_10"](spark, sf_dir)
