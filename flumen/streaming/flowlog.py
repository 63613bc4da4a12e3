"""The stateful flow log: packets matched to flows in either direction, rotated at block ends.

Matching depends on the order of packets (a request and a later one from another port share a key
but not a reverse key), so packets that could match are kept together and taken in time order. What
could match shares interface, protocol and the pair of addresses, and for TCP outside port 53 also the
pair of ports; that is the grouping key.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain, groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.direction import classify
from ..schema import BLOCK_SECONDS

OUTPUT = "time long, iface string, sip binary, dip binary, dport int, proto int, bytes_rcvd long, bytes_sent long, pkts_rcvd long, pkts_sent long"
GROUP = ("iface", "low", "high", "proto", "ports")
#: Order of the packets of a group.
ORDER = ("epoch", "sip", "dip", "sport", "dport")
#: What the log takes of a packet, besides its time.
PACKET = ("sip", "dip", "sport", "dport", "proto", "num_bytes", "tcp_flags", "inbound")
#: Flows that the batch form hands on at once.
OUT_ROWS = 10_000
_TCP, _DNS = 6, 53
#: State of a live flow: its key, then ends, counters and whether its direction is known.
FLOW_KEY = "sip binary, dip binary, dport int, sport int, proto int"
FLOW = "sip binary, dip binary, dport int, proto int, bytes_rcvd long, bytes_sent long, pkts_rcvd long, pkts_sent long, known boolean"


class FlowLog:
    """Live flows of one group, by forward key."""

    def __init__(self, flows: dict | None = None):
        self.flows: dict[tuple, list] = flows or {}  # key -> [sip, dip, dport, proto, four counters, direction known]

    @staticmethod
    def keys(sip: bytes, dip: bytes, sport: int, dport: int, proto: int) -> tuple[tuple, tuple]:
        """Forward and reverse key; the source port counts for TCP only, and not around DNS."""
        session = proto == _TCP and _DNS not in (sport, dport)
        return (sip, dip, dport, sport if session else 0, proto), (dip, sip, sport, dport if session else 0, proto)

    def add(self, sip: bytes, dip: bytes, sport: int, dport: int, proto: int, size: int, flags: int, inbound: bool) -> None:
        forward, reverse = self.keys(sip, dip, sport, dport, proto)
        flow = self.flows.get(forward) or self.flows.get(reverse)
        if flow is None:
            verdict = classify(dip, sport, dport, proto, flags)
            # the ends are put in order once, when the flow is made; its key stays that of the packet
            ends = (dip, sip, sport) if verdict == "revert" else (sip, dip, dport)
            flow = self.flows[forward] = [*ends, proto, 0, 0, 0, 0, verdict != "unknown"]
        elif not flow[8]:
            flow[8] = classify(dip, sport, dport, proto, flags) != "unknown"
        flow[4 if inbound else 5] += size
        flow[6 if inbound else 7] += 1

    def rotate(self) -> list[tuple]:
        """Sums by (sip, dip, dport, proto) since the last call. Idle flows go, and those of unknown direction."""
        sums: dict[tuple, list] = {}
        kept: dict = {}
        for key, flow in self.flows.items():
            if flow[6] or flow[7]:
                total = sums.setdefault(tuple(flow[:4]), [0, 0, 0, 0])
                for k in range(4):
                    total[k] += flow[4 + k]
                if flow[8]:
                    kept[key] = [*flow[:4], 0, 0, 0, 0, True]
        self.flows = kept
        return [(*k, *v) for k, v in sums.items()]


class Rotation:
    """A flow log with block ends on the event-time axis."""

    def __init__(self, log: FlowLog, end: int | None, seconds: int, start: int = 0):
        self.log, self.end, self.seconds, self.start = log, end, seconds, start

    def end_of(self, epoch: float) -> int:
        return int((epoch - self.start) // self.seconds + 1) * self.seconds + self.start

    def advance(self, until: int) -> Iterator[tuple]:
        """Rotations of all blocks that end before ``until``, as (time, flow...)."""
        while self.end is not None and self.end < until:
            for row in self.log.rotate():
                yield (self.end, *row)
            self.end = self.end + self.seconds if self.log.flows else None
        if self.end is None:
            self.end = until

    def feed(self, packets: pd.DataFrame) -> Iterator[tuple]:
        """Packets in time order; a late one counts in the open block."""
        ordered = packets.sort_values(list(ORDER), kind="stable")
        return self.take((p.epoch, bytes(p.sip), bytes(p.dip), int(p.sport), int(p.dport), int(p.proto), int(p.num_bytes), int(p.tcp_flags), bool(p.inbound)) for p in ordered.itertuples(index=False))

    def take(self, packets: Iterable[tuple]) -> Iterator[tuple]:
        """The same of packets that are in order already, each its time and then ``PACKET``."""
        for epoch, *packet in packets:
            end = self.end_of(epoch)
            if self.end is None or end > self.end:
                yield from self.advance(end)
            self.log.add(*packet)

    def finish(self) -> Iterator[tuple]:
        """Rotation of the open block."""
        if self.end is not None:
            for row in self.log.rotate():
                yield (self.end, *row)


def grouped_packets(packets: DataFrame) -> DataFrame:
    """Packets with the columns of the grouping key."""
    low, high = F.least("sip", "dip"), F.greatest("sip", "dip")
    session = (F.col("proto") == _TCP) & (F.col("sport") != _DNS) & (F.col("dport") != _DNS)
    ports = F.when(session, F.least("sport", "dport").cast("long") * 65_536 + F.greatest("sport", "dport")).otherwise(F.lit(-1))
    return packets.withColumns({"low": low, "high": high, "ports": ports})


def _rows(found: list[tuple], iface: str) -> pd.DataFrame:
    names = [c.split()[0] for c in OUTPUT.split(", ")]
    return pd.DataFrame([(t, iface, *rest) for t, *rest in found], columns=names)


def _batch(found: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), schema.types, strict=True)], schema=schema)


def flow_blocks(packets: DataFrame, seconds: int = BLOCK_SECONDS, start: int = 0) -> DataFrame:
    """Batch form: all blocks of a bounded set of packets (``epoch`` is their time), merged over groups.

    Packets come group by group and in time order; a task holds one Arrow batch, the live flows of one group and
    ``OUT_ROWS`` flows. Most groups have one packet or two, so a group costs no more than its packets do: no frame
    is made for it. A packet that lacks a field is in no flow.
    """
    names, types = zip(*(c.split() for c in OUTPUT.split(", ")), strict=True)
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    schema = pa.schema([(n, kinds[t]) for n, t in zip(names, types, strict=True)])
    width = len(GROUP)

    def flows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        rows = chain.from_iterable(zip(*(c.to_pylist() for c in batch.columns), strict=True) for batch in batches)
        for key, group in groupby(rows, lambda row: row[:width]):
            log = Rotation(FlowLog(), None, seconds, start)
            for end, *flow in chain(log.take(row[width:] for row in group), log.finish()):
                yield end, key[0], *flow

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = []
        for flow in flows(batches):
            found.append(flow)
            if len(found) == OUT_ROWS:
                yield _batch(found, schema)
                found = []
        if found:
            yield _batch(found, schema)

    rows = grouped_packets(packets).dropna(subset=[*GROUP, *ORDER, *PACKET]).repartition(*GROUP).sortWithinPartitions(*GROUP, *ORDER)
    # the group's columns twice, for a packet has its protocol too
    sent = rows.select(*[F.col(c).alias(f"group_{c}") for c in GROUP], "epoch", *PACKET)
    return merge_groups(sent.mapInArrow(fold, OUTPUT))


def merge_groups(parts: DataFrame) -> DataFrame:
    """Groups of one pair of hosts may give the same flow key; their counters add up."""
    return parts.groupBy("time", "iface", "sip", "dip", "dport", "proto").agg(*[F.sum(c).alias(c) for c in ("bytes_rcvd", "bytes_sent", "pkts_rcvd", "pkts_sent")])


class FlowLogProcessor(StatefulProcessor):
    """Streaming form. State is a map of the live flows and the end of the open block; a timer closes it.

    Only flows that a batch changes are written back.
    """

    def __init__(self, seconds: int = BLOCK_SECONDS, start: int = 0):
        self.seconds, self.start = seconds, start

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.end = handle.getValueState("end", "end long")
        self.flows = handle.getMapState("flows", FLOW_KEY, FLOW)

    def _load(self) -> tuple[Rotation, dict]:
        end = self.end.get()[0] if self.end.exists() else None
        whole = lambda row: [bytes(x) if isinstance(x, bytes | bytearray) else x for x in row]
        flows = {tuple(whole(k)): whole(v) for k, v in self.flows.iterator()} if end is not None else {}
        return Rotation(FlowLog(flows), end, self.seconds, self.start), {k: tuple(v) for k, v in flows.items()}

    def _save(self, r: Rotation, before: dict) -> None:
        for key in before.keys() - r.log.flows.keys():
            self.flows.removeKey(key)
        for key, flow in r.log.flows.items():
            if before.get(key) != tuple(flow):
                self.flows.updateValue(key, tuple(flow))
        if r.log.flows:
            self.end.update((r.end,))
            self.handle.registerTimer(r.end * 1000)
        else:
            self.end.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        r, before = self._load()
        found = list(r.feed(pd.concat(list(rows))))
        self._save(r, before)
        yield _rows(found, key[0])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        r, before = self._load()
        due = expiredTimerInfo.getExpiryTimeInMs() // 1000
        found = []
        if r.end is not None and r.end <= due:
            found = list(r.finish())
            r.end += self.seconds
            self._save(r, before)
        yield _rows(found, key[0])

    def close(self) -> None:
        pass


def stream_flow_blocks(packets: DataFrame, seconds: int = BLOCK_SECONDS, start: int = 0, delay: str = "1 minute") -> DataFrame:
    """Blocks of a stream of packets with column ``ts``. The session needs the RocksDB state store."""
    timed = grouped_packets(packets.withWatermark("ts", delay).withColumn("epoch", F.col("ts").cast("double")))
    return timed.groupBy(*GROUP).transformWithStateInPandas(FlowLogProcessor(seconds, start), OUTPUT, "Append", "EventTime")
