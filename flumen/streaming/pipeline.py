"""Streams into the flow store."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..config import Config
from ..operators.direction import oriented, packet_sums
from ..output.lines import syslog_lines
from ..schema import BLOCK_SECONDS, PACKETS
from ..sources.store import FlowStore
from .flowlog import merge_groups, stream_flow_blocks
from .packets import first_of_each_error, split_errors  # noqa: F401

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stateless_blocks(packets: DataFrame, seconds: int = BLOCK_SECONDS, start: int = 0, delay: str = "1 minute") -> DataFrame:
    """Tumbling event-time windows over oriented packets, stamped with their end; no flow state is kept."""
    windowed = oriented(packets.withWatermark("ts", delay)).groupBy(F.window("ts", f"{seconds} seconds", startTime=f"{start % seconds} seconds"), "iface", "sip", "dip", "dport", "proto").agg(*packet_sums())
    return windowed.select(F.col("window.end").cast("long").alias("time"), *[c for c in windowed.columns if c != "window"])


def start_store(
    packets: DataFrame,
    store: FlowStore,
    checkpoint: str,
    stateful: bool = True,
    seconds: int = BLOCK_SECONDS,
    syslog: str | None = None,
    trigger: dict | None = None,
    delay: str = "1 minute",
    name: str = "stream",
) -> StreamingQuery:
    """Writes each micro-batch of blocks to the store, and as lines to ``syslog`` if given.

    A batch is written under the stream's name and its number, so one that is tried again takes the place of
    what it wrote before.
    """
    blocks = stream_flow_blocks(packets, seconds, delay=delay) if stateful else stateless_blocks(packets, seconds, delay=delay)

    def write(batch: DataFrame, number: int) -> None:
        # here, for in the stream's plan the filter would move below the watermark
        rows = merge_groups(without_markers(batch)).persist()
        try:
            store.write_batch(rows, f"{name}-{number}")
            if syslog:
                syslog_lines(rows).write.mode("overwrite").text(f"{syslog}/batch={name}-{number}")
        finally:
            rows.unpersist()

    return blocks.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"availableNow": True})).start()


def start_dead_letters(packets: DataFrame, path: str, checkpoint: str, trigger: dict | None = None, error: str = "error") -> StreamingQuery:
    """Writes the first packet of each distinct error of a stream, with the batch's count of that error.

    An error that an earlier batch wrote is counted again but its packet is not repeated (it is null).
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        found = first_of_each_error(batch, error)
        earlier = [f"{path}/batch={k}" for k in range(number)]
        fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        fs = fs_path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        earlier = [x for x in earlier if fs.exists(fs_path(x))]
        if earlier:
            known = spark.read.schema(found.schema).parquet(*earlier).select(error).distinct().withColumn("known", F.lit(True))
            found = found.join(known, error, "left").select(*[F.when(F.col("known").isNull(), F.col(c)).alias(c) if c not in (error, "n") else F.col(c) for c in found.columns])
        found.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return packets.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def end_marker(spark: SparkSession, at: float) -> DataFrame:
    """A packet of no interface at an event time. As the last input of a stream it closes all blocks that end before
    that time less the stream's delay; ``without_markers`` takes it out again, after the watermark has seen it."""
    row = {f.name: F.lit(bytearray(16)) if f.dataType == T.BinaryType() else F.lit(False) if f.dataType == T.BooleanType() else F.lit("") if f.name == "iface" else F.lit(0) for f in PACKETS}
    row["ts"] = F.lit(at).cast("timestamp")
    return spark.range(1).select(*[c.cast(next(f for f in PACKETS if f.name == n).dataType).alias(n) for n, c in row.items()])


def without_markers(blocks: DataFrame) -> DataFrame:
    return blocks.where("iface <> ''")


def flush(spark: SparkSession, folder: str, until: int, seconds: int = BLOCK_SECONDS, delay_seconds: int = 60) -> None:
    """Ends a stream over files: adds a marker that closes the blocks up to the one that holds ``until``.

    Run the stream once more after it (``availableNow``). Packets of later blocks can still follow.
    """
    end = (until // seconds + 1) * seconds
    end_marker(spark, end + delay_seconds + 1).coalesce(1).write.mode("append").parquet(folder)


@dataclass
class Sources:
    """One stream for each source, with a checkpoint of its own, so that a failing one leaves the others alone.

    ``start`` makes the stream of a source. A stream that has failed is started anew by ``tend`` (call it once a
    block), which gives up on a source after ``tries`` failures in a row.
    """

    start: Callable[[str, object], StreamingQuery]
    tries: int = 3
    running: dict[str, StreamingQuery] = field(default_factory=dict)
    options: dict[str, object] = field(default_factory=dict)
    failures: dict[str, int] = field(default_factory=dict)
    errors: list[tuple[str, str]] = field(default_factory=list)

    def add(self, name: str, options: object = None) -> None:
        self.options[name], self.failures[name] = options, 0
        self.running[name] = self.start(name, options)

    def remove(self, name: str) -> None:
        self.running.pop(name).stop()
        self.options.pop(name), self.failures.pop(name)

    def apply(self, old: Config, new: Config) -> dict[str, list[str]]:
        """Reconfiguration: interfaces that are gone stop, new ones start, changed ones start anew."""
        changes = old.changed(new)
        for name in (*changes["remove"], *changes["restart"]):
            if name in self.running:
                self.remove(name)
        for name in (*changes["add"], *changes["restart"]):
            self.add(name, new.interfaces[name])
        return changes

    def tend(self) -> list[str]:
        """Starts failed sources anew; the names of these."""
        again = []
        for name, query in self.running.items():
            error = None if query.isActive else query.exception()
            if error is None:
                if query.isActive and (query.lastProgress or {}).get("batchId", -1) >= 0:
                    self.failures[name] = 0
                continue
            if self.failures[name] < self.tries:
                self.failures[name] += 1
                self.errors.append((name, str(error).splitlines()[0]))
                again.append(name)
        for name in again:
            self.running[name] = self.start(name, self.options[name])
        return again

    def stop(self) -> None:
        for name in list(self.running):
            self.remove(name)

    def status(self) -> dict[str, dict]:
        """State of every source, and its failures."""
        return {name: status(query) | {"failures": self.failures[name], "given_up": self.failures[name] >= self.tries} for name, query in self.running.items()}


def status(query: StreamingQuery) -> dict:
    """State of a stream for people: phase, batch, rows in, rows a second, error."""
    last = query.lastProgress or {}
    return {
        "active": query.isActive, "message": query.status["message"], "batch": last.get("batchId"), "rows": last.get("numInputRows"),
        "rows_per_second": last.get("processedRowsPerSecond"), "error": str(query.exception()) if query.exception() else None,
    }
