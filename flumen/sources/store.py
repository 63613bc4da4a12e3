"""The flow store: Parquet partitioned by interface and day, with block metadata beside it.

    <root>/flows/iface=<name>/day=<epoch>/...      <root>/block_meta/iface=<name>/day=<epoch>/...

Rows of a file are sorted by time, so row-group statistics prune blocks. Interface lists and summaries
are answered from block metadata alone. All paths go through Hadoop's file systems.
"""

from __future__ import annotations

import time as clock

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.blocks import block_meta, covered_span, day_of, summary
from ..schema import BLOCK_META, BLOCK_SECONDS, DAY_SECONDS, FLOWS
from .metadata import summary_json


class FlowStore:
    def __init__(self, spark: SparkSession, root: str, codec: str = "zstd"):
        self.spark, self.root, self.codec = spark, root.rstrip("/"), codec
        self.flows_path, self.meta_path = f"{self.root}/flows", f"{self.root}/block_meta"

    # writing

    def write(self, flows: DataFrame, meta: DataFrame | None = None, mode: str = "append") -> None:
        """Appends flows and their block metadata (counted from the flows unless given).

        A day of an interface is spread over as many tasks as its rows need: the rebalance splits large
        partitions and joins small ones, so a busy interface is not one task.
        """
        rows = flows.withColumn("day", day_of()).select(*FLOWS.fieldNames())
        laid = rows.hint("rebalance", "iface", "day").sortWithinPartitions("iface", "day", "time")
        laid.write.partitionBy("iface", "day").mode(mode).option("compression", self.codec).parquet(self.flows_path)
        counted = block_meta(rows) if meta is None else meta
        counted.select(*BLOCK_META.fieldNames()).hint("rebalance", "iface", "day").write.partitionBy("iface", "day").mode(mode).option("compression", self.codec).parquet(self.meta_path)

    def write_batch(self, flows: DataFrame, batch: str) -> None:
        """Writes a batch under its name: flows and block metadata that the same batch wrote before are replaced.

        Files are staged, then moved to their partitions as ``<batch>-<k>.parquet``. A try that broke off is
        made good by the next one: it stages anew and moves over what is there.
        """
        staged = f"{self.root}/.staged-{batch}"
        FlowStore(self.spark, staged, self.codec).write(flows, mode="overwrite")
        fs = self._fs(self.root)
        for source, target in ((f"{staged}/flows", self.flows_path), (f"{staged}/block_meta", self.meta_path)):
            fresh = set()
            for k, file in enumerate(self._files(source)):
                partition = "/".join(file.split("/")[-3:-1])
                at = f"{target}/{partition}/{batch}-{k}.parquet"
                fs.mkdirs(self._path(f"{target}/{partition}"))
                fs.delete(self._path(at), False)
                fs.rename(self._path(file), self._path(at))
                fresh.add("/".join(at.split("/")[-3:]))
            # of an earlier try that had more files
            for status in fs.globStatus(self._path(f"{target}/iface=*/day=*/{batch}-*.parquet")) or ():
                name = "/".join(status.getPath().toString().split("/")[-3:])
                if name not in fresh:
                    fs.delete(status.getPath(), False)
        fs.delete(self._path(staged), True)
        self.spark.catalog.clearCache()

    def _files(self, path: str) -> list[str]:
        found = self._fs(path).globStatus(self._path(f"{path}/iface=*/day=*/part-*.parquet")) or ()
        return sorted(x.getPath().toString() for x in found)

    # reading

    def _read(self, path: str, schema) -> DataFrame:
        if not self._fs(path).exists(self._path(path)):
            return self.spark.createDataFrame([], schema)
        # a block whose file is damaged is left out, the query goes on
        return self.spark.read.schema(schema).option("ignoreCorruptFiles", "true").parquet(path).select(*schema.fieldNames())

    def flows(self) -> DataFrame:
        return self._read(self.flows_path, FLOWS)

    def block_meta(self) -> DataFrame:
        return self._read(self.meta_path, BLOCK_META)

    def damaged_blocks(self) -> DataFrame:
        """Blocks whose rows are not what their metadata says (unequal counts, no rows at all, or no metadata).

        A damaged file is left out of queries without a word; this tells which blocks lack rows.
        """
        counts = ("flowcount", "packets_logged", "traffic")
        said = self.block_meta().groupBy("iface", "timestamp").agg(*[F.sum(c).alias(f"said_{c}") for c in counts])
        there = block_meta(self.flows()).select("iface", "timestamp", *counts)
        both = said.join(there, ["iface", "timestamp"], "full")
        problem = F.when(F.col("flowcount").isNull(), "no rows").when(F.col("said_flowcount").isNull(), "no metadata")
        for c in counts:
            problem = problem.when(F.col(c) != F.col(f"said_{c}"), f"unequal {c}")
        return both.select("iface", "timestamp", problem.alias("problem")).where("problem IS NOT NULL")

    def span(self, first: int | None = None, last: int | None = None, ifaces=None) -> DataFrame:
        """First and last time covered, from block metadata alone."""
        meta = self.block_meta()
        if ifaces is not None:
            meta = meta.where(F.col("iface").isin(list(ifaces)))
        if first is not None:
            meta = meta.where((F.col("timestamp") > first) & (F.col("day") > first - DAY_SECONDS))
        if last is not None:
            meta = meta.where((F.col("timestamp") < last + BLOCK_SECONDS) & (F.col("day") < last + BLOCK_SECONDS))
        return covered_span(meta)

    def write_summary(self, path: str) -> None:
        """The summary of all interfaces as one JSON file."""
        fs = self._fs(path)
        out = fs.create(self._path(path), True)
        out.write(bytearray(summary_json(self.summary()).encode()))
        out.close()

    def summary(self) -> DataFrame:
        return summary(self.block_meta())

    def interfaces(self) -> list[str]:
        return sorted(r["iface"] for r in self.block_meta().select("iface").distinct().collect())

    # maintenance

    def _path(self, path: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self, path: str):
        return self._path(path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def clean(self, before: int, now: float | None = None) -> int:
        """Deletes the days that end before ``before`` (epoch seconds, in the past); returns how many.

        Folders that are no partitions of the store stay. The summary follows, as it is derived.
        """
        if before >= (clock.time() if now is None else now):
            raise ValueError("only entries from the past can be cleaned up")
        limit, gone = before - before % DAY_SECONDS, 0
        for root in (self.flows_path, self.meta_path):
            fs = self._fs(root)
            if not fs.exists(self._path(root)):
                continue
            for iface in fs.listStatus(self._path(root)):
                if not iface.isDirectory() or not iface.getPath().getName().startswith("iface="):
                    continue
                left = 0
                for day in fs.listStatus(iface.getPath()):
                    name = day.getPath().getName()
                    value = name[4:] if day.isDirectory() and name.startswith("day=") else ""
                    if value.isdigit() and str(int(value)) == value and int(value) < limit:
                        fs.delete(day.getPath(), True)
                        gone += root == self.flows_path
                    else:
                        left += 1
                if not left:
                    fs.delete(iface.getPath(), True)
        self.spark.catalog.clearCache()
        return gone

    def wipe(self) -> None:
        for root in (self.flows_path, self.meta_path):
            self._fs(root).delete(self._path(root), True)

    def compact(self, day: int) -> None:
        """Rewrites a day whose stream left many small files, interface by interface.

        The rewritten folder takes the old one's place by two renames; a run that broke off between them is
        made good by the next one.
        """
        fs = self._fs(self.root)
        staged = f"{self.root}/.compact-{day}"
        for status in fs.globStatus(self._path(f"{staged}-old/iface=*")) or ():
            target = self._path(f"{self.flows_path}/{status.getPath().getName()}/day={day}")
            if not fs.exists(target):
                fs.rename(self._path(f"{status.getPath().toString()}/day={day}"), target)
        for path in (f"{staged}-old", staged):
            fs.delete(self._path(path), True)
        rows = self.flows().where(F.col("day") == day).hint("rebalance", "iface", "day").sortWithinPartitions("iface", "day", "time")
        rows.write.partitionBy("iface", "day").mode("overwrite").option("compression", self.codec).parquet(staged)
        for status in fs.globStatus(self._path(f"{staged}/iface=*/day={day}")) or ():
            iface = status.getPath().getParent().getName()
            live, old = self._path(f"{self.flows_path}/{iface}/day={day}"), self._path(f"{staged}-old/{iface}/day={day}")
            fs.mkdirs(old.getParent())
            fs.rename(live, old)
            fs.rename(status.getPath(), live)
        for path in (f"{staged}-old", staged):
            fs.delete(self._path(path), True)
        self.spark.catalog.clearCache()
