"""Metadata files in JSON: blocks of a day, and the summary of all interfaces."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.blocks import day_of
from ..schema import BLOCK_META, SUMMARY

_BLOCK = T.StructType([T.StructField(f.name, T.LongType()) for f in BLOCK_META if f.name not in ("iface", "day")])
_DAY_FILE = T.StructType([T.StructField("blocks", T.ArrayType(_BLOCK))])
_ENTRY = T.StructType([T.StructField(f.name, T.LongType()) for f in SUMMARY if f.name != "iface"])
_SUMMARY_FILE = T.StructType([T.StructField("interfaces", T.MapType(T.StringType(), _ENTRY))])


def read_block_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Block metadata from ``<iface>/<day>/meta.json`` files; damaged files count as empty."""
    rows = spark.read.schema(_DAY_FILE).option("multiLine", "true").option("mode", "PERMISSIVE").json(paths).select("blocks", F.input_file_name().alias("file"))
    blocks = rows.select(F.element_at(F.split("file", "/"), -3).alias("iface"), F.explode("blocks").alias("b")).select("iface", "b.*")
    return blocks.withColumn("day", day_of("timestamp")).select(*BLOCK_META.fieldNames())


def read_summary(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(_SUMMARY_FILE).option("multiLine", "true").json(path)
    return rows.select(F.explode("interfaces").alias("iface", "s")).select("iface", "s.*").select(*SUMMARY.fieldNames())


def summary_json(summaries: DataFrame) -> str:
    """One entry an interface, at most some hundreds."""
    rows = [r.asDict() for r in summaries.collect()]
    return json.dumps({"interfaces": {r["iface"]: {k: r[k] for k in ("flowcount", "traffic", "begin", "end")} for r in rows}}, sort_keys=True)


def merge_summaries(old: DataFrame, new: DataFrame) -> DataFrame:
    """Counts added, begin and end widened; interfaces of either side stay."""
    return (
        old.unionByName(new)
        .groupBy("iface")
        .agg(F.sum("flowcount").alias("flowcount"), F.sum("traffic").alias("traffic"), F.min("begin").alias("begin"), F.max("end").alias("end"))
    )
