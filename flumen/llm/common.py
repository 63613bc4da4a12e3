"""Helpers shared by the document operators."""

from __future__ import annotations

import gc
import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the one that all executors share (``spark.checkpoint.dir``).

    Where the session names none, a local session gets a folder of this machine; on a cluster it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="flumen-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/flumen-{uuid.uuid4().hex}"


def stored(df: DataFrame, folder: str, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: cuts lineage, survives lost executors."""
    path = f"{folder}/{name}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished steps, which it does once nothing refers to them."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def drop_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder of intermediate tables that no later step reads."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


_shipped: set = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once a Spark application, so that their Python finds it."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if os.path.isdir(package):  # else it was itself shipped as an archive
        path = os.path.join(tempfile.mkdtemp(prefix="flumen-"), "flumen.zip")
        with zipfile.ZipFile(path, "w") as archive:
            for top, _, names in os.walk(package):
                for name in names:
                    if name.endswith(".py"):
                        full = os.path.join(top, name)
                        archive.write(full, os.path.relpath(full, os.path.dirname(package)))
        context.addPyFile(path)
    _shipped.add(context.applicationId)


def map_arrow(df: DataFrame, run, schema) -> DataFrame:
    """``mapInArrow`` with this package at hand."""
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def crc_mod4(doc_id: str = "doc_id") -> Column:
    """crc32(doc_id as text) mod 4; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4


def is_held_out(doc_id: str = "doc_id") -> Column:
    """Remainder 2 marks the held-out quarter; a null id is not held out (and never learned from)."""
    return F.coalesce(crc_mod4(doc_id) == 2, F.lit(False))


def is_learnable(doc_id: str = "doc_id") -> Column:
    return F.coalesce(crc_mod4(doc_id) != 2, F.lit(False))


def pieces(batches, rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """Batches in slices of so many rows, so that a task's Python objects stay few."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], dict], schema: str) -> DataFrame:
    """Arrow batches through ``fn``, which returns column lists by name."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            out = fn(batch)
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    return map_arrow(df, run, schema)


def text_chunks(texts: list, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Index ranges of ``texts`` that hold about ``most`` characters each, one text at least."""
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text) if text else 0
        if size >= most:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
