"""Bounded samples of labelled rows, chosen by hash so that every run takes the same."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def least_hashes(rows: DataFrame, label: str, key: str, buckets: int) -> list[tuple]:
    """(label, key hash) of the row of least hash in each of ``buckets`` buckets of each label.

    At most ``buckets`` rows a label, however many rows there are; the maps reduce to that before
    anything is shuffled.
    """
    h = F.xxhash64(F.col(key))
    picked = rows.select(F.col(label).alias("label"), h.alias("h")).groupBy("label", F.pmod("h", F.lit(buckets)).alias("bucket")).agg(F.min("h").alias("h"))
    return [(r["label"], r["h"]) for r in picked.collect()]
