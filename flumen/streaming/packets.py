"""Sources of packets: decoding of captured frames, files and topics as streams, faulty packets."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import PACKETS

# Protocol numbers, and the one that stands for none.
_TCP, _UDP, _ESP, _NONE = 6, 17, 50, 255
#: Captured frames: ``frame`` begins with the link layer, ``length`` is that of the whole packet on the wire.
FRAMES = "iface string, ts timestamp, frame binary, length int, inbound boolean"
#: Packets of a file and of a micro-batch, where a bounded set of packets is given to a stream.
FILE_PACKETS, SLICE_PACKETS = 250_000, 2_000_000


def _byte(frame: Column, at: Column | int) -> Column:
    """The byte at an offset, as a number; null beyond the end."""
    at = F.lit(at) if isinstance(at, int) else at
    return F.when(at < F.length(frame), F.conv(F.hex(F.substring(frame, at + 1, F.lit(1))), 16, 10).cast("int"))


def _two(frame: Column, at: Column | int) -> Column:
    return _byte(frame, at) * 256 + _byte(frame, at + 1)


def decode_packets(frames: DataFrame, link: int = 14) -> DataFrame:
    """``frames`` as packets, with ``error``: null, or why the packet cannot be read (then its fields are null).

    Network and transport fields by built-in expressions. IPv4 fragments other than the first carry no
    ports and are errors, except those of ESP, which has none anyway; so are cut-off headers. Frames
    without an IP packet are left out. Lengths count modulo 65536.
    """
    frame = F.col("frame")
    version = F.floor(_byte(frame, link) / 16)
    rows = frames.withColumns({"v": version, "head": F.when(version == 4, F.pmod(_byte(frame, link), F.lit(16)) * 4).when(version == 6, F.lit(40))}).where("v IN (4, 6) OR v IS NULL")
    rows = rows.withColumn("proto", F.coalesce(F.when(F.col("v") == 4, _byte(frame, link + 9)).when(F.col("v") == 6, _byte(frame, link + 6)), F.lit(_NONE)))
    fragment = F.when(F.col("v") == 4, F.pmod(_two(frame, link + 6), F.lit(8192))).otherwise(F.lit(0))
    body = F.col("head") + link
    ports = F.col("proto").isin(_TCP, _UDP)
    error = (
        F.when(F.col("v").isNull() | (F.length(frame) < link + F.greatest("head", F.lit(20))) | (F.col("head") < 20), "network header not available")
        .when((F.col("proto") != _ESP) & (fragment != 0), F.concat(F.lit("fragment at offset "), fragment.cast("string")))
        .when(ports & (F.length(frame) < body + 4), "transport header not available")
        .when((F.col("proto") == _TCP) & (F.length(frame) < body + 14), "incomplete TCP header")
    )
    address = lambda v4, v6: F.when(F.col("v") == 4, F.concat(F.substring(frame, link + v4 + 1, 4), F.lit(bytearray(12)))).otherwise(F.substring(frame, link + v6 + 1, 16))
    rows = rows.withColumn("error", error)
    good = F.col("error").isNull()
    fields = {
        "sip": address(12, 8), "dip": address(16, 24), "sport": F.when(ports, _two(frame, body)).otherwise(0), "dport": F.when(ports, _two(frame, body + 2)).otherwise(0),
        "proto": F.col("proto"), "num_bytes": F.pmod("length", F.lit(65_536)), "tcp_flags": F.when(F.col("proto") == _TCP, _byte(frame, body + 13)).otherwise(0),
    }
    types = {f.name: f.dataType for f in PACKETS}
    return rows.select("iface", "ts", *[F.when(good, c).cast(types[n]).alias(n) for n, c in fields.items()], "inbound", "error")


def packet_files(spark: SparkSession, path: str, max_files: int | None = None, max_bytes: str | None = None) -> DataFrame:
    """A stream of packets from Parquet files that appear below ``path``; the bounds hold for a micro-batch."""
    reader = spark.readStream.schema(T.StructType([*PACKETS, T.StructField("error", T.StringType())]))
    for name, value in (("maxFilesPerTrigger", max_files), ("maxBytesPerTrigger", max_bytes)):
        if value is not None:
            reader = reader.option(name, value)
    return reader.parquet(path)


def ordered_files(packets: DataFrame, folder: str, n: int, file_packets: int = FILE_PACKETS, slice_packets: int = SLICE_PACKETS) -> list[list[str]]:
    """Writes ``n`` packets below ``folder`` as files that follow one another in time; their paths, slice by slice.

    A file has about ``file_packets`` packets and a slice about ``slice_packets``, however many there are in all.
    Packets of one moment may be dealt to several files.
    """
    spark, files = packets.sparkSession, -(-n // file_packets) or 1
    packets.repartitionByRange(files, "ts", "sip", "dip", "sport", "dport").write.parquet(folder)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/part-*.parquet")
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path) or ()
    # named by the number of the partition
    written = sorted(x.getPath().toString() for x in found)
    step = -(-len(written) // (-(-n // slice_packets) or 1)) or 1
    return [written[k : k + step] for k in range(0, len(written), step)]


def arriving(spark: SparkSession, slices: list[list[str]], folder: str) -> Iterator[int]:
    """Moves files into the folder of a stream, a slice at each step; yields the slice's number.

    Run the stream (``availableNow``) at each step: it then meets the slices in their order whatever the
    times of the files, so no packet is late, and holds the open blocks of one slice.
    """
    to = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = to(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(to(folder))
    for k, files in enumerate(slices):
        for file in files:
            if not fs.rename(to(file), to(f"{folder}/{file.rsplit('/', 1)[1]}")):
                raise OSError(f"{file} cannot be moved to {folder}")
        yield k


def parse_packets(values: DataFrame) -> DataFrame:
    """Packets from JSON texts in ``value`` (addresses in base64); a text that cannot be read is an error."""
    rows = values.select(F.col("value").cast("string").alias("value"))
    rows = rows.withColumn("p", F.from_json("value", PACKETS))
    whole = F.expr(" AND ".join(f"p.{f.name} IS NOT NULL" for f in PACKETS))
    return rows.select("p.*", F.when(~F.coalesce(whole, F.lit(False)), "unreadable record").alias("error"))


def packet_topic(spark: SparkSession, servers: str, topic: str, max_offsets: int | None = None, starting: str = "latest") -> DataFrame:
    """A stream of packets from JSON records of a Kafka topic; ``max_offsets`` bounds a micro-batch. Needs Spark's Kafka package."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", starting)
    if max_offsets is not None:
        reader = reader.option("maxOffsetsPerTrigger", max_offsets)
    return parse_packets(reader.load())


def split_errors(packets: DataFrame, error: str = "error") -> tuple[DataFrame, DataFrame]:
    """Good packets and the dead letters, which have a decode error."""
    return packets.where(F.col(error).isNull()).drop(error), packets.where(F.col(error).isNotNull())


def first_of_each_error(packets: DataFrame, error: str = "error") -> DataFrame:
    """The first packet of each distinct error, and how many there are."""
    rows = packets.where(F.col(error).isNotNull())
    others = [c for c in packets.columns if c != error]
    found = rows.groupBy(error).agg(F.count("*").alias("n"), F.min(F.struct("ts", *[c for c in others if c != "ts"])).alias("first"))
    return found.select(error, "n", *[f"first.{c}" for c in others])
