import ipaddress
import random
from datetime import UTC, datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from flumen.functions.human import count_text, duration_text, size_text, time_text
from flumen.functions.net import format_ip, ip_bytes, ip_text, parse_ip
from flumen.functions.protocols import NAMES, NUMBERS, protocol_name
from flumen.functions.timeparse import LAYOUTS, parse_time


def test_humanised():
    assert [size_text(x) for x in (0, 1024, 1025, 17 << 20)] == ["0.00  B", "1024.00  B", "1.00 kB", "17.00 MB"]
    assert [count_text(x) for x in (0, 813, 1000, 1320000)] == ["0.00  ", "813.00  ", "1000.00  ", "1.32 M"]
    assert [duration_text(x) for x in (0.017, 1.25, 61, 3720)] == ["17ms", "1.2s", "1m 1s", "1h 2m"]
    assert time_text(1456428575) == "16-02-25 19:29:35"


def test_times():
    t = datetime(2016, 2, 3, 15, 4, 0, tzinfo=UTC)
    for layout in LAYOUTS:
        assert parse_time(t.strftime(layout)) == int(t.timestamp()), layout
    assert parse_time("1456428575") == 1456428575
    assert parse_time("-15d:04h:05m", now=10**9) == 10**9 - 15 * 86400 - 4 * 3600 - 5 * 60
    assert parse_time("3.2.2016 15:04", zone=timezone(timedelta(hours=1))) == int(t.timestamp()) - 3600
    assert parse_time("03.02.16 15:04:00 +0000") == int(t.timestamp())
    for bad in ("", "-", "-5x", "-1d:", "tomorrow"):
        with pytest.raises(ValueError):
            parse_time(bad)


def test_protocols(spark):
    assert NAMES[6] == "TCP" and NAMES[17] == "UDP" and NAMES[58] == "IPv6-ICMP" and NAMES[132] == "SCTP" and NAMES[141] == "ROHC"
    assert NUMBERS["igmp"] == 2 and "unknown" not in NUMBERS
    got = spark.createDataFrame([(6,), (250,), (255,)], "p int").select(protocol_name(F.col("p")).alias("n")).collect()
    assert [r["n"] for r in got] == ["TCP", "", "UNKNOWN"]


def test_address_columns(spark):
    rng = random.Random(3)
    raws = [bytes(16), parse_ip("255.255.255.255"), parse_ip("::1"), parse_ip("1:0:0:2:0:0:3:4"), parse_ip("0:0:1::"), parse_ip("1:2:3:4:5:6:7:8")]
    raws += [b"".join(rng.choice([0, 0, 1, 0xAB, 0xFFFF]).to_bytes(2, "big") for _ in range(8)) for _ in range(300)]
    df = spark.createDataFrame([(bytearray(r),) for r in raws], "a binary")
    assert [r["t"] for r in df.select(ip_text("a").alias("t")).collect()] == [format_ip(r) for r in raws]
    texts = [format_ip(r) for r in raws] + ["256.1.1.1", "1.2.3", "1.2.3.4.", "x", "", "1::2::3", ":::", "12345::", "1:2:3", "2001:DB8::1", "::", "1:2:3:4:5:6:7:8:9"]
    got = [r["b"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(ip_bytes("t").alias("b")).collect()]
    for text, value in zip(texts, got, strict=True):
        try:
            expected = parse_ip(text) if "." in text else ipaddress.IPv6Address(text).packed
        except ValueError:
            expected = None
        assert (None if value is None else bytes(value)) == expected, text
