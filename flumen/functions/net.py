"""Addresses of 16 bytes: IPv4 in the first four (the rest zero), IPv6 in all."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_ip(text: str) -> bytes:
    """16 bytes of an address; whatever has a dot is taken for IPv4, mapped forms included."""
    try:
        if "." in text:
            address = ipaddress.ip_address(text)
            if address.version == 6:
                return address.packed[12:] + bytes(12)
            return address.packed + bytes(12)
        return ipaddress.IPv6Address(text).packed
    except ValueError as e:
        raise ValueError(f"not an IP address: {text!r}") from e


def is_ip(text: str) -> bool:
    try:
        parse_ip(text)
    except ValueError:
        return False
    return True


def cidr_range(text: str) -> tuple[bytes, bytes]:
    """First and last address of a network; bits of the host part are ignored."""
    head, slash, mask = text.partition("/")
    if not slash or not mask.isascii() or not mask.isdigit():
        raise ValueError(f"not a network: {text!r}")
    bits, most = int(mask), 32 if "." in head else 128
    if bits > most:
        raise ValueError(f"the netmask of {text!r} is over {most}")
    number, free = int.from_bytes(parse_ip(head), "big"), 128 - bits
    low = number >> free << free
    return low.to_bytes(16, "big"), (low | (1 << free) - 1).to_bytes(16, "big")


def format_ip(raw: bytes) -> str:
    """Text of an address; one whose last twelve bytes are zero prints as IPv4."""
    if not any(raw[4:]):
        return ".".join(map(str, raw[:4]))
    groups = [f"{raw[i] << 8 | raw[i + 1]:x}" for i in range(0, 16, 2)]
    best, start = 1, None
    for i in range(8):
        run = 0
        while i + run < 8 and groups[i + run] == "0":
            run += 1
        if run > best:
            best, start = run, i
    if start is None:
        return ":".join(groups)
    return f"{':'.join(groups[:start])}::{':'.join(groups[start + best :])}"


def _render(hex32: str, dialect: str) -> str:
    """SQL that renders 32 hex digits; Spark and DuckDB differ in array functions only."""
    if dialect == "spark":
        quad = " || '.' || ".join(f"CAST(CAST(conv(substr({hex32}, {i}, 2), 16, 10) AS INT) AS STRING)" for i in (1, 3, 5, 7))
    else:
        quad = " || '.' || ".join(f"CAST(('0x' || substr({hex32}, {i}, 2))::INT AS VARCHAR)" for i in (1, 3, 5, 7))
    groups = " || ':' || ".join(f"regexp_replace(substr({hex32}, {i}, 4), '^0{{1,3}}', '')" for i in range(1, 33, 4))
    runs = []
    for n in range(8, 1, -1):
        pattern = f"^(.*?)(?:^|:)(?:0:){{{n - 1}}}0(?::|$)(.*)$"
        has = f"g RLIKE '{pattern}'" if dialect == "spark" else f"regexp_matches(g, '{pattern}')"
        runs.append(f"WHEN {has} THEN regexp_extract(g, '{pattern}', 1) || '::' || regexp_extract(g, '{pattern}', 2)")
    long = f"CASE {' '.join(runs)} ELSE g END"
    if dialect == "spark":
        wide = f"element_at(transform(array({groups}), g -> {long}), 1)"
    else:
        wide = f"list_transform([{groups}], lambda g: {long})[1]"
    return f"CASE WHEN substr({hex32}, 9) = '{'0' * 24}' THEN {quad} ELSE {wide} END"


def ip_text(column: str) -> Column:
    """Text of a 16-byte column, by built-in expressions for IPv4 and IPv6."""
    return F.expr(_render(f"lower(hex({column}))", "spark"))


def sql_ip_text(hex32: str) -> str:
    """The same as DuckDB SQL over 32 lower-case hex digits."""
    return _render(hex32, "duckdb")


def ip_bytes(column: str) -> Column:
    """16 bytes of a text column; null where it is no address (for import, which sets such rows aside).

    Dotted quads and full or compressed IPv6 groups are read by built-in expressions.
    """
    c = f"lower(trim({column}))"
    octets = " || ".join(f"lpad(hex(CAST(split({c}, '[.]')[{i}] AS INT)), 2, '0')" for i in range(4))
    good = rf"{c} RLIKE '^((25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(\\.|$)){{4}}$' AND NOT {c} LIKE '%.'"
    # a compressed address has one '::', which stands for the groups that are missing
    full = f"""CASE WHEN instr({c}, '::') > 0 THEN concat(split({c}, '::')[0], IF(split({c}, '::')[0] = '', '', ':'),
        repeat('0:', 8 - (size(array_remove(split({c}, ':'), '')))), split({c}, '::')[1]) ELSE {c} END"""
    groups = f"array_remove(split({full}, ':'), '')"
    wide = rf"{c} RLIKE '^[0-9a-f:]+$' AND {c} NOT RLIKE ':::|::.*::|[0-9a-f]{{5}}|^:[^:]|[^:]:$' AND size({groups}) = 8 AND (instr({c}, '::') > 0 OR size(split({c}, ':')) = 8)"
    return F.expr(
        f"CASE WHEN {good} THEN unhex({octets} || '{'0' * 24}') WHEN {wide} THEN unhex(array_join(transform({groups}, g -> lpad(g, 4, '0')), '')) END"
    )
