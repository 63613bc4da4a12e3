"""Numbers, spans and times as people read them."""

from __future__ import annotations

from datetime import UTC, datetime, tzinfo

# Names of units, and below the forms of durations and times.
_SIZES = (" B", "kB", "MB", "GB", "TB", "PB", "EB", "ZB", "YB")
_COUNTS = (" ", "k", "M", "G", "T", "P", "E", "Z", "Y")


def _scaled(value: int, step: int, units: tuple) -> str:
    """Divided while the whole part is over a step, so a value of exactly one step keeps its unit."""
    size, k = float(value), 0
    while int(size) > step and k < len(units) - 1:
        size /= step
        k += 1
    return f"{size:.2f} {units[k]}"


def size_text(value: int) -> str:
    return _scaled(value, 1024, _SIZES)


def count_text(value: int) -> str:
    return _scaled(value, 1000, _COUNTS)


def duration_text(seconds: float) -> str:
    if seconds >= 3600:
        return f"{int(seconds // 3600)}h{int(seconds % 3600 // 60):2d}m"
    if seconds >= 60:
        return f"{int(seconds // 60)}m{int(seconds % 60):2d}s"
    return f"{seconds:.1f}s" if seconds >= 1 else f"{int(seconds * 1000)}ms"


def time_text(epoch: int, zone: tzinfo = UTC) -> str:
    return datetime.fromtimestamp(epoch, zone).strftime("%y-%m-%d %H:%M:%S")
