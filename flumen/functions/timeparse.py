"""Time arguments: epoch seconds, relative spans, calendar layouts."""

from __future__ import annotations

import re
import time as clock
from datetime import UTC, datetime, tzinfo

_SECONDS = {"d": 86_400, "h": 3_600, "m": 60}
_DATES = ("%d.%m.%Y", "%d.%m.%y", "%Y-%m-%d")
_CLOCKS = ("%H:%M:%S", "%H:%M")
#: Layouts in order of trial; every numeric date goes with either clock, with and without an offset.
LAYOUTS = (
    "%a %b %d %H:%M:%S %Y",
    "%a %b %d %H:%M:%S %z %Y",
    "%d %b %y %H:%M %z",
    "%a, %d %b %Y %H:%M:%S %z",
    "%Y-%m-%dT%H:%M:%S%z",
    *(f"{d} {c}{z}" for d in _DATES for c in _CLOCKS for z in ("", " %z")),
)


def parse_relative(text: str, now: float) -> int:
    """``-15d:04h:05m``: chunks of days, hours and minutes before now, in any order."""
    back = 0
    for chunk in text[1:].split(":"):
        m = re.fullmatch(r"([+-]?[0-9]+)([dhm])", chunk)
        if not m:
            raise ValueError(f"incorrect relative time: {text!r}")
        back += int(m[1]) * _SECONDS[m[2]]
    return int(now) - back


def parse_time(text: str | int, now: float | None = None, zone: tzinfo = UTC) -> int:
    """Epoch seconds of a time argument. ``now`` and ``zone`` stand for the clock and the local zone."""
    if isinstance(text, int):
        return text
    text = text.strip()
    if not text:
        raise ValueError("empty time")
    if text[0] == "-":
        return parse_relative(text, clock.time() if now is None else now)
    if re.fullmatch(r"[+-]?[0-9]+", text):
        return int(text)
    for layout in LAYOUTS:
        try:
            t = datetime.strptime(text, layout)
        except ValueError:
            continue
        return int((t if t.tzinfo else t.replace(tzinfo=zone)).timestamp())
    raise ValueError(f"unable to parse time {text!r}")
