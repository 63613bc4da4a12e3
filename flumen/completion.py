"""Shell completion of a query command line."""

from __future__ import annotations

import shlex

from .plans.condition import ATTRIBUTES, CLOSE, COMPARATORS, OPEN, tokenize
from .plans.query import ALIASES, PRESETS
from .schema import KEYS

FLAGS = ("-a", "-c", "-clean", "-d", "-e", "-f", "-h", "-i", "-in", "-l", "-list", "-n", "-out", "-resolve", "-s", "-sum", "-version", "-wipe", "-x")
_VALUES = {"-e": ("txt", "json", "csv", "influxdb"), "-s": ("bytes", "packets", "time")}
_TAKES_VALUE = ("-c", "-clean", "-d", "-e", "-f", "-i", "-l", "-n", "-s")


def split_words(line: str) -> list[str]:
    """Words of a line as the shell would split it; an open quote is closed."""
    for end in ("", '"', "'"):
        try:
            words = shlex.split(line + end)
            return words + [""] if not end and line[-1:].isspace() else words
        except ValueError:
            continue
    return line.split()


def _list_options(word: str, options) -> list[str]:
    head, comma, last = word.rpartition(",")
    used = set(head.split(",")) if head else set()
    return [f"{head}{comma}{o}" for o in options if o.startswith(last) and o not in used]


def _columns(word: str) -> list[str]:
    names = [*KEYS, "time", "iface", *ALIASES]
    return sorted(_list_options(word, names if "," in word else [*names, *PRESETS]))


def next_in_condition(text: str) -> list[str]:
    """Tokens that may follow a condition that is being written."""
    tokens, level, expect = tokenize(text), 0, "primitive"
    partial = "" if not text or text[-1:].isspace() or not tokens else tokens.pop()
    for t in tokens:
        if expect == "primitive":
            if t in OPEN:
                level += 1
            elif t not in ("!", "not"):
                expect = "comparator"
        elif expect == "comparator":
            expect = "value"
        elif expect == "value":
            expect = "operator"
        elif t in CLOSE:
            level -= 1
        else:
            expect = "primitive"
    options = {"primitive": [*ATTRIBUTES, "!", "("], "comparator": list(COMPARATORS), "value": [], "operator": ["&", "|", *([")"] if level else [])]}[expect]
    return sorted(o for o in options if o.startswith(partial))


def complete(line: str, ifaces: list[str]) -> list[str]:
    """Completions of the last word of a command line."""
    words = split_words(line)
    word, before = words[-1], words[-2] if len(words) > 1 else ""
    if before == "-i":
        return sorted(_list_options(word, [*ifaces, *([] if "," in word else ["any"])]))
    if before == "-c":
        return next_in_condition(word)
    if before in _VALUES:
        return [v for v in _VALUES[before] if v.startswith(word)]
    if before in _TAKES_VALUE:
        return []
    return [f for f in FLAGS if f.startswith(word)] if word.startswith("-") else _columns(word)
