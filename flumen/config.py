"""Capture configuration: where the store is and which interfaces are read."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

# Limits of the configuration.
MOST_INTERFACES = 1024
BUFFER_RANGE = (1 << 10, 1 << 30)


@dataclass(frozen=True)
class Interface:
    bpf_filter: str = ""
    buf_size: int = 2 << 20
    promisc: bool = False

    def __post_init__(self):
        if not BUFFER_RANGE[0] <= self.buf_size <= BUFFER_RANGE[1]:
            raise ValueError(f"buf_size {self.buf_size} is outside {BUFFER_RANGE}")


@dataclass(frozen=True)
class Config:
    db_path: str
    interfaces: dict[str, Interface] = field(default_factory=dict)
    syslog_flows: bool = False

    def __post_init__(self):
        if not self.db_path:
            raise ValueError("db_path is empty")
        if len(self.interfaces) > MOST_INTERFACES:
            raise ValueError(f"more than {MOST_INTERFACES} interfaces")

    @classmethod
    def parse(cls, text: str) -> Config:
        data = json.loads(text)
        return cls(data.get("db_path", ""), {k: Interface(**v) for k, v in data.get("interfaces", {}).items()}, bool(data.get("syslog_flows", False)))

    def changed(self, new: Config) -> dict[str, list[str]]:
        """Interfaces to add, remove and start anew; the store's place cannot change."""
        if new.db_path != self.db_path:
            raise ValueError("db_path cannot be changed while running")
        old, now = self.interfaces, new.interfaces
        return {
            "add": sorted(now.keys() - old.keys()),
            "remove": sorted(old.keys() - now.keys()),
            "restart": sorted(k for k in old.keys() & now.keys() if old[k] != now[k]),
        }
