"""Configuration: defaults, then a file, then the environment, then validation of everything at once."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Mapping
from dataclasses import dataclass, fields, replace

from strandlog import model as M
from strandlog.errors import InvalidArgument

# Units of durations, in ms.
UNITS = {"ns": 1e-6, "us": 1e-3, "µs": 1e-3, "ms": 1.0, "s": 1e3, "m": 6e4, "h": 3.6e6}
LOG_LEVELS = ("debug", "info", "warn", "error")
SYNC_MODES = ("every-write", "interval")
ENVIRONMENT = {"STRANDLOG_DATA_DIR": "data_dir", "STRANDLOG_LOG_LEVEL": "log_level", "STRANDLOG_SYNC_MODE": "sync_mode", "STRANDLOG_ADDRESS": "address"}


# Names in a configuration file with sections, and those that say nothing here, where there is no network server.
SECTIONS = ("storage", "subscribe")
OTHER_NAMES = {"listen_addr": "address", "segment_max_bytes": "segment_bytes", "index_interval_bytes": "index_interval"}
OF_SERVERS = ("max_recv_msg_size", "max_send_msg_size", "development", "shutdown_grace")


def _parsed(path: str) -> dict:
    """Settings of a JSON or YAML file, those in sections beside the others."""
    with open(path) as f:
        if path.endswith((".yaml", ".yml")):
            try:
                import yaml
            except ImportError as error:
                raise InvalidArgument("YAML can't be read here; use JSON") from error
            found = yaml.safe_load(f) or {}
        else:
            found = json.load(f)
    flat = {k: v for k, v in found.items() if k not in SECTIONS}
    for section in SECTIONS:
        flat |= found.get(section) or {}
    named = {k.replace("-", "_"): v for k, v in flat.items()}
    return {OTHER_NAMES.get(k, k): v for k, v in named.items() if k not in OF_SERVERS}


def duration_ms(text: str | int | float) -> float:
    """Milliseconds of a duration such as '1m30s', '100ms' or '-2h'; plain '0' is 0."""
    if isinstance(text, (int, float)):
        return float(text)
    sign, body = (-1, text[1:]) if text[:1] == "-" else (1, text.removeprefix("+"))
    if body == "0":
        return 0.0
    parts = re.findall(r"(\d+\.?\d*|\.\d+)(ns|us|µs|ms|s|m|h)", body)
    if not parts or "".join(a + b for a, b in parts) != body:
        raise InvalidArgument(f"invalid duration {text!r}")
    return sign * sum(float(a) * UNITS[b] for a, b in parts)


@dataclass(frozen=True)
class Config:
    address: str = "127.0.0.1:7400"
    data_dir: str = "./data"
    log_level: str = "info"
    segment_bytes: int = M.SEGMENT_BYTES
    index_interval: int = M.INDEX_INTERVAL
    sync_mode: str = "every-write"
    sync_interval_ms: float = 100.0
    retention_interval_ms: float = M.RETENTION_SWEEP_S * 1000.0
    read_limit: int = M.READ_LIMIT
    read_max_bytes: int = M.READ_MAX_BYTES
    grace_ms: float = 3_600_000.0  # for which dropped files stay, as readers of older manifests need them

    def problems(self) -> list[str]:
        """All that is wrong, not just the first."""
        rules = {
            "address must not be empty": bool(self.address),
            "data_dir must not be empty": bool(self.data_dir),
            f"log_level {self.log_level!r} must be one of {', '.join(LOG_LEVELS)}": self.log_level in LOG_LEVELS,
            "segment_bytes must be positive": self.segment_bytes > 0,
            "index_interval must be positive": self.index_interval > 0,
            f"sync_mode {self.sync_mode!r} must be one of {', '.join(SYNC_MODES)}": self.sync_mode in SYNC_MODES,
            "sync_interval must be positive in interval mode": self.sync_mode != "interval" or self.sync_interval_ms > 0,
            "retention_interval must not be negative": self.retention_interval_ms >= 0,
            "grace must not be negative": self.grace_ms >= 0,
            "read_limit must be positive": self.read_limit > 0,
            "read_max_bytes must be positive": self.read_max_bytes > 0,
        }
        return [text for text, ok in rules.items() if not ok]


def load(path: str | None = None, environment: Mapping[str, str] = os.environ) -> Config:
    """The configuration from a JSON or YAML file and the environment; empty variables don't count."""
    config = Config()
    if path:
        given = _parsed(path)
        for name in ("sync_interval", "retention_interval", "grace"):
            if name in given:
                given[name + "_ms"] = duration_ms(given.pop(name))
        if unknown := set(given) - {f.name for f in fields(Config)}:
            raise InvalidArgument(f"unknown settings: {', '.join(sorted(unknown))}")
        config = replace(config, **given)
    config = replace(config, **{field: environment[name] for name, field in ENVIRONMENT.items() if environment.get(name)})
    if found := config.problems():
        raise InvalidArgument("; ".join(found))
    return config
