"""The data model: schema of a log, limits and fixed names."""

from __future__ import annotations

from dataclasses import dataclass, field

# Fixed values of the data model.
MAX_KEY_BYTES = 4096
MAX_HEADERS = 64
MAX_HEADER_KEY_BYTES = 512
MAX_HEADER_VALUE_BYTES = 8192
MAX_TOPIC_NAME_BYTES = 255
MAX_CONSUMER_NAME_BYTES = 128
DEFAULT_MESSAGE_BYTES = 1 << 20
MAX_MESSAGE_BYTES = 1 << 26
TOPIC_NAME = "^[a-zA-Z0-9][a-zA-Z0-9._-]*$"
RESERVED_TOPIC_PREFIX = "__"
SEGMENT_BYTES = 512 << 20
INDEX_INTERVAL = 4096
READ_LIMIT = 512
READ_MAX_BYTES = 1 << 20
RETENTION_SWEEP_S = 30
STATES = ("starting", "recovering", "running", "draining", "stopping", "stopped")
TRANSITIONS = (
    ("starting", "recovering"), ("starting", "stopping"),
    ("recovering", "running"), ("recovering", "stopping"),
    ("running", "draining"), ("running", "stopping"),
    ("draining", "stopping"),
    ("stopping", "stopped"),
)

#: Prefix of headers that carry metadata inside a frame; 8 bytes, so that frame sizes are as specified.
SYSTEM_PREFIX = "__slog__"
#: Metadata columns with a reserved header, in column order.
SYSTEM_FIELDS = ("event_id", "content_type", "correlation_id", "trace_id", "retry_count", "ttl_ms", "priority", "schema_version")

#: One row is one record. `offset` is dense within a topic; batch_base is the first offset of the record's batch.
LOG_SCHEMA = (
    "topic string, partition int, offset long, batch_base long, timestamp_ms long, event_id string, key string, payload binary, "
    "headers map<string,string>, content_type string, correlation_id string, trace_id string, retry_count int, ttl_ms long, "
    "priority int, schema_version int, frame_bytes long, segment_base long"
)
MESSAGE_DEFAULTS = {
    "event_id": "''", "key": "''", "payload": "X''", "headers": "cast(map() as map<string,string>)", "content_type": "''", "correlation_id": "''",
    "trace_id": "''", "retry_count": "0", "ttl_ms": "0L", "priority": "0", "schema_version": "0",
}


@dataclass(frozen=True)
class TopicConfig:
    """Zero limits disable retention by age or size."""

    max_message_bytes: int = DEFAULT_MESSAGE_BYTES
    retention_ms: int = 0
    retention_bytes: int = 0
    cleanup: str = "delete"
    replication: int = 1


@dataclass(frozen=True)
class Topic:
    name: str
    partitions: int = 1
    config: TopicConfig = field(default_factory=TopicConfig)
    created_ms: int = 0


@dataclass(frozen=True)
class TrimResult:
    segments: int = 0
    bytes: int = 0
