"""Validation rules as columns: the code of the first rule that fails, or null. Lengths are in bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandlog import model as M


def message_error(payload: Column, key: Column, headers: Column, max_bytes: int = M.DEFAULT_MESSAGE_BYTES) -> Column:
    """Payload, then key, then number of headers, then each header: reserved, key length, value length."""
    names = F.map_keys(headers)
    one = lambda k: (
        F.when(k.startswith(M.SYSTEM_PREFIX), "reserved_header")
        .when(F.octet_length(k) > M.MAX_HEADER_KEY_BYTES, "header_key_too_long")
        .when(F.octet_length(F.element_at(headers, k)) > M.MAX_HEADER_VALUE_BYTES, "header_value_too_long")
    )
    failed = F.filter(F.transform(F.array_sort(names), one), lambda x: x.isNotNull())
    return (
        F.when(F.octet_length(payload) > max_bytes, "payload_too_large")
        .when(F.octet_length(key) > M.MAX_KEY_BYTES, "key_too_long")
        .when(F.size(names) > M.MAX_HEADERS, "too_many_headers")
        .otherwise(F.get(failed, F.lit(0)))
    )


def topic_name_error(name: Column) -> Column:
    size = F.octet_length(name)
    return (
        F.when(name.isNull() | (size == 0) | (size > M.MAX_TOPIC_NAME_BYTES) | name.isin(".", ".."), "invalid_name")
        .when(name.startswith(M.RESERVED_TOPIC_PREFIX), "reserved_name")
        .when(~name.rlike(M.TOPIC_NAME) | name.contains("\n"), "invalid_name")
    )


def consumer_name_error(name: Column) -> Column:
    size = F.octet_length(name)
    bad = name.isNull() | (size == 0) | (size > M.MAX_CONSUMER_NAME_BYTES) | name.contains("/") | name.contains("\x00")
    return F.when(bad, "invalid_consumer")


def config_error(partitions: Column, max_bytes: Column, retention_ms: Column, retention_bytes: Column, cleanup: Column, replication: Column) -> Column:
    return (
        F.when((max_bytes != 0) & ((max_bytes < 1) | (max_bytes > M.MAX_MESSAGE_BYTES)), "invalid_config")
        .when((retention_ms < 0) | (retention_bytes < 0), "invalid_config")
        .when(~cleanup.isin("", "delete", "compact"), "invalid_config")
        .when(~replication.isin(0, 1), "invalid_config")
        .when(partitions != 1, "invalid_partitions")
    )


def partition_ok(partition: Column, partitions: Column) -> Column:
    return (partition >= 0) & (partition < partitions)


def sweepable(cleanup: Column, retention_ms: Column, retention_bytes: Column) -> Column:
    """Whether the retention sweep looks at a topic."""
    return (cleanup == "delete") & ((retention_ms > 0) | (retention_bytes > 0))
