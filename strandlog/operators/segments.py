"""Segments: rotation, statistics, the sparse index and lookups in it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from strandlog.functions import fold, scan


def assign(log: DataFrame, max_bytes: int, size: str = "frame_bytes", topic: str = "topic") -> DataFrame:
    """topic, offset, size and segment_base: a segment ends before a batch that would exceed max_bytes; a larger batch has its own."""
    narrow = log.select(topic, "offset", size)
    found = fold.runs(narrow, size, max_bytes, 0, topic).select(topic, "offset", F.col("run_base").alias("segment_base"))
    return narrow.join(found, [topic, "offset"])


def stats(log: DataFrame, size: str = "frame_bytes", topic: str = "topic") -> DataFrame:
    """Per segment: next_offset, n_records, bytes and the timestamp of its last record (not the greatest)."""
    return log.groupBy(topic, "segment_base").agg(
        (F.max("offset") + 1).alias("next_offset"), F.count("*").alias("n_records"), F.sum(size).alias("bytes"),
        F.max_by("timestamp_ms", "offset").alias("last_timestamp_ms"),
    )


def with_position(log: DataFrame, size: str = "frame_bytes", topic: str = "topic") -> DataFrame:
    """log with position: bytes of the segment before the record."""
    out = scan.running(log, [topic, "segment_base"], scan.offset_block(), ["offset"], F.col(size), "sum", "position")
    return out.withColumn("position", F.col("position") - F.col(size))


def sparse_index(log: DataFrame, interval: int, size: str = "frame_bytes", topic: str = "topic") -> DataFrame:
    """topic, segment_base, relative_offset and relative_position of every entry."""
    found = fold.marks(with_position(log, size, topic), interval, topic).filter("entry")
    return found.select(topic, "segment_base", (F.col("offset") - F.col("segment_base")).alias("relative_offset"), F.col("position").alias("relative_position"))


def lookups(log: DataFrame, interval: int, size: str = "frame_bytes", topic: str = "topic") -> DataFrame:
    """For every record, the position that a reader of its offset starts from: that of the last entry at or before it."""
    marked = fold.marks(with_position(log, size, topic), interval, topic)
    place = F.when(F.col("entry"), F.col("position"))
    return scan.running(marked, [topic, "segment_base"], scan.offset_block(), ["offset"], place, "max", "seek").select(topic, "offset", "segment_base", "seek")


def surviving(segment_stats: DataFrame, start: int, topic: str = "topic") -> DataFrame:
    """Segments that a read from start has to open."""
    return segment_stats.filter(F.col("next_offset") > start)


def active(topic: str = "topic"):
    """Whether a segment is its topic's last, as a window over segments (metadata: one row per segment)."""
    return F.col("segment_base") == F.max("segment_base").over(W.partitionBy(topic))
