"""Retention over segment statistics. Segments are metadata: one row for up to half a gigabyte of log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .segments import active


def marked(segments: DataFrame, now_ms: int | Column, retention_ms: Column | int = 0, retention_bytes: Column | int = 0, topic: str = "topic") -> DataFrame:
    """segments with by_age, by_size and dropped.

    By age: sealed segments whose last record is strictly older than the limit, up to the first
    that isn't. Then by size: the oldest sealed ones while the topic exceeds the limit. The last
    segment always stays; a limit of 0 doesn't hold.
    """
    limit = lambda x: x if isinstance(x, Column) else F.lit(x)
    age, size = limit(retention_ms), limit(retention_bytes)
    up_to = W.partitionBy(topic).orderBy("segment_base").rowsBetween(W.unboundedPreceding, 0)
    rest = W.partitionBy(topic).orderBy("segment_base").rowsBetween(0, W.unboundedFollowing)
    fresh = (F.col("last_timestamp_ms") >= limit(now_ms) - age) | F.col("_active")
    s = segments.withColumn("_active", active(topic))
    s = s.withColumn("by_age", (age > 0) & (F.max(fresh.cast("int")).over(up_to) == 0))
    left = F.sum(F.when(F.col("by_age"), 0).otherwise(F.col("bytes"))).over(rest)
    s = s.withColumn("by_size", ~F.col("by_age") & (size > 0) & ~F.col("_active") & (left > size))
    return s.withColumn("dropped", F.col("by_age") | F.col("by_size")).drop("_active")


def result(marked_segments: DataFrame, topic: str = "topic") -> DataFrame:
    """Per topic, segments and bytes removed."""
    gone = F.col("dropped")
    return marked_segments.groupBy(topic).agg(
        F.sum(F.when(gone, 1).otherwise(0)).cast("long").alias("segments_removed"), F.sum(F.when(gone, F.col("bytes")).otherwise(0)).cast("long").alias("bytes_removed")
    )
