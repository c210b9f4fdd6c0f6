"""Logs made from the input tables, in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlog.functions import frames
from strandlog.operators import log

HOUR_MS = 3_600_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return e.select(
        F.col("event_type").alias("topic"), "event_id", "ts", "user_id", "value",
        F.col("user_id").cast("string").alias("key"), F.col("props").alias("payload"), ms.alias("timestamp_ms"),
    )


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as logs: a topic per event type, offsets in order of time, one record a batch."""
    hour = F.floor(F.col("timestamp_ms") / HOUR_MS)
    rows = log.assign_offsets(event_messages(spark, sf_dir), ["ts", "event_id"], hour)
    size = F.lit(frames.BATCH_HEADER + frames.RECORD_FIXED) + F.octet_length("key") + F.octet_length("payload")
    return rows.withColumns({"batch_base": F.col("offset"), "frame_bytes": size.cast("long")})


EVENT_LOG = """L AS (SELECT event_type AS topic, event_id, user_id, value, cast(user_id AS VARCHAR) AS key, props AS payload, epoch_us(ts) // 1000 AS timestamp_ms,
  row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS o, 77 + strlen(cast(user_id AS VARCHAR)) + strlen(props) AS frame_bytes FROM events)"""


def conversation_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as one topic: a batch per conversation."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = c.select(
        F.lit("conversations").alias("topic"), "conv_id", "turn", "role", F.col("conv_id").cast("string").alias("key"), F.col("text").alias("payload"),
        F.col("conv_id").alias("timestamp_ms"),
    )
    rows = log.assign_offsets(rows, ["conv_id", "turn"], F.floor(F.col("conv_id") / 1000))
    base = rows.groupBy("conv_id").agg(F.min("offset").alias("batch_base"))
    return rows.join(base, "conv_id")


CONVERSATION_LOG = """C AS (SELECT *, min(o) OVER (PARTITION BY conv_id) AS batch_base FROM (
  SELECT 'conversations' AS topic, conv_id, turn, role, text AS payload, row_number() OVER (ORDER BY conv_id, turn) - 1 AS o FROM conversations))"""


def acks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Acknowledgements of five consumers: the next offset, and for every third event a stale or negative one."""
    rows = event_log(spark, sf_dir)
    ack = F.when(F.col("event_id") % 3 == 0, F.greatest(F.lit(-1), F.col("offset") - 5)).otherwise(F.col("offset") + 1)
    return rows.select(F.concat(F.lit("c"), (F.col("user_id") % 5).cast("string")).alias("consumer"), "topic", "event_id", "offset", ack.alias("ack"))


ACKS = """A AS (SELECT 'c' || (user_id % 5) AS consumer, topic, event_id, o, CASE WHEN event_id % 3 = 0 THEN greatest(-1, o - 5) ELSE o + 1 END AS ack FROM L)"""
