"""Cursors: acknowledgements, start positions and lag."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlog.functions import scan


def ack_responses(acks: DataFrame, order: Sequence[Column | str], block: Column) -> DataFrame:
    """acks (consumer, topic, ack) with code and response: a cursor never goes back; a negative ack is an invalid message."""
    valid = F.when(F.col("ack") >= 0, F.col("ack"))
    out = scan.running(acks, ["consumer", "topic"], block, order, valid, "max", "_cursor")
    return out.withColumns({
        "code": F.when(F.col("ack") < 0, "invalid_message").otherwise("ok"),
        "response": F.when(F.col("ack") >= 0, F.col("_cursor")),
    }).drop("_cursor")


def final_cursors(acks: DataFrame, cursors: DataFrame | None = None) -> DataFrame:
    """consumer, topic, cursor after all acks, on top of stored cursors if given."""
    rows = acks.filter("ack >= 0").select("consumer", "topic", F.col("ack").alias("cursor"))
    if cursors is not None:
        rows = rows.unionByName(cursors.select("consumer", "topic", "cursor"))
    return rows.groupBy("consumer", "topic").agg(F.max("cursor").alias("cursor"))


def start_positions(subscriptions: DataFrame, cursors: DataFrame, log_ends: DataFrame) -> DataFrame:
    """subscriptions (consumer, topic, start) with position and code.

    An explicit start wins over a stored cursor, that over 0; without a consumer no cursor
    counts. A negative start is an invalid offset; one beyond the end is out of range.
    """
    stored = cursors.select(F.col("consumer").alias("_c"), F.col("topic").alias("_t"), "cursor")
    ends = log_ends.select(F.col("topic").alias("_topic"), "leo")
    s = subscriptions.join(stored, (F.col("consumer") == F.col("_c")) & (F.col("topic") == F.col("_t")) & (F.col("consumer") != ""), "left")
    s = s.join(ends, F.col("topic") == F.col("_topic"), "left")
    position = F.coalesce("start", "cursor", F.lit(0).cast("long"))
    code = (
        F.when(F.col("leo").isNull(), "topic_not_found")
        .when(F.col("start") < 0, "invalid_offset")
        .when(position > F.col("leo"), "out_of_range")
        .otherwise("ok")
    )
    return s.withColumns({"code": code, "position": F.when(code == "ok", position)}).drop("_c", "_t", "_topic", "cursor", "leo")


def lag(cursors: DataFrame, log_ends: DataFrame) -> DataFrame:
    """consumer, topic, cursor, leo and lag (records not yet consumed; never below 0)."""
    return cursors.join(log_ends.select("topic", "leo"), "topic").select(
        "consumer", "topic", "cursor", "leo", F.greatest(F.lit(0), F.col("leo") - F.col("cursor")).cast("long").alias("lag")
    )
