"""Reading and rewriting a log held as a DataFrame (one row per record, dense offsets per topic)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from strandlog.functions import fold, scan


def assign_offsets(messages: DataFrame, order: Sequence[Column | str], block: Column, topic: str = "topic", next_offset: Column | None = None) -> DataFrame:
    """messages with dense offsets per topic in arrival order, from next_offset (0 for a new topic)."""
    out = scan.positions(messages, [topic], block, order, "offset")
    return out if next_offset is None else out.withColumn("offset", F.col("offset") + next_offset)


def ends(log: DataFrame, topic: str = "topic") -> DataFrame:
    """First offset, next offset and number of records of each topic."""
    return log.groupBy(topic).agg(F.min("offset").alias("log_start"), (F.max("offset") + 1).alias("leo"), F.count("*").alias("n_records"))


def read(log: DataFrame, start: int | Column = 0) -> DataFrame:
    """Records from an offset on. The comparison reaches the scan."""
    return log.filter(F.col("offset") >= start)


def read_bounded(log: DataFrame, start: int = 0, limit: int = 0, max_bytes: int = 0, topic: str = "topic") -> DataFrame:
    """Of each topic, records from start: the first `limit` there are, and none beyond max_bytes of payload but the first.

    Bounds of 0 or less don't hold. Offsets may have holes. Counts and bytes of blocks, partial aggregates, say which blocks a topic's
    answer can lie in; only those are shuffled.
    """
    rows = read(log, start)
    if limit <= 0 and max_bytes <= 0:
        return rows
    size = F.octet_length("payload").cast("long")
    rows = rows.withColumn("_block", scan.offset_block())
    sums = rows.groupBy(topic, "_block").agg(F.count("*").alias("_n"), F.sum(size).alias("_size"))
    before = W.partitionBy(topic).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(topic, "_block", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in ("_n", "_size")))
    if limit > 0:
        sums = sums.filter(F.col("_n") < limit)
    if max_bytes > 0:
        sums = sums.filter((F.col("_size") <= max_bytes) | (F.col("_n") == 0))
    within = W.partitionBy(topic, "_block").orderBy("offset").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.join(sums, [topic, "_block"])
    rows = rows.withColumns({"_n": F.col("_n") + F.count("*").over(within), "_size": F.col("_size") + F.sum(size).over(within)})
    if limit > 0:
        rows = rows.filter(F.col("_n") <= limit)
    if max_bytes > 0:
        rows = rows.filter((F.col("_size") <= max_bytes) | (F.col("_n") == 1))
    return rows.drop("_block", "_n", "_size")


def chunks(log: DataFrame, limit: int, max_bytes: int, topic: str = "topic") -> DataFrame:
    """topic, offset and the number of the delivery chunk that each record goes out in."""
    sized = log.select(topic, "offset", F.octet_length("payload").cast("long").alias("_bytes"))
    return fold.runs(sized, "_bytes", max_bytes, limit, topic).select(topic, "offset", F.col("run").alias("chunk"))


def truncate(log: DataFrame, to: int | Column) -> DataFrame:
    """Drop the batches that begin at `to` or later; a batch that holds `to` stays whole."""
    if isinstance(to, int) and to < 0:
        raise ValueError("negative offset")
    return log.filter(F.col("batch_base") < to)


def compact(log: DataFrame, active_base: Column | None = None, topic: str = "topic", tombstones_before: int | None = None) -> DataFrame:
    """The last record of each key, and all records without a key; offsets stay. Records from active_base on all stay.

    A last record without a payload (null) says that its key is deleted; those with a timestamp before tombstones_before go, too.
    The last offset of a key is a partial aggregate, so a hot key sends one row per task.
    """
    keyed = F.col("key") != ""
    last = log.filter(keyed).groupBy(topic, "key").agg(F.max("offset").alias("_last"))
    kept = log.join(last, [topic, "key"], "left")
    stays = ~keyed | (F.col("offset") == F.col("_last"))
    if tombstones_before is not None:
        stays = stays & ~(keyed & F.col("payload").isNull() & (F.col("timestamp_ms") < tombstones_before))
    if active_base is not None:
        stays = stays | (F.col("offset") >= active_base)
    return kept.filter(stays).drop("_last")


def gaps(log: DataFrame, topic: str = "topic") -> DataFrame:
    """Per topic: records, offsets that don't follow their predecessor, and records missing between first and last."""
    block = scan.offset_block()
    rows = log.select(topic, "offset").withColumn("_block", block)
    inner = F.lag("offset").over(W.partitionBy(topic, "_block").orderBy("offset"))
    edges = rows.groupBy(topic, "_block").agg(F.max("offset").alias("_max"))
    edges = edges.select(topic, "_block", F.lag("_max").over(W.partitionBy(topic).orderBy("_block")).alias("_edge"))
    before = rows.withColumn("_inner", inner).join(edges, [topic, "_block"]).withColumn("_before", F.coalesce("_inner", "_edge"))
    n = F.count("*")
    return before.groupBy(topic).agg(
        n.alias("n_records"),
        F.sum(F.when(F.col("_before").isNotNull() & (F.col("offset") != F.col("_before") + 1), 1).otherwise(0)).cast("long").alias("n_gaps"),
        (F.max("offset") - F.min("offset") + 1 - n).alias("n_lost"),
    )
