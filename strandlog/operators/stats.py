"""Latency and throughput summaries."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlog.functions import scan

QUANTILES = {"p50": 0.5, "p90": 0.9, "p99": 0.99, "p999": 0.999}


def latency(samples: DataFrame, value: str, group: str = "topic", quantiles: Mapping[str, float] = QUANTILES, block: int = 1_000_000) -> DataFrame:
    """count, min, mean (whole-number division), nearest-rank quantiles and max per group.

    The quantile q of n samples is the one at place min(floor(q * n), n - 1) in order, without
    interpolation. Equal samples are counted before the shuffle, and ranks run over blocks of
    values, so no task sorts a group's samples.
    """
    counts = samples.groupBy(group, value).agg(F.count("*").alias("_n"))
    ranked = scan.running(counts, [group], F.floor(F.col(value) / block), [value], F.col("_n"), "sum", "_upto")
    totals = samples.groupBy(group).agg(
        F.count("*").alias("count"), F.min(value).alias("min"), F.expr(f"sum(`{value}`) div count(*)").alias("mean"), F.max(value).alias("max")
    )
    joined = ranked.join(totals.select(group, F.col("count").alias("_total")), group)
    places = {name: F.least(F.floor(F.lit(q) * F.col("_total")), F.col("_total") - 1) for name, q in quantiles.items()}
    found = joined.groupBy(group).agg(*[F.min(F.when(F.col("_upto") > place, F.col(value))).alias(name) for name, place in places.items()])
    return totals.join(found, group)


def throughput(log: DataFrame, topic: str = "topic") -> DataFrame:
    """Records, payload bytes, records and MiB a second between a topic's first and last timestamp."""
    seconds = (F.max("timestamp_ms") - F.min("timestamp_ms")) / 1000
    n, size = F.count("*"), F.sum(F.octet_length("payload"))
    return log.groupBy(topic).agg(
        n.alias("n_records"), size.cast("long").alias("payload_bytes"),
        F.round(n / seconds, 9).alias("records_per_s"), F.round(size / 1048576 / seconds, 12).alias("mib_per_s"),
    )
