"""Sharding by rendezvous hashing of record keys over weighted shards.

Each shard scores a record by -weight / ln(u), where u in (0, 1) comes from md5 of
key and shard; the record goes to the highest score. So the key, the shards and
their weights decide alone: adding a shard takes records only into it, and a
shard's share of keys is its weight's share. Records of one key stay together.

Places within a shard are gapless from 0. They are counted in parts, by 3 hex digits
of md5 of key and checksum: one window per shard and part, and a running sum over the
4096 parts of a shard, so no task gets a whole shard.

A null key counts as ''. A null text has size 8 and checksum 0. Rows of one key go to one
shard, by checksum there; equal rows take neighbouring places in any order. An empty table
gives no rows. Of texts, however long, only size and checksum are shuffled. Only the named columns are read, so further columns can't clash.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .tables import table

PART_DIGITS = 3


def _digest(text: Column, digits: int) -> Column:
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("long")


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """Shard of each key among len(weights) shards; ties go to the higher shard."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights are positive, one for each shard")
    given = F.array(*[F.lit(float(x)) for x in weights])

    def score(weight: Column, shard: Column) -> Column:
        u = (_digest(F.concat(key, F.lit(":"), shard.cast("string")), 13) + 0.5) / F.lit(2.0**52)
        return F.struct((-weight / F.ln(u)).alias("score"), shard.alias("shard"))

    return F.array_max(F.transform(given, score))["shard"].cast("int")


def assign(
    docs: DataFrame, key: str = "doc_id", text: str = "text", weights: Sequence[float] = (1.0,) * 24, grown: Sequence[float] | None = None
) -> DataFrame:
    """Key, size, text_crc32, shard, slot and, if weights for more shards are given, grown_shard."""
    body = F.coalesce(docs[text], F.lit(""))
    name = F.coalesce(docs[key].cast("string"), F.lit(""))
    rows = docs.select(
        docs[key].alias(key),
        (F.octet_length(body) + 8).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        name.alias("_name"),
    )
    name = F.col("_name")
    rows = rows.select(
        key, "size", "text_crc32",
        shard_of(name, weights).alias("shard"),
        (shard_of(name, grown) if grown else F.lit(None).cast("int")).alias("grown_shard"),
        _digest(F.concat(name, F.lit("/"), F.col("text_crc32").cast("string")), PART_DIGITS).alias("_part"),
    ).repartition("shard", "_part")
    before = W.partitionBy("shard").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    parts = rows.groupBy("shard", "_part").agg(F.count("*").alias("_n"))
    parts = parts.select("shard", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = F.row_number().over(W.partitionBy("shard", "_part").orderBy(key, "text_crc32"))
    placed = rows.withColumn("_within", within).join(parts, ["shard", "_part"])
    return placed.select(key, "size", "text_crc32", "shard", (F.col("_before") + F.col("_within") - 1).alias("slot"), "grown_shard")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return assign(docs, grown=(1.0,) * 25).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )


OP5_SQL = """
WITH crc_table AS (
  SELECT list(list_reduce(range(8), lambda a, i: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, b) ORDER BY b) AS t
  FROM range(256) AS r(b)),
d AS (SELECT doc_id, coalesce(cast(doc_id AS VARCHAR), '') AS k, encode(coalesce(text, '')) AS b FROM documents),
s AS (SELECT doc_id, k, octet_length(b) + 8 AS size, xor(list_reduce(list_transform(regexp_extract_all(hex(b), '..'),
    lambda x: ('0x' || x)::BIGINT), lambda a, x: xor(a >> 8, t[xor(a & 255, x) + 1]), 4294967295::BIGINT), 4294967295) AS text_crc32
  FROM d, crc_table),
h AS (SELECT *, list_transform(range(25), lambda i: ('0x' || substr(md5(k || ':' || i), 1, 13))::BIGINT) AS u,
  ('0x' || substr(md5(k || '/' || text_crc32), 1, 3))::BIGINT AS part FROM s),
g AS (SELECT *, list_position(u[1:24], list_max(u[1:24])) - 1 AS shard, list_position(u, list_max(u)) - 1 AS grown_shard FROM h)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'key' AS law, shard::INTEGER AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY part, doc_id, text_crc32) - 1 AS slot, grown_shard::INTEGER AS grown_shard
FROM g
"""
