"""Running values over a long group without putting the group into one task.

A window over a whole topic would meet in one task. Here the order is cut into blocks
(a column that never decreases in the order); a window runs within each block, and a second one
over one row per block supplies what came before it. Both sides are hash-partitioned by group
and block, so a topic with a third of all rows spreads over as many tasks as it has blocks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Offsets in a block.
BLOCK = 1 << 16


def offset_block(offset: str = "offset") -> Column:
    return F.shiftright(F.col(offset), 16)


def running(df: DataFrame, group: Sequence[str], block: Column, order: Sequence[Column | str], value: Column, how: str, out: str) -> DataFrame:
    """df with out: the sum or max of value over the group's rows up to and with each row."""
    rows = df.withColumns({"_block": block, "_value": value})
    keys = [*group, "_block"]
    total = {"sum": F.sum, "max": F.max}[how]
    local = total("_value").over(W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    before = total("_total").over(W.partitionBy(*group).orderBy("_block").rowsBetween(W.unboundedPreceding, -1))
    blocks = rows.groupBy(*keys).agg(total("_value").alias("_total")).select(*keys, before.alias("_before"))
    joined = rows.withColumn("_local", local).join(blocks, keys)
    if how == "sum":
        both = F.coalesce("_before", F.lit(0)) + F.col("_local")
    else:
        both = F.greatest("_before", "_local")
    return joined.withColumn(out, both).drop("_block", "_value", "_local", "_before")


def positions(df: DataFrame, group: Sequence[str], block: Column, order: Sequence[Column | str], out: str) -> DataFrame:
    """df with out: the row's place in its group, gapless from 0. Nothing in the order may be equal."""
    return running(df, group, block, order, F.lit(1).cast("long"), "sum", out).withColumn(out, F.col(out) - 1)
