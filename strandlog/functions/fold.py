"""Folds that reset: delivery chunks, segments and sparse index entries.

Where a chunk begins depends on where the one before it ended, which no window states. A group is cut into blocks of
offsets. Each block is folded from every record that a chunk could begin at, in parallel: later beginnings never end
earlier, and soon meet, so a block comes down to a few rows that say which beginnings lead to which last chunk. One pass over those rows
along a group says where each block's first chunk begins, and then all blocks are numbered in parallel. Chunks
of more records than a block has don't meet within it; such blocks come down to a row a record.

States that begin anew with each segment need no such thing: segments are dealt to tasks one by one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Offsets in a block of the fold into runs.
RUN_BLOCK = 1 << 20


class Cut:
    """Greedy runs: a run ends before a record that would exceed max_bytes or limit; its first record always fits."""

    def __init__(self, max_bytes: int, limit: int = 0, used: int = 0, count: int = 0, base: int | None = None, number: int = 0):
        self.max_bytes, self.limit = max_bytes, limit
        self.used, self.count, self.base, self.number = used, count, base, number

    def take(self, offset: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and first offset of each record's run."""
        n = len(size)
        sums = np.concatenate(([0], np.cumsum(size)))
        number, base = np.empty(n, np.int64), np.empty(n, np.int64)
        i = 0
        while i < n:
            j = n if self.max_bytes <= 0 else int(np.searchsorted(sums, sums[i] + self.max_bytes - self.used, "right")) - 1
            if self.limit > 0:
                j = min(j, i + self.limit - self.count)
            if self.count and j <= i:
                self.used, self.count, self.base, self.number = 0, 0, None, self.number + 1
                continue
            j = max(j, i + 1)
            if self.base is None:
                self.base = int(offset[i])
            number[i:j], base[i:j] = self.number, self.base
            self.used += int(sums[j] - sums[i])
            self.count += j - i
            i = j
        return number, base


def fold(df: DataFrame, group: str, start: Callable[[], object], step: Callable, schema: str, within: tuple[str, ...] = ()) -> DataFrame:
    """Apply step(state, batch of one group in offset order) along each group; start() makes a group's state.

    A state that begins anew with each value of the columns within lets those be dealt to tasks one by one.
    """
    ordered = df.repartition(group, *within).sortWithinPartitions(group, *within, "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            names = batch.column(group).to_pylist()
            at = 0
            while at < len(names):
                to = at + 1
                while to < len(names) and names[to] == names[at]:
                    to += 1
                if state is None or names[at] != now:
                    now, state = names[at], start()
                yield step(state, batch.slice(at, to - at))
                at = to

    return ordered.mapInArrow(run, schema)


def _by_block(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[pa.RecordBatch]:
    """Whole groups of rows with equal keys, from batches in which those stand together."""
    now, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        names = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True)) if batch.num_rows else []
        at = 0
        while at < len(names):
            to = at + 1
            while to < len(names) and names[to] == names[at]:
                to += 1
            if held and names[at] != now:
                yield _joined(held)
                held = []
            now = names[at]
            held.append(batch.slice(at, to - at))
            at = to
    if held:
        yield _joined(held)


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def exits(before: np.ndarray, size: np.ndarray, max_bytes: int, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each record of a block, if a run begins there: the record that the block's last run begins at, and the runs after the first."""
    n = len(size)
    at = np.arange(n)
    following = np.full(n, n)
    if max_bytes > 0:
        following = np.searchsorted(before + size, before + max_bytes, "right")
    if limit > 0:
        following = np.minimum(following, at + limit)
    following = np.maximum(following, at + 1)
    jump, hops = np.where(following < n, following, at), (following < n).astype(np.int64)
    while True:
        further = jump[jump]
        if (further == jump).all():
            return jump, hops
        hops = hops + hops[jump]
        jump = further


def runs(df: DataFrame, size: str, max_bytes: int, limit: int = 0, group: str = "topic") -> DataFrame:
    """group, offset, run (number from 0) and run_base of every record."""
    rows = df.select(df[group].cast("string").alias("_g"), F.col("offset").cast("long").alias("offset"), df[size].cast("long").alias("_s"))
    rows = rows.withColumn("_b", F.floor(F.col("offset") / RUN_BLOCK).cast("long"))
    before = W.partitionBy("_g").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    sums = rows.groupBy("_g", "_b").agg(F.sum("_s").alias("_t"), F.count("*").alias("_n"))
    sums = sums.select("_g", "_b", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_t0"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"))
    laid = rows.repartition("_g", "_b").sortWithinPartitions("_g", "_b", "offset")

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each block, beginnings that lead to one last run as a row: the greatest of them, that run's beginning and the runs until it."""
        for part in _by_block(batches, "_g", "_b"):
            s, offset = part.column("_s").to_numpy(), part.column("offset").to_numpy()
            b = np.cumsum(s) - s
            last, hops = exits(b, s, max_bytes, limit)
            ends = np.flatnonzero(np.append((last[1:] != last[:-1]) | (hops[1:] != hops[:-1]), True))
            to = last[ends]
            columns = [part.column(c).take(pa.array(ends)) for c in ("_g", "_b")] + [pa.array(x) for x in ((b + s)[ends], ends, b[to], to, offset[to], hops[ends])]
            yield pa.RecordBatch.from_arrays(columns, names=["_g", "_b", "_end", "_place", "_start", "_first", "_base", "_hops"])

    def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The run that is open where each block begins: its number and base, and its bytes and records before the block."""
        now, state = None, None
        for part in _by_block(batches, "_g", "_b"):
            g, b, t0, n0 = (part.column(c)[0].as_py() for c in ("_g", "_b", "_t0", "_n0"))
            end, place, start, first, base, hops = (part.column(c).to_numpy() for c in ("_end", "_place", "_start", "_first", "_base", "_hops"))
            if g != now:
                now, state = g, None
            yield pa.RecordBatch.from_arrays(
                [pa.array([x], t) for x, t in zip((g, b, *((state[2], state[3], t0 - state[0], n0 - state[1]) if state else (0, None, 0, 0))), (pa.string(), *[pa.int64()] * 5), strict=True)],
                names=["_g", "_b", "_run", "_open", "_used", "_count"],
            )
            at = 0
            if state:
                at = len(end) if max_bytes <= 0 else int(np.searchsorted(end, state[0] + max_bytes - t0, "right"))
                if limit > 0:
                    at = min(at, int(np.searchsorted(place, state[1] + limit - n0, "left")))
            if at < len(end):
                state = (t0 + int(start[at]), n0 + int(first[at]), (state[2] + 1 if state else 0) + int(hops[at]), int(base[at]))

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _by_block(batches, "_g", "_b"):
            run, base, used, count = (part.column(c)[0].as_py() for c in ("_run", "_open", "_used", "_count"))
            number, bases = Cut(max_bytes, limit, used, count, base, run).take(part.column("offset").to_numpy(), part.column("_s").to_numpy())
            yield pa.RecordBatch.from_arrays([part.column("_g"), part.column("offset"), pa.array(number), pa.array(bases)], names=[group, "offset", "run", "run_base"])

    found = laid.mapInArrow(summed, "_g string, _b long, _end long, _place long, _start long, _first long, _base long, _hops long")
    found = found.join(sums, ["_g", "_b"]).repartition("_g").sortWithinPartitions("_g", "_b", "_place")
    opened = found.mapInArrow(chained, "_g string, _b long, _run long, _open long, _used long, _count long")
    filled = laid.join(opened, ["_g", "_b"]).sortWithinPartitions("_g", "_b", "offset")
    return filled.mapInArrow(numbered, f"{group} string, offset long, run long, run_base long")


class Marks:
    """An entry for the first record of a segment and for each that starts interval bytes or more after the last entry."""

    def __init__(self, interval: int):
        self.interval, self.segment, self.due = interval, None, 0

    def take(self, segment: np.ndarray, position: np.ndarray) -> np.ndarray:
        out = np.zeros(len(position), bool)
        i, n = 0, len(position)
        while i < n:
            if segment[i] != self.segment:
                self.segment, self.due = segment[i], 0
            to = i + int(np.searchsorted(segment[i:], segment[i], "right"))
            while i < to:
                i += int(np.searchsorted(position[i:to], self.due, "left"))
                if i < to:
                    out[i] = True
                    self.due = int(position[i]) + self.interval
        return out


def marks(df: DataFrame, interval: int, group: str = "topic") -> DataFrame:
    """group, offset, segment_base, position and entry (whether the sparse index has the record)."""

    def step(state: Marks, part: pa.RecordBatch) -> pa.RecordBatch:
        entry = state.take(part.column("segment_base").to_numpy(), part.column("position").to_numpy())
        names = [group, "offset", "segment_base", "position"]
        return pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(entry)], names=[*names, "entry"])

    return fold(df.select(group, "offset", "segment_base", "position"), group, lambda: Marks(interval), step, f"{group} string, offset long, segment_base long, position long, entry boolean", ("segment_base",))
