"""Logs in native segment files: discovery, scans by offset, recovery and its checkpoint.

A segment is a file named by its first offset (20 digits and `.log`) with frames end to end. Files are found and
read through Spark's readers, one row a file, so a task holds a segment at a time; segments that end before a read's start
aren't opened, and frames before it are passed over by their headers.

Recovery checks every frame: the last segment may end in what a crash left, which is cut; damage in a
sealed one is fatal. A checkpoint of 40 bytes says how long the log was when it was written. If it describes the files, only
what the last segment gained since is checked, and sealed segments only by their first frame; else it is discarded.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from strandlog.errors import Corrupt, InvalidArgument
from strandlog.sources import codec
from strandlog.sources.table_log import listed
from strandlog.workspace import file_system

# Fixed values of the checkpoint's format: magic and version, 2 unused bytes, checksum of the rest; four numbers, big-endian.
CHECKPOINT = struct.Struct(">BBHIqqqq")
CHECKPOINT_MAGIC, CHECKPOINT_VERSION = 0x53, 1
SUFFIX = ".log"


@dataclass(frozen=True)
class SegmentFile:
    path: str
    base: int


def discover(spark: SparkSession, folder: str) -> list[SegmentFile]:
    """Segment files by first offset; other files don't count, but a segment's name that isn't an offset is damage."""
    found = []
    for name, _ in listed(spark, folder):
        if name.endswith(SUFFIX):
            stem = name.removesuffix(SUFFIX)
            if len(stem) != 20 or not (stem.isascii() and stem.isdigit()):
                raise Corrupt(f"{name} isn't a segment's name")
            found.append(SegmentFile(f"{folder}/{name}", int(stem)))
    return sorted(found, key=lambda f: f.base)


def _contents(spark: SparkSession, files: list[SegmentFile]) -> DataFrame:
    """(base, last, content) of every file; the reader has no row for an empty one."""
    if not files:
        return spark.createDataFrame([], "base long, last boolean, content binary")
    base = F.regexp_extract("path", rf"(\d{{20}})\{SUFFIX}$", 1).cast("long")
    rows = spark.read.format("binaryFile").load([f.path for f in files]).select(base.alias("base"), "content")
    every = spark.createDataFrame([(f.base, f is files[-1]) for f in files], "base long, last boolean")  # a row a segment
    return every.join(rows, "base", "left").select("base", "last", F.coalesce("content", F.lit(b"")).alias("content"))


def read(spark: SparkSession, folder: str, start: int = 0, end: int | None = None) -> DataFrame:
    """Records of a folder's segments from start on and before end, as codec.decode gives them, without topic and code.

    Frames that hold none of them aren't decoded. An incomplete frame at the end of the last segment isn't read; any other damage fails the job.
    """
    files = discover(spark, folder)
    ends = [*(f.base for f in files[1:]), None][: len(files)]
    some = [f for f, e in zip(files, ends, strict=True) if (e is None or e > start) and (end is None or f.base < end)]
    newest = files[-1].base if files else -1

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for base, content in zip(part.column("base").to_pylist(), part.column("content"), strict=True):
                data, rows = memoryview(content.as_buffer()), []
                for at, size in frames(data):
                    if size is None:
                        if base == newest:
                            break
                        raise codec.FrameError("truncated")
                    first, count = codec.frame_range(data[at : at + codec.HEADER.size])
                    if first + count <= start or (end is not None and first >= end):
                        continue
                    own, records = codec.decode_batch(bytes(data[at : at + size]))
                    rows += [(own, o, ms, k, p, list(h.items())) for o, ms, k, p, h in records if o >= start and (end is None or o < end)]
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.map_(pa.string(), pa.string())]
                columns = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
                names = ["batch_base", "offset", "timestamp_ms", "key", "payload", "headers"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    return _contents(spark, some).mapInArrow(run, "batch_base long, offset long, timestamp_ms long, key string, payload binary, headers map<string,string>")


def frames(data: memoryview) -> Iterator[tuple[int, int | None]]:
    """Place and size of every frame by its header; size is None for what doesn't hold a whole frame."""
    at = 0
    while at < len(data):
        size = codec.frame_size(bytes(data[at : at + codec.HEADER.size])) if len(data) - at >= codec.HEADER.size else None
        if size is None or size > len(data) - at:
            yield at, None
            return
        yield at, size
        at += size


def scanned(segments: DataFrame, *more: str, trusted: Column | None = None) -> DataFrame:
    """For rows (base, content) the columns more, base, bytes, valid_bytes, next_offset and code of what ends the valid part (null: nothing).

    trusted: a struct (bytes, next) of a prefix that needs no check.
    """
    known = F.lit(None).cast("struct<bytes:long,next:long>") if trusted is None else trusted

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            out = []
            for base, content, sure in zip(part.column("base").to_pylist(), part.column("content"), part.column("_sure").to_pylist(), strict=True):
                data = content.as_py() or b""
                skip, expected = (sure["bytes"], sure["next"]) if sure else (0, base)
                valid, following, code = codec.scan_segment(data[skip:], expected)
                out.append((len(data), skip + valid, following, code))
            columns = list(zip(*out, strict=True)) if out else [()] * 4
            kinds = [pa.int64()] * 3 + [pa.string()]
            arrays = [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in (*more, "base")), *arrays], names=[*more, "base", "bytes", "valid_bytes", "next_offset", "code"])

    kinds = dict(segments.dtypes)
    fields = "".join(f"`{c}` {kinds[c]}, " for c in more)
    return segments.select(*more, "base", "content", known.alias("_sure")).mapInArrow(run, f"{fields}base long, bytes long, valid_bytes long, next_offset long, code string")


def judged(found: DataFrame, *group: str) -> DataFrame:
    """found (see scanned) with last (whether a segment is its group's newest) and fatal: damage, or a gap, in a sealed one."""
    order = W.partitionBy(*group).orderBy("base")
    following = F.lead("base").over(order)
    rows = found.withColumn("_following", following)
    fatal = F.col("_following").isNotNull() & (F.col("code").isNotNull() | (F.col("next_offset") != F.col("_following")))
    return rows.withColumns({"last": F.col("_following").isNull(), "fatal": fatal}).drop("_following")


@dataclass(frozen=True)
class Checkpoint:
    leo: int
    active_base: int
    active_bytes: int

    def sound(self) -> bool:
        return 0 <= self.active_base <= self.leo and self.active_bytes >= 0


def checkpoint_bytes(state: Checkpoint) -> bytes:
    if not state.sound():
        raise InvalidArgument("inconsistent checkpoint")
    body = CHECKPOINT.pack(0, 0, 0, 0, state.leo, state.active_base, state.active_bytes, state.leo)[8:]
    return CHECKPOINT.pack(CHECKPOINT_MAGIC, CHECKPOINT_VERSION, 0, int(codec.crc32c([body])[0]), state.leo, state.active_base, state.active_bytes, state.leo)


def parse_checkpoint(data: bytes) -> Checkpoint:
    """The checkpoint, or Corrupt if it can't be trusted."""
    if len(data) != CHECKPOINT.size:
        raise Corrupt(f"checkpoint of {len(data)} bytes")
    magic, version, _, crc, leo, base, size, following = CHECKPOINT.unpack(data)
    state = Checkpoint(leo, base, size)
    if (magic, version) != (CHECKPOINT_MAGIC, CHECKPOINT_VERSION) or crc != int(codec.crc32c([data[8:]])[0]) or following != leo or not state.sound():
        raise Corrupt("checkpoint can't be trusted")
    return state


def _path(folder: str) -> str:
    return f"{folder}/snapshot"


def load_checkpoint(spark: SparkSession, folder: str) -> Checkpoint | None:
    fs, where = file_system(spark, _path(folder))
    if not fs.exists(where):
        return None
    stream = fs.open(where)
    try:
        return parse_checkpoint(bytes(stream.readAllBytes()))
    finally:
        stream.close()


def replace_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """Write a file so that readers see the old content or the new one, whole."""
    fs, where = file_system(spark, path)
    _, draft = file_system(spark, f"{path}.draft")
    stream = fs.create(draft, True)
    stream.write(bytearray(data))
    stream.close()
    rename = spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    context = spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(fs.makeQualified(draft), fs.makeQualified(where), options)


def save_checkpoint(spark: SparkSession, folder: str, state: Checkpoint) -> None:
    replace_bytes(spark, _path(folder), checkpoint_bytes(state))


@dataclass(frozen=True)
class Recovered:
    next_offset: int
    segments: list[tuple[int, int, int]]  # base, valid bytes, next offset
    cut_bytes: int
    trusted: bool  # whether a checkpoint spared a full check


def recover(spark: SparkSession, folder: str, cut: bool = True) -> Recovered:
    """Check a folder's segments, cut what follows the valid part of the last one, and say where the log ends.

    Corrupt if a sealed segment is damaged or doesn't lead to the next one.
    """
    files = discover(spark, folder)
    if not files:
        return Recovered(0, [], 0, False)
    try:
        state = load_checkpoint(spark, folder)
    except Corrupt:
        state = None
    rows = _contents(spark, files)
    found, trusted = None, False
    if state is not None and state.active_base == files[-1].base:
        found = _by_checkpoint(rows, files, state)
        trusted = found is not None
    if not trusted:
        fs, where = file_system(spark, _path(folder))
        fs.delete(where, False)
        found = judged(scanned(rows)).orderBy("base").collect()  # a row a segment
    if bad := [r for r in found if r["fatal"]]:
        raise Corrupt(f"sealed segment {bad[0]['base']}: {bad[0]['code'] or 'gap'}")
    last = found[-1]
    if cut and last["valid_bytes"] < last["bytes"]:
        _cut(spark, files[-1].path, last["valid_bytes"])
    return Recovered(last["next_offset"], [(r["base"], r["valid_bytes"], r["next_offset"]) for r in found], last["bytes"] - last["valid_bytes"], trusted)


def _by_checkpoint(rows: DataFrame, files: list[SegmentFile], state: Checkpoint) -> list | None:
    """Rows as judged() gives them, or None if the checkpoint doesn't describe the files."""
    spark = rows.sparkSession
    ends = spark.createDataFrame([(f.base, g.base) for f, g in zip(files, files[1:], strict=False)] + [(files[-1].base, state.leo)], "base long, _end long")  # a row a segment
    size = F.octet_length("content").cast("long")
    sealed = rows.join(ends, "base").filter("not last")
    first = F.conv(F.hex(F.substring("content", 9, 8)), 16, 10).cast("long")
    sealed = sealed.select("base", size.alias("bytes"), size.alias("valid_bytes"), F.col("_end").alias("next_offset"), F.when(first != F.col("base"), "discontinuity").alias("code"))
    sure = F.struct(F.lit(state.active_bytes).cast("long").alias("bytes"), F.lit(state.leo).cast("long").alias("next"))
    active = scanned(rows.filter("last"), trusted=sure).collect()[0]
    if active["bytes"] < state.active_bytes:
        return None
    done = sealed.withColumns({"last": F.lit(False), "fatal": F.col("code").isNotNull()}).orderBy("base").collect()
    return [r.asDict() for r in done] + [active.asDict() | {"last": True, "fatal": False}]


def _cut(spark: SparkSession, path: str, size: int) -> None:
    """Keep the first size bytes of a file."""
    fs, where = file_system(spark, path)
    stream = fs.open(where)
    try:
        kept = bytes(stream.readNBytes(size))
    finally:
        stream.close()
    replace_bytes(spark, path, kept)

