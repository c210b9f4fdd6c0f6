"""The binary frame of a batch: encoding, decoding, checksums, and recovery of what is valid.

A frame is a big-endian header of 52 bytes and records. Header: magic, version (1 byte each),
flags (2), CRC-32C of everything after it (4), base offset (8), bytes of records (4), first and
last timestamp in ms (8 each), number of records (4), and three reserved numbers (4 each). Record:
its length (4), attributes (1), timestamp and offset less those of the batch (4 each), key, payload,
number of headers (4), and headers, each part with its length (4). Headers are sorted by
key. Metadata other than key and payload travels in reserved headers.

Frames of a DataFrame are encoded and decoded batch by batch in parallel; one frame is bounded by its
batch.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from strandlog import model as M
from strandlog.functions.frames import system_headers

# Fixed values of the format.
MAGIC, VERSION = 1, 1
HEADER = struct.Struct(">BBHIQIQQIIII")
RECORD = struct.Struct(">IBiI")
NULL = 0xFFFFFFFF
COMPRESSION_BITS = 0x7
POLYNOMIAL = 0x82F63B78


#: Metadata fields by their reserved headers.
RESERVED = {M.SYSTEM_PREFIX + name: name for name in M.SYSTEM_FIELDS}


class FrameError(ValueError):
    """A frame that can't be read; args[0] is the code."""


def _crc_table() -> np.ndarray:
    value = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        value = np.where(value & 1, (value >> 1) ^ np.uint32(POLYNOMIAL), value >> 1)
    return value


_CRC = _crc_table()


#: Rows below which stepping through all rows at once costs more than one row after the other; bytes of the parts that longer rows are cut into.
_FEW, _PART = 16, 1024


def _registers(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The registers after the bytes of each part, from value: all parts one byte further at a time, the few longest then each for itself."""
    order = np.argsort(-sizes, kind="stable")
    starts, left, value = starts[order], sizes[order], value[order]
    together = int(left[_FEW - 1]) if len(left) >= _FEW else 0
    active = np.searchsorted(-left, -np.arange(1, together + 1), "right")
    for i, n in enumerate(active):
        part = value[:n]
        value[:n] = (part >> np.uint32(8)) ^ _CRC[(part ^ data[starts[:n] + i]) & 0xFF]
    table = _CRC.tolist()
    for k in range(min(_FEW, len(left))):
        crc = int(value[k])
        for byte in data[starts[k] + together : starts[k] + left[k]].tolist():
            crc = (crc >> 8) ^ table[(crc ^ byte) & 0xFF]
        value[k] = crc
    out = np.empty(len(left), np.uint32)
    out[order] = value
    return out


@lru_cache(maxsize=1)
def _passed() -> list[list[int]]:
    """What _PART zero bytes make of a register, by its four bytes: the register is linear in them."""
    bits = np.uint32(1) << np.arange(32, dtype=np.uint32)
    after = _registers(np.zeros(_PART, np.uint8), np.zeros(32, np.int64), np.full(32, _PART), bits)
    ones = (np.arange(256)[:, None] >> np.arange(8)[None, :] & 1).astype(bool)
    return [np.bitwise_xor.reduce(np.where(ones, after[8 * k : 8 * k + 8][None, :], np.uint32(0)), axis=1).tolist() for k in range(4)]


def crc32c(rows: list[bytes]) -> np.ndarray:
    """CRC-32C of each byte string. Long ones are cut into parts of _PART bytes, the first one shorter, which run beside each other."""
    sizes = np.fromiter(map(len, rows), np.int64, len(rows))
    starts, data = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(rows), np.uint8)
    parts = np.maximum(1, -(-sizes // _PART))
    of = np.repeat(np.arange(len(rows)), parts)
    place = np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)
    head = sizes - (parts - 1) * _PART
    at = starts[of] + np.where(place > 0, head[of] + (place - 1) * _PART, 0)
    value = _registers(data, at, np.where(place > 0, _PART, head[of]), np.where(place > 0, 0, 0xFFFFFFFF).astype(np.uint32))
    out = value[place == 0]
    if (long := np.flatnonzero(parts > 1)).size:
        a, b, c, d = _passed()
        first = np.cumsum(parts) - parts
        for i in long.tolist():
            crc = int(out[i])
            for more in value[first[i] + 1 : first[i] + parts[i]].tolist():
                crc = a[crc & 0xFF] ^ b[crc >> 8 & 0xFF] ^ c[crc >> 16 & 0xFF] ^ d[crc >> 24] ^ more
            out[i] = crc
    return ~out


def crc32c_column(data: Column) -> Column:
    @F.arrow_udf(T.LongType())
    def checksum(values: pa.Array) -> pa.Array:
        return pa.array(crc32c([v or b"" for v in values.to_pylist()]).astype(np.int64), mask=np.asarray(values.is_null()))

    return checksum(data)


def _text(part: bytes) -> bytes:
    return struct.pack(">I", len(part)) + part


def _unsealed(base: int, records: list[tuple[int, int, str, bytes, dict[str, str]]]) -> bytes:
    """A frame whose checksum isn't set yet."""
    if not records:
        raise FrameError("empty_batch")
    if base < 0:
        raise FrameError("invalid_offset")
    first = records[0][1]
    body = bytearray()
    for offset, ms, key, payload, headers in records:
        if offset < base:
            raise FrameError("invalid_offset")
        named = b"".join(_text(k.encode()) + _text(headers[k].encode()) for k in sorted(headers, key=str.encode))
        rest = _text(key.encode()) + _text(payload) + struct.pack(">I", len(headers)) + named
        body += RECORD.pack(len(rest) + RECORD.size - 4, 0, ms - first, offset - base) + rest
    return HEADER.pack(MAGIC, VERSION, 0, 0, base, len(body), first, records[-1][1], len(records), 0, 0, 0) + body


def _sealed(frames: list[bytes]) -> list[bytes]:
    """Frames with their checksums."""
    sums = crc32c([f[8:] for f in frames])
    return [f[:4] + struct.pack(">I", int(s)) + f[8:] for f, s in zip(frames, sums, strict=True)]


def encode_batch(base: int, records: list[tuple[int, int, str, bytes, dict[str, str]]]) -> bytes:
    """A frame for records (offset, timestamp_ms, key, payload, headers with the reserved ones)."""
    return _sealed([_unsealed(base, records)])[0]


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if n > len(self.data) - self.at:
            raise FrameError("invalid_record_length")
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self) -> int:
        return int.from_bytes(self.take(4), "big")

    def text(self) -> bytes | None:
        n = self.number()
        return None if n == NULL else self.take(n)


def _decoded(part: bytes | None) -> str:
    try:
        return (part or b"").decode()
    except UnicodeDecodeError:
        raise FrameError("invalid_text") from None


def _check_reserved(name: str, value: str) -> None:
    """A reserved header is one of the metadata fields, and numbers and ids among them can be read."""
    field = RESERVED.get(name)
    if field is None:
        raise FrameError("invalid_system_header")
    bits = {"retry_count": 32, "priority": 32, "schema_version": 32, "ttl_ms": 64}.get(field)
    if bits and not (re.fullmatch(r"[+-]?[0-9]+", value) and -(1 << bits - 1) <= int(value) < 1 << bits - 1):
        raise FrameError("invalid_system_header")
    if field == "event_id" and not re.fullmatch(r"[0-7][0-9A-HJKMNP-TV-Za-hjkmnp-tv-z]{25}", value):
        raise FrameError("invalid_system_header")


def frame_range(header: bytes) -> tuple[int, int]:
    """First offset and number of records of the frame that begins with header."""
    return int.from_bytes(header[8:16], "big"), int.from_bytes(header[36:40], "big")


def frame_size(header: bytes) -> int:
    """Bytes of the frame that begins with header."""
    return HEADER.size + int.from_bytes(header[16:20], "big")


def decode_batch(frame: bytes, checksum: int | None = None) -> tuple[int, list[tuple[int, int, str, bytes, dict[str, str]]]]:
    """Base offset and records of a frame, or FrameError with the first of the checks that fails."""
    if len(frame) < HEADER.size:
        raise FrameError("truncated")
    magic, version, flags, crc, base, size, first, _, count, _, _, _ = HEADER.unpack_from(frame)
    if magic != MAGIC:
        raise FrameError("bad_magic")
    if version != VERSION:
        raise FrameError("unsupported_version")
    if flags & COMPRESSION_BITS:
        raise FrameError("unsupported_compression")
    if HEADER.size + size != len(frame):
        raise FrameError("truncated")
    if crc != (int(crc32c([frame[8:]])[0]) if checksum is None else checksum):
        raise FrameError("crc_mismatch")
    if not count:
        raise FrameError("empty_batch")
    reader, records = _Reader(frame[HEADER.size :]), []
    for _ in range(count):
        body = _Reader(reader.take(reader.number()))
        body.take(1)
        ms = int.from_bytes(body.take(4), "big", signed=True)
        delta = body.number()
        if delta >= count:
            raise FrameError("offset_delta_out_of_range")
        key, payload = body.text(), body.text()
        headers = {}
        for _ in range(body.number()):
            k, v = _decoded(body.text()), _decoded(body.text())
            if k.startswith(M.SYSTEM_PREFIX):
                _check_reserved(k, v)
            headers[k] = v
        if body.at != len(body.data):
            raise FrameError("invalid_record_length")
        records.append((base + delta, first + ms, _decoded(key), payload or b"", headers))
    if reader.at != len(reader.data):
        raise FrameError("invalid_record_length")
    return base, records


def encode(log: DataFrame) -> DataFrame:
    """(topic, base, n_records, frame) of every batch of log; metadata columns that log has go into reserved headers."""
    fields = {c: F.col(c) for c in M.SYSTEM_FIELDS if c in log.columns}
    headers = F.col("headers") if "headers" in log.columns else F.create_map().cast("map<string,string>")
    if fields:
        headers = F.map_concat(headers, system_headers(fields))
    record = F.struct("offset", "timestamp_ms", F.coalesce("key", F.lit("")).alias("key"), F.coalesce("payload", F.lit(b"")).alias("payload"), F.map_entries(headers).alias("headers"))
    batches = log.groupBy("topic", F.col("batch_base").alias("base")).agg(F.sort_array(F.collect_list(record)).alias("records"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            out = [
                _unsealed(base, [(r["offset"], r["timestamp_ms"], r["key"], r["payload"], {h["key"]: h["value"] for h in r["headers"]}) for r in rows])
                for base, rows in zip(part.column("base").to_pylist(), part.column("records").to_pylist(), strict=True)
            ]
            n = pa.compute.list_value_length(part.column("records")).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("topic"), part.column("base"), n, pa.array(_sealed(out), pa.binary())], names=["topic", "base", "n_records", "frame"])

    return batches.mapInArrow(run, "topic string, base long, n_records long, frame binary")


_RECORDS = "topic string, batch_base long, offset long, timestamp_ms long, key string, payload binary, headers map<string,string>, code string"


def decode(frames: DataFrame, strict: bool = True) -> DataFrame:
    """Records of (topic, frame) rows. A bad frame fails the job, or, unless strict, gives one row with its code."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            data = [f or b"" for f in part.column("frame").to_pylist()]
            sums = crc32c([f[8:] for f in data])
            rows = []
            for topic, frame, crc in zip(part.column("topic").to_pylist(), data, sums, strict=True):
                try:
                    base, records = decode_batch(frame, int(crc))
                    rows += [(topic, base, o, ms, k, p, list(h.items()), None) for o, ms, k, p, h in records]
                except FrameError as e:
                    if strict:
                        raise
                    rows.append((topic, None, None, None, None, None, None, e.args[0]))
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.map_(pa.string(), pa.string()), pa.string()]
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
            names = ["topic", "batch_base", "offset", "timestamp_ms", "key", "payload", "headers", "code"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    return frames.select("topic", "frame").mapInArrow(run, _RECORDS)


def check(frames: DataFrame) -> DataFrame:
    """(topic, base, n_records, code) of every frame; code is null for a valid one."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            data = [f or b"" for f in part.column("frame").to_pylist()]
            sums = crc32c([f[8:] for f in data])
            codes = []
            for frame, crc in zip(data, sums, strict=True):
                try:
                    decode_batch(frame, int(crc))
                    codes.append(None)
                except FrameError as e:
                    codes.append(e.args[0])
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("topic", "base", "n_records")), pa.array(codes, pa.string())], names=["topic", "base", "n_records", "code"])

    return frames.select("topic", "base", "n_records", "frame").mapInArrow(run, "topic string, base long, n_records long, code string")


def recover(frames: DataFrame) -> DataFrame:
    """Per topic: next_offset after the valid prefix (frames that decode and follow on), n_frames, and whether frames were damaged.

    Frames are checked in parallel; continuity looks at narrow rows only.
    """
    checked = check(frames)
    after = F.lag(F.col("base") + F.col("n_records")).over(W.partitionBy("topic").orderBy("base"))
    checked = checked.withColumn("_bad", F.col("code").isNotNull() | (F.col("base") != F.coalesce(after, F.col("base"))))
    found = checked.groupBy("topic").agg(
        F.min(F.when(F.col("_bad"), F.col("base"))).alias("_first_bad"), F.max(F.col("base") + F.col("n_records")).alias("_end"), F.count("*").alias("n_frames")
    )
    return found.select("topic", F.coalesce("_first_bad", "_end").alias("next_offset"), "n_frames", F.col("_first_bad").isNotNull().alias("damaged"))


def scan_segment(data: bytes, base: int) -> tuple[int, int, str | None]:
    """Valid bytes of a segment's content, the next offset after them, and the code of what ends them, if anything does."""
    at, expected = 0, base
    while at < len(data):
        if len(data) - at < HEADER.size:
            return at, expected, "truncated"
        size = frame_size(data[at : at + HEADER.size])
        try:
            found, records = decode_batch(data[at : at + size])
        except FrameError as e:
            return at, expected, e.args[0]
        if found != expected:
            return at, expected, "discontinuity"
        at, expected = at + size, expected + len(records)
    return at, expected, None
