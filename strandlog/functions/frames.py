"""Metadata headers, frame sizes, names and event ids as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandlog import model as M

# Fixed sizes of the frame format, in bytes.
BATCH_HEADER = 52
RECORD_FIXED = 25
HEADER_FIXED = 8

CROCKFORD = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"
_TEXT_FIELDS = ("event_id", "content_type", "correlation_id", "trace_id")


def system_headers(fields: dict[str, Column]) -> Column:
    """A map of reserved headers for the fields that aren't at their default."""
    entries = []
    for name in M.SYSTEM_FIELDS:
        if name in fields:
            value = fields[name]
            there = (value != "") if name in _TEXT_FIELDS else (value != 0)
            entries.append(F.when(there, F.struct(F.lit(M.SYSTEM_PREFIX + name).alias("key"), value.cast("string").alias("value"))))
    return F.map_from_entries(F.filter(F.array(*entries), lambda x: x.isNotNull()))


def user_headers(headers: Column) -> Column:
    return F.map_filter(headers, lambda k, v: ~k.startswith(M.SYSTEM_PREFIX))


def field_of(headers: Column, name: str) -> Column:
    """A metadata field back from the reserved headers; its default if absent."""
    value = F.try_element_at(headers, F.lit(M.SYSTEM_PREFIX + name))
    if name in _TEXT_FIELDS:
        return F.coalesce(value, F.lit(""))
    return F.coalesce(value.try_cast("long" if name == "ttl_ms" else "int"), F.lit(0))


def _headers_bytes(headers: Column) -> Column:
    sizes = F.transform(F.map_entries(headers), lambda e: HEADER_FIXED + F.octet_length(e["key"]) + F.octet_length(e["value"]))
    return F.aggregate(sizes, F.lit(0), lambda a, x: a + x).cast("long")


def record_bytes(key: Column, payload: Column, headers: Column, fields: dict[str, Column]) -> Column:
    """Bytes of a record inside a frame, reserved headers included."""
    return (F.lit(RECORD_FIXED) + F.octet_length(key) + F.octet_length(payload)).cast("long") + _headers_bytes(headers) + _headers_bytes(system_headers(fields))


def prefix_end(prefix: Column) -> Column:
    """The least byte string greater than all that begin with prefix (binary); null if there is none."""
    kept = F.regexp_replace(F.hex(prefix), "(FF)+$", "")
    last = F.conv(F.substring(kept, -2, 2), 16, 10).cast("int") + 1
    return F.when(kept != "", F.unhex(F.concat(F.substring(kept, F.lit(1), F.length(kept) - 2), F.lpad(F.hex(last), 2, "0"))))


def with_prefix(key: Column, prefix: Column) -> Column:
    """Whether a binary key begins with prefix, as a range of keys, which a sorted table's statistics can answer."""
    return (key >= prefix) & (prefix_end(prefix).isNull() | (key < prefix_end(prefix)))


def segment_name(base: Column) -> Column:
    return F.lpad(base.cast("string"), 20, "0")


def segment_base(name: Column) -> Column:
    """The base offset in a segment's name, or null if it isn't one."""
    return F.when(name.rlike("^[0-9]{20}$"), name.try_cast("long"))


def ulid(timestamp_ms: Column, seed: Column) -> Column:
    """An event id of 26 characters: 48 bits of time, and 80 bits from md5 of the seed, so that reruns give the same."""
    digest = F.md5(seed.cast("string"))
    bits = lambda at: F.conv(F.substring(digest, at, 10), 16, 10).cast("long")
    letters = lambda value, n: F.transform(
        F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.substring(F.lit(CROCKFORD), (F.call_function("shiftright", value, (F.lit(n - 1) - i) * 5).bitwiseAND(F.lit(31)) + 1).cast("int"), F.lit(1))
    )
    return F.concat(F.array_join(letters(timestamp_ms, 10), ""), F.array_join(letters(bits(1), 8), ""), F.array_join(letters(bits(11), 8), ""))


def ulid_ok(text: Column) -> Column:
    return F.upper(text).rlike("^[0-7][0-9A-HJKMNP-TV-Z]{25}$")


def state_name(state: Column) -> Column:
    return F.coalesce(F.get(F.array(*map(F.lit, M.STATES)), state), F.lit("unknown"))
