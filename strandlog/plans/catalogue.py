"""All queries over the log operators, with the SQL that states each result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlog import errors
from strandlog import model as M
from strandlog.config import Config
from strandlog.engine import Engine
from strandlog.functions import checks, frames, scan
from strandlog.operators import cursors, log, retention, segments, stats
from strandlog.plans.logs import ACKS, CONVERSATION_LOG, EVENT_LOG, acks, conversation_log, event_log, event_messages, table
from strandlog.sources import codec, native
from strandlog.streaming import follow
from strandlog.workspace import new_path

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}


def _query(sql: str):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


def _values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def _literals(rows: list[tuple], names: str) -> str:
    def one(x) -> str:
        return "NULL" if x is None else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)

    return f"(VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) AS v({names})"


# Offsets, ends and reads


@_query(f"WITH {EVENT_LOG} SELECT topic, event_id, o AS \"offset\", o AS batch_base, timestamp_ms FROM L")
def publish_offsets(spark, sf_dir):
    return event_log(spark, sf_dir).select("topic", "event_id", "offset", "batch_base", "timestamp_ms")


@_query(f"WITH {EVENT_LOG} SELECT topic, min(o) AS log_start, max(o) + 1 AS leo, count(*) AS n_records FROM L GROUP BY topic")
def log_end_offsets(spark, sf_dir):
    return log.ends(event_log(spark, sf_dir))


@_query(f"WITH {EVENT_LOG} SELECT topic, o AS \"offset\", key, payload, timestamp_ms FROM L WHERE o >= 500")
def read_from_offset(spark, sf_dir):
    return log.read(event_log(spark, sf_dir), 500).select("topic", "offset", "key", "payload", "timestamp_ms")


@_query(f"""WITH {EVENT_LOG}, s AS (SELECT *, row_number() OVER w AS rn, sum(strlen(payload)) OVER w AS cs FROM L WHERE o >= 100
  WINDOW w AS (PARTITION BY topic ORDER BY o))
SELECT topic, o AS "offset", payload FROM s WHERE rn <= 512 AND (rn = 1 OR cs <= 4096)""")
def read_bounded(spark, sf_dir):
    return log.read_bounded(event_log(spark, sf_dir), 100, 512, 4096).select("topic", "offset", "payload")


_HOLES = "K AS (SELECT topic, o, payload FROM L QUALIFY row_number() OVER (PARTITION BY topic, key ORDER BY o DESC) = 1)"


@_query(f"""WITH {EVENT_LOG}, {_HOLES}, S AS (SELECT *, row_number() OVER w AS n, sum(strlen(payload)) OVER w AS b FROM K WHERE o >= 100 WINDOW w AS (PARTITION BY topic ORDER BY o))
SELECT topic, o AS "offset", payload FROM S WHERE n <= 60 AND (b <= 500 OR n = 1)""")
def read_bounded_compacted(spark, sf_dir):
    return log.read_bounded(log.compact(event_log(spark, sf_dir)), 100, 60, 500).select("topic", "offset", "payload")


@_query(f"""WITH {EVENT_LOG}, {_HOLES} SELECT topic, o AS "offset", row_number() OVER (PARTITION BY topic ORDER BY o) AS place
FROM K WHERE o >= 100 QUALIFY row_number() OVER (PARTITION BY topic ORDER BY o) <= 40""")
def read_limited_compacted(spark, sf_dir):
    rows = log.read_bounded(log.compact(event_log(spark, sf_dir)), 100, 40)
    return scan.positions(rows, ["topic"], scan.offset_block(), ["offset"], "place").select("topic", "offset", (F.col("place") + 1).alias("place"))


def _greedy(source: str, size: str, max_bytes: int, limit: int) -> str:
    """Recursive SQL that numbers greedy runs of rows with columns topic, o."""
    fits = f"g.used + x.{size} <= {max_bytes}" + (f" AND g.n < {limit}" if limit else "")
    return f"""g AS (SELECT topic, o, {size} AS used, 1 AS n, 0 AS run, o AS base FROM {source} WHERE o = 0
  UNION ALL SELECT x.topic, x.o, CASE WHEN {fits} THEN g.used ELSE 0 END + x.{size}, CASE WHEN {fits} THEN g.n ELSE 0 END + 1,
    CASE WHEN {fits} THEN g.run ELSE g.run + 1 END, CASE WHEN {fits} THEN g.base ELSE x.o END
  FROM g JOIN {source} AS x ON x.topic = g.topic AND x.o = g.o + 1)"""


_SIZED = f"{EVENT_LOG}, S AS MATERIALIZED (SELECT topic, o, timestamp_ms, strlen(payload) AS payload_bytes, frame_bytes FROM L)"


@_query(f"WITH RECURSIVE {_SIZED}, {_greedy('S', 'payload_bytes', 4096, 512)} SELECT topic, o AS \"offset\", run::BIGINT AS chunk FROM g")
def read_chunks(spark, sf_dir):
    return log.chunks(event_log(spark, sf_dir), M.READ_LIMIT, 4096)


# Cursors

_CURSORS = f"{EVENT_LOG}, {ACKS}, K AS (SELECT consumer, topic, max(ack) AS cursor FROM A WHERE ack >= 0 GROUP BY ALL), E AS (SELECT topic, max(o) + 1 AS leo FROM L GROUP BY topic)"
_STARTS = [("c0", None), ("c1", None), ("c2", 7), ("c3", 0), ("", None), ("", 5), ("new", None), ("c4", -1), ("c4", 1 << 40), ("c1", -2)]


def _subscriptions(spark, sf_dir) -> DataFrame:
    topics = table(spark, sf_dir, "events").select(F.col("event_type").alias("topic")).distinct()
    starts = F.array(*[F.struct(F.lit(c).alias("consumer"), F.lit(s).cast("long").alias("start")) for c, s in _STARTS])
    return topics.select("topic", F.inline(starts)).unionByName(_values(spark, [("missing", "c0", None)], "topic string, consumer string, start long"))


_POSITIONS = f"""{_CURSORS}, u AS (SELECT topic, consumer, start FROM E, {_literals(_STARTS, 'consumer, start')} UNION ALL SELECT 'missing', 'c0', NULL),
p AS (SELECT u.topic, u.consumer, start::BIGINT AS start, leo, coalesce(start, cursor, 0) AS pos FROM u
  LEFT JOIN K ON K.topic = u.topic AND K.consumer = u.consumer AND u.consumer <> '' LEFT JOIN E ON E.topic = u.topic),
q AS (SELECT topic, consumer, start, pos, CASE WHEN leo IS NULL THEN 'topic_not_found' WHEN start < 0 THEN 'invalid_offset' WHEN pos > leo THEN 'out_of_range' ELSE 'ok' END AS code FROM p)"""


@_query(f"WITH {_POSITIONS} SELECT topic, consumer, start, code, CASE WHEN code = 'ok' THEN pos END::BIGINT AS position FROM q")
def start_position_errors(spark, sf_dir):
    ends = log.ends(event_log(spark, sf_dir))
    return cursors.start_positions(_subscriptions(spark, sf_dir), cursors.final_cursors(acks(spark, sf_dir)), ends)


@_query(f"WITH {_POSITIONS} SELECT q.topic, consumer, start, pos::BIGINT AS position, o AS \"offset\", payload FROM q JOIN L ON L.topic = q.topic AND o >= pos WHERE code = 'ok'")
def resume_from_cursor(spark, sf_dir):
    rows = event_log(spark, sf_dir)
    at = cursors.start_positions(_subscriptions(spark, sf_dir), cursors.final_cursors(acks(spark, sf_dir)), log.ends(rows)).filter("code = 'ok'")
    at = at.select(F.col("topic").alias("_t"), "consumer", "start", "position")
    return rows.join(at, (rows["topic"] == at["_t"]) & (rows["offset"] >= at["position"])).select("topic", "consumer", "start", "position", "offset", "payload")


@_query(f"""WITH {EVENT_LOG}, {ACKS} SELECT consumer, topic, event_id, ack, CASE WHEN ack < 0 THEN 'invalid_message' ELSE 'ok' END AS code,
CASE WHEN ack >= 0 THEN max(CASE WHEN ack >= 0 THEN ack END) OVER (PARTITION BY consumer, topic ORDER BY o) END AS response FROM A""")
def ack_responses(spark, sf_dir):
    out = cursors.ack_responses(acks(spark, sf_dir), ["offset"], scan.offset_block())
    return out.select("consumer", "topic", "event_id", "ack", "code", "response")


@_query(f"WITH {_CURSORS} SELECT consumer, topic, cursor FROM K")
def ack_final_cursors(spark, sf_dir):
    return cursors.final_cursors(acks(spark, sf_dir))


@_query(f"WITH {_CURSORS} SELECT consumer, topic, cursor, leo, greatest(0, leo - cursor)::BIGINT AS lag FROM K JOIN E USING (topic)")
def consumer_lag(spark, sf_dir):
    return cursors.lag(cursors.final_cursors(acks(spark, sf_dir)), log.ends(event_log(spark, sf_dir)))


# Validation

@_query(f"""WITH d AS (SELECT doc_id, text, source, n_chars % 70 AS n, doc_id % 11 = 3 AS reserved, doc_id % 13 = 4 AS long_key, doc_id % 17 = 5 AS big_key FROM documents)
SELECT doc_id, CASE WHEN strlen(text) > 8192 THEN 'payload_too_large' WHEN big_key AND strlen(source) * 1500 > 4096 THEN 'key_too_long'
  WHEN n + reserved::INT + long_key::INT + 1 > 64 THEN 'too_many_headers' WHEN reserved THEN 'reserved_header'
  WHEN strlen(text) > 8192 THEN 'header_value_too_long' WHEN long_key THEN 'header_key_too_long' END AS code FROM d""")
def validate_messages(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    plain = F.transform(F.sequence(F.lit(1), (F.col("n_chars") % 70).cast("int")), lambda i: F.struct(F.concat(F.lit("h"), i.cast("string")).alias("key"), F.lit("v").alias("value")))
    extra = [
        F.when(F.col("doc_id") % 11 == 3, F.struct(F.lit(M.SYSTEM_PREFIX + "x").alias("key"), F.lit("v").alias("value"))),
        F.when(F.col("doc_id") % 13 == 4, F.struct(F.repeat(F.lit("z"), 513).alias("key"), F.lit("v").alias("value"))),
        F.struct(F.lit("text").alias("key"), F.col("text").alias("value")),
    ]
    none = F.filter(plain, lambda x: F.lit(False))
    headers = F.map_from_entries(F.concat(F.when(F.col("n_chars") % 70 > 0, plain).otherwise(none), F.filter(F.array(*extra), lambda x: x.isNotNull())))
    key = F.when(F.col("doc_id") % 17 == 5, F.repeat("source", 1500)).otherwise(F.col("source"))
    return d.select("doc_id", checks.message_error(F.col("text"), key, headers, 8192).alias("code"))


_NAMES = ["", ".", "..", "__internal", "__", "_a", "a", "a.b-c_d", "-a", ".a", "a/b", "a b", "é", "x" * 255, "x" * 256, "0", "A.", "a\nb"]
_NAME_ROWS = "SELECT p_name AS name FROM part UNION SELECT url FROM pages UNION SELECT source FROM documents UNION SELECT n_name FROM nation UNION SELECT c_name FROM customer"


def _names(spark, sf_dir) -> DataFrame:
    columns = (("part", "p_name"), ("pages", "url"), ("documents", "source"), ("nation", "n_name"), ("customer", "c_name"))
    out = _values(spark, [(n,) for n in _NAMES], "name string")
    for t, c in columns:
        out = out.unionByName(table(spark, sf_dir, t).select(F.col(c).alias("name")))
    return out.distinct()


_ALL_NAMES = f"n AS ({_NAME_ROWS} UNION SELECT * FROM {_literals([(x,) for x in _NAMES], 'name')})"


@_query(f"""WITH {_ALL_NAMES} SELECT name, CASE WHEN name IS NULL OR name IN ('', '.', '..') OR strlen(name) > 255 THEN 'invalid_name' WHEN starts_with(name, '__') THEN 'reserved_name'
  WHEN NOT regexp_full_match(name, '[a-zA-Z0-9][a-zA-Z0-9._-]*') THEN 'invalid_name' END AS code FROM n""")
def validate_topic_names(spark, sf_dir):
    return _names(spark, sf_dir).select("name", checks.topic_name_error(F.col("name")).alias("code"))


@_query(f"WITH {_ALL_NAMES} SELECT name, CASE WHEN name IS NULL OR name = '' OR strlen(name) > 128 OR contains(name, '/') THEN 'invalid_consumer' END AS code FROM n")
def validate_consumer_names(spark, sf_dir):
    return _names(spark, sf_dir).select("name", checks.consumer_name_error(F.col("name")).alias("code"))


_CONFIGS = [
    (p, m, age, size, c, r)
    for p in (0, 1, 2) for m in (-1, 0, 1, M.MAX_MESSAGE_BYTES, M.MAX_MESSAGE_BYTES + 1) for age in (-1, 0, 60000) for size in (-1, 0, 1000)
    for c in ("", "delete", "compact", "other") for r in (0, 1, 3)
]


@_query(f"""SELECT *, CASE WHEN code IS NULL THEN CASE WHEN max_bytes = 0 THEN {M.DEFAULT_MESSAGE_BYTES} ELSE max_bytes END END AS effective_bytes,
  CASE WHEN code IS NULL THEN CASE WHEN cleanup = '' THEN 'delete' ELSE cleanup END END AS effective_cleanup FROM (
  SELECT partitions::INTEGER AS partitions, max_bytes::BIGINT AS max_bytes, retention_ms::BIGINT AS retention_ms, retention_bytes::BIGINT AS retention_bytes, cleanup, replication::INTEGER AS replication,
  CASE WHEN max_bytes <> 0 AND (max_bytes < 1 OR max_bytes > {M.MAX_MESSAGE_BYTES}) OR retention_ms < 0 OR retention_bytes < 0 OR cleanup NOT IN ('', 'delete', 'compact')
    OR replication NOT IN (0, 1) THEN 'invalid_config' WHEN partitions <> 1 THEN 'invalid_partitions' END AS code
  FROM {_literals(_CONFIGS, 'partitions, max_bytes, retention_ms, retention_bytes, cleanup, replication')})""")
def normalize_topic_config(spark, sf_dir):
    rows = _values(spark, _CONFIGS, "partitions int, max_bytes long, retention_ms long, retention_bytes long, cleanup string, replication int")
    rows = rows.withColumn("code", checks.config_error(*[F.col(c) for c in rows.columns]))
    ok = F.col("code").isNull()
    return rows.withColumns({
        "effective_bytes": F.when(ok, F.when(F.col("max_bytes") == 0, M.DEFAULT_MESSAGE_BYTES).otherwise(F.col("max_bytes"))).cast("long"),
        "effective_cleanup": F.when(ok, F.when(F.col("cleanup") == "", "delete").otherwise(F.col("cleanup"))),
    })


@_query("SELECT p.partition::INTEGER AS partition, n.partitions::INTEGER AS partitions, p.partition >= 0 AND p.partition < n.partitions AS valid FROM (VALUES (-1), (0), (1), (2)) AS p(partition), (VALUES (0), (1), (2)) AS n(partitions)")
def validate_partitions(spark, sf_dir):
    rows = _values(spark, [(p, n) for p in (-1, 0, 1, 2) for n in (0, 1, 2)], "partition int, partitions int")
    return rows.withColumn("valid", checks.partition_ok(F.col("partition"), F.col("partitions")))


# Frames, headers and names

def _fields() -> dict[str, Column]:
    """Metadata of conversations' messages; one expression per field."""
    return {
        "event_id": F.lit("01ARZ3NDEKTSV4RRFFQ69G5FAV"),
        "content_type": F.when(F.col("turn") % 2 == 0, "text/plain").otherwise(""),
        "correlation_id": F.col("conv_id").cast("string"),
        "trace_id": F.lit(""),
        "retry_count": (F.col("turn") % 3 - 1).cast("int"),
        "ttl_ms": F.col("conv_id") * 1000,
        "priority": F.col("turn").cast("int"),
        "schema_version": F.lit(0),
    }


_FIELD_SQL = {
    "event_id": "'01ARZ3NDEKTSV4RRFFQ69G5FAV'", "content_type": "CASE WHEN turn % 2 = 0 THEN 'text/plain' ELSE '' END", "correlation_id": "conv_id::VARCHAR",
    "retry_count": "CASE WHEN turn % 3 = 1 THEN '' ELSE (turn % 3 - 1)::VARCHAR END", "ttl_ms": "CASE WHEN conv_id = 0 THEN '' ELSE (conv_id * 1000)::VARCHAR END", "priority": "CASE WHEN turn = 0 THEN '' ELSE turn::VARCHAR END",
}


@_query("SELECT conv_id, turn, 25 + strlen(conv_id::VARCHAR) + strlen(text) + 12 + strlen(role) + "
        + " + ".join(f"CASE WHEN {v} <> '' THEN {8 + 8 + len(k)} + strlen({v}) ELSE 0 END" for k, v in _FIELD_SQL.items()) + " AS record_bytes FROM conversations")
def frame_sizes(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    size = frames.record_bytes(F.col("conv_id").cast("string"), F.col("text"), F.create_map(F.lit("role"), F.col("role")), _fields())
    return c.select("conv_id", "turn", size.alias("record_bytes"))


@_query("SELECT conv_id, turn, key, value FROM (" + " UNION ALL ".join(f"SELECT conv_id, turn, '{M.SYSTEM_PREFIX}{k}' AS key, {v} AS value FROM conversations" for k, v in _FIELD_SQL.items())
        + " UNION ALL SELECT conv_id, turn, 'role', role FROM conversations) WHERE value <> ''")
def system_headers(spark, sf_dir):
    every = F.map_concat(frames.system_headers(_fields()), F.create_map(F.lit("role"), F.col("role")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(every))


@_query("SELECT conv_id, turn, 'role=' || role AS user_headers, conv_id * 1000 AS ttl_ms, (turn % 3 - 1)::INTEGER AS retry_count, '' AS trace_id FROM conversations")
def header_fields(spark, sf_dir):
    every = F.map_concat(frames.system_headers(_fields()), F.create_map(F.lit("role"), F.col("role")))
    c = table(spark, sf_dir, "conversations").withColumn("headers", every)
    user = F.array_join(F.transform(F.map_entries(frames.user_headers(F.col("headers"))), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return c.select("conv_id", "turn", user.alias("user_headers"), *[frames.field_of(F.col("headers"), n).alias(n) for n in ("ttl_ms", "retry_count", "trace_id")])


@_query("SELECT event_id, json_extract_string(props, '$.k') AS k, event_type FROM events")
def header_lookup(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    headers = F.create_map(F.lit("k"), F.get_json_object("props", "$.k"), F.lit("event_type"), F.col("event_type"))
    return e.withColumn("h", headers).select("event_id", F.element_at("h", "k").alias("k"), F.element_at("h", "event_type").alias("event_type"))


@_query("SELECT o_orderkey, lpad(o_orderkey::VARCHAR, 20, '0') AS name, o_orderkey AS base, o_orderpriority, NULL::BIGINT AS not_a_base FROM orders")
def segment_names(spark, sf_dir):
    name = frames.segment_name(F.col("o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey", name.alias("name"), frames.segment_base(name).alias("base"), "o_orderpriority", frames.segment_base(F.col("o_orderpriority")).alias("not_a_base"))


_ULID = "array_to_string(list_transform(range({n}), lambda i: substr('0123456789ABCDEFGHJKMNPQRSTVWXYZ', ((({v}) >> (5 * ({n} - 1 - i))) & 31) + 1, 1)), '')"


@_query("WITH e AS (SELECT event_id, epoch_us(ts) // 1000 AS ms, md5(event_type || ':' || event_id) AS h FROM events) SELECT event_id, "
        + " || ".join((_ULID.format(n=10, v="ms"), _ULID.format(n=8, v="('0x' || substr(h, 1, 10))::BIGINT"), _ULID.format(n=8, v="('0x' || substr(h, 11, 10))::BIGINT"))) + " AS ulid, true AS valid FROM e")
def event_ids(spark, sf_dir):
    e = event_messages(spark, sf_dir)
    e = e.select("event_id", frames.ulid(F.col("timestamp_ms"), F.concat_ws(":", "topic", F.col("event_id").cast("string"))).alias("ulid"))
    return e.withColumn("valid", frames.ulid_ok(F.lower("ulid")))


_CRC_TABLE = "T AS (SELECT list(list_reduce(range(8), lambda a, i: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 2197175160) ELSE a >> 1 END, b) ORDER BY b) AS t FROM range(256) AS r(b))"


@_query(f"""WITH {_CRC_TABLE} SELECT doc_id, xor(list_reduce(list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::BIGINT),
  lambda a, x: xor(a >> 8, t[xor(a & 255, x) + 1]), 4294967295::BIGINT), 4294967295)::BIGINT AS crc32c FROM documents, T""")
def payload_checksums(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", codec.crc32c_column(F.col("text").cast("binary")).alias("crc32c"))


# Segments, index and retention

_SEGMENT_BYTES = 20_000
_SEGMENTED = f"{_SIZED}, {_greedy('S', 'frame_bytes', _SEGMENT_BYTES, 0)}, Q AS MATERIALIZED (SELECT S.*, g.base FROM S JOIN g USING (topic, o))"
_SEGMENT_STATS = f"{_SEGMENTED}, Z AS (SELECT topic, base AS segment_base, max(o) + 1 AS next_offset, count(*) AS n_records, sum(frame_bytes)::BIGINT AS bytes, arg_max(timestamp_ms, o) AS last_timestamp_ms FROM Q GROUP BY ALL)"


def _segmented(spark, sf_dir) -> DataFrame:
    rows = event_log(spark, sf_dir).select("topic", "offset", "timestamp_ms", "frame_bytes")
    return segments.assign(rows, _SEGMENT_BYTES).join(rows.select("topic", "offset", "timestamp_ms"), ["topic", "offset"])


@_query(f"WITH RECURSIVE {_SEGMENTED} SELECT topic, o AS \"offset\", frame_bytes, base AS segment_base FROM Q")
def segment_assignment(spark, sf_dir):
    return segments.assign(event_log(spark, sf_dir), _SEGMENT_BYTES)


@_query(f"WITH RECURSIVE {_SEGMENT_STATS} SELECT * FROM Z")
def segment_stats(spark, sf_dir):
    return segments.stats(_segmented(spark, sf_dir))


@_query(f"WITH RECURSIVE {_SEGMENT_STATS} SELECT topic, sum(bytes)::BIGINT AS log_bytes, count(*) AS n_segments FROM Z GROUP BY topic")
def log_sizes(spark, sf_dir):
    return segments.stats(_segmented(spark, sf_dir)).groupBy("topic").agg(F.sum("bytes").alias("log_bytes"), F.count("*").alias("n_segments"))


@_query(f"WITH RECURSIVE {_SEGMENT_STATS} SELECT topic, segment_base, next_offset FROM Z WHERE next_offset > 1000")
def segment_pruning(spark, sf_dir):
    return segments.surviving(segments.stats(_segmented(spark, sf_dir)), 1000).select("topic", "segment_base", "next_offset")


_MARKED = f"""{_SEGMENTED}, P AS MATERIALIZED (SELECT *, sum(frame_bytes) OVER (PARTITION BY topic, base ORDER BY o) - frame_bytes AS pos FROM Q),
m AS (SELECT topic, o, base, pos, true AS entry, pos + 4096 AS due FROM P WHERE o = 0
  UNION ALL SELECT P.topic, P.o, P.base, P.pos, P.base = P.o OR P.pos >= m.due, CASE WHEN P.base = P.o OR P.pos >= m.due THEN P.pos + 4096 ELSE m.due END
  FROM m JOIN P ON P.topic = m.topic AND P.o = m.o + 1)"""


@_query(f"WITH RECURSIVE {_MARKED} SELECT topic, base AS segment_base, o - base AS relative_offset, pos::BIGINT AS relative_position FROM m WHERE entry")
def sparse_index(spark, sf_dir):
    return segments.sparse_index(_segmented(spark, sf_dir), M.INDEX_INTERVAL)


@_query(f"WITH RECURSIVE {_MARKED} SELECT topic, o AS \"offset\", base AS segment_base, max(CASE WHEN entry THEN pos END) OVER (PARTITION BY topic, base ORDER BY o)::BIGINT AS seek FROM m")
def index_lookup(spark, sf_dir):
    return segments.lookups(_segmented(spark, sf_dir), M.INDEX_INTERVAL)


def _trim_sql(age_ms: int, size: int, out: str) -> str:
    aged = f"NOT bool_or(last_timestamp_ms >= now_ms - {age_ms} OR live) OVER (PARTITION BY topic ORDER BY segment_base)" if age_ms else "false"
    sized = f"NOT by_age AND NOT live AND sum(CASE WHEN by_age THEN 0 ELSE bytes END) OVER (PARTITION BY topic ORDER BY segment_base DESC) > {size}" if size else "false"
    return f"""WITH RECURSIVE {_SEGMENT_STATS}, n AS (SELECT max(timestamp_ms) AS now_ms FROM L),
a AS (SELECT Z.*, now_ms, segment_base = max(segment_base) OVER (PARTITION BY topic) AS live FROM Z, n),
b AS (SELECT *, {aged} AS by_age FROM a), c AS (SELECT *, {sized} AS by_size FROM b)
{out}"""


_TRIMMED = "SELECT topic, segment_base, bytes, by_age, by_size, by_age OR by_size AS dropped FROM c"
_AGE, _SIZE = 10 * 24 * 3_600_000, 100_000


def _trim(spark, sf_dir, age: int, size: int) -> DataFrame:
    now = event_messages(spark, sf_dir).agg(F.max("timestamp_ms").alias("_now"))
    zones = segments.stats(_segmented(spark, sf_dir)).join(F.broadcast(now))  # one row
    return retention.marked(zones, F.col("_now"), age, size)


@_query(_trim_sql(_AGE, 0, _TRIMMED))
def trim_by_age(spark, sf_dir):
    return _trim(spark, sf_dir, _AGE, 0).select("topic", "segment_base", "bytes", "by_age", "by_size", "dropped")


@_query(_trim_sql(0, _SIZE, _TRIMMED))
def trim_by_size(spark, sf_dir):
    return _trim(spark, sf_dir, 0, _SIZE).select("topic", "segment_base", "bytes", "by_age", "by_size", "dropped")


@_query(_trim_sql(2 * _AGE, _SIZE, _TRIMMED))
def trim_combined(spark, sf_dir):
    return _trim(spark, sf_dir, 2 * _AGE, _SIZE).select("topic", "segment_base", "bytes", "by_age", "by_size", "dropped")


@_query(_trim_sql(2 * _AGE, _SIZE, "SELECT topic, count(*) FILTER (by_age OR by_size) AS segments_removed, coalesce(sum(bytes) FILTER (by_age OR by_size), 0)::BIGINT AS bytes_removed FROM c GROUP BY topic"))
def trim_result(spark, sf_dir):
    return retention.result(_trim(spark, sf_dir, 2 * _AGE, _SIZE))


@_query(f"WITH {CONVERSATION_LOG} SELECT conv_id, turn, o AS \"offset\", batch_base FROM C WHERE batch_base < 100")
def truncate_log(spark, sf_dir):
    return log.truncate(conversation_log(spark, sf_dir), 100).select("conv_id", "turn", "offset", "batch_base")


@_query(f"WITH {EVENT_LOG}, K AS (SELECT * REPLACE (CASE WHEN event_id % 10 = 0 THEN '' ELSE key END AS key) FROM L) SELECT topic, o AS \"offset\", key FROM K QUALIFY key = '' OR row_number() OVER (PARTITION BY topic, key ORDER BY o DESC) = 1")
def compact_log(spark, sf_dir):
    rows = event_log(spark, sf_dir).withColumn("key", F.when(F.col("event_id") % 10 == 0, "").otherwise(F.col("key")))
    return log.compact(rows).select("topic", "offset", "key")


# Keys by prefix

_PREFIXES = ("", "p", "pu", "si", "v", "z")


@_query(f"SELECT p AS prefix, event_type AS topic, count(*) AS n_records FROM events, {_literals([(p,) for p in _PREFIXES], 'p')} WHERE starts_with(event_type, p) GROUP BY ALL")
def prefix_scan(spark, sf_dir):
    counts = event_messages(spark, sf_dir).groupBy("topic").agg(F.count("*").alias("n_records"))
    own = counts.select(F.explode(F.array(*map(F.lit, _PREFIXES))).alias("prefix"), "topic", "n_records")
    return own.filter((F.col("prefix") == "") | frames.with_prefix(F.col("topic").cast("binary"), F.col("prefix").cast("binary")))


@_query("""SELECT * FROM (VALUES ('61', '62'), ('6162', '6163'), ('61FF', '62'), ('00', '01'), ('FF', NULL), ('FFFF', NULL), ('0FFF', '10'), ('7F', '80'), ('', NULL), ('FE01FFFF', 'FE02')) AS v(prefix, end_before)""")
def prefix_ends(spark, sf_dir):
    rows = _values(spark, [(x,) for x in ("61", "6162", "61FF", "00", "FF", "FFFF", "0FFF", "7F", "", "FE01FFFF")], "prefix string")
    return rows.select("prefix", F.hex(frames.prefix_end(F.unhex("prefix"))).alias("end_before"))


# Catalog and lifecycle


@_query("SELECT event_type AS name, 1 AS partitions, count(*) AS n_records, count(*) OVER () AS n_topics FROM events GROUP BY event_type")
def topics_catalog(spark, sf_dir):
    topics = event_messages(spark, sf_dir).groupBy(F.col("topic").alias("name")).agg(F.count("*").alias("n_records"))
    total = topics.agg(F.count("*").alias("n_topics"))
    return topics.join(F.broadcast(total)).select("name", F.lit(1).alias("partitions"), "n_records", "n_topics").orderBy("name")


_SWEEPS = [(c, a, s) for c in ("delete", "compact") for a in (0, 1) for s in (0, 1)]


@_query(f"SELECT cleanup, retention_ms::BIGINT AS retention_ms, retention_bytes::BIGINT AS retention_bytes, cleanup = 'delete' AND (retention_ms > 0 OR retention_bytes > 0) AS eligible FROM {_literals(_SWEEPS, 'cleanup, retention_ms, retention_bytes')}")
def sweep_eligible(spark, sf_dir):
    rows = _values(spark, _SWEEPS, "cleanup string, retention_ms long, retention_bytes long")
    return rows.withColumn("eligible", checks.sweepable(*[F.col(c) for c in rows.columns]))


@_query("""SELECT a.s AS state, b.s AS next, a.s || '>' || b.s IN ('starting>recovering', 'starting>stopping', 'recovering>running', 'recovering>stopping',
  'running>draining', 'running>stopping', 'draining>stopping', 'stopping>stopped') AS allowed, a.i::INTEGER AS number
FROM (VALUES (0, 'starting'), (1, 'recovering'), (2, 'running'), (3, 'draining'), (4, 'stopping'), (5, 'stopped')) AS a(i, s)
CROSS JOIN (VALUES ('starting'), ('recovering'), ('running'), ('draining'), ('stopping'), ('stopped')) AS b(s)""")
def lifecycle_transitions(spark, sf_dir):
    edges = F.array(*[F.lit(f"{a}>{b}") for a, b in M.TRANSITIONS])
    rows = spark.range(len(M.STATES)).select(F.col("id").cast("int").alias("number"), frames.state_name(F.col("id").cast("int")).alias("state"), F.explode(F.array(*map(F.lit, M.STATES))).alias("next"))
    return rows.select("state", "next", F.array_contains(edges, F.concat_ws(">", "state", "next")).alias("allowed"), "number")


_FAILURES = [*errors.STATUS_OF, "disk_full", ""]


@_query("""SELECT * FROM (VALUES ('cancelled', 'Canceled'), ('deadline', 'DeadlineExceeded'), ('invalid_name', 'InvalidArgument'), ('reserved_name', 'InvalidArgument'),
  ('invalid_config', 'InvalidArgument'), ('invalid_partitions', 'InvalidArgument'), ('invalid_message', 'InvalidArgument'), ('invalid_consumer', 'InvalidArgument'),
  ('topic_not_found', 'NotFound'), ('partition_not_found', 'NotFound'), ('already_exists', 'AlreadyExists'), ('out_of_range', 'OutOfRange'),
  ('invalid_offset', 'OutOfRange'), ('not_running', 'Unavailable'), ('disk_full', 'Internal'), ('', 'Internal')) AS v(kind, status)""")
def error_codes(spark, sf_dir):
    known = F.create_map(*[F.lit(x) for pair in errors.STATUS_OF.items() for x in pair])
    return _values(spark, [(k,) for k in _FAILURES], "kind string").select("kind", F.coalesce(F.try_element_at(known, F.col("kind")), F.lit("Internal")).alias("status"))


# Statistics


@_query("""WITH s AS (SELECT event_type AS topic, round(value * 1000000)::BIGINT AS ns FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY ns) - 1 AS rn, count(*) OVER (PARTITION BY topic) AS n FROM s)
SELECT topic, count(*) AS count, min(ns) AS min, (sum(ns) // count(*))::BIGINT AS mean, max(ns) AS max,
  """ + ", ".join(f"max(ns) FILTER (rn = least(floor({q} * n), n - 1)) AS {name}" for name, q in stats.QUANTILES.items()) + " FROM r GROUP BY topic")  # fmt: skip
def latency_summary(spark, sf_dir):
    samples = event_messages(spark, sf_dir).select("topic", F.round(F.col("value") * 1_000_000).cast("long").alias("ns"))
    return stats.latency(samples, "ns")


@_query(f"""WITH {EVENT_LOG}, s AS (SELECT topic, count(*) AS n, sum(strlen(payload)) AS b, (max(timestamp_ms) - min(timestamp_ms)) / 1000 AS t FROM L GROUP BY topic)
SELECT topic, n AS n_records, b::BIGINT AS payload_bytes, round(n / t, 9) AS records_per_s, round(b / 1048576 / t, 12) AS mib_per_s FROM s""")
def throughput(spark, sf_dir):
    return stats.throughput(event_log(spark, sf_dir))


@_query(f"""WITH {EVENT_LOG}, k AS (SELECT topic, o FROM L QUALIFY row_number() OVER (PARTITION BY topic, key ORDER BY o DESC) = 1),
s AS (SELECT topic, o, lag(o) OVER (PARTITION BY topic ORDER BY o) AS before FROM k)
SELECT topic, count(*) AS n_records, count(*) FILTER (o <> before + 1) AS n_gaps, max(o) - min(o) + 1 - count(*) AS n_lost FROM s GROUP BY topic""")
def delivery_check(spark, sf_dir):
    # A compacted log has holes, which the check has to count.
    return log.gaps(log.compact(event_log(spark, sf_dir)))


# Streaming, frames on disk and recovery


@_query(f"WITH {EVENT_LOG} SELECT topic, o AS \"offset\", payload FROM L WHERE o >= 200")
def follow_stream(spark, sf_dir):
    return follow.replay(spark, event_log(spark, sf_dir).select("topic", "offset", "payload"), 200)


@_query(f"WITH {EVENT_LOG} SELECT topic, o AS \"offset\", key, payload, timestamp_ms FROM L")
def codec_roundtrip(spark, sf_dir):
    rows = event_log(spark, sf_dir).select("topic", "offset", "batch_base", "timestamp_ms", "key", F.col("payload").cast("binary").alias("payload"))
    back = codec.decode(codec.encode(rows))
    return back.select("topic", "offset", "key", F.col("payload").cast("string").alias("payload"), "timestamp_ms")


@_query(f"""WITH {EVENT_LOG}, d AS (SELECT topic, min(o) FILTER (event_id % 499 = 7) AS bad, max(o) + 1 AS n FROM L GROUP BY topic)
SELECT topic, coalesce(bad, n) AS next_offset, n AS n_frames, bad IS NOT NULL AS damaged FROM d""")
def recovery_prefix(spark, sf_dir):
    # Frames of events whose number leaves 7 modulo 499 get a flipped byte: they are the damage to find.
    rows = event_log(spark, sf_dir).select("topic", "event_id", "offset", "batch_base", "timestamp_ms", "key", F.col("payload").cast("binary").alias("payload"))
    hurt = rows.filter(F.col("event_id") % 499 == 7).select("topic", F.col("batch_base").alias("base"), F.lit(True).alias("hurt"))
    framed = codec.encode(rows.drop("event_id")).join(hurt, ["topic", "base"], "left")
    flipped = F.concat(F.expr("substring(frame, 1, 60)"), F.unhex(F.lit("FF")), F.expr("substring(frame, 62)"))
    return codec.recover(framed.withColumn("frame", F.when(F.col("hurt"), flipped).otherwise(F.col("frame"))))


@_query(f"""WITH RECURSIVE {_SEGMENTED}, B AS (SELECT Q.topic, Q.base, Q.o, Q.frame_bytes, min(CASE WHEN L.event_id % 499 = 7 THEN Q.o END) OVER (PARTITION BY Q.topic, Q.base) AS bad
  FROM Q JOIN L USING (topic, o)),
R AS (SELECT topic, base, sum(frame_bytes)::BIGINT AS bytes, coalesce(sum(frame_bytes) FILTER (bad IS NULL OR o < bad), 0)::BIGINT AS valid_bytes, coalesce(min(bad), max(o) + 1) AS next_offset,
  CASE WHEN min(bad) IS NOT NULL THEN 'crc_mismatch' END AS code FROM B GROUP BY ALL)
SELECT *, base = max(base) OVER (PARTITION BY topic) AS last, base < max(base) OVER (PARTITION BY topic) AND code IS NOT NULL AS fatal FROM R""")
def recover_segments(spark, sf_dir):
    rows = event_log(spark, sf_dir).select("topic", "event_id", "offset", "batch_base", "timestamp_ms", "key", F.col("payload").cast("binary").alias("payload"))
    parts = segments.assign(event_log(spark, sf_dir), _SEGMENT_BYTES).select("topic", F.col("offset").alias("base"), "segment_base")
    hurt = rows.select("topic", F.col("batch_base").alias("base"), (F.col("event_id") % 499 == 7).alias("hurt"))
    framed = codec.encode(rows.drop("event_id")).join(hurt, ["topic", "base"]).join(parts, ["topic", "base"])
    flipped = F.concat(F.expr("substring(frame, 1, 60)"), F.unhex(F.lit("FF")), F.expr("substring(frame, 62)"))
    framed = framed.withColumn("frame", F.when(F.col("hurt"), flipped).otherwise(F.col("frame")))
    # A segment's frames end to end, at most _SEGMENT_BYTES of them.
    each = F.sort_array(F.collect_list(F.struct("base", F.hex("frame").alias("frame"))))
    files = framed.groupBy("topic", "segment_base").agg(F.unhex(F.concat_ws("", F.transform(each, lambda x: x["frame"]))).alias("content"))
    return native.judged(native.scanned(files.withColumnRenamed("segment_base", "base"), "topic"), "topic")


@_query("SELECT * FROM (VALUES (0, 'ok'), (1, 'ok'), (2, 'size'), (3, 'magic'), (4, 'version'), (5, 'checksum'), (6, 'state')) AS v(number, verdict)")
def checkpoint_states(spark, sf_dir):
    sound = native.checkpoint_bytes(native.Checkpoint(40, 30, 1000))
    bad = native.CHECKPOINT.pack(0, 0, 0, 0, 40, 30, 1000, 41)[8:]
    cases = (
        sound, native.checkpoint_bytes(native.Checkpoint(0, 0, 0)), sound[:-1], b"T" + sound[1:], sound[:1] + b"\x02" + sound[2:], sound[:-1] + b"\x00",
        native.CHECKPOINT.pack(native.CHECKPOINT_MAGIC, 1, 0, int(codec.crc32c([bad])[0]), 40, 30, 1000, 41),
    )
    rows = _values(spark, list(enumerate(map(bytearray, cases))), "number int, data binary")
    part = lambda at, n: F.conv(F.hex(F.substring("data", at + 1, n)), 16, 10).cast("long")
    states = F.when(F.octet_length("data") != 40, "size").when(part(0, 1) != 0x53, "magic").when(part(1, 1) != 1, "version")
    states = states.when(part(4, 4) != codec.crc32c_column(F.expr("substring(data, 9)")), "checksum")
    consistent = (part(8, 8) >= 0) & (part(16, 8) >= 0) & (part(24, 8) >= 0) & (part(32, 8) == part(8, 8)) & (part(16, 8) <= part(8, 8))
    return rows.select("number", states.when(~consistent, "state").otherwise("ok").alias("verdict"))


_FED = "S AS MATERIALIZED (SELECT 'events' AS topic, row_number() OVER (ORDER BY ts, event_id) - 1 AS o, strlen(props) AS payload_bytes FROM events)"


@_query(f"""WITH RECURSIVE {_FED}, {_greedy('S', 'payload_bytes', 16384, 1500)}
SELECT run AS chunk, min(o) AS first, max(o) AS last, count(*) AS n_records, sum(payload_bytes)::BIGINT AS payload_bytes, true AS ordered FROM g JOIN S USING (topic, o) GROUP BY run""")
def delivered_chunks(spark, sf_dir):
    """What a subscriber gets of a published log: a row a chunk."""
    engine = Engine(spark, new_path(spark, "engine"), Config(read_limit=1500, read_max_bytes=16384)).start()
    engine.create_topic("events")
    at = F.unix_micros(F.col("ts").cast("timestamp")).alias("at")
    rows = table(spark, sf_dir, "events").select(at, F.col("event_id").alias("place"), F.col("event_type").alias("key"), F.col("props").alias("payload"))
    engine.publish("events", rows, order=["at", "place"])
    seen: list[tuple] = []

    def emit(chunk: DataFrame, number: int) -> None:
        got = [(r["offset"], len(r["payload"])) for r in chunk.select("offset", "payload").collect()]  # read_limit records at most
        offsets = [o for o, _ in got]
        seen.append((number, offsets[0], offsets[-1], len(got), sum(n for _, n in got), offsets == sorted(offsets)))

    engine.subscribe("events", emit, new_path(spark, "progress")).awaitTermination()
    engine.stop()
    return _values(spark, seen, "chunk long, first long, last long, n_records long, payload_bytes long, ordered boolean")
