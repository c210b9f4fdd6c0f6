"""The engine: topics, publishing, reading, cursors, maintenance and lifecycle over log tables.

Appends to a topic are serialised by a lock within an engine and by numbered manifests between engines; each
publish is one batch, visible once its manifest is. Delivery is at least once, in order, in bounded chunks.
"""

from __future__ import annotations

import json
import logging
import threading
import time
import uuid
from collections.abc import Callable, Iterable, Iterator, Mapping

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from strandlog import errors as E
from strandlog import model as M
from strandlog.config import Config
from strandlog.functions import checks, frames
from strandlog.operators import log as ops
from strandlog.sources.table_log import Conflict, Manifest, Segment, TableLog, listed, read_text, replace_text
from strandlog.streaming import follow as streams
from strandlog.workspace import file_system

SCHEMA_VERSION = 1
#: Times that a write tries again after another engine committed first.
ATTEMPTS = 8
logger = logging.getLogger("strandlog")


def _now_ms() -> int:
    return time.time_ns() // 1_000_000


class Engine:
    def __init__(self, spark: SparkSession, data_dir: str, config: Config | None = None, clock: Callable[[], int] = _now_ms):
        self.spark, self.root, self.config, self.clock = spark, data_dir.rstrip("/"), config or Config(), clock
        self.state, self.started_ms, self.identity = "starting", 0, {}
        self._locks: dict[str, threading.Lock] = {}
        self._guard = threading.Lock()
        self._halt, self._ticker = threading.Event(), None
        self._counts: dict[tuple[str, str], int] = {}
        self._untold: dict[str, int] = {}  # first offset that a topic's feed lacks
        logger.setLevel({"warn": "WARNING"}.get(self.config.log_level, self.config.log_level.upper()))

    # Lifecycle

    def _to(self, state: str) -> None:
        if (self.state, state) not in M.TRANSITIONS:
            raise E.LogError(f"invalid transition: {self.state} to {state}")
        self.state = state

    def start(self) -> Engine:
        """Load or make the identity, make logs that the catalog has but storage lacks, and run."""
        self._to("recovering")
        stored = self._json("identity.json", None)
        if stored is None:
            stored = {"cluster": uuid.uuid4().hex, "broker": uuid.uuid4().hex, "schema_version": SCHEMA_VERSION}
            self._save("identity.json", stored)
        if stored["schema_version"] != SCHEMA_VERSION:
            raise E.LogError(f"metadata version {stored['schema_version']} isn't {SCHEMA_VERSION}")
        self.identity = stored
        for name in self._json("catalog.json", {}):
            self._recover(name)
        self.started_ms = self.clock()
        self._to("running")
        logger.info("running on %s as broker %s", self.root, stored["broker"])
        return self

    def _recover(self, name: str) -> None:
        """Make a log that storage lacks, tell the feed of commits it lacks, and delete what no commit named."""
        table = self._log(name)
        manifest = table.manifest()
        if manifest is None:
            logger.warning("topic %s had no log; it has an empty one now", name)
            return table.create()
        if (told := max(table.announced(), manifest.log_start)) < manifest.leo:
            table.announce(told, manifest.leo, manifest.number)
        if gone := table.collect(self.clock(), self.config.grace_ms):
            logger.info("topic %s: removed %d files that nothing names", name, len(gone))

    def watch(self) -> Engine:
        """Sweep now, and again every retention_interval until stop()."""
        self._running()

        def run() -> None:
            while self.state == "running":
                try:
                    self.sweep()
                except Exception:
                    logger.exception("sweep failed")
                if self._halt.wait(max(0.001, self.config.retention_interval_ms / 1000)):
                    return

        if self.config.retention_interval_ms > 0 and self._ticker is None:
            self._ticker = threading.Thread(target=run, name="strandlog-retention", daemon=True)
            self._ticker.start()
        return self

    def health(self) -> tuple[bool, str]:
        """Whether the engine serves, and its state."""
        return self.state == "running", self.state

    def _count(self, topic: str, **counts: int) -> None:
        with self._guard:
            for name, n in counts.items():
                self._counts[topic, name] = self._counts.get((topic, name), 0) + n

    def metrics(self) -> DataFrame:
        """Counters since the start by topic and name: records, bytes and batches published, chunks delivered, acks, segments and bytes trimmed."""
        with self._guard:
            rows = [(t, n, v) for (t, n), v in self._counts.items()]
        return self.spark.createDataFrame(rows, "topic string, name string, value long").orderBy("topic", "name")

    def stop(self) -> None:
        self._halt.set()
        if self._ticker is not None and self._ticker is not threading.current_thread():
            self._ticker.join()
        if self.state == "running":
            self._to("draining")
        self._to("stopping")
        self._to("stopped")

    def _running(self) -> None:
        if self.state != "running":
            raise E.NotRunning("engine is not running")

    def info(self) -> DataFrame:
        """One row: identity, state, start and number of topics."""
        row = (self.identity.get("cluster", ""), self.identity.get("broker", ""), self.state, self.config.address, self.started_ms, len(self._json("catalog.json", {})))
        return self.spark.createDataFrame([row], "cluster_id string, broker_id string, state string, address string, started_ms long, n_topics int")

    # Metadata

    def _json(self, name: str, default):
        text = read_text(self.spark, f"{self.root}/{name}")
        return default if text is None else json.loads(text)

    def _save(self, name: str, value) -> None:
        replace_text(self.spark, f"{self.root}/{name}", json.dumps(value, sort_keys=True))

    def _lock(self, topic: str) -> threading.Lock:
        with self._guard:
            return self._locks.setdefault(topic, threading.Lock())

    def _log(self, topic: str) -> TableLog:
        return TableLog(self.spark, self.root, topic)

    def _check(self, *columns) -> list[str | None]:
        return list(self.spark.range(1).select(*columns).first())

    def _found(self, topic: str, partition: int = 0) -> tuple[M.Topic, TableLog]:
        stored = self._json("catalog.json", {}).get(topic)
        if stored is None:
            raise E.NotFound(f"topic {topic!r} not found")
        if not 0 <= partition < stored["partitions"]:
            raise E.NotFound(f"partition {partition} of {topic!r} not found")
        return M.Topic(topic, stored["partitions"], M.TopicConfig(**stored["config"]), stored["created_ms"]), self._log(topic)

    # Topics

    def create_topic(self, name: str, config: M.TopicConfig = M.TopicConfig(), partitions: int = 1) -> M.Topic:
        self._running()
        given = [F.lit(x) for x in (partitions, config.max_message_bytes, config.retention_ms, config.retention_bytes, config.cleanup, config.replication)]
        bad_name, bad_config = self._check(checks.topic_name_error(F.lit(name)), checks.config_error(*given))
        if bad_name:
            raise E.InvalidTopic(f"{bad_name}: {name!r}")
        if bad_config:
            raise E.InvalidTopic(bad_config)
        config = M.TopicConfig(config.max_message_bytes or M.DEFAULT_MESSAGE_BYTES, config.retention_ms, config.retention_bytes, config.cleanup or "delete", config.replication or 1)
        with self._guard:
            catalog = self._json("catalog.json", {})
            if name in catalog:
                raise E.AlreadyExists(f"topic {name!r} already exists")
            topic = M.Topic(name, partitions, config, self.clock())
            catalog[name] = {"partitions": partitions, "created_ms": topic.created_ms, "config": vars(config)}
            self._log(name).create()
            self._save("catalog.json", catalog)
        logger.info("created topic %s", name)
        return topic

    def delete_topic(self, name: str) -> None:
        """Remove a topic, its log and its cursors."""
        self._running()
        with self._lock(name), self._guard:
            catalog = self._json("catalog.json", {})
            if name not in catalog:
                raise E.NotFound(f"topic {name!r} not found")
            del catalog[name]
            self._save("catalog.json", catalog)
            for consumer, _ in listed(self.spark, f"{self.root}/cursors"):
                fs, where = file_system(self.spark, f"{self.root}/cursors/{consumer}/{name}.json")
                fs.delete(where, False)
            self._log(name).drop()
        logger.info("deleted topic %s", name)

    def topics(self, prefix: str = "") -> DataFrame:
        """The catalog by name: topics whose names begin with prefix."""
        rows = [(n, t["partitions"], t["created_ms"], *(t["config"][k] for k in ("max_message_bytes", "retention_ms", "retention_bytes", "cleanup", "replication"))) for n, t in self._json("catalog.json", {}).items() if n.startswith(prefix)]
        schema = "name string, partitions int, created_ms long, max_message_bytes long, retention_ms long, retention_bytes long, cleanup string, replication int"
        return self.spark.createDataFrame(rows, schema).orderBy("name")

    # Publishing

    def publish(self, topic: str, messages: DataFrame | Iterable[Mapping], partition: int = 0, order: list[str] | None = None) -> tuple[int, int]:
        """Append messages as one batch; returns its first offset and the one after its last.

        Columns that messages lack have their defaults. A DataFrame gets offsets in the order of the
        given columns, which must tell its rows apart; a list in its own order. One bad message
        rejects all.
        """
        self._running()
        found, table = self._found(topic, partition)
        if not isinstance(messages, DataFrame):
            listed = [dict(m) for m in messages]
            if not listed:
                raise E.InvalidMessage("empty batch")
            messages, order = self._listed(listed), ["_place"]
        elif not order:
            raise E.InvalidArgument("order columns say how the rows of a DataFrame are numbered")
        rows = messages.select(*[F.col(c) for c in order if c not in M.MESSAGE_DEFAULTS], *[self._field(messages, c, d) for c, d in M.MESSAGE_DEFAULTS.items()])
        bad_id = F.when((F.col("event_id") != "") & ~frames.ulid_ok(F.col("event_id")), "invalid_event_id")
        code = F.coalesce(checks.message_error(F.col("payload"), F.col("key"), F.col("headers"), found.config.max_message_bytes), bad_id)
        n, bad = rows.agg(F.count("*"), F.min(code)).first()
        if not n:
            raise E.InvalidMessage("empty batch")
        if bad:
            raise E.InvalidMessage(bad)
        with self._lock(topic):
            base, end, size = self._retried(lambda: self._append(found, table, rows, order, partition))
        self._count(topic, published_records=n, published_bytes=size, published_batches=1)
        return base, end

    @staticmethod
    def _retried(write: Callable):
        """The result of write, which is tried again if another engine commits first."""
        for _ in range(ATTEMPTS - 1):
            try:
                return write()
            except Conflict:
                logger.info("another engine committed first; trying again")
        return write()

    def _append(self, found: M.Topic, table: TableLog, rows: DataFrame, order: list[str], partition: int) -> tuple[int, int, int]:
        topic = found.name
        manifest = table.manifest() or Manifest()
        now = self.clock()
        base = manifest.leo
        rows = ops.assign_offsets(rows.withColumn("topic", F.lit(topic)), order, F.lit(0), next_offset=F.lit(base)) if order == ["_place"] else self._numbered(rows, topic, order, base)
        given_id = F.when(F.col("event_id") == "", frames.ulid(F.lit(now), F.concat_ws(":", "topic", F.col("offset").cast("string")))).otherwise(F.upper("event_id"))
        rows = rows.withColumns({"event_id": given_id, "timestamp_ms": F.lit(now), "partition": F.lit(partition), "batch_base": F.lit(base)})
        fields = {c: F.col(c) for c in M.SYSTEM_FIELDS}
        rows = rows.withColumn("frame_bytes", frames.record_bytes(F.col("key"), F.col("payload"), F.col("headers"), fields)).withColumn("segment_base", F.lit(0).cast("long"))
        names = [c.split()[0] for c in M.LOG_SCHEMA.split(", ")]
        staged = table.stage(rows.select(*names).sortWithinPartitions("offset"))
        n, size = self.spark.read.parquet(staged).agg(F.count("*"), F.sum("frame_bytes")).first()
        size += frames.BATCH_HEADER
        active = manifest.segments[-1] if manifest.segments else None
        if active is None or active.bytes > 0 and active.bytes + size > self.config.segment_bytes:
            active = Segment(base, base, 0, 0)
            manifest.segments.append(active)
        active.paths.append(table.publish(staged, active.base, base))
        active.batches.append([base, base + n, size, now])
        active.next_offset, active.bytes, active.last_timestamp_ms = base + n, active.bytes + size, now
        manifest.leo = base + n
        table.commit(manifest)
        self._announce(table, base, base + n, manifest.number)
        return base, base + n, size

    def _announce(self, table: TableLog, base: int, end: int, number: int) -> None:
        """Tell streams of a commit. It stands even if that fails; the next one's entry, or that of the next start, then tells of it."""
        try:
            table.announce(self._untold.get(table.topic, base), end, number)
            self._untold.pop(table.topic, None)
        except Exception:
            self._untold.setdefault(table.topic, base)
            logger.exception("topic %s: the feed lacks offsets from %d on", table.topic, self._untold[table.topic])

    def _listed(self, listed: list[dict]) -> DataFrame:
        kinds = {"headers": "map<string,string>", "payload": "binary", "retry_count": "int", "priority": "int", "schema_version": "int", "ttl_ms": "long"}
        if unknown := {k for m in listed for k in m} - set(M.MESSAGE_DEFAULTS):
            raise E.InvalidArgument(f"unknown fields: {', '.join(sorted(unknown))}")
        names = [c for c in M.MESSAGE_DEFAULTS if any(c in m for m in listed)]
        clean = lambda c, v: v.encode() if c == "payload" and isinstance(v, str) else v
        rows = [(i, *(clean(c, m.get(c)) for c in names)) for i, m in enumerate(listed)]
        return self.spark.createDataFrame(rows, ", ".join(["_place long", *(f"{c} {kinds.get(c, 'string')}" for c in names)]))

    @staticmethod
    def _field(messages: DataFrame, name: str, default: str):
        if name not in messages.columns:
            return F.expr(default).alias(name)
        column = messages[name].cast("binary") if name == "payload" else messages[name]
        return F.coalesce(column, F.expr(default)).alias(name)

    def _numbered(self, rows: DataFrame, topic: str, order: list[str], base: int) -> DataFrame:
        """Offsets for a large DataFrame: blocks by quantiles of the first order column, if it is a number."""
        first = rows.schema[order[0]].dataType.typeName()
        rows, block = rows.withColumn("topic", F.lit(topic)), F.lit(0)
        if first in ("long", "integer", "short", "byte"):
            n = max(2, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
            bounds = sorted(set(rows.agg(F.percentile_approx(order[0], [i / n for i in range(1, n)], 10 * n)).first()[0] or []))
            block = F.size(F.filter(F.array(*[F.lit(b).cast("long") for b in bounds]), lambda b: b < F.col(order[0])))
        return ops.assign_offsets(rows, order, block, next_offset=F.lit(base))

    # Reading

    def leo(self, topic: str) -> int:
        return (self._found(topic)[1].manifest() or Manifest()).leo

    def read(self, topic: str, start: int = 0, limit: int = 0, max_bytes: int = 0) -> DataFrame:
        """A snapshot of the records from start on by offset: at most limit, and none beyond max_bytes of payload but the first."""
        self._running()
        _, table = self._found(topic)
        if start < 0:
            raise E.OutOfRange("negative offset")
        return self._bounded(table.read(start), start, limit, max_bytes)

    @staticmethod
    def _bounded(rows: DataFrame, start: int, limit: int, max_bytes: int) -> DataFrame:
        rows = rows.orderBy("offset").limit(limit) if limit > 0 else rows  # the first of each task, then of those
        return ops.read_bounded(rows, start, 0, max_bytes).orderBy("offset")

    def start_position(self, topic: str, consumer: str = "", start: int | None = None) -> int:
        """Explicit start, else the stored cursor, else 0; beyond the end is out of range."""
        position = start if start is not None else self._json(f"cursors/{consumer}/{topic}.json", 0) if consumer else 0
        if position < 0 or position > self.leo(topic):
            raise E.OutOfRange(f"offset {position} is outside the log of {topic!r}")
        return position

    def subscribe(self, topic: str, emit: Callable[[DataFrame, int], None], checkpoint: str, consumer: str = "", start: int | None = None, follow: bool = False):
        """Deliver committed records in order, in chunks of read_limit records and read_max_bytes; returns the streaming query.

        emit gets each chunk, ordered by offset, and its number.
        """
        self._running()
        self._consumer(consumer, optional=True)
        _, table = self._found(topic)
        position = self.start_position(topic, consumer, start)

        def snapshot() -> Callable[[int, int], DataFrame]:
            manifest = table.manifest() or Manifest()
            return lambda a, b: table.read(a, manifest, b)

        def chunks(at: int, end: int) -> Iterator[DataFrame]:
            for rows, n in streams.chunks(snapshot, at, end, self.config.read_limit, self.config.read_max_bytes):
                self._count(topic, delivered_records=n, delivered_chunks=1)
                yield rows

        feed = self.spark.readStream.schema("base long, end long").option("ignoreMissingFiles", "true").json(f"{table.path}/feed")
        return streams.deliver(feed, chunks, emit, checkpoint, position, follow)

    def subscribe_each(self, topic: str, emit: Callable[[Row], None], checkpoint: str, consumer: str = "", start: int | None = None, follow: bool = False):
        """Like subscribe, with one record at a time; an error that emit raises ends the query, which begins with that chunk again."""

        def every(rows: DataFrame, _: int) -> None:
            for row in rows.toLocalIterator():
                emit(row)

        return self.subscribe(topic, every, checkpoint, consumer, start, follow)

    # Cursors

    def cursors(self, prefix: str = "") -> DataFrame:
        """Stored cursors (consumer, topic, next offset) of consumers whose names begin with prefix."""
        names = [c for c, _ in listed(self.spark, f"{self.root}/cursors") if c.startswith(prefix)]
        rows = [(c, f.removesuffix(".json"), self._json(f"cursors/{c}/{f}", 0)) for c in names for f, _ in listed(self.spark, f"{self.root}/cursors/{c}")]
        return self.spark.createDataFrame(rows, "consumer string, topic string, next_offset long").orderBy("consumer", "topic")

    def _consumer(self, name: str, optional: bool = False) -> None:
        if optional and not name:
            return
        if self._check(checks.consumer_name_error(F.lit(name)))[0]:
            raise E.InvalidConsumer(f"invalid consumer name {name!r}")

    def ack(self, consumer: str, topic: str, offset: int, partition: int = 0) -> int:
        """Store the next offset to consume; a cursor never goes back. Returns the cursor."""
        self._running()
        self._consumer(consumer)
        self._found(topic, partition)
        if offset < 0:
            raise E.InvalidMessage("negative offset")
        with self._lock(f"{consumer}/{topic}"):
            name = f"cursors/{consumer}/{topic}.json"
            stored = self._json(name, None)
            if stored is None or offset > stored:
                self._save(name, offset)
                stored = offset
        self._count(topic, acks=1)
        return stored

    # Maintenance

    def trim(self, topic: str, now_ms: int | None = None) -> M.TrimResult:
        """Drop sealed segments by age, then by size."""
        self._running()
        found, table = self._found(topic)
        now = self.clock() if now_ms is None else now_ms
        def run() -> M.TrimResult:
            manifest = table.manifest() or Manifest()
            segments, age, limit = manifest.segments, found.config.retention_ms, found.config.retention_bytes
            cut = 0
            while age > 0 and cut < len(segments) - 1 and segments[cut].last_timestamp_ms < now - age:
                cut += 1
            total = sum(s.bytes for s in segments[cut:])
            while limit > 0 and cut < len(segments) - 1 and total > limit:
                total -= segments[cut].bytes
                cut += 1
            gone, manifest.segments = segments[:cut], segments[cut:]
            if gone:
                manifest.log_start = manifest.segments[0].base
                self._drop(table, manifest, gone)
                table.commit(manifest)
            return M.TrimResult(len(gone), sum(s.bytes for s in gone))

        with self._lock(topic):
            done = self._retried(run)
        if done.segments:
            self._count(topic, trimmed_segments=done.segments, trimmed_bytes=done.bytes)
            logger.info("topic %s: trimmed %d segments of %d bytes", topic, done.segments, done.bytes)
        return done

    def _drop(self, table: TableLog, manifest: Manifest, segments: list[Segment]) -> None:
        """Note what the manifest no longer names; readers of older manifests may still need it."""
        manifest.gone += [[p, self.clock()] for s in segments for p in [*table.load(s).paths, *([s.listed] if s.listed else [])]]

    def collect(self, topic: str) -> list[str]:
        """Delete what was dropped, or written and never committed, longer ago than grace_ms."""
        self._running()
        _, table = self._found(topic)
        with self._lock(topic):
            return self._retried(lambda: table.collect(self.clock(), self.config.grace_ms))

    def sweep(self, now_ms: int | None = None) -> dict[str, M.TrimResult | str]:
        """Trim every topic with the delete policy and a limit; one topic's failure doesn't stop the others."""
        out: dict[str, M.TrimResult | str] = {}
        eligible = self.topics().filter(checks.sweepable(F.col("cleanup"), F.col("retention_ms"), F.col("retention_bytes")))
        for row in eligible.select("name").toLocalIterator():
            try:
                out[row["name"]] = self.trim(row["name"], now_ms)
                self.collect(row["name"])
            except Exception as error:  # reported, and the sweep goes on
                logger.warning("sweep of topic %s failed: %s", row["name"], error)
                out[row["name"]] = str(error)
        return out

    def truncate(self, topic: str, to: int) -> int:
        """Drop batches that begin at `to` or later; returns the new end of the log."""
        self._running()
        if to < 0:
            raise E.OutOfRange("negative offset")
        _, table = self._found(topic)
        def run() -> int:
            manifest = table.manifest() or Manifest()
            if to >= manifest.leo:
                return manifest.leo
            gone, kept = [], []
            for s in map(table.load, manifest.segments):
                stay = [i for i, b in enumerate(s.batches) if b[0] < to]
                if len(stay) == len(s.batches):
                    kept.append(s)
                    continue
                gone.append(Segment(s.base, s.next_offset, 0, 0, [p for i, p in enumerate(s.paths) if i not in set(stay)], listed=s.listed))
                if stay:
                    batches = [s.batches[i] for i in stay]
                    kept.append(Segment(s.base, batches[-1][1], sum(b[2] for b in batches), batches[-1][3], [s.paths[i] for i in stay], batches))
            manifest.segments, manifest.leo = kept, kept[-1].next_offset if kept else manifest.log_start
            self._drop(table, manifest, gone)
            table.commit(manifest)
            table.forget(manifest.leo)
            return manifest.leo

        with self._lock(topic):
            return self._retried(run)

    def compact(self, topic: str, least_gain: float = 0.1, most_segments: int = 4) -> int:
        """Rewrite sealed segments of a topic with the compact policy, keeping each key's last record; returns records removed.

        The oldest segments that would lose least_gain of their bytes or more are rewritten, most_segments of them at a time, each for
        itself; those that lose all records go. Offsets stay, so reads see holes. The last segment isn't rewritten.
        """
        self._running()
        found, table = self._found(topic)
        if found.config.cleanup != "compact":
            raise E.InvalidArgument(f"topic {topic!r} isn't compacted")

        def run() -> int:
            manifest = table.manifest() or Manifest()
            sealed = manifest.segments[:-1]
            if not sealed:
                return 0
            active = manifest.segments[-1].base
            every = table.read(manifest.log_start, manifest).withColumn("_segment", F.regexp_extract(F.input_file_name(), r"segment=(\d{20})", 1).cast("long"))
            kept = ops.compact(every, F.lit(active)).filter(F.col("offset") < active)
            sums = lambda rows: {r["_segment"]: r for r in rows.groupBy("_segment").agg(F.count("*").alias("n"), F.sum("frame_bytes").alias("size"), F.max_by("timestamp_ms", "offset").alias("last")).collect()}
            before, after = sums(every.filter(F.col("offset") < active)), sums(kept)  # a row a segment
            size = lambda of, s: of[s.base]["size"] if s.base in of else 0
            chosen = [s for s in sealed if size(after, s) < size(before, s) and size(after, s) <= (1 - least_gain) * size(before, s)][:most_segments]
            if not chosen:
                return 0
            bases = [s.base for s in chosen]
            staged = table.stage(kept.filter(F.col("_segment").isin(bases)), "_segment")
            rewritten, removed = {}, 0
            for s in chosen:
                removed += before[s.base]["n"] - (after[s.base]["n"] if s.base in after else 0)
                if s.base in after:
                    path = table.publish(f"{staged}/_segment={s.base}", s.base, s.base)
                    last = after[s.base]["last"]
                    rewritten[s.base] = Segment(s.base, s.next_offset, size(after, s), last, [path], [[s.base, s.next_offset, size(after, s), last]])
            manifest.segments = [rewritten.get(s.base) if s.base in bases else s for s in manifest.segments]
            manifest.segments = [s for s in manifest.segments if s is not None]
            self._drop(table, manifest, chosen)
            table.commit(manifest)
            return removed

        with self._lock(topic):
            removed = self._retried(run)
        self._count(topic, compacted_records=removed)
        return removed

    def verify(self, topic: str) -> DataFrame:
        """Records, gaps and missing records between the first and the last offset."""
        return ops.gaps(self._found(topic)[1].read())


