"""The engine end to end: publish, read, resume, follow, retention, truncation, compaction, restart."""

import io
import os
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from strandlog import errors as E
from strandlog import model as M
from strandlog.cli import run
from strandlog.config import Config, load
from strandlog.engine import Engine
from strandlog.plans import catalogue
from strandlog.sources.table_log import Conflict, TableLog
from strandlog.streaming import follow


class Clock:
    now = 1_700_000_000_000

    def __call__(self):
        return self.now


@pytest.fixture
def clock():
    return Clock()


@pytest.fixture
def engine(spark, tmp_path, clock):
    return Engine(spark, str(tmp_path / "data"), Config(segment_bytes=600), clock).start()


def offsets(df):
    return [r["offset"] for r in df.orderBy("offset").collect()]


def test_publish_and_read(engine, clock):
    engine.create_topic("t")
    assert engine.publish("t", [{"key": "a", "payload": "one"}, {"payload": b"two", "headers": {"h": "v"}}]) == (0, 2)
    clock.now += 5
    assert engine.publish("t", [{"payload": "three", "event_id": "01arz3ndektsv4rrffq69g5fav"}]) == (2, 3)
    rows = engine.read("t").orderBy("offset").collect()
    assert [bytes(r["payload"]) for r in rows] == [b"one", b"two", b"three"] and [r["batch_base"] for r in rows] == [0, 0, 2]
    assert rows[0]["timestamp_ms"] == rows[1]["timestamp_ms"] == clock.now - 5 and rows[2]["event_id"] == "01ARZ3NDEKTSV4RRFFQ69G5FAV" and len(rows[0]["event_id"]) == 26
    assert offsets(engine.read("t", 1, 1)) == [1] and offsets(engine.read("t", 3)) == [] and offsets(engine.read("t", 0, 0, 4)) == [0]
    assert engine.verify("t").first()[1:] == (3, 0, 0)


def test_bad_publishes_append_nothing(engine):
    engine.create_topic("t", M.TopicConfig(max_message_bytes=4))
    for messages, error in (([], E.InvalidMessage), ([{"payload": "ok"}, {"payload": "longer"}], E.InvalidMessage), ([{"event_id": "x"}], E.InvalidMessage), ([{"nope": 1}], E.InvalidArgument)):
        with pytest.raises(error):
            engine.publish("t", messages)
    with pytest.raises(E.NotFound):
        engine.publish("missing", [{"payload": ""}])
    with pytest.raises(E.NotFound):
        engine.publish("t", [{"payload": ""}], partition=1)
    assert engine.leo("t") == 0


def test_publish_a_frame(engine, spark):
    engine.create_topic("t")
    df = spark.range(50).select("id", F.col("id").cast("string").alias("payload"))
    with pytest.raises(E.InvalidArgument):
        engine.publish("t", df)
    engine.publish("t", [{"payload": "x"}])
    assert engine.publish("t", df, order=["id"]) == (1, 51)
    assert engine.read("t", 1).filter("cast(cast(payload as string) as long) <> offset - 1").count() == 0


def test_topics(engine):
    engine.create_topic("b")
    engine.create_topic("a", M.TopicConfig(0, 5, 6, "", 0))
    assert [r["name"] for r in engine.topics().collect()] == ["a", "b"]
    assert engine.topics().first()[3:] == (M.DEFAULT_MESSAGE_BYTES, 5, 6, "delete", 1)
    for name, config, partitions, error in (("a", M.TopicConfig(), 1, E.AlreadyExists), ("__x", M.TopicConfig(), 1, E.InvalidTopic), ("c", M.TopicConfig(-1), 1, E.InvalidTopic), ("c", M.TopicConfig(), 2, E.InvalidTopic)):
        with pytest.raises(error):
            engine.create_topic(name, config, partitions)
    engine.publish("a", [{"payload": ""}])
    engine.ack("me", "a", 1)
    engine.delete_topic("a")
    with pytest.raises(E.NotFound):
        engine.read("a")
    engine.create_topic("a")
    assert engine.start_position("a", "me") == 0 and engine.info().first()["n_topics"] == 2


def test_cursors(engine):
    engine.create_topic("t")
    engine.publish("t", [{"payload": str(i)} for i in range(5)])
    assert [engine.ack("c", "t", o) for o in (0, 3, 2, 3)] == [0, 3, 3, 3]
    assert engine.start_position("t", "c") == 3 and engine.start_position("t", "c", 1) == 1 and engine.start_position("t") == 0 and engine.start_position("t", "new") == 0
    engine.ack("c", "t", 99)
    for consumer, start in (("c", None), ("", 6), ("", -1)):
        with pytest.raises(E.OutOfRange):
            engine.start_position("t", consumer, start)
    with pytest.raises(E.InvalidMessage):
        engine.ack("c", "t", -1)
    with pytest.raises(E.InvalidConsumer):
        engine.ack("a/b", "t", 1)


def test_rotation_and_trim(engine, clock):
    engine.create_topic("t", M.TopicConfig(retention_ms=1000, retention_bytes=100_000))
    for i in range(6):
        engine.publish("t", [{"payload": "x" * 150}])
        clock.now += 600
    segments = engine._log("t").manifest().segments
    assert [s.base for s in segments] == [0, 2, 4] and all(s.bytes <= 600 for s in segments)
    done = engine.trim("t")
    assert (done.segments, done.bytes) == (2, sum(s.bytes for s in segments[:2])) and offsets(engine.read("t")) == [4, 5] and engine.leo("t") == 6
    assert engine.sweep()["t"] == M.TrimResult(0, 0)
    assert engine.publish("t", [{"payload": "y"}]) == (6, 7)


def test_trim_by_size_spares_the_active_segment(engine):
    engine.create_topic("t", M.TopicConfig(retention_bytes=1))
    for _ in range(4):
        engine.publish("t", [{"payload": "x" * 500}])
    assert engine.trim("t").segments == 3 and offsets(engine.read("t")) == [3]


def test_truncate(engine):
    engine.create_topic("t")
    for n in (2, 2, 1):
        engine.publish("t", [{"payload": "p"}] * n)
    assert engine.truncate("t", 9) == 5 and engine.truncate("t", 3) == 4 and offsets(engine.read("t")) == [0, 1, 2, 3]
    assert engine.truncate("t", 2) == 2 and engine.publish("t", [{"payload": "q"}]) == (2, 3)
    with pytest.raises(E.OutOfRange):
        engine.truncate("t", -1)


def test_compact(engine):
    engine.create_topic("t", M.TopicConfig(cleanup="compact"))
    for k in "abab":
        engine.publish("t", [{"key": k, "payload": "x" * 300}])
    engine.publish("t", [{"key": "a", "payload": "x" * 300}])
    assert engine.compact("t") == 3 and offsets(engine.read("t")) == [3, 4] and engine.leo("t") == 5
    engine.create_topic("d")
    with pytest.raises(E.InvalidArgument):
        engine.compact("d")


def test_follow_resumes_where_it_stopped(engine, tmp_path):
    engine.create_topic("t")
    engine.publish("t", [{"payload": str(i)} for i in range(4)])
    got = []
    go = lambda: engine.subscribe("t", lambda rows, _: got.extend(offsets(rows)), str(tmp_path / "progress"), start=1).awaitTermination()
    go()
    assert got == [1, 2, 3]
    engine.publish("t", [{"payload": "new"}])
    go()
    assert got == [1, 2, 3, 4]


def test_restart_and_lifecycle(engine, spark, clock):
    engine.create_topic("t")
    engine.publish("t", [{"payload": "kept"}])
    engine._log("t").stage(engine.read("t"))  # a write that never was committed
    who = engine.identity
    engine.stop()
    with pytest.raises(E.NotRunning):
        engine.read("t")
    again = Engine(spark, engine.root, engine.config, clock).start()
    assert again.identity == who and offsets(again.read("t")) == [0] and again.publish("t", [{"payload": "next"}]) == (1, 2)
    again._log("t").drop()
    assert Engine(spark, engine.root, engine.config, clock).start().leo("t") == 0
    with pytest.raises(E.LogError):
        again._to("starting")


def test_command_line(spark, tmp_path, capsys):
    def do(*args):
        out = io.StringIO()
        code = run(["--data-dir", str(tmp_path / "d"), *args], spark, out)
        return code, out.getvalue().splitlines()

    assert do("topics", "create", "t", "--retention", "1h") == (0, ["t"]) and do("topics", "list") == (0, ["t"])
    assert do("publish", "t", "-m", "one", "-m", "two") == (0, ["0 1"])
    code, lines = do("subscribe", "t", "--start", "1")
    assert code == 0 and lines[0].split("\t")[::2] == ["1", "two"]
    assert do("ack", "c", "t", "1") == (0, ["1"]) and do("subscribe", "t", "--consumer", "c")[1][0].startswith("1\t")
    assert do("topics", "delete", "nope")[0] == 1 and "NotFound" in capsys.readouterr().err
    assert dict(line.split("\t") for line in do("info")[1])["n_topics"] == "1"
    code, lines = do("subscribe", "t", "--follow", "--timeout", "8s")
    assert code == 0 and [x.split("\t")[::2] for x in lines] == [["0", "one"], ["1", "two"]]


def test_delivery_in_bounded_ordered_chunks(engine, tmp_path):
    engine.config = Config(segment_bytes=600, read_limit=3, read_max_bytes=20)
    engine.create_topic("t")
    engine.publish("t", [{"payload": "x" * 4}] * 5)
    engine.publish("t", [{"payload": "y" * 30}, {"payload": "z" * 15}, {"payload": "z" * 5}, {"payload": "z"}])
    got = []
    engine.subscribe("t", lambda rows, i: got.append((i, [r["offset"] for r in rows.collect()])), str(tmp_path / "p")).awaitTermination()
    assert got == [(0, [0, 1, 2]), (1, [3, 4]), (2, [5]), (3, [6, 7]), (4, [8])]
    assert {r["name"]: r["value"] for r in engine.metrics().collect() if r["name"].startswith("delivered")} == {"delivered_records": 9, "delivered_chunks": 5}


def test_many_chunks_are_fetched_at_a_time(engine, tmp_path, monkeypatch):
    engine.config = Config(read_limit=5, read_max_bytes=20)
    engine.create_topic("t")
    sizes = [n % 7 + (30 if n % 23 == 0 else 0) for n in range(200)]
    engine.publish("t", [{"payload": "x" * n, "headers": {"h": str(n)}} for n in sizes])
    want, at = [], 0
    while at < len(sizes):
        to = at + 1
        while to < len(sizes) and to - at < 5 and sum(sizes[at : to + 1]) <= 20:
            to += 1
        want.append(list(range(at, to)))
        at = to
    reads, read = [], TableLog.read
    monkeypatch.setattr(TableLog, "read", lambda *a, **b: (reads.append(1), read(*a, **b))[1])

    def deliver(name):
        got = []
        reads.clear()
        engine.subscribe("t", lambda rows, i: got.append((i, [(r["offset"], len(r["payload"]), r["headers"]) for r in rows.collect()])), str(tmp_path / name)).awaitTermination()
        return got

    every = [(i, [(o, sizes[o], {"h": str(sizes[o])}) for o in c]) for i, c in enumerate(want)]
    assert len(want) > 40 and deliver("p") == every and len(reads) < 5
    monkeypatch.setattr(follow, "SIZED", 17)
    monkeypatch.setattr(follow, "FETCHED", 700)
    assert deliver("q") == every
    monkeypatch.setattr(follow, "FETCHED", 1)
    assert deliver("r") == every


def test_delivered_chunks_go_by_time(spark, tmp_path):
    n = 3000
    rows = spark.range(n).select(
        F.col("id").alias("event_id"), F.timestamp_seconds(1_700_000_000 + (F.col("id") * 7919) % 1000).alias("ts"), F.lit("a").alias("event_type"),
        F.col("id").alias("user_id"), F.lit(1.0).alias("value"), F.repeat(F.lit("x"), (F.col("id") % 40).cast("int")).alias("props"),
    )
    rows.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    db = duckdb.connect()
    db.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = db.sql(catalogue.oracle_sql()["delivered_chunks"]).fetchall()
    assert len(want) > 2 and sorted(tuple(r) for r in catalogue.queries()["delivered_chunks"](spark, str(tmp_path)).collect()) == sorted(want)


def test_what_was_not_committed_is_not_delivered(engine, spark, tmp_path, monkeypatch):
    engine.create_topic("t")
    engine.publish("t", [{"payload": "a"}] * 2)
    got = []
    go = lambda e: e.subscribe("t", lambda rows, _: got.extend((r["offset"], bytes(r["payload"])) for r in rows.collect()), str(tmp_path / "p")).awaitTermination()
    commit = TableLog.commit

    def fail(*_):
        raise OSError("no space")

    monkeypatch.setattr(TableLog, "commit", fail)
    with pytest.raises(OSError):
        engine.publish("t", [{"payload": "lost"}])
    monkeypatch.setattr(TableLog, "commit", commit)
    go(engine)
    assert got == [(0, b"a"), (1, b"a")] and engine.leo("t") == 2
    engine.publish("t", [{"payload": "b"}])
    go(engine)
    assert got[2:] == [(2, b"b")]
    # The batch whose commit failed goes at the next start, once the grace time is over.
    left = lambda: sum(len(files) for _, _, files in os.walk(tmp_path / "data/topics/t/segment=00000000000000000000"))
    before = left()
    again = Engine(spark, engine.root, Config(segment_bytes=600, grace_ms=0), lambda: int(time.time() * 1000) + 1).start()
    assert left() < before and offsets(again.read("t")) == [0, 1, 2]


def test_a_commit_the_feed_missed_is_delivered_after_a_restart(engine, spark, tmp_path, monkeypatch, clock):
    engine.create_topic("t")
    monkeypatch.setattr(TableLog, "announce", lambda *_: None)
    engine.publish("t", [{"payload": "a"}] * 3)
    monkeypatch.undo()
    got = []
    again = Engine(spark, engine.root, engine.config, clock).start()
    again.subscribe("t", lambda rows, _: got.extend(offsets(rows)), str(tmp_path / "p")).awaitTermination()
    assert got == [0, 1, 2]


def test_compaction_does_not_deliver_again(engine, tmp_path):
    engine.create_topic("t", M.TopicConfig(cleanup="compact"))
    for k in "abab":
        engine.publish("t", [{"key": k, "payload": "x" * 300}])
    got = []
    go = lambda path: engine.subscribe("t", lambda rows, _: got.extend(offsets(rows)), str(tmp_path / path)).awaitTermination()
    go("p")
    engine.compact("t")
    go("p")
    assert got == [0, 1, 2, 3]
    engine.publish("t", [{"key": "a", "payload": ""}])
    go("p")
    assert got == [0, 1, 2, 3, 4]
    got.clear()
    go("other")
    assert got == [2, 3, 4]


def test_limits_count_records_not_offsets(engine):
    engine.create_topic("t", M.TopicConfig(cleanup="compact"))
    for k in "aabaacaaad":
        engine.publish("t", [{"key": k, "payload": "x" * 200}])
    engine.publish("t", [{"key": "z", "payload": "x"}])
    engine.compact("t")
    left = [r["offset"] for r in engine.read("t").collect()]
    assert left == sorted(left) and left != list(range(left[0], left[-1] + 1))
    for limit in (1, 3, 4, 99):
        assert [r["offset"] for r in engine.read("t", 0, limit).collect()] == left[:limit]
        assert [r["offset"] for r in engine.read("t", 3, limit, 450).collect()] == [o for o in left if o >= 3][: min(limit, 2)]


def test_readers_of_older_manifests_go_on(engine, clock):
    engine.create_topic("t", M.TopicConfig(retention_ms=1000))
    for _ in range(6):
        engine.publish("t", [{"payload": "x" * 150}])
        clock.now += 600
    snapshot = engine.read("t")
    assert engine.trim("t").segments == 2 and engine.collect("t") == [] and offsets(snapshot) == [0, 1, 2, 3, 4, 5]
    clock.now += 3_600_000
    assert engine.collect("t") and offsets(engine.read("t")) == [4, 5] and engine.collect("t") == []


def test_two_engines_on_one_directory(engine, spark, clock):
    engine.create_topic("t")
    other = Engine(spark, engine.root, engine.config, clock).start()
    table = other._log("t")
    seen = table.manifest()
    engine.publish("t", [{"payload": "a"}])
    with pytest.raises(Conflict):
        table.commit(seen)
    real, first = TableLog.manifest, [seen]
    try:
        TableLog.manifest = lambda self: first.pop() if first else real(self)  # a manifest read before the other's commit
        assert other.publish("t", [{"payload": "b"}]) == (1, 2)
    finally:
        TableLog.manifest = real
    assert [bytes(r["payload"]) for r in engine.read("t").collect()] == [b"a", b"b"]


def test_retention_loop_health_and_metrics(engine, clock):
    assert engine.health() == (True, "running")
    engine.create_topic("t", M.TopicConfig(retention_ms=1000))
    for _ in range(4):
        engine.publish("t", [{"payload": "x" * 300}])
        clock.now += 2000
    engine.config = Config(segment_bytes=600, retention_interval_ms=50)
    engine.watch()
    until = time.time() + 20
    while engine._log("t").manifest().log_start < 3 and time.time() < until:
        time.sleep(0.1)
    engine.ack("c", "t", 1)
    counts = {r["name"]: r["value"] for r in engine.metrics().collect()}
    assert (counts["published_records"], counts["published_batches"], counts["trimmed_segments"], counts["acks"]) == (4, 4, 3, 1)
    engine.stop()
    assert engine.health() == (False, "stopped") and not engine._ticker.is_alive()


def test_compaction_by_gain_and_number_of_segments(engine):
    engine.create_topic("t", M.TopicConfig(cleanup="compact"))
    for k in "abcdefghij":  # a segment each
        engine.publish("t", [{"key": k, "payload": "x" * 400}])
    engine.publish("t", [{"key": k, "payload": "y"} for k in "abcde"])
    engine.publish("t", [{"key": "z", "payload": "x" * 400}])
    assert engine.compact("t") == 4 and offsets(engine.read("t"))[:2] == [4, 5]
    assert engine.compact("t") == 1 and engine.compact("t") == 0 and offsets(engine.read("t")) == [5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15]
    engine.publish("t", [{"key": "a", "payload": "x" * 400}])
    assert engine.compact("t", least_gain=0.5) == 0 and engine.compact("t", least_gain=0.1) == 1 and 10 not in offsets(engine.read("t"))


def test_tombstones(spark):
    from strandlog.operators import log

    rows = [("t", 0, "a", b"1", 10), ("t", 1, "a", None, 20), ("t", 2, "b", None, 30), ("t", 3, "", None, 1), ("t", 4, "c", None, 5), ("t", 5, "c", b"2", 6)]
    df = spark.createDataFrame(rows, "topic string, offset long, key string, payload binary, timestamp_ms long")
    assert offsets(log.compact(df)) == [1, 2, 3, 5] and offsets(log.compact(df, tombstones_before=25)) == [2, 3, 5]


def test_yaml_settings(tmp_path):
    pytest.importorskip("yaml")
    path = tmp_path / "server.yaml"
    path.write_text("listen-addr: 0.0.0.0:1\ndata-dir: /d\nmax-recv-msg-size: 5\nstorage:\n  segment-max-bytes: 7\n  retention-interval: 1m\nsubscribe:\n  read-limit: 9\n")
    config = load(str(path), {})
    assert (config.address, config.data_dir, config.segment_bytes, config.retention_interval_ms, config.read_limit) == ("0.0.0.0:1", "/d", 7, 60000, 9)


def test_records_one_by_one_and_prefixes(engine, tmp_path):
    engine.create_topic("logs.a")
    engine.create_topic("other")
    engine.publish("logs.a", [{"payload": str(i)} for i in range(5)])
    got = []

    def stop_at_three(row):
        if row["offset"] == 3 and 3 not in got:
            got.append(3)
            raise RuntimeError("not yet")
        got.append(row["offset"])

    with pytest.raises(Exception, match="not yet"):
        engine.subscribe_each("logs.a", stop_at_three, str(tmp_path / "p")).awaitTermination()
    engine.subscribe_each("logs.a", stop_at_three, str(tmp_path / "p")).awaitTermination()
    assert got == [0, 1, 2, 3, 0, 1, 2, 3, 4]  # at least once, from the chunk that failed
    engine.ack("team-1", "logs.a", 4)
    engine.ack("team-2", "other", 0)
    engine.ack("x", "other", 1)
    assert [tuple(r) for r in engine.cursors("team-").collect()] == [("team-1", "logs.a", 4), ("team-2", "other", 0)] and engine.cursors().count() == 3
    assert [r["name"] for r in engine.topics("logs.").collect()] == ["logs.a"]


def test_the_feed_after_truncation_and_failures(engine, spark, tmp_path, monkeypatch, clock):
    engine.create_topic("t")
    for k in "abc":
        engine.publish("t", [{"payload": k}] * 2)
    got = []
    go = lambda e: e.subscribe("t", lambda rows, _: got.extend((r["offset"], bytes(r["payload"]).decode()) for r in rows.collect()), str(tmp_path / "p")).awaitTermination()
    go(engine)
    engine.truncate("t", 2)
    engine.publish("t", [{"payload": "d"}])
    go(engine)
    assert got == [(0, "a"), (1, "a"), (2, "b"), (3, "b"), (4, "c"), (5, "c"), (2, "d")]
    got.clear()
    real = TableLog.announce
    monkeypatch.setattr(TableLog, "announce", lambda *_: 1 / 0)
    assert engine.publish("t", [{"payload": "e"}]) == (3, 4)  # committed, though nobody is told
    monkeypatch.setattr(TableLog, "announce", real)
    go(engine)
    assert got == []
    engine.publish("t", [{"payload": "f"}])
    go(engine)
    assert got == [(3, "e"), (4, "f")]
    engine.truncate("t", 3)
    monkeypatch.setattr(TableLog, "announce", lambda *_: 1 / 0)
    engine.publish("t", [{"payload": "g"}])
    monkeypatch.setattr(TableLog, "announce", real)
    go(Engine(spark, engine.root, engine.config, clock).start())
    assert got[2:] == [(3, "g")]
