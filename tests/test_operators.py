"""Operators on hand-made cases."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandlog import config, errors
from strandlog.functions import checks, fold, frames, scan
from strandlog.functions.fold import Cut, Marks
from strandlog.operators import cursors, log, retention, segments, stats
from strandlog.sources import codec


def make(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


# Folds


def greedy(sizes, max_bytes, limit):
    run, used, count, out = 0, 0, 0, []
    for s in sizes:
        if count and (max_bytes > 0 and used + s > max_bytes or 0 < limit <= count):
            run, used, count = run + 1, 0, 0
        used, count = used + s, count + 1
        out.append(run)
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 30), max_size=60), st.integers(0, 50), st.integers(0, 7), st.lists(st.integers(0, 60), max_size=4))
def test_runs_are_greedy_however_batches_fall(sizes, max_bytes, limit, cuts):
    cut, out = Cut(max_bytes, limit), []
    edges = sorted({0, len(sizes), *(c for c in cuts if c < len(sizes))})
    for a, b in zip(edges, edges[1:], strict=False):
        out += cut.take(np.arange(a, b), np.array(sizes[a:b], np.int64))[0].tolist()
    assert out == greedy(sizes, max_bytes, limit)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.booleans(), st.integers(1, 30)), max_size=50), st.integers(1, 40), st.integers(0, 50))
def test_marks_follow_the_interval(records, interval, at):
    segment, position, base, pos = [], [], 0, 0
    for i, (new, size) in enumerate(records):
        if new:
            base, pos = i, 0
        segment.append(base)
        position.append(pos)
        pos += size
    want, due, last = [], 0, None
    for s, p in zip(segment, position, strict=True):
        if s != last:
            due, last = 0, s
        want.append(p >= due)
        if p >= due:
            due = p + interval
    marks, got = Marks(interval), []
    for part in (slice(0, at), slice(at, None)):
        got += marks.take(np.array(segment[part], np.int64), np.array(position[part], np.int64)).tolist()
    assert got == want


def test_rotation_edges():
    run = lambda sizes, most: Cut(most).take(np.arange(len(sizes)), np.array(sizes))[1].tolist()
    assert run([5, 5, 1], 10) == [0, 0, 2] and run([50, 1, 50], 10) == [0, 1, 2] and run([0, 10], 10) == [0, 0]


# Scans and reads


def test_running_over_blocks(spark):
    rows = [(t, i, (i * 7) % 5) for t in "ab" for i in range(200)]
    df = make(spark, rows, "topic string, offset long, v long")
    out = scan.running(df, ["topic"], F.floor(F.col("offset") / 16), ["offset"], F.col("v"), "sum", "s").orderBy("topic", "offset").collect()
    for t in "ab":
        mine = [r for r in out if r["topic"] == t]
        assert [r["s"] for r in mine] == np.cumsum([r["v"] for r in mine]).tolist()
    top = scan.running(df.withColumn("v", F.when(F.col("v") > 2, F.col("v"))), ["topic"], F.floor(F.col("offset") / 16), ["offset"], F.col("v"), "max", "m")
    assert top.filter("offset = 0 and m is not null").count() == 0 and top.filter("offset = 199").select("m").first()[0] == 4


@pytest.mark.parametrize(("start", "limit", "most", "want"), [
    (0, 0, 0, [0, 1, 2, 3]), (1, 2, 0, [1, 2]), (0, 0, 12, [0]), (3, 0, 5, [3]), (4, 0, 0, []), (0, 0, 20, [0, 1]), (0, 3, 25, [0, 1]), (2, 0, 10, [2]), (9, 1, 1, []),
])
def test_bounded_read(spark, start, limit, most, want):
    rows = [("t", i, b"x" * n) for i, n in enumerate((10, 10, 10, 30))]
    df = make(spark, rows, "topic string, offset long, payload binary")
    assert sorted(r["offset"] for r in log.read_bounded(df, start, limit, most).collect()) == want


def test_truncate_keeps_the_batch(spark):
    df = make(spark, [(0, 0), (1, 0), (2, 2), (3, 2), (4, 4)], "offset long, batch_base long")
    left = lambda to: [r["offset"] for r in log.truncate(df, to).orderBy("offset").collect()]
    assert left(2) == [0, 1] and left(3) == [0, 1, 2, 3] and left(9) == [0, 1, 2, 3, 4] and left(0) == []
    with pytest.raises(ValueError):
        log.truncate(df, -1)


def test_compaction_keeps_offsets_and_keyless(spark):
    df = make(spark, [("t", 0, "a"), ("t", 1, ""), ("t", 2, "a"), ("t", 3, "b"), ("t", 4, ""), ("t", 5, "a"), ("u", 0, "a")], "topic string, offset long, key string")
    kept = lambda d: sorted((r["topic"], r["offset"]) for r in d.collect())
    assert kept(log.compact(df)) == [("t", 1), ("t", 3), ("t", 4), ("t", 5), ("u", 0)]
    assert ("t", 2) in kept(log.compact(df, F.lit(2)))
    assert [tuple(r) for r in log.gaps(log.compact(df)).orderBy("topic").collect()] == [("t", 4, 1, 1), ("u", 1, 0, 0)]


# Cursors


def test_acks_never_go_back(spark):
    df = make(spark, [("c", "t", i, a) for i, a in enumerate((5, 3, -1, 9, 9, 0))], "consumer string, topic string, offset long, ack long")
    out = cursors.ack_responses(df, ["offset"], F.floor(F.col("offset") / 2)).orderBy("offset").collect()
    assert [r["response"] for r in out] == [5, 5, None, 9, 9, 9] and [r["code"] for r in out][2] == "invalid_message"
    assert cursors.final_cursors(df).first()["cursor"] == 9


def test_start_positions(spark):
    subs = make(spark, [("t", c, s) for c, s in (("a", None), ("a", 1), ("", None), ("b", None), ("a", 6), ("a", -1), ("z", 5), ("far", None))], "topic string, consumer string, start long")
    stored = make(spark, [("a", "t", 3), ("", "t", 4), ("far", "t", 9)], "consumer string, topic string, cursor long")
    ends = make(spark, [("t", 5)], "topic string, leo long")
    out = {(r["consumer"], r["start"]): (r["position"], r["code"]) for r in cursors.start_positions(subs, stored, ends).collect()}
    assert out == {
        ("a", None): (3, "ok"), ("a", 1): (1, "ok"), ("", None): (0, "ok"), ("b", None): (0, "ok"), ("a", 6): (None, "out_of_range"), ("a", -1): (None, "invalid_offset"),
        ("z", 5): (5, "ok"), ("far", None): (None, "out_of_range"),
    }
    assert [r["lag"] for r in cursors.lag(stored, ends).orderBy("cursor").collect()] == [2, 1, 0]


# Retention


def test_retention(spark):
    rows = [("t", i * 10, i * 10 + 10, 10, 100, ts) for i, ts in enumerate((1000, 5000, 2000, 9000))]
    df = make(spark, rows, "topic string, segment_base long, next_offset long, n_records long, bytes long, last_timestamp_ms long")
    gone = lambda now, age, size: [r["segment_base"] for r in retention.marked(df, now, age, size).filter("dropped").orderBy("segment_base").collect()]
    assert gone(10000, 8000, 0) == [0] and gone(9000, 8000, 0) == [] and gone(99999, 1, 0) == [0, 10, 20]
    assert gone(0, 0, 400) == [] and gone(0, 0, 399) == [0] and gone(0, 0, 1) == [0, 10, 20] and gone(10000, 8000, 200) == [0, 10]
    assert retention.result(retention.marked(df, 10000, 8000, 200)).first()[1:] == (2, 200)
    assert segments.surviving(df, 20).count() == 2


def test_latency_is_nearest_rank(spark):
    df = make(spark, [("t", v) for v in range(1, 101)] + [("u", 7)], "topic string, ns long")
    out = {r["topic"]: r.asDict() for r in stats.latency(df, "ns", block=10).collect()}
    assert (out["t"]["p50"], out["t"]["p99"], out["t"]["p999"], out["t"]["mean"], out["t"]["max"]) == (51, 100, 100, 50, 100)
    assert out["u"]["p50"] == 7 and out["u"]["count"] == 1


# Checks, headers, names


def test_message_checks(spark):
    one = lambda payload=b"", key="", headers="map()": spark.range(1).select(checks.message_error(F.lit(payload), F.lit(key), F.expr(f"cast({headers} as map<string,string>)"), 8)).first()[0]
    assert one(b"x" * 8) is None and one(b"x" * 9) == "payload_too_large" and one(key="k" * 4096) is None and one(key="é" * 2049) == "key_too_long"
    assert one(b"x" * 9, "k" * 5000) == "payload_too_large"
    assert one(headers="map('__slog__x', '')") == "reserved_header" and one(headers="map(repeat('a', 513), '')") == "header_key_too_long"
    assert one(headers="map('a', repeat('b', 8193))") == "header_value_too_long" and one(headers="map('a', repeat('b', 8192))") is None
    many = "map_from_entries(transform(sequence(1, {}), i -> struct(string(i) as k, '' as v)))"
    assert one(headers=many.format(64)) is None and one(headers=many.format(65)) == "too_many_headers"


def test_headers_round_trip(spark):
    fields = {"event_id": F.lit("x"), "retry_count": F.lit(-3), "ttl_ms": F.lit(1 << 40), "priority": F.lit(0), "trace_id": F.lit("")}
    df = spark.range(1).select(frames.system_headers(fields).alias("h"))
    row = df.select(F.size("h"), *[frames.field_of(F.col("h"), n) for n in ("event_id", "retry_count", "ttl_ms", "priority", "trace_id")]).first()
    assert tuple(row) == (3, "x", -3, 1 << 40, 0, "")


def test_names_and_ids(spark):
    row = spark.range(1).select(
        frames.segment_name(F.lit(42)), frames.segment_base(F.lit("0" * 18 + "42")), frames.segment_base(F.lit("42")), frames.ulid(F.lit(1469918176385), F.lit("s")),
        frames.state_name(F.lit(2)), frames.state_name(F.lit(9)),
    ).first()
    assert row[0] == "0" * 18 + "42" and row[1] == 42 and row[2] is None and row[3].startswith("01ARYZ6S41") and len(row[3]) == 26 and row[4:] == ("running", "unknown")


# Frames


def test_crc32c_check_value():
    assert codec.crc32c([b"123456789"] * 40 + [b"", b"a" * 500]).tolist()[:1] == [0xE3069283]
    rows = [bytes(range(i % 256)) * 3 for i in range(60)]
    assert codec.crc32c(rows).tolist() == [int(codec.crc32c([r])[0]) for r in rows] and codec.crc32c([]).tolist() == []


records = st.lists(st.tuples(st.integers(0, 5), st.text(max_size=5), st.binary(max_size=20), st.dictionaries(st.text(min_size=1, max_size=4), st.text(max_size=4), max_size=3)), min_size=1, max_size=6)


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 1 << 40), records)
def test_frames_round_trip(base, rows):
    batch = [(base + i, 1_700_000_000_000 + ms, k, p, h) for i, (ms, k, p, h) in enumerate(rows)]
    frame = codec.encode_batch(base, batch)
    assert codec.decode_batch(frame) == (base, batch) and codec.encode_batch(base, codec.decode_batch(frame)[1]) == frame
    assert codec.frame_size(frame) == len(frame)


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=200))
def test_decoding_rubbish_fails_cleanly(data):
    with pytest.raises(codec.FrameError):
        codec.decode_batch(data)


@pytest.mark.parametrize(("change", "code"), [
    (lambda f: f[:51], "truncated"), (lambda f: b"\x02" + f[1:], "bad_magic"), (lambda f: f[:1] + b"\x09" + f[2:], "unsupported_version"),
    (lambda f: f[:3] + b"\x01" + f[4:], "unsupported_compression"), (lambda f: f[:-1], "truncated"), (lambda f: f[:60] + bytes([f[60] ^ 1]) + f[61:], "crc_mismatch"),
])
def test_damaged_frames(change, code):
    frame = codec.encode_batch(10, [(10, 5, "k", b"payload", {"a": "b"})])
    with pytest.raises(codec.FrameError, match=code):
        codec.decode_batch(change(frame))


def test_segment_scan_keeps_the_valid_prefix():
    made = [codec.encode_batch(i, [(i, 1, "", b"x" * i, {})]) for i in range(5)]
    whole = b"".join(made)
    assert codec.scan_segment(whole, 0) == (len(whole), 5, None)
    assert codec.scan_segment(whole + b"rubbish", 0) == (len(whole), 5, "truncated")
    assert codec.scan_segment(whole[:-3], 0)[:2] == (len(whole) - len(made[4]), 4)
    assert codec.scan_segment(made[0] + made[2], 0)[1:] == (1, "discontinuity")


def test_frame_bytes_are_as_computed(spark):
    df = make(spark, [("t", 0, 0, 7, "clé", b"abc", {"h": "v"}, 3)], "topic string, offset long, batch_base long, timestamp_ms long, key string, payload binary, headers map<string,string>, retry_count int")
    size = frames.record_bytes(F.col("key"), F.col("payload"), F.col("headers"), {"retry_count": F.col("retry_count")})
    row = codec.encode(df).crossJoin(df.select((size + frames.BATCH_HEADER).alias("size"))).first()
    assert len(row["frame"]) == row["size"]


def test_decode_reports_bad_frames(spark):
    df = make(spark, [("t", b"xx"), ("t", codec.encode_batch(0, [(0, 1, "", b"p", {})]))], "topic string, frame binary")
    assert sorted((r["offset"], r["code"]) for r in codec.decode(df, strict=False).na.fill({"offset": -1, "code": ""}).collect()) == [(-1, "truncated"), (0, "")]


# Configuration and errors


def test_durations():
    assert config.duration_ms("100ms") == 100 and config.duration_ms("1m30s") == 90000 and config.duration_ms("-1.5h") == -5.4e6 and config.duration_ms("0") == 0
    for bad in ("", "5", "1x", "ms", "1s 2s"):
        with pytest.raises(errors.InvalidArgument):
            config.duration_ms(bad)


def test_config_layers(tmp_path):
    path = tmp_path / "c.json"
    path.write_text('{"data-dir": "/file", "segment-bytes": 99, "sync-interval": "2s"}')
    c = config.load(str(path), {"STRANDLOG_DATA_DIR": "/env", "STRANDLOG_LOG_LEVEL": ""})
    assert (c.data_dir, c.segment_bytes, c.sync_interval_ms, c.log_level) == ("/env", 99, 2000, "info")
    with pytest.raises(errors.InvalidArgument, match="segment_bytes.*read_limit"):
        path.write_text('{"segment-bytes": 0, "read-limit": 0}')
        config.load(str(path), {})


def test_statuses():
    assert errors.status_of(errors.NotFound("x")) == ("NotFound", "x") and errors.status_of(ValueError("secret")) == ("Internal", "internal error")
    assert errors.status_of(errors.Corrupt("disk"))[0] == "Internal" and errors.status_of(TimeoutError())[0] == "DeadlineExceeded"


def test_runs_over_many_blocks(spark, monkeypatch):
    r = random.Random(6)
    rows = [(t, o, r.choice([0, 1, 3, 50, 400])) for t, n in (("a", 700), ("b", 1), ("c", 333)) for o in sorted(r.sample(range(900), n))]
    df = spark.createDataFrame(rows, "topic string, offset long, size long")
    for block in (1 << 20, 7):
        monkeypatch.setattr(fold, "RUN_BLOCK", block)
        for max_bytes, limit in ((500, 0), (0, 13), (1000, 5), (60, 100), (10**6, 0), (0, 10**6), (1, 0)):
            want = []
            for topic in "abc":
                own = [(o, s) for t, o, s in rows if t == topic]
                number, base = fold.Cut(max_bytes, limit).take(np.array([o for o, _ in own]), np.array([s for _, s in own]))
                want += [(topic, o, int(n), int(b)) for (o, _), n, b in zip(own, number, base, strict=True)]
            assert sorted(map(tuple, fold.runs(df, "size", max_bytes, limit).collect())) == want
    assert fold.runs(df.limit(0), "size", 5).count() == 0
