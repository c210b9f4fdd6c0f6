"""Native segment files: scans, recovery after crashes, checkpoints."""

import pytest

from strandlog import errors as E
from strandlog.sources import codec, native


def frames(sizes, base=0):
    """Frames of so many records each, from offset base."""
    out, at = [], base
    for n in sizes:
        out.append(codec.encode_batch(at, [(at + i, 1000 + at + i, f"k{(at + i) % 3}", b"payload %d" % (at + i), {"h": "v"}) for i in range(n)]))
        at += n
    return out, at


def put(path, data):
    """Write a file; the checksum file that Hadoop's local file system keeps beside its own goes."""
    (path.parent / f".{path.name}.crc").unlink(missing_ok=True)
    path.write_bytes(data)


@pytest.fixture
def log(tmp_path):
    """Three segments with offsets 0..5, 6..9 and 10..14."""
    for base, sizes in ((0, (2, 1, 3)), (6, (4,)), (10, (1, 1, 3))):
        (tmp_path / f"{base:020d}.log").write_bytes(b"".join(frames(sizes, base)[0]))
    (tmp_path / "notes.txt").write_text("not a segment")
    return tmp_path


def offsets(df):
    return sorted(r["offset"] for r in df.collect())


def test_scans(spark, log):
    path = str(log)
    assert [f.base for f in native.discover(spark, path)] == [0, 6, 10]
    assert offsets(native.read(spark, path)) == list(range(15)) and offsets(native.read(spark, path, 8)) == list(range(8, 15))
    assert offsets(native.read(spark, path, 1, 7)) == [1, 2, 3, 4, 5, 6] and offsets(native.read(spark, path, 99)) == []
    row = native.read(spark, path, 4, 5).first()
    assert (row["batch_base"], row["timestamp_ms"], row["key"], bytes(row["payload"]), row["headers"]) == (3, 1004, "k1", b"payload 4", {"h": "v"})
    assert native.read(spark, path + "/none").count() == 0 and native.recover(spark, path + "/none") == native.Recovered(0, [], 0, False)


def test_only_frames_of_the_range_are_decoded(spark, log):
    first = log / f"{0:020d}.log"
    data = bytearray(first.read_bytes())
    data[60] ^= 0xFF  # in the first frame, which holds 0 and 1
    put(first, data)
    assert offsets(native.read(spark, str(log), 2)) == list(range(2, 15))
    with pytest.raises(Exception, match="crc_mismatch"):
        native.read(spark, str(log)).collect()


def test_a_torn_tail_is_cut(spark, log):
    last = log / f"{10:020d}.log"
    whole = last.read_bytes()
    for torn in (whole + b"\x01rubbish", whole + frames((2,), 15)[0][0][:-5], whole[:-3], whole[:60]):
        put(last, torn)
        scanned = codec.scan_segment(torn, 10)
        assert offsets(native.read(spark, str(log), 6))[:4] == [6, 7, 8, 9]
        found = native.recover(spark, str(log))
        assert (found.next_offset, found.cut_bytes, found.trusted) == (scanned[1], len(torn) - scanned[0], False) and last.read_bytes() == torn[: scanned[0]]
        again = native.recover(spark, str(log))
        assert again.next_offset == found.next_offset and again.cut_bytes == 0


def test_damage_in_a_sealed_segment_is_fatal(spark, log):
    middle = log / f"{6:020d}.log"
    whole = middle.read_bytes()
    for bad in (whole[:-1], whole[:60] + b"\xff" + whole[61:], b"", b"".join(frames((3,), 6)[0])):
        put(middle, bad)
        with pytest.raises(E.Corrupt, match="sealed segment 6"):
            native.recover(spark, str(log))
    put(middle, whole)
    assert native.recover(spark, str(log)).next_offset == 15
    (log / "12.log").write_bytes(b"")
    with pytest.raises(E.Corrupt):
        native.discover(spark, str(log))


def test_an_empty_active_segment(spark, log):
    put(log / f"{15:020d}.log", b"")
    found = native.recover(spark, str(log))
    assert found.next_offset == 15 and found.segments[-1] == (15, 0, 15) and offsets(native.read(spark, str(log), 12)) == [12, 13, 14]
    native.save_checkpoint(spark, str(log), native.Checkpoint(15, 15, 0))
    put(log / f"{15:020d}.log", frames((2,), 15)[0][0])
    assert native.recover(spark, str(log)).next_offset == 17


def test_checkpoints(spark, log):
    path, last = str(log), log / f"{10:020d}.log"
    whole = last.read_bytes()
    state = native.Checkpoint(15, 10, len(whole))
    assert native.load_checkpoint(spark, path) is None
    native.save_checkpoint(spark, path, state)
    assert native.load_checkpoint(spark, path) == state and native.recover(spark, path).trusted
    # The active segment grew: only what came since is checked, and a torn end is cut.
    put(last, whole + frames((2,), 15)[0][0] + b"torn")
    found = native.recover(spark, path)
    assert found == native.Recovered(17, [(0, (log / f"{0:020d}.log").stat().st_size, 6), (6, (log / f"{6:020d}.log").stat().st_size, 10), (10, last.stat().st_size, 17)], 4, True)
    # What the checkpoint vouches for isn't checked again, in sealed segments but for where they begin.
    sealed = log / f"{6:020d}.log"
    data = bytearray(sealed.read_bytes())
    data[-1] ^= 1
    put(sealed, data)
    assert native.recover(spark, path).trusted
    data[15] ^= 1  # the first frame's offset
    put(sealed, data)
    with pytest.raises(E.Corrupt):
        native.recover(spark, path)
    data[15] ^= 1
    data[-1] ^= 1
    put(sealed, data)
    # Shorter than the checkpoint says, another active segment, or a damaged checkpoint: discarded, and everything is checked.
    put(last, whole[:-1])
    found = native.recover(spark, path)
    assert not found.trusted and found.next_offset == 12 and native.load_checkpoint(spark, path) is None
    put(last, whole)
    native.save_checkpoint(spark, path, native.Checkpoint(10, 6, 5))
    assert not native.recover(spark, path).trusted
    (log / "snapshot").write_bytes(native.checkpoint_bytes(state)[:-1] + b"x")
    with pytest.raises(E.Corrupt):
        native.load_checkpoint(spark, path)
    assert native.recover(spark, path).next_offset == 15 and not (log / "snapshot").exists()
    with pytest.raises(E.InvalidArgument):
        native.checkpoint_bytes(native.Checkpoint(3, 4, 0))


def test_bad_text_and_reserved_headers_have_codes(spark):
    good = [codec._unsealed(0, [(0, 1, "k", b"p", {name: value})]) for name, value in (("__slog__retry_count", "3"), ("__slog__event_id", "01ARZ3NDEKTSV4RRFFQ69G5FAV"), ("h", "v"))]
    bad = [codec._unsealed(0, [(0, 1, "k", b"p", {name: value})]) for name, value in (("__slog__other", "x"), ("__slog__priority", "many"), ("__slog__retry_count", "3000000000"), ("__slog__event_id", "short"))]
    text = codec._unsealed(0, [(0, 1, "key", b"p", {})]).replace(b"key", b"k\xff\xfe")
    df = spark.createDataFrame([(f"t{i}", 0, 1, bytearray(f)) for i, f in enumerate(codec._sealed([*good, *bad, text]))], "topic string, base long, n_records long, frame binary")
    want = [None] * 3 + ["invalid_system_header"] * 4 + ["invalid_text"]
    assert [r["code"] for r in codec.decode(df, strict=False).orderBy("topic").collect()] == want
    assert [r["code"] for r in codec.check(df).orderBy("topic").collect()] == want
