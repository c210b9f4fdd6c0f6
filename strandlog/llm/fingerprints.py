"""Document fingerprints from closed syncmers.

A k-mer (K code points) is chosen if the least hash among its inner S-mers stands at its
first or last place. That depends on the k-mer alone, so an edit changes anchors only
where it touches them: equal passages have equal anchors at equal distances. A text
shorter than K code points is one k-mer.

A fingerprint lists all distinct anchors of a text, each as 8 hex digits of its hash and 6
of its first position (modulo 2 ** 24), by hash. Likeness of two fingerprints: among the
hashes of either, the share that both have at matching positions, that is at one common
displacement, within WIDTH code points.

Null or empty texts have an empty fingerprint, like another empty one (1.0) and unlike all
others (0.0). Equal texts have equal fingerprints. Positions are counted modulo 2 ** 24 code points, so in longer
texts anchors that far apart count as being at one place. For neighbours, rows are ordered by
descending id, null last, then by text; after the last row comes the first, and a single row is
its own neighbour. An empty table gives no rows. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import table
from .textvec import _U, mix64, slices, span_hashes

K, S, WIDTH = 12, 5, 64
SLICE = 1 << 20


def anchors(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, position and 32-bit hash of every chosen k-mer, in order."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(_U)
    codes = mix64(codes + _U(0x51ED27))
    n = len(codes)
    owner = np.repeat(np.arange(len(texts)), sizes)
    short = np.flatnonzero((sizes > 0) & (sizes < K))
    whole = span_hashes(codes, bounds[short], bounds[short] + sizes[short]) >> _U(32)
    if n < K:
        return short, np.zeros(len(short), np.int64), whole
    inner = span_hashes(codes, np.arange(n - S + 1), np.arange(S, n + 1))
    w = K - S + 1
    least, reach = inner, 1
    while reach < w:
        step = min(reach, w - reach)
        least = np.minimum(least[: len(least) - step], least[step:])
        reach += step
    m = n - K + 1
    edge = (inner[:m] == least[:m]) | (inner[w - 1 : w - 1 + m] == least[:m])
    at = np.flatnonzero(edge & (owner[:m] == owner[K - 1 :]))
    hashes = span_hashes(codes, at, at + K) >> _U(32)
    text = np.concatenate([owner[at], short])
    position = np.concatenate([at - bounds[owner[at]], np.zeros(len(short), np.int64)])
    order = np.argsort(text, kind="stable")
    return text[order], position[order], np.concatenate([hashes, whole])[order]


def fingerprints(texts: list[str]) -> list[np.ndarray]:
    """Of each text, all distinct anchors: hash << 24 | position, by hash."""
    text, position, hashes = anchors(texts)
    keys, first = np.unique((text.astype(_U) << _U(32)) | hashes, return_index=True)
    owner = (keys >> _U(32)).astype(np.int64)
    bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
    packed = ((keys & _U(0xFFFFFFFF)) << _U(24)) | (position[first].astype(_U) & _U(0xFFFFFF))
    return [packed[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def written(found: np.ndarray) -> str:
    return found.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 1:].tobytes().hex()


def parsed(fingerprint: str) -> np.ndarray:
    digits = np.frombuffer(bytes.fromhex(fingerprint), np.uint8).reshape(-1, 7)
    return np.pad(digits, ((0, 0), (1, 0))).view(">u8").ravel().astype(_U)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Of two fingerprints, from 0 to 1."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    ha, hb = a >> _U(24), b >> _U(24)
    shared, ia, ib = np.intersect1d(ha, hb, assume_unique=True, return_indices=True)
    if not len(shared):
        return 0.0
    moved = (a[ia] & _U(0xFFFFFF)).astype(np.int64) - (b[ib] & _U(0xFFFFFF)).astype(np.int64)
    matched = max(np.unique((moved + half) // WIDTH, return_counts=True)[1].max() for half in (0, WIDTH // 2))
    return float(matched) / (len(a) + len(b) - len(shared))


def edited(text: str, following: str) -> str:
    """text with its last half replaced by as much of the start of following, or all of that."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _salts(spark: SparkSession, n: int) -> np.ndarray:
    """For each of n partitions a number that hash partitioning puts there."""
    place = F.pmod(F.hash("id"), F.lit(n))
    found = spark.range(32 * n).groupBy(place.alias("place")).agg(F.min("id").alias("salt")).toArrow()
    out = np.arange(n)  # a partition that none of so many numbers hashes to gets what its own number hashes to
    out[found.column("place").to_numpy()] = found.column("salt").to_numpy()
    return out


def _bucketed(bounds: np.ndarray):
    """The bucket of every _key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column("_key").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(np.searchsorted(bounds, key)), batch.column("_key")], names=["_bucket", "_key"])

    return run


def _dealt(bounds: np.ndarray, salts: np.ndarray, firsts: np.ndarray, to: np.ndarray):
    """Rows with their bucket and its salt, and after them the rows whose key is among firsts once more, for the bucket in to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column("_key").to_numpy()
            own = np.searchsorted(bounds, key)
            place = np.minimum(np.searchsorted(firsts, key), len(firsts) - 1)
            again = np.flatnonzero(firsts[place] == key)
            for rows, bucket, extra in ((batch, own, False), (batch.take(pa.array(again)), to[place[again]], True)):
                if rows.num_rows:
                    columns = [pa.array(salts[bucket]), pa.array(bucket), pa.array(np.full(rows.num_rows, extra)), *rows.columns]
                    yield pa.RecordBatch.from_arrays(columns, names=["_salt", "_bucket", "_extra", *rows.schema.names])

    return run


def with_next(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows _bucket, _extra, _key, _id, _text, laid out so that a row's neighbour follows it in its partition.

    Ranges of ids are dealt to buckets, one to a shuffle partition; the first row of a bucket is also sent, as an
    extra row, to the end of the bucket before it. The text is shuffled once. What the driver
    gets are one bound, one id and one salt for each shuffle partition; they go to the tasks as arrays, so the plan doesn't grow.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = docs.schema[id].dataType.simpleString()
    key = F.coalesce(docs[id].cast("long"), F.lit(-(1 << 63)))
    rows = docs.select(key.alias("_key"), docs[id].alias("_id"), docs[text].alias("_text"))
    ids = rows.select("_key")
    got = ids.agg(F.percentile_approx("_key", [i / n for i in range(1, n)] or [0.5], 10 * n)).first()[0] or []
    bounds = np.array(sorted(set(got)), np.int64)[: n - 1]
    found = ids.mapInArrow(_bucketed(bounds), "_bucket long, _key long").groupBy("_bucket").agg(F.max("_key").alias("_first")).toArrow().sort_by("_bucket")
    buckets, firsts = found.column("_bucket").to_numpy(), found.column("_first").to_numpy()
    if len(buckets):
        # The bucket above; the highest one's first row closes the lowest.
        rows = rows.mapInArrow(_dealt(bounds, _salts(spark, n), firsts, np.roll(buckets, -1)), f"_salt long, _bucket long, _extra boolean, _key long, _id {kind}, _text string")
    else:
        rows = rows.select(F.lit(0).cast("long").alias("_salt"), F.lit(0).cast("long").alias("_bucket"), F.lit(False).alias("_extra"), "_key", "_id", "_text")
    return rows.repartition(n, "_salt").sortWithinPartitions("_bucket", "_extra", F.col("_key").desc(), "_text")


def compare_neighbours(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and its edited text, with likenesses."""
    kind = docs.schema[id].dataType.simpleString()
    names = ["_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def out(rows: list[tuple], prints: list[np.ndarray], id_type: pa.DataType) -> pa.RecordBatch:
        """Results for rows (bucket, extra, id, text), but for the last, which awaits its neighbour."""
        pairs = [i for i in range(len(rows) - 1) if not rows[i][1] and rows[i + 1][0] == rows[i][0]]
        changed = [edited(rows[i][3], rows[i + 1][3]) for i in pairs]
        anew = fingerprints(changed)
        columns = [
            pa.array([rows[i][2] for i in pairs], id_type),
            pa.array([len(rows[i][3]) for i in pairs], pa.int64()),
            pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed], pa.string()),
            pa.array([written(prints[i]) for i in pairs], pa.string()),
            pa.array([written(x) for x in anew], pa.string()),
            pa.array([likeness(prints[i], x) for i, x in zip(pairs, anew, strict=True)], pa.float64()),
            pa.array([likeness(prints[i], prints[i + 1]) for i in pairs], pa.float64()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple] = []
        kept_print: list[np.ndarray] = []
        for batch in batches:
            for part in slices(batch, "_text", SLICE):
                rows = [(b, e, i, t or "") for b, e, i, t in zip(*(part.column(c).to_pylist() for c in ("_bucket", "_extra", "_id", "_text")), strict=True)]
                prints = kept_print + fingerprints([r[3] for r in rows])
                rows = kept + rows
                yield out(rows, prints, part.schema.field("_id").type)
                kept, kept_print = rows[-1:], prints[-1:]

    schema = f"_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(docs, id, text).select("_bucket", "_extra", "_id", "_text").mapInArrow(run, schema).withColumnRenamed("_id", id)


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_neighbours(table(spark, sf_dir, "documents").select("doc_id", "text"))
