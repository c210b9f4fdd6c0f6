"""Removal of repeated passages, found by level-wise doubling.

A window is `window` consecutive words. A window whose words also start earlier (in a
document with a smaller id, or earlier in the same one) is a repeat, and every word under
a repeat goes. Windows are judged on the input.

Repeats are searched at doubling lengths (5, 10, then 20 words for the default). A window can
only be repeated if its shorter windows are, so only windows repeated at one length are
extended to twice that length; the search ends at the window's own length or when no
candidate is left. At the shorter lengths a window is stood for by the least hash among its
parts, the same for equal windows, which thins what is shuffled by the number of parts.

Shuffled are hashes, first places and, once, the texts (all passes over them reuse that
exchange). Hashes that a slice of documents holds twice are known to be repeated: one row
stands for them in the count, and the rest are dealt out by document, so a passage that
a third of all documents share doesn't meet in one task. First places are minima; a task
remembers up to HOT windows that it met twice in a slice and sends them again only with an
earlier place. Shorter windows are compared by 64-bit hashes, where a collision only
adds a candidate; full windows by 96 bits.

A null or empty text has no words and keeps ''. Very long texts have all their windows; a task has one in memory if it exceeds a slice. Ties: of
windows that start at one place of one text there is one. Rows with the same id and the same text count
as one document and are each returned; those with the same id and different texts are
ordered by a hash of their content; a null id comes first. An empty table gives no rows. Only the
named columns are read, so further columns can't clash. Ids are whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from strandlog.workspace import materialize

from .tables import table
from .textvec import _U, Words, mix64, seeds, slices

WINDOW = 20
#: Windows that a task remembers; more are sent as often as slices hold them, with the same result.
HOT = 1 << 17
_NONE = _U((1 << 64) - 1)
_SALT = seeds(4, 2)


def levels(window: int) -> list[int]:
    """Lengths that double up to window, starting from 4 to 7 words (or window itself, if shorter)."""
    out = [window]
    while out[0] >= 8 and out[0] % 2 == 0:
        out.insert(0, out[0] // 2)
    return out


def _starts(words: Words, window: int) -> np.ndarray:
    n = len(words.starts)
    if n < window:
        return np.zeros(0, np.int64)
    return np.flatnonzero(words.doc[: n - window + 1] == words.doc[window - 1 :])


def _least(words: Words, hashes: np.ndarray, size: int, window: int, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of size words, and for each window at starts the least of those inside it."""
    at, value = words.windows(hashes, size)
    every = np.full(len(hashes), _NONE, _U)
    every[at] = value
    least, reach, parts = every, 1, window - size + 1
    while reach < parts:
        step = min(reach, parts - reach)
        least = np.minimum(least[: len(least) - step], least[step:])
        reach += step
    return every, least[starts]


def _member(doc: np.ndarray, value: np.ndarray, lists: pa.Array) -> np.ndarray:
    """Whether each value is in the list of its document."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    sizes = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(lists), 0))
    known = np.asarray(lists.flatten()).astype(np.int64).view(_U)
    tagged = lambda d, v: mix64(v ^ mix64(d.astype(_U) + _SALT[0]))
    return np.isin(tagged(doc, value), tagged(np.repeat(np.arange(len(sizes)), sizes), known))


def _anchors(size: int, window: int, before: int | None):
    """Rows (hash, key, known, route) for windows of size words inside windows that are still candidates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text"):
                words = Words(part.column("_text"))
                hashes = words.hashes()
                starts = _starts(words, window)
                if before:
                    _, least = _least(words, hashes, before, window, starts)
                    starts = starts[_member(words.doc[starts], least, part.column("_seen"))]
                if not len(starts):
                    continue
                every, least = _least(words, hashes, size, window, starts)
                chosen = np.zeros(len(every), bool)
                for j in range(window - size + 1):
                    chosen[starts[every[starts + j] == least] + j] = True
                at = np.flatnonzero(chosen)
                value, doc = every[at], words.doc[at]
                order = np.lexsort((doc, value))
                value, doc = value[order], doc[order]
                first = np.append(True, value[1:] != value[:-1])
                known = np.diff(np.append(np.flatnonzero(first), len(value)))[np.cumsum(first) - 1] > 1
                own = first | np.append(True, doc[1:] != doc[:-1])
                value, doc, known, first = value[own], doc[own], known[own], first[own]
                key = np.asarray(part.column("_key"))[doc]
                route = np.where(known & ~first, key, 0)
                yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(key), pa.array(known), pa.array(route)], names=["_hash", "_key", "_known", "_route"])

    return run


def _repeated(rows: DataFrame) -> DataFrame:
    """Per document, the hashes found elsewhere too."""
    n = F.count("*").over(W.partitionBy("_route", "_hash"))
    found = rows.withColumn("_n", n).filter((F.col("_n") > 1) | F.col("_known"))
    return found.groupBy("_key").agg(F.collect_set("_hash").alias("_seen"))


def _earlier(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...]) -> np.ndarray:
    """Whether each place (id, key, at) of a comes before that of b."""
    return (a[0] < b[0]) | ((a[0] == b[0]) & ((a[1] < b[1]) | ((a[1] == b[1]) & (a[2] < b[2]))))


def _places(window: int, before: int | None):
    """Rows (a, b, id, key, at) for candidate windows of full length, the first of each in a slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = np.zeros(0, _U)
        hot_place = (np.zeros(0, np.int64),) * 3
        for batch in batches:
            for part in slices(batch, "_text"):
                words = Words(part.column("_text"))
                starts, a, b = _candidates(words, part, window, before)
                doc = words.doc[starts]
                place = tuple(x.astype(np.int64) for x in (np.asarray(part.column("_id"))[doc], np.asarray(part.column("_key"))[doc], starts - words.first[:-1][doc]))
                whole = mix64(a ^ mix64(b.astype(np.int64).view(_U) + _SALT[2]))
                order = np.lexsort((*place[::-1], whole))
                first = np.append(True, whole[order][1:] != whole[order][:-1]) if len(order) else np.zeros(0, bool)
                often = np.diff(np.append(np.flatnonzero(first), len(order))) > 1
                order = order[first]
                known = np.searchsorted(hot, whole[order])
                met = np.zeros(len(order), bool)
                inside = known < len(hot)
                met[inside] = hot[known[inside]] == whole[order][inside]
                later = np.zeros(len(order), bool)
                later[met] = ~_earlier(tuple(x[order][met] for x in place), tuple(x[known[met]] for x in hot_place))
                new = often & ~met
                if new.any() and len(hot) + new.sum() <= HOT:
                    every = np.concatenate([hot, whole[order][new]])
                    rank = np.argsort(every)
                    hot = every[rank]
                    hot_place = tuple(np.concatenate([h, x[order][new]])[rank] for h, x in zip(hot_place, place, strict=True))
                sent = np.sort(order[~later])
                columns = [a[sent].view(np.int64), b[sent], *(x[sent] for x in place[:2]), place[2][sent].astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["_a", "_b", "_id", "_key", "_at"])

    return run


def _candidates(words: Words, part: pa.RecordBatch, window: int, before: int | None, hashed: bool = True) -> tuple[np.ndarray, ...]:
    starts = _starts(words, window)
    hashes = words.hashes()
    if before:
        _, least = _least(words, hashes, before, window, starts)
        starts = starts[_member(words.doc[starts], least, part.column("_seen"))]
    if not hashed:
        return (starts,)
    n = len(hashes)
    full = np.zeros(n, _U)
    more = np.zeros(n, _U)
    at, value = words.windows(hashes, window)
    full[at] = value
    at, value = words.windows(mix64(hashes ^ _SALT[1]), window)
    more[at] = value
    return starts, full[starts], (more[starts] >> _U(32)).astype(np.int64).astype(np.uint32).view(np.int32)


def _kept(window: int, before: int | None):
    """Rows (id, n_words, n_removed, kept_text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text"):
                words = Words(part.column("_text"))
                (starts,) = _candidates(words, part, window, before, hashed=False)
                n = len(words.starts)
                first = part.column("_first")
                sizes = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(first), 0))
                earliest = np.asarray(first.flatten()).astype(np.int64) + np.repeat(words.first[:-1], sizes)
                repeat = np.zeros(n + 1, np.int64)
                repeat[starts] = 1
                repeat[earliest] = 0
                over = np.cumsum(repeat[:n])
                over[window:] -= np.cumsum(repeat[:n])[:-window].copy()
                keep = over == 0
                removed = np.bincount(words.doc[~keep], minlength=part.num_rows)
                yield pa.RecordBatch.from_arrays(
                    [part.column("_own"), pa.array(words.counts), pa.array(removed.astype(np.int64)), _joined(words, keep)],
                    names=["_own", "n_words", "n_removed", "kept_text"],
                )

    return run


def _joined(words: Words, keep: np.ndarray) -> pa.Array:
    """Kept words of every text, joined by one blank."""
    starts, ends, doc = words.starts[keep], words.ends[keep], words.doc[keep]
    last = np.append(doc[1:] != doc[:-1], True) if len(doc) else np.zeros(0, bool)
    take = np.zeros(len(words.data) + 1, np.int32)
    # A word that isn't its text's last kept one is followed by white space, which becomes the blank.
    np.add.at(take, starts, 1)
    np.add.at(take, ends + ~last, -1)
    mask = np.cumsum(take[:-1]) > 0
    data = words.data.copy()
    data[(ends)[~last]] = 0x20
    kept = data[mask]
    offsets = np.concatenate(([0], np.cumsum(mask)))[words.offsets]
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(kept.tobytes())).cast(pa.string())


def remove_repeats(docs: DataFrame, id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """Id, n_words, n_removed and kept_text (the words kept, joined by one blank) of every row."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = docs.schema[id].dataType.simpleString()
    order = F.coalesce(docs[id].cast("long"), F.lit(-(1 << 63)))
    own = docs.select(order.alias("_id"), docs[id].alias("_own"), docs[text].alias("_text"), F.xxhash64(docs[id], docs[text]).alias("_key"))
    texts = own.repartition(n, "_key")  # the same columns are read in every pass, so that all share one exchange
    columns = ["_id", "_own", "_text", "_key"]
    seen, before = None, None
    for size in levels(window)[:-1]:
        source = own if seen is None else texts.join(seen.hint("shuffle_hash"), "_key", "left").select(*columns, "_seen")
        found = _repeated(source.mapInArrow(_anchors(size, window, before), "_hash long, _key long, _known boolean, _route long"))
        # The first level shuffles most hashes and needs no shuffled text; written, they are gone before the texts move.
        seen, before = materialize(found, "repeats") if seen is None else found, size
    if seen is None:
        seen = own.select("_key", F.array().cast("array<long>").alias("_seen")).limit(0)
    known = texts.join(seen.hint("shuffle_hash"), "_key", "left").select(*columns, "_seen")
    places = known.mapInArrow(_places(window, before), "_a long, _b int, _id long, _key long, _at int").repartition(n, "_a", "_b")
    firsts = places.groupBy("_a", "_b").agg(F.min(F.struct("_id", "_key", "_at")).alias("_f"))
    firsts = firsts.select("_f._key", "_f._at").groupBy("_key").agg(F.collect_set("_at").alias("_first"))
    whole = known.join(firsts.hint("shuffle_hash"), "_key", "left").select(*columns, "_seen", "_first")
    return whole.mapInArrow(_kept(window, before), f"_own {kind}, n_words long, n_removed long, kept_text string").withColumnRenamed("_own", id)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP2_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
w AS (SELECT doc_id, i, array_to_string(ws[i:i + 19], ' ') AS s FROM d, unnest(range(1, len(ws) - 18)) AS u(i)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS n FROM w) WHERE n > 1),
c AS (SELECT DISTINCT doc_id, i + j AS i FROM r, range(20) AS u(j)),
t AS (SELECT doc_id, i, ws[i] AS word FROM d, unnest(range(1, len(ws) + 1)) AS u(i)),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM t ANTI JOIN c USING (doc_id, i) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n FROM c GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id) LEFT JOIN n USING (doc_id)
"""
