"""Quality classifier: logistic regression over hashed word n-grams, trained by FTRL-proximal.

A text becomes tokens: runs of letters and digits, and runs of other marks. Features are
hashed 1- and 2-grams of the lower-cased tokens, and 1- to 3-grams of their forms (case,
digits, the mark itself, whether it repeats the token before), valued by the square root of their
count and scaled to unit length. Weights are learnt one text after the other with follow-the-regularised-
leader updates; a score is the logistic of a sparse dot product.

Training uses a bounded sample of labelled texts (max_train, those with the least md5 of
their id, while their features are at most max_features), so what reaches the driver and what goes to the tasks, 2 ** bits weights, is
bounded in bytes, whatever the lengths of texts. Texts are used whole or not at all. Scoring covers every whole text and needs no shuffle.

A null or empty text has no feature but the constant one and gets the constant's score.
Labels that are null, or whose text is absent, train nothing; without labels every score is
0.5. Repeated rows are scored alike, and very long texts whole. An empty table gives no rows. Results of score() are
added under the given names after dropping columns of those names from the input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from strandlog.workspace import materialize, release

from .tables import table
from .textvec import _BYTE_CODES, _LOWER, _SPACE, _U, SMALL_SLICE, give_back, mix64, seeds, slices, span_hashes, tidy, utf8

BITS = 18
MAX_TRAIN = 12_000
#: Features (8 bytes each) that the training texts have together at most, and those fetched to the driver at a time.
MAX_FEATURES, FETCHED = 24_000_000, 3_000_000
THRESHOLD = 0.3
#: Value of the constant feature beside others; alone it is 1.
CONSTANT = 0.2

_WORD_BYTE = np.zeros(256, bool)
_WORD_BYTE[48:58] = _WORD_BYTE[65:91] = _WORD_BYTE[97:123] = _WORD_BYTE[128:] = True
_CLASS = np.where(_SPACE, 0, np.where(_WORD_BYTE, 1, 2)).astype(np.int8)
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_SMALL = np.zeros(256, bool)
_SMALL[97:123] = _SMALL[128:] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_SALT = seeds(8, 6)


def features(column: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct feature numbers of all texts, text after text, their values, and the n + 1 bounds of the texts."""
    data, offsets = utf8(column)
    n, docs = len(data), len(offsets) - 1
    kind = _CLASS[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    begin = kind > 0
    begin[1:] &= (kind[1:] != kind[:-1]) | edge[1:n]
    stop = kind > 0
    stop[:-1] &= (kind[:-1] != kind[1:]) | edge[1:n]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0), np.zeros(docs + 1, np.int64)
    doc = np.searchsorted(offsets, starts, "right") - 1
    word = span_hashes(_BYTE_CODES[_LOWER[data]], starts, ends)
    count = lambda flags: np.diff(np.concatenate(([0], np.cumsum(flags[data])))[np.stack([starts, ends])], axis=0)[0]
    upper, small, digit = count(_UPPER), count(_SMALL), count(_DIGIT)
    same = np.zeros(len(starts), bool)
    same[1:] = (word[1:] == word[:-1]) & (doc[1:] == doc[:-1])
    mark = kind[starts] == 2
    form = np.where(
        mark,
        1000 + data[starts].astype(np.int64) * 4 + np.minimum(ends - starts, 3),
        (_UPPER[data[starts]] * 1 + (upper > 1) * 2 + (small > 0) * 4 + (digit > 0) * 8 + same * 16),
    ).astype(_U)
    form = mix64(form + _SALT[0])
    grams, owner = [], []
    for salt, base, size in ((1, word, 1), (2, word, 2), (3, form, 1), (4, form, 2), (5, form, 3)):
        if len(base) < size:
            continue
        m = len(base) - size + 1
        ok = doc[:m] == doc[size - 1 :]
        value = base[:m] * _SALT[salt] + _SALT[7]
        for j in range(1, size):
            value = mix64(value) + base[j : j + m] * _SALT[salt]
        grams.append((mix64(value)[ok] >> _U(64 - bits)).astype(np.int64))
        owner.append(doc[:m][ok])
    owners = np.concatenate(owner)
    keys, counts = np.unique((owners << bits) | np.concatenate(grams), return_counts=True)
    values = np.sqrt(counts / np.bincount(owners, minlength=docs)[keys >> bits])
    return keys & ((1 << bits) - 1), values, np.searchsorted(keys >> bits, np.arange(docs + 1)).astype(np.int64)


def ftrl(
    rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, bits: int = BITS, epochs: int = 5, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.001, l2: float = 0.01
) -> tuple[np.ndarray, float]:
    """Weights and constant after FTRL-proximal updates over rows (feature numbers, values), in their order."""
    size = 1 << bits
    z, n, w = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    for _ in range(epochs):
        for (idx, values), y in zip(rows, labels, strict=True):
            at = np.append(idx, size)
            x = np.append(values, CONSTANT if len(idx) else 1.0)
            wi = w[at]
            p = 1 / (1 + np.exp(-np.clip(wi @ x, -35, 35)))
            g = (p - y) * x
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * wi
            n[at] += g * g
            zi = z[at]
            w[at] = np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2))
    return w[:size].astype(np.float32), float(w[size])


def _sample_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "_text", SMALL_SLICE):
            idx, values, bounds = features(part.column("_text"))
            lists = [pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(x, t)) for x, t in ((idx, pa.int32()), (values, pa.float32()))]
            count = pa.array(np.diff(bounds))
            yield pa.RecordBatch.from_arrays([part.column("_rank"), part.column("_label"), count, *lists], names=["_rank", "_label", "_count", "idx", "val"])


def train(
    docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality", max_train: int = MAX_TRAIN, max_features: int = MAX_FEATURES
) -> tuple[np.ndarray, float]:
    """Weights from at most max_train labelled texts, those with the least md5 of their id, as many as have max_features features together."""
    rank = F.md5(F.col("_id").cast("string"))
    few = (
        labels.select(labels[id].alias("_id"), labels[label].cast("double").alias("_label")).dropna()
        .withColumn("_rank", rank).orderBy("_rank", "_label").limit(max_train)
    )
    # few has max_train rows of 60 bytes at most, whatever the size of labels.
    chosen = docs.select(docs[id].alias("_id"), docs[text].alias("_text")).join(F.broadcast(few), "_id").select("_rank", "_label", "_text")
    found = materialize(chosen.mapInArrow(tidy(_sample_features), "_rank string, _label double, _count long, idx array<int>, val array<float>"), "features")
    # Bounds the driver's memory whatever the lengths of texts: ranks up to one that all labelled texts up to it fit with; ids of several rows make few more.
    sizes = found.groupBy("_rank").agg(F.sum("_count").alias("_count")).toArrow().sort_by("_rank")
    ranks, total = sizes.column("_rank").to_pylist(), np.cumsum(sizes.column("_count").to_numpy())
    fit = int(np.searchsorted(total, max_features, "right"))
    rows: list[tuple[np.ndarray, np.ndarray]] = []
    marks: list[float] = []
    at = 0
    while at < fit:
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + FETCHED, "right")))
        to = min(to, fit)
        got = found.filter(F.col("_rank").between(ranks[at], ranks[to - 1])).toArrow().sort_by([("_rank", "ascending"), ("_label", "ascending"), ("_count", "ascending")])
        rows += [(np.asarray(i.values), np.asarray(v.values)) for i, v in zip(got.column("idx"), got.column("val"), strict=True)]  # no copies
        marks += got.column("_label").to_pylist()
        at = to
    release(found)
    model = ftrl(rows, np.array(marks))
    # Most of what the driver's Python ever holds; it would keep it as free memory for the rest of the session.
    rows, got, sizes = [], None, None
    give_back()
    return model


def score_column(column: pa.Array, weights: np.ndarray, constant: float) -> np.ndarray:
    idx, values, bounds = features(column)
    owner = np.repeat(np.arange(len(column)), np.diff(bounds))
    dot = np.bincount(owner, weights[idx] * values, minlength=len(column))
    return 1 / (1 + np.exp(-(dot + constant * np.where(np.diff(bounds) > 0, CONSTANT, 1.0))))


def score(docs: DataFrame, model: tuple[np.ndarray, float], text: str = "text", out: str = "score") -> DataFrame:
    """docs with the column out in place of any of that name; the text column may be kept or not by a later select."""
    weights, constant = model
    docs = docs.drop(out) if out != text else docs
    names = docs.columns
    schema = StructType([*docs.schema.fields, StructField(out, DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text, SMALL_SLICE):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score_column(part.column(text), weights, constant))], names=[*names, out])

    return docs.mapInArrow(tidy(run), schema)


def keep_good(docs: DataFrame, model: tuple[np.ndarray, float], text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Rows of docs, unchanged, that score threshold or more."""
    weights, constant = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text, SMALL_SLICE):
                yield part.filter(pa.array(score_column(part.column(text), weights, constant) >= threshold))

    return docs.mapInArrow(tidy(run), docs.schema)


def fold(id: str = "doc_id"):
    """Remainder that says whether a row is held out (0)."""
    return F.crc32(F.coalesce(F.col(id).cast("string"), F.lit("")).cast("binary")) % 5


def fitted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> tuple[np.ndarray, float]:
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return train(docs, labels.filter(fold() != 0))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, fitted(spark, docs, sf_dir))
    return scored.select("doc_id", (fold() == 0).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
