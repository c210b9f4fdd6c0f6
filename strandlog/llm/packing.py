"""Best-fit packing of tokenised documents into sequences of a fixed capacity.

Linear grouping scheme. Pieces longer than a share of the capacity are large: sorted by
length, cut into groups of equal cardinality and rounded up to their group's longest, so
that few sizes are left. For those, configurations are optimised by column generation (a
linear program over configurations, priced by a knapsack) and rounded down. Then actual
documents take the places of the rounded ones, and what is left over and the small pieces
go best-fit into the room that remains, longest first.

Lengths are whole numbers up to the capacity, so a histogram with at most `capacity` rows
says all the plan needs; the plan is a table of places for runs of ranks within a length.
Its size depends on the capacity and the groups, not on the number of documents. Pieces
get their rank within their length from windows over parts of each length (PART_ROWS pieces a part or more), and look
up their place with a binary search. No task gets all pieces of a frequent length.

A null or empty text is one piece, the closing id alone. Texts longer than the capacity
are cut into whole pieces; the last may be shorter. Very long texts are encoded whole, by their distinct parts. Rows with the same
id and text are packed each for itself; which of two equal pieces gets which place isn't defined. An empty table gives no rows. Only the named columns are read.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator
from math import isqrt
from unicodedata import normalize

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from strandlog.workspace import materialize

from .tables import table
from .textvec import slices, tidy, utf8

CAPACITY = 2048
VOCABULARY = "word_bpe_49k.json"
CLOSING_ID = 0
#: Pieces of one length that are ranked together, on average, at least; of very many the square root, so that parts are as many as pieces in them.
PART_ROWS = 1000
#: Distinct parts of words whose ids a worker keeps; beyond that it starts anew.
CACHED_PARTS = 1_000_000
#: Bytes of texts encoded at a time.
ENCODED_BYTES = 1 << 20
#: Marks that the vocabulary's pre-tokenizer splits from letters before them, as one token's text.
MARKS = ".,;:!?#$%&*|"
_OTHER, _BLANK, _LETTER, _MARK, _HIGH = range(5)
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[[0x20, 0x0A]] = _BLANK
_KIND[[*range(65, 91), *range(97, 123)]] = _LETTER
_KIND[list(MARKS.encode())] = _MARK
_KIND[128:] = _HIGH

_tokenizers: dict[str, tuple] = {}


def _tokenizer(vocabulary: str):
    """Tokenizer and known parts of one worker process. A bare file name is looked up among the public vocabularies."""
    if vocabulary not in _tokenizers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        path = vocabulary
        if not os.path.dirname(vocabulary):
            import public_tokenizers

            path = public_tokenizers.path(vocabulary)
        _tokenizers[vocabulary] = (Tokenizer.from_file(path), _Known())
    return _tokenizers[vocabulary]


def _letters(text: str) -> bool:
    """Whether text is letters only, in lower case and normal form too: a combining mark would join the marks after it."""
    return text.isalpha() and (text.isascii() or normalize("NFC", text.lower()).isalpha())


def _encode_each(tokenizer, texts: list[str]) -> list[bytes]:
    return [array("I", e.ids).tobytes() for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def _encode_letters(tokenizer, stems: list[str], together: int = 128) -> list[bytes]:
    """Ids of stems that are letters only: many at once, parted by a mark, whose id no letters give."""
    (part,) = np.frombuffer(_encode_each(tokenizer, [","])[0], "<u4")
    out: list[bytes] = []
    groups = [stems[i : i + together] for i in range(0, len(stems), together)]
    for group, ids in zip(groups, _encode_each(tokenizer, [" , ".join(g) for g in groups]), strict=True):
        ends = (np.flatnonzero(np.frombuffer(ids, "<u4") == part) * 4).tolist()
        if len(ends) != len(group) - 1:
            out += _encode_each(tokenizer, group)
        else:
            out += [ids[a:b] for a, b in zip([0, *(e + 4 for e in ends)], [*ends, len(ids)], strict=True)]
    return out


class _Known:
    """Ids of the parts seen so far, end to end, with their places."""

    CLOSING = 0  # the number of the closing id

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.ids, self.first = np.zeros(1 << 16, "<u4"), np.zeros(1 << 14, np.int64)
        self.add([""], [np.array([CLOSING_ID], "<u4").tobytes()])

    def add(self, parts: list[str], ids: list[bytes]) -> None:
        n = len(self.number)
        ends = self.first[n] + np.cumsum([len(x) // 4 for x in ids], dtype=np.int64)
        self.first = self._room(self.first, n + len(parts) + 1)
        self.ids = self._room(self.ids, int(ends[-1]))
        self.ids[self.first[n] : ends[-1]] = np.frombuffer(b"".join(ids), "<u4")
        self.first[n + 1 : n + len(parts) + 1] = ends
        self.number.update(zip(parts, range(n, n + len(parts)), strict=True))

    @staticmethod
    def _room(have: np.ndarray, size: int) -> np.ndarray:
        return have if size <= len(have) else np.concatenate([have, np.zeros(max(size, 2 * len(have)) - len(have), have.dtype)])


class _Parts:
    """Texts cut into parts: words, and for words of letters that end in marks, the letters and the marks.

    A part's string goes on to the next part, so that it ends in a blank unless marks (or another text) follow at once.
    """

    def __init__(self, column: pa.Array):
        data, self.offsets = utf8(column)
        kind = _KIND[data]
        self.data = np.where(kind == _BLANK, np.uint8(0x20), data)
        solid, n = kind != _BLANK, len(data)
        edge = np.zeros(n + 1, bool)
        edge[self.offsets] = True
        begin, stop = solid.copy(), solid.copy()
        begin[1:] &= ~solid[:-1] | edge[1:n]
        stop[:-1] &= ~solid[1:] | edge[1:n]
        self.starts, ends = np.flatnonzero(begin), np.flatnonzero(stop)
        last = np.maximum.accumulate(np.where(kind != _MARK, np.arange(n, dtype=np.int32), np.int32(-1))) if n else np.zeros(0, np.int32)
        self.stems = np.maximum(self.starts, last[ends] + 1)  # where the marks at a word's end begin
        letters = ~self._any((kind != _LETTER) & (kind != _HIGH)) & (self.stems > self.starts)
        plain = letters & ~self._any(kind == _HIGH)
        lower = np.zeros(n + 1, np.int8)
        lower[self.starts[plain]] += 1
        lower[self.stems[plain]] -= 1
        self.data |= np.cumsum(lower[:n], dtype=np.int8).view(np.uint8) << np.uint8(5)
        self.split = letters & (self.stems <= ends)
        self._cut()

    def _any(self, flags: np.ndarray) -> np.ndarray:
        """Whether a word has a flag before the marks at its end."""
        sums = np.zeros(len(flags) + 1, np.int32)
        np.cumsum(flags, dtype=np.int32, out=sums[1:])
        return sums[self.stems] > sums[self.starts]

    def _cut(self) -> None:
        flags = np.zeros(len(self.data), bool)
        flags[self.starts] = True
        flags[self.stems[self.split]] = True
        self.at = np.flatnonzero(flags)
        ends = np.append(self.at, len(self.data)).astype(np.int32)
        found = pa.StringArray.from_buffers(len(self.at), pa.py_buffer(ends.tobytes()), pa.py_buffer(self.data.tobytes())).dictionary_encode()
        self.strings, self.place = found.dictionary.to_pylist(), found.indices.to_numpy()

    def unlike_letters(self) -> list[int]:
        """Strings before marks that aren't letters."""
        before = np.unique(self.place[np.searchsorted(self.at, self.starts[self.split])])
        return [i for i in before.tolist() if not self.strings[i].isascii() and not _letters(self.strings[i])]

    def join(self, wrong: list[int]) -> None:
        """Make words whose letters are one of these strings one part again."""
        bad = np.zeros(len(self.data) + 1, bool)
        bad[self.at[np.isin(self.place, wrong)]] = True
        self.split &= ~bad[self.starts]
        self._cut()


def encoded(column: pa.Array, vocabulary: str = VOCABULARY) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts end to end, each text's with the closing id, and the n + 1 bounds of the texts.

    The vocabulary lower-cases, drops white space and joins nothing across it, nor letters and the
    marks after them. So the ids of a text are those of its parts, one after the other, and
    each distinct part is encoded once in a worker.
    """
    tokenizer, known = _tokenizer(vocabulary)
    parts = _Parts(column)
    # Bytes beyond ASCII needn't be letters; words that end in marks after other such bytes stay whole.
    while wrong := parts.unlike_letters():
        parts.join(wrong)
    if len(known.number) > CACHED_PARTS:
        known.clear()
    number = [known.number.get(x, -1) for x in parts.strings]
    lacking = [x for x, i in zip(parts.strings, number, strict=True) if i < 0]
    if lacking:
        stripped = [x.rstrip(" ") for x in lacking]
        distinct = dict.fromkeys(stripped)
        letters, others = [], []
        for x in distinct:
            (letters if _letters(x) else others).append(x)
        distinct.update(zip(letters, _encode_letters(tokenizer, letters), strict=True))
        distinct.update(zip(others, _encode_each(tokenizer, others), strict=True))
        fresh = iter(range(len(known.number), len(known.number) + len(lacking)))
        known.add(lacking, [distinct[x] for x in stripped])
        number = [next(fresh) if i < 0 else i for i in number]
    ends = np.searchsorted(parts.at, parts.offsets[1:])
    place = np.insert(np.array(number, np.int32)[parts.place], ends, _Known.CLOSING)
    first = known.first[place]
    counts = known.first[place + 1] - first
    ends += np.arange(1, len(ends) + 1)
    sums = np.concatenate(([0], np.cumsum(counts)))
    first -= sums[:-1]
    at = np.repeat(first, counts)
    at += np.arange(len(at))
    return known.ids[at], np.concatenate(([0], sums[ends]))


def encode(texts: list[str], vocabulary: str = VOCABULARY) -> list[bytes]:
    """Ids of each text as little-endian unsigned 32-bit numbers, without the closing id."""
    ids, bounds = encoded(pa.array(texts, pa.string()), vocabulary)
    return [ids[a : b - 1].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def pieces(docs: DataFrame, id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """Id, piece, start, length and ids_crc32 of every document's pieces."""
    kind = docs.schema[id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text", ENCODED_BYTES):
                ids, bounds = encoded(part.column("_text"), vocabulary)
                of = -(-np.diff(bounds) // capacity)  # pieces of each text: one at least
                at = np.repeat(np.arange(part.num_rows), of)
                k = np.arange(len(at)) - np.repeat(np.cumsum(of) - of, of)
                start = k * capacity
                length = np.minimum(capacity, np.diff(bounds)[at] - start)
                begin = bounds[:-1][at] + start
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(begin.tolist(), (begin + length).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("_id").take(pa.array(at)), pa.array(k, pa.int32()), *[pa.array(c, pa.int64()) for c in (start, length, crc)]],
                    names=["_id", "piece", "start", "length", "ids_crc32"],
                )

    schema = f"_id {kind}, piece int, start long, length long, ids_crc32 long"
    return docs.select(docs[id].alias("_id"), docs[text].alias("_text")).mapInArrow(tidy(run), schema).withColumnRenamed("_id", id)


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 400) -> list[tuple[np.ndarray, int]]:
    """Configurations (how many of each size) and how often to use each, rounded down.

    Column generation: the simplex method over configurations, where a knapsack over the
    dual prices finds the one that enters.
    """
    k = len(sizes)
    basis = np.diag((capacity // sizes).astype(float))
    have = demand / np.diag(basis)
    for _ in range(rounds):
        inverse = np.linalg.inv(basis)
        price = inverse.sum(axis=0)
        best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        for c in range(int(sizes.min()), capacity + 1):
            fit = np.flatnonzero(sizes <= c)
            value = best[c - sizes[fit]] + price[fit]
            j = int(value.argmax())
            if value[j] > best[c - 1] + 1e-12:
                best[c], last[c] = value[j], fit[j]
            else:
                best[c] = best[c - 1]
        if best[capacity] <= 1 + 1e-7:
            break
        enter, c = np.zeros(k), capacity
        while c > 0:
            if last[c] < 0:
                c -= 1
            else:
                enter[last[c]] += 1
                c -= int(sizes[last[c]])
        direction = inverse @ enter
        ratio = np.where(direction > 1e-9, have / np.maximum(direction, 1e-9), np.inf)
        out = int(ratio.argmin())
        have = np.maximum(have - ratio[out] * direction, 0)
        have[out] = ratio[out]
        basis[:, out] = enter
    return [(basis[:, j].astype(int), int(have[j] + 1e-6)) for j in range(k) if have[j] + 1e-6 >= 1]


class Plan:
    """Places for all pieces of a histogram of lengths.

    A row of runs says: ranks first .. first + count - 1 of a length go, `per` to a sequence,
    into sequences base, base + 1, ..., from offset on.
    """

    def __init__(self, histogram: dict[int, int], capacity: int, large: float, groups: int):
        self.capacity, self.runs, self.sequences = capacity, [], 0
        self.used: dict[int, int] = defaultdict(int)
        self.room: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room left: (first sequence, how many)
        left = {n: c for n, c in histogram.items() if c}
        if full := left.pop(capacity, 0):
            self._run(capacity, full, 1, self._new(full), 0)
        big = sorted((n for n in left if n > large * capacity), reverse=True)
        if len(big) > 1:
            self._large([(n, left[n]) for n in big], groups, left)
        for n in sorted(left, reverse=True):
            self._best_fit(n, left[n])

    def _new(self, n: int) -> int:
        self.sequences += n
        return self.sequences - n

    def _run(self, length: int, count: int, per: int, base: int, offset: int) -> None:
        self.runs.append((length, self.used[length], count, per, base, offset))
        self.used[length] += count

    def _large(self, lengths: list[tuple[int, int]], groups: int, left: dict[int, int]) -> None:
        total = sum(c for _, c in lengths)
        each = -(-total // min(groups, len(lengths)))
        members: list[list[list[int]]] = [[]]
        room = each
        for n, c in lengths:
            while c:
                if not room:
                    members.append([])
                    room = each
                take = min(c, room)
                members[-1].append([n, take])
                c -= take
                room -= take
        sizes: list[int] = []
        merged: list[list[list[int]]] = []
        for m in members:
            if sizes and m[0][0] == sizes[-1]:
                merged[-1] += m
            else:
                sizes.append(m[0][0])
                merged.append(m)
        demand = np.array([sum(c for _, c in m) for m in merged], float)
        for counts, often in configurations(np.array(sizes), demand, self.capacity):
            places = [g for g in range(len(sizes)) for _ in range(counts[g])]
            often = min([often, *(sum(c for _, c in merged[g]) // counts[g] for g in set(places))])
            if not often or not places:
                continue
            taken = [self._take(merged[g], often) for g in places]
            done = 0
            while done < often:  # copies whose documents have the same lengths make a class
                n = min(t[0][1] for t in taken)
                base, offset = self._new(n), 0
                for t in taken:
                    self._run(t[0][0], n, 1, base, offset)
                    left[t[0][0]] -= n
                    offset += t[0][0]
                    t[0][1] -= n
                    if not t[0][1]:
                        t.pop(0)
                self.room[self.capacity - offset].append((base, n))
                done += n

    @staticmethod
    def _take(group: list[list[int]], count: int) -> list[list[int]]:
        out = []
        while count:
            n = min(count, group[0][1])
            out.append([group[0][0], n])
            group[0][1] -= n
            count -= n
            if not group[0][1]:
                group.pop(0)
        return out

    def _best_fit(self, length: int, count: int) -> None:
        for room in sorted(r for r in self.room if r >= length):
            if not count:
                return
            per, waiting = room // length, self.room.pop(room)
            while waiting and count:
                base, n = waiting.pop()
                count -= self._fill(length, count, per, base, n, room)
            if waiting:
                self.room[room] += waiting
        if count:
            per = self.capacity // length
            n = -(-count // per)
            self._fill(length, count, per, self._new(n), n, self.capacity)

    def _fill(self, length: int, count: int, per: int, base: int, n: int, room: int) -> int:
        """Put up to count pieces into n sequences with the same room; returns how many went in."""
        offset, whole = self.capacity - room, min(n, count // per)
        put = whole * per
        if whole:
            self._run(length, put, per, base, offset)
            self._spare(room - per * length, base, whole)
        if whole < n:
            if rest := min(count - put, per - 1):
                self._run(length, rest, per, base + whole, offset)
                self._spare(room - rest * length, base + whole, 1)
                put += rest
                whole += 1
            self._spare(room, base + whole, n - whole)
        return put

    def _spare(self, room: int, base: int, n: int) -> None:
        if room and n:
            self.room[room].append((base, n))

    def arrays(self) -> np.ndarray:
        """Runs sorted by length and first rank: columns length, first, per, base, offset."""
        runs = np.array([(a, b, d, e, f) for a, b, _, d, e, f in self.runs], dtype=np.int64).reshape(-1, 5)
        return runs[np.lexsort((runs[:, 1], runs[:, 0]))]


#: What counts as large, as a share of the capacity, and the number of groups: each is tried.
SCHEMES = ((1 / 2, 16), (1 / 3, 32), (1 / 4, 24))


def best_plan(histogram: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """The plan with the fewest sequences among SCHEMES; the first of equals."""
    return min((Plan(histogram, capacity, *scheme) for scheme in SCHEMES), key=lambda p: p.sequences)


def _placed(runs: np.ndarray, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    key = (runs[:, 0] << 48) | runs[:, 1]
    run = runs[np.searchsorted(key, (length << 48) | rank, "right") - 1]
    over = rank - run[:, 1]
    return run[:, 3] + over // run[:, 2], run[:, 4] + over % run[:, 2] * length


def pack(docs: DataFrame, id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """Pieces of all documents with sequence_id and offset."""
    cut = materialize(pieces(docs, id, text, capacity, vocabulary), "pieces")
    histogram = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # capacity rows at most
    runs = best_plan(histogram, capacity).arrays()
    # As many parts of a length as its pieces need: a broadcast of capacity rows at most.
    parts_of = cut.sparkSession.createDataFrame([(n, -(-c // max(PART_ROWS, isqrt(c)))) for n, c in histogram.items()], "length long, _parts long")
    rows = cut.join(F.broadcast(parts_of), "length").withColumn("_part", F.pmod(F.xxhash64(id, "piece", "ids_crc32"), F.col("_parts"))).repartition("length", "_part")
    before = W.partitionBy("length").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    parts = rows.groupBy("length", "_part").agg(F.count("*").alias("_n"))
    parts = parts.select("length", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = F.row_number().over(W.partitionBy("length", "_part").orderBy(id, "piece", "ids_crc32"))
    ranked = rows.withColumn("_within", within).join(parts, ["length", "_part"])
    ranked = ranked.select(id, "piece", "start", "length", "ids_crc32", (F.col("_before") + F.col("_within") - 1).alias("_rank"))
    kind = cut.schema[id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "_rank"))
            sequence, offset = _placed(runs, length, rank)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=[*cut_names, "sequence_id", "offset"])

    cut_names = ["_id", "piece", "start", "length", "ids_crc32"]
    schema = f"_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked.withColumnRenamed(id, "_id").mapInArrow(tidy(run), schema).withColumnRenamed("_id", id)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"))
