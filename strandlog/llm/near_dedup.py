"""MinHash near-duplicates through a multi-index Hamming join.

Documents are sets of word shingles. Documents with equal sets (128-bit digests) are one
node of the graph, so copies cost nothing further. Each node has a signature of POSITIONS
b-bit minima (b = 16). Two signatures are candidates if they differ in at most `errors`
positions, chosen so that a pair at the similarity asked for exceeds it with a probability
of about one in a million. A key has three positions at least: with 8 bits, texts that have nothing in common would share
keys of 24 bits more often the more texts there are, until most nodes are in one group; with 16 bits that isn't so. Candidates are found by pigeonhole: positions are dealt to
(errors + 1) / 2 chunks, rounded up, so any such pair has a chunk with one difference or none, and
each node is filed under every chunk with each single position left out. Every pair within the
distance shares a key; every link is then confirmed on the full sets.

Not all pairs of a key are made. First each node is held against the least node of its key
(within a slice, then over all slices, so a key that a third of all nodes share sends one row a
slice). Links give components. Keys whose nodes are in one component by then need nothing
more. The nodes of the others form groups: nodes with such a key in common are in one. Each group is held
against itself in blocks of about BLOCK bytes, which carry the whole sets. A task looks for pairs
within the distance whose components differ, closest first, confirms them on the sets at once, and puts out a
spanning forest of the links it found: at most one a node. No pair that is refuted leaves a task. Nodes outside the largest
component of a group are held against all, those inside only against those outside, so a large group of linked
copies is sent once for every block of nodes that aren't linked to it. What is sent grows with the square of a group, so pairs of
blocks are searched in passes, and a pass's shuffle files go before the next: disk is in proportion to the sets. A group of nodes that are within the distance
and not similar enough has as many comparisons as pairs, in memory, but never as many rows.

Components come from contracting trees of least neighbours, each step written to the shared
folder. Nothing but counts reaches the driver.

A null or empty text, or one without words, has the empty set and is linked with nothing.
Very long texts have all their shingles, and are in memory one by one if they exceed a slice.
Rows that share an id and have words are one node of the links. A null id is no document's least id: such rows are
ordered last, told apart by their sets, and have a null component_id unless a document with an
id is linked. Ties between equally close nodes don't matter, as all pairs across components are looked at. An empty
table gives no rows. Only the named columns are read. Ids are whole numbers below 2 ** 62.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from strandlog.workspace import materialize, passing, release

from .tables import table
from .textvec import _U, SMALL_SLICE, Words, mix64, reduce_min, seeds, slices, span_hashes, tidy, utf8

POSITIONS = 128
#: Minima, and bytes of a signature.
MINIMUM = np.dtype(np.uint16)
SIGN_BYTES = POSITIONS * MINIMUM.itemsize
#: Bytes of signatures and sets in a block; a task holds two blocks at a time.
BLOCK = 1 << 19
#: Groups whose nodes would be sent more often than this in pairs of blocks, on average, are searched key by key: a node has so many keys.
WIDE = POSITIONS
#: Bytes that a pass of the search sends, at least; at most it is these or twice the bytes of all nodes in groups.
PASS_BYTES = 1 << 28
#: Pairs of signatures in memory at a time, closest pairs of a node that are confirmed first, and shingles confirmed at a time.
PAIRS, CLOSEST, GATHERED = 1 << 15, 32, 1 << 20
NULL_ID = 1 << 62
#: Standard deviations of the number of differing positions that a signature may exceed its mean by.
MARGIN = 5.2

_XOR = seeds(POSITIONS, 41)
_MUL = seeds(POSITIONS, 42) | _U(1)
_CELL = seeds(POSITIONS, 43)
_PLACE = seeds(POSITIONS, 60)
_SALT = seeds(64, 44)


def errors(percent: int, positions: int = POSITIONS) -> int:
    """Differing positions up to which a pair is a candidate."""
    p = 1 - percent / 100
    return min(positions - 1, ceil(positions * p + MARGIN * sqrt(positions * p * (1 - p))))


def shingles(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, sorted within each text, and the n + 1 bounds of the texts."""
    words = Words(column, lower=True)
    hashes = words.hashes()
    at, value = words.windows(hashes, size)
    few = np.flatnonzero((words.counts > 0) & (words.counts < size))
    whole = span_hashes(hashes, words.first[few], words.first[few] + words.counts[few])
    doc, value = np.concatenate([words.doc[at], few]), np.concatenate([value, whole])
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    own = np.append(True, (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])) if len(doc) else np.zeros(0, bool)
    doc, value = doc[own], value[own]
    return value, np.searchsorted(doc, np.arange(len(words.counts) + 1)).astype(np.int64)


def signatures(value: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One minimum for each position and text."""
    counts = np.diff(bounds)
    out = np.zeros((len(counts), POSITIONS), MINIMUM)
    for j in range(POSITIONS):
        out[:, j] = (reduce_min((value ^ _XOR[j]) * _MUL[j], bounds, counts, 0) >> _U(24)).astype(MINIMUM)
    return out


def _sums(value: np.ndarray, bounds: np.ndarray, salt: np.uint64) -> np.ndarray:
    total = np.concatenate((np.zeros(1, _U), np.cumsum(mix64(value ^ salt), dtype=_U)))
    return (total[bounds[1:]] - total[bounds[:-1]]).view(np.int64)


def _sign(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text", SMALL_SLICE):
                value, bounds = shingles(part.column("_text"), size)
                sign = pa.FixedSizeBinaryArray.from_buffers(pa.binary(SIGN_BYTES), part.num_rows, [None, pa.py_buffer(signatures(value, bounds).tobytes())])
                columns = [part.column("_id"), part.column("_x"), pa.array(np.diff(bounds)), *(pa.array(_sums(value, bounds, s)) for s in _SALT[:2]), sign.cast(pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["_id", "_x", "_n", "_d1", "_d2", "_sign"])

    return tidy(run)


def _matrix(column: pa.Array) -> np.ndarray:
    """Signatures as rows of minima."""
    if not len(column):
        return np.zeros((0, POSITIONS), MINIMUM)
    bufs = column.buffers()
    offset = int(np.frombuffer(bufs[1], np.int32)[column.offset])
    return np.frombuffer(bufs[2], MINIMUM, len(column) * POSITIONS, offset).reshape(-1, POSITIONS)


def keys(sign: np.ndarray, allowed: int) -> np.ndarray:
    """POSITIONS keys of each signature: for every chunk, the chunk without each of its positions in turn."""
    cells = mix64(sign.astype(_U) + _CELL[None, :])
    out = np.empty(sign.shape, _U)
    for chunk in np.array_split(np.arange(POSITIONS), ceil((allowed + 1) / 2)):
        out[:, chunk] = (cells[:, chunk].sum(axis=1, dtype=_U)[:, None] - cells[:, chunk]) + _PLACE[chunk][None, :]
    return mix64(out)


def _key_slices(batches: Iterator[pa.RecordBatch], rows: int = 4096) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _stars(allowed: int):
    """Rows (key, node, other): a key's least node in a slice, or another node of the key with that one as other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _key_slices(batches):
            key = keys(_matrix(part.column("_sign")), allowed).ravel()
            node = np.repeat(np.asarray(part.column("_node")), POSITIONS)
            order = np.lexsort((node, key))
            key, node = key[order], node[order]
            first = np.append(True, key[1:] != key[:-1])
            head = node[first][np.cumsum(first) - 1]
            pairs = np.unique(np.stack([node[~first], head[~first]]), axis=1)
            pairs = pairs[:, pairs[0] != pairs[1]]
            route = mix64(pairs[0].view(_U) ^ mix64(pairs[1].view(_U)))
            none = pa.nulls(int(first.sum()), pa.int64())
            columns = [
                pa.array(np.concatenate([key[first], route]).view(np.int64)),
                pa.array(np.concatenate([node[first], pairs[0]])),
                pa.concat_arrays([none, pa.array(pairs[1])]),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["_key", "_node", "_other"])

    return tidy(run)


def _filed(allowed: int):
    """Rows (key, node) for all keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _key_slices(batches):
            key = keys(_matrix(part.column("_sign")), allowed)
            columns = [pa.array(key.ravel().view(np.int64)), pa.array(np.repeat(np.asarray(part.column("_node")), POSITIONS))]
            yield pa.RecordBatch.from_arrays(columns, names=["_key", "_node"])

    return tidy(run)


class Block:
    """Nodes that one task holds against each other: their blocks (own), ids, components, signatures and sets."""

    def __init__(self, own: np.ndarray, node: np.ndarray, comp: np.ndarray, sign: np.ndarray, value: np.ndarray, counts: np.ndarray):
        self.own, self.node, self.sign, self.value, self.counts = own, node, sign, value, counts
        self.bounds = np.concatenate(([0], np.cumsum(counts)))
        _, self.number, self.members = np.unique(comp, return_inverse=True, return_counts=True)
        self.label = np.arange(len(self.members))
        self.local: np.ndarray | None = None
        self.filed: np.ndarray | None = None

    def apart(self, x: int, y: np.ndarray) -> np.ndarray:
        return y[self.label[self.number[y]] != self.label[self.number[x]]]

    def close(self, x: int, y: np.ndarray, allowed: int, key: int | None) -> np.ndarray:
        """Those of y that are within the distance of x, closest first; with a key, those that share no earlier one with x."""
        far = (self.sign[y] != self.sign[x]).sum(axis=1)
        y = y[np.argsort(far, kind="stable")][: int((far <= allowed).sum())]
        if key is not None and len(y):
            if self.filed is None:
                self.filed = keys(self.sign, allowed)
            y = y[self.filed[y, (self.filed[y] == self.filed[x]).argmax(axis=1)] == np.int64(key).view(_U)]
        return y

    def shared(self, x: int, y: np.ndarray) -> np.ndarray:
        """Sizes of the intersections of x's whole set with those of y."""
        if self.local is None:
            names, self.local = np.unique(self.value, return_inverse=True)
            self.mark = np.zeros(len(names), bool)
        own = self.local[self.bounds[x] : self.bounds[x + 1]]
        self.mark[own] = True
        ends = np.cumsum(self.counts[y])
        at = np.arange(ends[-1]) + np.repeat(self.bounds[y] - ends + self.counts[y], self.counts[y])
        found = np.add.reduceat(self.mark[self.local[at]], ends - self.counts[y], dtype=np.int64)
        self.mark[own] = False
        return found

    def links(self, i: int, j: int, allowed: int, percent: int, key: int | None = None) -> np.ndarray:
        """A spanning forest of the links between components: of nodes of blocks i and j, or of all nodes if i is j.

        All pairs within the distance are confirmed on their whole sets, but for those that are in one component by then. Of
        two nodes of one block and different components, at least one is outside the block's largest component.
        """
        out: list[tuple[int, int]] = []
        if len(self.members) > 1:
            main = self.number == self.members.argmax()
            left, right = (np.flatnonzero(~main), np.arange(len(self.node))) if i == j else (np.flatnonzero(self.own == i), np.flatnonzero(self.own == j))
            # Positions whose two lowest bits differ do differ: most pairs are beyond the distance by those alone.
            low = [np.packbits(self.sign >> bit & 1, axis=1).view(_U) for bit in (0, 1)]
            step = max(1, PAIRS // max(1, len(right)))
            for at in range(0, len(left), step):
                rows = left[at : at + step]
                differ = (low[0][rows][:, None, :] ^ low[0][right][None, :, :]) | (low[1][rows][:, None, :] ^ low[1][right][None, :, :])
                ok = np.bitwise_count(differ).sum(axis=2, dtype=np.int16) <= allowed
                ok &= self.number[rows][:, None] != self.number[right][None, :]
                few, many = np.minimum(self.counts[rows][:, None], self.counts[right][None, :]), np.maximum(self.counts[rows][:, None], self.counts[right][None, :])
                ok &= 100 * few >= percent * many
                if i == j:
                    ok &= main[right][None, :] | (right[None, :] > rows[:, None])
                for k in np.flatnonzero(ok.any(axis=1)).tolist():
                    out += self._join(int(rows[k]), right[ok[k]], allowed, percent, key)
        return np.array(out, np.int64).reshape(-1, 2).T

    def _join(self, x: int, y: np.ndarray, allowed: int, percent: int, key: int | None) -> list[tuple[int, int]]:
        out = []
        y, take = self.close(x, self.apart(x, y), allowed, key), CLOSEST
        while len(y):
            take = max(1, min(take, int(np.searchsorted(np.cumsum(self.counts[y]), GATHERED, "right"))))
            some, y, take = y[:take], y[take:], len(self.node)
            both = self.shared(x, some)
            for z in some[100 * both >= percent * (self.counts[x] + self.counts[some] - both)].tolist():
                a, b = self.label[self.number[x]], self.label[self.number[z]]
                if a != b:
                    self.label[self.label == b] = a
                    out.append((min(int(self.node[x]), int(self.node[z])), max(int(self.node[x]), int(self.node[z]))))
            y = self.apart(x, y)
        return out


def _block_links(allowed: int, percent: int, keyed: bool):
    """Links (a, b) from rows sorted by group and pair of blocks; a task holds one pair of blocks at a time."""

    def emit(group: tuple[int, int, int], held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        found = Block(*(np.concatenate(x) for x in zip(*held, strict=True))).links(*group[1:], allowed, percent, group[0] if keyed else None)
        return pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1])], names=["_a", "_b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            group = np.stack([np.asarray(batch.column(c)).astype(np.int64) for c in ("_group", "_i", "_j")])
            data, offsets = utf8(batch.column("_set"))
            offsets = offsets // 8
            value = data.view(_U)
            columns = (*(np.asarray(batch.column(c)) for c in ("_own", "_node", "_comp")), _matrix(batch.column("_sign")))
            cuts = np.append(np.flatnonzero(np.append(True, (group[:, 1:] != group[:, :-1]).any(axis=0))), batch.num_rows)
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                key = tuple(group[:, a].tolist())
                if key != now:
                    if held:
                        yield emit(now, held)
                    now, held = key, []
                held.append((*(c[a:b] for c in columns), value[offsets[a] : offsets[b]], np.diff(offsets[a : b + 1])))
        if held:
            yield emit(now, held)

    return tidy(run)


def _within(allowed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far = (_matrix(batch.column("_sa")) != _matrix(batch.column("_sb"))).sum(axis=1)
            yield batch.select(["_a", "_b"]).filter(pa.array(far <= allowed))

    return tidy(run)


def _shared_keys(allowed: int):
    """Keys that both nodes of a pair are filed under, each with the pair's lesser node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _key_slices(batches):
            one, two = (keys(_matrix(part.column(c)), allowed) for c in ("_sa", "_sb"))
            same = one == two
            key, node = one[same], np.repeat(np.asarray(part.column("_a")), same.sum(axis=1))
            order = np.lexsort((node, key))
            key, node = key[order], node[order]
            first = np.append(True, key[1:] != key[:-1]) if len(key) else np.zeros(0, bool)
            yield pa.RecordBatch.from_arrays([pa.array(key[first].view(np.int64)), pa.array(node[first])], names=["_key", "_least"])

    return tidy(run)


def _near(percent: int):
    """Pairs whose full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for a, b in zip(batch.column("_set_a"), batch.column("_set_b"), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), _U) for v in (a, b))
                both = np.concatenate([x, y])
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                ok.append(100 * shared >= percent * (len(both) - shared))
            yield batch.select(["_a", "_b"]).filter(pa.array(ok, pa.bool_()))

    return tidy(run)


def _set_rows(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text", SMALL_SLICE):
                value, bounds = shingles(part.column("_text"), size)
                sets = pa.LargeBinaryArray.from_buffers(pa.large_binary(), part.num_rows, [None, pa.py_buffer((bounds * 8).tobytes()), pa.py_buffer(value.tobytes())])
                columns = [part.column("_id"), *(pa.array(_sums(value, bounds, s)) for s in _SALT[:2]), sets.cast(pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["_id", "_d1", "_d2", "_set"])

    return tidy(run)


def _pairs(rows: DataFrame) -> DataFrame:
    """Distinct (a, b) with a < b from columns _a, _b in any order."""
    return rows.select(F.least("_a", "_b").alias("_a"), F.greatest("_a", "_b").alias("_b")).filter("_a < _b").distinct()


def _roots(to: DataFrame) -> DataFrame:
    """(node, comp) from (node, to), a forest in which every node is tied to a lesser one or to itself: its tree's root."""
    hops = materialize(to, "hops")
    while True:
        further = hops.select(F.col("_node").alias("_to"), F.col("_to").alias("_next"))
        jumped = materialize(hops.join(further, "_to").select("_node", F.col("_next").alias("_to"), (F.col("_next") < F.col("_to")).alias("_moved")), "hops")
        release(hops)
        hops = jumped.select("_node", "_to")
        hops.written_to = jumped.written_to
        if not jumped.filter("_moved").limit(1).count():
            return hops


def components(links: DataFrame) -> DataFrame:
    """(node, comp) for every node of links (a, b): the least node reachable.

    Every node is tied to its least neighbour; the trees that this makes are contracted to their roots, and the edges between them go
    through the same again, until there are none. So each edge is joined twice, and again only if it still leads to
    another tree. Spark splits what a hot component sends to one task in these joins (adaptive skew joins); aggregates are partial.
    """
    edges = materialize(_pairs(links).select(F.col("_a").alias("_x"), F.col("_b").alias("_y")), "edges")
    labels = None
    while True:
        both = edges.union(edges.select("_y", "_x"))
        roots = _roots(both.groupBy(F.col("_x").alias("_node")).agg(F.least(F.col("_x"), F.min("_y")).alias("_to")))
        root = lambda c: roots.select(F.col("_node").alias(c), F.col("_to").alias(f"{c}_root"))
        if labels is None:
            labels = roots.select("_node", F.col("_to").alias("_comp"))
            labels.written_to = roots.written_to
        else:
            before, labels = labels, materialize(labels.join(root("_comp"), "_comp", "left").select("_node", F.coalesce("_comp_root", "_comp").alias("_comp")), "labels")
            release(before)
        left = _pairs(edges.join(root("_x"), "_x").join(root("_y"), "_y").select(F.col("_x_root").alias("_a"), F.col("_y_root").alias("_b")))
        left = materialize(left.select(F.col("_a").alias("_x"), F.col("_b").alias("_y")), "edges")
        release(edges)
        if labels.written_to != roots.written_to:
            release(roots)
        edges = left
        if not edges.limit(1).count():
            release(edges)
            return labels


class _Graph:
    """Nodes, their signatures and sets, and the links confirmed so far."""

    def __init__(self, docs: DataFrame, nodes: DataFrame, size: int, percent: int, links: DataFrame | None):
        self.docs, self.nodes, self.size, self.percent = docs, nodes, size, percent
        self.allowed = errors(percent)
        self.sign = nodes.select("_node", "_sign")
        self.labels = None if links is None else components(links)
        self.held: int | None = None

    def comp(self, rows: DataFrame, name: str, out: str) -> DataFrame:
        """rows with the component of the node in column name."""
        if self.labels is None:
            return rows.withColumn(out, F.col(name))
        labels = self.labels.select(F.col("_node").alias(name), F.col("_comp").alias(out))
        return rows.join(labels, name, "left").withColumn(out, F.coalesce(out, name))

    def apart(self, pairs: DataFrame) -> DataFrame:
        """Pairs whose nodes are in different components."""
        return self.comp(self.comp(pairs, "_a", "_ca"), "_b", "_cb").filter("_ca <> _cb").select("_a", "_b")

    def beside(self, pairs: DataFrame) -> DataFrame:
        """Pairs with both signatures."""
        side = lambda c: self.sign.select(F.col("_node").alias(f"_{c}"), F.col("_sign").alias(f"_s{c}"))
        return pairs.join(side("a"), "_a").join(side("b"), "_b")

    def close(self, pairs: DataFrame) -> DataFrame:
        """Pairs within the signature distance."""
        return self.beside(pairs).mapInArrow(_within(self.allowed), "_a long, _b long")

    def fetch(self, nodes: DataFrame) -> None:
        """Write the sets of nodes (column _node); their texts are read again and shuffled once."""
        wanted = self.nodes.join(nodes, "_node", "left_semi").select("_node", F.col("_rid").alias("_id"), "_d1", "_d2")
        some = self.docs.join(wanted.select("_id").distinct(), "_id", "left_semi")
        sets = some.mapInArrow(_set_rows(self.size), "_id long, _d1 long, _d2 long, _set binary").dropDuplicates(["_id", "_d1", "_d2"])
        self.sets = materialize(sets.join(wanted, ["_id", "_d1", "_d2"]).select("_node", "_set"), "sets")

    def add(self, found: DataFrame) -> None:
        """Add confirmed links: components of components so far, which then rename those."""
        found = materialize(found, "links")
        if not found.limit(1).count():
            return
        merged = components(_pairs(self.comp(self.comp(found, "_a", "_ca"), "_b", "_cb").select(F.col("_ca").alias("_a"), F.col("_cb").alias("_b"))))
        if self.labels is not None:
            to = merged.select(F.col("_node").alias("_comp"), F.col("_comp").alias("_to"))
            moved = self.labels.join(to, "_comp", "left").select("_node", F.coalesce("_to", "_comp").alias("_comp"))
            merged = materialize(moved.union(merged.join(self.labels.select("_node"), "_node", "left_anti")), "labels")
        self.labels = merged

    def confirm(self, pairs: DataFrame) -> None:
        """Add the links among pairs."""
        side = lambda c: self.sets.select(F.col("_node").alias(f"_{c}"), F.col("_set").alias(f"_set_{c}"))
        self.add(pairs.join(side("a"), "_a").join(side("b"), "_b").mapInArrow(_near(self.percent), "_a long, _b long"))

    def dealt(self, groups: DataFrame) -> DataFrame:
        """(_group, _node, _comp) of groups (_group, _node) with more than one component, with the group's numbers of blocks and of copies of a node.

        A group of at most BLOCK bytes is one block. Else the nodes outside its largest component are dealt to _outer blocks, those inside
        to _inner ones after them.
        """
        rows = groups.join(self.nodes.select("_node", (F.col("_n") * 8 + SIGN_BYTES).alias("_bytes")), "_node")
        rows = materialize(self.comp(rows, "_node", "_comp"), "grouped")
        if self.held is None:
            self.held = rows.agg(F.sum("_bytes")).first()[0] or 0
        parts = rows.groupBy("_group", "_comp").agg(F.sum("_bytes").alias("_bytes"))
        sums = parts.groupBy("_group").agg(F.sum("_bytes").alias("_all"), F.max(F.struct("_bytes", "_comp")).alias("_main"), F.count("*").alias("_comps"))
        blocks = lambda c: F.ceil(c / BLOCK).cast("int")
        whole = F.col("_all") <= BLOCK
        sums = sums.filter("_comps > 1").select(
            "_group",
            F.when(whole, F.lit(None)).otherwise(F.col("_main._comp")).alias("_inside"),
            F.when(whole, 1).otherwise(blocks(F.col("_all") - F.col("_main._bytes"))).alias("_outer"),
            F.when(whole, 0).otherwise(blocks(F.col("_main._bytes"))).alias("_inner"),
            (F.col("_main._bytes") / F.col("_all")).alias("_share"),
        )
        sums = sums.withColumn("_copies", F.col("_outer") + (1 - F.col("_share")) * F.col("_inner"))
        return rows.select("_group", "_node", "_comp", "_bytes").join(sums, "_group")

    def search(self, dealt: DataFrame, keyed: bool) -> DataFrame:
        """Links between components within each group, from all pairs of its nodes that are within the distance; written pass by pass."""
        n = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        inside, at = F.coalesce(F.col("_comp") == F.col("_inside"), F.lit(False)), F.xxhash64("_node")
        own = F.when(inside, F.col("_outer") + F.pmod(at, F.col("_inner"))).otherwise(F.pmod(at, F.col("_outer"))).cast("int")
        others = F.col("_outer") + F.when(inside, 0).otherwise(F.col("_inner"))
        sent = dealt.agg(F.sum(F.col("_bytes") * others)).first()[0] or 0
        passes = max(1, ceil(sent / max(PASS_BYTES, 2 * self.held)))
        rows = dealt.withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), others - 1)))
        rows = rows.select("_group", F.least("_own", "_other").alias("_i"), F.greatest("_own", "_other").alias("_j"), "_own", "_node", "_comp")
        found = None
        for k in range(passes):
            some = rows.filter(F.pmod(F.xxhash64("_group", "_i", "_j"), F.lit(passes)) == k) if passes > 1 else rows
            some = some.join(self.sign, "_node").join(self.sets, "_node")
            some = some.repartition(n, "_group", "_i", "_j").sortWithinPartitions("_group", "_i", "_j")
            links = materialize(some.mapInArrow(_block_links(self.allowed, self.percent, keyed), "_a long, _b long"), "found")
            found = links if found is None else found.union(links)
        return found


def link(docs: DataFrame, nodes: DataFrame, size: int, percent: int, links: DataFrame | None = None) -> DataFrame | None:
    """(node, comp) for all nodes with links, or None without links. Given links hold from the start."""
    with passing() as keep:
        labels = _link(docs, nodes, size, percent, links)
        if labels is not None:
            keep(labels)
    return labels


def _link(docs: DataFrame, nodes: DataFrame, size: int, percent: int, links: DataFrame | None) -> DataFrame | None:
    graph = _Graph(docs, nodes, size, percent, links)
    stars = graph.sign.select("_node", "_sign").mapInArrow(_stars(graph.allowed), "_key long, _node long, _other long")
    least = F.coalesce("_other", F.min("_node").over(W.partitionBy("_key")))
    pairs = materialize(_pairs(stars.select(F.col("_node").alias("_a"), least.alias("_b")).filter("_a <> _b")), "stars")
    alive = materialize(pairs.select(F.col("_a").alias("_node")).union(pairs.select("_b")).distinct(), "alive")
    if not alive.limit(1).count():
        return graph.labels
    graph.fetch(alive)
    close = materialize(graph.close(pairs), "close")
    # One pair of each node links most; the other pairs are needed only where they join components.
    graph.confirm(close.groupBy("_b").agg(F.min("_a").alias("_a")).select("_a", "_b"))
    graph.confirm(graph.apart(close))
    # A key has members in two components only if it made a pair whose nodes are still apart.
    apart = materialize(graph.apart(pairs), "apart")
    if not apart.limit(1).count():
        return graph.labels
    mixed = graph.beside(apart).mapInArrow(_shared_keys(graph.allowed), "_key long, _least long")
    mixed = materialize(mixed.groupBy("_key").agg(F.min("_least").alias("_least")), "mixed")
    filed = graph.sign.join(alive, "_node", "left_semi").mapInArrow(_filed(graph.allowed), "_key long, _node long")
    # Nodes with a mixed key in common are one group, and so are groups with a node in common: no pair still to be made is across groups.
    # The keys' least nodes that a node is filed with are tied to the least of those, so edges are not much more than nodes.
    beside = filed.join(mixed, "_key").select("_node", "_least").distinct()
    beside = materialize(beside.withColumn("_a", F.min("_least").over(W.partitionBy("_node"))), "beside")
    edges = _pairs(beside.select("_a", F.col("_node").alias("_b")).union(beside.select("_a", F.col("_least").alias("_b"))))
    groups = components(edges).select("_node", F.col("_comp").alias("_group"))
    dealt = graph.dealt(groups)
    wide = F.col("_copies") > WIDE
    found = graph.search(dealt.filter(~wide), False)
    if dealt.filter(wide).limit(1).count():
        members = filed.join(dealt.filter(wide).select("_node"), "_node", "left_semi").join(mixed, "_key", "left_semi")
        found = found.union(graph.search(graph.dealt(members.select(F.col("_key").alias("_group"), "_node")), True))
    graph.add(found)
    return graph.labels


def _linked(docs: DataFrame, id: str, text: str, size: int, percent: int, by_id: bool) -> tuple[DataFrame, DataFrame]:
    """Per row _id, _x (hash of the text), _n, _node and _comp (null without words); and the ids of several rows.

    A node is a set. It has its least id for a name, or a stand-in from NULL_ID on if it has no id, or
    its least id names a node already. With by_id, the sets of one id are linked.
    """
    own = docs.select(docs[id].cast("long").alias("_id"), F.xxhash64(docs[text]).alias("_x"), docs[text].alias("_text"))
    signed = materialize(own.mapInArrow(_sign(size), "_id long, _x long, _n long, _d1 long, _d2 long, _sign binary"), "signed")
    mark = ["_n", "_d1", "_d2"]
    some = signed.filter("_n > 0")
    nodes = some.groupBy(*mark).agg(F.min("_id").alias("_rid"), F.first("_sign").alias("_sign"))
    unnamed = F.lit(NULL_ID).bitwiseOR(F.xxhash64("_d1", "_d2").bitwiseAND(F.lit(NULL_ID - 1)))
    name = F.coalesce("_rid", unnamed)
    full = F.when(F.col("_n") > 0, F.struct(*mark))
    again = signed.filter("_id is not null").groupBy("_id").agg(F.count("*").alias("_rows"), (F.min(full) != F.max(full)).alias("_differ")).filter("_rows > 1")
    again = materialize(again.select("_id", "_differ"), "again")
    several = again.filter("_differ").select("_id")
    repeated = bool(several.limit(1).count())
    if repeated:
        named = nodes.join(several.withColumnRenamed("_id", "_rid"), "_rid", "left_semi").groupBy("_rid").agg(F.min(F.struct(*mark)).alias("_named"))
        name = F.when(F.col("_named") != F.struct(*mark), unnamed).otherwise(name)
        nodes = nodes.join(named, "_rid", "left").withColumn("_node", name).drop("_named")
    else:
        nodes = nodes.withColumn("_node", name)
    nodes = materialize(nodes, "nodes")
    links = None
    if repeated and by_id:
        beside = some.join(several, "_id", "left_semi").join(nodes.select(*mark, "_node"), mark).select("_id", "_node")
        beside = beside.join(beside.groupBy("_id").agg(F.min("_node").alias("_least")), "_id")
        links = materialize(_pairs(beside.select(F.col("_least").alias("_a"), F.col("_node").alias("_b"))), "same")
    # A null id can't be looked up by a plain join; such rows get their stand-in here.
    keyed = own.select(F.coalesce("_id", F.lit(NULL_ID)).alias("_id"), "_text")
    labels = link(keyed, nodes.withColumn("_rid", F.coalesce("_rid", F.lit(NULL_ID))), size, percent, links)
    named = nodes.select(*mark, "_node")
    if labels is not None:
        named = named.join(labels, "_node", "left").withColumn("_comp", F.coalesce("_comp", "_node"))
    else:
        named = named.withColumn("_comp", F.col("_node"))
    return signed.join(named, mark, "left").select("_id", "_x", "_n", "_node", "_comp"), again.select("_id")


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """Id, n_shingles, component_id and kept (whether the row's id is its component's) of every row."""
    kind = docs.schema[id].dataType.simpleString()
    comp = F.when(F.col("_comp") < NULL_ID, F.col("_comp")).when(F.col("_comp").isNull(), F.col("_id"))
    rows, _ = _linked(docs, id, text, size, percent, True)
    rows = rows.select(F.col("_id").cast(kind).alias(id), F.col("_n").alias("n_shingles"), comp.cast(kind).alias("component_id"))
    return rows.withColumn("kept", F.col(id).eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, id: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs with one document of each group of near-duplicates: the one with the least id.

    Here a document is an id with a set: texts that aren't similar stay each for itself, though they share an
    id, and no text goes unless one of its group stays. Of texts with one id and set that with the least hash stays, and of
    rows with one id and text that whose other columns come first as JSON. Rows without words are in no group; of those
    with one id and text one stays. Rows without an id can't be told apart by it and all stay.
    """
    rows, again = _linked(docs, id, text, size, percent, False)
    alone = F.col("_node").isNull()
    kept = rows.filter("_id is not null").groupBy("_comp", F.when(alone, F.col("_id")), F.when(alone, F.col("_x"))).agg(F.min(F.struct("_id", "_node", "_x")).alias("_kept"))
    kept = materialize(kept.select("_kept._id", "_kept._x"), "kept")
    match = lambda rows: (docs[id].cast("long") == rows["_id"]) & (F.xxhash64(docs[text]) == rows["_x"])
    more = kept.join(again, "_id", "left_semi")
    if more.limit(1).count():
        once = kept.join(again, "_id", "left_anti")
        rest = docs.join(more, match(more), "left_semi")
        others = F.to_json(F.struct(F.lit(1).alias("_"), *[rest[c] for c in docs.columns if c not in (id, text)]))
        first = F.row_number().over(W.partitionBy(rest[id], F.xxhash64(rest[text])).orderBy(others))
        place = "_place" + "_" * max(map(len, docs.columns))
        rest = rest.withColumn(place, first).filter(F.col(place) == 1).drop(place)
        found = docs.join(once, match(once), "left_semi").unionByName(rest)
    else:
        found = docs.join(kept, match(kept), "left_semi")
    return found.unionByName(docs.filter(docs[id].isNull()))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), size=3, percent=85)


OP4_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, s FROM (
  SELECT doc_id, array_to_string(ws[i:i + 2], ' ') AS s FROM d, unnest(range(1, len(ws) - 1)) AS u(i)
  UNION ALL SELECT doc_id, array_to_string(ws, ' ') FROM d WHERE len(ws) BETWEEN 1 AND 2)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s AS a JOIN s AS b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT a AS doc_id, a AS c FROM e UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id),
m AS (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(c, doc_id) AS component_id, coalesce(c, doc_id) = doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""
