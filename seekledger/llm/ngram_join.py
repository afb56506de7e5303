"""Jaccard self-join of word n-gram sets over a count-vector R-tree.

Tokens (the distinct n-grams of a document) are hashed into groups and a document is a point: its
count in each group. Two sets of sizes a and b with Jaccard at least p percent share at least
p (a + b) / (100 + p) tokens, and never more than the sum over groups of the smaller count, so a pair
or a pair of tree nodes whose summed minima fall short holds no link.

The space is first cut into tiles so that trees stay small. With d the largest symmetric difference
that a linked pair of these sizes can have, the groups are dealt to m > d segments; a linked pair
agrees in all of at least m - d segments, so a tile is (size class, segment, contents of the segment),
and a document lies in the tiles of its own size class and the next lower one. m is so chosen that few
documents have m - d empty segments; the others meet in a segment that is not empty and leave out their
empty ones. Tiles with one document are found by ``blocks.shared`` and never leave their block. Each other tile gets an R-tree, packed
along the points' order, and is joined with itself from the roots down.

Links are needed only between components, so groups of any size need no list of their pairs: equal
sets are one point from the start; a first round verifies every point against the smallest of its
tile, where size and a coarse point in the tile's rows already rule most of them out; then the tree join
lists, for points and foreign components of their tile, the best bound only; a last join lists every pair
of different components that the bound leaves over and verifies all of them. After it no link is missing.

Counts say little about large sets, so verification starts with parities: whether a set has an odd number of
tokens in each of about as many groups as it has tokens. Two sets differ in one token at least for each
group of unlike parity, and a linked pair in no more than its sizes allow. Only the tokens of the pairs that
are left over move, 64 times the parities' size.

Cases: null, empty and blank texts have no tokens and are linked with nothing; texts with fewer than
n words are one token; rows that repeat a ``doc_id`` are separate documents whose component is that of
the smallest ``doc_id``; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seekledger.llm.arrays import mix, windows, words
from seekledger.llm.blocks import ROW_BITS, Keys, answered, distinct, each_block, pack, shared, unpacked, with_answer
from seekledger.llm.components import components
from seekledger.llm.scratch import written

U = np.uint64
_TOKEN_BITS = 64 - ROW_BITS
_KEY_BITS = 44
#: Coordinates of a point.
GROUPS = 64
#: Points in a leaf and children of a node.
LEAF = 16
#: Pairs of nodes opened at a time: with 256 pairs of children each, a level holds some MB.
OPENED = 256
#: Points of a group of a large tile; a task joins one group with one other.
TILE_ROWS = 512
#: Points of whole tiles joined at a time, and pairs found that a task holds.
JOINED_ROWS, PAIRS = 20_000, 100_000
#: Bits of the parities in a tree's rows; whole parities are a power of two, no less than these or the set's size.
SHORT = 512
#: Bytes of a coarse point: sums of neighbouring coordinates, scaled to fit.
COARSE = 16


def tokens(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct tokens of all texts, document by document in ascending order; first of each)."""
    w = words(texts, lower=True)
    starts, hashes = windows(w, n)
    docs = w.doc[starts]
    counts = np.diff(w.first)
    for short in range(1, n):
        mine = np.flatnonzero(counts == short)
        at, h = windows(w, short, starts=w.first[mine])
        docs, hashes = np.concatenate([docs, w.doc[at]]), np.concatenate([hashes, mix(h, short)])
    packed = (docs.astype(U) << U(_TOKEN_BITS)) | (hashes >> U(ROW_BITS))
    packed = np.sort(packed)
    packed = packed[np.append(True, packed[1:] != packed[:-1])] if len(packed) else packed
    first = np.searchsorted(packed >> U(_TOKEN_BITS), np.arange(len(texts) + 1, dtype=U))
    return packed & U((1 << _TOKEN_BITS) - 1), first


class SizeClasses:
    """Sizes by class: linked sets are at most one class apart."""

    def __init__(self, percent: int, largest: int):
        bounds = [1]
        while bounds[-1] <= largest:
            bounds.append(max(bounds[-1] + 1, (bounds[-1] - 1) * 100 // percent + 1))
        self.bounds = np.array(bounds)
        top = self.bounds[1:] - 1  # the largest size of each class
        self.differences = np.append(top * (100 - percent) // percent, 0)
        self.segments = np.array([self._segments(int(d), int(n)) for d, n in zip(self.differences, self.bounds)])

    @staticmethod
    def _segments(d: int, n: int) -> int:
        """Segments for sets of n tokens that differ in d at most: the fewest that exceed d by more
        than the empty ones to be expected, with room."""
        if d == 0:
            return 1
        for m in range(d + 1, max(n, d + 1) + 1):
            if m - d >= 3 + 1.5 * m * math.exp(-n / m):
                return m
        return d + 1

    def of(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds, sizes, side="right") - 1


def _tile_keys(token: np.ndarray, first: np.ndarray, rows: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, key) of all tiles of the documents ``rows``."""
    sizes = np.diff(first)[rows]
    rows, sizes = rows[sizes > 0], sizes[sizes > 0]
    if not len(rows):
        return np.zeros(0, np.int64), np.zeros(0, U)
    classes = SizeClasses(percent, int(sizes.max()))
    docs, keys = [], []
    index = np.repeat(np.arange(len(rows)), sizes)
    at = np.arange(len(index)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(first[rows], sizes)
    value = token[at]
    spot, body = mix(value, 1) >> U(32), mix(value, 2)
    for lower in (0, 1):
        cls = classes.of(sizes) - lower
        segments = np.where(cls >= 0, classes.segments[np.maximum(cls, 0)], 0)
        spare = segments - np.where(cls >= 0, classes.differences[np.maximum(cls, 0)], 0)
        segments[segments == 1] = 0  # no difference allowed: equal sets, one point already
        base = np.cumsum(segments) - segments
        on = segments[index] > 0
        segment = (spot[on] * segments[index[on]].astype(U)) >> U(32)
        sums = np.zeros(int(segments.sum()), U)
        np.add.at(sums, base[index[on]] + segment.astype(np.int64), body[on])
        doc = np.repeat(np.arange(len(rows)), segments)
        number = np.arange(len(sums)) - base[doc]
        empty = sums == 0
        few = np.bincount(doc, empty, len(rows)) < spare
        salt = mix((cls[doc].astype(U) << U(32)) | number.astype(U), 3)
        key = mix(sums ^ salt, 4) >> U(64 - _KEY_BITS)
        sent = ~(empty & few[doc])
        docs.append(rows[doc[sent]])
        keys.append(key[sent])
    return np.concatenate(docs), np.concatenate(keys)


def _wanted(row: dict) -> np.ndarray:
    return np.sort(np.array([r["pos"] for r in row["points"] or []], np.int64))


def _point(token: np.ndarray) -> np.ndarray:
    return np.bincount((mix(token, 5) >> U(58)).astype(np.int64), minlength=GROUPS)[:GROUPS]


def _parities(token: np.ndarray) -> np.ndarray:
    """Bits packed in bytes: whether the set has an odd number of tokens in each group."""
    bits = 1 << (max(len(token), SHORT) - 1).bit_length()
    groups = np.bincount((mix(token, 8) & U(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((groups & 1).astype(np.uint8))


def _folded(parities: np.ndarray, size: int) -> np.ndarray:
    """The parities of the ``size`` bytes of wider groups."""
    return np.bitwise_xor.reduce(parities.reshape(-1, size), 0)


def _may_differ(size: np.ndarray, percent: int) -> np.ndarray:
    """Most tokens in one set only, of a linked pair whose sizes sum to ``size``."""
    return size - 2 * _need(size, percent)


def _packed(point: np.ndarray) -> bytes:
    """One byte a coordinate, or four where one byte is too small for some."""
    return point.astype(np.uint8 if point.max(initial=0) < 256 else "<u4").tobytes()


def _coarse(point: np.ndarray) -> tuple[int, int, int]:
    """(halvings, two words of eight bytes): byte << halvings is never less than the count it stands for."""
    sums, halved = point.reshape(COARSE, -1).sum(1), 0
    while (small := -(-sums >> halved)).max(initial=0) > 255:
        halved += 1
    words_ = small.astype(np.uint8).view("<i8")
    return halved, int(words_[0]), int(words_[1])


_COARSE_DDL = "halved int, coarse0 long, coarse1 long"


def _may_link(p: str, q: str, percent: int) -> Column:
    """Whether the coarse points' summed minima reach the least overlap."""
    def count(s: str, k: int) -> Column:
        byte = F.shiftright(F.col(f"{s}coarse{k // 8}"), 8 * (k % 8)).bitwiseAND(255)
        return F.call_function("shiftleft", byte, F.col(f"{s}halved"))

    shared_ = sum((F.least(count(p, k), count(q, k)) for k in range(COARSE)), F.lit(0))
    size = F.col(f"{p}n") + F.col(f"{q}n")
    return shared_ * (100 + percent) >= size * percent


def _need(size: np.ndarray, percent: int) -> np.ndarray:
    """Least overlap of a linked pair whose sizes sum to ``size``."""
    return -(-size * percent // (100 + percent))


def _points(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    read = lambda x: np.frombuffer(x, np.uint8 if len(x) == GROUPS else "<u4").astype("<u4").tobytes()
    rows = column.to_pylist()
    if all(len(x) == GROUPS for x in rows):
        return np.frombuffer(b"".join(rows), np.uint8).reshape(-1, GROUPS).astype(np.int32)
    return np.frombuffer(b"".join(map(read, rows)), "<u4").reshape(-1, GROUPS).astype(np.int32)


def _bounded(percent: int) -> Callable:
    """Keeps pairs (a, b, point_a, point_b) whose summed minima reach the least overlap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p, q = _points(batch.column("point_a")), _points(batch.column("point_b"))
            near = np.minimum(p, q).sum(1) >= _need(p.sum(1, dtype=np.int64) + q.sum(1, dtype=np.int64), percent)
            stay = pa.array(np.flatnonzero(near))
            yield pa.record_batch([batch.column("a").take(stay), batch.column("b").take(stay)], names=["a", "b"])

    return run


def _even(percent: int) -> Callable:
    """Keeps pairs (a, b, n_a, n_b, parity_a, parity_b) whose parities differ in no more groups than a link's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            get = lambda name: [np.frombuffer(x.as_buffer(), np.uint8) for x in batch.column(name)]
            unlike = []
            for x, y in zip(get("parity_a"), get("parity_b")):
                size = min(len(x), len(y))
                unlike.append(int(np.bitwise_count(_folded(x, size) ^ _folded(y, size)).sum()))
            sizes = batch.column("n_a").to_numpy() + batch.column("n_b").to_numpy()
            stay = pa.array(np.flatnonzero(np.array(unlike, np.int64) <= _may_differ(sizes, percent)))
            yield pa.record_batch([batch.column("a").take(stay), batch.column("b").take(stay)], names=["a", "b"])

    return run


def _verify(percent: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            get = lambda name: [np.frombuffer(x.as_buffer(), "<u8") for x in batch.column(name)]
            good = []
            for x, y in zip(get("set_a"), get("set_b")):
                both = np.concatenate([x, y])
                both.sort()
                shared_ = int((both[1:] == both[:-1]).sum())
                good.append(100 * shared_ >= percent * (len(both) - shared_))
            yield pa.record_batch([batch.column("a"), batch.column("b"), pa.array(good, pa.bool_())], names=["a", "b", "ok"])

    return run


def _levels(first: np.ndarray, count: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Nodes over runs of points: for each level (first child, number of children), leaves last.
    Runs never share a node; the top level has one node a run."""
    out = []
    while True:
        nodes = -(-count // LEAF)
        start = np.repeat(first, nodes) + LEAF * (np.arange(nodes.sum()) - np.repeat(np.cumsum(nodes) - nodes, nodes))
        left = np.repeat(first + count, nodes) - start
        out.append((start, np.minimum(left, LEAF)))
        first, count = np.cumsum(nodes) - nodes, nodes
        if (nodes == 1).all():
            return out[::-1]


class _Tree:
    """R-trees of many tiles, level by level. Points are sorted by (tile, size, coordinates)."""

    def __init__(self, tile: np.ndarray, size: np.ndarray, comp: np.ndarray, points: np.ndarray, percent: int):
        self.size, self.comp, self.points, self.percent = size, comp, points, percent
        first = np.flatnonzero(np.append(True, tile[1:] != tile[:-1]))
        self.levels = _levels(first, np.diff(np.append(first, len(tile))))
        self.bounds = []
        high, low, largest, c0, c1 = points, size, size, comp, comp
        for start, _ in reversed(self.levels):
            high, low = np.maximum.reduceat(high, start), np.minimum.reduceat(low, start)
            largest = np.maximum.reduceat(largest, start)
            c0, c1 = np.minimum.reduceat(c0, start), np.maximum.reduceat(c1, start)
            self.bounds.insert(0, (high, low, largest, c0, c1))

    def _near(self, a: np.ndarray, b: np.ndarray, level: int | None) -> np.ndarray:
        """Which pairs may hold a link between different components."""
        if level is None:
            high, low, largest, c0, c1 = self.points, self.size, self.size, self.comp, self.comp
        else:
            high, low, largest, c0, c1 = self.bounds[level]
        ok = ~((c0[a] == c1[a]) & (c0[a] == c0[b]) & (c0[b] == c1[b]))
        ok &= (largest[a] * 100 >= low[b] * self.percent) & (largest[b] * 100 >= low[a] * self.percent)
        a, b, places = a[ok], b[ok], np.flatnonzero(ok)
        need = _need(low[a] + low[b], self.percent)
        good = np.zeros(len(ok), bool)
        for k in range(0, len(a), 65_536):
            part = slice(k, k + 65_536)
            good[places[part]] = np.minimum(high[a[part]], high[b[part]]).sum(1) >= need[part]
        return good

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of points the bound leaves over, some tiles at a time."""
        roots = np.arange(len(self.levels[0][0]))
        for k in range(0, len(roots), OPENED):
            yield from self._down(roots[k : k + OPENED], roots[k : k + OPENED], 0)

    def _down(self, a: np.ndarray, b: np.ndarray, level: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        near = self._near(a, b, level)
        a, b = a[near], b[near]
        start, count = self.levels[level]
        for k in range(0, len(a), OPENED):
            x, y = a[k : k + OPENED], b[k : k + OPENED]
            n = count[x] * count[y]
            which = np.repeat(np.arange(len(x)), n)
            i = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            p = start[x[which]] + i // count[y[which]]
            q = start[y[which]] + i % count[y[which]]
            once = p <= q if level + 1 < len(self.levels) else p < q
            p, q = p[once], q[once]
            if level + 1 < len(self.levels):
                yield from self._down(p, q, level + 1)
            else:
                near = self._near(p, q, None)
                yield p[near], q[near]


def _tree_pairs(percent: int, all_pairs: bool) -> Callable:
    """Joins the tiles of a partition: rows (key, uid, comp, n, point, short) sorted by key."""

    def join(table: pa.Table) -> Iterator[pa.RecordBatch]:
        col = lambda name: table.column(name).to_numpy()
        key, uid, comp, size = col("key"), col("uid"), col("comp"), col("n").astype(np.int64)
        points = _points(table.column("point"))
        short = np.frombuffer(b"".join(table.column("short").to_pylist()), "<u8").reshape(-1, SHORT // 64)
        order = np.lexsort((uid, points[:, 1], points[:, 0], size, key))
        key, uid, comp, size, points, short = (x[order] for x in (key, uid, comp, size, points, short))
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for p, q in _Tree(key, size, comp, points, percent).pairs():
            even = np.bitwise_count(short[p] ^ short[q]).sum(1) <= _may_differ(size[p] + size[q], percent)
            p, q = p[even], q[even]
            if not len(p):
                continue
            if not all_pairs:  # of each point and foreign component, the best bound among those at hand
                spare = np.minimum(points[p], points[q]).sum(1) - _need(size[p] + size[q], percent)
                rank = np.lexsort((q, -spare, comp[q], p))
                p, q = p[rank], q[rank]
                best = np.append(True, (p[1:] != p[:-1]) | (comp[q[1:]] != comp[q[:-1]]))
                p, q = p[best], q[best]
            held.append((np.minimum(uid[p], uid[q]), np.maximum(uid[p], uid[q])))
            if sum(len(x) for x, _ in held) > PAIRS:
                yield pairs(held)
                held = []
        if held:
            yield pairs(held)

    def pairs(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        ab = np.unique(np.stack([np.concatenate(x) for x in zip(*held)], 1), axis=0)
        return pa.record_batch([pa.array(ab[:, 0], pa.int64()), pa.array(ab[:, 1], pa.int64())], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            if batch.num_rows == 0:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows < JOINED_ROWS:
                continue
            table = pa.Table.from_batches(held)
            last = table.column("key")[-1].as_py()
            key = table.column("key").to_numpy()
            whole = int(np.searchsorted(key, last))  # the last tile may go on in the next batch
            if whole:
                yield from join(table.slice(0, whole))
            held, rows = table.slice(whole).to_batches(), len(table) - whole
        if rows:
            yield from join(pa.Table.from_batches(held))

    return run


def similar_documents(docs: DataFrame, n: int = 5, percent: int = 80, text: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id``. Documents link when 100 x shared
    >= percent x all of their distinct n-grams; the component is the smallest ``doc_id`` that links
    reach, the document's own included."""
    return _classes(pack(docs, text), n, percent).select("doc_id", "n_shingles", "component_id")


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80, text: str = "text") -> DataFrame:
    """``docs`` with one row of each component, that of the smallest ``doc_id``. The texts stay in
    their blocks; only the places of the rows that go move."""
    table = pack(docs, text, carry=True)
    spare = _classes(table, n, percent).filter(~F.col("first"))
    places = spare.select(
        F.shiftright("uid", ROW_BITS).alias("block"), F.col("uid").bitwiseAND((1 << ROW_BITS) - 1).cast("int").alias("pos")
    )

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in each_block(batches):
            gone = np.zeros(len(row["ids"]), bool)
            gone[[r["pos"] for r in row["gone"] or []]] = True
            stay = pa.array(np.flatnonzero(~gone))
            yield pa.record_batch([row["rests"].take(stay), row["texts"].take(stay)], names=["rest", text])

    kept = with_answer(table, written(places, "spare"), "block", "gone").mapInArrow(finish, f"rest string, `{text}` binary")
    return unpacked(kept, docs, text)


def _classes(table: DataFrame, n: int, percent: int) -> DataFrame:
    """``uid, doc_id, n_shingles, component_id, first`` of each document of the blocks ``table``;
    ``first`` marks one row of each component."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in each_block(batches):
            token, first = tokens(row["texts"], n)
            sums = [np.append(U(0), np.cumsum(mix(token, s))) for s in (6, 7)]
            a, b = (s[first[1:]] - s[first[:-1]] for s in sums)
            pos = np.arange(len(first) - 1)
            yield pa.record_batch(
                [row["ids"], pa.array((row["block"] << ROW_BITS) | pos), pa.array(np.diff(first)),
                 pa.array(a.view(np.int64)), pa.array(b.view(np.int64))],
                names=["doc_id", "uid", "n", "hash_a", "hash_b"],
            )

    rows = written(
        table.mapInArrow(describe, "doc_id long, uid long, n long, hash_a long, hash_b long"), "sets"
    )
    same = ["n", "hash_a", "hash_b"]
    place = F.struct("doc_id", "uid")
    points = rows.filter("n > 0").groupBy(*same).agg(F.min("uid").alias("uid"), F.min(place).alias("head"))
    points = written(points, "points")
    wanted = points.select(F.shiftright("uid", ROW_BITS).alias("block"), F.col("uid").bitwiseAND((1 << ROW_BITS) - 1).alias("pos"))
    asked = with_answer(table, wanted, "block", "points")

    def keys_of(row: dict) -> Keys:
        token, first = tokens(row["texts"], n)
        return distinct(_tile_keys(token, first, _wanted(row), percent)[1])[0]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in each_block(batches):
            token, first = tokens(row["texts"], n)
            doc, key = _tile_keys(token, first, _wanted(row), percent)
            on = answered(row["tiles"])[distinct(key)[1]] if len(key) else np.zeros(0, bool)
            doc, key = doc[on], key[on].astype(np.int64)
            order = np.argsort(doc, kind="stable")
            doc, key = doc[order], key[order]
            some, at = np.unique(doc, return_index=True)
            made = [_point(token[first[d] : first[d + 1]]) for d in some]
            parities = [_parities(token[first[d] : first[d + 1]]) for d in some]
            coarse = list(zip(*map(_coarse, made))) if made else [[], [], []]
            yield pa.record_batch(
                [
                    pa.array((row["block"] << ROW_BITS) | some, pa.int64()),
                    pa.array([int(p.sum()) for p in made], pa.int64()),
                    pa.array([_packed(p) for p in made], pa.binary()),
                    pa.array([_folded(p, SHORT // 8).tobytes() for p in parities], pa.binary()),
                    pa.array([p.tobytes() for p in parities], pa.binary()),
                    *(pa.array(c, t) for c, t in zip(coarse, (pa.int32(), pa.int64(), pa.int64()))),
                    pa.ListArray.from_arrays(pa.array(np.append(at, len(key)), pa.int32()), pa.array(key, pa.int64())),
                ],
                names=["uid", "n", "point", "short", "parity", "halved", "coarse0", "coarse1", "keys"],
            )

    described = f"uid long, n long, point binary, short binary, parity binary, {_COARSE_DDL}, keys array<long>"
    members = written(shared(asked, keys_of, _KEY_BITS, "tiles").mapInArrow(emit, described), "members")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in each_block(batches):
            if not row["points"]:
                continue
            some = _wanted(row)
            token, first = tokens(row["texts"].take(pa.array(some)), n)
            sets = [token[i:j].astype("<u8").tobytes() for i, j in zip(first[:-1], first[1:])]
            yield pa.record_batch(
                [pa.array((row["block"] << ROW_BITS) | some, pa.int64()), pa.array(sets, pa.binary())], names=["uid", "set"]
            )

    def sets_of(uids: DataFrame) -> DataFrame:
        places = uids.select(F.shiftright("uid", ROW_BITS).alias("block"), F.col("uid").bitwiseAND((1 << ROW_BITS) - 1).alias("pos"))
        return with_answer(table, places, "block", "points").mapInArrow(fetch, "uid long, set binary")

    links = _links(members, percent, sets_of)
    comp = components(links)
    # documents -> points -> components; copies of a hot set meet their point in a skew-splittable join
    best = points.join(comp, "uid", "left").withColumn("comp", F.coalesce("comp", "uid"))
    least = best.groupBy("comp").agg(F.min("head").alias("least"))
    named = best.join(least, "comp").select(*same, "least")
    own = F.coalesce(F.col("least"), place)
    return rows.join(named, same, "left").select(
        "uid", "doc_id", F.col("n").alias("n_shingles"), own["doc_id"].alias("component_id"), (own == place).alias("first")
    )


def _links(members: DataFrame, percent: int, sets_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Links between points, enough to join every component. ``sets_of`` fetches the tokens of
    points, which only those in pairs that the bound leaves over need."""
    tiles = members.select("uid", F.explode("keys").alias("key"))
    at = members.select("uid", "n", "point", "short")
    sets: DataFrame | None = None
    refuted: DataFrame | None = None

    def joined(pairs: DataFrame, rows: DataFrame, *values: str) -> DataFrame:
        side = lambda s: rows.select(F.col("uid").alias(s), *(F.col(v).alias(f"{v}_{s}") for v in values))
        return pairs.join(side("a"), "a").join(side("b"), "b")

    def bounded(pairs: DataFrame) -> DataFrame:
        return joined(pairs, at, "point").mapInArrow(_bounded(percent), "a long, b long")

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        nonlocal sets, refuted
        pairs = joined(pairs, members, "n", "parity").mapInArrow(_even(percent), "a long, b long")
        if refuted is not None:
            pairs = pairs.join(refuted, ["a", "b"], "left_anti")
        pairs = written(pairs, "pairs")
        uids = pairs.select(F.col("a").alias("uid")).union(pairs.select("b")).distinct()
        if sets is None:
            sets = written(sets_of(uids), "token_sets")
        else:
            more = written(uids.join(sets.select("uid"), "uid", "left_anti"), "more_points")
            if not more.isEmpty():
                sets = sets.unionByName(written(sets_of(more), "token_sets"))
        found = written(joined(pairs, sets, "set").mapInArrow(_verify(percent), "a long, b long, ok boolean"), name)
        wrong = found.filter("NOT ok").select("a", "b")
        refuted = wrong if refuted is None else refuted.unionByName(wrong)
        return found.filter("ok").select("a", "b")

    # a tile's rows carry size and coarse point, so most seeds end where they are made
    bounds = ["n", "halved", "coarse0", "coarse1"]
    cells = members.select("uid", *bounds, F.explode("keys").alias("key"))
    centre = cells.groupBy("key").agg(F.min(F.struct("uid", *bounds)).alias("m"), F.count("*").alias("c")).filter("c > 1").drop("c")
    seeds = cells.join(centre, "key").filter((F.col("uid") != F.col("m.uid")) & _may_link("", "m.", percent))
    links = verified(bounded(seeds.select(F.col("m.uid").alias("a"), F.col("uid").alias("b")).distinct()), "links")
    for all_pairs in (False, True):
        comp = components(links)
        own = members.select("uid", "keys").join(comp, "uid", "left")
        placed = own.select("uid", F.coalesce("comp", "uid").alias("comp"), F.explode("keys").alias("key"))
        mixed = placed.groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).filter("c0 != c1")
        open_ = written(placed.join(mixed.select("key"), "key", "left_semi"), "open_tiles")
        if open_.isEmpty():
            return links
        rows = _split_tiles(open_).join(at, "uid")
        ordered = rows.repartition("key").sortWithinPartitions("key")
        found = ordered.select("key", "uid", "comp", "n", "point", "short").mapInArrow(_tree_pairs(percent, all_pairs), "a long, b long")
        links = written(links.unionByName(verified(found.distinct(), "links")), "links")
    return links


def _split_tiles(tiles: DataFrame) -> DataFrame:
    """Splits tiles of more than ``TILE_ROWS`` rows into groups of about so many, by hash: the members of the
    tile's largest component, which need no comparison with each other, and all others. A task joins
    a group of the others with one of the largest component, or two groups of the others, so none holds
    more than two groups, whatever the tile's size and however its members link."""
    by_comp = tiles.groupBy("key", "comp").agg(F.count("*").alias("c"))
    sizes = by_comp.groupBy("key").agg(F.sum("c").alias("rows"), F.max(F.struct("c", "comp")).alias("top"))
    groups = lambda rows: F.ceil(rows / TILE_ROWS).cast("int")
    large = sizes.filter(F.col("rows") > TILE_ROWS).select(
        "key", F.col("top.comp").alias("main"), groups(F.col("top.c")).alias("mains"), groups(F.col("rows") - F.col("top.c")).alias("others")
    )
    split = tiles.join(large, "key", "left")
    in_main = F.col("comp") == F.col("main")
    mine = F.pmod(F.xxhash64("uid"), F.when(in_main, F.col("mains")).otherwise(F.col("others"))).cast("int")
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    task = lambda kind, x, y: F.struct(F.lit(kind).alias("kind"), x.alias("x"), y.alias("y"))
    with_main = F.transform(upto("mains"), lambda m: task(1, m, mine))
    among = F.transform(upto("others"), lambda o: task(2, F.least(o, mine), F.greatest(o, mine)))
    whole = F.array(task(0, F.lit(0), F.lit(0)))
    tasks = F.when(F.col("main").isNull(), whole).when(in_main, F.transform(upto("others"), lambda o: task(1, mine, o))).otherwise(F.concat(with_main, among))
    split = split.withColumn("task", F.explode(tasks))
    key = F.when(F.col("task.kind") == 0, F.col("key")).otherwise(F.xxhash64("key", "task.kind", "task.x", "task.y"))
    return split.select(key.alias("key"), "uid", "comp")
