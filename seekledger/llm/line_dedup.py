"""Line dedup: equal lines by their digest, near-equal ones by a segment-partition edit join.

Lines are compared without the white space at their ends; blank lines are left alone. Of equal lines
the first stays, in the order of (``doc_id``, line). The distinct lines of at least ``min_chars``
characters are then joined within ``edits`` edits (insert, delete or replace one character): a line of
length L is cut into ``edits + 1`` segments, of which any similar line keeps at least one, moved by no
more than its share of the edits. Segments are indexed by (length, number, contents); each line probes
the index for its own and the ``edits`` next lower lengths with the substrings that can match.
``blocks.shared`` finds the keys that meet. Lines that meet are verified by edit distance in a band of
2 x edits + 1 diagonals, one machine word per pair, many pairs at a time.

Similar lines form classes (connected components); of each class the first line stays. As in the n-gram
join, each line is first verified against the least of its key, and only keys that still hold several
classes list pairs: those whose sketches (parities of letters and of pairs of letters) differ in no more
places than the edits can turn over.

Cases: null and empty texts have no lines and stay as they are (null gives empty kept text); rows that
repeat a ``doc_id`` are separate documents; shorter lines take part by equality only; a text all of
whose lines go is empty; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seekledger.llm.arrays import RUN_BASES, Runs, flat, mix
from seekledger.llm.blocks import ROW_BITS, Keys, answered, distinct, each_block, pack, shared, with_answer
from seekledger.llm.components import components
from seekledger.llm.scratch import written

U = np.uint64
_KEY_BITS = 44


class Lines(NamedTuple):
    """Lines of a block with a character, over its code points."""

    code: np.ndarray  # code points of all texts
    doc: np.ndarray
    number: np.ndarray  # in its text, blank lines counted
    start: np.ndarray  # without white space at the ends
    end: np.ndarray


def lines(texts: pa.Array) -> Lines:
    data, offsets = flat(texts)
    code = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    if len(code) != int(((data & 0xC0) != 0x80).sum()):  # broken UTF-8: decode text by text
        parts = [(t or b"").decode("utf-8", "replace").encode("utf-32-le") for t in texts.to_pylist()]
        code = np.frombuffer(b"".join(parts), np.uint32)
        offsets = np.concatenate([[0], np.cumsum([len(p) // 4 for p in parts])])
    else:
        offsets = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    feed = np.flatnonzero(code == 10)
    bounds = np.unique(np.concatenate([offsets, feed, feed + 1]))
    start, end = bounds[:-1], bounds[1:]
    own = ~((end - start == 1) & (code[np.minimum(start, max(len(code) - 1, 0))] == 10)) if len(code) else np.zeros(0, bool)
    start, end = start[own], end[own]
    doc = np.searchsorted(offsets, start, side="right") - 1
    fed = np.concatenate([[0], np.cumsum(code == 10)])
    number = fed[start] - fed[offsets[doc]]
    blank = (code == 0x20) | ((code >= 0x09) & (code <= 0x0D))
    full = np.concatenate([[0], np.cumsum(~blank)])
    solid = np.flatnonzero(np.diff(full))
    some = full[end] > full[start]
    start, end, doc, number = start[some], end[some], doc[some], number[some]
    return Lines(code, doc, number, solid[full[start]], solid[full[end] - 1] + 1)


_EDGES = b" \t\n\x0b\x0c\r"


def _identity(line: bytes) -> bytes:
    """128 bits of a cryptographic digest: no pattern of characters makes two lines look alike."""
    return blake2b(line, digest_size=16).digest()


def _whole(x: Lines, k: int) -> bytes:
    return x.code[x.start[k] : x.end[k]].tobytes()


def _segment(length: np.ndarray, i: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of segment i: the last ``length % parts`` are one longer."""
    short, rest = length // parts, length % parts
    longer = np.maximum(i - (parts - rest), 0)
    return i * short + longer, short + (i >= parts - rest)


def _moves(edits: int) -> list[tuple[int, int, int]]:
    """(how much shorter, segment, move) of each key of a line; the first of a segment's is its index."""
    out = []
    for shorter in range(edits + 1):
        for i in range(edits + 1):
            low, high = max(-i, shorter - (edits - i)), min(i, shorter + (edits - i))
            out += [(shorter, i, move) for move in range(low, high + 1)]
    return out


#: No key has as many bits.
_NO_KEY = U((1 << 48) - 1)


def _segment_keys(x: Lines, pick: np.ndarray, edits: int) -> np.ndarray:
    """Keys of the lines ``pick``, one column a move."""
    hashed = Runs(mix(x.code.astype(U), 12), RUN_BASES[0])
    start, size = x.start[pick], x.end[pick] - x.start[pick]
    columns = []
    for shorter, i, move in _moves(edits):
        length = size - shorter
        at, n = _segment(length, i, edits + 1)
        begin = at + move
        ok = (begin >= 0) & (begin + n <= size) & (n > 0)
        h = hashed((start + begin)[ok], (start + begin + n)[ok])
        salt = mix((length[ok].astype(U) << U(8)) | U(i), 13)
        key = np.full(len(pick), _NO_KEY)
        key[ok] = mix(h ^ salt, 14) >> U(64 - _KEY_BITS)
        columns.append(key)
    return np.stack(columns, axis=1) if columns else np.zeros((len(pick), 0), U)


_KEY_BYTES = (_KEY_BITS + 7) // 8


def _packed(keys: np.ndarray) -> bytes:
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :_KEY_BYTES].tobytes()


def _unpacked(packed: bytes, columns: int) -> np.ndarray:
    raw = np.zeros((len(packed) // _KEY_BYTES, 8), np.uint8)
    raw[:, :_KEY_BYTES] = np.frombuffer(packed, np.uint8).reshape(-1, _KEY_BYTES)
    return raw.view("<u8").reshape(-1, columns)


def within_edits(pairs: list[tuple[np.ndarray, np.ndarray]], edits: int) -> np.ndarray:
    """Whether each pair of code point arrays is within ``edits`` edits; lengths differ by no more."""
    good = np.zeros(len(pairs), bool)
    order = sorted(range(len(pairs)), key=lambda k: max(len(pairs[k][0]), len(pairs[k][1])))
    step, k = 1024, 0
    while k < len(order):
        longest = max(map(len, pairs[order[min(k + step, len(order)) - 1]]))
        part = order[k : k + max(16, min(step, 8_000_000 // (longest + 1)))]
        good[part] = _banded([sorted(pairs[j], key=len) for j in part], edits)
        k += len(part)
    return good


def _banded(pairs: list[list[np.ndarray]], edits: int) -> np.ndarray:
    """Bit-parallel edit distance in a band (Myers' recurrence, Hyyro's band): bit ``edits + d`` of a
    pair's word is diagonal d, and the word moves down one row of the longer string per column."""
    width = 2 * edits + 1
    n_long = np.array([len(b) for _, b in pairs])
    n_short = np.array([len(a) for a, _ in pairs])
    columns = int(n_short.max(initial=0))
    long_ = np.full((columns + 2 * edits + 1, len(pairs)), -1, np.int64)
    short = np.full((columns, len(pairs)), -2, np.int64)
    for j, (a, b) in enumerate(pairs):
        long_[edits : edits + len(b), j] = b[: len(long_) - edits]
        short[: len(a), j] = a
    full = U((1 << width) - 1)
    vp = np.full(len(pairs), ((1 << (edits + 1)) - 1) << edits, U)
    vn = np.zeros(len(pairs), U)
    # the distance on the lowest diagonal of the band that reaches the end of the longer string
    target = n_long - n_short
    score = np.zeros(len(pairs), np.int64)
    for c in range(columns):
        match = np.zeros(len(pairs), U)
        for d in range(width):
            match |= (long_[c + d] == short[c]).astype(U) << U(d)
        d0 = ((((match & vp) + vp) ^ vp) | match | vn) & full
        hp = (vn | ~(d0 | vp)) & full
        hn = d0 & vp
        live = c < n_short
        score += live & ((d0 >> U(edits)) & U(1) == 0)
        down = d0 >> U(1)
        new_vp = (hn | ~(down | hp)) & full
        new_vn = down & hp
        vp, vn = np.where(live, new_vp, vp), np.where(live, new_vn, vn)
        if c % 64 == 63 and (score[live] > 2 * edits).all() and live.all():
            return np.zeros(len(pairs), bool)
    # from the main diagonal in the last column down to the end of the longer string
    for k in range(1, edits + 1):
        bit = U(edits + k - 1)
        step = ((vp >> bit) & U(1)).astype(np.int64) - ((vn >> bit) & U(1)).astype(np.int64)
        score += np.where(target >= k, step, 0)
    return score <= edits


def _verify(edits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code = lambda c: [np.frombuffer((t or "").encode("utf-32-le"), np.uint32) for t in batch.column(c).to_pylist()]
            pairs = list(zip(code("text_a"), code("text_b")))
            near = np.array([abs(len(a) - len(b)) <= edits for a, b in pairs], bool)
            ok = np.zeros(len(pairs), bool)
            some = np.flatnonzero(near)
            ok[some] = within_edits([pairs[k] for k in some], edits)
            yield pa.record_batch([batch.column("a"), batch.column("b"), pa.array(ok)], names=["a", "b", "ok"])

    return run


#: Words of a sketch: one for letters, the others for pairs of letters.
_SKETCH = 5


def _sketches(x: Lines, pick: np.ndarray) -> np.ndarray:
    """Parities of letters (by 64 classes) and of neighbouring pairs of letters (by 256 classes). An
    edit turns over at most 2 bits of the first word and 4 of the others."""
    size = x.end[pick] - x.start[pick]
    line = np.repeat(np.arange(len(pick)), size)
    at = np.arange(len(line)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(x.start[pick], size)
    code = x.code[at].astype(U)
    inner = np.flatnonzero(line[1:] == line[:-1])
    pairs = mix(code[inner] * U(0x9E3779B97F4A7C15) + code[inner + 1], 16)
    bits = np.concatenate([mix(code, 15) >> U(58), U(64) + (pairs >> U(56))]).astype(np.int64)
    place = np.concatenate([line, line[inner]]) * (64 * _SKETCH) + bits
    odd = np.bincount(place, minlength=64 * _SKETCH * len(pick)).reshape(-1, _SKETCH, 64) & 1
    return (odd.astype(U) << np.arange(64, dtype=U)).sum(2, dtype=U)


def _sketch_names() -> list[str]:
    return [f"s{k}" for k in range(_SKETCH)]


def _close(p: str, q: str, edits: int) -> Column:
    turned = [F.bit_count(F.col(f"{p}s{k}").bitwiseXOR(F.col(f"{q}s{k}"))) for k in range(_SKETCH)]
    return (turned[0] <= 2 * edits) & (sum(turned[1:], F.lit(0)) <= 4 * edits)


def _line_texts(texts: pa.Array, pos: np.ndarray, numbers: np.ndarray) -> list[str]:
    """The lines of some places, in their order."""
    out, split, last = [], [], -1
    for p, n in zip(pos.tolist(), numbers.tolist()):
        if p != last:
            split, last = (texts[p].as_py() or b"").split(b"\n"), p
        out.append(split[n].strip(_EDGES).decode("utf-8", "replace"))
    return out


_DESCRIBED = "id array<long>, check array<long>, owner array<long>, uid array<long>, line array<int>, long array<int>, keys binary"


def _describe(edits: int, min_chars: int):
    """Adds to each block its lines: digest, document, place; the numbers (``long``) of those that take part in
    the edit join, and their keys. Later steps read these and leave the texts alone."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, batch in ((row, batch.slice(i, 1)) for batch in batches for i, row in enumerate(each_block([batch]))):
            x = lines(row["texts"])
            digests = np.frombuffer(b"".join([_identity(_whole(x, k)) for k in range(len(x.doc))]), "<i8").reshape(-1, 2)
            long = np.flatnonzero(x.end - x.start >= min_chars)
            one = lambda values, kind: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind))
            added = {
                "id": one(digests[:, 0], pa.int64()), "check": one(digests[:, 1], pa.int64()),
                "owner": one(row["ids"].take(pa.array(x.doc)), pa.int64()),
                "uid": one((row["block"] << ROW_BITS) | x.doc, pa.int64()), "line": one(x.number, pa.int32()),
                "long": one(long, pa.int32()), "keys": pa.array([_packed(_segment_keys(x, long, edits))], pa.binary()),
            }
            yield pa.RecordBatch.from_arrays([*batch.columns, *added.values()], names=[*batch.schema.names, *added])

    return step


def line_classes(
    docs: DataFrame, edits: int = 2, min_chars: int = 30, text: str = "text", carry: bool = False
) -> tuple[DataFrame, DataFrame]:
    """(blocks of ``docs``, removed lines ``block, pos, line, near``)."""
    table = pack(docs, text, carry=carry, describe=(_describe(edits, min_chars), _DESCRIBED))
    listed = F.explode(F.arrays_zip("id", "check", "owner", "uid", "line")).alias("x")
    rows = table.select(listed).select("x.id", "x.check", F.col("x.owner").alias("doc_id"), "x.uid", "x.line")
    place = F.struct("doc_id", "uid", "line")
    first = rows.groupBy("id", "check").agg(F.min(place).alias("first"), F.count("*").alias("c"))
    many = written(first.filter("c > 1").drop("c"), "repeated_lines")
    at = lambda uid: (F.shiftright(uid, ROW_BITS).alias("block"), F.col(uid).bitwiseAND((1 << ROW_BITS) - 1).cast("int").alias("pos"))
    copies = rows.join(many, ["id", "check"]).filter(place != F.col("first"))
    copies = written(copies.select(*at("uid"), "line"), "line_copies")
    moves = _moves(edits)
    is_index = np.array([shorter == 0 and move == 0 for shorter, _, move in moves])

    def chosen(row: dict) -> tuple[np.ndarray, np.ndarray]:
        """(number among the block's lines, keys) of the long lines that are no copies."""
        long = np.array(row["long"], np.int64)
        keys = _unpacked(row["keys"], len(moves))
        if row["gone"] and len(long):
            pos = np.array(row["uid"], np.int64)[long] & ((1 << ROW_BITS) - 1)
            number = np.array(row["line"], np.int64)[long]
            span = int(number.max()) + 1
            gone = np.array([r["pos"] * span + r["line"] for r in row["gone"] if r["line"] < span], np.int64)
            stay = ~np.isin(pos * span + number, gone)
            long, keys = long[stay], keys[stay]
        return long, keys

    def keys_of(row: dict) -> Keys:
        _, keys = chosen(row)
        flat_, index = keys.ravel(), np.tile(is_index, len(keys))
        real = flat_ != _NO_KEY
        return distinct(flat_[real], anchor=index[real])[0]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in each_block(batches):
            long, keys = chosen(row)
            real = keys != _NO_KEY
            on = np.zeros(keys.shape, bool)
            if real.any():
                on[real] = answered(row["met"])[distinct(keys[real])[1]]
            some = np.flatnonzero(on.any(axis=1))
            own = long[some]
            ids, uids, numbers = (np.array(row[c], np.int64)[own] for c in ("id", "uid", "line"))
            bodies = _line_texts(row["texts"], uids & ((1 << ROW_BITS) - 1), numbers)
            codes = [np.frombuffer(b.encode("utf-32-le"), np.uint32) for b in bodies]
            ends = np.cumsum([len(c) for c in codes], dtype=np.int64)
            starts = ends - [len(c) for c in codes] if codes else ends
            x = Lines(np.concatenate([*codes, np.zeros(0, np.uint32)]), own, numbers, starts, ends)
            met = [k[o].astype(np.int64) for k, o in zip(keys[some], on[some])]
            yield pa.record_batch(
                [pa.array(ids), pa.array([row["owner"][k] for k in own.tolist()], pa.int64()), pa.array(uids), pa.array(numbers, pa.int32()),
                 *(pa.array(s.view(np.int64)) for s in np.ascontiguousarray(_sketches(x, np.arange(len(own))).T)), pa.array(bodies, pa.string()),
                 pa.array(met, pa.list_(pa.int64()))],
                names=["id", "doc_id", "uid", "line", *_sketch_names(), "text", "keys"],
            )

    asked = with_answer(table.select("block", "uid", "line", "long", "keys"), copies, "block", "gone")
    met = shared(asked, keys_of, _KEY_BITS, "met").select("block", "gone", "met")
    hit = table.select("block", "texts", "id", "owner", "uid", "line", "long", "keys").join(met.hint("shuffle_hash"), "block")
    members = written(
        hit.mapInArrow(
            emit, f"id long, doc_id long, uid long, line int, {' long, '.join(_sketch_names())} long, text string, keys array<long>"
        ),
        "line_members",
    )
    comp = components(_links(members, edits))
    placed = members.select("id", place.alias("place")).join(comp.withColumnRenamed("uid", "id"), "id")
    earliest = placed.groupBy("comp").agg(F.min("place").alias("first"))
    later = placed.join(earliest, "comp").filter(F.col("place") != F.col("first")).select("place.uid", "place.line")
    near = later.select(*at("uid"), "line")
    removed = copies.withColumn("near", F.lit(False)).unionByName(near.withColumn("near", F.lit(True)))
    return table, written(removed, "removed_lines")


def _links(members: DataFrame, edits: int) -> DataFrame:
    sketch = _sketch_names()
    tiles = written(members.select("id", *sketch, F.explode("keys").alias("key")), "line_tiles")
    texts = members.select("id", "text")

    def verified(pairs: DataFrame) -> DataFrame:
        side = lambda s: texts.select(F.col("id").alias(s), F.col("text").alias(f"text_{s}"))
        both = pairs.join(side("a"), "a").join(side("b"), "b")
        return written(both.mapInArrow(_verify(edits), "a long, b long, ok boolean").filter("ok").select("a", "b"), "line_links")

    least = tiles.groupBy("key").agg(F.min(F.struct("id", *sketch)).alias("m"), F.count("*").alias("c")).filter("c > 1")
    seeds = tiles.join(least, "key").filter((F.col("id") != F.col("m.id")) & _close("", "m.", edits))
    links = verified(seeds.select(F.col("m.id").alias("a"), F.col("id").alias("b")).distinct())
    comp = components(links)
    placed = tiles.join(comp.withColumnRenamed("uid", "id"), "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    mixed = placed.groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).filter("c0 != c1")
    open_ = written(placed.join(mixed.select("key"), "key", "left_semi"), "open_lines")
    p, q = open_.alias("p"), open_.alias("q")
    met = p.join(q, (F.col("p.key") == F.col("q.key")) & (F.col("p.id") < F.col("q.id")) & (F.col("p.comp") != F.col("q.comp"))
                 & _close("p.", "q.", edits))
    rest = met.select(F.col("p.id").alias("a"), F.col("q.id").alias("b")).distinct()
    return written(links.unionByName(verified(rest)), "line_links")


def dedup_lines(
    docs: DataFrame, edits: int = 2, min_chars: int = 30, text: str = "text", carry: bool = False
) -> DataFrame:
    """One row per document: ``doc_id, n_lines`` (not blank), ``n_copies`` and ``n_near`` (lines
    removed as equal and as near-equal), ``kept_text`` (the other lines, blank ones included), and
    with ``carry`` also ``rest`` (its other columns, for ``blocks.unpacked``)."""
    table, removed = line_classes(docs, edits, min_chars, text, carry)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in each_block(batches):
            pos = np.array(row["uid"], np.int64) & ((1 << ROW_BITS) - 1)
            counts = np.bincount(pos, minlength=len(row["texts"]))
            gone: dict[int, dict[int, bool]] = {}
            for r in row["removed"] or []:
                gone.setdefault(r["pos"], {})[r["line"]] = r["near"]
            copies, near, kept = [], [], []
            for k, body in enumerate(row["texts"].to_pylist()):
                mine = gone.get(k, {})
                near.append(sum(mine.values()))
                copies.append(len(mine) - near[-1])
                body = body or b""
                kept.append(b"\n".join(t for i, t in enumerate(body.split(b"\n")) if i not in mine) if mine else body)
            columns = [row["ids"], pa.array(counts, pa.int64()), pa.array(copies, pa.int64()),
                       pa.array(near, pa.int64()), pa.array(kept, pa.binary())]
            names = ["doc_id", "n_lines", "n_copies", "n_near", "kept_text"]
            if carry:
                columns, names = [*columns, row["rests"]], [*names, "rest"]
            yield pa.record_batch(columns, names=names)

    columns = ["block", "ids", "texts", "uid", *(["rests"] if carry else [])]
    return with_answer(table.select(*columns), removed, "block", "removed").mapInArrow(
        finish, "doc_id long, n_lines long, n_copies long, n_near long, kept_text binary" + ", rest string" * carry
    )
