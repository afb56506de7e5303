"""Blocks of documents and the exchange of their packed keys.

``pack`` puts the rows of a table into blocks of a few MB, written once and bucketed by block, so
that what is later learned about a block meets its texts without moving them.

``shared`` answers, for the keys that each block holds, which of them are repeated anywhere in the
corpus. A block sends its distinct keys sorted and packed (a bucket of neighbouring keys is one row
of byte-wide differences, about 3 bytes a key); a bucket counts them over all blocks and answers
with one bit a key. Nothing is sent per occurrence: a key that a group of copies holds thousands of
times counts once a block, so buckets are even whatever the skew. The block makes its key list anew,
in the same order, to read the answer.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seekledger.llm.arrays import flat
from seekledger.llm.scratch import partitions, written, written_bucketed

U = np.uint64
#: Documents and bytes of text in a block, at most (a longer text is a block of its own).
MAX_ROWS = 4096
MAX_BYTES = 1 << 20
ROW_BITS = 12
#: Blocks of a partition: 16 million of a MiB or more, with 2**27 partitions.
BLOCK_BITS = 24


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    place, k = TaskContext.get().partitionId() << BLOCK_BITS, 0
    held: list[pa.RecordBatch] = []
    rows = size = 0

    def made() -> pa.RecordBatch:
        nonlocal k
        table = pa.Table.from_batches(held).combine_chunks()
        k += 1
        if k > 1 << BLOCK_BITS or place >> (63 - ROW_BITS):
            raise OverflowError("more blocks or partitions than their numbers hold")
        one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
        columns = [one(table.column(c).combine_chunks()) for c in table.column_names]
        return pa.record_batch([pa.array([place + k - 1], pa.int64()), *columns], names=["block", "ids", "texts", "rests"][: len(columns) + 1])

    for batch in batches:
        lengths = np.diff(flat(batch.column("text"))[1])
        at = 0
        while at < batch.num_rows:
            ends = np.cumsum(lengths[at:]) + size
            n = int(min(np.searchsorted(ends, MAX_BYTES, side="right"), MAX_ROWS - rows))
            if n == 0 and not rows:
                n = 1
            held.append(batch.slice(at, n))
            rows, size, at = rows + n, size + int(lengths[at : at + n].sum()), at + n
            if at < batch.num_rows:
                yield made()
                held, rows, size = [], 0, 0
    if rows:
        yield made()


_JSON = {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


def pack(
    docs: DataFrame, text: str = "text", name: str = "blocks", carry: bool = False,
    describe: tuple[Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], str] | None = None,
) -> DataFrame:
    """``block, ids, texts`` of all rows of ``docs``, bucketed by ``block``. With ``carry`` also
    ``rests``: the other columns of each row as JSON, which ``unpacked`` turns back. ``describe`` is a step
    that adds columns to the blocks before they are written, and their types."""
    columns = [F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text")]
    schema = "block long, ids array<long>, texts array<binary>"
    if carry:
        columns.append(F.to_json(F.struct(*_others(docs, text)), _JSON).alias("rest"))
        schema += ", rests array<string>"
    if describe is None:
        packed = docs.select(*columns).mapInArrow(_blocks, schema)
    else:
        step, added = describe
        packed = docs.select(*columns).mapInArrow(lambda batches: step(_blocks(batches)), f"{schema}, {added}")
    return written_bucketed(packed, name, "block", partitions(docs.sparkSession))


def _others(docs: DataFrame, text: str) -> list[str]:
    return [f"`{c}`" for c in docs.columns if c != text]


def unpacked(rows: DataFrame, docs: DataFrame, text: str = "text") -> DataFrame:
    """``rows(rest, text)`` -> the columns of ``docs``."""
    schema = docs.drop(text).schema
    back = rows.select(F.from_json("rest", schema, _JSON).alias("_r"), F.col(text).cast("string").alias("_t"))
    return back.select(*(F.col("_t").alias(c) if c == text else F.col(f"_r.`{c}`") for c in docs.columns))


class Keys(NamedTuple):
    """Distinct keys of a block in ascending order."""

    key: np.ndarray  # uint64 below 2**bits
    check: np.ndarray | None  # further hash bits of the same items, or None
    many: np.ndarray  # bool: the block holds it more than once
    anchor: np.ndarray  # bool: only keys that are an anchor somewhere can be shared


def distinct(key: np.ndarray, check: np.ndarray | None = None, anchor: np.ndarray | None = None) -> tuple[Keys, np.ndarray]:
    """The keys of a block, and for each given key its place among the distinct ones."""
    order = np.argsort(key, kind="stable") if check is None else np.lexsort((check, key))
    sorted_ = key[order]
    new = np.ones(len(key), bool)
    new[1:] = sorted_[1:] != sorted_[:-1]
    if check is not None:
        checks = check[order]
        new[1:] |= checks[1:] != checks[:-1]
    starts = np.flatnonzero(new)
    counts = np.diff(np.append(starts, len(key)))
    place = np.empty(len(key), np.int64)
    place[order] = np.cumsum(new) - 1
    anchors = np.ones(len(starts), bool)
    if anchor is not None:
        anchors = np.zeros(len(starts), bool)
        anchors[place[anchor]] = True
    return Keys(sorted_[starts], None if check is None else checks[starts], counts > 1, anchors), place


def _bucket_edges(buckets: int, bits: int) -> np.ndarray:
    return np.array([-(-(b << bits) // buckets) for b in range(1, buckets)], dtype=U)


_SENT = pa.schema(
    [("bucket", pa.int32()), ("block", pa.int64()), ("base", pa.int64()), ("width", pa.int32())]
    + [(n, pa.binary()) for n in ("steps", "checks", "many", "anchor")]
)
_SENT_DDL = "bucket int, block long, base long, width int, steps binary, checks binary, many binary, anchor binary"


def _bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def _flags(packed: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(packed, np.uint8), count=n).astype(bool)


def _send(block: int, keys: Keys, edges: np.ndarray) -> pa.RecordBatch:
    bounds = np.concatenate([[0], np.searchsorted(keys.key, edges), [len(keys.key)]])
    rows: list[tuple] = []
    for b in np.flatnonzero(np.diff(bounds)):
        part = slice(bounds[b], bounds[b + 1])
        key = keys.key[part]
        steps = np.diff(key)
        width = max(1, (int(steps.max()).bit_length() + 7) // 8) if len(steps) else 1
        packed = steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()
        checks = b"" if keys.check is None else keys.check[part].astype("<u4").tobytes()
        base = int(key[0].astype(np.int64))
        rows.append((int(b), block, base, width, packed, checks, _bits(keys.many[part]), _bits(keys.anchor[part])))
    columns = list(zip(*rows)) if rows else [[]] * len(_SENT)
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, _SENT)], schema=_SENT)


def _received(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    raw = np.frombuffer(row["steps"], np.uint8).reshape(-1, row["width"])
    steps = np.zeros((len(raw), 8), np.uint8)
    steps[:, : row["width"]] = raw
    key = np.empty(len(raw) + 1, U)
    key[0] = np.int64(row["base"]).astype(U)
    np.cumsum(steps.view("<u8").ravel(), out=key[1:])
    key[1:] += key[0]
    checks = np.frombuffer(row["checks"], "<u4") if row["checks"] else np.zeros(len(key), np.uint32)
    return key, checks, _flags(row["many"], len(key)), _flags(row["anchor"], len(key))


def _answer(table: pa.Table) -> pa.Table:
    """For one bucket: which keys of each block occur twice or more and are an anchor somewhere."""
    rows = table.to_pylist()
    parts = [_received(r) for r in rows]
    key, check, many, anchor = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(key, kind="stable") if not check.any() else np.lexsort((check, key))
    k, c = key[order], check[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
    starts = np.flatnonzero(new)
    twice = np.diff(np.append(starts, len(k))) > 1
    twice |= np.logical_or.reduceat(many[order], starts)
    good = twice & np.logical_or.reduceat(anchor[order], starts)
    hit = np.empty(len(k), bool)
    hit[order] = good[np.cumsum(new) - 1]
    ends = np.cumsum([len(p[0]) for p in parts])
    masks = [_bits(hit[e - len(p[0]) : e]) for e, p in zip(ends, parts)]
    return pa.table(
        {
            "block": pa.array([r["block"] for r in rows], pa.int64()),
            "bucket": pa.array([r["bucket"] for r in rows], pa.int32()),
            "n": pa.array([len(p[0]) for p in parts], pa.int32()),
            "mask": pa.array(masks, pa.binary()),
        }
    )


def each_block(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows of a blocks table as dictionaries: texts and ids as Arrow arrays, the rest as values."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = {}
            for name, column in zip(batch.schema.names, batch.columns):
                value = column[i]
                row[name] = value.values if name in ("ids", "texts", "rests") else value.as_py()
            yield row


def shared(blocks: DataFrame, keys_of: Callable[[dict], Keys], bits: int, answer: str) -> DataFrame:
    """``blocks`` + a column ``answer``: read it with ``answered``. ``keys_of`` gives the keys of a
    block from its row, which may hold earlier answers."""
    buckets = partitions(blocks.sparkSession)
    edges = _bucket_edges(buckets, bits)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in each_block(batches):
            yield _send(row["block"], keys_of(row), edges)

    sent = blocks.mapInArrow(send, _SENT_DDL)
    masks = sent.groupBy("bucket").applyInArrow(_answer, "block long, bucket int, n int, mask binary")
    masks = written(masks, "masks")
    return with_answer(blocks, masks, "block", answer)


def with_answer(blocks: DataFrame, rows: DataFrame, key: str, answer: str) -> DataFrame:
    """All rows of a block gathered beside it; the blocks, bucketed, stay where they are."""
    others = [F.col(c) for c in rows.columns if c != key]
    gathered = rows.groupBy(key).agg(F.collect_list(F.struct(*others)).alias(answer))
    return blocks.join(gathered.hint("shuffle_hash"), key, "left")


def answered(answer: list | None) -> np.ndarray:
    """One flag per distinct key of the block, in their order."""
    rows = sorted(answer or [], key=lambda r: r["bucket"])
    return np.concatenate([_flags(r["mask"], r["n"]) for r in rows]) if rows else np.zeros(0, bool)
