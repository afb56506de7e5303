"""Exact top-k inner products by exhaustive term-at-a-time accumulation.

A vector is a sparse row of (term, weight). Candidates are packed into blocks of postings (for each
term the positions and weights that have it), queries into blocks of sparse rows. Every pair of a
query block and a candidate block is one piece of work: each query scatters its weighted postings
into a dense score array, a partition selection keeps its best k of the block, and the selections
merge by a ranking per query. All candidates are scored; nothing is approximated.

Memory of a task is one candidate block (``candidate_rows``), one query block and one score array.

Cases: rows whose vector is null or holds null or non-finite components, or whose id is null, take no
part; vectors of different length meet in their common terms; an empty vector scores 0 with
everything; repeated ids: a query never meets rows of its own id, and a candidate id that occurs
twice is listed twice; ties go to the smaller id; extra columns are ignored; fewer candidates than
k give fewer rows. Weights must keep inner products within 64 bits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seekledger.llm.scratch import written

_LOWEST = np.iinfo(np.int64).min


def _ptr(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)


def _chunks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[np.ndarray, pa.ListArray]]:
    """(ids, vectors) of at most ``most`` rows, over batch bounds."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        while batch.num_rows:
            part = batch.slice(0, most - count)
            batch = batch.slice(part.num_rows)
            held.append(part)
            count += part.num_rows
            if count == most:
                yield _joined(held)
                held, count = [], 0
    if count:
        yield _joined(held)


def _joined(held: list[pa.RecordBatch]) -> tuple[np.ndarray, pa.ListArray]:
    table = pa.Table.from_batches(held).combine_chunks()
    return table.column(0).to_numpy(), table.column(1).combine_chunks()


def _sparse(vectors) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, weight) of the components other than 0."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    lengths = np.diff(vectors.offsets.to_numpy())
    values = vectors.flatten().to_numpy(zero_copy_only=False)
    rows = np.repeat(np.arange(len(lengths)), lengths)
    terms = np.arange(len(values)) - np.repeat(_ptr(lengths)[:-1], lengths)
    on = values != 0
    return rows[on], terms[on], values[on]


def _pack(most: int, by_term: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = TaskContext.get().partitionId() << 32
        for k, (ids, vectors) in enumerate(_chunks(batches, most)):
            if by_term:
                order = np.argsort(ids, kind="stable")
                ids, vectors = ids[order], vectors.take(pa.array(order))
            rows, terms, weights = _sparse(vectors)
            if by_term:
                order = np.argsort(terms, kind="stable")
                lengths = np.bincount(terms, minlength=1)
                inner, weights = rows[order], weights[order]
            else:
                lengths, inner = np.bincount(rows, minlength=len(ids)), terms
            packed = [ids, _ptr(lengths), inner.astype(np.int32), weights.astype(np.int64)]
            yield pa.record_batch(
                [[place + k], *([a.tobytes()] for a in packed)], names=["block", "ids", "ptr", "inner", "weights"]
            )

    return run


_BLOCK = "block long, ids binary, ptr binary, inner binary, weights binary"


def _select(scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best, the earlier of equals first chosen."""
    if len(scores) <= k:
        return np.arange(len(scores))
    least = np.partition(scores, len(scores) - k)[len(scores) - k]
    above = np.flatnonzero(scores > least)
    return np.concatenate([above, np.flatnonzero(scores == least)[: k - len(above)]])


def _score(k: int) -> Callable:
    def arrays(batch: pa.RecordBatch, row: int, side: str) -> list[np.ndarray]:
        kinds = (("ids", np.int64), ("ptr", np.int64), ("inner", np.int32), ("weights", np.int64))
        return [np.frombuffer(batch.column(f"{side}_{n}")[row].as_buffer(), dtype=t) for n, t in kinds]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                q_ids, q_ptr, q_terms, q_weights = arrays(batch, row, "q")
                ids, ptr, places, weights = arrays(batch, row, "c")
                postings = [(places[a:b], weights[a:b]) for a, b in zip(ptr[:-1], ptr[1:])]
                out: list[tuple] = []
                for q, query in enumerate(q_ids):
                    scores = np.zeros(len(ids), np.int64)
                    for t, w in zip(q_terms[q_ptr[q] : q_ptr[q + 1]], q_weights[q_ptr[q] : q_ptr[q + 1]]):
                        if t < len(postings):
                            at, by = postings[t]
                            scores[at] += w * by
                    own = slice(*np.searchsorted(ids, [query, query + 1]))
                    others = np.ones(len(ids), bool)
                    others[own] = False
                    scores[own] = _LOWEST
                    best = _select(scores, k)
                    best = best[others[best]]
                    out.append((np.full(len(best), query), ids[best], scores[best]))
                q, c, s = (np.concatenate(x) for x in zip(*out)) if out else ([], [], [])
                yield pa.record_batch(
                    [pa.array(x, pa.int64()) for x in (q, c, s)], names=["query_id", "vec_id", "score"]
                )

    return run


def usable(vector: str = "embedding") -> Column:
    """No null or non-finite component."""
    ok = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))
    return F.col(vector).isNotNull() & F.forall(vector, ok)


def top_k(
    vectors: DataFrame, queries: DataFrame, k: int, candidate_rows: int = 8192, query_rows: int = 256
) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row of ``queries`` its k best rows of
    ``vectors``. Both hold ``id`` (long) and ``vector`` (array<long>)."""
    pack = lambda rows, most, by_term: written(
        rows.filter("id IS NOT NULL").select("id", "vector").mapInArrow(_pack(most, by_term), _BLOCK), "topk_blocks"
    )
    candidates = pack(vectors, candidate_rows, True)
    asked = pack(queries, query_rows, False)
    numbered = lambda d, side: d.select(*(F.col(c).alias(f"{side}_{c}") for c in d.columns))
    # each query block meets each candidate block: the grid pairs block numbers only, the blocks
    # themselves then meet in an equi-join on the candidate block's number
    grid = numbered(asked, "q").crossJoin(candidates.select(F.col("block").alias("c_block")))
    pairs = grid.join(numbered(candidates, "c"), "c_block").drop("c_block", "q_block")
    found = pairs.mapInArrow(_score(k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
