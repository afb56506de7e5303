"""Exact repeats of word sequences across a corpus, by fixed-block anchors.

The reference blocks of a document are its runs of ``anchor`` words at multiples of ``anchor``, with
``anchor = (window + 1) // 2``: any ``window`` words in a row hold one such block whole. The blocks are
the index; every rolling run of ``anchor`` words of every document probes it. A run that meets a block
other than itself is a hit. Hits are extended word by word: each ``window`` that holds a hit is kept if
its word sequence starts anywhere else too, and windows that touch join to maximal repeats.

Both steps use ``blocks.shared``, so copies of any number cost one key a block. Probe keys may collide
(44 bits), which only adds windows to test. Windows are compared by an 80-bit cryptographic digest of their
words themselves, so no pattern of words makes two of them look alike.

Cases: null and empty texts have no words and lose none; texts shorter than the window lose none;
overlapping repeats within one text count; rows that repeat a ``doc_id`` are separate documents and
each gives a row; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from seekledger.llm.arrays import Words, flat, spread, windows, words
from seekledger.llm.blocks import Keys, answered, distinct, each_block, pack, shared

U = np.uint64
_PROBE_BITS, _WINDOW_BITS = 44, 48


def _probes(w: Words, anchor: int) -> tuple[np.ndarray, Keys, np.ndarray]:
    """(first words, distinct keys, place of each) of the rolling runs; blocks are marked."""
    starts, hashes = windows(w, anchor)
    is_block = (starts - w.first[w.doc[starts]]) % anchor == 0 if len(starts) else np.zeros(0, bool)
    keys, place = distinct(hashes >> U(64 - _PROBE_BITS), anchor=is_block)
    return starts, keys, place


def _candidates(w: Words, answer: list | None, anchor: int, window: int) -> np.ndarray:
    """First words of the windows that hold a hit."""
    starts, _, place = _probes(w, anchor)
    if not len(starts):
        return starts
    hits = starts[answered(answer)[place]]
    near = spread(np.maximum(hits - (window - anchor), 0), window - anchor + 1, len(w.hash))
    all_, _ = windows(w, window)
    return all_[near[all_]]


def _window_keys(texts: pa.Array, w: Words, starts: np.ndarray, window: int) -> tuple[Keys, np.ndarray]:
    data = flat(texts)[0]
    size = w.end - w.start
    # all words, one blank after each
    ends = np.cumsum(size + 1)
    plain = np.full(int(ends[-1]) if len(ends) else 0, 0x20, np.uint8)
    word = np.repeat(np.arange(len(size)), size)
    at = np.arange(len(word))
    plain[at + word] = data[at - np.repeat(np.cumsum(size) - size, size) + np.repeat(w.start, size)]
    view = memoryview(plain.tobytes())
    begin, end = (ends - size - 1)[starts], (ends - 1)[starts + window - 1]
    digests = b"".join([blake2b(view[i:j], digest_size=16).digest() for i, j in zip(begin.tolist(), end.tolist())])
    parts = np.frombuffer(digests, "<u8").reshape(-1, 2)
    return distinct(parts[:, 0] >> U(64 - _WINDOW_BITS), (parts[:, 1] >> U(32)).astype(np.uint32))


def repeats(docs: DataFrame, window: int = 35, text: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_words, n_removed, spans`` (starts and ends, in words, of its
    maximal repeats) and ``kept_text`` (the other words, joined by one blank)."""
    anchor = (window + 1) // 2
    table = pack(docs, text)

    def probe(row: dict) -> Keys:
        return _probes(words(row["texts"]), anchor)[1]

    def extend(row: dict) -> Keys:
        w = words(row["texts"])
        return _window_keys(row["texts"], w, _candidates(w, row["hits"], anchor, window), window)[0]

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in each_block(batches):
            w = words(row["texts"])
            starts = _candidates(w, row["hits"], anchor, window)
            _, place = _window_keys(row["texts"], w, starts, window)
            gone = spread(starts[answered(row["repeats"])[place]], window, len(w.hash)) if len(place) else np.zeros(len(w.hash), bool)
            n, removed, spans, kept = [], [], [], []
            for k, body in enumerate(row["texts"].to_pylist()):
                mine = gone[w.first[k] : w.first[k + 1]]
                change = np.flatnonzero(np.diff(np.concatenate([[False], mine, [False]])))
                n.append(len(mine))
                removed.append(int(mine.sum()))
                spans.append(change)
                kept.append(b" ".join(compress((body or b"").split(), ~mine)))
            yield pa.record_batch(
                [row["ids"], pa.array(n, pa.int64()), pa.array(removed, pa.int64()),
                 pa.array(spans, pa.list_(pa.int32())), pa.array(kept, pa.binary())],
                names=["doc_id", "n_words", "n_removed", "spans", "kept_text"],
            )

    hits = shared(table, probe, _PROBE_BITS, "hits")
    found = shared(hits, extend, _WINDOW_BITS, "repeats")
    return found.mapInArrow(
        finish, "doc_id long, n_words long, n_removed long, spans array<int>, kept_text binary"
    )

