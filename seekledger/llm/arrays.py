"""Words of many texts at once, as numpy arrays over their UTF-8 bytes.

A word is a run of bytes other than blank and tab to carriage return. Its hash adds up a random
64-bit value for each byte and its place in the word, and mixes the sum. Runs of words are hashed by
doubling: those of 1, 2, 4 ... words are mixed from two halves, and a run of any length from its binary
parts. Polynomials modulo 2**64 (``Runs``) collide for texts of certain patterns whatever their base;
they hash features only, and never decide whether texts are equal. Nothing loops over bytes or words in
Python.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa

U = np.uint64
#: Odd bases of the polynomials.
RUN_BASES = (25955542328677901357, 25548923372355807093)
#: A value for each byte at each of the first places of a word.
_PLACES = 64
_AT_PLACE = np.random.Generator(np.random.PCG64(20240502)).integers(0, 1 << 64, _PLACES * 256, dtype=U)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits."""
    x = x + U(salt * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


#: Powers are kept between calls up to this exponent: what an idle worker holds stays small.
_KEPT_POWERS = 1 << 19


def _made_powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    def run(b: int) -> np.ndarray:
        out = np.full(n + 1, U(b & 0xFFFFFFFFFFFFFFFF))
        out[0] = 1
        return np.cumprod(out, out=out)

    return run(base), run(pow(base, -1, 1 << 64))


def _power(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(base**i, base**-i) for i up to n."""
    if n > _KEPT_POWERS:
        return _made_powers(base, n)
    if base not in _powers:
        _powers[base] = _made_powers(base, _KEPT_POWERS)
    return _powers[base]


class Runs:
    """Hashes of values[start:end]; the prefix sums are made once."""

    def __init__(self, values: np.ndarray, base: int):
        up, self._down = _power(base, len(values))
        self._sums = np.empty(len(values) + 1, U)
        self._sums[0] = 0
        np.cumsum(values * up[: len(values)], out=self._sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self._sums[ends] - self._sums[starts]) * self._down[starts])


def runs(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    return Runs(values, base)(starts, ends)


class Words(NamedTuple):
    doc: np.ndarray  # of each word
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # of each document: its first word; one more entry at the end


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a binary array; nulls are empty."""
    if texts.null_count:
        texts = texts.fill_null(b"")
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_binary(texts.type) or pa.types.is_large_string(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)
    offsets = offsets[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    buffer = texts.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(texts: pa.Array, lower: bool = False) -> Words:
    """Words of each text; ``lower`` folds A-Z."""
    data, offsets = flat(texts)
    return split(LOWER[data] if lower else data, offsets)


def split(data: np.ndarray, offsets: np.ndarray) -> Words:
    n = len(data)
    inside = ~_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], inside[:-1]]) if n else inside
    after = np.concatenate([inside[1:], [False]]) if n else inside
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    hashes = _word_hashes(data[inside], end - start)
    first = np.searchsorted(start, offsets)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    return Words(doc, start, end, hashes, first)


def _word_hashes(data: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Of words whose bytes follow one another in ``data``."""
    ends = np.cumsum(sizes)
    place = np.arange(len(data)) - np.repeat(ends - sizes, sizes)
    values = _AT_PLACE[np.minimum(place, _PLACES - 1) * 256 + data]
    late = np.flatnonzero(place >= _PLACES)
    if len(late):
        values[late] = mix((place[late].astype(U) << U(8)) | data[late], 21)
    sums = np.concatenate([[U(0)], np.cumsum(values)])
    return mix(sums[ends] - sums[ends - sizes], 22)


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mix(mix(left, 23) + right, 24)


def run_hashes(values: np.ndarray, length: int, salt: int = 0) -> np.ndarray:
    """Hash of values[i : i + length] for each i that leaves so many."""
    if len(values) < length:
        return np.zeros(0, U)
    level, size, out, covered = mix(values, 25 + salt), 1, None, 0
    while True:
        if length & size:
            out = level if out is None else _joined(out[: len(values) - covered - size + 1], level[covered:])
            covered += size
            if covered == length:
                return out[: len(values) - length + 1]
        level, size = _joined(level[:-size], level[size:]), 2 * size


def windows(w: Words, length: int, hash_number: int = 0, starts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of each run of ``length`` words of one document, or of those that begin
    at ``starts``."""
    n = len(w.hash)
    if starts is None:
        starts = np.arange(max(0, n - length + 1))
        starts = starts[w.doc[starts] == w.doc[starts + length - 1]] if len(starts) else starts
    return starts, run_hashes(w.hash, length, hash_number)[starts]


def spread(positions: np.ndarray, length: int, n: int) -> np.ndarray:
    """Which of ``n`` places lie in [p, p + length) for some p."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, positions, 1)
    np.add.at(change, np.minimum(positions + length, n), -1)
    return np.cumsum(change[:-1]) > 0
