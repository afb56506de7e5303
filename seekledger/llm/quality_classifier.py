"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

Random indexing gives every word a fixed sparse vector of a few +1 and -1, by hash, and learns a word's
vector as the sum of those of its neighbours. Words share ``SLOTS`` rows of a table by hash, so the model
has a fixed size; a word's row is found by its lower-cased form and by its shape (case, digits, symbols,
marks, length), which unseen words have too. A document is the mean vector of its words and of their
shapes, with a few measures of repetition. A network with one hidden layer of tanh units, trained with
numpy on the driver, gives a logit, whose temperature is then fitted on rows kept from training.

Word vectors and network are fitted on a sample of at most about ``max_rows`` labelled documents; the driver
holds the table (``SLOTS`` x ``DIMENSIONS``) and the pooled vectors of the sample, both bounded.

Cases: null and empty texts have zero vectors and are scored like all others; null labels are left out; with
no labelled row, or one class only, every score is that class's share smoothed towards one half; repeated
rows are scored alike; extra columns are ignored; whole texts are pooled.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seekledger.llm.arrays import LOWER, Words, flat, mix, split, windows
from seekledger.llm.quality_rules import bounded_sample
from seekledger.llm.scratch import written

U = np.uint64
SLOTS, DIMENSIONS, NONZERO, REACH = 8192, 48, 4, 2
HIDDEN = 24
MEASURES = 5
#: Bytes of text pooled at a time.
_BATCH_BYTES = 2 << 20


def _class_of(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars]] = True
    return out


_UPPER = _class_of("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_DIGIT = _class_of("0123456789")
_SYMBOL = _class_of("#*$%&|<>@^~_=+\\/{}[]")
_MARK = _class_of("!?;:")


class Coded(NamedTuple):
    words: Words
    slot: np.ndarray  # row of the lower-cased form
    shape: np.ndarray  # row of the shape


def code(texts: pa.Array) -> Coded:
    data, offsets = flat(texts)
    words = split(LOWER[data], offsets)

    def count(member: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(member[data])])
        return sums[words.end] - sums[words.start]

    size = np.minimum((words.end - words.start) // 4, 3)
    shape = np.minimum(count(_UPPER), 2)
    for part, limit in ((count(_DIGIT), 1), (count(_SYMBOL), 2), (count(_MARK), 2), (size, 3)):
        shape = shape * (limit + 1) + np.minimum(part, limit)
    half = SLOTS // 2
    slot = (words.hash >> U(40)).astype(np.int64) % half
    return Coded(words, slot, half + (mix(shape.astype(U), 71) >> U(40)).astype(np.int64) % half)


def _index_vector(hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Place and sign of entry k of the fixed sparse vectors."""
    h = mix(hashes, 80 + k)
    return (h >> U(33)).astype(np.int64) % DIMENSIONS, np.where(h & U(1), 1.0, -1.0)


def context_sums(coded: Coded) -> np.ndarray:
    """Sums of the neighbours' fixed vectors, by row of the table."""
    out = np.zeros(SLOTS * DIMENSIONS)
    n = len(coded.slot)
    for step in range(1, REACH + 1):
        near = np.flatnonzero(coded.words.doc[step:] == coded.words.doc[:-step]) if n > step else np.zeros(0, np.int64)
        for word, other in ((near, near + step), (near + step, near)):
            for k in range(NONZERO):
                place, sign = _index_vector(coded.words.hash[other], k)
                for rows in (coded.slot, coded.shape):
                    out += np.bincount(rows[word] * DIMENSIONS + place, sign, SLOTS * DIMENSIONS)
    return out.reshape(SLOTS, DIMENSIONS)


def _pooled(coded: Coded, table: np.ndarray, n_docs: int) -> np.ndarray:
    """Mean vectors of words and shapes of each document, and measures of repetition."""
    first = coded.words.first
    n = np.diff(first)
    some = np.flatnonzero(n)
    out = np.zeros((n_docs, 2 * DIMENSIONS + MEASURES), np.float32)

    def distinct(values: np.ndarray, doc: np.ndarray) -> np.ndarray:
        packed = np.sort((doc.astype(U) << U(44)) | (values >> U(20)))
        packed = packed[np.append(True, packed[1:] != packed[:-1])] if len(packed) else packed
        return np.bincount((packed >> U(44)).astype(np.int64), minlength=n_docs)

    if len(some):
        for k, rows in enumerate((coded.slot, coded.shape)):
            for a in range(0, DIMENSIONS, 16):  # a few columns at a time keep the gathered rows small
                sums = np.add.reduceat(table[:, a : a + 16][rows], first[some], axis=0)
                out[some, k * DIMENSIONS + a : k * DIMENSIONS + a + 16] = sums / n[some, None]
        at, runs3 = windows(coded.words, 3)
        base = 2 * DIMENSIONS
        out[:, base] = np.log1p(n)
        out[:, base + 1] = distinct(coded.words.hash, coded.words.doc) / np.maximum(n, 1)
        out[:, base + 2] = distinct(runs3, coded.words.doc[at]) / np.maximum(n - 2, 1)
        packed = np.sort(coded.words.doc * SLOTS + coded.shape)
        starts = np.flatnonzero(np.append(True, packed[1:] != packed[:-1]))
        most = np.zeros(n_docs)  # words of the most frequent shape
        np.maximum.at(most, packed[starts] // SLOTS, np.diff(np.append(starts, len(packed))))
        out[:, base + 3] = most / np.maximum(n, 1)
        length = np.bincount(coded.words.doc, coded.words.end - coded.words.start, n_docs)
        out[:, base + 4] = length / np.maximum(n, 1) / 10
    return out


def _pieces(texts: pa.Array) -> Iterator[pa.Array]:
    ends = flat(texts)[1][1:]
    at = 0
    while at < len(texts):
        base = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, base + _BATCH_BYTES, side="right")))
        yield texts.slice(at, stop - at)
        at = stop


def pool(texts: pa.Array, table: np.ndarray) -> np.ndarray:
    parts = [_pooled(code(x), table, len(x)) for x in _pieces(texts)]
    return np.concatenate(parts) if parts else np.zeros((0, 2 * DIMENSIONS + MEASURES), np.float32)


class Network(NamedTuple):
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return (np.tanh(z @ self.w1 + self.b1) @ self.w2 + self.b2) / self.temperature

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -30, 30)))


def _loss(logits: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, logits) - y * logits))


def fit_network(x: np.ndarray, y: np.ndarray, epochs: int = 60, batch: int = 256, rate: float = 0.005, seed: int = 3) -> Network:
    """Adam on the cross entropy of four fifths of the rows, with classes weighted evenly; the
    temperature is fitted on the rest by the unweighted cross entropy."""
    random = np.random.default_rng(seed)
    d = x.shape[1]
    none = np.zeros(d), np.ones(d), np.zeros((d, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN)
    good = float(y.sum())
    if good in (0.0, float(len(y))):
        return Network(*none, float(np.log((good + 1) / (len(y) - good + 1))), 1.0)
    mean, scale = x.mean(0), x.std(0) + 1e-3
    z = np.clip((x - mean) / scale, -8, 8)
    rows = random.permutation(len(y))
    held, own = rows[: len(y) // 5], rows[len(y) // 5 :]
    weights = [random.normal(0, d**-0.5, (d, HIDDEN)), np.zeros(HIDDEN), random.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
    first = [np.zeros_like(w) for w in weights]
    second = [np.zeros_like(w) for w in weights]
    share = y[own].mean() if 0 < y[own].mean() < 1 else 0.5
    importance = np.where(y > 0, 0.5 / share, 0.5 / (1 - share))
    step = 0
    for _ in range(epochs):
        for part in np.array_split(random.permutation(own), max(1, len(own) // batch)):
            w1, b1, w2, b2 = weights
            h = np.tanh(z[part] @ w1 + b1)
            p = 1 / (1 + np.exp(-np.clip(h @ w2 + b2[0], -30, 30)))
            e = (p - y[part]) * importance[part] / len(part)
            dh = np.outer(e, w2) * (1 - h * h)
            gradients = [z[part].T @ dh + 1e-4 * w1, dh.sum(0), h.T @ e + 1e-4 * w2, np.array([e.sum()])]
            step += 1
            for k, g in enumerate(gradients):
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                weights[k] = weights[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    w1, b1, w2, b2 = weights
    net = Network(mean, scale, w1, b1, w2, float(b2[0]), 1.0)
    if len(held):
        raw = net.logits(x[held])
        choices = np.exp(np.linspace(np.log(0.2), np.log(8), 60))
        net = net._replace(temperature=float(min(choices, key=lambda t: _loss(raw / t, y[held]))))
    return net


class Model(NamedTuple):
    table: np.ndarray
    network: Network


def train(labelled: DataFrame, max_rows: int = 12_000, text: str = "text", label: str = "quality", parts: int = 8) -> Model:
    """Fit on rows with ``doc_id``, ``text`` and ``label`` (0 or 1), at most about ``max_rows`` of them,
    chosen by hash, which are written out once. Callers with a large corpus pass rows already sampled."""
    rows = labelled.filter(F.col(label).isin(0, 1)).select(
        "doc_id", F.col(text).cast("binary").alias("text"), F.col(label).cast("int").alias("label")
    )
    rows = written(rows, "quality_rows")
    rows = bounded_sample(rows, max_rows, salt=37)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((SLOTS, DIMENSIONS))
        for batch in batches:
            for piece in _pieces(batch.column("text")):
                total += context_sums(code(piece))
        yield pa.record_batch([pa.array([total.astype(np.float32).tobytes()], pa.binary())], names=["sums"])

    few = written(rows.repartition(parts, "doc_id"), "quality_sample")
    total = np.zeros((SLOTS, DIMENSIONS))
    for row in few.coalesce(parts).mapInArrow(sums, "sums binary").collect():
        total += np.frombuffer(row.sums, np.float32).reshape(SLOTS, DIMENSIONS)
    norm = np.linalg.norm(total, axis=1, keepdims=True)
    table = np.ascontiguousarray(total / np.maximum(norm, 1e-9), np.float32)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pool(batch.column("text"), table)
            yield pa.record_batch(
                [batch.column("doc_id"), batch.column("label"), pa.array([v.tobytes() for v in x], pa.binary())],
                names=["doc_id", "label", "vector"],
            )

    kind = labelled.schema["doc_id"].dataType.simpleString()
    found = few.mapInArrow(vectors, f"doc_id {kind}, label int, vector binary").collect()
    found.sort(key=lambda r: (str(r.doc_id), r.label, bytes(r.vector)))
    vectors_ = [np.frombuffer(r.vector, np.float32) for r in found]
    x = np.array(vectors_, np.float64).reshape(len(found), 2 * DIMENSIONS + MEASURES)
    return Model(table, fit_network(x, np.array([r.label for r in found], float)))


def score(docs: DataFrame, model: Model, text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``carry`` columns + ``score``: how likely a text is of quality 1."""
    rows = docs.select(*carry, F.col(text).cast("binary").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = model.network.scores(pool(batch.column("_text"), model.table))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in carry), pa.array(found.astype(np.float64))], names=[*carry, "score"]
            )

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "_text"]
    return rows.mapInArrow(run, ", ".join([*fields, "score double"]))
