"""SentencePiece encoding and decoding by a streaming Viterbi search over the model's piece scores.

The best segmentation of a text is the path with the largest sum of piece scores. ``StreamingViterbi``
reads characters in order and keeps only the open part of the text: no piece is longer than the
longest in the vocabulary, so later pieces can start only at the last ``longest`` boundaries. Whenever
the paths back from all of those run together at one boundary, what lies before it is final and its ids
are committed. Where no piece can span a place at all (before a word mark, around a character no piece
holds) the paths run together by themselves; the stretch between two such places always has the same
ids, which a task remembers for short stretches.

Only the model file's pieces, scores and flags are used. A unigram model's scores are log probabilities
and serve as they are. A BPE model's scores are merge ranks, which cannot be added up; its pieces get the
log probability that Zipf's law gives their rank, so the ids are those of the best path under these, not
those that the order of merges gives. Characters outside the vocabulary fall back to their UTF-8 bytes
where the model has byte pieces.

Cases: null and empty texts have no ids and decode to the empty text; a text of blanks only decodes to
itself; the word mark itself (U+2581) in a text decodes to a blank; ids outside the vocabulary raise; extra
columns are carried along; repeated rows are coded alike; text is not capped.
"""

from __future__ import annotations

import math
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

MARK = "▁"
#: Piece kinds of the model format (fixed by the format).
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
BPE = 2  # model type
UNKNOWN_PENALTY = 10.0
#: Stretches up to this length are remembered, so many of them in each generation.
MEMORY_CHARS, MEMORY_ENTRIES = 32, 200_000


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(field number, value) of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 0x7F) << shift
            if byte < 0x80:
                return value
            shift += 7

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 2:
            n = varint()
            yield tag >> 3, data[at : at + n]
            at += n
        else:
            n = 8 if kind == 1 else 4
            yield tag >> 3, data[at : at + n]
            at += n


@dataclass(frozen=True)
class Model:
    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    kinds: tuple[int, ...]
    dummy_prefix: bool = True
    squeeze: bool = False

    @staticmethod
    def load(path: str) -> Model:
        pieces, scores, kinds, prefix, squeeze, ranked = [], [], [], True, True, False
        for number, value in _fields(Path(path).read_bytes()):
            if number == 1:
                piece = dict(_fields(value))
                pieces.append(piece[1].decode("utf-8"))
                scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                kinds.append(piece.get(3, NORMAL))
            elif number == 2:
                ranked = dict(_fields(value)).get(3) == BPE
            elif number == 3:
                spec = dict(_fields(value))
                if spec.get(2):
                    raise ValueError("models with a character map for normalisation are not supported")
                prefix, squeeze = bool(spec.get(3, 1)), bool(spec.get(4, 1))
        if ranked:
            scores = [-math.log(2 - s) if k in (NORMAL, USER) else s for s, k in zip(scores, kinds)]
        return Model(tuple(pieces), tuple(scores), tuple(kinds), prefix, squeeze)


_codecs: dict[Model, Codec] = {}


def _codec(model: Model) -> Codec:
    """The codec of a model, kept with its memory by the worker process from task to task."""
    if model not in _codecs:
        _codecs.clear()
        _codecs[model] = Codec(model)
    return _codecs[model]


class Codec:
    def __init__(self, model: Model):
        self.model = model
        usable = [k in (NORMAL, USER) for k in model.kinds]
        self.vocabulary = {p: (s, i) for i, (p, s, u) in enumerate(zip(model.pieces, model.scores, usable)) if u}
        self.longest = max(map(len, self.vocabulary), default=1)
        self.trie: dict = {}
        for piece, entry in self.vocabulary.items():
            node = self.trie
            for char in piece:
                node = node.setdefault(char, {})
            node[""] = entry
        self.unknown_id = model.kinds.index(UNKNOWN) if UNKNOWN in model.kinds else 0
        least = min((s for s, _ in self.vocabulary.values()), default=0.0)
        self.unknown = least - UNKNOWN_PENALTY
        byte_ids = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(model.pieces, model.kinds)) if k == BYTE}
        self.byte_ids = byte_ids if len(byte_ids) == 256 else None
        loose = "".join(c for c in "\n\r\t" if not any(c in p for p in self.vocabulary))
        # a mark after another character always begins a stretch, if no piece holds one further on
        self.marks_cut = not any(MARK in p.lstrip(MARK) for p in self.vocabulary)
        other = re.escape(MARK + loose)
        cut = f"|[{re.escape(loose)}]" if loose else ""
        self.stretches = re.compile(f"{MARK}*[^{other}]+|{MARK}+{cut}") if self.marks_cut else re.compile(r"(?s).+")
        self.memory = _Memory(self)
        self._text = [self._shown(i) for i in range(len(model.pieces))]
        self._late = np.array([k == BYTE and int(p[3:5], 16) > 127 for p, k in zip(model.pieces, model.kinds)])

    def _shown(self, i: int) -> str:
        piece, kind = self.model.pieces[i], self.model.kinds[i]
        if kind == CONTROL:
            return ""
        if kind == UNKNOWN:
            return " ⁇ "
        if kind == BYTE:
            value = int(piece[3:5], 16)
            return chr(value) if value < 128 else ""
        return piece.replace(MARK, " ")

    def normalised(self, text: str) -> str:
        if self.model.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        if not text:
            return ""
        return (MARK if self.model.dummy_prefix else "") + text.replace(" ", MARK)

    def unknown_ids(self, char: str) -> list[int]:
        if self.byte_ids is None:
            return [self.unknown_id]
        return [self.byte_ids[b] for b in char.encode("utf-8")]

    def encode_packed(self, text: str) -> bytes:
        """Ids as little-endian 32-bit integers."""
        return b"".join(map(self.memory.__getitem__, self.stretches.findall(self.normalised(text))))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_packed(text), "<i4").tolist()

    def decode(self, ids: np.ndarray) -> str:
        shown = self._text
        if len(ids) and self._late[ids].any():
            out: list[str] = []
            pending = bytearray()
            for i in ids.tolist():
                if self.model.kinds[i] == BYTE:
                    pending.append(int(self.model.pieces[i][3:5], 16))
                    continue
                if pending:
                    out.append(pending.decode("utf-8", "replace"))
                    pending.clear()
                out.append(shown[i])
            out.append(pending.decode("utf-8", "replace"))
            text = "".join(out)
        else:
            text = "".join([shown[i] for i in ids.tolist()])
        return text[1:] if self.model.dummy_prefix and text.startswith(" ") else text


class _Memory(dict):
    """Ids of stretches, packed. Two generations of bounded size: what is still in use when the young one
    is full moves over from the old one as it is asked for again."""

    def __init__(self, codec: Codec):
        super().__init__()
        self.codec = codec
        self.old: dict[str, bytes] = {}

    def __missing__(self, stretch: str) -> bytes:
        packed = self.old.get(stretch)
        if packed is None:
            search = StreamingViterbi(self.codec)
            ids = search.feed(stretch) + search.finish()
            packed = struct.pack(f"<{len(ids)}i", *ids)
        if len(stretch) <= MEMORY_CHARS:
            if len(self) >= MEMORY_ENTRIES:
                self.old = dict(self)
                self.clear()
            self[stretch] = packed
        return packed


class StreamingViterbi:
    """Feed characters, get the ids that are final; ``finish`` gives the rest.

    ``open`` holds the characters after the last committed boundary. A start is expanded, along the trie
    of pieces, once as many characters follow it as the longest piece has."""

    def __init__(self, codec: Codec):
        self.codec = codec
        self.open = ""
        self.best = [0.0]  # of each boundary reached so far
        self.back: list[tuple[int, int | None]] = [(0, None)]  # where its last piece starts, and the id
        self.done = 0  # starts expanded
        self.widest = 0  # the longest open part so far

    def feed(self, text: str) -> list[int]:
        out: list[int] = []
        longest = self.codec.longest
        for at in range(0, len(text), longest):
            self.open += text[at : at + longest]
            self.widest = max(self.widest, len(self.open))
            self._expand(len(self.open) - longest)
            if self.done >= longest:
                out += self._commit()
        return out

    def _expand(self, limit: int) -> None:
        codec, window, best, back = self.codec, self.open, self.best, self.back
        trie, unknown, n = codec.trie, codec.unknown, len(window)
        for start in range(self.done, limit):
            base, node = best[start], trie
            for end in range(start, n):
                node = node.get(window[end])
                if node is None:
                    break
                piece = node.get("")
                if piece is not None:
                    score = base + piece[0]
                    while len(best) < end + 2:
                        best.append(-math.inf)
                        back.append((0, None))
                    if score > best[end + 1]:
                        best[end + 1] = score
                        back[end + 1] = (start, piece[1])
            if window[start] not in codec.vocabulary:  # a single character always has an unknown piece at least
                if len(best) < start + 2:
                    best.append(-math.inf)
                    back.append((0, None))
                if base + unknown > best[start + 1]:
                    best[start + 1] = base + unknown
                    back[start + 1] = (start, None)
        self.done = max(self.done, limit)

    def _commit(self) -> list[int]:
        """Commits up to the boundary at which the paths of all live boundaries meet. Live are those
        from which pieces are still to start."""
        live = {e for e in range(self.done, len(self.best)) if self.best[e] > -math.inf}
        while len(live) > 1:
            last = max(live)
            live.remove(last)
            live.add(self.back[last][0])
        meet = live.pop()
        if meet == 0:
            return []
        out = self._ids(meet)
        self.open = self.open[meet:]
        self.best = [b - self.best[meet] for b in self.best[meet:]]
        self.back = [(max(at - meet, 0), piece) for at, piece in self.back[meet:]]
        self.done -= meet
        return out

    def _ids(self, end: int) -> list[int]:
        path: list[tuple[int, int, int | None]] = []
        back = self.back
        while end > 0:
            start, piece = back[end]
            path.append((start, end, piece))
            end = start
        out: list[int] = []
        for start, stop, piece in reversed(path):
            if piece is None:
                out += self.codec.unknown_ids(self.open[start:stop])
            else:
                out.append(piece)
        return out

    def finish(self) -> list[int]:
        self._expand(len(self.open))
        out = self._ids(len(self.open))
        self.__init__(self.codec)
        return out


def _ddl(df: DataFrame, drop: tuple[str, ...] = ()) -> list[str]:
    return [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name not in drop]


def _packed_lists(packed: list[bytes]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(p) // 4 for p in packed])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(packed), "<i4")))


def _replaced(batch: pa.RecordBatch, drop: tuple[str, ...], columns: list[pa.Array]) -> pa.RecordBatch:
    kept = [n for n in batch.schema.names if n not in drop]
    arrays = [*(batch.column(n) for n in kept), *columns]
    return pa.RecordBatch.from_arrays(arrays, names=[*kept, *(f"_{i}" for i in range(len(columns)))])


def encode(docs: DataFrame, model: Model, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` + ``ids`` (array<int>)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model)
        for batch in batches:
            packed = [codec.encode_packed(t or "") for t in batch.column(text).to_pylist()]
            yield _replaced(batch, (ids,), [_packed_lists(packed)])

    return docs.drop(ids).mapInArrow(run, ", ".join([*_ddl(docs, (ids,)), f"`{ids}` array<int>"]))


def decode(coded: DataFrame, model: Model, ids: str = "ids", text: str = "text") -> DataFrame:
    """``coded`` with ``ids`` turned into ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model)
        for batch in batches:
            texts = [codec.decode(np.asarray(x.values, np.int64)) if x.is_valid else "" for x in batch.column(ids)]
            yield _replaced(batch, (ids, text), [pa.array(texts, pa.string())])

    kept = coded.drop(text)
    return kept.mapInArrow(run, ", ".join([*_ddl(kept, (ids,)), f"`{text}` string"]))


def round_trip(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` without ``text`` + ``n_ids`` (long), ``packed`` (ids as 32-bit little-endian binary)
    and ``decoded`` (string), in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model)
        for batch in batches:
            packed = [codec.encode_packed(t or "") for t in batch.column(text).to_pylist()]
            ids = [np.frombuffer(p, "<i4") for p in packed]
            yield _replaced(
                batch, (text,),
                [pa.array([len(x) for x in ids], pa.int64()), pa.array(packed, pa.binary()),
                 pa.array([codec.decode(x) for x in ids], pa.string())],
            )

    docs = docs.drop("n_ids", "packed", "decoded")
    return docs.mapInArrow(run, ", ".join([*_ddl(docs, (text,)), "n_ids long", "packed binary", "decoded string"]))


def coded_text(docs: DataFrame, model: Model, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with ``ids`` (array<int>) of the text and, in its place, the text decoded from them, in one
    pass: a task needs one Python worker, and texts cross to it once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model)
        for batch in batches:
            packed = [codec.encode_packed(t or "") for t in batch.column(text).to_pylist()]
            texts = [codec.decode(np.frombuffer(p, "<i4")) for p in packed]
            yield _replaced(batch, (ids, text), [_packed_lists(packed), pa.array(texts, pa.string())])

    return docs.mapInArrow(run, ", ".join([*_ddl(docs, (ids, text)), f"`{ids}` array<int>", f"`{text}` string"]))
