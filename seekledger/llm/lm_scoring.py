"""Language-model scores by the likelihood of the lattice of all segmentations.

An existing unigram vocabulary gives every piece a probability. A word, behind the word mark, can be cut into
pieces in many ways; its probability is the sum over all of them, which a forward recursion in log space
adds up from left to right: the sum at a place is over all pieces that end there. No piece reaches over
a blank, so a text's lattice is the chain of its words' lattices, and each different word is worked out
once however often it occurs. A text's score is the log10 probability that the model ends a text after its
words and does not before, learned from the training texts (one added to ends and to words), times that
of each word.

Beside it stands a count model: words, and one end of each text, with counts of the training texts, one
added to each.

Texts are read once, in chunks of some MB: a chunk keeps its texts as numbers of its own list of words. Each
word of a list goes, once a chunk, to the place where it is counted over all chunks (as the full word,
not a hash) and its lattice is added up; the count and the sum go back to the chunks. What is
exchanged grows with the input; the most frequent word is one row a chunk.

With ``learn`` the model is fitted to the training texts. Every word of them becomes a piece of the lattice
beside its cuts: of N training words, V of them different, one that occurs c times has the probability
(c + V * S) / (N + V), where S is the sum over its cuts. The pieces' probabilities under S are those of
``ROUNDS`` rounds of expectation and maximization over all different training words, each once. Counts, N
and V are exact. The words are written in order with their counts, so a round reads them and moves nothing
but one number a piece.

Sums over many words are added up for all of them at once, place by place (``Lattice.log_probabilities``,
``Lattice.expected_counts``); only words over ``LONG`` characters go one by one.

Cases: a null text is empty: no word, one end; null ids belong to the training texts; characters outside the
vocabulary take the probability of their bytes; repeated rows count as often as they occur; an empty table
gives an empty result, and without any training text all counts are 0; only the named columns are read.
Texts and words of any length are scored whole.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seekledger.llm.scratch import written
from seekledger.llm.sentencepiece_codec import BYTE, MARK, NORMAL, UNKNOWN_PENALTY, USER, Model

#: Bytes of text in a chunk; a longer text is a chunk of its own.
CHUNK_BYTES = 1 << 24
BLANKS = r"[\x20\x09-\x0D]+"
LN10 = math.log(10)
#: Rounds over the different training words.
ROUNDS = 3
#: Expected counts are summed as whole numbers of this part of one, so that no order of tasks matters.
UNIT = 1 << 32
#: Longer words are added up one by one; others together, as many as have so many characters.
LONG, CELLS = 256, 1 << 19


class Trie:
    """Pieces from their last character to their first, as arrays: the node behind ``node`` and a character of
    number ``c`` is ``base[node] + c``, if ``owner`` of that is ``node``; ``piece`` is the number of the piece
    that a node spells, or -1. Characters no piece holds have the number 0."""

    def __init__(self, pieces: list[str]):
        alphabet = sorted({c for p in pieces for c in p})
        number = {c: k for k, c in enumerate(alphabet, 1)}
        self.numbers = np.zeros(0x110000, np.int32)
        self.numbers[[ord(c) for c in alphabet]] = np.arange(1, len(alphabet) + 1)
        self.single = np.zeros(len(alphabet) + 1, bool)
        children: list[dict[int, int]] = [{}]
        spelled = [-1]
        for k, piece in enumerate(pieces):
            node = 0
            for c in reversed(piece):
                after = children[node].get(number[c])
                if after is None:
                    after = children[node][number[c]] = len(children)
                    children.append({})
                    spelled.append(-1)
                node = after
            spelled[node] = k
            if len(piece) == 1:
                self.single[number[piece]] = True
        # nodes move to the places where their parents look for them, those with most children first; place 0 is the root's
        width = len(alphabet) + 1
        used = np.zeros(2 * len(children) + 4 * width, bool)
        used[:width] = True
        place, base = np.zeros(len(children), np.int64), np.zeros(len(children), np.int64)
        free, at, siblings = width, width, 0
        for node in sorted(range(len(children)), key=lambda n: -len(children[n])):
            if not children[node]:
                break
            codes = np.fromiter(children[node], np.int64)
            codes.sort()
            while used[free]:
                free += 1
            # as many children as the node before: what did not fit that one is not tried again
            at = at if siblings == len(codes) and siblings > 1 else free
            siblings = len(codes)
            while used[at + codes - codes[0]].any():
                at += 1
                if at + 2 * width > len(used):
                    used = np.concatenate([used, np.zeros(len(used), bool)])
            base[node] = at - codes[0]
            used[at + codes - codes[0]] = True
            place[[children[node][c] for c in codes]] = at + codes - codes[0]
        size = int(place.max(initial=0)) + width + 1
        self.base, self.owner, self.piece = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        self.base[place], self.piece[place] = base, spelled
        for node, after in enumerate(children):
            self.owner[place[list(after.values())]] = place[node]


_tries: dict[Model, Trie] = {}


def _trie(model: Model) -> Trie:
    if model not in _tries:
        _tries.clear()
        _tries[model] = Trie(_own_pieces(model))
    return _tries[model]


def _own_pieces(model: Model) -> list[str]:
    return list(dict.fromkeys(p for p, k in zip(model.pieces, model.kinds) if k in (NORMAL, USER) and p))


class Lattice:
    """Sums over all segmentations under the pieces of a model, scaled to add up to one."""

    def __init__(self, model: Model, fitted: dict[str, int] | None = None):
        """``fitted``: expected counts of pieces in ``UNIT``, and of the bytes of unknown characters under
        ""; each piece and byte counts once more than that."""
        scores = {p: s for p, s, k in zip(model.pieces, model.scores, model.kinds) if k in (NORMAL, USER)}
        least = min(scores.values(), default=0.0)
        has_bytes = sum(k == BYTE for k in model.kinds) == 256
        weights = [*scores.values(), *([least] * 256 if has_bytes else [])]
        total = _log_sum(weights) if weights else 0.0
        self.byte = least - total if has_bytes else least - total - UNKNOWN_PENALTY
        if fitted is not None:
            bytes_seen = fitted.get("", 0) / UNIT + 256
            scores = {p: math.log(fitted.get(p, 0) / UNIT + 1) for p in scores}
            total = math.log(math.fsum([math.exp(s) for s in scores.values()]) + bytes_seen)
            self.byte = math.log(bytes_seen / 256) - total
        self.known = {p for p in scores if len(p) == 1}
        #: Pieces from their last character to their first; the entry "" is a piece's log probability.
        self.back: dict = {}
        for piece, score in scores.items():
            node = self.back
            for char in reversed(piece):
                node = node.setdefault(char, {})
            node[""] = score - total
        self._text, self._sums = "", [0.0]
        self._model, self.pieces = model, _own_pieces(model)
        #: Log probabilities of pieces by number; the number behind them is that of a byte.
        self.scores = np.array([*(scores[p] - total for p in self.pieces), self.byte])

    @cached_property
    def trie(self) -> Trie:
        return _trie(self._model)

    def log_probability(self, text: str) -> float:
        """Natural logarithm; -inf never occurs, as every character has its bytes. What the text before
        shares with this one is kept, so sorted texts cost little."""
        same = 0
        for x, y in zip(text, self._text):
            if x != y:
                break
            same += 1
        sums = self._sums[: same + 1]
        for end in range(same + 1, len(text) + 1):
            terms, node, at = [], self.back, end - 1
            if text[at] not in self.known:
                terms.append(sums[at] + self.byte * len(text[at].encode("utf-8", "replace")))
            while at >= 0:
                node = node.get(text[at])
                if node is None:
                    break
                score = node.get("")
                if score is not None:
                    terms.append(sums[at] + score)
                at -= 1
            sums.append(terms[0] if len(terms) == 1 else _log_sum(terms))
        self._text, self._sums = text, sums
        return sums[-1]

    def word(self, word: str) -> float:
        """log10 probability of a word behind its mark."""
        return self.log_probability(MARK + word) / LN10

    def expected(self, word: str) -> dict[str, float]:
        """How often each piece is expected in the cuts of a word, given the word; bytes under ""."""
        text = MARK + word
        whole = self.log_probability(text)
        sums, after = self._sums, [0.0] + [-math.inf] * len(text)
        after.reverse()
        found: dict[str, float] = {}

        def step(start: int, end: int, score: float, piece: str, times: int) -> None:
            here = score + after[end]
            chance = math.exp(sums[start] + here - whole)
            found[piece] = found.get(piece, 0.0) + times * chance
            after[start] = here if after[start] == -math.inf else _log_sum([after[start], here])

        for end in range(len(text), 0, -1):
            if after[end] == -math.inf:
                continue
            node, at = self.back, end - 1
            if text[at] not in self.known:
                n_bytes = len(text[at].encode("utf-8", "replace"))
                step(at, end, self.byte * n_bytes, "", n_bytes)
            while at >= 0:
                node = node.get(text[at])
                if node is None:
                    break
                if "" in node:
                    step(at, end, node[""], text[at:end], 1)
                at -= 1
        return found

    def log_probabilities(self, words: pa.Array) -> np.ndarray:
        """log10 probability of each word behind its mark."""
        out = np.zeros(len(words))
        for rows, places in self._together(words):
            out[rows] = places.whole / LN10 if isinstance(places, _Places) else self.word(places)
        return out

    def expected_counts(self, words: pa.Array) -> np.ndarray:
        """How often each piece is expected in the cuts of all words, in ``UNIT``, by number; bytes last. The
        share of each place is a whole number, so the sum is the same however the words are dealt out."""
        counts = np.zeros(len(self.scores), np.int64)
        number = None
        for _, places in self._together(words):
            if isinstance(places, _Places):
                counts += places.expected(len(counts))
            else:
                number = number or {**{p: k for k, p in enumerate(self.pieces)}, "": len(self.pieces)}
                for piece, n in self.expected(places).items():
                    counts[number[piece]] += round(n * UNIT)
        return counts

    def _together(self, words: pa.Array) -> Iterator[tuple]:
        """Rows of words of similar length, and their places; or the row of a long word, and the word."""
        lengths = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        order = np.argsort(-lengths, kind="stable")
        n_long = int((lengths > LONG).sum())
        for row in order[:n_long]:
            yield row, words[int(row)].as_py()
        at = n_long
        while at < len(order):
            rows = order[at : at + max(1, CELLS // int(lengths[order[at]] + 1))]
            yield rows, _Places(self, words.take(pa.array(rows)), lengths[rows])
            at += len(rows)


class _Places:
    """The lattices of some words, the longest first, place by place: what ends at each, and the sums up to it."""

    def __init__(self, lattice: Lattice, words: pa.Array, lengths: np.ndarray):
        trie, n, longest = lattice.trie, len(lengths), int(lengths[0]) + 1
        points = np.frombuffer("".join(words.to_pylist()).encode("utf-32-le"), "<u4")
        begins = np.cumsum(lengths) - lengths
        known = trie.numbers
        self.n, self.longest, self.lengths = n, longest, lengths
        #: Rows whose text, the mark included, has a place ``end``, for each ``end``.
        self.open = np.searchsorted(-(lengths + 1), -np.arange(longest + 1), side="right")
        codes, code_points = np.zeros((longest, n), np.int32), np.zeros((longest, n), np.uint32)
        codes[0], code_points[0] = known[ord(MARK)], ord(MARK)
        for at in range(1, longest):
            m = self.open[at + 1]
            code_points[at, :m] = points[begins[:m] + at - 1]
            codes[at, :m] = known[code_points[at, :m]]
        sums, self.edges = np.zeros((longest + 1, n)), []
        for end in range(1, longest + 1):
            m = self.open[end]
            edges, rows, node = [], np.arange(m), np.zeros(m, np.int32)
            odd = np.flatnonzero(~trie.single[codes[end - 1, :m]])
            if len(odd):
                point = code_points[end - 1, odd]
                n_bytes = 1 + (point >= 0x80) + (point >= 0x800) + (point >= 0x10000)
                edges.append((end - 1, odd, len(lattice.pieces), lattice.byte * n_bytes, n_bytes))
            for at in range(end - 1, -1, -1):
                after = trie.base[node] + codes[at, rows]
                there = trie.owner[after] == node
                rows, node = rows[there], after[there]
                if not len(rows):
                    break
                piece = trie.piece[node]
                spelled = piece >= 0
                if spelled.any():
                    piece = piece[spelled]
                    edges.append((at, rows[spelled], piece, lattice.scores[piece], 1))
            terms = np.full((len(edges), m), -np.inf)
            for k, (at, own, _, score, _) in enumerate(edges):
                terms[k, own] = sums[at, own] + score
            top = terms.max(axis=0)
            total = np.zeros(m)
            for term in terms:
                total += np.exp(term - top)
            sums[end, :m] = top + np.log(total)
            self.edges.append(edges)
        self.sums = sums
        self.whole = sums[lengths + 1, np.arange(n)]

    def expected(self, size: int) -> np.ndarray:
        """Whole numbers of ``UNIT`` for each of ``size`` pieces."""
        after = np.full((self.longest + 1, self.n), -np.inf)
        after[self.lengths + 1, np.arange(self.n)] = 0.0
        pieces, shares = [], []
        for end in range(self.longest, 0, -1):
            for at, rows, piece, score, times in self.edges[end - 1]:
                here = score + after[end, rows]
                share = np.rint(np.exp(self.sums[at, rows] + here - self.whole[rows]) * times * UNIT)
                after[at, rows] = np.logaddexp(after[at, rows], here)
                pieces.append(np.broadcast_to(piece, share.shape))
                shares.append(share)
        # whole numbers, of at most 4 for each character, so a float holds their sum exactly
        return np.bincount(np.concatenate(pieces), np.concatenate(shares), size).astype(np.int64)


def _log_sum(terms: list[float]) -> float:
    top = max(terms)
    return top + math.log(sum([math.exp(t - top) for t in terms]))


_lattices: dict[tuple, Lattice] = {}


def _lattice(model: Model, fitted: dict[str, int] | None) -> Lattice:
    key = (model, None if fitted is None else frozenset(fitted.items()))
    if key not in _lattices:
        _lattices.clear()
        _lattices[key] = Lattice(model, fitted)
    return _lattices[key]


def _some_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The batches, joined to tables of about ``CELLS`` characters, as short ones keep arrays too small."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += pc.sum(pc.binary_length(batch.column("word"))).as_py() or 0
        if size >= CELLS:
            yield pa.Table.from_batches(held).combine_chunks()
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _words_of(table: pa.Table) -> pa.Array:
    words = table.column("word").combine_chunks()
    return words.combine_chunks() if isinstance(words, pa.ChunkedArray) else words


def _expectation(model: Model, fitted: dict[str, int] | None):
    """Words -> expected counts of their pieces."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = _lattice(model, fitted)
        counts = np.zeros(len(lattice.scores), np.int64)
        for table in _some_words(batches):
            counts += lattice.expected_counts(_words_of(table))
        seen = np.flatnonzero(counts)
        if len(seen):
            names = [*lattice.pieces, ""]
            yield pa.record_batch([pa.array([names[k] for k in seen]), pa.array(counts[seen])], names=["piece", "n"])

    return made


def fit_pieces(words: DataFrame, model: Model) -> dict[str, int]:
    """``words(word)``, all of them different -> expected counts, at most one a piece of the model. They are
    read once a round."""
    fitted = None
    for _ in range(ROUNDS):
        counts = words.select("word").mapInArrow(_expectation(model, fitted), "piece string, n long")
        summed = counts.groupBy("piece").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n"))
        fitted = {r.piece: int(r.n) for r in summed.filter("n > 0").collect()}
    return fitted


def text_words(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The words of texts, A-Z lower-cased, as numbers of their list; and where each text's begin."""
    plain = pc.ascii_lower(pc.fill_null(texts, ""))
    lists = pc.split_pattern_regex(plain, pattern=BLANKS)
    offsets = np.asarray(lists.offsets)
    flat = lists.values.slice(offsets[0], offsets[-1] - offsets[0])
    some = pc.not_equal(pc.binary_length(flat), 0)
    before = np.concatenate([[0], np.cumsum(np.asarray(some.to_numpy(zero_copy_only=False), np.int64))])
    return flat.filter(some).dictionary_encode(), before[offsets - offsets[0]]


_CHUNKED = "chunk long, doc_id long, held_out boolean, n_words long, numbers binary, k int, word string, n_train long"
_SCHEMA = pa.schema(
    [("chunk", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_words", pa.int64())]
    + [("numbers", pa.binary()), ("k", pa.int32()), ("word", pa.string()), ("n_train", pa.int64())]
)


def _rows(n: int, **columns) -> pa.RecordBatch:
    """A batch of the table of texts and words; columns not given are null."""
    arrays = [columns[f.name] if f.name in columns else pa.nulls(n, f.type) for f in _SCHEMA]
    return pa.record_batch([a if isinstance(a, pa.Array) else pa.array(a, f.type) for a, f in zip(arrays, _SCHEMA)], schema=_SCHEMA)


def _chunked(parts: int, remainder: int, chunk_bytes: int):
    """Texts -> a row per text, and per chunk a row for each of its words."""

    def held_out(doc_id: int | None) -> bool:
        return doc_id is not None and zlib.crc32(str(doc_id).encode()) % parts == remainder

    def chunk_rows(chunk: int, held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).combine_chunks()
        ids = table.column("doc_id").combine_chunks()
        words, first = text_words(table.column("text").combine_chunks())
        numbers = words.indices.to_numpy().astype("<u4")
        out = np.array([held_out(d) for d in ids.to_pylist()], bool)
        n = np.diff(first)
        trained = np.repeat(~out, n)
        counts = np.bincount(numbers[trained], minlength=len(words.dictionary))
        chunks = lambda n: pa.array(np.full(n, chunk))
        step = 1 << 16
        for a in range(0, len(words.dictionary), step):
            part = words.dictionary.slice(a, step)
            size = len(part)
            yield _rows(size, chunk=chunks(size), k=np.arange(a, a + size, dtype=np.int32), word=part, n_train=counts[a : a + size])
        packed = [numbers[a:b].tobytes() for a, b in zip(first[:-1], first[1:])]
        yield _rows(len(ids), chunk=chunks(len(ids)), doc_id=ids, held_out=out, n_words=n, numbers=packed)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, held, size = TaskContext.get().partitionId() << 28, [], 0
        for batch in batches:
            lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column("text")), 0), np.int64)
            at = 0
            while at < batch.num_rows:
                ends = np.cumsum(lengths[at:]) + size
                n = int(np.searchsorted(ends, chunk_bytes, side="right"))
                n = 1 if n == 0 and not held else n
                if n:
                    held.append(batch.slice(at, n))
                    size, at = int(ends[n - 1]), at + n
                if at < batch.num_rows:
                    yield from chunk_rows(chunk, held)
                    chunk, held, size = chunk + 1, [], 0
        if held:
            yield from chunk_rows(chunk, held)

    return made


_VALUED = "chunk long, k int, c long, z double, first boolean"


def _valued(model: Model, fitted: dict[str, int] | None = None):
    """Words in order -> their lattice sums."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = _lattice(model, fitted)
        for table in _some_words(batches):
            words = _words_of(table)
            new = np.ones(len(words), bool)
            new[1:] = pc.not_equal(words[1:], words[:-1]).to_numpy(zero_copy_only=False)
            z = lattice.log_probabilities(words.filter(pa.array(new)))[np.cumsum(new) - 1]
            columns = {"chunk": table["chunk"], "k": table["k"], "c": table["c"], "z": pa.array(z), "first": table["first"]}
            yield from pa.table(columns).to_batches()

    return made


_SCORED = "doc_id long, held_out boolean, n_words long, known long, log_counts double, log_words double, new_words long"


def _with_words(c: np.ndarray, z: np.ndarray, weight: int) -> np.ndarray:
    """log10 of c + weight * 10^z, also where the power is too small for a number."""
    cuts = z + math.log10(weight)
    top = np.maximum(cuts, np.log10(np.maximum(c, 1)))
    return np.where(c > 0, top + np.log10(c / 10.0**top + 10.0 ** (cuts - top)), cuts)


def _scorer(weight: int | None):
    """``weight`` of the sums over cuts beside the counts of whole words; None: cuts alone."""
    return lambda texts, words: _scored(texts, words, weight)


def _scored(texts: pa.Table, words: pa.Table, weight: int | None) -> pa.Table:
    """One chunk: sums over the words of each of its texts. ``new_words`` of its first text says how many
    trained words are counted by this chunk."""
    texts, words = texts.combine_chunks(), words.combine_chunks()
    k = words.column("k").to_numpy()
    c, z = np.zeros(len(k), np.int64), np.zeros(len(k))
    c[k], z[k] = words.column("c").to_numpy(), words.column("z").to_numpy()
    logs = np.log10(c + 1.0)
    if weight is not None:
        z = _with_words(c, z, weight)
    rows: list[tuple] = []
    for packed in texts.column("numbers").to_pylist():
        numbers = np.frombuffer(packed, "<u4")
        rows.append((int((c[numbers] > 0).sum()), math.fsum(logs[numbers]), math.fsum(z[numbers])))
    known, log_counts, log_words = (list(x) for x in zip(*rows))
    new = pc.sum(pc.and_(words.column("first"), pc.greater(words.column("c"), 0))).as_py() or 0
    columns = [texts.column(n) for n in ("doc_id", "held_out", "n_words")]
    columns += [pa.array(known, pa.int64()), pa.array(log_counts, pa.float64()), pa.array(log_words, pa.float64())]
    columns.append(pa.array([new] + [0] * (len(rows) - 1), pa.int64()))
    return pa.table(columns, names=[c.split()[0] for c in _SCORED.split(", ")])


def score_texts(docs: DataFrame, model: Model, parts: int = 7, held_out: int = 2, learn: bool = False) -> DataFrame:
    """``docs(doc_id, text)`` -> ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.
    Texts whose id has the remainder ``held_out`` are not learned from. Without ``learn`` the pieces keep the
    probabilities of the model and the words are not pieces."""
    columns = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    chunked = written(columns.mapInArrow(_chunked(parts, held_out, CHUNK_BYTES), _CHUNKED), "lm_chunks")
    words = chunked.filter("k IS NOT NULL").select("chunk", "k", "word", "n_train")
    every = Window.partitionBy("word")
    columns = {"c": F.sum("n_train").over(every), "first": F.col("chunk") == F.min("chunk").over(every)}
    counted = words.withColumns(columns).select("chunk", "k", "word", "c", "first")
    fitted, weight, scale = None, None, 0.0
    if learn:
        counted = written(counted, "lm_words")  # in the order of the words
        trained = counted.filter("first AND c > 0")
        seen, different = trained.agg(F.sum("c"), F.count(F.lit(1))).first()
        fitted, weight = fit_pieces(trained, model), max(different, 1)
        scale = math.log10((seen or 0) + weight)
    valued = counted.mapInArrow(_valued(model, fitted), _VALUED)
    texts = chunked.filter("k IS NULL").select("chunk", "doc_id", "held_out", "n_words", "numbers")
    pairs = texts.groupBy("chunk").cogroup(valued.groupBy("chunk"))
    scored = written(pairs.applyInArrow(_scorer(weight), _SCORED), "lm_scored")
    learned = F.when(~F.col("held_out"), F.col("n_words") + 1)
    row = scored.agg(F.sum(learned), F.count(learned), F.sum("new_words")).first()
    tokens, ends, distinct = (x or 0 for x in row)
    total = tokens + distinct + bool(ends) + 1
    ending = (ends + 1) / (tokens + 2)
    n_tokens = F.col("n_words") + 1
    base = F.col("log_counts") + math.log10(ends + 1) - n_tokens * math.log10(total)
    score = F.col("log_words") + F.col("n_words") * (math.log1p(-ending) / LN10 - scale) + math.log10(ending)
    return scored.select(
        "doc_id",
        "held_out",
        n_tokens.alias("n_tokens"),
        (F.col("known") + int(ends > 0)).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        score.alias("score"),
    )
