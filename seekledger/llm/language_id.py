"""Language of the words of code-switched text by a linear-chain conditional random field.

Words carry hashed features: the word, its first and last one to three letters (affixes), its letter
two- and three-grams, and whether it is in a language's lexicon (words that training texts of one language
use and others hardly do). Weights of these features and of the transitions between languages are learned
together by stochastic gradient ascent on the likelihood; gradients and predictions come from the forward
and backward passes, run over many chains at once. A chain is a line of a text, or each ``CHAIN`` words of
a longer line. A document's language is the one with the largest sum of word marginals over its words that
have a letter. ``label_words`` gives the labelled words themselves, ``predict`` the documents' languages; both
come from the same marginals.

Training uses a span of one line of each of at most about ``max_docs`` documents, and of some documents of
every language however rare it is; documents, lines and places of spans are chosen by hash
(``training_lines``). It joins spans of lines in different languages, so that transitions learn how seldom languages switch.
The model has a fixed size, whatever the corpus.

Cases: null texts and texts without a letter are ``und`` with score 0; training rows without a language are
left out; with no training row at all every text is ``und``; with one language it has all marginals; repeated
rows are predicted alike; extra columns are ignored; whole texts are used, line by line.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seekledger.llm.arrays import RUN_BASES, Runs, mix, runs
from seekledger.llm.native import words as words_of

U = np.uint64
UNDETERMINED = "und"
CHAIN = 256
FEATURE_BITS = 16
#: Words and characters of a line that trains, at most; the span starts anywhere in the line.
SPAN_WORDS = 64
SPAN_CHARS = 2000
#: Documents of each language that train, about so many or all of a rarer one.
LEAST_DOCS = 50
#: Words of text coded at a time.
_BATCH_CHARS = 1_000_000


class Words(NamedTuple):
    code: np.ndarray  # lower-cased code points
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    chain: np.ndarray
    letters: np.ndarray  # of each word
    hash: np.ndarray


def _letters(code: np.ndarray) -> np.ndarray:
    known, place = np.unique(code, return_inverse=True)
    return np.array([chr(c).isalpha() for c in known], bool)[place] if len(code) else np.zeros(0, bool)


def read_words(texts: list[str | None], lower: bool = True) -> Words:
    cased = ((t or "").lower() if lower else t or "" for t in texts)
    parts = [t.encode("utf-32-le", "replace") for t in cased]
    code = np.frombuffer(b"".join(parts), np.uint32)
    offsets = np.concatenate([[0], np.cumsum([len(p) // 4 for p in parts])]).astype(np.int64)
    blank = (code == 0x20) | ((code >= 0x09) & (code <= 0x0D))
    edge = np.zeros(len(code) + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[True], blank[:-1]]) if len(code) else blank
    after = np.concatenate([blank[1:], [True]]) if len(code) else blank
    start = np.flatnonzero(~blank & (before | edge[:-1]))
    end = np.flatnonzero(~blank & (after | edge[1:])) + 1
    doc = np.searchsorted(offsets, start, side="right") - 1
    line = np.concatenate([[0], np.cumsum(code == 0x0A)])[start]
    new = np.ones(len(start), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (line[1:] != line[:-1])
    first = np.maximum.accumulate(np.where(new, np.arange(len(start)), 0))
    new |= (np.arange(len(start)) - first) % CHAIN == 0
    alpha = np.concatenate([[0], np.cumsum(_letters(code))])
    values = mix(code.astype(U), 21)
    return Words(code, doc, start, end, np.cumsum(new) - 1, alpha[end] - alpha[start], runs(values, start, end, RUN_BASES[0]))


def features(code: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word, hashed feature) of the words code[start:end]."""
    run = Runs(mix(code.astype(U), 21), RUN_BASES[0])
    size = end - start
    words, hashed = [np.arange(len(start))], [mix(run(start, end), 31)]
    for n in (1, 2, 3):
        long = np.flatnonzero(size >= n)
        words += [long, long]
        hashed.append(mix(run(start[long], start[long] + n), 40 + n))
        hashed.append(mix(run(end[long] - n, end[long]), 50 + n))
    for n in (2, 3):
        count = np.maximum(size - n + 1, 0)
        word = np.repeat(np.arange(len(start)), count)
        at = np.arange(len(word)) - np.repeat(np.cumsum(count) - count, count) + start[word]
        words.append(word)
        hashed.append(mix(run(at, at + n), 60 + n))
    return np.concatenate(words), (np.concatenate(hashed) >> U(64 - FEATURE_BITS)).astype(np.int64)


class Model(NamedTuple):
    languages: list[str]
    weights: np.ndarray  # hashed feature x language
    lexicon: np.ndarray  # sorted word hashes
    lexicon_of: np.ndarray  # language of each
    lexicon_weights: np.ndarray  # lexicon language x language
    transitions: np.ndarray  # from x to


def _in_lexicon(model: Model, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word, language) of the words in the lexicon."""
    if not len(model.lexicon):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(model.lexicon, hashes), len(model.lexicon) - 1)
    hit = np.flatnonzero(model.lexicon[at] == hashes)
    return hit, model.lexicon_of[at[hit]]


def _emissions(model: Model, words: Words) -> np.ndarray:
    """Score of each word and language; equal words are scored once."""
    known, first, place = np.unique(words.hash, return_index=True, return_inverse=True)
    owner, feature = features(words.code, words.start[first], words.end[first])
    score = np.stack(
        [np.bincount(owner, model.weights[feature, k], len(known)) for k in range(len(model.languages))], 1
    ).astype(np.float64, copy=False)  # without words bincount gives integers
    hit, language = _in_lexicon(model, known)
    score[hit] += model.lexicon_weights[language]
    return score[place]


def _layout(chain: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chains by falling length: (first word, length) of each and its number."""
    first = np.flatnonzero(np.append(True, chain[1:] != chain[:-1])) if len(chain) else np.zeros(0, np.int64)
    length = np.diff(np.append(first, len(chain)))
    order = np.argsort(-length, kind="stable")
    return first[order], length[order], order


def forward_backward(
    emissions: np.ndarray, chain: np.ndarray, transitions: np.ndarray, pairs: bool = False
) -> tuple[np.ndarray, np.ndarray | None]:
    """Marginals of each word, and summed marginals of neighbours if ``pairs``. All chains step
    together, the shorter ones dropping out."""
    n, k = emissions.shape
    gamma = np.zeros((n, k))
    xi = np.zeros((k, k)) if pairs else None
    if n == 0:
        return gamma, xi
    first, length, _ = _layout(chain)
    e = np.exp(emissions - emissions.max(1, keepdims=True))
    t = np.exp(transitions)
    alpha = np.empty((n, k))
    live = np.searchsorted(-length, -np.arange(1, length[0] + 1), side="right")  # chains longer than a step
    a = None
    for step, m in enumerate(live):
        at = first[:m] + step
        a = e[at] if a is None else (a[:m] @ t) * e[at]
        a /= a.sum(1, keepdims=True)
        alpha[at] = a
    b = np.zeros((0, k))
    for step in range(len(live) - 1, -1, -1):
        m = live[step]
        b = np.concatenate([b, np.ones((m - len(b), k))])
        at = first[:m] + step
        g = alpha[at] * b
        gamma[at] = g / g.sum(1, keepdims=True)
        if step:
            back = e[at] * b
            if pairs:
                joint = alpha[at - 1][:, :, None] * t[None] * back[:, None, :]
                xi += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
            b = back @ t.T
            b /= b.sum(1, keepdims=True)
    return gamma, xi


def _span(text: str) -> list[str]:
    """Words of a line, or ``SPAN_WORDS`` of them from a place that a hash of the line gives."""
    words = text.split()
    begin = zlib.crc32(text.encode("utf-8", "replace")) % max(1, len(words) - SPAN_WORDS + 1)
    return words[begin : begin + SPAN_WORDS]


def train(lines: list[tuple[str, str]], epochs: int = 5, batch: int = 256, rate: float = 0.25, seed: int = 7) -> Model:
    """Learn from (text, language) lines."""
    random = np.random.default_rng(seed)
    languages = sorted({language for _, language in lines})
    number = {language: k for k, language in enumerate(languages)}
    k = len(languages)
    cut = [(_span(text), number[language]) for text, language in lines]
    cut = [(words, y) for words, y in cut if words]
    chains: list[list[tuple[str, int]]] = [[(w, y) for w in words] for words, y in cut]
    for _ in range(len(cut) // 2):  # code-switched chains: spans of two or three lines
        mixed: list[tuple[str, int]] = []
        for j in random.integers(0, len(cut), random.integers(2, 4)):
            words, y = cut[j]
            n = int(random.integers(2, 13))
            begin = int(random.integers(0, max(1, len(words) - n + 1)))
            mixed += [(w, y) for w in words[begin : begin + n]]
        chains.append(mixed)
    texts = [" ".join(w for w, _ in c) for c in chains]
    words = read_words(texts)
    labels = np.array([y for c in chains for _, y in c], np.int64)
    counts = np.zeros(0)
    known, first, place = np.unique(words.hash, return_index=True, return_inverse=True)
    counts = np.bincount(place * max(k, 1) + labels, minlength=len(known) * max(k, 1)).reshape(-1, max(k, 1))
    total = counts.sum(1)
    best = counts.argmax(1) if k else np.zeros(0, np.int64)
    telling = (total >= 3) & (counts.max(1, initial=0) >= 0.9 * total)
    model = Model(
        languages, np.zeros((1 << FEATURE_BITS, k)), known[telling], best[telling], np.zeros((k, k)), np.zeros((k, k))
    )
    if k < 2:
        return model
    owner, feature = features(words.code, words.start[first], words.end[first])
    order = np.argsort(owner, kind="stable")
    feature, begin = feature[order], np.searchsorted(owner[order], np.arange(len(known) + 1))
    in_lexicon = np.full(len(known), -1)
    hit, language = _in_lexicon(model, known)
    in_lexicon[hit] = language
    squares = [np.full(x.shape, 1e-6) for x in (model.weights, model.lexicon_weights, model.transitions)]
    chain_first = np.searchsorted(words.chain, np.arange(words.chain.max() + 2))
    for _ in range(epochs):
        shuffled = random.permutation(len(chain_first) - 1)
        for s in range(0, len(shuffled), batch):
            picked = shuffled[s : s + batch]
            at = np.concatenate([np.arange(chain_first[c], chain_first[c + 1]) for c in picked])
            types, own = np.unique(place[at], return_inverse=True)
            n = begin[types + 1] - begin[types]
            mine = np.repeat(np.arange(len(types)), n)
            f = feature[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin[types], n)]
            score = np.stack([np.bincount(mine, model.weights[f, j], len(types)) for j in range(k)], 1)
            lex = in_lexicon[types]
            score[lex >= 0] += model.lexicon_weights[lex[lex >= 0]]
            gamma, xi = forward_backward(score[own], words.chain[at], model.transitions, pairs=True)
            y = labels[at]
            up = -gamma
            up[np.arange(len(at)), y] += 1
            same = words.chain[at[1:]] == words.chain[at[:-1]]
            seen = np.bincount(y[:-1][same] * k + y[1:][same], minlength=k * k).reshape(k, k)
            by_type = np.stack([np.bincount(own, up[:, j], len(types)) for j in range(k)], 1)
            touched, spot = np.unique(f, return_inverse=True)
            steps = (
                (model.weights, squares[0], touched, np.stack([np.bincount(spot, by_type[mine, j], len(touched)) for j in range(k)], 1)),
                (model.lexicon_weights, squares[1], slice(None), np.stack([np.bincount(lex[lex >= 0], by_type[lex >= 0, j], k) for j in range(k)], 1)),
                (model.transitions, squares[2], slice(None), seen - xi),
            )
            for value, square, where, gradient in steps:
                gradient = gradient / len(picked) - 1e-5 * value[where]
                square[where] += gradient**2
                value[where] += rate * gradient / np.sqrt(square[where])
    return model


def training_lines(
    docs: DataFrame, max_docs: int, text: str = "text", lang: str = "lang", least: int = LEAST_DOCS
) -> DataFrame:
    """``line, lang``: a span of one line, by hash, of each of at most about ``max_docs`` documents that
    have a language and a text; of a language that has few of them, about ``least`` documents or all."""
    rows = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull())
    # the model has a column for each language, so their counts fit the driver
    counts = {r[0]: r[1] for r in rows.groupBy(lang).count().collect()}
    n = sum(counts.values())
    if not n:
        return rows.select(F.col(text).alias("line"), F.col(lang).alias("lang"))
    shares = [(language, min(1.0, max(max_docs / n, least / c))) for language, c in counts.items()]
    known = rows.sparkSession.createDataFrame(shares, "_lang string, _share double")
    rows = rows.join(F.broadcast(known), F.col(lang) == F.col("_lang"))
    fine = F.lit(1 << 52)  # a share of a large language may be below one in a million
    rows = rows.filter(F.pmod(F.xxhash64("doc_id", F.lit(23)), fine) < F.col("_share") * fine)
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"\p{L}"))
    by_hash = lambda salt, n: F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.greatest(n, F.lit(1))).cast("int")
    one = rows.select("doc_id", F.col(lang).alias("lang"), F.get(lines, by_hash(29, F.size(lines))).alias("_line"))
    one = one.filter("_line IS NOT NULL").withColumn("_words", words_of(F.col("_line")))
    begin = by_hash(31, F.size("_words") - SPAN_WORDS + 1)
    span = one.withColumn("_span", F.array_join(F.slice("_words", begin + 1, SPAN_WORDS), " "))
    at = by_hash(37, F.length("_span") - SPAN_CHARS + 1)
    return span.select(F.substring("_span", at + 1, F.lit(SPAN_CHARS)).alias("line"), "lang")


def word_marginals(model: Model, words: Words) -> np.ndarray:
    return forward_backward(_emissions(model, words), words.chain, model.transitions)[0]


class Labels(NamedTuple):
    """Languages of some texts and of their words with a letter."""

    names: list[str]  # of each text
    scores: list[float]
    doc: np.ndarray  # of each labelled word
    start: np.ndarray  # in code points of its text
    end: np.ndarray
    language: np.ndarray  # number of the most probable language
    marginal: np.ndarray


def _places(texts: list[str | None], words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Where the words lie in their texts as given: lower case may change lengths, never the blanks."""
    given = read_words(texts, lower=False)
    first = np.concatenate([[0], np.cumsum([len(t or "") for t in texts])]).astype(np.int64)[given.doc]
    assert len(given.start) == len(words.start)
    return given.start - first, given.end - first


def _label(model: Model, texts: list[str | None], places: bool) -> Labels:
    words = read_words(texts)
    k = len(model.languages)
    on = words.letters > 0
    if k == 0:
        none = np.zeros(0, np.int64)
        return Labels([UNDETERMINED] * len(texts), [0.0] * len(texts), none, none, none, none, np.zeros(0))
    gamma = word_marginals(model, words)[on]
    sums = np.stack([np.bincount(words.doc[on], gamma[:, j], len(texts)) for j in range(k)], 1)
    total = sums.sum(1)
    best = sums.argmax(1)
    share = sums[np.arange(len(texts)), best] / np.maximum(total, 1e-12)
    names = [model.languages[b] if t > 0 else UNDETERMINED for b, t in zip(best, total)]
    scores = [float(min(1.0, s)) if t > 0 else 0.0 for s, t in zip(share, total)]
    start, end = (x[on] for x in _places(texts, words)) if places else (words.start[on], words.end[on])
    return Labels(names, scores, words.doc[on], start, end, gamma.argmax(1), gamma.max(1, initial=0))


_SPANS = "array<struct<start:int,end:int,language:string,marginal:double>>"


def _spans(found: Labels, model: Model, n: int) -> pa.Array:
    language = pa.array(model.languages, pa.string()).take(pa.array(found.language))
    columns = [pa.array(found.start, pa.int32()), pa.array(found.end, pa.int32()), language, pa.array(found.marginal)]
    values = pa.StructArray.from_arrays(columns, names=["start", "end", "language", "marginal"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(found.doc, np.arange(n + 1)), pa.int32()), values)


def label_words(
    docs: DataFrame, model: Model, text: str = "text", carry: tuple[str, ...] = ("doc_id",), spans: bool = True
) -> DataFrame:
    """``carry`` columns + ``lang_pred, score`` and, with ``spans``, ``words``: of each word with a letter its
    place in the text (characters from ``start``, counted from 0, up to ``end``), its most probable
    language and the marginal of that language."""
    rows = docs.select(*carry, F.col(text).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("_text").to_pylist()
            at = 0
            while at < len(texts):  # some text at a time, in whole texts
                end, chars = at, 0
                while end < len(texts) and (end == at or chars + len(texts[end] or "") <= _BATCH_CHARS):
                    chars += len(texts[end] or "")
                    end += 1
                found = _label(model, texts[at:end], spans)
                part = batch.slice(at, end - at)
                columns = [*(part.column(c) for c in carry), pa.array(found.names, pa.string()), pa.array(found.scores, pa.float64())]
                names = [*carry, "lang_pred", "score"]
                if spans:
                    columns, names = [*columns, _spans(found, model, end - at)], [*names, "words"]
                yield pa.RecordBatch.from_arrays(columns, names=names)
                at = end

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "_text"]
    made = ["lang_pred string", "score double", *([f"words {_SPANS}"] if spans else [])]
    return rows.mapInArrow(run, ", ".join([*fields, *made]))


def predict(docs: DataFrame, model: Model, text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``carry`` columns + ``lang_pred, score``: ``label_words`` without the words."""
    return label_words(docs, model, text, carry, spans=False)


def remainder(doc_id: Column, n: int) -> Column:
    return F.crc32(doc_id.cast("string")) % n
