"""Spelling variants, lattice scores and source divergence against plain versions."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import pyarrow as pa
import pytest

from seekledger.llm import lm_scoring, source_divergence, spelling_variants
from seekledger.llm import queries as q
from seekledger.llm.sentencepiece_codec import BYTE, CONTROL, MARK, NORMAL, Model

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def one_edit(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(words: dict[str, int], times: int = 5) -> set[tuple]:
    near = {w: [x for x in words if one_edit(w, x)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= times * words[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {(w, form[w], root(w), n, len(near[w]), words.get(form[w])) for w, n in words.items()}


def plain_words(documents, least_length=6, least=5) -> dict[str, int]:
    count = Counter()
    for d, t, *_ in documents:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(FOLD)
            h = zlib.crc32(f"{d}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= least_length:
                count[run] += 1
    return {w: n for w, n in count.items() if n >= least}


def variant_rows(df) -> set[tuple]:
    rows = df.select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert len({r.word for r in rows}) == len(rows)
    return set(map(tuple, rows))


def test_variants_of_documents(spark, tmp_path):
    r = random.Random(3)
    base = ["".join(r.choices(["éa", "ti", "on", "ÿs", "re", "um", "a"], k=r.randrange(3, 7))) for _ in range(40)]
    rows = []
    for k in range(4000):
        some = r.sample(base, 3) * 6
        rows.append((k, "-".join(w.upper() if r.random() < 0.2 and w.isascii() else w for w in some)))
    rows += [(None, "Nationwide " * 7), (401, None), (402, ""), (403, "é" * 3000 + " 1 " + "nationwide " * 7), (403, "é" * 3000 + " x"), (404, ("é" * 2999 + " ") * 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS word", "1 AS n").repartition(3)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    words = plain_words([(d if d is not None else "", t) for d, t in rows])
    want = plain_variants(words)
    assert len(want) > 50 and sum(w[1] is not None for w in want) > 10
    assert variant_rows(q.op11_spelling_variants(spark, str(tmp_path))) == want


def test_variants_over_a_small_alphabet(spark):
    """Few letters: many near words, ties of grams and of counts, chains of forms."""
    r = random.Random(8)
    words = {"".join(r.choices("ab", k=r.randrange(4, 9))): r.choice([1, 5, 5, 25, 130, 700]) for _ in range(260)}
    words |= {"aaaa": 5, "aaaaa": 25, "aaaaaa": 125, "aaaaaaa": 625, "aaaaaaaa": 3125}
    df = spark.createDataFrame([(w, n, 1) for w, n in words.items()], "word string, n long, part int")
    want = plain_variants(words)
    assert any(w[1] != w[2] and w[1] for w in want)
    assert variant_rows(spelling_variants.group_variants(df)) == want


def test_pivots_are_the_cheapest_disjoint_grams():
    r = random.Random(2)
    for _ in range(500):
        grams = [spelling_variants.Gram(k, r.randrange(1, 9), r.choice("abcd")) for k in range(r.randrange(3, 12))]
        prefix = spelling_variants.gram_prefix(grams)
        chosen = spelling_variants.pivotal(prefix)
        pairs = [(x, y) for x in prefix for y in prefix if y.place >= x.place + 2]
        assert len(chosen) == 2 and tuple(chosen) in pairs
        assert sum(g.words for g in chosen) == min(x.words + y.words for x, y in pairs)


def small_model() -> Model:
    pieces = ["</s>", MARK, MARK + "a", "a", "b", "ab", "ba", "aba", MARK + "ab"] + [f"<0x{b:02X}>" for b in range(256)]
    kinds = [CONTROL] + [NORMAL] * 8 + [BYTE] * 256
    return Model(tuple(pieces), tuple([0.0] + [-1.0 - k / 3 for k in range(8)] + [0.0] * 256), tuple(kinds))


def all_segmentations(text: str, weight: dict[str, float], byte: float) -> float:
    """Sum over every way to cut the text, by trying them all."""
    if not text:
        return 1.0
    total = 0.0
    for n in range(1, len(text) + 1):
        if text[:n] in weight:
            total += weight[text[:n]] * all_segmentations(text[n:], weight, byte)
    if text[0] not in weight:
        total += byte ** len(text[0].encode()) * all_segmentations(text[1:], weight, byte)
    return total


def test_lattice_sums_all_segmentations():
    model = small_model()
    lattice = lm_scoring.Lattice(model)
    scores = {p: math.exp(s) for p, s, k in zip(model.pieces, model.scores, model.kinds) if k == NORMAL}
    least = min(scores.values())
    total = sum(scores.values()) + 256 * least
    weight = {p: s / total for p, s in scores.items()}
    for word in ("", "a", "ab", "abab", "ababa", "aé", "babaab", "ab" * 7, "中a", "ab▁a"):
        want = math.log10(all_segmentations(MARK + word, weight, least / total))
        assert lattice.word(word) == pytest.approx(want, rel=1e-12)
    assert lattice.word("ab" * 50_000) < -10_000  # no underflow, no recursion


def plain_scores(rows, model):
    lattice = lm_scoring.Lattice(model)
    tokens = [[w.translate(FOLD) for w in WORD.findall(t or "")] + [None] for _, t in rows]
    held = [d is not None and zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in rows]
    count = Counter(w for ws, out in zip(tokens, held) if not out for w in ws)
    n, v = sum(count.values()), len(count)
    end = (count[None] + 1) / (n + 2)
    out = []
    for (d, _), ws, h in zip(rows, tokens, held):
        base = sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws)
        score = sum(lattice.word(w) + math.log10(1 - end) for w in ws[:-1]) + math.log10(end)
        out.append((str(d), h, len(ws), sum(count[w] > 0 for w in ws), n, base, score))
    return sorted(out)


def check_scores(got, rows, model):
    got = sorted((str(r[0]), *r[1:]) for r in got)
    want = plain_scores(rows, model)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-9)


def test_lm_scores_of_documents(spark, sf_dir, documents):
    got = q.op12_lm_scoring(spark, sf_dir)
    assert got.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    check_scores(map(tuple, got.collect()), [(d, t) for d, t, *_ in documents], Model.load(q.PIECES))


@pytest.mark.parametrize("chunk", [1, 300, 1 << 24])
def test_lm_scores_over_many_chunks(spark, monkeypatch, chunk):
    """Also nulls, repeated rows, a long word, words of one chunk that others hold."""
    r = random.Random(4)
    rows = [(k, " ".join(r.choices(["a", "ab", "Ba", "x", "é", "abab"], k=r.randrange(0, 30)))) for k in range(60)]
    rows += [(None, "ab ab"), (7, None), (2**40, "\t\n"), rows[3], (99, "ab" * 40_000)]
    monkeypatch.setattr(lm_scoring, "CHUNK_BYTES", chunk)
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS word", "0 AS chunk").repartition(3)
    check_scores(map(tuple, lm_scoring.score_texts(docs, small_model()).collect()), rows, small_model())


def test_lm_scores_without_training_texts(spark):
    only = [k for k in range(200) if zlib.crc32(str(k).encode()) % 7 == 2][:3]
    rows = [(k, "ab x") for k in only]
    check_scores(map(tuple, lm_scoring.score_texts(spark.createDataFrame(rows, "doc_id long, text string"), small_model()).collect()), rows, small_model())


def test_expected_pieces_are_those_of_all_segmentations():
    lattice = lm_scoring.Lattice(small_model())
    for word in ("", "a", "abab", "aé", "babaab"):
        found = lattice.expected(word)
        characters = sum(n * len(p) for p, n in found.items() if p) + sum(not (c in lattice.known) for c in MARK + word)
        assert characters == pytest.approx(len(MARK + word))
        # the slope of the logarithm of the sum, along the logarithm of a piece's probability
        for piece in [p for p in found if p]:
            less = lm_scoring.Lattice(small_model())
            node = less.back
            for c in reversed(piece):
                node = node[c]
            node[""] += 1e-6
            assert found[piece] == pytest.approx((less.log_probability(MARK + word) - lattice.log_probability(MARK + word)) / 1e-6, rel=1e-4)


@pytest.mark.parametrize("chunk", [300, 1 << 24])
def test_lm_scores_learned(spark, monkeypatch, chunk):
    r = random.Random(5)
    rows = [(k, " ".join(r.choices(["a", "ab", "Ba", "x", "abab"], k=r.randrange(0, 30)))) for k in range(60)]
    rows += [(8, "bbb " + "ab" * 2_000), (7, None)]
    held = [zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in rows]
    words = [[w.translate(FOLD) for w in WORD.findall(t or "")] for _, t in rows]
    count = Counter(w for ws, out in zip(words, held) if not out for w in ws)
    n, v = sum(count.values()), len(count)
    fitted = None
    for _ in range(lm_scoring.ROUNDS):
        lattice, sums = lm_scoring.Lattice(small_model(), fitted), Counter()
        for w in count:
            for piece, times in lattice.expected(w).items():
                sums[piece] += round(times * lm_scoring.UNIT)
        fitted = {p: x for p, x in sums.items() if x}
    lattice = lm_scoring.Lattice(small_model(), fitted)
    ends = held.count(False)
    end = (ends + 1) / (n + ends + 2)

    def one(w):
        z = lattice.word(w)
        return math.log10(v) + z if not count[w] else math.log10(count[w] + v * 10.0**z)

    want = {d: sum(one(w) - math.log10(n + v) + math.log10(1 - end) for w in ws) + math.log10(end) for (d, _), ws in zip(rows[:60], words)}
    monkeypatch.setattr(lm_scoring, "CHUNK_BYTES", chunk)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = lm_scoring.score_texts(docs, small_model(), learn=True).collect()
    assert len(got) == len(rows) and all(math.isfinite(x.score) for x in got)
    for d in want.keys() - {7, 8}:
        assert [x.score for x in got if x.doc_id == d] == pytest.approx([want[d]], rel=1e-9)


def test_pieces_are_fitted_to_all_words(spark, monkeypatch):
    """Also where there are far more different words than a sample would hold."""
    monkeypatch.setattr(lm_scoring, "FIT_WORDS", 5, raising=False)
    monkeypatch.setattr(lm_scoring, "ROUNDS", 1)
    r = random.Random(6)
    words = sorted({"".join(r.choices("abé", k=r.randrange(1, 9))) for _ in range(300)})
    docs = spark.createDataFrame([(k, w) for k, w in enumerate(words) if zlib.crc32(str(k).encode()) % 7 != 2], "doc_id long, text string")
    fitted = []
    monkeypatch.setattr(lm_scoring, "fit_pieces", lambda *a, f=lm_scoring.fit_pieces: fitted.append(f(*a)) or fitted[-1])
    assert all(math.isfinite(x.score) for x in lm_scoring.score_texts(docs, small_model(), learn=True).collect())
    lattice, want = lm_scoring.Lattice(small_model()), Counter()
    for (word,) in docs.select("text").collect():
        want.update(lattice.expected(word))
    assert {p: fitted[0].get(p, 0) / lm_scoring.UNIT for p in want} == pytest.approx(want, rel=1e-3, abs=1e-3)


def test_sums_of_many_words_are_those_of_one(monkeypatch):
    """With slices of any size, characters of all widths, long words, repeats, none."""
    r = random.Random(7)
    words = ["".join(r.choices("abxé中🙂▁", [6, 6, 1, 1, 1, 1, 1], k=r.randrange(0, 40))) for _ in range(500)]
    words += ["", "ab" * 100, "ab" * 400, "é" * 300, words[3]]
    for model in (small_model(), Model.load(q.PIECES)):
        lattice = lm_scoring.Lattice(model)
        want = Counter()
        for w in words:
            want.update(lattice.expected(w))
        found = []
        for cells, order in ((1, words), (300, words[::-1]), (1 << 19, words)):
            monkeypatch.setattr(lm_scoring, "CELLS", cells)
            assert lattice.log_probabilities(pa.array(order)).tolist() == pytest.approx([lattice.word(w) for w in order], rel=1e-12)
            found.append(lattice.expected_counts(pa.array(order)).tolist())
        assert found[0] == found[1] == found[2]
        names = [*lattice.pieces, ""]
        assert [n / lm_scoring.UNIT for n in found[0]] == pytest.approx([want[p] for p in names], rel=1e-6, abs=1e-6)
    assert lattice.log_probabilities(pa.array([], pa.string())).tolist() == [] and not lattice.expected_counts(pa.array([], pa.string())).any()


def test_lm_scores_learned_from_nothing(spark):
    only = [k for k in range(200) if zlib.crc32(str(k).encode()) % 7 == 2][:3]
    docs = spark.createDataFrame([(k, "ab x") for k in only], "doc_id long, text string")
    assert all(math.isfinite(x.score) and x.score < 0 for x in lm_scoring.score_texts(docs, small_model(), learn=True).collect())


def test_held_out_texts_score_near_the_base(spark, sf_dir):
    """The base gives any unknown word one count, whatever its letters, so only mostly known texts compare."""
    got = q.op12_lm_scoring(spark, sf_dir).filter("held_out").collect()
    assert got and all(math.isfinite(x.score) for x in got)
    known = [x for x in got if x.n_known >= 0.95 * x.n_tokens]
    assert known and sum(x.score for x in known) > 1.3 * sum(x.base_score for x in known)


TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain_audit(rows, least=10, best=10):
    """rows (text, lang, source) -> the audit, in whole numbers of any size."""
    held, count, groups = Counter(), Counter(), set()
    for t, g, s in ((t or "", g or "", s or "") for t, g, s in rows):
        terms = [x.translate(FOLD) for x in TERM.findall(t)]
        groups.add((g, s))
        held.update((g, x) for x in set(terms))
        count.update((g, s, x) for x in terms)
    out = set()
    for lang in {g for g, _ in groups}:
        kept = [x for (g, x), n in held.items() if g == lang and n >= least]
        sources = sorted(s for g, s in groups if g == lang)

        def share(counts):
            total = sum(counts.values()) + 2 * len(kept)
            return {x: 1 + 1_000_000_000 * (counts[x] + 2) // total for x in kept}

        per = {s: {x: count[lang, s, x] for x in kept} for s in sources}
        own = share({x: sum(per[s][x] for s in sources) for x in kept})
        p = {s: share(per[s]) for s in sources}
        f = lambda a, b: (a - b) * (a - b) // (a + b)
        for s in sources:
            pairs = sorted((-sum(f(p[s][x], p[o][x]) for x in kept), o.encode()) for o in sources if o != s)
            terms = sorted((-f(p[s][x], own[x]), x.encode()) for x in kept if per[s][x] and p[s][x] > own[x])[:best]
            for part, found in (("pair", pairs), ("term", terms)):
                out |= {(lang, s, part, item.decode(), -v, k + 1) for k, (v, item) in enumerate(found)}
    return out


def audit_rows(df) -> set[tuple]:
    rows = df.select("lang", "source", "part", "item", "value", "rank").collect()
    assert len(set(rows)) == len(rows)
    return set(map(tuple, rows))


def test_divergence_of_documents(spark, sf_dir, documents):
    want = plain_audit([(t, g, s) for _, t, g, s, _ in documents])
    assert {w[2] for w in want} == {"pair", "term"}
    assert audit_rows(q.op13_source_divergence(spark, sf_dir)) == want


@pytest.mark.parametrize("small", [False, True])
def test_divergence_of_odd_texts(spark, monkeypatch, small):
    r = random.Random(6)
    rows = [(" ".join(r.choices(["The", "the", "é", "naïve", "x1y", "中文", "zz"], k=40)), r.choice(["en", None, "fr"]), r.choice(["a", "b", None, "ä"])) for _ in range(150)]
    rows += [(None, "en", "none"), ("", "xx", "a"), ("only once", "xx", "b"), ("word " * 90_000, "en", "a"), ("the é", "yy", "single")] + [("the é", "yy", "single")] * 12
    if small:
        for name, value in (("SHARD_TERMS", 2), ("CELLS", 3), ("SLICE_BYTES", 50), ("HELD_ROWS", 5)):
            monkeypatch.setattr(source_divergence, name, value)
    docs = spark.createDataFrame(rows, "text string, lang string, source string").selectExpr("*", "1 AS term", "2 AS n", "'q' AS shard").repartition(3)
    assert audit_rows(source_divergence.audit(docs)) == plain_audit(rows)


def test_shares_do_not_overflow():
    import numpy as np

    count = np.array([1, 2, 10**12, 3 * 10**15, 9 * 10**15], np.int64)
    total = 9 * 10**15
    assert source_divergence.shares(count, np.int64(total)).tolist() == [1 + 10**9 * int(c) // total for c in count]


@pytest.mark.parametrize("limit", [3, 40, 5000])
def test_mixing_draws_in_the_order_of_the_keys(spark, limit):
    """Against a plain sort: weights near one and of 0.05, a hot source, repeated and null ids, ties."""
    from pyspark.sql import functions as F

    from seekledger.llm import mixing

    r = random.Random(5)
    rows = [(k, r.choices(["hot", "b", "c", None], [60, 20, 15, 5])[0], r.randrange(0, 50), r.choice([0.05, 1.0, 0.05, 7.0])) for k in range(3000)]
    rows += [rows[7], rows[7], (None, "b", 9, 1.0), (None, "c", 3, 1.0)] + [(9999, "hot", 2, 0.05)] * 60
    docs = spark.createDataFrame(rows, "doc_id long, source string, size long, quality double").repartition(4)
    keys = {(x.doc_id, x.quality): x.k for x in docs.select("doc_id", "quality", mixing.exponential_key(F.col("doc_id"), F.col("quality")).alias("k")).collect()}
    got = mixing.mix(docs, rows_per_cut=limit).collect()
    assert len(got) == len(rows)
    for source in ("hot", "b", "c", None):
        mine = [x for x in got if x.source == source]
        total = sum(x.size for x in mine)
        rest = mine[0].target - math.floor(mine[0].target / total) * total
        epochs = math.floor(mine[0].target / total)
        # documents in the order of their keys, rows that repeat one together
        groups = {}
        for x in mine:
            if x.size:
                groups.setdefault((keys[x.doc_id, x.quality], x.doc_id if x.doc_id is not None else -1), []).append(x)
        order, sums = sorted(groups), [0]
        for k in order:
            sums.append(sums[-1] + sum(x.size for x in groups[k]))
        best = min(range(len(sums)), key=lambda i: (abs(sums[i] - rest), i))
        drawn = set(order[:best])
        for k in order:
            assert {x.times for x in groups[k]} == {epochs + (k in drawn)}, (source, k)
        assert all(x.taken == x.times * x.size for x in mine)


def test_samples_of_any_number_of_rows(spark):
    from seekledger.llm.quality_rules import bounded_sample, sample_limit

    for n in (12_001, 25 * 10**9, 10**14):
        assert sample_limit(12_000, n) >= 1
    assert sample_limit(12_000, 25 * 10**9) > 10**9
    rows = spark.range(50_000).withColumnRenamed("id", "doc_id")
    assert 800 <= bounded_sample(rows, 1000).count() <= 1200 and bounded_sample(rows.limit(900), 1000).count() == 900
