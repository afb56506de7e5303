"""Parts of the operators against plain versions."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from seekledger.llm import arrays, blocks, line_dedup, language_id, ngram_join, quality_rules, queries, sentencepiece_codec, substring_dedup, warc
from seekledger.llm.components import components
from seekledger.llm.queries import PIECES
from text_samples import sentence

# --- arrays and blocks


def test_words_and_windows():
    texts = ["a bb\tccc", None, "", " x\x0by ", "é é", "a bb ccc a bb"]
    w = arrays.words(pa.array([t and t.encode() for t in texts], pa.binary()))
    assert np.diff(w.first).tolist() == [3, 0, 0, 2, 2, 5]
    assert w.hash[0] == w.hash[7] and w.hash[5] == w.hash[6]
    starts, h = arrays.windows(w, 2)
    same = {(int(a), int(b)) for a, x in zip(starts, h) for b, y in zip(starts, h) if x == y and a < b}
    assert same == {(0, 7), (0, 10), (7, 10), (1, 8)}


def test_blocks_keep_rows(spark, monkeypatch):
    rows = [(k, "w" * (k % 50)) for k in range(500)] + [(None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit(7)).repartition(3)
    table = blocks.pack(docs, carry=True)
    out = blocks.unpacked(table.select(F.explode(F.arrays_zip("rests", "texts")).alias("x")).select(
        F.col("x.rests").alias("rest"), F.col("x.texts").cast("string").alias("text")), docs)
    key = lambda r: (r[0] is None, r)
    assert sorted(map(tuple, out.collect()), key=key) == sorted(((a, b, 7) for a, b in rows), key=key)


def test_packed_keys_come_back():
    random_ = np.random.default_rng(1)
    key = random_.integers(0, 1 << 44, 1000, dtype=np.uint64)
    keys, place = blocks.distinct(np.concatenate([key, key[:10]]), anchor=np.arange(1010) % 2 == 0)
    assert (keys.key[place[:1000]] == key).all() and keys.many.sum() == 10
    sent = blocks._send(5, keys, blocks._bucket_edges(7, 44)).to_pylist()
    back = [blocks._received(r) for r in sorted(sent, key=lambda r: r["bucket"])]
    assert (np.concatenate([b[0] for b in back]) == keys.key).all()
    assert (np.concatenate([b[3] for b in back]) == keys.anchor).all()


def test_components(spark):
    links = [(1, 2), (2, 3), (9, 8), (8, 7), (5, 5), (3, 10), (10, 11), (11, 12), (12, 13)]
    found = dict(components(spark.createDataFrame(links, "a long, b long")).collect())
    assert found == {1: 1, 2: 1, 3: 1, 10: 1, 11: 1, 12: 1, 13: 1, 7: 7, 8: 7, 9: 7}


# --- quality rules


def test_rules_are_learned_and_ordered(spark):
    r = random.Random(3)
    rows = []
    for k in range(600):
        a, b = r.random(), r.random()
        rows.append((k, a, b, 0 if a > 0.8 or (a < 0.2 and b > 0.5) else 1))
    df = spark.createDataFrame(rows, "doc_id long, a double, b double, quality int")
    rules = quality_rules.learn(df, names=("a", "b"))
    wrong = df.filter(rules.keep() != (F.col("quality") == 1)).count()
    assert 2 <= len(rules.rules) <= 8 and wrong <= 24
    assert str(quality_rules.learn(df.filter("quality = 1"), names=("a", "b"))) == "keep all"
    assert str(quality_rules.learn(df.limit(0), names=("a", "b"))) == "keep all"


def test_repeated_words_under_hash_collisions(spark, monkeypatch):
    r = random.Random(4)
    texts = [" ".join(r.choice("abc") for _ in range(n)) for n in (0, 2, 3, 4, 9, 30)] + ["a b c x y z a b c", None]
    # all windows share their hash, so that different ones lie between equal ones
    monkeypatch.setattr(quality_rules.F, "xxhash64", lambda *c: F.lit(5).cast("long"))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x.n_repeat_words for x in quality_rules.text_statistics(docs).collect()}
    for k, text in enumerate(texts):
        w = (text or "").split()
        runs = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        assert got[k] == len({i + j for i, x in enumerate(runs) if runs.count(x) > 1 for j in range(3)})


# --- WARC


def test_segments_and_framing(spark, tmp_path):
    body = bytes(range(256)) * 40
    rows = [(1, "u", body), (2, None, b""), (3, "u", body), (4, "u", b"\r\n\r\nWARC/1.1\r\n" * 9)]
    marked = warc.mark_revisits(spark.createDataFrame(rows, "id long, url string, payload binary"))
    warc.write_archives(marked, str(tmp_path / "a"), segment_bytes=700, chunk_bytes=100)
    records = warc.read_archives(spark, str(tmp_path / "a"))
    assert records.filter("record_type = 'continuation'").count() > 10
    got = {r.record_id: r for r in warc.decode(warc.reassemble(records)).collect()}
    assert all(r.complete and r.framed for r in got.values())
    assert bytes(got["<urn:page:3>"].payload) == body and got["<urn:page:1>"].refers_to == "<urn:page:3>"
    assert bytes(got["<urn:page:4>"].payload) == rows[3][2] and bytes(got["<urn:page:2>"].payload) == b""


def test_lost_segments_are_seen(spark, tmp_path):
    rows = [(1, "u", b"x" * 5000), (2, "u", b"y" * 5000)]
    marked = warc.mark_revisits(spark.createDataFrame(rows, "id long, url string, payload binary"))
    warc.write_archives(marked, str(tmp_path / "a"), segment_bytes=700)
    records = warc.read_archives(spark, str(tmp_path / "a"))
    lost = warc.reassemble(records.filter("NOT (origin_id = '<urn:page:1>' AND segment = 3)  OR origin_id IS NULL"))
    assert {r.record_id: r.complete for r in lost.collect()} == {"<urn:page:1>": False, "<urn:page:2>": True}
    assert warc._decode(b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n5\r\nabc") == (b"abc", False)
    assert warc._decode(b"HTTP/1.1 200 OK\r\n\r\nabc") == (b"abc", True)


def test_pages_that_share_an_id_or_have_none(spark, tmp_path):
    large, other = b"x" * 90_000, b"y" * 80_000
    rows = [(1, "u", large), (1, "v", large), (0, "u", large), (2, "u", other), (2, "u", b"z" * 70_000), (2, "u", other), (-3, "u", other)]
    rows += [(None, "u", b"n" * 40_000), (None, None, b"n" * 40_000), (None, "u", large), (None, "u", None), (5, "u", b"s"), (5, "u", b"s")]
    marked = warc.mark_revisits(spark.createDataFrame(rows, "id long, url string, payload binary").repartition(3))
    warc.write_archives(marked, str(tmp_path / "a"))
    records = warc.read_archives(spark, str(tmp_path / "a"))
    whole = warc.reassemble(records).collect()
    assert len({r.record_id for r in whole}) == len(rows) and all(r.complete for r in whole)
    resolved = warc.resolve(warc.decode(warc.reassemble(records)))
    key = lambda r: tuple((x is None, x) for x in r)
    got = [(r.page_id and int(r.page_id), r.payload_bytes, r.digest, r.refers_page) for r in resolved.collect()]
    refers = {(0, large): "1", (-3, other): "2"}
    want = [(k, len(p or b""), hashlib.sha1(p or b"").hexdigest(), refers.get((k, p))) for k, _, p in rows]
    assert sorted(got, key=key) == sorted(want, key=key)
    # the same archives read twice: no revisit is doubled beyond its own copies
    twice = warc.decode(warc.reassemble(records)).unionByName(warc.decode(warc.reassemble(records)))
    assert warc.resolve(twice).count() == 2 * len(rows)


def test_archives_are_parsed_once(spark, sf_dir, tmp_path):
    rows = [(1, "u", b"x" * 5000), (2, "u", bytes(range(256)) * 30), (3, "u", b""), (4, None, b"x" * 5000), (None, "u", b"s")]
    marked = warc.mark_revisits(spark.createDataFrame(rows, "id long, url string, payload binary").repartition(2))
    path = str(tmp_path / "a")
    warc.write_archives(marked, path, segment_bytes=700, chunk_bytes=100)
    whole = warc.resolve(warc.decode(warc.reassemble(warc.read_archives(spark, path))))
    measured = warc.resolve(warc.read_measured(spark, path)).select(whole.columns)
    assert sorted(map(repr, measured.collect())) == sorted(map(repr, whole.collect()))
    assert measured.count() == len(rows) and measured.filter("complete AND framed").count() == len(rows)
    # what the query returns is made of the tables written, not of the archives again
    assert not [f for f in queries.op2_warc(spark, sf_dir).inputFiles() if ".txt" in f]


# --- repeats and joins


def test_repeats_overlap_and_spans(spark):
    loop = " ".join(["a b c"] * 20)
    rows = [(1, loop), (2, "x " + " ".join(map(str, range(40)))), (3, " ".join(map(str, range(40))) + " y"), (4, None)]
    got = {r.doc_id: r for r in substring_dedup.repeats(spark.createDataFrame(rows, "doc_id long, text string"), 7).collect()}
    assert got[1].n_removed == 60 and got[2].n_removed == 40 and got[2].spans == [1, 41] and got[3].spans == [0, 40]
    assert bytes(got[2].kept_text) == b"x" and got[4].n_words == 0


@pytest.mark.parametrize("percent", [60, 80])
def test_join_of_large_near_groups(spark, percent, monkeypatch):
    r = random.Random(percent)
    base = [f"w{k}" for k in range(80)]
    rows = []
    for k in range(150):  # a chain of drifting copies and unrelated texts
        if k % 5 == 0:
            base = base[:]
            base[r.randrange(80)] = f"c{k}"
        words = base[:]
        for _ in range(r.randrange(0, 3)):
            words[r.randrange(80)] = f"d{r.randrange(1000)}"
        rows.append((k, " ".join(words)))
    rows += [(200 + k, " ".join(f"u{r.randrange(30)}" for _ in range(25))) for k in range(60)]
    sets = {d: {tuple(w[i : i + 2]) for i in range(len(w) - 1)} for d, t in rows for w in [t.split()]}
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                lo, hi = sorted((root(a), root(b)))
                parent[hi] = lo
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    monkeypatch.setattr(ngram_join, "TILE_ROWS", 20)
    got = {r.doc_id: r.component_id for r in ngram_join.similar_documents(docs, 2, percent).collect()}
    assert got == {d: root(d) for d in sets}
    kept = {r.doc_id for r in ngram_join.one_of_each(docs, 2, percent).collect()}
    assert kept == {root(d) for d in sets}


def _distance(a, b):
    before = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(before[j] + 1, now[-1] + 1, before[j - 1] + (x != y)))
        before = now
    return before[-1]


def _edited(r, text, n):
    s = list(text)
    for _ in range(n):
        k = r.randrange(len(s))
        s[k : k + r.randrange(2)] = r.choice([[], ["a"], ["é"]])
    return "".join(s)


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_banded_edit_distance(edits):
    r = random.Random(edits)
    pairs = []
    while len(pairs) < 300:
        a = "".join(r.choice("aéb") for _ in range(r.randrange(5, 60)))
        b = _edited(r, a, r.randrange(0, 2 * edits + 2))
        if abs(len(a) - len(b)) <= edits and b:
            pairs.append((a, b))
    arrays_ = [tuple(np.array([ord(c) for c in x], np.uint32) for x in p) for p in pairs]
    assert line_dedup.within_edits(arrays_, edits).tolist() == [_distance(a, b) <= edits for a, b in pairs]


def test_near_lines(spark):
    r = random.Random(4)
    base = ["".join(r.choice("abcdefgh ") for _ in range(r.randrange(28, 50))) for _ in range(40)]
    rows = [(d, "\n".join(_edited(r, r.choice(base), r.choice([0, 0, 1, 2])) for _ in range(r.randrange(0, 6)))) for d in range(60)]
    rows.append((99, None))
    first = {}
    for d, t in rows:
        for k, line in enumerate((t or "").split("\n")):
            line = line.strip(" \t\n\x0b\x0c\r")
            if line:
                first.setdefault(line, (d, k))
    parent = {x: x for x in first}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    long = [x for x in first if len(x) >= 30]
    for i, a in enumerate(long):
        for b in long[i + 1 :]:
            if abs(len(a) - len(b)) <= 2 and _distance(a, b) <= 2:
                parent[root(a)] = root(b)
    classes = {}
    for x, place in first.items():
        classes.setdefault(root(x), []).append(place)
    keep = {min(v) for v in classes.values()}
    assert len(keep) < len(first)
    for got in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect():
        text = dict(rows)[got.doc_id] or ""
        want = "\n".join(x for k, x in enumerate(text.split("\n")) if not x.strip() or (got.doc_id, k) in keep)
        assert bytes(got.kept_text).decode() == want


# --- models


def test_viterbi_is_best_and_streams():
    model = sentencepiece_codec.Model.load(PIECES)
    codec = sentencepiece_codec.Codec(model)
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    r = random.Random(6)
    texts = ["", " ", "a  b ", "Hello wörld\n\tthe é 中 😀", "a▁b", "antidisestablishment" * 5]
    texts += ["".join(r.choice("abcthe é\n 中😀") for _ in range(50)) for _ in range(60)]

    def best(t):
        z = codec.normalised(t)
        top = [0.0]
        for e in range(1, len(z) + 1):
            known = [top[s] + codec.vocabulary[z[s:e]][0] for s in range(max(0, e - codec.longest), e) if z[s:e] in codec.vocabulary]
            if z[e - 1] not in codec.vocabulary:
                known.append(top[e - 1] + codec.unknown)
            top.append(max(known))
        return top[-1]

    for t in texts:
        ids = codec.encode(t)
        z = codec.normalised(t)
        own = sum(model.scores[i] for i in ids if model.kinds[i] != sentencepiece_codec.BYTE)
        own += codec.unknown * sum(c not in codec.vocabulary for c in z)
        assert own == pytest.approx(best(t)) and library.decode(ids) == codec.decode(np.array(ids, int))
        assert codec.decode(np.array(ids, int)) == t.replace("▁", " ")
    long = codec.normalised("中文字符internationalization" * 50)
    search, out = sentencepiece_codec.StreamingViterbi(codec), []
    for k in range(0, len(long), 9):
        out += search.feed(long[k : k + 9])
    widest = search.widest
    assert out + search.finish() == codec.encode("中文字符internationalization" * 50) and widest <= 4 * codec.longest


def test_coding_carries_columns(spark):
    model = sentencepiece_codec.Model.load(PIECES)
    docs = spark.createDataFrame([(1, "a b", "x"), (2, None, "y"), (3, "", None)], "doc_id long, text string, ids string")
    coded = sentencepiece_codec.encode(docs, model)
    assert coded.columns == ["doc_id", "text", "ids"] and {r.doc_id: len(r.ids) for r in coded.collect()}[2] == 0
    back = {r.doc_id: r.text for r in sentencepiece_codec.decode(coded, model).collect()}
    assert back == {1: "a b", 2: "", 3: ""}


def test_forward_backward_against_all_paths():
    random_ = np.random.default_rng(2)
    emissions, transitions = random_.normal(size=(7, 3)), random_.normal(size=(3, 3))
    chain = np.array([0, 0, 0, 0, 1, 1, 2])
    gamma, xi = language_id.forward_backward(emissions, chain, transitions, pairs=True)
    total = np.zeros((3, 3))
    for c in range(3):
        at = np.flatnonzero(chain == c)
        paths = np.stack(np.meshgrid(*[range(3)] * len(at), indexing="ij"), -1).reshape(-1, len(at))
        weight = np.exp([sum(emissions[a, y] for a, y in zip(at, p)) + sum(transitions[x, y] for x, y in zip(p, p[1:])) for p in paths])
        weight /= weight.sum()
        for k, a in enumerate(at):
            assert np.allclose(gamma[a], [weight[paths[:, k] == y].sum() for y in range(3)])
        for k in range(len(at) - 1):
            for x in range(3):
                for y in range(3):
                    total[x, y] += weight[(paths[:, k] == x) & (paths[:, k + 1] == y)].sum()
    assert np.allclose(xi, total)


def test_code_switched_words():
    r = random.Random(8)
    lines = [(sentence(r, g, 12), g) for g in ("en", "fr", "de") for _ in range(80)]
    model = language_id.train(lines)
    text = sentence(r, "en", 10) + " " + sentence(r, "de", 10)
    marginals = language_id.word_marginals(model, language_id.read_words([text]))
    labels = [model.languages[k] for k in marginals.argmax(1)]
    assert labels[:9].count("en") >= 8 and labels[11:].count("de") >= 8


def test_training_spans_lie_anywhere_and_hold_every_language(spark):
    rows = [(k, " ".join(f"w{j}" for j in range(1000)), "en") for k in range(3000)]
    rows += [(9000 + k, f"mot{k} ici", "fr") for k in range(3)] + [(9100, "\u4e2d" * 9000, "zh"), (9200, None, "xx"), (9300, "none", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = [(r.line, r.lang) for r in language_id.training_lines(docs, 200).collect()]
    assert sum(g == "fr" for _, g in got) == 3 and [len(t) for t, g in got if g == "zh"] == [language_id.SPAN_CHARS]
    starts = [int(t.split()[0][1:]) for t, g in got if g == "en"]
    assert 120 <= len(starts) <= 300 and min(starts) < 300 and max(starts) > 600
    assert all(len(t.split()) == language_id.SPAN_WORDS for t, g in got if g == "en")
    assert len({language_id._span(rows[0][1] + f" x{k}")[0] for k in range(20)}) > 5


def test_words_of_a_text_are_labelled(spark):
    r = random.Random(8)
    model = language_id.train([(sentence(r, g, 12), g) for g in ("en", "fr", "de") for _ in range(80)])
    text = "\u0130 " + sentence(r, "en", 10) + " 12 \n" + sentence(r, "de", 10)
    docs = spark.createDataFrame([(1, text), (2, None), (3, "12 34"), (4, "")], "doc_id long, text string")
    got = {x.doc_id: x for x in language_id.label_words(docs, model).collect()}
    assert [text[w.start : w.end] for w in got[1].words] == [w for w in text.split() if w != "12"]
    labels = [w.language for w in got[1].words]
    assert labels[1:10].count("en") >= 8 and labels[12:].count("de") >= 8
    assert all(1 / 3 <= w.marginal <= 1 for w in got[1].words) and not (got[2].words or got[3].words or got[4].words)
    plain = {x.doc_id: (x.lang_pred, x.score) for x in language_id.predict(docs, model).collect()}
    assert plain == {k: (x.lang_pred, x.score) for k, x in got.items()} and plain[3] == ("und", 0.0)
    untrained = language_id.label_words(docs, language_id.train([])).collect()
    assert all(x.words == [] and x.lang_pred == "und" for x in untrained)


@pytest.mark.parametrize("size", [0, 1, 300, 512, 513, 5_000])
def test_parities_never_refute_a_link(size):
    rng = np.random.default_rng(size)
    for other in (size, size + 7, 3 * size + 1):
        for shared in {0, size // 2, size * 9 // 10, size}:
            values = np.unique(rng.integers(0, 1 << 52, size + other + 10, dtype=np.uint64))
            rng.shuffle(values)
            a, b = values[:size], values[size - shared : size - shared + other]
            x, y = ngram_join._parities(a), ngram_join._parities(b)
            least = min(len(x), len(y))
            unlike = int(np.bitwise_count(ngram_join._folded(x, least) ^ ngram_join._folded(y, least)).sum())
            apart = len(set(a.tolist()) ^ set(b.tolist()))
            assert unlike <= apart and unlike % 2 == apart % 2
            if size == 5_000 and shared <= size // 2:  # what has little in common is told by parities alone
                assert unlike > ngram_join._may_differ(np.int64(len(a) + len(b)), 80)
            both = len(set(a.tolist()) & set(b.tolist()))
            if a.size and 100 * both >= 80 * (len(a) + len(b) - both):
                assert unlike <= ngram_join._may_differ(np.int64(len(a) + len(b)), 80)
