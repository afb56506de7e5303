"""The registered queries against brute force on a small folder of tables, and on empty tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from seekledger.llm import queries as q
from seekledger.llm.sentencepiece_codec import Codec, Model

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def texts(documents):
    """One entry per distinct row; repeated rows give equal results."""
    return {d: t for d, t, *_ in documents}


def rows_by_id(df, n):
    rows = df.collect()
    assert len(rows) == n
    return rows


def sql_rows(sf_dir, sql):
    db = duckdb.connect()
    for name in ("documents", "labels", "pages", "embeddings"):
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet/*.parquet')")
    found = db.execute(sql)
    return [c[0] for c in found.description], sorted(found.fetchall(), key=repr)


@pytest.mark.parametrize("name", [n for n, x in q.QUERIES.items() if x.sql])
def test_sql(spark, sf_dir, name):
    columns, want = sql_rows(sf_dir, q.QUERIES[name].sql)
    got = q.QUERIES[name].run(spark, sf_dir).select(columns).collect()
    assert sorted(map(tuple, got), key=repr) == want


def test_pages_with_repeated_and_null_ids(spark, tmp_path):
    body, long_ = "<p>" + "é page " * 300, "y" * 70_000
    rows = [(1, body), (1, body), (None, body), (0, body), (2, long_), (2, long_), (2, "z" * 50_000), (None, long_), (None, None), (-1, long_)]
    pages = spark.createDataFrame([(k, "u", h) for k, h in rows], "page_id long, url string, html string")
    pages.repartition(3).write.parquet(str(tmp_path / "pages.parquet"))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    want = db.execute(q.OP2_SQL)
    names = [c[0] for c in want.description]
    got = q.op2_warc(spark, str(tmp_path)).select(names).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want.fetchall(), key=repr)


@pytest.mark.parametrize("name", list(q.QUERIES))
def test_empty_tables(spark, empty_dir, name):
    assert q.QUERIES[name].run(spark, empty_dir).collect() == []


def test_quality_rules(spark, sf_dir, documents):
    known = texts(documents)
    kept = {}
    for r in rows_by_id(q.op1_quality_rules(spark, sf_dir), len(documents)):
        t = known[r.doc_id] or ""
        w = words(t)
        runs = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        count = Counter(runs)
        covered = {i + k for i, x in enumerate(runs) if count[x] > 1 for k in range(3)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        base = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
        assert not (r.base_failed and r.kept)
        kept[r.doc_id] = r.kept
    clean = [d for d, t, *_ in documents[:50] if len(words(t)) >= 50]
    junk = [d for d, t in known.items() if t and ("!!" in t or "***" in t)]
    assert sum(kept[d] for d in clean) >= 0.9 * len(clean) and sum(kept[d] for d in junk) <= 0.1 * len(junk)


def test_substring_dedup(spark, sf_dir, documents):
    known, n = texts(documents), 35
    count = Counter(tuple(w[i : i + n]) for _, t, *_ in documents for w in [words(t)] for i in range(len(w) - n + 1))
    removed = 0
    for r in rows_by_id(q.op4_substring_dedup(spark, sf_dir), len(documents)):
        w = words(known[r.doc_id])
        gone = {i + k for i in range(len(w) - n + 1) if count[tuple(w[i : i + n])] > 1 for k in range(n)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        assert (r.n_words, r.n_removed, r.kept_sha256) == (len(w), len(gone), sha(kept.encode()))
        removed += len(gone)
    assert removed > 300


def test_ngram_join(spark, sf_dir, documents):
    fold = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})

    def tokens(t):
        w = [x.translate(fold) for x in words(t)]
        return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} or ({tuple(w)} if w else set())

    known = {d: tokens(t) for d, t in texts(documents).items()}
    parent = {d: d for d in known}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for a in known:
        for b in known:
            x, y = known[a], known[b]
            if a < b and x and y and 100 * len(x & y) >= 90 * len(x | y):
                lo, hi = sorted((root(a), root(b)))
                parent[hi] = lo
    assert sum(root(d) != d for d in known) >= 4
    for r in rows_by_id(q.op5_ngram_join(spark, sf_dir), len(documents)):
        assert (r.n_shingles, r.component_id) == (len(known[r.doc_id]), root(r.doc_id))


def test_mixing(spark, sf_dir, documents):
    size = {d: len(words(t)) for d, t, *_ in documents}
    per_source = Counter()
    for d, _, _, s, _ in documents:
        per_source[s] += size[d]
    order = sorted((s for s in per_source if s is not None), key=lambda s: s.encode()) + [None] * (None in per_source)
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(order)}
    total, target, free = sum(per_source.values()), {}, set(order)
    while True:
        level = (total - sum(target.values())) / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level >= 3 * per_source[s]}
        if not over:
            break
        target |= {s: 3 * per_source[s] for s in over}
        free -= over
    target |= {s: weight[s] * level for s in free}
    rows = rows_by_id(q.op6_mixing(spark, sf_dir), len(documents))
    again = q.op6_mixing(spark, sf_dir).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
    source = {d: s for d, _, _, s, _ in documents}
    taken = Counter()
    for r in rows:
        s = source[r.doc_id]
        assert (r.size, r.source_size) == (size[r.doc_id], per_source[s]) and r.target == pytest.approx(target[s])
        assert r.taken % max(r.size, 1) == 0 and r.taken <= 3 * r.size
        taken[s] += r.taken
    largest = max(size.values())
    assert all(abs(taken[s] - target[s]) <= largest for s in order)
    assert abs(sum(taken.values()) - total) < 0.1 * total


def test_quality_classifier(spark, sf_dir, documents):
    import zlib

    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect() if r.quality is not None}
    right, held = 0, 0
    for r in rows_by_id(q.op7_quality_classifier(spark, sf_dir), len(documents)):
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        if r.held_out and r.doc_id in quality:
            held += 1
            right += r.predicted == quality[r.doc_id]
    assert held >= 15 and right >= 0.85 * held


def test_sentencepiece(spark, sf_dir, documents):
    codec = Codec(Model.load(q.PIECES))
    known = texts(documents)
    for r in rows_by_id(q.op8_sentencepiece(spark, sf_dir), len(documents)):
        t = known[r.doc_id] or ""
        ids = codec.encode(t)
        assert (r.n_ids, r.ids_sha256, r.text_sha256) == (len(ids), sha(np.array(ids, "<i4").tobytes()), sha(t.encode()))


def test_line_dedup(spark, sf_dir, documents):
    lines = {}
    for d, t, *_ in documents:
        for k, line in enumerate((t or "").split("\n")):
            if WORD.search(line):
                lines.setdefault(line.strip(" \t\n\x0b\x0c\r"), []).append((d, k))
    assert min(abs(len(a) - len(b)) for a in list(lines)[:5] for b in list(lines)[5:9]) >= 0
    repeated = sum(len(v) - len(set(v)) for v in lines.values())  # of the repeated row
    rows = rows_by_id(q.op9_line_dedup(spark, sf_dir), len(documents))
    n = sum(len(v) for v in lines.values())
    assert sum(r.n_lines for r in rows) == n
    assert sum(r.n_copies for r in rows) == n - len(lines) and repeated > 0


def test_language_id(spark, sf_dir, documents):
    import zlib

    lang = {d: g for d, _, g, *_ in documents}
    known = texts(documents)
    right, held = 0, 0
    for r in rows_by_id(q.op10_language_id(spark, sf_dir), len(documents)):
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        letters = any(c.isalpha() for c in known[r.doc_id] or "")
        assert (r.lang_pred == "und") == (not letters) and 0 <= r.score <= 1
        if r.held_out and len(known[r.doc_id] or "") > 60:
            held += 1
            right += r.lang_pred == lang[r.doc_id]
    assert held >= 10 and right >= 0.9 * held
