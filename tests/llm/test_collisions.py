"""Texts built so that polynomial hashes modulo 2**64 collide, texts of several blocks, hot tiles."""

from __future__ import annotations

import random
import time

import numpy as np
import pyarrow as pa
import pytest

from seekledger.llm import arrays, blocks, line_dedup, ngram_join, substring_dedup


def pattern(bits: int = 12) -> tuple[str, str]:
    """A Thue-Morse word over a and b, and the same with a and b exchanged: any polynomial hash modulo
    2**64 with an odd base takes them for equal."""
    plain = "".join("ab"[k.bit_count() % 2] for k in range(1 << bits))
    return plain, plain.translate(str.maketrans("ab", "ba"))


def frame(spark, texts, parts=3):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(parts)


def test_words_and_runs_do_not_collide():
    one, other = pattern()
    w = arrays.words(pa.array([one.encode(), other.encode()]))
    assert w.hash[0] != w.hash[1]
    values = np.array([ord(c) for c in one + other], np.uint64)
    h = arrays.run_hashes(values, len(one))
    assert h[0] != h[len(one)]


def test_windows_of_colliding_words(spark):
    """35 words each: the windows of two documents differ, those of the third repeat the first."""
    one, other = pattern()
    first = " ".join([one, *(f"w{k}" for k in range(34))])
    second = " ".join([other, *(f"w{k}" for k in range(34))])
    got = {r.doc_id: r.n_removed for r in substring_dedup.repeats(frame(spark, [first, second])).collect()}
    assert got == {0: 0, 1: 0}
    got = {r.doc_id: r.n_removed for r in substring_dedup.repeats(frame(spark, [first, second, first])).collect()}
    assert got == {0: 35, 1: 0, 2: 35}
    # the pattern over words instead of letters
    rows = [" ".join(f"x{c}" for c in t) + " " + tail for t, tail in zip(pattern(9), ("one end", "another"))]
    got = substring_dedup.repeats(frame(spark, rows), 512).collect()
    assert [r.n_removed for r in got] == [0, 0]


def test_lines_that_collide_both_stay(spark):
    one, other = pattern()
    got = {r.doc_id: (r.n_copies, r.n_near, bytes(r.kept_text).decode()) for r in line_dedup.dedup_lines(frame(spark, [one, other])).collect()}
    assert got == {0: (0, 0, one), 1: (0, 0, other)}


def test_sets_that_collide_do_not_link(spark):
    one, other = pattern()
    texts = [f"{one} tail end", f"{other} tail end"]
    got = {r.doc_id: r.component_id for r in ngram_join.similar_documents(frame(spark, texts), 3, 90).collect()}
    assert got == {0: 0, 1: 1}


def sentence(r, n):
    return " ".join("".join(r.choices("abcdefgh", k=r.randrange(2, 7))) for _ in range(n))


def test_blocks_split_and_keep_long_texts(spark):
    r = random.Random(1)
    long = sentence(r, 700_000)  # more than 3 MiB
    texts = [sentence(r, 20) for _ in range(9000)] + [long, long, None, ""]
    packed = blocks.pack(frame(spark, texts, 1)).selectExpr("block", "size(ids) AS n", "aggregate(texts, 0L, (s, t) -> s + coalesce(length(t), 0)) AS size").collect()
    assert len(packed) > 3 and sum(b.n for b in packed) == len(texts)
    assert all(b.n <= blocks.MAX_ROWS and (b.size <= blocks.MAX_BYTES or b.n == 1) for b in packed)


def test_long_texts_through_the_operators(spark):
    """Two texts of more than 3 MiB that share their second half, and one line, over blocks of their own."""
    r = random.Random(2)
    half = sentence(r, 350_000)
    texts = [f"{sentence(r, 300_000)}\n{half}", f"{sentence(r, 310_000)}\n{half}", "short text of one line"]
    got = {x.doc_id: x for x in substring_dedup.repeats(frame(spark, texts)).collect()}
    assert {d: x.n_removed for d, x in got.items()} == {0: 350_000, 1: 350_000, 2: 0}
    assert bytes(got[0].kept_text).decode() == texts[0].split("\n")[0]
    lines = {x.doc_id: x for x in line_dedup.dedup_lines(frame(spark, texts)).collect()}
    assert {d: (x.n_lines, x.n_copies, x.n_near) for d, x in lines.items()} == {0: (2, 0, 0), 1: (2, 1, 0), 2: (1, 0, 0)}
    assert bytes(lines[1].kept_text).decode() == texts[1].split("\n")[0]


@pytest.mark.parametrize("tile_rows", [10, 64])
def test_every_link_across_the_groups_of_a_hot_tile(spark, monkeypatch, tile_rows):
    """Texts of one template: most do not link, chains of near copies do, and groups of a tile are small."""
    r = random.Random(3)
    template = sentence(r, 120).split()
    texts = []
    for k in range(150):
        own = template[:]
        for at in r.sample(range(120), 22):
            own[at] = f"own{k}x{at}"
        texts.append(" ".join(own))
    for k in range(0, 60, 3):
        near = texts[k].split()
        near[60] = f"near{k}"
        texts.append(" ".join(near))
    sets = [{tuple(w[i : i + 3]) for i in range(len(w) - 2)} for w in (t.split() for t in texts)]
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, x in enumerate(sets):
        for j in range(i):
            if 100 * len(x & sets[j]) >= 90 * len(x | sets[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    monkeypatch.setattr(ngram_join, "TILE_ROWS", tile_rows)
    got = {x.doc_id: x.component_id for x in ngram_join.similar_documents(frame(spark, texts), 3, 90).collect()}
    assert got == {k: root(k) for k in range(len(texts))} and sum(root(k) != k for k in got) == 20


def test_tasks_of_a_hot_tile_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "TILE_ROWS", 50)
    rows = [(1, k, 0 if k < 400 else k) for k in range(900)] + [(2, k, k) for k in range(10)]
    tiles = spark.createDataFrame(rows, "key long, uid long, comp long")
    tasks = ngram_join._split_tiles(tiles)
    assert tasks.groupBy("key").count().agg({"count": "max"}).first()[0] <= 2 * 50 * 1.8
    together = {}
    for x in tasks.collect():
        together.setdefault(x.key, set()).add(x.uid)
    met = {(a, b) for group in together.values() for a in group for b in group if a < b}
    assert all((a, b) in met for a in range(900) for b in range(a + 1, 900) if b >= 400)


def test_many_texts_of_one_template(spark):
    r = random.Random(4)
    template = sentence(r, 150).split()
    texts = []
    for k in range(3000):
        own = template[:]
        for at in r.sample(range(150), 30):
            own[at] = f"own{k}x{at}"
        texts.append(" ".join(own))
    docs = frame(spark, texts)
    start = time.time()
    assert {x.component_id == x.doc_id for x in ngram_join.similar_documents(docs, 3, 90).collect()} == {True}
    assert time.time() - start < 90
