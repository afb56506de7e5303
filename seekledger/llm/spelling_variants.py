"""Grouping of spelling variants by pivotal grams.

Two words are near if one inserted, deleted or replaced character turns one into the other. The grams
(pairs of neighbouring characters) of all words are put in one order, rare ones first; a word's gram prefix
is its three first grams in that order, with all that tie with the third. An edit spoils at most two grams,
which overlap, so of two disjoint grams of a word, its pivots, one is found unspoiled in every near word,
shifted by at most one place. And if the last prefix gram of word r is not after that of word s, the pivots
of r, all among its prefix, can be found in no other place than the prefix of s. So the pivots of each word
are looked up among the prefixes of the others, which holds every near pair.

The pivots are the cheapest two disjoint grams of the prefix, by dynamic programming over their places.
Position limits are part of the key: an edit behind a gram leaves all up to it alone, an edit before it
leaves all from it on alone, and the other word is shorter or longer by one at most. So a key is the part
of the word that stays, with the gram at its end, and the length of the word. Pairs are verified by their
edit distance in the join itself, which adaptive execution splits where a key is hot.

Cases: null texts hold no words; a null id counts as the empty text in the hash that damages runs; repeated
rows count as often as they occur; ties of counts go to the word that is smaller in code points; an empty
table gives an empty result; only the named columns of the input are read, so others may have any name.
Words and texts are not capped. Words below four characters have no two disjoint grams to rely on.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seekledger.llm.scratch import written

LETTERS = r"A-Za-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Characters of a gram; grams of the prefix: what one edit can spoil, and one more.
GRAM = 2
PREFIX = GRAM + 1
PIVOTS = 2


def _damaged(doc_id: Column, run: Column, every: int) -> Column:
    """The run without one of its characters, where the hash of its place says so."""
    hashed = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run))
    at = (hashed % F.char_length(run)).cast("int")
    without = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))
    return F.when(hashed % every == 0, without).otherwise(run)


def word_counts(docs: DataFrame, least_length: int = 6, least_count: int = 5, damage_every: int = 199) -> DataFrame:
    """``docs(doc_id, text)`` -> ``word, n``: runs of letters, A-Z lower-cased, after the damage."""
    runs = F.regexp_extract_all("text", F.lit(f"([{LETTERS}]{{{least_length},}})"), F.lit(1))
    found = docs.select(F.col("doc_id").alias("doc"), F.explode(runs).alias("run"))
    run = F.when(F.lower("run") == F.col("run"), F.col("run")).otherwise(F.translate("run", UPPER, LOWER))
    found = found.select("doc", run.alias("run")).select(_damaged(F.col("doc"), F.col("run"), damage_every).alias("word"))
    counted = found.filter(F.char_length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n"))
    return counted.filter(F.col("n") >= least_count)


class Gram(NamedTuple):
    place: int
    words: int  # that hold it
    text: str


def gram_prefix(grams: list[Gram]) -> list[Gram]:
    """The rarest grams of a word, in the order of their places."""
    order = sorted((g.words, g.text) for g in grams)
    last = order[min(PREFIX, len(order)) - 1]
    return sorted(g for g in grams if (g.words, g.text) <= last)


def pivotal(prefix: list[Gram], count: int = PIVOTS) -> list[Gram]:
    """The cheapest ``count`` disjoint grams of a prefix: ``best[k][i]`` is the least cost of k of its
    first i grams."""
    before = [sum(p.place + GRAM <= g.place for p in prefix) for g in prefix]
    best: list[list[tuple[float, tuple[Gram, ...]]]] = [[(0.0, ())] * (len(prefix) + 1)]
    for _ in range(count):
        row: list[tuple[float, tuple[Gram, ...]]] = [(float("inf"), ())]
        for i, gram in enumerate(prefix):
            cost, chosen = best[-1][before[i]]
            row.append(min(row[-1], (cost + gram.words, (*chosen, gram)), key=lambda x: x[0]))
        best.append(row)
    return list(best[-1][-1][1])


_KEYS = "word string, n long, probe boolean, part string, size int, last_words long, last_text string"


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[tuple] = []
        for row in batch.to_pylist():
            word, n = row["word"], row["n"]
            prefix = gram_prefix([Gram(g["place"], g["words"], g["gram"]) for g in row["grams"]])
            last = max((g.words, g.text) for g in prefix)
            for gram in prefix:
                rows += [(word, n, False, part, len(word), *last) for part in _parts(word, gram)]
            for gram in pivotal(prefix):
                for part in _parts(word, gram):
                    rows += [(word, n, True, part, len(word) + shift, *last) for shift in (-1, 0, 1)]
        columns = list(zip(*rows)) if rows else [[]] * 7
        types = [pa.string(), pa.int64(), pa.bool_(), pa.string(), pa.int32(), pa.int64(), pa.string()]
        names = [c.split()[0] for c in _KEYS.split(", ")]
        yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)], names=names)


def _parts(word: str, gram: Gram) -> tuple[str, str]:
    """What stays if the edit lies behind the gram, and if it lies before it."""
    return "<" + word[: gram.place + GRAM], ">" + word[gram.place :]


def near_pairs(words: DataFrame) -> DataFrame:
    """``words(word, n)`` of four characters or more -> ``a, n_a, b, n_b``: each near pair once, a < b."""
    places = F.sequence(F.lit(0), F.char_length("word") - GRAM)
    grams = words.filter(F.char_length("word") >= GRAM + 2).select("word", "n", F.explode(places).alias("place"))
    grams = grams.withColumn("gram", F.substring("word", F.col("place") + 1, F.lit(GRAM)))
    held = grams.groupBy("gram").agg(F.count("*").alias("words"))
    by_word = grams.join(held, "gram").groupBy("word", "n").agg(F.collect_list(F.struct("place", "words", "gram")).alias("grams"))
    keys = written(by_word.mapInArrow(_keys, _KEYS), "variant_keys")
    probe = keys.filter("probe").select("part", "size", F.col("word").alias("r"), F.col("n").alias("n_r"), F.struct("last_words", "last_text").alias("last_r"))
    index = keys.filter("NOT probe").select("part", "size", F.col("word").alias("s"), F.col("n").alias("n_s"), F.struct("last_words", "last_text").alias("last_s"))
    found = probe.join(index, ["part", "size"]).filter("last_r <= last_s AND r != s AND levenshtein(r, s, 1) = 1")
    first = F.col("r") < F.col("s")
    ordered = [
        F.when(first, F.col(x)).otherwise(F.col(y)).alias(name)
        for x, y, name in (("r", "s", "a"), ("n_r", "n_s", "n_a"), ("s", "r", "b"), ("n_s", "n_r", "n_b"))
    ]
    return found.select(*ordered).distinct()


def forms(words: DataFrame, pairs: DataFrame, times: int = 5) -> DataFrame:
    """+ n_near; form and form_n: the near word of the largest count, if that is ``times`` the word's."""
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("n_b").alias("m"))
    both = both.union(pairs.select("b", "a", "n_a"))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("minus"), "other")).alias("best"))
    strong = -F.col("best.minus") >= times * F.col("n")
    return words.join(best, "word", "left").select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(strong, F.col("best.other")).alias("form"),
        F.when(strong, -F.col("best.minus")).alias("form_n"),
    )


def roots(found: DataFrame) -> DataFrame:
    """+ root: the end of the chain of forms. Each step of a chain multiplies the count, so chains are
    short; every round doubles the number of steps taken."""
    steps = written(found.filter("form IS NOT NULL").select("word", F.col("form").alias("root")), "variant_steps")
    while True:
        further = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        steps = written(steps.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "variant_steps")
        if steps.filter("moved").isEmpty():
            return found.join(steps.select("word", "root"), "word", "left").withColumn("root", F.coalesce("root", "word"))
        steps = steps.select("word", "root")


def group_variants(words: DataFrame, times: int = 5) -> DataFrame:
    """``words(word, n)`` -> ``word, n, n_near, form, form_n, root``."""
    words = written(words.select("word", "n"), "variant_words")
    return roots(written(forms(words, near_pairs(words), times), "variant_forms"))
