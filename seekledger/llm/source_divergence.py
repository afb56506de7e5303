"""Audit of the words by which sources of one language differ.

Counting runs as a pipeline of Arrow kernels inside each task: texts are lower-cased (``ascii_lower``), cut
(``split_pattern_regex``), their terms numbered (``dictionary_encode``) and counted by hash grouping, first by
text, for the number of texts that hold a term, then by group of language and source. A task merges its
partial counts while they repeat and sends one row a group and term.

The merged counts of the terms that a language keeps are dealt by a hash of the term to columnar shards of
a set number of terms. A shard lays its counts out as an array of terms by sources, some columns at a time,
and adds up the divergence of each pair of sources; absent terms are part of the array. Sums over shards
are plain long additions, so every result is exact. A language that holds a third of all rows has more
shards, not larger ones; what a shard gets besides its terms is one number a source of the language, as
long as each source's own result.

Shares are scaled to whole billionths by long division in three steps of a thousand each, so nothing
overflows before the kept terms of a language occur 9e15 times.

Cases: null text, language and source are the empty text; a text without terms still makes its group occur;
a language that keeps no term has pairs of value 0 and no terms; a language with one source has no pairs;
repeated rows count as often as they occur; equal values are ranked by the item's bytes; an empty table gives
an empty result; only the named columns are read. Texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seekledger.llm.scratch import written

#: What lies between terms: ASCII other than letters.
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
SCALE = 1_000_000_000
#: Terms of a shard; counts laid out at a time.
SHARD_TERMS = 50_000
CELLS = 1 << 20
#: Bytes of text counted at a time; partial counts that a task holds before it sends them.
SLICE_BYTES = 1 << 23
HELD_ROWS = 1 << 19

_COUNTED = "lang string, source string, term string, n long, docs long"


def _count(batch: pa.RecordBatch) -> pa.Table:
    """lang, source, term -> occurrences and texts. Groups occur without terms, too: a row of null."""
    groups = pa.table({"lang": batch.column("lang"), "source": batch.column("source")})
    row = pa.array(np.arange(batch.num_rows, dtype=np.int32))
    terms = pc.split_pattern_regex(pc.ascii_lower(batch.column("text")), pattern=BETWEEN)
    at, flat = pc.list_parent_indices(terms).cast(pa.int32()), terms.flatten()
    some = pc.not_equal(pc.binary_length(flat), 0)
    coded = flat.filter(some).dictionary_encode()
    by_text = pa.table({"row": at.filter(some), "code": coded.indices}).group_by(["row", "code"]).aggregate([([], "count_all")])
    by_text = by_text.append_column("lang", groups["lang"].take(by_text["row"]))
    by_text = by_text.append_column("source", groups["source"].take(by_text["row"]))
    found = by_text.group_by(["lang", "source", "code"]).aggregate([("count_all", "sum"), ("row", "count")])
    named = pa.table({"lang": found["lang"], "source": found["source"], "term": pa.chunked_array([coded.dictionary]).take(found["code"])}
                     | {"n": found["count_all_sum"].cast(pa.int64()), "docs": found["row_count"]})
    alone = groups.append_column("row", row).group_by(["lang", "source"]).aggregate([("row", "count")]).select(["lang", "source"])
    zero = pa.array(np.zeros(alone.num_rows, np.int64))
    alone = pa.table({"lang": alone["lang"], "source": alone["source"], "term": pa.nulls(alone.num_rows, pa.string()), "n": zero, "docs": zero})
    return pa.concat_tables([named, alone])


def _merged(tables: list[pa.Table]) -> pa.Table:
    summed = pa.concat_tables(tables).group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ("docs", "sum")])
    return summed.rename_columns({"n_sum": "n", "docs_sum": "docs"}).select(["lang", "source", "term", "n", "docs"])


def _slices(batch: pa.RecordBatch, size: int) -> Iterator[pa.RecordBatch]:
    ends = np.cumsum(np.asarray(pc.binary_length(batch.column("text")), np.int64))
    at = 0
    while at < batch.num_rows:
        to = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, side="right"))
        to = max(to, at + 1)
        yield batch.slice(at, to - at)
        at = to


def _partial(slice_bytes: int, held_rows: int):
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            for part in _slices(batch, slice_bytes):
                held.append(_count(part))
                if sum(t.num_rows for t in held) > held_rows:
                    held = [_merged(held)]
                    if held[0].num_rows > held_rows // 2:
                        yield from held[0].to_batches()
                        held = []
        if held:
            yield from _merged(held).to_batches()

    return made


def term_counts(docs: DataFrame) -> DataFrame:
    """``docs(text, lang, source)`` -> ``lang, source, term, n, docs``; the row with the term null says
    that the group occurs."""
    empty = F.lit("")
    columns = [F.coalesce(F.col(c).cast("string"), empty).alias(c) for c in ("lang", "source", "text")]
    counted = docs.select(*columns).mapInArrow(_partial(SLICE_BYTES, HELD_ROWS), _COUNTED)
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def shares(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * count / total) of counts up to their total."""
    out, rest = np.zeros(np.broadcast(count, total).shape, np.int64), count
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + rest // total, rest % total
    return out + 1


def gaps(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    difference = p - q
    return difference * difference // (p + q)


def _shard(best: int, cells_at_once: int):
    """One shard of a language: parts of the sums of its pairs, and its best terms of each source."""
    fields = [("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())]

    def made(terms: pa.Table, sources: pa.Table) -> pa.Table:
        sources, terms = sources.combine_chunks(), terms.combine_chunks()
        names = sources.column("source").to_pylist()
        lang, kept = sources.column("lang")[0].as_py(), sources.column("kept")[0].as_py()
        n = sources.column("n").to_numpy()
        totals, own = n + 2 * kept, int(n.sum()) + 2 * kept
        place = {s: k for k, s in enumerate(names)}
        listed = terms.column("counts").combine_chunks() if terms.num_rows else None
        words = terms.column("term").to_pylist()
        pairs = np.zeros((len(names), len(names)), np.int64)
        found: list[list[tuple[int, bytes]]] = [[] for _ in names]
        step = max(1, cells_at_once // len(names))
        for a in range(0, len(words), step):
            part = listed.slice(a, step)
            cells = part.flatten()
            at = np.repeat(np.arange(len(part)), np.diff(np.asarray(part.offsets)))
            counts = np.zeros((len(names), len(part)), np.int64)
            counts[[place[s] for s in cells.field("source").to_pylist()], at] = cells.field("n").to_numpy()
            p = shares(counts + 2, totals[:, None])
            for k in range(len(names) - 1):
                pairs[k, k + 1 :] += gaps(p[k], p[k + 1 :]).sum(axis=1)
            q = shares(counts.sum(axis=0) + 2, np.int64(own))
            for k in range(len(names)):
                chosen = np.flatnonzero((counts[k] > 0) & (p[k] > q))
                value = gaps(p[k, chosen], q[chosen])
                if len(chosen) > best:
                    least = np.partition(value, -best)[-best]
                    chosen, value = chosen[value >= least], value[value >= least]
                ranked = found[k] + [(-v, words[a + i].encode()) for v, i in zip(value.tolist(), chosen.tolist())]
                found[k] = sorted(ranked)[:best]
        rows = [(lang, names[x], "pair", names[y], int(pairs[min(x, y), max(x, y)])) for x in range(len(names)) for y in range(len(names)) if x != y]
        rows += [(lang, names[k], "term", word.decode(), -minus) for k, f in enumerate(found) for minus, word in f]
        columns = list(zip(*rows)) if rows else [[]] * 5
        return pa.table([pa.array(c, t) for c, (_, t) in zip(columns, fields)], names=[f for f, _ in fields])

    return made


def audit(docs: DataFrame, least_docs: int = 10, best: int = 10) -> DataFrame:
    """``docs(text, lang, source)`` -> ``lang, source, part, item, value, rank``."""
    counts = written(term_counts(docs), "divergence_counts")
    groups = counts.filter("term IS NULL").select("lang", "source")
    by_term = counts.filter("term IS NOT NULL").groupBy("lang", "term").agg(
        F.collect_list(F.struct("source", "n")).alias("counts"), F.sum("docs").alias("docs")
    )
    kept = written(by_term.filter(F.col("docs") >= least_docs).drop("docs"), "divergence_terms")
    by_source = kept.select("lang", F.inline("counts")).groupBy("lang", "source").agg(F.sum("n").alias("n"))
    by_lang = kept.groupBy("lang").agg(F.count("*").alias("kept"))
    sources = groups.join(by_source, ["lang", "source"], "left").join(by_lang, "lang", "left")
    sources = written(sources.select("lang", "source", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n", "kept"))), "divergence_sources")
    shards = F.ceil(F.greatest("kept", F.lit(1)) / SHARD_TERMS).cast("long")
    dealt = kept.join(sources.select("lang", shards.alias("shards")).distinct(), "lang")
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64("term"), "shards")).drop("shards")
    every = sources.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), shards - 1)))
    parts = dealt.groupBy("lang", "shard").cogroup(every.groupBy("lang", "shard"))
    parts = parts.applyInArrow(_shard(best, CELLS), "lang string, source string, part string, item string, value long")
    values = parts.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = values.withColumn("rank", F.row_number().over(order))
    return ranked.filter((F.col("part") == "pair") | (F.col("rank") <= best))
