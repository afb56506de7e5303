"""Mixing sources to target weights with weighted sampling without replacement.

Each document draws the exponential key ``-ln(u) / weight`` (Efraimidis and Spirakis), ``u`` from a
hash of its id. A source whose target is at least its size is first taken whole as often as fits
(complete epochs); the rest of its target is taken from its documents in the order of their keys, up
to the document at which the running total comes nearest.

No source is ever sorted in one task: approximate quantiles cut a source's keys into parts of about even
numbers, whatever its weights are; exact part totals find the part in which the running total meets the
target, which is cut again until it holds few documents, and only those are ordered. The result is
one cut per source, so taking is a comparison in the scan of the documents.

Cases: null or empty texts have size 0 and take 0 words; a null source is a source of its own, after
all others; rows that repeat a ``doc_id`` share a key and are taken together; an empty table gives an
empty result; other columns are carried along untouched.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seekledger.llm.scratch import written

#: Sources up to this many are sent to every task; beyond it they are joined by a shuffle.
MAX_BROADCAST_SOURCES = 20_000
MAX_EPOCHS = 3


def exponential_key(doc_id: Column, weight: Column, seed: int = 0) -> Column:
    bits = F.shiftrightunsigned(F.xxhash64(doc_id, F.lit(seed)), 11)
    u = (bits.cast("double") + 0.5) / F.lit(float(1 << 53))
    return -F.log(u) / weight


#: Parts that a round cuts a source's keys into.
PARTS = 64


def _brackets(keyed: DataFrame, plan: DataFrame, limit: int) -> DataFrame:
    """``source, rest, lo, hi, before``: keys between which the sizes of a source, added up in their order,
    reach ``rest``, with the sum ``before`` them; at most ``limit`` documents, or one key that many share."""
    whole = keyed.groupBy("source").agg(F.min("key").alias("lo"), F.max("key").alias("hi"), F.count("*").alias("n"))
    reached = plan.filter("rest > 0").select("source", "rest").alias("p")
    start = whole.alias("w").join(reached, F.expr("w.source <=> p.source")).select(
        "w.*", "p.rest", F.lit(0).cast("long").alias("before")
    )
    names = ["source", "rest", "lo", "hi", "n", "before"]
    found = written(start.select(names), "mix_brackets")
    while True:
        wide = found.filter((F.col("n") > limit) & (F.col("lo") < F.col("hi")))
        if wide.isEmpty():
            return found.drop("n")
        inside = (
            keyed.alias("d").join(wide.alias("b"), F.expr("d.source <=> b.source AND b.lo <= d.key AND d.key <= b.hi"))
            .select("d.source", "d.key", "d.size")
        )
        # with its source in a struct, a null one is a group and a join key like any other
        inside = inside.select(F.struct("source").alias("s"), "key", "size")
        cuts = inside.groupBy("s").agg(F.percentile_approx("key", [k / PARTS for k in range(1, PARTS)], 100 * PARTS).alias("cuts"))
        # a cut is a part of its own
        part = 2 * F.size(F.filter("cuts", lambda c: c < F.col("key"))) + F.array_contains("cuts", F.col("key")).cast("int")
        parts = inside.join(cuts, "s").groupBy("s", part.alias("part")).agg(
            F.sum("size").alias("m"), F.min("key").alias("lo"), F.max("key").alias("hi"), F.count("*").alias("n")
        )
        ends = parts.withColumn("end", F.sum("m").over(W.partitionBy("s").orderBy("part")))
        state = wide.select(F.struct("source").alias("s"), "rest", F.col("before").alias("_before"))
        placed = ends.join(state, "s").withColumn("before", F.col("_before") + F.col("end") - F.col("m"))
        chosen = placed.filter("before < rest AND rest <= before + m").select("s.source", *names[1:])
        done = found.filter((F.col("n") <= limit) | (F.col("lo") >= F.col("hi")))
        found = written(done.unionByName(chosen), "mix_brackets")


def source_targets(
    sources: DataFrame, weights: Sequence[float] = (1, 2, 3), max_epochs: int = MAX_EPOCHS
) -> DataFrame:
    """``source, source_size`` -> ``+ target``. Sources by code point, null last, weigh ``weights``,
    repeating, and share the total size; what exceeds ``max_epochs`` times a source's size goes to
    the others by weight until none exceeds. ``sources`` has one row per source."""
    order = W.orderBy(F.col("source").asc_nulls_last())
    given = F.array(*(F.lit(float(w)) for w in weights))
    sources = written(
        sources.withColumn("weight", F.get(given, F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))))),
        "sources",
    )
    limit = F.col("source_size") * max_epochs
    total, all_weight = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    level = float(total or 0) / all_weight if all_weight else 0.0
    capped = -1
    while True:
        full = limit <= F.col("weight") * level
        n, held, free = sources.agg(
            F.count_if(full), F.sum(F.when(full, limit)), F.sum(F.when(~full, F.col("weight")))
        ).first()
        if n == capped or not free:
            break
        capped, level = n, (float(total) - float(held or 0)) / free
    target = F.when(full, limit.cast("double")).otherwise(F.col("weight") * level)
    return sources.select("source", "source_size", target.alias("target"))


def mix(
    docs: DataFrame,
    size: str = "size",
    quality: str = "quality",
    weights: Sequence[float] = (1, 2, 3),
    rows_per_cut: int = 5_000,
    seed: int = 0,
) -> DataFrame:
    """``docs`` (with ``doc_id``, ``source`` and the two named columns) + ``source_size``,
    ``target``, ``times`` (int) and ``taken`` = times x size. ``quality`` is a positive weight:
    the larger, the earlier a document is drawn."""
    key = exponential_key(F.col("doc_id"), F.greatest(F.col(quality), F.lit(1e-6)), seed)
    keyed = docs.select("doc_id", "source", F.col(size).cast("long").alias("size"), key.alias("key"))
    keyed = written(keyed, "mix_keys")
    sizes = written(keyed.groupBy("source").agg(F.sum("size").alias("source_size")), "mix_sizes")
    targets = written(source_targets(sizes, weights), "mix_targets")
    small = sizes.count() <= MAX_BROADCAST_SOURCES
    near = (lambda d: F.broadcast(d)) if small else (lambda d: d)
    epochs = F.coalesce(F.floor(F.col("target") / F.nullif(F.col("source_size"), F.lit(0))), F.lit(0)).cast("int")
    rest = F.col("target") - epochs * F.col("source_size")
    plan = targets.select("source", "source_size", "target", epochs.alias("epochs"), rest.alias("rest"))

    meets = _brackets(keyed.filter("size > 0"), plan, rows_per_cut)
    inside = (
        keyed.filter("size > 0").alias("d")
        .join(near(meets.alias("m")), F.expr("d.source <=> m.source AND m.lo <= d.key AND d.key <= m.hi"))
        # rows that repeat a document are taken together
        .groupBy("d.source", "d.key", "d.doc_id", "m.before", "m.rest").agg(F.sum("d.size").alias("size"))
    )
    order = W.partitionBy("source").orderBy("key", "doc_id").rangeBetween(W.unboundedPreceding, 0)
    steps = inside.withColumn("end", F.col("before") + F.sum("size").over(order))
    at = F.struct("key", "doc_id")
    past = steps.filter("end >= rest").groupBy("source").agg(
        F.min(F.struct(F.col("end"), at.alias("at"), F.col("rest"))).alias("over")
    )
    short = steps.filter("end < rest").groupBy("source").agg(
        F.max(F.struct(F.col("end"), at.alias("at"))).alias("under")
    )
    first = inside.groupBy("source").agg(F.first("before").alias("before"), F.min(at).alias("least"))
    cut = (
        first.alias("f").join(past.alias("o"), F.expr("f.source <=> o.source"), "left")
        .join(short.alias("u"), F.expr("f.source <=> u.source"), "left")
    )
    under = F.coalesce(F.col("u.under.end"), F.col("f.before"))
    take_over = F.col("o.over.end") - F.col("o.over.rest") < F.col("o.over.rest") - under
    place = F.when(take_over, F.col("o.over.at")).otherwise(F.col("u.under.at"))
    cut = written(
        cut.select("f.source", place.alias("cut"), F.col("f.least").alias("least")), "mix_cuts"
    )
    plan = written(
        plan.alias("p").join(cut.alias("c"), F.expr("p.source <=> c.source"), "left").select(
            F.struct("p.*", F.col("c.cut").alias("cut"), F.col("c.least").alias("least")).alias("_mix")
        ),
        "mix_plan",
    )
    docs = docs.drop(*(c for c in ("source_size", "target", "times", "taken", "_mix") if c in docs.columns))
    joined = docs.join(near(plan), docs["source"].eqNullSafe(plan["_mix"]["source"]))
    mine = F.struct(key.alias("key"), F.col("doc_id").alias("doc_id"))
    # without a cut, all documents before the band of the cut are taken, the band's own are not
    drawn = F.when(F.col("_mix.least").isNull(), F.lit(False)).when(
        F.col("_mix.cut").isNotNull(), mine <= F.col("_mix.cut")
    ).otherwise(mine < F.col("_mix.least"))
    times = F.when(F.col(size) > 0, F.col("_mix.epochs") + drawn.cast("int")).otherwise(0)
    return joined.select(
        *docs.columns,
        F.col("_mix.source_size").alias("source_size"),
        F.col("_mix.target").alias("target"),
        times.cast("int").alias("times"),
        (times * F.col(size)).cast("long").alias("taken"),
    )
