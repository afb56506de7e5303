"""Exact percentiles by distributed selection: no task orders more values of a key than a set number.

Distinct values are counted once, in a written table. Per key, a bracket holds the two ranks that the
percentile lies between. While it holds more values than the limit, approximate quantiles of the values inside
cut it into parts of about equal numbers, whatever the values are; the parts are counted exactly, and the part
with the ranks is the next bracket. Each round leaves about one part in ``bins``, so an outlier, a heavy
tail or a spike of near-equal values costs no more than even ones. Only the last bracket is put in order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seekledger.operators.tables import kept

#: Values of a key that one task may put in order.
ORDERED_VALUES = 100_000


def value_counts(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``keys, _v, _n``: how often each value occurs; null keys and values are left out."""
    known = df.select(*keys, F.col(value).alias("_v")).dropna()
    return kept(known.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_n")), "value_counts")


def _first_brackets(counts: DataFrame, keys: list[str], p: float) -> DataFrame:
    """``_lo`` to ``_hi`` holds ``_values`` different values, ``_below`` rows lie before it; the percentile is
    ``_part`` of the way from rank ``_low`` to rank ``_high``."""
    whole = counts.groupBy(*keys).agg(
        F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count(F.lit(1)).alias("_values"), F.sum("_n").alias("_rows")
    )
    at = p * (F.col("_rows") - 1)
    return whole.select(
        *keys, "_lo", "_hi", "_values", F.lit(0).cast("long").alias("_below"), F.floor(at).alias("_low"),
        F.ceil(at).alias("_high"), (at - F.floor(at)).alias("_part"), F.lit(False).alias("_apart"),
    )


def _inside(counts: DataFrame, brackets: DataFrame, keys: list[str]) -> DataFrame:
    return counts.join(brackets, keys).filter((F.col("_lo") <= F.col("_v")) & (F.col("_v") <= F.col("_hi")))


def _narrowed(counts: DataFrame, brackets: DataFrame, keys: list[str], bins: int) -> DataFrame:
    """The part of each bracket that holds its ranks. If they lie in two parts, the lower rank is the last
    value of the first and the upper one the first value of the second."""
    state = ["_below", "_low", "_high", "_part"]
    inside = _inside(counts, brackets, keys).select(*keys, "_v", "_n")
    cuts = inside.groupBy(*keys).agg(F.percentile_approx("_v", [k / bins for k in range(1, bins)], 100 * bins).alias("_cuts"))
    smaller = F.size(F.filter("_cuts", lambda c: c < F.col("_v")))
    # a cut is a part of its own, so a value that repeats through many cuts ends the search
    part = 2 * smaller + F.array_contains("_cuts", F.col("_v")).cast("int")
    parts = inside.join(cuts, keys).groupBy(*keys, part.alias("_bin")).agg(
        F.sum("_n").alias("_m"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count(F.lit(1)).alias("_values")
    )
    ends = F.sum("_m").over(Window.partitionBy(*keys).orderBy("_bin"))
    placed = parts.withColumn("_end", ends).join(brackets.select(*keys, *state), keys)
    start, end = F.col("_below") + F.col("_end") - F.col("_m"), F.col("_below") + F.col("_end")
    holds = lambda rank: (start <= F.col(rank)) & (F.col(rank) < end)
    chosen = placed.filter(holds("_low") | holds("_high")).withColumn("_start", start)
    apart = F.count(F.lit(1)) > 1
    return chosen.groupBy(*keys).agg(
        F.when(apart, F.min("_hi")).otherwise(F.min("_lo")).alias("_lo"),
        F.when(apart, F.max("_lo")).otherwise(F.max("_hi")).alias("_hi"),
        F.max("_values").alias("_values"),
        F.min("_start").alias("_below"),
        *[F.first(c).alias(c) for c in ("_low", "_high", "_part")],
        apart.alias("_apart"),
    )


def percentile_brackets(counts: DataFrame, keys: list[str], p: float, bins: int = 64, limit: int = ORDERED_VALUES) -> DataFrame:
    """One bracket a key with at most ``limit`` values, or (``_apart``) the two values themselves."""
    brackets = kept(_first_brackets(counts, keys, p), "brackets")
    while True:
        wide = brackets.filter((F.col("_values") > limit) & ~F.col("_apart"))
        if wide.isEmpty():
            return brackets
        done = brackets.filter((F.col("_values") <= limit) | F.col("_apart"))
        brackets = kept(done.unionByName(_narrowed(counts, wide, keys, bins)), "brackets")


def ranked_percentile(
    df: DataFrame, keys: list[str], value: str, p: float, name: str, bins: int = 64, limit: int = ORDERED_VALUES
) -> DataFrame:
    """Interpolated percentile per key for values that hardly repeat: ``keys, name``."""
    counts = value_counts(df, keys, value)
    brackets = percentile_brackets(counts, keys, p, bins, limit)
    inside = _inside(counts, brackets.filter(~F.col("_apart")), keys)
    reached = F.col("_below") + F.sum("_n").over(Window.partitionBy(*keys).orderBy("_v"))
    ordered = inside.withColumn("_reached", reached).groupBy(*keys, "_part").agg(
        F.min(F.when(F.col("_reached") > F.col("_low"), F.col("_v"))).alias("_lo"),
        F.min(F.when(F.col("_reached") > F.col("_high"), F.col("_v"))).alias("_hi"),
    )
    found = ordered.unionByName(brackets.filter("_apart").select(*keys, "_part", "_lo", "_hi"))
    return found.select(*keys, (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_part")).alias(name))
