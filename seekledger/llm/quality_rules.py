"""Quality rules: a decision list learned by sequential covering, as a Spark expression.

``text_statistics`` describes each text by a few numbers. ``learn`` reads labelled statistics and
covers the rejected class rule by rule: a rule grows one threshold at a time by information gain
on the growing rows, is pruned back on the pruning rows, and its rows are set aside before the next
rule. Each step is one aggregation that counts labels by (statistic, bin); only those counts, at
most statistics x bins of them, reach the driver. ``DecisionList.keep`` is an ordered ``CASE``.

Everything is DataFrame code. Cases:

* null or empty text: all statistics are 0;
* no labels, or labels of one class only: no rules, everything is kept;
* null labels are left out; a document labelled several times counts once per label row;
* extra columns are ignored, repeated documents are treated alike.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seekledger.llm.native import SPACE, char_count, let, words

#: Characters that count as symbols (fixed by the contract of the statistics).
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Statistics a rule may test, each a ratio or a count that does not depend on the corpus.
RATIOS = {
    "mean_word_chars": lambda: _share("word_chars", "n_words"),
    "symbol_share": lambda: _share("n_symbols", "n_words"),
    "dup_line_share": lambda: _share("n_dup_lines", "n_lines"),
    "repeat_word_share": lambda: _share("n_repeat_words", "n_words"),
    "upper_share": lambda: _share("n_upper", "word_chars"),
    "words_per_line": lambda: _share("n_words", "n_lines"),
}


def _share(top: str, bottom: str) -> Column:
    return F.coalesce(F.col(top) / F.nullif(F.col(bottom), F.lit(0)), F.lit(0.0)).cast("double")


def _repeat_words(word_list: Column, window: int = 3) -> Column:
    """Words inside windows of ``window`` words that occur twice or more in the text.

    Windows are sorted by their hash, then their words, then their position: equal windows are
    neighbours whatever the hash gives and however long the text is. The positions of windows that
    equal a neighbour, in order, cover ``window`` words each less their overlaps.
    """

    def of(w: Column) -> Column:
        n = F.size(w)
        same_fields = ["h", *(f"w{k}" for k in range(window))]

        def placed(i: Column) -> Column:
            parts = [F.get(w, i + k) for k in range(window)]
            return F.struct(*(x.alias(n) for x, n in zip([F.xxhash64(*parts), *parts], same_fields)), i.alias("i"))

        def same(a: Column, b: Column) -> Column:
            equal = F.lit(True)
            for name in same_fields:
                equal = equal & (a[name] == b[name])
            return F.coalesce(equal, F.lit(False))

        def found(s: Column) -> Column:
            return F.filter(s, lambda x, i: same(x, F.get(s, i - 1)) | same(x, F.get(s, i + 1)))

        def covered(p: Column) -> Column:
            steps = F.transform(p, lambda x, i: F.least(F.lit(window), F.coalesce(F.get(p, i + 1) - x, F.lit(window))))
            return F.aggregate(steps, F.lit(0).cast("long"), lambda t, x: t + x)

        order = F.sort_array(F.transform(F.sequence(F.lit(0), n - window), placed))
        places = let(order, lambda s: F.sort_array(F.transform(found(s), lambda x: x["i"])))
        return F.when(n <= window, F.lit(0).cast("long")).otherwise(let(places, covered))

    return let(word_list, of)


def text_statistics(docs: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keys`` and the statistics of each whole text, one row per row of ``docs``."""
    body = F.coalesce(F.col(text), F.lit(""))
    base = docs.select(*keys, body.alias("_text"), words(F.col(text)).alias("_words"))
    lines = F.filter(F.split(F.col("_text"), "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counts = {
        "n_words": F.size("_words"),
        "word_chars": F.length(F.array_join("_words", "")),
        "n_symbols": char_count(F.col("_text"), SYMBOLS),
        "n_lines": let(lines, lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("d"))),
        "n_repeat_words": _repeat_words(F.col("_words")),
        "n_upper": F.length("_text") - F.length(F.regexp_replace("_text", r"\p{Lu}+", "")),
    }
    out = base.select(*keys, *(c.alias(name) for name, c in counts.items()))
    longs = [n for n in counts if n != "n_lines"]
    out = out.select(
        *keys,
        *(F.col(n).cast("long").alias(n) for n in longs),
        F.col("n_lines.n").cast("long").alias("n_lines"),
        (F.col("n_lines.n") - F.col("n_lines.d")).cast("long").alias("n_dup_lines"),
    )
    return out.select("*", *(c().alias(name) for name, c in RATIOS.items()))


def base_failed() -> Column:
    """Texts too short or too repetitive for any rule to save."""
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    name: str
    above: bool
    threshold: float

    def holds(self) -> Column:
        value = F.col(self.name)
        return value > self.threshold if self.above else value <= self.threshold

    def __str__(self) -> str:
        return f"{self.name} {'>' if self.above else '<='} {self.threshold:g}"


@dataclass
class DecisionList:
    """Rules in order; a text that meets all conditions of one is rejected."""

    rules: list[list[Condition]] = field(default_factory=list)

    def keep(self) -> Column:
        out = None
        for rule in self.rules:
            test = F.lit(True)
            for condition in rule:
                test = test & condition.holds()
            out = F.when(test, F.lit(False)) if out is None else out.when(test, F.lit(False))
        return F.lit(True) if out is None else out.otherwise(F.lit(True))

    def __str__(self) -> str:
        return "\n".join(f"reject if {' and '.join(map(str, rule))}" for rule in self.rules) or "keep all"


def _cuts(rows: DataFrame, names: list[str], bins: int) -> dict[str, list[float]]:
    """Candidate thresholds of each statistic: its quantiles on the labelled rows."""
    at = [k / bins for k in range(1, bins)]
    found = rows.agg(*(F.percentile_approx(n, at, 1000).alias(n) for n in names)).first()
    return {n: sorted(set(found[n] or [])) for n in names}


def _counts(rows: DataFrame, cuts: dict[str, list[float]]) -> list:
    """Labels by (statistic, bin), in one pass: bin k holds the values up to cut k."""
    def bin_of(name: str) -> Column:
        value = F.col(name)
        return F.size(F.filter(F.array(*map(F.lit, cuts[name])), lambda c: c < value))

    binned = [F.struct(F.lit(i).alias("name"), bin_of(n).alias("bin")) for i, n in enumerate(cuts) if cuts[n]]
    if not binned:
        return []
    stacked = rows.select("bad", "grow", F.explode(F.array(*binned)).alias("b"))
    sums = [
        F.sum(((F.col("bad") == bad) & (F.col("grow") == grow)).cast("long"))
        for grow in (True, False)
        for bad in (True, False)
    ]
    return stacked.groupBy("b.name", "b.bin").agg(*sums).collect()


def _candidates(counted: list, cuts: dict[str, list[float]]):
    """(condition, bad and good growing rows, bad and good pruning rows) of each threshold."""
    names = list(cuts)
    for i, name in enumerate(names):
        rows = sorted((r for r in counted if r[0] == i), key=lambda r: r[1])
        total = [sum(r[k] for r in rows) for k in range(2, 6)]
        below = [0, 0, 0, 0]
        by_bin = {r[1]: r[2:] for r in rows}
        for k, cut in enumerate(cuts[name]):
            below = [a + b for a, b in zip(below, by_bin.get(k, (0, 0, 0, 0)))]
            yield Condition(name, False, float(cut)), below
            yield Condition(name, True, float(cut)), [t - b for t, b in zip(total, below)]


def _gain(before: tuple[int, int], after: tuple[int, int]) -> float:
    """Information gain of a narrower rule, weighted by the bad rows it still covers."""
    if after[0] == 0:
        return -math.inf
    bits = lambda p, n: math.log2(p / (p + n)) if p else -math.inf
    return after[0] * (bits(*after) - bits(*before)) if before[0] else -math.inf


def learn(
    labelled: DataFrame,
    label: str = "quality",
    names: tuple[str, ...] = tuple(RATIOS),
    max_rules: int = 12,
    max_conditions: int = 4,
    bins: int = 40,
    min_precision: float = 0.9,
    min_covered: int = 3,
) -> DecisionList:
    """Learn rules that reject rows whose ``label`` is 0. ``labelled`` holds the statistics, the
    label and ``doc_id``; two thirds of the rows (by hash of the id) grow rules, the rest prune."""
    rows = labelled.filter(F.col(label).isin(0, 1)).select(
        *names,
        (F.col(label) == 0).alias("bad"),
        (F.pmod(F.xxhash64("doc_id"), F.lit(3)) != 0).alias("grow"),
    )
    cuts = _cuts(rows, list(names), bins)
    out = DecisionList()
    while len(out.rules) < max_rules:
        left = rows.filter(out.keep())
        rule: list[Condition] = []
        trail: list[list[int]] = []
        counted = _counts(left, cuts)
        if not counted:
            break
        first = counted[0][0]
        cover = [sum(r[k] for r in counted if r[0] == first) for k in range(2, 6)]
        while len(rule) < max_conditions and cover[0] and cover[1]:
            best = max(
                ((_gain((cover[0], cover[1]), (c[0], c[1])), str(cond), cond, c) for cond, c in _candidates(counted, cuts)),
                key=lambda x: (x[0], x[1]),
                default=None,
            )
            if best is None or best[0] <= 1e-9:
                break
            rule.append(best[2])
            trail.append(cover := best[3])
            if not cover[1]:
                break
            narrowed = left
            for condition in rule:
                narrowed = narrowed.filter(condition.holds())
            counted = _counts(narrowed, cuts)
        worth = lambda c: (c[2] - c[3]) / (c[2] + c[3]) if c[2] + c[3] else (c[0] - c[1]) / (c[0] + c[1]) - 2
        if not rule:
            break
        keep = max(range(len(rule)), key=lambda k: (worth(trail[k]), -k))
        bad, good = trail[keep][0] + trail[keep][2], trail[keep][1] + trail[keep][3]
        if bad < min_covered or bad < min_precision * (bad + good):
            break
        out.rules.append(rule[: keep + 1])
    return out


#: Steps in which a share of rows is measured: even one row of 4e15 can be asked for.
SHARE_STEPS = 1 << 52


def bounded_sample(rows: DataFrame, most: int, key: str = "doc_id", salt: int = 17) -> DataFrame:
    """All rows, or about ``most`` of them chosen by a hash of the key."""
    n = rows.count()
    if n <= most:
        return rows
    return rows.filter(F.pmod(F.xxhash64(F.col(key), F.lit(salt)), F.lit(SHARE_STEPS)) < sample_limit(most, n))


def sample_limit(most: int, n: int) -> int:
    """Hashes below it belong to a sample of ``most`` of ``n`` rows; never 0."""
    return max(1, SHARE_STEPS * most // n)
