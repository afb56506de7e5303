"""Rollup primitives against brute force on small frames with ties, nulls and a hot key."""

from __future__ import annotations

import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from seekledger.operators import rollups as R

START = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    out = []
    for at in range(600):
        # One key holds a third of all rows.
        parent = "hot" if at % 3 == 0 else rng.choice(["a", "b", "c", "d", None])
        child = rng.choice(["x", "y", "z", None])
        names = rng.sample(["p", "q", "r", "s"], rng.randint(0, 3))
        out.append((at, parent, child, names + names[:1], START + timedelta(minutes=rng.randint(0, 3000)), float(rng.randint(0, 50))))
    return out


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, parent string, child string, names array<string>, timestamp timestamp, v double").repartition(4)


def _ranked(counts, size):
    return sorted(counts.items(), key=lambda kv: (-kv[1], kv[0]))[:size]


def test_terms_leave_nulls_out_and_break_ties_by_key(frame, rows):
    got = [(r.parent, r["count"]) for r in R.terms(frame, "parent", 3).collect()]
    assert got == _ranked(Counter(r[1] for r in rows if r[1]), 3)


def test_terms_with_a_label_for_missing(frame, rows):
    got = [(r.parent, r["count"]) for r in R.terms(frame, "parent", 10, missing="-").collect()]
    assert got == _ranked(Counter(r[1] or "-" for r in rows), 10)


def test_list_terms_count_a_row_once_per_value(frame, rows):
    got = [(r.name, r["count"]) for r in R.terms_of_list(frame, F.col("names"), "name", 10).collect()]
    assert got == _ranked(Counter(n for r in rows for n in set(r[3])), 10)


@pytest.mark.parametrize("sizes", [(2, 2), (5, 1), (10, 10)])
def test_nested_terms_rank_parents_by_their_own_total(frame, rows, sizes):
    got = {(r.parent, r.child, r["count"]) for r in R.nested_terms(frame, ["parent", "child"], list(sizes)).collect()}
    want = set()
    for parent, _ in _ranked(Counter(r[1] for r in rows if r[1]), sizes[0]):
        want |= {(parent, c, n) for c, n in _ranked(Counter(r[2] for r in rows if r[1] == parent and r[2]), sizes[1])}
    assert got == want


def test_nested_terms_three_levels(frame, rows):
    df = frame.withColumn("third", F.col("id") % 4)
    got = {tuple(r) for r in R.nested_terms(df, ["parent", "child", "third"], [2, 2, 2]).select("parent", "child", "third", "count").collect()}
    want = set()
    for p, _ in _ranked(Counter(r[1] for r in rows if r[1]), 2):
        for c, _ in _ranked(Counter(r[2] for r in rows if r[1] == p and r[2]), 2):
            cells = Counter(r[0] % 4 for r in rows if r[1] == p and r[2] == c)
            want |= {(p, c, t, n) for t, n in _ranked(cells, 2)}
    assert got == want


def test_nested_list_terms(frame, rows):
    got = {tuple(r) for r in R.nested_terms_of_list(frame, "parent", F.col("names"), "name", (2, 2), "-").select("parent", "name", "count").collect()}
    want = set()
    for p, _ in _ranked(Counter(r[1] or "-" for r in rows), 2):
        want |= {(p, n, k) for n, k in _ranked(Counter(n for r in rows if (r[1] or "-") == p for n in set(r[3])), 2)}
    assert got == want


def _bucket(at):
    return START + timedelta(hours=(at - START) // timedelta(hours=1))


def test_time_buckets_are_never_empty(frame, rows):
    got = {r.bucket: r["count"] for r in R.over_time(frame, "1 hour").collect()}
    assert got == Counter(_bucket(r[4]) for r in rows)


@pytest.mark.parametrize("per_bucket", [False, True])
def test_series(frame, rows, per_bucket):
    got = {(r.bucket, r.parent, r["count"]) for r in R.series_over_time(frame, "1 hour", "parent", 2, per_bucket=per_bucket).collect()}
    cells = Counter((_bucket(r[4]), r[1]) for r in rows if r[1])
    if per_bucket:
        by_bucket = defaultdict(dict)
        for (b, p), n in cells.items():
            by_bucket[b][p] = n
        want = {(b, p, n) for b, ps in by_bucket.items() for p, n in _ranked(ps, 2)}
    else:
        top = {p for p, _ in _ranked(Counter(r[1] for r in rows if r[1]), 2)}
        want = {(b, p, n) for (b, p), n in cells.items() if p in top}
    assert got == want


def test_distinct_counts(frame, rows):
    got = [(r.parent, r.n, r.d) for r in R.distinct_per_key(frame, "parent", "child", 10, ("n", "d")).collect()]
    totals = Counter(r[1] for r in rows if r[1])
    assert got == [(p, n, len({r[2] for r in rows if r[1] == p and r[2]})) for p, n in _ranked(totals, 10)]
    rough = R.distinct_per_key(frame, "parent", "child", 10, ("n", "d"), approximate=True).collect()
    assert [(r.parent, r.n, r.d) for r in rough] == got


def test_shares_are_of_the_whole_not_of_the_top(frame, rows):
    got = R.shares(frame, "parent", F.col("v"), 1, "total").collect()
    totals = Counter()
    for r in rows:
        totals[r[1]] += r[5] if r[1] else 0
    (key, best), = _ranked({k: v for k, v in totals.items() if k}, 1)
    assert [(r.parent, r.total) for r in got] == [(key, best)]
    assert got[0].share == pytest.approx(best / sum(totals.values()))


def test_percentiles_interpolate(frame, rows):
    got = {r.parent: (r.p50, r.p95) for r in R.exact_percentiles(frame.filter("parent is not null"), ["parent"], "v", {"p50": 0.5, "p95": 0.95}).collect()}
    for parent, (p50, p95) in got.items():
        values = sorted(r[5] for r in rows if r[1] == parent)
        for share, value in ((0.5, p50), (0.95, p95)):
            at = share * (len(values) - 1)
            low = values[int(at)]
            high = values[min(int(at) + 1, len(values) - 1)]
            assert value == pytest.approx(low + (high - low) * (at - int(at)))
    rough = R.exact_percentiles(frame, ["parent"], "v", {"p50": 0.5}, accuracy=10000).collect()
    assert len(rough) == len(got) + 1


@pytest.mark.parametrize("span, width", [(timedelta(hours=24), "30 minutes"), (timedelta(days=7), "3 hours"),
                                         (timedelta(minutes=15), "30 seconds"), (timedelta(days=4000), "30 days")])
def test_automatic_bar_width(span, width):
    assert R.auto_width(START, START + span) == width


def _final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_rankings_scan_their_source_once(spark, frame, tmp_path):
    path = str(tmp_path / "rows")
    frame.write.parquet(path)
    stored = spark.read.parquet(path)
    for df in (
        R.nested_terms(stored, ["parent", "child"], [2, 2]),
        R.nested_terms_of_list(stored, "parent", F.col("names"), "name", (2, 2), "-"),
        R.series_over_time(stored, "1 hour", "parent", 2),
    ):
        plan = _final_plan(df)
        assert plan.count("FileScan") == 1 and "ReusedExchange" in plan


def test_ranked_percentile_equals_the_exact_one(spark):
    import random

    from seekledger.operators.selection import ranked_percentile

    r = random.Random(5)
    rows = [("hot", r.choice([r.random() * 1e6, 7.5])) for _ in range(4000)] + [("one", 3.25), ("same", 2.0), ("same", 2.0), ("none", None)]
    rows += [("two", 1.0), ("two", 2.0)]
    frame = spark.createDataFrame(rows, "k string, v double").repartition(3)
    for p in (0.0, 0.3, 0.5, 0.95, 1.0):
        want = {r.k: r.x for r in R.exact_percentiles(frame, ["k"], "v", {"x": p}, digits=9).collect()}
        got = {r.k: r.x for r in ranked_percentile(frame, ["k"], "v", p, "x", bins=50).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_no_task_orders_more_than_the_limit(spark):
    """Outliers, a heavy tail, a spike and near-equal values: brackets narrow however the values lie."""
    import random

    from seekledger.operators.selection import percentile_brackets, ranked_percentile, value_counts

    r = random.Random(7)
    rows = [("outlier", r.random()) for _ in range(6000)] + [("outlier", 1e300), ("outlier", -1e18)]
    rows += [("tail", r.paretovariate(0.2)) for _ in range(5000)]
    rows += [("spike", r.choice([5.0, 5.0, 5.0, r.random() * 10])) for _ in range(5000)]
    rows += [("close", 1.0 + k * 2.0**-50) for k in range(4000)] + [("few", 1.0), ("few", 9.0), (None, 3.0)]
    frame = spark.createDataFrame(rows, "k string, v double").repartition(4)
    for p in (0.01, 0.5, 0.75, 0.999):
        want = {x.k: x.x for x in R.exact_percentiles(frame.filter("k IS NOT NULL"), ["k"], "v", {"x": p}, digits=None).collect()}
        got = {x.k: x.x for x in ranked_percentile(frame, ["k"], "v", p, "x", bins=16, limit=100).collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-9) for k in want)
        brackets = percentile_brackets(value_counts(frame, ["k"], "v"), ["k"], p, bins=16, limit=100).collect()
        assert len(brackets) == 5 and all(b._apart or b._values <= 100 for b in brackets)


def test_usage_stats_scan_once(spark, tmp_path):
    from seekledger.plans.architecture import usage_stats
    from seekledger.schemas import USAGE_EVENTS

    spark.createDataFrame([], USAGE_EVENTS).write.parquet(str(tmp_path / "e"))
    stats = usage_stats(spark.read.schema(USAGE_EVENTS).parquet(str(tmp_path / "e")))
    stats.collect()
    plan = stats._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    assert final.count("Scan parquet") <= 1 or "ReusedExchange" in final

