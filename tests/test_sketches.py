"""Merged sketches stay within their stated errors, whatever the number of parts."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

from seekledger.operators.event_table import EventTable
from seekledger.plans import sketches as S
from seekledger.schemas import FIELD_CATEGORIES, USAGE_EVENTS

START = datetime(2026, 1, 1)


def test_estimates_of_a_window(spark, tmp_path):
    r = random.Random(4)
    rows = []
    for k in range(12_000):
        when = START + timedelta(minutes=r.randrange(60 * 72))
        row = dict.fromkeys(USAGE_EVENTS.fieldNames())
        row.update(request_id=k, timestamp=when, event_date=when.date(), index_group=r.choice("aab"), fields=tuple([] for _ in FIELD_CATEGORIES),
                   client_ip=f"10.{r.randrange(5000)}", query_template_hash=None if r.random() < 0.1 else f"t{r.randrange(40)}",
                   response_time_ms=r.lognormvariate(3, 2))
        rows.append(tuple(row[n] for n in USAGE_EVENTS.fieldNames()))
    events = spark.createDataFrame(rows, USAGE_EVENTS)
    table = EventTable(spark, str(tmp_path / "events"))
    for part in range(3):
        table.append(events.filter(f"request_id % 3 = {part}"), "s", part)
    partials = S.sketch_partials(table, str(tmp_path / "sketches"))
    assert partials.update() == ["2026-01-01", "2026-01-02", "2026-01-03"] and partials.update() == []
    since = START + timedelta(hours=9, minutes=20)
    names = USAGE_EVENTS.fieldNames()
    seen = 0
    for x in S.estimates(partials, since, {"p50": 0.5, "p95": 0.95}).collect():
        mine = [d for row in rows if (d := dict(zip(names, row)))["timestamp"] >= since and d["index_group"] == x.index_group]
        assert x.requests == len(mine)
        for name, column in S.DISTINCT.items():
            exact = len({d[column] for d in mine} - {None})
            assert abs(x[name] - exact) <= S.DISTINCT_ERROR * exact + 1
        times = sorted(d["response_time_ms"] for d in mine)
        for name, p in (("p50", 0.5), ("p95", 0.95)):
            rank = sum(t <= x[name] for t in times) / len(times)
            assert abs(rank - p) <= S.RANK_ERROR
        seen += 1
    assert seen == 2
