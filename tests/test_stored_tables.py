"""Versions, event tables, keyed tables, snapshots, partials: commits, conflicts, compaction, new days only."""

from __future__ import annotations

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from seekledger.operators import keyed_table as K
from seekledger.operators.event_table import EventTable
from seekledger.operators.snapshots import Snapshots
from seekledger.operators.versions import Conflict, Versions
from seekledger.plans import architecture as A
from seekledger.plans import mapping as M
from seekledger.plans.partials import field_partials, stats_partials
from seekledger.plans.refresh import SCHEMAS, refresh_usage
from seekledger.schemas import FIELD_CATEGORIES, USAGE_EVENTS


def _events(spark, rows):
    """rows: (id, group, time, fields, lookback)"""
    full = []
    for at, group, when, fields, lookback in rows:
        row = dict.fromkeys(USAGE_EVENTS.fieldNames())
        row.update(request_id=at, timestamp=when, event_date=when.date(), index_group=group, index=group, operation="search",
                   lookback_seconds=lookback, fields=tuple(fields.get(c, []) for c in FIELD_CATEGORIES))
        full.append(tuple(row[n] for n in USAGE_EVENTS.fieldNames()))
    return spark.createDataFrame(full, USAGE_EVENTS)


def _day(spark, day, ids, group="g", field="a"):
    return _events(spark, [(k, group, datetime(2026, 1, day, k % 24, k % 60), {"queried": [field], "sorted": ["s"]}, float(k % 3)) for k in ids])


def _ids(table, **kw):
    return sorted(r.request_id for r in table.read(**kw).select("request_id").collect())


def test_a_number_is_taken_once(spark, tmp_path):
    first, second = Versions(spark, str(tmp_path)), Versions(spark, str(tmp_path))
    assert first.newest() == (0, {})
    assert first.commit(0, {"a": 1}) == 1
    with pytest.raises(Conflict):
        second.commit(0, {"a": 2})
    assert second.newest() == (1, {"a": 1})
    assert second.change(lambda s: {"a": s["a"] + 1}) == {"a": 2} and first.newest() == (2, {"a": 2})


def test_old_states_are_cleared(spark, tmp_path):
    v = Versions(spark, str(tmp_path), kept=3)
    for k in range(8):
        v.commit(k, {"k": k})
    assert v._numbers() == [6, 7, 8] and v.newest() == (8, {"k": 7})


def test_a_state_is_read_once(spark, tmp_path):
    mine, other = Versions(spark, str(tmp_path)), Versions(spark, str(tmp_path))
    mine.commit(0, {"a": 1})
    assert other.newest() == (1, {"a": 1}) and other.newest() == (1, {"a": 1})
    # what a reader does to it stays its own, and what others write is seen
    other.newest()[1]["a"] = 5
    assert other.newest() == (1, {"a": 1})
    mine.commit(1, {"a": 2})
    assert other.newest() == (2, {"a": 2}) == mine.newest()
    text = other._seen[1]
    other._seen = other._seen[0], text.replace("2", "3")
    assert other.newest() == (2, {"a": 3})  # from memory
    (tmp_path / "_states" / "000000000002.json").write_text('{"a": 44}')
    (tmp_path / "_states" / ".000000000002.json.crc").unlink()
    assert other.newest() == (2, {"a": 44})  # another file


def test_change_meets_a_faster_writer(spark, tmp_path):
    mine, other = Versions(spark, str(tmp_path)), Versions(spark, str(tmp_path))
    seen = []

    def add(state):
        if not seen:
            other.change(lambda s: {"n": s.get("n", 0) + 10})
        seen.append(state.get("n", 0))
        return {"n": state.get("n", 0) + 1}

    assert mine.change(add) == {"n": 11} and seen == [0, 10]


def test_runs_appear_whole_and_count_once(spark, tmp_path):
    table = EventTable(spark, str(tmp_path / "events"))
    assert table.read().count() == 0
    assert table.append(_day(spark, 1, range(5)).unionByName(_day(spark, 2, range(5, 8))), "s", 0)
    # written, but not committed: as if the writer had died
    table._write(_day(spark, 1, range(100, 110)), "lost")
    assert _ids(table) == list(range(8))
    assert not table.append(_day(spark, 1, range(5)), "s", 0)
    assert table.append(_day(spark, 2, range(8, 10)), "s", 1)
    assert table.append(_day(spark, 2, [20]))
    assert _ids(table) == [*range(10), 20] and table.committed("s") == 1
    assert _ids(table, start=date(2026, 1, 2)) == [5, 6, 7, 8, 9, 20] and _ids(table, only=["2026-01-01"]) == list(range(5))
    table.clear()
    assert _ids(table) == [] and not table.append(_day(spark, 1, [1]), "s", 1)


def test_compaction_swaps_behind_the_readers(spark, tmp_path):
    table = EventTable(spark, str(tmp_path / "events"))
    for k in range(6):
        table.append(_day(spark, 1, [k]).unionByName(_day(spark, 2, [10 + k])), "s", k)
    table.append(_day(spark, 3, [30]))
    before, revisions = table.read(), {d: x["revision"] for d, x in table.days().items()}
    assert table.compact(most=5) == ["2026-01-01", "2026-01-02"]
    assert {d: len(x["paths"]) for d, x in table.days().items()} == {"2026-01-01": 1, "2026-01-02": 1, "2026-01-03": 1}
    assert {d: x["revision"] for d, x in table.days().items()} == revisions
    assert _ids(table) == sorted([*range(6), *range(10, 16), 30])
    assert before.count() == 13  # a reader that has begun goes on
    assert table.compact(most=5) == [] and not table.append(_day(spark, 1, [5]), "s", 5)


def test_an_append_during_compaction_stays(spark, tmp_path, monkeypatch):
    table = EventTable(spark, str(tmp_path / "events"))
    for k in range(3):
        table.append(_day(spark, 1, [k]), "s", k)
    write = EventTable._write

    def slow(self, events, name):
        out = write(self, events, name)
        if name == "compacted":
            monkeypatch.undo()
            EventTable(spark, str(tmp_path / "events")).append(_day(spark, 1, [50]), "t", 0)
        return out

    monkeypatch.setattr(EventTable, "_write", slow)
    table.compact(most=2)
    assert _ids(table) == [0, 1, 2, 50] and len(table.days()["2026-01-01"]["paths"]) == 2


def test_a_day_cleared_during_compaction_stays_cleared(spark, tmp_path, monkeypatch):
    table = EventTable(spark, str(tmp_path / "events"))
    for k in range(3):
        table.append(_day(spark, 1, [k]))
    write = EventTable._write

    def slow(self, events, name):
        out = write(self, events, name)
        self.clear()
        return out

    monkeypatch.setattr(EventTable, "_write", slow)
    with pytest.raises(Conflict):
        table.compact(most=2)
    assert table.read().count() == 0


def test_unused_folders_go(spark, tmp_path):
    table = EventTable(spark, str(tmp_path / "events"))
    for k in range(30):
        table.versions.change(lambda s: {**s, "touch": k})
    table.append(_day(spark, 1, [1]))
    table._write(_day(spark, 1, [2]), "lost")
    assert table.remove_unused(older_than_hours=1) == []
    gone = table.remove_unused(older_than_hours=-1)
    assert len(gone) == 1 and gone[0].startswith("run=lost") and _ids(table) == [1]


def _keyed(spark, path, **kw):
    return K.KeyedTable(spark, path, ["id"], "id long, name string, n long", **kw)


def test_only_touched_parts_are_written(spark, tmp_path):
    table = _keyed(spark, str(tmp_path), parts=16)
    table.merge(spark.range(200).selectExpr("id", "concat('n', id) AS name", "id AS n"))
    before = table.parts()
    rows = spark.createDataFrame([(5, "new", None), (1000, "added", 1), (None, "null key", 2)], "id long, name string, n long")
    touched = table.merge(rows, K.known_wins)
    after = table.parts()
    assert len(before) == 16 and 1 <= len(touched) <= 3
    assert {p for p in after if after[p] != before.get(p)} == set(touched)
    table.merge(rows.filter("id IS NULL"))
    got = {r.id: (r.name, r.n) for r in table.read().collect()}
    assert len(got) == 202 and got[5] == ("new", 5) and got[1000] == ("added", 1) and got[None] == ("null key", 2) and got[6] == ("n6", 6)


def test_a_merge_beaten_by_another_keeps_both(spark, tmp_path, monkeypatch):
    table, other = (_keyed(spark, str(tmp_path), parts=1) for _ in range(2))
    one = lambda k, name: spark.createDataFrame([(k, name, 0)], "id long, name string, n long")
    table.merge(one(1, "old"))
    write = K.KeyedTable._write

    def slow(self, rows):
        out = write(self, rows)
        monkeypatch.undo()
        other.merge(one(2, "other"))
        return out

    monkeypatch.setattr(K.KeyedTable, "_write", slow)
    table.merge(one(1, "mine"))
    assert {(r.id, r.name) for r in table.read().collect()} == {(1, "mine"), (2, "other")}


def test_a_repeated_batch_merges_once(spark, tmp_path):
    table = _keyed(spark, str(tmp_path), parts=4)
    added = lambda old, new: old + new if old is not None else new
    rows = spark.createDataFrame([(1, "a", 1)], "id long, name string, n long")
    combine = lambda old, new: F.coalesce(new, old)
    assert table.merge(rows, combine, "s", 0) and table.merge(rows, combine, "s", 0) == []
    assert added(1, 2) == 3 and table.read().count() == 1


def test_parts_with_odd_names(spark, tmp_path):
    table = _keyed(spark, str(tmp_path), part=F.col("name"))
    for n in (1, 2):
        table.merge(spark.createDataFrame([(1, "a:b/c", n), (2, "é =%", n)], "id long, name string, n long"))
    assert {(r.id, r.n) for r in table.read().collect()} == {(1, 2), (2, 2)}


def test_two_refreshes_at_once(spark, tmp_path, monkeypatch):
    schema = "index_group string, n int"
    both = [Snapshots(spark, str(tmp_path), {"t": spark.createDataFrame([], schema).schema}) for _ in range(2)]
    rows = lambda *r: spark.createDataFrame(list(r), schema)
    both[0].replace("t", rows(("a", 1), ("b", 1), ("c", 1)), rows(("a", 0), ("b", 0), ("c", 0)))
    commit = Versions.commit

    def late(self, base, state):
        monkeypatch.undo()
        both[1].replace("t", rows(("b", 2)), rows(("b", 0)))
        return commit(self, base, state)

    monkeypatch.setattr(Versions, "commit", late)
    both[0].replace("t", rows(("a", 2)), rows(("a", 0)))
    assert {tuple(r) for r in both[1].read("t").collect()} == {("a", 2), ("b", 2), ("c", 1)}


def _same(a, b):
    names = sorted(a.columns)
    rows = [sorted((tuple(r) for r in x.select(names).collect()), key=repr) for x in (a, b)]
    return rows[0] == rows[1]


def test_windows_equal_the_whole_count(spark, tmp_path):
    table = EventTable(spark, str(tmp_path / "events"))
    fields, stats = field_partials(table, str(tmp_path / "fields")), stats_partials(table, str(tmp_path / "stats"))
    start = datetime(2026, 1, 2, 7, 30)

    def check(changed):
        assert fields.update() == stats.update() == changed
        recent = table.read().filter(F.col("timestamp") >= F.lit(start))
        assert _same(fields.window(start), M.field_usage(recent))
        assert _same(A.stats_of_cells(stats.window(start)), A.usage_stats(recent))

    check([])
    table.append(_day(spark, 1, range(40)).unionByName(_day(spark, 2, range(60))))
    check(["2026-01-01", "2026-01-02"])
    table.append(_day(spark, 3, range(30), "h", "b"), "s", 0)
    check(["2026-01-03"])
    table.append(_day(spark, 2, [7, 8], "h", "late"), "s", 1)  # late events
    table.append(_day(spark, 3, [1]), "s", 1)  # the batch again
    check(["2026-01-02"])
    table.compact(most=1)
    check([])
    start += timedelta(hours=15, minutes=30)  # the window moves on, to a whole hour
    check([])
    table.clear()
    check([])


def test_refresh_reads_new_days_only(spark, tmp_path):
    table = EventTable(spark, str(tmp_path / "events"))
    partials = field_partials(table, str(tmp_path / "partials"))
    snapshots = Snapshots(spark, str(tmp_path / "snapshots"), SCHEMAS)
    mapping = '{"properties":{"a":{"type":"keyword"},"b":{"type":"long"},"x":{"type":"keyword"}}}'
    mappings = spark.createDataFrame([("g", mapping), ("h", mapping)], "index_name string, mapping_json string")
    groups = spark.createDataFrame([("g", "g"), ("h", "h")], "index_name string, index_group string")
    for k, (day, group, field) in enumerate([(1, "g", "a"), (5, "h", "b"), (9, "g", "b"), (9, "g", "x")]):
        table.append(_day(spark, day, range(k * 10, k * 10 + 9), group, field), "s", k)
        now = datetime(2026, 1, day, 23)
        assert refresh_usage(partials, snapshots, mappings, groups, now) == [f"2026-01-{day:02d}"]
        from seekledger.sources.cluster import mapping_fields

        want = M.mapping_diff(mapping_fields(mappings, groups), M.field_usage(M.recent(table.read(), now)), now)
        assert _same(snapshots.read("mapping_diff"), want)
        assert _same(snapshots.read("mapping_recommendations"), M.mapping_recommendations(want, now))
