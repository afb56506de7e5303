"""Index groups, sinks, snapshots and the shared tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from seekledger.operators import groups as G
from seekledger.operators import tables as T
from seekledger.plans import mapping as M
from seekledger.plans.refresh import refresh_architecture, refresh_mapping
from seekledger.schemas import ALIASES, CAT_SHARDS, DATA_STREAMS, FIELD_CATEGORIES, USAGE_EVENTS
from test_advice import HEALTHY, PROFILE_SCHEMA

NAMES = "index_name string"


def _map(spark, indices, aliases=(), streams=()):
    frame = G.build_group_map(
        spark.createDataFrame([(i,) for i in indices], NAMES),
        spark.createDataFrame(list(aliases), ALIASES),
        spark.createDataFrame(list(streams), DATA_STREAMS),
    )
    return frame


def test_group_map_order_of_precedence(spark):
    frame = _map(
        spark,
        ["logs-1", "logs-2", "products", ".hidden", ".ds-metrics-1"],
        [("logs-1", "logs", 0), ("logs-1", "all", 1), ("logs-2", "b", 1), ("logs-2", "a", 2), (".hidden", "h", 0)],
        [("metrics", ".ds-metrics-1"), ("stream", "logs-2")],
    )
    got = {r.index_name: r.index_group for r in frame.collect()}
    assert got == {"logs-1": "logs", "logs-2": "stream", "products": "products", ".ds-metrics-1": "metrics"}
    listing = {tuple(r) for r in G.list_groups(frame).collect()}
    assert listing == {("logs", "logs-1"), ("stream", "logs-2"), ("products", "products"), ("metrics", ".ds-metrics-1")}


def test_resolve_falls_back_to_the_name(spark):
    groups = _map(spark, ["i"], [("i", "g", 0)])
    events = spark.createDataFrame([("i",), ("g",), ("other",), ("_unknown",)], "index string")
    got = {r["index"]: r.index_group for r in G.resolve_group(events, groups).collect()}
    assert got == {"i": "g", "g": "g", "other": "other", "_unknown": "_unknown"}


def _events(spark, rows):
    full = []
    for at, (group, day, fields) in enumerate(rows):
        row = dict.fromkeys(USAGE_EVENTS.fieldNames())
        when = datetime(2026, 1, day, 12)
        row.update(request_id=at, timestamp=when, event_date=when.date(), index_group=group, index=group, operation="search",
                   fields=tuple(fields.get(c, []) for c in FIELD_CATEGORIES))
        full.append(tuple(row[n] for n in USAGE_EVENTS.fieldNames()))
    return spark.createDataFrame(full, USAGE_EVENTS)


def test_append_clear_and_newest(spark, tmp_path):
    path = str(tmp_path / "events")
    events = _events(spark, [("a", 1, {}), ("a", 2, {}), ("b", 2, {})])
    T.append_events(events, path)
    T.append_events(events, path)
    stored = spark.read.schema(USAGE_EVENTS).parquet(path)
    assert stored.count() == 6
    assert stored.filter("event_date = '2026-01-02'").count() == 4
    assert [r.request_id for r in T.newest(stored, 2, "a").collect()] == [1, 1]
    assert T.newest(stored, 1000).count() == 6
    other = str(tmp_path / "cleared")
    T.append_events(events, other)
    T.clear_events(events, other)
    assert spark.read.schema(USAGE_EVENTS).parquet(other).count() == 0
    T.append_events(events, other)
    assert spark.read.schema(USAGE_EVENTS).parquet(other).filter("event_date = '2026-01-02'").count() == 2


def test_a_named_run_replaces_itself(spark, tmp_path):
    path = str(tmp_path / "events")
    events = _events(spark, [("a", 1, {}), ("a", 2, {}), ("b", 2, {})])
    for run in ("r1", "r2", "r1"):
        T.append_events(events, path, run=run)
    assert spark.read.schema(USAGE_EVENTS).parquet(path).count() == 6


def test_snapshots_keep_groups_that_were_not_processed(spark, tmp_path):
    schema = "index_group string, n int"
    old = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], schema)
    new = spark.createDataFrame([("a", 2), ("a", 3)], schema)
    processed = spark.createDataFrame([("a",), ("b",)], "index_group string")
    first = T.write_snapshot(old, str(tmp_path))
    second = T.write_snapshot(T.replace_groups(spark.read.parquet(first), new, processed), str(tmp_path))
    assert sorted(tuple(r) for r in spark.read.parquet(second).collect()) == [("a", 2), ("a", 3), ("c", 1)]
    assert spark.read.parquet(first).count() == 3


def test_tables_are_written_once_and_read_back(spark):
    built = []

    def build():
        built.append(1)
        return spark.range(3)

    assert T.written_once(spark, "test table", build).count() == 3
    assert T.written_once(spark, "test table", build).count() == 3
    assert built == [1]


def test_usage_window_and_diff(spark):
    now = datetime(2026, 1, 10, 12)
    events = _events(spark, [
        ("g", 10, {"queried": ["a"], "filtered": ["a"], "sourced": ["b"]}),
        ("g", 3, {"queried": ["a"], "written": ["c"]}),
        ("g", 2, {"queried": ["old"]}),
        ("other", 10, {"queried": ["d"]}),
    ])
    usage = M.field_usage(M.recent(events, now))
    fields = spark.createDataFrame(
        [("g", n, "keyword", True, True) for n in ("a", "b", "c", "d", "old")],
        "index_group string, field_name string, mapped_type string, is_indexed boolean, has_doc_values boolean",
    )
    rows = {r.field_name: r for r in M.mapping_diff(fields, usage, now).collect()}
    assert {n: r.classification for n, r in rows.items()} == {
        "a": "active", "b": "sourced_only", "c": "write_only", "d": "unused", "old": "unused"}
    assert (rows["a"].count_queried, rows["a"].count_filtered, rows["a"].total_references) == (2, 1, 3)
    assert rows["a"].last_seen == datetime(2026, 1, 10, 12) and rows["a"].last_seen_sorted is None
    assert rows["d"].last_seen is None
    wide = M.field_usage(M.recent(events, now, lookback_hours=24 * 30))
    assert wide.filter(F.col("field_name") == "old").count() == 1


def test_refresh_replaces_only_processed_groups(spark, tmp_path):
    now, later = datetime(2026, 1, 10, 12), datetime(2026, 1, 11, 12)
    events = _events(spark, [("g", 10, {"queried": ["a"]}), ("h", 10, {"written": ["b"]})])
    schema = "index_name string, mapping_json string"
    both = spark.createDataFrame(
        [("g", '{"properties":{"a":{"type":"keyword"},"x":{"type":"long"}}}'), ("h", '{"properties":{"b":{"type":"keyword"}}}')], schema)
    groups = spark.createDataFrame([("g", "g"), ("h", "h")], "index_name string, index_group string")
    first = refresh_mapping(events, both, groups, now, str(tmp_path))
    second = refresh_mapping(events, both.filter("index_name = 'g'"), groups, later, str(tmp_path), first)
    diff = {(r.index_group, r.field_name): r.timestamp for r in spark.read.parquet(second["mapping_diff"]).collect()}
    assert diff == {("g", "a"): later, ("g", "x"): later, ("h", "b"): now}
    advice = {(r.index_group, r.recommendation) for r in spark.read.parquet(second["mapping_recommendations"]).collect()}
    assert advice == {("g", "disable_doc_values"), ("g", "remove_field"), ("h", "disable_index")}


def test_refresh_of_findings_clears_what_is_mended(spark, tmp_path):
    shards = spark.createDataFrame([], CAT_SHARDS)
    names = [c.split()[0] for c in PROFILE_SCHEMA.split(", ")][1:]

    def profile(**changes):
        return spark.createDataFrame([("g", *[{**HEALTHY, **changes}[n] for n in names])], PROFILE_SCHEMA)

    first = refresh_architecture(profile(number_of_replicas=0), shards, datetime(2026, 1, 1), str(tmp_path))
    assert spark.read.parquet(first["index_recommendations"]).count() == 1
    second = refresh_architecture(profile(), shards, datetime(2026, 1, 2), str(tmp_path), first)
    assert spark.read.parquet(second["index_recommendations"]).count() == 0


def test_groups_as_of_the_time_of_a_row(spark):
    at = lambda d: datetime(2026, 1, d)
    read = [("i", "a", at(1)), ("i", "a", at(3)), ("i", "b", at(5)), ("i", "b", at(6)), ("i", "a", at(9)), ("j", "g", at(4))]
    intervals = G.group_intervals(spark.createDataFrame(read, "index_name string, index_group string, seen_at timestamp"))
    assert {tuple(r) for r in intervals.collect()} == {
        ("i", "a", None, at(5)), ("i", "b", at(5), at(9)), ("i", "a", at(9), None), ("j", "g", None, None)}
    rows = [(1, "i", datetime(2020, 1, 1)), (2, "i", at(5)), (3, "i", datetime(2026, 1, 4, 23, 59)), (4, "i", at(30)), (5, "j", at(1)), (6, "k", at(1))]
    events = spark.createDataFrame(rows, "id long, index string, ts timestamp")
    got = {r.id: r.index_group for r in G.resolve_group(events, intervals).collect()}
    assert got == {1: "a", 2: "b", 3: "a", 4: "a", 5: "g", 6: "k"}
    plain = G.resolve_group(events, intervals.drop("valid_from", "valid_to"))
    assert sorted(G.resolve_group(events, intervals).columns) == sorted(plain.columns)


def test_clear_empties_the_folder_that_holds_the_events(spark, tmp_path):
    path = str(tmp_path / "events")
    events = _events(spark, [("a", 1, {}), ("a", 2, {}), ("b", 2, {})])
    for run in ("r1", "r2"):
        T.append_events(events, path, run=run)
    T.clear_events(events, path)
    assert spark.read.schema(USAGE_EVENTS).parquet(path).count() == 0
    T.append_events(events, path, run="r1")
    assert spark.read.schema(USAGE_EVENTS).parquet(path).count() == 3
