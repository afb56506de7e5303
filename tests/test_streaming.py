"""The stream gives the events of the batch; redeliveries count once; buckets close with the watermark."""

from __future__ import annotations

import json
from datetime import datetime, timedelta

import pytest

from seekledger.plans.events import build_usage_events
from seekledger.schemas import REQUEST_LOG, USAGE_EVENTS
from seekledger.streaming import ingest as L

START = datetime(2026, 1, 1)


def _row(at, minutes):
    body = json.dumps({"query": {"bool": {"filter": [{"term": {f"f{at % 5}": at}}]}}})
    return (at, START + timedelta(minutes=minutes), "POST", f"/i{at % 3}/_search", body, 200, 1.0, None, "ip", "ua", 1)


@pytest.fixture()
def source(spark, tmp_path):
    path = str(tmp_path / "requests")
    for part in range(3):
        rows = [_row(part * 20 + at, part * 20 + at) for at in range(20)]
        spark.createDataFrame(rows, REQUEST_LOG).coalesce(1).write.mode("append").parquet(path)
    return path


@pytest.fixture()
def groups(spark):
    return spark.createDataFrame([("i0", "g")], "index_name string, index_group string")


def _rows(frame):
    return sorted((tuple(r) for r in frame.drop("event_date", "run").collect()), key=lambda r: r[0])


def test_stream_equals_batch_and_resumes(spark, source, groups, tmp_path):
    sink, checkpoint = str(tmp_path / "sink"), str(tmp_path / "checkpoint")

    def run():
        stream = L.request_stream(spark, source, max_files=1)
        query = L.start_ingest(stream, groups, sink, checkpoint, interval=None)
        query.awaitTermination()
        return len(query.recentProgress)

    assert run() >= 3
    stored = spark.read.schema(USAGE_EVENTS).parquet(sink)
    batch = build_usage_events(spark.read.schema(REQUEST_LOG).parquet(source), groups)
    assert _rows(stored) == _rows(batch)
    spark.createDataFrame([_row(100, 100)], REQUEST_LOG).coalesce(1).write.mode("append").parquet(source)
    run()
    assert spark.read.schema(USAGE_EVENTS).parquet(sink).count() == 61


def test_event_expressions_are_built_once_for_all_batches(spark, source, groups, tmp_path, monkeypatch):
    built = []
    monkeypatch.setattr(L, "build_usage_events", lambda *args: built.append(1) or build_usage_events(*args))
    table = L.EventTable(spark, str(tmp_path / "table"))
    query = L.start_ingest(L.request_stream(spark, source, max_files=1), groups, table, str(tmp_path / "c"), interval=None)
    query.awaitTermination()
    assert len(query.recentProgress) >= 3 and len(built) == 1
    batch = build_usage_events(spark.read.schema(REQUEST_LOG).parquet(source), groups)
    assert _rows(table.read()) == _rows(batch)


@pytest.mark.parametrize("as_table", [False, True])
def test_large_batches_describe_each_body_once(spark, groups, tmp_path, as_table):
    path, checkpoint = str(tmp_path / "requests"), str(tmp_path / "checkpoint")
    for part in range(3):
        rows = [(at, START + timedelta(minutes=at), *_row(at % 4, 0)[2:]) for at in range(part * 20, part * 20 + 20)]
        spark.createDataFrame(rows + rows[-1:], REQUEST_LOG).coalesce(1).write.mode("append").parquet(path)
    sink = L.EventTable(spark, str(tmp_path / "table")) if as_table else str(tmp_path / "sink")
    stream = L.request_stream(spark, path, max_files=1)
    query = L.start_ingest(stream, (lambda: groups) if as_table else groups, sink, checkpoint, interval=None, once=True)
    query.awaitTermination()
    assert len(query.recentProgress) >= 3 and query.exception() is None
    batch = build_usage_events(spark.read.schema(REQUEST_LOG).parquet(path).dropDuplicates(["request_id"]), groups)
    got = sink.read() if as_table else spark.read.schema(USAGE_EVENTS).parquet(sink)
    assert _rows(got) == _rows(batch) and got.count() == 60
    # of the last batch only: its requests and its four different bodies
    kept = {p.name: spark.read.parquet(str(p)).count() for p in (tmp_path / "checkpoint-requests").iterdir()}
    assert kept["bodies"] == 4 and kept["rows"] <= 20 and len(kept) == 2


def test_redelivered_requests_count_once(spark, source, groups, tmp_path):
    rows = [_row(at, at) for at in range(40, 60)]
    spark.createDataFrame(rows, REQUEST_LOG).coalesce(1).write.mode("append").parquet(source)
    sink = str(tmp_path / "sink")
    stream = L.request_stream(spark, source)
    L.start_ingest(stream, groups, sink, str(tmp_path / "checkpoint"), interval=None).awaitTermination()
    assert spark.read.schema(USAGE_EVENTS).parquet(sink).count() == 60


def test_an_index_joins_a_group_midway(spark, source, tmp_path):
    sink, maps = str(tmp_path / "sink"), []

    def group_map():
        maps.append(len(maps))
        rows = [("i0", "g")] + [("i1", "g")] * (len(maps) > 1)
        return spark.createDataFrame(rows, "index_name string, index_group string")

    L.start_ingest(L.request_stream(spark, source, max_files=1), group_map, sink, str(tmp_path / "checkpoint"), interval=None).awaitTermination()
    stored = spark.read.schema(USAGE_EVENTS).parquet(sink).filter("index = 'i1'")
    assert len(maps) >= 3 and {r.index_group for r in stored.collect()} == {"i1", "g"}


def test_open_buckets_are_counted_too(spark, source, groups, tmp_path):
    sink = str(tmp_path / "counts")
    events = build_usage_events(L.request_stream(spark, source, max_files=1), groups)
    L.start_counts(events, "10 minutes", sink, str(tmp_path / "checkpoint"), "index_group").awaitTermination()
    assert L.latest_counts(spark, sink, "index_group").agg({"count": "sum"}).first()[0] == 60


def test_buckets_are_final_behind_the_watermark(spark, source, groups, tmp_path):
    sink = str(tmp_path / "counts")
    events = build_usage_events(L.request_stream(spark, source), groups)
    counts = L.counts_over_time(events, "10 minutes", "index_group", lateness="5 minutes")
    query = (counts.writeStream.format("parquet").option("path", sink)
             .option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start())
    query.awaitTermination()
    stored = spark.read.schema(counts.schema).parquet(sink)
    # The newest event is at minute 59, so buckets up to minute 50 are closed.
    assert stored.agg({"count": "sum"}).first()[0] == 50
    assert stored.agg({"bucket": "max"}).first()[0] == START + timedelta(minutes=40)


def test_refresh_runs_after_new_events(spark, source, groups, tmp_path):
    seen = []
    events = build_usage_events(L.request_stream(spark, source), groups)
    query = L.start_refresh(events, str(tmp_path / "checkpoint"), seen.append, interval="1 second")
    query.processAllAvailable()
    query.stop()
    assert seen == [0]


def test_stream_into_an_event_table(spark, source, groups, tmp_path):
    from seekledger.operators.event_table import EventTable

    table, checkpoint = EventTable(spark, str(tmp_path / "table")), str(tmp_path / "checkpoint")
    stream = lambda: L.request_stream(spark, source, max_files=1)
    L.start_ingest(stream(), groups, table, checkpoint, interval=None, compact_at=2).awaitTermination()
    batch = build_usage_events(spark.read.schema(REQUEST_LOG).parquet(source), groups)
    assert _rows(table.read()) == _rows(batch)
    assert table.committed("ingest") >= 2 and all(len(x["paths"]) <= 2 for x in table.days().values())


def test_count_files_do_not_grow_with_batches(spark, groups, tmp_path):
    """Also events that come late, but within the lateness, and too late."""
    from pathlib import Path

    path, sink, checkpoint = str(tmp_path / "requests"), str(tmp_path / "counts"), str(tmp_path / "checkpoint")

    def feed(*minutes):
        rows = [_row(at, m) for at, m in enumerate(minutes)]
        spark.createDataFrame(rows, REQUEST_LOG).coalesce(1).write.mode("append").parquet(path)
        events = build_usage_events(L.request_stream(spark, path), groups)
        L.start_counts(events, "10 minutes", sink, checkpoint).awaitTermination()
        return {r.bucket: r["count"] for r in L.latest_counts(spark, sink).collect()}

    at = lambda m: START + timedelta(minutes=m)
    assert feed(1, 2, 15) == {at(0): 2, at(10): 1}
    assert feed(8, 18, 19) == {at(0): 3, at(10): 3}  # 8 is late, its bucket open
    assert feed(60) == {at(0): 3, at(10): 3, at(60): 1}
    for k in range(4):
        got = feed(3, 61 + k)  # 3 is too late by now
    assert got == {at(0): 3, at(10): 3, at(60): 5}
    live = L._count_table(spark, sink, None).parts()
    assert list(live) == ["2026-01-01"]
    assert len(list(Path(sink, live["2026-01-01"]).glob("*.parquet"))) <= 4


def _numbered(spark, path, n, parts):
    rows = [_row(at, at % 50) for at in range(n)]
    spark.createDataFrame(rows, REQUEST_LOG).repartition(parts).sortWithinPartitions("request_id").write.option("parquet.block.size", 4096).mode("append").parquet(path)


def test_batches_are_admitted_by_rows(spark, groups, tmp_path):
    from seekledger.streaming.rows import request_rows

    path, sizes, ids = str(tmp_path / "requests"), [], []
    _numbered(spark, path, 230, 3)

    def on_batch(batch, batch_id):
        found = [r.request_id for r in batch.select("request_id").collect()]
        sizes.append(len(found))
        ids.extend(found)

    def start(max_wait):
        stream = request_rows(spark, path, str(tmp_path / "log"), max_rows=50, max_wait=max_wait)
        return stream.writeStream.foreachBatch(on_batch).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(processingTime="0 seconds").start()

    query = start(0.0)
    query.processAllAvailable()
    query.stop()
    assert sizes == [50, 50, 50, 50, 30] and sorted(ids) == list(range(230))
    # a restart goes on where it was, in the middle of things, and new files come later
    _numbered(spark, path, 70, 2)
    query = start(0.0)
    query.processAllAvailable()
    query.stop()
    assert sizes[5:] == [50, 20] and sorted(ids[230:]) == list(range(70))


def test_a_short_batch_waits(spark, tmp_path):
    import time

    from seekledger.streaming.rows import RequestRowsReader

    path = str(tmp_path / "requests")
    _numbered(spark, path, 30, 1)
    reader = RequestRowsReader({"path": path, "log": str(tmp_path / "log"), "max_rows": "20", "max_wait": "0.3"}, REQUEST_LOG)
    assert reader.latestOffset() == {"rows": 20}
    assert reader.latestOffset() == {"rows": 20}
    time.sleep(0.4)
    assert reader.latestOffset() == {"rows": 30}
    assert reader.latestOffset() == {"rows": 30}
    parts = reader.partitions({"rows": 10}, {"rows": 25})
    got = [i for p in parts for b in reader.read(p) for i in b.column("request_id").to_pylist()]
    assert got == list(range(10, 25))


def test_rows_through_the_ingest(spark, groups, tmp_path):
    from seekledger.operators.event_table import EventTable
    from seekledger.streaming.rows import request_rows

    path, table = str(tmp_path / "requests"), EventTable(spark, str(tmp_path / "table"))
    _numbered(spark, path, 90, 2)
    stream = request_rows(spark, path, str(tmp_path / "log"), max_rows=40, max_wait=0.0)
    # the rows are not in the order of their times
    query = L.start_ingest(stream, groups, table, str(tmp_path / "checkpoint"), interval="0 seconds", window="2 hours")
    query.processAllAvailable()
    query.stop()
    batch = build_usage_events(spark.read.schema(REQUEST_LOG).parquet(path), groups)
    assert _rows(table.read()) == _rows(batch)


def test_sizes_of_all_batches_are_counted(spark, monkeypatch):
    """Also where a query remembers fewer batches than it had."""
    from catalogue import stored

    monkeypatch.setattr(stored, "BATCH_ROWS", 150)
    remembered = "spark.sql.streaming.numRecentProgressUpdates"
    spark.conf.set(remembered, "2")
    try:
        row = stored._by_rows(spark, "/root/testdata/sf0.001").first()
    finally:
        spark.conf.unset(remembered)
    assert (row.requests, row.largest_batch) == (spark.read.parquet("/root/testdata/sf0.001/events.parquet").count(), 150)


def test_a_reader_stops_behind_its_rows(spark, tmp_path, monkeypatch):
    from seekledger.streaming import rows

    path, looked = str(tmp_path / "requests"), []

    class File(rows.pq.ParquetFile):
        def iter_batches(self, **options):
            for batch in super().iter_batches(batch_size=10, **options):
                looked.append(batch.num_rows)
                yield batch

    frame = spark.createDataFrame([_row(at, at) for at in range(200)], REQUEST_LOG).coalesce(1).sortWithinPartitions("request_id")
    frame.write.parquet(path)
    monkeypatch.setattr(rows.pq, "ParquetFile", File)
    reader = rows.RequestRowsReader({"path": path, "log": str(tmp_path / "log"), "max_rows": "20"}, REQUEST_LOG)
    reader.latestOffset()
    (part,) = reader.partitions({"rows": 15}, {"rows": 35})
    assert [i for b in reader.read(part) for i in b.column("request_id").to_pylist()] == list(range(15, 35))
    assert sum(looked) == 40


def test_small_batches_leave_one_file_a_day(spark, groups, tmp_path):
    from pathlib import Path

    from seekledger.operators.event_table import EventTable
    from seekledger.streaming.rows import request_rows

    path, table, checkpoint = str(tmp_path / "requests"), EventTable(spark, str(tmp_path / "table")), tmp_path / "checkpoint"
    rows = [_row(at, at * 60) for at in range(90)] + [_row(7, 7 * 60)]
    spark.createDataFrame(rows, REQUEST_LOG).repartition(2).write.parquet(path)
    stream = request_rows(spark, path, str(tmp_path / "log"), max_rows=40, max_wait=0.0)
    query = L.start_ingest(stream, groups, table, str(checkpoint), interval="0 seconds", window="30 days", small=True)
    query.processAllAvailable()
    query.stop()
    batch = build_usage_events(spark.createDataFrame(rows[:-1], REQUEST_LOG), groups)
    assert _rows(table.read()) == _rows(batch)
    folders = [f for f in Path(tmp_path, "table", "data").glob("*/event_date=*")]
    assert len(folders) >= 4 and all(len(list(f.glob("*.parquet"))) == 1 for f in folders)
    # a prime below the four tasks that run at a time, and changes of the state only
    state = checkpoint / "state" / "0"
    assert sorted(f.name for f in state.iterdir() if f.name.isdigit()) == ["0", "1", "2"]
    assert list((state / "0").glob("*.changelog"))
    assert spark.conf.get("spark.sql.shuffle.partitions") == "4"
