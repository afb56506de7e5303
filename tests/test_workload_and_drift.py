"""Writes and drift against brute force."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest

from seekledger.plans import drift as J
from seekledger.plans import stress as S
from seekledger.plans import workload as W


@pytest.fixture(scope="module")
def changes():
    rng = random.Random(3)
    rows = []
    for at in range(300):
        key = 1 if at % 3 == 0 else rng.randint(1, 20)
        rows.append((key, rng.choice([None, "a", "b"]), rng.choice([None, 1, 2, 3]), at))
    return rows


def test_partial_update_takes_the_latest_value_of_each_column(spark, changes):
    target = spark.createDataFrame([(k, "t", 0) for k in range(1, 26)], "id int, name string, n int")
    updates = spark.createDataFrame(changes, "id int, name string, n int, at int").repartition(4)
    want = {k: ["t", 0] for k in range(1, 26)}
    for key, name, n, _ in changes:
        want[key][0] = name if name is not None else want[key][0]
        want[key][1] = n if n is not None else want[key][1]
    got = {r.id: [r.name, r.n] for r in W.partial_update(target, updates, "id", ["at"]).collect()}
    assert got == want


def test_upsert_replaces_whole_rows(spark, changes):
    target = spark.createDataFrame([(k, "t", 0) for k in range(15, 26)], "id int, name string, n int")
    documents = spark.createDataFrame(changes, "id int, name string, n int, at int").repartition(4)
    want = {k: ("t", 0) for k in range(15, 26)} | {k: (name, n) for k, name, n, _ in changes}
    got = {r.id: (r.name, r.n) for r in W.upsert(target, documents, "id", ["at"]).collect()}
    assert got == want
    assert W.append(target, target).count() == 22


def test_match_is_by_whole_lower_cased_token(spark):
    frame = spark.createDataFrame([(1, "Smart-Home KIT"), (2, "smarter"), (3, None)], "id int, t string")
    assert [r.id for r in W.search_text(frame, "t", "SMART", ["id"], "id", 10).collect()] == [1]


def test_template_and_field_drift(spark):
    split = datetime(2024, 1, 10)
    rows = []
    for at, (template, field, hours) in enumerate([("t1", "a", -5), ("t1", "a", 5), ("t2", "b", -1), ("t3", "c", 2), ("t4", "d", -30), (None, "a", 1)]):
        when = split + timedelta(hours=hours)
        rows.append((at, "g", template, when, when.date(), ([field], [], [], [], [], [])))
    fields = ", ".join(f"{c}: array<string>" for c in ("queried", "filtered", "aggregated", "sorted", "sourced", "written"))
    events = spark.createDataFrame(
        rows, f"request_id long, index_group string, query_template_hash string, timestamp timestamp, event_date date, fields struct<{fields}>")
    windows = J.two_windows(events, split, 24)
    assert {r.query_template_hash: r.state for r in J.template_drift(windows).collect()} == {"t1": "kept", "t2": "gone", "t3": "new"}
    assert [r.field for r in J.abandoned_fields(windows).collect()] == ["b"]


def test_operation_kinds(spark):
    cases = {("search", "POST"): "query", ("doc_get", "GET"): "query", ("doc_get", "DELETE"): "delete", ("bulk", "POST"): "insert",
             ("doc_write", "PUT"): "insert", ("update", "POST"): "update", ("update_by_query", "POST"): "update",
             ("delete_by_query", "POST"): "delete", ("other", "GET"): "other"}
    frame = spark.createDataFrame(list(cases), "operation string, http_method string")
    got = {(r.operation, r.http_method): r.kind for r in frame.withColumn("kind", S.operation_kind()).collect()}
    assert got == cases


def test_multi_field_gaps(spark):
    rows = [("a", "title"), ("a", "title.keyword"), ("b", "title"), ("b", "size"), ("c", "title"), ("c", "title.keyword")]
    fields = spark.createDataFrame(rows, "index_group string, field_name string")
    assert {tuple(r) for r in J.multi_field_gaps(fields).select("index_group", "field_name").collect()} == {("b", "title")}


def test_change_verdicts(spark):
    counts = ", ".join(f"count_{c} long" for c in ("queried", "filtered", "aggregated", "sorted", "sourced", "written"))
    usage = spark.createDataFrame([("g", "f", 2, 0, 3, 0, 1, 0)], f"index_group string, field_name string, {counts}")
    changes = spark.createDataFrame(
        [("g", "f", a) for a in (*J.BREAKS, "add_field")] + [("g", "idle", "remove_field")],
        "index_group string, field_name string, action string",
    )
    got = {(r.field_name, r.action): (r.breaking, r.broken_references) for r in J.change_verdicts(usage, changes).collect()}
    assert got["f", "remove_field"] == (True, 6) and got["f", "disable_doc_values"] == (True, 3)
    assert got["f", "disable_index"] == (True, 2) and got["f", "add_field"] == (False, 0) == got["idle", "remove_field"]
