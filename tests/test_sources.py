"""Input tables as files, and a profile built from them end to end."""

from __future__ import annotations

import json

import pytest

from seekledger.plans import architecture as A
from seekledger.plans.events import EventSettings
from seekledger.sources import cluster
from seekledger.sources.tables import read_input, unobserved_requests

GB = 10**9


def _lines(path, rows):
    path.write_text("\n".join(json.dumps(r) for r in rows))
    return str(path)


@pytest.fixture()
def folder(tmp_path):
    names = ["logs-1", "logs-2", ".sys"]
    _lines(tmp_path / "cat_indices", [
        {"index": n, "pri": "1", "docs.count": "5", "creation.date.string": f"2026-01-0{at + 1}T00:00:00.000Z"} for at, n in enumerate(names)])
    _lines(tmp_path / "cat_shards", [
        {"index": n, "shard": "0", "prirep": p, "state": "STARTED", "docs": "5", "store": str(60 * GB), "node": "n"} for n in names for p in "pr"])
    _lines(tmp_path / "settings", [
        {"index": "logs-1", "settings": {"index.number_of_replicas": "0"}},
        {"index": "logs-2", "settings": {"index.blocks.write": "true", "index.sort.field": '["ts"]'}}])
    _lines(tmp_path / "segments", [{"index": "logs-2", "primary_segments": 15}])
    _lines(tmp_path / "mappings", [{"index_name": n, "mapping_json": '{"properties":{"a":{"type":"keyword"}}}'} for n in names])
    return tmp_path


def _profile(spark, folder, with_segments):
    tables = {n: read_input(spark, n, str(folder / n), "json") for n in ("cat_indices", "cat_shards", "settings", "segments", "mappings")}
    groups = spark.createDataFrame([("logs-1", "logs"), ("logs-2", "logs"), (".sys", ".sys")], "index_name string, index_group string")
    usage = spark.createDataFrame([], "index_group string, lookback_p50_seconds double, lookback_p95_seconds double, "
                                      "dominant_sort_field string, dominant_sort_pct double, search_count long, write_count long")
    info = cluster.mapping_info(tables["mappings"], groups)
    segments = cluster.segment_counts(tables["segments"]) if with_segments else None
    return A.index_profile(groups, tables["cat_indices"], tables["cat_shards"], tables["settings"], info, usage, segments)


def test_profile_from_files(spark, folder):
    (row,) = _profile(spark, folder, True).collect()
    assert (row.index_group, row.index_count, row.primary_shard_count) == ("logs", 2, 2)
    assert (row.avg_primary_shard_size_bytes, row.total_primary_store_bytes) == (60 * GB, 120 * GB)
    assert (row.number_of_replicas, row.blocks_write, row.index_sort_field) == (1, True, ["ts"])
    assert (row.avg_segments_per_primary, row.estimated_rollover_hours, row.field_count) == (7, 24.0, 1)
    assert (row.search_count, row.source_enabled, row.translog_durability) == (0, True, "request")


def test_rules_without_segments_are_silent(spark, folder):
    def codes(with_segments):
        return sorted(r.recommendation for r in A.group_findings(_profile(spark, folder, with_segments)).collect())

    assert codes(True) == ["codec_opportunity", "force_merge_opportunity", "merge_policy_tuning", "shard_too_large"]
    assert codes(False) == ["codec_opportunity", "merge_policy_tuning", "shard_too_large"]


def test_unobserved_requests(spark, tmp_path):
    rows = [{"request_id": 1, "ts": "2026-01-01T00:00:00Z", "body": "x" * 50, "elapsed_ms": 1.0},
            {"request_id": 2, "body": "x" * 500, "elapsed_ms": 1.0}, {"request_id": 3, "body": "x" * 500}]
    requests = read_input(spark, "requests", _lines(tmp_path / "requests", rows), "json")
    assert tuple(unobserved_requests(requests, EventSettings(body_limit=100)).first()) == (1, 500)


def _walked(spark, *texts):
    rows = [(f"i{k}", t if isinstance(t, str) else json.dumps(t)) for k, t in enumerate(texts)]
    mappings = spark.createDataFrame(rows, "index_name string, mapping_json string")
    groups = mappings.selectExpr("index_name", "index_name AS index_group")
    found: dict[str, dict] = {}
    for r in cluster.mapping_fields(mappings, groups).collect():
        found.setdefault(r.index_group, {})[r.field_name] = (r.mapped_type, r.is_indexed, r.has_doc_values)
    info = {r.index_group: (r.field_count, r.source_enabled) for r in cluster.mapping_info(mappings, groups).collect()}
    return found, info


def test_mappings_of_any_depth_and_odd_names(spark):
    deep = {"type": "keyword"}
    for k in range(150):
        deep = {"properties": {f"o{k}": deep}}
    odd = {"properties": {"type": {"type": "long"}, "properties": {"properties": {"fields": {"type": "date", "fields": {"properties": {"type": "text"}}}}},
                          "a.b": {"type": "text", "fields": {"raw": {"type": "keyword", "fields": {"no": {"type": "keyword"}}}, "untyped": {}}}}}
    found, info = _walked(spark, deep, odd, {"mappings": odd, "other": 1})
    assert list(found["i0"]) == [".".join(f"o{k}" for k in reversed(range(150)))]
    want = {"type": ("long", True, True), "properties.fields": ("date", True, True), "properties.fields.properties": ("text", True, False),
            "a.b": ("text", True, False), "a.b.raw": ("keyword", True, True)}
    assert found["i1"] == found["i2"] == want and info["i1"] == info["i2"] == (5, True)


def test_switches_and_broken_mappings(spark):
    switches = [True, False, None, 0, 0.0, 1, 2.5, "", "false", [], {}]
    mapping = {"_source": {"enabled": False}, "properties": {f"f{k}": {"type": "keyword", "index": v, "doc_values": v} for k, v in enumerate(switches)}}
    mapping["properties"] |= {"list": [{"type": "x"}], "number": 3, "none": None, "typed": {"type": 7}, "blank": {"type": ""}, "text": {"type": "text", "doc_values": True}}
    found, info = _walked(spark, mapping, "no json", "[1, 2]", "{}", '{"properties": 3}', '{"properties": {"a": {"properties": []}}}')
    # lists and objects are no switches: on, as a value that is there
    for k, value in enumerate(switches[:9]):
        assert found["i0"][f"f{k}"][1:] == (bool(value), bool(value)), value
    assert found["i0"]["text"] == ("text", True, True)
    assert set(found["i0"]) == {f"f{k}" for k in range(11)} | {"text"} and set(found) == {"i0"}
    assert info["i0"] == (12, False) and info["i3"] == (0, True)
