"""Field extraction goldens: literal requests and the event each must give, run as one job."""

from __future__ import annotations

import json
import time
from datetime import datetime

import pytest

from seekledger.operators.tables import kept
from seekledger.plans import events as E
from seekledger.plans.events import EventSettings, build_usage_events, rejected_requests, traffic_counters
from seekledger.schemas import FIELD_CATEGORIES, REQUEST_LOG

SEARCH = ("POST", "/x/_search")


def search(body, **want):
    return (*SEARCH, json.dumps(body), want)


def _filter(clause):
    return {"query": {"bool": {"filter": clause}}}


LEAVES = ("match", "match_phrase", "match_phrase_prefix", "term", "terms", "range", "wildcard", "prefix", "fuzzy", "regexp")
METRICS = ("avg", "sum", "min", "max", "cardinality", "value_count", "stats", "extended_stats", "percentiles",
           "percentile_ranks", "median_absolute_deviation", "top_hits")
BUCKETS = ("terms", "date_histogram", "histogram", "range", "date_range", "filter", "filters", "significant_terms",
           "composite", "auto_date_histogram")
DOC = "doc['price'].value * doc[\"qty\"].value + ctx._source.rank_1 - doc['_score']"

CASES = {
    **{f"leaf {q}": search({"query": {q: {"f": {"x": 1}, "_id": 1}}}, queried=["f"]) for q in LEAVES},
    **{f"filtered {q}": search(_filter([{q: {"f": "v"}}]), filtered=["f"]) for q in LEAVES},
    **{f"aggregation {a}": search({"aggs": {"n": {a: {"field": "f"}}}}, aggregated=["f"]) for a in (*METRICS, *BUCKETS)},
    "unknown query": search({"query": {"geo_thing": {"f": 1}}}),
    "option keys count": search({"query": {"terms": {"f": [1], "boost": 2}}}, queried=["boost", "f"]),
    "empty leaf body": search({"query": {"term": {"f": {}}}}, queried=["f"]),
    "leaf with a list": search({"query": {"term": ["f"]}}),
    "exists": search({"query": {"exists": {"field": "f"}}}, queried=["f"]),
    "exists of internal": search({"query": {"exists": {"field": "_id"}}}),
    "exists without text": search({"query": {"exists": {"field": 3}}}),
    "exists of nothing": search({"query": {"exists": {"field": ""}}}),
    "multi match": search({"query": {"multi_match": {"fields": ["a^2", "b^1.5", "c", "_d", 5, "e^x"]}}},
                          queried=["a", "b", "c", "e^x"]),
    "multi match of one": search({"query": {"multi_match": {"fields": "title^3"}}}, queried=["title"]),
    "multi match filtered": search(_filter({"multi_match": {"fields": ["a"]}}), filtered=["a"]),
    "bool clauses": search(
        {"query": {"bool": {"must": {"match": {"a": 1}}, "should": [{"match": {"b": 1}}],
                            "must_not": [{"match": {"c": 1}}], "filter": {"match": {"d": 1}}, "other": {"match": {"e": 1}}}}},
        queried=["a", "b", "c"], filtered=["d"]),
    "bool below filter": search(_filter([{"bool": {"must": [{"term": {"a": 1}}], "should": {"bool": {"must_not": {"term": {"b": 1}}}}}}]),
                                filtered=["a", "b"]),
    "filter below must": search({"query": {"bool": {"must": [{"bool": {"filter": [{"term": {"a": 1}}]}}]}}}, filtered=["a"]),
    "list in a clause list": search({"query": {"bool": {"must": [[{"term": {"a": 1}}]]}}}),
    "nested": search({"query": {"nested": {"path": "p", "query": {"match": {"p.a": 1}}}}}, queried=["p.a"]),
    "nested filtered": search(_filter({"nested": {"query": {"term": {"p.a": 1}}}}), filtered=["p.a"]),
    "deep nesting": search(
        {"query": {"bool": {"must": [{"nested": {"query": {"bool": {"must": [{"nested": {"query": {"term": {"a": 1}}}}]}}}}]}}},
        queried=["a"]),
    "function score": search(
        {"query": {"function_score": {"query": {"match": {"t": 1}}, "functions": [
            {"script_score": {"script": {"source": DOC}}}, {"field_value_factor": {"field": "pop"}},
            {"gauss": {"loc": {}}}, {"linear": {"age": {}}}, {"exp": {"day": {}}}, "junk"]}}},
        queried=["age", "day", "loc", "pop", "price", "qty", "rank_1", "t"], language="dsl+painless"),
    "function score filtered": search(
        _filter({"function_score": {"query": {"term": {"t": 1}}, "functions": [
            {"script_score": {"script": "doc['z'].value"}}]}}),
        filtered=["t", "z"], language="dsl+painless"),
    "functions as object": search({"query": {"function_score": {"functions": {"gauss": {"a": {}}}}}}),
    "sub aggregations": search(
        {"aggregations": {"a": {"terms": {"field": "x"}, "aggs": {"aggs": {"avg": {"field": "y"}, "aggregations": {"c": {"max": {"field": "z"}}}}}}}},
        aggregated=["x", "y", "z"]),
    "composite": search(
        {"aggs": {"c": {"composite": {"sources": [{"s": {"terms": {"field": "a"}}}, {"t": {"date_histogram": {"field": "b"}}}, 4]}}}},
        aggregated=["a", "b"]),
    "filter aggregation": search({"aggs": {"f": {"filter": {"bool": {"must": [{"term": {"a": 1}}]}}, "aggs": {"m": {"avg": {"field": "b"}}}}}},
                                 filtered=["a"], aggregated=["b"]),
    "filters aggregation": search({"aggs": {"f": {"filters": {"filters": {"one": {"term": {"a": 1}}, "two": {"exists": {"field": "b"}}}}}}},
                                  filtered=["a", "b"]),
    "scripted aggregations": search(
        {"aggs": {"s": {"scripted_metric": {"init_script": "doc['a']", "map_script": {"source": "doc['b']"},
                                            "combine_script": "doc['c']", "reduce_script": "doc['d']", "params": "doc['no']"}},
                  "b": {"bucket_script": {"script": "doc['e'].value"}}, "t": {"bucket_selector": {"script": {"inline": "doc['f']"}}}}},
        aggregated=["a", "b", "c", "d", "e", "f"], language="dsl+painless"),
    "unknown aggregation": search({"aggs": {"n": {"weird": {"field": "f"}}}}),
    "sort list": search({"sort": ["a", {"b": "asc"}, {"c": {"order": "desc"}}, "_score", {"_doc": "asc"}, 7]}, sorted=["a", "b", "c"]),
    "sort object": search({"sort": {"a": "asc", "_script": {"script": "doc['no']"}}}, sorted=["a"]),
    "sort text": search({"sort": "a"}),
    "script sort": search({"sort": [{"_script": {"type": "number", "script": {"source": DOC}}}]},
                          sorted=["price", "qty", "rank_1"], language="dsl+painless"),
    "source list": search({"_source": ["a", "_id", "b.*", ""]}, sourced=["", "a", "b.*"]),
    "source object": search({"_source": {"includes": ["a"], "excludes": ["b"], "other": ["c"]}}, sourced=["a", "b"]),
    "source switch": search({"_source": False}),
    "source text": search({"_source": "a"}),
    "doc values and stored": search({"docvalue_fields": ["a", {"field": "b", "format": "x"}, {"field": ""}], "stored_fields": ["c"]},
                                    sourced=["a", "b", "c"]),
    "highlight": search({"highlight": {"fields": {"a": {}, "b": {"x": 1}}}}, queried=["a", "b"]),
    "highlight list": search({"highlight": {"fields": [{"a": {}}]}}),
    "suggest": search({"suggest": {"text": "t", "one": {"completion": {"field": "a"}}, "two": {"term": {"field": "b"}},
                                   "three": {"phrase": {"field": "c"}}, "four": {"other": {"field": "d"}}}}, queried=["a", "b", "c"]),
    "collapse and post filter": search({"collapse": {"field": "a"}, "post_filter": {"bool": {"must": [{"term": {"b": 1}}]}}},
                                       filtered=["a", "b"]),
    "script fields": search({"script_fields": {"p": {"script": {"source": "doc['a']", "lang": "painless"}},
                                               "m": {"script": {"source": "doc['no']", "lang": "mustache"}},
                                               "s": {"script": {"id": "stored"}}}}, sourced=["a"], language="dsl+painless"),
    "runtime mappings": search({"runtime_mappings": {"d": {"type": "keyword", "script": "emit(doc['a'].value)"}},
                                "aggs": {"n": {"terms": {"field": "d"}}}}, sourced=["a"], aggregated=["d"], language="dsl+painless"),
    "internal script reference": search({"script_fields": {"p": {"script": "doc['_score']"}}}),
    "odd characters": search({"query": {"term": {"a\x1db\x1e\x1f\x1a": 1, "ü\n": 1}}}, queried=["a\x1db\x1e\x1f\x1a", "ü\n"]),
    "widest lookback": search(
        {"query": {"bool": {"must": [{"range": {"a": {"gte": "now-1h"}}}], "filter": [{"range": {"b": {"gte": " now-7d "}}}]}}},
        queried=["a"], filtered=["b"], lookback=(604800.0, "b", "7d")),
    "first bound counts": search({"query": {"range": {"a": {"lt": "now-7d", "gt": "now-2m"}}}}, queried=["a"], lookback=(120.0, "a", "2m")),
    "bound order": search({"query": {"range": {"a": {"lte": "now-1w", "gte": "2026-01-01"}}}}, queried=["a"], lookback=(604800.0, "a", "1w")),
    "ties go to the first clause": search(
        {"query": {"bool": {"filter": {"range": {"f": {"gte": "now-60m"}}}, "must": [{"range": {"m": {"gte": "now-1h"}}}]}}},
        queried=["m"], filtered=["f"], lookback=(3600.0, "m", "1h")),
    "post filter lookback": search({"post_filter": {"range": {"a": {"gte": "now-30s"}}}}, filtered=["a"], lookback=(30.0, "a", "30s")),
    "no lookback": search({"query": {"range": {"a": {"gte": "2026-01-01", "lt": "now-1d/d"}, "b": {"gte": "now-1M"}, "c": {"gt": "now"}}}},
                          queried=["a", "b", "c"]),
    "aggregation filter has no lookback": search({"aggs": {"f": {"filter": {"range": {"a": {"gte": "now-1h"}}}}}}, filtered=["a"]),
    "count": ("POST", "/x/_count", '{"query":{"term":{"a":1}}}', {"queried": ["a"], "operation": "count"}),
    "update by query": ("POST", "/x/_update_by_query", '{"query":{"term":{"a":1}}}', {"queried": ["a"], "operation": "update_by_query"}),
    "delete by query": ("POST", "/x/_delete_by_query", '{"query":{"term":{"a":1}}}', {"queried": ["a"], "operation": "delete_by_query"}),
    "async search": ("POST", "/x/_async_search", '{"sort":["a"]}', {"sorted": ["a"], "operation": "async_search"}),
    "document write": ("PUT", "/x/_doc/1", '{"a":1,"b":{"c":1},"_id":1}', {"written": ["a", "b"], "operation": "doc_write"}),
    "document post": ("post", "/x/_doc", '{"a":1}', {"written": ["a"], "operation": "doc_write"}),
    "document read": ("GET", "/x/_doc/1", None, {"operation": "doc_get"}),
    "document delete": ("DELETE", "/x/_doc/1", None, {"operation": "doc_get"}),
    "update": ("POST", "/x/_update/1", '{"doc":{"a":1},"upsert":{"b":1},"script":"doc[1]"}', {"written": ["a", "b"], "operation": "update"}),
    "update by put": ("PUT", "/x/_update/1", '{"doc":{"a":1}}', {"operation": "update"}),
    "bulk": ("POST", "/_bulk", '{"index":{}}\n{"a":1}\n{"delete":{}}\n{"update":{}}\n{"doc":{"b":1}}\n',
             {"written": ["a", "b"], "operation": "bulk", "index": "_unknown"}),
    "multi search": ("POST", "/x/_msearch",
                     '{}\n{"query":{"range":{"a":{"gte":"now-1h"}}}}\n{}\n{"query":{"range":{"a":{"gte":"now-60m"}}},"aggs":{"n":{"avg":{"field":"b"}}}}\n',
                     {"queried": ["a"], "aggregated": ["b"], "operation": "msearch", "lookback": (3600.0, "a", "1h")}),
    "several indices": ("POST", "/ a , b/_search", '{"sort":["z"]}', {"sorted": ["z"], "index": "a"}),
    "known group": ("POST", "/logs-1/_search", "{}", {"index": "logs-1", "index_group": "logs"}),
    "no operation": ("GET", "/x", None, {"operation": "other"}),
    "root": ("GET", "/", None, {"operation": "other", "index": "_unknown"}),
    "bad json": ("POST", "/x/_search", "not json", {}),
    "json list": ("POST", "/x/_search", '[{"query":{"term":{"a":1}}}]', {}),
}
SKIPPED = (("GET", "/_cat/indices"), ("GET", "/_cluster/health"), ("GET", "/_nodes"), ("GET", "/_tasks"),
           ("GET", "/_gateway/x"), ("POST", "/.kibana/_search"), ("POST", "/a,.b/_search"))


def _row(at, method, path, body, ms=1.239):
    return (at, datetime(2026, 1, 1), method, path, body, 200, ms, "c", "ip", "ua", 5)


@pytest.fixture(scope="module")
def groups(spark):
    return spark.createDataFrame([("logs-1", "logs")], "index_name string, index_group string")


@pytest.fixture(scope="module")
def events(spark, groups):
    rows = [_row(at, m, p, b) for at, (m, p, b, _) in enumerate(CASES.values())]
    rows += [_row(1000 + at, m, p, None) for at, (m, p) in enumerate(SKIPPED)]
    requests = spark.createDataFrame(rows, REQUEST_LOG).repartition(4)
    return {r.request_id: r for r in build_usage_events(requests, groups).collect()}


@pytest.mark.parametrize("name", CASES)
def test_event(events, name):
    want = CASES[name][3]
    event = events[list(CASES).index(name)]
    got = {c: event.fields[c] for c in FIELD_CATEGORIES}
    assert got == {c: want.get(c, []) for c in FIELD_CATEGORIES}
    assert (event.lookback_seconds, event.lookback_field, event.lookback_label) == want.get("lookback", (None, None, None))
    assert event.language == want.get("language", "dsl")
    assert event.operation == want.get("operation", "search")
    assert event["index"] == want.get("index", "x")
    assert event.index_group == want.get("index_group", event["index"])
    assert event.response_time_ms == 1.24


def test_skipped_requests_leave_no_event(events):
    assert set(events) == set(range(len(CASES)))


def test_large_bodies_and_unanswered_requests_are_counted_apart(spark, groups):
    rows = [_row(1, *SEARCH, '{"sort":["a"]}'), _row(2, *SEARCH, "x" * 101), _row(3, *SEARCH, "{}", None), _row(4, "GET", "/_cat/x", None)]
    requests = spark.createDataFrame(rows, REQUEST_LOG)
    limits = EventSettings(body_limit=100)
    events = build_usage_events(requests, groups, limits)
    assert sorted(r.request_id for r in events.collect()) == [1, 2]
    counters = traffic_counters(requests, events, limits).first()
    assert (counters.requests_proxied, counters.requests_failed, counters.requests_unobserved) == (4, 1, 1)
    assert (counters.events_skipped, counters.events_emitted, counters.response_avg_ms) == (1, 2, 1.24)
    assert counters.extraction_errors == 0


def test_nothing_is_lost_by_size(spark, groups):
    filters = [{"term": {f"field{k}": "v" * 40}} for k in range(30_000)]
    rows = [_row(1, *SEARCH, json.dumps({"query": {"bool": {"filter": filters}}}))]
    event = build_usage_events(spark.createDataFrame(rows, REQUEST_LOG), groups).first()
    assert len(rows[0][4]) > 1 << 20 and len(event.fields.filtered) == 30_000
    assert event.query_body == rows[0][4] and len(event.query_template_text) > 500_000


def test_bodies_too_deep_to_parse_are_rejected(spark, groups):
    deep = lambda n: '{"query": ' + '{"bool": {"filter": ' * n + '{"term": {"deep": 1}}' + "}}" * n + "}"
    requests = spark.createDataFrame([_row(1, *SEARCH, deep(900)), _row(2, *SEARCH, deep(60_000))], REQUEST_LOG)
    events = build_usage_events(requests, groups).cache()
    assert [(r.request_id, r.fields.filtered) for r in events.collect()] == [(1, ["deep"])]
    assert events.first().query_template_hash is not None
    assert [r.request_id for r in rejected_requests(requests).collect()] == [2]
    counters = traffic_counters(requests, events).first()
    assert (counters.events_emitted, counters.extraction_errors) == (1, 1)


def test_lookback_of_many_ranges_is_linear(spark, groups):
    ranges = [{"range": {f"f{k}": {"gte": f"now-{k % 50 + 1}h"}}} for k in range(2_000)]
    rows = [_row(1, *SEARCH, json.dumps({"query": {"bool": {"filter": ranges}}}))]
    start = time.monotonic()
    event = build_usage_events(spark.createDataFrame(rows, REQUEST_LOG), groups).first()
    assert (event.lookback_seconds, event.lookback_field) == (50 * 3600, "f49")
    assert time.monotonic() - start < 60


def test_sampling_keeps_the_same_rows_and_clamps(spark, groups):
    requests = spark.createDataFrame([_row(at, *SEARCH, "{}") for at in range(2000)], REQUEST_LOG)

    def kept(rate, **options):
        events = build_usage_events(requests, groups, EventSettings(event_sample_rate=rate, **options))
        return {r.request_id: r.query_body for r in events.select("request_id", "query_body").collect()}

    assert len(kept(1.5)) == 2000 and kept(-1.0) == {}
    some = kept(0.3)
    assert some == kept(0.3) and 500 < len(some) < 700
    assert set(kept(1.0, store_bodies=False).values()) == {None}
    assert 0 < sum(b is None for b in kept(1.0, body_sample_rate=0.5).values()) < 2000


def test_a_body_crosses_into_python_once(spark, groups):
    requests = spark.createDataFrame([_row(1, *SEARCH, "{}")], REQUEST_LOG)
    for events in (build_usage_events(requests, groups), rejected_requests(requests)):
        plan = events._jdf.queryExecution().executedPlan().toString()
        assert plan.count("ArrowEvalPython") == 1


def test_each_different_body_of_a_log_is_described_once(spark, groups, monkeypatch):
    cases = [(m, p, b) for m, p, b, _ in CASES.values()]
    cases += [(*SEARCH, None), (*SEARCH, ""), ("POST", "/x/_bulk", "{}"), (*SEARCH, '{"query": ' + "[" * 60_000), ("GET", "/_cat/x", None)]
    rows = [_row(at, *case) for at, case in enumerate(cases * 3)]
    requests = spark.createDataFrame(rows, REQUEST_LOG).repartition(4)
    written = []
    monkeypatch.setattr(E, "kept", lambda table, name: written.append(kept(table, name)) or written[-1])
    for limits in (EventSettings(), EventSettings(body_limit=60, text_limit=10, event_sample_rate=0.7)):
        got = build_usage_events(requests, groups, limits, once=True).collect()
        want = build_usage_events(requests, groups, limits).collect()
        assert sorted(got, key=lambda r: r.request_id) == sorted(want, key=lambda r: r.request_id) != []
    assert written[0].count() <= len(cases) - 1
    monkeypatch.setattr(E, "BROADCAST_BYTES", 0)
    joined = build_usage_events(requests, groups, once=True)
    assert "SortMergeJoin" in joined._jdf.queryExecution().executedPlan().toString()
    assert joined.count() == build_usage_events(requests, groups).count()


def test_routes_of_odd_paths(spark):
    want = {
        "/x/_search": ("search", ["x"], "search", False), "x/_update/1": ("update", ["x"], "update", False),
        "//a , b//_doc": ("other", ["a", "b"], "none", False), "/x/__doc/1": ("doc_write", ["x"], "write", False),
        "/x": ("other", ["x"], "none", False), "/x/_": ("other", ["x"], "none", False), "": ("other", None, "none", False),
        "/ , ,/_search": ("other", None, "none", False), "/__bulk": ("bulk", None, "bulk", False), "/_": ("other", None, "none", False),
        "/a, .b/_count": ("count", ["a", ".b"], "search", True), "/_cat/.b": ("cat", None, "none", True),
        "/x/update POST": ("update POST", ["x"], "none", False), "/x/\n": ("\n", ["x"], "none", False), None: ("other", None, "none", None),
    }
    requests = spark.createDataFrame([_row(at, "POST", path, None) for at, path in enumerate(want)], REQUEST_LOG)
    routes = E.route(requests).select("path", "operation", "indices", "mode", "skipped").collect()
    assert {r.path: tuple(r[1:]) for r in routes if r.path is not None} == {p: w for p, w in want.items() if p is not None}
    assert [tuple(r[1:4]) for r in routes if r.path is None] == [want[None][:3]]
