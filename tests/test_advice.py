"""Rules: one healthy row, one value changed per case, with values on both sides of each threshold."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from seekledger.functions import numbers as N
from seekledger.plans import architecture as A
from seekledger.plans import mapping as M
from seekledger.schemas import CAT_INDICES, CAT_SHARDS, FIELD_CATEGORIES, MAPPING_DIFF, USAGE_EVENTS
from seekledger.sources import cluster

NOW = datetime(2026, 1, 10)
GB = 10**9

# --- Mapping rules ---------------------------------------------------------------------------

ACTIVE = {"classification": "active"}
DIFF_CASES = {
    "active and healthy": ({**ACTIVE, "count_queried": 1, "count_sorted": 1}, []),
    "write only": ({"classification": "write_only"}, ["disable_index"]),
    "write only, columns left": ({"classification": "write_only", "is_indexed": False}, ["disable_index"]),
    "write only, nothing left": ({"classification": "write_only", "is_indexed": False, "has_doc_values": False}, []),
    "sourced only": ({"classification": "sourced_only"}, ["disable_index"]),
    "unused": ({"classification": "unused"}, ["remove_field"]),
    "unused sub-field": ({"classification": "unused", "field_name": "a.b.raw"}, ["remove_multifield"]),
    "never columnar": ({**ACTIVE, "count_filtered": 1}, ["disable_doc_values"]),
    "columnar by sort": ({**ACTIVE, "count_filtered": 1, "count_sorted": 1}, []),
    "columnar by aggregation": ({**ACTIVE, "count_queried": 1, "count_aggregated": 1}, []),
    "annotated text": ({**ACTIVE, "count_queried": 1, "mapped_type": "annotated_text"}, []),
    "text in filters": ({**ACTIVE, "count_filtered": 2, "mapped_type": "text"}, ["change_to_keyword", "disable_norms"]),
    "text in filters and sort": ({**ACTIVE, "count_filtered": 2, "count_sorted": 1, "mapped_type": "text"}, ["disable_norms"]),
    "text in both": ({**ACTIVE, "count_queried": 1, "count_filtered": 1, "mapped_type": "text"}, ["add_keyword_subfield"]),
    "text grouped": ({**ACTIVE, "count_queried": 1, "count_aggregated": 1, "mapped_type": "text"}, ["add_keyword_subfield"]),
    "text with sibling": ({**ACTIVE, "count_queried": 1, "count_filtered": 1, "mapped_type": "text", "field_name": "withkey"}, []),
    "text only queried": ({**ACTIVE, "count_queried": 1, "mapped_type": "text"}, []),
}


def _diff_row(group, **changes):
    row = {f.name: None for f in MAPPING_DIFF.fields}
    row.update({f"count_{c}": 0 for c in FIELD_CATEGORIES})
    row.update(timestamp=NOW, index_group=group, field_name="price", mapped_type="keyword", is_indexed=True,
               has_doc_values=True, total_references=1, classification="active", **{})
    row.update(changes)
    return tuple(row[f.name] for f in MAPPING_DIFF.fields)


@pytest.fixture(scope="module")
def advice(spark):
    rows = [_diff_row(name, **changes) for name, (changes, _) in DIFF_CASES.items()]
    # The sibling is in use, so it adds no advice of its own; one in another group does not count.
    healthy = {"count_queried": 1, "count_sorted": 1, "classification": "active"}
    rows.append(_diff_row("text with sibling", field_name="withkey.keyword", **healthy))
    rows.append(_diff_row("active and healthy", field_name="price.keyword", **healthy))
    frame = spark.createDataFrame(rows, MAPPING_DIFF)
    return M.mapping_recommendations(frame, NOW).collect()


@pytest.mark.parametrize("name", DIFF_CASES)
def test_mapping_rule(advice, name):
    assert sorted(r.recommendation for r in advice if r.index_group == name) == DIFF_CASES[name][1]


def test_advice_texts_are_filled(advice):
    assert all("{field}" not in r.how and "{type}" not in r.how and "{sub}" not in r.how for r in advice)
    sub = next(r for r in advice if r.recommendation == "remove_multifield")
    assert '"raw"' in sub.how and '"a.b"' in sub.how
    assert {r.recommendation for r in advice if r.breaking_change} == {"change_to_keyword"}


@pytest.mark.parametrize(
    "counts, want",
    [({}, "unused"), ({"queried": 1, "written": 5}, "active"), ({"sorted": 1}, "active"), ({"aggregated": 1}, "active"),
     ({"filtered": 1}, "active"), ({"sourced": 1, "written": 9}, "sourced_only"), ({"written": 1}, "write_only")],
)
def test_classification(spark, counts, want):
    columns = [F.lit(counts.get(c, 0)).alias(f"count_{c}") for c in FIELD_CATEGORIES]
    assert spark.range(1).select(*columns).select(M.classification()).first()[0] == want


def test_mapping_flattening_edges(spark):
    mapping = (
        '{"mappings": {"_source": {"enabled": false}, "properties": {"properties": {"type": "keyword"}, "o": {"properties": '
        '{"p": {"type": "text", "fields": {"raw": {"type": "keyword", "index": false}, "bad": {}}}}}, '
        '"off": {"type": "date", "index": false, "doc_values": false}, "n": {"type": "long", "index": null}, '
        '"text_value": {"type": "annotated_text", "index": "false"}, "junk": 5, '
        '"type": {"properties": {"type": {"type": "nested", "properties": {"leaf": {"type": "float"}}}}}}}}'
    )
    mappings = spark.createDataFrame([("i2", mapping), ("i1", mapping), ("z", '{"properties":{}}'), (".h", mapping)],
                                     "index_name string, mapping_json string")
    groups = spark.createDataFrame([("i1", "g"), ("i2", "g"), ("z", "empty"), (".h", ".h")], "index_name string, index_group string")
    got = {tuple(r)[1:] for r in cluster.mapping_fields(mappings, groups).collect()}
    assert got == {
        ("properties", "keyword", True, True), ("o.p", "text", True, False), ("o.p.raw", "keyword", False, True),
        ("off", "date", False, False), ("n", "long", False, True), ("text_value", "annotated_text", True, False),
        ("type.type", "nested", True, True), ("type.type.leaf", "float", True, True),
    }
    info = {r.index_group: (r.field_count, r.source_enabled) for r in cluster.mapping_info(mappings, groups).collect()}
    assert info == {"g": (8, False), "empty": (0, True)}


# --- Index rules -----------------------------------------------------------------------------

HEALTHY = {
    "primary_shard_count": 1, "avg_primary_shard_size_bytes": 20 * GB, "total_primary_store_bytes": 20 * GB,
    "number_of_replicas": 1, "tier_preference": "data_hot", "index_codec": None, "blocks_write": False,
    "refresh_interval": "30s", "index_sort_field": None, "total_fields_limit": 1000, "field_count": 50,
    "source_enabled": True, "estimated_rollover_hours": 24.0, "lookback_p95_seconds": 3600.0,
    "dominant_sort_field": None, "dominant_sort_pct": None, "search_count": 100, "write_count": 10,
    "translog_durability": "request", "avg_segments_per_primary": 2, "max_merged_segment": None,
    "max_docs_per_primary_shard": 1000,
}
PROFILE_SCHEMA = (
    "index_group string, primary_shard_count long, avg_primary_shard_size_bytes long, total_primary_store_bytes long, "
    "number_of_replicas long, tier_preference string, index_codec string, blocks_write boolean, refresh_interval string, "
    "index_sort_field array<string>, total_fields_limit long, field_count int, source_enabled boolean, "
    "estimated_rollover_hours double, lookback_p95_seconds double, dominant_sort_field string, dominant_sort_pct double, "
    "search_count long, write_count long, translog_durability string, avg_segments_per_primary long, "
    "max_merged_segment string, max_docs_per_primary_shard long"
)


def _avg(n):
    return {"avg_primary_shard_size_bytes": n, "total_primary_store_bytes": n}


SORT = {"dominant_sort_field": "ts", "dominant_sort_pct": 0.7}
PROFILE_CASES = [
    ({}, []),
    ({"primary_shard_count": 2, **_avg(GB - 1)}, [("shard_too_small", "warning", "2 primary shards x 1000MB avg = 1000MB total")]),
    ({"primary_shard_count": 2, **_avg(GB)}, []),
    ({"primary_shard_count": 1, **_avg(5)}, []),
    ({**_avg(50 * GB - 1)}, []),
    ({**_avg(50 * GB), "max_merged_segment": "10gb"}, [("shard_too_large", "warning", "1 primary shards averaging 50.0GB each")]),
    ({**_avg(100 * GB), "max_merged_segment": "10gb"}, [("shard_too_large", "warning", None)]),
    ({**_avg(100 * GB + 1), "max_merged_segment": "10gb"}, [("shard_too_large", "critical", None)]),
    ({"number_of_replicas": 0}, [("replica_risk", "warning", "0 replicas configured")]),
    ({"number_of_replicas": 0, "tier_preference": "data_frozen", "index_codec": "x"}, []),
    ({"number_of_replicas": 2, "tier_preference": "data_cold,data_hot", "index_codec": "x"},
     [("replica_waste", "info", "2 replica(s) on cold tier")]),
    ({"blocks_write": True}, [("codec_opportunity", "info", "Default codec (LZ4) on read-only index (20.0GB)")]),
    ({"tier_preference": "data_warm"}, [("codec_opportunity", "info", "Default codec (LZ4) on warm tier index (20.0GB)")]),
    ({"tier_preference": None}, []),
    ({"field_count": 799}, []),
    ({"field_count": 800}, [("field_count_near_limit", "warning", "800 fields mapped out of 1000 limit (80%)")]),
    ({"field_count": 950}, [("field_count_near_limit", "warning", None)]),
    ({"field_count": 951}, [("field_count_near_limit", "critical", None)]),
    ({"field_count": None}, []),
    ({"total_fields_limit": 0}, []),
    ({"source_enabled": False}, [("source_disabled", "critical", "_source: false")]),
    ({"lookback_p95_seconds": 48 * 3600.0}, []),
    ({"lookback_p95_seconds": 49 * 3600.0}, [("rollover_lookback_mismatch", "warning",
                                              "Rollover ~24h, p95 query lookback 2d (~2 indices per query)")]),
    ({"lookback_p95_seconds": 9e9, "estimated_rollover_hours": None}, []),
    ({"lookback_p95_seconds": None}, []),
    (SORT, [("index_sorting_opportunity", "info", "70% of sorted queries use 'ts', index is unsorted")]),
    ({**SORT, "dominant_sort_pct": 0.69}, []),
    ({**SORT, "index_sort_field": ["ts"]}, []),
    ({**SORT, "index_sort_field": []}, [("index_sorting_opportunity", "info", None)]),
    ({"write_count": 1000, "refresh_interval": None},
     [("refresh_interval_opportunity", "info", "Refresh: 1s (default) | Writes: 1,000/period | Searches: 100/period")]),
    ({"write_count": 1000, "refresh_interval": "1000ms"}, [("refresh_interval_opportunity", "info", None)]),
    ({"write_count": 999, "refresh_interval": "1s"}, []),
    ({"write_count": 1000, "refresh_interval": "30s"}, []),
    ({"write_count": 0, "search_count": 0, "refresh_interval": "1s"}, []),
    ({"translog_durability": "async"}, [("translog_async", "warning", "index.translog.durability = async")]),
    ({"blocks_write": True, "index_codec": "x", "avg_segments_per_primary": 6},
     [("force_merge_opportunity", "info", "Read-only index with ~6 segments/shard (1 primary shards, 20.0GB total)")]),
    ({"blocks_write": True, "index_codec": "x", "avg_segments_per_primary": 5}, []),
    ({**_avg(60 * GB)}, [("merge_policy_tuning", "info", "Avg shard size 60.0GB with max_merged_segment = 5gb (default)"),
                         ("shard_too_large", "warning", None)]),
    ({**_avg(60 * GB), "max_merged_segment": "5gb"}, [("merge_policy_tuning", "info", None), ("shard_too_large", "warning", None)]),
    ({**_avg(60 * GB), "max_merged_segment": "nonsense"}, [("merge_policy_tuning", "info", None), ("shard_too_large", "warning", None)]),
    ({"max_docs_per_primary_shard": 200_000_000}, []),
    ({"max_docs_per_primary_shard": 200_000_001}, [("shard_docs_limit", "warning", "Max docs per primary shard: 200M (1 primary shards)")]),
    ({"max_docs_per_primary_shard": 500_000_000}, [("shard_docs_limit", "warning", None)]),
    ({"max_docs_per_primary_shard": 500_000_001}, [("shard_docs_limit", "critical", None)]),
]


@pytest.fixture(scope="module")
def findings(spark):
    names = [c.split()[0] for c in PROFILE_SCHEMA.split(", ")][1:]
    rows = [(str(at), *[{**HEALTHY, **changes}[n] for n in names]) for at, (changes, _) in enumerate(PROFILE_CASES)]
    return A.group_findings(spark.createDataFrame(rows, PROFILE_SCHEMA)).collect()


@pytest.mark.parametrize("at", range(len(PROFILE_CASES)))
def test_index_rule(findings, at):
    want = PROFILE_CASES[at][1]
    got = sorted((r.recommendation, r.severity, r.current_value) for r in findings if r.index_group == str(at))
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert all(w[2] in (None, g[2]) for g, w in zip(got, want))


def test_finding_texts_are_filled(findings):
    assert all("{" not in r.current_value and "{" not in r.why for r in findings)


def test_node_counts(spark):
    def rows(node, n, state="STARTED"):
        return [("i", str(k), "p", state, "1", "1", node) for k in range(n)]

    shards = spark.createDataFrame(
        rows("a", 1000) + rows("b", 1001) + rows("c", 1501) + rows("d", 2000, "UNASSIGNED") + rows(None, 2000), CAT_SHARDS
    )
    got = {r.current_value: (r.index_group, r.severity) for r in A.node_findings(shards).collect()}
    assert got == {"Node 'b' has 1,001 shards": ("_cluster", "warning"), "Node 'c' has 1,501 shards": ("_cluster", "critical")}


def test_shard_stats_count_started_primaries_only(spark):
    rows = [("i", "0", "p", "STARTED", "10", "5000000000", "n"), ("i", "1", "p", "STARTED", "bad", "3000000000", "n"),
            ("i", "0", "r", "STARTED", "99", "9", "n"), ("i", "2", "p", "INITIALIZING", "99", "9", "n"),
            ("unknown", "0", "p", "STARTED", "1", "1", "n"), (".sys", "0", "p", "STARTED", "1", "1", "n")]
    groups = spark.createDataFrame([("i", "g"), (".sys", "s")], "index_name string, index_group string")
    (row,) = A.shard_stats(spark.createDataFrame(rows, CAT_SHARDS), groups).collect()
    assert (row.primary_shard_count, row.total_primary_store_bytes, row.avg_primary_shard_size_bytes) == (2, 8 * GB, 4 * GB)
    assert row.max_docs_per_primary_shard == 10


def test_rollover_is_the_median_positive_gap(spark):
    dates = ["2026-01-01T00:00:00.000Z", "2026-01-02T00:00:00.000Z", "2026-01-02T00:00:00.000Z", "2026-01-04T00:00:00Z", "bad", None]
    rows = [(f"i{at}", *[None] * 7, d) for at, d in enumerate(dates)] + [("lone", *[None] * 7, dates[0])]
    groups = [(f"i{at}", "g") for at in range(len(dates))] + [("lone", "l")]
    frame = spark.createDataFrame(groups, "index_name string, index_group string")
    got = A.rollover_hours(spark.createDataFrame(rows, CAT_INDICES), frame).collect()
    assert [(r.index_group, r.estimated_rollover_hours) for r in got] == [("g", 36.0)]


def test_usage_stats_quirks(spark):
    def event(op, sorts=(), lookback=None, group="g"):
        row = dict.fromkeys(USAGE_EVENTS.fieldNames())
        row.update(operation=op, index_group=group, lookback_seconds=lookback, timestamp=NOW,
                   fields=tuple(list(sorts) if c == "sorted" else [] for c in FIELD_CATEGORIES))
        return tuple(row[n] for n in USAGE_EVENTS.fieldNames())

    rows = [event("search", ["b", "a"], 0.0), event("count", ["b"]), event("msearch", ["a"]), event("bulk"), event("update"),
            event("doc_write"), event("search", group="plain", lookback=60.0), event("async_search", group="plain", lookback=120.0)]
    frame = spark.createDataFrame(rows, USAGE_EVENTS)
    got = {r.index_group: r for r in A.usage_stats(frame).collect()}
    assert (got["g"].dominant_sort_field, got["g"].dominant_sort_pct) == ("a", pytest.approx(2 / 3))
    assert (got["g"].search_count, got["g"].write_count) == (2, 2)
    assert got["g"].lookback_p50_seconds is None and got["plain"].lookback_p50_seconds == 90.0
    assert got["plain"].dominant_sort_field is None
    with_writes = {r.index_group: r.write_count for r in A.usage_stats(frame, include_doc_write=True).collect()}
    assert with_writes["g"] == 3


@pytest.mark.parametrize("text, want", [("5gb", 5 * GB), (" 512 MB ", 512 * 10**6), ("1.5k", 1500), ("7", 7), ("7b", 7), ("2t", 2 * 10**12),
                                        ("", None), ("gb", None), ("abc", None), (None, None), ("nan", None)])
def test_byte_counts(spark, text, want):
    row = spark.createDataFrame([(text,)], "t string").select(N.byte_count(F.col("t"))).first()
    assert row[0] == want


def test_number_helpers(spark):
    frame = spark.createDataFrame([("12", 1234567890), (" 7 ", 2_500_000), ("1.5", 999), ("x", 0), (None, 0)], "t string, n long")
    got = frame.select(N.safe_int(F.col("t"), 9), N.byte_label(F.col("n")), N.safe_float(F.col("t"), -1.0)).collect()
    assert [tuple(r) for r in got] == [(12, "1.2GB", 12.0), (7, "2MB", 7.0), (9, "1KB", 1.5), (9, "0KB", -1.0), (9, "0KB", -1.0)]
