"""Table schemas shared by the batch and streaming jobs."""

from __future__ import annotations

from pyspark.sql import types as T

FIELD_CATEGORIES = ("queried", "filtered", "aggregated", "sorted", "sourced", "written")


def _struct(*columns: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in columns])


_S, _L, _D, _B, _TS = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType(), T.TimestampType()

REQUEST_LOG = _struct(
    ("request_id", _L),
    ("ts", _TS),
    ("method", _S),
    ("path", _S),
    ("body", _S),
    ("status", T.IntegerType()),
    ("elapsed_ms", _D),
    ("client_id", _S),
    ("client_ip", _S),
    ("client_user_agent", _S),
    ("response_hits", _L),
)

FIELD_SETS = _struct(*[(c, T.ArrayType(_S)) for c in FIELD_CATEGORIES])

USAGE_EVENTS = _struct(
    ("request_id", _L),
    ("timestamp", _TS),
    ("cluster_id", _S),
    ("index", _S),
    ("index_group", _S),
    ("operation", _S),
    ("http_method", _S),
    ("path", _S),
    ("fields", FIELD_SETS),
    ("language", _S),
    ("query_fingerprint", _S),
    ("query_template_hash", _S),
    ("query_template_text", _S),
    ("response_time_ms", _D),
    ("response_status", T.IntegerType()),
    ("client_id", _S),
    ("client_ip", _S),
    ("client_user_agent", _S),
    ("lookback_seconds", _D),
    ("lookback_field", _S),
    ("lookback_label", _S),
    ("query_body", _S),
    ("response_hits", _L),
    ("query_type", _S),
    ("bulk_documents", T.IntegerType()),
    ("event_date", T.DateType()),
)

ALIASES = _struct(("index_name", _S), ("alias", _S), ("position", T.IntegerType()))
DATA_STREAMS = _struct(("data_stream", _S), ("index_name", _S))
GROUP_MAP = _struct(("index_name", _S), ("index_group", _S))

MAPPING_JSON = _struct(("index_name", _S), ("mapping_json", _S))
MAPPING_FIELDS = _struct(
    ("index_group", _S),
    ("field_name", _S),
    ("mapped_type", _S),
    ("is_indexed", _B),
    ("has_doc_values", _B),
)

MAPPING_DIFF = _struct(
    ("timestamp", _TS),
    ("index_group", _S),
    ("field_name", _S),
    ("mapped_type", _S),
    ("is_indexed", _B),
    ("has_doc_values", _B),
    ("total_references", _L),
    ("last_seen", _TS),
    ("classification", _S),
    *[(f"count_{c}", _L) for c in FIELD_CATEGORIES],
    *[(f"last_seen_{c}", _TS) for c in FIELD_CATEGORIES],
)

MAPPING_RECOMMENDATIONS = _struct(
    ("timestamp", _TS),
    ("index_group", _S),
    ("field_name", _S),
    ("mapped_type", _S),
    ("classification", _S),
    ("recommendation", _S),
    ("why", _S),
    ("how", _S),
    ("breaking_change", _B),
)

# Columns of the cluster's own listings arrive as text.
CAT_INDICES = _struct(
    *[
        (c, _S)
        for c in (
            "index",
            "health",
            "status",
            "pri",
            "rep",
            "docs.count",
            "store.size",
            "pri.store.size",
            "creation.date.string",
        )
    ]
)
CAT_SHARDS = _struct(*[(c, _S) for c in ("index", "shard", "prirep", "state", "docs", "store", "node")])
INDEX_SETTINGS = _struct(("index", _S), ("settings", T.MapType(_S, _S)))
SEGMENTS = _struct(("index", _S), ("primary_segments", _L))
MAPPING_INFO = _struct(("index", _S), ("field_count", T.IntegerType()), ("source_enabled", _B))

INDEX_RECOMMENDATIONS = _struct(
    ("timestamp", _TS),
    ("index_group", _S),
    ("category", _S),
    ("recommendation", _S),
    ("severity", _S),
    ("current_value", _S),
    ("why", _S),
    ("how", _S),
    ("reference_url", _S),
    ("breaking_change", _B),
)
