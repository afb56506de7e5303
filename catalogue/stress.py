"""Registered stress and streaming queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogue.common import BUCKET_SQL, WIDTH, Query, stamp_sql
from catalogue.events_sql import with_events
from catalogue.usage import EVENT_COLUMNS, LISTS, terms_sql
from seekledger.operators.tables import new_place
from seekledger.plans import stress as S
from seekledger.plans.events import build_usage_events
from seekledger.samples import catalog as C
from seekledger.schemas import USAGE_EVENTS
from seekledger.streaming import ingest as L

_KIND = (
    "CASE WHEN operation IN ('doc_write', 'bulk') THEN 'insert' WHEN operation = 'update' THEN 'update' ELSE 'query' END"
)
_PAIRS = "(len(queried) + len(filtered) + len(aggregated) + len(sorted) + len(sourced) + len(written))"
SCORED_CTE = f"""kinds AS (SELECT *, {_KIND} AS operation_kind FROM ev),
scores AS (SELECT *, CASE WHEN operation_kind = 'query' THEN query_type WHEN operation = 'bulk' THEN 'bulk' ELSE 'single' END AS operation_type,
  CASE WHEN operation_kind = 'query' THEN 0.5 * (response_time_ms / 1000) + 0.3 * (response_hits / 10000) + 0.2 * ({_PAIRS} / 10)
    ELSE 0.4 * (response_time_ms / 1000) + 0.6 * ((CASE WHEN operation = 'bulk' THEN bulk_documents ELSE 1 END) / 100) END AS stress,
  coalesce(client_id, '{S.NO_APPLICATION}') AS application, coalesce(client_id, client_ip) AS application_or_host FROM kinds),
scored AS (SELECT *, CAST(round(stress * 1000000) AS BIGINT) AS stress_micro FROM scores)"""


def _scored(rollup, *args):
    return lambda spark, sf_dir: rollup(S.with_stress(C.usage_events(spark, sf_dir)), *args)


def _sql(select: str) -> str:
    return with_events(select, SCORED_CTE)


def _share_sql(key: str) -> str:
    return _sql(
        f"SELECT {key}, sum(stress_micro) / 1e6 AS stress, sum(stress_micro) / (SELECT sum(stress_micro) FROM scored "
        f"WHERE {key} IS NOT NULL) AS share FROM scored WHERE {key} IS NOT NULL GROUP BY 1 ORDER BY sum(stress_micro) DESC, 1 LIMIT 10"
    )


def _series_sql(key: str, amount: str, name: str, rank: str) -> str:
    return _sql(
        f"SELECT {BUCKET_SQL}, {key}, {amount} AS {name} FROM scored WHERE {key} IN (SELECT {key} FROM scored WHERE {key} IS NOT NULL "
        f"GROUP BY 1 ORDER BY {rank} DESC, 1 LIMIT 10) GROUP BY 1, 2"
    )


def _ingested(spark, sf_dir):
    """The request files as a stream, read back from the sink."""
    requests = L.request_stream(spark, C.requests_path(spark, sf_dir))
    sink = new_place(spark, "stream_events")
    query = L.start_ingest(requests, C.group_map(spark, sf_dir), sink, f"{sink}-checkpoint", interval=None, once=True)
    query.awaitTermination()
    events = spark.read.schema(USAGE_EVENTS).parquet(sink)
    return events.select("timestamp", *EVENT_COLUMNS, "fields.*")


def _counted(spark, sf_dir):
    requests = L.request_stream(spark, C.requests_path(spark, sf_dir))
    events = build_usage_events(requests, C.group_map(spark, sf_dir))
    sink = new_place(spark, "stream_counts")
    L.start_counts(events, WIDTH, sink, f"{sink}-checkpoint", "index_group").awaitTermination()
    return L.latest_counts(spark, sink, "index_group")


_EVENT_LIST = ", ".join(f'"{c}"' for c in EVENT_COLUMNS)
_KEYS = S.DIMENSIONS
_RATE_KEYS = {**_KEYS, "application": "application_or_host"}

QUERIES: dict[str, Query] = {
    "i01_stress_scores": Query(
        _scored(lambda df: df.select("request_id", "operation_kind", "operation_type", "stress_micro")),
        _sql("SELECT request_id, operation_kind, operation_type, stress_micro FROM scored"),
    ),
    "i02_kinds_and_types": Query(
        _scored(lambda df: df.groupBy("operation_kind", "operation_type").agg(F.count(F.lit(1)).alias("count"))),
        _sql("SELECT operation_kind, operation_type, count(*) AS count FROM scored GROUP BY 1, 2"),
    ),
    **{f"i03_stress_share_by_{d}": Query(_scored(S.stress_share, d), _share_sql(k)) for d, k in _KEYS.items()},
    **{
        f"i04_stress_over_time_by_{d}": Query(
            _scored(S.stress_over_time, d, WIDTH),
            _series_sql(k, "sum(stress_micro) / 1e6", "stress", "sum(stress_micro)"),
        )
        for d, k in _KEYS.items()
    },
    **{
        f"i05_executions_over_time_by_{d}": Query(
            _scored(S.executions_over_time, d, WIDTH), _series_sql(k, "count(*)", "count", "count(*)")
        )
        for d, k in _RATE_KEYS.items()
    },
    "i06_top_applications": Query(
        _scored(S.top_applications),
        _sql(
            terms_sql("application_or_host", 10, "sum(stress_micro) / 1e6 AS stress", "sum(stress_micro)", "scored")
        ),
    ),
    "i06_request_rate": Query(
        _scored(S.request_rate, WIDTH),
        _series_sql("application_or_host", "count(*) / 43200", "per_second", "count(*)"),
    ),
    "l01_stream_ingest": Query(
        _ingested,
        with_events(f"SELECT {stamp_sql(chr(34) + 'timestamp' + chr(34), 'timestamp')}, {_EVENT_LIST}, {LISTS} FROM ev"),
    ),
    "l06_stream_counts": Query(
        _counted,
        with_events(
            f"SELECT strftime(b, '%Y-%m-%d %H:%M:%S.%f') AS bucket, index_group, count(*) AS count FROM (SELECT index_group, "
            "time_bucket(INTERVAL '12 hours', \"timestamp\", TIMESTAMP '1970-01-01') AS b FROM ev) GROUP BY b, index_group"
        ),
    ),
}
