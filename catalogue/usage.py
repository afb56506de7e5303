"""Registered event and usage queries (ETL, traffic and the usage dashboards)."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogue.common import AVG_MS, BUCKET_SQL, SUM_MS, WIDTH, Query, stamp_sql
from catalogue.events_sql import FIELDS, SKIPPED, with_events, with_requests
from seekledger.functions.grammar import all_fields
from seekledger.operators import rollups as R
from seekledger.operators.groups import list_groups
from seekledger.operators.tables import newest
from seekledger.plans import events as E
from seekledger.plans import usage as U
from seekledger.samples import catalog as C
from seekledger.samples.request_log import read_table

NO_CLIENT = f"coalesce(client_id, '{R.NO_CLIENT}')"
AGENT = "client_user_agent"
FIELD = "category"


def _on_events(rollup, *args, **kwargs):
    return lambda spark, sf_dir: rollup(C.usage_events(spark, sf_dir), *args, **kwargs)


def _on_field(rollup, *args, **kwargs):
    return lambda spark, sf_dir: rollup(U.with_field(C.usage_events(spark, sf_dir), FIELD), *args, **kwargs)


def terms_sql(key: str, size: int, metrics: str = "count(*) AS count", by: str = "count", source: str = "ev",
              name: str | None = None) -> str:
    name = name or key
    return (
        f'SELECT {key} AS "{name}", {metrics} FROM {source} WHERE {key} IS NOT NULL '
        f"GROUP BY {key} ORDER BY {by} DESC NULLS LAST, {key} LIMIT {size}"
    )


def list_terms_sql(category: str, metrics: str, by: str) -> str:
    source = f"(SELECT unnest({category}) AS field, cents FROM ev)"
    return with_events(terms_sql("field", 20, metrics, by, source))


def nested_sql(parent: str, child: str, sizes: tuple[int, int], source: str = "ev",
               names: tuple[str, str] | None = None) -> str:
    p, c = names or (parent, child)
    return with_events(
        f"SELECT p AS {p}, c AS {c}, n AS count FROM (SELECT p, c, n, row_number() OVER "
        f"(PARTITION BY p ORDER BY n DESC, c) AS r FROM (SELECT p, c, count(*) AS n FROM cells "
        f"WHERE c IS NOT NULL AND p IN (SELECT p FROM top) GROUP BY p, c)) WHERE r <= {sizes[1]}",
        f"cells AS (SELECT {parent} AS p, {child} AS c FROM {source})",
        f"top AS (SELECT p FROM cells WHERE p IS NOT NULL GROUP BY p ORDER BY count(*) DESC, p LIMIT {sizes[0]})",
    )


def over_time_sql(metrics: str, where: str = "true") -> str:
    return with_events(f"SELECT {BUCKET_SQL}, {metrics} FROM ev WHERE {where} GROUP BY 1")


def series_sql(key: str, size: int, where: str = "true", amount: str = "count(*)", name: str = "count",
               out: str | None = None) -> str:
    return with_events(
        f"SELECT {BUCKET_SQL}, {key} AS {out or key}, {amount} AS {name} FROM ev WHERE {key} IN (SELECT key FROM top) "
        f"AND {where} GROUP BY 1, 2",
        f"top AS (SELECT {key} AS key FROM ev WHERE {key} IS NOT NULL AND {where} GROUP BY 1 "
        f"ORDER BY {amount} DESC, 1 LIMIT {size})",
    )


def bucket_series_sql(key: str, size: int) -> str:
    return with_events(
        f"SELECT bucket, {key}, count FROM (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY count DESC, {key}) AS r "
        f"FROM (SELECT {BUCKET_SQL}, {key}, count(*) AS count FROM ev WHERE {key} IS NOT NULL GROUP BY 1, 2)) WHERE r <= {size}"
    )


LISTS = ", ".join(f"array_to_string({c}, ',') AS {c}" for c in FIELDS)
EVENT_COLUMNS = (
    "request_id", "cluster_id", "index", "index_group", "operation", "http_method", "path", "language",
    "query_fingerprint", "query_template_hash", "query_template_text", "response_time_ms", "response_status",
    "client_id", "client_ip", "client_user_agent", "lookback_seconds", "lookback_field", "lookback_label",
    "query_body", "response_hits", "query_type", "bulk_documents",
)
_EVENT_LIST = ", ".join(f'"{c}"' for c in EVENT_COLUMNS)


def _events(spark, sf_dir):
    """The whole pipeline from the raw table, every column of every event."""
    events = E.build_usage_events(C.requests(spark, sf_dir), C.group_map(spark, sf_dir), once=True)
    return events.select("timestamp", *EVENT_COLUMNS, "fields.*")


def _sampled(spark, sf_dir):
    settings = E.EventSettings(event_sample_rate=0.25, body_sample_rate=0.5)
    events = E.build_usage_events(C.requests(spark, sf_dir), C.group_map(spark, sf_dir), settings, once=True)
    return events.select("request_id", "query_body")


def _keep_sql(salt: str, rate: float) -> str:
    digest = f"substr(md5(concat('{salt}', cast(request_id as varchar))), 1, 8)"
    return f"cast('0x' || {digest} as bigint) < {int(rate * 2**32)}"


def _all_fields(spark, sf_dir):
    events = C.usage_events(spark, sf_dir)
    return events.select("request_id", F.array_join(all_fields(F.col("fields")), ",").alias("all_fields"))


def _routes(spark, sf_dir):
    columns = ("request_id", "indices", "operation", "mode", "skipped")
    return E.route(C.requests(spark, sf_dir)).select(*columns)


_MODE = (
    "CASE WHEN operation IN ('search', 'count') THEN 'search' WHEN operation = 'doc_write' THEN 'write' "
    "WHEN operation IN ('update', 'bulk', 'msearch') THEN operation ELSE 'none' END"
)

_FIELD_EV = "ev_f AS (SELECT * FROM ev WHERE " + " OR ".join(
    f"list_contains({c}, '{FIELD}')" for c in FIELDS
) + ")"


def _field_sql(select: str) -> str:
    return with_events(select.replace("FROM ev ", "FROM ev_f "), _FIELD_EV)


_DUE = f"elapsed_ms IS NOT NULL AND NOT {SKIPPED}"
QUERIES: dict[str, Query] = {
    "b_usage_events": Query(
        _events, with_events(f"SELECT {stamp_sql(chr(34) + 'timestamp' + chr(34), 'timestamp')}, {_EVENT_LIST}, {LISTS} FROM ev")
    ),
    "b01_routes": Query(
        _routes,
        with_requests(
            "SELECT request_id, CASE WHEN path LIKE '/\\_%' ESCAPE '\\' THEN NULL ELSE split_part(path, '/', 2) END AS indices, "
            f"operation, {_MODE} AS mode, {SKIPPED} AS skipped FROM req"
        ),
    ),
    "b26_all_fields": Query(
        _all_fields,
        with_events(
            "SELECT request_id, array_to_string(list_sort(list_distinct("
            + "list_concat(queried, list_concat(filtered, list_concat(aggregated, list_concat(sorted, list_concat(sourced, written)))))"
            + ")), ',') AS all_fields FROM ev"
        ),
    ),
    "b28_sampled_events": Query(
        _sampled,
        with_events(
            f"SELECT request_id, CASE WHEN {_keep_sql('body', 0.5)} THEN query_body END AS query_body "
            f"FROM ev WHERE {_keep_sql('', 0.25)}"
        ),
    ),
    "a02_group_map": Query(
        lambda spark, sf_dir: C.group_map(spark, sf_dir),
        with_requests(
            "SELECT index_name, CASE WHEN index_name LIKE 'logs-____.__.0%' THEN 'logs-stream' WHEN index_name LIKE 'logs-%' "
            "THEN 'logs' WHEN index_name LIKE 'orders-%' THEN 'orders' ELSE index_name END AS index_group FROM known",
            "known AS (SELECT DISTINCT index_name FROM (SELECT unnest(string_split(split_part(path, '/', 2), ',')) AS index_name "
            "FROM req) WHERE index_name LIKE 'logs-%' OR index_name LIKE 'orders-%' OR index_name = 'products')",
        ),
    ),
    "a12_sample_events": Query(
        lambda spark, sf_dir: newest(C.usage_events(spark, sf_dir), 1000, "orders").select(
            "request_id", "timestamp", "index", "operation"
        ),
        with_events(
            f"SELECT request_id, {stamp_sql(chr(34) + 'timestamp' + chr(34), 'timestamp')}, \"index\", operation FROM "
            "(SELECT * FROM ev WHERE index_group = 'orders' ORDER BY \"timestamp\" DESC, request_id DESC LIMIT 1000)"
        ),
    ),
    "a13_raw_events": Query(
        _on_events(U.raw_events),
        with_events(
            f"SELECT {stamp_sql(chr(34) + 'timestamp' + chr(34), 'timestamp')}, "
            + ", ".join(U.RAW_COLUMNS[1:])
            + " FROM ev"
        ),
    ),
    "a14_group_listing": Query(
        lambda spark, sf_dir: list_groups(C.group_map(spark, sf_dir)),
        with_requests(
            "SELECT g AS index_group, index_name FROM "
            "(SELECT index_name, CASE WHEN index_name LIKE 'logs-____.__.0%' THEN 'logs-stream' WHEN index_name LIKE 'logs-%' "
            "THEN 'logs' WHEN index_name LIKE 'orders-%' THEN 'orders' ELSE index_name END AS g FROM known)",
            "known AS (SELECT DISTINCT index_name FROM (SELECT unnest(string_split(split_part(path, '/', 2), ',')) AS index_name "
            "FROM req) WHERE index_name LIKE 'logs-%' OR index_name LIKE 'orders-%' OR index_name = 'products')",
        ),
    ),
    "e01_groups_by_count": Query(_on_events(U.groups_by_count), with_events(terms_sql("index_group", 20))),
    "e02_operations_over_time": Query(_on_events(U.operations_over_time, WIDTH), over_time_sql("count(*) AS count")),
    "e03_operation_distribution": Query(
        _on_events(U.operation_distribution), with_events(terms_sql("operation", 10))
    ),
    **{
        f"e{4 + at:02d}_top_{c}_fields": Query(
            _on_events(U.field_heat, c), list_terms_sql(c, "count(*) AS count", "count")
        )
        for at, c in enumerate(U.READ_CATEGORIES)
    },
    **{
        f"e{9 + at:02d}_costliest_{c}_fields": Query(
            _on_events(U.field_cost, c), list_terms_sql(c, SUM_MS, "total_ms")
        )
        for at, c in enumerate(U.READ_CATEGORIES)
    },
    "e04_e13_field_tables_one_scan": Query(
        _on_events(U.field_heat_table),
        with_events(
            "SELECT category, field, count, total_ms, 'count' AS ranked_by FROM (SELECT *, row_number() OVER "
            "(PARTITION BY category ORDER BY count DESC, field) AS r FROM totals) WHERE r <= 20 UNION ALL "
            "SELECT category, field, count, total_ms, 'total_ms' FROM (SELECT *, row_number() OVER "
            "(PARTITION BY category ORDER BY total_ms DESC, field) AS r FROM totals) WHERE r <= 20",
            "refs AS ("
            + " UNION ALL ".join(
                f"SELECT '{c}' AS category, unnest({c}) AS field, cents FROM ev" for c in U.READ_CATEGORIES
            )
            + ")",
            f"totals AS (SELECT category, field, count(*) AS count, {SUM_MS} FROM refs GROUP BY 1, 2)",
        ),
    ),
    "e14_response_over_time": Query(_on_events(U.response_over_time, WIDTH), over_time_sql(AVG_MS)),
    "e15_top_templates": Query(
        _on_events(U.templates), with_events(terms_sql("query_template_hash", 20, f"count(*) AS count, {AVG_MS}"))
    ),
    "e16_templates_over_time": Query(
        _on_events(U.templates_over_time, WIDTH), series_sql("query_template_hash", 10)
    ),
    "e16_templates_per_bucket": Query(
        _on_events(U.templates_over_time, WIDTH, per_bucket=True), bucket_series_sql("query_template_hash", 10)
    ),
    "e17_costliest_templates": Query(
        _on_events(U.costliest_templates), with_events(terms_sql("query_template_hash", 20, SUM_MS, "total_ms"))
    ),
    "e18_template_variety": Query(
        _on_events(U.template_variety),
        with_events(
            terms_sql("index_group", 20, "count(*) AS count, count(DISTINCT query_template_hash) AS templates")
        ),
    ),
    "e19_clients": Query(
        _on_events(U.clients),
        with_events(terms_sql(NO_CLIENT, 20, f"count(*) AS count, {AVG_MS}", name="client_id")),
    ),
    "e20_client_addresses": Query(
        _on_events(U.client_addresses),
        with_events(terms_sql("client_ip", 20, f"count(*) AS count, count(DISTINCT {AGENT}) AS user_agents")),
    ),
    "e21_client_groups": Query(
        _on_events(U.client_groups),
        nested_sql(NO_CLIENT, "index_group", (20, 20), names=("client_id", "index_group")),
    ),
    "e22_client_fields": Query(
        _on_events(U.client_fields),
        with_events(
            "SELECT client_id, field, count FROM (SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY count DESC, field) AS r "
            "FROM (SELECT client_id, field, count(*) AS count FROM (SELECT client_id, unnest(queried) AS field FROM e) GROUP BY 1, 2) "
            "WHERE client_id IN (SELECT client_id FROM e GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 20)) WHERE r <= 20",
            f"e AS (SELECT {NO_CLIENT} AS client_id, queried FROM ev)",
        ),
    ),
    "e23_user_agents": Query(
        _on_events(U.user_agents), with_events(terms_sql(AGENT, 10, name="client_user_agent"))
    ),
    "e24_lookback_labels": Query(_on_events(U.lookback_labels), with_events(terms_sql("lookback_label", 20))),
    "e25_lookback_by_group": Query(
        _on_events(U.lookback_by_group),
        with_events(
            terms_sql(
                "index_group", 20, "avg(lookback_seconds) AS avg_lookback_seconds", "avg_lookback_seconds"
            )
        ),
    ),
    "e26_lookback_fields": Query(_on_events(U.lookback_fields), with_events(terms_sql("lookback_field", 10))),
    "e27_operations_by_group": Query(_on_events(U.groups_by_count), with_events(terms_sql("index_group", 20))),
    "e28_groups_over_time": Query(_on_events(U.groups_over_time, WIDTH), series_sql("index_group", 10)),
    "e28_groups_per_bucket": Query(
        _on_events(U.groups_over_time, WIDTH, per_bucket=True), bucket_series_sql("index_group", 10)
    ),
    "e29_group_operation_types": Query(
        _on_events(U.group_operations, 10), nested_sql("index_group", "operation", (20, 10))
    ),
    "e30_response_by_group": Query(
        _on_events(U.response_by_group), with_events(terms_sql("index_group", 20, AVG_MS, "avg_ms"))
    ),
    "e31_group_breakdown": Query(
        _on_events(U.group_operations, 20), nested_sql("index_group", "operation", (20, 20))
    ),
    "e32_field_over_time": Query(
        _on_field(U.operations_over_time, WIDTH), _field_sql(f"SELECT {BUCKET_SQL}, count(*) AS count FROM ev GROUP BY 1")
    ),
    "e33_field_operations": Query(_on_field(U.operation_distribution), _field_sql(terms_sql("operation", 10))),
    "e34_field_clients": Query(
        _on_field(U.clients), _field_sql(terms_sql(NO_CLIENT, 20, f"count(*) AS count, {AVG_MS}", name="client_id"))
    ),
    "e35_field_addresses": Query(
        _on_field(U.client_addresses),
        _field_sql(terms_sql("client_ip", 20, f"count(*) AS count, count(DISTINCT {AGENT}) AS user_agents")),
    ),
    "e36_field_user_agents": Query(
        _on_field(U.user_agents), _field_sql(terms_sql(AGENT, 10, name="client_user_agent"))
    ),
    "e37_field_templates": Query(
        _on_field(U.template_costs),
        _field_sql(terms_sql("query_template_hash", 20, f"count(*) AS count, {AVG_MS}, {SUM_MS}")),
    ),
    "e38_field_response_over_time": Query(
        _on_field(U.response_over_time, WIDTH), _field_sql(f"SELECT {BUCKET_SQL}, {AVG_MS} FROM ev GROUP BY 1")
    ),
    "e39_field_raw_events": Query(
        _on_field(U.raw_events),
        _field_sql(
            f"SELECT {stamp_sql(chr(34) + 'timestamp' + chr(34), 'timestamp')}, "
            + ", ".join(U.RAW_COLUMNS[1:])
            + " FROM ev "
        ),
    ),
    "e40_dashboard_controls": Query(
        lambda spark, sf_dir: U.group_operations(
            U.select_events(C.usage_events(spark, sf_dir), groups=["orders", "products"], languages=["dsl+painless"])
        ),
        nested_sql(
            "index_group", "operation", (20, 10),
            "ev WHERE index_group IN ('orders', 'products') AND \"language\" = 'dsl+painless'",
        ),
    ),
    "e41_product_table": Query(
        lambda spark, sf_dir: U.product_table(
            read_table(spark, sf_dir, "part").selectExpr("p_name AS title", "p_type AS category", "p_brand AS brand")
        ),
        "WITH cells AS (SELECT p_name AS a, p_type AS b, p_brand AS c, count(*) AS n FROM part GROUP BY 1, 2, 3), "
        "t AS (SELECT a FROM cells GROUP BY a ORDER BY sum(n) DESC, a LIMIT 100), "
        "u AS (SELECT a, b FROM (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY sum(n) DESC, b) AS r FROM cells "
        "WHERE a IN (SELECT a FROM t) GROUP BY a, b) WHERE r <= 20) "
        "SELECT a AS title, b AS category, c AS brand, n AS count FROM (SELECT cells.*, row_number() OVER "
        "(PARTITION BY a, b ORDER BY n DESC, c) AS r FROM cells JOIN u USING (a, b)) WHERE r <= 20",
    ),
    "e42_product_categories": Query(
        lambda spark, sf_dir: U.product_categories(
            read_table(spark, sf_dir, "part").selectExpr("p_type AS category")
        ),
        "SELECT p_type AS category, count(*) AS count FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    ),
    "e43_traffic_counters": Query(
        lambda spark, sf_dir: E.traffic_counters(C.requests(spark, sf_dir), C.usage_events(spark, sf_dir)),
        with_requests(
            "SELECT count(*) AS requests_proxied, count(*) FILTER (elapsed_ms IS NULL) AS requests_failed, "
            f"count(*) FILTER ({_DUE} AND strlen(body) > 1000000) AS requests_unobserved, "
            f"count(*) FILTER (elapsed_ms IS NOT NULL AND {SKIPPED}) AS events_skipped, "
            f"count(*) FILTER ({_DUE} AND NOT {_keep_sql('', 1)}) AS events_sampled_out, "
            f"count(*) FILTER ({_DUE} AND lost) AS extraction_errors, count(*) FILTER ({_DUE} AND NOT lost) AS events_emitted, "
            "round(sum(CAST(round(elapsed_ms * 100) AS BIGINT)) / 100.0 / count(elapsed_ms), 2) AS response_avg_ms, "
            "max(elapsed_ms) AS response_max_ms FROM req"
        ),
    ),
}
