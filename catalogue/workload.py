"""Registered workload, drift and table-sink queries."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from catalogue.common import AVG_MS, SUM_MS, WIDTH, Query, stamp_sql
from catalogue.events_sql import FIELDS, with_events
from catalogue.mapping import DIFF_CTE, FIELDS_CTE, REFS_CTE, USAGE_CTE
from catalogue.usage import terms_sql
from seekledger.operators.tables import append_events, clear_events, new_place, replace_groups
from seekledger.plans import drift as J
from seekledger.plans import mapping as M
from seekledger.plans import usage as U
from seekledger.plans import workload as W
from seekledger.samples import business as B
from seekledger.samples import catalog as C
from seekledger.schemas import USAGE_EVENTS
from seekledger.sources.cluster import mapping_fields

START, ORDERS_START = datetime(2024, 1, 20), datetime(2001, 1, 1)


def _view(columns: dict[str, str], source: str) -> str:
    return "SELECT " + ", ".join(f'{sql} AS "{name}"' for name, sql in columns.items()) + f" FROM {source}"


PRODUCTS = "products AS (" + _view(B.PRODUCT_COLUMNS, "part") + ")"
LOGS = "logs AS (" + _view(B.LOG_COLUMNS, "events") + ")"
ORDERS = "sales AS (" + _view(
    B.ORDER_COLUMNS,
    "orders LEFT JOIN (SELECT l_orderkey, count(*) AS items FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey "
    "JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey",
) + ")"
NEWEST_DOCS = (
    "docs AS (SELECT product_id + 1000 AS product_id, arg_max(concat('line ', line), (changed_at, line)) AS title, "
    "arg_max(struct_pack(p := price), (changed_at, line)).p AS price FROM updates GROUP BY 1)"
)
UPDATES = "updates AS (" + _view(B.UPDATE_COLUMNS, "lineitem") + ")"


def _sql(select: str, *ctes: str) -> str:
    return "WITH " + ", ".join(ctes) + " " + select


def _on(table, query, *args):
    return lambda spark, sf_dir: query(table(spark, sf_dir), *args)


def _tokens(column: str, term: str) -> str:
    return f"list_contains(regexp_split_to_array(lower({column}), '[^\\pL\\pN_]+'), '{term}')"


def _match(table, view: str, cte: str, text: str, term: str, columns: tuple, key: str, size: int) -> Query:
    names = ", ".join(stamp_sql('"timestamp"', '"timestamp"') if c == "timestamp" else c for c in columns)
    return Query(
        _on(table, W.search_text, text, term, columns, key, size),
        _sql(f"SELECT {names} FROM (SELECT * FROM {view} WHERE {_tokens(text, term)} ORDER BY {key} LIMIT {size})", cte),
    )


_STAMP = stamp_sql('"timestamp"', '"timestamp"')
_DATE = stamp_sql("order_date", "order_date")
_CHANGES = ["product_id", "price", "stock_count"]


def _documents(spark, sf_dir):
    return B.product_updates(spark, sf_dir).selectExpr(
        "product_id + 1000 AS product_id", "concat('line ', cast(line as string)) AS title", "price", "changed_at", "line"
    )


def _upserted(spark, sf_dir):
    target = B.products(spark, sf_dir).select("product_id", "title", "price")
    return W.upsert(target, _documents(spark, sf_dir), "product_id", ["changed_at", "line"])


def _updated(spark, sf_dir):
    target = B.products(spark, sf_dir).select(*_CHANGES)
    return W.partial_update(target, B.product_updates(spark, sf_dir), "product_id", ["changed_at", "line"])


def _appended(spark, sf_dir):
    target = B.products(spark, sf_dir).select("product_id", "price")
    return W.append(target, _documents(spark, sf_dir).select("product_id", "price"))


# --- Drift -----------------------------------------------------------------------------------

SPLIT, HALF = datetime(2024, 1, 16), 15 * 24


def _windows(spark, sf_dir):
    """Both halves of the log, per concrete index."""
    events = C.usage_events(spark, sf_dir).withColumn("index_group", F.col("index"))
    return J.two_windows(events, SPLIT, HALF)


WINDOWS = (
    "windows AS (SELECT *, \"timestamp\" >= TIMESTAMP '2024-01-16' AS is_new FROM ev "
    "WHERE \"timestamp\" >= TIMESTAMP '2024-01-01' AND \"timestamp\" < TIMESTAMP '2024-01-31')"
)
DRIFT = (
    "drift AS (SELECT \"index\" AS index_group, query_template_hash, count(*) FILTER (NOT is_new) AS before, "
    "count(*) FILTER (is_new) AS after FROM windows WHERE query_template_hash IS NOT NULL GROUP BY 1, 2)"
)
ALL_REFS = "every AS (" + " UNION ALL ".join(
    f"SELECT request_id, \"index\", index_group, client_id, query_template_hash, \"timestamp\" AS ts, unnest({c}) AS field FROM ev"
    for c in FIELDS
) + ")"


def _fields(spark, sf_dir):
    return mapping_fields(C.mappings(spark, sf_dir), C.group_map(spark, sf_dir))


def _unmapped(spark, sf_dir):
    return J.unmapped_fields(M.field_usage(C.usage_events(spark, sf_dir)), _fields(spark, sf_dir)).select(
        "index_group", "field_name"
    )


def _impact(spark, sf_dir):
    changes = C.mapping_diff_table(spark, sf_dir).filter("classification <> 'unused'")
    return J.change_impact(C.usage_events(spark, sf_dir), changes.select("index_group", "field_name"))


def _snapshots(spark, sf_dir):
    """The mapping as it is, and one in which some fields are gone, retyped or new."""
    old = _fields(spark, sf_dir)
    kept = old.filter("field_name NOT LIKE 'internal%'").withColumn(
        "mapped_type", F.expr("case when mapped_type = 'float' then 'double' else mapped_type end")
    )
    added = _unmapped(spark, sf_dir).withColumn("mapped_type", F.lit("keyword"))
    return old, kept.select("index_group", "field_name", "mapped_type").unionByName(added)


def _history(spark, sf_dir):
    return J.mapping_history(*_snapshots(spark, sf_dir))


def _growth(spark, sf_dir):
    usage = M.field_usage(M.recent(C.usage_events(spark, sf_dir), C.as_of(spark, sf_dir)))
    return J.field_growth(*_snapshots(spark, sf_dir), usage)


def _verdicts(spark, sf_dir):
    """Every action proposed for every mapped field."""
    actions = F.explode(F.array(*map(F.lit, [*J.BREAKS, "add_field"])))
    changes = _fields(spark, sf_dir).select("index_group", "field_name", actions.alias("action"))
    usage = M.field_usage(M.recent(C.usage_events(spark, sf_dir), C.as_of(spark, sf_dir)))
    return J.change_verdicts(usage, changes)


# Written out by hand, apart from the rules in the code.
_BROKEN_SQL = {
    "remove_field": "queried filtered aggregated sorted sourced written",
    "remove_multi_field": "queried filtered aggregated sorted sourced written",
    "text_to_keyword": "queried",
    "keyword_to_text": "filtered aggregated sorted",
    "disable_index": "queried filtered",
    "disable_doc_values": "aggregated sorted",
    "disable_norms": "queried",
    "add_field": "",
}


def _verdict_arm(action: str) -> str:
    uses = _BROKEN_SQL[action].split()
    names = ", ".join(f"CASE WHEN coalesce(count_{c}, 0) > 0 THEN '{c}' END" for c in uses) or "NULL"
    total = " + ".join(f"coalesce(count_{c}, 0)" for c in uses) or "0"
    return (
        f"SELECT index_group, field_name, '{action}' AS action, ({total}) > 0 AS breaking, "
        f"concat_ws(',', {names}) AS broken, CAST({total} AS BIGINT) AS broken_references "
        "FROM mapped LEFT JOIN used USING (index_group, field_name)"
    )


UNMAPPED = (
    "unmapped AS (SELECT DISTINCT index_group, field AS field_name FROM every WHERE index_group IN (SELECT index_group FROM mapped) "
    "AND (index_group, field) NOT IN (SELECT (index_group, field_name) FROM mapped))"
)


# --- Sinks -----------------------------------------------------------------------------------


def _sink(spark, sf_dir):
    path = new_place(spark, "event_sink")
    append_events(C.usage_events(spark, sf_dir), path)
    stored = spark.read.schema(USAGE_EVENTS).parquet(path)
    return stored.groupBy("event_date", "index_group").agg(F.count(F.lit(1)).alias("count"))


def _cleared(spark, sf_dir):
    """Events written, cleared, and those of one group written again, in the same run twice."""
    path = new_place(spark, "cleared_events")
    events = C.usage_events(spark, sf_dir)
    append_events(events, path, run="first")
    clear_events(events, path)
    for _ in range(2):
        append_events(events.filter("index_group = 'orders'"), path, run="again")
    stored = spark.read.schema(USAGE_EVENTS).parquet(path)
    return stored.groupBy("event_date", "index_group").agg(F.count(F.lit(1)).alias("count"))


def _replaced(spark, sf_dir):
    events = C.usage_events(spark, sf_dir)
    old = U.groups_by_count(U.select_events(events, end=SPLIT), 1000)
    new = U.groups_by_count(U.select_events(events, ["orders", "products"], start=SPLIT), 1000)
    return replace_groups(old, new, new)


_OVER_TIME = (
    "strftime(time_bucket(INTERVAL '12 hours', \"timestamp\", TIMESTAMP '1970-01-01'), '%Y-%m-%d %H:%M:%S.%f') AS bucket"
)
_P_LIST = ("title", "price", "category")

QUERIES: dict[str, Query] = {
    "a09_event_sink": Query(
        _sink,
        with_events(
            "SELECT strftime(\"timestamp\", '%Y-%m-%d') AS event_date, index_group, count(*) AS count FROM ev GROUP BY 1, 2"
        ),
    ),
    "a11_clear_events": Query(
        _cleared,
        with_events(
            "SELECT strftime(\"timestamp\", '%Y-%m-%d') AS event_date, index_group, count(*) AS count FROM ev "
            "WHERE index_group = 'orders' GROUP BY 1, 2"
        ),
    ),
    "a10_replace_groups": Query(
        _replaced,
        with_events(
            "SELECT index_group, count(*) AS count FROM ev WHERE CASE WHEN index_group IN ('orders', 'products') "
            "THEN \"timestamp\" >= TIMESTAMP '2024-01-16' ELSE \"timestamp\" < TIMESTAMP '2024-01-16' END GROUP BY 1"
        ),
    ),
    "k01_search_title": _match(B.products, "products", PRODUCTS, "title", "ring", _P_LIST, "product_id", 10),
    "k01_search_description": _match(
        B.products, "products", PRODUCTS, "description", "promo", ("product_id", "description"), "product_id", 5
    ),
    "k01_search_message": _match(
        B.logs, "logs", LOGS, "message", "timeout", ("timestamp", "level", "service", "message"), "log_id", 20
    ),
    "k01_search_customer": _match(
        B.orders, "sales", ORDERS, "customer_name", "000000007", ("order_id", "customer_name", "total_amount", "status"),
        "order_id", 10,
    ),
    "k02_in_category": Query(
        _on(B.products, W.in_category, "PROMO"),
        _sql("SELECT product_id, title, price, category FROM products WHERE category = 'PROMO' ORDER BY price, product_id LIMIT 20", PRODUCTS),
    ),
    "k03_count_by_brand": Query(_on(B.products, W.count_by, "brand", 20), _sql(terms_sql("brand", 20, source="products"), PRODUCTS)),
    "k03_count_by_payment": Query(
        _on(B.orders, W.count_by, "payment_method", 10), _sql(terms_sql("payment_method", 10, source="sales"), ORDERS)
    ),
    "k04_rating_range": Query(
        _on(B.products, W.rated_at_least, 3.5),
        _sql("SELECT * FROM products WHERE rating >= 3.5 ORDER BY product_id LIMIT 10", PRODUCTS),
    ),
    "k05_by_id": Query(
        _on(B.products, W.by_id, "product_id", 42), _sql("SELECT * FROM products WHERE product_id = 42", PRODUCTS)
    ),
    "k05_match_all": Query(
        _on(B.products, W.match_all, "product_id"), _sql("SELECT * FROM products ORDER BY product_id LIMIT 5", PRODUCTS)
    ),
    "k06_discounted_price": Query(
        _on(B.products, W.with_discount, "PROMO", 0.25),
        _sql("SELECT product_id, title, category, price * 0.75::DOUBLE AS discounted_price FROM products WHERE category = 'PROMO'", PRODUCTS),
    ),
    "k07_newest_logs": Query(
        _on(B.logs, W.newest_logs, "ERROR", START),
        _sql(
            f"SELECT log_id, {_STAMP}, level, service FROM (SELECT * FROM logs WHERE level = 'ERROR' AND \"timestamp\" >= "
            "TIMESTAMP '2024-01-20' ORDER BY \"timestamp\" DESC, log_id DESC LIMIT 50)", LOGS
        ),
    ),
    "k07_orders_since": Query(
        _on(B.orders, W.orders_since, ORDERS_START),
        _sql(
            f"SELECT order_id, {_DATE}, status, total_amount FROM (SELECT * FROM sales WHERE order_date >= TIMESTAMP '2001-01-01' "
            "ORDER BY order_date DESC, order_id LIMIT 20)", ORDERS
        ),
    ),
    "k08_average_duration": Query(
        _on(B.logs, W.average_duration),
        _sql(
            terms_sql(
                "service", 20,
                "count(*) AS count, sum(cast(round(duration_ms * 100) as bigint)) / 100.0 / count(duration_ms) AS avg_duration",
                source="logs",
            ),
            LOGS,
        ),
    ),
    **{
        f"k08_revenue_by_{name}": Query(
            _on(B.orders, W.revenue_by, key),
            _sql(
                terms_sql(
                    key, 20, "count(*) AS count, sum(cast(round(total_amount * 100) as bigint)) / 100.0 AS revenue", source="sales"
                ),
                ORDERS,
            ),
        )
        for name, key in (("category", "category"), ("country", "shipping_country"))
    },
    "k09_logs_over_time": Query(
        _on(B.logs, W.logs_over_time, START, WIDTH),
        _sql(f"SELECT {_OVER_TIME}, count(*) AS count FROM logs WHERE \"timestamp\" >= TIMESTAMP '2024-01-20' GROUP BY 1", LOGS),
    ),
    "k10_failed_requests": Query(
        _on(B.logs, W.failed_requests, "svc-2"),
        _sql(
            f"SELECT log_id, {_STAMP}, level, service, endpoint, status_code, message FROM (SELECT * FROM logs WHERE service = 'svc-2' "
            "AND status_code >= 400 ORDER BY \"timestamp\" DESC, log_id DESC LIMIT 30)", LOGS
        ),
    ),
    "k10_orders_in_status": Query(
        _on(B.orders, W.orders_in_status, "P"),
        _sql(
            f"SELECT order_id, customer_name, status, total_amount, {_DATE} FROM (SELECT * FROM sales WHERE status = 'P' "
            "ORDER BY order_date DESC, order_id LIMIT 20)", ORDERS
        ),
    ),
    "k11_slowest_requests": Query(
        _on(B.logs, W.slowest_requests),
        _sql(
            f"SELECT log_id, {_STAMP}, service, duration_ms, status_code, CASE WHEN status_code >= 500 THEN duration_ms / 1000 * 3 "
            "ELSE duration_ms / 1000 END AS severity_score FROM (SELECT * FROM logs WHERE duration_ms >= 100 "
            "ORDER BY duration_ms DESC, log_id LIMIT 20)", LOGS
        ),
    ),
    "k12_orders_by_weekday": Query(
        _on(B.orders, W.orders_by_weekday),
        _sql(
            terms_sql("day_of_week", 7, source="days"),
            ORDERS, "days AS (SELECT upper(dayname(order_date)) AS day_of_week FROM sales)",
        ),
    ),
    "k13_densest_orders": Query(
        _on(B.orders, W.densest_orders, "O"),
        _sql(
            "SELECT order_id, customer_name, total_amount, item_count FROM sales WHERE status = 'O' "
            "ORDER BY total_amount * item_count DESC, order_id LIMIT 20", ORDERS
        ),
    ),
    "k14_upsert": Query(
        _upserted,
        _sql(
            "SELECT p.product_id, p.title, p.price FROM products p LEFT JOIN docs ON p.product_id = docs.product_id "
            "WHERE docs.product_id IS NULL UNION ALL SELECT product_id, title, price FROM docs",
            PRODUCTS, UPDATES, NEWEST_DOCS,
        ),
    ),
    "k14_bulk_append": Query(
        _appended,
        _sql(
            "SELECT product_id, price FROM products UNION ALL SELECT product_id + 1000, price FROM updates", PRODUCTS, UPDATES
        ),
    ),
    "k14_partial_update": Query(
        _updated,
        _sql(
            "SELECT product_id, coalesce(p, price) AS price, coalesce(s, stock_count) AS stock_count FROM products LEFT JOIN "
            "(SELECT product_id, arg_max(price, (changed_at, line)) FILTER (price IS NOT NULL) AS p, "
            "arg_max(stock_count, (changed_at, line)) FILTER (stock_count IS NOT NULL) AS s FROM updates GROUP BY 1) USING (product_id)",
            PRODUCTS, UPDATES,
        ),
    ),
    "j01_template_drift": Query(
        lambda spark, sf_dir: J.template_drift(_windows(spark, sf_dir)),
        with_events(
            "SELECT *, CASE WHEN before = 0 THEN 'new' WHEN after = 0 THEN 'gone' ELSE 'kept' END AS state FROM drift", WINDOWS, DRIFT
        ),
    ),
    "j01_new_templates": Query(
        lambda spark, sf_dir: J.new_templates(_windows(spark, sf_dir)),
        with_events("SELECT *, 'new' AS state FROM drift WHERE before = 0", WINDOWS, DRIFT),
    ),
    "j02_abandoned_fields": Query(
        lambda spark, sf_dir: J.abandoned_fields(_windows(spark, sf_dir)),
        with_events(
            "SELECT \"index\" AS index_group, field, count(*) AS before, CAST(0 AS BIGINT) AS after FROM every "
            "GROUP BY 1, 2 HAVING max(ts) < TIMESTAMP '2024-01-16'", ALL_REFS
        ),
    ),
    "j02_abandoned_over_threshold": Query(
        lambda spark, sf_dir: J.abandoned_fields(_windows(spark, sf_dir), 2),
        with_events(
            "SELECT \"index\" AS index_group, field, count(*) AS before, CAST(0 AS BIGINT) AS after FROM every "
            "GROUP BY 1, 2 HAVING max(ts) < TIMESTAMP '2024-01-16' AND count(*) > 2", ALL_REFS
        ),
    ),
    "j03_unmapped_fields": Query(
        _unmapped, with_events("SELECT * FROM unmapped", FIELDS_CTE, ALL_REFS, UNMAPPED)
    ),
    "j04_change_impact": Query(
        _impact,
        with_events(
            "SELECT d.index_group, d.field_name, count(DISTINCT request_id) AS requests, count(DISTINCT client_id) AS clients, "
            "count(DISTINCT query_template_hash) AS templates FROM diff d LEFT JOIN every e ON d.index_group = e.index_group "
            "AND d.field_name = e.field WHERE classification <> 'unused' GROUP BY 1, 2",
            REFS_CTE, USAGE_CTE, FIELDS_CTE, DIFF_CTE, ALL_REFS,
        ),
    ),
    "j04_change_verdicts": Query(
        _verdicts,
        with_events(" UNION ALL ".join(map(_verdict_arm, _BROKEN_SQL)), REFS_CTE, USAGE_CTE, FIELDS_CTE),
    ),
    "j05_type_conflicts": Query(
        lambda spark, sf_dir: J.type_conflicts(_fields(spark, sf_dir)),
        with_events(
            "SELECT field_name, string_agg(DISTINCT mapped_type, ',' ORDER BY mapped_type) AS types, count(DISTINCT index_group) AS groups "
            "FROM mapped GROUP BY 1 HAVING count(DISTINCT mapped_type) > 1", FIELDS_CTE
        ),
    ),
    "j06_template_percentiles": Query(
        lambda spark, sf_dir: J.template_percentiles(C.usage_events(spark, sf_dir)),
        with_events(
            terms_sql(
                "query_template_hash", 20,
                f"{SUM_MS}, count(*) AS count, {AVG_MS}, round(quantile_cont(response_time_ms, 0.95), 4) AS p95_ms", "total_ms"
            )
        ),
    ),
    "j07_mapping_history": Query(
        _history,
        with_events(
            "SELECT index_group, field_name, mapped_type AS old_type, CASE WHEN mapped_type = 'float' AND field_name NOT LIKE 'internal%' "
            "THEN 'double' END AS new_type, CASE WHEN field_name LIKE 'internal%' THEN 'removed' ELSE 'retyped' END AS change FROM mapped "
            "WHERE field_name LIKE 'internal%' OR mapped_type = 'float' UNION ALL "
            "SELECT index_group, field_name, NULL, 'keyword', 'added' FROM unmapped",
            FIELDS_CTE, ALL_REFS, UNMAPPED,
        ),
    ),
    "j07_field_growth": Query(
        _growth,
        with_events(
            "SELECT index_group, count(*) FILTER (NOT is_new) AS fields_before, count(*) FILTER (is_new OR NOT gone) AS fields_after, "
            "count(*) FILTER (is_new) AS added, count(*) FILTER (gone) AS removed, "
            "CAST(coalesce(sum(uses) FILTER (is_new), 0) AS BIGINT) AS references_to_added FROM ("
            "SELECT index_group, field_name, false AS is_new, field_name LIKE 'internal%' AS gone, 0 AS uses FROM mapped UNION ALL "
            "SELECT u.index_group, u.field_name, true, false, "
            + " + ".join(f"coalesce(count_{c}, 0)" for c in FIELDS)
            + " FROM unmapped u LEFT JOIN used USING (index_group, field_name)) GROUP BY 1",
            REFS_CTE, USAGE_CTE, FIELDS_CTE, ALL_REFS, UNMAPPED,
        ),
    ),
}
