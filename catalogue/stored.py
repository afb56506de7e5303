"""Registered queries of stored tables, streams by rows, sketches, selection, and requests out of the ordinary."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from catalogue.architecture import QUERIES as H_QUERIES
from catalogue.common import Query, stamp_sql
from catalogue.events_sql import SKIPPED, with_events, with_requests
from catalogue.mapping import DIFF_CTE, FIELDS_CTE, REFS_CTE, USAGE_CTE
from catalogue.usage import EVENT_COLUMNS, LISTS, NO_CLIENT, _keep_sql
from catalogue.workload import NEWEST_DOCS, PRODUCTS, UPDATES, _documents, _sql
from seekledger.operators import keyed_table as K
from seekledger.operators.event_table import EventTable
from seekledger.operators.groups import group_intervals
from seekledger.operators.selection import ranked_percentile
from seekledger.operators.snapshots import Snapshots
from seekledger.operators.tables import new_place
from seekledger.plans import architecture as A
from seekledger.plans import drift as J
from seekledger.plans import events as E
from seekledger.plans import mapping as M
from seekledger.plans import partials as P
from seekledger.plans import sketches as S
from seekledger.plans import usage as U
from seekledger.plans.refresh import SCHEMAS, refresh_findings, refresh_usage
from seekledger.samples import business as B
from seekledger.samples import catalog as C
from seekledger.samples.mappings import CRM_FIELD, CRM_INDEX, crm_groups
from seekledger.samples.request_log import read_table
from seekledger.sources import cluster
from seekledger.streaming import ingest as L
from seekledger.streaming.rows import BatchSizes, request_rows

_STAMP = stamp_sql('"timestamp"', '"timestamp"')
_EVENT_LIST = ", ".join(f'"{c}"' for c in EVENT_COLUMNS)


# --- Event tables and streams ----------------------------------------------------------------


def _in_batches(spark, sf_dir, table: EventTable, parts: int = 6):
    """The events in as many appends, the last of them twice, as a stream that is tried again would."""
    events = C.usage_events(spark, sf_dir)
    for batch in [*range(parts), parts - 1]:
        table.append(events.filter(F.col("request_id") % parts == batch), "sample", batch)
        yield batch


def _compacted(spark, sf_dir):
    table = EventTable(spark, new_place(spark, "event_table"))
    for _ in _in_batches(spark, sf_dir, table):
        table.compact(most=3)
    stored = table.read()
    folders = max(len(x["paths"]) for x in table.days().values())
    return stored.select("timestamp", *EVENT_COLUMNS, "fields.*").withColumn("few_folders", F.lit(folders <= 3))


BATCH_ROWS = 2000


def _by_rows(spark, sf_dir):
    """The log as a stream of at most BATCH_ROWS requests a batch, into an event table."""
    place = new_place(spark, "stream_by_rows")
    table = EventTable(spark, f"{place}/events")
    requests = request_rows(spark, C.requests_path(spark, sf_dir), f"{place}/log", BATCH_ROWS, 0.0)
    batches = BatchSizes()
    spark.streams.addListener(batches)
    try:
        # the log is not in the order of its times, so a redelivery may be as far away as the log is long
        query = L.start_ingest(
            requests, C.group_map(spark, sf_dir), table, f"{place}/checkpoint", interval="0 seconds", window="3650 days", small=True
        )
        try:
            query.processAllAvailable()
        finally:
            query.stop()
        sizes = batches.of(query)
    finally:
        spark.streams.removeListener(batches)
    seen, largest = sum(sizes.values()), max(sizes.values(), default=0)
    return table.read().agg(F.count(F.lit(1)).alias("events"), F.count_distinct("request_id").alias("requests_with_events")).select(
        "events", "requests_with_events", F.lit(seen).alias("requests"), F.lit(largest).alias("largest_batch")
    )


def _refreshed(spark, sf_dir):
    """Diff after several refreshes, each of which reads the days of its own batch only."""
    place, now = new_place(spark, "refresh"), C.as_of(spark, sf_dir)
    table, mappings, groups = EventTable(spark, f"{place}/events"), C.mappings(spark, sf_dir), C.group_map(spark, sf_dir)
    partials, snapshots = P.field_partials(table, f"{place}/partials"), Snapshots(spark, f"{place}/results", SCHEMAS)
    events, new_only = C.usage_events(spark, sf_dir), True
    ends = [now.date() - timedelta(days=n) for n in (5, 2, 0)]
    for batch, (start, end) in enumerate(zip([None, *ends], ends)):
        part = events.filter(F.col("event_date") <= F.lit(end))
        table.append(part if start is None else part.filter(F.col("event_date") > F.lit(start)), "sample", batch)
        read = refresh_usage(partials, snapshots, mappings, groups, now)
        new_only &= all(start is None or d > start.isoformat() for d in read)
    return snapshots.read("mapping_diff").select(
        "index_group", "field_name", "mapped_type", "total_references", "last_seen", "classification", F.lit(new_only).alias("new_days_only")
    )


def _window_stats(spark, sf_dir):
    """Usage statistics of the lookback window from hourly partials of all days."""
    place, now = new_place(spark, "usage_partials"), C.as_of(spark, sf_dir)
    table = EventTable(spark, f"{place}/events")
    table.append(C.usage_events(spark, sf_dir))
    partials = P.stats_partials(table, f"{place}/partials")
    partials.update()
    return A.stats_of_cells(partials.window(now - timedelta(hours=M.LOOKBACK_HOURS))).select(
        "index_group", "lookback_p50_seconds", "lookback_p95_seconds", "search_count", "write_count"
    )


START = datetime(2024, 1, 10, 5, 30)


def _sketched(spark, sf_dir):
    """Estimates from merged sketches beside exact figures: are they within the stated errors?"""
    place, events = new_place(spark, "sketches"), C.usage_events(spark, sf_dir)
    table = EventTable(spark, f"{place}/events")
    for _ in _in_batches(spark, sf_dir, table, 2):
        pass
    partials = S.sketch_partials(table, f"{place}/partials")
    partials.update()
    found = S.estimates(partials, START, {"p50": 0.5, "p95": 0.95})
    recent = events.filter(F.col("timestamp") >= F.lit(START))
    exact = recent.groupBy("index_group").agg(*[F.count_distinct(c).alias(f"exact_{n}") for n, c in S.DISTINCT.items()])
    ranks = recent.join(found.select("index_group", "p50", "p95"), "index_group").groupBy("index_group").agg(
        F.count("response_time_ms").alias("_n"),
        *[F.count_if(F.col("response_time_ms") <= F.col(p)).alias(f"_upto_{p}") for p in ("p50", "p95")],
        *[F.count_if(F.col("response_time_ms") < F.col(p)).alias(f"_below_{p}") for p in ("p50", "p95")],
    )

    def near(name: str, rank: float):
        slack = S.RANK_ERROR * F.col("_n") + 1
        return (F.col(f"_below_{name}") <= rank * F.col("_n") + slack) & (F.col(f"_upto_{name}") >= rank * F.col("_n") - slack)

    within = lambda n: F.abs(F.col(n) - F.col(f"exact_{n}")) <= F.ceil(S.DISTINCT_ERROR * F.col(f"exact_{n}"))
    return found.join(exact, "index_group").join(ranks, "index_group").select(
        "index_group", "requests", *[f"exact_{n}" for n in S.DISTINCT], *[within(n).alias(f"{n}_near") for n in S.DISTINCT],
        near("p50", 0.5).alias("p50_near"), near("p95", 0.95).alias("p95_near"),
    )


# --- Groups as of a time ---------------------------------------------------------------------

MOVED = datetime(2024, 1, 16)


def _as_of(spark, sf_dir):
    """Events built anew from the log, while orders-us has joined another group midway."""
    today = C.group_map(spark, sf_dir)
    read_at = F.explode(F.array(*[F.lit(MOVED + timedelta(days=d)) for d in (-400, -3, 0, 2)]))
    moved = (F.col("index_name") == "orders-us") & (F.col("seen_at") >= F.lit(MOVED))
    history = today.withColumn("seen_at", read_at).withColumn("index_group", F.when(moved, "archive").otherwise(F.col("index_group")))
    events = E.build_usage_events(C.requests(spark, sf_dir), group_intervals(history), once=True)
    return events.groupBy("index", "index_group").agg(F.count(F.lit(1)).alias("count"))


# --- Keyed tables ----------------------------------------------------------------------------


def _merged_products(spark, sf_dir):
    """Products as a stored table; the documents arrive in three merges, and one more that changes one row."""
    table = K.KeyedTable(spark, new_place(spark, "product_table"), ["product_id"], "product_id int, title string, price double", parts=16)
    cast = lambda df: df.selectExpr("cast(product_id as int) AS product_id", "title", "cast(price as double) AS price")
    table.merge(cast(B.products(spark, sf_dir)))
    docs = _documents(spark, sf_dir)
    newest = docs.groupBy("product_id").agg(F.max_by(F.struct("title", "price"), F.struct("changed_at", "line")).alias("doc"))
    newest = newest.select("product_id", "doc.*")
    for batch in range(3):
        table.merge(cast(newest.filter(F.col("product_id") % 3 == batch)), stream="documents", batch=batch)
    before = table.parts()
    table.merge(cast(newest.filter(F.col("product_id") == 1007)))
    rewritten = sum(path != before[part] for part, path in table.parts().items())
    return table.read().withColumn("parts_rewritten", F.lit(rewritten))


def _snapshots(spark, sf_dir):
    """Diff tables of two refreshes, each of its own groups."""
    results = Snapshots(spark, new_place(spark, "snapshots"), SCHEMAS)
    diff = C.mapping_diff_table(spark, sf_dir)
    results.replace("mapping_diff", diff.withColumn("classification", F.lit("stale")), diff)
    for group in ("orders", "products"):
        rows = diff.filter(F.col("index_group") == group)
        results.replace("mapping_diff", rows, rows)
    return results.read("mapping_diff").select("index_group", "field_name", "classification", "total_references")


# --- Selection -------------------------------------------------------------------------------


def _prices(spark, sf_dir):
    lines = read_table(spark, sf_dir, "lineitem")
    found = None
    for name, p in (("p50", 0.5), ("p99", 0.99)):
        part = ranked_percentile(lines, ["l_returnflag"], "l_extendedprice", p, name, limit=1000)
        found = part if found is None else found.join(part, "l_returnflag")
    return found.select("l_returnflag", *[F.round(n, 4).alias(n) for n in ("p50", "p99")])


# --- Mappings that grow with the tables ------------------------------------------------------

_CRM_CTES = (
    "customers AS (SELECT "
    + ", ".join(f'{sql} AS "{name}"' for name, sql in {"index_group": CRM_INDEX.replace(" div ", " // "), **CRM_FIELD}.items())
    + " FROM customer), crm AS (SELECT index_group, concat(segment, '.', name) AS field_name, type AS mapped_type, NOT off AS is_indexed, "
    "NOT row_only AND type <> 'text' AS has_doc_values FROM customers UNION ALL "
    "SELECT index_group, concat(segment, '.', name, '.keyword'), 'keyword', true, true FROM customers WHERE sub)"
)
_NEW_TYPE = "CASE WHEN mapped_type = 'long' THEN 'double' ELSE mapped_type END"


def _crm_history(spark, sf_dir):
    """The mappings as they are, and as they were: dates not yet there, whole numbers still long."""
    new = C.crm_fields(spark, sf_dir)
    old = new.filter("mapped_type <> 'date'")
    retyped = new.withColumn("mapped_type", F.expr(_NEW_TYPE)).filter("field_name NOT LIKE '%.f1'")
    return old, retyped


# --- Clients and templates -------------------------------------------------------------------


def _findings(spark, sf_dir):
    """Findings refreshed twice: the first time as if every group were in trouble."""
    profile, shards, now = C.tenant_profile(spark, sf_dir), C.tenant_shards(spark, sf_dir), C.as_of(spark, sf_dir)
    results = Snapshots(spark, new_place(spark, "findings"), SCHEMAS)
    for replicas in (F.lit(0).cast("long"), F.col("number_of_replicas")):
        found = refresh_findings(profile.withColumn("number_of_replicas", replicas), shards, now, results)
    return found


# --- Requests out of the ordinary ------------------------------------------------------------

LIMITED = E.EventSettings(body_limit=4096, text_limit=100, event_sample_rate=0.5)
_SENT = f"elapsed_ms IS NOT NULL AND NOT {SKIPPED}"
_SAMPLED = _keep_sql("", 0.5)


def _limited(spark, sf_dir):
    return E.build_usage_events(C.requests(spark, sf_dir), C.group_map(spark, sf_dir), LIMITED, once=True)


QUERIES: dict[str, Query] = {
    "l01_compacted": Query(_compacted, with_events(f"SELECT {_STAMP}, {_EVENT_LIST}, {LISTS}, true AS few_folders FROM ev")),
    "l02_batched": Query(
        _by_rows,
        with_events(
            "SELECT count(*) AS events, count(DISTINCT request_id) AS requests_with_events, (SELECT count(*) FROM events) AS requests, "
            f"(SELECT least(count(*), {BATCH_ROWS}) FROM events) AS largest_batch FROM ev"
        ),
    ),
    "l05_refresh": Query(
        _refreshed,
        with_events(
            f"SELECT index_group, field_name, mapped_type, total_references, {stamp_sql('last_seen', 'last_seen')}, classification, "
            "true AS new_days_only FROM diff", REFS_CTE, USAGE_CTE, FIELDS_CTE, DIFF_CTE,
        ),
    ),
    "l05_window_stats": Query(
        _window_stats,
        with_events(
            "SELECT index_group, CASE WHEN p95 <> 0 OR p50 <> 0 THEN p50 END AS lookback_p50_seconds, "
            "CASE WHEN p95 <> 0 OR p50 <> 0 THEN p95 END AS lookback_p95_seconds, search_count, write_count FROM ("
            "SELECT index_group, round(quantile_cont(lookback_seconds, 0.5), 4) AS p50, round(quantile_cont(lookback_seconds, 0.95), 4) AS p95, "
            "count(*) FILTER (operation IN ('search', 'async_search', 'count')) AS search_count, "
            "count(*) FILTER (operation IN ('bulk', 'index', 'update', 'delete')) AS write_count FROM recent GROUP BY 1)",
            REFS_CTE,
        ),
    ),
    "l05_findings": Query(
        lambda spark, sf_dir: _findings(spark, sf_dir).groupBy("index_group", "recommendation", "severity").agg(F.count(F.lit(1)).alias("count")),
        "SELECT index_group, recommendation, severity, count(*) AS count FROM ("
        + H_QUERIES["h25_index_recommendations"].sql + ") GROUP BY 1, 2, 3",
    ),
    "e44_client_activity": Query(
        lambda spark, sf_dir: U.client_activity(C.usage_events(spark, sf_dir)),
        with_events(
            f"SELECT {NO_CLIENT} AS client_id, count(*) AS count, string_agg(DISTINCT index_group, ',' ORDER BY index_group) AS index_groups, "
            f"{stamp_sql('max(' + chr(34) + 'timestamp' + chr(34) + ')', 'last_seen')} FROM ev GROUP BY 1"
        ),
    ),
    "j08_template_fields": Query(
        lambda spark, sf_dir: J.template_fields(C.usage_events(spark, sf_dir), 10, 3),
        with_events(
            "SELECT query_template_hash, total / 100.0 AS total_ms, field, n AS count FROM (SELECT *, row_number() OVER "
            "(PARTITION BY query_template_hash ORDER BY n DESC, field) AS r FROM (SELECT query_template_hash, field, count(*) AS n FROM "
            "(SELECT query_template_hash, unnest(queried) AS field FROM ev) GROUP BY 1, 2) JOIN top USING (query_template_hash)) WHERE r <= 3",
            "top AS (SELECT query_template_hash, sum(cents) AS total FROM ev WHERE query_template_hash IS NOT NULL GROUP BY 1 "
            "ORDER BY 2 DESC, 1 LIMIT 10)",
        ),
    ),
    "d08_sketches": Query(
        _sketched,
        with_events(
            "SELECT index_group, count(*) AS requests, count(DISTINCT client_ip) AS exact_clients, "
            "count(DISTINCT query_template_hash) AS exact_templates, true AS clients_near, true AS templates_near, "
            "true AS p50_near, true AS p95_near FROM ev WHERE \"timestamp\" >= TIMESTAMP '2024-01-10 05:30:00' GROUP BY 1"
        ),
    ),
    "d09_price_percentiles": Query(
        _prices,
        "SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.5), 4) AS p50, round(quantile_cont(l_extendedprice, 0.99), 4) AS p99 "
        "FROM lineitem GROUP BY 1",
    ),
    "c01_group_as_of": Query(
        _as_of,
        with_events(
            "SELECT \"index\", CASE WHEN \"index\" = 'orders-us' AND \"timestamp\" >= TIMESTAMP '2024-01-16' THEN 'archive' "
            "ELSE index_group END AS index_group, count(*) AS count FROM ev GROUP BY 1, 2"
        ),
    ),
    "k14_merge": Query(
        _merged_products,
        _sql(
            "SELECT p.product_id, p.title, CAST(p.price AS DOUBLE) AS price, 1 AS parts_rewritten FROM products p LEFT JOIN docs ON "
            "p.product_id = docs.product_id WHERE docs.product_id IS NULL UNION ALL "
            "SELECT product_id, title, CAST(price AS DOUBLE), 1 FROM docs",
            PRODUCTS, UPDATES, NEWEST_DOCS,
        ),
    ),
    "a10_snapshots": Query(
        _snapshots,
        with_events(
            "SELECT index_group, field_name, CASE WHEN index_group IN ('orders', 'products') THEN classification ELSE 'stale' END AS classification, "
            "total_references FROM diff", REFS_CTE, USAGE_CTE, FIELDS_CTE, DIFF_CTE,
        ),
    ),
    "f01_crm_fields": Query(
        lambda spark, sf_dir: C.crm_fields(spark, sf_dir),
        f"WITH {_CRM_CTES} SELECT index_group, field_name, mapped_type, is_indexed, has_doc_values FROM crm",
    ),
    "a08_crm_info": Query(
        lambda spark, sf_dir: cluster.mapping_info(C.crm_mapping_table(spark, sf_dir), crm_groups(C.crm_mapping_table(spark, sf_dir))),
        f"WITH {_CRM_CTES} SELECT index_group, CAST(count(*) AS INT) AS field_count, true AS source_enabled FROM crm GROUP BY 1",
    ),
    "j05_crm_conflicts": Query(
        lambda spark, sf_dir: J.type_conflicts(C.crm_fields(spark, sf_dir)),
        f"WITH {_CRM_CTES} SELECT field_name, string_agg(DISTINCT mapped_type, ',' ORDER BY mapped_type) AS types, "
        "count(DISTINCT index_group) AS groups FROM crm GROUP BY 1 HAVING count(DISTINCT mapped_type) > 1",
    ),
    "j05_multifield_gaps": Query(
        lambda spark, sf_dir: J.multi_field_gaps(C.crm_fields(spark, sf_dir)),
        f"WITH {_CRM_CTES} SELECT index_group, field_name FROM crm WHERE concat(field_name, '.keyword') IN (SELECT field_name FROM crm) "
        "AND (index_group, concat(field_name, '.keyword')) NOT IN (SELECT (index_group, field_name) FROM crm)",
    ),
    "j07_crm_history": Query(
        lambda spark, sf_dir: J.mapping_history(*_crm_history(spark, sf_dir)),
        f"WITH {_CRM_CTES}, o AS (SELECT * FROM crm WHERE mapped_type <> 'date'), "
        f"n AS (SELECT index_group, field_name, {_NEW_TYPE} AS mapped_type FROM crm WHERE field_name NOT LIKE '%.f1') "
        "SELECT index_group, field_name, o.mapped_type AS old_type, n.mapped_type AS new_type, CASE WHEN o.mapped_type IS NULL THEN 'added' "
        "WHEN n.mapped_type IS NULL THEN 'removed' ELSE 'retyped' END AS change FROM o FULL JOIN n USING (index_group, field_name) "
        "WHERE o.mapped_type IS DISTINCT FROM n.mapped_type",
    ),
    "a01_large_bodies": Query(
        lambda spark, sf_dir: _limited(spark, sf_dir).select(
            "request_id", F.size(F.col("fields.queried")).alias("queried"), F.col("query_fingerprint").isNull().alias("unparsed"), "operation"
        ),
        with_events(
            "SELECT ev.request_id, CASE WHEN strlen(query_body) > 4096 THEN 0 ELSE CAST(len(queried) AS INT) END AS queried, "
            "(strlen(query_body) > 4096 OR query_fingerprint IS NULL) AS unparsed, operation FROM ("
            f"SELECT * FROM ev WHERE {_SAMPLED} UNION ALL BY NAME SELECT * FROM lost_ev) ev",
            f"lost_ev AS (SELECT request_id, operation, body AS query_body, [] AS queried, NULL AS query_fingerprint FROM req "
            f"WHERE lost AND {_SENT} AND {_SAMPLED})",
        ),
    ),
    "b32_long_templates": Query(
        lambda spark, sf_dir: _limited(spark, sf_dir).filter("octet_length(query_template_text) >= 100").select(
            "request_id", "query_template_text", F.length("query_body").alias("body_chars")
        ),
        with_events(
            "SELECT request_id, left(query_template_text, 100) AS query_template_text, CAST(least(length(query_body), 100) AS INT) AS body_chars "
            f"FROM ev WHERE strlen(query_body) <= 4096 AND length(query_template_text) >= 100 AND {_SAMPLED}"
        ),
    ),
    "b_rejects": Query(
        lambda spark, sf_dir: E.rejected_requests(C.requests(spark, sf_dir)),
        with_requests(
            f"SELECT request_id, {stamp_sql('ts', 'ts')}, path, strlen(body)::BIGINT AS body_bytes FROM req WHERE lost AND {_SENT}"
        ),
    ),
    "e43_limited_counters": Query(
        lambda spark, sf_dir: E.traffic_counters(C.requests(spark, sf_dir), _limited(spark, sf_dir), LIMITED),
        with_requests(
            "SELECT count(*) AS requests_proxied, count(*) FILTER (elapsed_ms IS NULL) AS requests_failed, "
            f"count(*) FILTER ({_SENT} AND {_SAMPLED} AND strlen(coalesce(body, '')) > 4096) AS requests_unobserved, "
            f"count(*) FILTER (elapsed_ms IS NOT NULL AND {SKIPPED}) AS events_skipped, "
            f"count(*) FILTER ({_SENT} AND NOT {_SAMPLED}) AS events_sampled_out, "
            "count(*) FILTER (false) AS extraction_errors, "
            f"count(*) FILTER ({_SENT} AND {_SAMPLED}) AS events_emitted, "
            "round(sum(CAST(round(elapsed_ms * 100) AS BIGINT)) / 100.0 / count(elapsed_ms), 2) AS response_avg_ms, "
            "max(elapsed_ms) AS response_max_ms FROM req"
        ),
    ),
}
