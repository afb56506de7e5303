"""Registered index-structure queries: inputs, profile, rules and dashboards."""

from __future__ import annotations

from catalogue.common import Query, stamp_sql
from catalogue.events_sql import with_events
from catalogue.usage import terms_sql
from seekledger.plans import architecture as A
from seekledger.plans.texts import IMPACT, INDEX_HOW, INDEX_RULES, INDEX_WHY
from seekledger.samples import catalog as C
from seekledger.samples import cluster_tables as T

_MAP = "map {" + ", ".join(f"'{k}': {v}" for k, v in T.SETTINGS.items()) + "}"

TENANT_CTES = f"""tenants AS (SELECT *, {T.INDEX_NAME} AS "index", {T.GROUP_NAME} AS index_group, {T.PRIMARIES} AS pri, {T.REPLICAS} AS rep
  FROM (SELECT c_custkey AS ck, c_nationkey AS nk, coalesce(n, 0) AS n, coalesce(cents, 0) AS cents, first FROM customer LEFT JOIN
    (SELECT o_custkey, count(*) AS n, sum(cast(round(o_totalprice * 100) AS bigint)) AS cents, min(o_orderdate) AS first FROM orders GROUP BY 1)
    ON c_custkey = o_custkey)),
shards AS (SELECT "index", index_group, copy, {T.STATE} AS state, n * ({T.DOCS_FACTOR}) AS docs,
  CAST(cents * ({T.STORE_FACTOR}) // (100 * pri) AS BIGINT) AS store, CASE WHEN ck % 97 <> 0 THEN {T.NODE} END AS node
  FROM (SELECT *, unnest(range(rep + 1)) AS copy FROM (SELECT *, unnest(range(pri)) AS shard FROM tenants)))"""
SHARD_CTE = """shard_stats AS (SELECT index_group, count(*) AS primary_shard_count, CAST(sum(store) AS BIGINT) AS total_primary_store_bytes,
  CAST(sum(store) // count(*) AS BIGINT) AS avg_primary_shard_size_bytes, max(docs) AS max_docs_per_primary_shard
  FROM shards WHERE copy = 0 AND state = 'STARTED' GROUP BY 1)"""
_CLIENT = "cast(split_part(client_ip, '.', 4) as int) % 5"
USAGE_CTES = f"""tev AS (SELECT 'tenant-' || lpad(cast({T.TENANT_OF_EVENT} + {_CLIENT} AS varchar), 2, '0') AS g, sorted, lookback_seconds AS lb, operation
  FROM ev WHERE "timestamp" >= (SELECT max("timestamp") FROM ev) - INTERVAL 168 HOUR),
sorts AS (SELECT g, f, uses, row_number() OVER (PARTITION BY g ORDER BY uses DESC, f) AS r FROM
  (SELECT g, f, count(*) AS uses FROM (SELECT g, unnest(sorted) AS f FROM tev) GROUP BY 1, 2)),
usage AS (SELECT tev.g AS index_group,
  CASE WHEN quantile_cont(lb, 0.5) <> 0 OR quantile_cont(lb, 0.95) <> 0 THEN round(quantile_cont(lb, 0.5), 4) END AS lookback_p50_seconds,
  CASE WHEN quantile_cont(lb, 0.5) <> 0 OR quantile_cont(lb, 0.95) <> 0 THEN round(quantile_cont(lb, 0.95), 4) END AS lookback_p95_seconds,
  max(sorts.f) AS dominant_sort_field, max(sorts.uses) / count(*) FILTER (len(sorted) > 0) AS dominant_sort_pct,
  count(*) FILTER (operation IN ('search', 'async_search', 'count')) AS search_count,
  count(*) FILTER (operation IN ('bulk', 'index', 'update', 'delete')) AS write_count
  FROM tev LEFT JOIN sorts ON tev.g = sorts.g AND r = 1 GROUP BY 1)"""
_SETTING = {
    "number_of_replicas": "coalesce(try_cast(x0 AS bigint), 1)",
    "tier_preference": "x1",
    "index_codec": "x2",
    "blocks_write": "coalesce(x3 = 'true', false)",
    "refresh_interval": "x4",
    "index_sort_field": "CASE WHEN x5 LIKE '[%' THEN array_to_string(from_json(x5, '[\"varchar\"]'), ',') ELSE x5 END",
    "total_fields_limit": "coalesce(try_cast(x6 AS bigint), 1000)",
    "translog_durability": "coalesce(x7, 'request')",
    "max_merged_segment": "x8",
}
PROFILE_CTES = f"""settings AS (SELECT index_group, {', '.join(f'{v} AS {k}' for k, v in _SETTING.items())} FROM
  (SELECT index_group, {', '.join(f'{v} AS x{i}' for i, v in enumerate(T.SETTINGS.values()))} FROM tenants
   WHERE "index" IN (SELECT max("index") FROM tenants GROUP BY index_group))),
rollover AS (SELECT index_group, quantile_cont(gap, 0.5) AS estimated_rollover_hours FROM (SELECT index_group,
  (epoch_us(first) - epoch_us(lag(first) OVER w)) / 3.6e9::DOUBLE AS gap
  FROM tenants WHERE first IS NOT NULL WINDOW w AS (PARTITION BY index_group ORDER BY first)) WHERE gap > 0 GROUP BY 1),
stats AS (SELECT index_group, count(*) AS index_count,
  sum(CASE WHEN nk % 12 <> 6 THEN {T.SEGMENTS} ELSE 0 END) AS segs, min(nk) AS nk FROM tenants GROUP BY 1),
profile AS (SELECT stats.index_group, index_count, coalesce(primary_shard_count, 0) AS primary_shard_count,
  coalesce(total_primary_store_bytes, 0) AS total_primary_store_bytes, coalesce(avg_primary_shard_size_bytes, 0) AS avg_primary_shard_size_bytes,
  coalesce(max_docs_per_primary_shard, 0) AS max_docs_per_primary_shard, {', '.join('settings.' + k for k in _SETTING)},
  CASE WHEN nk % 2 = 0 THEN 16 ELSE 10 END AS field_count, nk % 2 = 0 AS source_enabled, estimated_rollover_hours,
  lookback_p50_seconds, lookback_p95_seconds, dominant_sort_field, dominant_sort_pct, coalesce(search_count, 0) AS search_count,
  coalesce(write_count, 0) AS write_count,
  CASE WHEN primary_shard_count > 0 THEN CAST(segs // primary_shard_count AS BIGINT) ELSE 0 END AS avg_segments_per_primary
  FROM stats LEFT JOIN shard_stats USING (index_group) LEFT JOIN settings USING (index_group)
  LEFT JOIN rollover USING (index_group) LEFT JOIN usage USING (index_group))"""

PROFILE_COLUMNS = (
    "index_group index_count primary_shard_count total_primary_store_bytes "
    "avg_primary_shard_size_bytes max_docs_per_primary_shard number_of_replicas tier_preference index_codec blocks_write "
    "refresh_interval index_sort_field total_fields_limit translog_durability max_merged_segment field_count source_enabled "
    "estimated_rollover_hours lookback_p50_seconds lookback_p95_seconds dominant_sort_field dominant_sort_pct search_count "
    "write_count avg_segments_per_primary"
).split()


def _bytes(n: str) -> str:
    return (
        f"CASE WHEN {n} >= 1000000000 THEN printf('%.1fGB', {n} / 1e9) WHEN {n} >= 1000000 THEN printf('%.0fMB', {n} / 1e6) "
        f"ELSE printf('%.0fKB', {n} / 1e3) END"
    )


def _span(h: str) -> str:
    return f"CASE WHEN {h} < 48 THEN printf('%.0fh', {h}) ELSE printf('%.0fd', {h} / 24) END"


_AVG, _TOTAL = "avg_primary_shard_size_bytes", "total_primary_store_bytes"
_TIER = "coalesce(tier_preference, '')"
_FIRST = f"replace(split_part({_TIER}, ',', 1), 'data_', '')"
_COLD = f"({_TIER} LIKE '%cold%' OR {_TIER} LIKE '%frozen%')"
_LB, _RO = "(lookback_p95_seconds / 3600)", "estimated_rollover_hours"
_DOCS = "max_docs_per_primary_shard"

# code: (condition, critical condition, observed value)
RULE_SQL = {
    "shard_too_small": (f"primary_shard_count > 1 AND {_AVG} < 1000000000", None,
                        f"concat(primary_shard_count, ' primary shards x ', {_bytes(_AVG)}, ' avg = ', {_bytes(_TOTAL)}, ' total')"),
    "shard_too_large": (f"primary_shard_count > 0 AND {_AVG} >= 50000000000", f"{_AVG} > 100000000000",
                        f"concat(primary_shard_count, ' primary shards averaging ', {_bytes(_AVG)}, ' each')"),
    "replica_risk": (f"number_of_replicas = 0 AND {_TIER} NOT LIKE '%frozen%'", None, "'0 replicas configured'"),
    "replica_waste": (f"number_of_replicas <> 0 AND {_COLD}", None,
                      f"concat(number_of_replicas, ' replica(s) on ', {_FIRST}, ' tier')"),
    "codec_opportunity": (f"index_codec IS NULL AND (blocks_write OR {_COLD} OR {_TIER} LIKE '%warm%')", None,
                          f"concat('Default codec (LZ4) on ', CASE WHEN blocks_write THEN 'read-only' ELSE {_FIRST} || ' tier' END, "
                          f"' index (', {_bytes(_TOTAL)}, ')')"),
    "field_count_near_limit": ("total_fields_limit > 0 AND field_count / total_fields_limit >= 0.8",
                               "field_count / total_fields_limit > 0.95",
                               "concat(field_count, ' fields mapped out of ', total_fields_limit, ' limit (', "
                               "cast(floor(field_count / total_fields_limit * 100) as int), '%)')"),
    "source_disabled": ("NOT source_enabled", None, "'_source: false'"),
    "rollover_lookback_mismatch": (f"{_RO} > 0 AND {_LB} > 2 * {_RO}", None,
                                   f"concat('Rollover ~', {_span(_RO)}, ', p95 query lookback ', {_span(_LB)}, ' (~', "
                                   f"printf('%.0f', {_LB} / {_RO}), ' indices per query)')"),
    "index_sorting_opportunity": ("dominant_sort_pct >= 0.7 AND coalesce(index_sort_field, '') = ''", None,
                                  "concat(cast(floor(dominant_sort_pct * 100) as int), '% of sorted queries use ''', "
                                  "dominant_sort_field, ''', index is unsorted')"),
    "refresh_interval_opportunity": ("write_count > 0 AND write_count >= 10 * search_count AND "
                                     "coalesce(refresh_interval, '1s') IN ('1s', '1000ms')", None,
                                     "concat('Refresh: ', coalesce(refresh_interval, '1s (default)'), ' | Writes: ', "
                                     "format('{:,}', write_count), '/period | Searches: ', format('{:,}', search_count), '/period')"),
    "translog_async": ("translog_durability = 'async'", None, "'index.translog.durability = async'"),
    "force_merge_opportunity": ("blocks_write AND avg_segments_per_primary > 5 AND primary_shard_count > 0", None,
                                "concat('Read-only index with ~', avg_segments_per_primary, ' segments/shard (', primary_shard_count, "
                                f"' primary shards, ', {_bytes(_TOTAL)}, ' total)')"),
    "merge_policy_tuning": (f"{_AVG} >= 50000000000 AND (max_merged_segment IS NULL OR max_merged_segment <> '10gb')", None,
                            f"concat('Avg shard size ', {_bytes(_AVG)}, ' with max_merged_segment = ', "
                            "coalesce(max_merged_segment, '5gb (default)'))"),
    "shard_docs_limit": (f"{_DOCS} > 200000000", f"{_DOCS} > 500000000",
                         f"concat('Max docs per primary shard: ', printf('%.0fM', {_DOCS} / 1e6), ' (', primary_shard_count, ' primary shards)')"),
}


# Values the advice texts may name.
TEXT_SQL = {
    "shards": "primary_shard_count",
    "avg_size": _bytes(_AVG),
    "replicas": "number_of_replicas",
    "tier": _FIRST,
    "reason": f"CASE WHEN blocks_write THEN 'read-only' ELSE {_FIRST} || ' tier' END",
    "fields": "field_count",
    "limit": "total_fields_limit",
    "field_pct": "cast(floor(field_count / total_fields_limit * 100) as int)",
    "rollover": _span(_RO),
    "lookback": _span(_LB),
    "indices_hit": f"printf('%.0f', {_LB} / {_RO})",
    "sort_pct": "cast(floor(dominant_sort_pct * 100) as int)",
    "sort_field": "dominant_sort_field",
    "writes": "format('{:,}', write_count)",
    "searches": "format('{:,}', search_count)",
    "segments": "avg_segments_per_primary",
    "docs": f"printf('%.0fM', {_DOCS} / 1e6)",
    "impact": f"CASE WHEN {_DOCS} > 500000000 THEN '{IMPACT['docs_critical']}' ELSE '{IMPACT['docs_warning']}' END",
    "shard_target": "greatest(primary_shard_count * 2, 2)",
}
NODE_TEXT_SQL = {
    "node": "node",
    "node_shards": "format('{:,}', n)",
    "impact": f"CASE WHEN n > 1500 THEN '{IMPACT['node_critical']}' ELSE '{IMPACT['node_warning']}' END",
}


def _text_sql(template: str, values: dict[str, str]) -> str:
    sql = "'" + template.replace("'", "''") + "'"
    for name, value in values.items():
        marker = "{" + name + "}"
        if marker in template:
            sql = f"replace({sql}, '{marker}', cast({value} as varchar))"
    return sql


def _texts_sql() -> str:
    parts = [
        f"SELECT index_group, '{code}' AS recommendation, {_text_sql(INDEX_WHY[code], TEXT_SQL)} AS why, "
        f"{_text_sql(INDEX_HOW[code], TEXT_SQL)} AS how FROM profile WHERE {RULE_SQL[code][0]}"
        for code in RULE_SQL
    ]
    node = "node_shard_count"
    parts.append(
        f"SELECT '_cluster', '{node}', {_text_sql(INDEX_WHY[node], NODE_TEXT_SQL)}, {_text_sql(INDEX_HOW[node], NODE_TEXT_SQL)} "
        "FROM (SELECT node, count(*) AS n FROM shards WHERE state = 'STARTED' AND node IS NOT NULL GROUP BY 1) WHERE n > 1000"
    )
    return with_events(" UNION ALL ".join(parts), *_PROFILE)


def _rule_sql(code: str) -> str:
    condition, critical, current = RULE_SQL[code]
    category, usual, breaking, page = INDEX_RULES[code]
    severity = f"CASE WHEN {critical} THEN 'critical' ELSE '{usual}' END" if critical else f"'{usual}'"
    return (
        f"SELECT index_group, '{category}' AS category, '{code}' AS recommendation, {severity} AS severity, "
        f"{current} AS current_value, '{page}' AS reference_url, {str(breaking).lower()} AS breaking_change "
        f"FROM profile WHERE {condition}"
    )


_NODE_SQL = (
    "SELECT '_cluster' AS index_group, 'cluster_health' AS category, 'node_shard_count' AS recommendation, "
    "CASE WHEN n > 1500 THEN 'critical' ELSE 'warning' END AS severity, "
    "concat('Node ''', node, ''' has ', format('{:,}', n), ' shards') AS current_value, "
    f"'{INDEX_RULES['node_shard_count'][3]}' AS reference_url, false AS breaking_change FROM "
    "(SELECT node, count(*) AS n FROM shards WHERE state = 'STARTED' AND node IS NOT NULL GROUP BY 1) WHERE n > 1000"
)
FINDINGS_CTE = "findings AS (" + " UNION ALL ".join([*map(_rule_sql, RULE_SQL), _NODE_SQL]) + ")"
_PROFILE = (TENANT_CTES, SHARD_CTE, USAGE_CTES, PROFILE_CTES)
_NOW = stamp_sql("(SELECT max(\"timestamp\") FROM ev)", "\"timestamp\"")
_FINDING = "index_group, category, recommendation, severity, current_value, reference_url, breaking_change"


def _findings_sql(select: str) -> str:
    return with_events(select, *_PROFILE, FINDINGS_CTE)


def _on_findings(rollup):
    return lambda spark, sf_dir: rollup(C.tenant_findings(spark, sf_dir))


def _rule_query(code: str) -> Query:
    columns = _FINDING.split(", ")
    return Query(
        lambda spark, sf_dir: A.group_findings(C.tenant_profile(spark, sf_dir))
        .filter(f"recommendation = '{code}'")
        .select(*columns),
        with_events(_rule_sql(code), *_PROFILE),
    )


_NUMBERS = {code: at for at, code in enumerate(INDEX_RULES, start=9)}
QUERIES: dict[str, Query] = {
    "h01_usage_stats": Query(
        lambda spark, sf_dir: C.tenant_usage_stats(spark, sf_dir), with_events("SELECT * FROM usage", USAGE_CTES)
    ),
    "h02_shard_stats": Query(
        lambda spark, sf_dir: A.shard_stats(C.tenant_shards(spark, sf_dir), C.tenant_group_map(spark, sf_dir)),
        f"WITH {TENANT_CTES}, {SHARD_CTE} SELECT * FROM shard_stats",
    ),
    "h05_rollover_hours": Query(
        lambda spark, sf_dir: A.rollover_hours(T.cat_indices(spark, sf_dir), C.tenant_group_map(spark, sf_dir)),
        with_events("SELECT * FROM rollover", *_PROFILE),
    ),
    "h04_settings": Query(
        lambda spark, sf_dir: A.representative_settings(T.settings(spark, sf_dir), C.tenant_group_map(spark, sf_dir))
        .fillna(False, ["blocks_write"]),
        with_events("SELECT * FROM settings", *_PROFILE),
    ),
    "h08_index_dates": Query(
        lambda spark, sf_dir: A.index_dates(T.cat_indices(spark, sf_dir), C.tenant_group_map(spark, sf_dir)),
        f"WITH {TENANT_CTES} SELECT index_group, \"index\", strftime(first, '%Y-%m-%dT%H:%M:%S.') || '000Z' AS creation_date FROM tenants",
    ),
    "h08_index_profile": Query(
        lambda spark, sf_dir: C.tenant_profile(spark, sf_dir).select(*PROFILE_COLUMNS),
        with_events("SELECT " + ", ".join(PROFILE_COLUMNS) + " FROM profile", *_PROFILE),
    ),
    **{f"h{_NUMBERS[code]:02d}_{code}": _rule_query(code) for code in RULE_SQL},
    "h21_node_shard_count": Query(
        lambda spark, sf_dir: A.node_findings(C.tenant_shards(spark, sf_dir)).select(*_FINDING.split(", ")),
        f"WITH {TENANT_CTES} {_NODE_SQL}",
    ),
    "h24_index_advice_texts": Query(
        lambda spark, sf_dir: C.tenant_findings(spark, sf_dir).select("index_group", "recommendation", "why", "how"),
        _texts_sql(),
    ),
    "h25_index_recommendations": Query(
        lambda spark, sf_dir: C.tenant_findings(spark, sf_dir).select("timestamp", *_FINDING.split(", ")),
        _findings_sql(f"SELECT {_NOW}, {_FINDING} FROM findings"),
    ),
    "h26_by_severity": Query(
        _on_findings(A.findings_by_severity), _findings_sql(terms_sql("severity", 10, source="findings"))
    ),
    "h27_by_category": Query(
        _on_findings(A.findings_by_category), _findings_sql(terms_sql("category", 10, source="findings"))
    ),
    "h28_group_severity": Query(
        _on_findings(A.findings_by_group_severity),
        _findings_sql(
            "SELECT index_group, severity, count(*) AS count FROM findings WHERE index_group IN (SELECT index_group FROM findings "
            "GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 20) GROUP BY 1, 2"
        ),
    ),
    "h29_all_findings": Query(
        lambda spark, sf_dir: A.all_findings(C.tenant_findings(spark, sf_dir)).drop("why", "how"),
        _findings_sql(
            "SELECT index_group, category, recommendation, severity, current_value, reference_url FROM findings"
        ),
    ),
    "h30_urgent_findings": Query(
        lambda spark, sf_dir: A.urgent_findings(C.tenant_findings(spark, sf_dir)).drop("why", "how"),
        _findings_sql(
            "SELECT index_group, recommendation, severity, current_value, reference_url FROM findings "
            "WHERE severity = 'critical' OR breaking_change"
        ),
    ),
}
