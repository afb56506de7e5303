"""Registered mapping queries: flattening, usage, diff, advice and their dashboards."""

from __future__ import annotations

from catalogue.common import Query, stamp_sql
from catalogue.events_sql import FIELDS, with_events
from catalogue.usage import nested_sql, terms_sql
from seekledger.plans import mapping as M
from seekledger.plans.texts import MAPPING_HOW, MAPPING_WHY
from seekledger.samples import catalog as C
from seekledger.sources import cluster

# Fields each sample mapping must flatten to: type, indexed, columnar. Written by hand.
_T, _K, _F, _I, _D = "text", "keyword", "float", "integer", "date"
EXPECTED = {
    "products": [
        ("title", _T, 1, 0), ("title.keyword", _K, 1, 1), ("description", _T, 1, 0), ("category", _T, 1, 0),
        ("subcategory", _K, 1, 1), ("brand", _K, 1, 1), ("price", _F, 1, 1), ("rating", _F, 1, 1),
        ("stock_count", _I, 1, 0), ("created_at", _D, 1, 1), ("internal_sku", _K, 0, 0),
        ("legacy_supplier_code", _K, 0, 1), ("tags", _K, 1, 1), ("dimensions.width", _F, 1, 1),
        ("dimensions.box.kind", _K, 1, 1), ("properties", "annotated_text", 1, 0),
    ],
    "logs": [
        ("timestamp", _D, 1, 1), ("level", _K, 1, 1), ("service", _K, 1, 1), ("host", _K, 1, 1),
        ("message", _T, 1, 0), ("status_code", _I, 1, 1), ("duration_ms", _F, 1, 1),
        ("user_agent", _K, 1, 1), ("internal_request_id", _K, 0, 1),
    ],
    "orders": [
        ("order_id", _K, 1, 1), ("customer_name", _T, 1, 0), ("customer_name.keyword", _K, 1, 1),
        ("order_date", _D, 1, 1), ("status", _T, 1, 0), ("total_amount", _F, 1, 1), ("item_count", _I, 1, 1),
        ("category", _K, 1, 1), ("channel", _K, 1, 1), ("internal_notes", _T, 1, 1),
    ],
}
EXPECTED["logs-stream"] = EXPECTED["logs"]

# Groups come from the index names of the log, so their fields are listed only if an index was seen.
FIELDS_CTE = (
    "declared(index_group, field_name, mapped_type, is_indexed, has_doc_values) AS (VALUES "
    + ", ".join(
        f"('{g}', '{n}', '{t}', {'true' if i else 'false'}, {'true' if d else 'false'})"
        for g, rows in EXPECTED.items()
        for n, t, i, d in rows
    )
    + "), mapped AS (SELECT * FROM declared WHERE index_group IN (SELECT index_group FROM ev))"
)
REFS_CTE = (
    "recent AS (SELECT * FROM ev WHERE \"timestamp\" >= (SELECT max(\"timestamp\") FROM ev) - INTERVAL 168 HOUR), refs AS ("
    + " UNION ALL ".join(
        f"SELECT index_group, \"timestamp\" AS ts, '{c}' AS category, unnest({c}) AS field_name FROM recent" for c in FIELDS
    )
    + ")"
)
USAGE_CTE = (
    "used AS (SELECT index_group, field_name, "
    + ", ".join(f"count(*) FILTER (category = '{c}') AS count_{c}" for c in FIELDS)
    + ", "
    + ", ".join(f"max(ts) FILTER (category = '{c}') AS last_seen_{c}" for c in FIELDS)
    + " FROM refs GROUP BY 1, 2)"
)
_COUNTS = ", ".join(f"coalesce(count_{c}, 0) AS count_{c}" for c in FIELDS)
_SEEN = ", ".join(f"last_seen_{c}" for c in FIELDS)
_TOTAL = " + ".join(f"count_{c}" for c in FIELDS)
DIFF_CTE = (
    f"joined AS (SELECT m.*, {_COUNTS}, {_SEEN} FROM mapped m LEFT JOIN used u USING (index_group, field_name)), "
    f"diff AS (SELECT *, {_TOTAL} AS total_references, greatest({_SEEN}) AS last_seen, "
    f"CASE WHEN {_TOTAL} = 0 THEN 'unused' WHEN count_queried + count_filtered + count_aggregated + count_sorted > 0 "
    "THEN 'active' WHEN count_sourced > 0 THEN 'sourced_only' ELSE 'write_only' END AS classification FROM joined)"
)


def _rule(code: str, condition: str, breaking: str = "false") -> str:
    return (
        f"SELECT index_group, field_name, mapped_type, classification, '{code}' AS recommendation, "
        f"{breaking} AS breaking_change FROM diff d WHERE {condition}"
    )


_EXACT = "classification = 'active' AND mapped_type = 'text' AND count_queried = 0 AND count_filtered > 0"
_PLAIN = "count_aggregated = 0 AND count_sorted = 0"
ADVICE_CTE = (
    "advice AS ("
    + " UNION ALL ".join(
        [
            _rule("disable_index", "classification IN ('write_only', 'sourced_only') AND (is_indexed OR has_doc_values)"),
            _rule("remove_multifield", "classification = 'unused' AND contains(field_name, '.')"),
            _rule("remove_field", "classification = 'unused' AND NOT contains(field_name, '.')"),
            _rule(
                "disable_doc_values",
                "classification = 'active' AND count_queried + count_filtered > 0 AND "
                f"{_PLAIN} AND has_doc_values AND mapped_type NOT IN ('text', 'annotated_text')",
            ),
            _rule("disable_norms", _EXACT),
            _rule("change_to_keyword", f"{_EXACT} AND {_PLAIN}", "true"),
            _rule(
                "add_keyword_subfield",
                "classification = 'active' AND mapped_type = 'text' AND count_queried > 0 AND "
                "(count_filtered > 0 OR count_aggregated > 0) AND NOT EXISTS (SELECT 1 FROM diff s WHERE "
                "s.index_group = d.index_group AND s.field_name = d.field_name || '.keyword')",
            ),
        ]
    )
    + ")"
)
_DIFF_CTES = (REFS_CTE, USAGE_CTE, FIELDS_CTE, DIFF_CTE)
_NOW = stamp_sql("(SELECT max(\"timestamp\") FROM ev)", "\"timestamp\"")


def _diff_sql(select: str) -> str:
    return with_events(select, *_DIFF_CTES)


def _advice_sql(select: str) -> str:
    return with_events(select, *_DIFF_CTES, ADVICE_CTE)


def _nested_on(source: str, *ctes: str):
    def build(parent: str, child: str, sizes: tuple[int, int]) -> str:
        sql = nested_sql(parent, child, sizes, source)
        return sql.replace(",\ncells AS", ",\n" + ",\n".join(ctes) + ",\ncells AS", 1)

    return build


def _on_diff(rollup):
    return lambda spark, sf_dir: rollup(C.mapping_diff_table(spark, sf_dir))


def _on_advice(rollup):
    return lambda spark, sf_dir: rollup(C.mapping_advice(spark, sf_dir))


def _usage(spark, sf_dir):
    return M.field_usage(M.recent(C.usage_events(spark, sf_dir), C.as_of(spark, sf_dir)))


def _text_sql(texts: dict[str, str]) -> str:
    quoted = {code: text.replace("'", "''") for code, text in texts.items()}
    return "CASE recommendation " + " ".join(f"WHEN '{c}' THEN '{t}'" for c, t in quoted.items()) + " END"


def _filled_sql(texts: dict[str, str]) -> str:
    last = "position('.' IN reverse(field_name))"
    values = {
        "{field}": "field_name",
        "{type}": "mapped_type",
        "{parent}": f"left(field_name, length(field_name) - {last})",
        "{sub}": f"right(field_name, {last} - 1)",
    }
    sql = _text_sql(texts)
    for marker, value in values.items():
        sql = f"replace({sql}, '{marker}', {value})"
    return sql


_USAGE_COLUMNS = (
    "index_group, field_name, "
    + ", ".join(f"count_{c}" for c in FIELDS)
    + ", "
    + ", ".join(stamp_sql(f"last_seen_{c}", f"last_seen_{c}") for c in FIELDS)
)
_MAPPED = "index_group, field_name, mapped_type, is_indexed, has_doc_values"
_ADVICE_KEYS = "index_group, field_name, mapped_type, classification, recommendation, breaking_change"

QUERIES: dict[str, Query] = {
    "f01_mapping_fields": Query(
        lambda spark, sf_dir: cluster.mapping_fields(C.mappings(spark, sf_dir), C.group_map(spark, sf_dir)),
        with_events(f"SELECT {_MAPPED} FROM mapped", FIELDS_CTE),
    ),
    "a08_mapping_info": Query(
        lambda spark, sf_dir: cluster.mapping_info(C.mappings(spark, sf_dir), C.group_map(spark, sf_dir)),
        with_events(
            "SELECT index_group, count(*) AS field_count, index_group <> 'orders' AS source_enabled FROM mapped GROUP BY 1",
            FIELDS_CTE,
        ),
    ),
    "f02_field_usage": Query(_usage, with_events(f"SELECT {_USAGE_COLUMNS} FROM used", REFS_CTE, USAGE_CTE)),
    "f05_mapping_diff": Query(
        lambda spark, sf_dir: C.mapping_diff_table(spark, sf_dir),
        _diff_sql(
            f"SELECT {_NOW}, {_USAGE_COLUMNS}, mapped_type, is_indexed, has_doc_values, total_references, "
            f"{stamp_sql('last_seen', 'last_seen')}, classification FROM diff"
        ),
    ),
    "f07_diff_by_class": Query(_on_diff(M.diff_by_class), _diff_sql(terms_sql("classification", 10, source="diff"))),
    "f08_diff_by_group_class": Query(
        _on_diff(M.diff_by_group_class), _nested_on("diff", *_DIFF_CTES)("index_group", "classification", (20, 10))
    ),
    "f09_diff_table": Query(
        _on_diff(M.diff_table),
        _diff_sql(
            "SELECT index_group, field_name, classification, mapped_type, max(total_references) AS max_references, "
            f"{stamp_sql('max(last_seen)', 'last_seen')} FROM diff GROUP BY 1, 2, 3, 4"
        ),
    ),
    "f10_unused_fields": Query(
        _on_diff(M.unused_fields),
        _diff_sql(
            "SELECT index_group, field_name, mapped_type, is_indexed, count(*) AS count, "
            f"{stamp_sql('max(last_seen)', 'last_seen')} FROM diff WHERE classification = 'unused' GROUP BY 1, 2, 3, 4"
        ),
    ),
    "f11_diff_by_type": Query(_on_diff(M.diff_by_type), _diff_sql(terms_sql("mapped_type", 20, source="diff"))),
    "g01_g10_recommendations": Query(
        lambda spark, sf_dir: C.mapping_advice(spark, sf_dir).select("timestamp", *_ADVICE_KEYS.split(", ")),
        _advice_sql(f"SELECT {_NOW}, {_ADVICE_KEYS} FROM advice"),
    ),
    "g11_advice_by_type": Query(
        _on_advice(M.advice_by_type), _advice_sql(terms_sql("recommendation", 10, source="advice"))
    ),
    "g12_advice_by_group_type": Query(
        _on_advice(M.advice_by_group_type),
        _nested_on("advice", *_DIFF_CTES, ADVICE_CTE)("index_group", "recommendation", (20, 10)),
    ),
    "g13_advice_table": Query(
        lambda spark, sf_dir: M.advice_table(C.mapping_advice(spark, sf_dir)).drop("why", "how"),
        _advice_sql(
            "SELECT index_group, field_name, mapped_type, recommendation, count(*) AS count FROM advice GROUP BY 1, 2, 3, 4"
        ),
    ),
    "g14_breaking_advice": Query(
        lambda spark, sf_dir: M.breaking_advice(C.mapping_advice(spark, sf_dir)).drop("why", "how"),
        _advice_sql(
            "SELECT index_group, field_name, recommendation, count(*) AS count FROM advice WHERE breaking_change GROUP BY 1, 2, 3"
        ),
    ),
    "g09_advice_texts": Query(
        lambda spark, sf_dir: C.mapping_advice(spark, sf_dir).select(
            "index_group", "field_name", "recommendation", "why", "how"
        ),
        _advice_sql(
            f"SELECT index_group, field_name, recommendation, {_text_sql(MAPPING_WHY)} AS why, {_filled_sql(MAPPING_HOW)} AS how FROM advice"
        ),
    ),
}
