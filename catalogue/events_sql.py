"""Independent SQL for the sample tables: the expected event of each request shape, by hand.

Nothing here parses a body: what every shape must yield is written down, and DuckDB only fills in
the values of the row. ``with_events`` prefixes a query with the tables ``req`` and ``ev``.
"""

from __future__ import annotations

import json

from seekledger.samples.request_log import K, MARKERS, SLOTS, UNANSWERED, USER_AGENT, Shape, shape_of_each_slot

FIELDS = ("queried", "filtered", "aggregated", "sorted", "sourced", "written")

# (event type, k % 4): operation, query type, painless, the six field lists,
# lookback (seconds, field, label) as SQL, documents in a bulk body.
_NONE = ("null", "null", "null")
_HOURS, _DAYS = MARKERS["hours"], MARKERS["days"]
EXPECTED = {
    ("click", 0): ("search", "text", 0, "title", "", "", "", "category price title", "", _NONE, 0),
    ("click", 1): ("search", "filter", 0, "", "category", "", "price", "", "", _NONE, 0),
    ("click", 2): ("search", "agg", 0, "", "", "brand", "", "", "", _NONE, 0),
    ("click", 3): ("search", "text", 1, "rating stock_count title", "", "", "", "price", "", _NONE, 0),
    ("view", 0): ("search", "filter", 0, "", "level timestamp", "", "timestamp", "", "",
                  (f"cast(3600 * cast({_HOURS} as int) as double)", "'timestamp'", f"concat({_HOURS}, 'h')"), 0),
    ("view", 1): ("search", "text", 0, "h_only message", "", "", "", "host service", "", _NONE, 0),
    ("view", 2): ("search", "agg", 0, "", "", "duration_ms service", "", "", "", _NONE, 0),
    ("view", 3): ("count", "agg", 0, "", "status_code trace_id", "host timestamp", "", "", "", _NONE, 0),
    ("purchase", 0): ("update", None, 0, "", "", "", "", "", "status", _NONE, 0),
    ("purchase", 1): ("doc_write", None, 0, "", "", "", "", "",
                      "channel customer_name order_id status total_amount", _NONE, 0),
    ("purchase", 2): ("search", "agg", 0, "", "", "category total_amount", "", "", "", _NONE, 0),
    ("purchase", 3): ("search", "filter", 1, "order_date", "status", "", "item_count order_date total_amount",
                      "order_date", "",
                      (f"cast(86400 * cast({_DAYS} as int) as double)", "'order_date'", f"concat({_DAYS}, 'd')"), 0),
    ("signup", 0): ("search", "text", 0, "description tags title", "description", "", "", "internal_sku title", "", _NONE, 0),
    ("signup", 1): ("bulk", None, 0, "", "", "", "", "", "host level message service timestamp", _NONE, 2),
    ("signup", 2): ("bulk", None, 0, "", "", "", "", "", "item_count status", _NONE, 1),
    ("signup", 3): ("bulk", None, 0, "", "", "", "", "", "price stock_count title", _NONE, 2),
    ("error", 0): ("msearch", "filter", 0, "brand", "timestamp", "", "", "", "",
                   ("cast(604800 as double)", "'timestamp'", "'1w'"), 0),
    ("error", 1): ("cat", None, 0, "", "", "", "", "", "", _NONE, 0),
    ("error", 2): ("search", "text", 0, "secret", "", "", "", "", "", _NONE, 0),
    ("error", 3): ("search", "filter", 0, "", "", "", "", "", "", _NONE, 0),
}


#: The rare shapes, by event type and k % 16; None: the body cannot be parsed and leaves no event.
RARE_EXPECTED = {
    ("click", 4): ("search", "text", 0, "reviews.text", "reviews.stars", "", "", "", "", _NONE, 0),
    ("click", 5): ("search", "text", 0, "q_fuzzy q_phrase q_phrase_prefix q_regexp", "f_match f_prefix f_terms f_wildcard", "", "", "", "", _NONE, 0),
    ("click", 6): ("search", "agg", 0, "", "", "m_cardinality m_deviation m_extended_stats m_max m_min m_percentile_ranks m_percentiles "
                   "m_stats m_top_hits m_value_count", "", "", "", _NONE, 0),
    ("click", 7): ("search", "text", 0, "created_at popularity price title", "", "", "", "", "", _NONE, 0),
    ("view", 5): ("search", "agg", 0, "", "f_duration f_level", "host", "", "", "", _NONE, 0),
    ("view", 6): ("search", "agg", 1, "", "", "host s_bucket s_combine s_init s_map s_reduce s_selector", "", "", "", _NONE, 0),
    ("view", 7): ("search", "filter", 1, "level", "", "", "", "p_double p_inline p_source", "", _NONE, 0),
    ("view", 13): ("search", "agg", 0, "", "", "b_auto b_date_histogram b_date_range b_filter b_histogram b_inner b_range b_significant b_terms",
                   "", "", "", _NONE, 0),
    ("purchase", 6): ("search", "filter", 0, "g_completion g_phrase g_term", "", "", "", "", "", _NONE, 0),
    ("purchase", 7): ("search", "filter", 0, "status", "", "", "", "dv_object dv_plain st_one st_two", "", _NONE, 0),
    ("purchase", 8): ("update", None, 0, "", "", "", "", "", "status u_doc u_upsert", _NONE, 0),
    ("purchase", 12): ("update", None, 0, "", "", "", "", "", "u_upsert", _NONE, 0),
    ("signup", 4): ("search", "filter", 0, "a.b.c", "a.kind d.e", "", "", "", "", _NONE, 0),
    ("error", 7): None,
    ("error", 11): ("search", "text", 0, "title", "", "", "price", "", "", _NONE, 0),
}
_LOST = ("search", None, 0, "", "", "", "", "", "", _NONE, 0)


def expected(shape: Shape) -> tuple | None:
    key = (shape.event_type, shape.slot)
    return RARE_EXPECTED[key] if key in RARE_EXPECTED else EXPECTED[(shape.event_type, shape.slot % 4)]


def _quoted(text: str | None) -> str:
    return "null" if text is None else "'" + text.replace("'", "''") + "'"


def _generalised(node):
    if isinstance(node, dict):
        return {k: _generalised(v) for k, v in node.items()}
    if isinstance(node, list):
        return [_generalised(v) for v in node] if any(isinstance(v, (dict, list)) for v in node) else ["?"]
    return "?"


def _canonical(body: str | None) -> tuple[str | None, str | None, str | None]:
    """Fingerprint text (with markers), template text compact and readable."""
    try:
        tree = json.loads(body or "")
    except ValueError:
        return None, None, None
    shape = _generalised(tree)
    return (
        json.dumps(tree, sort_keys=True, separators=(",", ":")),
        json.dumps(shape, sort_keys=True, separators=(",", ":")),
        json.dumps(shape, sort_keys=True),
    )


def _filled(column: str) -> str:
    sql = column
    for name, value in MARKERS.items():
        sql = f"replace({sql}, '<<{name}>>', {value})"
    return sql


def _shape_rows() -> str:
    rows = []
    for s in shape_of_each_slot():
        want = expected(s) or _LOST
        texts = [s.method, s.path, s.body, *_canonical(s.body), *want[:2]]
        lists = [f"string_split({_quoted(t)}, ' ')" if t else "cast([] as varchar[])" for t in want[3:9]]
        lost = "true" if expected(s) is None else "false"
        rows.append(
            f"({_quoted(s.event_type)}, {s.slot}, {', '.join(map(_quoted, texts))}, {want[2]}, "
            f"{', '.join(lists)}, {want[10]}, {lost})"
        )
    return ",\n".join(rows)


def _lookback(part: int) -> str:
    arms = " ".join(
        f"when event_type = '{s.event_type}' and k % {SLOTS} = {s.slot} then {want[9][part]}"
        for s in shape_of_each_slot()
        if (want := expected(s)) and want[9] != _NONE
    )
    return f"case {arms} end"


def request_ctes() -> str:
    return f"""shapes(event_type, slot, method, path_t, body_t, canon_t, tmpl, tmpl_text, operation, qtype, painless,
  {', '.join(FIELDS)}, docs, lost) AS (VALUES {_shape_rows()}),
raw AS (SELECT *, {K} AS k FROM events),
req AS (SELECT raw.event_id AS request_id, raw.ts, raw.k, shapes.*, raw.user_id,
  {_filled('path_t')} AS path, {_filled('body_t')} AS body, {_filled('canon_t')} AS canon,
  CASE WHEN raw.{UNANSWERED.replace(" and k", " and raw.k")} THEN 502 WHEN raw.event_type = 'error' THEN 500 ELSE 200 END AS status,
  CASE WHEN raw.{UNANSWERED.replace(" and k", " and raw.k")} THEN NULL ELSE value END AS elapsed_ms,
  CASE WHEN user_id % 5 = 4 THEN NULL ELSE concat('svc-', user_id % 5) END AS client_id,
  concat('10.0.0.', user_id) AS client_ip,
  {USER_AGENT} AS client_user_agent,
  CAST(floor(value * 100) AS BIGINT) AS response_hits
  FROM raw JOIN shapes ON raw.event_type = shapes.event_type AND raw.k % {SLOTS} = shapes.slot)"""


SKIPPED = "(operation = 'cat' OR path LIKE '/.%')"


def event_ctes() -> str:
    return f"""{request_ctes()},
named AS (SELECT *, CASE WHEN path LIKE '/\\_%' ESCAPE '\\' THEN '_unknown'
    ELSE split_part(split_part(path, '/', 2), ',', 1) END AS "index"
  FROM req WHERE elapsed_ms IS NOT NULL AND NOT {SKIPPED} AND NOT lost),
ev AS (SELECT request_id, ts AS "timestamp", 'default' AS cluster_id, "index",
  CASE WHEN "index" LIKE 'logs-____.__.0%' THEN 'logs-stream' WHEN "index" LIKE 'logs-%' THEN 'logs'
       WHEN "index" LIKE 'orders-%' THEN 'orders' ELSE "index" END AS index_group,
  operation, method AS http_method, path, {', '.join(FIELDS)},
  CASE WHEN painless = 1 THEN 'dsl+painless' ELSE 'dsl' END AS "language",
  sha256(canon) AS query_fingerprint, sha256(tmpl) AS query_template_hash, tmpl_text AS query_template_text,
  elapsed_ms AS response_time_ms, status AS response_status, client_id, client_ip, client_user_agent,
  {_lookback(0)} AS lookback_seconds, {_lookback(1)} AS lookback_field, {_lookback(2)} AS lookback_label,
  body AS query_body, response_hits, qtype AS query_type, docs AS bulk_documents,
  CAST(round(elapsed_ms * 100) AS BIGINT) AS cents
  FROM named)"""


def with_events(select: str, *ctes: str) -> str:
    return "WITH " + ",\n".join([event_ctes(), *ctes]) + "\n" + select


def with_requests(select: str, *ctes: str) -> str:
    return "WITH " + ",\n".join([request_ctes(), *ctes]) + "\n" + select
