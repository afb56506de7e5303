"""A request log derived from the provided ``events`` table.

Each event becomes one request; event type and ``k % 16`` pick its shape: a rare one if there is one for both,
else the common one of ``k % 4``. The expressions use only
functions that read the same in Spark and in other SQL engines, so the log can be checked by
independent SQL. Markers in the templates: ``<<k>>``, ``<<hours>>``, ``<<days>>``, ``<<day>>`` are
values of the row, ``<<q>>`` is an apostrophe and ``<<nl>>`` a line break.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import astuple, dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seekledger.schemas import REQUEST_LOG


@dataclass(frozen=True)
class Shape:
    event_type: str
    slot: int
    method: str
    path: str
    body: str | None


SHAPES = (
    Shape("click", 0, "POST", "/products/_search",
          '{"size": 10, "query": {"match": {"title": "term <<k>>"}}, "_source": ["title", "price", "category"]}'),
    Shape("click", 1, "POST", "/products/_search",
          '{"query": {"bool": {"filter": [{"term": {"category": "c<<k>>"}}]}}, "sort": [{"price": {"order": "asc"}}]}'),
    Shape("click", 2, "POST", "/products/_search",
          '{"size": 0, "aggs": {"brands": {"terms": {"field": "brand", "size": 20}}}}'),
    Shape("click", 3, "POST", "/products/_search",
          '{"query": {"function_score": {"query": {"match": {"title": "t<<k>>"}}, "functions": ['
          '{"script_score": {"script": {"source": "doc[<<q>>rating<<q>>].value / 100"}}}, '
          '{"field_value_factor": {"field": "stock_count"}}]}}, '
          '"script_fields": {"discounted": {"script": {"source": "doc[<<q>>price<<q>>].value * 0.9"}}}}'),
    Shape("view", 0, "POST", "/logs/_search",
          '{"query": {"bool": {"filter": [{"term": {"level": "ERROR"}}, '
          '{"range": {"timestamp": {"gte": "now-<<hours>>h"}}}]}}, "sort": [{"timestamp": {"order": "desc"}}], "size": 50}'),
    Shape("view", 1, "POST", "/logs-<<day>>/_search",
          '{"query": {"match": {"message": "m<<k>>"}}, "highlight": {"fields": {"message": {}, "h_only": {}}}, '
          '"docvalue_fields": ["service", {"field": "host"}]}'),
    Shape("view", 2, "POST", "/logs/_search",
          '{"size": 0, "aggs": {"by_service": {"terms": {"field": "service"}, '
          '"aggs": {"avg_duration": {"avg": {"field": "duration_ms"}}}}}}'),
    Shape("view", 3, "GET", "/logs-<<day>>/_count",
          '{"aggs": {"pages": {"composite": {"sources": [{"h": {"terms": {"field": "host"}}}, '
          '{"t": {"date_histogram": {"field": "timestamp"}}}]}}, '
          '"bad": {"filter": {"range": {"status_code": {"gte": "<<k>>"}}}}}, "collapse": {"field": "trace_id"}}'),
    Shape("purchase", 0, "POST", "/orders-us/_update/<<k>>", '{"doc": {"status": "s<<k>>"}}'),
    Shape("purchase", 1, "PUT", "/orders-eu/_doc/ORD-<<k>>",
          '{"order_id": "ORD-<<k>>", "customer_name": "n<<k>>", "status": "pending", "total_amount": "<<k>>", "channel": "web"}'),
    Shape("purchase", 2, "POST", "/orders/_search",
          '{"size": 0, "aggs": {"by_category": {"terms": {"field": "category"}, '
          '"aggs": {"revenue": {"sum": {"field": "total_amount"}}}}}}'),
    Shape("purchase", 3, "POST", "/orders/_search",
          '{"query": {"range": {"order_date": {"gte": "now-<<days>>d"}}}, "post_filter": {"term": {"status": "s<<k>>"}}, '
          '"sort": [{"_script": {"type": "number", "script": {"source": '
          '"doc[<<q>>total_amount<<q>>].value * doc[<<q>>item_count<<q>>].value"}}}, "order_date"], '
          '"runtime_mappings": {"dow": {"type": "keyword", "script": {"source": "emit(doc[<<q>>order_date<<q>>].value)"}}}}'),
    Shape("signup", 0, "POST", "/products,orders-us/_search",
          '{"query": {"bool": {"must": [{"multi_match": {"query": "x<<k>>", "fields": ["title^2", "description"]}}], '
          '"must_not": [{"exists": {"field": "tags"}}]}}, "_source": {"includes": ["title"], "excludes": ["internal_sku"]}, '
          '"post_filter": {"term": {"description": "d<<k>>"}}}'),
    Shape("signup", 1, "POST", "/logs-<<day>>/_bulk",
          '{"index": {}}<<nl>>{"timestamp": "<<day>>", "level": "INFO", "service": "s<<k>>", "message": "hello"}<<nl>>'
          '{"create": {}}<<nl>>{"timestamp": "<<day>>", "host": "web-<<k>>"}<<nl>>'),
    Shape("signup", 2, "POST", "/orders-eu/_bulk",
          '{"update": {"_id": "<<k>>"}}<<nl>>{"doc": {"status": "x"}, "upsert": {"item_count": "<<k>>", "_hidden": 1}}<<nl>>'),
    Shape("signup", 3, "POST", "/_bulk",
          '{"delete": {"_index": "products", "_id": "<<k>>"}}<<nl>>{"index": {"_index": "products"}}<<nl>>'
          '{"title": "t<<k>>", "price": "<<k>>", "stock_count": "1"}<<nl>>'),
    Shape("error", 0, "POST", "/_msearch",
          '{"index": "products"}<<nl>>{"query": {"term": {"brand": "b<<k>>"}}}<<nl>>{"index": "logs"}<<nl>>'
          '{"query": {"bool": {"filter": {"range": {"timestamp": {"lt": "now-2d", "gte": "now-1w"}}}}}}<<nl>>'),
    Shape("error", 1, "GET", "/_cat/indices", None),
    Shape("error", 2, "POST", "/.sys/_search", '{"query": {"match": {"secret": "s<<k>>"}}}'),
    Shape("error", 3, "POST", "/products/_search", "not json <<k>>"),
)

#: Shapes of single values of ``k % 16``, in place of the common ones.
RARE_SHAPES = (
    Shape("click", 4, "POST", "/products/_search",
          '{"query": {"nested": {"path": "reviews", "query": {"bool": {"must": [{"match": {"reviews.text": "r<<k>>"}}], '
          '"filter": [{"term": {"reviews.stars": "<<k>>"}}]}}}}}'),
    Shape("click", 5, "POST", "/products/_search",
          '{"query": {"bool": {"must": [{"match_phrase": {"q_phrase": "p<<k>>"}}, {"match_phrase_prefix": {"q_phrase_prefix": "p"}}, '
          '{"fuzzy": {"q_fuzzy": {"value": "f<<k>>"}}}], "should": {"regexp": {"q_regexp": "r.*"}}, '
          '"filter": [{"terms": {"f_terms": ["a", "b<<k>>"]}}, {"wildcard": {"f_wildcard": {"value": "w*"}}}, {"prefix": {"f_prefix": "x"}}, '
          '{"match": {"f_match": "m"}}]}}}'),
    Shape("click", 6, "POST", "/products/_search",
          '{"size": 0, "aggs": {"a": {"min": {"field": "m_min"}}, "b": {"max": {"field": "m_max"}}, "c": {"cardinality": {"field": "m_cardinality"}}, '
          '"d": {"value_count": {"field": "m_value_count"}}, "e": {"stats": {"field": "m_stats"}}, "f": {"extended_stats": {"field": "m_extended_stats"}}, '
          '"g": {"percentiles": {"field": "m_percentiles"}}, "h": {"percentile_ranks": {"field": "m_percentile_ranks", "values": ["<<k>>"]}}, '
          '"i": {"median_absolute_deviation": {"field": "m_deviation"}}, "j": {"top_hits": {"field": "m_top_hits", "size": 1}}, '
          '"k": {"weighted_avg": {"field": "not_this_one"}}}}'),
    Shape("click", 7, "POST", "/products/_search",
          '{"query": {"function_score": {"query": {"match": {"title": "t<<k>>"}}, "functions": ['
          '{"gauss": {"price": {"origin": "<<k>>", "scale": "2"}}}, {"linear": {"created_at": {"origin": "now", "scale": "10d"}}}, '
          '{"exp": {"popularity": {"origin": 1, "scale": 2}, "_internal": {}}}]}}}'),
    Shape("view", 5, "POST", "/logs/_search",
          '{"size": 0, "aggs": {"by": {"filters": {"filters": {"errors": {"term": {"f_level": "e<<k>>"}}, '
          '"slow": {"bool": {"must": [{"range": {"f_duration": {"gte": "<<k>>"}}}]}}}}, "aggs": {"h": {"cardinality": {"field": "host"}}}}}}'),
    Shape("view", 6, "POST", "/logs/_search",
          '{"size": 0, "aggs": {"s": {"scripted_metric": {"init_script": "state.a = doc[<<q>>s_init<<q>>].size()", '
          '"map_script": {"source": "state.a += doc[<<q>>s_map<<q>>].value"}, "combine_script": "return doc[<<q>>s_combine<<q>>]", '
          '"reduce_script": {"inline": "doc[<<q>>s_reduce<<q>>]"}}}, "t": {"terms": {"field": "host"}, "aggregations": {'
          '"u": {"bucket_script": {"buckets_path": {}, "script": "doc[<<q>>s_bucket<<q>>].value"}}, '
          '"v": {"bucket_selector": {"buckets_path": {}, "script": {"source": "doc[<<q>>s_selector<<q>>].value > <<k>>"}}}}}}}'),
    Shape("view", 7, "POST", "/logs/_search",
          '{"query": {"term": {"level": "l<<k>>"}}, "script_fields": {"double": {"script": {"source": "doc[\\"p_double\\"].value"}}, '
          '"source": {"script": "ctx._source.p_source + 1"}, "old": {"script": {"inline": "doc[ <<q>>not_this<<q>> ] + doc[<<q>> p_inline <<q>>]"}}, '
          '"template": {"script": {"lang": "mustache", "source": "doc[<<q>>p_mustache<<q>>]"}}, "stored": {"script": {"id": "p_stored"}}, '
          '"internal": {"script": "doc[<<q>>_p_internal<<q>>]"}}}'),
    Shape("view", 13, "POST", "/logs/_search",
          '{"size": 0, "aggs": {"t": {"terms": {"field": "b_terms"}, "aggs": {"a": {"date_histogram": {"field": "b_date_histogram"}, '
          '"aggregations": {"b": {"histogram": {"field": "b_histogram", "interval": "<<k>>"}}}}, "c": {"range": {"field": "b_range"}}}}, '
          '"d": {"date_range": {"field": "b_date_range"}}, "e": {"significant_terms": {"field": "b_significant"}}, '
          '"f": {"auto_date_histogram": {"field": "b_auto"}}, "g": {"filter": {"field": "b_filter"}}, "h": {"nested": {"path": "p"}, "aggs": {"i": {"avg": {"field": "b_inner"}}}}}}'),
    Shape("purchase", 6, "POST", "/orders/_search",
          '{"suggest": {"one": {"prefix": "n<<k>>", "completion": {"field": "g_completion"}}, "two": {"text": "x", "term": {"field": "g_term"}}, '
          '"three": {"text": "y", "phrase": {"field": "g_phrase"}}, "four": {"text": "z", "other": {"field": "not_this_one"}}}}'),
    Shape("purchase", 7, "POST", "/orders/_search",
          '{"query": {"term": {"status": "s<<k>>"}}, "stored_fields": ["st_one", "st_two", "_id"], "docvalue_fields": ["dv_plain", {"field": "dv_object", "format": "x"}]}'),
    Shape("purchase", 8, "POST", "/orders-us/_update/<<k>>",
          '{"doc": {"u_doc": "d<<k>>", "_meta": 1}, "upsert": {"u_upsert": "<<k>>", "status": "new", "_hidden": 1}}'),
    Shape("purchase", 12, "POST", "/orders-us/_update/<<k>>",
          '{"script": {"source": "ctx._source.not_this_one = <<k>>"}, "upsert": {"u_upsert": 1}, "detect_noop": true}'),
    Shape("signup", 4, "POST", "/products,orders-us/_search",
          '{"query": {"bool": {"must": {"nested": {"path": "a", "query": {"nested": {"path": "a.b", "query": {"exists": {"field": "a.b.c"}}}}}}, '
          '"must_not": {"nested": {"path": "a", "query": {"bool": {"filter": {"terms": {"a.kind": ["x<<k>>"]}}}}}}}}, '
          '"post_filter": {"nested": {"path": "d", "query": {"wildcard": {"d.e": "w*"}}}}}'),
    Shape("error", 7, "POST", "/products/_search", '{"query": <<deep>>'),
    Shape("error", 11, "POST", "/products/_search", '{"query": {"match": {"title": "t<<k>> <<long>>"}}, "sort": ["price"]}'),
)
SLOTS = 16


def shape_of_each_slot() -> list[Shape]:
    rare = {(s.event_type, s.slot): s for s in RARE_SHAPES}
    every = [replace(s, slot=at) for s in SHAPES for at in range(s.slot, SLOTS, 4)]
    return [rare.get((s.event_type, s.slot), s) for s in every]


# Values of one row, as SQL over the columns of ``events`` and ``k``.
K = "cast(regexp_extract(props, '([0-9]+)', 1) as int)"
MARKERS = {
    "k": "cast(k as string)",
    "hours": "case k % 16 when 0 then '1' when 4 then '6' when 8 then '24' else '48' end",
    "days": "case when k % 8 = 3 then '7' else '30' end",
    "day": "replace(substr(cast(ts as string), 1, 10), '-', '.')",
    "deep": "repeat('[', 20000)",
    "long": "repeat('long text ', 600)",
    "q": "chr(39)",
    "nl": "chr(10)",
}


# Markers whose value is the same in every row, and short: they are filled in the list of shapes.
CONSTANT = ("q", "nl")


def filled(column: str, markers: Iterable[str]) -> str:
    """SQL expression that puts the row's values into a template column."""
    sql = column
    for name in markers:
        sql = f"replace({sql}, '<<{name}>>', {MARKERS[name]})"
    return sql


def row_markers(column: str) -> list[str]:
    """Markers that a template column holds and each row fills: every search costs a pass over the text."""
    texts = [getattr(s, column) or "" for s in shape_of_each_slot()]
    return [m for m in MARKERS if m not in CONSTANT and any(f"<<{m}>>" in text for text in texts)]


# A failed upstream call has no elapsed time.
UNANSWERED = "event_type = 'error' and k = 99"
USER_AGENT = (
    "case user_id % 3 when 0 then 'python-client/8.1' when 1 then 'Mozilla/5.0' "
    "else case when user_id % 7 = 0 then repeat('agent', 120) else 'java-client/7.17' end end"
)
REQUEST_COLUMNS = {
    "request_id": "event_id",
    "ts": "ts",
    "method": "method",
    "path": filled("path", row_markers("path")),
    "body": filled("body", row_markers("body")),
    "status": f"case when {UNANSWERED} then 502 when event_type = 'error' then 500 else 200 end",
    "elapsed_ms": f"case when {UNANSWERED} then null else value end",
    "client_id": "case when user_id % 5 = 4 then null else concat('svc-', cast(user_id % 5 as string)) end",
    "client_ip": "concat('10.0.0.', cast(user_id as string))",
    "client_user_agent": USER_AGENT,
    "response_hits": "cast(floor(value * 100) as bigint)",
}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def log_files(spark: SparkSession) -> int:
    """As many files as tasks can run at a time, so that reading the log keeps all cores busy."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read_table(spark, sf_dir, "events").repartition(log_files(spark), "event_id").withColumn("k", F.expr(K))
    # One row per type and slot, a fixed list.
    columns = "event_type string, slot int, method string, path string, body string"
    shapes = spark.createDataFrame([astuple(s) for s in shape_of_each_slot()], columns)
    shapes = shapes.withColumns({c: F.expr(filled(c, CONSTANT)) for c in ("path", "body")})
    rows = events.withColumn("slot", F.col("k") % SLOTS).join(F.broadcast(shapes), ["event_type", "slot"], "left")
    unmatched = F.raise_error(F.concat(F.lit("no request shape for event "), F.col("event_id").cast("string")))
    rows = rows.withColumn("path", F.when(F.col("path").isNull(), unmatched).otherwise(F.col("path")))
    return rows.select(
        [F.expr(REQUEST_COLUMNS[f.name]).cast(f.dataType).alias(f.name) for f in REQUEST_LOG.fields]
    )


# Concrete indices and their aliases and data streams, as SQL over the index names of the log.
KNOWN_INDEX = "index_name like 'logs-%' or index_name like 'orders-%' or index_name = 'products'"
STREAM_INDEX = "index_name like 'logs-____.__.0%'"


def known_indices(requests: DataFrame) -> DataFrame:
    named = requests.select(F.explode(F.split(F.split("path", "/")[1], ",")).alias("index_name"))
    return named.distinct().filter(KNOWN_INDEX)


def alias_table(indices: DataFrame) -> DataFrame:
    """Two aliases per log and order index; only the first one names the group."""
    family = F.split("index_name", "-")[0]
    aliased = indices.filter("index_name <> 'products'")
    return aliased.select(
        "index_name",
        F.posexplode(F.array(family, F.concat(family, F.lit("-all")))).alias("position", "alias"),
    ).select("index_name", "alias", "position")


def stream_table(indices: DataFrame) -> DataFrame:
    """The log indices of each month's first nine days belong to a data stream."""
    return indices.filter(STREAM_INDEX).select(F.lit("logs-stream").alias("data_stream"), "index_name")
