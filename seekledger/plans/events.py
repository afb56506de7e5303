"""Request log -> usage events: one narrow pipeline, the same for batch and stream.

Everything is a function of one request, so nothing is shuffled, unless each body of a log is to be
parsed once. Rows that leave no event (system
calls, hidden indices, sampled out, no response seen) are dropped before the body is parsed, and only
body and mode cross into Python. Bodies nested too deep to parse leave no event either:
``rejected_requests`` lists them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seekledger.functions import grammar, paths
from seekledger.functions.bodies import observe_bodies
from seekledger.functions.numbers import avg_ms, keep_rate
from seekledger.operators.groups import resolve_group
from seekledger.operators.tables import kept, kept_at
from seekledger.schemas import USAGE_EVENTS

UNKNOWN_INDEX = "_unknown"
# What the different bodies of a log yield is broadcast up to this size.
BROADCAST_BYTES = 64 * 2**20


@dataclass(frozen=True)
class EventSettings:
    """``body_limit`` (bytes): larger bodies are kept as events but not parsed; the original observed
    none over 1 MiB. ``text_limit`` (characters): longer template and body texts are cut; the original
    cut at 4096. Neither is set by default."""

    cluster_id: str = "default"
    body_limit: int | None = None
    text_limit: int | None = None
    event_sample_rate: float = 1.0
    store_bodies: bool = True
    body_sample_rate: float = 1.0


def is_answered() -> Column:
    return F.col("elapsed_ms").isNotNull()


def is_parsed(settings: EventSettings = EventSettings()) -> Column:
    """The body is within the limit, if there is one."""
    if settings.body_limit is None:
        return F.lit(True)
    return F.coalesce(F.octet_length("body"), F.lit(0)) <= settings.body_limit


def _text(text: Column, settings: EventSettings) -> Column:
    return text if settings.text_limit is None else F.substring(text, 1, settings.text_limit)


def route(requests: DataFrame) -> DataFrame:
    """Add indices, operation, mode and the skip flag; works on the path alone."""
    return (
        requests.withColumn("indices", paths.index_names(F.col("path")))
        .withColumn("operation", paths.operation(F.col("path"), F.col("method")))
        .withColumn("mode", paths.body_mode(F.col("operation"), F.col("method")))
        .withColumn("skipped", paths.is_skipped(F.col("operation"), F.col("path")))
    )


def _due(requests: DataFrame, settings: EventSettings) -> DataFrame:
    """Requests that may leave an event; ``body`` is what is parsed of it."""
    kept_rows = (
        route(requests.filter(is_answered()))
        .filter(~F.col("skipped"))
        .filter(keep_rate(F.col("request_id"), settings.event_sample_rate))
    )
    body = F.col("body") if settings.body_limit is None else F.when(is_parsed(settings), F.col("body"))
    return kept_rows.withColumn("parsed", body)


def describe(bodies: DataFrame) -> DataFrame:
    """Add what a body (``parsed``, ``mode``) yields: ``failed`` and the columns of its event."""
    seen = bodies.withColumn("seen", observe_bodies(F.col("parsed"), F.col("mode"))).withColumn("nodes", F.col("seen.nodes"))
    extracted = seen.withColumns(
        {"lookback": grammar.lookback(F.col("nodes")), "scripts": grammar.script_names(F.col("nodes"))}
    )
    searched = F.col("mode").isin("search", "msearch")
    columns = {
        "failed": F.col("seen.failed"),
        "fields": grammar.field_sets(F.col("nodes"), F.col("scripts")),
        "language": F.when(grammar.has_script_references(F.col("scripts")), "dsl+painless").otherwise("dsl"),
        "query_fingerprint": F.col("seen.fingerprint"),
        "query_template_hash": F.col("seen.template_hash"),
        "query_template_text": F.col("seen.template_text"),
        "lookback_seconds": F.col("lookback.seconds"),
        "lookback_field": F.col("lookback.field"),
        "lookback_label": F.col("lookback.label"),
        "query_type": F.when(searched, grammar.query_type(F.col("nodes"))),
        "bulk_documents": F.col("seen.documents"),
    }
    return extracted.select(*bodies.columns, *[c.alias(name) for name, c in columns.items()])


def _describe_once(due: DataFrame, place: str | None) -> DataFrame:
    """``describe``, but each different body once for the whole log: clients repeat themselves. What bodies yield
    is written by digest and joined to the requests; whether it is broadcast follows from its real bytes, as
    equal texts take next to nothing in a file."""
    spark = due.sparkSession
    key = F.sha2(F.concat_ws("\n", "mode", "parsed"), 256)
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    bodies = due.select("mode", "parsed").distinct().withColumn("_key", key).repartition(tasks, "_key")
    described = describe(bodies).drop("mode", "parsed")
    described = kept(described, "described_bodies") if place is None else kept_at(described, place)
    size = described.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0
    small = F.broadcast(described) if size <= BROADCAST_BYTES else described.hint("merge")
    return due.withColumn("_key", key).join(small, "_key").drop("_key")


def rejected_requests(requests: DataFrame, settings: EventSettings = EventSettings()) -> DataFrame:
    """Requests whose body is nested too deep to parse: they leave no event."""
    failed = describe(_due(requests, settings)).filter("failed")
    return failed.select("request_id", "ts", "path", F.octet_length("body").cast("long").alias("body_bytes"))


def build_usage_events(
    requests: DataFrame,
    group_map: DataFrame,
    settings: EventSettings = EventSettings(),
    once: bool = False,
    place: str | None = None,
) -> DataFrame:
    """``once``: for a log at rest. Each different body is parsed once for the whole log, by a job that runs at
    once and leaves its result at ``place`` (a new one, if none is given); otherwise nothing is shuffled, and a
    body is parsed once a batch of rows."""
    due = _due(requests, settings)
    described = (_describe_once(due, place) if once else describe(due)).filter(~F.col("failed"))
    named = resolve_group(
        described.withColumn("index", F.coalesce(F.get("indices", F.lit(0)), F.lit(UNKNOWN_INDEX))), group_map
    )
    stored = F.col("body") != ""
    if not settings.store_bodies:
        stored = F.lit(False)
    stored = stored & keep_rate(F.col("request_id"), settings.body_sample_rate, salt="body")
    columns = {
        "timestamp": F.col("ts"),
        "cluster_id": F.lit(settings.cluster_id),
        "http_method": F.col("method"),
        "query_template_text": _text(F.col("query_template_text"), settings),
        "response_time_ms": F.round("elapsed_ms", 2),
        "response_status": F.col("status"),
        "query_body": F.when(stored, _text(F.col("body"), settings)),
        "event_date": F.to_date("ts"),
    }
    return named.select(
        [columns.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name) for f in USAGE_EVENTS.fields]
    )


def traffic_counters(
    requests: DataFrame, events: DataFrame, settings: EventSettings = EventSettings()
) -> DataFrame:
    """One row of request counters and response times. ``events`` are those made of ``requests``:
    what could have left an event and did not is an extraction error, so no body is parsed again."""
    sampled = keep_rate(F.col("request_id"), settings.event_sample_rate)
    tagged = (
        route(requests)
        .withColumn("answered", is_answered())
        .withColumn("due", F.col("answered") & ~F.col("skipped") & sampled)
        .withColumn("ms", F.when(F.col("answered"), F.round("elapsed_ms", 2)))
    )
    counted = tagged.agg(
        F.count(F.lit(1)).alias("requests_proxied"),
        F.count_if(~F.col("answered")).alias("requests_failed"),
        F.count_if(F.col("due") & ~is_parsed(settings)).alias("requests_unobserved"),
        F.count_if(F.col("answered") & F.col("skipped")).alias("events_skipped"),
        F.count_if(F.col("answered") & ~F.col("skipped") & ~sampled).alias("events_sampled_out"),
        F.count_if("due").alias("_due"),
        F.coalesce(F.round(avg_ms(F.col("ms")), 2), F.lit(0.0)).alias("response_avg_ms"),
        F.coalesce(F.max("ms"), F.lit(0.0)).alias("response_max_ms"),
    )
    emitted = events.agg(F.count(F.lit(1)).alias("events_emitted"))
    return counted.join(emitted).select(  # one row each
        "requests_proxied", "requests_failed", "requests_unobserved", "events_skipped", "events_sampled_out",
        (F.col("_due") - F.col("events_emitted")).alias("extraction_errors"),
        "events_emitted", "response_avg_ms", "response_max_ms",
    )
