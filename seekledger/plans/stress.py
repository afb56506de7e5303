"""Stress score: how heavy a request is, and who causes it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seekledger.operators import rollups as R
from seekledger.schemas import FIELD_CATEGORIES

# Baselines of the terms. The complexity of a request is its number of distinct
# (category, field) references; its baseline is our choice.
MS, HITS, DOCUMENTS, COMPLEXITY = 1000, 10000, 100, 10
NO_APPLICATION = R.NO_CLIENT

INSERTS = ("doc_write", "bulk", "index", "create")
UPDATES = ("update", "update_by_query")
DELETES = ("delete", "delete_by_query")
QUERIES = ("search", "count", "async_search", "msearch", "doc_get")

DIMENSIONS = {
    "template": "query_template_hash",
    "kind": "operation_kind",
    "type": "operation_type",
    "target": "index_group",
    "application": "application",
}


def operation_kind() -> Column:
    op = F.col("operation")
    removes = (op == "doc_get") & (F.upper("http_method") == "DELETE")
    return (
        F.when(op.isin(*DELETES) | removes, "delete")
        .when(op.isin(*INSERTS), "insert")
        .when(op.isin(*UPDATES), "update")
        .when(op.isin(*QUERIES), "query")
        .otherwise("other")
    )


def operation_type() -> Column:
    """Searches by what they do; writes as bulk, by query or single."""
    op = F.col("operation")
    written = (
        F.when(op == "bulk", "bulk").when(F.endswith(op, F.lit("_by_query")), "by query").otherwise("single")
    )
    return F.when(F.col("operation_kind") == "query", F.coalesce("query_type", F.lit("single"))).otherwise(written)


def complexity() -> Column:
    total = F.lit(0)
    for category in FIELD_CATEGORIES:
        total = total + F.coalesce(F.size(F.array_distinct(f"fields.{category}")), F.lit(0))
    return total


def _documents() -> Column:
    op = F.col("operation")
    return (
        F.when(op == "bulk", F.col("bulk_documents"))
        .when(F.endswith(op, F.lit("_by_query")), F.coalesce("response_hits", F.lit(0)))
        .otherwise(1)
    )


def stress_score() -> Column:
    """Searches weigh time, hits and complexity; everything else time and documents."""
    took = F.col("response_time_ms") / MS
    hits = F.coalesce("response_hits", F.lit(0)) / HITS
    search = 0.5 * took + 0.3 * hits + 0.2 * (complexity() / COMPLEXITY)
    write = 0.4 * took + 0.6 * (_documents() / DOCUMENTS)
    return F.when(F.col("operation_kind") == "query", search).otherwise(write)


def with_stress(events: DataFrame) -> DataFrame:
    """Add kind, type, application and the score, also as whole millionths whose sums are exact."""
    return (
        events.withColumn("operation_kind", operation_kind())
        .withColumn("operation_type", operation_type())
        .withColumn("stress", stress_score())
        .withColumns(
            {
                "stress_micro": F.round(F.col("stress") * 1_000_000).cast("bigint"),
                "application": F.coalesce("client_id", F.lit(NO_APPLICATION)),
                "application_or_host": F.coalesce("client_id", "client_ip"),
            }
        )
    )


def stress_share(scored: DataFrame, dimension: str, size: int = 10) -> DataFrame:
    """Largest contributors and their part of the whole stress."""
    key = DIMENSIONS[dimension]
    table = R.shares(scored, key, F.col("stress_micro"), size, "stress_micro")
    return table.select(key, (F.col("stress_micro") / 1e6).alias("stress"), "share")


def stress_over_time(scored: DataFrame, dimension: str, width: str, size: int = 10) -> DataFrame:
    key = DIMENSIONS[dimension]
    series = R.series_over_time(scored, width, key, size, F.col("stress_micro"), "stress_micro")
    return series.select("bucket", key, (F.col("stress_micro") / 1e6).alias("stress"))


def executions_over_time(scored: DataFrame, dimension: str, width: str, size: int = 10) -> DataFrame:
    key = "application_or_host" if dimension == "application" else DIMENSIONS[dimension]
    return R.series_over_time(scored, width, key, size)


def top_applications(scored: DataFrame, size: int = 10) -> DataFrame:
    table = R.terms(scored, "application_or_host", size, {"stress_micro": F.sum("stress_micro")})
    return table.select("application_or_host", (F.col("stress_micro") / 1e6).alias("stress"))


def request_rate(scored: DataFrame, width: str, size: int = 10) -> DataFrame:
    """Requests per second over time for the busiest applications or hosts."""
    series = R.series_over_time(scored, width, "application_or_host", size)
    return series.select(
        "bucket", "application_or_host", (F.col("count") / R.width_seconds(width)).alias("per_second")
    )
