"""Usage rollups over the events table, one function per dashboard table or chart.

Every function takes usage events already narrowed by ``select_events`` and reads only the columns
it names, so parquet pruning reaches down to single field lists.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seekledger.functions.numbers import avg_ms, sum_ms
from seekledger.operators import rollups as R
from seekledger.schemas import FIELD_CATEGORIES

# Columns of the raw-events view (fixed).
RAW_COLUMNS = (
    "timestamp", "index_group", "operation", "language", "client_id", "client_ip",
    "client_user_agent", "lookback_label", "path", "query_body", "response_status", "response_time_ms",
)
READ_CATEGORIES = ("queried", "filtered", "aggregated", "sorted", "sourced")


def _ms() -> Column:
    return F.col("response_time_ms")


def _count() -> Column:
    return F.count(F.lit(1))


def select_events(
    events: DataFrame,
    groups: Sequence[str] | None = None,
    languages: Sequence[str] | None = None,
    start: datetime | None = None,
    end: datetime | None = None,
) -> DataFrame:
    """Dashboard controls. A time range also prunes the day partitions."""
    if groups:
        events = events.filter(F.col("index_group").isin(list(groups)))
    if languages:
        events = events.filter(F.col("language").isin(list(languages)))
    if start is not None:
        events = events.filter((F.col("timestamp") >= F.lit(start)) & (F.col("event_date") >= F.lit(_day(start))))
    if end is not None:
        events = events.filter((F.col("timestamp") < F.lit(end)) & (F.col("event_date") <= F.lit(_day(end))))
    return events


def _day(at: datetime) -> date:
    return at.date()


def with_field(events: DataFrame, field: str, category: str | None = None) -> DataFrame:
    """Events that reference one field, in one category or in any."""
    categories = FIELD_CATEGORIES if category is None else (category,)
    condition = F.lit(False)
    for name in categories:
        condition = condition | F.coalesce(F.array_contains(f"fields.{name}", field), F.lit(False))
    return events.filter(condition)


# --- Traffic ---------------------------------------------------------------------------------


def groups_by_count(events: DataFrame, size: int = 20) -> DataFrame:
    return R.terms(events, "index_group", size)


def operations_over_time(events: DataFrame, width: str) -> DataFrame:
    return R.over_time(events, width)


def operation_distribution(events: DataFrame, size: int = 10) -> DataFrame:
    return R.terms(events, "operation", size)


def response_over_time(events: DataFrame, width: str) -> DataFrame:
    return R.over_time(events, width, {"avg_ms": avg_ms(_ms())})


def groups_over_time(events: DataFrame, width: str, size: int = 10, per_bucket: bool = False) -> DataFrame:
    return R.series_over_time(events, width, "index_group", size, per_bucket=per_bucket)


def group_operations(events: DataFrame, operations: int = 10, groups: int = 20) -> DataFrame:
    return R.nested_terms(events, ["index_group", "operation"], [groups, operations])


def response_by_group(events: DataFrame, size: int = 20) -> DataFrame:
    return R.terms(events, "index_group", size, {"avg_ms": avg_ms(_ms())})


def raw_events(events: DataFrame, page: int | None = None) -> DataFrame:
    """All events, or the newest ``page`` of them in order."""
    if page is not None:
        events = events.orderBy(F.desc("timestamp"), F.desc("request_id")).limit(page)
    return events.select(*RAW_COLUMNS)


# --- Field heat ------------------------------------------------------------------------------


def field_heat(events: DataFrame, category: str, size: int = 20) -> DataFrame:
    return R.terms_of_list(events, F.col(f"fields.{category}"), "field", size)


def field_cost(events: DataFrame, category: str, size: int = 20) -> DataFrame:
    metrics = {"total_ms": sum_ms(_ms())}
    return R.terms_of_list(events, F.col(f"fields.{category}"), "field", size, metrics)


def field_references(events: DataFrame, categories: Sequence[str] = FIELD_CATEGORIES) -> DataFrame:
    """One row per (event, category, field): one pass over the events serves all categories."""
    lists = F.array(
        *[F.struct(F.lit(c).alias("category"), F.array_distinct(f"fields.{c}").alias("names")) for c in categories]
    )
    tagged = events.withColumn("_list", F.explode(lists))
    return tagged.withColumns(
        {"category": F.col("_list.category"), "field": F.explode("_list.names")}
    ).drop("_list")


def field_heat_table(events: DataFrame, size: int = 20) -> DataFrame:
    """All five field tables, by count and by time, in one scan."""
    refs = field_references(events.select("fields", "response_time_ms"), READ_CATEGORIES)
    totals = refs.groupBy("category", "field").agg(
        _count().alias("count"), sum_ms(_ms()).alias("total_ms")
    )
    by_count = R._top_rows(totals, ["category"], "field", "count", size)
    by_time = R._top_rows(totals, ["category"], "field", "total_ms", size)
    return by_count.withColumn("ranked_by", F.lit("count")).unionByName(
        by_time.withColumn("ranked_by", F.lit("total_ms"))
    )


# --- Templates -------------------------------------------------------------------------------


def templates(events: DataFrame, size: int = 20) -> DataFrame:
    return R.terms(events, "query_template_hash", size, {"count": _count(), "avg_ms": avg_ms(_ms())})


def templates_over_time(events: DataFrame, width: str, size: int = 10, per_bucket: bool = False) -> DataFrame:
    return R.series_over_time(events, width, "query_template_hash", size, per_bucket=per_bucket)


def costliest_templates(events: DataFrame, size: int = 20) -> DataFrame:
    return R.terms(events, "query_template_hash", size, {"total_ms": sum_ms(_ms())})


def template_variety(events: DataFrame, size: int = 20, approximate: bool = False) -> DataFrame:
    return R.distinct_per_key(
        events, "index_group", "query_template_hash", size, ("count", "templates"), approximate
    )


def template_costs(events: DataFrame, size: int = 20) -> DataFrame:
    metrics = {"count": _count(), "avg_ms": avg_ms(_ms()), "total_ms": sum_ms(_ms())}
    return R.terms(events, "query_template_hash", size, metrics)


# --- Clients ---------------------------------------------------------------------------------


def clients(events: DataFrame, size: int = 20) -> DataFrame:
    metrics = {"count": _count(), "avg_ms": avg_ms(_ms())}
    return R.terms(events, "client_id", size, metrics, missing=R.NO_CLIENT)


def client_addresses(events: DataFrame, size: int = 20, approximate: bool = False) -> DataFrame:
    return R.distinct_per_key(
        events, "client_ip", "client_user_agent", size, ("count", "user_agents"), approximate
    )


def client_groups(events: DataFrame) -> DataFrame:
    return R.nested_terms(
        events, ["client_id", "index_group"], [20, 20], missing={"client_id": R.NO_CLIENT}
    )


def client_activity(events: DataFrame) -> DataFrame:
    """Every client with its number of requests, its groups and when it was last seen. Requests are counted
    per client and group first, so a client's list grows with its groups only."""
    named = events.fillna({"client_id": R.NO_CLIENT})
    cells = named.groupBy("client_id", "index_group").agg(_count().alias("_n"), F.max("timestamp").alias("_last"))
    return cells.groupBy("client_id").agg(
        F.sum("_n").alias("count"), F.sort_array(F.collect_set("index_group")).alias("index_groups"), F.max("_last").alias("last_seen")
    )


def client_fields(events: DataFrame, with_filtered: bool = False) -> DataFrame:
    fields = F.col("fields.queried")
    if with_filtered:
        fields = F.array_union(fields, F.col("fields.filtered"))
    return R.nested_terms_of_list(events, "client_id", fields, "field", (20, 20), R.NO_CLIENT)


def user_agents(events: DataFrame, size: int = 10) -> DataFrame:
    return R.terms(events, "client_user_agent", size)


# --- Lookback --------------------------------------------------------------------------------


def lookback_labels(events: DataFrame, size: int = 20) -> DataFrame:
    return R.terms(events, "lookback_label", size)


def lookback_by_group(events: DataFrame, size: int = 20) -> DataFrame:
    """Groups without any lookback rank last."""
    return R.terms(events, "index_group", size, {"avg_lookback_seconds": F.avg("lookback_seconds")})


def lookback_fields(events: DataFrame, size: int = 10) -> DataFrame:
    return R.terms(events, "lookback_field", size)


# --- Products --------------------------------------------------------------------------------


def product_table(products: DataFrame) -> DataFrame:
    return R.nested_terms(products, ["title", "category", "brand"], [100, 20, 20])


def product_categories(products: DataFrame, size: int = 10) -> DataFrame:
    return R.terms(products, "category", size)
