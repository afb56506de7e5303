"""Changes over time: templates, field use, mappings."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seekledger.functions.grammar import all_fields
from seekledger.functions.numbers import hundredths
from seekledger.operators import rollups as R
from seekledger.plans.usage import field_references


def two_windows(events: DataFrame, split: datetime, hours: int) -> DataFrame:
    """Events of the window before and the window after ``split``, marked in ``is_new``."""
    span = F.make_dt_interval(hours=F.lit(hours))
    start, end = F.lit(split) - span, F.lit(split) + span
    return events.filter(
        (F.col("timestamp") >= start)
        & (F.col("timestamp") < end)
        & (F.col("event_date") >= F.to_date(start))
        & (F.col("event_date") <= F.to_date(end))
    ).withColumn("is_new", F.col("timestamp") >= F.lit(split))


def template_drift(windows: DataFrame) -> DataFrame:
    """Per group and template: count in both windows and whether it is new, gone or kept."""
    counts = (
        windows.filter(F.col("query_template_hash").isNotNull())
        .groupBy("index_group", "query_template_hash")
        .agg(F.count_if(~F.col("is_new")).alias("before"), F.count_if("is_new").alias("after"))
    )
    state = F.when(F.col("before") == 0, "new").when(F.col("after") == 0, "gone").otherwise("kept")
    return counts.withColumn("state", state)


def new_templates(windows: DataFrame) -> DataFrame:
    return template_drift(windows).filter(F.col("state") == "new")


def abandoned_fields(windows: DataFrame, threshold: int = 0) -> DataFrame:
    """Fields used more than ``threshold`` times in the first window and not at all in the second."""
    counts = field_references(windows.select("index_group", "is_new", "fields")).groupBy("index_group", "field").agg(
        F.count_if(~F.col("is_new")).alias("before"), F.count_if("is_new").alias("after")
    )
    return counts.filter((F.col("before") > threshold) & (F.col("after") == 0))


def unmapped_fields(usage: DataFrame, mapping_fields: DataFrame) -> DataFrame:
    """Fields that requests name but the mapping does not hold, for groups with a mapping."""
    known_groups = mapping_fields.select("index_group").distinct()
    return usage.join(known_groups, "index_group", "left_semi").join(
        mapping_fields.select("index_group", "field_name"), ["index_group", "field_name"], "left_anti"
    )


def change_impact(events: DataFrame, changes: DataFrame) -> DataFrame:
    """For proposed changes (index_group, field_name): requests, clients and templates affected."""
    # The union of a request's field lists counts the request once per field, without a distinct.
    refs = events.select(
        "index_group", "client_id", "query_template_hash", F.explode(all_fields(F.col("fields"))).alias("field_name")
    )
    grouped = (
        refs.join(changes, ["index_group", "field_name"], "left_semi")
        .groupBy("index_group", "field_name", "client_id", "query_template_hash")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    totals = grouped.groupBy("index_group", "field_name").agg(
        F.sum("_n").alias("requests"),
        F.count_distinct("client_id").alias("clients"),
        F.count_distinct("query_template_hash").alias("templates"),
    )
    return changes.join(totals, ["index_group", "field_name"], "left").fillna(
        0, ["requests", "clients", "templates"]
    )


# What each proposed action breaks: the uses that stop working (fixed rules). An action not listed, such
# as adding a field, breaks none.
_ANY_USE = ("queried", "filtered", "aggregated", "sorted", "sourced", "written")
BREAKS = {
    "remove_field": _ANY_USE,
    "remove_multi_field": _ANY_USE,
    "text_to_keyword": ("queried",),
    "keyword_to_text": ("filtered", "aggregated", "sorted"),
    "disable_index": ("queried", "filtered"),
    "disable_doc_values": ("aggregated", "sorted"),
    "disable_norms": ("queried",),
}


def change_verdicts(usage: DataFrame, changes: DataFrame) -> DataFrame:
    """For proposed changes (index_group, field_name, action): whether the field's use in the window
    that ``usage`` (``mapping.field_usage``) covers makes them breaking, what breaks, and how often it is used."""
    counted = changes.join(usage, ["index_group", "field_name"], "left").fillna(0, [f"count_{c}" for c in _ANY_USE])
    broken = F.filter(
        F.array(
            *[
                F.when(F.col("action").isin(*[a for a, uses in BREAKS.items() if c in uses]) & (F.col(f"count_{c}") > 0), c)
                for c in _ANY_USE
            ]
        ),
        lambda c: c.isNotNull(),
    )
    judged = counted.withColumn("broken", broken)
    uses = F.lit(0)
    for c in _ANY_USE:
        uses = uses + F.when(F.array_contains("broken", c), F.col(f"count_{c}")).otherwise(0)
    return judged.select(
        "index_group", "field_name", "action", (F.size("broken") > 0).alias("breaking"), "broken",
        uses.cast("long").alias("broken_references"),
    )


def multi_field_gaps(mapping_fields: DataFrame, suffix: str = "keyword") -> DataFrame:
    """Fields that have a sub-field of this name in some group but not in the group given."""
    end = f".{suffix}"
    sub = mapping_fields.filter(F.endswith("field_name", F.lit(end))).select(
        "index_group", F.expr(f"substring(field_name, 1, length(field_name) - {len(end)})").alias("field_name")
    )
    some = sub.select("field_name").distinct()
    rest = mapping_fields.select("index_group", "field_name").join(some, "field_name", "left_semi")
    return rest.join(sub, ["index_group", "field_name"], "left_anti").distinct()


def field_growth(old: DataFrame, new: DataFrame, usage: DataFrame) -> DataFrame:
    """Per group, between two mapping snapshots: fields before and after, added and removed, and the
    references to added fields in ``usage`` (``mapping.field_usage`` of the events since)."""
    keys = ["index_group", "field_name"]
    both = old.select(*keys).withColumn("in_old", F.lit(True)).join(
        new.select(*keys).withColumn("in_new", F.lit(True)), keys, "full"
    )
    uses = sum((F.col(f"count_{c}") for c in _ANY_USE), F.lit(0))
    used = both.join(usage.select(*keys, uses.alias("uses")), keys, "left")
    added = F.col("in_old").isNull()
    return used.groupBy("index_group").agg(
        F.count("in_old").alias("fields_before"),
        F.count("in_new").alias("fields_after"),
        F.count_if(added).alias("added"),
        F.count_if(F.col("in_new").isNull()).alias("removed"),
        F.coalesce(F.sum(F.when(added, F.col("uses"))), F.lit(0)).cast("long").alias("references_to_added"),
    )


def type_conflicts(mapping_fields: DataFrame) -> DataFrame:
    """Field names mapped to different types in different groups."""
    kinds = mapping_fields.groupBy("field_name").agg(
        F.sort_array(F.collect_set("mapped_type")).alias("types"),
        F.count_distinct("index_group").alias("groups"),
    )
    return kinds.filter(F.size("types") > 1)


def template_percentiles(events: DataFrame, size: int = 20) -> DataFrame:
    """Costliest templates with their 95th percentile, from one count per (template, time) pair."""
    cells = (
        events.filter(F.col("query_template_hash").isNotNull())
        .groupBy("query_template_hash", hundredths(F.col("response_time_ms")).alias("_value"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    totals = cells.groupBy("query_template_hash").agg(
        F.sum(F.col("_value") * F.col("_n")).alias("_total"),
        F.sum("_n").alias("count"),
        F.sum(F.when(F.col("_value").isNotNull(), F.col("_n"))).alias("_timed"),
    )
    top = totals.orderBy(F.desc("_total"), F.asc("query_template_hash")).limit(size)
    # Only the values of the chosen templates are brought together, each once with its count.
    p95 = R._keep(cells, top, ["query_template_hash"], size).groupBy("query_template_hash").agg(
        F.round(F.percentile("_value", 0.95, F.col("_n")) / 100.0, 4).alias("p95_ms")
    )
    return top.join(p95, "query_template_hash", "left").select(
        "query_template_hash",
        (F.col("_total") / 100.0).alias("total_ms"),
        "count",
        (F.col("_total") / 100.0 / F.col("_timed")).alias("avg_ms"),
        "p95_ms",
    )


def template_fields(events: DataFrame, size: int = 50, fields: int = 20) -> DataFrame:
    """The costliest templates, each with the fields it queries most often. One count per template and
    field; a template's own row and time are counted once, with the first field of each request."""
    requests = events.filter(F.col("query_template_hash").isNotNull()).select(
        "query_template_hash", "response_time_ms", F.posexplode_outer(F.array_distinct("fields.queried")).alias("_at", "field")
    )
    first = F.coalesce("_at", F.lit(0)) == 0
    cells = requests.groupBy("query_template_hash", "field").agg(
        F.count(F.lit(1)).alias("count"), F.sum(F.when(first, hundredths(F.col("response_time_ms")))).alias("_total")
    )
    totals = cells.groupBy("query_template_hash").agg(F.sum("_total").alias("_total"))
    top = totals.orderBy(F.desc("_total"), F.asc("query_template_hash")).limit(size)
    chosen = R._keep(cells.drop("_total"), top, ["query_template_hash"], size)
    named = R._top_children(chosen, ["query_template_hash"], "field", fields)
    return named.join(top, "query_template_hash").select("query_template_hash", (F.col("_total") / 100.0).alias("total_ms"), "field", "count")


def mapping_history(old: DataFrame, new: DataFrame) -> DataFrame:
    """Fields added, removed or retyped between two mapping snapshots."""
    keys = ["index_group", "field_name"]
    both = old.select(*keys, F.col("mapped_type").alias("old_type")).join(
        new.select(*keys, F.col("mapped_type").alias("new_type")), keys, "full"
    )
    change = (
        F.when(F.col("old_type").isNull(), "added")
        .when(F.col("new_type").isNull(), "removed")
        .when(F.col("old_type") != F.col("new_type"), "retyped")
    )
    return both.withColumn("change", change).filter(F.col("change").isNotNull())
