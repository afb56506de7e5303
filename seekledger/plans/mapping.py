"""Declared mappings against observed use, and the advice that follows."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seekledger.operators import rollups as R
from seekledger.plans.texts import MAPPING_HOW, MAPPING_WHY
from seekledger.plans.usage import field_references
from seekledger.schemas import FIELD_CATEGORIES, MAPPING_DIFF, MAPPING_RECOMMENDATIONS
from seekledger.sources.cluster import NO_DOC_VALUES

LOOKBACK_HOURS = 168
READ_COUNTS = ("count_queried", "count_filtered", "count_aggregated", "count_sorted")


def recent(events: DataFrame, as_of: datetime, lookback_hours: int = LOOKBACK_HOURS) -> DataFrame:
    """Events of the window before ``as_of``; the day predicate prunes partitions."""
    start = F.lit(as_of) - F.make_dt_interval(hours=F.lit(lookback_hours))
    return events.filter((F.col("timestamp") >= start) & (F.col("event_date") >= F.to_date(start)))


def usage_measures() -> list[Column]:
    """References and last use in each category."""
    in_category = {c: F.col("category") == c for c in FIELD_CATEGORIES}
    return [F.count_if(hit).alias(f"count_{c}") for c, hit in in_category.items()] + [
        F.max(F.when(hit, F.col("timestamp"))).alias(f"last_seen_{c}") for c, hit in in_category.items()
    ]


def field_usage(events: DataFrame) -> DataFrame:
    """Per group and field: references and last use in each category. One explode, one shuffle of
    partially aggregated rows."""
    refs = field_references(events.select("index_group", "timestamp", "fields"))
    return refs.groupBy("index_group", F.col("field").alias("field_name")).agg(*usage_measures())


def _total(columns: tuple[str, ...] | list[str]) -> Column:
    total = F.lit(0)
    for name in columns:
        total = total + F.col(name)
    return total


def classification() -> Column:
    counts = [f"count_{c}" for c in FIELD_CATEGORIES]
    return (
        F.when(_total(counts) == 0, "unused")
        .when(_total(READ_COUNTS) > 0, "active")
        .when(F.col("count_sourced") > 0, "sourced_only")
        .otherwise("write_only")
    )


def mapping_diff(fields: DataFrame, usage: DataFrame, as_of: datetime) -> DataFrame:
    """Every mapped field with its use; fields that are used but not mapped are left out."""
    joined = fields.join(usage, ["index_group", "field_name"], "left")
    counted = joined.fillna(0, [f"count_{c}" for c in FIELD_CATEGORIES])
    full = counted.withColumns(
        {
            "timestamp": F.lit(as_of),
            "total_references": _total([f"count_{c}" for c in FIELD_CATEGORIES]),
            "last_seen": F.greatest(*[f"last_seen_{c}" for c in FIELD_CATEGORIES]),
            "classification": classification(),
        }
    )
    return full.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in MAPPING_DIFF.fields])


# --- Advice ----------------------------------------------------------------------------------


def _advice(code: str, condition: Column, breaking: bool = False) -> Column:
    row = F.struct(F.lit(code).alias("recommendation"), F.lit(breaking).alias("breaking_change"))
    return F.when(condition, row)


def _rules() -> list[Column]:
    kind, state = F.col("mapped_type"), F.col("classification")
    queried, filtered, aggregated, sorted_ = (F.col(c) for c in READ_COUNTS)
    has_structures = F.col("is_indexed") | F.col("has_doc_values")
    unused, active = state == "unused", state == "active"
    dotted = F.contains(F.col("field_name"), F.lit("."))
    never_columnar = (aggregated == 0) & (sorted_ == 0)
    exact_text = active & (kind == "text") & (queried == 0) & (filtered > 0)
    return [
        _advice("disable_index", state.isin("write_only", "sourced_only") & has_structures),
        _advice("remove_multifield", unused & dotted),
        _advice("remove_field", unused & ~dotted),
        _advice(
            "disable_doc_values",
            active
            & ((queried > 0) | (filtered > 0))
            & never_columnar
            & F.col("has_doc_values")
            & ~kind.isin(*NO_DOC_VALUES),
        ),
        _advice("disable_norms", exact_text),
        _advice("change_to_keyword", exact_text & never_columnar, breaking=True),
        _advice(
            "add_keyword_subfield",
            active
            & (kind == "text")
            & (queried > 0)
            & ((filtered > 0) | (aggregated > 0))
            & F.col("_keyword").isNull(),
        ),
    ]


def _text(texts: dict[str, str], code: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in texts.items() for x in pair]), code)


def _fill(text: Column) -> Column:
    name = F.col("field_name")
    values = {
        "{field}": name,
        "{type}": F.col("mapped_type"),
        "{parent}": F.regexp_extract(name, r"^(.*)\.([^.]*)$", 1),
        "{sub}": F.regexp_extract(name, r"^(.*)\.([^.]*)$", 2),
    }
    for marker, value in values.items():
        text = F.replace(text, F.lit(marker), value)
    return text


def mapping_recommendations(diff: DataFrame, as_of: datetime) -> DataFrame:
    """Advice per field: at most one row for a field nobody reads, several for one in use."""
    suffix = ".keyword"
    keywords = diff.filter(F.endswith("field_name", F.lit(suffix))).select(
        "index_group",
        F.expr(f"substr(field_name, 1, length(field_name) - {len(suffix)})").alias("field_name"),
        F.lit(True).alias("_keyword"),
    )
    judged = diff.join(keywords.distinct(), ["index_group", "field_name"], "left").withColumn(
        "advice", F.explode(F.array_compact(F.array(*_rules())))
    )
    code = F.col("advice.recommendation")
    columns = {
        "timestamp": F.lit(as_of),
        "recommendation": code,
        "why": _text(MAPPING_WHY, code),
        "how": _fill(_text(MAPPING_HOW, code)),
        "breaking_change": F.col("advice.breaking_change"),
    }
    return judged.select(
        [
            columns.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name)
            for f in MAPPING_RECOMMENDATIONS.fields
        ]
    )


# --- Dashboards ------------------------------------------------------------------------------


def diff_by_class(diff: DataFrame) -> DataFrame:
    return R.terms(diff, "classification", 10)


def diff_by_group_class(diff: DataFrame) -> DataFrame:
    return R.nested_terms(diff, ["index_group", "classification"], [20, 10])


def diff_table(diff: DataFrame) -> DataFrame:
    return diff.groupBy("index_group", "field_name", "classification", "mapped_type").agg(
        F.max("total_references").alias("max_references"), F.max("last_seen").alias("last_seen")
    )


def unused_fields(diff: DataFrame) -> DataFrame:
    return (
        diff.filter(F.col("classification") == "unused")
        .groupBy("index_group", "field_name", "mapped_type", "is_indexed")
        .agg(F.count(F.lit(1)).alias("count"), F.max("last_seen").alias("last_seen"))
    )


def diff_by_type(diff: DataFrame) -> DataFrame:
    return R.terms(diff, "mapped_type", 20)


def advice_by_type(advice: DataFrame) -> DataFrame:
    return R.terms(advice, "recommendation", 10)


def advice_by_group_type(advice: DataFrame) -> DataFrame:
    return R.nested_terms(advice, ["index_group", "recommendation"], [20, 10])


def advice_table(advice: DataFrame) -> DataFrame:
    keys = ("index_group", "field_name", "mapped_type", "recommendation", "why", "how")
    return advice.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"))


def breaking_advice(advice: DataFrame) -> DataFrame:
    keys = ("index_group", "field_name", "recommendation", "why", "how")
    return advice.filter("breaking_change").groupBy(*keys).agg(F.count(F.lit(1)).alias("count"))
