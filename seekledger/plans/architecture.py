"""Index structure: one profile row per group, and fifteen rules over it.

Listings and events are each aggregated to one row per group before they are joined, so the joins
see group counts, not index, shard or event counts.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seekledger.functions.numbers import byte_count, byte_label, grouped, half_even, safe_int
from seekledger.operators import rollups as R
from seekledger.operators.groups import is_hidden
from seekledger.operators.selection import ranked_percentile
from seekledger.plans.texts import IMPACT, INDEX_CURRENT, INDEX_HOW, INDEX_RULES, INDEX_WHY
from seekledger.schemas import INDEX_RECOMMENDATIONS
from seekledger.sources.cluster import representative_index, visible

# Fixed values of the rules.
SEARCH_OPERATIONS = ("search", "async_search", "count")
WRITE_OPERATIONS = ("bulk", "index", "update", "delete")
DEFAULTS = {
    "index.number_of_replicas": "1",
    "index.mapping.total_fields.limit": "1000",
    "index.translog.durability": "request",
    "index.blocks.write": "false",
}
GB = 10**9
NODE_SHARDS, NODE_SHARDS_CRITICAL = 1000, 1500
SHARD_DOCS, SHARD_DOCS_CRITICAL = 200_000_000, 500_000_000
CLUSTER_GROUP = "_cluster"


# --- Inputs per group ------------------------------------------------------------------------


def grouped_rows(listing: DataFrame, group_map: DataFrame) -> DataFrame:
    """Listing rows with their group; rows of unknown indices drop out."""
    lookup = group_map.select(F.col("index_name").alias("index"), "index_group")
    return visible(listing).join(lookup, "index")


CELL_KEYS, CELL_ROWS = ["index_group", "lookback_seconds", "kind", "sorted"], "_n"


def usage_cells(events: DataFrame, include_doc_write: bool = False, by: list[str] = []) -> DataFrame:
    """Number of requests with equal lookback, kind and sort fields; counts of parts add up."""
    writes = WRITE_OPERATIONS + (("doc_write",) if include_doc_write else ())
    kind = F.when(F.col("operation").isin(*SEARCH_OPERATIONS), "search").when(F.col("operation").isin(*writes), "write")
    return events.groupBy(
        *by, "index_group", "lookback_seconds", kind.alias("kind"), F.array_distinct("fields.sorted").alias("sorted")
    ).agg(F.count(F.lit(1)).alias(CELL_ROWS))


def usage_stats(events: DataFrame, include_doc_write: bool = False) -> DataFrame:
    """Lookback percentiles, dominant sort field and its share, search and write counts per group."""
    return stats_of_cells(usage_cells(events, include_doc_write))


def stats_of_cells(cells: DataFrame) -> DataFrame:
    """``usage_stats`` of what ``usage_cells`` has counted. The three results share the exchange of the one scan."""
    n = F.col("_n")
    lookbacks = R.exact_percentiles(
        cells, ["index_group"], "lookback_seconds", {"lookback_p50_seconds": 0.5, "lookback_p95_seconds": 0.95}, weight="_n"
    )
    counts = cells.groupBy("index_group").agg(
        *[F.coalesce(F.sum(F.when(F.col("kind") == k, n)), F.lit(0)).alias(f"{k}_count") for k in ("search", "write")],
        F.coalesce(F.sum(F.when(F.size("sorted") > 0, n)), F.lit(0)).alias("_sorted"),
    )
    sorts = (
        cells.select("index_group", F.explode("sorted").alias("dominant_sort_field"), "_n")
        .groupBy("index_group", "dominant_sort_field")
        .agg(F.sum("_n").alias("_uses"))
    )
    dominant = R._top_rows(sorts, ["index_group"], "dominant_sort_field", "_uses", 1)
    both_zero = (F.col("lookback_p50_seconds") == 0) & (F.col("lookback_p95_seconds") == 0)
    return (
        counts.join(lookbacks, "index_group", "left")
        .join(dominant, "index_group", "left")
        .select(
            "index_group",
            *[
                F.when(~both_zero, F.col(c)).alias(c)
                for c in ("lookback_p50_seconds", "lookback_p95_seconds")
            ],
            "dominant_sort_field",
            (F.col("_uses") / F.col("_sorted")).alias("dominant_sort_pct"),
            "search_count",
            "write_count",
        )
    )


def shard_stats(cat_shards: DataFrame, group_map: DataFrame) -> DataFrame:
    """Started primary shards per group: number, bytes, whole average, largest document count."""
    primaries = grouped_rows(cat_shards, group_map).filter(
        (F.col("prirep") == "p") & (F.col("state") == "STARTED")
    )
    stats = primaries.groupBy("index_group").agg(
        F.count(F.lit(1)).alias("primary_shard_count"),
        F.sum(safe_int(F.col("store"))).alias("total_primary_store_bytes"),
        F.greatest(F.max(safe_int(F.col("docs"))), F.lit(0)).alias("max_docs_per_primary_shard"),
    )
    return stats.withColumn(
        "avg_primary_shard_size_bytes", F.expr("total_primary_store_bytes div primary_shard_count")
    )


def rollover_hours(cat_indices: DataFrame, group_map: DataFrame) -> DataFrame:
    """Median positive gap between index creations per group, in hours.

    The windows run inside one (group, day); the gap across days comes from the last creation of
    the previous day that has any. So no task sees more of a large group than one of its days, or
    its list of days. Equal times are merged first, as only positive gaps count.
    """
    day = ["index_group", "day"]
    created = (
        grouped_rows(cat_indices, group_map)
        .select("index_group", F.unix_micros(F.col("`creation.date.string`").try_cast("timestamp")).alias("at"))
        .filter(F.col("at").isNotNull())
        .distinct()
        .withColumn("day", F.expr("at div 86400000000"))
    )
    ends = created.groupBy(*day).agg(F.max("at").alias("end")).select(
        *day, F.lag("end").over(Window.partitionBy("index_group").orderBy("day")).alias("before_day")
    )
    before = F.lag("at").over(Window.partitionBy(*day).orderBy("at"))
    gaps = created.withColumn("before", before).join(ends, day).select(
        "index_group", ((F.col("at") - F.coalesce("before", "before_day")) / 3.6e9).alias("gap")
    )
    return ranked_percentile(gaps, ["index_group"], "gap", 0.5, "estimated_rollover_hours")


def representative_settings(settings: DataFrame, group_map: DataFrame) -> DataFrame:
    """Settings of the last index by name, with defaults."""
    chosen = representative_index(group_map, last=True).withColumnRenamed("index_name", "index")
    rows = chosen.join(settings, "index", "left")

    def raw(key: str) -> Column:
        value = F.try_element_at("settings", F.lit(key))
        return F.coalesce(value, F.lit(DEFAULTS[key])) if key in DEFAULTS else value

    def number(key: str) -> Column:
        return safe_int(raw(key), int(DEFAULTS[key]))

    sort_field = raw("index.sort.field")
    listed = F.coalesce(F.from_json(sort_field, "array<string>"), F.array(sort_field))
    return rows.select(
        "index_group",
        number("index.number_of_replicas").alias("number_of_replicas"),
        raw("index.routing.allocation.include._tier_preference").alias("tier_preference"),
        raw("index.codec").alias("index_codec"),
        (raw("index.blocks.write") == "true").alias("blocks_write"),
        raw("index.refresh_interval").alias("refresh_interval"),
        F.when(
            sort_field != "", F.when(F.startswith(sort_field, F.lit("[")), listed).otherwise(F.array(sort_field))
        ).alias("index_sort_field"),
        number("index.mapping.total_fields.limit").alias("total_fields_limit"),
        raw("index.translog.durability").alias("translog_durability"),
        raw("index.merge.policy.max_merged_segment").alias("max_merged_segment"),
    )


def index_stats(cat_indices: DataFrame, segments: DataFrame | None, group_map: DataFrame) -> DataFrame:
    """Number of indices of each group and their primary segments; unknown segments count as none."""
    rows = grouped_rows(cat_indices, group_map)
    if segments is None:
        rows = rows.withColumn("primary_segments", F.lit(0))
    else:
        rows = rows.join(segments, "index", "left")
    return rows.groupBy("index_group").agg(
        F.count(F.lit(1)).alias("index_count"),
        F.sum(F.coalesce("primary_segments", F.lit(0))).alias("_segments"),
    )


def index_dates(cat_indices: DataFrame, group_map: DataFrame) -> DataFrame:
    """Indices of each group with their creation dates: one row per index, as groups may be large."""
    return grouped_rows(cat_indices, group_map).select(
        "index_group", "index", F.expr("nullif(`creation.date.string`, '')").alias("creation_date")
    )


def index_profile(
    group_map: DataFrame,
    cat_indices: DataFrame,
    cat_shards: DataFrame,
    settings: DataFrame,
    mapping_info: DataFrame,
    usage: DataFrame,
    segments: DataFrame | None = None,
) -> DataFrame:
    """One row per visible group that has indices."""
    zero = ("primary_shard_count", "avg_primary_shard_size_bytes", "total_primary_store_bytes",
            "max_docs_per_primary_shard", "search_count", "write_count")
    joined = index_stats(cat_indices, segments, group_map).filter(~is_hidden(F.col("index_group")))
    for part in (
        shard_stats(cat_shards, group_map),
        representative_settings(settings, group_map),
        mapping_info,
        rollover_hours(cat_indices, group_map),
        usage,
    ):
        joined = joined.join(part, "index_group", "left")
    filled = joined.fillna(0, list(zero)).fillna(True, ["source_enabled"])
    return filled.withColumn(
        "avg_segments_per_primary",
        F.when(F.col("primary_shard_count") > 0, F.expr("_segments div primary_shard_count")).otherwise(0),
    ).drop("_segments")


# --- Rules -----------------------------------------------------------------------------------


def _fill(texts: dict[str, str], code: str, values: dict[str, Column]) -> Column:
    text, template = F.lit(texts[code]), texts[code]
    for name, value in values.items():
        marker = "{" + name + "}"
        if marker in template:
            text = F.replace(text, F.lit(marker), F.coalesce(value.cast("string"), F.lit("")))
    return text


def _finding(code: str, values: dict[str, Column], severity: Column | None = None) -> Column:
    category, usual, breaking, page = INDEX_RULES[code]
    return F.struct(
        F.lit(category).alias("category"),
        F.lit(code).alias("recommendation"),
        (F.lit(usual) if severity is None else severity).alias("severity"),
        _fill(INDEX_CURRENT, code, values).alias("current_value"),
        _fill(INDEX_WHY, code, values).alias("why"),
        _fill(INDEX_HOW, code, values).alias("how"),
        F.lit(page).alias("reference_url"),
        F.lit(breaking).alias("breaking_change"),
    )


def _span(hours: Column) -> Column:
    """Hours below two days, else days."""
    return F.when(hours < 48, F.concat(half_even(hours), F.lit("h"))).otherwise(
        F.concat(half_even(hours / 24), F.lit("d"))
    )


def _group_rules() -> list[Column]:
    c = F.col
    shards, avg = c("primary_shard_count"), c("avg_primary_shard_size_bytes")
    total, replicas = c("total_primary_store_bytes"), c("number_of_replicas")
    tier = F.coalesce("tier_preference", F.lit(""))
    cold, frozen, warm = (F.contains(tier, F.lit(t)) for t in ("cold", "frozen", "warm"))
    read_only = F.coalesce("blocks_write", F.lit(False))
    ratio = c("field_count") / c("total_fields_limit")
    lookback_h, rollover_h = c("lookback_p95_seconds") / 3600, c("estimated_rollover_hours")
    writes, searches = c("write_count"), c("search_count")
    segments, docs = c("avg_segments_per_primary"), c("max_docs_per_primary_shard")
    first_tier = F.replace(F.split(tier, ",")[0], F.lit("data_"), F.lit(""))
    max_segment = byte_count(c("max_merged_segment"))
    values = {
        "shards": shards,
        "avg_size": byte_label(avg),
        "total_size": byte_label(total),
        "replicas": replicas,
        "tier": first_tier,
        "reason": F.when(read_only, "read-only").otherwise(F.concat(first_tier, F.lit(" tier"))),
        "fields": c("field_count"),
        "limit": c("total_fields_limit"),
        "field_pct": (ratio * 100).cast("int"),
        "rollover": _span(rollover_h),
        "lookback": _span(lookback_h),
        "indices_hit": half_even(lookback_h / rollover_h),
        "sort_pct": (c("dominant_sort_pct") * 100).cast("int"),
        "sort_field": c("dominant_sort_field"),
        "refresh": F.coalesce("refresh_interval", F.lit("1s (default)")),
        "writes": grouped(writes),
        "searches": grouped(searches),
        "segments": segments,
        "max_segment": F.coalesce("max_merged_segment", F.lit("5gb (default)")),
        "docs": F.concat(half_even(docs / 1e6), F.lit("M")),
        "impact": F.when(docs > SHARD_DOCS_CRITICAL, IMPACT["docs_critical"]).otherwise(IMPACT["docs_warning"]),
        "shard_target": F.greatest(shards * 2, F.lit(2)),
    }

    def rule(code: str, condition: Column, critical: Column | None = None) -> Column:
        usual = INDEX_RULES[code][1]
        severity = None if critical is None else F.when(critical, "critical").otherwise(usual)
        return F.when(condition, _finding(code, values, severity))

    return [
        rule("shard_too_small", (shards > 1) & (avg < GB)),
        rule("shard_too_large", (shards > 0) & (avg >= 50 * GB), avg > 100 * GB),
        rule("replica_risk", (replicas == 0) & ~frozen),
        rule("replica_waste", (replicas != 0) & (cold | frozen)),
        rule("codec_opportunity", c("index_codec").isNull() & (read_only | warm | cold | frozen)),
        rule("field_count_near_limit", (c("total_fields_limit") > 0) & (ratio >= 0.8), ratio > 0.95),
        rule("source_disabled", ~c("source_enabled")),
        rule("rollover_lookback_mismatch", (rollover_h > 0) & (lookback_h > rollover_h * 2)),
        rule(
            "index_sorting_opportunity",
            (c("dominant_sort_pct") >= 0.7) & (F.coalesce(F.size("index_sort_field"), F.lit(0)) <= 0),
        ),
        rule(
            "refresh_interval_opportunity",
            (writes > 0)
            & (writes >= searches * 10)
            & F.coalesce(c("refresh_interval").isin("1s", "1000ms"), F.lit(True)),
        ),
        rule("translog_async", c("translog_durability") == "async"),
        rule("force_merge_opportunity", read_only & (segments > 5) & (shards > 0)),
        rule(
            "merge_policy_tuning",
            (avg >= 50 * GB) & (F.coalesce(max_segment, F.lit(0)) <= 5 * GB),
        ),
        rule("shard_docs_limit", docs > SHARD_DOCS, docs > SHARD_DOCS_CRITICAL),
    ]


def group_findings(profile: DataFrame) -> DataFrame:
    # The ratio of a missing or zero limit is not a finding.
    safe = profile.withColumn("total_fields_limit", F.nullif("total_fields_limit", F.lit(0)))
    found = safe.select("index_group", F.explode(F.array_compact(F.array(*_group_rules()))).alias("finding"))
    return found.select("index_group", "finding.*")


def node_findings(cat_shards: DataFrame) -> DataFrame:
    """Nodes with too many started shards; these rows belong to the whole cluster."""
    counts = (
        visible(cat_shards)
        .filter((F.col("state") == "STARTED") & (F.col("node") != ""))
        .groupBy("node")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") > NODE_SHARDS)
    )
    critical = F.col("n") > NODE_SHARDS_CRITICAL
    values = {
        "node": F.col("node"),
        "node_shards": grouped(F.col("n")),
        "impact": F.when(critical, IMPACT["node_critical"]).otherwise(IMPACT["node_warning"]),
    }
    severity = F.when(critical, "critical").otherwise("warning")
    finding = _finding("node_shard_count", values, severity)
    return counts.select(F.lit(CLUSTER_GROUP).alias("index_group"), finding.alias("finding")).select(
        "index_group", "finding.*"
    )


def index_recommendations(profile: DataFrame, cat_shards: DataFrame, as_of: datetime) -> DataFrame:
    rows = group_findings(profile).unionByName(node_findings(cat_shards)).withColumn("timestamp", F.lit(as_of))
    return rows.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in INDEX_RECOMMENDATIONS.fields])


# --- Dashboards ------------------------------------------------------------------------------


def findings_by_severity(rows: DataFrame) -> DataFrame:
    return R.terms(rows, "severity", 10)


def findings_by_category(rows: DataFrame) -> DataFrame:
    return R.terms(rows, "category", 10)


def findings_by_group_severity(rows: DataFrame) -> DataFrame:
    return R.nested_terms(rows, ["index_group", "severity"], [20, 10])


# Columns of the findings view (fixed).
FINDING_COLUMNS = (
    "index_group", "category", "recommendation", "severity", "current_value", "why", "how", "reference_url",
)


def all_findings(rows: DataFrame) -> DataFrame:
    """Newest first; the rows of one snapshot share their time, so groups and rules part them."""
    return rows.orderBy(F.desc("timestamp"), "index_group", "recommendation").select(*FINDING_COLUMNS)


def urgent_findings(rows: DataFrame) -> DataFrame:
    urgent = rows.filter((F.col("severity") == "critical") | F.col("breaking_change"))
    return all_findings(urgent).drop("category")
