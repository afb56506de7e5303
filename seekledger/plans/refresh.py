"""Scheduled recomputation: diff, advice and findings for all groups at once, as new snapshots."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seekledger.operators.snapshots import Snapshots
from seekledger.operators.tables import replace_groups, write_snapshot
from seekledger.plans import architecture as A
from seekledger.plans import mapping as M
from seekledger.plans.partials import Partials
from seekledger.schemas import INDEX_RECOMMENDATIONS, MAPPING_DIFF, MAPPING_RECOMMENDATIONS
from seekledger.sources.cluster import mapping_fields

SCHEMAS = {
    "mapping_diff": MAPPING_DIFF,
    "mapping_recommendations": MAPPING_RECOMMENDATIONS,
    "index_recommendations": INDEX_RECOMMENDATIONS,
}


def _next(
    spark: SparkSession, name: str, folder: str, previous: Mapping[str, str], new: DataFrame, processed: DataFrame
) -> str:
    """Write the next snapshot of a table; groups that were not processed keep their old rows."""
    if name in previous:
        old = spark.read.schema(SCHEMAS[name]).parquet(previous[name])
        new = replace_groups(old, new, processed)
    return write_snapshot(new, f"{folder.rstrip('/')}/{name}")


def refresh_mapping(
    events: DataFrame,
    mappings: DataFrame,
    group_map: DataFrame,
    as_of: datetime,
    folder: str,
    previous: Mapping[str, str] = {},
    lookback_hours: int = M.LOOKBACK_HOURS,
) -> dict[str, str]:
    """Recompute diff and advice of every group with a mapping; returns the snapshot of each table."""
    spark = events.sparkSession
    fields = mapping_fields(mappings, group_map)
    diff = M.mapping_diff(fields, M.field_usage(M.recent(events, as_of, lookback_hours)), as_of)
    paths = {"mapping_diff": _next(spark, "mapping_diff", folder, previous, diff, fields)}
    # The advice reads the written diff, so the usage is aggregated once.
    stored = spark.read.schema(MAPPING_DIFF).parquet(paths["mapping_diff"])
    advice = M.mapping_recommendations(stored, as_of)
    paths["mapping_recommendations"] = _next(spark, "mapping_recommendations", folder, previous, advice, stored)
    return paths


def refresh_architecture(
    profile: DataFrame, cat_shards: DataFrame, as_of: datetime, folder: str, previous: Mapping[str, str] = {}
) -> dict[str, str]:
    """Recompute the findings of every profiled group and of the cluster as a whole."""
    findings = A.index_recommendations(profile, cat_shards, as_of)
    cluster = profile.sparkSession.range(1).select(F.lit(A.CLUSTER_GROUP).alias("index_group"))
    processed = profile.select("index_group").unionByName(cluster)
    spark = profile.sparkSession
    return {"index_recommendations": _next(spark, "index_recommendations", folder, previous, findings, processed)}


def refresh_usage(
    partials: Partials,
    snapshots: Snapshots,
    mappings: DataFrame,
    group_map: DataFrame,
    as_of: datetime,
    lookback_hours: int = M.LOOKBACK_HOURS,
) -> list[str]:
    """The same diff and advice, kept up to date: only days with new events are read (and returned), and
    refreshes that run at the same time keep each other's groups."""
    changed = partials.update()
    usage = partials.window(as_of - timedelta(hours=lookback_hours))
    fields = mapping_fields(mappings, group_map)
    diff = snapshots.replace("mapping_diff", M.mapping_diff(fields, usage, as_of), fields)
    processed = fields.select("index_group").distinct()
    advised = M.mapping_recommendations(diff.join(processed, "index_group", "left_semi"), as_of)
    snapshots.replace("mapping_recommendations", advised, processed)
    return changed


def refresh_findings(profile: DataFrame, cat_shards: DataFrame, as_of: datetime, snapshots: Snapshots) -> DataFrame:
    """The findings of every profiled group and of the cluster, in place of those they had."""
    cluster = profile.sparkSession.range(1).select(F.lit(A.CLUSTER_GROUP).alias("index_group"))
    processed = profile.select("index_group").unionByName(cluster)
    return snapshots.replace("index_recommendations", A.index_recommendations(profile, cat_shards, as_of), processed)
