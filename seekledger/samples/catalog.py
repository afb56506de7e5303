"""Sample tables by name, each derived from the provided tables and written once per application."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seekledger.operators.groups import build_group_map
from seekledger.operators.tables import append_events, kept, written_once, written_path
from seekledger.plans.events import build_usage_events
from seekledger.plans.mapping import field_usage, mapping_diff, mapping_recommendations, recent
from seekledger.plans.architecture import index_profile, index_recommendations, usage_stats
from seekledger.samples import cluster_tables as tables
from seekledger.samples import request_log as log
from seekledger.samples.mappings import crm_groups, crm_mappings, mapping_table
from seekledger.sources.cluster import mapping_fields, mapping_info, segment_counts


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written_once(spark, f"request_log {sf_dir}", lambda: log.request_log(spark, sf_dir))


def requests_path(spark: SparkSession, sf_dir: str) -> str:
    requests(spark, sf_dir)
    return written_path(spark, f"request_log {sf_dir}")


def group_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    def build() -> DataFrame:
        # written, as three tables read it and each would scan the log
        indices = kept(log.known_indices(requests(spark, sf_dir)), "known_indices")
        return build_group_map(indices, log.alias_table(indices), log.stream_table(indices))

    return written_once(spark, f"group_map {sf_dir}", build)


def usage_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written_once(
        spark,
        f"usage_events {sf_dir}",
        lambda: build_usage_events(requests(spark, sf_dir), group_map(spark, sf_dir), once=True),
        append_events,
    )


def indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_map(spark, sf_dir).select("index_name")


def mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping_table(indices(spark, sf_dir))


def as_of(spark: SparkSession, sf_dir: str) -> datetime:
    """Time of the newest event: the 'now' of all windows."""
    return usage_events(spark, sf_dir).agg(F.max("timestamp")).first()[0]


def mapping_diff_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    def build() -> DataFrame:
        now = as_of(spark, sf_dir)
        fields = mapping_fields(mappings(spark, sf_dir), group_map(spark, sf_dir))
        return mapping_diff(fields, field_usage(recent(usage_events(spark, sf_dir), now)), now)

    return written_once(spark, f"mapping_diff {sf_dir}", build)


def mapping_advice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping_recommendations(mapping_diff_table(spark, sf_dir), as_of(spark, sf_dir))


def tenant_group_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written_once(spark, f"tenant_groups {sf_dir}", lambda: tables.tenant_groups(spark, sf_dir))


def tenant_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written_once(spark, f"tenant_shards {sf_dir}", lambda: tables.cat_shards(spark, sf_dir))


def tenant_usage_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    recent_events = recent(usage_events(spark, sf_dir), as_of(spark, sf_dir))
    return usage_stats(tables.tenant_usage(recent_events))


def tenant_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = tenant_group_map(spark, sf_dir)
    return written_once(
        spark,
        f"tenant_profile {sf_dir}",
        lambda: index_profile(
            groups,
            tables.cat_indices(spark, sf_dir),
            tenant_shards(spark, sf_dir),
            tables.settings(spark, sf_dir),
            mapping_info(tables.tenant_mappings(spark, sf_dir), groups),
            tenant_usage_stats(spark, sf_dir),
            segment_counts(tables.segments(spark, sf_dir)),
        ),
    )


def tenant_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    def build() -> DataFrame:
        return index_recommendations(
            tenant_profile(spark, sf_dir), tenant_shards(spark, sf_dir), as_of(spark, sf_dir)
        )

    return written_once(spark, f"tenant_findings {sf_dir}", build)


def crm_mapping_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written_once(spark, f"crm_mappings {sf_dir}", lambda: crm_mappings(spark, sf_dir))


def crm_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    def build() -> DataFrame:
        mappings = crm_mapping_table(spark, sf_dir)
        return mapping_fields(mappings, crm_groups(mappings))

    return written_once(spark, f"crm_fields {sf_dir}", build)
