"""Cluster listings derived from ``customer`` and ``orders``: one index per customer, grouped by nation.

Sizes come from the customers' orders and settings from the nation key, so that the groups differ
and every rule has groups on both sides of its threshold. The SQL texts read the same in Spark and
in other engines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seekledger.samples.mappings import mapping_texts
from seekledger.samples.request_log import read_table

INDEX_NAME = (
    "concat('tenant-', lpad(cast(nk as string), 2, '0'), '-', lpad(cast(ck as string), 8, '0'))"
)
GROUP_NAME = "concat('tenant-', lpad(cast(nk as string), 2, '0'))"
PRIMARIES = "1 + ck % 2"
REPLICAS = "nk % 3"
STORE_FACTOR = "case nk % 5 when 0 then 100 when 2 then 30000 when 3 then 60000 else 1000 end"
DOCS_FACTOR = "case nk % 6 when 5 then 60000000 when 4 then 30000000 else 1000 end"
NODE = "case when (ck + shard + copy) % 10 < 5 then 'node-0' when (ck + shard + copy) % 10 < 8 then 'node-1' else 'node-2' end"
STATE = "case when ck % 97 = 0 then 'UNASSIGNED' else 'STARTED' end"
SEGMENTS = "3 + ck % 12"
# A missing arm is a missing setting.
SETTINGS = {
    "index.number_of_replicas": "case when nk % 7 <> 0 then cast(nk % 3 as string) end",
    "index.routing.allocation.include._tier_preference": (
        "case nk % 8 when 1 then 'data_hot' when 2 then 'data_warm,data_hot' when 3 then 'data_cold' "
        "when 5 then 'data_hot' when 6 then 'data_warm,data_hot' when 7 then 'data_frozen' end"
    ),
    "index.codec": "case when nk % 5 = 0 then 'best_compression' end",
    "index.blocks.write": "case when nk % 6 = 0 then 'true' when nk % 6 = 1 then 'false' end",
    "index.refresh_interval": "case nk % 4 when 1 then '1s' when 2 then '30s' end",
    "index.sort.field": "case nk % 9 when 0 then '[\"timestamp\", \"level\"]' when 1 then 'price' when 2 then '[]' end",
    "index.mapping.total_fields.limit": "case nk % 10 when 0 then '20' when 1 then 'many' when 2 then '16' when 4 then '0' end",
    "index.translog.durability": "case when nk % 11 = 0 then 'async' end",
    "index.merge.policy.max_merged_segment": (
        "case nk % 10 when 2 then '10gb' when 7 then '5gb' when 3 then '512 MB' when 8 then 'large' end"
    ),
}
MAPPING_FAMILY = "case when nk % 2 = 0 then 'products' else 'orders' end"


def _tenants(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read_table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("ck")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")).alias("cents"),
        F.min("o_orderdate").alias("first"),
    )
    customers = read_table(spark, sf_dir, "customer").selectExpr("c_custkey AS ck", "c_nationkey AS nk")
    return customers.join(orders, "ck", "left").fillna(0, ["n", "cents"]).withColumns(
        {"index": F.expr(INDEX_NAME), "pri": F.expr(PRIMARIES), "rep": F.expr(REPLICAS)}
    )


def tenant_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tenants(spark, sf_dir).selectExpr("index AS index_name", f"{GROUP_NAME} AS index_group")


def cat_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = (
        _tenants(spark, sf_dir)
        .withColumn("shard", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("pri") - 1)))
        .withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("rep"))))
    )
    return shards.selectExpr(
        "index",
        "cast(shard as string) AS shard",
        "case when copy = 0 then 'p' else 'r' end AS prirep",
        f"{STATE} AS state",
        f"cast(n * ({DOCS_FACTOR}) as string) AS docs",
        f"cast(cents * ({STORE_FACTOR}) div (100 * pri) as string) AS store",
        f"case when ck % 97 <> 0 then {NODE} end AS node",
    )


def cat_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tenants(spark, sf_dir).select(
        "index",
        F.lit("green").alias("health"),
        F.lit("open").alias("status"),
        F.col("pri").cast("string").alias("pri"),
        F.col("rep").cast("string").alias("rep"),
        F.col("n").cast("string").alias("docs.count"),
        F.expr(f"cast(cents * ({STORE_FACTOR}) * (1 + rep) div 100 as string)").alias("store.size"),
        F.expr(f"cast(cents * ({STORE_FACTOR}) div 100 as string)").alias("pri.store.size"),
        F.date_format("first", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("creation.date.string"),
    )


def settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = [F.struct(F.lit(key), F.expr(sql)) for key, sql in SETTINGS.items()]
    present = F.filter(F.array(*entries), lambda e: e["col2"].isNotNull())
    return _tenants(spark, sf_dir).select("index", F.map_from_entries(present).alias("settings"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tenants(spark, sf_dir).filter("nk % 12 <> 6").selectExpr("index", f"{SEGMENTS} AS primary_segments")


def tenant_mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    lookup = F.create_map(*[F.lit(x) for pair in mapping_texts().items() for x in pair])
    return _tenants(spark, sf_dir).select(
        F.col("index").alias("index_name"),
        F.element_at(lookup, F.expr(MAPPING_FAMILY)).alias("mapping_json"),
    )


# Tenants' searches: the sample events, dealt out by kind of request and client.
TENANT_OF_EVENT = (
    "case when operation = 'bulk' then 15 when operation in ('update', 'doc_write') then 10 "
    "when index_group = 'products' then 0 when index_group in ('logs', 'logs-stream') then 5 else 20 end"
)


def tenant_usage(events: DataFrame) -> DataFrame:
    client = F.split("client_ip", "[.]")[3].cast("int")
    number = F.expr(TENANT_OF_EVENT) + client % 5
    return events.withColumn("index_group", F.concat(F.lit("tenant-"), F.lpad(number.cast("string"), 2, "0")))
