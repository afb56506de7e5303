"""Mappings of the sample indices: one per index family, as the cluster would report it."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _field(kind: str, **options) -> dict:
    return {"type": kind, **options}


_KEYWORD = {"keyword": _field("keyword")}

MAPPINGS = {
    "products": {
        "title": _field("text", fields=_KEYWORD),
        "description": _field("text"),
        "category": _field("text"),
        "subcategory": _field("keyword"),
        "brand": _field("keyword"),
        "price": _field("float"),
        "rating": _field("float"),
        "stock_count": _field("integer", doc_values=False),
        "created_at": _field("date"),
        "internal_sku": _field("keyword", index=False, doc_values=False),
        "legacy_supplier_code": _field("keyword", index=False),
        "tags": _field("keyword"),
        "dimensions": {"properties": {"width": _field("float"), "box": {"properties": {"kind": _field("keyword")}}}},
        "properties": _field("annotated_text"),
    },
    "logs": {
        "timestamp": _field("date"),
        "level": _field("keyword"),
        "service": _field("keyword"),
        "host": _field("keyword"),
        "message": _field("text"),
        "status_code": _field("integer"),
        "duration_ms": _field("float"),
        "user_agent": _field("keyword"),
        "internal_request_id": _field("keyword", index=None),
    },
    "orders": {
        "order_id": _field("keyword"),
        "customer_name": _field("text", fields=_KEYWORD),
        "order_date": _field("date"),
        "status": _field("text"),
        "total_amount": _field("float"),
        "item_count": _field("integer"),
        "category": _field("keyword"),
        "channel": _field("keyword"),
        "internal_notes": _field("text", doc_values="yes"),
    },
}


def mapping_texts() -> dict[str, str]:
    """Mapping by family; the orders do not keep their source."""
    roots = {family: {"properties": fields} for family, fields in MAPPINGS.items()}
    roots["orders"]["_source"] = {"enabled": False}
    return {family: json.dumps(root) for family, root in roots.items()}


def mapping_table(indices: DataFrame) -> DataFrame:
    """index_name, mapping_json for every index of the log."""
    lookup = F.create_map(*[F.lit(x) for pair in mapping_texts().items() for x in pair])
    family = F.split("index_name", "-")[0]
    return indices.select("index_name", F.element_at(lookup, family).alias("mapping_json"))


# --- Mappings that grow with the tables: an index per hundred customers, a field per customer -----------

CRM_INDEX = "concat('crm-', cast(c_custkey div 100 as string))"
#: Of one customer, as SQL that reads the same in other engines.
CRM_FIELD = {
    "segment": "lower(c_mktsegment)",
    "name": "concat('f', cast(c_custkey % 100 as string))",
    "type": "case c_nationkey % 4 when 0 then 'keyword' when 1 then 'text' when 2 then 'long' else 'date' end",
    "off": "c_acctbal < 0",
    "row_only": "c_custkey % 7 = 0",
    "sub": "c_nationkey % 4 = 1 and c_custkey % 3 = 0",
}


def crm_mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """index_name, mapping_json: an object per market segment, with a field for each of its customers."""
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr(
        f"{CRM_INDEX} AS index_name", *[f"{sql} AS `{name}`" for name, sql in CRM_FIELD.items()]
    )
    keyword = F.create_map(F.lit("keyword"), F.struct(F.lit("keyword").alias("type")))
    leaf = F.struct(
        "type",
        F.when(F.col("off"), F.lit(False)).alias("index"),
        F.when(F.col("row_only"), F.lit(False)).alias("doc_values"),
        F.when(F.col("sub"), keyword).alias("fields"),
    )

    def gathered(key: str, value: Column) -> Column:
        return F.map_from_entries(F.collect_list(F.struct(key, value)))

    objects = customers.groupBy("index_name", "segment").agg(gathered("name", leaf).alias("properties"))
    roots = objects.groupBy("index_name").agg(gathered("segment", F.struct("properties")).alias("properties"))
    return roots.select("index_name", F.to_json(F.struct("properties")).alias("mapping_json"))


def crm_groups(mappings: DataFrame) -> DataFrame:
    return mappings.select("index_name", F.col("index_name").alias("index_group"))
