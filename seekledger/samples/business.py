"""Products, logs and orders in the column names of the workload, derived from the provided tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seekledger.samples.request_log import K, read_table

PRODUCT_COLUMNS = {
    "product_id": "p_partkey",
    "title": "p_name",
    "description": "concat(p_name, ' - ', p_type, ' product from ', p_brand)",
    "category": "p_type",
    "brand": "p_brand",
    "price": "p_retailprice",
    "rating": "cast(1 + p_size % 5 as double)",
    "stock_count": "p_size",
}
LOG_COLUMNS = {
    "log_id": "event_id",
    "timestamp": "ts",
    "level": "case event_type when 'error' then 'ERROR' when 'signup' then 'WARN' else 'INFO' end",
    "service": "concat('svc-', cast(user_id % 5 as string))",
    "message": "concat('Request ', event_type, ': ', case when user_id % 3 = 0 then 'timeout' else 'done' end)",
    "status_code": f"case event_type when 'error' then 500 + {K} % 5 when 'signup' then 400 + {K} % 30 else 200 end",
    "duration_ms": "value",
    "endpoint": "concat('/api/', event_type)",
}
ORDER_COLUMNS = {
    "order_id": "o_orderkey",
    "customer_name": "c_name",
    "order_date": "o_orderdate",
    "status": "o_orderstatus",
    "total_amount": "o_totalprice",
    "item_count": "coalesce(items, 0)",
    "payment_method": "o_orderpriority",
    "shipping_country": "n_name",
    "category": "c_mktsegment",
}


def _select(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.selectExpr(*[f"{sql} AS {name}" for name, sql in columns.items()])


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _select(read_table(spark, sf_dir, "part"), PRODUCT_COLUMNS)


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _select(read_table(spark, sf_dir, "events"), LOG_COLUMNS)


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = read_table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count(F.lit(1)).alias("items")
    )
    customers = read_table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_nationkey")
    nations = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    joined = (
        read_table(spark, sf_dir, "orders")
        .join(items, "o_orderkey", "left")
        .join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    )
    return _select(joined, ORDER_COLUMNS)


# Price and stock changes of products, from the order lines; a line may leave one of them alone.
UPDATE_COLUMNS = {
    "product_id": "l_partkey",
    "price": "case when l_quantity < 25 then l_extendedprice end",
    "stock_count": "case when l_linenumber % 2 = 0 then cast(floor(l_quantity) as int) end",
    "changed_at": "l_shipdate",
    "line": "l_orderkey * 100000000 + l_suppkey * 10000 + l_linenumber * 1000 + cast(floor(l_quantity) as bigint)",
}


def product_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _select(read_table(spark, sf_dir, "lineitem"), UPDATE_COLUMNS)
