"""The searches and writes of the sample traffic, as table queries on products, logs and orders."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seekledger.operators import rollups as R


def matches(text: str, term: str) -> Column:
    """Full-text match without ranking: some lower-cased token equals the term."""
    return F.array_contains(F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}_]+"), term.lower())


def search_text(df: DataFrame, text: str, term: str, columns: Sequence[str], key: str, size: int) -> DataFrame:
    """Rows that match; without a ranking the smallest keys come first."""
    return df.filter(matches(text, term)).orderBy(key).limit(size).select(*columns)


def filter_sorted(
    df: DataFrame, condition: Column, order: Sequence[Column], columns: Sequence[str], size: int
) -> DataFrame:
    return df.filter(condition).orderBy(*order).limit(size).select(*columns)


def in_category(products: DataFrame, category: str, size: int = 20) -> DataFrame:
    columns = ("product_id", "title", "price", "category")
    return filter_sorted(products, F.col("category") == category, [F.asc("price"), F.asc("product_id")], columns, size)


def count_by(df: DataFrame, key: str, size: int) -> DataFrame:
    return R.terms(df, key, size)


def rated_at_least(products: DataFrame, rating: float, size: int = 10) -> DataFrame:
    return products.filter(F.col("rating") >= rating).orderBy("product_id").limit(size)


def by_id(df: DataFrame, key: str, value) -> DataFrame:
    return df.filter(F.col(key) == value)


def match_all(df: DataFrame, key: str, size: int = 5) -> DataFrame:
    return df.orderBy(key).limit(size)


def with_discount(products: DataFrame, category: str, discount: float) -> DataFrame:
    return products.filter(F.col("category") == category).select(
        "product_id", "title", "category", (F.col("price") * (1 - discount)).alias("discounted_price")
    )


def newest_logs(logs: DataFrame, level: str, start: datetime, size: int = 50) -> DataFrame:
    condition = (F.col("level") == level) & (F.col("timestamp") >= F.lit(start))
    order = [F.desc("timestamp"), F.desc("log_id")]
    return filter_sorted(logs, condition, order, ("log_id", "timestamp", "level", "service"), size)


def orders_since(orders: DataFrame, start: datetime, size: int = 20) -> DataFrame:
    condition = F.col("order_date") >= F.lit(start)
    order = [F.desc("order_date"), F.asc("order_id")]
    return filter_sorted(orders, condition, order, ("order_id", "order_date", "status", "total_amount"), size)


def _hundredths(name: str) -> Column:
    return F.round(F.col(name) * 100).cast("bigint")


def average_duration(logs: DataFrame, size: int = 20) -> DataFrame:
    mean = F.sum(_hundredths("duration_ms")) / 100.0 / F.count("duration_ms")
    return R.terms(logs, "service", size, {"count": F.count(F.lit(1)), "avg_duration": mean})


def revenue_by(orders: DataFrame, key: str, size: int = 20) -> DataFrame:
    revenue = F.sum(_hundredths("total_amount")) / 100.0
    return R.terms(orders, key, size, {"count": F.count(F.lit(1)), "revenue": revenue})


def logs_over_time(logs: DataFrame, start: datetime, width: str) -> DataFrame:
    return R.over_time(logs.filter(F.col("timestamp") >= F.lit(start)), width)


def failed_requests(logs: DataFrame, service: str, size: int = 30) -> DataFrame:
    condition = (F.col("service") == service) & (F.col("status_code") >= 400)
    columns = ("log_id", "timestamp", "level", "service", "endpoint", "status_code", "message")
    return filter_sorted(logs, condition, [F.desc("timestamp"), F.desc("log_id")], columns, size)


def orders_in_status(orders: DataFrame, status: str, size: int = 20) -> DataFrame:
    columns = ("order_id", "customer_name", "status", "total_amount", "order_date")
    order = [F.desc("order_date"), F.asc("order_id")]
    return filter_sorted(orders, F.col("status") == status, order, columns, size)


def slowest_requests(logs: DataFrame, at_least_ms: float = 100, size: int = 20) -> DataFrame:
    seconds = F.col("duration_ms") / 1000
    score = F.when(F.col("status_code") >= 500, seconds * 3).otherwise(seconds)
    columns = ("log_id", "timestamp", "service", "duration_ms", "status_code", "severity_score")
    scored = logs.withColumn("severity_score", score)
    order = [F.desc("duration_ms"), F.asc("log_id")]
    return filter_sorted(scored, F.col("duration_ms") >= at_least_ms, order, columns, size)


def orders_by_weekday(orders: DataFrame) -> DataFrame:
    named = orders.withColumn("day_of_week", F.upper(F.date_format("order_date", "EEEE")))
    return R.terms(named, "day_of_week", 7)


def densest_orders(orders: DataFrame, status: str, size: int = 20) -> DataFrame:
    columns = ("order_id", "customer_name", "total_amount", "item_count")
    value = F.col("total_amount") * F.col("item_count")
    return filter_sorted(orders, F.col("status") == status, [value.desc(), F.asc("order_id")], columns, size)


# --- Writes ----------------------------------------------------------------------------------


def upsert(target: DataFrame, documents: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Whole documents replace rows of the same key; the last document of a key wins."""
    columns = target.columns
    newest = documents.groupBy(key).agg(
        F.max_by(F.struct(*columns), F.struct(*order)).alias("doc")
    )
    return target.join(newest.select(key), key, "left_anti").unionByName(newest.select("doc.*"))


def append(target: DataFrame, documents: DataFrame) -> DataFrame:
    return target.unionByName(documents)


def partial_update(target: DataFrame, updates: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Each column takes its latest value that is not null; keys without a row are ignored."""
    changed = [c for c in updates.columns if c in target.columns and c != key]
    latest = updates.groupBy(key).agg(
        *[
            F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(*order))).alias(f"_{c}")
            for c in changed
        ]
    )
    joined = target.join(latest, key, "left")
    return joined.select(
        *[F.coalesce(f"_{c}", c).alias(c) if c in changed else F.col(c) for c in target.columns]
    )
