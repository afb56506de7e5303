"""Bucket aggregations over DataFrames: terms, nested terms, time buckets, series, shares.

All of them aggregate before anything is ranked, so hot keys are combined map-side and what is
sorted is one row per bucket. Ties go to the smaller key.
"""

from __future__ import annotations

from datetime import datetime, timedelta
from math import prod

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Rankings whose size parameters allow no more rows than this are broadcast.
BROADCAST_ROWS = 200_000
NO_CLIENT = "(no x-client-id)"
MAX_BARS = 60
# Bar widths an automatic time axis chooses from.
WIDTHS = (
    "1 second", "5 seconds", "10 seconds", "30 seconds", "1 minute", "5 minutes", "10 minutes",
    "30 minutes", "1 hour", "3 hours", "12 hours", "1 day", "7 days", "30 days",
)
_UNIT_SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}


def _count() -> Column:
    return F.count(F.lit(1))


def width_seconds(width: str) -> int:
    amount, unit = width.split()
    return int(amount) * _UNIT_SECONDS[unit.rstrip("s")]


def auto_width(start: datetime, end: datetime) -> str:
    """Smallest width that needs at most MAX_BARS bars for the range."""
    span = (end - start) / timedelta(seconds=1)
    return next((w for w in WIDTHS if span <= MAX_BARS * width_seconds(w)), WIDTHS[-1])


def terms(
    df: DataFrame,
    key: str,
    size: int,
    metrics: dict[str, Column] | None = None,
    by: str | None = None,
    missing: str | None = None,
) -> DataFrame:
    """Top ``size`` keys by the first metric (or ``by``); null keys count only with ``missing``."""
    metrics = metrics or {"count": _count()}
    source = df.filter(F.col(key).isNotNull()) if missing is None else df.fillna({key: missing})
    ranked = source.groupBy(key).agg(*[m.alias(name) for name, m in metrics.items()])
    return ranked.orderBy(F.desc(by or next(iter(metrics))), F.asc(key)).limit(size)


def terms_of_list(
    df: DataFrame, values: Column, key: str, size: int, metrics: dict[str, Column] | None = None
) -> DataFrame:
    """Terms over a list column: a row counts once for each distinct value it holds."""
    return terms(df.withColumn(key, F.explode(F.array_distinct(values))), key, size, metrics)


def _top_rows(df: DataFrame, partition: list[str], key: str, metric: str, size: int) -> DataFrame:
    order = Window.partitionBy(*partition).orderBy(F.desc(metric), F.asc(key))
    return df.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= size).drop("_rank")


def _keep(cells: DataFrame, top: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """Cells of the chosen keys, of which there are at most ``rows``. An inner join on purpose: a semi join would be pushed below the aggregation, and the source scanned twice
    instead of one exchange serving the ranking and the cells."""
    chosen = top.select(*keys)
    return cells.join(F.broadcast(chosen) if rows <= BROADCAST_ROWS else chosen, keys)


def _top_children(cells: DataFrame, parents: list[str], child: str, size: int) -> DataFrame:
    """Best children per parent. Null children come last and are dropped after ranking, since an
    earlier filter would sink below the aggregation and part the two uses of its exchange."""
    order = Window.partitionBy(*parents).orderBy(F.isnull(child), F.desc("count"), F.asc(child))
    ranked = cells.withColumn("_rank", F.row_number().over(order))
    return ranked.filter((F.col("_rank") <= size) & F.col(child).isNotNull()).drop("_rank")


def nested_terms(
    df: DataFrame, keys: list[str], sizes: list[int], missing: dict[str, str] | None = None
) -> DataFrame:
    """Top keys inside each of the top parent keys, to any depth, by row count.

    A parent is ranked by its own total. The cells are counted once; parent totals are sums of
    cells, and the ranking windows see one row per cell.
    """
    source = df.fillna(missing) if missing else df
    cells = source.filter(F.col(keys[0]).isNotNull()).groupBy(*keys).agg(_count().alias("count"))
    for level, size in enumerate(sizes[:-1]):
        prefix = keys[: level + 1]
        totals = cells.groupBy(*prefix).agg(F.sum("count").alias("count"))
        if level == 0:
            top = totals.orderBy(F.desc("count"), F.asc(keys[0])).limit(size)
        else:
            top = _top_children(totals, keys[:level], keys[level], size)
        cells = _keep(cells, top, prefix, prod(sizes[: level + 1]))
    return _top_children(cells, keys[:-1], keys[-1], sizes[-1])


def nested_terms_of_list(
    df: DataFrame, parent: str, values: Column, child: str, sizes: tuple[int, int], missing: str
) -> DataFrame:
    """Top list values inside each of the top parents; rows with an empty list count for the parent."""
    exploded = df.fillna({parent: missing}).select(
        parent, F.posexplode_outer(F.array_distinct(values)).alias("_at", child)
    )
    # The first value of a row, or its empty list, stands for the row itself.
    cells = exploded.groupBy(parent, child, (F.coalesce("_at", F.lit(0)) == 0).alias("_row")).agg(
        _count().alias("count")
    )
    totals = cells.groupBy(parent).agg(F.sum(F.when(F.col("_row"), F.col("count"))).alias("_total"))
    top = totals.orderBy(F.desc("_total"), F.asc(parent)).limit(sizes[0])
    chosen = _keep(cells, top, [parent], sizes[0]).groupBy(parent, child).agg(F.sum("count").alias("count"))
    return _top_children(chosen, [parent], child, sizes[1])


def _bucket(width: str, at: str) -> Column:
    return F.window(F.col(at), width)["start"].alias("bucket")


def over_time(
    df: DataFrame, width: str, metrics: dict[str, Column] | None = None, at: str = "timestamp"
) -> DataFrame:
    """Date histogram; empty buckets are left out."""
    metrics = metrics or {"count": _count()}
    return df.groupBy(_bucket(width, at)).agg(*[m.alias(name) for name, m in metrics.items()])


def series_over_time(
    df: DataFrame,
    width: str,
    key: str,
    size: int,
    amount: Column | None = None,
    name: str = "count",
    per_bucket: bool = False,
    missing: str | None = None,
    at: str = "timestamp",
) -> DataFrame:
    """Date histogram split into the ``size`` largest series, by row count or by summed ``amount``.

    ``per_bucket`` ranks the keys inside every bucket, as a split below the time axis does;
    otherwise one ranking over the whole range decides.
    """
    source = df.filter(F.col(key).isNotNull()) if missing is None else df.fillna({key: missing})
    metric = _count() if amount is None else F.sum(amount)
    cells = source.groupBy(_bucket(width, at), key).agg(metric.alias(name))
    if per_bucket:
        return _top_rows(cells, ["bucket"], key, name, size)
    totals = cells.groupBy(key).agg(F.sum(name).alias("_total"))
    top = totals.orderBy(F.desc("_total"), F.asc(key)).limit(size)
    return _keep(cells, top, [key], size).select("bucket", key, name)


def distinct_per_key(
    df: DataFrame, key: str, value: str, size: int, names: tuple[str, str], approximate: bool = False
) -> DataFrame:
    """Row count and distinct ``value`` count per key, top ``size`` by row count.

    The exact form counts (key, value) pairs first: repeated pairs are merged map-side and a hot
    key is spread over its values.
    """
    source = df.filter(F.col(key).isNotNull())
    if approximate:
        counts = source.groupBy(key).agg(
            _count().alias(names[0]), F.approx_count_distinct(value).alias(names[1])
        )
    else:
        pairs = source.groupBy(key, value).agg(_count().alias("_n"))
        counts = pairs.groupBy(key).agg(F.sum("_n").alias(names[0]), F.count(value).alias(names[1]))
    return counts.orderBy(F.desc(names[0]), F.asc(key)).limit(size)


def shares(df: DataFrame, key: str, amount: Column, size: int, name: str, missing: str | None = None) -> DataFrame:
    """Top keys by summed ``amount`` with their part of the total over all keys."""
    source = df.filter(F.col(key).isNotNull()) if missing is None else df.fillna({key: missing})
    sums = source.groupBy(key).agg(F.sum(amount).alias(name))
    total = sums.agg(F.sum(name)).scalar()
    top = sums.orderBy(F.desc(name), F.asc(key)).limit(size)
    return top.withColumn("share", F.col(name) / total)


def exact_percentiles(
    df: DataFrame,
    keys: list[str],
    value: str,
    percents: dict[str, float],
    accuracy: int | None = None,
    digits: int | None = 4,
    weight: str | None = None,
) -> DataFrame:
    """Interpolated percentiles per key from value counts: memory grows with the number of distinct
    values of a key, not with its rows. Interpolating values of two decimals gives at most four.
    ``weight`` names a column of row counts. ``accuracy`` switches to the bounded approximate form,
    ``selection.ranked_percentile`` is the exact one for values that hardly repeat."""
    if accuracy is not None:
        return df.groupBy(*keys).agg(
            *[F.percentile_approx(value, p, accuracy).alias(n) for n, p in percents.items()]
        )
    number = _count() if weight is None else F.sum(weight)
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(number.alias("_n"))
    exact = {n: F.percentile(value, p, F.col("_n")) for n, p in percents.items()}
    return counts.groupBy(*keys).agg(
        *[(p if digits is None else F.round(p, digits)).alias(n) for n, p in exact.items()]
    )
