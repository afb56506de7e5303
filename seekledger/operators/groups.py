"""Index groups: which alias or data stream a concrete index belongs to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def is_hidden(name: Column) -> Column:
    return F.startswith(name, F.lit("."))


def build_group_map(indices: DataFrame, aliases: DataFrame, data_streams: DataFrame) -> DataFrame:
    """index_name -> index_group: the data stream if any, else the first alias, else the index.

    ``indices`` has index_name; ``aliases`` index_name, alias, position; ``data_streams``
    data_stream, index_name. Dot-prefixed indices count only inside a data stream.
    """
    first_alias = aliases.groupBy("index_name").agg(F.min_by("alias", "position").alias("alias"))
    streams = data_streams.groupBy("index_name").agg(F.max("data_stream").alias("data_stream"))
    known = (
        indices.select("index_name")
        .unionByName(aliases.select("index_name"))
        .filter(~is_hidden(F.col("index_name")))
        .unionByName(data_streams.select("index_name"))
        .distinct()
    )
    hidden = is_hidden(F.col("index_name"))
    return (
        known.join(first_alias, "index_name", "left")
        .join(streams, "index_name", "left")
        .select(
            "index_name",
            F.coalesce("data_stream", F.when(~hidden, F.col("alias")), "index_name").alias("index_group"),
        )
    )


def list_groups(group_map: DataFrame) -> DataFrame:
    """One row per group and index, whatever the size of a group."""
    return group_map.select("index_group", "index_name").distinct()


def group_intervals(history: DataFrame) -> DataFrame:
    """``index_name, index_group, valid_from, valid_to`` from maps read at various times (``index_name,
    index_group, seen_at``): an interval begins when another group is seen first, and the first one has no
    beginning. The windows run inside one index, over the times at which its group was read."""
    by_time = Window.partitionBy("index_name").orderBy("seen_at")
    before = F.lag("index_group").over(by_time)
    changes = history.withColumn("_before", before).filter(F.col("_before").isNull() | (F.col("_before") != F.col("index_group")))
    return changes.select(
        "index_name",
        "index_group",
        F.when(F.col("_before").isNotNull(), F.col("seen_at")).alias("valid_from"),
        F.lead("seen_at").over(by_time).alias("valid_to"),
    )


def resolve_group(df: DataFrame, group_map: DataFrame, index_column: str = "index", at: str = "ts") -> DataFrame:
    """Add index_group; a name that is no known index (an alias, say) is its own group. Whether the
    map is broadcast follows from its size in bytes, at planning or at run time.

    With a map of intervals (``group_intervals``) a row gets the group its index had at the time ``at``: a
    backfill of old requests gives what they gave then."""
    columns = [F.col("index_name").alias(index_column), F.col("index_group").alias("_group")]
    if "valid_from" not in group_map.columns:
        joined = df.join(group_map.select(*columns), index_column, "left")
    else:
        lookup = group_map.select(F.col("index_name").alias("_name"), columns[1], "valid_from", "valid_to")
        begun = F.col("valid_from").isNull() | (F.col("valid_from") <= F.col(at))
        open_ = F.col("valid_to").isNull() | (F.col(at) < F.col("valid_to"))
        same = F.col(index_column) == F.col("_name")
        joined = df.join(lookup, same & begun & open_, "left").drop("_name", "valid_from", "valid_to")
    return joined.withColumn("index_group", F.coalesce("_group", index_column)).drop("_group")
