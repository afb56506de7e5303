"""Cluster listings: mappings, and the textual index and shard tables."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seekledger.functions.numbers import safe_int
from seekledger.operators.groups import is_hidden
from seekledger.operators.tables import kept

# Types without columnar values unless asked for.
NO_DOC_VALUES = ("text", "annotated_text")

#: Every object below "properties" of the root, of its children and so on, and one level of multi-fields. A
#: node's children lie two keys down, so fields may themselves be called "properties" or "fields".
_WALK = """
WITH RECURSIVE walk(index_group, path, node, kind) AS (
  SELECT index_group, '', root, 'root' FROM {roots}
  UNION ALL
  SELECT w.index_group, concat(w.path, CASE WHEN w.kind = 'root' THEN '' ELSE '.' END, child.key), child.value, part.key
  FROM walk w, LATERAL variant_explode(w.node) part, LATERAL variant_explode(part.value) child
  WHERE (part.key = 'properties' AND w.kind <> 'fields' OR part.key = 'fields' AND w.kind = 'properties') AND child.key IS NOT NULL
)
SELECT index_group, path, node FROM walk WHERE kind <> 'root'
"""
_LIMITS = ("spark.sql.cteRecursionRowLimit", "spark.sql.cteRecursionLevelLimit")


def visible(listing: DataFrame) -> DataFrame:
    """Rows of non-system indices."""
    return listing.filter(~is_hidden(F.col("index")))


def representative_index(group_map: DataFrame, last: bool = False) -> DataFrame:
    """One concrete index per visible group: the first by name, or the last."""
    pick = F.max("index_name") if last else F.min("index_name")
    groups = group_map.filter(~is_hidden(F.col("index_group")))
    return groups.groupBy("index_group").agg(pick.alias("index_name"))


def _roots(mappings: DataFrame, group_map: DataFrame, last: bool) -> DataFrame:
    """The mapping of each group's chosen index, with or without the wrapper the cluster puts around it."""
    chosen = mappings.join(representative_index(group_map, last), "index_name")
    root = F.try_parse_json("mapping_json")
    inner = F.try_variant_get(root, "$.mappings", "variant")
    return chosen.select("index_group", F.coalesce(inner, root).alias("root"))


@contextmanager
def _any_depth(spark: SparkSession) -> Iterator[None]:
    """No limit on levels and rows of a recursive query that runs inside."""
    before = {name: spark.conf.get(name) for name in _LIMITS}
    for name in _LIMITS:
        spark.conf.set(name, "-1")
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def _truthy(node: str, path: str, default: Column) -> Column:
    """A switch as the cluster reads it: absent is the default; null, false, 0 and '' are off."""
    found = F.try_variant_get(node, path, "variant")
    kind = F.schema_of_variant(found)
    return (
        F.when(found.isNull(), default)
        .when(kind == "VOID", False)
        .when(kind == "STRING", F.try_variant_get(node, path, "string") != "")
        .when(kind == "BOOLEAN", F.try_variant_get(node, path, "boolean"))
        .otherwise(F.coalesce(F.try_variant_get(node, path, "double") != 0, F.lit(True)))
    )


def _flat(roots: DataFrame) -> DataFrame:
    """One row per mapped field: objects, nested properties and one level of multi-fields, at any depth."""
    spark = roots.sparkSession
    kind = F.try_variant_get("node", "$.type", "variant")
    name = F.when(F.schema_of_variant(kind) == "STRING", F.try_variant_get("node", "$.type", "string"))
    named = lambda walked: walked.select(
        "index_group",
        F.col("path").alias("field_name"),
        name.alias("mapped_type"),
        _truthy("node", "$.index", F.lit(True)).alias("is_indexed"),
        _truthy("node", "$.doc_values", ~name.isin(*NO_DOC_VALUES)).alias("has_doc_values"),
    ).filter(F.col("mapped_type") != "")
    with _any_depth(spark):
        return kept(named(spark.sql(_WALK, roots=roots)), "mapped_fields")


def mapping_fields(mappings: DataFrame, group_map: DataFrame) -> DataFrame:
    """Mapped fields of every group, read from its first concrete index."""
    return _flat(_roots(mappings, group_map, last=False))


def mapping_info(mappings: DataFrame, group_map: DataFrame) -> DataFrame:
    """Field count and whether the source is stored, from each group's last concrete index."""
    roots = _roots(mappings, group_map, last=True)
    sources = roots.select("index_group", _truthy("root", "$._source.enabled", F.lit(True)).alias("source_enabled"))
    counts = _flat(roots).groupBy("index_group").agg(F.count(F.lit(1)).cast("int").alias("field_count"))
    return sources.join(counts, "index_group", "left").select(
        "index_group", F.coalesce("field_count", F.lit(0)).alias("field_count"), "source_enabled"
    )


def segment_counts(segments: DataFrame) -> DataFrame:
    return segments.select("index", safe_int(F.col("primary_segments")).alias("primary_segments"))
