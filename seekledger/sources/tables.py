"""Reading the input tables with their declared schemas: nothing is inferred, so nothing is scanned
twice and missing columns come back as nulls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seekledger import schemas
from seekledger.plans.events import EventSettings, is_answered, is_parsed

INPUTS = {
    "requests": schemas.REQUEST_LOG,
    "aliases": schemas.ALIASES,
    "data_streams": schemas.DATA_STREAMS,
    "mappings": schemas.MAPPING_JSON,
    "cat_indices": schemas.CAT_INDICES,
    "cat_shards": schemas.CAT_SHARDS,
    "settings": schemas.INDEX_SETTINGS,
    "segments": schemas.SEGMENTS,
    "usage_events": schemas.USAGE_EVENTS,
}


def read_input(spark: SparkSession, name: str, path: str, format: str = "parquet") -> DataFrame:
    """One of the input tables, from parquet, orc or line-delimited JSON."""
    return spark.read.schema(INPUTS[name]).format(format).load(path)


def unobserved_requests(requests: DataFrame, settings: EventSettings = EventSettings()) -> DataFrame:
    """Answered requests whose body is over the limit, if there is one: number and bytes."""
    large = requests.filter(is_answered() & ~is_parsed(settings))
    return large.agg(
        F.count(F.lit(1)).alias("requests"), F.coalesce(F.sum(F.octet_length("body")), F.lit(0)).alias("bytes")
    )
