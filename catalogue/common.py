"""Shared pieces of the registered queries."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

WIDTH = "12 hours"
BUCKET_SQL = (
    "strftime(time_bucket(INTERVAL '12 hours', \"timestamp\", TIMESTAMP '1970-01-01'), "
    "'%Y-%m-%d %H:%M:%S.%f') AS bucket"
)
STAMP = "yyyy-MM-dd HH:mm:ss.SSSSSS"
SUM_MS = "sum(cents) / 100.0 AS total_ms"
AVG_MS = "sum(cents) / 100.0 / count(cents) AS avg_ms"


class Query(NamedTuple):
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


def stamp_sql(expression: str, name: str | None = None) -> str:
    text = f"strftime({expression}, '%Y-%m-%d %H:%M:%S.%f')"
    return f"{text} AS {name}" if name else text


def portable(df: DataFrame) -> DataFrame:
    """Times and lists as text, so that results compare across engines."""
    columns = []
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            column = F.date_format(column, STAMP)
        elif isinstance(field.dataType, T.ArrayType):
            column = F.array_join(column, ",")
        elif isinstance(field.dataType, T.DateType):
            column = column.cast("string")
        elif isinstance(field.dataType, T.DecimalType):
            column = column.cast("double")
        columns.append(column.alias(field.name))
    return df.select(*columns)
