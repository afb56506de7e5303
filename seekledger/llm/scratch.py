"""Tables that cut lineage, in the folder the cluster shares.

The folder is ``spark.checkpoint.dir`` as the session names it; where it is unset (tests, local
runs) a folder below the warehouse is used. A table is written once and read back by any executor,
so nothing depends on the executor that made it.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Paths and tables made so far, by (application, scope).
_made: dict[tuple[str, str], list[tuple[str, str | None]]] = {}
_scope = ""


def shared_folder(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str, table: str | None = None) -> str:
    app = spark.sparkContext.applicationId
    path = f"{shared_folder(spark)}/llm-{app}/{name}-{uuid.uuid4().hex[:12]}"
    _made.setdefault((app, _scope), []).append((path, table))
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a new place and read it back."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written_bucketed(df: DataFrame, name: str, column: str, buckets: int) -> DataFrame:
    """The same, bucketed by ``column``: later joins on it move only the other side."""
    spark = df.sparkSession
    table = f"llm_{name}_{uuid.uuid4().hex[:12]}"
    path = new_path(spark, name, table)
    writer = df.write.format("parquet").option("path", path).option("compression", "zstd")
    writer.bucketBy(buckets, column).saveAsTable(table)
    return spark.table(table)


@contextmanager
def scope(name: str) -> Iterator[None]:
    """What is made inside belongs to ``name``, for ``release``."""
    global _scope
    before, _scope = _scope, name
    try:
        yield
    finally:
        _scope = before


def release(spark: SparkSession, name: str) -> None:
    """Remove what this application has made in a scope. Call it only when every result derived from
    those tables has itself been written."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path, table in _made.pop((spark.sparkContext.applicationId, name), []):
        if table:
            spark.sql(f"DROP TABLE IF EXISTS {table}")
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(conf).delete(place, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
