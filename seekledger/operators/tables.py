"""Written tables: snapshots replaced per group, and tables shared by many queries."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_written: dict[tuple[str, str], str] = {}


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can read: ``spark.checkpoint.dir`` as the session names it, else a
    folder in the warehouse."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    return folder or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"


def new_place(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used yet."""
    folder = shared_folder(spark)
    safe = re.sub(r"\W+", "_", name).strip("_")
    return f"{folder.rstrip('/')}/seekledger-{spark.sparkContext.applicationId}/{safe}-{uuid.uuid4().hex[:8]}"


def kept(table: DataFrame, name: str) -> DataFrame:
    """Write a table to a place of its own and read it back: its lineage ends there."""
    spark = table.sparkSession
    path = new_place(spark, name)
    table.write.parquet(path)
    return spark.read.schema(table.schema).parquet(path)


def kept_at(table: DataFrame, path: str, spark: SparkSession | None = None) -> DataFrame:
    """The same, in place of what was at ``path``; ``spark`` reads it, if another session is to."""
    table.write.mode("overwrite").parquet(path)
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in table.schema])
    return (spark or table.sparkSession).read.schema(schema).parquet(path)


def written_once(
    spark: SparkSession,
    name: str,
    build: Callable[[], DataFrame],
    write: Callable[[DataFrame, str], None] | None = None,
) -> DataFrame:
    """Read the table ``name``, writing it first if this application has not done so yet.

    Many rollups read the same usage events; parsing each body once and keeping the result in the
    shared folder cuts the lineage, survives lost executors and gives later scans column pruning.
    """
    key = (spark.sparkContext.applicationId, name)
    if key not in _written:
        path = new_place(spark, name)
        table = build()
        if write is None:
            table.write.parquet(path)
        else:
            write(table, path)
        _written[key] = path
    return spark.read.parquet(_written[key])


def written_path(spark: SparkSession, name: str) -> str:
    """Where ``written_once`` put a table."""
    return _written[(spark.sparkContext.applicationId, name)]


def forget(spark: SparkSession, *names: str) -> None:
    """Let the tables whose name begins so be computed anew when next asked for."""
    app = spark.sparkContext.applicationId
    for key in [k for k in _written if k[0] == app and k[1].startswith(names)]:
        del _written[key]


def append_events(events: DataFrame, path: str, run: str | None = None) -> None:
    """Append usage events, one folder per day. The rebalance gives files of even size: it splits
    a heavy day over several tasks and merges light ones.

    A named ``run`` (a batch id, say) has a folder of its own inside each day, which writing it again
    replaces: a job that is retried adds nothing twice. A table takes runs always or never."""
    even = events.hint("rebalance", "event_date")
    if run is None:
        even.write.mode("append").partitionBy("event_date").parquet(path)
        return
    writer = even.withColumn("run", F.lit(run)).write.mode("overwrite")
    writer.option("partitionOverwriteMode", "dynamic").partitionBy("event_date", "run").parquet(path)


def clear_events(events: DataFrame, path: str) -> None:
    """Empty the table at ``path``; its day layout stays. ``events`` only gives the columns."""
    none = events.sparkSession.createDataFrame([], events.schema)
    none.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("event_date").parquet(path)


def replace_groups(old: DataFrame, new: DataFrame, processed: DataFrame) -> DataFrame:
    """Next snapshot: new rows for the processed groups, old rows for all the others."""
    groups = processed.select("index_group").distinct()
    return old.join(groups, "index_group", "left_anti").unionByName(new.select(old.columns))


def write_snapshot(snapshot: DataFrame, folder: str) -> str:
    """Write a snapshot to a new place below ``folder`` and return it: the old one stays readable
    until the caller switches over."""
    path = f"{folder.rstrip('/')}/snapshot-{uuid.uuid4().hex}"
    snapshot.write.parquet(path)
    return path


def newest(events: DataFrame, n: int = 20, index_group: str | None = None) -> DataFrame:
    """The ``n`` newest events."""
    chosen = events if index_group is None else events.filter(F.col("index_group") == index_group)
    return chosen.orderBy(F.desc("timestamp"), F.desc("request_id")).limit(n)
