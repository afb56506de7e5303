"""The batch pipeline on a stream: requests in, usage events out, counts per time bucket."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from contextlib import contextmanager
from types import MappingProxyType

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from seekledger.operators.event_table import EventTable
from seekledger.operators.keyed_table import KeyedTable
from seekledger.operators.tables import append_events, kept_at
from seekledger.plans.events import EventSettings, build_usage_events
from seekledger.schemas import REQUEST_LOG

FLUSH_INTERVAL = "60 seconds"
REPEAT_WINDOW = "10 minutes"
#: Folders of a day beyond which a batch is followed by a compaction.
COMPACT_AT = 32
_STORE = "spark.sql.streaming.stateStore.providerClass"
_PARTITIONS = "spark.sql.shuffle.partitions"
_DISK_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Counting the keys of the state, a metric only, takes one more look-up for each row. A batch commits its changes
#: of the state only; whole states are written now and then, behind the batches.
_INGEST_SETTINGS = {
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


@contextmanager
def _state_on_disk(spark: SparkSession, settings: Mapping[str, str] = MappingProxyType({})) -> Iterator[None]:
    """State of queries started inside is kept by RocksDB, so that it may outgrow an executor's memory, and
    ``settings`` hold for them; a store or a setting that the session names itself stays."""
    before = spark.conf.get(_STORE)
    if before.endswith(".HDFSBackedStateStoreProvider"):
        spark.conf.set(_STORE, _DISK_STORE)
    own = [name for name in settings if spark.conf.get(name, None) is None]
    for name in own:
        spark.conf.set(name, settings[name])
    try:
        yield
    finally:
        spark.conf.set(_STORE, before)
        for name in own:
            spark.conf.unset(name)


@contextmanager
def _shuffled_to(spark: SparkSession, partitions: int | None) -> Iterator[None]:
    """Queries started inside have so many partitions."""
    if partitions is None:
        yield
        return
    before = spark.conf.get(_PARTITIONS)
    spark.conf.set(_PARTITIONS, partitions)
    try:
        yield
    finally:
        spark.conf.set(_PARTITIONS, before)


def few_partitions(spark: SparkSession) -> int:
    """State partitions for small batches: no more than tasks run at a time, and a prime, so that a log whose files were
    dealt out by the same hash of the ids as the state is still spreads over them."""
    most = min(spark.sparkContext.defaultParallelism, int(spark.conf.get(_PARTITIONS)))
    return next((n for n in range(most, 1, -1) if all(n % k for k in range(2, n))), 1)


def request_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Request files as they arrive. ``max_files`` limits a micro-batch; nothing is ever dropped,
    files beyond the limit wait for the next batch."""
    reader = spark.readStream.schema(REQUEST_LOG)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def once_per_request(requests: DataFrame, window: str = REPEAT_WINDOW) -> DataFrame:
    """Drop redelivered requests; the state holds ids no longer than the window."""
    return requests.withWatermark("ts", window).dropDuplicatesWithinWatermark(["request_id"])


def start_ingest(
    requests: DataFrame,
    group_map: DataFrame | Callable[[], DataFrame],
    sink: str | EventTable,
    checkpoint: str,
    settings: EventSettings = EventSettings(),
    interval: str | None = FLUSH_INTERVAL,
    window: str = REPEAT_WINDOW,
    name: str = "ingest",
    compact_at: int = COMPACT_AT,
    once: bool = False,
    small: bool = False,
) -> StreamingQuery:
    """Append usage events to ``sink``. Without an interval the stream handles what is there and
    stops, keeping its place in the checkpoint.

    Requests redelivered within ``window`` count once. Each batch is rebalanced and written as a run of
    its own. In an ``EventTable`` it appears as a whole, a batch that ``name`` has committed is skipped, and a
    day of more than ``compact_at`` runs is compacted; in a plain folder a repeated batch replaces its run.
    ``group_map`` may be a function that reads the map: it is called for every batch, so an index that joins
    a group counts for it from then on. With a table the events are a part of the stream, and their
    expressions are built once, not again for every batch.

    ``once`` is for large batches, a backlog say: the batch's requests are written beside the checkpoint, in place of
    those of the batch before, and each different body of the batch is parsed once. That takes some jobs more a
    batch, so small batches do better without."""
    spark, staged = requests.sparkSession, f"{checkpoint}-requests"
    few = few_partitions(spark) if small else None

    def described_once(batch: DataFrame) -> DataFrame:
        # read by the caller's session: a stream's own plans without adaptive execution, which evens out the files
        rows = kept_at(batch, f"{staged}/rows", spark)
        groups = group_map() if callable(group_map) else group_map
        if rows.isEmpty():  # a batch that only moves the watermark
            return build_usage_events(rows, groups, settings)
        return build_usage_events(rows, groups, settings, once=True, place=f"{staged}/bodies")

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        if once:
            events = described_once(batch)
        else:
            events = build_usage_events(batch, group_map(), settings) if callable(group_map) else batch
            if few is not None:
                events = events.repartition(few, "event_date")
        if isinstance(sink, EventTable):
            sink.append(events, stream=name, batch=batch_id)
            sink.compact(compact_at)
        else:
            append_events(events, sink, run=f"batch-{batch_id:012d}")

    rows = once_per_request(requests, window)
    if not once and not callable(group_map):
        rows = build_usage_events(rows, group_map, settings)
    writer = rows.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint)
    trigger = {"availableNow": True} if interval is None else {"processingTime": interval}
    with _state_on_disk(spark, _INGEST_SETTINGS), _shuffled_to(spark, few):
        return writer.trigger(**trigger).start()


def counts_over_time(
    events: DataFrame, width: str, key: str | None = None, lateness: str = "10 minutes"
) -> DataFrame:
    """Rows per time bucket (and key) on a stream; a bucket is final once the watermark passes it.
    In append mode only final buckets come out, in update mode all that changed (``start_counts``)."""
    keys = [F.window("timestamp", width).alias("w")] + ([F.col(key)] if key else [])
    counts = events.withWatermark("timestamp", lateness).groupBy(*keys).agg(F.count(F.lit(1)).alias("count"))
    return counts.select(F.col("w.start").alias("bucket"), *([key] if key else []), "count")


def _count_table(spark: SparkSession, sink: str, key: str | None) -> KeyedTable:
    """One row per bucket and key, in a part per day."""
    fields = [T.StructField("bucket", T.TimestampType()), *([T.StructField(key, T.StringType())] if key else [])]
    schema = T.StructType([*fields, T.StructField("count", T.LongType())])
    return KeyedTable(spark, sink, ["bucket", *([key] if key else [])], schema, F.to_date("bucket").cast("string"))


def start_counts(
    events: DataFrame, width: str, sink: str, checkpoint: str, key: str | None = None, lateness: str = "10 minutes"
) -> StreamingQuery:
    """Keep counts per time bucket (and key) in ``sink``, open buckets included. A batch replaces the rows of
    the buckets it has changed, which rewrites the days they lie in; what a reader opens is one folder a day,
    however many batches there were. Buckets behind the watermark leave the state."""
    counts = counts_over_time(events, width, key, lateness)
    table = _count_table(events.sparkSession, sink, key)

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        table.merge(batch.select(*([F.col(key).cast("string").alias(key)] if key else []), "bucket", "count"), stream="counts", batch=batch_id)

    writer = counts.writeStream.outputMode("update").foreachBatch(on_batch).option("checkpointLocation", checkpoint)
    with _state_on_disk(events.sparkSession):
        return writer.trigger(availableNow=True).start()


def latest_counts(spark: SparkSession, sink: str, key: str | None = None) -> DataFrame:
    """The newest count of each bucket (and key)."""
    return _count_table(spark, sink, key).read()


def start_refresh(
    events: DataFrame, checkpoint: str, refresh: Callable[[int], None], interval: str = "300 seconds"
) -> StreamingQuery:
    """Run ``refresh(batch_id)`` (diff, advice, findings) after each batch of new events, at most
    once per interval."""

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            refresh(batch_id)

    return (
        events.select("index_group")
        .writeStream.foreachBatch(on_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(processingTime=interval)
        .start()
    )
