"""Usage per hour, kept day by day, so that a window that moves on reads new days only.

A partial holds what can be merged: counts are added, last uses compared. A day is counted when its events
change (``EventTable`` numbers the appends each day has seen) and forgotten with it; compaction changes
nothing. A window is the sum of its whole hours and of the events of the one hour in which it begins,
so it equals the count over all its events.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seekledger.operators.event_table import DAY, EventTable
from seekledger.operators.versions import Versions
from seekledger.plans import architecture as A
from seekledger.plans import mapping as M
from seekledger.plans.usage import field_references
from seekledger.schemas import FIELD_CATEGORIES

HOUR = "hour"


class Partials:
    """``count`` turns events, which have ``hour``, into rows of the hour, the keys and the measures."""

    def __init__(self, events: EventTable, folder: str, count: Callable[[DataFrame], DataFrame], keys: list[str], merge: dict[str, Callable[[str], Column]]):
        self.events, self.folder, self.count, self.keys, self.merge = events, folder.rstrip("/"), count, keys, merge
        self.spark = events.spark
        self.versions = Versions(self.spark, folder)

    def _hours(self, events: DataFrame) -> DataFrame:
        return self.count(events.withColumn(HOUR, F.date_trunc("hour", "timestamp")))

    def update(self) -> list[str]:
        """Count the days whose events have changed; returns them."""
        live = self.events.days()
        known = self.versions.newest()[1].get("days", {})
        changed = sorted(d for d, x in live.items() if known.get(d, {}).get("revision") != x["revision"])
        gone = known.keys() - live.keys()
        if not changed and not gone:
            return []
        paths: dict[str, str | None] = dict.fromkeys(changed)
        if changed:
            place = f"data/{uuid.uuid4().hex}"
            # what is appended after ``live`` was read may be in, too: the day is then counted again next time
            rows = self._hours(self.events.read(only=changed)).withColumn(DAY, F.to_date(HOUR))
            rows.hint("rebalance", DAY).write.partitionBy(DAY).parquet(f"{self.folder}/{place}")
            paths |= {f.split("=", 1)[1]: f"{place}/{f}" for f in self.versions.subfolders(place) if f.startswith(DAY + "=")}

        def change(state: dict) -> dict:
            days = {d: x for d, x in state.get("days", {}).items() if d not in gone}
            days |= {d: {"revision": live[d]["revision"], "path": paths.get(d)} for d in changed}
            return {**state, "days": days}

        self.versions.change(change)
        return changed

    def window(self, start: datetime) -> DataFrame:
        """Keys and merged measures of all events from ``start`` on, as of the last update."""
        first = start.replace(minute=0, second=0, microsecond=0)
        first = first if first == start else first + timedelta(hours=1)
        days = self.versions.newest()[1].get("days", {})
        paths = [f"{self.folder}/{x['path']}" for d, x in days.items() if d >= start.date().isoformat() and x["path"]]
        early = (F.col("timestamp") >= F.lit(start)) & (F.col("timestamp") < F.lit(first))
        rows = self._hours(self.events.read(only=[start.date().isoformat()]).filter(early))
        if paths:
            rows = rows.unionByName(self.spark.read.schema(rows.schema).parquet(*sorted(paths)).filter(F.col(HOUR) >= F.lit(first)))
        return rows.groupBy(*self.keys).agg(*[f(c).alias(c) for c, f in self.merge.items()])


def field_partials(events: EventTable, folder: str) -> Partials:
    """Its windows equal ``mapping.field_usage``."""

    def count(rows: DataFrame) -> DataFrame:
        refs = field_references(rows.select("index_group", "timestamp", "fields"))
        hour = F.date_trunc("hour", "timestamp").alias(HOUR)
        return refs.groupBy(hour, "index_group", F.col("field").alias("field_name")).agg(*M.usage_measures())

    merge = {f"count_{c}": F.sum for c in FIELD_CATEGORIES} | {f"last_seen_{c}": F.max for c in FIELD_CATEGORIES}
    return Partials(events, folder, count, ["index_group", "field_name"], merge)


def stats_partials(events: EventTable, folder: str, include_doc_write: bool = False) -> Partials:
    """Its windows are the cells of ``architecture.stats_of_cells``."""
    keys = A.CELL_KEYS
    return Partials(events, folder, lambda rows: A.usage_cells(rows, include_doc_write, [HOUR]), keys, {A.CELL_ROWS: F.sum})
