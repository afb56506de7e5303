"""The stored usage events: runs that become visible as a whole, and compaction behind the readers' backs.

Each append writes folders of its own, one per day, and then commits them. A stream names itself and its
batch: what it has committed before is skipped, so a batch that is tried again counts once. A minute's
run leaves small files; ``compact`` writes a day's folders as one and swaps them in a single commit, while
readers go on with the folders they know. A day's ``revision`` counts the appends it has seen and is
left alone by compaction, so whatever was derived from a day stays valid until the day gets new rows.
"""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import DataFrame, SparkSession

from seekledger.operators.versions import Conflict, Versions
from seekledger.schemas import USAGE_EVENTS

DAY = "event_date"


class EventTable:
    def __init__(self, spark: SparkSession, folder: str, schema=USAGE_EVENTS):
        self.spark, self.folder, self.schema = spark, folder.rstrip("/"), schema
        self.versions = Versions(spark, folder)

    # --- reading

    def days(self) -> dict[str, dict]:
        """day -> revision and folders."""
        return self.versions.newest()[1].get("days", {})

    def paths(self, start: date | None = None, end: date | None = None, only: list[str] | None = None) -> list[str]:
        chosen = {
            d: x
            for d, x in self.days().items()
            if (start is None or d >= start.isoformat()) and (end is None or d <= end.isoformat()) and (only is None or d in only)
        }
        return [f"{self.folder}/{p}" for d in sorted(chosen) for p in chosen[d]["paths"]]

    def _load(self, paths: list[str]) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).option("basePath", f"{self.folder}/data").parquet(*paths).select(self.schema.names)

    def read(self, start: date | None = None, end: date | None = None, only: list[str] | None = None) -> DataFrame:
        """Events of the committed runs, of some days only if asked."""
        return self._load(self.paths(start, end, only))

    # --- writing

    def _write(self, events: DataFrame, name: str) -> dict[str, str]:
        """day -> the folder written for it."""
        place = f"data/run={name}-{uuid.uuid4().hex[:12]}"
        # even files: a heavy day is split over several tasks, light ones are merged
        events.hint("rebalance", DAY).write.partitionBy(DAY).parquet(f"{self.folder}/{place}")
        folders = [f for f in self.versions.subfolders(place) if f.startswith(DAY + "=")]
        return {f.split("=", 1)[1]: f"{place}/{f}" for f in folders}

    def committed(self, stream: str) -> int:
        """The last batch of a stream that is in the table; -1 if none is."""
        return self.versions.newest()[1].get("streams", {}).get(stream, -1)

    def append(self, events: DataFrame, stream: str | None = None, batch: int = 0) -> bool:
        """Add events; false if the batch was there already."""
        if stream is not None and batch <= self.committed(stream):
            return False
        written = self._write(events, stream or "append")
        added = True

        def change(state: dict) -> dict | None:
            nonlocal added
            streams, days = state.setdefault("streams", {}), state.setdefault("days", {})
            added = stream is None or batch > streams.get(stream, -1)
            if not added:
                return None
            if stream is not None:
                streams[stream] = batch
            # revisions never repeat, not even after the table was cleared
            state["appends"] = state.get("appends", 0) + 1
            for day, path in written.items():
                days[day] = {"revision": state["appends"], "paths": [*days.get(day, {}).get("paths", []), path]}
            return state

        self.versions.change(change)
        return added

    def clear(self) -> None:
        """No events; what streams have committed stays known."""
        self.versions.change(lambda state: {**state, "days": {}})

    def compact(self, most: int = 8) -> list[str]:
        """Write each day of more than ``most`` folders as one; returns those days. Folders appended in the
        meantime stay beside it. If the day's folders were taken away in the meantime, nothing is swapped."""
        days = {d: x["paths"] for d, x in self.days().items() if len(x["paths"]) > most}
        if not days:
            return []
        old = [f"{self.folder}/{p}" for paths in days.values() for p in paths]
        written = self._write(self._load(old), "compacted")

        def change(state: dict) -> dict:
            for day, paths in days.items():
                now = state.get("days", {}).get(day, {}).get("paths", [])
                if not set(paths) <= set(now):
                    raise Conflict(f"{day} was changed by another writer")
                state["days"][day]["paths"] = [*([written[day]] if day in written else []), *(p for p in now if p not in paths)]
            return state

        self.versions.change(change)
        return sorted(days)

    def remove_unused(self, older_than_hours: float = 24) -> list[str]:
        live = lambda state: {p for x in state.get("days", {}).values() for p in x["paths"]}
        return self.versions.remove_unused(live, older_than_hours)
