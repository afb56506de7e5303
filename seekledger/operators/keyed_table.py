"""Stored tables with one row per key: changes rewrite only the parts that hold a changed key.

Rows lie in parts, by a hash of the key or by any expression over it (a day, say). A merge reads, joins and
writes the parts that the changes touch and swaps them in one commit; folders of all other parts stay as they
are. Two merges at once: the later one finds the number taken, and merges again into what the other left.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seekledger.operators.versions import Conflict, Versions

PART = "_part"
#: old and new value of a column -> the value that stays.
Combine = Callable[[Column, Column], Column]


def newest_wins(old: Column, new: Column) -> Column:
    return new


def known_wins(old: Column, new: Column) -> Column:
    """Partial rows: a null leaves the stored value."""
    return F.coalesce(new, old)


def hashed(keys: list[str], parts: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("string")


class KeyedTable:
    def __init__(self, spark: SparkSession, folder: str, keys: list[str], schema, part: Column | None = None, parts: int = 64):
        self.spark, self.folder, self.keys, self.schema = spark, folder.rstrip("/"), keys, schema
        self.part = hashed(keys, parts) if part is None else part
        self.versions = Versions(spark, folder)

    def parts(self) -> dict[str, str]:
        """part -> folder."""
        return self.versions.newest()[1].get("parts", {})

    def _load(self, paths: list[str]) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        places = [f"{self.folder}/{p}" for p in paths]
        return self.spark.read.schema(self.schema).parquet(*places)

    def read(self) -> DataFrame:
        return self._load(sorted(self.parts().values()))

    def _write(self, rows: DataFrame) -> dict[str, str]:
        place = f"data/{uuid.uuid4().hex}"
        rows.withColumn(PART, self.part).hint("rebalance", PART).write.partitionBy(PART).parquet(f"{self.folder}/{place}")
        folders = [f for f in self.versions.subfolders(place) if f.startswith(PART + "=")]
        # folder names hold the parts with special characters escaped
        return {unquote(f.split("=", 1)[1]): f"{place}/{f}" for f in folders}

    def _merged(self, old: DataFrame, changes: DataFrame, combine: Combine) -> DataFrame:
        names = [c for c in old.columns if c not in self.keys]
        side = lambda rows: rows.select(F.struct(*self.keys).alias("k"), F.struct(*names).alias("v"))
        stored, new = side(old).alias("old"), side(changes).alias("new")
        # null-safe, so that a key may be null
        both = stored.join(new, F.col("old.k").eqNullSafe(F.col("new.k")), "full")
        is_old, is_new = F.col("old.v").isNotNull(), F.col("new.v").isNotNull()
        values = [
            F.when(is_old & is_new, combine(F.col(f"old.v.{c}"), F.col(f"new.v.{c}")))
            .when(is_new, F.col(f"new.v.{c}"))
            .otherwise(F.col(f"old.v.{c}"))
            .alias(c)
            for c in names
        ]
        key = F.coalesce("old.k", "new.k")
        return both.select(*(key.getField(k).alias(k) for k in self.keys), *values).select(old.columns)

    def merge(self, changes: DataFrame, combine: Combine = newest_wins, stream: str | None = None, batch: int = 0) -> list[str]:
        """Insert rows of new keys and combine those of known ones; ``changes`` has one row a
        key. Returns the parts written. A stream's batch that is in already is skipped."""
        touched: list[str] | None = None
        while True:
            number, state = self.versions.newest()
            if stream is not None and batch <= state.get("streams", {}).get(stream, -1):
                return []
            known = state.get("parts", {})
            if touched is None:
                # as many as there are parts, at most
                touched = sorted(r[0] for r in changes.select(self.part.alias(PART)).distinct().collect())
            old = self._load([known[p] for p in touched if p in known])
            written = self._write(self._merged(old, changes.select(old.columns), combine))
            streams = {**state.get("streams", {}), **({} if stream is None else {stream: batch})}
            try:
                self.versions.commit(number, {**state, "parts": {**known, **written}, "streams": streams})
                return touched
            except Conflict:
                continue

    def remove_unused(self, older_than_hours: float = 24) -> list[str]:
        return self.versions.remove_unused(lambda state: set(state.get("parts", {}).values()), older_than_hours)
