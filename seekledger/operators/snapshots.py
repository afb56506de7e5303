"""Result tables that are replaced group by group, by several jobs at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from seekledger.operators.tables import replace_groups, write_snapshot
from seekledger.operators.versions import Conflict, Versions


class Snapshots:
    """Named tables of one folder; which snapshot of each is the current one is a state of ``Versions``."""

    def __init__(self, spark: SparkSession, folder: str, schemas: dict[str, StructType]):
        self.spark, self.folder, self.schemas = spark, folder.rstrip("/"), schemas
        self.versions = Versions(spark, folder)

    def _load(self, name: str, state: dict) -> DataFrame:
        path = state.get("tables", {}).get(name)
        if path is None:
            return self.spark.createDataFrame([], self.schemas[name])
        return self.spark.read.schema(self.schemas[name]).parquet(path)

    def read(self, name: str) -> DataFrame:
        return self._load(name, self.versions.newest()[1])

    def replace(self, name: str, new: DataFrame, processed: DataFrame) -> DataFrame:
        """Put ``new`` in place of all rows of the processed groups. If another job has switched to a snapshot
        of its own meanwhile, its rows of other groups are taken over before the next try."""
        staged = write_snapshot(new, f"{self.folder}/data/{name}-new")
        groups = write_snapshot(processed.select("index_group").distinct(), f"{self.folder}/data/{name}-groups")
        new, processed = self.spark.read.schema(self.schemas[name]).parquet(staged), self.spark.read.parquet(groups)
        while True:
            number, state = self.versions.newest()
            path = write_snapshot(replace_groups(self._load(name, state), new, processed), f"{self.folder}/data/{name}")
            try:
                self.versions.commit(number, {**state, "tables": {**state.get("tables", {}), name: path}})
                return self.spark.read.schema(self.schemas[name]).parquet(path)
            except Conflict:
                continue
