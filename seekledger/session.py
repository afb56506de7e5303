"""Session settings for local runs; a cluster brings its own."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.driver.memory": "12g",
}


def local_session(
    cores: int | None = None, name: str = "seekledger", settings: dict[str, str] | None = None
) -> SparkSession:
    cores = cores or os.cpu_count() or 4
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name)
    for key, value in (SETTINGS | (settings or {})).items():
        builder = builder.config(key, value)
    spark = builder.config("spark.sql.shuffle.partitions", str(cores)).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
