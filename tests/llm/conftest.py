from __future__ import annotations

import random

import pytest
from pyspark.sql import SparkSession

from text_samples import sample_documents


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from seekledger.session import SETTINGS

    builder = SparkSession.builder.master("local[4]").appName("tests")
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    builder = builder.config("spark.sql.shuffle.partitions", "4")
    builder = builder.config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
    session = builder.config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse"))).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def documents():
    return sample_documents()


@pytest.fixture(scope="session")
def sf_dir(spark, documents, tmp_path_factory):
    """A folder of tables with an extra, clashing column each."""
    folder = str(tmp_path_factory.mktemp("tables"))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(documents, schema)
    docs.selectExpr("*", "'x' AS block", "1 AS size", "2.5 AS target").repartition(3).write.parquet(f"{folder}/documents.parquet")
    junk = lambda t: bool(t) and ("!!" in t or "***" in t or (t.count("\n") > 5 and len(set(t.split("\n"))) == 1))
    labels = [(d, 0 if junk(t) else 1, 0) for d, t, *_ in documents if t and len(t) > 40] + [(0, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    body = "<p>" + "é page " * 300 + "</p>"
    pages = [(k, f"http://h/{k}", h) for k, h in enumerate([body, "short", body, None, "", "short", body + "WARC/1.1\r\n\r\n", "x" * 70_000, body])]
    spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "'x' AS payload").write.parquet(f"{folder}/pages.parquet")
    r = random.Random(9)
    vectors = [(k, [r.gauss(0, 1) for _ in range(12)], 1) for k in range(230)]
    vectors += [(230, None, 1), (250, [float("nan")] * 12, 1), (251, [1.0, None], 1), (300, vectors[7][1], 1), (301, vectors[7][1], 1), (350, [], 1)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").selectExpr("*", "0L AS id").write.parquet(f"{folder}/embeddings.parquet")
    return folder


@pytest.fixture(scope="session")
def empty_dir(spark, sf_dir, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("empty"))
    for name in ("documents", "labels", "pages", "embeddings"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").limit(0).write.parquet(f"{folder}/{name}.parquet")
    return folder
