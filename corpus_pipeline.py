"""From raw documents to token ids: quality rules, line dedup, near-duplicate documents, mixing,
SentencePiece. Each stage is a function of (spark, docs, sf_dir); its result is written before the
next one starts, so a stage first removes what the one before it left in the shared folder.

Stages 1 to 4 return the columns of ``documents``. Stage 1 drops rejected documents; stage 2 removes
repeated lines and drops documents that lose all of their lines, sets ``n_chars`` anew and keeps blank
documents; stage 3 keeps one document of each group of near copies; stage 4 repeats or leaves out
documents so that sources meet their targets; stage 5 adds ``ids``, and its ``text`` is decoded from them.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seekledger.llm import blocks, line_dedup, mixing, ngram_join, quality_rules, scratch, sentencepiece_codec
from seekledger.llm.queries import PIECES, learned_rules, table, with_quality

SCOPE = "pipeline"
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _stage(f: Stage) -> Stage:
    @wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        scratch.release(spark, SCOPE)
        with scratch.scope(SCOPE):
            return f(spark, docs, sf_dir)

    return run_stage


@_stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = docs.withColumn("_row", F.struct(*docs.columns))
    statistics = scratch.written(quality_rules.text_statistics(rows, keys=("doc_id", "_row")), "statistics")
    rules = learned_rules(spark, sf_dir, statistics.drop("_row"))
    return statistics.filter(~quality_rules.base_failed() & rules.keep()).select("_row.*")


@_stage
def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(docs, carry=True)
    removed = F.col("n_copies") + F.col("n_near")
    kept = found.filter((removed == 0) | (removed < F.col("n_lines")))
    out = blocks.unpacked(kept.select("rest", F.col("kept_text").alias("text")), docs)
    return out.withColumn("n_chars", F.length("text").cast("long"))


@_stage
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.one_of_each(docs)


@_stage
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    sized = with_quality(docs, "_size", "_quality")
    taken = mixing.mix(sized.withColumn("_row", F.struct(*docs.columns)), "_size", "_quality").filter("times > 0")
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("times")))).select("_row.*")


@_stage
def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = sentencepiece_codec.Model.load(PIECES)
    columns = [c for c in docs.columns if c != "ids"]
    return sentencepiece_codec.coded_text(docs, model).select(*columns, "ids")


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("ngram_jaccard_join", near_copies),
    ("mixing", mixed),
    ("sentencepiece", token_ids),
]
#: Learned rules, edit distances and token ids have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.written(stage(spark, docs, sf_dir), f"pipeline_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
