"""The registered queries of the operators: production parameters, whole tables, digest columns."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seekledger.llm import language_id, line_dedup, lm_scoring, mixing, ngram_join, quality_classifier, quality_rules, sentencepiece_codec, source_divergence
from seekledger.llm import spelling_variants, substring_dedup, topk_search, warc
from seekledger.llm.native import word_count
from seekledger.llm.scratch import new_path, written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Labelled rows that the rules of query 1 are learned from, at most about so many.
RULE_ROWS = 200_000


def learned_rules(spark: SparkSession, sf_dir: str, statistics: DataFrame) -> quality_rules.DecisionList:
    labels = table(spark, sf_dir, "labels").filter("quality IS NOT NULL").select("doc_id", "quality")
    sample = written(quality_rules.bounded_sample(statistics.join(labels, "doc_id"), RULE_ROWS), "rule_rows")
    return quality_rules.learn(sample)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    statistics = written(quality_rules.text_statistics(docs), "statistics")
    rules = learned_rules(spark, sf_dir, statistics)
    failed = quality_rules.base_failed()
    return statistics.select(
        "doc_id", *quality_rules.BASE, failed.alias("base_failed"), (~failed & rules.keep()).alias("kept")
    )


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    html = F.encode("html", "UTF-8").alias("payload")
    payloads = pages.select(F.col("page_id").alias("id"), "url", html, warc.file_rows().alias("row"))
    path = new_path(spark, "archives")
    warc.write_archives(warc.mark_revisits(payloads), path)
    read = warc.resolve(warc.read_measured(spark, path))
    return read.select(
        F.col("page_id").try_cast("long").alias("page_id"),
        "payload_bytes",
        F.col("digest").alias("payload_digest"),
        "record_type",
        F.when(F.col("record_type") == "revisit", F.col("refers_page").try_cast("long")).alias("refers_to"),
    )


OP2_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, '')) AS n FROM pages
), c AS (SELECT h, max(page_id) AS chosen FROM p WHERE n >= 1000 GROUP BY h)
SELECT page_id, n::BIGINT AS payload_bytes, sha1(p.h) AS payload_digest,
  CASE WHEN chosen <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN chosen <> page_id THEN chosen END AS refers_to
FROM p LEFT JOIN c ON p.h = c.h AND n >= 1000
"""


def op3_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").filter(topk_search.usable())
    scaled = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256).cast("long"))
    vectors = rows.select(F.col("vec_id").alias("id"), scaled.alias("vector"))
    return topk_search.top_k(vectors, vectors.filter(F.col("id") % 50 == 0), 5)


OP3_SQL = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])), 0)::BIGINT AS score
  FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup.repeats(docs, 35).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256")
    )


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), 3, 90)


def with_quality(docs: DataFrame, size: str = "size", quality: str = "quality") -> DataFrame:
    """+ size in words and the weight by which a document is drawn: its share of plain characters."""
    text = F.coalesce(F.col("text"), F.lit(""))
    plain = F.length(F.regexp_replace(text, r"[#*$%&|<>!?0-9]+", ""))
    share = plain / F.greatest(F.length(text), F.lit(1))
    return docs.select("*", word_count(F.col("text")).alias(size), share.alias(quality))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_quality(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).drop("text")
    mixed = mixing.mix(written(docs, "mix_docs"))
    return mixed.select("doc_id", "size", "source_size", F.col("target").cast("double"), "taken")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_copies", "n_near", F.sha2("kept_text", 256).alias("kept_sha256"))


#: Vocabulary file of a public tokenizer; read on the driver only.
PIECES = "/opt/tokenizers/piece_bpe_32k.model"


def op8_sentencepiece(spark: SparkSession, sf_dir: str, model_path: str = PIECES) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = sentencepiece_codec.round_trip(docs, sentencepiece_codec.Model.load(model_path))
    return coded.select(
        "doc_id", "n_ids", F.sha2("packed", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("text_sha256")
    )


#: Labelled documents that the classifier is fitted on, at most about so many.
CLASSIFIER_ROWS = 12_000


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    remainder = F.crc32(F.col("doc_id").cast("string")) % 3
    held_out = F.coalesce(remainder == 1, F.lit(False))
    labels = table(spark, sf_dir, "labels").filter(F.col("quality").isin(0, 1) & (remainder != 1))
    sample = quality_rules.bounded_sample(labels.select("doc_id", "quality"), CLASSIFIER_ROWS)
    # the sample is bounded by its parameter, so it may be sent to every task
    model = quality_classifier.train(docs.join(F.broadcast(sample), "doc_id"), CLASSIFIER_ROWS)
    found = quality_classifier.score(docs.select("doc_id", "text", held_out.alias("held_out")), model, carry=("doc_id", "held_out"))
    return found.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


#: Documents whose lines train the language model, at most about so many.
LANGUAGE_DOCS = 6_000


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(language_id.remainder(F.col("doc_id"), 5) == 0, F.lit(False))
    lines = language_id.training_lines(docs.filter(~held_out), LANGUAGE_DOCS)
    model = language_id.train(sorted((r.line, r.lang) for r in lines.collect()))
    found = language_id.predict(docs.select("doc_id", "text", held_out.alias("held_out")), model, carry=("doc_id", "held_out"))
    return found.select("doc_id", "held_out", "lang_pred", "score")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spelling_variants.word_counts(table(spark, sf_dir, "documents"))
    found = spelling_variants.group_variants(words)
    return found.select("word", "form", "root", "n", "n_near", "form_n")


def op12_lm_scoring(spark: SparkSession, sf_dir: str, model_path: str = PIECES) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lm_scoring.score_texts(docs, sentencepiece_codec.Model.load(model_path), learn=True)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.audit(table(spark, sf_dir, "documents").select("text", "lang", "source"))


OP13_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents
), t AS (
  SELECT r, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d
), k AS (SELECT lang, term, count(*) AS all_n FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY lang, source, term),
gn AS (SELECT g.lang, g.source, coalesce(sum(n), 0)::HUGEINT AS total FROM g LEFT JOIN c ON g.lang = c.lang AND g.source = c.source GROUP BY g.lang, g.source),
lv AS (SELECT lang, count(*)::HUGEINT AS v, sum(all_n)::HUGEINT AS total FROM k GROUP BY lang),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (gn.total + 2 * lv.v) AS p,
    1 + (1000000000::HUGEINT * (k.all_n + 2)) // (lv.total + 2 * lv.v) AS q
  FROM g JOIN k ON g.lang = k.lang JOIN lv ON lv.lang = g.lang JOIN gn ON gn.lang = g.lang AND gn.source = g.source
    LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), s AS (
  SELECT x.lang, x.source, y.source AS item, sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)) AS value
  FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
), terms AS (
  SELECT lang, source, 'term' AS part, term AS item, (((p - q) * (p - q)) // (p + q))::BIGINT AS value FROM p WHERE n > 0 AND p > q
), r AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
)
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 10
"""


class Query(NamedTuple):
    run: object
    sql: str | None = None


QUERIES = {
    "op1_quality_rules": Query(op1_quality_rules),
    "op2_warc": Query(op2_warc, OP2_SQL),
    "op3_topk_search": Query(op3_topk_search, OP3_SQL),
    "op4_substring_dedup": Query(op4_substring_dedup),
    "op5_ngram_join": Query(op5_ngram_join),
    "op6_mixing": Query(op6_mixing),
    "op7_quality_classifier": Query(op7_quality_classifier),
    "op8_sentencepiece": Query(op8_sentencepiece),
    "op9_line_dedup": Query(op9_line_dedup),
    "op10_language_id": Query(op10_language_id),
    "op11_spelling_variants": Query(op11_spelling_variants),
    "op12_lm_scoring": Query(op12_lm_scoring),
    "op13_source_divergence": Query(op13_source_divergence, OP13_SQL),
}
