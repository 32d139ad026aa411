"""The corpus pipeline: each stage applies one operator to all that the stage before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.llm import language_id, quality_qda
from logweave.llm.minhash_dedup import drop_near_duplicates
from logweave.llm.packing import pack_documents
from logweave.llm.secret_scan import redact, secret_spans
from logweave.llm.tables import stored
from logweave.llm.tokenizer_ids import read_spec
from logweave.session import ship_package

#: SQL cannot express the models; the stages are tested against plain versions.
ORACLE_SQL = None


#: Documents whose best language is less probable are rejected, as are those below the quality score.
LEAST_LANGUAGE, LEAST_QUALITY = 0.4, 0.5


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a recognised language: no letters at all, or no language probable enough."""
    ship_package(spark)
    model = language_id.fit(language_id.training_rows(docs, "doc_id", "text", "lang", 4, 2))
    return language_id.keep_recognised(docs, model, LEAST_LANGUAGE)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the quality classifier scores below one half."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    _, model = quality_qda.learn(docs, labels, "doc_id", "text", "quality", 3, 1)
    return quality_qda.keep_good(docs, model, LEAST_QUALITY)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document (the smallest id) of each group of near duplicates: five-word shingles, 0.8."""
    return drop_near_duplicates(docs, shingle_words=5, percent=80)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace the secrets in each text by a marker; ``n_chars`` follows the new text."""
    columns = docs.columns
    return redact(secret_spans(docs)).withColumn("n_chars", F.length("text").cast("long")).select(*columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the documents into sequences of at most 4096 tokens."""
    return pack_documents(docs, read_spec(public_tokenizers.path("word_bpe_49k.json")), end_id=1)


STAGES = [("language ID", language_stage), ("quality classifier", quality_stage),
          ("MinHash near-dedup", near_duplicate_stage), ("secret scans", secret_stage),
          ("best-fit packing", packing_stage)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
