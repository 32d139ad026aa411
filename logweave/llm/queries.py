"""Registered queries of the training-data operators over the driver tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .bpe_tree import code_digest, decode_ids, encode_texts
from .conversation_repair import damage, repair_digest
from .embedding_dedup import near_duplicate_vectors
from .language_id import identify_languages
from .line_frequency import line_frequency
from .minhash_dedup import near_duplicates
from .packing import pack_documents
from .periodic_runs import periodic_runs, plant_periods, run_digest
from .quality_qda import quality_scores
from .secret_scan import secret_spans, span_digest
from .surrogates import replace_entities
from .token_output import token_files
from .tokenizer_ids import read_spec
from .unigram import encode, read_model

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: The key of the registered query; real runs pass a secret of their own.
SURROGATE_KEY = b"registered query"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_rotation_codes(spark, sf_dir):
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"), threshold=0.93)


@query
def op2_token_planes(spark, sf_dir):
    spec = read_spec(public_tokenizers.path("byte_bpe_50k.json"))
    return token_files(table(spark, sf_dir, "documents"), spec, end_id=0)


@query
def op3_line_frequency(spark, sf_dir):
    return line_frequency(table(spark, sf_dir, "documents")).drop("frequent")


@query
def op4_surrogates(spark, sf_dir):
    return replace_entities(table(spark, sf_dir, "documents"), key=SURROGATE_KEY)


@query
def op5_quadratic_discriminant(spark, sf_dir):
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op6_window_entropy(spark, sf_dir):
    return span_digest(secret_spans(table(spark, sf_dir, "documents")))


@query
def op7_residual_packing(spark, sf_dir):
    spec = read_spec(public_tokenizers.path("word_bpe_49k.json"))
    return pack_documents(table(spark, sf_dir, "documents"), spec, end_id=1)


@query
def op8_language_id(spark, sf_dir):
    return identify_languages(table(spark, sf_dir, "documents"))


@query
def op9_unigram_pieces(spark, sf_dir):
    proto = read_model(public_tokenizers.path("piece_bpe_32k.model"))
    return encode(table(spark, sf_dir, "documents"), proto, keep_ids=False)


@query
def op10_minhash_index(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"), shingle_words=4, percent=80)


@query
def op11_bpe_tree(spark, sf_dir):
    spec = read_spec(public_tokenizers.path("byte_bpe_50k.json"))
    return code_digest(decode_ids(encode_texts(table(spark, sf_dir, "documents"), spec), spec))


@query
def op12_periodic_runs(spark, sf_dir):
    return run_digest(periodic_runs(plant_periods(table(spark, sf_dir, "documents"))))


@query
def op13_conversation_repair(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    return repair_digest(rows, damage(rows))
