"""The queries of this subpackage: each applies its operator, with production parameters, to a whole table."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import language_id, sentencepiece_codec
from .common import table
from .embedding_dedup import embedding_dedup
from .exact_dedup import OP5_SQL, exact_dedup
from .line_dedup import OP1_SQL, line_dedup
from .mixing import mix
from .sharding import balanced_shards
from .simhash import simhash_dedup
from .suffix_dedup import suffix_dedup
from .url_filters import reputation_sql, url_filter

#: The SentencePiece model; another path can be given by the environment.
MODEL = os.environ.get("SENTENCEPIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str, model: str = MODEL) -> DataFrame:
    out = sentencepiece_codec.encode_decode(table(spark, sf_dir, "documents"), sentencepiece_codec.load(model))
    return out.select("kept.doc_id", "n_tokens", "ids", "decoded")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = language_id.held_out(docs)
    model = language_id.train(docs.filter(~held))
    out = language_id.identify(docs.select("doc_id", "text", held.alias("held_out")), model, keep=("doc_id", "held_out"))
    return out.select("kept.doc_id", "kept.held_out", "lang_pred", "score")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balanced_shards(table(spark, sf_dir, "documents"))


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup(table(spark, sf_dir, "documents"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(table(spark, sf_dir, "embeddings"))


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_line_dedup, op2_sentencepiece, op3_language_id, op4_mixing, op5_exact_dedup, op6_suffix_dedup, op7_sharding, op8_simhash_dedup, op9_embedding_dedup, op10_url_filters)}


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": OP1_SQL, "op5_exact_dedup": OP5_SQL, "op10_url_filters": reputation_sql("pages")}
