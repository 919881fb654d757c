"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again.

Each stage works on all rows that its predecessor kept and, but for the last, returns the columns of
``documents``. Language ID learns from the labelled rows of its own input and drops texts that have no
language (``und``); exact dedup and SimHash dedup keep one document of each group; mixing takes words by
source towards the target weights, a row for each pass over a document; the last stage returns ids too.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ledgerbars.llm import exact_dedup, language_id, sentencepiece_codec, simhash
from ledgerbars.llm.common import shared_folder
from ledgerbars.llm.mixing import mixed_documents
from ledgerbars.llm.queries import MODEL


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows whose text has a language: null texts and texts without a letter go. Ids may be null or repeat."""
    model = language_id.train(docs.filter(~language_id.held_out(docs)))
    if not model:  # nothing is labelled: only texts without a letter can be rejected
        return docs.filter(docs["text"].rlike(r"\p{L}"))
    out = language_id.identify(docs, model, keep=tuple(docs.columns))
    return out.filter("lang_pred <> 'und'").select("kept.*")


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each text that differs beyond white space: the longest, then the smallest id, null last."""
    return exact_dedup.keep_one(docs)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each component of fingerprints at most 3 bits apart: the smallest id, null last."""
    return simhash.keep_one(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each pass that takes words of a document; a null source is one of its own; documents without words give none."""
    return mixed_documents(docs)


def sentencepiece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its ids and the text decoded from them; null texts have no ids."""
    out = sentencepiece_codec.encode_decode(docs, sentencepiece_codec.load(MODEL), keep=tuple(docs.columns))
    return out.select("kept.*", "n_tokens", "ids", "decoded")


STAGES = [("language_id", language_stage), ("exact_dedup", exact_stage), ("simhash_dedup", simhash_stage), ("mixing", mixing_stage), ("sentencepiece", sentencepiece_stage)]

#: The language model, the drawn mix and the merges can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written to the shared folder and read by the next."""
    shared = shared_folder(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    at = f"{shared}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        out.write.parquet(f"{at}/{k}-{name}")
        docs = spark.read.parquet(f"{at}/{k}-{name}")
    raise AssertionError("STAGES is empty")
