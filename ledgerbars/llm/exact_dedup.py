"""Exact dedup by skew-safe combining: local, salted, global; whole contents are compared each time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPACES, cut, join_back


def normalised(text: Column) -> Column:
    """The text without any of ``[\\x20\\x09-\\x0D]``; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), SPACES, "")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Grouping is by digest *and* whole normalised text. The first aggregation combines each task's rows
    before its shuffle (local dedup) and merges by digest, text and a salt of the task, so a group that
    holds a third of all rows arrives as at most one row per task spread over the salts; the second
    combines the salts' winners. Of a group, the row with the most code points in the original text
    stays, then the smallest doc_id; a null doc_id comes last.

    Digest collisions do not merge texts: where one digest has several texts, those rows alone are
    joined by whole text. Null texts and empty texts form one group. Of rows that repeat both the
    winner's id and its normalised text, exactly one is kept. An empty table gives no rows. Other
    columns of ``docs`` are not read and may have any name.
    """
    text = F.coalesce(docs[text_col], F.lit(""))
    d = docs.select(docs[id_col].cast("long").alias("doc_id"), F.length(text).alias("n"), normalised(docs[text_col]).alias("norm"))
    d = d.withColumn("digest", digest(F.col("norm")))
    # ~doc_id reverses the order without overflow; a null id is the smallest in a max().
    best = F.max(F.struct("n", F.bitwise_not("doc_id").alias("inv"))).alias("best")
    salted = d.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts))).groupBy("digest", "salt", "norm").agg(best, F.count("*").alias("size"))
    whole = salted.groupBy("digest", "norm").agg(F.max("best").alias("best"), F.sum("size").alias("size"))
    groups = whole.groupBy("digest").agg(
        F.count("*").alias("texts"), F.max(F.bitwise_not(F.col("best.inv"))).alias("keep_id"), F.max("best.n").alias("keep_n"), F.sum("size").alias("size")
    )
    groups = cut(groups)
    clash = groups.filter("texts > 1")
    left = d.select("doc_id", "n", "digest", F.sha2("norm", 256).alias("text_sha256"))
    total = groups.agg(F.sum("size")).first()[0] or 0
    out = join_back(left, groups.filter("texts = 1").drop("texts"), ["digest"], ["doc_id", "n"], "size", total)
    if not clash.isEmpty():
        bad = clash.select("digest")
        mine = d.join(bad, "digest", "left_semi")
        theirs = whole.join(bad, "digest", "left_semi").select("digest", "norm", F.bitwise_not(F.col("best.inv")).alias("keep_id"), F.col("best.n").alias("keep_n"), "size")
        out = out.unionByName(mine.join(theirs, ["digest", "norm"]).select("digest", "doc_id", "n", F.sha2("norm", 256).alias("text_sha256"), "keep_id", "keep_n", "size"))
    # Rows that repeat a doc_id: (sha, doc_id) is nearly unique, so no task gathers a hot group here.
    first = F.row_number().over(Window.partitionBy("text_sha256", "doc_id").orderBy(F.desc("n")))
    return out.withColumn("turn", first).select(
        "doc_id", "keep_id", F.col("size").alias("group_size"), (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("turn") == 1)).alias("kept"), "text_sha256"
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with their own columns; one row for each distinct text."""
    stay = exact_dedup(docs, id_col, text_col).filter("kept").select(F.col("doc_id").alias("_i"), F.col("text_sha256").alias("_s"))
    d = docs.select(F.struct("*").alias("_row"), docs[id_col].cast("long").alias("_id"), F.length(docs[text_col]).alias("_n"), F.sha2(normalised(docs[text_col]), 256).alias("_sha"))
    d = d.join(stay, d["_id"].eqNullSafe(stay["_i"]) & (d["_sha"] == stay["_s"]), "left_semi")
    turn = F.row_number().over(Window.partitionBy("_id", "_sha").orderBy(F.desc("_n")))
    return d.withColumn("_turn", turn).filter("_turn = 1").select("_row.*")


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER w = 1 AS kept,
       sha256(norm) AS text_sha256
FROM d WINDOW w AS (PARTITION BY norm ORDER BY n DESC, doc_id)
"""
