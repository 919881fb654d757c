"""What large joins, sums and graphs share: cutting lineage, hot groups met by their one row, distributed prefix sums, connected components."""

from __future__ import annotations

import gc
import re
import tempfile
import time
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share. Only a session of one machine may do without the setting."""
    set_ = spark.conf.get("spark.checkpoint.dir", None)
    if set_:
        return set_
    master = spark.sparkContext.master
    if not re.fullmatch(r"local(\[[^\]]*\])?", master):
        raise ValueError(f"spark.checkpoint.dir is not set: executors of {master} would write where nobody else can read")
    return tempfile.mkdtemp(prefix="checkpoint-")


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the folder that all executors share."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def release(spark: SparkSession, pause: float = 0.3) -> None:
    """Let the context cleaner drop the shuffle files and checkpoints that nothing refers to any more. What ran last is held for a second or
    two more: ``pause`` is waited twice, before the second collection and after it."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(pause)


def same(a: DataFrame, b: DataFrame, names: Sequence[str]) -> Column:
    """Null-safe equality of the named columns of two frames; still an equi-join for the planner."""
    return reduce(lambda x, y: x & y, (a[n].eqNullSafe(b[n]) for n in names))


def buckets_for(rows: int, each: int = 100_000) -> int:
    """Into how many buckets so many rows go, so that a sort of one stays small at any size."""
    return max(1024, -(-rows // each))


def join_back(rows: DataFrame, groups: DataFrame, keys: Sequence[str], by: Sequence[str], size: str, total: int, parts: int = 256, how: str = "inner") -> DataFrame:
    """Join each row to the one row of its group; ``keys`` are not null. ``size`` of ``groups``: how many rows a group has.

    A group that holds more than a ``parts``-th of all ``total`` rows is split by a hash of ``by`` into tasks of about
    that size, and its one row is repeated for each. There are fewer than ``parts`` such groups, whose keys are broadcast.
    """
    many = F.ceil(F.col(size) * parts / max(1, total)).cast("int")
    hot = groups.filter(F.col(size) * parts > total).select(*keys, many.alias("_salts"))
    salted = rows.join(F.broadcast(hot), list(keys), "left").withColumn("_salt", F.pmod(F.xxhash64(*by), F.coalesce("_salts", F.lit(1))).cast("int")).drop("_salts")
    each = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.greatest(many, F.lit(1)) - 1)))
    return salted.join(each.hint("merge"), [*keys, "_salt"], how).drop("_salt")


def prefix_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str], weight: Column | None, out: str, buckets: int = 1024) -> DataFrame:
    """Add ``out``: the sum of ``weight`` (1 if None) over the rows before this one within ``keys``, which are not null.

    The order is by a hash bucket of ``order``, then by ``order`` itself. No task sees more than one
    bucket of one key, so a key that holds a third of all rows is spread over ``buckets`` sorts; the
    offsets come from a table of at most ``buckets`` rows a key. The join keeps the windows' partitioning; it
    is a merge join by hint, as the planner can't know how many rows an unfolded frame has.
    """
    weight = F.lit(1).cast("long") if weight is None else weight.cast("long")
    d = df.withColumns({"_pb": F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"), "_pw": weight})
    before = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    offsets = d.groupBy(*keys, "_pb").agg(F.sum("_pw").alias("_pt"))
    offsets = offsets.withColumn("_po", F.coalesce(F.sum("_pt").over(before(*keys).orderBy("_pb")), F.lit(0))).drop("_pt")
    local = d.withColumn("_pl", F.coalesce(F.sum("_pw").over(before(*keys, "_pb").orderBy(*order)), F.lit(0)))
    joined = local.join(offsets.hint("merge"), [*keys, "_pb"])
    return joined.select(*df.columns, (F.col("_pl") + F.col("_po")).alias(out))


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """``links`` (u, v long) -> (id, component): the smallest id that each linked id can reach.

    Alternating large-star and small-star joins; the edge list never leaves the cluster and the
    lineage is cut each round. Ids without a link do not appear. Null ends are ignored.
    """
    big, small = F.greatest("u", "v"), F.least("u", "v")
    e = cut(links.filter("u <> v").select(big.alias("u"), small.alias("v")).distinct())
    state = F.struct(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)))
    seen = e.select(state.alias("s")).first()["s"]
    for _ in range(rounds):
        if seen[0] == 0:
            break
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(moved.union(low.select("u", F.col("m").alias("v"))).distinct())
        now = e.select(state.alias("s")).first()["s"]
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    ends = e.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return ends.union(e.select(F.col("v").alias("id"), F.col("v").alias("component"))).groupBy("id").agg(F.min("component").alias("component"))
