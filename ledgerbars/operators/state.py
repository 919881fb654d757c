"""State from append-only logs: latest per key, conditional columns, first per key, rank-limited moves."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """The values of the last row of each key; combines before the shuffle, unlike a window."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("_v")).select(*keys, *(f"_v.{v}" for v in values))


def first(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Insert if absent: the first row of each key stays."""
    return df.groupBy(*keys).agg(F.min_by(F.struct(*values), F.struct(*order)).alias("_v")).select(*keys, *(f"_v.{v}" for v in values))


def rank_of(column: Column, names: Sequence[str]) -> Column:
    """The place of a state in a ranking, null if it has none."""
    out = F.lit(None).cast("int")
    for i, n in enumerate(names):
        out = F.when(column == n, i).otherwise(out)
    return out


def named(rank: Column, names: Sequence[str]) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), rank + 1)


def before_in(df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, value: str, out: str) -> DataFrame:
    """Adds ``out``: ``value`` of the row before in the order of ``order`` within ``keys``. ``bucket`` never falls along that order, and
    a task sorts one bucket of a key only: a key that holds a third of all rows is many sorts. The last value of each bucket
    comes from a table with a row a key and bucket. Neither keys nor buckets are null."""
    at = F.struct(*order)
    d = df.withColumn("_b", bucket)
    ends = d.groupBy(*keys, "_b").agg(F.max_by(F.struct(F.col(value).alias("v")), at).alias("_end"))
    ends = ends.withColumn("_before", F.lag("_end").over(Window.partitionBy(*keys).orderBy("_b"))).drop("_end")
    nth = Window.partitionBy(*keys, "_b").orderBy(*order)
    d = d.withColumns({out: F.lag(value).over(nth), "_n": F.row_number().over(nth)})
    j = d.join(ends.hint("merge"), [*keys, "_b"])
    return j.withColumn(out, F.when(F.col("_n") == 1, F.col("_before.v")).otherwise(F.col(out))).drop("_b", "_n", "_before")


def number_in(df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, out: str) -> DataFrame:
    """Adds ``out``: the row's number from 1 within ``keys`` by ``order``, in sorts of one ``bucket`` of a key each, as in ``before_in``."""
    d = df.withColumn("_b", bucket)
    counts = d.groupBy(*keys, "_b").agg(F.count("*").alias("_k"))
    upto = F.sum("_k").over(Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(*keys, "_b", F.coalesce(upto, F.lit(0)).alias("_off"))
    d = d.withColumn(out, F.row_number().over(Window.partitionBy(*keys, "_b").orderBy(*order)))
    return d.join(counts.hint("merge"), [*keys, "_b"]).withColumn(out, F.col(out) + F.col("_off")).drop("_b", "_off")
