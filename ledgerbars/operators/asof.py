"""As-of join: a union and one window pass; no range join, no row fan-out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def asof_join(left: DataFrame, right: DataFrame, keys: Sequence[str], ts: str, values: Sequence[str], prefix: str = "r_", strict: bool = False) -> DataFrame:
    """For each left row the ``values`` (and ``ts``) of the last right row of its keys at or before it; before it if ``strict``.

    One shuffle on the keys. Where times tie, right rows sort first unless ``strict``; among right rows of
    one time the greatest values count. A key that is much larger than the others should be given a
    second key of time buckets by the caller.
    """
    side = F.lit(1 if strict else 0)
    names = left.columns
    packed = F.struct(F.col(ts), *(F.col(v) for v in values))
    r = right.select(*keys, ts, packed.alias("_right"), F.lit(None).cast(left.select(F.struct("*").alias("s")).schema["s"].dataType).alias("_left"), side.alias("_side"))
    both = left.select(*keys, ts, F.lit(None).cast(r.schema["_right"].dataType).alias("_right"), F.struct(*names).alias("_left"), (1 - side).alias("_side")).unionByName(r)
    w = Window.partitionBy(*keys).orderBy(ts, "_side", F.col("_right").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_last", F.last("_right", ignorenulls=True).over(w)).filter("_left is not null")
    return found.select("_left.*", *(F.col(f"_last.{v}").alias(prefix + v) for v in [ts, *values]))
