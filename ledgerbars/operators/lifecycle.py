"""Stages of a start and the time that a replay runs at."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The stages of a start, in order.
STAGES = ("reconcile", "square_off", "backfill", "warm_up", "resume")


def start(spark: SparkSession, hooks: Mapping[str, Callable[[], object]], stages: Sequence[str] = STAGES) -> DataFrame:
    """Run the stages in order: (place, stage, outcome, note). A stage without a hook is deferred; one that fails is noted and the start goes on."""
    rows = []
    for i, stage in enumerate(stages):
        if stage not in hooks:
            rows.append((i, stage, "deferred", None))
            continue
        try:
            made = hooks[stage]()
            rows.append((i, stage, "done", None if made is None else str(made)))
        except Exception as e:  # noqa: BLE001 - a hook may fail in any way
            rows.append((i, stage, "failed", type(e).__name__))
    return spark.createDataFrame(rows, "place int, stage string, outcome string, note string")


def as_of(spark: SparkSession, otherwise: Column) -> Column:
    """The time that a query runs at: ``spark.ledgerbars.asOf`` if a replay sets it, else what the data says. Never the clock of a machine."""
    at = spark.conf.get("spark.ledgerbars.asOf", "")
    return F.lit(at).cast("timestamp_ntz") if at else otherwise
