"""Loading the tables by role. Nothing is cached: column pruning and filters reach each scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def money(c: Column | str, scale: int = 4) -> Column:
    """A double read as exact money."""
    return (F.col(c) if isinstance(c, str) else c).cast(f"decimal(18,{scale})")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event stream as ticks: instrument, ts, price, qty, kind, id, day and minute of day."""
    e = load(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").alias("instrument"), "ts", F.col("value").alias("price"), F.get_json_object("props", "$.k").cast("long").alias("qty"),
        F.col("event_type").alias("kind"), F.col("event_id").alias("id"), F.to_date("ts").alias("day"), (F.hour("ts") * 60 + F.minute("ts")).alias("minute"),
    )


#: The same in DuckDB.
TICKS = """ticks AS (SELECT user_id AS instrument, ts, value AS price, CAST(json_extract_string(props, '$.k') AS BIGINT) AS qty, event_type AS kind,
 event_id AS id, CAST(ts AS DATE) AS day, hour(ts) * 60 + minute(ts) AS minute FROM events)"""
