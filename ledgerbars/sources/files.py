"""File sources and sinks: bars by interval and day, log lines as JSON, exchange files as CSV with quarantine."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StringType, StructType

from ..operators.scale import shared_folder
from .tables import load


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the one that the cluster shares."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def write_bars(bars: DataFrame, interval: str, path: str) -> None:
    """Bars partitioned by interval and day: one file a day and task at most, since rows of a day are brought together first."""
    bars.withColumns({"interval": F.lit(interval), "dt": F.to_date("bar_start")}).repartition("interval", "dt").write.mode("append").partitionBy("interval", "dt").parquet(path)


def read_bars(spark: SparkSession, path: str, interval: str, first: str, last: str) -> DataFrame:
    """A range of days; the partitions outside are not listed."""
    return spark.read.parquet(path).filter((F.col("interval") == interval) & F.col("dt").between(F.lit(first).cast("date"), F.lit(last).cast("date")))


def append_json(df: DataFrame, path: str, day: str) -> None:
    df.write.mode("append").partitionBy(day).json(path)


def read_csv(spark: SparkSession, path: str, schema: StructType) -> tuple[DataFrame, DataFrame]:
    """(rows, quarantine): a line with a value that does not fit its type keeps its strings and goes to the second.

    Values are read as strings and cast here: a reader's own check would not see the columns that a
    query does not use.
    """
    raw = spark.read.schema(StructType([StructField(f.name, StringType()) for f in schema.fields])).option("header", True).csv(path)
    unfit = reduce(lambda x, y: x | y, (F.col(f.name).isNotNull() & F.col(f.name).try_cast(f.dataType).isNull() for f in schema.fields))
    return raw.filter(~unfit).select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields)), raw.filter(unfit)


def append_audit(df: DataFrame, path: str) -> None:
    """Audit rows (name, diff, actor, at): appended, never changed."""
    df.select("name", "diff", "actor", "at").write.mode("append").parquet(path)


__all__ = ["append_audit", "append_json", "load", "read_bars", "read_csv", "scratch", "write_bars"]
