"""The store as a service has it: parameterised reads, named read views, versioned snapshots, migrations, shared files."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .tables import load

TABLES = "region nation customer supplier part orders lineitem events".split()


def fetch_all(spark: SparkSession, sf: str, sql: str, args: Mapping[str, Any] | None = None) -> DataFrame:
    """The rows of a query with named parameters (``:name``) over ``{table}`` references; values are never put into the text."""
    return spark.sql(sql, args=dict(args or {}), **{t: load(spark, sf, t) for t in TABLES if "{" + t + "}" in sql})


def fetch_one(spark: SparkSession, sf: str, sql: str, args: Mapping[str, Any] | None = None) -> Row | None:
    """The first row, or None: one row reaches the driver."""
    return fetch_all(spark, sf, sql, args).limit(1).first()


def views(spark: SparkSession, sf: str, prefix: str = "view_") -> dict[str, DataFrame]:
    """The read views of a dashboard, registered as temporary views: names and columns that readers may rely on. Without rows they are empty."""
    o, li, c, e = (load(spark, sf, t) for t in ("orders", "lineitem", "customer", "events"))
    out = {
        "orders": o.select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("account"), F.col("o_orderstatus").alias("state"), F.col("o_totalprice").alias("price"), F.col("o_orderdate").alias("placed_at")),
        "positions": li.filter("l_linestatus = 'O'").groupBy(F.col("l_partkey").alias("symbol")).agg(F.sum(F.col("l_quantity").cast("decimal(18,4)")).cast("double").alias("quantity"), F.count("*").alias("fills")),
        "decisions": e.filter("event_type = 'click'").select(F.col("event_id").alias("decision_id"), F.col("user_id").alias("account"), F.col("ts").alias("at")),
        "verdicts": o.select(F.col("o_orderkey").alias("order_id"), (F.col("o_orderstatus") != "P").alias("approved")),
        "headroom": c.select(F.col("c_custkey").alias("account"), (F.lit(20000) - F.col("c_acctbal")).alias("headroom")),
        "budget": o.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count("*").alias("calls")),
        "learning": li.groupBy(F.col("l_returnflag").alias("strategy")).agg(F.count("*").alias("trades")),
    }
    for name, df in out.items():
        df.createOrReplaceTempView(prefix + name)
    return out


def hadoop(spark: SparkSession, path: str):
    """(file system, path) of Hadoop, for the few things that are no data: listing, moving, removing."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), p


def names_in(spark: SparkSession, folder: str) -> list[str]:
    fs, p = hadoop(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, visible as a whole or not at all: written beside its place and moved there."""
    fs, p = hadoop(spark, path)
    _, beside = hadoop(spark, f"{path}.{uuid.uuid4().hex}")
    out = fs.create(beside, True)
    out.write(bytearray(text.encode("utf-8")))
    out.close()
    fs.delete(p, False)
    if not fs.rename(beside, p):
        raise OSError(f"{path} was not written")


def read_text(spark: SparkSession, path: str) -> str | None:
    fs, p = hadoop(spark, path)
    if not fs.exists(p):
        return None
    return "".join(r[0] for r in spark.read.option("wholetext", True).text(path).collect())


def replace_snapshot(df: DataFrame, path: str) -> None:
    """Replace a snapshot, all or nothing: a new version is written whole, then one pointer moves. If the write fails, readers keep the old."""
    spark, version = df.sparkSession, f"v-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{version}")
    write_text(spark, f"{path}/CURRENT", version)


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{(read_text(spark, f'{path}/CURRENT') or '').strip()}")


def retain(spark: SparkSession, path: str, column: str, keep: int) -> list[str]:
    """Keep the newest ``keep`` partitions (``column=value`` folders) and remove the others; returns what is gone."""
    parts = [n for n in names_in(spark, path) if n.startswith(f"{column}=")]
    gone = parts[: max(0, len(parts) - keep)]
    for n in gone:
        fs, p = hadoop(spark, f"{path}/{n}")
        fs.delete(p, True)
    return gone


def pending(names: list[str], applied: set[str], reseed: bool = False) -> list[str]:
    """Files to apply, in order of name: those that are not applied, or all if asked to seed anew."""
    return [n for n in sorted(names) if n.endswith(".sql") and (reseed or n not in applied)]


def migrate(spark: SparkSession, folder: str, log: str, at: str, run: Callable[[str], Any], reseed: bool = False) -> list[str]:
    """Apply the folder's new files in order; each is logged with its time once all its statements have run. A file that fails is not
    logged, and ends the run."""
    applied = {r["name"] for r in spark.read.schema("name string, applied_at timestamp_ntz").parquet(log).collect()} if names_in(spark, log) else set()  # a row a file
    done = pending(names_in(spark, folder), applied, reseed)
    for name in done:
        for statement in (read_text(spark, f"{folder}/{name}") or "").split(";"):
            if statement.strip():
                run(statement.strip())
        spark.range(1).select(F.lit(name).alias("name"), F.lit(at).cast("timestamp_ntz").alias("applied_at")).write.mode("append").parquet(log)
    return done
