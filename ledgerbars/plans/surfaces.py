"""Sinks read back, and user functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.extensions import SLOTS, Slots, redacted
from ..registry import query
from ..sources.files import append_audit, append_json, read_bars, read_csv, scratch, write_bars
from ..sources.tables import TICKS, load
from .bars import BAR, bars_1h


@query(f"WITH {TICKS}, b AS (SELECT instrument, time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01') AS bar_start, {BAR} FROM ticks GROUP BY 1, 2) SELECT instrument, bar_start, open, high, low, close, volume FROM b WHERE bar_start >= TIMESTAMP '2024-01-10' AND bar_start < TIMESTAMP '2024-01-13'")
def bar_persistence(spark: SparkSession, sf: str) -> DataFrame:
    """Bars written by interval and day, and three days of them read back through partition pruning."""
    at = scratch(spark, "bars")
    write_bars(bars_1h(spark, sf), "1h", at)
    return read_bars(spark, at, "1h", "2024-01-10", "2024-01-12").select("instrument", "bar_start", "open", "high", "low", "close", "volume")


@query("SELECT CAST(ts AS DATE) AS day, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events GROUP BY 1")
def json_sink_by_day(spark: SparkSession, sf: str) -> DataFrame:
    at = scratch(spark, "log")
    append_json(load(spark, sf, "events").select(F.to_date("ts").alias("day"), "event_id", "event_type"), at, "day")
    return spark.read.schema("event_id long, event_type string, day date").json(at).groupBy("day").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query("SELECT count_if(p_partkey % 7 <> 0) AS n_rows, count_if(p_partkey % 7 = 0) AS n_quarantined FROM part")
def csv_quarantine(spark: SparkSession, sf: str) -> DataFrame:
    """An exchange file with bad sizes: the lines that do not fit are kept apart."""
    at = scratch(spark, "csv")
    size = F.when(F.col("p_partkey") % 7 == 0, "n/a").otherwise(F.col("p_size").cast("string"))
    load(spark, sf, "part").select("p_partkey", size.alias("p_size"), "p_name").write.option("header", True).csv(at)
    schema = load(spark, sf, "part").select("p_partkey", "p_size", "p_name").schema
    good, bad = read_csv(spark, at, schema)
    return good.agg(F.count("p_partkey").alias("n_rows")).join(bad.agg(F.count("p_partkey").alias("n_quarantined")))


@query("SELECT 'rule' || (o_orderkey % 3) AS name, count(*) AS n, max(o_orderdate) AS last_at FROM orders WHERE o_orderstatus = 'F' GROUP BY 1")
def audit_append(spark: SparkSession, sf: str) -> DataFrame:
    at = scratch(spark, "audit")
    o = load(spark, sf, "orders").filter("o_orderstatus = 'F'")
    row = o.select(F.concat(F.lit("rule"), F.col("o_orderkey") % 3).alias("name"), F.to_json(F.struct(F.col("o_totalprice").alias("new"))).alias("diff"), F.lit("owner").alias("actor"), F.col("o_orderdate").alias("at"))
    append_audit(row.filter("at < timestamp_ntz '1998-01-01'"), at)
    append_audit(row.filter("at >= timestamp_ntz '1998-01-01'"), at)
    return spark.read.schema("name string, diff string, actor string, at timestamp_ntz").parquet(at).groupBy("name").agg(F.count("*").alias("n"), F.max("at").alias("last_at"))


@query("SELECT c_custkey, '<' || length(c_name) || ' chars>' AS secret FROM customer")
def redacted_names(spark: SparkSession, sf: str) -> DataFrame:
    """A pandas UDF over Arrow batches."""
    return load(spark, sf, "customer").select("c_custkey", redacted(F.col("c_name")).alias("secret"))


@query("SELECT n_name AS job, m AS minute, printf('%02d:%02d', m // 60, m % 60) AS hhmm FROM nation, LATERAL (SELECT CAST(unnest(generate_series(CAST(540 + n_nationkey AS BIGINT), 599, 20)) AS INT) AS m)")
def job_slots(spark: SparkSession, sf: str) -> DataFrame:
    """A Python table function, once for each row by a lateral join."""
    slots = F.udtf(Slots, returnType=SLOTS)
    spark.udtf.register("job_slots_of", slots)
    return spark.sql("SELECT n_name AS job, minute, hhmm FROM {n}, LATERAL job_slots_of(540 + n_nationkey, 600, 20)", n=load(spark, sf, "nation"))


@query("WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) - 1 AS k FROM orders) SELECT o_custkey, round(sum((o_orderkey % 100) * pow(0.5, k)) / sum(pow(0.5, k)), 4) AS score FROM r GROUP BY 1")
def decayed_by_order(spark: SparkSession, sf: str) -> DataFrame:
    """An aggregate of one's own: the newest value weighs a half, each older one half as much."""

    def of(pdf: pd.DataFrame) -> pd.DataFrame:
        v = (pdf.sort_values("o_orderkey")["o_orderkey"] % 100).astype(float)
        return pd.DataFrame({"o_custkey": [pdf["o_custkey"].iloc[0]], "score": [round(float(v.ewm(alpha=0.5).mean().iloc[-1]), 4)]})

    return load(spark, sf, "orders").select("o_custkey", "o_orderkey").groupBy("o_custkey").applyInPandas(of, "o_custkey long, score double")


@query("SELECT event_type AS type, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids, CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS value, 0 AS n_skipped FROM events GROUP BY 1")
def frame_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Events as frames on the wire and back; frames that can't be decoded would be counted."""
    from ..sources.frames import decode_frames, encode_frames

    e = load(spark, sf, "events").select(F.col("user_id").cast("string").alias("source"), F.col("event_type").alias("type"), F.to_json(F.struct("event_id", "value")).alias("data"))
    d = decode_frames(encode_frames(e), "source", "frame")
    body = F.from_json("data", "event_id long, value double")
    g = d.withColumn("b", body).groupBy("type").agg(F.count("*").alias("n"), F.sum("b.event_id").alias("ids"), F.sum(F.col("b.value").cast("decimal(18,4)")).cast("double").alias("value"), F.count_if(~F.col("ok")).alias("n_skipped"))
    return g
