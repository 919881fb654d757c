"""Ticks to bars: tumbling, sliding and session windows, volumes, opening ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.calendar import CLOSE, OPEN, PRE_OPEN
from ..registry import query
from ..sources.tables import TICKS, ticks


def ohlc(df: DataFrame, *keys) -> DataFrame:
    """Open, high, low, close, volume and number of ticks; ties of time go by id."""
    at = F.struct("ts", "id")
    return df.groupBy(*keys).agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.sum("qty").alias("volume"), F.count("*").alias("n_ticks")
    )


BAR = "arg_min(price, (ts, id)) AS open, max(price) AS high, min(price) AS low, arg_max(price, (ts, id)) AS close, CAST(sum(qty) AS BIGINT) AS volume, count(*) AS n_ticks"


@query(f"WITH {TICKS} SELECT instrument, day, {BAR} FROM ticks GROUP BY instrument, day")
def daily_ohlc_bars(spark: SparkSession, sf: str) -> DataFrame:
    return ohlc(ticks(spark, sf), "instrument", "day")


@query(f"WITH {TICKS} SELECT instrument, time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01') AS bar_start, {BAR} FROM ticks GROUP BY 1, 2")
def bars_1h(spark: SparkSession, sf: str) -> DataFrame:
    return ohlc(ticks(spark, sf), "instrument", F.window("ts", "1 hour").start.alias("bar_start"))


@query(f"WITH {TICKS} SELECT instrument, time_bucket(INTERVAL 1 MINUTE, ts, TIMESTAMP '1970-01-01') AS bar_start, {BAR} FROM ticks WHERE minute >= 555 AND minute < 930 GROUP BY 1, 2")
def bars_1m_session(spark: SparkSession, sf: str) -> DataFrame:
    """Minute bars of the continuous session; pre-open and later ticks are left out before windowing."""
    return ohlc(ticks(spark, sf).filter((F.col("minute") >= OPEN) & (F.col("minute") < CLOSE)), "instrument", F.window("ts", "1 minute").start.alias("bar_start"))


@query(f"""WITH {TICKS} SELECT instrument, b.s AS bar_start, {BAR}
FROM ticks, LATERAL (SELECT time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01') - h * INTERVAL 1 HOUR AS s FROM (VALUES (0), (1)) v(h)) b GROUP BY 1, 2""")
def bars_sliding(spark: SparkSession, sf: str) -> DataFrame:
    return ohlc(ticks(spark, sf), "instrument", F.window("ts", "2 hours", "1 hour").start.alias("bar_start"))


@query(f"""WITH {TICKS}, g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM ticks WINDOW w AS (PARTITION BY instrument ORDER BY ts, id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY instrument ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT instrument, min(ts) AS session_start, max(ts) + INTERVAL 6 HOUR AS session_end, count(*) AS n_ticks FROM s GROUP BY instrument, k""")
def session_activity(spark: SparkSession, sf: str) -> DataFrame:
    w = F.session_window("ts", "6 hours")
    return ticks(spark, sf).groupBy("instrument", w.alias("w")).agg(F.count("*").alias("n_ticks")).select("instrument", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n_ticks")


def cumulative(df: DataFrame) -> DataFrame:
    """Ticks with the day's volume so far, as a feed reports it."""
    w = Window.partitionBy("instrument", "day").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("day_volume", F.sum("qty").over(w))


@query(f"""WITH {TICKS}, c AS (SELECT *, sum(qty) OVER (PARTITION BY instrument, day ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS v FROM ticks),
d AS (SELECT *, v - coalesce(lag(v) OVER (PARTITION BY instrument, day ORDER BY ts, id), 0) AS delta FROM c)
SELECT instrument, day, CAST(hour(ts) AS INT) AS hour, CAST(sum(delta) AS BIGINT) AS volume, CAST(max(v) AS BIGINT) AS day_volume FROM d GROUP BY 1, 2, 3""")
def cum_volume_delta(spark: SparkSession, sf: str) -> DataFrame:
    """Bar volume as the difference of cumulative day volume; the day's first tick counts whole."""
    w = Window.partitionBy("instrument", "day").orderBy("ts", "id")
    d = cumulative(ticks(spark, sf)).withColumn("delta", F.col("day_volume") - F.coalesce(F.lag("day_volume").over(w), F.lit(0)))
    return d.groupBy("instrument", "day", F.hour("ts").alias("hour")).agg(F.sum("delta").alias("volume"), F.max("day_volume").alias("day_volume"))


@query(f"""WITH {TICKS} SELECT day, CASE WHEN minute < 540 THEN 'before' WHEN minute < 555 THEN 'pre_open' WHEN minute < 930 THEN 'continuous' WHEN minute >= 940 AND minute < 960 THEN 'post_close' ELSE 'closed' END AS phase,
count(*) AS n_ticks, CAST(sum(qty) AS BIGINT) AS volume, arg_max(price, (ts, id)) AS last_price FROM ticks GROUP BY 1, 2""")
def session_phases(spark: SparkSession, sf: str) -> DataFrame:
    m = F.col("minute")
    phase = F.when(m < PRE_OPEN, "before").when(m < OPEN, "pre_open").when(m < CLOSE, "continuous").when((m >= 940) & (m < 960), "post_close").otherwise("closed")
    return ticks(spark, sf).groupBy("day", phase.alias("phase")).agg(F.count("*").alias("n_ticks"), F.sum("qty").alias("volume"), F.max_by("price", F.struct("ts", "id")).alias("last_price"))


@query(f"""WITH {TICKS} SELECT instrument, day, CAST(sum(CAST(price AS DECIMAL(18,4)) * qty) AS DOUBLE) AS turnover, CAST(sum(qty) AS BIGINT) AS volume,
round(CAST(sum(CAST(price AS DECIMAL(18,4)) * qty) AS DOUBLE) / nullif(sum(qty), 0), 6) AS vwap FROM ticks GROUP BY 1, 2""")
def vwap_daily(spark: SparkSession, sf: str) -> DataFrame:
    t = ticks(spark, sf).groupBy("instrument", "day").agg(F.sum(F.col("price").cast("decimal(18,4)") * F.col("qty")).cast("double").alias("turnover"), F.sum("qty").alias("volume"))
    return t.withColumn("vwap", F.round(F.try_divide("turnover", "volume"), 6))


@query(f"""WITH {TICKS}, l AS (SELECT *, lag(price) OVER (PARTITION BY instrument ORDER BY ts, id) AS before FROM ticks)
SELECT date_trunc('hour', ts) AS hour_start, count(*) FILTER (price > before) AS advances, count(*) FILTER (price < before) AS declines, count(*) FILTER (price = before) AS unchanged FROM l GROUP BY 1""")
def advance_decline(spark: SparkSession, sf: str) -> DataFrame:
    d = ticks(spark, sf).withColumn("before", F.lag("price").over(Window.partitionBy("instrument").orderBy("ts", "id")))
    p, b = F.col("price"), F.col("before")
    return d.groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour_start")).agg(F.count_if(p > b).alias("advances"), F.count_if(p < b).alias("declines"), F.count_if(p == b).alias("unchanged"))


@query(f"""WITH {TICKS}, r AS (SELECT instrument, day, max(price) FILTER (minute < 735) AS range_high, min(price) FILTER (minute < 735) AS range_low, sum(qty) FILTER (minute < 735) AS range_volume,
max(price) FILTER (minute >= 735) AS later_high, sum(qty) FILTER (minute >= 735) AS later_volume FROM ticks WHERE minute >= 555 AND minute < 930 GROUP BY 1, 2)
SELECT instrument, day, range_high, range_low, CAST(range_volume AS BIGINT) AS range_volume, coalesce(later_high > range_high AND later_volume >= 1.5 * range_volume, false) AS breakout FROM r""")
def opening_range_breakout(spark: SparkSession, sf: str) -> DataFrame:
    """The range of the first 180 minutes of a session (ticks are sparse) and whether a later high breaks it on 1.5 times its volume."""
    t = ticks(spark, sf).filter((F.col("minute") >= OPEN) & (F.col("minute") < CLOSE))
    early = F.col("minute") < OPEN + 180
    r = t.groupBy("instrument", "day").agg(
        F.max(F.when(early, F.col("price"))).alias("range_high"), F.min(F.when(early, F.col("price"))).alias("range_low"), F.sum(F.when(early, F.col("qty"))).alias("range_volume"),
        F.max(F.when(~early, F.col("price"))).alias("later_high"), F.sum(F.when(~early, F.col("qty"))).alias("later_volume"),
    )
    out = F.coalesce((F.col("later_high") > F.col("range_high")) & (F.col("later_volume") >= 1.5 * F.col("range_volume")), F.lit(False))
    return r.select("instrument", "day", "range_high", "range_low", "range_volume", out.alias("breakout"))
