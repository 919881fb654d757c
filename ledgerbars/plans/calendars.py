"""Calendar queries with the fixed holidays of any year: trading days, sessions, zones. Those from year files are in control.py and ledger.py."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.calendar import clamp, end_less_buffer, is_trading_day, session_minutes, verified_trading_day
from ..registry import query
from ..sources.tables import load

OPEN_SQL = "CASE WHEN isodow({0}) >= 6 THEN strftime({0}, '%Y-%m-%d') = '2026-11-08' WHEN strftime({0}, '%m-%d') IN ('01-26', '05-01', '10-02', '12-25') THEN false ELSE true END"


@query(f"""SELECT o_orderkey, {OPEN_SQL.format("o_orderdate")} AS open,
CASE WHEN isodow(o_orderdate) >= 6 THEN strftime(o_orderdate, '%Y-%m-%d') = '2026-11-08' WHEN strftime(o_orderdate, '%m-%d') IN ('01-26', '05-01', '10-02', '12-25') THEN false ELSE o_orderdate <= DATE '1999-12-31' END AS open_verified FROM orders""")
def trading_day_flags(spark: SparkSession, sf: str) -> DataFrame:
    d = F.to_date("o_orderdate")
    return load(spark, sf, "orders").select("o_orderkey", is_trading_day(d).alias("open"), verified_trading_day(d, F.lit("1999-12-31").cast("date")).alias("open_verified"))


@query("""WITH w AS (SELECT event_id, CAST(event_id % 1440 AS INT) AS a, CAST((event_id * 7) % 1440 AS INT) AS b FROM events)
SELECT event_id, greatest(a, 555) AS lo, least(b, 930) AS hi, greatest(a, 555) < least(b, 930) AS tradable, CAST((least(b, 930) - 5 + 1440) % 1440 AS INT) AS last_entry FROM w""")
def session_clamp(spark: SparkSession, sf: str) -> DataFrame:
    """Proposed windows within the session; an inverted one is empty."""
    e = load(spark, sf, "events").select("event_id", F.to_date("ts").alias("day"), (F.col("event_id") % 1440).cast("int").alias("a"), ((F.col("event_id") * 7) % 1440).cast("int").alias("b"))
    lo, hi, ok = clamp(F.col("a"), F.col("b"), F.col("day"))
    return e.select("event_id", lo.alias("lo"), hi.alias("hi"), ok.alias("tradable"), end_less_buffer(hi, F.lit(5)).alias("last_entry"))


@query("""SELECT event_id, strftime(ts + INTERVAL 330 MINUTE, '%H:%M') AS ist, date_diff('day', DATE '2024-01-01', CAST(ts + INTERVAL 330 MINUTE AS DATE)) AS ist_day, hour(ts + INTERVAL 330 MINUTE) * 60 + minute(ts + INTERVAL 330 MINUTE) AS minute_of_day FROM events""")
def zone_conversion(spark: SparkSession, sf: str) -> DataFrame:
    t = F.convert_timezone(F.lit("UTC"), F.lit("Asia/Kolkata"), F.col("ts"))
    return load(spark, sf, "events").select("event_id", F.date_format(t, "HH:mm").alias("ist"), F.datediff(F.to_date(t), F.lit("2024-01-01").cast("date")).alias("ist_day"), (F.hour(t) * 60 + F.minute(t)).alias("minute_of_day"))


@query("""SELECT CASE WHEN isodow(o_orderdate) >= 6 THEN 'weekend' ELSE 'weekday' END AS kind, count(*) AS n, min(555) AS open_minute, max(930) AS close_minute FROM orders GROUP BY 1""")
def session_times(spark: SparkSession, sf: str) -> DataFrame:
    d = F.to_date("o_orderdate")
    a, b = session_minutes(d)
    return load(spark, sf, "orders").groupBy(F.when(F.weekday(d) >= 5, "weekend").otherwise("weekday").alias("kind")).agg(F.count("*").alias("n"), F.min(a).alias("open_minute"), F.max(b).alias("close_minute"))
