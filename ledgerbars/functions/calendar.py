"""Trading-calendar semantics as columns: a date dimension, sessions, windows.

Any year is open on weekdays but four fixed holidays; the shipped year also has one special session.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Holidays (month-day) of every year, the special session, session minutes of the day.
HOLIDAYS = ("01-26", "05-01", "10-02", "12-25")
SPECIAL = {"2026-11-08": (555, 615)}
PRE_OPEN, OPEN, CLOSE, POST_START, POST_END = 540, 555, 930, 940, 960


def is_holiday(day: Column) -> Column:
    return F.date_format(day, "MM-dd").isin(*HOLIDAYS)


def is_special(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM-dd").isin(*SPECIAL)


def is_trading_day(day: Column) -> Column:
    """Weekends are open for a special session only; then holidays are closed; all else is open."""
    return F.when(F.weekday(day) >= 5, is_special(day)).when(is_holiday(day), False).otherwise(True)


def verified_trading_day(day: Column, verified_through: Column) -> Column:
    """Strict mode: no day past the verified horizon but for a weekend's special session, which is asked first."""
    strict = F.coalesce(day <= verified_through, F.lit(False))
    return F.when(F.weekday(day) >= 5, is_special(day)).when(is_holiday(day), False).otherwise(strict)


def session_minutes(day: Column) -> tuple[Column, Column]:
    key = F.date_format(day, "yyyy-MM-dd")
    start, end = F.lit(OPEN), F.lit(CLOSE)
    for d, (a, b) in SPECIAL.items():
        start, end = F.when(key == d, a).otherwise(start), F.when(key == d, b).otherwise(end)
    return start, end


def clamp(start: Column, end: Column, day: Column) -> tuple[Column, Column, Column]:
    """A window within the session, and whether anything of it is left (an inverted one is empty)."""
    a, b = session_minutes(day)
    lo, hi = F.greatest(start, a), F.least(end, b)
    return lo, hi, lo < hi


def end_less_buffer(end: Column, buffer_min: Column) -> Column:
    """Minutes of the day, around midnight if need be."""
    return F.pmod(end - buffer_min, F.lit(1440))


def date_dimension(spark: SparkSession, first: str, last: str) -> DataFrame:
    """One row a day: trading flag, running index of sessions, next trading day. Days are few: years times 366."""
    d = spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("day"))
    d = d.withColumn("open", is_trading_day(F.col("day")))
    w = Window.orderBy("day")
    return d.withColumn("session_index", F.sum(F.col("open").cast("int")).over(w)).withColumn(
        "next_day", F.min(F.when(F.col("open"), F.col("day"))).over(w.rowsBetween(1, Window.unboundedFollowing))
    )


#: The dimension in DuckDB, for days between two dates given by format().
CALENDAR = """cal AS (SELECT day, open, CAST(sum(CASE WHEN open THEN 1 ELSE 0 END) OVER (ORDER BY day) AS BIGINT) AS session_index,
 min(CASE WHEN open THEN day END) OVER (ORDER BY day ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_day
 FROM (SELECT CAST(g AS DATE) AS day, CASE WHEN isodow(g) >= 6 THEN strftime(g, '%Y-%m-%d') = '2026-11-08'
 WHEN strftime(g, '%m-%d') IN ('01-26', '05-01', '10-02', '12-25') THEN false ELSE true END AS open
 FROM generate_series(TIMESTAMP '{}', TIMESTAMP '{}', INTERVAL 1 DAY) t(g)) q)"""
