"""Trading days, sessions and windows from year calendars, as columns. No calendar of a year, no trading in it."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as Over

from ..sources.config import Window, Year

#: So many days after one the next trading day is looked for.
PROBES = 370


def among(day: Column, days) -> Column:
    """Whether a day is one of a calendar's few."""
    days = sorted(days)
    return F.coalesce(day.isin(*[F.lit(d) for d in days]), F.lit(False)) if days else F.lit(False)


def is_open(day: Column, years: dict[int, Year], strict: bool = False) -> Column:
    """In this order: no calendar: closed; weekend: special sessions only; holiday: closed; strict and unverified or beyond the horizon: closed."""
    out = F.lit(False)
    for y in years.values():
        sure = F.lit(True)
        if strict:
            sure = F.lit(y.verified) if y.verified_through is None or not y.verified else day <= F.lit(y.verified_through)
        answer = F.when(F.weekday(day) >= 5, among(day, y.special)).when(among(day, y.holidays), False).otherwise(sure)
        out = F.when(F.year(day) == y.year, answer).otherwise(out)
    return F.coalesce(out, F.lit(False))


def session(day: Column, years: dict[int, Year]) -> Column:
    """(open, close, special, shortened) in minutes of a trading day, null else; special times beat shortened ones beat the year's."""
    out = F.lit(None)
    for y in years.values():
        start, end = F.lit(y.continuous[0]), F.lit(y.continuous[1])
        for days in (y.shortened, y.special):
            for d, (a, b) in days.items():
                start, end = F.when(day == F.lit(d), a).otherwise(start), F.when(day == F.lit(d), b).otherwise(end)
        special = among(day, y.special)
        row = F.struct(start.alias("open"), end.alias("close"), special.alias("special"), (among(day, y.shortened) & ~special).alias("shortened"))
        out = F.when(F.year(day) == y.year, row).otherwise(out)
    return F.when(is_open(day, years), out)


def trade_window(day: Column, years: dict[int, Year], seed: Window, start: Column | None = None, end: Column | None = None, buffer: Column | None = None) -> Column:
    """(start, end, buffer, tradable): the stored row if both of its ends are set, else the seed, clamped to the session; an inverted
    window is empty, and so is all of a day without a session."""
    stored = start.isNotNull() & end.isNotNull() if start is not None else F.lit(False)
    s = session(day, years)
    pick = lambda own, other: F.when(stored, own).otherwise(other) if own is not None else F.lit(other)
    lo, hi = F.greatest(pick(start, seed.start), s["open"]), F.least(pick(end, seed.end), s["close"])
    return F.when(s.isNotNull(), F.struct(lo.cast("int").alias("start"), hi.cast("int").alias("end"), F.coalesce(pick(buffer, seed.buffer_min), F.lit(0)).cast("int").alias("buffer"), (lo < hi).alias("tradable")))


def days(spark: SparkSession, years: dict[int, Year], first: datetime.date, last: datetime.date) -> DataFrame:
    """One row a day from ``first`` to ``last``: open, a running index of sessions, and the next trading day within PROBES days, which
    may lie after ``last``. A few hundred rows a year, in one window."""
    d = spark.range(1).select(F.explode(F.sequence(F.lit(first), F.date_add(F.lit(last), PROBES))).alias("day")).withColumn("open", is_open(F.col("day"), years))
    w = Over.orderBy("day")
    d = d.withColumn("session_index", F.sum(F.col("open").cast("int")).over(w)).withColumn("next_day", F.min(F.when(F.col("open"), F.col("day"))).over(w.rowsBetween(1, PROBES)))
    return d.filter(F.col("day") <= F.lit(last))


def next_or_error(next_day: Column, day: Column) -> Column:
    """The next trading day; a day without one within PROBES days is an error."""
    return F.coalesce(next_day, F.raise_error(F.concat(F.lit(f"no trading day within {PROBES} days of "), day.cast("string"))).cast("date"))
