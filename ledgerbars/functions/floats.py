"""Doubles as DuckDB counts them: division by zero and rounding."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def quotient(x: Column, y: Column) -> Column:
    """x / y by IEEE 754: infinite or NaN over zero, also over -0.0, where Spark's division gives null or fails."""
    over_zero = x * F.when(y.cast("string").startswith("-"), -INF).otherwise(INF)
    return F.when(y == 0, over_zero).otherwise(F.try_divide(x, y))


def rounded(x: Column, places: int) -> Column:
    """Half away from zero after scaling in double precision; Spark's own round works on the shortest decimal, which may be on a half where the scaled double is not."""
    s = x * F.lit(10.0**places)
    t = F.rint(s)
    r = F.when(F.abs(s) - F.abs(t) == 0.5, t + F.signum(s)).otherwise(t)
    return F.when(F.abs(s) < INF, r / F.lit(10.0**places)).otherwise(x)


def round_half_away(x: float, places: int) -> float:
    """``rounded`` for one number."""
    s = x * 10.0**places
    if not math.isfinite(s):
        return x
    t = math.floor(abs(s))
    return math.copysign((t + (abs(s) - t >= 0.5)) / 10.0**places, x)
