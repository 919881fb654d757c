"""Exact money: tick rounding in integers, and the cost of a trade."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Rates in per cent of notional unless said.
BROKERAGE_MIS, BROKERAGE_CAP = "0.03", "20"
STT_DELIVERY, STT_INTRADAY_SELL = "0.1", "0.025"
TXN, SEBI_PER_CRORE = "0.00307", "10"
STAMP_DELIVERY_BUY, STAMP_INTRADAY_BUY = "0.015", "0.003"
GST, DP_PER_SELL = "18", "15.34"


def round_to_tick(price: Column, tick: Column) -> Column:
    """Half up to the grid, in ten-thousandths, so that no division leaves the integers; prices are not negative."""
    p, t = (price * 10000).cast("long"), (tick * 10000).cast("long")
    return (F.floor((2 * p + t) / (2 * t)).cast("long") * t / F.lit(10000).cast("decimal(5,0)")).cast("decimal(18,4)")


def pct(notional: Column, rate: str) -> Column:
    return (notional * F.lit(rate).cast("decimal(9,5)") / F.lit(100).cast("decimal(3,0)")).cast("decimal(24,8)")


def cost_parts(notional: Column, delivery: Column, sell: Column) -> dict[str, Column]:
    """The parts of one order's cost: decimals of eight places."""
    zero = F.lit(0).cast("decimal(24,8)")
    brokerage = F.when(delivery, zero).otherwise(F.least(pct(notional, BROKERAGE_MIS), F.lit(BROKERAGE_CAP).cast("decimal(24,8)")))
    stt = F.when(delivery, pct(notional, STT_DELIVERY)).when(sell, pct(notional, STT_INTRADAY_SELL)).otherwise(zero)
    txn = pct(notional, TXN)
    sebi = (notional * F.lit(SEBI_PER_CRORE).cast("decimal(9,5)") / F.lit(10000000).cast("decimal(8,0)")).cast("decimal(24,8)")
    stamp = F.when(sell, zero).when(delivery, pct(notional, STAMP_DELIVERY_BUY)).otherwise(pct(notional, STAMP_INTRADAY_BUY))
    gst = pct(brokerage + txn + sebi, GST)
    dp = F.when(delivery & sell, F.lit(DP_PER_SELL).cast("decimal(24,8)")).otherwise(zero)
    return {"brokerage": brokerage, "stt": stt, "txn": txn, "sebi": sebi, "stamp": stamp, "gst": gst, "dp": dp}


def total(parts: dict[str, Column]) -> Column:
    out = F.lit(0).cast("decimal(24,8)")
    for c in parts.values():
        out = out + c
    return out.cast("decimal(24,8)")


def position_size(budget: Column, entry: Column, stop: Column, overnight: Column, multiplier: str = "2.5") -> Column:
    """Whole units whose loss at the stop is within the budget; overnight the distance counts ``multiplier`` times. 0 without a distance."""
    distance = F.abs(entry - stop) * F.when(overnight, F.lit(multiplier).cast("decimal(4,1)")).otherwise(F.lit("1").cast("decimal(4,1)"))
    return F.coalesce(F.floor(F.try_divide(budget.cast("decimal(18,4)"), distance.cast("decimal(18,4)"))), F.lit(0)).cast("long")
