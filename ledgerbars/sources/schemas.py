"""Static schemas of the state tables that queries read, and membership of their closed word lists. Nothing is inferred."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, IntegerType, StringType, StructField, StructType, TimestampType

MONEY = DecimalType(18, 4)
# Tables, their columns and word lists. Times are instants, flags are 0 or 1 as in the store.
SCHEMAS = {
    "positions": StructType(
        [
            StructField("position_id", StringType(), False), StructField("symbol", StringType(), False), StructField("side", StringType()), StructField("style", StringType()), StructField("product", StringType()),
            StructField("qty", IntegerType()), StructField("avg_entry", MONEY), StructField("stop", MONEY), StructField("target", MONEY), StructField("state", StringType()), StructField("protection_state", StringType()),
            StructField("is_paper", IntegerType(), False), StructField("origin", StringType(), False), StructField("close_reason", StringType()), StructField("opened_at", TimestampType()), StructField("closed_at", TimestampType()),
        ]
    ),
    "mode_state": StructType(
        [
            StructField("id", IntegerType()), StructField("mode", StringType(), False), StructField("routing", StringType()), StructField("risk_state", StringType(), False), StructField("reason", StringType()),
            StructField("changed_by", StringType()), StructField("changed_at", TimestampType()),
        ]
    ),
    "trade_window_state": StructType(
        [
            StructField("id", IntegerType()), StructField("start_ist", StringType()), StructField("end_ist", StringType()), StructField("squareoff_buffer_min", IntegerType()), StructField("set_by", StringType()),
            StructField("changed_at", TimestampType()),
        ]
    ),
    "engine_lifecycle": StructType(
        [
            StructField("id", IntegerType()), StructField("state", StringType(), False), StructField("last_alive_at", TimestampType()), StructField("pid", IntegerType()), StructField("started_at", TimestampType()),
            StructField("last_clean_stop_at", TimestampType()), StructField("version", StringType()),
        ]
    ),
}
WORDS = {
    ("positions", "style"): ("intraday", "swing", "position"), ("positions", "product"): ("MIS", "CNC"), ("positions", "origin"): ("platform", "external", "recommended"),
    ("mode_state", "mode"): ("OFF", "RECOMMEND", "AUTO"), ("mode_state", "risk_state"): ("NORMAL", "FROZEN", "CLOSE_ONLY"), ("engine_lifecycle", "state"): ("RUNNING", "STOPPING", "STOPPED"),
}


def valid(table: str) -> Column:
    """True for rows whose words are all in their lists; an absent word is not."""
    checks = [F.coalesce(F.col(c).isin(*w), F.lit(False)) for (t, c), w in WORDS.items() if t == table]
    return reduce(lambda a, b: a & b, checks, F.lit(True))


def split(df: DataFrame, ok: Column) -> tuple[DataFrame, DataFrame]:
    """(valid rows, quarantine); an unknown answer is quarantined."""
    good = F.coalesce(ok, F.lit(False))
    return df.filter(good), df.filter(~good)
