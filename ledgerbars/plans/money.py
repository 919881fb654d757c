"""Decimal queries: tick grid, costs, sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.money import cost_parts, position_size, round_to_tick, total
from ..registry import query
from ..sources.tables import load, money


@query("""WITH p AS (SELECT p_partkey, CAST(round(p_retailprice * 10000) AS BIGINT) AS u, CASE WHEN p_size <= 10 THEN 100 WHEN p_size <= 30 THEN 500 ELSE 1000 END AS t FROM part)
SELECT p_partkey, CAST(((2 * u + t) // (2 * t)) * t AS DOUBLE) / 10000 AS rounded FROM p""")
def tick_rounded_prices(spark: SparkSession, sf: str) -> DataFrame:
    tick = F.when(F.col("p_size") <= 10, F.lit("0.01")).when(F.col("p_size") <= 30, F.lit("0.05")).otherwise(F.lit("0.10")).cast("decimal(18,4)")
    return load(spark, sf, "part").select("p_partkey", round_to_tick(money("p_retailprice"), tick).cast("double").alias("rounded"))


COSTS = """c AS (SELECT *, CAST(l_extendedprice AS DECIMAL(18,4)) AS n, l_returnflag = 'A' AS delivery, l_linestatus = 'O' AS sell FROM lineitem),
k AS (SELECT *, CASE WHEN delivery THEN 0 ELSE least(CAST(n * 0.0003 AS DECIMAL(24,8)), 20) END AS brokerage, CAST(CASE WHEN delivery THEN n * 0.001 WHEN sell THEN n * 0.00025 ELSE 0 END AS DECIMAL(24,8)) AS stt,
CAST(n * 0.0000307 AS DECIMAL(24,8)) AS txn, CAST(n * 0.000001 AS DECIMAL(24,8)) AS sebi, CAST(CASE WHEN sell THEN 0 WHEN delivery THEN n * 0.00015 ELSE n * 0.00003 END AS DECIMAL(24,8)) AS stamp, CASE WHEN delivery AND sell THEN 15.34 ELSE 0 END AS dp FROM c),
g AS (SELECT *, CAST((brokerage + txn + sebi) * 0.18 AS DECIMAL(24,8)) AS gst FROM k)"""


def costed(spark: SparkSession, sf: str) -> tuple[DataFrame, dict]:
    li = load(spark, sf, "lineitem")
    return li, cost_parts(money("l_extendedprice"), F.col("l_returnflag") == "A", F.col("l_linestatus") == "O")


@query(f"""WITH {COSTS} SELECT l_returnflag, l_linestatus, count(*) AS n, round(CAST(sum(brokerage) AS DOUBLE), 2) AS brokerage, round(CAST(sum(stt) AS DOUBLE), 2) AS stt, round(CAST(sum(stamp) AS DOUBLE), 2) AS stamp,
round(CAST(sum(gst) AS DOUBLE), 2) AS gst, round(CAST(sum(dp) AS DOUBLE), 2) AS dp, round(CAST(sum(brokerage + stt + txn + sebi + stamp + gst + dp) AS DOUBLE), 2) AS total FROM g GROUP BY 1, 2""")
def lineitem_cost_breakdown(spark: SparkSession, sf: str) -> DataFrame:
    li, parts = costed(spark, sf)
    show = {k: F.round(F.sum(k).cast("double"), 2).alias(k) for k in ("brokerage", "stt", "stamp", "gst", "dp", "total")}
    return li.withColumns(parts | {"total": total(parts)}).groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), *show.values())


@query(f"""WITH {COSTS}, e AS (SELECT unnest(['brokerage', 'dp', 'gst', 'sebi', 'stamp', 'stt', 'txn']) AS part, unnest([CAST(brokerage AS DOUBLE), dp, gst, sebi, stamp, stt, txn]) AS v FROM g)
SELECT part, count(*) AS n, round(sum(v), 1) AS cost FROM e GROUP BY part""")
def cost_components_map(spark: SparkSession, sf: str) -> DataFrame:
    """Costs as a map of components, unfolded and summed by component."""
    li, parts = costed(spark, sf)
    entries = F.map_from_entries(F.array(*(F.struct(F.lit(k), v.cast("decimal(24,8)")) for k, v in parts.items())))
    e = li.select(F.explode(entries).alias("part", "v"))
    return e.groupBy("part").agg(F.count("*").alias("n"), F.round(F.sum("v").cast("double"), 1).alias("cost"))


@query("""WITH p AS (SELECT p_partkey, CAST(p_retailprice AS DECIMAL(18,4)) AS entry, CAST(CAST(p_retailprice AS DECIMAL(18,4)) * p_size AS DECIMAL(24,4)) AS stop100, p_size, p_type = 'PROMO' AS overnight FROM part)
SELECT p_partkey, CASE WHEN p_size = 0 THEN 0 ELSE CAST((CASE WHEN overnight THEN 4000000000 ELSE 2000000000 END) // (CAST(p_size AS BIGINT) * 10000 * CASE WHEN overnight THEN 25 ELSE 10 END) AS BIGINT) END AS quantity FROM p""")
def position_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """Units for a budget of 20,000 (40,000 overnight) at a stop p_size away from the price."""
    p = load(spark, sf, "part")
    night = F.col("p_type") == "PROMO"
    entry = money("p_retailprice")
    budget = F.when(night, F.lit(40000)).otherwise(F.lit(20000)).cast("decimal(18,4)")
    return p.select("p_partkey", position_size(budget, entry, entry - F.col("p_size").cast("decimal(18,4)"), night).alias("quantity"))


@query("""SELECT l_orderkey, l_linenumber, abs(l_extendedprice / l_quantity / 2000 - 1) <= CASE WHEN l_returnflag = 'A' THEN 0.2 ELSE 0.1 END AS in_band, count(*) AS n FROM lineitem WHERE l_quantity > 0 GROUP BY ALL""")
def entry_sanity_band(spark: SparkSession, sf: str) -> DataFrame:
    """Prices near a reference price, by product (a wide band: the test prices scatter)."""
    li = load(spark, sf, "lineitem").filter("l_quantity > 0")
    unit = F.col("l_extendedprice") / F.col("l_quantity")
    band = F.when(F.col("l_returnflag") == "A", 0.2).otherwise(0.1)
    return li.groupBy("l_orderkey", "l_linenumber", (F.abs(unit / 2000 - 1) <= band).alias("in_band")).agg(F.count("*").alias("n"))
