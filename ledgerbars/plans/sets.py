"""Set operations and order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import query
from ..sources.tables import load


@query("""(SELECT 'with_orders' AS part, count(*) AS n FROM (SELECT c_custkey FROM customer INTERSECT SELECT o_custkey FROM orders)) UNION ALL (SELECT 'without_orders', count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders))
UNION ALL (SELECT 'any_key', count(*) FROM (SELECT c_custkey FROM customer UNION SELECT s_suppkey FROM supplier)) UNION ALL (SELECT 'bag_left', count(*) FROM (SELECT o_custkey FROM orders EXCEPT ALL SELECT c_custkey FROM customer))""")
def set_ops_accounts(spark: SparkSession, sf: str) -> DataFrame:
    c, o, s = load(spark, sf, "customer").select(F.col("c_custkey").alias("k")), load(spark, sf, "orders").select(F.col("o_custkey").alias("k")), load(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"))
    parts = {"with_orders": c.intersect(o), "without_orders": c.subtract(o), "any_key": c.union(s).distinct(), "bag_left": o.exceptAll(c)}
    counts = [p.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n") for name, p in parts.items()]
    return counts[0].union(counts[1]).union(counts[2]).union(counts[3])


@query("""WITH a AS (SELECT DISTINCT l_orderkey AS k FROM lineitem), b AS (SELECT o_orderkey AS k FROM orders) SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'only_orders' ELSE 'only_lines' END AS side FROM a FULL JOIN b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL""")
def set_equality(spark: SparkSession, sf: str) -> DataFrame:
    """What two sets do not share; empty if they are equal. One pass over the union instead of two differences."""
    a, b = load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.lit(1).alias("s")), load(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.lit(2).alias("s"))
    m = a.union(b).groupBy("k").agg(F.min("s").alias("lo"), F.max("s").alias("hi")).filter("lo = hi")
    return m.select("k", F.when(F.col("lo") == 2, "only_orders").otherwise("only_lines").alias("side"))


@query("""SELECT count(*) AS n_conflicts FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders WHERE strftime(o_orderdate, '%m-%d') IN ('01-26', '05-01', '10-02', '12-25') INTERSECT SELECT DATE '2026-11-08')""")
def holiday_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    """Holidays that are special sessions too: there must be none."""
    from ..functions.calendar import is_holiday, is_special

    d = F.to_date("o_orderdate")
    return load(spark, sf, "orders").filter(is_holiday(d) & is_special(d)).select(d.alias("d")).distinct().agg(F.count("*").alias("n_conflicts"))


@query("""SELECT o_orderkey, o_orderdate, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100""")
def top_orders(spark: SparkSession, sf: str) -> DataFrame:
    """The hundred largest orders: a top-k in each task, merged at the end."""
    return load(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100)


@query("""SELECT o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS first_order, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS last_order, array_to_string(list(o_orderkey ORDER BY o_orderdate, o_orderkey)[1:3], ',') AS earliest FROM orders GROUP BY 1""")
def first_last_orders(spark: SparkSession, sf: str) -> DataFrame:
    o = load(spark, sf, "orders")
    at = F.struct("o_orderdate", "o_orderkey")
    early = F.transform(F.slice(F.array_sort(F.collect_list(at)), 1, 3), lambda s: s["o_orderkey"])
    return o.groupBy("o_custkey").agg(F.min_by("o_orderkey", at).alias("first_order"), F.max_by("o_orderkey", at).alias("last_order"), F.array_join(early, ",").alias("earliest"))
