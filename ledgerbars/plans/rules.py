"""Rule checks over accounts and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.rules import check_rows
from ..registry import query
from ..sources.tables import load

@query("""SELECT c_custkey, unnest(['capital_cap', 'equity_floor_rung', 'cumulative_floor']) AS rule_id, unnest([v <= 20000, p > -10, p >= -15]) AS passed, unnest([v, p, p]) AS value, unnest([CAST(20000 AS DOUBLE), -10, -15]) AS "limit", unnest([20000 - v, p + 10, p + 15]) AS headroom
FROM (SELECT c_custkey, c_acctbal AS v, round(c_acctbal) - 5000 AS p FROM customer)""")
def rule_checks_long(spark: SparkSession, sf: str) -> DataFrame:
    c = load(spark, sf, "customer").select("c_custkey", F.col("c_acctbal").alias("deployed"), (F.round("c_acctbal") - 5000).alias("equity_pct"))
    return check_rows(c, ["c_custkey"])


@query()
def rule_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """The gate's verdict of each account: its checks as an array of structs, and whether all passed."""
    rows = rule_checks_long(spark, sf)
    return rows.groupBy("c_custkey").agg(F.bool_and("passed").alias("approved"), F.array_sort(F.collect_list(F.struct("rule_id", "passed", "value", "limit", "headroom"))).alias("checks"))


@query("""WITH w AS (SELECT event_id, CAST(event_id % 1000 + 400 AS INT) AS a, CAST((event_id * 3) % 1000 + 400 AS INT) AS b, event_type <> 'signup' AS owner FROM events)
SELECT event_id, CASE WHEN NOT owner THEN 'not authorised' WHEN b <= a THEN 'end not after start' WHEN a < 555 OR b > 930 THEN 'outside session' WHEN b - 5 <= a THEN 'empty after buffer' END AS reason FROM w""")
def trade_window_validation(spark: SparkSession, sf: str) -> DataFrame:
    """The first reason that fails, in a fixed order, or null."""
    a, b = (F.col("event_id") % 1000 + 400).cast("int"), ((F.col("event_id") * 3) % 1000 + 400).cast("int")
    why = F.when(F.col("event_type") == "signup", "not authorised").when(b <= a, "end not after start").when((a < 555) | (b > 930), "outside session").when(b - 5 <= a, "empty after buffer")
    return load(spark, sf, "events").select("event_id", why.alias("reason"))


@query("""WITH t AS (SELECT event_id, hour(ts) * 60 + minute(ts) AS m, event_type AS k, day(ts) % 7 = 4 AS expiry FROM events)
SELECT k AS kind, count(*) AS n, count_if(CASE WHEN k IN ('click', 'view') THEN m BETWEEN 570 AND 870 AND NOT (expiry AND m >= 840) ELSE m BETWEEN 560 AND 900 END) AS n_allowed FROM t GROUP BY 1""")
def entry_time_bands(spark: SparkSession, sf: str) -> DataFrame:
    """Bands by product, and an earlier end on expiry days."""
    m, intraday, expiry = F.hour("ts") * 60 + F.minute("ts"), F.col("event_type").isin("click", "view"), F.day("ts") % 7 == 4
    ok = F.when(intraday, m.between(570, 870) & ~(expiry & (m >= 840))).otherwise(m.between(560, 900))
    return load(spark, sf, "events").groupBy(F.col("event_type").alias("kind")).agg(F.count("*").alias("n"), F.count_if(ok).alias("n_allowed"))


@query("""SELECT event_id, array_to_string(list_filter([CASE WHEN event_type = 'error' THEN 'feed' END, CASE WHEN value > 50 THEN 'skew' END, CASE WHEN event_id % 11 = 0 THEN 'disk' END, CASE WHEN user_id % 9 = 0 THEN 'wal' END], lambda x: x IS NOT NULL), ',') AS problems FROM events""")
def health_problems(spark: SparkSession, sf: str) -> DataFrame:
    p = F.array(F.when(F.col("event_type") == "error", "feed"), F.when(F.col("value") > 50, "skew"), F.when(F.col("event_id") % 11 == 0, "disk"), F.when(F.col("user_id") % 9 == 0, "wal"))
    return load(spark, sf, "events").select("event_id", F.array_join(F.array_compact(p), ",").alias("problems"))


@query("""SELECT user_id, count(*) AS n, count_if(props IS NULL) AS unknown, coalesce(min(offset_us), -1) AS offset_us FROM (SELECT user_id, props, abs(coalesce(CASE WHEN event_type = 'view' THEN value END, CASE WHEN event_type = 'click' THEN value * 2 END)) AS offset_us FROM events) GROUP BY 1""")
def first_source_wins(spark: SparkSession, sf: str) -> DataFrame:
    """The first reachable source counts, as an absolute offset; none: -1."""
    v = F.abs(F.coalesce(F.when(F.col("event_type") == "view", F.col("value")), F.when(F.col("event_type") == "click", F.col("value") * 2)))
    return load(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("props").isNull()).alias("unknown"), F.coalesce(F.min(v), F.lit(-1.0)).alias("offset_us"))
