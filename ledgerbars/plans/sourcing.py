"""Typed reading with quarantine, snapshots, price maps, migrations, JSON validation, log sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.actions import validate_actions
from ..registry import query
from ..sources.tables import load

RAW = "r AS (SELECT p_partkey, p_name AS symbol, p_brand AS segment, p_type AS kind, CASE WHEN p_partkey % 17 = 0 THEN 'None' WHEN p_size <= 10 THEN '0.01' ELSE '0.05' END AS tick, CASE WHEN p_partkey % 13 = 0 THEN '' ELSE CAST(p_size AS VARCHAR) END AS lot FROM part)"


def instruments(spark: SparkSession, sf: str) -> DataFrame:
    """Dump rows of strings -> typed instruments, with ``ok``: a missing tick size sends a row to quarantine; a missing lot is 1."""
    tick = F.when(F.col("p_partkey") % 17 == 0, "None").when(F.col("p_size") <= 10, "0.01").otherwise("0.05")
    lot = F.when(F.col("p_partkey") % 13 == 0, "").otherwise(F.col("p_size").cast("string"))
    r = load(spark, sf, "part").select("p_partkey", F.col("p_name").alias("symbol"), F.col("p_brand").alias("segment"), F.col("p_type").alias("kind"), tick.try_cast("decimal(18,4)").alias("tick_size"), F.coalesce(F.nullif(lot.try_cast("int"), F.lit(0)), F.lit(1)).alias("lot_size"))
    return r.withColumn("is_fno", F.col("segment").isin("Brand#1", "Brand#2") | F.col("kind").isin("PROMO", "LARGE")).withColumn("ok", F.col("tick_size").isNotNull())


@query(f"WITH {RAW} SELECT p_partkey, symbol, CAST(TRY_CAST(tick AS DECIMAL(18,4)) AS DOUBLE) AS tick_size, coalesce(nullif(TRY_CAST(lot AS INT), 0), 1) AS lot_size, segment IN ('Brand#1', 'Brand#2') OR kind IN ('PROMO', 'LARGE') AS is_fno FROM r WHERE TRY_CAST(tick AS DECIMAL(18,4)) IS NOT NULL")
def typed_instruments(spark: SparkSession, sf: str) -> DataFrame:
    return instruments(spark, sf).filter("ok").select("p_partkey", "symbol", F.col("tick_size").cast("double").alias("tick_size"), "lot_size", "is_fno")


@query(f"WITH {RAW} SELECT segment, count(*) AS n, count_if(TRY_CAST(tick AS DECIMAL(18,4)) IS NULL) AS n_quarantined FROM r GROUP BY 1")
def quarantine_counts(spark: SparkSession, sf: str) -> DataFrame:
    return instruments(spark, sf).groupBy("segment").agg(F.count("*").alias("n"), F.count_if(~F.col("ok")).alias("n_quarantined"))


@query("SELECT upper(trim(p_name)) AS symbol, min(p_partkey) AS token, count(*) AS n FROM part GROUP BY 1")
def symbol_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Trimmed, case-insensitive; the first hit counts."""
    return load(spark, sf, "part").groupBy(F.upper(F.trim("p_name")).alias("symbol")).agg(F.min("p_partkey").alias("token"), F.count("*").alias("n"))


@query("SELECT user_id AS token, arg_max(value, event_id) AS price FROM events WHERE value IS NOT NULL GROUP BY 1")
def last_price_map(spark: SparkSession, sf: str) -> DataFrame:
    """Null prices dropped, the last of a token's duplicates wins."""
    return load(spark, sf, "events").filter("value is not null").groupBy(F.col("user_id").alias("token")).agg(F.max_by("value", "event_id").alias("price"))


@query("SELECT l_orderkey, l_linenumber, l_shipdate, count(*) AS n FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-01-01' AND l_shipdate < TIMESTAMP '1997-04-01' GROUP BY ALL")
def range_scan(spark: SparkSession, sf: str) -> DataFrame:
    """A candle-like range read: both ends of the predicate are pushed to the scan."""
    li = load(spark, sf, "lineitem").filter((F.col("l_shipdate") >= F.lit("1997-01-01").cast("timestamp_ntz")) & (F.col("l_shipdate") < F.lit("1997-04-01").cast("timestamp_ntz")))
    return li.groupBy("l_orderkey", "l_linenumber", "l_shipdate").agg(F.count("*").alias("n"))


@query("SELECT r_name || '.sql' AS file FROM region WHERE r_regionkey NOT IN (SELECT n_regionkey FROM nation WHERE n_nationkey < 3) ORDER BY 1")
def unapplied_migrations(spark: SparkSession, sf: str) -> DataFrame:
    done = load(spark, sf, "nation").filter("n_nationkey < 3").select("n_regionkey")
    return load(spark, sf, "region").join(done, F.col("r_regionkey") == F.col("n_regionkey"), "left_anti").select(F.concat("r_name", F.lit(".sql")).alias("file")).orderBy("file")


ACTION = """'{"action":"' || CASE event_type WHEN 'purchase' THEN 'enter' WHEN 'view' THEN 'exit' WHEN 'click' THEN 'cancel' ELSE 'dance' END || '","thesis":"' || repeat('x', CAST(event_id % 40 AS INT)) || '","confidence":' || CAST(event_id % 12 AS VARCHAR) || 'e-1' || CASE WHEN event_id % 10 = 0 THEN ',"extra":1' ELSE '' END || CASE event_type WHEN 'click' THEN ',"order_id":"o1"' WHEN 'view' THEN ',"position_id":"p1","exit_type":"MARKET","reason":"other"' ELSE '' END || '}'"""


@query(f"""WITH j AS (SELECT event_id, event_type AS k, {ACTION} AS body FROM events)
SELECT event_id, CASE WHEN k NOT IN ('purchase', 'view', 'click') THEN 'unknown action' WHEN event_id % 10 = 0 THEN 'unknown key' WHEN event_id % 40 < 20 THEN 'thesis' WHEN event_id % 12 > 10 THEN 'confidence' WHEN k = 'purchase' THEN 'missing key' END AS problem FROM j""")
def action_union_validate(spark: SparkSession, sf: str) -> DataFrame:
    """Proposals as JSON text, judged by their action's own keys; the first problem or null."""
    k = F.col("event_type")
    action = F.when(k == "purchase", "enter").when(k == "view", "exit").when(k == "click", "cancel").otherwise("dance")
    extra = F.when(F.col("event_id") % 10 == 0, ',"extra":1').otherwise("")
    own = F.when(k == "click", ',"order_id":"o1"').when(k == "view", ',"position_id":"p1","exit_type":"MARKET","reason":"other"').otherwise("")
    body = F.concat(F.lit('{"action":"'), action, F.lit('","thesis":"'), F.repeat(F.lit("x"), (F.col("event_id") % 40).cast("int")), F.lit('","confidence":'), (F.col("event_id") % 12).cast("string"), F.lit("e-1"), extra, own, F.lit("}"))
    return validate_actions(load(spark, sf, "events").select("event_id", body.alias("body")), "body").select("event_id", "problem")


@query("""SELECT CAST(ts AS DATE) AS day, event_type AS level, count(*) AS n, min('{"id":' || event_id || ',"user":' || user_id || '}') AS sample FROM events GROUP BY 1, 2""")
def json_log_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Log lines by day, as the JSON sink would write them."""
    line = F.to_json(F.struct(F.col("event_id").alias("id"), F.col("user_id").alias("user")))
    return load(spark, sf, "events").groupBy(F.to_date("ts").alias("day"), F.col("event_type").alias("level")).agg(F.count("*").alias("n"), F.min(line).alias("sample"))
