"""Joins: as-of, chains, semi and anti, full outer, range, lookup."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.asof import asof_join
from ..registry import query
from ..sources.tables import TICKS, load, money, ticks


@query("""WITH p AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), v AS (SELECT user_id, ts, value FROM events WHERE event_type = 'view')
SELECT p.event_id, p.user_id, p.ts, v.ts AS view_ts, v.value AS view_price FROM p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.ts >= v.ts""")
def asof_last_view_before_purchase(spark: SparkSession, sf: str) -> DataFrame:
    e = load(spark, sf, "events")
    p = e.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    v = e.filter("event_type = 'view'").select("user_id", "ts", "value")
    j = asof_join(p, v, ["user_id"], "ts", ["value"])
    return j.select("event_id", "user_id", "ts", F.col("r_ts").alias("view_ts"), F.col("r_value").alias("view_price"))


@query("""WITH p AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), v AS (SELECT user_id, ts FROM events WHERE event_type = 'click')
SELECT p.user_id AS user_id, count(*) AS n_entries, count_if(v.ts IS NULL OR epoch_us(p.ts) - epoch_us(v.ts) > 3600000000) AS n_stale
FROM p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.ts >= v.ts GROUP BY p.user_id""")
def stale_data_guard(spark: SparkSession, sf: str) -> DataFrame:
    """Entries whose last tick is too old or missing (an hour here: the test ticks are sparse)."""
    e = load(spark, sf, "events")
    p = e.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    v = e.filter("event_type = 'click'").select("user_id", "ts").withColumn("seen", F.lit(True))
    j = asof_join(p, v, ["user_id"], "ts", ["seen"])
    age = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("r_ts").cast("timestamp"))
    return j.groupBy("user_id").agg(F.count("*").alias("n_entries"), F.count_if(F.col("r_ts").isNull() | (age > 3_600_000_000)).alias("n_stale"))


@query("""SELECT c_custkey, o_orderkey, o_orderstatus, count(*) AS n_fills, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,4))) AS DOUBLE) AS filled, max(l_shipdate) AS last_fill
FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2, 3""")
def provenance_chain(spark: SparkSession, sf: str) -> DataFrame:
    """Account to order to fills. Fills are combined by order before the joins."""
    fills = load(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n_fills"), F.sum(money("l_extendedprice")).cast("double").alias("filled"), F.max("l_shipdate").alias("last_fill"))
    o = load(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    c = load(spark, sf, "customer").select("c_custkey")
    return c.join(o, F.col("c_custkey") == F.col("o_custkey")).join(fills, F.col("o_orderkey") == F.col("l_orderkey")).select("c_custkey", "o_orderkey", "o_orderstatus", "n_fills", "filled", "last_fill")


@query("""SELECT p_brand, count(*) AS n_fills, CAST(sum(CAST(l_quantity AS DECIMAL(18,4))) AS DOUBLE) AS quantity, max(p_retailprice) AS max_price FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand""")
def instrument_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Fills by the sector of their instrument; the planner broadcasts the dimension while it is small."""
    li = load(spark, sf, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"), F.sum(money("l_quantity")).alias("q"))
    p = load(spark, sf, "part").select("p_partkey", "p_brand", "p_retailprice")
    return li.join(p, F.col("l_partkey") == F.col("p_partkey")).groupBy("p_brand").agg(F.sum("n").alias("n_fills"), F.sum("q").cast("double").alias("quantity"), F.max("p_retailprice").alias("max_price"))


@query("""SELECT o_orderpriority, l_returnflag, count(*) AS n, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,4))) AS DOUBLE) AS value FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2""")
def orders_lineitem_smj(spark: SparkSession, sf: str) -> DataFrame:
    o, li = load(spark, sf, "orders").select("o_orderkey", "o_orderpriority"), load(spark, sf, "lineitem").select("l_orderkey", "l_returnflag", "l_extendedprice")
    return o.hint("merge").join(li, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_orderpriority", "l_returnflag").agg(F.count("*").alias("n"), F.sum(money("l_extendedprice")).cast("double").alias("value"))


@query("""WITH f AS (SELECT l_orderkey, count(*) AS n, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,4))) AS DOUBLE) AS filled FROM lineitem GROUP BY 1)
SELECT coalesce(o_orderkey, l_orderkey) AS order_id, CASE WHEN l_orderkey IS NULL THEN 'no_fills' WHEN o_orderkey IS NULL THEN 'no_order' WHEN abs(filled - o_totalprice) <= 0.01 THEN 'match' ELSE 'differs' END AS status, o_totalprice AS ordered, filled
FROM orders FULL JOIN f ON o_orderkey = l_orderkey""")
def reconcile_orders_lines(spark: SparkSession, sf: str) -> DataFrame:
    f = load(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sum(money("l_extendedprice")).cast("double").alias("filled"))
    j = load(spark, sf, "orders").select("o_orderkey", "o_totalprice").join(f, F.col("o_orderkey") == F.col("l_orderkey"), "full")
    status = F.when(F.col("l_orderkey").isNull(), "no_fills").when(F.col("o_orderkey").isNull(), "no_order").when(F.abs(F.col("filled") - F.col("o_totalprice")) <= 0.01, "match").otherwise("differs")
    return j.select(F.coalesce("o_orderkey", "l_orderkey").alias("order_id"), status.alias("status"), F.col("o_totalprice").alias("ordered"), "filled")


@query(f"""WITH {TICKS}, a AS (SELECT instrument, day, count(*) AS n, max(price) AS high FROM ticks WHERE kind <> 'error' GROUP BY 1, 2), b AS (SELECT instrument, day, count(*) AS n, max(price) AS high FROM ticks WHERE kind <> 'signup' GROUP BY 1, 2)
SELECT coalesce(a.instrument, b.instrument) AS instrument, coalesce(a.day, b.day) AS day, CASE WHEN b.day IS NULL THEN 'only_own' WHEN a.day IS NULL THEN 'only_official' WHEN abs(a.high - b.high) <= 0.05 THEN 'match' ELSE 'differs' END AS status
FROM a FULL JOIN b ON a.instrument = b.instrument AND a.day = b.day""")
def bar_reconciliation(spark: SparkSession, sf: str) -> DataFrame:
    """Own bars against official ones (two cuts of the stream here), with a tolerance of one tick."""
    t = ticks(spark, sf)
    bars = lambda kind, name: t.filter(F.col("kind") != kind).groupBy("instrument", "day").agg(F.max("price").alias(name))
    j = bars("error", "own").join(bars("signup", "official"), ["instrument", "day"], "full")
    status = F.when(F.col("official").isNull(), "only_own").when(F.col("own").isNull(), "only_official").when(F.abs(F.col("own") - F.col("official")) <= 0.05, "match").otherwise("differs")
    return j.select("instrument", "day", status.alias("status"))


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def orders_with_returns(spark: SparkSession, sf: str) -> DataFrame:
    r = load(spark, sf, "lineitem").filter("l_returnflag = 'R'").select("l_orderkey")
    return load(spark, sf, "orders").join(r, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey", "o_custkey", "o_totalprice")


@query("""WITH d AS (SELECT DISTINCT CAST(ts AS DATE) AS run_date FROM events), j AS (SELECT DISTINCT user_id AS job_id FROM events),
done AS (SELECT DISTINCT user_id AS job_id, CAST(ts AS DATE) AS run_date FROM events WHERE event_type = 'purchase')
SELECT job_id, run_date FROM j, d WHERE NOT EXISTS (SELECT 1 FROM done WHERE done.job_id = j.job_id AND done.run_date = d.run_date)""")
def missing_runs_anti(spark: SparkSession, sf: str) -> DataFrame:
    """Expected (job, date) runs without a success: the schedule anti-joined with the log. The schedule is jobs
    times calendar days between the log's ends, unfolded from each job's row."""
    e = load(spark, sf, "events").select(F.col("user_id").alias("job_id"), F.to_date("ts").alias("run_date"), "event_type")
    days = e.select("run_date").distinct().agg(F.array_sort(F.collect_set("run_date")).alias("days"))
    expected = e.select("job_id").distinct().join(F.broadcast(days)).select("job_id", F.explode("days").alias("run_date"))
    return expected.join(e.filter("event_type = 'purchase'").select("job_id", "run_date"), ["job_id", "run_date"], "left_anti")


@query("""SELECT o_orderkey, o_custkey, l_shipdate AS ex_date, date_diff('day', o_orderdate, l_shipdate) AS days_ahead, count(*) AS n
FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE date_diff('day', o_orderdate, l_shipdate) BETWEEN 0 AND 30 GROUP BY 1, 2, 3, 4""")
def exdate_within_days(spark: SparkSession, sf: str) -> DataFrame:
    """Ex-dates within 30 days ahead of each order of the same symbol: an equi-join with a range on top."""
    o = load(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    li = load(spark, sf, "lineitem").select("l_orderkey", F.col("l_shipdate").alias("ex_date"))
    ahead = F.datediff("ex_date", "o_orderdate")
    j = o.join(li, F.col("o_orderkey") == F.col("l_orderkey")).filter(ahead.between(0, 30))
    return j.groupBy("o_orderkey", "o_custkey", "ex_date", ahead.alias("days_ahead")).agg(F.count("*").alias("n"))


@query("""WITH t AS (SELECT event_id, user_id, ts, value FROM events WHERE event_type = 'purchase')
SELECT t.event_id, t.user_id, count(e.event_id) AS n_ticks, CAST(min(CAST(e.value AS DECIMAL(18,4)) - CAST(t.value AS DECIMAL(18,4))) AS DOUBLE) AS mae, CAST(max(CAST(e.value AS DECIMAL(18,4)) - CAST(t.value AS DECIMAL(18,4))) AS DOUBLE) AS mfe
FROM t LEFT JOIN events e ON e.user_id = t.user_id AND e.ts > t.ts AND e.ts <= t.ts + INTERVAL 1 DAY GROUP BY 1, 2""")
def mae_mfe_holding(spark: SparkSession, sf: str) -> DataFrame:
    """Worst and best move in the day after each entry: a range frame over the ticks of the instrument, no join."""
    from pyspark.sql.window import Window

    e = load(spark, sf, "events").withColumn("s", F.unix_micros(F.col("ts").cast("timestamp")))
    w = Window.partitionBy("user_id").orderBy("s").rangeBetween(1, 86_400_000_000)
    p = money("value")
    e = e.withColumns({"n_ticks": F.count("*").over(w), "lo": F.min(p).over(w), "hi": F.max(p).over(w)}).filter("event_type = 'purchase'")
    return e.select("event_id", "user_id", "n_ticks", (F.col("lo") - p).cast("double").alias("mae"), (F.col("hi") - p).cast("double").alias("mfe"))


@query("""WITH r(rule_id, cap) AS (VALUES ('low', 1000), ('mid', 5000), ('high', 9000)) SELECT c_custkey, rule_id, c_acctbal <= cap AS passed FROM customer, r""")
def rule_by_account_cross(spark: SparkSession, sf: str) -> DataFrame:
    """Every account against a fixed rule list, unfolded from the row: no join is needed for a constant table."""
    rules = F.array(*(F.struct(F.lit(n).alias("rule_id"), F.lit(c).alias("cap")) for n, c in (("low", 1000), ("mid", 5000), ("high", 9000))))
    return load(spark, sf, "customer").select("c_custkey", "c_acctbal", F.explode(rules).alias("r")).select("c_custkey", "r.rule_id", (F.col("c_acctbal") <= F.col("r.cap")).alias("passed"))


@query("""SELECT l_suppkey, count(*) FILTER (l_linestatus = 'F') AS n_live, count(*) FILTER (l_linestatus = 'O') AS n_paper,
CAST(sum(CAST(l_extendedprice AS DECIMAL(18,4))) FILTER (l_linestatus = 'F') AS DOUBLE) AS live, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,4))) FILTER (l_linestatus = 'O') AS DOUBLE) AS paper FROM lineitem GROUP BY l_suppkey""")
def live_paper_comparison(spark: SparkSession, sf: str) -> DataFrame:
    """One pass of conditional sums instead of a self join."""
    live, paper = F.col("l_linestatus") == "F", F.col("l_linestatus") == "O"
    v = money("l_extendedprice")
    return load(spark, sf, "lineitem").groupBy("l_suppkey").agg(
        F.count_if(live).alias("n_live"), F.count_if(paper).alias("n_paper"), F.sum(F.when(live, v)).cast("double").alias("live"), F.sum(F.when(paper, v)).cast("double").alias("paper")
    )


@query("""WITH u AS (SELECT DISTINCT p_partkey FROM part WHERE p_type IN ('PROMO', 'LARGE')) SELECT l_suppkey, count(*) AS n, count(p_partkey) AS n_fno FROM lineitem LEFT JOIN u ON l_partkey = p_partkey GROUP BY 1""")
def fno_left_join(spark: SparkSession, sf: str) -> DataFrame:
    """Membership of a derivative list; unknown instruments are not members."""
    u = load(spark, sf, "part").filter(F.col("p_type").isin("PROMO", "LARGE")).select("p_partkey").distinct()
    j = load(spark, sf, "lineitem").select("l_suppkey", "l_partkey").join(u, F.col("l_partkey") == F.col("p_partkey"), "left")
    return j.groupBy("l_suppkey").agg(F.count("*").alias("n"), F.count("p_partkey").alias("n_fno"))


@query("""WITH t AS (SELECT p_partkey, unnest(CASE p_type WHEN 'PROMO' THEN ['media', 'retail'] WHEN 'LARGE' THEN ['infra'] ELSE [] END) AS theme FROM part)
SELECT theme, count(*) AS n_fills, CAST(sum(CAST(l_quantity AS DECIMAL(18,4))) / 2 AS DOUBLE) AS weighted FROM lineitem JOIN t ON l_partkey = p_partkey GROUP BY theme""")
def theme_fanout(spark: SparkSession, sf: str) -> DataFrame:
    """Fills to themes through their instruments, each theme at a weight of one half."""
    themes = F.when(F.col("p_type") == "PROMO", F.array(F.lit("media"), F.lit("retail"))).when(F.col("p_type") == "LARGE", F.array(F.lit("infra")))
    t = load(spark, sf, "part").select("p_partkey", F.explode(themes).alias("theme"))
    li = load(spark, sf, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"), F.sum(money("l_quantity")).alias("q"))
    return li.join(t, F.col("l_partkey") == F.col("p_partkey")).groupBy("theme").agg(F.sum("n").alias("n_fills"), (F.sum("q").cast("double") / 2).alias("weighted"))


@query("""WITH b AS (SELECT p_brand, min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part WHERE p_size <= 25 GROUP BY 1)
SELECT p.p_partkey, p.p_brand, p.p_retailprice BETWEEN b.lo AND b.hi AS in_bounds FROM part p JOIN b ON p.p_brand = b.p_brand""")
def envelope_bounds_join(spark: SparkSession, sf: str) -> DataFrame:
    p = load(spark, sf, "part").select("p_partkey", "p_brand", "p_retailprice", "p_size")
    b = p.filter("p_size <= 25").groupBy("p_brand").agg(F.min("p_retailprice").alias("lo"), F.max("p_retailprice").alias("hi"))
    return p.join(b, "p_brand").select("p_partkey", "p_brand", F.col("p_retailprice").between(F.col("lo"), F.col("hi")).alias("in_bounds"))


@query("""SELECT r_name, n_name, count(*) AS n_accounts, CAST(sum(CAST(c_acctbal AS DECIMAL(18,4))) AS DOUBLE) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2""")
def sector_hierarchy(spark: SparkSession, sf: str) -> DataFrame:
    c = load(spark, sf, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n_accounts"), F.sum(money("c_acctbal")).cast("double").alias("balance"))
    n, r = load(spark, sf, "nation"), load(spark, sf, "region")
    return c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey")).select("r_name", "n_name", "n_accounts", "balance")


@query("""WITH v AS (SELECT * FROM conversations WHERE role = 'user'), a AS (SELECT conv_id, turn FROM conversations WHERE role = 'assistant')
SELECT v.conv_id, v.turn, min(a.turn) AS answered_at FROM v LEFT JOIN a ON a.conv_id = v.conv_id AND a.turn > v.turn GROUP BY 1, 2""")
def proposal_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """Each proposal (a user's turn) and its first verdict (the next answer), or null: one frame per conversation."""
    from pyspark.sql.window import Window

    c = load(spark, sf, "conversations").select("conv_id", "turn", "role")
    w = Window.partitionBy("conv_id").orderBy("turn").rangeBetween(1, Window.unboundedFollowing)
    return c.withColumn("answered_at", F.min(F.when(F.col("role") == "assistant", F.col("turn"))).over(w)).filter("role = 'user'").select("conv_id", "turn", "answered_at").distinct()
