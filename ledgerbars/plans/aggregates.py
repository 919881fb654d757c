"""Aggregations: counts, ledgers, budgets, caps, exposure, decay."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..registry import query
from ..sources.tables import TICKS, load, money, ticks

#: Prices by model tier, money a million tokens in and out.
PRICES = {"1-URGENT": (10, 50), "2-HIGH": (5, 25), "3-MEDIUM": (3, 15), "4-NOT SPECIFIED": (1, 5), "5-LOW": (1, 5)}


@query("SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority IN ('1-URGENT', '2-HIGH')")
def open_positions_count(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "orders").filter((F.col("o_orderstatus") == "O") & F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).agg(F.count("*").alias("n"))


@query("SELECT o_orderpriority AS calendar, max(CASE WHEN o_orderstatus = 'F' THEN o_orderdate END) AS verified_through FROM orders GROUP BY 1")
def verified_horizon(spark: SparkSession, sf: str) -> DataFrame:
    """The greatest verified date, null if none is verified."""
    return load(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("calendar")).agg(F.max(F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate"))).alias("verified_through"))


@query("""SELECT doc_id % 10 AS suite, bool_and(quality = 1) AS all_passed, bool_or(toxic = 1) AS any_failed, count_if(quality = 1) AS n_pass, count_if(quality = 0) AS n_fail,
coalesce(string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) FILTER (toxic = 1), 'none') AS failed FROM labels GROUP BY 1""")
def check_summary(spark: SparkSession, sf: str) -> DataFrame:
    bad = F.col("toxic") == 1
    return load(spark, sf, "labels").groupBy((F.col("doc_id") % 10).alias("suite")).agg(
        F.bool_and(F.col("quality") == 1).alias("all_passed"), F.bool_or(bad).alias("any_failed"), F.count_if(F.col("quality") == 1).alias("n_pass"), F.count_if(F.col("quality") == 0).alias("n_fail"),
        F.coalesce(F.nullif(F.array_join(F.array_sort(F.collect_list(F.when(bad, F.col("doc_id")))), ","), F.lit("")), F.lit("none")).alias("failed"),
    )


@query("""WITH b AS (SELECT doc_id % 10 AS suite, doc_id, row_number() OVER (PARTITION BY doc_id % 10 ORDER BY doc_id) AS k FROM labels WHERE toxic = 1), f AS (SELECT suite, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS first_failed FROM b WHERE k <= 10 GROUP BY 1)
SELECT doc_id % 10 AS suite, count(*) AS n, count_if(toxic = 1) AS n_failed, coalesce(any_value(first_failed), 'none') AS first_failed FROM labels LEFT JOIN f ON f.suite = doc_id % 10 GROUP BY 1""")
def check_report(spark: SparkSession, sf: str) -> DataFrame:
    """Checks by suite: how many failed, and the first ten of them by name or "none"; ten a task and suite reach the shuffle."""
    c = load(spark, sf, "labels").select((F.col("doc_id") % 10).alias("suite"), "doc_id", (F.col("toxic") == 1).alias("bad"))
    k = F.row_number().over(Window.partitionBy("suite").orderBy("doc_id"))
    few = c.filter("bad").select("suite", "doc_id").withColumn("k", k).filter("k <= 10").groupBy("suite").agg(F.array_join(F.array_sort(F.collect_list("doc_id")), ",").alias("first_failed"))
    return c.groupBy("suite").agg(F.count("*").alias("n"), F.count_if("bad").alias("n_failed")).join(few, "suite", "left").withColumn("first_failed", F.coalesce("first_failed", F.lit("none")))


@query("""SELECT CAST(ts AS DATE) AS day, count_if(event_type = 'purchase') AS entry, count_if(event_type = 'view') AS risk_reducing, count_if(event_type = 'click') AS query FROM events GROUP BY 1""")
def calls_per_day_pivot(spark: SparkSession, sf: str) -> DataFrame:
    intent = F.when(F.col("event_type") == "purchase", "entry").when(F.col("event_type") == "view", "risk_reducing").when(F.col("event_type") == "click", "query")
    p = load(spark, sf, "events").select(F.to_date("ts").alias("day"), intent.alias("intent")).groupBy("day").pivot("intent", ["entry", "risk_reducing", "query"]).count()
    return p.na.fill(0)


@query("""SELECT strftime(o_orderdate, '%Y-%m') AS month, c_mktsegment AS agent, count(*) AS calls, CAST(sum(CAST(o_totalprice AS DECIMAL(18,4)) * CASE o_orderpriority WHEN '1-URGENT' THEN 10 WHEN '2-HIGH' THEN 5 WHEN '3-MEDIUM' THEN 3 ELSE 1 END) / 1000000 AS DOUBLE) AS spend
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2""")
def budget_by_month(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens times the price of the model tier, by month and agent."""
    price = F.coalesce(*(F.when(F.col("o_orderpriority") == k, F.lit(v[0])) for k, v in PRICES.items()))
    o = load(spark, sf, "orders").select("o_custkey", F.date_format("o_orderdate", "yyyy-MM").alias("month"), (money("o_totalprice") * price.cast("decimal(10,0)")).alias("cost"))
    c = load(spark, sf, "customer").select("c_custkey", F.col("c_mktsegment").alias("agent"))
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy("month", "agent").agg(F.count("*").alias("calls"), (F.sum("cost").cast("double") / 1000000).alias("spend"))


@query("""SELECT year(o_orderdate) AS yr, o_orderpriority AS tier, CAST(grouping(yr) AS INT) AS all_years, CAST(grouping(tier) AS INT) AS all_tiers, count(*) AS calls, CAST(sum(CAST(o_totalprice AS DECIMAL(18,4))) AS DOUBLE) AS spend
FROM orders GROUP BY ROLLUP (yr, tier)""")
def budget_rollup(spark: SparkSession, sf: str) -> DataFrame:
    o = load(spark, sf, "orders").select(F.year("o_orderdate").alias("yr"), F.col("o_orderpriority").alias("tier"), money("o_totalprice").alias("v"))
    return o.rollup("yr", "tier").agg(F.grouping("yr").cast("int").alias("all_years"), F.grouping("tier").cast("int").alias("all_tiers"), F.count("*").alias("calls"), F.sum("v").cast("double").alias("spend"))


@query("""WITH t AS (SELECT l_returnflag AS strategy, l_linestatus AS regime, CAST(l_extendedprice AS DECIMAL(18,4)) - 50000 AS pnl FROM lineitem)
SELECT strategy, regime, count(*) AS n_trades, round(CAST(count_if(pnl > 0) AS DOUBLE) / count(*), 6) AS hit_rate, CAST(sum(pnl) AS DOUBLE) AS net, CAST(min(pnl) AS DOUBLE) AS worst, CAST(max(pnl) AS DOUBLE) AS best, round(median(CAST(pnl AS DOUBLE)), 4) AS median_pnl FROM t GROUP BY 1, 2""")
def ledger_metrics(spark: SparkSession, sf: str) -> DataFrame:
    pnl = (money("l_extendedprice") - F.lit(50000).cast("decimal(18,4)")).alias("pnl")
    t = load(spark, sf, "lineitem").select(F.col("l_returnflag").alias("strategy"), F.col("l_linestatus").alias("regime"), pnl)
    # Counted by value first, so that no task holds more than a group's distinct results for its exact median.
    t = t.groupBy("strategy", "regime", "pnl").agg(F.count("*").alias("k"))
    wins = F.sum(F.when(F.col("pnl") > 0, F.col("k")).otherwise(0))
    return t.groupBy("strategy", "regime").agg(
        F.sum("k").alias("n_trades"), F.round(wins / F.sum("k"), 6).alias("hit_rate"), F.sum(F.col("pnl") * F.col("k")).cast("double").alias("net"), F.min("pnl").cast("double").alias("worst"),
        F.max("pnl").cast("double").alias("best"), F.round(F.percentile(F.col("pnl").cast("double"), 0.5, F.col("k")), 4).alias("median_pnl"),
    )


@query("""SELECT l_returnflag AS strategy, l_linestatus AS regime, CAST(grouping_id(l_returnflag, l_linestatus) AS INT) AS gid, count(*) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(18,4))) AS DOUBLE) AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)""")
def ledger_cube(spark: SparkSession, sf: str) -> DataFrame:
    t = load(spark, sf, "lineitem").select(F.col("l_returnflag").alias("strategy"), F.col("l_linestatus").alias("regime"), money("l_quantity").alias("q"))
    return t.cube("strategy", "regime").agg(F.grouping_id().cast("int").alias("gid"), F.count("*").alias("n"), F.sum("q").cast("double").alias("quantity"))


@query("""SELECT o_orderpriority AS tier, o_orderstatus AS state, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderpriority), (o_orderstatus), ())""")
def ledger_grouping_sets(spark: SparkSession, sf: str) -> DataFrame:
    o = load(spark, sf, "orders").select(F.col("o_orderpriority").alias("tier"), F.col("o_orderstatus").alias("state"))
    return o.groupingSets([["tier"], ["state"], []], "tier", "state").agg(F.count("*").alias("n"))


@query("""SELECT lang, count(*) AS n_items, count(DISTINCT source) AS n_domains, count(DISTINCT source) >= 2 AS corroborated FROM documents GROUP BY lang""")
def corroboration(spark: SparkSession, sf: str) -> DataFrame:
    """Topics with at least two distinct source domains."""
    return load(spark, sf, "documents").groupBy("lang").agg(F.count("*").alias("n_items"), F.count_distinct("source").alias("n_domains"), (F.count_distinct("source") >= 2).alias("corroborated"))


@query()
def corroboration_approximate(spark: SparkSession, sf: str) -> DataFrame:
    """The same by sketch: mergeable, of a fixed size for each group. Engines' sketches differ, so there is no oracle."""
    return load(spark, sf, "events").groupBy(F.to_date("ts").alias("day")).agg(F.approx_count_distinct("user_id", 0.02).alias("n_sources"))


@query("""SELECT o_custkey AS account, CAST(sum(CAST(o_totalprice AS DECIMAL(18,4))) FILTER (o_orderstatus = 'O') AS DOUBLE) AS deployed, coalesce(CAST(sum(CAST(o_totalprice AS DECIMAL(18,4))) FILTER (o_orderstatus = 'O') AS DOUBLE) <= 1000000, true) AS within_cap FROM orders GROUP BY 1""")
def exposure_sums(spark: SparkSession, sf: str) -> DataFrame:
    v = F.sum(F.when(F.col("o_orderstatus") == "O", money("o_totalprice"))).cast("double")
    return load(spark, sf, "orders").groupBy(F.col("o_custkey").alias("account")).agg(v.alias("deployed"), F.coalesce(v <= 1000000, F.lit(True)).alias("within_cap"))


@query("""WITH c AS (SELECT p_brand AS sector, l_suppkey AS account, count(DISTINCT l_partkey) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2) SELECT sector, account, n, n <= 2 AS within_cap FROM c""")
def sector_caps(spark: SparkSession, sf: str) -> DataFrame:
    pairs = load(spark, sf, "lineitem").select(F.col("l_suppkey").alias("account"), "l_partkey").distinct()
    p = load(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("sector"))
    return pairs.join(p, F.col("l_partkey") == F.col("p_partkey")).groupBy("sector", "account").agg(F.count("*").alias("n")).withColumn("within_cap", F.col("n") <= 2)


@query("""WITH d AS (SELECT o_custkey AS account, o_orderdate AS day, sum(CAST(o_totalprice AS DECIMAL(18,4)) - 150000) AS pnl FROM orders GROUP BY 1, 2)
SELECT account, day, CAST(20000 + sum(pnl) OVER (PARTITION BY account ORDER BY day) AS DOUBLE) AS equity FROM d""")
def equity_curve(spark: SparkSession, sf: str) -> DataFrame:
    """Base plus realised results so far, by account and day."""
    d = load(spark, sf, "orders").groupBy(F.col("o_custkey").alias("account"), F.col("o_orderdate").alias("day")).agg(F.sum(money("o_totalprice") - F.lit(150000).cast("decimal(18,4)")).alias("pnl"))
    run = F.sum("pnl").over(Window.partitionBy("account").orderBy("day"))
    return d.select("account", "day", (F.lit(20000).cast("decimal(18,4)") + run).cast("double").alias("equity"))


@query(f"""WITH {TICKS}, e AS (SELECT max(ts) AS as_of FROM ticks) SELECT instrument, round(sum(price * exp(-ln(2) * (epoch_us(as_of) - epoch_us(ts)) / 3600000000.0 / 24)), 4) AS score FROM ticks, e GROUP BY 1""")
def decayed_score(spark: SparkSession, sf: str) -> DataFrame:
    """Scores halved every 24 hours, as of the last tick; the end is one row and joins as such."""
    t = ticks(spark, sf).withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    end = t.agg(F.max("us").alias("as_of"))
    age = (F.col("as_of") - F.col("us")) / F.lit(3600000000.0) / 24
    return t.join(F.broadcast(end)).groupBy("instrument").agg(F.round(F.sum(F.col("price") * F.exp(-F.log(F.lit(2.0)) * age)), 4).alias("score"))


@query(f"""WITH {TICKS}, d AS (SELECT instrument, day, CAST(sum(CAST(price AS DECIMAL(18,4)) * qty) AS DOUBLE) AS traded FROM ticks GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY day DESC) AS k FROM d),
m AS (SELECT instrument, round(median(traded), 4) AS median_traded FROM r WHERE k <= 20 GROUP BY 1), w AS (SELECT *, row_number() OVER (ORDER BY median_traded DESC, instrument) AS place FROM m WHERE median_traded >= 500) SELECT instrument, median_traded, place FROM w WHERE place <= 50""")
def liquid_watchlist(spark: SparkSession, sf: str) -> DataFrame:
    """Instruments by the median traded value of their last 20 days, at least 500; the list holds 50."""
    d = ticks(spark, sf).groupBy("instrument", "day").agg(F.sum(F.col("price").cast("decimal(18,4)") * F.col("qty")).cast("double").alias("traded"))
    r = d.withColumn("k", F.row_number().over(Window.partitionBy("instrument").orderBy(F.desc("day")))).filter("k <= 20")
    m = r.groupBy("instrument").agg(F.round(F.median("traded"), 4).alias("median_traded")).filter("median_traded >= 500")
    top = m.orderBy(F.desc("median_traded"), "instrument").limit(50)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("median_traded"), "instrument")))
