"""Risk rules on inputs computed from the tables: one query a rule, each with every limit that the rule has.

Roles: a customer is an account, an order a trade (its price scaled to a notional), a line of an order a position's fill, delivery if
returned and intraday else, a part a symbol and its brand a sector; an event of type purchase is an entry call, an error a losing close.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.floats import quotient, rounded
from ..functions.money import cost_parts, total
from ..registry import query
from ..sources.config import limits, minutes
from ..sources.tables import TICKS, load, money, ticks

L = limits()
BASE = L["capital_base_inr"]


def signed(c: str = "o_totalprice") -> Column:
    """An order's result: its price against 150,000, a hundredth of it."""
    return ((money(c) - F.lit(150000).cast("decimal(18,4)")) / F.lit(100).cast("decimal(3,0)")).cast("decimal(18,6)")


SIGNED = "CAST((CAST(o_totalprice AS DECIMAL(18,4)) - 150000) / 100 AS DECIMAL(18,6))"


def day_results(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "orders").groupBy(F.col("o_custkey").alias("account"), F.to_date("o_orderdate").alias("day")).agg(F.sum(signed()).alias("result"))


DAYS = f"d AS (SELECT o_custkey AS account, CAST(o_orderdate AS DATE) AS day, sum({SIGNED}) AS result FROM orders GROUP BY 1, 2)"


@query(f"""WITH {DAYS} SELECT account, day, CAST(result AS DOUBLE) AS result, CASE WHEN result <= -1400 THEN 'forced_downgrade' WHEN result <= -1000 THEN 'frozen' ELSE 'none' END AS action FROM d""")
def rule_daily_loss(spark: SparkSession, sf: str) -> DataFrame:
    """A day's result against the base: at the soft limit entries freeze, at the hard one the mode steps down."""
    at = lambda rule: F.lit(BASE * L[rule]["day_mtm_pct"] / 100)
    r = F.col("result").cast("double")
    return day_results(spark, sf).select("account", "day", r.alias("result"), F.when(r <= at("daily_loss_hard"), "forced_downgrade").when(r <= at("daily_loss_soft"), "frozen").otherwise("none").alias("action"))


@query(f"""WITH {DAYS}, e AS (SELECT account, day, sum(result) OVER (PARTITION BY account ORDER BY day) AS pnl FROM d)
SELECT account, day, CAST(pnl AS DOUBLE) AS pnl, CASE WHEN pnl < -3000 THEN 'kill' WHEN pnl <= -2000 THEN 'go_flat' ELSE 'none' END AS action FROM e""")
def rule_equity_floors(spark: SparkSession, sf: str) -> DataFrame:
    """Equity so far against the base: at the rung all positions close, below the floor the kill sequence runs (strictly below)."""
    e = day_results(spark, sf).withColumn("pnl", F.sum("result").over(Window.partitionBy("account").orderBy("day")).cast("double"))
    p = F.col("pnl")
    rung, floor = BASE * L["equity_floor_rung"]["equity_pct_of_base"] / 100, BASE * L["cumulative_floor"]["equity_pct_of_base"] / 100
    return e.select("account", "day", p.alias("pnl"), F.when(p < floor, "kill").when(p <= rung, "go_flat").otherwise("none").alias("action"))


@query("""WITH t AS (SELECT l_orderkey, l_linenumber, l_returnflag = 'R' AS overnight, CAST(l_quantity AS BIGINT) AS qty, CAST(l_discount * 1000 AS BIGINT) AS stop FROM lineitem),
r AS (SELECT *, CASE WHEN overnight THEN 400.0 ELSE 200.0 END AS budget, CASE WHEN overnight THEN 2.5 ELSE 1.0 END * stop AS risk FROM t)
SELECT l_orderkey, l_linenumber, qty, CASE WHEN risk = 0 THEN qty ELSE least(qty, CAST(floor(budget / risk) AS BIGINT)) END AS allowed, CASE WHEN risk = 0 OR qty * risk <= budget THEN 'pass' WHEN budget < risk THEN 'reject' ELSE 'shrink' END AS verdict, count(*) AS n FROM r GROUP BY ALL""")
def rule_per_trade_risk(spark: SparkSession, sf: str) -> DataFrame:
    """Risk at the stop within one per cent of the base, two overnight, where the distance counts 2.5 times; too many units shrink, none is a refusal."""
    r = L["per_trade_risk"]
    night = F.col("l_returnflag") == "R"
    t = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("long").alias("qty"), F.when(night, BASE * r["swing_position_pct"] / 100).otherwise(BASE * r["intraday_pct"] / 100).alias("budget"),
                                           (F.when(night, r["overnight_gap_mult"]).otherwise(1.0) * (F.col("l_discount") * 1000).cast("long")).alias("risk"))
    q, b, k = F.col("qty"), F.col("budget"), F.col("risk")
    allowed = F.when(k == 0, q).otherwise(F.least(q, F.floor(F.try_divide(b, k)).cast("long")))
    verdict = F.when((k == 0) | (q * k <= b), "pass").when(b < k, "reject").otherwise("shrink")
    return t.groupBy("l_orderkey", "l_linenumber", "qty", allowed.alias("allowed"), verdict.alias("verdict")).agg(F.count("*").alias("n"))


@query("""WITH n AS (SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey, year(o_orderdate) ORDER BY o_orderdate, o_orderkey) AS nth FROM orders) SELECT o_orderkey, nth, nth <= 5 AS passed FROM n""")
def rule_max_new_trades(spark: SparkSession, sf: str) -> DataFrame:
    """The nth new trade of an account in a period (a year here: the test's accounts trade rarely) is refused beyond five."""
    n = F.row_number().over(Window.partitionBy("o_custkey", F.year("o_orderdate")).orderBy("o_orderdate", "o_orderkey"))
    return load(spark, sf, "orders").select("o_orderkey", n.alias("nth")).withColumn("passed", F.col("nth") <= L["max_new_trades_day"]["count"])


CHANGES = """f AS (SELECT l_suppkey AS account, CASE WHEN l_returnflag = 'R' THEN 'delivery' ELSE 'intraday' END AS product, CAST(l_shipdate AS DATE) AS opened, CAST(l_shipdate AS DATE) + CAST(l_linenumber AS INTEGER) AS closed FROM lineitem WHERE l_quantity >= 45),
c AS (SELECT account, product, opened AS day, 1 AS step FROM f UNION ALL SELECT account, product, closed, -1 FROM f), g AS (SELECT account, day, sum(step) AS all_, sum(CASE WHEN product = 'intraday' THEN step ELSE 0 END) AS i, sum(CASE WHEN product = 'delivery' THEN step ELSE 0 END) AS d FROM c GROUP BY 1, 2)"""


@query(f"""WITH {CHANGES}, r AS (SELECT account, day, CAST(sum(all_) OVER w AS BIGINT) AS total, CAST(sum(i) OVER w AS BIGINT) AS intraday, CAST(sum(d) OVER w AS BIGINT) AS delivery FROM g WINDOW w AS (PARTITION BY account ORDER BY day))
SELECT *, total <= 3 AND intraday <= 2 AND delivery <= 2 AS passed FROM r""")
def rule_max_open_positions(spark: SparkSession, sf: str) -> DataFrame:
    """Open positions by day as a running sum of openings and closings: three in all, two of a product."""
    x = L["max_open_positions"]
    f = load(spark, sf, "lineitem").filter("l_quantity >= 45").select(F.col("l_suppkey").alias("account"), (F.col("l_returnflag") == "R").alias("delivery"), F.to_date("l_shipdate").alias("opened"), F.col("l_linenumber").cast("int").alias("held"))
    steps = F.array(F.struct(F.col("opened").alias("day"), F.lit(1).alias("step")), F.struct(F.date_add("opened", F.col("held")).alias("day"), F.lit(-1).alias("step")))
    c = f.select("account", "delivery", F.inline(steps)).groupBy("account", "day").agg(F.sum("step").alias("a"), F.sum(F.when(~F.col("delivery"), F.col("step")).otherwise(0)).alias("i"), F.sum(F.when(F.col("delivery"), F.col("step")).otherwise(0)).alias("d"))
    w = Window.partitionBy("account").orderBy("day")
    r = c.select("account", "day", F.sum("a").over(w).alias("total"), F.sum("i").over(w).alias("intraday"), F.sum("d").over(w).alias("delivery"))
    return r.withColumn("passed", (F.col("total") <= x["total"]) & (F.col("intraday") <= x["max_mis"]) & (F.col("delivery") <= x["max_cnc"]))


@query("""WITH s AS (SELECT l_suppkey AS account, l_partkey AS symbol, count(DISTINCT l_orderkey) AS positions, CAST(coalesce(sum(CAST(l_extendedprice AS DECIMAL(18,4))) FILTER (l_returnflag = 'R'), 0) / 10 AS DOUBLE) AS notional FROM lineitem GROUP BY 1, 2)
SELECT account, symbol, positions, round(notional, 4) AS notional, positions <= 1 AS one_position, notional <= 8000 AS within_notional FROM s""")
def rule_per_stock_exposure(spark: SparkSession, sf: str) -> DataFrame:
    """By account and symbol: one position, and delivery notional (a tenth of the price here) within 8,000."""
    x = L["per_stock_exposure"]
    li = load(spark, sf, "lineitem")
    one = li.groupBy(F.col("l_suppkey").alias("account"), F.col("l_partkey").alias("symbol"), "l_orderkey").agg(F.sum(F.when(F.col("l_returnflag") == "R", money("l_extendedprice"))).alias("v"))
    s = one.groupBy("account", "symbol").agg(F.count("*").alias("positions"), (F.coalesce(F.sum("v"), F.lit(0)) / 10).cast("double").alias("notional"))
    return s.select("account", "symbol", "positions", F.round("notional", 4).alias("notional"), (F.col("positions") <= x["max_positions_per_symbol"]).alias("one_position"), (F.col("notional") <= x["cnc_notional_inr"]).alias("within_notional"))


@query("""WITH p AS (SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_brand END AS sector FROM part), c AS (SELECT l_suppkey AS account, sector, count(DISTINCT l_partkey) AS positions FROM lineitem LEFT JOIN p ON l_partkey = p_partkey GROUP BY 1, 2)
SELECT account, coalesce(sector, 'UNCLASSIFIED') AS sector, positions, positions <= CASE WHEN sector IS NULL THEN 1 ELSE 2 END AS passed FROM c""")
def rule_per_sector_exposure(spark: SparkSession, sf: str) -> DataFrame:
    """Two positions of a sector, one of the unclassified, which are those with no sector or no row at all."""
    x = L["per_sector_exposure"]
    pairs = load(spark, sf, "lineitem").select(F.col("l_suppkey").alias("account"), "l_partkey").distinct()
    p = load(spark, sf, "part").select("p_partkey", F.when(F.col("p_size") % 5 != 0, F.col("p_brand")).alias("sector"))
    c = pairs.join(p, F.col("l_partkey") == F.col("p_partkey"), "left").groupBy("account", "sector").agg(F.count("*").alias("positions"))
    return c.select("account", F.coalesce("sector", F.lit("UNCLASSIFIED")).alias("sector"), "positions", (F.col("positions") <= F.when(F.col("sector").isNull(), x["unclassified_cap"]).otherwise(x["max_positions_per_sector"])).alias("passed"))


@query("""WITH e AS (SELECT o_custkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,4))) AS DOUBLE) AS exposure FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)
SELECT c_custkey, round(exposure / c_acctbal, 6) AS leverage, c_acctbal > 0 AND exposure / c_acctbal <= 3.0 AS passed, CASE WHEN c_acctbal > 0 THEN round(least(exposure, 3.0 * c_acctbal), 4) ELSE 0 END AS allowed FROM customer JOIN e ON c_custkey = o_custkey""")
def rule_max_leverage(spark: SparkSession, sf: str) -> DataFrame:
    """Exposure over equity at most three; above it the exposure shrinks to the cap, without equity there is none. Over no equity leverage is infinite; over an unknown one it is unknown."""
    cap = L["max_leverage"]["platform_cap_x"]
    e = load(spark, sf, "orders").filter("o_orderstatus = 'O'").groupBy("o_custkey").agg(F.sum(money("o_totalprice")).cast("double").alias("exposure"))
    c = load(spark, sf, "customer").select("c_custkey", "c_acctbal").join(e, F.col("c_custkey") == F.col("o_custkey"))
    x, b = F.col("exposure"), F.col("c_acctbal")
    return c.select("c_custkey", rounded(quotient(x, b), 6).alias("leverage"), ((b > 0) & (quotient(x, b) <= cap)).alias("passed"), F.when(b > 0, rounded(F.least(x, cap * b), 4)).otherwise(0.0).alias("allowed"))


@query("""WITH t AS (SELECT event_id, user_id, event_type = 'view' AS delivery, event_type IN ('view', 'click') AS listed, hour(ts) * 60 + minute(ts) AS m, CAST(ts AS DATE) AS day FROM events WHERE event_type IN ('view', 'click', 'purchase')),
r AS (SELECT DISTINCT user_id AS u, CAST(ts AS DATE) AS d FROM events WHERE event_type = 'signup')
SELECT event_id, CASE WHEN u IS NOT NULL THEN 'results day' WHEN NOT CASE WHEN delivery THEN m BETWEEN 560 AND 900 ELSE m BETWEEN 570 AND 870 END THEN 'outside band' WHEN NOT delivery AND isodow(day) = 4 AND m >= 840 THEN 'expiry' END AS reason FROM t LEFT JOIN r ON user_id = u AND day = d""")
def rule_no_trade_windows(spark: SparkSession, sf: str) -> DataFrame:
    """No entry on a symbol's results day, outside its product's band, or intraday late on an expiry day (Thursdays); the first reason or null."""
    x = L["no_trade_windows"]
    e = load(spark, sf, "events")
    t = e.filter(F.col("event_type").isin("view", "click", "purchase")).select("event_id", "user_id", (F.col("event_type") == "view").alias("delivery"), (F.hour("ts") * 60 + F.minute("ts")).alias("m"), F.to_date("ts").alias("day"))
    r = e.filter("event_type = 'signup'").select("user_id", F.to_date("ts").alias("day"), F.lit(True).alias("results")).distinct()
    band = F.when(F.col("delivery"), F.col("m").between(minutes(x["cnc_entry_start"]), minutes(x["cnc_entry_end"]))).otherwise(F.col("m").between(minutes(x["mis_entry_start"]), minutes(x["mis_entry_end"])))
    late = ~F.col("delivery") & (F.weekday("day") == 3) & (F.col("m") >= minutes(x["nifty50_no_new_mis_after_on_expiry"]))
    why = F.when(F.col("results") & F.lit(x["no_entry_on_results_day"]), "results day").when(~band, "outside band").when(late, "expiry")
    return t.join(r, ["user_id", "day"], "left").select("event_id", why.alias("reason"))


KINDS = ["earnings_result", "order_win", "m_and_a", "pump", "other"]


@query("""WITH d AS (SELECT doc_id, lang, source, CAST(doc_id % 97 AS DOUBLE) / 97 AS sentiment, CAST(doc_id % 31 AS INTEGER) AS age_h, ['earnings_result', 'order_win', 'm_and_a', 'pump', 'other'][CAST(doc_id % 5 AS INTEGER) + 1] AS kind, doc_id % 11 AS topic FROM documents WHERE lang IS NOT NULL),
t AS (SELECT lang, topic, count(DISTINCT source) AS domains, avg(sentiment) AS sentiment, max(age_h) AS age_h, bool_and(kind IN ('earnings_result', 'order_win', 'm_and_a')) AS listed FROM d WHERE age_h <= 20 GROUP BY 1, 2),
o AS (SELECT *, domains >= 2 AND sentiment >= 0.30 AND age_h <= 20 AS grade FROM t), n AS (SELECT *, CASE WHEN grade THEN row_number() OVER (PARTITION BY lang, grade ORDER BY topic) END AS nth FROM o)
SELECT lang, topic, domains, round(sentiment, 6) AS sentiment, listed, grade, nth, coalesce(grade AND nth <= 2, false) AS entry FROM n""")
def rule_catalyst_guard(spark: SparkSession, sf: str) -> DataFrame:
    """Topics with two domains, a mean sentiment of 0.30 and a digest of at most 20 hours may originate; two entries a day (a language here);
    the closed list of types shows whether all its items are of a kind that may."""
    x = L["catalyst_guard"]
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.col("doc_id") % 5).cast("int") + 1)
    d = load(spark, sf, "documents").filter("lang is not null").select("lang", "source", ((F.col("doc_id") % 97).cast("double") / 97).alias("sentiment"), (F.col("doc_id") % 31).cast("int").alias("age_h"), kind.isin(*x["originating_event_types"]).alias("ok"), (F.col("doc_id") % 11).alias("topic"))
    d = d.filter(F.col("age_h") <= x["digest_stale_max_h"])
    t = d.groupBy("lang", "topic").agg(F.count_distinct("source").alias("domains"), F.avg("sentiment").alias("s"), F.max("age_h").alias("age_h"), F.bool_and("ok").alias("listed"))
    o = t.withColumn("grade", (F.col("domains") >= x["min_source_domains"]) & (F.col("s") >= x["sentiment_min_long"]) & (F.col("age_h") <= x["digest_stale_max_h"]))
    n = o.withColumn("nth", F.when(F.col("grade"), F.row_number().over(Window.partitionBy("lang", "grade").orderBy("topic"))))
    return n.select("lang", "topic", "domains", F.round("s", 6).alias("sentiment"), "listed", "grade", "nth", F.coalesce(F.col("grade") & (F.col("nth") <= x["max_catalyst_entries_day"]), F.lit(False)).alias("entry"))


@query(f"""WITH {TICKS}, h AS (SELECT DISTINCT instrument, CAST(epoch(date_trunc('hour', ts)) / 3600 AS BIGINT) AS k FROM ticks), i AS (SELECT instrument, k, k - row_number() OVER (PARTITION BY instrument ORDER BY k) AS island FROM h),
r AS (SELECT instrument, max(k) AS last, count(*) AS n FROM i GROUP BY instrument, island), l AS (SELECT instrument, arg_max(n, last) AS bars FROM r GROUP BY 1) SELECT instrument, bars, bars >= 30 AS ready FROM l""")
def rule_warmup_ready(spark: SparkSession, sf: str) -> DataFrame:
    """Bars without a gap up to the last one: the length of the last island of hours."""
    h = ticks(spark, sf).select("instrument", F.expr("unix_seconds(cast(date_trunc('hour', ts) as timestamp)) div 3600").alias("k")).distinct()
    i = h.withColumn("island", F.col("k") - F.row_number().over(Window.partitionBy("instrument").orderBy("k")))
    r = i.groupBy("instrument", "island").agg(F.max("k").alias("last"), F.count("*").alias("n")).groupBy("instrument").agg(F.max_by("n", "last").alias("bars"))
    return r.withColumn("ready", F.col("bars") >= L["choices"]["warmup_bars"])


@query(f"""WITH {TICKS} SELECT instrument, count(DISTINCT day) FILTER (kind = 'view') AS index_days, count(DISTINCT day) FILTER (kind = 'click') AS volatility_days, least(count(DISTINCT day) FILTER (kind = 'view'), count(DISTINCT day) FILTER (kind = 'click')) >= 20 AS ready FROM ticks GROUP BY 1""")
def rule_regime_data_ready(spark: SparkSession, sf: str) -> DataFrame:
    """Both histories, the index's and the volatility's, cover enough days."""
    days = lambda kind: F.count_distinct(F.when(F.col("kind") == kind, F.col("day")))
    t = ticks(spark, sf).groupBy("instrument").agg(days("view").alias("index_days"), days("click").alias("volatility_days"))
    return t.withColumn("ready", F.least("index_days", "volatility_days") >= L["choices"]["regime_days"])


@query("""WITH s AS (SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE value / 20 - 1 END AS skew FROM events) SELECT event_id, skew IS NOT NULL AND abs(skew) <= 2 AS passed, CASE WHEN skew IS NULL THEN 'unmeasured' WHEN abs(skew) > 2 THEN 'skewed' END AS reason FROM s""")
def rule_clock_skew(spark: SparkSession, sf: str) -> DataFrame:
    """A skew of over two seconds freezes entries, and so does one that can't be measured."""
    skew = F.abs(F.when(F.col("event_type") != "error", F.col("value") / 20 - 1))
    cap = L["clock_skew"]["max_skew_s"]
    return load(spark, sf, "events").select("event_id", F.coalesce(skew <= cap, F.lit(False)).alias("passed"), F.when(skew.isNull(), "unmeasured").when(skew > cap, "skewed").alias("reason"))


@query(f"""WITH {TICKS}, d AS (SELECT instrument, day, arg_max(price, (ts, id)) AS close FROM ticks GROUP BY 1, 2), b AS (SELECT instrument, day, lag(close) OVER (PARTITION BY instrument ORDER BY day) AS base, close FROM d),
c AS (SELECT *, base * 1.5 AS upper, base * 0.5 AS lower FROM b WHERE base > 0) SELECT instrument, day, round(100 * least(upper - close, close - lower) / close, 6) AS room_pct, close > 0 AND 100 * least(upper - close, close - lower) / close > 2.0 AND (instrument % 3 <> 0) AS intraday_ok, close > 0 AND 100 * least(upper - close, close - lower) / close > 2.0 AS delivery_ok FROM c WHERE close > 0""")
def rule_circuit_proximity(spark: SparkSession, sf: str) -> DataFrame:
    """No entry within two per cent of the day's price band (half around the last close: test prices scatter); intraday needs a listed derivative too."""
    from .windows import by_day, daily

    b = daily(spark, sf).select("instrument", "day", "close", F.lag("close").over(by_day()).alias("base")).filter("base > 0 and close > 0")
    room = 100 * F.least(F.col("base") * 1.5 - F.col("close"), F.col("close") - F.col("base") * 0.5) / F.col("close")
    ok = room > L["circuit_proximity"]["band_proximity_pct"]
    return b.select("instrument", "day", F.round(room, 6).alias("room_pct"), (ok & (F.col("instrument") % 3 != 0)).alias("intraday_ok"), ok.alias("delivery_ok"))


@query("""WITH h AS (SELECT l_orderkey, l_linenumber, l_returnflag = 'R' AS position, CAST(l_shipdate AS DATE) AS opened, CAST(l_shipdate AS DATE) + CAST(CAST(l_quantity AS INTEGER) * 4 AS INTEGER) AS seen FROM lineitem),
c AS (SELECT CAST(g AS DATE) AS day, CASE WHEN year(g) NOT BETWEEN 1995 AND 2002 THEN false WHEN isodow(g) >= 6 THEN CAST(g AS DATE) = DATE '1996-11-10' ELSE strftime(g, '%m-%d') NOT IN ('01-26', '05-01', '10-02', '12-25') END AS open FROM generate_series((SELECT min(opened) FROM h)::TIMESTAMP, (SELECT max(seen) FROM h)::TIMESTAMP, INTERVAL 1 DAY) t(g)),
x AS (SELECT day, CAST(sum(CASE WHEN open THEN 1 ELSE 0 END) OVER (ORDER BY day) AS BIGINT) AS k FROM c)
SELECT l_orderkey, l_linenumber, b.k - a.k AS held, b.k - a.k > CASE WHEN position THEN 120 ELSE 20 END AS over, count(*) AS n FROM h JOIN x a ON a.day = opened JOIN x b ON b.day = seen GROUP BY ALL""")
def rule_max_holding(spark: SparkSession, sf: str) -> DataFrame:
    """Trading days held: 20 for a swing, 120 for a position; the calendar spans the data's own days."""
    from ..functions.years import days
    from ..sources.config import calendar

    x = L["max_holding"]
    h = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_returnflag") == "R").alias("position"), F.to_date("l_shipdate").alias("opened"), F.date_add(F.to_date("l_shipdate"), F.col("l_quantity").cast("int") * 4).alias("seen"))
    lo, hi = h.agg(F.min("opened"), F.max("seen")).first()
    if lo is None:
        return h.select("l_orderkey", "l_linenumber", F.lit(0).cast("long").alias("held"), F.lit(False).alias("over"), F.lit(0).cast("long").alias("n"))
    cal = days(spark, calendar(), lo, hi).select("day", "session_index")
    a, b = (F.broadcast(cal.select(F.col("day").alias(d), F.col("session_index").alias(f"{d}_k"))) for d in ("opened", "seen"))  # one row a day
    j = h.join(a, "opened").join(b, "seen").withColumn("held", F.col("seen_k") - F.col("opened_k"))
    return j.groupBy("l_orderkey", "l_linenumber", "held", (F.col("held") > F.when(F.col("position"), x["position_trading_days"]).otherwise(x["swing_trading_days"])).alias("over")).agg(F.count("*").alias("n"))


@query("""WITH e AS (SELECT event_id, hour(ts) * 60 + minute(ts) AS m, event_type <> 'view' AS intraday FROM events) SELECT event_id, 625 - m AS minutes_left, NOT intraday OR 625 - m >= 10 AS passed FROM e""")
def rule_min_residual_window(spark: SparkSession, sf: str) -> DataFrame:
    """Intraday entries need ten minutes to the window's end less its buffer."""
    from ..sources.config import settings

    w = settings().trade_window
    left = F.lit(w.end - w.buffer_min) - (F.hour("ts") * 60 + F.minute("ts"))
    return load(spark, sf, "events").select("event_id", left.alias("minutes_left"), ((F.col("event_type") == "view") | (left >= L["min_residual_window"]["min_hold_min"])).alias("passed"))


@query("""WITH m AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY 1, 2) SELECT user_id, day, n, n <= 20 AS passed, n > 18 AS replace FROM m""")
def rule_order_modifications(spark: SparkSession, sf: str) -> DataFrame:
    """At most 20 changes of an order (an account's day here); past 18 it is cancelled and placed anew."""
    x = L["order_modifications"]
    m = load(spark, sf, "events").filter("event_type = 'click'").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return m.select("user_id", "day", "n", (F.col("n") <= x["self_cap"]).alias("passed"), (F.col("n") > L["choices"]["replace_after"]).alias("replace"))


@query("""WITH r AS (SELECT o_orderkey, o_custkey, CAST(o_totalprice AS DECIMAL(18,4)) / 50 AS need, sum(CAST(o_totalprice AS DECIMAL(18,4)) / 50) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS used FROM orders WHERE o_orderstatus = 'O')
SELECT o_orderkey, round(CAST((c_acctbal - coalesce(used, 0)) / need AS DOUBLE), 4) AS ratio, (c_acctbal - coalesce(CAST(used AS DOUBLE), 0)) / CAST(need AS DOUBLE) >= 1.1 AS passed FROM r JOIN customer ON o_custkey = c_custkey""")
def rule_margin_buffer(spark: SparkSession, sf: str) -> DataFrame:
    """Margin left after the orders before it is 1.1 times what an order needs (a fiftieth of its price)."""
    need = (money("o_totalprice") / F.lit(50).cast("decimal(2,0)")).cast("decimal(18,6)")
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, -1)
    o = load(spark, sf, "orders").filter("o_orderstatus = 'O'").select("o_orderkey", "o_custkey", need.cast("double").alias("need"), F.sum(need).over(w).cast("double").alias("used"))
    j = o.join(load(spark, sf, "customer").select("c_custkey", "c_acctbal"), F.col("o_custkey") == F.col("c_custkey"))
    ratio = (F.col("c_acctbal") - F.coalesce("used", F.lit(0.0))) / F.col("need")
    return j.select("o_orderkey", F.round(ratio, 4).alias("ratio"), (ratio >= L["margin_buffer"]["min_ratio"]).alias("passed"))


@query("""WITH c AS (SELECT l_orderkey, l_linenumber, CAST(l_extendedprice AS DECIMAL(18,4)) AS n, l_returnflag = 'R' AS delivery, l_tax FROM lineitem),
k AS (SELECT *, CASE WHEN delivery THEN 0 ELSE least(CAST(n * 0.0003 AS DECIMAL(24,8)), 20) END AS brokerage, CAST(n * 0.0000307 AS DECIMAL(24,8)) AS txn, CAST(n * 0.000001 AS DECIMAL(24,8)) AS sebi FROM c),
t AS (SELECT *, CAST(2 * (brokerage + txn + sebi + CAST((brokerage + txn + sebi) * 0.18 AS DECIMAL(24,8))) + CASE WHEN delivery THEN 2 * CAST(n * 0.001 AS DECIMAL(24,8)) + CAST(n * 0.00015 AS DECIMAL(24,8)) + 15.34 ELSE CAST(n * 0.00025 AS DECIMAL(24,8)) + CAST(n * 0.00003 AS DECIMAL(24,8)) END AS DOUBLE) AS round_trip FROM k)
SELECT l_orderkey, l_linenumber, round_trip AS breakeven, CAST(n AS DOUBLE) * l_tax / 20 >= 2.0 * round_trip AS passed, count(*) AS n FROM t GROUP BY ALL""")
def rule_min_viable_size(spark: SparkSession, sf: str) -> DataFrame:
    """The expected edge (a twentieth of the tax rate here) is twice the cost of buying and selling."""
    delivery, n = F.col("l_returnflag") == "R", money("l_extendedprice")
    trip = (total(cost_parts(n, delivery, F.lit(False))) + total(cost_parts(n, delivery, F.lit(True)))).cast("double")
    li = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", trip.alias("trip"), (n.cast("double") * F.col("l_tax") / 20).alias("edge"))
    return li.groupBy("l_orderkey", "l_linenumber", F.col("trip").alias("breakeven"), (F.col("edge") >= L["min_viable_size"]["edge_multiple_min_default"] * F.col("trip")).alias("passed")).agg(F.count("*").alias("n"))


@query("""WITH c AS (SELECT conv_id, turn, CAST(length(text) % 101 AS DOUBLE) / 100 AS confidence FROM conversations WHERE role = 'assistant') SELECT conv_id, turn, confidence, CASE WHEN confidence IS NOT NULL AND confidence >= 0.55 THEN 'proposal' ELSE 'no_action' END AS outcome FROM c""")
def rule_analyst_confidence(spark: SparkSession, sf: str) -> DataFrame:
    """Proposals below the least confidence, or without one, become no action."""
    c = (F.length("text") % 101).cast("double") / 100
    return load(spark, sf, "conversations").filter("role = 'assistant'").select("conv_id", "turn", c.alias("confidence"), F.when(c >= L["analyst_confidence_min"], "proposal").otherwise("no_action").alias("outcome"))
