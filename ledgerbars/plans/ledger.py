"""Ledgers: the degrade ladder, trades with costs and marks, the provenance chain, envelopes, rebalancing, indicators without Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.money import cost_parts, total
from ..functions.years import days
from ..registry import query
from ..sources.config import HERE, calendar, load_yaml
from ..sources.tables import TICKS, load, money
from .windows import DAILY, by_day, daily

AGENTS = load_yaml(HERE / "agents.yaml")
#: Which agent a market segment stands for here, and how many units of money one unit of an allocation is.
SEGMENTS = {"AUTOMOBILE": "intraday_analyst", "BUILDING": "nightly_reviewer", "FURNITURE": "weekly_researcher", "HOUSEHOLD": "news_analyst", "MACHINERY": "preopen_planner"}
UNIT = 200000


@query("""WITH o AS (SELECT c_mktsegment AS seg, CAST(o_orderdate AS DATE) AS day, CAST(o_totalprice AS DECIMAL(18,4)) AS v FROM orders JOIN customer ON o_custkey = c_custkey), d AS (SELECT seg, day, sum(v) AS v FROM o GROUP BY 1, 2),
r AS (SELECT seg, day, CAST(sum(v) OVER (PARTITION BY seg, date_trunc('month', day) ORDER BY day) AS DOUBLE) AS spend FROM d), w AS (SELECT day, sum(v) AS v FROM d GROUP BY 1), x AS (SELECT day, CAST(sum(v) OVER (PARTITION BY date_trunc('month', day) ORDER BY day) AS DOUBLE) AS whole FROM w),
a AS (SELECT seg, r.day, spend, whole, CASE seg WHEN 'AUTOMOBILE' THEN 42 WHEN 'BUILDING' THEN 20 WHEN 'FURNITURE' THEN 12 WHEN 'HOUSEHOLD' THEN 14 ELSE 5 END * 200000 AS alloc, CAST(day(r.day) AS DOUBLE) / day(last_day(r.day)) AS part FROM r JOIN x ON r.day = x.day)
SELECT seg, day, spend, CASE WHEN whole >= 20000000 THEN 'DG4' WHEN whole >= 19000000 THEN 'DG3' WHEN spend >= 1.25 * alloc * part OR whole >= 17000000 THEN 'DG2' WHEN spend >= 1.1 * alloc * part OR spend >= 0.85 * alloc THEN 'DG1' ELSE 'DG0' END AS tier FROM a""")
def degrade_ladder(spark: SparkSession, sf: str) -> DataFrame:
    """Spending by agent and day of a month against its allocation pro rata of the days gone, and all spending against the whole with its
    reserve: the most restrictive step that is reached. A day has at most one row an agent, so the windows are small."""
    ladder, parts = AGENTS["degrade_ladder"], AGENTS["budget_allocations_usd"]
    whole = sum(parts.values()) * UNIT
    share = F.coalesce(*(F.when(F.col("seg") == k, F.lit(parts[a] * UNIT)) for k, a in SEGMENTS.items()))
    o = load(spark, sf, "orders").select("o_custkey", F.to_date("o_orderdate").alias("day"), money("o_totalprice").alias("v"))
    c = load(spark, sf, "customer").select("c_custkey", F.col("c_mktsegment").alias("seg"))
    d = o.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy("seg", "day").agg(F.sum("v").alias("v"))
    month = F.trunc("day", "month")
    r = d.withColumn("spend", F.sum("v").over(Window.partitionBy("seg", month).orderBy("day")).cast("double"))
    x = d.groupBy("day").agg(F.sum("v").alias("v")).select("day", F.sum("v").over(Window.partitionBy(month).orderBy("day")).cast("double").alias("whole"))
    a = r.join(x, "day").withColumns({"alloc": share, "part": F.day("day").cast("double") / F.day(F.last_day("day"))})
    s, w, pro = F.col("spend"), F.col("whole"), F.col("alloc") * F.col("part")
    pct = lambda step, key: ladder[step][key] / 100
    tier = F.when(w >= pct("DG4", "global_alloc_pct") * whole, "DG4").when(w >= pct("DG3", "global_alloc_pct") * whole, "DG3").when((s >= pct("DG2", "pro_rata_pct") * pro) | (w >= pct("DG2", "global_alloc_pct") * whole), "DG2")
    tier = tier.when((s >= pct("DG1", "pro_rata_pct") * pro) | (s >= pct("DG1", "agent_alloc_pct") * F.col("alloc")), "DG1").otherwise("DG0")
    return a.select("seg", "day", "spend", tier.alias("tier"))


TRADES = """e AS (SELECT event_id, user_id, event_type, ts, CAST(value AS DECIMAL(18,4)) AS p FROM events), t AS (SELECT event_id, user_id, p AS entry, ts FROM e WHERE event_type = 'purchase'),
x AS (SELECT t.event_id, t.user_id, any_value(entry) AS entry, min(e.p) - any_value(entry) AS mae, max(e.p) - any_value(entry) AS mfe, arg_max(e.p, (e.ts, e.event_id)) AS last, count(*) AS n FROM t JOIN e ON e.user_id = t.user_id AND e.ts > t.ts AND e.ts <= t.ts + INTERVAL 1 DAY GROUP BY 1, 2)"""


def trades(spark: SparkSession, sf: str) -> DataFrame:
    """Entries with the ticks of the day after: worst and best move, the last price as the exit. A range frame, no join."""
    e = load(spark, sf, "events").withColumns({"s": F.unix_micros(F.col("ts").cast("timestamp")), "p": money("value")})
    w = Window.partitionBy("user_id").orderBy("s").rangeBetween(1, 86_400_000_000)
    e = e.withColumns({"lo": F.min("p").over(w), "hi": F.max("p").over(w), "last": F.max(F.struct("s", "event_id", "p")).over(w)["p"], "n": F.count("*").over(w)})
    return e.filter("event_type = 'purchase' and n > 0").select("event_id", "user_id", F.col("p").alias("entry"), (F.col("lo") - F.col("p")).alias("mae"), (F.col("hi") - F.col("p")).alias("mfe"), "last")


@query(f"""WITH {TRADES} SELECT user_id % 5 AS strategy, event_id % 2 = 0 AS is_paper, count(*) AS n, count_if(last > entry) AS wins, CAST(min(mae) AS DOUBLE) AS worst_mae, CAST(max(mfe) AS DOUBLE) AS best_mfe, CAST(sum(last - entry) AS DOUBLE) AS net,
CAST(sum(entry - round(entry, 0)) AS DOUBLE) AS slippage FROM x GROUP BY 1, 2""")
def ledger_of_trades(spark: SparkSession, sf: str) -> DataFrame:
    """The learning ledger by strategy, paper and live apart: adverse and favourable excursion, result, slippage against the wished (whole) price."""
    t = trades(spark, sf)
    slip = F.col("entry") - F.round("entry", 0)
    return t.groupBy((F.col("user_id") % 5).alias("strategy"), (F.col("event_id") % 2 == 0).alias("is_paper")).agg(
        F.count("*").alias("n"), F.count_if(F.col("last") > F.col("entry")).alias("wins"), F.min("mae").cast("double").alias("worst_mae"), F.max("mfe").cast("double").alias("best_mfe"), F.sum(F.col("last") - F.col("entry")).cast("double").alias("net"), F.sum(slip).cast("double").alias("slippage"),
    )


@query("""WITH f AS (SELECT l_suppkey AS account, CAST(l_shipdate AS DATE) AS day, CAST(l_extendedprice AS DECIMAL(18,4)) AS v, l_linestatus = 'O' AS open, l_returnflag = 'R' AS delivery FROM lineitem),
c AS (SELECT *, CASE WHEN delivery THEN 0 ELSE least(CAST(v * 0.0003 AS DECIMAL(24,8)), 20) END AS b, CAST(v * 0.0000307 AS DECIMAL(24,8)) AS t, CAST(v * 0.000001 AS DECIMAL(24,8)) AS s FROM f),
k AS (SELECT *, b + t + s + CAST((b + t + s) * 0.18 AS DECIMAL(24,8)) + CASE WHEN delivery THEN CAST(v * 0.001 AS DECIMAL(24,8)) + CAST(v * 0.00015 AS DECIMAL(24,8)) ELSE CAST(v * 0.00003 AS DECIMAL(24,8)) END AS cost FROM c),
d AS (SELECT account, day, sum(CASE WHEN open THEN 0 ELSE v - 36000 END) AS realised, sum(CASE WHEN open THEN v - 36000 ELSE 0 END) AS marks, sum(cost) AS costs FROM k GROUP BY 1, 2)
SELECT account, day, CAST(20000 + sum(realised) OVER w - sum(costs) OVER w + sum(marks) OVER w AS DOUBLE) AS equity, CAST(sum(costs) OVER w AS DOUBLE) AS costs FROM d WINDOW w AS (PARTITION BY account ORDER BY day)""")
def equity_with_costs(spark: SparkSession, sf: str) -> DataFrame:
    """Base plus realised results less costs plus the marks of what is open, by account and day. Combined by day before the window."""
    delivery, v, open_ = F.col("l_returnflag") == "R", money("l_extendedprice"), F.col("l_linestatus") == "O"
    gain = v - F.lit(36000).cast("decimal(18,4)")
    zero = F.lit(0).cast("decimal(18,4)")
    d = load(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("account"), F.to_date("l_shipdate").alias("day")).agg(
        F.sum(F.when(open_, zero).otherwise(gain)).alias("realised"), F.sum(F.when(open_, gain).otherwise(zero)).alias("marks"), F.sum(total(cost_parts(v, delivery, F.lit(False)))).alias("costs")
    )
    w = Window.partitionBy("account").orderBy("day")
    run = lambda c: F.sum(c).over(w).cast("decimal(30,8)")  # noqa: E731  # wider sums would lose places when added
    eq = (F.lit(20000).cast("decimal(30,8)") + run("realised") - run("costs") + run("marks")).cast("decimal(34,8)")
    return d.select("account", "day", eq.cast("double").alias("equity"), F.sum("costs").over(w).cast("double").alias("costs"))


@query("""WITH ev AS (SELECT user_id, count(*) AS n_events, count_if(event_type = 'error') AS n_rejected FROM events GROUP BY 1)
SELECT o_orderkey, c_custkey, c_mktsegment, coalesce(n_events, 0) AS n_events, coalesce(n_rejected, 0) = 0 AS approved, count(*) AS n_fills, count(DISTINCT l_partkey) AS n_positions, count(DISTINCT p_brand) AS n_sectors, count(DISTINCT s_nationkey) AS n_venues
FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN ev ON ev.user_id = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL""")
def provenance_chain_six(spark: SparkSession, sf: str) -> DataFrame:
    """Proposal (order) to verdict and events (of its account), fills (lines), positions (parts) and venues (suppliers): six tables. Lines
    are combined by order before they meet orders; events by account."""
    li = load(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    p, s = load(spark, sf, "part").select("p_partkey", "p_brand"), load(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    f = li.join(p, F.col("l_partkey") == F.col("p_partkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    f = f.groupBy("l_orderkey").agg(F.count("*").alias("n_fills"), F.count_distinct("l_partkey").alias("n_positions"), F.count_distinct("p_brand").alias("n_sectors"), F.count_distinct("s_nationkey").alias("n_venues"))
    ev = load(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("n_events"), F.count_if(F.col("event_type") == "error").alias("n_rejected"))
    o = load(spark, sf, "orders").select("o_orderkey", "o_custkey").join(load(spark, sf, "customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    j = o.join(f, F.col("o_orderkey") == F.col("l_orderkey")).join(ev, F.col("c_custkey") == F.col("user_id"), "left")
    return j.select("o_orderkey", "c_custkey", "c_mktsegment", F.coalesce("n_events", F.lit(0)).alias("n_events"), (F.coalesce("n_rejected", F.lit(0)) == 0).alias("approved"), "n_fills", "n_positions", "n_sectors", "n_venues")


@query("""WITH b AS (SELECT p_brand AS param, CAST(min(p_size) AS BIGINT) AS lo, CAST(max(p_size) AS BIGINT) AS hi FROM part WHERE p_partkey % 3 <> 0 GROUP BY 1), s AS (SELECT p_partkey, p_brand AS param, p_size AS value, sha256(p_brand || '|1|' || (CASE WHEN p_partkey % 2 = 0 THEN 50 ELSE 49 END)) AS bounds_sha FROM part)
SELECT p_partkey, s.param, bounds_sha = sha256(s.param || '|' || lo || '|' || hi) AS same_bounds, bounds_sha = sha256(s.param || '|' || lo || '|' || hi) AND value BETWEEN lo AND hi AS valid FROM s JOIN b ON s.param = b.param""")
def envelope_bounds_hash(spark: SparkSession, sf: str) -> DataFrame:
    """A parameter's value counts only under the bounds that it was set with: the digest kept with it must be that of the bounds of today."""
    p = load(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("param"), "p_size")
    b = p.filter("p_partkey % 3 <> 0").groupBy("param").agg(F.min("p_size").cast("long").alias("lo"), F.max("p_size").cast("long").alias("hi"))
    kept = F.sha2(F.concat_ws("|", "param", F.lit("1"), F.when(F.col("p_partkey") % 2 == 0, "50").otherwise("49")), 256)
    same = kept == F.sha2(F.concat_ws("|", "param", F.col("lo").cast("string"), F.col("hi").cast("string")), 256)
    return p.join(b, "param").select("p_partkey", "param", same.alias("same_bounds"), (same & F.col("p_size").between(F.col("lo"), F.col("hi"))).alias("valid"))


@query("""WITH b AS (SELECT r_regionkey AS band, 900 + 40 * r_regionkey AS lo, 1000 + 40 * r_regionkey AS hi FROM region) SELECT p_partkey, band FROM part JOIN b ON p_retailprice >= lo AND p_retailprice < hi""")
def theta_bands(spark: SparkSession, sf: str) -> DataFrame:
    """Prices and the bands that hold them, which overlap: a join on an inequality alone. The bands are checked to be few and then broadcast; were
    there many, prices and bands would meet by their hundreds, as an equi-join, with the inequality behind it."""
    p = load(spark, sf, "part").select("p_partkey", "p_retailprice")
    b = load(spark, sf, "region").select(F.col("r_regionkey").alias("band"), (900 + 40 * F.col("r_regionkey")).alias("lo"), (1000 + 40 * F.col("r_regionkey")).alias("hi"))
    inside = (F.col("p_retailprice") >= F.col("lo")) & (F.col("p_retailprice") < F.col("hi"))
    if b.limit(1001).count() <= 1000:
        return p.join(F.broadcast(b), inside).select("p_partkey", "band")
    cell = lambda c: F.floor(F.col(c) / 100)
    return p.withColumn("cell", cell("p_retailprice")).join(b.withColumn("cell", F.explode(F.sequence(cell("lo"), cell("hi")))), "cell").filter(inside).select("p_partkey", "band")


@query(f"""WITH {TICKS}, {DAILY}, m AS (SELECT instrument, day, close / nullif(lag(close, 5) OVER (PARTITION BY instrument ORDER BY day), 0) - 1 AS momentum FROM d), n AS (SELECT DISTINCT day FROM d), k AS (SELECT day, row_number() OVER (ORDER BY day) - 1 AS i FROM n),
r AS (SELECT m.instrument, k.day, k.i, m.momentum, row_number() OVER (PARTITION BY k.day ORDER BY momentum DESC, instrument) AS place FROM m JOIN k ON m.day = k.day WHERE momentum IS NOT NULL AND k.i % 5 = 0)
SELECT k.day, r.day AS rebalanced_on, r.instrument, r.place FROM k JOIN r ON r.i = k.i - k.i % 5 WHERE r.place <= 2""")
def momentum_rebalanced(spark: SparkSession, sf: str) -> DataFrame:
    """The two best by momentum, chosen every fifth day and held until the next choice. Days are few, a row each in one window."""
    d = daily(spark, sf).select("instrument", "day", "close")
    k = d.select("day").distinct().withColumn("i", F.row_number().over(Window.orderBy("day")) - 1)
    m = d.withColumn("momentum", F.try_divide("close", F.lag("close", 5).over(by_day())) - 1).filter("momentum is not null").select("instrument", "day", "momentum")
    chosen = m.join(F.broadcast(k.filter("i % 5 = 0")), "day").withColumn("place", F.row_number().over(Window.partitionBy("day").orderBy(F.desc("momentum"), "instrument"))).filter("place <= 2")
    held = k.select("day", (F.col("i") - F.col("i") % 5).alias("at"))
    return held.join(chosen.select(F.col("day").alias("rebalanced_on"), "i", "instrument", "place"), F.col("at") == F.col("i")).select("day", "rebalanced_on", "instrument", "place")


@query(f"""WITH {TICKS}, {DAILY}, c AS (SELECT CAST(g AS DATE) AS day, CASE WHEN year(g) <> 2024 THEN false WHEN isodow(g) >= 6 THEN CAST(g AS DATE) = DATE '2024-01-20' ELSE strftime(g, '%m-%d') NOT IN ('01-26', '05-01', '10-02', '12-25') END AS open FROM generate_series((SELECT min(day) FROM d)::TIMESTAMP, (SELECT max(day) FROM d)::TIMESTAMP, INTERVAL 1 DAY) t(g)),
x AS (SELECT day, CAST(sum(CASE WHEN open THEN 1 ELSE 0 END) OVER (ORDER BY day) AS BIGINT) AS k FROM c), l AS (SELECT *, lag(close) OVER w AS pre, lag(day) OVER w AS pre_day, avg(volume) OVER (PARTITION BY instrument ORDER BY day ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS usual FROM d WINDOW w AS (PARTITION BY instrument ORDER BY day))
SELECT instrument, l.day, round(100 * (close - pre) / pre, 4) AS move_pct, a.k - b.k AS age_sessions FROM l JOIN x a ON a.day = l.day JOIN x b ON b.day = l.pre_day WHERE pre > 0 AND usual > 0 AND 100 * abs(close - pre) / pre >= 1.0 AND volume >= 1.5 * usual AND a.k - b.k <= 2""")
def catalyst_signals(spark: SparkSession, sf: str) -> DataFrame:
    """Catalyst moves over the data's own span of days, ages in sessions of the year files; no bar is left out."""
    d = daily(spark, sf)
    lo, hi = d.agg(F.min("day"), F.max("day")).first()
    if lo is None:
        return d.select("instrument", "day", F.lit(0.0).alias("move_pct"), F.lit(0).cast("long").alias("age_sessions"))
    cal = F.broadcast(days(spark, calendar(), lo, hi).select("day", F.col("session_index").alias("k")))  # one row a day
    d = d.withColumns({"pre": F.lag("close").over(by_day()), "pre_day": F.lag("day").over(by_day()), "usual": F.avg("volume").over(by_day().rowsBetween(-5, -1))})
    move = F.col("close") - F.col("pre")
    j = d.join(cal, "day").join(cal.select(F.col("day").alias("pre_day"), F.col("k").alias("pre_k")), "pre_day").withColumn("age_sessions", F.col("k") - F.col("pre_k"))
    j = j.filter((F.col("pre") > 0) & (F.col("usual") > 0) & (F.col("age_sessions") <= 2)).filter((100 * F.abs(move) / F.col("pre") >= 1.0) & (F.col("volume") >= 1.5 * F.col("usual")))
    return j.select("instrument", "day", F.round(100 * move / F.col("pre"), 4).alias("move_pct"), "age_sessions")


@query("""SELECT user_id, (SELECT count(*) FROM (SELECT DISTINCT CAST(g AS DATE) AS day FROM generate_series((SELECT min(ts)::DATE::TIMESTAMP FROM events), max(e.ts)::DATE::TIMESTAMP, INTERVAL 1 DAY) t(g)) c WHERE CASE WHEN isodow(day) >= 6 THEN day = DATE '2024-01-20' ELSE strftime(day, '%m-%d') NOT IN ('01-26', '05-01', '10-02', '12-25') END)
- count(DISTINCT CASE WHEN isodow(ts) >= 6 THEN CASE WHEN CAST(ts AS DATE) = DATE '2024-01-20' THEN CAST(ts AS DATE) END WHEN strftime(ts, '%m-%d') NOT IN ('01-26', '05-01', '10-02', '12-25') THEN CAST(ts AS DATE) END) AS n_missing FROM events e GROUP BY 1""")
def backfill_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions of the data's own span that an instrument lacks up to its last day; the span's open days are one sorted array."""
    e = load(spark, sf, "events").select("user_id", F.to_date("ts").alias("day"))
    have = e.groupBy("user_id").agg(F.collect_set("day").alias("have"), F.max("day").alias("through"))
    lo, hi = e.agg(F.min("day"), F.max("day")).first()
    if lo is None:
        return have.select("user_id", F.lit(0).alias("n_missing"))
    span = days(spark, calendar(), lo, hi).filter("open").agg(F.array_sort(F.collect_list("day")).alias("span"))
    j = have.join(F.broadcast(span))
    return j.select("user_id", F.size(F.array_except(F.filter("span", lambda d: d <= F.col("through")), "have")).cast("long").alias("n_missing"))


def wilder(values: Column, n: int) -> Column:
    """Wilder's smoothing of an array at each place: a mean of the first ``n``, then (before * (n - 1) + now) / n; null before."""
    def step(acc: Column, x: Column) -> Column:
        k, before = acc["k"] + 1, acc["avg"]
        avg = F.when(k < n, before + x).when(k == n, (before + x) / n).otherwise((before * (n - 1) + x) / n)
        return F.struct(k.alias("k"), avg.alias("avg"), F.concat(acc["out"], F.array(F.when(k >= n, avg))).alias("out"))

    start = F.struct(F.lit(0).alias("k"), F.lit(0.0).alias("avg"), F.array().cast("array<double>").alias("out"))
    return F.aggregate(values, start, step)["out"]


@query(f"""WITH RECURSIVE {TICKS}, {DAILY}, c AS (SELECT instrument, day, close - lag(close) OVER (PARTITION BY instrument ORDER BY day) AS ch FROM d), s AS (SELECT instrument, day, greatest(ch, 0.0) AS up, greatest(-ch, 0.0) AS down, row_number() OVER (PARTITION BY instrument ORDER BY day) AS k FROM c WHERE ch IS NOT NULL),
r AS (SELECT a.instrument, b.day, CAST(2 AS BIGINT) AS k, (a.up + b.up) / 2 AS u, (a.down + b.down) / 2 AS w FROM s a JOIN s b ON a.instrument = b.instrument AND a.k = 1 AND b.k = 2 UNION ALL SELECT s.instrument, s.day, s.k, (r.u + s.up) / 2, (r.w + s.down) / 2 FROM r JOIN s ON s.instrument = r.instrument AND s.k = r.k + 1)
SELECT instrument, day, round(100 * u / (u + w), 4) AS rsi FROM r WHERE u + w > 0""")
def rsi_wilder(spark: SparkSession, sf: str) -> DataFrame:
    """RSI(2) with Wilder's smoothing, folded over an instrument's daily closes in the JVM: a series has a few hundred days a year."""
    d = daily(spark, sf).groupBy("instrument").agg(F.array_sort(F.collect_list(F.struct("day", "close"))).alias("s"))
    change = F.transform(F.slice("s", 2, F.size("s")), lambda x, i: x["close"] - F.col("s")[i]["close"])
    d = d.filter(F.size("s") > 1).select("instrument", F.slice(F.col("s")["day"], 2, F.size("s")).alias("days"), change.alias("ch"))
    up, down = wilder(F.transform("ch", lambda x: F.greatest(x, F.lit(0.0))), 2), wilder(F.transform("ch", lambda x: F.greatest(-x, F.lit(0.0))), 2)
    z = d.select("instrument", F.explode(F.arrays_zip(F.col("days").alias("day"), up.alias("u"), down.alias("w"))).alias("z")).select("instrument", "z.day", "z.u", "z.w")
    return z.filter("u is not null and u + w > 0").select("instrument", "day", F.round(100 * F.col("u") / (F.col("u") + F.col("w")), 4).alias("rsi"))


@query()
def adx_atr_wilder(spark: SparkSession, sf: str) -> DataFrame:
    """ATR(5) and ADX(5) with Wilder's smoothing: true ranges and directed moves of consecutive days, folded in the JVM; the second smoothing
    is of what the first gives. Tested against plain pandas."""
    n = 5
    d = daily(spark, sf).groupBy("instrument").agg(F.array_sort(F.collect_list(F.struct("day", "high", "low", "close"))).alias("s")).filter(F.size("s") > n)
    s = F.col("s")

    def moves(x: Column, i: Column) -> Column:
        up, down = x["high"] - s[i]["high"], s[i]["low"] - x["low"]
        tr = F.greatest(x["high"] - x["low"], F.abs(x["high"] - s[i]["close"]), F.abs(x["low"] - s[i]["close"]))
        return F.struct(x["day"].alias("day"), tr.alias("tr"), F.when((up > down) & (up > 0), up).otherwise(0.0).alias("plus"), F.when((down > up) & (down > 0), down).otherwise(0.0).alias("minus"))

    d = d.select("instrument", F.transform(F.slice("s", 2, F.size("s")), moves).alias("m"))
    d = d.select("instrument", F.col("m")["day"].alias("days"), *(wilder(F.col("m")[c], n).alias(c) for c in ("tr", "plus", "minus")))
    z = F.filter(F.arrays_zip("days", F.col("tr").alias("atr"), "plus", "minus"), lambda z: (z["plus"] + z["minus"]) > 0)
    d = d.select("instrument", z.alias("z"))
    dx = F.transform("z", lambda z: 100 * F.abs(z["plus"] - z["minus"]) / (z["plus"] + z["minus"]))
    d = d.select("instrument", F.explode(F.arrays_zip(F.col("z")["days"].alias("day"), F.col("z")["atr"].alias("atr"), wilder(dx, n).alias("adx"))).alias("r")).select("instrument", "r.day", "r.atr", "r.adx")
    return d.filter("adx is not null")
