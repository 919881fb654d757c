"""Window functions: gaps, transitions, drawdown, streaks, indicators, momentum."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.floats import quotient, rounded
from ..registry import query
from ..sources.tables import TICKS, load, money, ticks

DAILY = "d AS (SELECT instrument, day, arg_min(price, (ts, id)) AS open, max(price) AS high, min(price) AS low, arg_max(price, (ts, id)) AS close, CAST(sum(qty) AS BIGINT) AS volume FROM ticks GROUP BY 1, 2)"


def by_day():
    return Window.partitionBy("instrument").orderBy("day")


def daily(spark: SparkSession, sf: str) -> DataFrame:
    from .bars import ohlc

    return ohlc(ticks(spark, sf), "instrument", "day")


@query(f"WITH {TICKS}, {DAILY}, g AS (SELECT *, lag(close) OVER (PARTITION BY instrument ORDER BY day) AS pre FROM d) SELECT instrument, day, round((open - pre) / nullif(pre, 0), 6) AS gap FROM g WHERE pre IS NOT NULL")
def gap_returns(spark: SparkSession, sf: str) -> DataFrame:
    """Open against the close before; null where that is zero."""
    g = daily(spark, sf).withColumn("pre", F.lag("close").over(by_day())).filter("pre is not null")
    return g.select("instrument", "day", F.round(F.try_divide(F.col("open") - F.col("pre"), F.col("pre")), 6).alias("gap"))


@query(f"""WITH {TICKS}, {DAILY}, x AS (SELECT DISTINCT instrument, DATE '2024-01-15' AS ex_date FROM d),
a AS (SELECT x.instrument, arg_max(close, day) FILTER (day < ex_date) AS pre, arg_min(close, day) FILTER (day >= ex_date) AS post_close, arg_min(open, day) FILTER (day >= ex_date) AS post_open FROM x JOIN d ON d.instrument = x.instrument GROUP BY 1)
SELECT instrument, round((post_close - pre) / pre, 6) AS daily_gap, round((post_open - pre) / pre, 6) AS minute_gap,
CASE WHEN pre IS NULL OR post_close IS NULL OR pre = 0 THEN 'error' WHEN abs((post_close - pre) / pre) >= 0.08 THEN 'inconclusive' WHEN abs((post_open - pre) / pre) >= 0.08 THEN 'unadjusted' ELSE 'adjusted' END AS verdict FROM a""")
def exdate_gap_verdict(spark: SparkSession, sf: str) -> DataFrame:
    """Is the series adjusted for the ex-date? Last bar before against first on or after: close to close for the
    daily series, close to open for the minute series. Prices that are null are passed over; a close of zero gives infinite gaps or NaN."""
    ex = F.lit("2024-01-15").cast("date")
    before, after = F.col("day") < ex, F.col("day") >= ex
    at = F.when(F.col("price").isNotNull(), F.struct("ts", "id"))
    d = ticks(spark, sf).filter("instrument is not null").groupBy("instrument", "day").agg(F.min_by("price", at).alias("open"), F.max_by("price", at).alias("close"))
    pick = lambda f, v, c: f(v, F.when(c & F.col(v).isNotNull(), F.col("day")))
    a = d.groupBy("instrument").agg(pick(F.max_by, "close", before).alias("pre"), pick(F.min_by, "close", after).alias("post_close"), pick(F.min_by, "open", after).alias("post_open"))
    return verdict(a.withColumn("pre", F.col("pre") + 0.0))  # the SQL's arg_max has no negative zero


def verdict(a: DataFrame) -> DataFrame:
    """(pre, post_close, post_open) -> gaps and the tri-state decision at eight per cent."""
    gap = lambda post: quotient(F.col(post) - F.col("pre"), F.col("pre"))
    d, m = gap("post_close"), gap("post_open")
    v = F.when(F.col("pre").isNull() | F.col("post_close").isNull() | (F.col("pre") == 0), "error").when(F.abs(d) >= 0.08, "inconclusive").when(F.abs(m) >= 0.08, "unadjusted").otherwise("adjusted")
    return a.select("instrument", rounded(d, 6).alias("daily_gap"), rounded(m, 6).alias("minute_gap"), v.alias("verdict"))


@query("""WITH l AS (SELECT user_id, event_type AS state, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events),
legal(a, b) AS (VALUES ('signup', 'view'), ('view', 'click'), ('click', 'purchase'), ('view', 'purchase'), ('purchase', 'view'))
SELECT l.before AS from_state, l.state AS to_state, count(*) AS n, bool_or(legal.a IS NOT NULL) AS legal FROM l LEFT JOIN legal ON l.before = legal.a AND l.state = legal.b WHERE l.before IS NOT NULL GROUP BY 1, 2""")
def state_transitions(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    t = load(spark, sf, "events").select("user_id", "event_type", F.lag("event_type").over(w).alias("from_state")).filter("from_state is not null")
    legal = [("signup", "view"), ("view", "click"), ("click", "purchase"), ("view", "purchase"), ("purchase", "view")]
    ok = F.struct("from_state", "to_state").isin(*[F.struct(F.lit(a), F.lit(b)) for a, b in legal])
    return t.groupBy("from_state", F.col("event_type").alias("to_state")).agg(F.count("*").alias("n")).withColumn("legal", F.coalesce(ok, F.lit(False)))


@query(f"""WITH {TICKS}, {DAILY}, p AS (SELECT instrument, day, close, max(close) OVER (PARTITION BY instrument ORDER BY day ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS peak FROM d)
SELECT instrument, day, round((peak - close) / nullif(peak, 0), 6) AS drawdown, coalesce((peak - close) / nullif(peak, 0) >= 0.08, false) AS breach FROM p""")
def rolling_drawdown_5(spark: SparkSession, sf: str) -> DataFrame:
    p = daily(spark, sf).withColumn("peak", F.max("close").over(by_day().rowsBetween(-4, 0)))
    dd = F.try_divide(F.col("peak") - F.col("close"), F.col("peak"))
    return p.select("instrument", "day", F.round(dd, 6).alias("drawdown"), F.coalesce(dd >= 0.08, F.lit(False)).alias("breach"))


@query("""SELECT event_id, count(*) OVER w AS n_day, CAST(sum(CAST(value AS DECIMAL(18,4))) OVER w AS DOUBLE) AS value_day FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW)""")
def range_1d_activity(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("us").rangeBetween(-86_400_000_000, 0)
    e = load(spark, sf, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    return e.select("event_id", F.count("*").over(w).alias("n_day"), F.sum(money("value")).over(w).cast("double").alias("value_day"))


@query("""WITH r AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS island FROM events),
s AS (SELECT user_id, count(*) AS n FROM r WHERE event_type = 'error' GROUP BY user_id, island) SELECT user_id, max(n) AS longest FROM s GROUP BY user_id""")
def longest_error_streak(spark: SparkSession, sf: str) -> DataFrame:
    """Gaps and islands: the difference of two row numbers is constant in a streak."""
    o = ("ts", "event_id")
    island = F.row_number().over(Window.partitionBy("user_id").orderBy(*o)) - F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy(*o))
    r = load(spark, sf, "events").select("user_id", "event_type", island.alias("island")).filter("event_type = 'error'")
    return r.groupBy("user_id", "island").agg(F.count("*").alias("n")).groupBy("user_id").agg(F.max("n").alias("longest"))


@query(f"""WITH {TICKS}, c AS (SELECT instrument, day, ts, id, price < lag(price) OVER (PARTITION BY instrument, day ORDER BY ts, id) AS loss FROM ticks)
SELECT instrument, day, count(*) FILTER (loss) AS losses, count(*) FILTER (loss) >= 3 AS frozen FROM c GROUP BY 1, 2""")
def losses_per_session(spark: SparkSession, sf: str) -> DataFrame:
    """Losing closes of a session, consecutive or not."""
    loss = F.col("price") < F.lag("price").over(Window.partitionBy("instrument", "day").orderBy("ts", "id"))
    c = ticks(spark, sf).withColumn("loss", loss)
    return c.groupBy("instrument", "day").agg(F.count_if("loss").alias("losses"), (F.count_if("loss") >= 3).alias("frozen"))


@query(f"""WITH {TICKS}, {DAILY}, r AS (SELECT instrument, day, close / nullif(lag(close) OVER (PARTITION BY instrument ORDER BY day), 0) - 1 AS ret, row_number() OVER (PARTITION BY instrument ORDER BY day DESC) AS k FROM d),
q AS (SELECT * FROM r WHERE k <= 20 AND ret IS NOT NULL), o AS (SELECT instrument FROM d GROUP BY 1 ORDER BY sum(volume) DESC, instrument LIMIT 3)
SELECT a.instrument, b.instrument AS held, count(*) AS n, round(corr(a.ret, b.ret), 6) AS corr FROM q a JOIN q b ON a.day = b.day JOIN o ON b.instrument = o.instrument WHERE a.instrument <> b.instrument GROUP BY 1, 2 HAVING count(*) >= 5""")
def pair_correlation(spark: SparkSession, sf: str) -> DataFrame:
    """20-day return correlation of each instrument with the open positions: the position cap bounds those to
    three (the most traded here), so the join is not one of all pairs."""
    d = daily(spark, sf)
    ret = F.try_divide("close", F.lag("close").over(by_day())) - 1
    r = d.select("instrument", "day", ret.alias("ret"), F.row_number().over(Window.partitionBy("instrument").orderBy(F.desc("day"))).alias("k")).filter("k <= 20 and ret is not null")
    held = d.groupBy("instrument").agg(F.sum("volume").alias("v")).orderBy(F.desc("v"), "instrument").limit(3).select(F.col("instrument").alias("held"))
    h = r.join(F.broadcast(held), F.col("instrument") == F.col("held")).select("held", "day", F.col("ret").alias("held_ret"))
    j = r.join(h, "day").filter("instrument <> held")
    return j.groupBy("instrument", "held").agg(F.count("*").alias("n"), F.round(F.corr("ret", "held_ret"), 6).alias("corr")).filter("n >= 5")


@query(f"""WITH {TICKS}, {DAILY}, c AS (SELECT instrument, day, CAST(close AS DECIMAL(18,4)) - lag(CAST(close AS DECIMAL(18,4))) OVER (PARTITION BY instrument ORDER BY day) AS ch FROM d),
g AS (SELECT *, sum(greatest(ch, 0)) OVER w AS gain, sum(greatest(-ch, 0)) OVER w AS loss, count(ch) OVER w AS n FROM c WINDOW w AS (PARTITION BY instrument ORDER BY day ROWS BETWEEN 1 PRECEDING AND CURRENT ROW))
SELECT instrument, day, round(100 * CAST(gain AS DOUBLE) / nullif(CAST(gain + loss AS DOUBLE), 0), 4) AS rsi2 FROM g WHERE n = 2""")
def rsi2_simple(spark: SparkSession, sf: str) -> DataFrame:
    """RSI of two sessions with simple averages; null without movement."""
    w = by_day().rowsBetween(-1, 0)
    c = daily(spark, sf).withColumn("ch", money("close") - F.lag(money("close")).over(by_day()))
    zero = F.lit(0).cast("decimal(18,4)")
    c = c.withColumns({"gain": F.sum(F.greatest("ch", zero)).over(w), "loss": F.sum(F.greatest(-F.col("ch"), zero)).over(w), "n": F.count("ch").over(w)}).filter("n = 2")
    g, lo = F.col("gain").cast("double"), F.col("loss").cast("double")
    return c.select("instrument", "day", F.round(100 * F.try_divide(g, g + lo), 4).alias("rsi2"))


# The recursive indicators of one instrument in plain pandas, to hold the queries against (plans/ledger.py folds them in the JVM).
def wilder(s: pd.Series, n: int) -> pd.Series:
    """Wilder's smoothing: a mean of the first n, then (before * (n - 1) + now) / n."""
    out, avg = [], None
    for i, x in enumerate(s):
        avg = s.iloc[: i + 1].mean() if i + 1 <= n else (avg * (n - 1) + x) / n
        out.append(avg if i + 1 >= n else float("nan"))
    return pd.Series(out, index=s.index)


def rsi_frame(pdf: pd.DataFrame) -> pd.DataFrame:
    n = 2
    p = pdf.sort_values("day").reset_index(drop=True)
    ch = p["close"].diff().iloc[1:]
    up, down = wilder(ch.clip(lower=0), n), wilder((-ch).clip(lower=0), n)
    rsi = (100 * up / (up + down)).where(up + down > 0)
    return pd.DataFrame({"instrument": p["instrument"].iloc[1:], "day": p["day"].iloc[1:], "rsi": rsi}).dropna()


def adx_frame(pdf: pd.DataFrame) -> pd.DataFrame:
    n = 5
    p = pdf.sort_values("day").reset_index(drop=True)
    up, down = p["high"].diff(), -p["low"].diff()
    before = p["close"].shift()
    tr = pd.concat([p["high"] - p["low"], (p["high"] - before).abs(), (p["low"] - before).abs()], axis=1).max(axis=1).iloc[1:]
    plus, minus = up.where((up > down) & (up > 0), 0.0).iloc[1:], down.where((down > up) & (down > 0), 0.0).iloc[1:]
    atr, a, b = wilder(tr, n), wilder(plus, n), wilder(minus, n)
    dx = (100 * (a - b).abs() / (a + b)).where(a + b > 0).dropna()
    out = pd.DataFrame({"instrument": p["instrument"], "day": p["day"], "atr": atr, "adx": wilder(dx, n)})
    return out.dropna()


@query(f"""WITH {TICKS}, {DAILY}, i AS (SELECT instrument, day, CAST(round(high * 10000) AS BIGINT) AS high, CAST(round(low * 10000) AS BIGINT) AS low, CAST(round(close * 10000) AS BIGINT) AS close FROM d),
l AS (SELECT *, lag(close) OVER (PARTITION BY instrument ORDER BY day) AS pre FROM i), t AS (SELECT instrument, day, close, greatest(high - low, coalesce(abs(high - pre), 0), coalesce(abs(low - pre), 0)) AS tr FROM l),
w AS (SELECT *, CAST(sum(tr) OVER w AS BIGINT) AS s, count(*) OVER w AS n, max(close) OVER w AS top FROM t WINDOW w AS (PARTITION BY instrument ORDER BY day ROWS BETWEEN 13 PRECEDING AND CURRENT ROW))
SELECT instrument, day, CAST(s // n AS DOUBLE) / 10000 AS atr, CAST(top - (5 * s) // (2 * n) AS DOUBLE) / 10000 AS trail_stop FROM w""")
def atr_trailing_stop(spark: SparkSession, sf: str) -> DataFrame:
    """Mean true range of 14 sessions and a stop 2.5 of it below the highest close, in whole ten-thousandths."""
    whole = lambda c: F.round(F.col(c) * 10000).cast("long").alias(c)
    d = daily(spark, sf).select("instrument", "day", whole("high"), whole("low"), whole("close")).withColumn("pre", F.lag("close").over(by_day()))
    tr = F.greatest(F.col("high") - F.col("low"), F.coalesce(F.abs(F.col("high") - F.col("pre")), F.lit(0)), F.coalesce(F.abs(F.col("low") - F.col("pre")), F.lit(0)))
    w = by_day().rowsBetween(-13, 0)
    d = d.withColumn("tr", tr).withColumns({"s": F.sum("tr").over(w), "n": F.count("*").over(w), "top": F.max("close").over(w)})
    return d.select("instrument", "day", (F.expr("s div n").cast("double") / 10000).alias("atr"), (F.expr("top - (5 * s) div (2 * n)").cast("double") / 10000).alias("trail_stop"))


@query(f"""WITH {TICKS}, {DAILY}, m AS (SELECT instrument, day, close / nullif(lag(close, 5) OVER (PARTITION BY instrument ORDER BY day), 0) - 1 AS momentum FROM d),
r AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY momentum DESC, instrument) AS place FROM m WHERE momentum IS NOT NULL) SELECT instrument, day, round(momentum, 6) AS momentum, place FROM r WHERE place <= 2""")
def momentum_top_n(spark: SparkSession, sf: str) -> DataFrame:
    m = daily(spark, sf).select("instrument", "day", (F.try_divide("close", F.lag("close", 5).over(by_day())) - 1).alias("momentum")).filter("momentum is not null")
    r = m.withColumn("place", F.row_number().over(Window.partitionBy("day").orderBy(F.desc("momentum"), "instrument"))).filter("place <= 2")
    return r.select("instrument", "day", F.round("momentum", 6).alias("momentum"), "place")


@query("""WITH g AS (SELECT user_id, event_id, event_id - lag(event_id) OVER w AS step, epoch_us(ts) - epoch_us(lag(ts) OVER w) AS silence FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT user_id, count(*) FILTER (step > 1) AS n_gaps, max(step) AS longest_step, count(*) FILTER (silence > 86400000000) AS n_silent FROM g GROUP BY 1""")
def heartbeat_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """Jumps of a sequence number, and silences of over a day (seconds in a live feed)."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    g = load(spark, sf, "events").select("user_id", (F.col("event_id") - F.lag("event_id").over(w)).alias("step"), (us - F.lag(us).over(w)).alias("silence"))
    return g.groupBy("user_id").agg(F.count_if(F.col("step") > 1).alias("n_gaps"), F.max("step").alias("longest_step"), F.count_if(F.col("silence") > 86_400_000_000).alias("n_silent"))


@query(f"WITH {TICKS} SELECT instrument, id, ts, price, place FROM (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY ts DESC, id DESC) AS place FROM ticks) WHERE place <= 3")
def latest_k_per_instrument(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("instrument").orderBy(F.desc("ts"), F.desc("id"))
    return ticks(spark, sf).withColumn("place", F.row_number().over(w)).filter("place <= 3").select("instrument", "id", "ts", "price", "place")


@query("""SELECT o_custkey, o_orderkey, rank() OVER w AS rank, dense_rank() OVER w AS dense_rank, ntile(4) OVER w2 AS quartile, round(percent_rank() OVER w, 6) AS percent_rank, round(cume_dist() OVER w, 6) AS cume_dist
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderpriority), w2 AS (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderkey)""")
def rank_family(spark: SparkSession, sf: str) -> DataFrame:
    w, w2 = Window.partitionBy("o_custkey").orderBy("o_orderpriority"), Window.partitionBy("o_custkey").orderBy("o_orderpriority", "o_orderkey")
    return load(spark, sf, "orders").select("o_custkey", "o_orderkey", F.rank().over(w).alias("rank"), F.dense_rank().over(w).alias("dense_rank"), F.ntile(4).over(w2).alias("quartile"), F.round(F.percent_rank().over(w), 6).alias("percent_rank"), F.round(F.cume_dist().over(w), 6).alias("cume_dist"))
