"""Control plane: calendars from files, configuration, migrations, guarded writes, messages, challenges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.messages import KINDS, joined, report
from ..functions.years import days, is_open, next_or_error, session, trade_window
from ..operators.lifecycle import as_of, start
from ..operators.state import latest
from ..registry import query
from ..sources import store
from ..sources.config import calendar, limits, settings
from ..sources.files import scratch
from ..sources.tables import load

#: What the shipped year files say, written out for DuckDB: years, special and shortened sessions, holidays of any year.
KNOWN = "(1995, 1996, 1997, 1998, 1999, 2000, 2001, 2002, 2024, 2026)"
OPEN = f"""CASE WHEN year({{0}}) NOT IN {KNOWN} THEN false WHEN isodow({{0}}) >= 6 THEN {{0}} IN (DATE '1996-11-10', DATE '2024-01-20', DATE '2026-11-08') WHEN strftime({{0}}, '%m-%d') IN ('01-26', '05-01', '10-02', '12-25') THEN false ELSE true END"""
STRICT = OPEN.replace("ELSE true END", "ELSE {0} <= DATE '1996-06-30' END")
SPECIAL, SHORT = "{0} IN (DATE '1996-11-10', DATE '2024-01-20', DATE '2026-11-08')", "{0} IN (DATE '1996-12-24', DATE '2024-01-25')"
#: Days far outside the data, so that unknown years and both kinds of sessions are met: an order's date, moved by 0 to 27 years.
MOVED = "d AS (SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) + to_years(CAST(o_orderkey % 3 AS INTEGER) * 14) AS DATE) AS day FROM orders)"


def moved(spark: SparkSession, sf: str) -> DataFrame:
    day = F.add_months(F.to_date("o_orderdate"), (F.col("o_orderkey") % 3).cast("int") * 168)
    return load(spark, sf, "orders").select("o_orderkey", day.alias("day"))


@query(f"WITH {MOVED} SELECT o_orderkey, day, {OPEN.format('day')} AS open, {STRICT.format('day')} AS open_strict FROM d")
def calendar_trading_days(spark: SparkSession, sf: str) -> DataFrame:
    """Trading days from year files; years without a file are closed, strict mode asks for verified ones."""
    years, day = calendar(), F.col("day")
    return moved(spark, sf).select("o_orderkey", "day", is_open(day, years).alias("open"), is_open(day, years, strict=True).alias("open_strict"))


@query(f"""WITH s AS (SELECT DISTINCT CAST(g AS DATE) AS day FROM generate_series((SELECT min(o_orderdate) FROM orders), (SELECT max(o_orderdate) FROM orders), INTERVAL 1 DAY) t(g))
SELECT day, CASE WHEN {SPECIAL.format('day')} OR {SHORT.format('day')} OR true THEN 555 END AS open, CASE WHEN {SPECIAL.format('day')} THEN 615 WHEN day = DATE '1996-12-24' THEN 750 WHEN day = DATE '2024-01-25' THEN 780 ELSE 930 END AS close,
{SPECIAL.format('day')} AS special, {SHORT.format('day')} AS shortened FROM s WHERE {OPEN.format('day')}""")
def calendar_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions of every trading day between the data's first and last: special times beat shortened ones beat the regular ones."""
    years = calendar()
    lo, hi = load(spark, sf, "orders").agg(F.to_date(F.min("o_orderdate")), F.to_date(F.max("o_orderdate"))).first()
    d = days(spark, years, lo, hi) if lo else days(spark, years, *[next(iter(years.values())).verified_through] * 2).limit(0)
    return d.withColumn("s", session(F.col("day"), years)).filter("s is not null").select("day", "s.open", "s.close", "s.special", "s.shortened")


@query(f"""WITH e AS (SELECT event_id, CAST(ts AS DATE) AS day, CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(event_id % 700 + 400 AS INTEGER) END AS a, CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(event_id % 500 + 650 AS INTEGER) END AS b FROM events),
w AS (SELECT event_id, day, a IS NOT NULL AND b IS NOT NULL AS stored, greatest(CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN a ELSE 600 END, 555) AS lo, least(CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN b ELSE 630 END, CASE WHEN {SPECIAL.format('day')} THEN 615 WHEN {SHORT.format('day')} THEN 780 ELSE 930 END) AS hi FROM e WHERE {OPEN.format('day')})
SELECT event_id, lo AS start, hi AS "end", CASE WHEN stored THEN 3 ELSE 5 END AS buffer, lo < hi AS tradable FROM w""")
def calendar_trade_windows(spark: SparkSession, sf: str) -> DataFrame:
    """The stored window if both of its ends are set, else the seed, within the day's session; an inverted one is empty."""
    i = F.col("event_id")
    e = load(spark, sf, "events").select("event_id", F.to_date("ts").alias("day"), F.when(i % 3 != 0, (i % 700 + 400).cast("int")).alias("a"), F.when(i % 5 != 0, (i % 500 + 650).cast("int")).alias("b"))
    w = trade_window(F.col("day"), calendar(), settings().trade_window, F.col("a"), F.col("b"), F.lit(3))
    return e.withColumn("w", w).filter("w is not null").select("event_id", "w.start", "w.end", "w.buffer", "w.tradable")


@query(f"""WITH c AS (SELECT CAST(g AS DATE) AS day FROM generate_series((SELECT min(o_orderdate)::DATE::TIMESTAMP FROM orders), (SELECT max(o_orderdate)::DATE::TIMESTAMP + INTERVAL 370 DAY FROM orders), INTERVAL 1 DAY) t(g)), o AS (SELECT day FROM c WHERE {OPEN.format('day')})
SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, o.day AS next_day FROM orders ASOF LEFT JOIN o ON o.day > CAST(o_orderdate AS DATE)""")
def next_trading_day(spark: SparkSession, sf: str) -> DataFrame:
    """The next trading day within 370 days, over the data's own span; a day without one is an error."""
    o = load(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    lo, hi = o.agg(F.min("day"), F.max("day")).first()
    if lo is None:
        return o.withColumn("next_day", F.col("day"))
    cal = F.broadcast(days(spark, calendar(), lo, hi).select("day", "next_day"))  # one row a day
    return o.join(cal, "day").select("o_orderkey", "day", next_or_error(F.col("next_day"), F.col("day")).alias("next_day"))


@query(f"""WITH c AS (SELECT CAST(g AS DATE) AS day FROM generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-31', INTERVAL 1 DAY) t(g)), j(job, minute) AS (VALUES ('bars', 960), ('plan', 530), ('review', 1260), ('scan', 600), ('scan', 602)),
s AS (SELECT job, CAST(day AS TIMESTAMP) + to_minutes(minute) AS due FROM c, j WHERE {OPEN.format('day')}), k AS (SELECT job, due, (SELECT min(ts) FROM events WHERE user_id % 10 = 0 AND ts >= due) AS woke FROM s)
SELECT job, due, CASE WHEN woke IS NULL OR epoch_us(woke) - epoch_us(due) > 300000000 THEN 'misfired' WHEN row_number() OVER (PARTITION BY job, woke ORDER BY due DESC) > 1 THEN 'coalesced' ELSE 'ran' END AS outcome FROM k""")
def scheduled_runs_misfire(spark: SparkSession, sf: str) -> DataFrame:
    """Runs due on trading days, at the first time after that the engine was awake: over 300 s late they are missed, several of a job at one
    time are one. Wake times and due times meet in one window of all, which only the few of one engine pass through."""
    jobs = F.array(*(F.struct(F.lit(n).alias("job"), F.lit(m).alias("minute")) for n, m in (("bars", 960), ("plan", 530), ("review", 1260), ("scan", 600), ("scan", 602))))
    month = spark.range(1).select(F.explode(F.sequence(F.lit("2024-01-01").cast("date"), F.lit("2024-01-31").cast("date"))).alias("day")).filter(is_open(F.col("day"), calendar()))
    s = month.select(F.explode(jobs).alias("j"), "day").select(F.col("j.job"), (F.col("day").cast("timestamp_ntz") + F.make_dt_interval(mins=F.col("j.minute"))).alias("due"))
    near = load(spark, sf, "events").filter("user_id % 10 = 0").select(F.to_date("ts").alias("day"), "ts")
    # Only a wake-up of the due day or the next within 300 s counts, so a day's first ones after each due time are enough.
    d = s.withColumn("until", F.col("due") + F.expr("INTERVAL 300 SECONDS")).withColumn("day", F.explode(F.array_distinct(F.array(F.to_date("due"), F.to_date("until")))))
    hit = d.join(near, "day").filter((F.col("ts") >= F.col("due")) & (F.col("ts") <= F.col("until"))).groupBy("job", "due").agg(F.min("ts").alias("woke"))
    k = s.join(hit, ["job", "due"], "left")
    nth = F.row_number().over(Window.partitionBy("job", "woke").orderBy(F.desc("due")))
    return k.select("job", "due", F.when(F.col("woke").isNull(), "misfired").when(nth > 1, "coalesced").otherwise("ran").alias("outcome"))


@query("""SELECT rule, name, CAST(value AS DOUBLE) AS value FROM (VALUES ('capital_cap', 'max_deployed_capital_inr', 20000), ('per_trade_risk', 'intraday_pct', 1), ('per_trade_risk', 'swing_position_pct', 2), ('per_trade_risk', 'overnight_gap_mult', 2.5), ('daily_loss_soft', 'day_mtm_pct', -5), ('daily_loss_hard', 'day_mtm_pct', -7),
('weekly_drawdown', 'rolling_sessions', 5), ('weekly_drawdown', 'drawdown_pct', 8), ('equity_floor_rung', 'equity_pct_of_base', -10), ('cumulative_floor', 'equity_pct_of_base', -15), ('consecutive_losses', 'max_per_session', 3), ('max_new_trades_day', 'count', 5), ('max_open_positions', 'total', 3),
('max_open_positions', 'max_mis', 2), ('max_open_positions', 'max_cnc', 2), ('per_stock_exposure', 'max_positions_per_symbol', 1), ('per_stock_exposure', 'cnc_notional_inr', 8000), ('per_sector_exposure', 'max_positions_per_sector', 2), ('per_sector_exposure', 'unclassified_cap', 1),
('co_movement_cap', 'corr_max', 0.7), ('max_leverage', 'platform_cap_x', 3), ('catalyst_guard', 'min_source_domains', 2), ('catalyst_guard', 'sentiment_min_long', 0.3), ('catalyst_guard', 'max_catalyst_entries_day', 2), ('catalyst_guard', 'digest_stale_max_h', 20), ('stale_data_guard', 'max_tick_age_s', 5),
('stale_data_guard', 'feed_heartbeat_silence_s', 10), ('clock_skew', 'max_skew_s', 2), ('entry_sanity_band', 'mis_pct', 1), ('entry_sanity_band', 'cnc_pct', 2), ('circuit_proximity', 'band_proximity_pct', 2), ('max_holding', 'swing_trading_days', 20), ('max_holding', 'position_trading_days', 120),
('min_residual_window', 'min_hold_min', 10), ('order_rate', 'sustained_per_s', 1), ('order_rate', 'burst', 2), ('order_rate', 'entry_calls_per_day', 70), ('order_modifications', 'self_cap', 20), ('margin_buffer', 'min_ratio', 1.1), ('min_viable_size', 'edge_multiple_min_default', 2),
('choices', 'warmup_bars', 30), ('choices', 'regime_days', 20), ('choices', 'replace_after', 18)) t(rule, name, value)""")
def config_limits(spark: SparkSession, sf: str) -> DataFrame:
    """The numbers of the limits file as rows."""
    rows = [(rule, k, float(v)) for rule, body in limits().items() if isinstance(body, dict) for k, v in body.items() if isinstance(v, (int, float)) and not isinstance(v, bool)]
    return spark.createDataFrame(rows, "rule string, name string, value double")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'P' AND o_totalprice >= 100000")
def fetch_orders(spark: SparkSession, sf: str) -> DataFrame:
    """A read with named parameters; filters reach the scan."""
    return store.fetch_all(spark, sf, "SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_orderstatus = :status AND o_totalprice >= :least", {"status": "P", "least": 100000})


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1")
def fetch_one_order(spark: SparkSession, sf: str) -> DataFrame:
    """One row or none."""
    r = store.fetch_one(spark, sf, "SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC, o_orderkey")
    return spark.createDataFrame([tuple(r)] if r else [], "o_orderkey long, o_totalprice double")


@query("SELECT 1 AS id, arg_max(event_type, (ts, event_id)) AS mode, max(ts) AS changed_at FROM events HAVING count(*) > 0")
def mode_now(spark: SparkSession, sf: str) -> DataFrame:
    """The one row of a singleton: the last change of a log."""
    e = load(spark, sf, "events").select(F.lit(1).alias("id"), F.col("event_type").alias("mode"), F.col("ts").alias("changed_at"), "event_id")
    return latest(e, ["id"], ["changed_at", "event_id"], ["mode", "changed_at"])


@query("SELECT name, TIMESTAMP '2024-01-02 00:00:00' AS applied_at, file_no FROM (VALUES ('0002_orders.sql', 1), ('0003_views.sql', 2)) t(name, file_no) UNION ALL SELECT '0001_initial.sql', TIMESTAMP '2024-01-01 00:00:00', 0")
def migrations_applied(spark: SparkSession, sf: str) -> DataFrame:
    """Files of a folder, applied once each in order and logged with the time; the second run finds only what is new."""
    at = scratch(spark, "migrations")
    store.write_text(spark, f"{at}/sql/0001_initial.sql", "SELECT 1")
    store.migrate(spark, f"{at}/sql", f"{at}/log", "2024-01-01", spark.sql)
    store.write_text(spark, f"{at}/sql/0003_views.sql", "SELECT 3; SELECT 4")
    store.write_text(spark, f"{at}/sql/0002_orders.sql", "SELECT 2")
    store.write_text(spark, f"{at}/sql/notes.txt", "not a migration")
    store.migrate(spark, f"{at}/sql", f"{at}/log", "2024-01-02", spark.sql)
    w = Window.orderBy("name")  # a row a file
    return spark.read.schema("name string, applied_at timestamp_ntz").parquet(f"{at}/log").withColumn("file_no", F.row_number().over(w) - 1)


@query("SELECT r_name || '.sql' AS file, r_regionkey < 3 AS applied, reseed, reseed OR r_regionkey >= 3 AS to_apply FROM region, (VALUES (false), (true)) v(reseed)")
def migrations_reseed(spark: SparkSession, sf: str) -> DataFrame:
    """What is applied: files that are not registered, or all of them when seeding anew."""
    r = load(spark, sf, "region").select(F.concat("r_name", F.lit(".sql")).alias("file"), (F.col("r_regionkey") < 3).alias("applied"), F.explode(F.array(F.lit(False), F.lit(True))).alias("reseed"))
    return r.withColumn("to_apply", F.col("reseed") | ~F.col("applied"))


#: The files that may be read through the protected store.
PROTECTED = ("limits.yaml", "envelope.yaml")
ASKED = "['limits.yaml', 'envelope.yaml', 'settings.yaml', '../limits.yaml', 'LIMITS.YAML'][CAST(event_id % 5 AS INTEGER) + 1]"


@query(f"SELECT event_id, {ASKED} AS name, CASE WHEN {ASKED} NOT IN ('limits.yaml', 'envelope.yaml') THEN 'not protected' WHEN event_type <> 'purchase' THEN 'not authorised' END AS refusal FROM events")
def protected_names(spark: SparkSession, sf: str) -> DataFrame:
    """Only listed names are served, as they are spelled; a change needs the owner's confirmation."""
    name = F.element_at(F.array(*map(F.lit, ["limits.yaml", "envelope.yaml", "settings.yaml", "../limits.yaml", "LIMITS.YAML"])), (F.col("event_id") % 5).cast("int") + 1)
    e = load(spark, sf, "events").select("event_id", name.alias("name"), "event_type")
    return e.select("event_id", "name", F.when(~F.col("name").isin(*PROTECTED), "not protected").when(F.col("event_type") != "purchase", "not authorised").alias("refusal"))


REQUEST = """w AS (SELECT event_id, user_id, ts, CAST(event_id % 1000 + 400 AS INTEGER) AS a, CAST((event_id * 3) % 1000 + 400 AS INTEGER) AS b, event_type <> 'signup' AS owner FROM events),
v AS (SELECT *, owner AND b > a AND a >= 555 AND b <= 930 AND b - 5 > a AS ok FROM w)"""


@query(f"""WITH {REQUEST}, s AS (SELECT user_id, arg_max(a, (ts, event_id)) AS start, arg_max(b, (ts, event_id)) AS "end", count(*) AS n_audit FROM v WHERE ok GROUP BY 1) SELECT user_id, start, "end", n_audit, '{{"start":' || start || ',"end":' || "end" || '}}' AS last_diff FROM s""")
def trade_window_set(spark: SparkSession, sf: str) -> DataFrame:
    """The setter of the trade window: a request that passes its checks changes the state and leaves an audit row, both of one write, so that
    readers see both or none; a refused one leaves nothing. The state is the last row of the log."""
    i = F.col("event_id")
    a, b = (i % 1000 + 400).cast("int"), ((i * 3) % 1000 + 400).cast("int")
    ok = (F.col("event_type") != "signup") & (b > a) & (a >= 555) & (b <= 930) & (b - 5 > a)
    e = load(spark, sf, "events").filter(ok).select("user_id", "event_id", "ts", a.alias("start"), b.alias("end"))
    diff = F.to_json(F.struct("start", "end"))
    at = scratch(spark, "window")
    both = F.array(F.struct(F.lit("state").alias("kind"), F.lit(None).cast("string").alias("diff")), F.struct(F.lit("audit").alias("kind"), diff.alias("diff")))
    e.select("*", F.inline(both)).write.parquet(at)
    log = spark.read.parquet(at)
    order = F.struct("ts", "event_id")
    state = log.groupBy("user_id").agg(F.max_by(F.struct("start", "end"), F.when(F.col("kind") == "state", order)).alias("s"), F.count_if(F.col("kind") == "audit").alias("n_audit"), F.max_by("diff", F.when(F.col("kind") == "audit", order)).alias("last_diff"))
    return state.select("user_id", "s.start", "s.end", "n_audit", "last_diff")


@query("""SELECT event_id, kind, kind IN ('recommendation', 'fill', 'limit_breach', 'kill', 'budget_warning', 'daily_summary', 'weekly_summary', 'engine_started', 'engine_stopped', 'startup_report', 'trade_window_changed', 'login_prompt', 'feed_stale', 'rec_fill_suspected') AS known
FROM (SELECT event_id, ['recommendation', 'fill', 'limit_breach', 'kill', 'budget_warning', 'daily_summary', 'weekly_summary', 'engine_started', 'engine_stopped', 'startup_report', 'trade_window_changed', 'login_prompt', 'feed_stale', 'rec_fill_suspected', 'gossip', 'Kill'][CAST(event_id % 16 AS INTEGER) + 1] AS kind FROM events)""")
def message_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """Membership of the catalogue of message kinds, which is closed and spelled in one way."""
    kind = F.element_at(F.array(*map(F.lit, [*KINDS, "gossip", "Kill"])), (F.col("event_id") % 16).cast("int") + 1)
    return load(spark, sf, "events").select("event_id", kind.alias("kind")).withColumn("known", F.col("kind").isin(*KINDS))


FLAGS = "SELECT event_id, event_type = 'error' AS killed, event_id % 7 <> 0 AS integrity, event_id % 11 = 0 AS crashed, list_filter([CASE WHEN event_id % 2 = 0 THEN 'clock' END, CASE WHEN event_id % 3 = 0 THEN 'feed' END], lambda x: x IS NOT NULL) AS frozen, list_filter([CASE WHEN event_id % 5 = 0 THEN 'backfill' END], lambda x: x IS NOT NULL) AS deferred FROM events"


@query(f"""WITH f AS ({FLAGS}) SELECT event_id, CASE WHEN killed OR NOT integrity OR crashed THEN 'critical' ELSE 'info' END AS severity,
CASE WHEN crashed THEN 'recovered from RUNNING; ' ELSE '' END || 'killed=' || killed || ' integrity_ok=' || integrity || chr(10) || 'frozen: ' || CASE WHEN len(frozen) > 0 THEN array_to_string(frozen, ', ') ELSE 'none' END || chr(10) || 'deferred: ' || CASE WHEN len(deferred) > 0 THEN array_to_string(deferred, ', ') ELSE 'none' END AS body FROM f""")
def startup_reports(spark: SparkSession, sf: str) -> DataFrame:
    """A report whose severity comes from its flags, with lists joined or "none"."""
    i = F.col("event_id")
    e = load(spark, sf, "events").select("event_id", (F.col("event_type") == "error").alias("killed"), (i % 7 != 0).alias("integrity"), (i % 11 == 0).alias("crashed"),
                                         F.array_compact(F.array(F.when(i % 2 == 0, "clock"), F.when(i % 3 == 0, "feed"))).alias("frozen"), F.array_compact(F.array(F.when(i % 5 == 0, "backfill"))).alias("deferred"))
    severity, body = report(F.col("killed"), F.col("integrity"), F.col("crashed"), F.lit("RUNNING"), F.col("frozen"), F.col("deferred"))
    return e.select("event_id", severity.alias("severity"), body.alias("body"))


def or_dash(c: Column) -> Column:
    return F.coalesce(c, F.lit("-"))


@query("""SELECT user_id, concat_ws(chr(10), 'mode: ' || arg_max(event_type, (ts, event_id)), 'routing: ' || coalesce(CASE WHEN arg_max(event_type, (ts, event_id)) = 'purchase' THEN 'live' END, '-'), 'trade_window: ' || CASE WHEN user_id % 2 = 0 THEN '600-630' ELSE '(unset)' END,
'kill: ' || CASE WHEN bool_or(event_type = 'error') THEN 'engaged' ELSE 'clear' END) AS status FROM events GROUP BY 1""")
def status_lines(spark: SparkSession, sf: str) -> DataFrame:
    """A status text with placeholders for what is not set."""
    g = load(spark, sf, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("mode"), F.bool_or(F.col("event_type") == "error").alias("killed"))
    w = settings().trade_window
    window = F.coalesce(F.when(F.col("user_id") % 2 == 0, f"{w.start}-{w.end}"), F.lit("(unset)"))
    lines = (F.concat(F.lit("mode: "), "mode"), F.concat(F.lit("routing: "), or_dash(F.when(F.col("mode") == "purchase", "live"))), F.concat(F.lit("trade_window: "), window), F.concat(F.lit("kill: "), F.when(F.col("killed"), "engaged").otherwise("clear")))
    return g.select("user_id", F.concat_ws("\n", *lines).alias("status"))


@query("""WITH c AS (SELECT user_id, ts, event_id, event_type = 'signup' AS minted FROM events WHERE event_type IN ('signup', 'purchase')), l AS (SELECT *, lead(minted) OVER w AS next_minted, lead(ts) OVER w AS next_ts FROM c WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, substr(sha256(CAST(event_id AS VARCHAR)), 1, 6) AS phrase, CASE WHEN next_ts IS NULL THEN 'pending' WHEN next_minted THEN 'superseded' WHEN epoch_us(next_ts) - epoch_us(ts) > 7200000000 THEN 'expired' ELSE 'confirmed' END AS outcome FROM l WHERE minted""")
def challenges_minted(spark: SparkSession, sf: str) -> DataFrame:
    """Challenges with a phrase of six digits; an owner has one pending at most: a new one supersedes it, an answer ends it, in time (two hours
    here) or too late. The phrase is a digest, so that a replay mints the same."""
    c = load(spark, sf, "events").filter("event_type in ('signup', 'purchase')").select("user_id", "ts", "event_id", (F.col("event_type") == "signup").alias("minted"))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    c = c.withColumns({"next_minted": F.lead("minted").over(w), "next_ts": F.lead("ts").over(w)}).filter("minted")
    age = F.unix_micros(F.col("next_ts").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))
    outcome = F.when(F.col("next_ts").isNull(), "pending").when(F.col("next_minted"), "superseded").when(age > 7_200_000_000, "expired").otherwise("confirmed")
    return c.select("event_id", F.substring(F.sha2(F.col("event_id").cast("string"), 256), 1, 6).alias("phrase"), outcome.alias("outcome"))


@query("SELECT l_suppkey AS connection, count(DISTINCT l_partkey) AS n, count(DISTINCT l_partkey) > 40 AS warn FROM lineitem GROUP BY 1")
def subscription_cap(spark: SparkSession, sf: str) -> DataFrame:
    """Instruments by connection against the feed's cap (3,000; 40 for the test's small feeds); above it a warning, no refusal."""
    cap = settings().instruments_per_connection // 75
    return load(spark, sf, "lineitem").select(F.col("l_suppkey").alias("connection"), "l_partkey").distinct().groupBy("connection").agg(F.count("*").alias("n"), (F.count("*") > cap).alias("warn"))


@query("""SELECT event_id, CASE WHEN event_type = 'view' THEN 1 WHEN event_type = 'click' THEN 2 ELSE 3 END AS source, abs(CASE WHEN event_type = 'view' THEN value ELSE -value END) AS offset_s FROM events WHERE value IS NOT NULL""")
def first_source_or_error(spark: SparkSession, sf: str) -> DataFrame:
    """The first of three time sources that answers, by rank, and its offset without sign; no answer at all is an error."""
    e = load(spark, sf, "events").filter("value is not null")
    kind = F.col("event_type")
    sources = [F.when(kind == "view", F.col("value")), F.when(kind == "click", -F.col("value")), F.when(~kind.isin("view", "click"), -F.col("value"))]
    found = F.coalesce(*(F.when(s.isNotNull(), F.struct(F.lit(i + 1).alias("source"), F.abs(s).alias("offset_s"))) for i, s in enumerate(sources)), F.raise_error(F.lit("no time source answers")).cast("struct<source:int,offset_s:double>"))
    return e.select("event_id", found.alias("f")).select("event_id", "f.source", "f.offset_s")


@query("""SELECT event_id, strftime(CASE WHEN event_id % 2 = 0 THEN ts ELSE ts + INTERVAL 330 MINUTE END, '%Y-%m-%d %H:%M:%S') AS ist, CASE WHEN event_id % 2 = 0 THEN 'naive' ELSE 'aware' END AS kind FROM events""")
def zone_rule(spark: SparkSession, sf: str) -> DataFrame:
    """A time without a zone is taken to be in the market's zone as it stands; one with a zone is converted."""
    naive = F.col("event_id") % 2 == 0
    aware = F.convert_timezone(F.lit("UTC"), F.lit(settings().timezone), F.col("ts"))
    return load(spark, sf, "events").select("event_id", F.date_format(F.when(naive, F.col("ts")).otherwise(aware), "yyyy-MM-dd HH:mm:ss").alias("ist"), F.when(naive, "naive").otherwise("aware").alias("kind"))


@query("""WITH a AS (SELECT c_mktsegment AS seg, c_custkey AS k FROM customer), b AS (SELECT DISTINCT o_custkey AS k FROM orders) SELECT seg, count(*) AS n, count(*) FILTER (b.k IS NULL) AS n_outside, count(*) FILTER (b.k IS NULL) = 0 AS is_subset FROM a LEFT JOIN b ON a.k = b.k GROUP BY seg""")
def subset_tests(spark: SparkSession, sf: str) -> DataFrame:
    """Whether each set is a subset of another: no member of it is outside."""
    a = load(spark, sf, "customer").select(F.col("c_mktsegment").alias("seg"), F.col("c_custkey").alias("k"))
    b = load(spark, sf, "orders").select(F.col("o_custkey").alias("k"), F.lit(1).alias("hit")).distinct()
    out = F.count_if(F.col("hit").isNull())
    return a.join(b, "k", "left").groupBy("seg").agg(F.count("*").alias("n"), out.alias("n_outside"), (out == 0).alias("is_subset"))


@query("""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'level,key_name,user' ELSE 'key_name,level,user' END AS keys, CASE WHEN event_id % 2 = 0 THEN 'info,' || event_type || ',' || user_id ELSE event_type || ',warn,' || user_id END AS vals FROM events""")
def map_overlay(spark: SparkSession, sf: str) -> DataFrame:
    """Two maps laid over each other: where keys clash the right one wins; keys that a log record has of its own get a prefix."""
    base = F.create_map(F.lit("level"), F.lit("info"), F.lit("name"), F.col("event_type"))
    user = F.col("user_id").cast("string")
    over = F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("user"), user)).otherwise(F.create_map(F.lit("level"), F.lit("warn"), F.lit("user"), user))
    left = F.map_filter(base, lambda k, v: ~F.array_contains(F.map_keys(over), k))
    m = F.transform_keys(F.map_concat(left, over), lambda k, v: F.when(k.isin("name", "msg", "args"), F.concat(F.lit("key_"), k)).otherwise(k))
    return load(spark, sf, "events").select("event_id", joined(F.map_keys(m), ",").alias("keys"), joined(F.map_values(m), ",").alias("vals"))


@query("""WITH t AS (SELECT n_regionkey AS k, n_name AS name, n_nationkey % 4 AS v FROM nation) SELECT 'orders' AS view, (SELECT count(*) FROM orders) AS n UNION ALL SELECT 'positions', (SELECT count(DISTINCT l_partkey) FROM lineitem WHERE l_linestatus = 'O') UNION ALL SELECT 'decisions', (SELECT count(*) FROM events WHERE event_type = 'click')
UNION ALL SELECT 'verdicts', (SELECT count(*) FROM orders) UNION ALL SELECT 'headroom', (SELECT count(*) FROM customer) UNION ALL SELECT 'budget', (SELECT count(DISTINCT strftime(o_orderdate, '%Y-%m')) FROM orders) UNION ALL SELECT 'learning', (SELECT count(DISTINCT l_returnflag) FROM lineitem)""")
def read_views(spark: SparkSession, sf: str) -> DataFrame:
    """The dashboard's read views, counted through their registered names."""
    names = list(store.views(spark, sf))
    counts = [spark.sql(f"SELECT '{n}' AS view, count(*) AS n FROM view_{n}") for n in names]
    out = counts[0]
    for c in counts[1:]:
        out = out.union(c)
    return out


@query("""SELECT place, stage, outcome, note FROM (VALUES (0, 'reconcile', 'done', (SELECT CAST(count(*) AS VARCHAR) FROM orders WHERE o_orderstatus = 'O')), (1, 'square_off', 'failed', 'RuntimeError'), (2, 'backfill', 'done', (SELECT CAST(count(DISTINCT user_id) AS VARCHAR) FROM events)), (3, 'warm_up', 'deferred', NULL), (4, 'resume', 'done', NULL)) t(place, stage, outcome, note)""")
def startup_hooks(spark: SparkSession, sf: str) -> DataFrame:
    """A start whose hooks reconcile open orders and count feeds to fill; one is absent, one fails, and the others run all the same."""

    def square_off() -> None:
        raise RuntimeError("no session")

    hooks = {
        "reconcile": lambda: load(spark, sf, "orders").filter("o_orderstatus = 'O'").count(), "square_off": square_off, "backfill": lambda: load(spark, sf, "events").select("user_id").distinct().count(), "resume": lambda: None,
    }
    return start(spark, hooks)


@query("SELECT user_id, (SELECT max(epoch_us(ts)) FROM events) - max(epoch_us(ts)) AS age_us, (SELECT max(epoch_us(ts)) FROM events) - max(epoch_us(ts)) > 86400000000 AS stale FROM events GROUP BY 1")
def ages_as_of(spark: SparkSession, sf: str) -> DataFrame:
    """How old each feed's last word is, as of the time that a replay is given, else of the data's end."""
    e = load(spark, sf, "events")
    last = e.groupBy("user_id").agg(F.max("ts").alias("last"))
    end = e.agg(F.max("ts").alias("end"))
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    age = us(as_of(spark, F.col("end"))) - us(F.col("last"))
    return last.join(F.broadcast(end)).select("user_id", age.alias("age_us"), (age > 86_400_000_000).alias("stale"))  # one row
