"""State from logs: upserts, first and latest rows, crashes, downgrades, audit rows, predicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.asof import asof_join
from ..operators.state import before_in, first, latest, named, number_in, rank_of
from ..registry import query
from ..sources.tables import load

LOG = "l AS (SELECT user_id, ts, event_id, event_type AS status, value FROM events)"


@query("""SELECT user_id AS job_id, CAST(ts AS DATE) AS run_date, max(ts) FILTER (event_type = 'purchase') AS last_success_at, max(ts) AS last_attempt_at, arg_max(event_type, (ts, event_id)) AS status,
arg_max(event_type, (ts, event_id)) = 'purchase' AS was_run, bool_or(event_type = 'purchase') AS ever_succeeded FROM events GROUP BY 1, 2""")
def job_watermark_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Attempts always move, the success time only on success; the latest status and an earlier success are shown apart."""
    ok = F.col("event_type") == "purchase"
    g = load(spark, sf, "events").groupBy(F.col("user_id").alias("job_id"), F.to_date("ts").alias("run_date")).agg(
        F.max(F.when(ok, F.col("ts"))).alias("last_success_at"), F.max("ts").alias("last_attempt_at"), F.max_by("event_type", F.struct("ts", "event_id")).alias("status"), F.bool_or(ok).alias("ever_succeeded")
    )
    return g.withColumn("was_run", F.col("status") == "purchase")


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS state, max(ts) AS changed_at, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1")
def state_latest(spark: SparkSession, sf: str) -> DataFrame:
    e = load(spark, sf, "events").select("user_id", F.col("event_type").alias("state"), F.col("ts").alias("changed_at"), "value", "event_id")
    return latest(e, ["user_id"], ["changed_at", "event_id"], ["state", "changed_at", "value"])


@query("SELECT user_id, min(ts) AS seeded_at, arg_min(event_type, (ts, event_id)) AS seed FROM events GROUP BY 1")
def insert_if_absent(spark: SparkSession, sf: str) -> DataFrame:
    e = load(spark, sf, "events").select("user_id", F.col("event_type").alias("seed"), F.col("ts").alias("seeded_at"), "event_id")
    return first(e, ["user_id"], ["seeded_at", "event_id"], ["seeded_at", "seed"])


RUNS = "CASE event_type WHEN 'signup' THEN 'RUNNING' WHEN 'purchase' THEN 'STOPPED' WHEN 'click' THEN 'STOPPING' END"


@query(f"""WITH r AS (SELECT user_id, event_id, ts, {RUNS} AS state FROM events WHERE event_type IN ('signup', 'purchase', 'click')), l AS (SELECT *, lag(state) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prior FROM r)
SELECT user_id, event_id, coalesce(prior, 'STOPPED') AS prior, coalesce(prior IN ('RUNNING', 'STOPPING'), false) AS crashed FROM l WHERE state = 'RUNNING'""")
def crash_detection(spark: SparkSession, sf: str) -> DataFrame:
    """A run that begins while the one before was running or stopping follows a crash."""
    state = F.when(F.col("event_type") == "signup", "RUNNING").when(F.col("event_type") == "purchase", "STOPPED").when(F.col("event_type") == "click", "STOPPING")
    r = load(spark, sf, "events").select("user_id", "event_id", "ts", state.alias("state")).filter("state is not null")
    r = r.withColumn("prior", F.lag("state").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))).filter("state = 'RUNNING'")
    return r.select("user_id", "event_id", F.coalesce("prior", F.lit("STOPPED")).alias("prior"), F.coalesce(F.col("prior").isin("RUNNING", "STOPPING"), F.lit(False)).alias("crashed"))


RISK = ("NORMAL", "FROZEN", "CLOSE_ONLY", "KILLED")


@query("""WITH r AS (SELECT user_id, ts, event_id, CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'error' THEN 2 ELSE 3 END AS k FROM events WHERE event_type IN ('view', 'click', 'error'))
SELECT user_id, event_id, ['NORMAL', 'FROZEN', 'CLOSE_ONLY', 'KILLED'][max(k) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) + 1] AS risk FROM r""")
def downgrade_only(spark: SparkSession, sf: str) -> DataFrame:
    """Requested risk states by rank; the most restrictive so far holds."""
    asked = F.when(F.col("event_type") == "view", "NORMAL").when(F.col("event_type") == "click", "FROZEN").when(F.col("event_type") == "error", "CLOSE_ONLY")
    r = load(spark, sf, "events").select("user_id", "ts", "event_id", rank_of(asked, RISK).alias("k")).filter("k is not null")
    worst = F.max("k").over(Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0))
    return r.select("user_id", "event_id", named(worst, RISK).alias("risk"))


@query("""WITH h AS (SELECT source, doc_id, sha256(text) AS new, lag(sha256(text)) OVER (PARTITION BY source ORDER BY doc_id) AS prev FROM documents)
SELECT source, doc_id, CASE WHEN prev IS NULL THEN '{"new":"' || new || '","note":"registered"}' ELSE '{"prev":"' || prev || '","new":"' || new || '","note":"' || CASE WHEN prev = new THEN 'same' ELSE 'changed' END || '"}' END AS diff FROM h""")
def integrity_audit(spark: SparkSession, sf: str) -> DataFrame:
    """An audit row {prev, new, note} for each version of a file; absent keys are left out."""
    d = load(spark, sf, "documents").select("source", "doc_id", F.sha2("text", 256).alias("new"))
    # Sorted by 4,096 ids of a source at a time, as one source may hold a third of all rows; a null source is one too.
    d = before_in(d.withColumn("s", F.coalesce("source", F.lit("\u0000"))), ["s"], ["doc_id", "new"], F.coalesce(F.floor(F.col("doc_id") / 4096), F.lit(2**62)), "new", "prev")
    note = F.when(F.col("prev").isNull(), "registered").when(F.col("prev") == F.col("new"), "same").otherwise("changed")
    return d.select("source", "doc_id", F.to_json(F.struct("prev", "new", note.alias("note"))).alias("diff"))


@query("""SELECT o_orderkey, m IN ('AUTO', 'RECOMMEND') AND r = 'NORMAL' AND w AS entries_allowed, m = 'AUTO' AND r = 'NORMAL' AND w AS opening_orders_allowed FROM (SELECT o_orderkey,
CASE o_orderstatus WHEN 'O' THEN 'AUTO' WHEN 'P' THEN 'RECOMMEND' ELSE 'OFF' END AS m, CASE WHEN o_orderpriority = '1-URGENT' THEN 'FROZEN' ELSE 'NORMAL' END AS r, o_orderkey % 1440 BETWEEN 600 AND 899 AS w FROM orders)""")
def entry_predicate(spark: SparkSession, sf: str) -> DataFrame:
    mode = F.when(F.col("o_orderstatus") == "O", "AUTO").when(F.col("o_orderstatus") == "P", "RECOMMEND").otherwise("OFF")
    normal, inside = F.col("o_orderpriority") != "1-URGENT", (F.col("o_orderkey") % 1440).between(600, 899)
    return load(spark, sf, "orders").select("o_orderkey", (mode.isin("AUTO", "RECOMMEND") & normal & inside).alias("entries_allowed"), ((mode == "AUTO") & normal & inside).alias("opening_orders_allowed"))


@query("""WITH k AS (SELECT user_id, max(ts) AS killed_at FROM events WHERE event_type = 'error' GROUP BY 1) SELECT e.event_id, k.killed_at IS NULL OR e.ts <= k.killed_at AS allowed FROM events e LEFT JOIN k ON e.user_id = k.user_id WHERE e.event_type = 'purchase'""")
def kill_guard(spark: SparkSession, sf: str) -> DataFrame:
    """Orders after their account's kill are refused: one window, no join."""
    e = load(spark, sf, "events").withColumn("killed_at", F.max(F.when(F.col("event_type") == "error", F.col("ts"))).over(Window.partitionBy("user_id"))).filter("event_type = 'purchase'")
    return e.select("event_id", (F.col("killed_at").isNull() | (F.col("ts") <= F.col("killed_at"))).alias("allowed"))


@query("""WITH a AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), c AS (SELECT user_id, ts, event_id AS challenge FROM events WHERE event_type = 'signup')
SELECT a.event_id, c.challenge, CASE WHEN c.ts IS NULL THEN 'none' WHEN epoch_us(a.ts) - epoch_us(c.ts) > 7200000000 THEN 'expired' ELSE 'confirmed' END AS outcome FROM a ASOF LEFT JOIN c ON a.user_id = c.user_id AND a.ts >= c.ts""")
def challenge_match(spark: SparkSession, sf: str) -> DataFrame:
    """Each answer to the newest challenge before it, which lives two hours here."""
    e = load(spark, sf, "events")
    a = e.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    c = e.filter("event_type = 'signup'").select("user_id", "ts", F.col("event_id").alias("challenge"))
    j = asof_join(a, c, ["user_id"], "ts", ["challenge"])
    age = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("r_ts").cast("timestamp"))
    return j.select("event_id", F.col("r_challenge").alias("challenge"), F.when(F.col("r_ts").isNull(), "none").when(age > 7_200_000_000, "expired").otherwise("confirmed").alias("outcome"))


@query("""SELECT user_id, CAST(ts AS DATE) AS day, min(ts) AS first_invalid, count(*) AS n_signals FROM events WHERE event_type = 'error' GROUP BY 1, 2""")
def invalidation_once(spark: SparkSession, sf: str) -> DataFrame:
    """Only the first rejection of a day invalidates a session."""
    return load(spark, sf, "events").filter("event_type = 'error'").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.min("ts").alias("first_invalid"), F.count("*").alias("n_signals"))


@query("""WITH c AS (SELECT user_id, event_id, event_type, CAST(ts AS DATE) AS day, CASE WHEN event_type = 'purchase' THEN row_number() OVER (PARTITION BY CAST(ts AS DATE), event_type ORDER BY ts, event_id) END AS nth FROM events WHERE event_type IN ('purchase', 'view'))
SELECT event_id, nth, CASE WHEN event_type = 'view' THEN 'pass' WHEN nth > 70 THEN 'rejected' WHEN nth = 56 THEN 'alert' ELSE 'pass' END AS outcome FROM c""")
def entry_cap(spark: SparkSession, sf: str) -> DataFrame:
    """70 entries a day, an alert once at 80 per cent; risk-reducing calls always pass."""
    c = load(spark, sf, "events").filter(F.col("event_type").isin("purchase", "view"))
    # Numbered by the minute, with the counts of the minutes before: a day may hold a third of all rows.
    c = number_in(c.withColumn("day", F.to_date("ts")), ["day", "event_type"], ["ts", "event_id"], F.date_trunc("minute", "ts"), "nth").withColumn("nth", F.when(F.col("event_type") == "purchase", F.col("nth")))
    return c.select("event_id", "nth", F.when(F.col("event_type") == "view", "pass").when(F.col("nth") > 70, "rejected").when(F.col("nth") == 56, "alert").otherwise("pass").alias("outcome"))
