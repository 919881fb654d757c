"""Feeds and files: books, frames cut over buffers, exchange files, bar intervals, snapshots, retention, stamped proposals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.actions import stamp, validate_actions
from ..registry import query
from ..sources import store
from ..sources.files import append_json, read_bars, read_csv, scratch, write_bars
from ..sources.schemas import split, valid
from ..sources.tables import TICKS, load, ticks
from .bars import BAR, ohlc

BOOKS = {"orderbook": "order_id long, state string, price double", "positions": "symbol long, quantity double, day boolean", "holdings": "symbol long, quantity double", "margins": "account long, available double", "triggers": "order_id long, trigger double"}


@query("""SELECT 'orderbook' AS book, count(*) AS n, round(sum(o_totalprice), 2) AS value FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT 'positions', count(*), round(sum(q), 2) FROM (SELECT l_partkey, sum(l_quantity) AS q FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1)
UNION ALL SELECT 'holdings', count(*), round(sum(q), 2) FROM (SELECT l_partkey, sum(l_quantity) AS q FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1) UNION ALL SELECT 'margins', count(*), round(sum(c_acctbal), 2) FROM customer UNION ALL SELECT 'triggers', count(*), round(sum(o_totalprice), 2) FROM orders WHERE o_orderstatus = 'P'""")
def broker_books(spark: SparkSession, sf: str) -> DataFrame:
    """A broker's five books as JSON documents, read back with their schemas and counted."""
    o, li, c = (load(spark, sf, t) for t in ("orders", "lineitem", "customer"))
    held = lambda status: li.filter(F.col("l_linestatus") == status).groupBy(F.col("l_partkey").alias("symbol")).agg(F.sum("l_quantity").alias("quantity"))
    frames = {
        "orderbook": o.filter("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("order_id"), F.col("o_orderstatus").alias("state"), F.col("o_totalprice").alias("price")), "positions": held("O").withColumn("day", F.lit(True)), "holdings": held("F"),
        "margins": c.select(F.col("c_custkey").alias("account"), F.col("c_acctbal").alias("available")), "triggers": o.filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("order_id"), F.col("o_totalprice").alias("trigger")),
    }
    at, value, out = scratch(spark, "books"), {"orderbook": "price", "positions": "quantity", "holdings": "quantity", "margins": "available", "triggers": "trigger"}, None
    for book, df in frames.items():
        df.write.json(f"{at}/{book}")
        one = spark.read.schema(BOOKS[book]).json(f"{at}/{book}").agg(F.count("*").alias("n"), F.round(F.sum(value[book]), 2).alias("value")).select(F.lit(book).alias("book"), "n", "value")
        out = one if out is None else out.union(one)
    return out


@query("SELECT event_type AS type, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events GROUP BY 1")
def frames_over_buffers(spark: SparkSession, sf: str) -> DataFrame:
    """Frames of a source end to end, cut into buffers of 50 bytes wherever that falls: the rest of a buffer waits for the next one."""
    from ..sources.frames import decode_buffers, encode_frames

    e = load(spark, sf, "events").select(F.col("user_id").cast("string").alias("source"), F.col("event_type").alias("type"), F.to_json(F.struct("event_id")).alias("data"))
    whole = encode_frames(e).groupBy("source").agg(F.collect_list("frame").alias("f")).select("source", F.aggregate("f", F.lit(b"").cast("binary"), lambda a, b: F.concat(a, b)).alias("raw"))
    n = F.ceil(F.octet_length("raw") / 50).cast("int")
    cut = whole.select("source", "raw", F.explode(F.sequence(F.lit(0), n - 1)).alias("seq")).select("source", F.col("seq").cast("long").alias("seq"), F.substring("raw", F.col("seq") * 50 + 1, 50).alias("buffer"))
    d = decode_buffers(cut, "source", "seq", "buffer").filter("ok").withColumn("b", F.from_json("data", "event_id long"))
    return d.groupBy("type").agg(F.count("*").alias("n"), F.sum("b.event_id").alias("ids"))


FEEDS = {"eod": "symbol long, close double, traded long", "actions": "symbol long, kind string, ratio double", "earnings": "symbol long, on_day date", "deals": "symbol long, side string, quantity double", "news": "item long, source string, headline string"}


@query("""SELECT 'eod' AS feed, count(*) AS n, count_if(p_partkey % 7 = 0) AS n_bad FROM part UNION ALL SELECT 'actions', count(*), count_if(p_partkey % 5 = 0) FROM part WHERE p_size > 25 UNION ALL SELECT 'earnings', count(*), count_if(s_suppkey % 4 = 0) FROM supplier
UNION ALL SELECT 'deals', count(*), 0 FROM (SELECT l_partkey FROM lineitem WHERE l_quantity = 50) UNION ALL SELECT 'news', count(*), 0 FROM documents WHERE lang = 'fr'""")
def feed_files(spark: SparkSession, sf: str) -> DataFrame:
    """The five end-of-day feeds: CSV files with a schema each; lines that do not fit are counted apart. Headlines are quoted text of one line."""
    p, s, li, d = (load(spark, sf, t) for t in ("part", "supplier", "lineitem", "documents"))
    bad = lambda c, k, v: F.when(F.col(c) % k == 0, "n/a").otherwise(v.cast("string"))
    files = {
        "eod": p.select(F.col("p_partkey").alias("symbol"), bad("p_partkey", 7, F.col("p_retailprice")).alias("close"), F.col("p_size").alias("traded")),
        "actions": p.filter("p_size > 25").select(F.col("p_partkey").alias("symbol"), F.lit("split").alias("kind"), bad("p_partkey", 5, F.lit(0.5)).alias("ratio")),
        "earnings": s.select(F.col("s_suppkey").alias("symbol"), bad("s_suppkey", 4, F.lit("2024-01-15")).alias("on_day")),
        "deals": li.filter("l_quantity = 50").select(F.col("l_partkey").alias("symbol"), F.lit("BUY").alias("side"), F.col("l_quantity").alias("quantity")),
        "news": d.filter("lang = 'fr'").select(F.col("doc_id").alias("item"), "source", F.regexp_replace(F.substring("text", 1, 60), r"[\r\n\"\\]+", " ").alias("headline")),
    }
    at, out = scratch(spark, "feeds"), None
    for feed, df in files.items():
        df.write.option("header", True).csv(f"{at}/{feed}")
        schema = spark.createDataFrame([], FEEDS[feed]).schema
        good, unfit = read_csv(spark, f"{at}/{feed}", schema)
        one = good.select(F.lit(0).alias("bad")).union(unfit.select(F.lit(1))).agg(F.count("*").alias("n"), F.count_if(F.col("bad") == 1).alias("n_bad")).select(F.lit(feed).alias("feed"), "n", "n_bad")
        out = one if out is None else out.union(one)
    return out


@query(f"""WITH {TICKS}, m AS (SELECT instrument, date_trunc('minute', ts) AS bar_start, {BAR} FROM ticks GROUP BY 1, 2), d AS (SELECT instrument, CAST(day AS TIMESTAMP) AS bar_start, {BAR} FROM ticks GROUP BY 1, 2)
SELECT 'minute' AS interval, instrument, bar_start, close, volume FROM m WHERE bar_start >= TIMESTAMP '2024-01-05' AND bar_start < TIMESTAMP '2024-01-07' UNION ALL SELECT 'day', instrument, bar_start, close, volume FROM d WHERE bar_start >= TIMESTAMP '2024-01-05' AND bar_start < TIMESTAMP '2024-01-07'""")
def bar_intervals(spark: SparkSession, sf: str) -> DataFrame:
    """Minute and daily bars in one store, by interval and day; each interval is read back for two days, no other partition is listed."""
    at, t = scratch(spark, "intervals"), ticks(spark, sf)
    write_bars(ohlc(t, "instrument", F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("bar_start")), "minute", at)
    write_bars(ohlc(t, "instrument", F.col("day").cast("timestamp_ntz").alias("bar_start")), "day", at)
    cols = ["interval", "instrument", "bar_start", "close", "volume"]
    return read_bars(spark, at, "minute", "2024-01-05", "2024-01-06").select(cols).union(read_bars(spark, at, "day", "2024-01-05", "2024-01-06").select(cols))


@query("SELECT p_partkey, p_name FROM part WHERE p_size > 10")
def instrument_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    """A snapshot replaced as a whole: readers see the version that the pointer names, the old one while a new one is written."""
    at, p = scratch(spark, "snapshot"), load(spark, sf, "part").select("p_partkey", "p_name", "p_size")
    store.replace_snapshot(p.drop("p_size"), at)
    store.replace_snapshot(p.filter("p_size > 10").drop("p_size"), at)
    return store.read_snapshot(spark, at)


@query("SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders GROUP BY 1 ORDER BY 1 DESC LIMIT 90")
def log_retention(spark: SparkSession, sf: str) -> DataFrame:
    """Log lines by day; the newest 90 days stay, older ones are removed by their folders."""
    from ..sources.config import settings

    at = scratch(spark, "kept")
    newest = load(spark, sf, "orders").select(F.to_date("o_orderdate").alias("day")).distinct().orderBy(F.desc("day")).limit(settings().keep_days + 30)  # days that a rotation may find
    append_json(load(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day")).join(F.broadcast(newest), "day").repartition("day"), at, "day")
    store.retain(spark, at, "day", settings().keep_days)
    return spark.read.schema("o_orderkey long, day date").json(at).groupBy("day").agg(F.count("*").alias("n"))


MODES = "CASE event_id % 4 WHEN 0 THEN 'OFF' WHEN 1 THEN 'AUTO' WHEN 2 THEN 'auto' END"


@query(f"SELECT event_type AS risk_state, count(*) AS n, count_if(coalesce({MODES} IN ('OFF', 'RECOMMEND', 'AUTO'), false) AND event_type IN ('NORMAL', 'click')) AS n_valid FROM (SELECT event_id, CASE event_type WHEN 'view' THEN 'NORMAL' ELSE event_type END AS event_type FROM events) GROUP BY 1")
def closed_word_lists(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of a state table whose words are all in their lists; what is absent or spelled in another way is quarantined."""
    i = F.col("event_id") % 4
    e = load(spark, sf, "events").select(F.lit(1).alias("id"), F.when(i == 0, "OFF").when(i == 1, "AUTO").when(i == 2, "auto").alias("mode"), F.when(F.col("event_type") == "view", "NORMAL").otherwise(F.col("event_type")).alias("asked"))
    e = e.withColumn("risk_state", F.when(F.col("asked") == "click", "FROZEN").otherwise(F.col("asked")))
    good, bad = split(e, valid("mode_state"))
    return good.withColumn("ok", F.lit(1)).union(bad.withColumn("ok", F.lit(0))).groupBy(F.col("asked").alias("risk_state")).agg(F.count("*").alias("n"), F.sum("ok").cast("long").alias("n_valid"))


def proposal(extra: Column) -> Column:
    return F.concat(F.lit('{"action":"cancel","thesis":"'), F.repeat(F.lit("x"), 25), F.lit('","confidence":0.5,"order_id":"o1","proposal_id":"forged","agent_id":"me"'), extra, F.lit("}"))


@query("""SELECT event_id, 'p' || event_id AS proposal_id, CAST(user_id AS VARCHAR) AS agent_id, strftime(ts + INTERVAL 15 MINUTE, '%Y-%m-%dT%H:%M:%S') || '+05:30' AS valid_until, 'd' || event_id % 10 AS inputs_digest,
CASE WHEN event_id % 6 = 0 THEN 'unknown key' END AS problem FROM events""")
def stamped_proposals(spark: SparkSession, sf: str) -> DataFrame:
    """Proposals as they come, with forged platform keys; the four keys of the platform are written over whatever was there, then the whole is
    validated again. A key that neither action nor platform knows is still refused."""
    e = load(spark, sf, "events")
    body = proposal(F.when(F.col("event_id") % 6 == 0, ',"extra":1').otherwise(""))
    until = F.concat(F.date_format(F.col("ts") + F.expr("INTERVAL 15 MINUTES"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+05:30"))
    e = e.select("event_id", body.alias("raw"), F.concat(F.lit("p"), "event_id").alias("proposal_id"), F.col("user_id").cast("string").alias("agent_id"), until.alias("valid_until"), F.concat(F.lit("d"), F.col("event_id") % 10).alias("inputs_digest"))
    e = e.withColumn("body", stamp(F.col("raw"), F.col("proposal_id"), F.col("agent_id"), F.col("valid_until"), F.col("inputs_digest")))
    v = validate_actions(e.select("event_id", "body"), "body")
    get = lambda k: F.get_json_object("body", f"$.{k}").alias(k)
    return v.select("event_id", get("proposal_id"), get("agent_id"), get("valid_until"), get("inputs_digest"), "problem")


