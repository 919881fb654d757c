"""Calendars and settings from files, the store's services, stamping, indicators and stream handlers: cases with known answers."""

from __future__ import annotations

import datetime as dt

import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from ledgerbars import registry
from ledgerbars.functions.years import days, is_open, next_or_error, session, trade_window
from ledgerbars.operators.actions import stamp, validate_actions
from ledgerbars.operators.state import before_in, number_in
from ledgerbars.plans.windows import adx_frame, daily, rsi_frame
from ledgerbars.sources import store
from ledgerbars.sources.config import Settings, Window, calendar, horizon_of, read_yaml, settings
from ledgerbars.streaming.handlers import by_lateness, last_words, persist_then, to_topics, upserts

YEAR = """
year: 2026
verified: {verified}
verified_through: {through}
sessions:
  continuous: {{start: "09:15", end: "15:30"}}
holidays:
  - {{date: 2026-01-26, name: "a holiday"}}
special_sessions: [{{date: 2026-11-08, start: "09:15", end: "10:15"}}]
shortened_sessions:
  - {{date: 2026-06-17, start: "10:00", end: "13:00"}}
"""


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "a.yaml").write_text("year: 2026\nholidays: []\n")
    (tmp_path / "b.yaml").write_text(YEAR.format(verified="true", through="2026-06-30"))  # the last file of a year counts
    (tmp_path / "c.yaml").write_text("")
    (tmp_path / "d.yaml").write_text("note: no year\n")
    return tmp_path


def ask(spark, f, *dates):
    d = spark.createDataFrame([(dt.date.fromisoformat(x),) for x in dates], "day date")
    return [r.x for r in d.select("day", f(F.col("day")).alias("x")).collect()]


def test_trading_days(spark, folder, tmp_path):
    years = calendar(folder)
    dates = ("2026-06-17", "2026-01-26", "2026-06-20", "2026-11-08", "2027-06-17", "2026-07-01")
    assert ask(spark, lambda d: is_open(d, years), *dates) == [True, False, False, True, False, True]
    assert ask(spark, lambda d: is_open(d, years, strict=True), *dates) == [True, False, False, True, False, False]
    assert horizon_of(years) == dt.date(2026, 6, 30)
    (folder / "b.yaml").write_text(YEAR.format(verified="false", through=""))
    assert ask(spark, lambda d: is_open(d, calendar(folder), strict=True), *dates) == [False, False, False, True, False, False]
    assert calendar(tmp_path / "nowhere") == {} and ask(spark, lambda d: is_open(d, {}), "2026-06-17") == [False]


def test_sessions_and_windows(spark, folder):
    years = calendar(folder)
    got = ask(spark, lambda d: session(d, years), "2026-06-16", "2026-06-17", "2026-11-08", "2026-06-20")
    assert [g and tuple(g) for g in got] == [(555, 930, False, False), (600, 780, False, True), (555, 615, True, False), None]
    window = lambda *own: lambda d: trade_window(d, years, Window(), *(F.lit(x).cast("int") for x in own))
    assert tuple(ask(spark, window(), "2026-06-16")[0]) == (600, 630, 5, True)
    assert tuple(ask(spark, window(480, 960, 5), "2026-06-16")[0]) == (555, 930, 5, True)
    assert tuple(ask(spark, window(None, 960, 3), "2026-06-16")[0]) == (600, 630, 5, True)  # one end alone is no window
    assert tuple(ask(spark, window(800, 900, 0), "2026-06-17")[0]) == (800, 780, 0, False)
    assert ask(spark, window(), "2026-06-20") == [None]


def test_next_trading_day(spark, folder):
    d = days(spark, calendar(folder), dt.date(2026, 6, 19), dt.date(2026, 6, 20)).select("day", next_or_error(F.col("next_day"), F.col("day")).alias("next"))
    assert [r.next for r in d.orderBy("day").collect()] == [dt.date(2026, 6, 22)] * 2
    last = days(spark, calendar(folder), dt.date(2026, 12, 31), dt.date(2026, 12, 31)).select(next_or_error(F.col("next_day"), F.col("day")))
    with pytest.raises(PySparkException, match="no trading day"):
        last.collect()


def test_yaml_and_settings(tmp_path):
    assert read_yaml("") == {} and read_yaml("a: [1, 'x, y', {b: 2.5}]\nc:\n  - d # no\n  - '#e'\nf:\n") == {"a": [1, "x, y", {"b": 2.5}], "c": ["d", "#e"], "f": None}
    assert settings(environ={}) == Settings() and settings(environ={"LEDGERBARS_DATA": "/x"}).data == "/x"
    (tmp_path / "s.yaml").write_text("env: prod\nclok: {max_skew_s: 3}\n")
    with pytest.raises(ValueError, match="clok"):
        settings(tmp_path / "s.yaml")


def test_snapshot_is_all_or_nothing(spark, tmp_path):
    at = f"{tmp_path}/snapshot"
    store.replace_snapshot(spark.range(3), at)
    with pytest.raises(PySparkException):
        store.replace_snapshot(spark.range(5).select(F.when(F.col("id") > 3, F.raise_error(F.lit("bad row"))).cast("long").alias("id")), at)
    assert store.read_snapshot(spark, at).count() == 3


def test_migrations(spark, tmp_path):
    at, ran = str(tmp_path), []
    store.write_text(spark, f"{at}/sql/2_b.sql", "two; three")
    store.write_text(spark, f"{at}/sql/1_a.sql", "one")

    def run(statement):
        if statement == "three":
            raise RuntimeError("bad statement")
        ran.append(statement)

    with pytest.raises(RuntimeError):
        store.migrate(spark, f"{at}/sql", f"{at}/log", "2024-01-01", run)
    assert ran == ["one", "two"] and [r.name for r in spark.read.parquet(f"{at}/log").collect()] == ["1_a.sql"]
    assert store.migrate(spark, f"{at}/sql", f"{at}/log", "2024-01-02", ran.append) == ["2_b.sql"]
    assert store.migrate(spark, f"{at}/sql", f"{at}/log", "2024-01-03", ran.append) == [] and store.pending(["a.sql"], {"a.sql"}, reseed=True) == ["a.sql"]


def test_retention(spark, tmp_path):
    spark.range(10).withColumn("day", F.concat(F.lit("2024-01-1"), F.col("id"))).write.partitionBy("day").json(str(tmp_path / "log"))
    assert store.retain(spark, str(tmp_path / "log"), "day", 4) == [f"day=2024-01-1{i}" for i in range(6)]
    assert sorted(r.id for r in spark.read.json(str(tmp_path / "log")).collect()) == [6, 7, 8, 9]


def test_stamping(spark):
    body = '{"action":"cancel","thesis":"a \\"quoted\\" thesis, long enough","confidence":0.5,"order_id":"7","agent_id":"forged"}'
    d = spark.createDataFrame([(body, "2024-01-01T10:00:00+05:30"), (body, "2024-01-01T10:00:00"), ("[]", "2024-01-01T10:00:00Z")], "raw string, until string")
    out = validate_actions(d.withColumn("body", stamp(F.col("raw"), F.lit("p1"), F.lit("a1"), F.col("until"), F.lit("d1"))), "body")
    get = lambda k: F.get_json_object("body", f"$.{k}")
    rows = out.select("problem", get("agent_id"), get("proposal_id"), get("thesis"), get("order_id"), get("confidence")).collect()
    assert tuple(rows[0]) == (None, "a1", "p1", 'a "quoted" thesis, long enough', "7", "0.5")
    assert rows[1].problem == "valid_until" and rows[2].problem == "not an object"


def test_bucketed_order(spark):
    d = spark.createDataFrame([(k, i, f"{k}{i}") for k in "ab" for i in (1, 5, 9, 10, 11, 30)], "k string, i int, v string")
    got = {(r.k, r.i): (r.prev, r.n) for r in number_in(before_in(d, ["k"], ["i"], F.floor(F.col("i") / 10), "v", "prev"), ["k"], ["i"], F.floor(F.col("i") / 10), "n").collect()}
    order = [1, 5, 9, 10, 11, 30]
    assert got == {(k, i): (f"{k}{order[n - 1]}" if n else None, n + 1) for k in "ab" for n, i in enumerate(order)}


def test_indicators_equal_plain_pandas(spark, sf):
    bars = daily(spark, sf).toPandas()
    for name, frame, cols in (("rsi_wilder", rsi_frame, ["rsi"]), ("adx_atr_wilder", adx_frame, ["atr", "adx"])):
        want = pd.concat([frame(g) for _, g in bars.groupby("instrument")]).set_index(["instrument", "day"])[cols]
        got = registry.queries()[name](spark, sf).toPandas().set_index(["instrument", "day"])[cols]
        both = want.join(got, how="outer", lsuffix="_want")
        assert len(both) == len(want) == len(got) > 20
        for c in cols:
            assert (both[f"{c}_want"] - both[c]).abs().max() < 1e-3


def test_handlers(spark, tmp_path):
    at = str(tmp_path)
    d = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, topic string")
    seen = []

    def fails(df, batch):
        raise KeyError("x")

    to_topics(f"{at}/t", "topic", {"a": fails, "b": lambda df, batch: seen.append(df.count())})(d, 0)
    assert seen == [1] and {(r.topic, r.outcome, r.error) for r in spark.read.parquet(f"{at}/t/notes").collect()} == {("a", "failed", "KeyError"), ("b", "handled", None), ("c", "no handler", None)}
    keep = upserts(f"{at}/u")
    for batch, v in ((0, 1), (1, 2), (1, 3)):  # a batch that runs again replaces what it wrote
        keep(spark.createDataFrame([("k", v)], "k string, v int"), batch)
    assert [tuple(r) for r in last_words(spark, f"{at}/u", ["k"], "k string, v int").collect()] == [("k", 3)]
    t = lambda m: dt.datetime(2024, 1, 1, 0, m)
    late = by_lateness(f"{at}/l", "ts", dt.timedelta(minutes=10))
    for batch, minutes in ((0, [30]), (1, [19, 20, 50]), (2, [39, 45])):
        late(spark.createDataFrame([(t(m),) for m in minutes], "ts timestamp_ntz"), batch)
    assert sorted(r.ts.minute for r in spark.read.parquet(f"{at}/l/late").collect()) == [19, 39]
    acted = []
    broken = d.select(F.raise_error(F.lit("no disk")).cast("long").alias("id"))
    with pytest.raises(PySparkException):
        persist_then(f"{at}/p", lambda df, batch: acted.append(df.count()))(broken, 0)
    assert acted == []
    persist_then(f"{at}/p", lambda df, batch: acted.append(df.count()))(d, 0)
    assert acted == [3]


def test_frames_wait_for_the_next_buffer(spark):
    from ledgerbars.sources.frames import decode_buffers, frame

    wire = b"".join(frame({"type": "tick", "data": {"i": i}}) for i in range(5)) + b"\0\0\0\x01\xc1" + frame({"type": "order", "data": {}})
    rows = [(s, k, wire[k : k + 7]) for s in "xy" for k in range(0, len(wire), 7)]
    got = decode_buffers(spark.createDataFrame(rows, "source string, at long, raw binary"), "source", "at", "raw").collect()
    for s in "xy":
        assert [(r.type, r.data, r.ok) for r in got if r.source == s] == [*(("tick", f'{{"i": {i}}}', True) for i in range(5)), (None, None, False), ("order", "{}", True)]


def test_replay_runs_at_the_given_time(spark, sf):
    before = {r.user_id: r.age_us for r in registry.queries()["ages_as_of"](spark, sf).collect()}
    spark.conf.set("spark.ledgerbars.asOf", "2030-01-01 00:00:00")
    try:
        later = {r.user_id: r.age_us for r in registry.queries()["ages_as_of"](spark, sf).collect()}
    finally:
        spark.conf.unset("spark.ledgerbars.asOf")
    assert len({later[k] - before[k] for k in before}) == 1 and min(later.values()) > 10**14
