"""Hand-computed answers: calendar, tick grid, costs, sizes, ex-dates, caps, buckets, proposals."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerbars.functions import calendar, money
from ledgerbars.operators.actions import validate_actions
from ledgerbars.operators.asof import asof_join
from ledgerbars.operators.rules import RULES, check_rows
from ledgerbars.plans.windows import adx_frame, rsi_frame, verdict
from ledgerbars.streaming.queries import feed_states, refill, take_tokens


def days(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "t string").select(F.to_date("t").alias("day"))


def test_trading_days(spark):
    open_ = {"2026-06-17": True, "2026-06-20": False, "2026-06-21": False, "2026-01-26": False, "2026-11-08": True}
    got = {str(r.day): r.open for r in days(spark, *open_).select("day", calendar.is_trading_day(F.col("day")).alias("open")).collect()}
    assert got == open_
    strict = days(spark, "2026-06-17", "2026-11-08").select(calendar.verified_trading_day(F.col("day"), F.lit(None).cast("date")).alias("x")).collect()
    assert [r.x for r in strict] == [False, True]


def test_next_trading_day_and_sessions(spark):
    d = {str(r.day): r for r in calendar.date_dimension(spark, "2026-01-01", "2026-12-31").collect()}
    assert str(d["2026-06-19"].next_day) == "2026-06-22" and str(d["2026-01-23"].next_day) == "2026-01-27"
    a, b = calendar.session_minutes(F.col("day"))
    got = days(spark, "2026-06-17", "2026-11-08").select(a.alias("a"), b.alias("b")).collect()
    assert [tuple(r) for r in got] == [(555, 930), (555, 615)]


def test_clamp(spark):
    lo, hi, ok = calendar.clamp(F.col("a"), F.col("b"), F.lit("2026-06-17").cast("date"))
    w = spark.createDataFrame([(480, 960), (600, 630), (950, 1000)], "a int, b int").select(lo, hi, ok).collect()
    assert [tuple(r) for r in w] == [(555, 930, True), (600, 630, True), (950, 930, False)]
    assert spark.range(1).select(calendar.end_less_buffer(F.lit(2), F.lit(5))).first()[0] == 1437


def test_round_to_tick(spark):
    cases = {"100.125": "100.15", "100.025": "100.05", "100.024": "100.00", "0.075": "0.10"}
    d = spark.createDataFrame([(Decimal(k),) for k in cases], "p decimal(18,4)")
    got = [r[0] for r in d.select(money.round_to_tick(F.col("p"), F.lit("0.05").cast("decimal(18,4)"))).collect()]
    assert got == [Decimal(v).quantize(Decimal("0.0001")) for v in cases.values()]


@pytest.mark.parametrize("notional, delivery, want", [(20000, False, "21.2562"), (20000, True, "59.8362"), (100000, False, "82.6812")])
def test_round_trip_costs(spark, notional, delivery, want):
    n = F.lit(notional).cast("decimal(18,4)")
    both = sum(spark.range(1).select(money.total(money.cost_parts(n, F.lit(delivery), F.lit(sell)))).first()[0] for sell in (False, True))
    assert both.quantize(Decimal("0.0001")) == Decimal(want)


def test_position_size(spark):
    f = lambda e, s, night: spark.range(1).select(money.position_size(F.lit(200), F.lit(e), F.lit(s), F.lit(night))).first()[0]
    assert (f(100, 98, False), f(100, 98, True), f(100, 100, False)) == (100, 40, 0)


def test_exdate_verdicts(spark):
    rows = [(1, 100.0, 101.0, 34.0), (2, 100.0, 101.0, 101.0), (3, 100.0, 34.0, 34.0), (4, 100.0, 101.0, 92.0), (5, 100.0, 92.0, 100.0), (6, None, 1.0, 1.0)]
    d = spark.createDataFrame(rows, "instrument long, pre double, post_close double, post_open double")
    assert [r.verdict for r in verdict(d).orderBy("instrument").collect()] == ["unadjusted", "adjusted", "inconclusive", "unadjusted", "inconclusive", "error"]


def test_asof_ties(spark):
    t = lambda s: dt.datetime(2024, 1, 1, 0, 0, s)
    left = spark.createDataFrame([(1, t(5), "a"), (1, t(1), "b"), (2, t(5), "c")], "k long, ts timestamp_ntz, id string")
    right = spark.createDataFrame([(1, t(5), 1.0), (1, t(5), 2.0), (1, t(3), 9.0)], "k long, ts timestamp_ntz, v double")
    assert {r.id: r.r_v for r in asof_join(left, right, ["k"], "ts", ["v"]).collect()} == {"a": 2.0, "b": None, "c": None}
    assert {r.id: r.r_v for r in asof_join(left, right, ["k"], "ts", ["v"], strict=True).collect()} == {"a": 9.0, "b": None, "c": None}


def test_rules_fail_closed(spark):
    assert len({r.rule_id for r in RULES}) == 30
    d = spark.createDataFrame([(1, 20000.0, -15.0), (2, 20000.5, None)], "id long, deployed double, equity_pct double")
    got = {(r.id, r.rule_id): r.passed for r in check_rows(d, ["id"]).collect()}
    assert got == {(1, "capital_cap"): True, (1, "equity_floor_rung"): False, (1, "cumulative_floor"): True, (2, "capital_cap"): False, (2, "equity_floor_rung"): False, (2, "cumulative_floor"): False}


def test_action_union(spark):
    t = "x" * 20
    enter = f'{{"action":"enter","thesis":"{t}","confidence":0.5,"tradingsymbol":"A","exchange":"NSE","side":"BUY","style":"swing","entry_type":"LIMIT","stop_price":"9.5","quantity":3,"signal_id":"s","strategy_id":"t","features_snapshot_id":"f"}}'
    cases = {
        enter: None, enter.replace('"quantity":3', '"quantity":0'): "number", enter.replace("BUY", "HOLD"): "word", enter.replace("0.5", "1.5"): "confidence", enter.replace(t, "short"): "thesis", "[]": "not an object", "nonsense": "not an object",
        f'{{"action":"cancel","thesis":"{t}","confidence":1,"order_id":"o"}}': None, f'{{"action":"cancel","thesis":"{t}","confidence":1}}': "missing key", f'{{"action":"modify-target","thesis":"{t}","confidence":0,"position_id":"p"}}': None,
        f'{{"action":"cancel","thesis":"{t}","confidence":1,"order_id":"o","x":1}}': "unknown key", f'{{"action":"dance","thesis":"{t}","confidence":1}}': "unknown action",
    }
    d = spark.createDataFrame([(k,) for k in cases], "body string")
    assert {r.body: r.problem for r in validate_actions(d, "body").collect()} == cases


class State:
    def __init__(self):
        self.value, self.exists = None, False

    @property
    def get(self):
        return self.value

    def update(self, value):
        self.value, self.exists = value, True


def test_token_bucket_waits():
    calls = pd.DataFrame({"us": [0, 0, 0], "event_id": [1, 2, 3]})
    out = next(take_tokens(("e",), iter([calls]), State(), rate=1.0, burst=2.0))
    assert out["wait_s"].tolist() == [0.0, 0.0, 1.0]


@given(st.floats(0, 5), st.floats(0, 100), st.floats(0.1, 5), st.floats(1, 5))
@settings(max_examples=50, deadline=None)
def test_refill_is_bounded(tokens, gap, rate, burst):
    assert min(tokens, burst) <= refill(tokens, gap, rate, burst) <= burst


def test_feed_states_survive_batches():
    s, day = State(), 86_400_000_000
    first = next(feed_states((1,), iter([pd.DataFrame({"us": [0, 10], "event_id": [1, 2]})]), s))
    later = next(feed_states((1,), iter([pd.DataFrame({"us": [2 * day], "event_id": [3]})]), s))
    assert first["to_state"].tolist() == ["WARMING", "HEALTHY"] and later["to_state"].tolist() == ["STALE", "WARMING"]


def test_indicators():
    p = pd.DataFrame({"instrument": 1, "day": pd.date_range("2024-01-01", periods=4).date, "close": [1.0, 2.0, 3.0, 3.0]})
    assert rsi_frame(p)["rsi"].tolist() == [100.0, 100.0]
    q = pd.DataFrame({"instrument": 1, "day": pd.date_range("2024-01-01", periods=12).date, "high": range(2, 14), "low": range(0, 12), "close": range(1, 13)}).astype({"high": float, "low": float, "close": float})
    out = adx_frame(q)
    assert (out["atr"] == 2.0).all() and (out["adx"] == 100.0).all()


def test_stream_equals_batch(spark, sf):
    from ledgerbars import registry

    q = registry.queries()
    batch = {(r.instrument, r.bar_start): (r.open, r.high, r.low, r.close, r.n_ticks) for r in q["bars_1h"](spark, sf).collect()}
    live = {(r.user_id, r.bar_start): (r.open, r.high, r.low, r.close, r.n_ticks) for r in q["stream_bars"](spark, sf).collect()}
    assert live and live.items() <= batch.items() and len(batch) - len(live) <= 20
    first = {(r.user_id, r.day): r.first_invalid for r in q["invalidation_once"](spark, sf).collect()}
    seen = {(r.user_id, r.day) for r in q["stream_dedup"](spark, sf).collect()}
    assert seen <= set(first)
    sessions = q["stream_sessions"](spark, sf).count()
    assert 0 < sessions <= q["session_activity"](spark, sf).count()


def test_schemas_and_quarantine(spark):
    from ledgerbars.sources.schemas import SCHEMAS, split, valid

    assert [f.name for f in SCHEMAS["mode_state"]] == ["id", "mode", "routing", "risk_state", "reason", "changed_by", "changed_at"]
    d = spark.createDataFrame([(1, "AUTO", "NORMAL"), (2, "auto", "NORMAL"), (3, None, "FROZEN")], "id int, mode string, risk_state string")
    good, bad = split(d, valid("mode_state"))
    assert [r.id for r in good.collect()] == [1] and sorted(r.id for r in bad.collect()) == [2, 3]


def test_frames_skip_and_wait(spark):
    from ledgerbars.sources.frames import decode_frames, frame, pack, split_frames, unpack

    for v in (None, True, 5, 200, -3, 1.5, "é", b"x", [1, "a"], {"k": {"n": [None]}}):
        assert unpack(pack(v)) == (v, len(pack(v)))
    good, bad = frame({"type": "tick", "data": {"p": 1}}), b"\0\0\0\x01\xc1"
    bodies, rest = split_frames(good + bad + good + good[:7])
    assert len(bodies) == 3 and rest == good[:7]
    d = spark.createDataFrame([("s", good + bad + good + good[:7]), ("t", b""), ("u", None)], "source string, raw binary")
    got = decode_frames(d, "source", "raw").collect()
    assert [(r.type, r.data, r.ok) for r in got] == [("tick", '{"p": 1}', True), (None, None, False), ("tick", '{"p": 1}', True)]
