"""Inputs on which queries once differed from their SQL."""

from __future__ import annotations

import datetime as dt

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from ledgerbars import registry
from ledgerbars.functions.floats import round_half_away
from tests.compare import connect, spark_rows, sql_rows


def event(i: int, ts: str, user: int | None, value: float | None, kind: str = "view") -> dict:
    return {"event_id": i, "ts": dt.datetime.fromisoformat(ts), "user_id": user, "event_type": kind, "value": value, "props": '{"k": 1}'}


EVENTS = pa.schema([("event_id", pa.int64()), ("ts", pa.timestamp("us")), ("user_id", pa.int64()), ("event_type", pa.string()), ("value", pa.float64()), ("props", pa.string())])


@pytest.fixture
def like_sql(spark, sf, tmp_path):
    """Does a query give its SQL's rows where some tables are replaced?"""

    def check(name: str, **tables: pa.Table) -> list:
        for t in duckdb.sql(f"SELECT file FROM glob('{sf}/*.parquet')").fetchall():
            t = t[0].rsplit("/", 1)[-1]
            if not (tmp_path / t).exists():
                (tmp_path / t).symlink_to(f"{sf}/{t}")
        for t, rows in tables.items():
            (tmp_path / f"{t}.parquet").unlink()
            pq.write_table(rows, tmp_path / f"{t}.parquet", use_dictionary=False)
        got = spark_rows(registry.queries()[name](spark, str(tmp_path)))
        assert [[str(x) for x in r] for r in got[1]] == [[str(x) for x in r] for r in sql_rows(connect(str(tmp_path)), registry.oracle_sql()[name])[1]]
        return got[1]

    return check


def test_exdate_gaps_by_ieee(like_sql):
    """Closes of zero before the ex-date, a ratio whose seventh place is a five, prices and accounts that are null."""
    a, b, c = "2024-01-10T10:00:00", "2024-01-16T10:00:00", "2024-01-16T11:00:00"
    pairs = [(0.0, 1.0), (0.0, 0.0), (-0.0, 1.0), (64.0, 64.01), (1.28, 1.2865), (3.2, 3.2512), (10.25, 9.99)] + [(64.0 + k / 100, 61.0 + k / 7) for k in range(300)]
    rows = [event(10 * k + n, t, k, v) for k, (x, y) in enumerate(pairs) for n, t, v in ((0, a, x), (1, b, y), (2, c, y))]
    rows += [event(9001, a, None, 5.0), event(9002, b, None, 6.0), event(9003, a, 900, 5.0), event(9004, "2024-01-10T11:00:00", 900, None), event(9005, b, 900, None), event(9006, c, 900, 6.0), event(9007, a, 901, None)]
    got = like_sql("exdate_gap_verdict", events=pa.Table.from_pylist(rows, EVENTS))
    assert {r[0] for r in got if r[1] < 3} == {"nan", float("inf")}


def test_leverage_by_ieee(like_sql):
    """Equity of zero, below it and unknown; exposures of zero and unknown; leverages with a five in the seventh place."""
    some = [0.0, -0.0, None, -12.5, 64.0, 3.2, 1280.0, 10.25, 0.01]
    spent = [0.0, 64.01, 1.5, None, 3.2512] + [1000.07 + k / 100 for k in range(300)]
    keys = [(b, x) for b in some for x in spent]
    c = pa.table({"c_custkey": pa.array(range(len(keys)), pa.int64()), "c_acctbal": pa.array([b for b, _ in keys], pa.float64())})
    o = pa.table({"o_orderkey": pa.array(range(len(keys)), pa.int64()), "o_custkey": pa.array(range(len(keys)), pa.int64()), "o_orderstatus": ["O"] * len(keys), "o_totalprice": pa.array([x for _, x in keys], pa.float64())})
    got = like_sql("rule_max_leverage", customer=c, orders=o)
    assert {"nan", float("inf"), float("-inf"), None} <= {r[2] for r in got}


@pytest.fixture(params=[3, 12])
def scattered(request, spark, sf, tmp_path):
    """The tables with events in files of no order: three come in one batch, in many small frames; twelve in two batches."""
    for t in duckdb.sql(f"SELECT file FROM glob('{sf}/*.parquet')").fetchall():
        t = t[0].rsplit("/", 1)[-1]
        if t != "events.parquet":
            (tmp_path / t).symlink_to(f"{sf}/{t}")
    (tmp_path / "events.parquet").mkdir()
    e = pq.read_table(f"{sf}/events.parquet")
    e = e.take(np.random.default_rng(1).permutation(len(e)))
    for k in range(request.param):
        pq.write_table(e.take(np.arange(k, len(e), request.param)), tmp_path / f"events.parquet/part-{k}.parquet")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10)
    yield str(tmp_path)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def same_scattered(spark, folder: str, name: str) -> None:
    assert spark_rows(registry.queries()[name](spark, folder)) == sql_rows(connect(folder), registry.oracle_sql()[name])


def test_feed_state_in_no_order(spark, scattered):
    same_scattered(spark, scattered, "stream_feed_state")


def test_feed_watch_in_no_order(spark, scattered):
    """Late heartbeats count, also where the timer has gone off."""
    same_scattered(spark, scattered, "stream_feed_watch")


def test_token_bucket_in_no_order(spark, scattered):
    same_scattered(spark, scattered, "stream_token_bucket")


def test_rounding_of_one_number():
    """As DuckDB: scaled, then half away from zero."""
    for x in (0.0005, 1.0005, 2.0125, 1.005, 3599.9995, -0.0005, 0.00049999, 1e300, 0.0):
        assert round_half_away(x, 3) == duckdb.execute("SELECT round(?::DOUBLE, 3)", [x]).fetchall()[0][0]


def test_endpoint_buckets_in_no_order(spark, scattered):
    same_scattered(spark, scattered, "stream_endpoint_buckets")
