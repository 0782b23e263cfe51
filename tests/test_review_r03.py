"""Faults that a review found on larger tables and odd values."""

from __future__ import annotations

import datetime as dt
import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.functions import scalars, text
from tickloom.operators import patterns, trading, volatility
from tickloom.plans.base import rounded

START = dt.datetime(2024, 1, 1)
BARS = "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double"


def _hours(lows: list[float], symbol: str = "a") -> list[tuple]:
    return [(symbol, START + dt.timedelta(hours=i), 50.0, 60.0, x, 50.0, 1.0) for i, x in enumerate(lows)]


def test_two_bottoms_at_zero_are_a_double_bottom(spark):
    lows = [40.0 + i % 3 for i in range(40)]
    lows[10] = lows[25] = 0.0
    found = patterns.peak_patterns(spark.createDataFrame(_hours(lows), BARS)).where("pattern = 'DOUBLE_BOTTOM'").collect()
    assert [(r["start"], r["end"], r["confidence"]) for r in found] == [(START + dt.timedelta(hours=10), START + dt.timedelta(hours=25), 0.95)]


def test_double_extremes_at_zero(spark):
    lows = [40.0] * 30
    lows[18], lows[25] = 0.0, 0.0
    found = patterns.double_extremes(spark.createDataFrame(_hours(lows), BARS)).collect()
    assert [(r["pattern"], r["first"], r["second"]) for r in found] == [("DOUBLE_BOTTOM", 0.0, 0.0)]


def test_rounding_is_that_of_the_sql(spark):
    import duckdb

    values = [0.5095, 0.5035, -0.5105, 1.005, 2.675, -1.005, 1.0000005, 0.1234565, 3e10 + 0.1, 1e307, 0.0, None, math.inf]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = {r["i"]: (r["a"], r["b"], r["v"]) for r in rounded(rows.select("i", text.nearest(F.col("v"), 3).alias("a"), text.nearest(F.col("v"), 2).alias("b"), "v")).collect()}
    for i, v in enumerate(values):
        a, b, c = duckdb.execute("select round(x, 3), round(x, 2), round(x, 6) + 0.0 from (select ?::double as x)", [v]).fetchone()
        assert got[i] == (a, b, c)


def test_percentage_is_that_of_the_sql(spark):
    # 250950 lies 0.5095 over 200000 in units of 100000: its double is under the half
    share = text.nearest((F.col("v") - 200000) / 1e5, 3) + 0.0001
    assert spark.createDataFrame([(250950.0,)], "v double").select(scalars.format_percentage(share)).head()[0] == "+50.91%"


def test_large_numbers_are_rounded_as_in_sql(spark):
    rows = spark.createDataFrame([(19115.0,), (77195.0,), (128605.0,), (1500.0,)], "v double")
    assert [r[0] for r in rows.select(text.format_large(F.col("v"))).collect()] == ["19.11K", "77.19K", "128.60K", "1.50K"]


def test_recency_counts_fractions_of_a_second(spark):
    now = dt.datetime(2024, 1, 30, 23, 30)
    ages = [dt.timedelta(hours=h) + dt.timedelta(microseconds=m) for h in (1, 6, 24, 72) for m in (-1, 0, 1)]
    rows = spark.createDataFrame([(i, now - a) for i, a in enumerate(ages)], "i int, ts timestamp_ntz")
    found = rows.select("i", text.recency(F.col("ts"), F.lit(now).cast("timestamp_ntz"))).orderBy("i").collect()
    assert [r[1] for r in found] == [1.0, 0.8, 0.8, 0.8, 0.6, 0.6, 0.6, 0.4, 0.4, 0.4, 0.2, 0.2]


def test_whole_minutes_held_are_counted_whole(spark):
    rows = spark.range(1, 3000).select(F.lit("stop_loss").alias("reason"), F.lit("LONG").alias("side"), F.lit("stock").alias("asset_type"), F.lit(1.0).alias("quantity"), F.lit(1.0).alias("entry"), F.lit(1.0).alias("price"), F.lit(0.0).alias("pnl"), F.lit(START).cast("timestamp_ntz").alias("opened"), (F.lit(START).cast("timestamp_ntz") + F.make_dt_interval(mins=F.col("id").cast("int"))).alias("now"), "id")
    assert trading.closed(rows).where("minutes <> id").count() == 0


@pytest.fixture(scope="module")
def dips(spark):
    """Forty hours; in one the low is zero."""
    rows = [("a", START + dt.timedelta(hours=i), 50.0, 60.0, 0.0 if i == 15 else 40.0, 51.0, 1.0) for i in range(40)]
    return spark.createDataFrame(rows, BARS)


def test_garman_klass_is_infinite_while_a_low_is_zero(dips):
    found = [r[0] for r in volatility.garman_klass(dips).orderBy("ts").select("garman_klass_vol").collect()]
    assert found[:19] == [None] * 19 and found[19:35] == [math.inf] * 16 and all(0 < x < 100 for x in found[35:])


def test_parkinson_is_infinite_while_a_low_is_zero(dips):
    found = [r[0] for r in volatility.parkinson(dips).orderBy("ts").select("parkinson_vol").collect()]
    assert found[:19] == [None] * 19 and found[19:35] == [math.inf] * 16 and all(0 < x < 100 for x in found[35:])


def test_yang_zhang_is_infinite_while_a_low_is_zero(dips):
    found = [r[0] for r in volatility.yang_zhang(dips).orderBy("ts").select("yang_zhang_vol").collect()]
    assert found[:20] == [None] * 20 and found[20:35] == [math.inf] * 15 and all(0 < x < 100 for x in found[35:])


def test_a_symbols_orders_are_never_held_together(spark):
    """Batches of three orders: a task sees no more at once, and every order, also one with a large id, gets the bar that a plain loop gives it."""
    bars = [("a" if i % 2 else None, START + dt.timedelta(hours=i // 2), 50.0, 50.0 + i * 7 % 11, 50.0 - i * 5 % 13, None if i == 20 else 50.0 + i * 3 % 7 - 3, 1.0) for i in range(80)]
    orders = [(2**60 + i, None if i % 3 else "a", START + dt.timedelta(minutes=37 * i), "BUY" if i % 2 else "SELL", "LIMIT", 42.0 + i % 17, 2.0) for i in range(60)]
    taken = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        o = spark.createDataFrame(orders, "order_id long, symbol string, ts timestamp_ntz, side string, order_type string, price double, amount double")
        plan = trading.first_bars(o, spark.createDataFrame(bars, BARS))
        got = {r["order_id"]: (r["filled_ts"], r["fill_price"]) for r in plan.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", taken)
    assert "FlatMapGroupsInPandas" not in plan._jdf.queryExecution().toString()
    want = {}
    for key, symbol, ts, side, _, price, _ in orders:
        hits = [b[1] for b in sorted(bars, key=lambda b: b[1]) if b[0] == symbol and b[1] >= ts and (b[4] <= price if side == "BUY" else b[3] >= price)]
        if hits:
            want[key] = (hits[0], price)
    assert got == want


@pytest.mark.parametrize("name", ["order_stop_limits", "order_open", "order_status"])
def test_order_queries_hold_no_symbol_in_a_task(spark, name):
    """Each of them fills its orders batch by batch; a grouped step would hold all orders of a symbol."""
    import __spark_entry__

    plan = __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "FlatMapGroups" not in plan
