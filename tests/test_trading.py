"""Orders, cash, spectra and null rules on small cases worked out by hand."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.operators import features, quality, signals, strategies, trading
from tickloom.plans.query import Query


def test_first_bars_against_a_walk(spark):
    r = random.Random(5)
    bars = [("A", i, *sorted((r.uniform(10, 20), r.uniform(10, 20))), r.uniform(10, 20)) for i in range(300)]
    bars = [(s, i, max(b, c), min(a, c), c) for s, i, a, b, c in bars]
    orders = [(k, "A", r.randrange(310), r.choice(("BUY", "SELL")), r.choice(("MARKET", "LIMIT", "STOP", "TRAILING_STOP", "STOP_LIMIT")), r.uniform(9, 21), r.uniform(1, 11), r.uniform(9, 21)) for k in range(500)]
    want = {}
    for key, _, at, side, kind, price, amount, limit in orders:
        low, high, open_ = float("inf"), float("-inf"), False
        for _, i, h, lo, c in bars[at:]:
            low, high = min(low, lo), max(high, h)
            if kind == "MARKET":
                hit, paid = True, c
            elif kind == "LIMIT":
                hit, paid = (lo <= price if side == "BUY" else h >= price), price
            elif kind == "STOP_LIMIT":
                hit, paid = open_ and (lo <= limit if side == "BUY" else h >= limit), limit
                if not open_ and (c >= price if side == "BUY" else c <= price):
                    open_, hit = True, c <= limit if side == "BUY" else c >= limit
            elif kind == "STOP":
                hit, paid = (c >= price if side == "BUY" else c <= price), c
            else:
                hit, paid = (c >= low + amount if side == "BUY" else c <= high - amount), c
            if hit:
                want[key] = (i, paid)
                break
    stamp = lambda c: F.timestamp_seconds(F.col(c) * 60).cast("timestamp_ntz")
    b = spark.createDataFrame(bars, "symbol string, i long, high double, low double, close double").withColumn("ts", stamp("i")).drop("i")
    o = spark.createDataFrame(orders, "order_id long, symbol string, i long, side string, order_type string, price double, amount double, limit_price double").withColumn("ts", stamp("i")).drop("i")
    got = {x.order_id: (x.m, x.fill_price) for x in trading.first_bars(o, b).withColumn("m", F.unix_timestamp(F.col("filled_ts").cast("timestamp")) / 60).collect()}
    assert got == {k: (float(i), p) for k, (i, p) in want.items()}


def test_cash_admits_the_surest_first(spark):
    wanted = spark.createDataFrame([(1, "A", 90.0, 60.0, 1.0), (1, "B", 80.0, 50.0, 1.0), (1, "C", 70.0, 30.0, 1.0), (2, "A", 90.0, 10.0, 0.0)], "account long, symbol string, confidence double, value double, fee double")
    cash = spark.createDataFrame([(1, 100.0), (2, 5.0)], "account long, cash double")
    got = {(x.account, x.symbol): (x.taken, x.cash_left) for x in trading.admitted(wanted, cash).collect()}
    assert got == {(1, "A"): (True, 39.0), (1, "B"): (False, 39.0), (1, "C"): (True, 8.0), (2, "A"): (False, 5.0)}


def test_spectrum_finds_a_wave():
    t = np.arange(256)
    found = features.spectrum(100 * np.exp(0.02 * np.sin(2 * np.pi * 0.25 * t)))
    assert found["dominant"] == pytest.approx(0.25, abs=0.01) and found["freq_medium"] > 0.95
    assert features.spectrum(np.ones(10)) is None


def test_null_rules(spark):
    row = spark.range(1).select(
        signals.engine_size(F.lit(1000.0), F.lit(None).cast("double"), F.lit(10.0), F.lit(0.1)).alias("size"), strategies.at_most(F.lit(None).cast("double"), 1.0).alias("cap"),
        strategies.kelly_size(1000.0, F.lit(None).cast("double"), F.lit(10.0), F.lit(9.0)).alias("kelly"), strategies.points((F.lit(None).cast("boolean"), 0.4), (F.lit(True), 0.3)).alias("points"),
    ).first()
    assert row["size"] is None and row["cap"] is None and row["kelly"] is None and row["points"] == pytest.approx(0.3)
    bar = spark.createDataFrame([("A", 1.0, None, 0.5, 2.0, None)], "symbol string, open double, high double, low double, close double, volume double")
    fixed = quality.correct(bar).first()
    assert fixed["volume"] is None and fixed["high"] == 2.0


def test_question_marks_in_quotes_are_text(spark):
    rows = spark.createDataFrame([("what?", 1.0), ("x", 2.0)], "word string, x double")
    assert rows.where(Query.bind("word = 'what?' and x < ?", 1.5)).count() == 1
    assert rows.where(Query.bind("x < ?", float("inf"))).count() == 2
    with pytest.raises(ValueError):
        Query.bind("x < ?")


def test_levels_and_the_best_range():
    from tickloom.operators import ranges

    t = np.arange(100)
    wave = 100 + 3 * np.sin(2 * np.pi * t / 20)
    high, low, volume = wave + 0.1, wave - 0.1, np.ones(100)
    tops, bottoms = ranges.levels(high, volume), ranges.levels(low, volume, side=-1)
    assert [x[1] for x in tops] == [5] and tops[0][0] == pytest.approx(103.1, abs=0.01)
    assert bottoms[0][0] == pytest.approx(96.9, abs=0.01)
    found = ranges.best_range(high, low, wave, volume)
    assert found["support"] == pytest.approx(96.9, abs=0.01) and found["resistance"] == pytest.approx(103.1, abs=0.01) and found["quality"] > 80
    assert ranges.best_range(high * 2 ** (t / 20), low * 2 ** (t / 20), wave, volume) is None


def test_clusters_by_distance():
    from tickloom.operators import regimes

    rows = np.array([[0.0, 0], [0.1, 0], [5.0, 5], [0, 0.1]])
    for name, value in (("exponential", np.exp(-0.1)), ("inverse", 1 / 1.1)):
        names, sure, centres = regimes.online_clusters(rows, likeness=name)
        assert names.tolist() == [0, 0, 1, 0] and len(centres) == 2
        assert sure[1] == pytest.approx(min(1.0, 1.2 * value))
