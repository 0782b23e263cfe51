"""Averaged candles on planted bars; schedules of patterns against all subsets."""

from __future__ import annotations

import datetime as dt
import random
from collections import defaultdict
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from tickloom.operators import candles, schedule
from tickloom.plans import registry

DAY = dt.datetime(2024, 1, 1)
BARS = "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double"

#: Bars of body 1 and span 2, then those of the pattern: (open, high, low, close).
PLANTED = {
    "doji": [(100, 101, 99, 100.05)],
    "hammer": [(99.3, 100.0, 98.0, 99.9)],
    "hanging_man": [(101.0, 101.5, 99.0, 101.4)],
    "shooting_star": [(101.2, 103.0, 101.15, 101.6)],
    "engulfing": [(100.5, 101, 99, 99.5), (99.0, 101.5, 98.9, 101.0)],
    "morning_star": [(103, 103.2, 99.8, 100), (99.0, 99.5, 98.8, 99.2), (99.5, 102.2, 99.4, 102)],
    "evening_star": [(100, 103.2, 99.8, 103), (104.0, 104.5, 103.8, 104.2), (103.5, 103.6, 100.8, 101)],
    "harami": [(103, 103.2, 99.8, 100), (101.0, 101.9, 100.8, 101.5)],
    "dragonfly_doji": [(100, 100.1, 98, 100.02)],
    "gravestone_doji": [(100, 102, 99.95, 100.02)],
}
WAY = {"hanging_man": -100, "shooting_star": -100, "evening_star": -100}


@pytest.fixture(scope="module")
def hits(spark):
    rows = []
    for name, bars in PLANTED.items():
        plain = [(99.5, 101, 99, 100.5)] * 12
        rows += [(name, DAY + dt.timedelta(hours=k), *map(float, b), 10.0) for k, b in enumerate([*plain, *bars, (100, 101, 99, 100.5)])]
    frame = spark.createDataFrame(rows, BARS)
    return frame, {(r.symbol, r.pattern, (r.ts - DAY).seconds // 3600): r.strength for r in candles.candles(frame).collect()}


@pytest.mark.parametrize("name", PLANTED)
def test_planted_candles(hits, name):
    at = 11 + len(PLANTED[name])
    assert hits[1].get((name, name, at)) == WAY.get(name, 100), [k for k in hits[1] if k[0] == name]


def test_nothing_before_the_averages_are_full(hits):
    assert min(at for _, _, at in hits[1]) >= 10


def test_recent_signals(spark, hits):
    got = candles.recent_signals(hits[0]).collect()
    assert {(r.symbol, r.pattern, r.signal) for r in got} >= {("morning_star", "morning_star", "BUY"), ("evening_star", "evening_star", "SELL")}
    assert all(r.confidence == pytest.approx(0.8) for r in got if not r.signal.startswith("WEAK"))


def test_bars_with_nulls(spark):
    rows = [("a", DAY + dt.timedelta(hours=k), 100.0, 101.0, 99.0, None if k % 3 else 100.0, 1.0) for k in range(20)]
    got = candles.candles(spark.createDataFrame(rows, BARS)).collect()
    assert {((r.ts - DAY).seconds // 3600, r.pattern) for r in got} == {(12, "doji"), (15, "doji"), (18, "doji")}  # bars with a close, after ten spans
    assert candles.candles(spark.createDataFrame([], BARS)).count() == 0


INTERVALS = "symbol string, start long, end long, kind string, weight double"


def heaviest(rows):
    best = 0.0
    for n in range(len(rows) + 1):
        for some in combinations(rows, n):
            some = sorted(some)
            if all(a[1] < b[0] for a, b in zip(some, some[1:])):
                best = max(best, sum(x[3] for x in some))
    return best


def test_schedules_weigh_what_the_best_subset_does(spark):
    r = random.Random(8)
    rows = []
    for key in range(40):
        for _ in range(r.randint(0, 10)):
            start = r.randint(1, 30)
            rows.append((str(key), start, start + r.randint(0, 12), r.choice("abc"), r.choice([0.6, 0.7, 0.8, 0.9, 0.55])))
    got = defaultdict(list)
    for x in schedule.best_intervals(spark.createDataFrame(rows, INTERVALS), longest=12).collect():
        got[x.symbol].append((x.start, x.end, x.kind, x.weight))
    for key in {x[0] for x in rows}:
        mine, all_ = sorted(got[key]), [x[1:] for x in rows if x[0] == key]
        assert all(a[1] < b[0] for a, b in zip(mine, mine[1:])) and set(mine) <= set(all_)
        assert sum(x[3] for x in mine) == pytest.approx(heaviest(all_)), (key, mine)


def test_schedule_leaves_out_what_it_cannot_weigh(spark):
    rows = [("a", 1, 5, "x", 0.9), ("a", 5, 6, "y", None), ("a", 6, 9, "z", 0.0), ("a", 7, 6, "z", 1.0), ("a", None, 6, "z", 1.0), ("a", 1, 90, "long", 5.0), ("a", 6, 6, "x", 0.1), ("a", 6, 6, "x", 0.1)]
    got = schedule.best_intervals(spark.createDataFrame(rows, INTERVALS), longest=12).collect()
    assert sorted((x.start, x.end, x.weight) for x in got) == [(1, 5, 0.9), (6, 6, 0.1)]


def test_scan_gives_patterns_apart(spark):
    rows = registry.queries()["pattern_schedule"](spark, "/root/testdata/sf0.001").collect()
    by = defaultdict(list)
    for x in rows:
        by[x.symbol].append((x.start, x.end))
    assert rows and all(a[1] < b[0] for spans in by.values() for a, b in zip(sorted(spans), sorted(spans)[1:]))
    assert {x.kind for x in rows} & {"triangle", "rectangle", "resistance", "support", "bands", "range"}
    few = registry.queries()["pattern_scan"](spark, "/root/testdata/sf0.001").groupBy("symbol").count().agg(F.max("count")).first()[0]
    assert few <= 20
