"""Faults that a review found on larger tables."""

from __future__ import annotations

import datetime as dt
import math

import duckdb
import pytest

import __spark_entry__

AS_OF = dt.datetime(2024, 1, 30, 23, 30)


@pytest.fixture(scope="module")
def bounds(spark, tmp_path_factory):
    """Events about the bounds of recency, a microsecond and parts of a second on either side, for each of the made articles."""
    ages = [dt.timedelta(hours=h) + dt.timedelta(microseconds=m) for h in (1, 6, 24, 72) for m in (-1_000_001, -1_000_000, -999_999, -400_000, -1, 0, 1, 400_000)]
    rows = [(i, AS_OF - ages[i % len(ages)], i // len(ages), "click", 1.0, '{"k": 1}') for i in range(60 * len(ages))]
    rows += [(len(rows), dt.datetime(1969, 12, 31, 23, 59, 59, 500_000), 1, "view", 1.0, '{"k": 1}'), (len(rows) + 1, None, 1, "view", 1.0, '{"k": 1}')]
    folder = str(tmp_path_factory.mktemp("bounds"))
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{folder}/events.parquet")
    return folder


def _differences(spark, folder: str, name: str, table: str) -> tuple[int, set]:
    """Rows of the query, and those that either it or its SQL alone has."""
    frame = __spark_entry__.queries()[name](spark, folder)
    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    con.execute(f"create view {table} as select * from '{folder}/{table}.parquet/*.parquet'")
    named = lambda row: tuple("nan" if isinstance(x, float) and math.isnan(x) else x for x in row)
    got = [named(r) for r in frame.collect()]
    want = [named(r) for r in con.execute(f"select {', '.join(frame.columns)} from ({__spark_entry__.oracle_sql()[name]})").fetchall()]
    assert len(got) == len(want)
    return len(got), set(got) ^ set(want)


def test_annotated_news_count_from_the_second_of_publication(spark, bounds):
    assert _differences(spark, bounds, "news_annotated", "events") == (60 * 32 + 2, set())


def test_news_of_earnings_count_from_the_second_of_publication(spark, bounds):
    n, differing = _differences(spark, bounds, "news_earnings", "events")
    assert n > 100 and not differing


def test_insights_count_from_the_second_of_publication(spark, bounds):
    assert _differences(spark, bounds, "news_insights", "events") == (60 * 32 + 2, set())


def test_forms_of_odd_prices_and_keys_are_those_of_the_sql(spark, tmp_path):
    """Prices that are null, not finite, zero, below zero or beyond what a long holds; customers that doubles do not tell apart."""
    prices = [None, math.nan, math.inf, -math.inf, 0.0, -0.0, -0.001, -5.0, -999.995, -250000.0, 1000.0, 200000.0, 199950.0, 250950.0, 300000.0, 123456.785, 0.125, 1e-320]
    customers = [None, 0, 1, 2, 3, 14999, 2**53 + 1, 2**60 + 3]
    rows = [(i, c, p, dt.datetime(1998, 2, 6)) for i, (p, c) in enumerate((p, c) for p in prices for c in customers for _ in range(13))]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_totalprice double, o_orderdate timestamp_ntz").write.parquet(f"{tmp_path}/orders.parquet")
    assert _differences(spark, str(tmp_path), "scalar_forms", "orders") == (len(rows), set())


@pytest.mark.parametrize("price", [None, math.inf, math.nan, 5e18, 1e300])
def test_steps_and_large_forms_of_prices(spark, tmp_path, price):
    """Steps beyond a long stay as they are, and no null is written as a text."""
    spark.createDataFrame([(1, 7, price, dt.datetime(1998, 2, 6))], "o_orderkey long, o_custkey long, o_totalprice double, o_orderdate timestamp_ntz").write.parquet(f"{tmp_path}/orders.parquet")
    stepped = __spark_entry__.queries()["scalar_forms"](spark, str(tmp_path)).head()["stepped"]
    assert stepped == price or math.isnan(stepped) and math.isnan(price)
    if price is None or not math.isfinite(price):
        assert _differences(spark, str(tmp_path), "text_formats", "orders") == (1, set())
