"""All queries of the library by name, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

from pyspark.sql import DataFrame, SparkSession

from tickloom.plans import anomaly_queries, breakout_queries, candle_queries, check_queries, feature_queries, indicator_queries, market_queries, news_queries, pattern_queries, portfolio_queries, range_queries, selector_queries, sequential_queries, small_queries, state_queries, strategy_queries, stream_queries, text_queries, trading_queries
from tickloom.plans.base import Registry

MODULES = (indicator_queries, sequential_queries, portfolio_queries, market_queries, text_queries, pattern_queries, stream_queries, strategy_queries, selector_queries, news_queries, feature_queries, trading_queries, small_queries, range_queries, state_queries, anomaly_queries, breakout_queries, candle_queries, check_queries)


@cache
def _all() -> Registry:
    reg = Registry()
    for module in MODULES:
        module.register(reg)
    return reg


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One trading cycle: hourly bars, indicators, regimes, marked positions, exits, entries, sizes and what the cash allows."""
    return trading_queries.cycle(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_all().queries)


def oracle_sql() -> dict[str, str]:
    return dict(_all().oracles)
