"""What registered queries share: their inputs, rounding, and the SQL of common steps."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions.text import nearest
from tickloom.sources import market

Query = Callable[[SparkSession, str], DataFrame]

#: Ticks and hourly bars in SQL; every oracle over bars starts with these.
TICKS_SQL = """ticks as (select event_type as symbol, ts, value as price, coalesce((props->>'$.k')::double, 0.0) as volume, event_id from events)"""
BARS_SQL = TICKS_SQL + """, bars as (
    select symbol, date_trunc('hour', ts)::timestamp as ts, first(price order by ts, event_id) as open, max(price) as high, min(price) as low,
           last(price order by ts, event_id) as close, sum(volume) as volume
    from ticks group by symbol, date_trunc('hour', ts))"""


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.ticks(market.table(spark, sf_dir, "events"))


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.bars(ticks(spark, sf_dir))


def rounded(rows: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to so many digits, so that engines that add in another order agree; minus zero becomes zero."""
    return rows.select([(nearest(F.col(c), digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in rows.dtypes])


def r(expression: str, name: str, digits: int = 6) -> str:
    """Rounding in SQL."""
    return f"round({expression}, {digits}) + 0.0 as {name}"


def over(n: int) -> str:
    return f"over (partition by symbol order by ts rows {n - 1} preceding)"


def full(n: int, aggregate: str, column: str) -> str:
    return f"case when count({column}) {over(n)} = {n} then {aggregate} {over(n)} end"


def lag(column: str, k: int = 1) -> str:
    return f"lag({column}, {k}) over (partition by symbol order by ts)"


def so_far(aggregate: str) -> str:
    return f"{aggregate} over (partition by symbol order by ts rows unbounded preceding)"


class Registry:
    """Queries by name, with their SQL."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, query: Query, oracle: str | None = None) -> None:
        if name in self.queries:
            raise ValueError(f"{name} is registered twice")
        self.queries[name] = query
        if oracle is not None:
            self.oracles[name] = oracle

    def over_bars(self, name: str, step: Callable[[DataFrame], DataFrame], columns: list[str], oracle: str | None = None) -> None:
        """A query that adds columns to hourly bars; the oracle is a select from `bars`, which may start with further common tables."""
        keep = ["symbol", "ts", *columns]
        self.add(name, lambda spark, d: rounded(step(bars(spark, d)).select(*keep)), None if oracle is None else f"with {BARS_SQL} {oracle}")
