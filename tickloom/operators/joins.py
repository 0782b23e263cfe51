"""Joins of quotes, positions and dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def arbitrage(quotes: DataFrame, least_pct: float = 0.5) -> DataFrame:
    """Pairs of venues of a symbol where one's bid is over the other's ask by at least `least_pct` percent; size: the smaller volume.

    An equi-join on the symbol; only pairs that pay come out.
    """
    buy = quotes.select("symbol", F.col("venue").alias("buy_venue"), F.col("ask").alias("buy_price"), F.col("volume").alias("_bv"))
    sell = quotes.select("symbol", F.col("venue").alias("sell_venue"), F.col("bid").alias("sell_price"), F.col("volume").alias("_sv"))
    profit = (F.col("sell_price") - F.col("buy_price")) / F.col("buy_price") * 100
    both = buy.join(sell, "symbol").where((F.col("buy_venue") != F.col("sell_venue")) & (F.col("sell_price") > F.col("buy_price")) & (profit >= least_pct))
    return both.select("symbol", "buy_venue", "sell_venue", "buy_price", "sell_price", profit.alias("profit_pct"), F.least("_bv", "_sv").alias("max_size"))


def best_venues(quotes: DataFrame, least_pct: float = 0.5) -> DataFrame:
    """The cheapest and the dearest venue of each symbol, where the last prices differ by more than `least_pct` percent: one aggregate, no pairs."""
    out = quotes.groupBy("symbol").agg(F.min_by("venue", F.struct("last", "venue")).alias("buy_venue"), F.max_by("venue", F.struct("last", "venue")).alias("sell_venue"), F.min("last").alias("buy_price"), F.max("last").alias("sell_price"))
    out = out.withColumn("profit_pct", (F.col("sell_price") - F.col("buy_price")) / F.nullif(F.col("buy_price"), F.lit(0.0)) * 100)
    return out.where((F.col("profit_pct") > least_pct) & (F.col("buy_venue") != F.col("sell_venue")))


#: Rows a dimension of currencies may have for its pairs to be listed.
MOST_CURRENCIES = 1000


def carry_pairs(rates: DataFrame, least: float = 0.1) -> DataFrame:
    """(long, short, differential, risk, score, advice) of ordered pairs i < j of a rate table (idx, currency, rate, risk) with differential over `least`.

    All pairs of a dimension: a table of over MOST_CURRENCIES rows is refused.
    """
    if rates.limit(MOST_CURRENCIES + 1).count() > MOST_CURRENCIES:
        raise ValueError(f"over {MOST_CURRENCIES} currencies")
    a = rates.select(F.col("idx").alias("_i"), F.col("currency").alias("long_currency"), F.col("rate").alias("_ra"), F.col("risk").alias("_ka"))
    b = rates.select(F.col("idx").alias("_j"), F.col("currency").alias("short_currency"), F.col("rate").alias("_rb"), F.col("risk").alias("_kb"))
    differential = F.col("_ra") - F.col("_rb")
    risk = (F.coalesce("_ka", F.lit(0.5)) + F.coalesce("_kb", F.lit(0.5))) / 2
    score = differential / (1 + risk)
    both = a.join(F.broadcast(b), F.col("_i") < F.col("_j")).where(differential > least)
    return both.select("long_currency", "short_currency", differential.alias("differential"), risk.alias("risk"), score.alias("score"), carry_advice(score).alias("advice"))


def carry_advice(score: Column) -> Column:
    return F.when(score > 3, "STRONG_BUY").when(score > 2, "BUY").when(score > 1, "HOLD").when(score > 0.5, "WEAK").otherwise("AVOID")


def mark_to_market(positions: DataFrame, prices: DataFrame) -> DataFrame:
    """Positions (account, symbol, quantity, avg_cost, side) with the latest price (symbol, price, change): value, unrealised profit, day's change; a position without a price keeps nulls."""
    both = positions.join(prices.select("symbol", "price", "change"), "symbol", "left")
    sign = F.when(F.col("side") == "SHORT", -1.0).otherwise(1.0)
    return both.withColumns({"market_value": F.col("quantity") * F.col("price"), "unrealised_pnl": sign * F.col("quantity") * (F.col("price") - F.col("avg_cost")), "unrealised_pct": F.when(F.col("avg_cost") != 0, sign * (F.col("price") / F.col("avg_cost") - 1) * 100), "day_change": sign * F.col("quantity") * F.col("change")})


def candidates(prices: DataFrame, positions: DataFrame) -> DataFrame:
    """Prices of symbols without a position."""
    return prices.join(positions.select("symbol"), "symbol", "left_anti")


def exits(marked: DataFrame, stop: float = 5.0, target: float = 10.0, most_loss: float = 10.0) -> DataFrame:
    """Positions to close, with the first reason that holds: STOP_LOSS, TAKE_PROFIT, LOSS_LIMIT."""
    p = F.col("unrealised_pct")
    reason = F.when(p <= -stop, "STOP_LOSS").when(p >= target, "TAKE_PROFIT").when(p < -most_loss, "LOSS_LIMIT")
    return marked.withColumn("reason", reason).where("reason is not null")


def total_by_key(tables: list[DataFrame], key: str, value: str) -> DataFrame:
    """Union of balances, summed by key."""
    merged = tables[0]
    for more in tables[1:]:
        merged = merged.unionByName(more)
    return merged.groupBy(key).agg(F.sum(value).alias(value))
