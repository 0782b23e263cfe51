"""Signals, sizing and order execution as column expressions over snapshots, positions and orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _capped(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def sentiment_part(sentiment: Column, threshold: float = 0.1) -> Column:
    """min(s + 0.5, 1) over the threshold, 0.5 above 0 or unknown, else 0.2."""
    return F.when(sentiment.isNull(), 0.5).when(sentiment > threshold, F.least(sentiment + 0.5, F.lit(1.0))).when(sentiment > 0, 0.5).otherwise(0.2)


def asset_factor(asset_type: Column) -> Column:
    return F.when(asset_type == "crypto", 0.9).when(asset_type == "forex", 1.1).when(asset_type == "commodity", 1.05).otherwise(1.0)


def bull_score(momentum: Column, volume: Column, technical: Column, regime: Column, sentiment: Column, asset_type: Column) -> Column:
    return (0.30 * momentum + 0.20 * volume + 0.25 * technical + 0.15 * regime + 0.10 * sentiment) * asset_factor(asset_type)


def bull_signal(score: Column) -> Column:
    return F.when(score >= 0.9, "STRONG_BUY").when(score >= 0.7, "BUY").otherwise("HOLD")


def crypto_momentum(momentum: Column, volume_momentum: Column, vol_factor: Column, multiplier: Column) -> Column:
    """tanh(2 (momentum * volatility factor + 0.3 volume momentum) * regime multiplier)."""
    return F.tanh(2 * (momentum * vol_factor + 0.3 * volume_momentum) * multiplier)


def consensus(votes: DataFrame, by: str = "symbol") -> DataFrame:
    """(by, bulls, bears, consensus, confidence) of (by, signal, confidence): a side of three or more that outnumbers the other; confidence: the side's mean times its share, at most 95."""
    bull, bear = F.col("signal").isin("BUY", "BULLISH", "OVERSOLD"), F.col("signal").isin("SELL", "BEARISH", "OVERBOUGHT")
    out = votes.groupBy(by).agg(F.count("*").alias("_n"), F.count_if(bull).alias("bulls"), F.count_if(bear).alias("bears"), F.avg(F.when(bull, F.col("confidence"))).alias("_b"), F.avg(F.when(bear, F.col("confidence"))).alias("_s"))
    up, down = (F.col("bulls") >= 3) & (F.col("bulls") > F.col("bears")), (F.col("bears") >= 3) & (F.col("bears") > F.col("bulls"))
    side = F.when(up, "BUY").when(down, "SELL").otherwise("NEUTRAL")
    sure = F.least(F.lit(95.0), F.when(up, F.col("_b") * F.col("bulls") / F.col("_n")).when(down, F.col("_s") * F.col("bears") / F.col("_n")).otherwise(0.0))
    return out.select(by, "bulls", "bears", side.alias("consensus"), sure.alias("confidence"))


def exits(positions: DataFrame, prices: DataFrame) -> DataFrame:
    """Open positions whose price is at the stop, else at the target, else 10 % under water, with the reason: an equi-join on the symbol."""
    both, long = positions.join(prices.select("symbol", "price"), "symbol"), F.col("side") == "BUY"
    stop = F.when(long, F.col("price") <= F.col("stop")).otherwise(F.col("price") >= F.col("stop"))
    target = F.when(long, F.col("price") >= F.col("target")).otherwise(F.col("price") <= F.col("target"))
    pnl = F.when(long, 1.0).otherwise(-1.0) * (F.col("price") - F.col("entry")) / F.col("entry") * 100
    out = both.withColumns({"pnl_pct": pnl, "reason": F.when(stop, "STOP_LOSS").when(target, "TAKE_PROFIT").when(pnl < -10, "LOSS_LIMIT")})
    return out.where("reason is not null")


def entries(snaps: DataFrame, positions: DataFrame) -> DataFrame:
    """Snapshots of symbols without an open position."""
    return snaps.join(positions.select("symbol"), "symbol", "left_anti")


def commission(value: Column) -> Column:
    """1 up to 1,000, 0.5 % up to 10,000, 0.1 % above."""
    return F.when(value <= 1000, 1.0).when(value <= 10000, value * 0.005).otherwise(value * 0.001)


def execution_price(price: Column, side: Column, volatility: Column, value: Column) -> Column:
    """Half a spread of 5 bp (1 + volatility / 10) and an impact of 1 bp per million against the order; no random part."""
    half = price * 0.0005 * (1 + volatility / 20 * 2) / 2
    impact = price * 0.0001 * value / 1e6
    return F.when(side == "BUY", price + half + impact).otherwise(price - half - impact)


def engine_size(value: Column, kelly: Column, volatility: Column, loss_pct: Column) -> Column:
    """The least of Kelly times min(1, 20 / max(volatility, 5)), a tenth, and 2 % of the value over the loss (5 % where there is none); null where value, Kelly or volatility is."""
    known = value.isNotNull() & kelly.isNotNull() & volatility.isNotNull()
    return F.when(known, F.least(value * kelly * F.least(F.lit(1.0), 20 / F.greatest(volatility, F.lit(5.0))), value * 0.1, value * 0.02 / F.coalesce(F.nullif(loss_pct, F.lit(0.0)), F.lit(0.05))))
