"""Summaries for reports: top positions, totals of accounts, running results, validation scores, alerts, votes of indicators, filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators import risk


def valued(positions: DataFrame, price: Column) -> DataFrame:
    """Positions (side, quantity, entry) with their market value at the entry and their gain at a price."""
    gain = F.when(F.col("side") == "LONG", price - F.col("entry")).otherwise(F.col("entry") - price) * F.col("quantity")
    return positions.withColumns({"market_value": F.col("quantity") * F.col("entry"), "gain": gain})


def top_positions(rows: DataFrame, k: int = 5) -> DataFrame:
    """A report: the k positions of the largest market value, either sign, ties by account and symbol."""
    return rows.orderBy(F.desc(F.abs("market_value")), "account", "symbol").limit(k)


def newest(rows: DataFrame, k: int, ts: str = "ts", ties: str = "event_id") -> DataFrame:
    """A report: the k newest rows, the larger tie first."""
    return rows.orderBy(F.desc(ts), F.desc(ties)).limit(k)


def account_totals(rows: DataFrame) -> DataFrame:
    """(account, positions, market_value, unrealized, largest, long, winning) of valued positions."""
    return rows.groupBy("account").agg(F.count("*").alias("positions"), F.sum("market_value").alias("market_value"), F.sum("gain").alias("unrealized"), F.max("market_value").alias("largest"), F.count_if(F.col("side") == "LONG").alias("long"), F.count_if(F.col("gain") > 0).alias("winning"))


def risk_metrics(series: DataFrame, value: str = "price", worth: float = 1000.0, by: str = "symbol") -> DataFrame:
    """(by, n, var_95, var_99, expected_shortfall, volatility, sharpe, win_rate, max_drawdown_pct, risk_adjusted) of each series (by, ts, value); risk_adjusted is a positive Sharpe ratio a year, else 0.

    Returns and drawdowns come from one window; all but the tail's mean is one aggregate.
    """
    window = Window.partitionBy(by).orderBy("ts")
    before, peak = F.lag(value).over(window), F.max(value).over(window.rowsBetween(Window.unboundedPreceding, 0))
    rows = series.select(by, F.when(before > 0, F.col(value) / before - 1).alias("r"), F.when(peak > 0, (peak - F.col(value)) / peak * 100).otherwise(0.0).alias("down"))
    n, sd = F.count("r"), F.stddev_samp("r")
    one = rows.groupBy(by).agg(
        n.alias("n"), F.percentile("r", 0.05).alias("p5"), F.percentile("r", 0.01).alias("p1"), F.when(n >= 10, F.stddev_pop("r") * risk.YEAR**0.5).otherwise(0.2).alias("volatility"),
        F.when((n >= 2) & (sd > 0), F.avg("r") / sd).otherwise(0.0).alias("sharpe"), F.avg(F.when(F.col("r").isNotNull(), (F.col("r") > 0).cast("double"))).alias("win_rate"), F.max("down").alias("max_drawdown_pct"),
    ).where("n > 0")
    tail = rows.join(one.select(by, "p5"), by).where(F.col("r") <= F.col("p5")).groupBy(by).agg(F.avg("r").alias("tail"))
    enough = lambda c: F.when(F.col("n") >= 30, F.abs(c) * worth).otherwise(0.0)
    out = one.join(tail, by, "left").withColumns({"var_95": enough("p5"), "var_99": enough("p1"), "expected_shortfall": enough("tail"), "risk_adjusted": F.when(F.col("sharpe") > 0, F.col("sharpe") * risk.YEAR**0.5).otherwise(0.0)})
    return out.select(by, "n", "var_95", "var_99", "expected_shortfall", "volatility", "sharpe", "win_rate", "max_drawdown_pct", "risk_adjusted")


def validation_summary(scores: DataFrame, last: int = 10, by: str = "symbol") -> DataFrame:
    """(by, mean_score, least, most, trend) of the last scores (by, ts, score) of each series: improving if the newest is over the oldest of them. Null scores do not count."""
    recent = scores.where("score is not null").withColumn("_rn", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("ts")))).where(F.col("_rn") <= last)
    better = F.max_by("score", "ts") > F.min_by("score", "ts")
    return recent.groupBy(by).agg(F.avg("score").alias("mean_score"), F.min("score").alias("least"), F.max("score").alias("most"), F.when(better, "improving").otherwise("declining").alias("trend"))


def running_metrics(results: DataFrame, by: str = "symbol") -> DataFrame:
    """(by, ts, n, mean_confidence, success_rate) so far, of results (by, ts, confidence, success); success is null where it is not known, and then does not count."""
    order = Window.partitionBy(by).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    return results.select(by, "ts", F.count("*").over(order).alias("n"), F.avg("confidence").over(order).alias("mean_confidence"), F.avg(F.col("success").cast("double")).over(order).alias("success_rate"))


def alerting(snaps: DataFrame, high: float = 70, low: float = 30, move: float = 3, sure: float = 85) -> DataFrame:
    """Snapshots that give an alert, with `type` (RSI_HIGH, RSI_LOW, MOVE in percent) and `priority`."""
    kind = F.when(F.col("rsi") > high, "RSI_HIGH").when(F.col("rsi") < low, "RSI_LOW").when(F.abs("change_pct") > move, "MOVE")
    return snaps.withColumns({"type": kind, "priority": F.when(F.col("confidence") > sure, "HIGH").otherwise("NORMAL")}).where("type is not null")


def alert_counts(alerts: DataFrame) -> DataFrame:
    """(type, priority, alerts, last_ts)."""
    return alerts.groupBy("type", "priority").agg(F.count("*").alias("alerts"), F.max("ts").alias("last_ts"))


def alert_history(alerts: DataFrame, k: int = 50) -> DataFrame:
    """A report: the k newest alerts, ties by symbol."""
    return alerts.orderBy(F.desc("ts"), "symbol").limit(k)


def indicator_votes(snaps: DataFrame, by: str = "symbol") -> DataFrame:
    """(by, name, signal, sure) of each snapshot: RSI beyond 70 and 30 at the snapshot's confidence, signs of MACD and momentum at 60 and 50."""
    side = lambda c: F.when(F.col(c) > 0, "BULLISH").otherwise("BEARISH")
    vote = lambda name, signal, sure: F.struct(F.lit(name).alias("name"), signal.alias("signal"), sure.alias("sure"))
    rsi = F.when(F.col("rsi") > 70, "BEARISH").when(F.col("rsi") < 30, "BULLISH").otherwise("HOLD")
    return snaps.select(by, F.explode(F.array(vote("rsi", rsi, F.col("confidence")), vote("macd", side("macd"), F.lit(60.0)), vote("momentum", side("momentum"), F.lit(50.0)))).alias("v")).select(by, "v.*")


def indicator_summary(votes: DataFrame, by: str = "symbol") -> DataFrame:
    """(by, indicators, bullish, bearish, neutral, mean_confidence) of votes."""
    n = lambda *names: F.count_if(F.col("signal").isin(*names))
    return votes.groupBy(by).agg(F.count("*").alias("indicators"), n("BULLISH").alias("bullish"), n("BEARISH").alias("bearish"), n("HOLD", "NEUTRAL").alias("neutral"), F.avg("sure").alias("mean_confidence"))


def matching(snaps: DataFrame, price: tuple[float, float], volume: float, change: tuple[float, float]) -> DataFrame:
    """Snapshots with a price and a change in percent within bounds, both included, and enough volume."""
    return snaps.where(F.col("price").between(*price) & (F.col("volume") >= volume) & F.col("change_pct").between(*change))
