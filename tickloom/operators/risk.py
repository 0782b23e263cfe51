"""Portfolio, risk and performance aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.windows import in_order, so_far

YEAR = 252


def returns(series: DataFrame, value: str, by: str = "symbol", keep: int | None = None) -> DataFrame:
    """(by, ts, r): simple returns, none after a value that is not positive; with keep, each series' last so many."""
    before = F.lag(value).over(in_order(by))
    out = series.select(by, "ts", F.when(before > 0, F.col(value) / before - 1).alias("r")).where("r is not null")
    if keep is None:
        return out
    return out.withColumn("_rn", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("ts")))).where(F.col("_rn") <= keep).drop("_rn")


def value_at_risk(rets: DataFrame, by: str = "symbol", least: int = 30, value: float = 1.0) -> DataFrame:
    """VaR at 95 and 99 % (absolute interpolated percentile) and expected shortfall (mean of returns at or under the 5th percentile), times a value; 0 under `least` returns."""
    cuts = rets.groupBy(by).agg(F.count("*").alias("n"), F.percentile("r", 0.05).alias("p5"), F.percentile("r", 0.01).alias("p1"))
    tail = rets.join(cuts, by).where(F.col("r") <= F.col("p5")).groupBy(by).agg(F.avg("r").alias("tail"))
    enough = lambda c: F.when(F.col("n") >= least, F.abs(c) * value).otherwise(0.0)
    return cuts.join(tail, by, "left").select(by, "n", enough(F.col("p5")).alias("var_95"), enough(F.col("p1")).alias("var_99"), enough(F.col("tail")).alias("expected_shortfall"))


def volatility(rets: DataFrame, by: str = "symbol", least: int = 10, default: float = 0.2) -> DataFrame:
    """Population deviation a year; `default` under `least` returns."""
    n = F.count("*")
    return rets.groupBy(by).agg(F.when(n >= least, F.stddev_pop("r") * YEAR**0.5).otherwise(default).alias("volatility"))


def performance(rets: DataFrame, by: str = "symbol", risk_free: float = 0.0) -> DataFrame:
    """Count, compound return, Sharpe (sample deviation, not annualised), Sortino (mean over downside deviation), win rate."""
    excess = F.col("r") - risk_free
    n, sd = F.count("*"), F.stddev_samp(excess)
    down = F.sqrt(F.avg(F.pow(F.least(excess, F.lit(0.0)), 2)))
    return rets.groupBy(by).agg(
        n.alias("n"), (F.product(F.col("r") + 1) - 1).alias("compound_return"), F.when((n >= 2) & (sd > 0), F.avg(excess) / sd).otherwise(0.0).alias("sharpe"),
        F.when(down > 0, F.avg(excess) / down).otherwise(0.0).alias("sortino"), F.avg((F.col("r") > 0).cast("double")).alias("win_rate"),
    )


def drawdown(series: DataFrame, value: str, by: str = "symbol") -> DataFrame:
    """series with the running peak and the drawdown from it in percent."""
    out = series.withColumn("peak", F.max(value).over(so_far(by)))
    return out.withColumn("drawdown_pct", F.when(F.col("peak") > 0, (F.col("peak") - F.col(value)) / F.col("peak") * 100).otherwise(0.0))


def max_drawdown(series: DataFrame, value: str, by: str = "symbol") -> DataFrame:
    """Largest drawdown in percent, and the last one."""
    return drawdown(series, value, by).groupBy(by).agg(F.max("drawdown_pct").alias("max_drawdown_pct"), F.max_by("drawdown_pct", "ts").alias("current_drawdown_pct"))


def annualised(series: DataFrame, value: str, by: str = "symbol") -> DataFrame:
    """First and last value, days between, (last / first)^(365.25 / days) - 1."""
    out = series.groupBy(by).agg(F.min_by(value, "ts").alias("first_value"), F.max_by(value, "ts").alias("last_value"), F.datediff(F.max("ts"), F.min("ts")).alias("days"))
    grown = F.when((F.col("days") > 0) & (F.col("first_value") > 0), F.pow(F.col("last_value") / F.col("first_value"), 365.25 / F.col("days")) - 1)
    return out.withColumn("annualised_return", grown)


def trade_metrics(trades: DataFrame, by: str = "strategy") -> DataFrame:
    """From (by, pnl): trades, wins, win rate, mean win and loss, profit factor (infinite without a loss, 0 without a win), total."""
    win, loss = F.col("pnl") > 0, F.col("pnl") < 0
    out = trades.groupBy(by).agg(
        F.count("*").alias("trades"), F.count_if(win).alias("wins"), F.coalesce(F.avg(F.when(win, F.col("pnl"))), F.lit(0.0)).alias("avg_win"),
        F.coalesce(F.avg(F.when(loss, -F.col("pnl"))), F.lit(0.0)).alias("avg_loss"), F.coalesce(F.sum(F.when(win, F.col("pnl"))), F.lit(0.0)).alias("_won"),
        F.coalesce(F.sum(F.when(loss, -F.col("pnl"))), F.lit(0.0)).alias("_lost"), F.coalesce(F.sum("pnl"), F.lit(0.0)).alias("total_pnl"),
    )
    factor = F.when(F.col("_lost") > 0, F.col("_won") / F.col("_lost")).when(F.col("_won") > 0, F.lit(float("inf"))).otherwise(0.0)
    return out.withColumns({"win_rate": F.col("wins") / F.col("trades"), "profit_factor": factor}).drop("_won", "_lost")


def kelly(metrics: DataFrame, confidence: float = 1.0, cost: float = 0.001) -> DataFrame:
    """(b p - q) / b times confidence and 1 - cost, in 0..0.25; 0.02 under 20 trades, 0.01 without a loss."""
    b = F.col("avg_win") / F.nullif(F.col("avg_loss"), F.lit(0.0))
    raw = (b * F.col("win_rate") - (1 - F.col("win_rate"))) / F.nullif(b, F.lit(0.0)) * confidence * (1 - cost)
    fraction = F.when(F.col("trades") < 20, 0.02).when(F.col("avg_loss") == 0, 0.01).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(0.25), F.coalesce(raw, F.lit(0.0)))))
    return metrics.withColumn("kelly", fraction)


def best_strategies(metrics: DataFrame, least: int = 10, limit: int = 5, by: str = "strategy") -> DataFrame:
    """Of strategies with enough trades, the first by profit times win rate: a report of `limit` rows."""
    return metrics.where(F.col("trades") >= least).withColumn("score", F.col("total_pnl") * F.col("win_rate")).orderBy(F.desc("score"), by).limit(limit)


def weights(positions: DataFrame, by: str = "account") -> DataFrame:
    """Each position's share of its account's market value."""
    return positions.withColumn("weight", F.col("market_value") / F.nullif(F.sum("market_value").over(Window.partitionBy(by)), F.lit(0.0)))


def rebalancing(positions: DataFrame, targets: DataFrame, by: str = "account", limit: float = 0.05) -> DataFrame:
    """Targets (by, symbol, target) against weights, a missing weight being 0; drifted: off by more than the limit."""
    current = weights(positions, by).select(by, "symbol", "weight")
    both = targets.join(current, [by, "symbol"], "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    return both.withColumn("drift", F.col("weight") - F.col("target")).withColumn("drifted", F.abs("drift") > limit)


def exposure(positions: DataFrame, cash: float, by: str = "account") -> DataFrame:
    """Value with cash, leverage, beta (1 where missing), largest weight, positions, long and short counts."""
    mv = F.col("market_value")
    out = positions.groupBy(by).agg(F.count("*").alias("positions"), F.sum(mv).alias("market_value"), F.sum(F.abs(mv)).alias("_gross"), F.sum(F.abs(mv) * F.coalesce("beta", F.lit(1.0))).alias("_beta"), F.max(F.abs(mv)).alias("_most"), F.count_if(mv > 0).alias("long_count"), F.count_if(mv < 0).alias("short_count"))
    total = F.col("market_value") + cash
    ratio = lambda c: F.when(total != 0, F.col(c) / total).otherwise(0.0)
    return out.select(by, "positions", total.alias("total_value"), ratio("_gross").alias("leverage"), ratio("_beta").alias("beta"), ratio("_most").alias("max_weight"), "long_count", "short_count")


def allocation(positions: DataFrame, by: str = "asset_type") -> DataFrame:
    """Market value and share of the whole by type."""
    out = positions.groupBy(by).agg(F.count("*").alias("positions"), F.sum("market_value").alias("market_value"))
    return out.withColumn("share", F.col("market_value") / F.sum("market_value").over(Window.partitionBy()))  # a row a type


def risk_events(metrics: DataFrame, by: str = "account", most_drawdown: float = 15.0) -> DataFrame:
    """One row for each limit that an account breaks: drawdown over the limit, leverage over 1.5 (HIGH) or 2 (CRITICAL), a weight over 10 %."""
    event = lambda cond, kind, level, value: F.when(cond, F.struct(F.lit(kind).alias("event"), level.alias("severity"), value.alias("value")))
    lever, weight, fall = F.col("leverage"), F.col("max_weight"), F.col("drawdown_pct")
    every = F.array(event(fall > most_drawdown, "DRAWDOWN", F.lit("HIGH"), fall), event(lever > 1.5, "LEVERAGE", F.when(lever > 2, "CRITICAL").otherwise("HIGH"), lever), event(weight > 0.10, "CONCENTRATION", F.lit("MEDIUM"), weight))
    return metrics.select(by, F.explode(F.filter(every, lambda x: x.isNotNull())).alias("e")).select(by, "e.*")


def position_risk_score(weight: Column, beta: Column, vol: Column, correlation: Column) -> Column:
    """0.3 weight/0.1 + 0.3 beta/2 + 0.2 volatility/50 + 0.2 correlation, each ratio and the sum at most 1."""
    capped = lambda c: F.least(c, F.lit(1.0))
    return capped(0.3 * capped(weight / 0.1) + 0.3 * capped(beta / 2) + 0.2 * capped(vol / 50) + 0.2 * capped(correlation))


def risk_level(score: Column) -> Column:
    return F.when(score >= 6, "CRITICAL").when(score >= 4, "HIGH").when(score >= 2, "MEDIUM").otherwise("LOW")


def position_size(value: Column, entry: Column, stop: Column, confidence: Column, risk: float = 0.02, most: float = 0.1) -> Column:
    """Shares by risk: value * risk / |entry - stop| times confidence, at most `most` of the value in shares; without a stop 5 % of the value."""
    gap = F.abs(entry - stop)
    shares = F.when(stop.isNull() | (gap == 0), value * 0.05 / entry).otherwise(value * risk / gap * F.least(confidence / 100, F.lit(1.0)))
    return F.least(shares, value * most / entry)


def stop_loss(entry: Column, asset_type: Column, vol: Column, side: Column) -> Column:
    """5 % stock, 10 % crypto, 2 % forex, 7 % commodity, 4 % other, times 1.5 over 20 % volatility; below a long entry, above a short one."""
    share = F.when(asset_type == "stock", 0.05).when(asset_type == "crypto", 0.10).when(asset_type == "forex", 0.02).when(asset_type == "commodity", 0.07).otherwise(0.04)
    share = share * F.when(vol > 20, 1.5).otherwise(1.0)
    return F.when(side == "SELL", entry * (1 + share)).otherwise(entry * (1 - share))


def take_profit(entry: Column, stop: Column, ratio: float = 2.0) -> Column:
    return entry + ratio * (entry - stop)


def cross_section(snaps: DataFrame, by: str = "ts") -> DataFrame:
    """Features over all symbols of a time: change mean, deviation, share up and largest; log volume mean and relative deviation; agreement of direction; coherence."""
    change, volume = F.col("change_pct"), F.log1p("volume")
    n, up, down = F.count(change), F.count_if(change > 0), F.count_if(change < 0)
    stats = snaps.groupBy(by).agg(
        F.count("*").alias("symbols"), F.avg(change).alias("mean_change"), F.stddev_pop(change).alias("std_change"), (up / F.nullif(n, F.lit(0))).alias("share_up"), F.max(F.abs(change)).alias("max_change"),
        F.avg(volume).alias("mean_log_volume"), (F.stddev_pop(volume) / (F.avg(volume) + 1e-8)).alias("cv_volume"), F.when(n < 2, 0.5).otherwise(F.greatest(up, down) / n).alias("agreement"), n.alias("_n"),
    )
    away = snaps.join(stats.select(by, F.col("mean_change").alias("_m")), by).groupBy(by).agg(F.avg(F.abs(change - F.col("_m"))).alias("_mad"))
    out = stats.join(away, by)
    coherent = F.when((F.col("_n") < 2) | (F.col("std_change") == 0), 0.5).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("_mad") / F.col("std_change"))))
    return out.withColumn("coherence", coherent).drop("_n", "_mad")


def execution_summary(orders: DataFrame, fills: DataFrame, by: str = "status") -> DataFrame:
    """Orders ⟕ fills by status: orders, filled, notional, commission, mean fill rate."""
    done = fills.groupBy("order_id").agg(F.sum("quantity").alias("filled"), F.sum(F.col("quantity") * F.col("price")).alias("notional"), F.sum("commission").alias("commission"))
    both = orders.join(done, "order_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return both.groupBy(by).agg(F.count("*").alias("orders"), F.sum(zero("filled")).alias("filled"), F.sum(zero("notional")).alias("notional"), F.sum(zero("commission")).alias("commission"), F.avg(F.when(F.col("order_quantity") > 0, zero("filled") / F.col("order_quantity"))).alias("fill_rate"))


