"""Choosing strategies: scores of strategies from their results, then the choice by several methods. All native; strategies are a small fixed table, results are grouped first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.strategies import at_least, at_most, by_name

# Strategies in order of preference by regime, and by asset type with their points.
BY_REGIME = {"BULL": ("bull", "breakout"), "BEAR": ("bear", "volatility"), "SIDEWAYS": ("volatility", "range"), "VOLATILE": ("volatility", "breakout"), "BREAKOUT": ("breakout", "bull"), "BREAKDOWN": ("bear", "volatility")}
BY_ASSET = {"stock": {"bull": 15.0, "bear": 15.0, "breakout": 8.0, "volatility": 8.0}, "crypto": {"volatility": 15.0, "breakout": 15.0, "bull": 8.0, "bear": 8.0}, "forex": {"volatility": 15.0, "range": 15.0, "breakout": 8.0}}
STRATEGIES = ("bear", "breakout", "bull", "range", "volatility")
WEIGHTS = {"suitability": 0.3, "performance": 0.25, "risk": 0.25, "confidence": 0.2}


def clipped(c: Column, low: float, high: float) -> Column:
    return at_least(at_most(c, high), low)


def suitability(strategy: Column, regime: Column, asset_type: Column, volatility: Column) -> Column:
    """50, up to 30 by the regime's order, 15 or 8 by the asset type, up to 10 either way by the volatility (a year, as a share), in 0..100."""
    rank = F.lit(0.0)
    for name, order in BY_REGIME.items():
        for k, s in enumerate(order):
            rank = F.when((regime == name) & (strategy == s), 30.0 * (1 - k / len(order))).otherwise(rank)
    asset = F.lit(0.0)
    for name, points in BY_ASSET.items():
        asset = F.when(asset_type == name, by_name(strategy, points, 0.0)).otherwise(asset)
    vol = F.coalesce(volatility, F.lit(0.2))
    fit = (
        F.when(strategy == "volatility", F.when(vol > 0.3, 10.0).when(vol < 0.15, -10.0).otherwise(0.0)).when(strategy == "breakout", F.when(vol.between(0.2, 0.4), 10.0).otherwise(0.0))
        .when(strategy.isin("bull", "bear"), F.when(vol < 0.25, 10.0).otherwise(0.0)).otherwise(0.0)
    )
    return clipped(50 + rank + asset + fit, 0.0, 100.0)


def results(trades: DataFrame, as_of: Column, days: int = 30, least: int = 10) -> DataFrame:
    """(strategy, trades, mean_return, volatility, win_rate, drawdown, performance, risk, confidence) of trades (strategy, ts, ret, trade_id) of the last days.

    The drawdown goes by compounded returns in order of time. Under `least` trades performance and risk are 50; the confidence counts trades,
    their evenness and how recent the last one is. One window a strategy for the drawdown, else partial sums.
    """
    age = (F.unix_timestamp(as_of.cast("timestamp")) - F.unix_timestamp(F.col("ts").cast("timestamp"))) / 86400
    recent = trades.where(age.between(0, days))
    order = Window.partitionBy("strategy").orderBy("ts", "trade_id").rowsBetween(Window.unboundedPreceding, 0)
    path = recent.withColumn("_w", F.exp(F.sum(F.log1p("ret")).over(order)))
    path = path.withColumn("_d", 1 - F.col("_w") / F.max("_w").over(order))
    out = path.groupBy("strategy").agg(F.count("*").alias("trades"), F.avg("ret").alias("mean_return"), F.stddev_pop("ret").alias("volatility"), F.avg((F.col("ret") > 0).cast("double")).alias("win_rate"), F.max("_d").alias("drawdown"), F.floor(F.min(age)).alias("_days"))
    m, v, n = F.col("mean_return"), F.col("volatility"), F.col("trades")
    sharpe = F.when(v > 0, m / v).otherwise(0.0)
    performance = clipped(50 + F.col("win_rate") * 30 + clipped(m * 1000, -20.0, 20.0), 0.0, 100.0)
    risk = clipped(50 + clipped(sharpe * 25, -25.0, 25.0) + clipped(-F.col("drawdown") * 100, -15.0, 15.0) + clipped(-v * 200, -10.0, 10.0), 0.0, 100.0)
    even = F.when(n >= 5, clipped((1 - v / (F.abs(m) + 0.01)) * 40, 0.0, 40.0)).otherwise(20.0)
    confidence = clipped(at_most(n / least * 20, 40.0) + even + at_least(20.0 - F.col("_days"), 0.0), 0.0, 100.0)
    return out.withColumns({"performance": F.when(n >= least, performance).otherwise(50.0), "risk": F.when(n >= least, risk).otherwise(50.0), "confidence": confidence}).drop("_days")


def conditions(snaps: DataFrame) -> DataFrame:
    """snaps with what the choice looks at: volatility as a share, distance from the mean of 20, volume against the mean of 10, move of 4 rows."""
    from tickloom.functions.windows import full, lag, mean

    m = mean("price", 20)
    return snaps.withColumns({"volatility_share": F.col("volatility") / 100, "trend_strength": F.abs(F.col("price") - m) / m, "volume_trend": F.col("volume") / F.nullif(full("volume", F.avg("volume"), 10), F.lit(0.0)), "move_4": F.col("price") / lag("price", 4) - 1})


def scored(states: DataFrame, found: DataFrame) -> DataFrame:
    """A row for each state (symbol, regime, asset_type, volatility) and strategy with suitability, the results' scores (50, 50 and 20 without results) and their weighted sum `composite`. The results are one row a strategy and are broadcast."""
    every = states.withColumn("strategy", F.explode(F.array(*[F.lit(s) for s in STRATEGIES])))
    out = every.withColumn("suitability", suitability(F.col("strategy"), F.col("regime"), F.col("asset_type"), F.col("volatility")))
    known = found.select("strategy", "performance", "risk", "confidence", "mean_return", F.col("volatility").alias("return_volatility"))
    out = out.join(F.broadcast(known.where(F.col("strategy").isin(*STRATEGIES))), "strategy", "left").fillna({"performance": 50.0, "risk": 50.0, "confidence": 20.0, "mean_return": 0.0, "return_volatility": 0.0})
    total = sum((F.col(k) * w for k, w in list(WEIGHTS.items())[1:]), F.col("suitability") * WEIGHTS["suitability"])
    return out.withColumn("composite", F.round(total, 9))


def rankings(scores: DataFrame) -> DataFrame:
    """Scores with their place for each symbol, best composite first, ties by name."""
    return scores.withColumn("place", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("composite"), "strategy")))


def choices(scores: DataFrame) -> DataFrame:
    """(symbol, regime, by_regime, best, by_risk, ensemble, ensemble_return, ensemble_risk, adaptive) of each symbol.

    by_regime: the best composite among the regime's own, the best of all where it has none. ensemble: the first three of 40 and more with weights in
    proportion, at least a tenth, made to sum to one; its risk takes strategies as independent. adaptive: the ensemble, if it has several, returns over 1.1 and risks under
    1.2 times the regime's choice; else that.
    """
    own = F.lit(False)
    for name, order in BY_REGIME.items():
        own = own | ((F.col("regime") == name) & F.col("strategy").isin(*order))
    s = F.struct((-F.col("composite")).alias("c"), "strategy", "mean_return", "return_volatility", (-F.col("risk")).alias("r"))
    rows = scores.withColumn("_own", F.coalesce(own, F.lit(False))).groupBy("symbol", "regime").agg(F.array_sort(F.collect_list(s)).alias("_all"), F.array_sort(F.collect_list(F.when(F.col("_own"), s))).alias("_own"), F.min_by("strategy", F.struct((-F.col("risk")).alias("r"), "strategy")).alias("by_risk"))  # five rows a symbol
    rows = rows.withColumn("_r", F.coalesce(F.try_element_at("_own", F.lit(1)), F.element_at("_all", 1)))
    rows = rows.withColumn("_e", F.slice(F.filter("_all", lambda x: -x["c"] >= 40), 1, 3))
    rows = rows.withColumn("_e", F.when(F.size("_e") > 0, F.col("_e")).otherwise(F.slice("_all", 1, 1)))
    total = F.aggregate("_e", F.lit(0.0), lambda a, x: a - x["c"])
    rows = rows.withColumn("_w", F.transform("_e", lambda x: F.greatest(F.lit(0.1), -x["c"] / total)))
    rows = rows.withColumn("_w", F.transform("_w", lambda w: w / F.aggregate("_w", F.lit(0.0), lambda a, x: a + x)))
    both = F.arrays_zip("_e", "_w")
    rows = rows.withColumns({"ensemble_return": F.aggregate(both, F.lit(0.0), lambda a, x: a + x["_w"] * x["_e"]["mean_return"]), "ensemble_risk": F.sqrt(F.aggregate(both, F.lit(0.0), lambda a, x: a + F.pow(x["_w"] * x["_e"]["return_volatility"], F.lit(2))))})
    names = F.array_join(F.transform("_e", lambda x: x["strategy"]), "+")
    better = (F.size("_e") > 1) & (F.col("ensemble_return") > F.col("_r.mean_return") * 1.1) & (F.col("ensemble_risk") < F.col("_r.return_volatility") * 1.2)
    return rows.select("symbol", "regime", F.col("_r.strategy").alias("by_regime"), F.element_at("_all", 1)["strategy"].alias("best"), "by_risk", names.alias("ensemble"), "ensemble_return", "ensemble_risk", F.when(better, names).otherwise(F.col("_r.strategy")).alias("adaptive"))


def stable(decisions: DataFrame, n: int = 5, share: float = 0.6) -> DataFrame:
    """Decisions (symbol, ts, choice) with `kept`: the most frequent choice of the last n if it has the share of them, else the choice; before n decisions the choice. Of equally frequent ones the first by name."""
    frame = Window.partitionBy("symbol").orderBy("ts").rowsBetween(-(n - 1), 0)
    seen = decisions.withColumn("_seen", F.collect_list("choice").over(frame))
    count = lambda name: F.size(F.filter("_seen", lambda x: x == name))
    best = F.array_min(F.transform(F.array_distinct("_seen"), lambda x: F.struct((-count(x)).alias("n"), x.alias("name"))))
    out = seen.withColumn("_best", best)
    return out.withColumn("kept", F.when((F.size("_seen") == n) & (-F.col("_best.n") >= n * share), F.col("_best.name")).otherwise(F.col("choice"))).drop("_seen", "_best")


def due(decisions: DataFrame, minutes: float = 60) -> Column:
    """Whether a decision is at least so many minutes after the symbol's one before."""
    before = F.lag("ts").over(Window.partitionBy("symbol").orderBy("ts"))
    return F.coalesce((F.unix_timestamp(F.col("ts").cast("timestamp")) - F.unix_timestamp(before.cast("timestamp"))) / 60 >= minutes, F.lit(True))
