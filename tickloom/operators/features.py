"""Feature vectors: of the whole market at a time, and of a symbol at each row; scaling, selection, trust; regimes by trees of thresholds."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.windows import in_order, lag, last
from tickloom.operators.strategies import at_least, at_most

# Codes of asset types.
ASSET_CODES = {"stock": 0.1, "crypto": 0.3, "forex": 0.5, "commodity": 0.7, "etf": 0.2, "index": 0.4, "bond": 0.6, "option": 0.9}
MARKET = ("change_mean", "change_std", "bullish_ratio", "change_max_abs", "volume_log_mean", "volume_spread", "rsi_mean", "macd_mean", "volatility_mean", "sentiment_mean", "sentiment_std", "positive_ratio")


def asset_code(asset_type: Column) -> Column:
    out = F.lit(0.5)
    for name, code in ASSET_CODES.items():
        out = F.when(asset_type == name, code).otherwise(out)
    return out


def market(snaps: DataFrame, by: str = "ts") -> DataFrame:
    """(by, the twelve MARKET features, agreement, n): one partial aggregate over all symbols of a time. Missing RSI counts as 50, MACD as 0, volatility as 20, sentiment as 0, volume as 0; without any volume both volume features are 0."""
    chg, logv = F.coalesce("change_pct", F.lit(0.0)), F.log1p(F.coalesce("volume", F.lit(0.0)))
    sent, some = F.coalesce("sentiment", F.lit(0.0)), F.sum("volume") > 0
    share = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("double"))
    return snaps.groupBy(by).agg(
        F.avg(chg).alias("change_mean"), F.stddev_pop(chg).alias("change_std"), share(chg > 0).alias("bullish_ratio"), F.max(F.abs(chg)).alias("change_max_abs"),
        F.when(some, F.avg(logv)).otherwise(0.0).alias("volume_log_mean"), F.when(some, F.stddev_pop(logv) / (F.avg(logv) + 1e-8)).otherwise(0.0).alias("volume_spread"),
        F.avg(F.coalesce("rsi", F.lit(50.0))).alias("rsi_mean"), F.avg(F.coalesce("macd", F.lit(0.0))).alias("macd_mean"), F.avg(F.coalesce("volatility", F.lit(20.0))).alias("volatility_mean"),
        F.avg(sent).alias("sentiment_mean"), F.stddev_pop(sent).alias("sentiment_std"), share(sent > 0.1).alias("positive_ratio"),
        (F.greatest(F.count_if(chg > 0), F.count_if(chg < 0)) / F.count("*")).alias("agreement"), F.count("*").alias("n"),
    )


def market_short(snaps: DataFrame, by: str = "ts") -> DataFrame:
    """(by, eight features): change, its deviation, volatility (or |change|) and its deviation, volume, coherence (1 less mean over standard deviation of change, in 0..1; 0.5 for one symbol), liquidity, sentiment."""
    vol, chg = F.coalesce("volatility", F.abs("change_pct"), F.lit(0.0)), F.coalesce("change_pct", F.lit(0.0))
    rows = snaps.withColumns({"_c": chg, "_v": vol})
    means = rows.groupBy(by).agg(F.avg("_c").alias("_m"))
    rows = rows.join(means, by)
    return rows.groupBy(by).agg(
        F.avg("_c").alias("change_mean"), F.stddev_pop("_c").alias("change_std"), F.avg("_v").alias("volatility_mean"), F.stddev_pop("_v").alias("volatility_std"), F.coalesce(F.avg(F.when(F.col("volume") != 0, F.col("volume"))), F.lit(0.0)).alias("volume_mean"),
        F.when(F.count("*") < 2, 0.5).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.avg(F.abs(F.col("_c") - F.col("_m"))) / (F.stddev_pop("_c") + 1e-8)))).alias("coherence"),
        F.avg(F.coalesce("liquidity", F.lit(0.5))).alias("liquidity"), F.avg(F.coalesce("sentiment", F.lit(0.0))).alias("sentiment_mean"),
    )


def volume_trend(rows: DataFrame, by: str = "symbol", order: str = "ts", n: int = 5) -> DataFrame:
    """(by, volume_trend): the mean of the last n volumes against that of all before them; 0 without any before."""
    ranked = rows.withColumn("_rn", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(order))))
    new, old = F.avg(F.when(F.col("_rn") <= n, F.col("volume"))), F.avg(F.when(F.col("_rn") > n, F.col("volume")))
    return ranked.groupBy(by).agg(F.when(old > 0, (new - old) / old).otherwise(0.0).alias("volume_trend"))


def against_first(rows: DataFrame, columns: tuple[str, ...] = MARKET, order: str = "ts") -> DataFrame:
    """rows with every feature less that of the first row, in -3..3; null counts as 0. The first row is one row and is broadcast."""
    first = rows.agg(*[F.min_by(c, order).alias(f"_{c}") for c in columns])
    out = rows.crossJoin(F.broadcast(first))
    return out.withColumns({c: at_least(at_most(F.coalesce(c, F.lit(0.0)) - F.coalesce(f"_{c}", F.lit(0.0)), 3.0), -3.0) for c in columns}).drop(*[f"_{c}" for c in columns])


def regime_tree(change: Column, volatility: Column, activity: Column, sentiment: Column) -> Column:
    """By a change of 2 %, a volatility of 30 and 40, and, in calm, volume activity over 0.6 with sentiment beyond 0.1."""
    up, down, size = change > 0, change < 0, F.abs(change)
    calm = F.when((activity > 0.6) & (sentiment > 0.1), "ACCUMULATION").when((activity > 0.6) & (sentiment < -0.1), "DISTRIBUTION").otherwise("SIDEWAYS")
    return F.when((size > 2) & up, F.when(volatility > 30, "BREAKOUT").otherwise("BULL")).when((size > 2) & down, F.when(volatility > 30, "BREAKDOWN").otherwise("BEAR")).when(volatility > 40, "VOLATILE").when(size < 0.5, calm).otherwise("SIDEWAYS")


def regime_tree_by_volume(change: Column, volatility: Column, trend: Column) -> Column:
    """The same tree with the volume's trend, beyond 0.2 either way, in calm."""
    return regime_tree(change, volatility, F.when(F.abs(trend) > 0.2, 1.0).otherwise(0.0), trend)


def regime_tree_short(change: Column, strength: Column, volatility: Column, clustering: Column, volume: Column, coherence: Column, sentiment: Column) -> Column:
    return (
        F.when((change > 2) & (volatility < 3) & (sentiment > 0.3), "BULL").when((change > 0.5) & (strength > 2) & (volume > 0.7), "BREAKOUT").when((change < -2) & (volatility > 4), "BEAR").when((change < -0.5) & (strength > 2), "BREAKDOWN")
        .when((volatility > 5) & (clustering > 2), "VOLATILE").when((F.abs(change) < 0.3) & (coherence > 0.7) & (volume > 0.6), "ACCUMULATION").when((F.abs(change) < 0.3) & (coherence < 0.4), "DISTRIBUTION").otherwise("SIDEWAYS")
    )


def adaptive(accuracy: Column, stability: Column, drifted: Column, threshold: float = 0.75, rate: float = 0.14) -> dict[str, Column]:
    """Threshold by recent accuracy (over 0.9 a twentieth up to 0.9, under 0.7 down to 0.5) and rate by stability (over 0.8 a fifth down to 0.05, under 0.6 up to 0.3); a drift takes the threshold to 0.9 of its base and the rate to 1.5."""
    by_accuracy = F.when(accuracy > 0.9, min(0.9, threshold * 1.05)).when(accuracy < 0.7, max(0.5, threshold * 0.95)).otherwise(threshold)
    by_stability = F.when(stability > 0.8, max(0.05, rate * 0.8)).when(stability < 0.6, min(0.3, rate * 1.2)).otherwise(rate)
    return {"threshold": F.when(drifted, max(0.5, threshold * 0.9)).otherwise(by_accuracy), "rate": F.when(drifted, min(0.3, rate * 1.5)).otherwise(by_stability)}


def decayed(size: Column, steps: Column, rate: float = 0.02) -> Column:
    """A cluster's size after so many steps without a member, not under 1."""
    return at_least(size * F.pow(F.lit(1 - rate), steps), 1.0)


def drift_trend(scores: DataFrame, by: str = "symbol", order: str = "ts", n: int = 10) -> DataFrame:
    """scores with the slope of the last n scores; 0 before there are n."""
    out = scores.withColumn("_i", F.row_number().over(in_order(by, order)).cast("double"))
    frame = last(n, by, order)
    return out.withColumn("drift_trend", F.when(F.count("score").over(frame) == n, F.regr_slope("score", "_i").over(frame)).otherwise(0.0)).drop("_i")


def context_confidence(confidence: Column, share: Column, agreement: Column, drift: Column) -> Column:
    """Times 0.7 + 0.3 of the share of the last three regimes that agree, 0.8 + 0.2 of the symbols' agreement, and 0.9 in rising drift; in 0.1..1."""
    return at_least(at_most(confidence * (0.7 + 0.3 * F.coalesce(share, F.lit(1.0))) * (0.8 + 0.2 * agreement) * F.when(drift > 0.1, 0.9).otherwise(1.0), 1.0), 0.1)


# Features of a symbol


def symbol_features(snaps: DataFrame) -> DataFrame:
    """(symbol, ts, asset_type, volume, features): names and values of what is known at each row, sorted by name. All windows share one partitioning."""
    p, v, r = F.col("price"), F.col("volume"), F.col("change_pct") / 100
    out = snaps.withColumns({"_r": r, "_dp": p - lag("price"), "_dv": v - lag("volume"), "_n": F.row_number().over(in_order())})
    enough = lambda k: F.col("_n") > k
    seen = F.collect_list("price").over(last(20))
    below, at = F.size(F.filter(seen, lambda x: x < p)), F.size(F.filter(seen, lambda x: x == p))
    named = {"current_price": p, "price_change_pct": F.col("change_pct"), "rsi": F.col("rsi"), "macd": F.col("macd"), "volatility": F.col("volatility"), "sentiment_score": F.col("sentiment")}
    for k in (5, 10, 20):
        back = lag("price", k - 1)
        named[f"momentum_{k}"] = F.when(enough(k), (p - back) / back * 100)
        named[f"volatility_{k}"] = F.when(F.count("_r").over(last(k)) == k, F.stddev_samp("_r").over(last(k)) * 252**0.5 * 100)
        average = F.avg("volume").over(last(k))
        named[f"volume_ratio_{k}"] = F.when(enough(k) & (average > 0), v / average)
    for k in (10, 20, 50):
        average = F.avg("price").over(last(k))
        named[f"ma_ratio_{k}"] = F.when(enough(k), (p - average) / average * 100)
    named["price_percentile_20"] = F.when(enough(20), (2 * below + at + F.when(at > 0, 1).otherwise(0)) * 50 / 20)
    sd5, sd20 = F.stddev_samp("_r").over(last(5)), F.stddev_samp("_r").over(last(20))
    named["volatility_ratio_5_20"] = F.when((F.count("_r").over(last(20)) == 20) & (sd20 > 0), sd5 / sd20)
    old = F.avg("volume").over(in_order().rowsBetween(-9, -5))
    named["volume_trend"] = F.when(enough(10) & (old > 0), (F.avg("volume").over(last(5)) - old) / old)
    named["price_volume_correlation"] = F.when(enough(20), F.corr("_dp", "_dv").over(last(19)))
    named["crypto_volatility_adjusted"] = F.when(F.col("asset_type") == "crypto", F.col("volatility") * 1.5)
    out = out.withColumns({f"_f_{k}": c for k, c in named.items()})
    entries = F.array(*[F.struct(F.lit(k).alias("name"), F.col(f"_f_{k}").alias("value")) for k in sorted(named)])
    return out.select("symbol", "ts", "asset_type", "volume", F.filter(entries, lambda e: e["value"].isNotNull() & ~F.isnan(e["value"])).alias("features"))


def _at(values: Column, share: float) -> Column:
    """Interpolated percentile of a sorted array."""
    place = (F.size(values) - 1) * share
    low = F.element_at(values, F.floor(place).cast("int") + 1)
    high = F.element_at(values, F.ceil(place).cast("int") + 1)
    return low + (high - low) * (place - F.floor(place))


def _let(value: Column, body) -> Column:
    """body(value) with the value worked out once, however often the body uses it: the optimiser would put the expression in each place."""
    return F.element_at(F.transform(F.array(value), body), 1)


def scaled(rows: DataFrame) -> DataFrame:
    """rows with the features' values less their median over the range of their middle half (1 if that is 0), in -1e6..1e6: robust scaling across the vector."""
    clip = lambda x: F.greatest(F.lit(-1e6), F.least(F.lit(1e6), x))
    moved = lambda f, s: F.transform(f, lambda e: F.struct(e["name"].alias("name"), clip((e["value"] - s["m"]) / F.when(s["q"] > 0, s["q"]).otherwise(1.0)).alias("value")))
    centre = lambda v: F.struct(_at(v, 0.5).alias("m"), (_at(v, 0.75) - _at(v, 0.25)).alias("q"))
    body = lambda f: _let(F.array_sort(F.transform(f, lambda e: e["value"])), lambda v: _let(centre(v), lambda s: moved(f, s)))
    return rows.withColumn("features", _let(F.col("features"), body))


def selected(rows: DataFrame, most: int = 50, importance: float = 0.5) -> DataFrame:
    """rows with the `most` features of the largest |value| times importance times weight (momentum and trend 1.2, volatility and volume 1.1), largest first; ties by name."""
    weight = lambda n: F.when(n.contains("momentum") | n.contains("trend"), 1.2).when(n.contains("volatility") | n.contains("volume"), 1.1).otherwise(1.0)
    ranked = F.array_sort(F.transform("features", lambda e: F.struct(F.round(-F.abs(e["value"]) * importance * weight(e["name"]), 9).alias("s"), e["name"].alias("name"), e["value"].alias("value"))))
    return rows.withColumn("features", F.transform(F.slice(ranked, 1, most), lambda e: F.struct(e["name"], e["value"])))


def confidence(features: Column, volume: Column, age_hours: Column) -> Column:
    """0.8 times 0.5 + 0.5 of the share of values other than 0, 0.1 more with volume and under an hour, 0.1 less over a day; in 0.1..1."""
    share = F.size(F.filter(features, lambda e: e["value"] != 0)) / F.size(features)
    base = F.when(F.size(features) > 0, 0.8 * (0.5 + 0.5 * share)).otherwise(0.8)
    return at_least(at_most(base + F.when(volume > 0, 0.1).otherwise(0.0) + F.when(age_hours < 1, 0.1).when(age_hours > 24, -0.1).otherwise(0.0), 1.0), 0.1)


def fallback(snaps: DataFrame) -> DataFrame:
    """(symbol, ts, six values with defaults, confidence 0.3): what there is without history."""
    return snaps.select("symbol", "ts", F.coalesce("price", F.lit(0.0)).alias("price"), F.coalesce("change_pct", F.lit(0.0)).alias("change_pct"), F.coalesce("volume", F.lit(0.0)).alias("volume"), F.coalesce("rsi", F.lit(50.0)).alias("rsi"), F.coalesce("volatility", F.lit(20.0)).alias("volatility"), asset_code(F.col("asset_type")).alias("asset_code"), F.lit(0.3).alias("confidence"))


BANDS = {"high": (0.4, 0.5), "medium": (0.1, 0.4), "low": (0.01, 0.1)}


def spectrum(prices: np.ndarray) -> dict[str, float] | None:
    """Of 64 prices and more: the share of power of log returns, without their line and under a Hann window, in three bands, and the frequency with most; None under 64."""
    if len(prices) < 64 or (prices <= 0).any():
        return None
    r = np.diff(np.log(prices))
    t = np.arange(len(r))
    slope, level = np.polyfit(t, r, 1)
    flat = (r - slope * t - level) * (0.5 - 0.5 * np.cos(2 * np.pi * t / (len(r) - 1)))
    power, freq = np.abs(np.fft.fft(flat)) ** 2, np.abs(np.fft.fftfreq(len(flat)))
    total = power[1:].sum()
    out = {f"freq_{name}": float(power[(freq >= a) & (freq <= b)].sum() / total) if total > 0 else 0.0 for name, (a, b) in BANDS.items()}
    return out | {"dominant": float(freq[1 + int(np.argmax(power[1 : len(power) // 2]))])}


def spectral(snaps: DataFrame, most: int = 256) -> DataFrame:
    """(symbol, freq_high, freq_medium, freq_low, dominant) of each symbol's last rows: a group has at most `most` rows, whatever the history."""
    recent = snaps.select("symbol", "ts", "price", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("ts"))).alias("_rn")).where(F.col("_rn") <= most)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        found = spectrum(group.sort_values("ts")["price"].to_numpy(dtype=float))
        return pd.DataFrame([{"symbol": group["symbol"].iloc[0], **found}] if found else [], columns=["symbol", "freq_high", "freq_medium", "freq_low", "dominant"])

    return recent.groupBy("symbol").applyInPandas(run, "symbol string, freq_high double, freq_medium double, freq_low double, dominant double")
