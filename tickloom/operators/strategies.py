"""Strategies as column expressions over snapshots: scores, signals, stops, sizes. All of them stay in whole-stage code; history is a window over the symbol.

A null input gives no points, as if the indicator were missing.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.windows import in_order, last
from tickloom.operators import signals

PORTFOLIO = 100_000.0
# Stop distances by asset type.
STOPS = {"stock": 0.05, "crypto": 0.10, "forex": 0.02, "commodity": 0.07, "etf": 0.04}


def at_most(value: Column, most: float) -> Column:
    """Like least, but null stays null."""
    return F.when(value > most, F.lit(most)).otherwise(value)


def at_least(value: Column, least: float) -> Column:
    return F.when(value < least, F.lit(least)).otherwise(value)


def points(*rules: tuple[Column, float], most: float | None = 1.0, least: float | None = None) -> Column:
    """The sum of the points of the rules that hold; an unknown rule holds not."""
    out = reduce(lambda a, b: a + b, [F.when(rule, worth).otherwise(0.0) for rule, worth in rules], F.lit(0.0))
    out = out if most is None else F.least(F.lit(most), out)
    return out if least is None else F.greatest(F.lit(least), out)


def by_name(column: Column, values: dict[str, float | str], other: float | str | None) -> Column:
    out = F.lit(other)
    for name, value in values.items():
        out = F.when(column == name, value).otherwise(out)
    return out


# Signals of all strategies


def rsi_level(rsi: Column, low: float = 30, high: float = 70) -> Column:
    return F.when(rsi <= low, "oversold").when(rsi >= high, "overbought").when(rsi.isNotNull(), "neutral")


def volatility_level(volatility: Column, usual: float = 20) -> Column:
    return F.when(volatility < usual / 2, "low").when(volatility > usual * 1.5, "high").when(volatility.isNotNull(), "moderate")


def sentiment_level(sentiment: Column) -> Column:
    return F.when(sentiment > 0.3, "positive").when(sentiment < -0.3, "negative").when(sentiment.isNotNull(), "neutral")


def factors(rsi: Column, macd: Column, volatility: Column, momentum: Column, sentiment: Column) -> Column:
    """The indicators that are there with their levels, as a map of text."""
    pairs = {
        "rsi": F.format_string("%.4f", rsi), "rsi_condition": rsi_level(rsi), "macd_signal": F.when(macd > 0, "bullish").when(macd.isNotNull(), "bearish"), "volatility_level": volatility_level(volatility),
        "momentum_side": F.when(momentum > 0, "up").when(momentum.isNotNull(), "down"), "sentiment_bias": sentiment_level(sentiment),
    }
    seen = {"rsi": rsi, "rsi_condition": rsi}
    entries = [F.struct(F.lit(k).alias("key"), F.when(seen[k].isNotNull(), v).otherwise(F.lit(None)).alias("value") if k in seen else v.alias("value")) for k, v in pairs.items()]
    return F.map_from_entries(F.filter(F.array(*entries), lambda e: e["value"].isNotNull()))


def stop_loss(asset_type: Column, price: Column, buys: Column, volatility: Column, usual: float = 20) -> Column:
    """A share of the price by asset type (unknown: 5 %), half as much again in high volatility, below a buy and above a sell."""
    share = by_name(asset_type, STOPS, 0.05) * F.when(volatility > usual, 1.5).otherwise(1.0)
    return price * F.when(buys, 1 - share).otherwise(1 + share)


def take_profit(price: Column, stop: Column, buys: Column, reward: float = 2.0) -> Column:
    gain = F.coalesce(F.abs(price - stop), price * 0.05) * reward
    return F.when(buys, price + gain).otherwise(price - gain)


def position_value(value: float, price: Column, stop: Column, confidence: Column, risk: float = 0.02, most: float = 0.1) -> Column:
    """Risk of the value over the loss of a share, in shares' worth, times confidence, at most `most` of the value; without a stop 5 % of the value."""
    loss = F.abs(price - stop)
    shares = F.when(loss > 0, value * risk / loss).when(loss.isNotNull(), 0.0)
    return F.least(F.coalesce(shares * price, F.lit(value * 0.05)) * F.least(confidence / 100, F.lit(1.0)), F.lit(value * most))


def reward_risk(price: Column, stop: Column, target: Column) -> Column:
    return F.when(F.abs(price - stop) > 0, F.abs(target - price) / F.abs(price - stop))


def valid(rows: DataFrame, seconds: int = 30, least: float = 70, crypto_least: float = 80) -> DataFrame:
    """Of rows with a signal: `valid`, with the first `reason` against it. The gap is to the symbol's signal before, valid or not."""
    before = F.lag("ts").over(Window.partitionBy("symbol").orderBy("ts"))
    gap = F.unix_timestamp(F.col("ts").cast("timestamp")) - F.unix_timestamp(before.cast("timestamp"))
    reason = (
        F.when(F.col("confidence") < least, "confidence").when(gap < seconds, "too_soon").when(F.col("position_share") > 0.1, "size")
        .when((F.col("asset_type") == "crypto") & (F.col("confidence") < crypto_least), "crypto_confidence").when((F.col("asset_type") == "forex") & (F.hour("ts") > 22), "forex_hours")
    )
    return rows.withColumn("reason", reason).withColumn("valid", F.col("reason").isNull())


# Rising markets


def bull_parts(c=F.col) -> dict[str, Column]:
    """Five parts of 0..1; the momentum's consistency asks for two rises among the last three rows."""
    rises = F.sum(F.when(c("change_pct") > 0, 1).otherwise(0)).over(last(3))
    steady = (F.count("change_pct").over(last(5)) >= 3) & (rises >= 2)
    middle = (c("bb_upper") + c("bb_lower")) / 2
    return {
        "momentum_part": points((c("change_pct") > 1, 0.4), (c("change_pct") > 2, 0.3), (c("momentum") > 0, 0.3), (steady, 0.2)),
        "volume_part": points((c("volume") > 0, 0.7), (c("volume") > 1e6, 0.3)),
        "technical_part": points((c("rsi").between(35, 75), 0.4), (c("rsi").between(50, 70), 0.2), (c("macd") > 0, 0.3), (c("price") > middle, 0.1)),
        "regime_part": at_most(c("confidence") / 100 + F.when((c("regime") == "BULL") & (c("confidence") > 85), 0.2).when((c("regime") == "BREAKOUT") & (c("confidence") > 80), 0.3).otherwise(0.0), 1.0),
        "sentiment_part": signals.sentiment_part(c("sentiment")),
    }


def bull(snaps: DataFrame, least: float = 75) -> DataFrame:
    """snaps with the parts, `strength`, and in BULL and BREAKOUT of enough confidence `signal` from a strength of 0.7 on, with its confidence, stop, target and value.

    `recent_entry` marks a signal less than an hour after the symbol's signal before; it is not taken.
    """
    out = snaps.withColumns(bull_parts())
    names = ("momentum_part", "volume_part", "technical_part", "regime_part", "sentiment_part")
    out = out.withColumn("strength", at_most(signals.bull_score(*[F.col(n) for n in names], F.col("asset_type")), 1.0))
    fits = F.col("regime").isin("BULL", "BREAKOUT") & (F.col("confidence") >= least) & (F.col("strength") >= 0.7)
    out = out.withColumn("_raw", F.coalesce(fits, F.lit(False)))
    at = F.last(F.when(F.col("_raw"), F.col("ts")), ignorenulls=True).over(in_order().rowsBetween(Window.unboundedPreceding, -1))
    recent = F.col("_raw") & F.coalesce(F.unix_timestamp(F.col("ts").cast("timestamp")) - F.unix_timestamp(at.cast("timestamp")) < 3600, F.lit(False))
    out = out.withColumn("recent_entry", recent)
    taken, buys = F.col("_raw") & ~F.col("recent_entry"), F.lit(True)
    out = out.withColumns({
        "signal": F.when(taken, signals.bull_signal(F.col("strength"))), "signal_confidence": F.when(taken, at_most(F.col("confidence") * F.col("strength"), 95.0)),
        "stop": F.when(taken, stop_loss(F.col("asset_type"), F.col("price"), buys, F.col("volatility"))),
    })
    return out.withColumns({
        "target": F.when(taken, take_profit(F.col("price"), F.col("stop"), buys, 2.5)), "value": F.when(taken, position_value(PORTFOLIO, F.col("price"), F.col("stop"), F.col("signal_confidence"), 0.025, 0.15)),
    }).drop("_raw")


# Falling markets


def mean_of_known(values: Iterable[Column], other: float) -> Column:
    known = F.filter(F.array(*values), lambda x: x.isNotNull())
    return F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda s, x: s + x) / F.size(known)).otherwise(other)


def stress(regime: Column, volatility: Column, sentiment: Column) -> Column:
    """Mean of what is known of the regime's, the volatility's and the sentiment's stress; 0.5 if nothing is."""
    by_regime = by_name(regime, {"BEAR": 0.7, "BREAKDOWN": 0.9, "VOLATILE": 0.6}, None).cast("double")
    return mean_of_known([by_regime, F.when(volatility.isNotNull(), F.least(volatility / 50, F.lit(1.0))), F.when(sentiment.isNotNull(), F.least(F.greatest(-sentiment, F.lit(0.0)) / 0.5, F.lit(1.0)))], 0.5)


def bear_parts(c=F.col) -> dict[str, Column]:
    return {
        "breakdown_part": points((c("change_pct") < -2, 0.5), (c("change_pct") < -4, 0.3), (c("momentum") < 0, 0.2)),
        "volatility_part": points((c("volatility") > 25, 0.6), (c("volatility") > 37.5, 0.4), (c("volume") > 0, 0.3)),
        "technical_part": points((c("rsi") > 70, 0.4), (c("rsi") < 30, -0.3), (c("macd") < 0, 0.3), (c("bb_lower").isNotNull() & (c("price") > c("bb_upper") * 0.95), 0.3), most=None, least=0.0),
        "regime_part": c("confidence") / 100 * F.when(c("regime") == "BREAKDOWN", 1.2).otherwise(1.0),
        "sentiment_part": F.when(c("sentiment").isNull(), 0.5).when(c("sentiment") < -0.2, 1.0).when(c("sentiment") < 0, 0.7).otherwise(0.2),
    }


def short_stop(asset_type: Column, price: Column) -> Column:
    return price * (1 + 0.05 * F.when(asset_type == "crypto", 2.0).when(asset_type == "forex", 0.5).otherwise(1.0))


def short_target(price: Column, stop: Column, reward: float = 2.0) -> Column:
    return price - (stop - price) * reward


def bear(snaps: DataFrame, least: float = 80) -> DataFrame:
    """snaps with the parts, `strength`, `stress` and the first of three signals that fits: a short one over 0.7, a hedge, a reduction; a short one has stop, target and value, a hedge 5 % of the portfolio."""
    out = snaps.withColumns(bear_parts())
    weights = {"breakdown_part": 0.35, "volatility_part": 0.25, "technical_part": 0.20, "regime_part": 0.15, "sentiment_part": 0.05}
    total = reduce(lambda a, b: a + b, [F.col(k) * w for k, w in weights.items()])
    out = out.withColumns({"strength": at_most(total, 1.0), "stress": stress(F.col("regime"), F.col("volatility"), F.col("sentiment"))})
    sure = F.col("confidence")
    short = F.col("regime").isin("BEAR", "BREAKDOWN", "VOLATILE") & (sure >= least) & (F.col("strength") > 0.7)
    hedge = F.col("regime").isin("BEAR", "VOLATILE") & (sure > 75) & (F.col("stress") > 0.6)
    reduce_ = F.col("regime").isin("BEAR", "BREAKDOWN") & (sure > 70)
    out = out.withColumn("signal", F.when(short, F.when(F.col("strength") >= 0.9, "STRONG_SELL").otherwise("SELL")).when(hedge, "HEDGE").when(reduce_, "REDUCE"))
    sells = F.col("signal").isin("SELL", "STRONG_SELL")
    out = out.withColumns({"signal_confidence": F.when(sells, at_most(sure * F.col("strength"), 95.0)).when(F.col("signal").isNotNull(), sure), "stop": F.when(sells, short_stop(F.col("asset_type"), F.col("price")))})
    value = 0.7 * position_value(PORTFOLIO, F.col("price"), F.col("stop"), F.col("signal_confidence"), 0.015, 0.08)
    return out.withColumns({"target": F.when(sells, short_target(F.col("price"), F.col("stop"))), "value": F.when(sells, value).when(F.col("signal") == "HEDGE", PORTFOLIO * 0.05)})


# Rules of one row each


def simple_rules(c=F.col) -> dict[str, Column]:
    """Signals of fixed rules by name; null where a rule says nothing."""
    chg, rsi, vol, sure, price = c("change_pct"), c("rsi"), c("volatility"), c("confidence"), c("price")
    up, down = c("regime").isin("BULL", "BREAKOUT"), c("regime").isin("BEAR", "BREAKDOWN")
    side = F.when(chg > 0, "BUY").otherwise("SELL")
    return {
        "momentum": F.when(up & (chg > 1) & (rsi < 70), F.when(chg > 2, "STRONG_BUY").otherwise("BUY")),
        "defensive": F.when(down & F.coalesce((chg < -1) | (rsi > 70), F.lit(False)), F.when(chg > -2, "SELL").otherwise("STRONG_SELL")),
        "volatility": F.when((c("regime") == "VOLATILE") & (vol > 30) & (F.abs(chg) > 2), side),
        "breakout": F.when((c("regime") == "BREAKOUT") & (price > c("bb_upper")), "STRONG_BUY"),
        "range": F.when(c("regime") == "SIDEWAYS", F.when(price <= c("bb_lower"), "BUY").when(price >= c("bb_upper"), "SELL")),
        "crypto_volatility": F.when((c("asset_type") == "crypto") & (vol > 40) & (F.abs(chg) > 5), side),
        "forex_carry": F.when((c("asset_type") == "forex") & (F.abs(chg) < 0.5), "HOLD"),
        "mean_reversion": F.when(rsi > 75, "SELL").when(rsi < 25, "BUY"),
        "trend_up": F.when((chg > 1) & (rsi < 70) & (c("volume") > 0) & (sure > 75), F.when(sure > 85, "STRONG_BUY").otherwise("BUY")),
        "trend_down": F.when((chg < -1.5) & (rsi > 30) & (sure > 75), F.when(sure > 85, "STRONG_SELL").otherwise("SELL")),
        "bands": F.when((price <= c("bb_lower") * 1.02) & (rsi < 30), "BUY").when((price >= c("bb_upper") * 0.98) & (rsi > 70), "SELL"),
        "sure_volatility": F.when((vol > 30) & (F.abs(chg) > 2) & (sure > 80), side),
        "surge": F.when((chg > 3) & (c("volume") > 0) & (sure > 80), "BUY"),
        "plunge": F.when((chg < -3) & (c("volume") > 0) & (sure > 80), "SELL"),
        "accumulate": F.when((F.abs(chg) < 1) & (rsi > 35) & (rsi < 65) & (c("volume") > 0), "BUY"),
        "distribute": F.when((F.abs(chg) < 0.5) & (rsi > 60), "SELL"),
    }


#: What a rule's confidence is of the regime's.
RULE_CONFIDENCE = {"momentum": 0.8, "defensive": 0.9, "volatility": 0.7, "breakout": 0.85, "range": 0.7, "crypto_volatility": 0.6, "forex_carry": 0.8, "mean_reversion": 0.75, "sure_volatility": 0.8}


def rule_signals(snaps: DataFrame) -> DataFrame:
    """(symbol, ts, asset_type, price, rule, signal, confidence): a row for each rule that speaks; a stack of expressions, no join."""
    rules = simple_rules()
    every = F.array(*[F.struct(F.lit(n).alias("rule"), s.alias("signal"), (F.col("confidence") * RULE_CONFIDENCE.get(n, 1.0)).alias("confidence")) for n, s in rules.items()])
    spoke = snaps.select("symbol", "ts", "asset_type", "price", F.explode(F.filter(every, lambda x: x["signal"].isNotNull())).alias("_r"))
    return spoke.select("symbol", "ts", "asset_type", "price", "_r.*")


def wary(rows: DataFrame) -> DataFrame:
    """The same signals at 0.9 of the confidence and one and a half times the distance to the stop, with a note."""
    return rows.withColumns({"confidence": F.col("confidence") * 0.9, "stop": F.col("price") - (F.col("price") - F.col("stop")) * 1.5, "note": F.concat(F.lit("wary: "), F.col("rule"))})


def with_limits(rows: DataFrame, value: float, stop: float = 0.05, target: float = 0.10, most: float = 0.1, risk: float = 0.8) -> DataFrame:
    """Signals whose value is no more than a share of the portfolio, while what is open is no more than another; with stop and target."""
    kept = rows.where(F.coalesce(F.col("position_value") <= value * most, F.lit(True)) & (F.coalesce(F.col("open_value"), F.lit(0.0)) <= value * risk))
    buys, sells = F.col("signal").isin("BUY", "STRONG_BUY"), F.col("signal").isin("SELL", "STRONG_SELL")
    return kept.withColumns({
        "stop": F.when(buys, F.col("price") * (1 - stop)).when(sells, F.col("price") * (1 + stop)), "target": F.when(buys, F.col("price") * (1 + target)).when(sells, F.col("price") * (1 - target)),
    })


def kelly_size(value: float, confidence: Column, price: Column, stop: Column) -> Column:
    """Kelly's share for gains of 8 % and losses of 5 %, at most a quarter, or 2 % of the value over the loss of a unit, whichever is less; not under 0; null without a confidence."""
    win = confidence / 100
    kelly = at_least(at_most((win * 0.08 - (1 - win) * 0.05) / 0.08, 0.25), 0.0)
    loss = F.abs(price - stop) / price
    return F.when(kelly.isNotNull() & (loss > 0), F.least(kelly * value, value * 0.02 / loss)).otherwise(kelly * value)


def fill(price: Column, signal: Column, confidence: Column, quantity: Column, symbol: Column) -> dict[str, Column]:
    """Price after a slip of 1 bp times (2 - confidence), and the fee: 0.1 % of pairs in dollars, else 0.25 %."""
    slip = 0.0001 * (2 - confidence / 100)
    at = F.when(signal.isin("BUY", "STRONG_BUY"), price * (1 + slip)).otherwise(price * (1 - slip))
    return {"fill_price": at, "fee": at * quantity * F.when(symbol.like("%USD") | symbol.like("%USDT"), 0.001).otherwise(0.0025)}


def strategy_of(asset_type: Column, regime: Column, volatility: Column, rsi: Column) -> Column:
    """The strategy's name by asset type, then by regime."""
    up = regime.isin("BULL", "BREAKOUT")
    by_regime = F.when(regime == "BULL", "bull_momentum").when(regime == "BEAR", "bear_defensive").when(regime == "VOLATILE", "volatility_trading").when(regime == "BREAKOUT", "breakout_momentum").otherwise("range_trading")
    crypto = F.when(volatility > 50, "crypto_volatility").when(up, "bull_momentum").otherwise("volatility_trading")
    stock = F.when((regime == "SIDEWAYS") & ((rsi > 70) | (rsi < 30)), "mean_reversion").when(regime == "BULL", "bull_momentum").otherwise("bear_defensive")
    return F.when(asset_type == "crypto", crypto).when(asset_type == "forex", "forex_carry").when(asset_type == "stock", stock).otherwise(by_regime)


def engine_strategy(asset_type: Column, regime: Column, confidence: Column, volatility: Column) -> Column:
    """The engine's choice: by regime; crypto, forex and volatile commodities have their own; a conservative one under 60 %, an aggressive one over 90 %."""
    base = by_name(regime, ENGINE, "range_trading")
    own = F.when((asset_type == "crypto") & (volatility > 50), "crypto_volatility").when((asset_type == "crypto") & regime.isin("BULL", "BREAKOUT"), "crypto_momentum").when(asset_type == "forex", "forex_carry")
    own = own.when((asset_type == "commodity") & (regime == "VOLATILE"), "commodity_momentum")
    return F.coalesce(own, F.when(confidence < 60, "conservative").when(confidence > 90, F.concat(base, F.lit("_aggressive"))).otherwise(base))


# Crypto


# Categories of symbols, weights of momentum, sentiment and volatility by category, and momentum's factor by regime.
CATEGORIES = {"view": "bitcoin", "click": "meme", "signup": "defi", "BTC": "bitcoin", "ETH": "ethereum", "ADA": "altcoin_large", "SOL": "altcoin_large", "USDT": "stablecoin", "USDC": "stablecoin", "UNI": "defi", "AAVE": "defi", "DOGE": "meme", "SHIB": "meme", "XMR": "privacy", "ZEC": "privacy"}
CATEGORY_WEIGHTS = {"bitcoin": (0.7, 0.2, 0.1), "meme": (0.4, 0.5, 0.1), "defi": (0.5, 0.35, 0.15), "utility": (0.5, 0.35, 0.15)}
OTHER_WEIGHTS = (0.6, 0.3, 0.1)
REGIME_MOMENTUM = {"BULL": 1.3, "BEAR": 0.7, "BREAKOUT": 1.5, "BREAKDOWN": 0.5, "VOLATILE": 1.1, "SIDEWAYS": 0.8}
ENGINE = {"BULL": "bull_momentum", "BEAR": "bear_defensive", "BREAKOUT": "breakout_momentum", "BREAKDOWN": "bear_defensive", "VOLATILE": "volatility_trading", "SIDEWAYS": "range_trading", "ACCUMULATION": "accumulation", "DISTRIBUTION": "distribution"}


def category(symbol: Column) -> Column:
    """By the symbol without USD and dashes; unknown ones are middle altcoins."""
    bare = F.regexp_replace(symbol, "-USD|USD$|-", "")
    return F.coalesce(by_name(bare, CATEGORIES, None), F.lit("altcoin_mid"))


def share_below(value: str, n: int) -> Column:
    """Share of the last n rows with a value under this row's."""
    frame = F.collect_list(value).over(last(n))
    return F.when(F.col(value).isNotNull(), F.size(F.filter(frame, lambda x: x < F.col(value))) / F.size(frame))


def crypto_scores(snaps: DataFrame) -> DataFrame:
    """snaps with category, momentum_score, sentiment_score (its mean of three rows against the three before it, half, added), volatility_score and combined_score, all in -1..1."""
    vol = F.coalesce(F.col("volatility"), F.lit(20.0))
    out = snaps.withColumns({"category": category(F.col("symbol")), "_vol": vol, "_s": F.coalesce(F.col("sentiment"), F.lit(0.0)) * F.lit(2 / 3)})
    change = F.coalesce(F.col("change_pct"), F.lit(0.0)) / 100
    momentum = F.tanh(2 * change * F.least(F.lit(2.0), F.col("_vol") / 30) * by_name(F.col("regime"), REGIME_MOMENTUM, 1.0))
    now, old = F.avg("_s").over(last(3)), F.avg("_s").over(in_order().rowsBetween(-5, -3))
    drift = F.when(F.count("_s").over(last(6)) == 6, now - old).otherwise(0.0)
    clip = lambda c: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c))
    out = out.withColumns({"momentum_score": momentum, "sentiment_score": clip(F.col("_s") + 0.5 * drift), "_p": F.when(F.count("_vol").over(last(100)) > 10, share_below("_vol", 100)).otherwise(0.5)})
    out = out.withColumn("volatility_score", F.when(F.col("_vol") > 50, F.col("_p") * 0.5).otherwise((F.col("_p") - 0.5) * 0.2))
    weight = lambda k: by_name(F.col("category"), {n: w[k] for n, w in CATEGORY_WEIGHTS.items()}, OTHER_WEIGHTS[k])
    return out.withColumn("combined_score", clip(F.col("momentum_score") * weight(0) + F.col("sentiment_score") * weight(1) + F.col("volatility_score") * weight(2))).drop("_vol", "_s", "_p")


def crypto(snaps: DataFrame) -> DataFrame:
    """crypto_scores with signal, its kind and its confidence after hour, weekend and volatility; under 0.3 there is none, stablecoins have none."""
    out, score, sure, hour = crypto_scores(snaps), F.col("combined_score"), F.col("confidence"), F.hour("ts")
    signal = F.when(score > 0.6, "STRONG_BUY").when(score > 0.3, "BUY").when(score < -0.6, "STRONG_SELL").when(score < -0.3, "SELL")
    kind = F.when(score > 0.6, "MOMENTUM_BUY").when(score > 0.3, "TECHNICAL_BOUNCE").when(score < -0.6, "MOMENTUM_SELL").when(score < -0.3, "TECHNICAL_BREAKDOWN")
    conf = sure * F.abs(score) * by_name(F.col("category"), {"bitcoin": 1.1, "meme": 0.8}, 1.0)
    conf = conf * F.when(hour.between(2, 6), 0.8).when(hour.between(13, 21), 1.2).otherwise(1.0) * F.when(F.dayofweek("ts").isin(1, 7), 0.9).otherwise(1.0)
    conf = conf * F.when(F.col("volatility") > 100, F.when(F.col("category").isin("altcoin_small", "meme"), 0.6).otherwise(0.8)).otherwise(1.0)
    taken = signal.isNotNull() & (conf >= 0.3) & (F.col("category") != "stablecoin")
    share = 0.02 * by_name(F.col("category"), {"meme": 0.5, "altcoin_small": 0.7}, 1.0)
    return out.withColumns({"signal": F.when(taken, signal), "kind": F.when(taken, kind), "signal_confidence": F.when(taken, conf), "most_risk": F.when(taken, share)})


def crypto_volatility(snaps: DataFrame, history: int = 100) -> DataFrame:
    """snaps with vol_share, the share of the last volatilities under this one, signal and confidence: with the move in the top tenth, against a move over 3 % in the calm lowest fifth; from 20 rows on."""
    out = snaps.withColumn("_v", F.coalesce(F.col("volatility"), F.lit(20.0)))
    out = out.withColumn("vol_share", F.when(F.count("_v").over(last(history)) >= 20, share_below("_v", history)))
    up, p = F.col("change_pct") > 0, F.col("vol_share")
    calm = (p < 0.2) & (F.col("_v") < 15) & (F.abs("change_pct") > 3)
    signal = F.when(p > 0.9, F.when(up, "STRONG_BUY").otherwise("STRONG_SELL")).when(calm, F.when(up, "SELL").otherwise("BUY"))
    out = out.withColumn("signal", signal)
    stop = F.when(F.col("_v") > 80, F.col("price") * F.when(F.col("signal").isin("BUY", "STRONG_BUY"), 0.95).otherwise(1.05))
    some = F.col("signal").isNotNull()
    return out.withColumns({"signal_confidence": F.when(some, F.col("confidence") * F.least(F.lit(1.5), F.abs(p - 0.5) * 4)), "stop": F.when(some, stop)}).drop("_v")


def crypto_sentiment(snaps: DataFrame) -> DataFrame:
    """snaps with recent (mean sentiment of 5 rows), shift (against the 5 before), signal and confidence: with a shift over 0.1 beyond 0.6, against an extreme beyond 0.8; from 10 rows on."""
    out = snaps.withColumn("_s", F.coalesce(F.col("sentiment"), F.lit(0.0)))
    enough = F.count("_s").over(last(10)) == 10
    out = out.withColumns({"recent": F.when(enough, F.avg("_s").over(last(5))), "shift": F.when(enough, F.avg("_s").over(last(5)) - F.avg("_s").over(in_order().rowsBetween(-9, -5)))})
    now, by = F.col("recent"), F.col("shift")
    signal = F.when((now > 0.6) & (by > 0.1), "BUY").when((now < -0.6) & (by < -0.1), "SELL").when(now > 0.8, "WEAK_SELL").when(now < -0.8, "WEAK_BUY")
    return out.withColumns({"signal": signal, "signal_confidence": F.when(signal.isNotNull(), F.col("confidence") * (F.abs(by) * 2 + F.abs(now) * 0.5))}).drop("_s")


# Volatility


def volatility_signals(snaps: DataFrame, n: int = 60) -> DataFrame:
    """snaps with vol_z, vol_rank, vol_trend (relative change over 5 rows), vol_speed (1 less the AR(1) slope), vol_regime, persistence (share of the last 10 rows in the same regime) and the signal of two rules: mean reversion in HIGH and EXTREME, breakout outside them; with size, stop and target at 2 and 6 daily deviations, and `valid`."""
    out = snaps.withColumns({"_v": F.col("volatility") / 100, "_r": F.col("change_pct") / 100})
    out = out.withColumn("_b", F.lag("_v").over(in_order()))
    frame, some = last(n), F.count("_v").over(last(n)) >= 20
    sd = F.stddev_samp("_v").over(frame)
    pairs = F.count(F.when(F.col("_b").isNotNull(), F.col("_v"))).over(frame) >= 20
    out = out.withColumns({
        "vol_z": F.when(some & (sd > 0), (F.col("_v") - F.avg("_v").over(frame)) / sd), "vol_rank": F.when(some, share_below("_v", n)), "vol_trend": F.when(F.lag("_v", 5).over(in_order()) > 0, F.col("_v") / F.lag("_v", 5).over(in_order()) - 1),
        "vol_speed": F.when(pairs, 1 - F.regr_slope("_v", "_b").over(frame)), "_move": F.when(F.count("_r").over(last(5)) == 5, F.sum("_r").over(last(5))),
    })
    z, trend = F.col("vol_z"), F.col("vol_trend")
    name = F.when(trend > 0.1, "EXPANDING").when(trend < -0.1, "CONTRACTING").when(z > 3, "EXTREME").when(F.col("vol_rank") <= 0.15, "LOW").when(F.col("vol_rank") >= 0.95, "HIGH").when(F.col("vol_rank").isNotNull(), "NORMAL")
    out = out.withColumn("vol_regime", name)
    names = F.collect_list("vol_regime").over(last(10))
    out = out.withColumn("persistence", F.when(F.size(names) == 10, F.size(F.filter(names, lambda x: x == F.col("vol_regime"))) / 10))
    high = F.col("vol_regime").isin("HIGH", "EXTREME")
    revert = F.when(high & (F.col("vol_speed") >= 0.5), F.when(z > 2, "SELL").when(z < -2, "BUY"))
    broke = F.when(~high & (trend > 0) & (z >= 1.5), F.when(F.col("_move") > 0.02, "BUY").when(F.col("_move") < -0.02, "SELL"))
    out = out.withColumns({"rule": F.when(revert.isNotNull(), "mean_reversion").when(broke.isNotNull(), "breakout"), "signal": F.coalesce(revert, broke)})
    sure = F.when(F.col("rule") == "mean_reversion", F.least(F.lit(95.0), 50 + F.abs(z) * 10)).when(F.col("rule") == "breakout", F.least(F.lit(90.0), 60 + z * 10))
    sure = F.least(F.lit(95.0), sure * F.when(F.col("persistence") > 0.8, 1.1).when(F.col("persistence") < 0.3, 0.9).otherwise(1.0))
    size = 0.02 * F.when(F.col("_v") > 0, F.greatest(F.lit(0.5), F.least(F.lit(3.0), 0.2 / F.col("_v")))).otherwise(1.0)
    away, sign = F.col("_v") * 2 / 252**0.5, F.when(F.col("signal") == "BUY", 1.0).otherwise(-1.0)
    taken = F.col("signal").isNotNull()
    out = out.withColumns({"signal_confidence": F.when(taken, sure), "size": F.when(taken, size), "stop": F.when(taken, F.col("price") * (1 - sign * away)), "target": F.when(taken, F.col("price") * (1 + sign * away * 3))})
    return out.withColumn("valid", F.when(taken, (F.col("_v") / 252**0.5 <= 0.05) & (F.col("signal_confidence") >= 60) & (F.col("size") <= 0.1))).drop("_v", "_r", "_b", "_move")


# Breakouts


QUALITY_SIZE = {"VERY_STRONG": 1.5, "STRONG": 1.2, "MODERATE": 1.0, "WEAK": 0.7}
QUALITY_POINTS = {"VERY_STRONG": 40.0, "STRONG": 30.0, "MODERATE": 20.0, "WEAK": 10.0}
CONFIRM_POINTS = {"VERY_STRONG": 30.0, "STRONG": 22.0, "MODERATE": 15.0, "WEAK": 8.0}


def breakout_quality(strength: Column, volume_ratio: Column, momentum: Column) -> Column:
    """Four grades of 40 times the level's strength, up to 30 for volume and up to 30 for momentum."""
    score = 40 * strength + F.when(volume_ratio > 2, 30.0).when(volume_ratio > 1.5, 20.0).when(volume_ratio > 1.2, 10.0).otherwise(0.0) + F.least(F.lit(30.0), F.abs(momentum) * 1000)
    return F.when(score >= 80, "VERY_STRONG").when(score >= 60, "STRONG").when(score >= 40, "MODERATE").otherwise("WEAK")


def triangle_quality(high_r: Column, low_r: Column, touches: Column) -> Column:
    r = F.least(F.abs(high_r), F.abs(low_r))
    return F.when((r > 0.8) & (touches >= 6), "VERY_STRONG").when((r > 0.6) & (touches >= 4), "STRONG").when(r > 0.4, "MODERATE").otherwise("WEAK")


def rectangle_quality(width: Column, touches: Column) -> Column:
    return F.when((width >= 30) & (touches >= 8), "VERY_STRONG").when((width >= 20) & (touches >= 6), "STRONG").when((width >= 15) & (touches >= 4), "MODERATE").otherwise("WEAK")


def level_strength(touches: Column, age: Column, days_since_test: Column) -> Column:
    """A third of touches (of five), age (of a hundred rows, 0.8) and a test in the last five days (1.2)."""
    recent = F.when(days_since_test < 5, 1.2 * (5 - days_since_test) / 5).otherwise(0.0)
    return F.least(F.lit(1.0), (F.least(F.lit(1.0), touches / 5) + F.least(F.lit(1.0), age / 100) * 0.8 + recent) / 3)


def judged(patterns: DataFrame) -> DataFrame:
    """Breakouts (direction, quality, level, entry, target, stop, width, volume_ratio, momentum, sure, regime, volatility) with what follows: reward_risk, confirmations, score, signal, confidence, confirmation, expected move, horizon, invalidation, risks, size, valid."""
    c, up = F.col, F.col("direction") == "UP"
    out = patterns.withColumns({"reward_risk": F.round(reward_risk(c("entry"), c("stop"), c("target")), 9), "volume_ok": F.coalesce(c("volume_ratio") >= 1.2, F.lit(False)), "momentum_ok": F.coalesce(F.abs("momentum") >= 0.01, F.lit(False))})
    aligned = (c("regime").isin("BULL", "BREAKOUT") & up) | (c("regime").isin("BEAR", "BREAKDOWN") & ~up)
    ratio = F.when(c("reward_risk") > 3, 30.0).when(c("reward_risk") > 2, 20.0).when(c("reward_risk") > 1.5, 10.0).otherwise(0.0)
    base = F.greatest(F.lit(5), F.floor(c("width") / 4))
    risks = {"low volume": ~c("volume_ok"), "weak momentum": ~c("momentum_ok"), "poor reward": F.coalesce(c("reward_risk") < 1.5, F.lit(False)), "high volatility": F.coalesce(c("volatility") > 30, F.lit(False))}
    out = out.withColumns({
        "score": (by_name(c("quality"), QUALITY_POINTS, 10.0) + ratio + F.when(c("volume_ok"), 15.0).otherwise(0.0) + F.when(c("momentum_ok"), 15.0).otherwise(0.0)) * F.when(aligned, 1.3).otherwise(1.0),
        "signal": F.when(up, "BUY").otherwise("SELL"), "signal_confidence": at_most(c("sure") + F.when(c("volume_ok"), 10.0).otherwise(0.0) + F.when(c("momentum_ok"), 10.0).otherwise(0.0), 95.0),
        "confirmation": F.least(F.lit(100.0), F.when(c("volume_ok"), 40 * F.least(F.lit(1.0), c("volume_ratio") / 3)).otherwise(0.0) + F.when(c("momentum_ok"), 30 * F.least(F.lit(1.0), F.abs("momentum") / 0.05)).otherwise(0.0) + by_name(c("quality"), CONFIRM_POINTS, 8.0)),
        "expected_move": F.when(c("entry") > 0, F.abs(c("target") - c("entry")) / c("entry")).otherwise(0.0),
        "horizon": F.when(c("quality") == "VERY_STRONG", F.greatest(F.lit(3), F.floor(base / 2))).when(c("quality") == "STRONG", F.greatest(F.lit(5), F.floor(base * 7 / 10))).when(c("quality") == "MODERATE", base).otherwise(base * 2).cast("long"),
        "invalidation": c("level") * F.when(up, 0.995).otherwise(1.005), "risks": F.concat_ws(",", *[F.when(v, k) for k, v in risks.items()]),
        "n_risks": reduce(lambda a, b: a + b, [v.cast("int") for v in risks.values()]), "size": F.least(F.lit(0.05), 0.025 * by_name(c("quality"), QUALITY_SIZE, 1.0)) * F.when(c("reward_risk") < 2, 0.7).otherwise(1.0),
    })
    return out.withColumn("valid", (c("signal_confidence") >= 60) & F.coalesce(c("reward_risk") >= 1, F.lit(False)) & (c("n_risks") <= 3) & (c("size") <= 0.05) & (c("score") >= 40))


def breakouts(snaps: DataFrame, n: int = 20) -> DataFrame:
    """Breakouts of each row over 0.2 % beyond the last n prices, aimed the range's height further, and of volatility over two deviations of its own; judged."""
    before = in_order().rowsBetween(-n, -1)
    out = snaps.withColumns({"_top": F.max("price").over(before), "_low": F.min("price").over(before), "_n": F.count("price").over(before), "_v": F.col("volatility"), "_three": F.sum("change_pct").over(last(3)), "_z": (F.col("volatility") - F.avg("volatility").over(in_order().rowsBetween(-99, 0))) / F.nullif(F.stddev_samp("volatility").over(in_order().rowsBetween(-99, 0)), F.lit(0.0))})
    out = out.withColumn("_touches", F.lit(1) + F.size(F.filter(F.collect_list("price").over(before), lambda x: (x >= F.col("_top") * 0.995) | (x <= F.col("_low") * 1.005))))
    p, height, strength = F.col("price"), F.col("_top") - F.col("_low"), F.least(F.lit(1.0), F.col("_touches") / 5)
    full_ = F.col("_n") == n
    quality = breakout_quality(strength, F.col("volume_ratio"), F.col("change_pct") / 100)
    swing = p * F.col("_v") / 100 / 252**0.5 * 5
    up = F.when(F.col("_three") > 0, 1.0).otherwise(-1.0)
    shape = lambda cond, kind, way, grade, level, target, stop, width, ratio, momentum, sure: F.when(cond, F.struct(
        F.lit(kind).alias("kind"), way.alias("direction"), grade.alias("quality"), level.alias("level"), p.alias("entry"), target.alias("target"), stop.alias("stop"), F.lit(width).alias("width"), ratio.alias("volume_ratio"), momentum.alias("momentum"), sure.alias("sure")))
    sure = F.least(F.lit(95.0), 50 + 30 * strength)
    every = F.array(
        shape(full_ & (p > F.col("_top") * 1.002), "resistance", F.lit("UP"), quality, F.col("_top"), p + height, F.col("_top") * 0.99, n, F.col("volume_ratio"), F.col("change_pct") / 100, sure),
        shape(full_ & (p < F.col("_low") * 0.998), "support", F.lit("DOWN"), quality, F.col("_low"), p - height, F.col("_low") * 1.01, n, F.col("volume_ratio"), F.col("change_pct") / 100, sure),
        shape(F.col("_z") > 2, "volatility", F.when(up > 0, "UP").otherwise("DOWN"), F.when(F.col("_z") > 3, "STRONG").otherwise("MODERATE"), p, p + up * swing, p - up * swing / 2, n, F.lit(1.0), F.col("_z"), F.least(F.lit(95.0), 50 + F.col("_z") * 10)),
    )
    found = out.select("symbol", "ts", "regime", "volatility", F.explode(F.filter(every, lambda x: x.isNotNull())).alias("_p")).select("symbol", "ts", "regime", "volatility", "_p.*")
    return judged(found)


def best_breakout(found: DataFrame) -> DataFrame:
    """The valid breakout with the highest score of each symbol and time; ties by kind."""
    order = F.struct((-F.col("score")).alias("s"), "kind")
    return found.where("valid").groupBy("symbol", "ts").agg(F.min_by(F.struct("kind", "direction", "quality", "score", "signal", "signal_confidence", "size"), order).alias("_b")).select("symbol", "ts", "_b.*")
