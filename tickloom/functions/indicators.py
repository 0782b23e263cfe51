"""Technical indicators as window expressions: bars (symbol, ts, open, high, low, close, volume) in, the same with columns out.

All frames of one symbol share a partitioning and an order, so that any number of these needs one exchange and one sort. A value is null until its
frame is full.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .windows import full, highest, in_order, lag, last, lowest, mean, so_far, total


def C() -> Column:
    return F.col("close")


def H() -> Column:
    return F.col("high")


def L() -> Column:
    return F.col("low")


def V() -> Column:
    return F.col("volume")


def typical() -> Column:
    return (H() + L() + C()) / 3


def true_range() -> Column:
    """High less low on a first bar."""
    return F.greatest(H() - L(), F.abs(H() - lag("close")), F.abs(L() - lag("close")))


def sma(bars: DataFrame, periods: tuple[int, ...] = (10, 20, 50, 100, 200)) -> DataFrame:
    return bars.withColumns({f"sma_{n}": mean("close", n) for n in periods})


def wma(bars: DataFrame, n: int = 20) -> DataFrame:
    """Weights 1..n, the last bar's the largest."""
    weighted = sum(((n - k) * lag("close", k) for k in range(1, n)), n * C())
    return bars.withColumn(f"wma_{n}", weighted / (n * (n + 1) / 2))


def bollinger(bars: DataFrame, n: int = 20, width: float = 2.0, sample: bool = False) -> DataFrame:
    """Mean and bands at `width` deviations (population, or sample), width in percent of the mean, place inside the bands in percent; squeeze: a width under half its mean of n."""
    spread = full("close", F.stddev_samp("close") if sample else F.stddev_pop("close"), n)
    out = bars.withColumns({"bb_mid": mean("close", n), "_sd": spread})
    out = out.withColumns({"bb_upper": F.col("bb_mid") + width * F.col("_sd"), "bb_lower": F.col("bb_mid") - width * F.col("_sd")})
    gap = F.col("bb_upper") - F.col("bb_lower")
    out = out.withColumns({"bb_width": gap / F.col("bb_mid") * 100, "bb_position": F.when(gap > 0, (C() - F.col("bb_lower")) / gap * 100)})
    return out.withColumn("bb_squeeze", F.col("bb_width") < 0.5 * full("bb_width", F.avg("bb_width"), n)).drop("_sd")


def donchian(bars: DataFrame, n: int = 20) -> DataFrame:
    out = bars.withColumns({"dc_upper": highest("high", n), "dc_lower": lowest("low", n)})
    return out.withColumn("dc_mid", (F.col("dc_upper") + F.col("dc_lower")) / 2)


def ichimoku(bars: DataFrame, fast: int = 9, slow: int = 26, long: int = 52) -> DataFrame:
    """Midpoints of the last fast and slow bars, their mean and the long midpoint moved `slow` bars on, and the close `slow` bars later."""
    mid = lambda n: (highest("high", n) + lowest("low", n)) / 2
    out = bars.withColumns({"tenkan": mid(fast), "kijun": mid(slow), "_long": mid(long)})
    out = out.withColumns({"senkou_a": F.lag((F.col("tenkan") + F.col("kijun")) / 2, slow).over(in_order()), "senkou_b": F.lag("_long", slow).over(in_order())})
    return out.withColumn("chikou", F.lead("close", slow).over(in_order())).drop("_long")


def aroon(bars: DataFrame, n: int = 25) -> DataFrame:
    """100 (n - bars since the extreme) / n over n + 1 bars, the latest extreme on ties."""
    out = bars.withColumn("_i", F.row_number().over(in_order()))
    high = F.max_by("_i", F.struct("high", "_i")).over(last(n + 1))
    low = F.max_by("_i", F.struct(-L(), "_i")).over(last(n + 1))
    share = lambda at: F.when(F.col("_i") > n, 100.0 * (n - (F.col("_i") - at)) / n)
    out = out.withColumns({"aroon_up": share(high), "aroon_down": share(low)}).drop("_i")
    return out.withColumn("aroon_osc", F.col("aroon_up") - F.col("aroon_down"))


def stochastic(bars: DataFrame, k: int = 14, slow: int = 3, d: int = 3) -> DataFrame:
    gap = highest("high", k) - lowest("low", k)
    out = bars.withColumn("_fast", F.when(gap > 0, (C() - lowest("low", k)) / gap * 100).when(gap == 0, 0.0))
    out = out.withColumn("stoch_k", mean("_fast", slow))
    return out.withColumn("stoch_d", mean("stoch_k", d)).drop("_fast")


def williams_r(bars: DataFrame, n: int = 14) -> DataFrame:
    gap = highest("high", n) - lowest("low", n)
    return bars.withColumn("williams_r", F.when(gap > 0, -100 * (highest("high", n) - C()) / gap).when(gap == 0, 0.0))


def roc(bars: DataFrame, n: int = 10) -> DataFrame:
    return bars.withColumn("roc", F.when(lag("close", n) != 0, (C() / lag("close", n) - 1) * 100))


def momentum(bars: DataFrame, n: int = 10) -> DataFrame:
    return bars.withColumn("momentum", C() - lag("close", n))


def cci(bars: DataFrame, n: int = 20) -> DataFrame:
    """Typical price less its mean, over 0.015 times the mean deviation from this window's own mean."""
    out = bars.withColumn("_tp", typical()).withColumn("_all", full("_tp", F.collect_list("_tp"), n))
    out = out.withColumn("_mean", mean("_tp", n))
    away = F.aggregate("_all", F.lit(0.0), lambda s, x: s + F.abs(x - F.col("_mean"))) / n
    return out.withColumn("cci", F.when(away > 0, (F.col("_tp") - F.col("_mean")) / (0.015 * away)).when(away == 0, 0.0)).drop("_tp", "_all", "_mean")


def ultimate_oscillator(bars: DataFrame, periods: tuple[int, int, int] = (7, 14, 28)) -> DataFrame:
    floor = F.least(L(), lag("close"))
    out = bars.withColumns({"_bp": C() - floor, "_tr": F.greatest(H(), lag("close")) - floor})
    out = out.withColumns({"_bp": F.when(lag("close").isNotNull(), F.col("_bp")), "_tr": F.when(lag("close").isNotNull(), F.col("_tr"))})
    parts = [F.when(total("_tr", n) != 0, total("_bp", n) / total("_tr", n)) for n in periods]
    return out.withColumn("ultimate", 100 * (4 * parts[0] + 2 * parts[1] + parts[2]) / 7).drop("_bp", "_tr")


def obv(bars: DataFrame) -> DataFrame:
    """Volume summed by the sign of the close's change; the first bar's counts in full."""
    step = F.when(lag("close").isNull() | (C() > lag("close")), V()).when(C() < lag("close"), -V()).otherwise(0.0)
    return bars.withColumn("_s", step).withColumn("obv", F.sum("_s").over(so_far())).drop("_s")


def money_flow_volume() -> Column:
    return F.when(H() != L(), ((C() - L()) - (H() - C())) / (H() - L()) * V()).otherwise(0.0)


def ad_line(bars: DataFrame) -> DataFrame:
    return bars.withColumn("ad_line", F.sum(money_flow_volume()).over(so_far()))


def mfi(bars: DataFrame, n: int = 14) -> DataFrame:
    out = bars.withColumn("_tp", typical())
    out = out.withColumns({"_up": F.when(F.col("_tp") > lag("_tp"), F.col("_tp") * V()).when(lag("_tp").isNotNull(), 0.0), "_down": F.when(F.col("_tp") < lag("_tp"), F.col("_tp") * V()).when(lag("_tp").isNotNull(), 0.0)})
    flow = total("_up", n) + total("_down", n)
    return out.withColumn("mfi", F.when(flow >= 1, 100 * total("_up", n) / flow).when(flow < 1, 0.0)).drop("_tp", "_up", "_down")


def vwap(bars: DataFrame) -> DataFrame:
    """From the first bar on, without a reset."""
    return bars.withColumn("vwap", F.sum(typical() * V()).over(so_far()) / F.nullif(F.sum("volume").over(so_far()), F.lit(0.0)))


def simple_rsi(bars: DataFrame, n: int = 14) -> DataFrame:
    """RSI of plain means of gains and losses."""
    out = bars.withColumn("_d", C() - lag("close"))
    gain = full("_d", F.avg(F.greatest("_d", F.lit(0.0))), n)
    loss = full("_d", F.avg(F.greatest(-F.col("_d"), F.lit(0.0))), n)
    return out.withColumn("rsi_simple", F.when(loss > 0, 100 - 100 / (1 + gain / loss)).when(gain > 0, 100.0).when(loss == 0, 50.0)).drop("_d")


def expanding_mean(bars: DataFrame, n: int = 20) -> DataFrame:
    """A moving average that starts with what there is."""
    return bars.withColumn("ma_warm", F.avg("close").over(last(n)))


def normalised(bars: DataFrame) -> DataFrame:
    """Close against the first bar's, as 100."""
    first = F.first("close").over(so_far())
    return bars.withColumn("close_100", F.when(first != 0, C() / first * 100))


def volume_profile(bars: DataFrame, bins: int = 20) -> DataFrame:
    """(symbol, bin, low_edge, high_edge, volume): equal bins from the least low to the greatest high; a bar counts in full in each bin that it touches, bounds included.

    The bins of a bar are enumerated from its own low and high: no join with all bins.
    """
    ends = bars.groupBy("symbol").agg(F.min("low").alias("_lo"), F.max("high").alias("_hi")).withColumn("_step", (F.col("_hi") - F.col("_lo")) / bins)
    edges = ends.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    edges = edges.select("symbol", "bin", (F.col("_lo") + F.col("bin") * F.col("_step")).alias("low_edge"), (F.col("_lo") + (F.col("bin") + 1) * F.col("_step")).alias("high_edge"))
    at = lambda x: F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((x - F.col("_lo")) / F.nullif(F.col("_step"), F.lit(0.0))).cast("int")))
    touched = bars.join(F.broadcast(ends), "symbol")  # a row a symbol
    near = F.sequence(F.greatest(F.lit(0), F.coalesce(at(L()), F.lit(0)) - 1), F.least(F.lit(bins - 1), F.coalesce(at(H()), F.lit(bins - 1)) + 1))
    spread = touched.select("symbol", "low", "high", F.col("volume").alias("_v"), F.explode(near).alias("bin")).join(F.broadcast(edges), ["symbol", "bin"])
    hit = spread.where((L() <= F.col("high_edge")) & (H() >= F.col("low_edge"))).groupBy("symbol", "bin").agg(F.sum("_v").alias("volume"))
    return edges.join(hit, ["symbol", "bin"], "left").select("symbol", "bin", "low_edge", "high_edge", F.coalesce("volume", F.lit(0.0)).alias("volume"))


def ma_crossover(bars: DataFrame, fast: int = 20, slow: int = 50, gap: float = 0.001) -> DataFrame:
    """BULLISH or BEARISH where the fast mean crosses the slow one by more than `gap` of it."""
    out = bars.withColumns({"_f": mean("close", fast), "_s": mean("close", slow)})
    wide = F.abs(F.col("_f") - F.col("_s")) / F.col("_s") > gap
    up = (lag("_f") <= lag("_s")) & (F.col("_f") > F.col("_s")) & wide
    down = (lag("_f") >= lag("_s")) & (F.col("_f") < F.col("_s")) & wide
    return out.withColumn("cross", F.when(up, "BULLISH").when(down, "BEARISH")).drop("_f", "_s")


def composite_momentum(bars: DataFrame) -> DataFrame:
    """0.4 RSI + 0.3 %K + 0.3 (Williams %R + 100), null if one is; and the mean of those that are there."""
    out = williams_r(stochastic(simple_rsi(bars)))
    parts = [F.col("rsi_simple"), F.col("stoch_k"), F.col("williams_r") + 100]
    there = F.filter(F.array(*parts), lambda x: x.isNotNull())
    average = F.aggregate(there, F.lit(0.0), lambda s, x: s + x) / F.nullif(F.size(there), F.lit(0))
    return out.withColumns({"composite_momentum": 0.4 * parts[0] + 0.3 * parts[1] + 0.3 * parts[2], "composite_mean": average})


def volatility_regime(bars: DataFrame) -> DataFrame:
    """From bar 61 on: 1 up, 2 down, 3 sideways at volatility under 15 %, 4 over 30 %, else 5. Volatility: sample deviation of 20 returns times the root of 252, in percent, 20 where missing."""
    out = bars.withColumns({"_r": C() / F.nullif(lag("close"), F.lit(0.0)) - 1, "_i": F.row_number().over(in_order()), "_m20": mean("close", 20), "_m50": mean("close", 50)})
    vol = F.coalesce(full("_r", F.stddev_samp("_r"), 20) * (252**0.5) * 100, F.lit(20.0))
    out = out.withColumn("_vol", vol)
    up, down = (C() > F.col("_m20")) & (F.col("_m20") > F.col("_m50")), (C() < F.col("_m20")) & (F.col("_m20") < F.col("_m50"))
    code = F.when(F.col("_vol") < 15, F.when(up, 1).when(down, 2).otherwise(3)).when(F.col("_vol") > 30, 4).otherwise(5)
    return out.withColumn("regime_code", F.when(F.col("_i") > 60, code)).drop("_r", "_i", "_m20", "_m50", "_vol")


def native_pack(bars: DataFrame) -> DataFrame:
    """All of these that give a value a bar."""
    for step in (sma, wma, bollinger, donchian, ichimoku, aroon, stochastic, williams_r, roc, momentum, cci, ultimate_oscillator, obv, ad_line, mfi, vwap, simple_rsi):
        bars = step(bars)
    return bars
