"""Market scans: each adds a score, a confidence and an alert level to bars where its conditions hold; `scan` unites and ranks them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions import indicators as ind
from tickloom.functions.windows import before, in_order, lag

OUT = ("symbol", "ts", "scan", "score", "confidence", "alert", "close")
ALERTS = ("CRITICAL", "HIGH", "MEDIUM", "LOW")


def prepared(bars: DataFrame) -> DataFrame:
    """Bars with what the scans look at: change, volume ratios, RSI, volatility of 5 and of the 15 before."""
    out = ind.simple_rsi(bars).withColumns({
        "_i": F.row_number().over(in_order()), "change_pct": (F.col("close") - lag("close")) / F.nullif(lag("close"), F.lit(0.0)) * 100, "vol_ratio_20": F.col("volume") / F.nullif(F.avg("volume").over(before(20)), F.lit(0.0)),
        "vol_ratio_10": F.col("volume") / F.nullif(F.avg("volume").over(before(10)), F.lit(0.0)), "top_20": F.max("close").over(before(20)), "_lr": F.when((F.col("close") > 0) & (lag("close") > 0), F.ln(F.col("close") / lag("close"))),
    })
    return out.withColumns({"vol_5": F.stddev_pop("_lr").over(in_order().rowsBetween(-4, 0)), "vol_15": F.stddev_pop("_lr").over(in_order().rowsBetween(-19, -5))}).where("_i > 20")


def _mark(scan: str, cond: Column, score: Column, confidence: Column, alert: Column) -> Column:
    """What a scan says of a row; null where its condition does not hold."""
    return F.when(cond, F.struct(F.lit(scan).alias("scan"), score.cast("double").alias("score"), confidence.cast("double").alias("confidence"), alert.alias("alert")))


def _found(rows: DataFrame | None, *marks: Column) -> DataFrame | list[Column]:
    """A row for each mark of rows; without rows the marks themselves, for a pass that holds several scans."""
    if rows is None:
        return list(marks)
    return rows.select("symbol", "ts", "close", F.explode(F.filter(F.array(*marks), lambda x: x.isNotNull())).alias("_m")).select("symbol", "ts", "_m.*", "close")


def _one(c: Column) -> Column:
    return F.least(c, F.lit(1.0))


def breakout(rows: DataFrame | None) -> DataFrame | list[Column]:
    """Close over 1.005 times the highest close of the 20 bars before: 0.4 strength + 0.4 volume + 0.2 RSI over 50, at least 0.5."""
    strength = _one((F.col("close") / F.col("top_20") - 1) * 20)
    ratio = F.coalesce("vol_ratio_20", F.lit(0.0))
    score = 0.4 * strength + 0.4 * _one(ratio / 2) + 0.2 * (F.coalesce("rsi_simple", F.lit(50.0)) - 50) / 50
    alert = F.when((score > 0.8) & (ratio > 3), "HIGH").when((score > 0.6) & (ratio > 2), "MEDIUM").otherwise("LOW")
    return _found(rows, _mark("BREAKOUT", (F.col("close") > 1.005 * F.col("top_20")) & (score >= 0.5), score, _one(0.5 + score / 2), alert))


def momentum(rows: DataFrame | None) -> DataFrame | list[Column]:
    """At least two of: RSI in 60..80, change over 2 %, volume over 1.2 times the mean; weights 0.4, 0.3, 0.3."""
    flags = [F.coalesce(c, F.lit(False)).cast("int") for c in ((F.col("rsi_simple") > 60) & (F.col("rsi_simple") < 80), F.col("change_pct") > 2, F.col("vol_ratio_10") > 1.2)]
    score = 0.4 * flags[0] + 0.3 * flags[1] + 0.3 * flags[2]
    n = flags[0] + flags[1] + flags[2]
    return _found(rows, _mark("MOMENTUM", n >= 2, score, 0.5 + n / 8.0, F.when(n == 3, "HIGH").otherwise("MEDIUM")))


def volume_spike(rows: DataFrame | None, least: float = 2.0) -> DataFrame | list[Column]:
    ratio = F.col("vol_ratio_20")
    score = 0.8 * _one(ratio / 5) + 0.2 * _one(F.abs(F.coalesce("change_pct", F.lit(0.0))) / 5)
    alert = F.when((ratio > 5) & (F.abs("change_pct") > 3), "CRITICAL").when(ratio > 4, "HIGH").when(ratio > 3, "MEDIUM").otherwise("LOW")
    return _found(rows, _mark("VOLUME_SPIKE", ratio >= least, score, _one(0.5 + ratio / 20), alert))


def gap(rows: DataFrame | None, least: float = 3.0) -> DataFrame | list[Column]:
    move = F.abs("change_pct")
    score = _one(move / 10) * F.when(F.col("vol_ratio_10") > 1.5, 1.2).otherwise(1.0)
    alert = F.when(move > 8, "CRITICAL").when(move > 5, "HIGH").otherwise("MEDIUM")
    up, down = (F.col("change_pct") >= least) & (F.col("change_pct") > 0), (F.col("change_pct") <= -least) & (F.col("change_pct") < 0)
    return _found(rows, _mark("GAP_UP", up, score, _one(0.5 + move / 20), alert), _mark("GAP_DOWN", down, score, _one(0.5 + move / 20), alert))


def reversal(rows: DataFrame | None) -> DataFrame | list[Column]:
    """RSI under 30 and rising over 1 %, or over 70 and falling over 1 %."""
    up, down = (F.col("rsi_simple") < 30) & (F.col("change_pct") > 1), (F.col("rsi_simple") > 70) & (F.col("change_pct") < -1)
    score = F.when(up, (30 - F.col("rsi_simple")) / 30).otherwise((F.col("rsi_simple") - 70) / 30) * 0.5 + 0.5
    return _found(rows, _mark("REVERSAL", up | down, score, F.lit(0.6), F.lit("MEDIUM")))


def volatility_spike(rows: DataFrame | None, least: float = 1.5) -> DataFrame | list[Column]:
    ratio = F.col("vol_5") / F.nullif(F.col("vol_15"), F.lit(0.0))
    score = 0.6 * _one(ratio / 3) + 0.4 * _one(F.abs(F.coalesce("change_pct", F.lit(0.0))) / 5)
    return _found(rows, _mark("VOLATILITY_SPIKE", ratio >= least, score, _one(0.4 + ratio / 10), F.when(ratio > 3, "HIGH").otherwise("MEDIUM")))


SCANS = (breakout, momentum, volume_spike, gap, reversal, volatility_spike)


def scan(bars: DataFrame, least_score: float = 0.5, least_confidence: float = 0.5) -> DataFrame:
    """All scans' results that reach the thresholds: one pass over the bars, a row for each scan that finds one."""
    found = _found(prepared(bars), *[mark for one in SCANS for mark in one(None)])
    return found.where((F.col("score") >= least_score) & (F.col("confidence") >= least_confidence))


def breakout_preset(bars: DataFrame, volume: float = 100_000, ratio: float = 1.5, least_score: float = 0.7) -> DataFrame:
    """Breakouts with enough volume, so many times the mean of 20 bars, and a high score."""
    rows = prepared(bars).where((F.col("volume") >= volume) & (F.col("vol_ratio_20") >= ratio))
    return breakout(rows).where(F.col("score") >= least_score)


def momentum_preset(bars: DataFrame, asset_type_: Column, rsi: tuple[float, float] = (60, 80), change: float = 3.0, least_score: float = 0.6) -> DataFrame:
    """Momentum of stocks with an RSI in a range and a change of so many percent."""
    rows = prepared(bars).where((asset_type_ == "stock") & F.col("rsi_simple").between(*rsi) & (F.col("change_pct") >= change))
    return momentum(rows).where(F.col("score") >= least_score)


def top(found: DataFrame, limit: int = 50) -> DataFrame:
    """A report: the first by alert level and score."""
    level = F.array_position(F.array(*[F.lit(a) for a in ALERTS]), F.col("alert"))
    return found.orderBy(level, F.desc("score"), "symbol", "ts", "scan").limit(limit)


def history(found: DataFrame, as_of: Column, hours: int, limit: int, scan_name: str | None = None) -> DataFrame:
    """Results of the last hours, newest first."""
    recent = found.where(F.col("ts") >= as_of - F.make_dt_interval(hours=F.lit(hours)))
    if scan_name:
        recent = recent.where(F.col("scan") == scan_name)
    return recent.orderBy(F.desc("ts"), "symbol", "scan").limit(limit)


def best_per_symbol(found: DataFrame, k: int = 3) -> DataFrame:
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("score"), "ts", "scan")))
    return ranked.where(F.col("rank") <= k)


def asset_type(symbol: Column) -> Column:
    """By the symbol's form: a pair with a slash or six letters of two currencies is forex, -USD and known coins crypto, =F a future, else stock."""
    coins = ("BTC", "ETH", "SOL", "ADA", "DOGE", "XRP")
    money = "USD|EUR|GBP|JPY|CHF|AUD|CAD|NZD"
    return F.when(symbol.rlike(f"^({money})/?({money})$") | symbol.rlike("=X$"), "forex").when(symbol.rlike("=F$"), "commodity").when(symbol.rlike("-USDT?$") | symbol.rlike("^(" + "|".join(coins) + ")"), "crypto").otherwise("stock")
