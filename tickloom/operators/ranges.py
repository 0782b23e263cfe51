"""Trading ranges of a symbol's last rows: levels that peaks and troughs share, the best pair of them, and the signal at its edges.

Levels come from at most `most` last rows of each symbol, so that a group stays small however long the history; all that follows is column expressions.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.windows import full, lag
from tickloom.operators.patterns import peaks
from tickloom.operators.strategies import at_most

TOLERANCE, TOUCHES = 0.015, 3
LEAST_WIDTH, MOST_WIDTH, IDEAL_WIDTH = 0.02, 0.15, 0.06


def levels(values: np.ndarray, volume: np.ndarray, side: int = 1, tolerance: float = TOLERANCE, touches: int = TOUCHES, distance: int = 5) -> list[tuple[float, int, float, float, int]]:
    """(price, touches, quality, volume, last place) of levels that enough peaks (side 1) or troughs (side -1) share, best first.

    A peak gathers all within the tolerance of its own price. A level near one that is known replaces it if its quality, 20 a touch
    and 30 for evenness, is higher.
    """
    at = peaks(side * values, distance)
    found: list[tuple[float, int, float, float, int]] = []
    for place in at.tolist():
        near = at[np.abs(values[at] - values[place]) / values[place] <= tolerance]
        if len(near) < touches:
            continue
        price = float(values[near].mean())
        new = (price, len(near), 20 * len(near) + 30 * (1 - float(values[near].std()) / price), float(volume[near].mean()), int(near[-1]))
        same = next((k for k, old in enumerate(found) if abs(price - old[0]) / price <= tolerance), None)
        if same is None:
            found.append(new)
        elif new[2] > found[same][2]:
            found.pop(same)
            found.append(new)
    return sorted(found, key=lambda x: -x[2])


def quality(top: tuple, bottom: tuple, closes: np.ndarray) -> float:
    """Up to 40 for the levels, 20 for a width near 6 %, 20 for touches, 20 for the share of closes inside."""
    width = (top[0] - bottom[0]) / bottom[0]
    inside = float(((closes >= bottom[0]) & (closes <= top[0])).mean())
    return min(100.0, min(40.0, (top[2] + bottom[2]) / 2) + max(0.0, 20 * (1 - abs(width - IDEAL_WIDTH) / IDEAL_WIDTH)) + min(20.0, 2.0 * (top[1] + bottom[1])) + 20 * inside)


def best_range(high: np.ndarray, low: np.ndarray, close: np.ndarray, volume: np.ndarray) -> dict | None:
    """The pair of one of the three best resistances and supports with the highest quality, 2 to 15 % apart; None without one."""
    tops, bottoms = levels(high, volume)[:3], levels(low, volume, side=-1)[:3]
    best = None
    for top in tops:
        for bottom in bottoms:
            if top[0] > bottom[0] and LEAST_WIDTH <= (top[0] - bottom[0]) / bottom[0] <= MOST_WIDTH:
                score = quality(top, bottom, close)
                if best is None or score > best["quality"]:
                    best = {"support": bottom[0], "resistance": top[0], "quality": score, "support_touches": bottom[1], "resistance_touches": top[1]}
    if best is None:
        return None
    middle, span = (best["support"] + best["resistance"]) / 2, best["resistance"] - best["support"]
    away = np.abs(close - middle)
    recent = close[-10:]
    moved = recent[-1] / recent[0] - 1
    edge = (best["resistance"] - close[-1]) / span < 0.1 and moved > 0.01 or (close[-1] - best["support"]) / span < 0.1 and moved < -0.01
    return best | {"bars": len(close), "reversion": float((away[1:] < away[:-1]).mean()) if len(close) > 1 else 0.5, "breakout_probability": 0.7 if edge else 0.3}


_RANGE = "symbol string, support double, resistance double, quality double, support_touches long, resistance_touches long, bars long, reversion double, breakout_probability double"


def ranges(rows: DataFrame, most: int = 100, least: int = 15) -> DataFrame:
    """The best range of each symbol's last `most` rows (symbol, ts, high, low, close, volume); no row without one or under `least` rows."""
    recent = rows.select("symbol", "ts", "high", "low", "close", "volume", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("ts"))).alias("_rn")).where(F.col("_rn") <= most)
    names = [x.split()[0] for x in _RANGE.split(", ")]

    def run(group: pd.DataFrame) -> pd.DataFrame:
        g = group.sort_values("ts")
        found = best_range(*(g[c].to_numpy(dtype=float) for c in ("high", "low", "close", "volume"))) if len(g) >= least else None
        return pd.DataFrame([{"symbol": g["symbol"].iloc[0], **found}] if found else [], columns=names)

    return recent.groupBy("symbol").applyInPandas(run, _RANGE)


def grade(quality_: Column) -> Column:
    return F.when(quality_ >= 80, "EXCELLENT").when(quality_ >= 65, "GOOD").when(quality_ >= 50, "MODERATE").when(quality_ >= 35, "POOR").otherwise("INVALID")


def position(price: Column, support: Column, resistance: Column) -> Column:
    """OUTSIDE, or the fifth of the range in which the price lies."""
    share = (price - support) / (resistance - support)
    return F.when((price < support) | (price > resistance), "OUTSIDE").when(share <= 0.2, "BOTTOM").when(share <= 0.4, "LOWER").when(share <= 0.6, "MIDDLE").when(share <= 0.8, "UPPER").when(share.isNotNull(), "TOP")


def conditions(rows: DataFrame) -> DataFrame:
    """rows with momentum of 4 rows, volume against the mean of 10, RSI of 14, and `may_buy`, `may_sell`: no strong move against, 1.2 times the volume, RSI at 30 and under or 70 and over; a condition without enough rows holds."""
    d = F.col("close") - lag("close")
    out = rows.withColumns({"_d": d, "momentum_4": F.col("close") / lag("close", 4) - 1, "_mean": full("volume", F.avg("volume"), 10)})
    gain, loss = full("_d", F.avg(F.greatest(F.col("_d"), F.lit(0.0))), 14), full("_d", F.avg(F.greatest(-F.col("_d"), F.lit(0.0))), 14)
    out = out.withColumns({"_g": gain, "_l": loss})
    rsi = F.when(F.col("_l") > 0, 100 - 100 / (1 + F.col("_g") / F.col("_l"))).when(F.col("_g") > 0, 100.0)
    out = out.withColumn("rsi", rsi)
    ok = lambda c: F.coalesce(c, F.lit(True))
    enough = ok(F.col("volume") >= 1.2 * F.col("_mean"))
    return out.withColumns({"may_buy": ok(F.col("momentum_4") >= -0.005) & enough & ok(F.col("rsi") <= 30), "may_sell": ok(F.col("momentum_4") <= 0.005) & enough & ok(F.col("rsi") >= 70)}).drop("_d", "_mean", "_g", "_l")


def judged(found: DataFrame) -> DataFrame:
    """Ranges joined with their symbol's last conditions (price, momentum_4, may_buy, may_sell): position, grade, momentum within the range, time to target, stop half a percent outside, target at 0.8 of the way, signal with its reward over risk, and `valid`."""
    c = F.col
    width = c("resistance") - c("support")
    out = found.withColumns({"grade": grade(c("quality")), "position": position(c("price"), c("support"), c("resistance")), "range_momentum": c("momentum_4") / (width / c("support")), "_base": F.greatest(F.lit(5), F.floor(c("bars") / 4))})
    time = F.when(c("grade") == "EXCELLENT", F.greatest(F.lit(3), F.floor(c("_base") / 2))).when(c("grade") == "GOOD", F.greatest(F.lit(5), F.floor(c("_base") * 7 / 10))).otherwise(c("_base"))
    sound = (c("quality") >= 60) & (c("breakout_probability") <= 0.8) & (c("reversion") >= 0.4)
    signal = F.when(sound & c("position").isin("BOTTOM", "LOWER") & c("may_buy"), "BUY").when(sound & c("position").isin("TOP", "UPPER") & c("may_sell"), "SELL")
    out = out.withColumns({"bars_to_target": time.cast("long"), "sound": sound, "signal": signal})
    buys = c("signal") == "BUY"
    out = out.withColumns({"stop": F.when(buys, c("support") * 0.995).when(c("signal") == "SELL", c("resistance") * 1.005), "target": F.when(buys, c("price") + (c("resistance") - c("price")) * 0.8).when(c("signal") == "SELL", c("price") - (c("price") - c("support")) * 0.8)})
    ratio = F.abs(c("target") - c("price")) / F.abs(c("price") - c("stop"))
    return out.withColumns({"reward_risk": ratio, "signal_confidence": F.when(c("signal").isNotNull(), at_most(c("quality"), 95.0))}).withColumn("valid", F.coalesce((c("reward_risk") >= 1.5) & (c("signal_confidence") >= 60) & (c("position") != "OUTSIDE"), F.lit(False))).drop("_base")
