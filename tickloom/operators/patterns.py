"""Chart patterns. What a fixed window shows is a window expression; peaks with a distance and a prominence are found in one grouped pass."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.windows import before, full, in_order, lag


def reliability(confidence: Column) -> Column:
    return F.when(confidence >= 0.9, "VERY_HIGH").when(confidence >= 0.8, "HIGH").when(confidence >= 0.6, "MEDIUM").when(confidence >= 0.4, "LOW").otherwise("VERY_LOW")


def breakouts(bars: DataFrame, n: int = 19) -> DataFrame:
    """Bars that close beyond the n bars before by over 1 % of their range: direction, strength, confidence (raised by 0.1 on 1.5 times the volume)."""
    top, bottom = F.max("high").over(before(n)), F.min("low").over(before(n))
    rows = bars.withColumns({"_top": top, "_bottom": bottom, "_there": F.count("close").over(before(n)), "_v": F.avg("volume").over(before(n))}).where(F.col("_there") == n)
    gap = F.col("_top") - F.col("_bottom")
    up, down = (F.col("close") - F.col("_top")) / gap, (F.col("_bottom") - F.col("close")) / gap
    rows = rows.withColumn("strength", F.when(gap > 0, F.greatest(up, down))).where(F.col("strength") > 0.01)
    loud = F.coalesce(F.col("volume") > 1.5 * F.col("_v"), F.lit(False))
    confidence = F.least(F.lit(0.95), 0.6 + 2 * F.col("strength")) + F.when(loud, 0.1).otherwise(0.0)
    return rows.select("symbol", "ts", F.when(F.col("close") > F.col("_top"), "BUY").otherwise("SELL").alias("direction"), "strength", confidence.alias("confidence"))


def volume_breakouts(bars: DataFrame) -> DataFrame:
    """Over three times the mean volume of 20 bars before and a move over 1 %."""
    move = F.when(lag("close") != 0, F.col("close") / lag("close") - 1)
    rows = bars.withColumns({"ret": move, "ratio": F.col("volume") / F.nullif(F.avg("volume").over(before(20)), F.lit(0.0))})
    return rows.where((F.col("ratio") > 3) & (F.abs("ret") > 0.01)).select("symbol", "ts", "ratio", "ret")


def atr_breakouts(bars: DataFrame, n: int = 14, times: float = 1.5) -> DataFrame:
    """Moves over `times` the plain mean true range of n bars before."""
    spread = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - lag("close")), F.abs(F.col("low") - lag("close")))
    rows = bars.withColumns({"_tr": spread, "move": F.col("close") - lag("close")})
    rows = rows.withColumns({"_n": F.count("_tr").over(before(n)), "atr": F.avg("_tr").over(before(n))})
    return rows.where((F.col("_n") == n) & (F.abs("move") > times * F.col("atr"))).select("symbol", "ts", "move", "atr")


def bollinger_breakouts(bars: DataFrame, n: int = 20, width: float = 2.0) -> DataFrame:
    """Closes beyond the mean of n by `width` sample deviations."""
    mid, sd = full("close", F.avg("close"), n), full("close", F.stddev_samp("close"), n)
    rows = bars.withColumns({"_mid": mid, "_sd": sd})
    rows = rows.withColumn("z", F.when(F.col("_sd") > 0, (F.col("close") - F.col("_mid")) / F.col("_sd")))
    return rows.where(F.abs("z") > width).select("symbol", "ts", F.when(F.col("z") > 0, "BUY").otherwise("SELL").alias("direction"), "z")


def flags(bars: DataFrame, pole: int = 15, rest: int = 10) -> DataFrame:
    """Bars after a move of over 5 % in `pole` bars whose next `rest` bars keep to under half of it."""
    ahead = in_order().rowsBetween(0, rest - 1)
    rows = bars.withColumns({"_b": lag("close", pole), "_hi": F.max("high").over(ahead), "_lo": F.min("low").over(ahead), "_n": F.count("close").over(ahead)})
    moved = F.col("close") - F.col("_b")
    rows = rows.withColumn("move_pct", F.when(F.col("_b") > 0, moved / F.col("_b") * 100)).where((F.abs("move_pct") > 5) & (F.col("_n") == rest))
    return rows.where(F.col("_hi") - F.col("_lo") < 0.5 * F.abs(F.col("close") - F.col("_b"))).select("symbol", "ts", F.when(F.col("move_pct") > 0, "BULL_FLAG").otherwise("BEAR_FLAG").alias("pattern"), "move_pct")


def candles(bars: DataFrame) -> DataFrame:
    """(symbol, ts, pattern, direction): doji, hammer, shooting star, marubozu, engulfing and harami, from bodies and shadows of this bar and the last."""
    o, h, low, c = (F.col(x) for x in ("open", "high", "low", "close"))
    body, spread = F.abs(c - o), h - low
    upper, lower = h - F.greatest(o, c), F.least(o, c) - low
    po, pc = lag("open"), lag("close")
    rows = bars.withColumns({"_po": po, "_pc": pc, "_body": full(F.abs(c - o), F.avg(F.abs(c - o)), 10)})
    po, pc = F.col("_po"), F.col("_pc")
    mark = lambda cond, name, way: F.when(F.coalesce(cond, F.lit(False)), F.struct(F.lit(name).alias("pattern"), F.lit(way).alias("direction")))
    every = F.array(
        mark((spread > 0) & (body <= 0.1 * spread), "DOJI", "NEUTRAL"), mark((body > 0) & (lower >= 2 * body) & (upper <= 0.3 * body), "HAMMER", "BUY"), mark((body > 0) & (upper >= 2 * body) & (lower <= 0.3 * body), "SHOOTING_STAR", "SELL"),
        mark((body > F.col("_body")) & (body >= 0.95 * spread) & (c > o), "MARUBOZU", "BUY"), mark((body > F.col("_body")) & (body >= 0.95 * spread) & (c < o), "MARUBOZU", "SELL"),
        mark((pc < po) & (c > o) & (o <= pc) & (c >= po), "ENGULFING", "BUY"), mark((pc > po) & (c < o) & (o >= pc) & (c <= po), "ENGULFING", "SELL"),
        mark((pc < po) & (c > o) & (o > pc) & (c < po), "HARAMI", "BUY"), mark((pc > po) & (c < o) & (o < pc) & (c > po), "HARAMI", "SELL"),
    )
    return rows.select("symbol", "ts", F.explode(F.filter(every, lambda x: x.isNotNull())).alias("e")).select("symbol", "ts", "e.*")


def double_extremes(bars: DataFrame, window: int = 20, within: float = 0.02) -> DataFrame:
    """(symbol, pattern, first, second, ts): the last two strict 5-point lows (highs) of each symbol's last bars, if within 2 % of each other and the last close is 1 % beyond."""
    rows = bars.withColumn("_rn", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("ts")))).where(F.col("_rn") <= window)
    ends = rows.groupBy("symbol").agg(F.max_by("close", "ts").alias("_last"))
    order = in_order()
    around = lambda x: [F.lag(x, 1).over(order), F.lag(x, 2).over(order), F.lead(x, 1).over(order), F.lead(x, 2).over(order)]
    low_is = [F.col("low") < v for v in around("low")]
    high_is = [F.col("high") > v for v in around("high")]
    marked = rows.withColumns({"_low": low_is[0] & low_is[1] & low_is[2] & low_is[3], "_high": high_is[0] & high_is[1] & high_is[2] & high_is[3]})
    found = None
    for flag, value, name in (("_low", "low", "DOUBLE_BOTTOM"), ("_high", "high", "DOUBLE_TOP")):
        some = marked.where(flag).select("symbol", "ts", F.col(value).alias("second"), F.lag(value).over(order).alias("first"), F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("ts"))).alias("_k"))
        some = some.where("_k = 1 and first is not null").select("symbol", F.lit(name).alias("pattern"), "first", "second", "ts")
        found = some if found is None else found.unionByName(some)
    apart = F.when(F.col("first") != F.col("second"), F.abs(F.col("first") - F.col("second")) / F.greatest(F.abs("first"), F.abs("second"))).otherwise(0.0)
    both = found.join(ends, "symbol").where(apart < within)
    beyond = F.when(F.col("pattern") == "DOUBLE_BOTTOM", F.col("_last") > 1.01 * F.greatest("first", "second")).otherwise(F.col("_last") < 0.99 * F.least("first", "second"))
    return both.where(beyond).drop("_last")


def triangles(bars: DataFrame, n: int = 15) -> DataFrame:
    """(symbol, ts, pattern, fit) of each symbol's last bar: lines through the highs and lows of n bars, slopes relative to the first price."""
    rows = bars.withColumn("_i", F.row_number().over(in_order()).cast("double"))
    for x in ("high", "low"):
        rows = rows.withColumns({f"_s_{x}": full(x, F.regr_slope(x, "_i"), n) / F.nullif(F.first(x).over(in_order().rowsBetween(-(n - 1), 0)), F.lit(0.0)), f"_f_{x}": full(x, F.regr_r2(x, "_i"), n)})
    flat, rise, fall = (lambda c: F.abs(c) < 0.01), (lambda c: c > 0.01), (lambda c: c < -0.01)
    h, low = F.col("_s_high"), F.col("_s_low")
    name = F.when(flat(h) & rise(low), "ASCENDING").when(fall(h) & flat(low), "DESCENDING").when(fall(h) & rise(low), "SYMMETRIC")
    rows = rows.withColumns({"pattern": name, "fit": F.least("_f_high", "_f_low"), "_rn": F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("ts")))})
    return rows.where("_rn = 1 and pattern is not null and fit > 0.4").select("symbol", "ts", "pattern", "fit")


def peaks(x: np.ndarray, distance: int = 1, prominence: float = 0.0) -> np.ndarray:
    """Places of local maxima (the middle of a plateau), thinned so that the higher of any two nearer than `distance` stays, of at least the prominence."""
    found, i = [], 1
    while i < len(x) - 1:
        if x[i] > x[i - 1]:
            j = i
            while j + 1 < len(x) and x[j + 1] == x[i]:
                j += 1
            if j + 1 < len(x) and x[j + 1] < x[i]:
                found.append((i + j) // 2)
            i = j
        i += 1
    at = np.array(found, dtype=int)
    if distance > 1 and len(at):
        keep = np.ones(len(at), bool)
        for k in np.argsort(x[at], kind="stable")[::-1]:
            if keep[k]:
                near = np.abs(at - at[k]) < distance
                near[k] = False
                keep[near] = False
        at = at[keep]
    if prominence > 0:
        at = np.array([p for p in at if _prominence(x, p) >= prominence], dtype=int)
    return at


def _prominence(x: np.ndarray, p: int) -> float:
    """Height over the higher of the two lowest points passed on the way to higher ground."""
    left = np.flatnonzero(x[:p] > x[p])
    right = np.flatnonzero(x[p + 1 :] > x[p])
    a, b = (left[-1] + 1 if len(left) else 0), (p + 1 + right[0] if len(right) else len(x))
    return float(x[p] - max(x[a : p + 1].min(), x[p:b].min()))


def levels(prices: np.ndarray, spread: float) -> list[tuple[float, int, float]]:
    """(mean, touches, strength) of prices in a row, ascending, that lie within 0.02 times `spread` of their group's mean; groups of two or more."""
    groups: list[list[float]] = []
    for p in np.sort(prices):
        if groups and abs(p - np.mean(groups[-1])) <= 0.02 * spread:
            groups[-1].append(float(p))
        else:
            groups.append([float(p)])
    return [(float(np.mean(g)), len(g), min(1.0, len(g) / 5)) for g in groups if len(g) >= 2]


def _apart(a: float, b: float) -> float:
    """How far two prices differ, as a share of the larger; two zeros are equal."""
    return abs(a - b) / max(abs(a), abs(b)) if a != b else 0.0


PATTERN = "symbol string, pattern string, start timestamp_ntz, end timestamp_ntz, level double, target double, confidence double"
_COLUMNS = [x.split()[0] for x in PATTERN.split(", ")]


def _peak_patterns(symbol: str, bars: pd.DataFrame) -> list[tuple]:
    bars = bars.sort_values("ts", kind="stable")
    ts, high, low, close = (bars[c].to_numpy() for c in ("ts", "high", "low", "close"))
    if len(bars) < 10:
        return []
    out = []
    top, bottom = peaks(high, 5, 0.5 * high.std()), peaks(-low, 5, 0.5 * low.std())
    for a, b, c in zip(top, top[1:], top[2:], strict=False):
        left, head, right = high[a], high[b], high[c]
        inner = [v for v in bottom if a < v < c]
        if head > max(left, right) and _apart(left, right) < 0.05 and len(inner) >= 2:
            neck = float(low[inner[:2]].mean())
            symmetry, rise = 1 - _apart(left, right), (head - max(left, right)) / head
            out.append((symbol, "HEAD_AND_SHOULDERS", ts[a], ts[c], neck, neck - (head - neck), float(np.clip(0.4 * symmetry + 0.4 * min(1, rise * 10) + 0.2 * min(1, (head - neck) / head * 10), 0.1, 0.95))))
    for mirror, name in ((1, "DOUBLE_TOP"), (-1, "DOUBLE_BOTTOM")):
        x, y = (high, low) if mirror > 0 else (-low, -high)
        tops = peaks(x, 10, 0.3 * x.std())
        for a, b in zip(tops, tops[1:], strict=False):
            between = float(y[a : b + 1].min())
            first, second = float(x[a]), float(x[b])
            if _apart(first, second) < 0.03 and between < min(first, second):
                alike, depth = 1 - _apart(first, second), (min(first, second) - between) / max(abs(first), 1e-12)
                out.append((symbol, name, ts[a], ts[b], mirror * between, mirror * (between - (min(first, second) - between)), float(np.clip(0.6 * alike + 0.4 * min(1, depth * 10), 0.1, 0.95))))
    recent = slice(max(0, len(bars) - 50), None)
    price = float(close[-1])
    for x, name in ((high[recent], "RESISTANCE"), (-low[recent], "SUPPORT")):
        at = peaks(x, 5)
        for level, touches, strength in levels(np.abs(x[at]) if name == "SUPPORT" else x[at], float(np.std(x[at])) if len(at) else 0.0):
            if price and abs(level - price) / abs(price) <= 0.05:
                out.append((symbol, name, ts[recent][0], ts[-1], level, level, min(0.95, 0.5 + 0.1 * (touches - 2) + 0.3 * strength)))
    if len(top) >= 2 and len(bottom) >= 2:
        up, down = top[-4:], bottom[-4:]
        hs, ls = np.polyfit(up, high[up], 1)[0], np.polyfit(down, low[down], 1)[0]
        kind = "ASCENDING_TRIANGLE" if abs(hs) < 0.001 and ls > 0.002 else "DESCENDING_TRIANGLE" if abs(ls) < 0.001 and hs < -0.002 else "SYMMETRIC_TRIANGLE" if hs < -0.002 and ls > 0.002 else None
        if kind:
            out.append((symbol, kind, ts[min(up[0], down[0])], ts[-1], price, price, 0.6))
    return out


def peak_patterns(bars: DataFrame, least: float = 0.6, most: int = 20) -> DataFrame:
    """(symbol, pattern, start, end, level, target, confidence): head and shoulders, double tops and bottoms, levels, triangles; of one kind and start day the surest, of a symbol the `most` surest.

    A symbol's bars go to one task, in time order: peaks with a prominence depend on the whole series.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(_peak_patterns(group["symbol"].iloc[0], group), columns=_COLUMNS)

    found = bars.select("symbol", "ts", "high", "low", "close").groupBy("symbol").applyInPandas(run, PATTERN).where(F.col("confidence") >= least)
    ranked = found.withColumn("_d", F.row_number().over(Window.partitionBy("symbol", "pattern", F.to_date("start")).orderBy(F.desc("confidence"), "start", "level"))).where("_d = 1")
    ranked = ranked.withColumn("_r", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("confidence"), "start", "pattern", "level")))
    return ranked.where(F.col("_r") <= most).drop("_d", "_r")
