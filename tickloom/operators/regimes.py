"""Market regimes: window features and votes of rules; online clusters and drift as keyed state."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.sequential import pack
from tickloom.functions.windows import full, in_order, islands, lag, last

#: Shares of the detectors' votes.
VOTES = {"statistical": 0.30, "technical": 0.25, "volatility": 0.20, "trend": 0.15}


def features(bars: DataFrame) -> DataFrame:
    """bars with momentum over 5, 20 and 60 bars, volatility a year and its deviation, slope and fit of 14 bars, runs of highs and lows, volume trend."""
    close = F.col("close")
    back = lambda k: F.when(lag("close", k) > 0, close / lag("close", k) - 1)
    out = bars.withColumns({"_i": F.row_number().over(in_order()).cast("double"), "_lr": F.when((close > 0) & (lag("close") > 0), F.log(close / lag("close"))), "_up": (close > lag("close")).cast("int"), "_down": (close < lag("close")).cast("int")})
    out = out.withColumns({
        "momentum_5": back(5), "momentum_20": back(20), "momentum_60": back(60), "volatility": full("_lr", F.stddev_pop("_lr"), 20) * 252**0.5, "mean_return": full("_lr", F.avg("_lr"), 20),
        "slope": full("close", F.regr_slope("close", "_i"), 14) / F.first("close").over(last(14)), "fit": full("close", F.regr_r2("close", "_i"), 14),
        "_hh": (F.col("_up") == 1) & (lag("_up") == 1), "_ll": (F.col("_down") == 1) & (lag("_down") == 1),
    })
    return out.withColumns({
        "vol_of_vol": full("volatility", F.stddev_pop("volatility"), 10), "higher_highs": F.count_if(F.coalesce("_hh", F.lit(False))).over(last(18)), "lower_lows": F.count_if(F.coalesce("_ll", F.lit(False))).over(last(18)),
        "volume_trend": F.avg("volume").over(last(5)) / F.nullif(F.avg("volume").over(in_order().rowsBetween(-19, -5)), F.lit(0.0)) - 1,
    }).drop("_lr", "_up", "_down", "_hh", "_ll")


def statistical(f: DataFrame) -> Column:
    return F.when(F.col("volatility") > 0.30, "VOLATILE").when((F.col("mean_return") > 0.001) & (F.col("higher_highs") >= F.col("lower_lows")), "BULL").when((F.col("mean_return") < -0.001) & (F.col("lower_lows") >= F.col("higher_highs")), "BEAR").otherwise("SIDEWAYS")


def technical(f: DataFrame) -> Column:
    return F.when((F.col("fit") > 0.5) & (F.col("momentum_20") > 0.05), "BULL").when((F.col("fit") > 0.5) & (F.col("momentum_20") < -0.05), "BEAR").otherwise("SIDEWAYS")


def technical_vote(adx: Column, rsi: Column, macd_signal: Column, bb_position: Column, momentum: Column) -> dict[str, Column]:
    """Regime and confidence by strength of trend: over 25 by RSI and MACD, under 20 by the place in the bands (0 to 1), between by momentum of 5 %."""
    strong, flat = adx > 25, adx < 20
    up, down = (rsi > 60) & (macd_signal > 0), (rsi < 40) & (macd_signal < 0)
    regime = (
        F.when(strong, F.when(up, "BULL").when(down, "BEAR").otherwise("VOLATILE")).when(flat, F.when(bb_position > 0.8, "DISTRIBUTION").when(bb_position < 0.2, "ACCUMULATION").otherwise("SIDEWAYS"))
        .when(adx.isNotNull(), F.when(momentum > 0.05, "BULL").when(momentum < -0.05, "BEAR").otherwise("SIDEWAYS"))
    )
    lean = F.when(F.abs(rsi - 50) / 50 * 0.8 > 0.9, 0.9).otherwise(F.abs(rsi - 50) / 50 * 0.8)
    sure = F.when(strong, F.when(up | down, lean).otherwise(0.7)).when(flat, F.when((bb_position > 0.8) | (bb_position < 0.2), 0.6).otherwise(0.7)).when(adx.isNotNull(), 0.6)
    return {"technical_regime": regime, "technical_confidence": sure}


def volatility_band(volatility: Column) -> Column:
    """LOW under 0.10, NORMAL under 0.20, HIGH under 0.40, else EXTREME."""
    return F.when(volatility < 0.10, "LOW").when(volatility < 0.20, "NORMAL").when(volatility < 0.40, "HIGH").when(volatility.isNotNull(), "EXTREME")


def trend(f: DataFrame) -> Column:
    return F.when(F.col("slope") > 0.02, "BULL").when(F.col("slope") < -0.02, "BEAR").otherwise("SIDEWAYS")


def ensemble(bars: DataFrame) -> DataFrame:
    """bars with `regime`, `regime_confidence` and `regime_second`: shares of the votes by regime; the first name on ties; the second if over 0.7 of the first.

    Votes are summed in the row: no shuffle beyond the window's.
    """
    f = features(bars)
    by_vol = F.when(F.col("volatility") >= 0.40, "VOLATILE").otherwise("SIDEWAYS")
    votes = {"statistical": statistical(f), "technical": technical(f), "volatility": by_vol, "trend": trend(f)}
    total, names = sum(VOTES.values()), ("BEAR", "BULL", "SIDEWAYS", "VOLATILE")
    f = f.withColumns({f"_{k}": v for k, v in votes.items()})
    weight = lambda name: sum((F.when(F.col(f"_{k}") == name, w).otherwise(0.0) for k, w in VOTES.items()), F.lit(0.0)) / total
    ranked = F.array_sort(F.array(*[F.struct((-weight(n)).alias("w"), F.lit(n).alias("name")) for n in names]))
    f = f.withColumn("_r", ranked)
    first, second = F.col("_r")[0], F.col("_r")[1]
    f = f.withColumns({"regime": first["name"], "regime_confidence": -first["w"], "regime_second": F.when(-second["w"] > -0.7 * first["w"], second["name"])})
    return f.drop("_r", "_i", *[f"_{k}" for k in votes])


def votes(rows: DataFrame) -> DataFrame:
    """Rows of features with adx, rsi_14, macd_hist and bb_position to four votes, (regime, confidence) each: statistical, technical, volatility, trend."""
    c, cap = F.col, lambda x: F.least(F.lit(0.9), x)
    strength, up, down = F.abs("slope"), c("slope") > 0.001, c("slope") < -0.001
    rising, falling = F.coalesce((c("mean_return") > 0.001) & up, F.lit(False)), F.coalesce((c("mean_return") < -0.001) & down, F.lit(False))
    wild, steep = c("volatility") > 0.30, strength > 0.01
    quiet = F.when((c("higher_highs") > 0) & (c("lower_lows") == 0), "ACCUMULATION").when((c("lower_lows") > 0) & (c("higher_highs") == 0), "DISTRIBUTION").otherwise("SIDEWAYS")
    first = F.when(wild, "VOLATILE").when(rising, F.when(steep, "BREAKOUT").otherwise("BULL")).when(falling, F.when(steep, "BREAKDOWN").otherwise("BEAR")).otherwise(quiet)
    first_sure = F.when(wild, cap(c("volatility") / 0.30 * 0.7)).when(rising | falling, F.when(steep, cap(strength * 50)).otherwise(0.7)).otherwise(0.6)
    second = technical_vote(F.coalesce("adx", F.lit(25.0)), F.coalesce("rsi_14", F.lit(50.0)), F.coalesce("macd_hist", F.lit(0.0)), F.coalesce("bb_position", F.lit(0.5)), F.coalesce("momentum_20", F.lit(0.0)))
    band = volatility_band(c("volatility"))
    third = F.when(band.isin("EXTREME", "HIGH"), "VOLATILE").when((band == "LOW") & (c("momentum_60") > 0), "ACCUMULATION").otherwise("SIDEWAYS")
    third_sure = F.when(band == "EXTREME", 0.9).when(band == "HIGH", 0.7).when(band == "LOW", 0.6).otherwise(0.4)
    even = cap(F.coalesce("fit", F.lit(0.0)) * 0.8 + 0.3)
    far = strength > 0.02
    fourth = F.when(up, F.when(far, "BREAKOUT").otherwise("BULL")).when(down, F.when(far, "BREAKDOWN").otherwise("BEAR")).otherwise("SIDEWAYS")
    fourth_sure = even * F.when(up | down, F.when(far, 1.0).otherwise(0.8)).otherwise(0.6)
    named = {"statistical": (first, first_sure), "technical": (second["technical_regime"], second["technical_confidence"]), "volatility": (third, third_sure), "trend": (fourth, fourth_sure)}
    return rows.withColumns({f"{k}_vote": F.struct(a.alias("regime"), b.alias("confidence")) for k, (a, b) in named.items()})


REGIMES = ("ACCUMULATION", "BEAR", "BREAKDOWN", "BREAKOUT", "BULL", "DISTRIBUTION", "SIDEWAYS", "VOLATILE")


def decision(bars: DataFrame) -> DataFrame:
    """(symbol, ts, regime, regime_confidence, regime_second, strength): votes weighted by method and confidence, over all methods' weights; the first name on ties, the second if over 0.7 of the first.

    bars (symbol, ts, high, low, close, volume). The indicators that are recurrences come from one grouped pass; votes are conditional sums in the row. Null until 20 returns are there.
    """
    packed = pack(bars).select("symbol", "ts", "high", "low", "close", "volume", "adx", "rsi_14", "macd_hist")
    mid, dev = full("close", F.avg("close"), 5), full("close", F.stddev_pop("close"), 5)
    f = votes(features(packed).withColumns({"_mid": mid, "_dev": dev}).withColumn("bb_position", F.when(F.col("_dev") > 0, (F.col("close") - F.col("_mid") + 2 * F.col("_dev")) / (4 * F.col("_dev"))).when(F.col("_dev") == 0, 0.5)))
    weight = lambda name: sum((F.when(F.col(f"{k}_vote.regime") == name, w * F.col(f"{k}_vote.confidence")).otherwise(0.0) for k, w in VOTES.items()), F.lit(0.0)) / sum(VOTES.values())
    ranked = f.withColumn("_r", F.array_sort(F.array(*[F.struct((-F.round(weight(n), 9)).alias("w"), F.lit(n).alias("name")) for n in REGIMES])))
    first, second, known = F.col("_r")[0], F.col("_r")[1], F.col("volatility").isNotNull()
    sure = F.when(known, -first["w"])
    grade = F.when(sure > 0.85, "VERY_STRONG").when(sure > 0.75, "STRONG").when(sure > 0.65, "MODERATE").when(known, "WEAK")
    return ranked.select("symbol", "ts", F.when(known, first["name"]).alias("regime"), sure.alias("regime_confidence"), F.when(known & (-second["w"] > -0.7 * first["w"]), second["name"]).alias("regime_second"), grade.alias("strength"))


def trend_strength(bars: DataFrame) -> DataFrame:
    """(symbol, ts, trend_strength): the mean of twice the ADX, of 100 where price and means of 20 and 50 are in order and else 50, and of five times the move of 19 rows in percent, each at most 100; null before 50 rows."""
    c = F.col
    rows = pack(bars).select("symbol", "ts", "close", "adx")
    rows = rows.withColumns({"_n": F.row_number().over(in_order()), "_m20": full("close", F.avg("close"), 20), "_m50": full("close", F.avg("close"), 50), "_back": lag("close", 19)})
    lined = ((c("close") > c("_m20")) & (c("_m20") > c("_m50"))) | ((c("close") < c("_m20")) & (c("_m20") < c("_m50")))
    at_most = lambda x: F.when(x > 100, 100.0).otherwise(x)
    parts = (at_most(2 * c("adx")) + F.when(lined, 100.0).otherwise(50.0) + at_most(F.abs(c("close") / F.nullif(c("_back"), F.lit(0.0)) - 1) * 500)) / 3
    return rows.select("symbol", "ts", F.when(c("_n") >= 50, parts).alias("trend_strength"))


def persistence(rows: DataFrame, regime: str = "regime") -> DataFrame:
    """rows with how long the regime has lasted, changes in the last 20 rows, and the share of the last 10 that equal it."""
    out = islands(rows, regime).withColumnRenamed("run_length", "regime_duration").drop("island")
    changed = (~F.col(regime).eqNullSafe(lag(regime)) & lag(regime).isNotNull()).cast("int")
    out = out.withColumn("_c", changed).withColumns({"transitions": F.sum("_c").over(last(20)), "_l": F.collect_list(regime).over(last(10))})
    return out.withColumn("regime_share", F.size(F.filter("_l", lambda x: x == F.col(regime))) / F.size("_l")).drop("_c", "_l")


def consolidations(bars: DataFrame, n: int = 5, window: int = 30) -> DataFrame:
    """(symbol, consolidations): runs, in each symbol's last `window` bars, where the deviation of n closes is under half its median."""
    rows = bars.withColumn("_rn", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("ts")))).where(F.col("_rn") <= window)
    rows = rows.withColumn("_sd", full("close", F.stddev_pop("close"), n)).where("_sd is not null")
    rows = rows.withColumn("_flat", F.col("_sd") < 0.5 * F.median("_sd").over(Window.partitionBy("symbol")))
    starts = F.col("_flat") & ~F.coalesce(lag("_flat"), F.lit(False))
    return rows.withColumn("_s", starts).groupBy("symbol").agg(F.count_if("_s").alias("consolidations"))


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms).otherwise(0.0)


def euclidean(a: Column, b: Column) -> Column:
    squares = F.zip_with(a, b, lambda p, q: F.pow(p.cast("double") - q.cast("double"), F.lit(2)))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, v: s + v))


#: Rows of a centroid table that may be sent to every task.
MOST_CENTROIDS = 1000


def nearest_centroid(vectors: DataFrame, centroids: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, centroid, similarity): the most similar of (centroid, centre), the smaller name on ties.

    Centroids are one array literal of a table of checked size, so that every row is compared where it lies.
    """
    known = centroids.limit(MOST_CENTROIDS + 1).collect()
    if len(known) > MOST_CENTROIDS:
        raise ValueError(f"more than {MOST_CENTROIDS} centroids")
    pairs = F.array(*[F.struct((-cosine(F.col(vector), F.array(*[F.lit(float(x)) for x in c["centre"]]))).alias("s"), F.lit(c["centroid"]).alias("c")) for c in known])
    best = F.array_min(pairs)
    return vectors.select(key, best["c"].alias("centroid"), (-best["s"]).alias("similarity"))


def _cosine(x: np.ndarray, c: np.ndarray) -> float:
    norms = np.linalg.norm(x) * np.linalg.norm(c)
    return float(x @ c / norms) if norms else 0.0


#: How like a vector and a centre are: by direction, or by distance, falling off exponentially or as one over it.
LIKENESS = {"cosine": _cosine, "exponential": lambda x, c: float(np.exp(-np.linalg.norm(x - c))), "inverse": lambda x, c: float(1 / (1 + np.linalg.norm(x - c)))}


def online_clusters(rows: np.ndarray, threshold: float = 0.75, rate: float = 0.14, most: int = 12, likeness: str = "cosine") -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Cluster and confidence of each vector in order, and the last centroids.

    A vector joins the most similar cluster if the likeness is over the threshold, and draws its centre by `rate`. Else it starts one, up to
    `most`; beyond, it joins the nearest at 0.7 of the confidence, which is min(1, 1.2 times the likeness).
    """
    centres: list[np.ndarray] = []
    names, sure = np.empty(len(rows), np.int64), np.empty(len(rows))
    for i, x in enumerate(rows):
        near = [LIKENESS[likeness](x, c) for c in centres]
        k = int(np.argmax(near)) if near else -1
        if k >= 0 and near[k] > threshold:
            centres[k] = (1 - rate) * centres[k] + rate * x
            names[i], sure[i] = k, min(1.0, 1.2 * near[k])
        elif len(centres) < most:
            centres.append(x.astype(float))
            names[i], sure[i] = len(centres) - 1, 0.8
        else:
            names[i], sure[i] = k, 0.7 * min(1.0, 1.2 * max(near[k], 0.0))
    return names, sure, centres


def cluster_series(rows: DataFrame, columns: list[str], by: str = "symbol", order: str = "ts", **kw) -> DataFrame:
    """(by, order, cluster, confidence): online clusters of each key's vectors, z-scored over the key. A key's rows, in order, go to one task: the state needs them so."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(order, kind="stable")
        x = np.nan_to_num(group[columns].to_numpy(dtype=float))
        spread = x.std(axis=0)
        x = np.clip((x - x.mean(axis=0)) / np.where(spread > 0, spread, 1), -3, 3)
        names, sure, _ = online_clusters(x, **kw)
        return pd.DataFrame({by: group[by], order: group[order], "cluster": names, "confidence": sure})

    kinds = dict(rows.dtypes)
    return rows.select(by, order, *columns).groupBy(by).applyInPandas(run, f"{by} {kinds[by]}, {order} {kinds[order]}, cluster long, confidence double")


def ks_statistic(a: np.ndarray, b: np.ndarray) -> tuple[float, float]:
    """Two-sample Kolmogorov-Smirnov distance and its asymptotic p-value."""
    if not len(a) or not len(b):
        return 0.0, 1.0
    both = np.sort(np.concatenate([a, b]))
    gap = np.abs(np.searchsorted(np.sort(a), both, side="right") / len(a) - np.searchsorted(np.sort(b), both, side="right") / len(b)).max()
    root = np.sqrt(len(a) * len(b) / (len(a) + len(b)))
    scaled = (root + 0.12 + 0.11 / root) * gap
    k = np.arange(1, 101)
    p = 2 * np.sum((-1.0) ** (k - 1) * np.exp(-2 * k * k * scaled * scaled)) if scaled > 0.2 else 1.0
    return float(gap), float(np.clip(p, 0, 1))


def drift(rows: DataFrame, columns: list[str], n: int = 100, limit: float = 0.9, by: str = "symbol", order: str = "ts") -> DataFrame:
    """(by, window, score, drifted): each full window of n rows against the reference, the first one; score: largest 1 - p over columns; a drift makes the window the reference."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        x = group.sort_values(order, kind="stable")[columns].to_numpy(dtype=float)
        held, out = x[:n], []
        for at in range(n, len(x) - n + 1, n):
            now = x[at : at + n]
            score = max(1 - ks_statistic(held[:, c][~np.isnan(held[:, c])], now[:, c][~np.isnan(now[:, c])])[1] for c in range(len(columns)))
            out.append((group[by].iloc[0], at // n, score, score > limit))
            if score > limit:
                held = now
        return pd.DataFrame(out, columns=[by, "window", "score", "drifted"])

    kind = dict(rows.dtypes)[by]
    return rows.select(by, order, *columns).groupBy(by).applyInPandas(run, f"{by} {kind}, window long, score double, drifted boolean")
