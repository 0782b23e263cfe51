"""Ten candle patterns whose notions of long, short, near and far are averages of the bars before, not fixed ratios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.windows import before, lag

# Rows of the average and factor of each notion; the average runs over the rows before, of none over the bar itself.
BODY_LONG, BODY_SHORT, BODY_DOJI = (10, 1.0), (10, 1.0), (10, 0.1)
SHADOW_LONG, SHADOW_VERY_SHORT, NEAR = (0, 1.0), (10, 0.1), (5, 0.2)
PENETRATION = 0.3
SENSITIVITY = 0.8


def _average(column: str, rule: tuple[int, float]) -> Column:
    n, factor = rule
    return factor * (F.when(F.count(column).over(before(n)) == n, F.avg(column).over(before(n))) if n else F.col(column))


def measures(bars: DataFrame) -> DataFrame:
    """bars with body, span, shadows, colour (1 where the close is not under the open, else -1), ends of the body, and what is long, short, a doji's, very short and near at each bar; null until the rows before are there."""
    o, h, low, c = (F.col(x) for x in ("open", "high", "low", "close"))
    top, bottom = F.when(c >= o, c).when(c < o, o), F.when(c >= o, o).when(c < o, c)  # null where either is
    out = bars.withColumns({"body": F.abs(c - o), "span": h - low, "upper": h - top, "lower": bottom - low, "colour": F.when(c >= o, 1).when(c < o, -1), "top": top, "bottom": bottom})
    return out.withColumns({"long": _average("body", BODY_LONG), "short": _average("body", BODY_SHORT), "doji": _average("span", BODY_DOJI), "long_shadow": _average("body", SHADOW_LONG), "no_shadow": _average("span", SHADOW_VERY_SHORT), "near": _average("span", NEAR)})


def candles(bars: DataFrame) -> DataFrame:
    """(symbol, ts, pattern, strength): strength is 100 for a rise and -100 for a fall, 80 where bodies only touch. All windows share one partitioning and order.

    doji, dragonfly and gravestone doji count as rises. Bars with nulls have no pattern, nor have those before the averages are full.
    """
    names = ("open", "close", "high", "low", "body", "colour", "top", "bottom", "long", "short", "near")
    rows = measures(bars)
    rows = rows.withColumns({f"{n}_1": lag(n) for n in names} | {f"{n}_2": lag(n, 2) for n in ("close", "body", "colour", "top", "bottom", "long")})
    c = F.col
    small, low_tail, high_tail = c("body") < c("short"), c("lower") > c("long_shadow"), c("upper") > c("long_shadow")
    bare_top, bare_foot = c("upper") < c("no_shadow"), c("lower") < c("no_shadow")
    rise, fall = c("colour") == 1, c("colour") == -1
    over = (c("colour") != c("colour_1")) & (c("top") >= c("top_1")) & (c("bottom") <= c("bottom_1")) & ((c("top") > c("top_1")) | (c("bottom") < c("bottom_1")))
    within = (c("body_1") > c("long_1")) & (c("body") <= c("short")) & (c("top") <= c("top_1")) & (c("bottom") >= c("bottom_1"))
    star = (c("body_2") > c("long_2")) & (c("body_1") <= c("short_1")) & (c("body") > c("short"))
    deep = PENETRATION * c("body_2")
    touch = lambda a, b: F.when(a & b, 100).otherwise(80)
    found = {
        "doji": F.when(c("body") <= c("doji"), 100),
        "hammer": F.when(small & low_tail & bare_top & (c("bottom") <= c("low_1") + c("near_1")), 100),
        "hanging_man": F.when(small & low_tail & bare_top & (c("bottom") >= c("high_1") - c("near_1")), -100),
        "shooting_star": F.when(small & high_tail & bare_foot & (c("bottom") > c("top_1")), -100),
        "engulfing": F.when(over, c("colour") * touch(c("open") != c("close_1"), c("close") != c("open_1"))),
        "morning_star": F.when(star & (c("colour_2") == -1) & (c("top_1") < c("bottom_2")) & rise & (c("close") > c("close_2") + deep), 100),
        "evening_star": F.when(star & (c("colour_2") == 1) & (c("bottom_1") > c("top_2")) & fall & (c("close") < c("close_2") - deep), -100),
        "harami": F.when(within, -c("colour_1") * touch(c("top") < c("top_1"), c("bottom") > c("bottom_1"))),
        "dragonfly_doji": F.when((c("body") <= c("doji")) & bare_top & (c("lower") > c("no_shadow")), 100),
        "gravestone_doji": F.when((c("body") <= c("doji")) & bare_foot & (c("upper") > c("no_shadow")), 100),
    }
    every = F.array(*[F.when(v.isNotNull(), F.struct(F.lit(k).alias("pattern"), v.cast("int").alias("strength"))) for k, v in found.items()])
    return rows.select("symbol", "ts", F.explode(F.filter(every, lambda x: x.isNotNull())).alias("e")).select("symbol", "ts", "e.*")


def recent_signals(bars: DataFrame, most: int = 5, sensitivity: float = SENSITIVITY) -> DataFrame:
    """(symbol, ts, pattern, signal, confidence) of the last `most` hits of each pattern and symbol, those on a symbol's last bar left out: BUY and SELL at full strength, else WEAK_BUY and WEAK_SELL; confidence is the strength's share times the sensitivity, at most 0.95."""
    last = bars.groupBy("symbol").agg(F.max("ts").alias("_last"))
    hits = candles(bars).withColumn("_rn", F.row_number().over(Window.partitionBy("symbol", "pattern").orderBy(F.desc("ts")))).where(F.col("_rn") <= most)
    s = F.col("strength")
    signal = F.concat(F.when(F.abs(s) >= 100, "").otherwise("WEAK_"), F.when(s > 0, "BUY").otherwise("SELL"))
    return hits.join(last, "symbol").where(F.col("ts") < F.col("_last")).select("symbol", "ts", "pattern", signal.alias("signal"), F.least(F.lit(0.95), F.abs(s) / 100 * sensitivity).alias("confidence"))
