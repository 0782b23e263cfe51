"""Snapshots with indicators, regime and asset type at every bar: what strategies and features read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.windows import full, in_order, lag, last, mean

# The asset type of a symbol in the test tables.
ASSET_TYPES = {"click": "stock", "view": "crypto", "purchase": "forex", "signup": "commodity", "error": "etf"}


def asset_type(symbol: Column) -> Column:
    out = F.lit("stock")
    for name, kind in ASSET_TYPES.items():
        out = F.when(symbol == name, kind).otherwise(out)
    return out


def index_level(bars: DataFrame, base: float = 200.0, n: int = 10) -> DataFrame:
    """(symbol, ts, price, volume, sentiment): an index of a noisy series, `base` plus the mean of the last n closes; sentiment is where the bar closed between its low and high, -1 to 1, null for a flat bar."""
    place = F.when(F.col("high") > F.col("low"), (F.col("close") - F.col("open")) / (F.col("high") - F.col("low")))
    return bars.select("symbol", "ts", (base + F.avg("close").over(last(n))).alias("price"), (F.col("volume") * 10000).alias("volume"), place.alias("sentiment"))


def regime(price: Column, mean20: Column, mean50: Column, top: Column, bottom: Column, volatility: Column) -> Column:
    """BREAKOUT and BREAKDOWN beyond the last 20 prices' range, VOLATILE over 40 % a year, BULL and BEAR by the order of price and means, else SIDEWAYS; null before 20 prices."""
    return (
        F.when(top.isNull(), F.lit(None)).when(price > top * 1.01, "BREAKOUT").when(price < bottom * 0.99, "BREAKDOWN").when(volatility > 40, "VOLATILE")
        .when((price > mean20) & (mean20 > mean50), "BULL").when((price < mean20) & (mean20 < mean50), "BEAR").otherwise("SIDEWAYS")
    )


def enrich(rows: DataFrame) -> DataFrame:
    """rows (symbol, ts, price, volume, sentiment) with change_pct, momentum (10 rows), rsi (14, simple), macd (12- less 26-row mean), volatility (% a year), bands, volume ratio, asset type, regime and its confidence.

    One exchange and one sort by symbol serve all windows. Where there are too few rows a value is null.
    """
    price = F.col("price")
    out = rows.withColumns({"_before": lag("price"), "_back": lag("price", 10), "_lr": F.when((price > 0) & (lag("price") > 0), F.ln(price / lag("price")))})
    out = out.withColumns({"_d": price - F.col("_before")})
    gain, loss = full("_d", F.avg(F.greatest(F.col("_d"), F.lit(0.0))), 14), full("_d", F.avg(F.greatest(-F.col("_d"), F.lit(0.0))), 14)
    out = out.withColumns({
        "change_pct": F.when(F.col("_before") != 0, F.col("_d") / F.col("_before") * 100), "momentum": F.when(F.col("_back") != 0, price / F.col("_back") - 1), "_gain": gain, "_loss": loss,
        "macd": mean("price", 12) - mean("price", 26), "volatility": full("_lr", F.stddev_pop("_lr"), 20) * 252**0.5 * 100, "_m20": mean("price", 20), "_m50": mean("price", 50),
        "_s20": full("price", F.stddev_pop("price"), 20), "_top": F.max("price").over(in_order().rowsBetween(-20, -1)), "_low": F.min("price").over(in_order().rowsBetween(-20, -1)),
        "volume_ratio": F.col("volume") / F.nullif(F.avg("volume").over(in_order().rowsBetween(-20, -1)), F.lit(0.0)),
    })
    enough = F.col("_m20").isNotNull()
    away = F.when(F.col("_s20") > 0, F.abs(price - F.col("_m20")) / F.col("_s20")).otherwise(0.0)
    rsi = F.when(F.col("_loss") > 0, 100 - 100 / (1 + F.col("_gain") / F.col("_loss"))).when(F.col("_gain") > 0, 100.0).when(F.col("_loss") == 0, 50.0)
    out = out.withColumns({
        "rsi": rsi, "bb_upper": F.col("_m20") + 2 * F.col("_s20"), "bb_lower": F.col("_m20") - 2 * F.col("_s20"), "asset_type": asset_type(F.col("symbol")),
        "regime": regime(price, F.col("_m20"), F.coalesce("_m50", "_m20"), F.when(enough, F.col("_top")), F.col("_low"), F.col("volatility")), "confidence": F.when(enough, F.least(F.lit(95.0), 60 + 15 * away)),
    })
    return out.drop("_before", "_back", "_lr", "_d", "_gain", "_loss", "_m20", "_m50", "_s20", "_top", "_low")
