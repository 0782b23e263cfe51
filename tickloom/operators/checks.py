"""Checks of single records: live quotes, trades and books, trading parameters, whole series of bars; and maps of what a selection leaves."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.text import valid_symbol
from tickloom.operators.quality import broken_order


def live_error(age_seconds: Column, most_age: float = 300) -> Column:
    """The first fault of a live record (kind, bid, ask, price, size, bids, asks), null without one.

    A quote needs a bid under its ask, a trade a price and size over 0, a book both sides, best bid under best ask, and prices and sizes over 0; all need a time no older than most_age. Other kinds are unknown.
    """
    c = F.col
    missing = F.when(c("kind") == "quote", c("bid").isNull() | c("ask").isNull()).when(c("kind") == "trade", c("price").isNull() | c("size").isNull()).otherwise(c("bids").isNull() | c("asks").isNull())
    best, ask = F.array_max(F.transform("bids", lambda x: x["price"])), F.array_min(F.transform("asks", lambda x: x["price"]))
    bad = lambda side: F.exists(side, lambda x: (x["price"] <= 0) | (x["size"] <= 0))
    none = F.lit(False)
    sizes = F.when(c("kind") == "quote", (c("bid") <= 0) | (c("ask") <= 0)).when(c("kind") == "trade", (c("price") <= 0) | (c("size") <= 0)).otherwise(bad("bids") | bad("asks"))
    crossed = F.when(c("kind") == "quote", c("bid") >= c("ask")).when(c("kind") == "orderbook", best >= ask)
    empty = (c("kind") == "orderbook") & ((F.size("bids") == 0) | (F.size("asks") == 0))
    return (
        F.when(~F.coalesce(c("kind").isin("quote", "trade", "orderbook"), none), "unknown_kind").when(missing, "missing").when(F.coalesce(empty, none), "empty_side").when(F.coalesce(sizes, none), "not_positive")
        .when(F.coalesce(crossed, none), "crossed").when(F.coalesce(age_seconds > most_age, F.lit(True)), "stale")
    )


def parameter_error(symbol: Column, quantity: Column, price: Column, most: float = 1e6) -> Column:
    """The first trading parameter that is out of bounds: a symbol of 1 to 10 letters in either case, a quantity and a price over 0 and at most a million; a null one is not given and passes, text that is no number does not."""
    out = lambda v: v.isNotNull() & F.coalesce((F.expr("try_cast(0 as double)") + v.try_cast("double") <= 0) | (v.try_cast("double") > most) | F.isnan(v.try_cast("double")), F.lit(True))
    return F.when(symbol.isNotNull() & ~valid_symbol(F.upper(symbol)), "symbol").when(out(quantity), "quantity").when(out(price), "price")


def whole_series(bars: DataFrame, by: str = "symbol") -> DataFrame:
    """(by, bars, broken, usable): a series counts as a whole: one bar out of order or with a negative volume makes it unusable. Null prices break nothing."""
    bad = broken_order() | F.coalesce(F.col("volume") < 0, F.lit(False))
    out = bars.groupBy(by).agg(F.count("*").alias("bars"), F.count_if(bad).alias("broken"))
    return out.withColumn("usable", F.col("broken") == 0)


def kept_categories(categories: DataFrame, selected: list[int]) -> DataFrame:
    """(category, indexes): where the features of each category (category, feature: a place) stand after only the selected places are kept, in their order; categories that keep none go."""
    new = {old: k for k, old in enumerate(selected)}
    place = reduce(lambda out, pair: F.when(F.col("feature") == pair[0], pair[1]).otherwise(out), new.items(), F.lit(None).cast("int"))
    return categories.withColumn("_new", place).where("_new is not null").groupBy("category").agg(F.array_sort(F.collect_list("_new")).alias("indexes"))


def compound(rets: DataFrame, by: str = "symbol") -> DataFrame:
    """(by, compound_return): the product of 1 + r, less 1; a return of -1 and under loses all."""
    lost = F.max((F.col("r") <= -1).cast("int")) == 1
    return rets.groupBy(by).agg(F.when(lost, -1.0).otherwise(F.exp(F.sum(F.when(F.col("r") > -1, F.log1p("r")))) - 1).alias("compound_return"))


def risk_summary(metrics: DataFrame, events: DataFrame, positions: DataFrame, by: str = "account", recent: int = 10, high: float = 0.7) -> DataFrame:
    """(by, ts, *metrics, risky_positions, recent_severe, level): the latest metrics (by, ts, value, volatility, drawdown) of each account, its positions with a risk score over `high`, and how many of its last `recent` events (by, ts, severity) were HIGH or CRITICAL."""
    latest = metrics.groupBy(by).agg(F.max_by(F.struct("ts", "value", "volatility", "drawdown"), "ts").alias("m")).select(by, "m.*")
    risky = positions.groupBy(by).agg(F.count_if(F.col("risk_score") > high).alias("risky_positions"))
    newest = F.slice(F.sort_array(F.collect_list(F.struct("ts", "severity")), asc=False), 1, recent)
    # of the events of a day and account only the last can be among the last of all
    daily = events.groupBy(by, F.to_date("ts").alias("_d")).agg(newest.alias("_e"))
    last = daily.groupBy(by).agg(F.slice(F.sort_array(F.flatten(F.collect_list("_e")), asc=False), 1, recent).alias("_e"))
    severe = last.select(by, F.size(F.filter("_e", lambda e: e["severity"].isin("HIGH", "CRITICAL"))).alias("recent_severe"))
    out = latest.join(risky, by, "left").join(severe, by, "left").fillna(0, ["risky_positions", "recent_severe"])
    level = F.when((F.col("recent_severe") >= 3) | (F.col("drawdown") > 0.2), "CRITICAL").when((F.col("risky_positions") >= 3) | (F.col("recent_severe") >= 1), "HIGH").when(F.col("volatility") > 0.3, "MEDIUM").otherwise("LOW")
    return out.withColumn("level", level)
