"""Validation and cleaning of bars: one aggregate a symbol for the checks, windows for the repairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.windows import in_order
from tickloom.streaming.snapshots import written

PRICES = ("open", "high", "low", "close")


def broken_order() -> Column:
    """A bar whose high or low does not enclose the others; null prices break nothing."""
    c = F.col
    rules = [c("high") < c("low"), c("high") < c("open"), c("high") < c("close"), c("low") > c("open"), c("low") > c("close")]
    return F.coalesce(rules[0], F.lit(False)) | F.coalesce(rules[1], F.lit(False)) | F.coalesce(rules[2], F.lit(False)) | F.coalesce(rules[3], F.lit(False)) | F.coalesce(rules[4], F.lit(False))


def with_group(bars: DataFrame, by: str, *aggregates: Column) -> DataFrame:
    """bars with aggregates over all rows of each key: partial sums and a join of one row a key, so that no key's rows meet in one task."""
    return bars.join(bars.groupBy(by).agg(*aggregates), by, "left")


def measures(bars: DataFrame, by: str = "symbol") -> DataFrame:
    """Counts for all rules, lags over one window, the rest aggregates: rows, nulls, ranges, order of prices, gaps over 10 %, zero volume, volume spikes over 10 times the mean, duplicates, median step and steps over 3 of it."""
    window = in_order(by)
    rows = bars.withColumns({"_before": F.lag("close").over(window), "_step": (F.unix_timestamp(F.col("ts").cast("timestamp")) - F.unix_timestamp(F.lag("ts").over(window).cast("timestamp"))).cast("double")})
    rows = with_group(rows, by, F.avg("volume").alias("_mean"), F.median(F.when(F.col("_step") > 0, F.col("_step"))).alias("_median"))
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    any_price = lambda f: count(f("open") | f("high") | f("low") | f("close"))
    return rows.groupBy(by).agg(
        F.count("*").alias("rows"), sum((F.count_if(F.col(c).isNull()) for c in (*PRICES[1:], "volume")), F.count_if(F.col("open").isNull())).alias("nulls"),
        any_price(lambda c: F.coalesce(F.col(c) <= 0, F.lit(False))).alias("not_positive"), any_price(lambda c: F.coalesce(F.col(c) > 1e6, F.lit(False))).alias("too_high"), count(F.col("volume") < 0).alias("negative_volume"),
        count(F.col("volume") == 0).alias("zero_volume"), count(broken_order()).alias("broken_order"), count(F.abs(F.col("close") / F.nullif(F.col("_before"), F.lit(0.0)) - 1) > 0.10).alias("gaps"),
        count(F.col("volume") > 10 * F.col("_mean")).alias("volume_spikes"), count(F.col("_step") == 0).alias("duplicates"), F.max("_median").alias("median_step"), count(F.col("_step") > 3 * F.col("_median")).alias("time_gaps"),
    )


def frequency(seconds: Column) -> Column:
    return F.when(seconds <= 90, "1m").when(seconds <= 450, "5m").when(seconds <= 1800, "15m").when(seconds <= 43200, "1h").otherwise("1d")


def issues(found: DataFrame, by: str = "symbol") -> DataFrame:
    """A row for each rule that a symbol breaks: (by, rule, severity, affected)."""
    n, c = F.col("rows"), F.col
    share = lambda x: x / n
    rule = lambda cond, name, severity, affected: F.when(cond, F.struct(F.lit(name).alias("rule"), severity.alias("severity"), affected.cast("long").alias("affected")))
    lit = F.lit
    every = F.array(
        rule(share(c("nulls")) > 0.05, "nulls", F.when(c("nulls") / (5 * n) > 0.05, "ERROR").otherwise("WARNING"), c("nulls")), rule(c("not_positive") > 0, "not_positive", lit("CRITICAL"), c("not_positive")), rule(c("too_high") > 0, "too_high", lit("WARNING"), c("too_high")),
        rule(c("negative_volume") > 0, "negative_volume", lit("ERROR"), c("negative_volume")), rule(share(c("zero_volume")) > 0.10, "zero_volume", lit("WARNING"), c("zero_volume")), rule(c("broken_order") > 0, "broken_order", lit("ERROR"), c("broken_order")),
        rule(c("gaps") > 0, "gaps", lit("INFO"), c("gaps")), rule(share(c("volume_spikes")) > 0.05, "volume_spikes", lit("WARNING"), c("volume_spikes")), rule(c("duplicates") > 0, "duplicates", lit("ERROR"), c("duplicates")), rule(c("time_gaps") > 0, "time_gaps", lit("WARNING"), c("time_gaps")),
    )
    return found.select(by, F.explode(F.filter(every, lambda x: x.isNotNull())).alias("i")).select(by, "i.*")


def quality_score(found: DataFrame, by: str = "symbol") -> DataFrame:
    """100 less 25, 10, 3 and 1 for each critical, error, warning and info issue, less twice the missing percent over 5; and its level."""
    counts = issues(found, by).groupBy(by).agg(*[F.count_if(F.col("severity") == s).alias(s.lower()) for s in ("CRITICAL", "ERROR", "WARNING", "INFO")])
    both = found.select(by, (F.col("nulls") / (5 * F.col("rows")) * 100).alias("missing_pct")).join(counts, by, "left").fillna(0, ["critical", "error", "warning", "info"])
    score = 100 - 25 * F.col("critical") - 10 * F.col("error") - 3 * F.col("warning") - F.col("info") - 2 * F.greatest(F.col("missing_pct") - 5, F.lit(0.0))
    both = both.withColumn("score", F.greatest(score, F.lit(0.0)))
    level = F.when(F.col("score") >= 95, "EXCELLENT").when(F.col("score") >= 85, "GOOD").when(F.col("score") >= 70, "FAIR").when(F.col("score") >= 50, "POOR").otherwise("UNUSABLE")
    return both.withColumn("level", level)


def remove_outliers(bars: DataFrame, by: str = "symbol", most: float = 3.0) -> DataFrame:
    """Rows with no price further than `most` population deviations from the symbol's mean; a null price is no outlier."""
    out = with_group(bars, by, *[f(c).alias(f"_{n}_{c}") for c in PRICES for n, f in (("mean", F.avg), ("sd", F.stddev_pop))])
    far = [F.coalesce((F.col(f"_sd_{c}") > 0) & (F.abs(F.col(c) - F.col(f"_mean_{c}")) / F.col(f"_sd_{c}") > most), F.lit(False)) for c in PRICES]
    return out.where(~(far[0] | far[1] | far[2] | far[3])).select(*bars.columns)


def interpolate(bars: DataFrame, columns: tuple[str, ...] = PRICES, most: int = 3, by: str = "symbol") -> DataFrame:
    """Nulls between values on a straight line by position, at most `most` in a row; after the last value, it is carried on as far."""
    out = bars.withColumn("_i", F.row_number().over(in_order(by)))
    back = in_order(by).rowsBetween(Window.unboundedPreceding, 0)
    ahead = in_order(by).rowsBetween(0, Window.unboundedFollowing)
    for c in columns:
        known = F.when(F.col(c).isNotNull(), F.struct(F.col("_i").alias("i"), F.col(c).alias("v")))
        a, b = F.last(known, ignorenulls=True).over(back), F.first(known, ignorenulls=True).over(ahead)
        out = out.withColumns({"_a": a, "_b": b})
        line = F.col("_a.v") + (F.col("_b.v") - F.col("_a.v")) * (F.col("_i") - F.col("_a.i")) / (F.col("_b.i") - F.col("_a.i"))
        filled = F.when(F.col("_i") - F.col("_a.i") <= most, F.coalesce(line, F.col("_a.v")))
        out = out.withColumn(c, F.coalesce(F.col(c), filled)).drop("_a", "_b")
    return out.drop("_i")


def correct(bars: DataFrame) -> DataFrame:
    """Prices that are not positive to null, negative volume to 0 (null stays null), high and low stretched over all prices that there are."""
    out = bars.withColumns({c: F.when(F.col(c) > 0, F.col(c)) for c in PRICES})
    return out.withColumns({"high": F.greatest(*PRICES), "low": F.least(*PRICES), "volume": F.when(F.col("volume") < 0, 0.0).otherwise(F.col("volume"))})


def clean(bars: DataFrame) -> DataFrame:
    return correct(interpolate(remove_outliers(bars)))


def exact_percentiles(rows: DataFrame, column: str, shares: dict[str, float], by: str = "symbol") -> DataFrame:
    """(by, *names): percentiles of a column for each key, interpolated between neighbours, by the places of the values in a sort that may spill; no buffer holds a key's values. Nulls are not counted."""
    some = rows.where(F.col(column).isNotNull()).select(by, F.col(column).cast("double").alias("_v"))
    placed = some.withColumn("_at", F.row_number().over(Window.partitionBy(by).orderBy("_v"))).join(some.groupBy(by).agg(F.count("*").alias("_n")), by)
    out = []
    for name, share in shares.items():
        place = share * (F.col("_n") - 1) + 1
        part = place - F.floor(place)
        out.append(F.sum(F.when(F.col("_at") == F.floor(place), F.col("_v") * (1 - part)).when(F.col("_at") == F.floor(place) + 1, F.col("_v") * part)).alias(name))
    return placed.groupBy(by).agg(*out)


def drop_extremes(bars: DataFrame, by: str = "symbol") -> DataFrame:
    """Rows without a null or broken bar, then, price by price, those within half the 1st and twice the 99th percentile of what is left.

    The rows are written once, and after them a row a key with the bounds of each price in turn, so that nothing is worked out again for the next price. Rows without a key go.
    """
    kept = written(bars.dropna(subset=[by, *PRICES, "volume"]).where(~broken_order() & (F.col("volume") >= 0)), "bars")
    out = kept
    for c in PRICES:
        bounds = written(exact_percentiles(out, c, {f"_lo_{c}": 0.01, f"_hi_{c}": 0.99}, by), "bounds")
        out = out.join(bounds, by).where((F.col(c) <= 2 * F.col(f"_hi_{c}")) & (F.col(c) >= 0.5 * F.col(f"_lo_{c}"))).drop(f"_lo_{c}", f"_hi_{c}")
    return out.select(*bars.columns)


def valid_quotes(quotes: DataFrame, as_of: Column, seconds: int = 300) -> DataFrame:
    """Quotes with flags: missing (a required field is null), crossed (ask not over bid), stale (older than so many seconds)."""
    missing = F.col("symbol").isNull() | F.col("bid").isNull() | F.col("ask").isNull() | F.col("ts").isNull()
    age = F.unix_timestamp(as_of.cast("timestamp")) - F.unix_timestamp(F.col("ts").cast("timestamp"))
    return quotes.withColumns({"missing": missing, "crossed": F.coalesce(F.col("ask") <= F.col("bid"), F.lit(False)), "stale": F.coalesce(age > seconds, F.lit(False))})
