"""Ticks, bars, snapshots and ledgers from tables; sinks that keep the latest row of a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(events: DataFrame) -> DataFrame:
    """(symbol, ts, price, volume, event_id) of an event table; the volume is the JSON property k."""
    volume = F.from_json("props", "k double")["k"]
    return events.select(F.col("event_type").alias("symbol"), "ts", F.col("value").alias("price"), F.coalesce(volume, F.lit(0.0)).alias("volume"), "event_id")


def bars(rows: DataFrame, unit: str = "hour", by: str = "symbol") -> DataFrame:
    """OHLCV per symbol and time unit. Ties of time open and close by event_id; empty units have no row."""
    first, last = F.struct("ts", "event_id"), F.struct("ts", "event_id")
    return rows.groupBy(by, F.date_trunc(unit, F.col("ts").cast("timestamp")).cast("timestamp_ntz").alias("bar")).agg(
        F.min_by("price", first).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", last).alias("close"), F.sum("volume").alias("volume"),
    ).withColumnRenamed("bar", "ts")


def resample(rows: DataFrame, unit: str, by: str = "symbol") -> DataFrame:
    """Coarser bars from bars."""
    return rows.groupBy(by, F.date_trunc(unit, F.col("ts").cast("timestamp")).cast("timestamp_ntz").alias("bar")).agg(
        F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume"),
    ).withColumnRenamed("bar", "ts")


def downsample_old(rows: DataFrame, keep: int, unit: str) -> DataFrame:
    """The last `keep` bars of each symbol as they are, older ones resampled."""
    ranked = rows.withColumn("_rn", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("ts"))))
    columns = ["symbol", "ts", "open", "high", "low", "close", "volume"]
    return resample(ranked.where(F.col("_rn") > keep), unit).select(columns).unionByName(ranked.where(F.col("_rn") <= keep).select(columns))


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row a key: the first in the order."""
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old and new rows with one row a key, new before old: insert-or-replace as a table."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    return latest(both, keys, [F.desc("_new")]).drop("_new")


def first_source(sources: list[tuple[int, DataFrame]], keys: list[str]) -> DataFrame:
    """Of sources with priorities, each key's row from the one with the least priority that has it."""
    merged = None
    for priority, rows in sources:
        rows = rows.withColumn("source_priority", F.lit(priority))
        merged = rows if merged is None else merged.unionByName(rows, allowMissingColumns=True)
    return latest(merged, keys, [F.asc("source_priority")])


def valid_snapshots(rows: DataFrame, as_of: Column, hours: float = 1) -> DataFrame:
    """Rows with a symbol, a positive price and a time no older than so many hours before as_of; `suspect` marks changes over 50 %."""
    fresh = F.col("ts") >= as_of - F.make_dt_interval(hours=F.lit(int(hours)))
    return rows.where(F.col("symbol").isNotNull() & (F.col("price") > 0) & F.col("ts").isNotNull() & fresh).withColumn("suspect", F.abs("change_pct") > 50)


def snapshots(rows: DataFrame) -> DataFrame:
    """The latest bar of each symbol with its change from the bar before."""
    by = Window.partitionBy("symbol").orderBy("ts")
    before = F.lag("close").over(by)
    moved = rows.withColumns({"change": F.col("close") - before, "change_pct": F.when(before != 0, (F.col("close") - before) / before * 100)})
    return latest(moved, ["symbol"], [F.desc("ts")]).withColumnRenamed("close", "price")


def routes(sources: DataFrame, most: int = 10) -> DataFrame:
    """(asset_type, sources): of a table (asset_type, source, priority, enabled) the enabled sources of each type, the least priority first, then by name; at most `most`."""
    rank = F.row_number().over(Window.partitionBy("asset_type").orderBy("priority", "source"))
    best = sources.where("enabled").withColumn("_rn", rank).where(F.col("_rn") <= most)
    ordered = F.array_sort(F.collect_list(F.struct("_rn", "source")))
    return best.groupBy("asset_type").agg(ordered["source"].alias("sources"))


def routed(rows: DataFrame, sources: DataFrame, most: int = 10) -> DataFrame:
    """rows (asset_type) with the sources to ask, in order; an empty list for a type that has none. One row a type is joined."""
    none = F.array().cast("array<string>")
    return rows.join(routes(sources, most), "asset_type", "left").withColumn("sources", F.coalesce("sources", none))


def liquidity_score(volume: Column, cap: Column) -> Column:
    """min(1, 10 volume / cap); 0.1 without a cap, 0.3 where the volume is missing."""
    return F.when(volume.isNull(), 0.3).when(cap.isNull() | (cap <= 0), 0.1).otherwise(F.least(F.lit(1.0), 10 * volume / cap))


def order_book(quotes: DataFrame, depth: int) -> DataFrame:
    """(symbol, bids, asks): the best `depth` prices with sizes from quotes (symbol, side, price, size)."""
    bids = F.slice(F.sort_array(F.collect_list(F.when(F.col("side") == "bid", F.struct("price", "size"))), asc=False), 1, depth)
    asks = F.slice(F.sort_array(F.collect_list(F.when(F.col("side") == "ask", F.struct("price", "size")))), 1, depth)
    ranked = quotes.withColumn("_rn", F.row_number().over(Window.partitionBy("symbol", "side").orderBy(F.when(F.col("side") == "bid", -F.col("price")).otherwise(F.col("price")), "size")))
    return ranked.where(F.col("_rn") <= depth).groupBy("symbol").agg(bids.alias("bids"), asks.alias("asks"))


def book_measures(books: DataFrame) -> DataFrame:
    """Best prices, mid and spread in percent of the best bid; null on an empty side."""
    bid, ask = F.try_element_at("bids", F.lit(1))["price"], F.try_element_at("asks", F.lit(1))["price"]
    return books.select("symbol", bid.alias("best_bid"), ask.alias("best_ask"), ((bid + ask) / 2).alias("mid"), ((ask - bid) / bid * 100).alias("spread_pct"))


def parse_dates(text: Column, formats: tuple[str, ...]) -> Column:
    """The first format that fits; null if none does."""
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats])


def range_scan(rows: DataFrame, start: str, end: str, limit: int | None = None) -> DataFrame:
    """Bars from start to end inclusive, in time order, the first `limit` of each symbol; the bounds reach the scan."""
    found = rows.where(F.col("ts").between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")))
    if limit is None:
        return found
    return found.withColumn("_rn", F.row_number().over(Window.partitionBy("symbol").orderBy("ts"))).where(F.col("_rn") <= limit).drop("_rn")


def success_rates(log: DataFrame) -> DataFrame:
    """Calls, successes, failures and rate of each source from (source, success)."""
    ok = F.count_if(F.col("success"))
    return log.groupBy("source").agg(F.count("*").alias("total"), ok.alias("succeeded"), (F.count("*") - ok).alias("failed"), (ok / F.count("*")).alias("rate"))
