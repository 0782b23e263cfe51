"""Structured Streaming: ticks to bars with a watermark, JSON messages apart by kind, items newer than what was seen, alerts, and keyed state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

MESSAGE = "stream string, symbol string, price double, volume double, trade_ts timestamp"


def messages(raw: DataFrame, value: str = "value", received: Column | None = None) -> DataFrame:
    """JSON text to rows: tickers carry the time of receipt, trades their own. Text that is no such message goes."""
    rows = raw.select(F.from_json(F.col(value).cast("string"), MESSAGE).alias("m"), (F.current_timestamp() if received is None else received).alias("_at")).select("m.*", "_at")
    ts = F.when(F.col("stream").like("%trade%"), F.col("trade_ts")).otherwise(F.col("_at"))
    return rows.where(F.col("symbol").isNotNull()).select(F.when(F.col("stream").like("%trade%"), "trade").otherwise("ticker").alias("kind"), "symbol", ts.alias("ts"), "price", "volume")


def bars(ticks: DataFrame, width: str = "1 hour", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """OHLCV per symbol and event-time window; ticks later than `late` are dropped once their window is out. Works on a table too."""
    at = F.window("ts", width, slide) if slide else F.window("ts", width)
    rows = ticks.withWatermark("ts", late) if ticks.isStreaming else ticks
    out = rows.groupBy("symbol", at.alias("w")).agg(F.min_by("price", "ts").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "ts").alias("close"), F.sum("volume").alias("volume"))
    return out.select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")


def sessions(ticks: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Runs of ticks of a symbol with no gap longer than `gap`."""
    rows = ticks.withWatermark("ts", late) if ticks.isStreaming else ticks
    out = rows.groupBy("symbol", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("ticks"), F.sum("volume").alias("volume"))
    return out.select("symbol", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "ticks", "volume")


def unseen(items: DataFrame, key: str, ts: str = "ts", late: str = "1 day") -> DataFrame:
    """Each key once within the watermark."""
    return items.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def monitor(items: DataFrame, key: str, path: str, checkpoint: str, late: str = "1 day", ts: str = "ts", every: str | None = None) -> StreamingQuery:
    """Append each item once to the Parquet folder `path`: items whose key came before within `late` of event time are left out, over restarts too, as are items that come later than that.

    every: seconds or minutes between looks; without it, what is there is taken and the query ends.
    """
    writer = unseen(items, key, ts, late).writeStream.outputMode("append").option("checkpointLocation", checkpoint).format("parquet").option("path", path)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def alerts(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """(symbol, ts, rule_id, kind, price, limit): rows that a rule (rule_id, symbol, kind, limit) of their symbol fires on, bounds excluded.

    An equi-join on the symbol with a table of rules, which may be large.
    """
    hit = F.when(F.col("kind") == "price_above", F.col("price") > F.col("limit")).when(F.col("kind") == "price_below", F.col("price") < F.col("limit")).when(F.col("kind") == "change_percent_above", F.abs("change_pct") > F.col("limit"))
    return rows.join(rules, "symbol").where(hit).select("symbol", "ts", "rule_id", "kind", "price", "limit")


def rate_limited(events: DataFrame, key: str, width: str, limit: int, late: str = "1 minute") -> DataFrame:
    """(key, start, requests) of fixed windows with at least `limit` events."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(key, F.window("ts", width).alias("w")).agg(F.count("*").alias("requests")).where(F.col("requests") >= limit).select(key, F.col("w.start").alias("start"), "requests")


def position_step(state: tuple[float, float, float], side: str, quantity: float, price: float) -> tuple[float, float, float]:
    """(quantity, mean cost, realised profit) after a fill: buys average in, sells realise against the mean cost; a sale beyond the holding turns it short at the price."""
    held, cost, gained = state
    signed = quantity if side == "BUY" else -quantity
    if held == 0 or held * signed > 0:
        total = held + signed
        return total, (abs(held) * cost + abs(signed) * price) / abs(total) if total else 0.0, gained
    closed = min(abs(held), abs(signed))
    gained += closed * (price - cost) * (1 if held > 0 else -1)
    total = held + signed
    return total, price if held * total < 0 else cost if total else 0.0, gained


POSITION = "symbol string, ts timestamp, quantity double, mean_cost double, realised double"


def _fold(rows: pd.DataFrame, symbol: str, state: tuple[float, float, float]) -> tuple[pd.DataFrame, tuple[float, float, float]]:
    out = []
    for ts, side, quantity, price in rows.sort_values(["ts", "fill_id"], kind="stable")[["ts", "side", "quantity", "price"]].itertuples(index=False):
        state = position_step(state, side, float(quantity), float(price))
        out.append((symbol, ts, *state))
    return pd.DataFrame(out, columns=["symbol", "ts", "quantity", "mean_cost", "realised"]), state


def _fold_sorted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Fills in order of symbol and time, batch by batch: what is held is one symbol's state, however many fills it has."""
    symbol, state = None, (0.0, 0.0, 0.0)
    for batch in batches:
        out = []
        for name, ts, side, quantity, price in batch[["symbol", "ts", "side", "quantity", "price"]].itertuples(index=False):
            if name != symbol:
                symbol, state = name, (0.0, 0.0, 0.0)
            state = position_step(state, side, float(quantity), float(price))
            out.append((name, ts, *state))
        yield pd.DataFrame(out, columns=["symbol", "ts", "quantity", "mean_cost", "realised"])


def positions(fills: DataFrame) -> DataFrame:
    """The position after each fill (fill_id, symbol, ts, side, quantity, price): state by symbol on a stream, one ordered pass on a table."""
    if not fills.isStreaming:
        return fills.repartition("symbol").sortWithinPartitions("symbol", "ts", "fill_id").mapInPandas(_fold_sorted, POSITION)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = tuple(state.get) if state.exists else (0.0, 0.0, 0.0)
        rows = pd.concat(list(batches))
        out, now = _fold(rows, key[0], now)
        state.update(now)
        yield out

    return fills.groupBy("symbol").applyInPandasWithState(step, POSITION, "quantity double, mean_cost double, realised double", "append", GroupStateTimeout.NoTimeout)


def start(rows: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None, mode: str = "append") -> StreamingQuery:
    """Hand each batch to a function: at `every` so many seconds, or over what is there and then stop."""
    writer = rows.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(handle)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
