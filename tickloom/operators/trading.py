"""The trading cycle as one plan: mark positions, find exits, find entries, size them, admit what the cash allows. And the life of an order: checks, triggers, expiry, fills."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.strategies import RULE_CONFIDENCE, by_name, simple_rules, stop_loss
from tickloom.streaming import keyed

# Fee rates by asset type, and in which order exits are done.
FEES = {"crypto": 0.001, "forex": 0.0001, "commodity": 0.0005}
URGENCY = {"stop_loss": "high", "take_profit": "medium", "regime_change": "medium", "max_hold": "low", "large_loss": "high"}


def fee(asset_type: Column, value: Column) -> Column:
    return value * by_name(asset_type, FEES, 0.0)


def _seconds(later: Column, sooner: Column) -> Column:
    return F.unix_timestamp(later.cast("timestamp")) - F.unix_timestamp(sooner.cast("timestamp"))


def _days(later: Column, sooner: Column) -> Column:
    return _seconds(later, sooner) / 86400


def marked(positions: DataFrame, snaps: DataFrame) -> DataFrame:
    """Positions (account, symbol, side, quantity, entry, stop, target, opened, entry_regime) with the symbol's snapshot, market value, profit and profit in percent. One row a symbol meets many positions: an equi-join."""
    both = positions.join(snaps.select("symbol", "asset_type", F.col("ts").alias("now"), "price", "regime", "confidence"), "symbol")
    gain = F.when(F.col("side") == "LONG", F.col("price") - F.col("entry")).otherwise(F.col("entry") - F.col("price")) * F.col("quantity")
    return both.withColumns({"market_value": F.col("quantity") * F.col("price"), "pnl": gain, "pnl_pct": F.when(F.col("entry") > 0, gain / (F.col("entry") * F.col("quantity")) * 100)})


def exit_reason(sure: float = 80, days: float = 30, loss: float = -10) -> Column:
    """Stop, target, a sure change of regime, age, loss, in this order; null: hold."""
    long, price = F.col("side") == "LONG", F.col("price")
    return (
        F.when(F.when(long, price <= F.col("stop")).otherwise(price >= F.col("stop")), "stop_loss").when(F.when(long, price >= F.col("target")).otherwise(price <= F.col("target")), "take_profit")
        .when((F.col("entry_regime") != F.col("regime")) & (F.col("confidence") > sure), "regime_change").when(_days(F.col("now"), F.col("opened")) > days, "max_hold").when(F.col("pnl_pct") < loss, "large_loss")
    )


def closed(rows: DataFrame) -> DataFrame:
    """Marked positions that leave: fee, realised profit and percent after it, minutes held, what comes back in cash."""
    long, paid = F.col("side") == "LONG", fee(F.col("asset_type"), F.col("quantity") * F.col("entry"))
    out = rows.where("reason is not null").withColumns({"fee": paid, "urgency": by_name(F.col("reason"), URGENCY, None)})
    out = out.withColumns({"realized": F.col("pnl") - F.col("fee"), "minutes": F.floor(_seconds(F.col("now"), F.col("opened")) / 60)})
    return out.withColumns({"realized_pct": F.col("realized") / (F.col("entry") * F.col("quantity")) * 100, "back": F.when(long, F.col("price") * F.col("quantity")).otherwise(F.col("pnl")) - F.col("fee")})


def _admission() -> keyed.Machine:
    """An account's entries in turn: one is taken if what it needs is left."""

    def step(state: dict, row: tuple) -> list[tuple]:
        _, symbol, need, cash = row
        left = cash if state["left"] is None else state["left"]
        taken = need is not None and left is not None and need <= left
        state["left"] = left - need if taken else left
        return [(symbol, taken, state["left"])]

    return keyed.Machine(("symbol", "need", "cash"), "symbol string, taken boolean, cash_left double", lambda: {"left": None}, step, "account", "turn")


def admitted(wanted: DataFrame, cash: DataFrame) -> DataFrame:
    """Of entries (account, symbol, confidence, value, fee) those that the account's cash (account, cash) allows one after the other, surest first, then by symbol: `taken`, and the cash left after each.

    An account's entries are read once in order with the cash left at hand, however many they are; a symbol comes once.
    """
    turn = F.row_number().over(Window.partitionBy("account").orderBy(F.desc("confidence"), "symbol"))
    rows = wanted.join(cash.select("account", F.col("cash").cast("double").alias("cash")), "account") if "cash" not in wanted.columns else wanted
    rows = rows.withColumns({"turn": turn, "need": (F.col("value") + F.col("fee")).cast("double")})
    return wanted.drop("cash").join(keyed.run(rows.select("account", "turn", "symbol", "need", "cash"), _admission()), ["account", "symbol"])


def standing(snaps: DataFrame) -> DataFrame:
    """(symbol, ts, asset_type, price, regime, confidence, signal, signal_confidence, stop): a row a symbol, its latest snapshot and the surest signal that is no HOLD, of the last row at which any rule spoke, with its stop; null without one.

    One aggregate over the snapshots: a row's best signal is an expression.
    """
    rules = F.array(*[F.when(s.isNotNull(), F.struct((s != "HOLD").alias("acts"), (F.col("confidence") * RULE_CONFIDENCE.get(n, 1.0)).alias("sure"), F.lit(n).alias("rule"), s.alias("signal"))) for n, s in simple_rules().items()])
    best = F.array_max(F.filter(rules, lambda x: x.isNotNull()))
    rows = snaps.withColumn("_b", best)
    now = F.max_by(F.struct("ts", "asset_type", "price", "regime", "confidence"), "ts").alias("n")
    spoke = F.max_by(F.struct("_b", "asset_type", "price", "volatility"), F.when(F.col("_b").isNotNull(), F.col("ts"))).alias("s")
    out = rows.groupBy("symbol").agg(now, spoke)
    acts, signal = F.col("s._b.acts"), F.col("s._b.signal")
    stop = stop_loss(F.col("s.asset_type"), F.col("s.price"), signal.isin("BUY", "STRONG_BUY"), F.col("s.volatility"))
    return out.select("symbol", "n.*", F.when(acts, signal).alias("signal"), F.when(acts, F.col("s._b.sure")).alias("signal_confidence"), F.when(acts, stop).alias("stop"))


#: Signals that a cycle offers to each account, the surest: what is broadcast has so many rows at most.
MOST_OFFERED = 1000


def cycle(snaps: DataFrame, signals: DataFrame, positions: DataFrame, accounts: DataFrame, hold_days: float = 30, most: int = MOST_OFFERED) -> DataFrame:
    """(account, symbol, step, reason, urgency, side, quantity, price, pnl, fee, cash_left): what one cycle does with each position and each signal.

    snaps: the latest snapshot of each symbol. signals: the surest signal of a symbol (symbol, signal, confidence, stop, target). Exits come first
    and give their cash back; then symbols without a position are entered, 2 % of the account's value at risk and a tenth of it at most, as long as
    the cash lasts. An account is offered the `most` surest signals, the smaller symbol first on ties.
    """
    held = marked(positions, snaps).withColumn("reason", exit_reason(days=hold_days))
    gone, paid = F.col("reason").isNotNull(), fee(F.col("asset_type"), F.col("quantity") * F.col("entry"))
    back = F.when(gone, F.when(F.col("side") == "LONG", F.col("price") * F.col("quantity")).otherwise(F.col("pnl")) - paid)
    sums = held.groupBy("account").agg(F.sum("market_value").alias("_mv"), F.sum(back).alias("_back"))
    purse = accounts.join(sums, "account", "left").fillna(0.0, ["_back", "_mv"]).select("account", (F.col("cash") + F.col("_back")).cast("double").alias("cash"), (F.col("cash") + F.col("_mv")).alias("worth"))
    offered = signals.where(F.col("signal").isin("BUY", "STRONG_BUY", "SELL", "STRONG_SELL")).join(snaps.select("symbol", "asset_type", "price"), "symbol").orderBy(F.desc("confidence"), "symbol").limit(most)
    free = purse.join(F.broadcast(offered)).join(positions.select("account", "symbol"), ["account", "symbol"], "left_anti")  # at most `most` rows are sent
    loss = F.abs(F.col("price") - F.col("stop"))
    size = F.least(F.when(loss > 0, F.col("worth") * 0.02 / loss * F.col("price")).otherwise(F.col("worth") * 0.05) * F.least(F.col("confidence") / 100, F.lit(1.0)), F.col("worth") * 0.1)
    wanted = free.withColumn("value", F.round(size, 6)).where("value > 0").withColumn("fee", fee(F.col("asset_type"), F.col("value")))
    entered = admitted(wanted, purse)
    none = lambda t: F.lit(None).cast(t)
    old = held.select(
        "account", "symbol", F.when(gone, "exit").otherwise("hold").alias("step"), "reason", by_name(F.col("reason"), URGENCY, None).alias("urgency"), "side", "quantity", "price", F.when(gone, F.col("pnl") - paid).otherwise(F.col("pnl")).alias("pnl"),
        F.when(gone, paid).otherwise(0.0).alias("fee"), none("double").alias("cash_left"),
    )
    side = F.when(F.col("signal").isin("BUY", "STRONG_BUY"), "LONG").otherwise("SHORT")
    new = entered.select("account", "symbol", F.when(F.col("taken"), "enter").otherwise("skip"), F.col("signal"), none("string"), side, F.col("value") / F.col("price"), "price", F.lit(0.0), "fee", "cash_left")
    return old.union(new)


# Orders


def order_error(buying_power: float, most_value: float, most_daily: int) -> Column:
    """The first check that an order (quantity, side, order_type, price, market_price, position, ts, account, order_id) fails, null if none; the day's orders are counted in time order."""
    nth = F.row_number().over(Window.partitionBy("account", F.to_date("ts")).orderBy("ts", "order_id"))
    at = F.coalesce("price", "market_price", F.lit(100.0))
    return (
        F.when(F.col("quantity") <= 0, "quantity").when(~F.lower("side").isin("buy", "sell"), "side").when(~F.lower("order_type").isin("market", "limit", "stop", "stop_limit", "trailing_stop"), "order_type")
        .when((F.lower("order_type") == "limit") & (F.col("price") <= 0), "price").when(nth > most_daily, "daily_limit").when(F.col("quantity") * at > most_value, "value_limit")
        .when((F.lower("side") == "buy") & (F.col("quantity") * at > buying_power), "buying_power").when((F.lower("side") == "sell") & (F.coalesce("position", F.lit(0.0)) < F.col("quantity")), "position")
    )


def execution_price(price: Column, side: Column, quantity: Column, bps: float = 5.0, model: str = "fixed") -> Column:
    """The price after slippage against the order: fixed, or growing with the root of the size over 100."""
    slip = F.lit(bps) * (F.sqrt(quantity / 100) if model == "square_root" else 1.0) / 10000
    return F.when(F.lower(side) == "buy", price * (1 + slip)).otherwise(price * (1 - slip))


def market_open(ts: Column, asset_type: Column) -> Column:
    """Crypto always, others 9:30 to 16:00 from Monday to Friday."""
    minute = F.hour(ts) * 60 + F.minute(ts)
    return (asset_type == "crypto") | (~F.dayofweek(ts).isin(1, 7) & minute.between(570, 960))


def status(orders: DataFrame, now: Column) -> DataFrame:
    """Orders with `status`: REJECTED with an error, FILLED with a fill time, EXPIRED once expires_at has passed without one, CANCELLED where asked for and still open, else PENDING."""
    filled = F.col("filled_ts").isNotNull() & (F.col("expires_at").isNull() | (F.col("filled_ts") <= F.col("expires_at")))
    state = F.when(F.col("error").isNotNull(), "REJECTED").when(filled, "FILLED").when(F.col("expires_at") < now, "EXPIRED").when(F.col("cancel"), "CANCELLED").otherwise("PENDING")
    return orders.withColumn("status", state)


def first_bars(orders: DataFrame, bars: DataFrame) -> DataFrame:
    """(order_id, filled_ts, fill_price) of orders (order_id, symbol, ts, side, order_type, price, amount): the first bar at or after the order that reaches the price, no row if none does.

    A market order takes the first close, a limit order its own price. A stop order takes the close that passes its price; a trailing one that which
    falls by the amount from the highest high since the order (a buy: rises from the lowest low). A stop-limit order (with limit_price) becomes a limit order
    at the close that passes its price: it is filled at its limit by that close, or by the first bar after it that reaches the limit.

    A symbol's orders are dealt to SLOTS groups, and each group gets the symbol's bars, which come first. A task holds the bars of one group and one batch of its orders, however many they
    are. A tree of minima and maxima over the bars answers each order in logarithmic time; no order meets its symbol's bars one by one.
    """
    columns = {"ts": "timestamp_ntz", "order_id": "long", "side": "string", "order_type": "string", "price": "double", "amount": "double", "limit_price": "double", "high": "double", "low": "double", "close": "double"}
    cells = lambda rows: [(F.col(c) if c in rows.columns else F.lit(None)).cast(t).alias(c) for c, t in columns.items()]
    asked = orders.select("symbol", F.pmod(F.xxhash64("order_id"), F.lit(SLOTS)).cast("int").alias("_slot"), F.lit(1).alias("_kind"), *cells(orders.drop("high", "low", "close")))
    known = bars.where(F.col("ts").isNotNull()).select("symbol", F.explode(F.sequence(F.lit(0), F.lit(SLOTS - 1))).alias("_slot"), F.lit(0).alias("_kind"), *cells(bars.select("symbol", "ts", "high", "low", "close")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held, book = None, [], None
        for batch in batches:
            at, out = 0, []
            for group, same in groupby(zip(*(batch.column(c).to_pylist() for c in ("symbol", "_slot", "_kind")), strict=True)):
                part = batch.slice(at, sum(1 for _ in same))
                at += part.num_rows
                if group[:2] != last:
                    last, held, book = group[:2], [], None
                if group[2] == 0:
                    held.append([part.column(c).to_numpy(zero_copy_only=False) for c in ("ts", "low", "high", "close")])
                elif held:
                    book = book or _Book(*(np.concatenate(x) for x in zip(*held, strict=True)))
                    out.append(book.fills(part))
            if out:
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(x) for x in zip(*out, strict=True)], ["order_id", "filled_ts", "fill_price"])

    return asked.unionByName(known).repartition("symbol", "_slot").sortWithinPartitions("symbol", "_slot", "_kind", "ts").mapInArrow(run, "order_id long, filled_ts timestamp_ntz, fill_price double")


#: Groups to which a symbol's orders are dealt, each with the symbol's bars.
SLOTS = 16


class _Book:
    """A symbol's bars in time order, with trees of minima and maxima over them; bars without a price are passed over."""

    def __init__(self, ts: np.ndarray, low: np.ndarray, high: np.ndarray, close: np.ndarray):
        self.ts, self.low, self.high, self.close = ts, low.astype(float), high.astype(float), close.astype(float)
        self.trees = {}
        for name, values, pick in (("low", self.low, np.fmin), ("high", self.high, np.fmax), ("close_low", self.close, np.fmin), ("close_high", self.close, np.fmax)):
            levels = [values]
            while len(levels[-1]) > 1:
                last = levels[-1]
                half = last[: len(last) // 2 * 2].reshape(-1, 2)
                up = pick(half[:, 0], half[:, 1])
                levels.append(np.append(up, last[-1]) if len(last) % 2 else up)
            self.trees[name] = levels

    def first(self, name: str, start: int, fits: Callable[[float], bool]) -> int:
        """The first place from start on whose value fits, by climbing and descending a tree of minima or maxima."""
        levels, depth, at = self.trees[name], 0, start
        while depth < len(levels) and at < len(levels[depth]):
            if fits(levels[depth][at]):
                while depth:
                    depth, at = depth - 1, 2 * at
                    if not fits(levels[depth][at]):
                        at += 1
                return at
            at += 1
            while depth + 1 < len(levels) and at % 2 == 0 and at < len(levels[depth]):
                depth, at = depth + 1, at // 2
        return -1

    def trailing(self, start: int, buy: bool, amount: float) -> int:
        best = np.inf if buy else -np.inf
        for at in range(start, len(self.ts), 1024):
            part = slice(at, at + 1024)
            run = np.fmin(np.fmin.accumulate(self.low[part]), best) if buy else np.fmax(np.fmax.accumulate(self.high[part]), best)
            hit = self.close[part] >= run + amount if buy else self.close[part] <= run - amount
            if hit.any():
                return at + int(hit.argmax())
            best = run[-1]
        return -1

    def fill(self, buy: bool, kind: str | None, price: float, amount: float, limit: float, start: int) -> tuple[int, float | None]:
        """The place of the bar that fills an order placed before the bar at `start`, -1 if none does, and the price paid."""
        if kind == "market":
            return start, self.close[start]
        if kind == "limit":
            return self.first("low", start, lambda x: x <= price) if buy else self.first("high", start, lambda x: x >= price), price
        if kind == "trailing_stop":
            k = self.trailing(start, buy, amount)
        else:
            k = self.first("close_high", start, lambda x: x >= price) if buy else self.first("close_low", start, lambda x: x <= price)
        if kind != "stop_limit" or k < 0:
            return k, self.close[k]
        if not (self.close[k] <= limit if buy else self.close[k] >= limit):
            k = self.first("low", k + 1, lambda x: x <= limit) if buy else self.first("high", k + 1, lambda x: x >= limit)
        return k, limit

    def fills(self, orders: pa.RecordBatch) -> tuple[pa.Array, pa.Array, pa.Array]:
        """Ids, times and prices of the orders that are filled."""
        lower = lambda c: [x and x.lower() for x in orders.column(c).to_pylist()]
        number = lambda c: orders.column(c).to_numpy(zero_copy_only=False).astype(float)
        starts = np.searchsorted(self.ts, orders.column("ts").to_numpy(zero_copy_only=False), side="left")
        rows, places, prices = [], [], []
        for i, (side, kind, price, amount, limit, start) in enumerate(zip(lower("side"), lower("order_type"), number("price"), number("amount"), number("limit_price"), starts.tolist(), strict=True)):
            if start < len(self.ts):
                k, paid = self.fill(side == "buy", kind, price, amount, limit, start)
                if k >= 0:
                    rows.append(i)
                    places.append(k)
                    prices.append(paid)
        return orders.column("order_id").take(pa.array(rows, pa.int64())), pa.array(self.ts[np.array(places, dtype=int)], pa.timestamp("us")), pa.array(prices, pa.float64())


def running_book(fills: DataFrame) -> DataFrame:
    """Fills (account, symbol, ts, fill_id, side, quantity, price, commission) with cash flow, and cash and quantity after each."""
    flow = F.when(F.lower("side") == "buy", -F.col("quantity") * F.col("price")).otherwise(F.col("quantity") * F.col("price")) - F.col("commission")
    signed = F.when(F.lower("side") == "buy", F.col("quantity")).otherwise(-F.col("quantity"))
    out = fills.withColumns({"flow": flow, "_q": signed})
    order = Window.partitionBy("account").orderBy("ts", "fill_id").rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumns({"cash_change": F.sum("flow").over(order), "held": F.sum("_q").over(Window.partitionBy("account", "symbol").orderBy("ts", "fill_id").rowsBetween(Window.unboundedPreceding, 0))}).drop("_q")


def order_from_signal(signals: DataFrame) -> DataFrame:
    """A LIMIT order a signal: side by the signal, quantity by its value, 24 hours long."""
    side = F.when(F.col("signal").isin("BUY", "STRONG_BUY"), "BUY").when(F.col("signal").isin("SELL", "STRONG_SELL"), "SELL")
    return signals.where(side.isNotNull()).select("symbol", "ts", side.alias("side"), F.lit("LIMIT").alias("order_type"), (F.col("value") / F.col("price")).alias("quantity"), "price", "stop", "target", (F.col("ts") + F.expr("interval 24 hours")).alias("expires_at"))

