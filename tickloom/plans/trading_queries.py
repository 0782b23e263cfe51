"""The trading cycle and orders, each with its SQL. Accounts, positions and orders are made of all events: a user's account is one of 25."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators import risk, signals, trading
from tickloom.operators import strategies as st
from tickloom.plans.base import BARS_SQL, Registry, bars, r, rounded
from tickloom.plans.snapshot_sql import SNAPS_SQL, snaps
from tickloom.plans.strategy_queries import SPOKEN_SQL, STOP
from tickloom.sources.market import latest, table
from tickloom.streaming.snapshots import written

ACCOUNTS, LOT = 25, 200.0
POSITIONS_SQL = f"""po0 as (select user_id % {ACCOUNTS} as account, event_type as symbol, sum(case when event_id % 2 = 0 then 1 else -1 end * coalesce((props->>'$.k')::double, 0.0)) as net, 200 + avg(value) as entry, arg_max(ts, (value, event_id)) as opened from events group by all),
    positions as (select account, symbol, case when net > 0 then 'LONG' else 'SHORT' end as side, abs(net) as quantity, entry, entry * case when net > 0 then 0.96 else 1.04 end as stop, entry * case when net > 0 then 1.04 else 0.96 end as target, opened,
        case when account % 3 = 0 then 'BULL' else 'SIDEWAYS' end as entry_regime from po0 where abs(net) >= {LOT}),
    accounts as (select distinct user_id % {ACCOUNTS} as account, (4000 + (user_id % {ACCOUNTS}) * 1500)::double as cash from events)"""
FEE = "case asset_type when 'crypto' then 0.001 when 'forex' then 0.0001 when 'commodity' then 0.0005 else 0.0 end"
CYCLE_SQL = f"""{SNAPS_SQL}, {POSITIONS_SQL}, {SPOKEN_SQL}, now as (select * from snaps qualify row_number() over (partition by symbol order by ts desc) = 1),
    sure as (select symbol, signal, confidence, price * case when signal in ('BUY', 'STRONG_BUY') then 1 - {STOP} else 1 + {STOP} end as stop from spoken where ts = (select max(ts) from spoken s2 where s2.symbol = spoken.symbol) and signal <> 'HOLD' qualify row_number() over (partition by symbol order by confidence desc, rule desc) = 1),
    h0 as (select p.*, asset_type, now.ts as now, price, regime, confidence, case when side = 'LONG' then price - entry else entry - price end * quantity as pnl from positions p join now using (symbol)), h1 as (select *, quantity * price as mv, pnl / (entry * quantity) * 100 as pnl_pct from h0),
    held as (select *, case when (side = 'LONG' and price <= stop) or (side = 'SHORT' and price >= stop) then 'stop_loss' when (side = 'LONG' and price >= target) or (side = 'SHORT' and price <= target) then 'take_profit'
        when entry_regime <> regime and confidence > 80 then 'regime_change' when (epoch(now) - floor(epoch(opened))) / 86400 > 20 then 'max_hold' when pnl_pct < -10 then 'large_loss' end as reason from h1),
    gone as (select *, quantity * entry * {FEE} as fee, pnl - quantity * entry * {FEE} as realized, case when side = 'LONG' then price * quantity else pnl end - quantity * entry * {FEE} as back, floor((epoch(now) - floor(epoch(opened))) / 60)::bigint as minutes from held where reason is not null),
    purse as (select a.account, a.cash + coalesce(b.back, 0) as cash, a.cash + coalesce(v.mv, 0) as worth from accounts a left join (select account, sum(back) as back from gone group by account) b using (account) left join (select account, sum(mv) as mv from held group by account) v using (account)),
    w0 as (select account, worth, cash, sure.symbol, sure.signal, sure.confidence, sure.stop, asset_type, price from purse cross join sure join now using (symbol) where not exists (select 1 from positions p where p.account = purse.account and p.symbol = sure.symbol)),
    w1 as (select *, round(least(case when abs(price - stop) > 0 then worth * 0.02 / abs(price - stop) * price else worth * 0.05 end * least(confidence / 100, 1.0), worth * 0.1), 6) as value from w0),
    w2 as (select *, value * {FEE} as fee, row_number() over (partition by account order by confidence desc, symbol) as n from w1 where value > 0),
    fold as (select account, symbol, n, value + fee <= cash as taken, case when value + fee <= cash then cash - (value + fee) else cash end as cash_left from w2 where n = 1
        union all select w.account, w.symbol, w.n, w.value + w.fee <= f.cash_left, case when w.value + w.fee <= f.cash_left then f.cash_left - (w.value + w.fee) else f.cash_left end from w2 w join fold f on w.account = f.account and w.n = f.n + 1)"""


def positions(spark, d):
    k = F.coalesce(F.from_json("props", "k double")["k"], F.lit(0.0))
    e = table(spark, d, "events")
    one = e.groupBy((F.col("user_id") % ACCOUNTS).alias("account"), F.col("event_type").alias("symbol")).agg(F.sum(F.when(F.col("event_id") % 2 == 0, k).otherwise(-k)).alias("_net"), (200 + F.avg("value")).alias("entry"), F.max_by("ts", F.struct("value", "event_id")).alias("opened"))
    long = F.col("_net") > 0
    return one.where(F.abs("_net") >= LOT).select(
        "account", "symbol", F.when(long, "LONG").otherwise("SHORT").alias("side"), F.abs("_net").alias("quantity"), "entry", (F.col("entry") * F.when(long, 0.96).otherwise(1.04)).alias("stop"), (F.col("entry") * F.when(long, 1.04).otherwise(0.96)).alias("target"),
        "opened", F.when(F.col("account") % 3 == 0, "BULL").otherwise("SIDEWAYS").alias("entry_regime"),
    )


def accounts(spark, d):
    a = F.col("user_id") % ACCOUNTS
    return table(spark, d, "events").select(a.alias("account"), (4000 + a * 1500).cast("double").alias("cash")).distinct()


def cycle(spark, d):
    """Hourly bars, indicators, regimes; marks, exits, entries, sizes and cash: the flagship. What every symbol stands at, a row each, and the positions are written once and read where they are needed."""
    now, held = written(trading.standing(snaps(spark, d)), "standing"), written(positions(spark, d), "positions")
    sure = now.select("symbol", "signal", F.col("signal_confidence").alias("confidence"), "stop")
    return rounded(trading.cycle(now.drop("signal", "signal_confidence", "stop"), sure, held, accounts(spark, d), hold_days=20))


ORDERS_SQL = """orders_ as (select event_id as order_id, event_type as symbol, ts, user_id % 25 as account, case when event_id % 2 = 0 then 'BUY' else 'SELL' end as side, ['MARKET', 'LIMIT', 'STOP', 'TRAILING_STOP'][event_id % 4 + 1] as order_type,
        case when event_id % 4 in (1, 2) then value end as price, 20.0 + value as amount, coalesce((props->>'$.k')::double, 0.0) - 3 as quantity, ts + interval 12 hours as expires_at, event_id % 10 = 0 as cancel from events)"""


def orders(spark, d):
    k = F.coalesce(F.from_json("props", "k double")["k"], F.lit(0.0))
    i, kinds = F.col("event_id"), F.array(*[F.lit(x) for x in ("MARKET", "LIMIT", "STOP", "TRAILING_STOP")])
    return table(spark, d, "events").select(
        i.alias("order_id"), F.col("event_type").alias("symbol"), "ts", (F.col("user_id") % 25).alias("account"), F.when(i % 2 == 0, "BUY").otherwise("SELL").alias("side"), F.element_at(kinds, (i % 4 + 1).cast("int")).alias("order_type"),
        F.when((i % 4).isin(1, 2), F.col("value")).alias("price"), (20.0 + F.col("value")).alias("amount"), (k - 3).alias("quantity"), (F.col("ts") + F.expr("interval 12 hours")).alias("expires_at"), (i % 10 == 0).alias("cancel"),
    )


CHECK = dict(buying_power=3000.0, most_value=8000.0, most_daily=12)
CHECKED_SQL = f"""{ORDERS_SQL}, k0 as (select *, row_number() over (partition by account, ts::date order by ts, order_id) as nth, quantity * coalesce(price, 100.0) as worth, (order_id % 80)::double as position from orders_),
    checked as (select *, case when quantity <= 0 then 'quantity' when order_type = 'LIMIT' and price <= 0 then 'price' when nth > 12 then 'daily_limit' when worth > 8000 then 'value_limit' when side = 'BUY' and worth > 3000 then 'buying_power' when side = 'SELL' and position < quantity then 'position' end as error from k0)"""
FILLS_SQL = """j as (select o.*, b.ts as bts, b.high, b.low, b.close, min(b.low) over w as lo, max(b.high) over w as hi from orders_ o join bars b on b.symbol = o.symbol and b.ts >= o.ts window w as (partition by o.order_id order by b.ts rows unbounded preceding)),
    hits as (select *, case order_type when 'LIMIT' then price else close end as paid from j where case order_type when 'MARKET' then true when 'LIMIT' then case when side = 'BUY' then low <= price else high >= price end
        when 'STOP' then case when side = 'BUY' then close >= price else close <= price end else case when side = 'BUY' then close >= lo + amount else close <= hi - amount end end),
    filled as (select order_id, min(bts) as filled_ts, arg_min(paid, bts) as fill_price from hits group by order_id)"""


def checked(spark, d):
    rows = orders(spark, d).withColumns({"market_price": F.lit(None).cast("double"), "position": (F.col("order_id") % 80).cast("double")})
    return rows.withColumn("error", trading.order_error(**CHECK))


def states(spark, d):
    full = checked(spark, d).join(trading.first_bars(orders(spark, d), bars(spark, d)), "order_id", "left")
    return trading.status(full, F.lit("2024-01-30 12:00:00").cast("timestamp_ntz"))


def register(reg: Registry) -> None:
    cols = "account, symbol, step, reason, urgency, side"
    urgency = "case reason when 'stop_loss' then 'high' when 'take_profit' then 'medium' when 'regime_change' then 'medium' when 'max_hold' then 'low' when 'large_loss' then 'high' end"
    reg.add("trading_cycle", cycle, f"""with recursive {CYCLE_SQL}, u as (select account, symbol, 'exit' as step, reason, {urgency} as urgency, side, quantity, price, realized as pnl, fee, null::double as cash_left from gone
            union all select account, symbol, 'hold', null, null, side, quantity, price, pnl, 0.0, null from held where reason is null
            union all select w2.account, w2.symbol, case when taken then 'enter' else 'skip' end, signal, null, case when signal in ('BUY', 'STRONG_BUY') then 'LONG' else 'SHORT' end, value / price, price, 0.0, fee, cash_left from w2 join fold using (account, symbol))
        select {cols}, {', '.join(r(f'({c})::double', c) for c in ('quantity', 'price', 'pnl', 'fee', 'cash_left'))} from u""")

    def closing(spark, d):
        s = latest(snaps(spark, d), ["symbol"], [F.desc("ts")])
        held = trading.marked(positions(spark, d), s)
        done = trading.closed(held.withColumn("reason", trading.exit_reason(days=20)))
        order = F.when(F.col("urgency") == "high", 0).when(F.col("urgency") == "medium", 1).otherwise(2)
        return rounded(done.select("account", "symbol", "reason", order.alias("turn"), "realized", "realized_pct", "minutes"))

    reg.add("trading_closed", closing, f"with {CYCLE_SQL.split(', purse as')[0]} select account, symbol, reason, case when reason in ('stop_loss', 'large_loss') then 0 when reason = 'max_hold' then 2 else 1 end as turn, {r('realized', 'realized')}, {r('realized / (entry * quantity) * 100', 'realized_pct')}, minutes from gone")
    reg.add("order_checks", lambda spark, d: checked(spark, d).select("order_id", "account", "error"), f"with {CHECKED_SQL} select order_id, account, error from checked")
    reg.add("order_fills", lambda spark, d: rounded(trading.first_bars(orders(spark, d), bars(spark, d))), f"with {BARS_SQL}, {ORDERS_SQL}, {FILLS_SQL} select order_id, filled_ts, {r('fill_price', 'fill_price')} from filled")
    def stop_limits(spark, d):
        buys = F.col("side") == "BUY"
        o = orders(spark, d).withColumns({"order_type": F.lit("STOP_LIMIT"), "price": F.col("amount") - 20, "limit_price": F.col("amount") - 20 + F.when(buys, -1).otherwise(1) * (F.col("order_id") % 7 - 3)})
        return rounded(trading.first_bars(o, bars(spark, d)))

    reg.add("order_stop_limits", stop_limits, f"""with {BARS_SQL}, {ORDERS_SQL}, o as (select order_id, symbol, ts, side = 'BUY' as buys, amount - 20 as stop, amount - 20 + case when side = 'BUY' then -1 else 1 end * (order_id % 7 - 3) as lim from orders_),
        hit as (select o.*, (select min(b.ts) from bars b where b.symbol = o.symbol and b.ts >= o.ts and case when buys then b.close >= stop else b.close <= stop end) as hit_ts from o),
        trig as (select hit.*, b.close as c from hit join bars b on b.symbol = hit.symbol and b.ts = hit_ts),
        f as (select order_id, lim, case when case when buys then c <= lim else c >= lim end then hit_ts else (select min(b.ts) from bars b where b.symbol = trig.symbol and b.ts > hit_ts and case when buys then b.low <= lim else b.high >= lim end) end as filled_ts from trig)
        select order_id, filled_ts, {r('lim', 'fill_price')} from f where filled_ts is not null""")
    state = "case when error is not null then 'REJECTED' when filled_ts is not null and filled_ts <= expires_at then 'FILLED' when expires_at < timestamp '2024-01-30 12:00:00' then 'EXPIRED' when cancel then 'CANCELLED' else 'PENDING' end"
    reg.add("order_status", lambda spark, d: states(spark, d).groupBy("order_type", "status").agg(F.count("*").alias("orders")), f"with {BARS_SQL}, {CHECKED_SQL}, {FILLS_SQL} select order_type, {state} as status, count(*) as orders from checked left join filled using (order_id) group by all")
    reg.add("order_open", lambda spark, d: states(spark, d).where("status = 'PENDING'").select("order_id", "symbol", "order_type"), f"with {BARS_SQL}, {CHECKED_SQL}, {FILLS_SQL} select order_id, symbol, order_type from checked left join filled using (order_id) where {state} = 'PENDING'")
    reg.add("order_history", lambda spark, d: states(spark, d).where("status <> 'PENDING'").orderBy(F.desc("ts"), "order_id").limit(100).select("order_id", "symbol", "status", "ts"), f"with {BARS_SQL}, {CHECKED_SQL}, {FILLS_SQL} select order_id, symbol, {state} as status, ts from checked left join filled using (order_id) where {state} <> 'PENDING' order by ts desc, order_id limit 100")
    reg.add(
        "order_prices",
        lambda spark, d: rounded(orders(spark, d).where("quantity > 0").select("order_id", trading.execution_price(F.col("amount"), F.col("side"), F.col("quantity")).alias("fixed"), trading.execution_price(F.col("amount"), F.col("side"), F.col("quantity"), model="square_root").alias("by_size"), trading.market_open(F.col("ts"), F.when(F.col("symbol") == "view", "crypto").otherwise("stock")).alias("open"), signals.commission(F.col("quantity") * F.col("amount")).alias("commission")), 10),
        f"with {ORDERS_SQL} select order_id, {r("amount * case when side = 'BUY' then 1 + 5.0 / 10000 else 1 - 5.0 / 10000 end", 'fixed', 10)}, {r("amount * case when side = 'BUY' then 1 + 5.0 * sqrt(quantity / 100) / 10000 else 1 - 5.0 * sqrt(quantity / 100) / 10000 end", 'by_size', 10)}, symbol = 'view' or (isodow(ts) < 6 and hour(ts) * 60 + minute(ts) between 570 and 960) as open, {r('case when quantity * amount <= 1000 then 1.0 when quantity * amount <= 10000 then quantity * amount * 0.005 else quantity * amount * 0.001 end', 'commission', 10)} from orders_ where quantity > 0",
    )

    def book(spark, d):
        o = orders(spark, d).where("quantity > 0").select("account", "symbol", "ts", F.col("order_id").alias("fill_id"), "side", "quantity", F.col("amount").alias("price"), F.lit(1.0).alias("commission"))
        return rounded(trading.running_book(o).select("fill_id", "flow", "cash_change", "held"), 4)

    reg.add("order_book_keeping", book, f"""with {ORDERS_SQL}, f as (select *, case when side = 'BUY' then -1 else 1 end * quantity * amount - 1.0 as flow, case when side = 'BUY' then quantity else -quantity end as q from orders_ where quantity > 0)
        select order_id as fill_id, {r('flow', 'flow', 4)}, {r('sum(flow) over (partition by account order by ts, order_id rows unbounded preceding)', 'cash_change', 4)}, {r('sum(q) over (partition by account, symbol order by ts, order_id rows unbounded preceding)', 'held', 4)} from f""")

    def made(spark, d):
        s = snaps(spark, d)
        one = st.rule_signals(s).withColumns({"value": F.col("confidence") * 100, "stop": F.col("price") * 0.95, "target": F.col("price") * 1.1})
        return rounded(trading.order_from_signal(one).groupBy("symbol", "side", "order_type").agg(F.count("*").alias("orders"), F.sum("quantity").alias("quantity"), F.max("expires_at").alias("last_expiry")))

    reg.add("order_from_signal", made, f"with {SNAPS_SQL}, {SPOKEN_SQL} select symbol, case when signal in ('BUY', 'STRONG_BUY') then 'BUY' else 'SELL' end as side, 'LIMIT' as order_type, count(*) as orders, {r('sum(confidence * 100 / price)', 'quantity')}, max(ts + interval 24 hours) as last_expiry from spoken where signal <> 'HOLD' group by all")

    def sizes(spark, d):
        s, c = snaps(spark, d), F.col
        sell = F.when(F.hour("ts") % 2 == 0, "BUY").otherwise("SELL")
        stop = risk.stop_loss(c("price"), c("asset_type"), c("volatility"), sell)
        out = s.withColumns({"stop": stop, "kelly": F.abs("sentiment") / 4, "loss": c("volatility") / 1000})
        known = out.where("confidence is not null")
        return rounded(known.select(
            "symbol", "ts", "stop", risk.take_profit(c("price"), c("stop")).alias("target"), risk.position_size(F.lit(100000.0), c("price"), c("stop"), c("confidence")).alias("shares"), signals.engine_size(F.lit(100000.0), c("kelly"), c("volatility"), c("loss")).alias("engine"),
            risk.position_risk_score(c("confidence") / 1000, c("rsi") / 40, c("volatility"), c("confidence") / 100).alias("risk_score"), risk.risk_level(F.floor(c("volatility") / 10)).alias("level"),
        ))

    share = "case asset_type when 'stock' then 0.05 when 'crypto' then 0.10 when 'forex' then 0.02 when 'commodity' then 0.07 else 0.04 end * case when volatility > 20 then 1.5 else 1.0 end"
    reg.add("risk_sizes", sizes, f"""with {SNAPS_SQL}, z as (select *, price * case when hour(ts) % 2 = 0 then 1 - {share} else 1 + {share} end as stop, abs(sentiment) / 4 as kelly, volatility / 1000 as loss from snaps where confidence is not null)
        select symbol, ts, {r('stop', 'stop')}, {r('price + 2 * (price - stop)', 'target')}, {r('least(case when abs(price - stop) = 0 then 100000.0 * 0.05 / price else 100000.0 * 0.02 / abs(price - stop) * least(confidence / 100, 1.0) end, 10000.0 / price)', 'shares')},
        {r('case when kelly is not null and volatility is not null then least(100000.0 * kelly * least(1.0, 20 / greatest(volatility, 5.0)), 10000.0, 2000.0 / coalesce(nullif(loss, 0), 0.05)) end', 'engine')},
        {r('least(0.3 * least(confidence / 100, 1.0) + 0.3 * least(rsi / 40 / 2, 1.0) + 0.2 * least(volatility / 50, 1.0) + 0.2 * least(confidence / 100, 1.0), 1.0)', 'risk_score')}, case when floor(volatility / 10) >= 6 then 'CRITICAL' when floor(volatility / 10) >= 4 then 'HIGH' when floor(volatility / 10) >= 2 then 'MEDIUM' else 'LOW' end as level from z""")
