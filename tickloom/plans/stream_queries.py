"""Queries of streaming functions on tables, of signals and of the ledger."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators import signals
from tickloom.plans.base import BARS_SQL, Registry, bars, r, rounded, ticks
from tickloom.sources import market as sources
from tickloom.sources.market import table
from tickloom.streaming import market


def register(reg: Registry) -> None:
    reg.add("stream_window_bars", lambda spark, d: rounded(market.bars(ticks(spark, d)).select("symbol", "ts", "high", "low", "volume")), f"with {BARS_SQL} select symbol, ts, {r('high', 'high')}, {r('low', 'low')}, {r('volume', 'volume')} from bars")
    reg.add("stream_sessions", lambda spark, d: rounded(market.sessions(ticks(spark, d), "20 minutes")), f"""with {BARS_SQL}, a as (select *, coalesce((ts - lag(ts) over (partition by symbol order by ts, event_id) > interval 20 minute)::int, 1) as n from ticks), b as (select *, sum(n) over (partition by symbol order by ts, event_id rows unbounded preceding) as g from a)
        select symbol, min(ts) as start, max(ts) + interval 20 minute as "end", count(*) as ticks, {r('sum(volume)', 'volume')} from b group by symbol, g""")
    reg.add("stream_rate_limited", lambda spark, d: market.rate_limited(table(spark, d, "events"), "event_type", "1 hour", 4), "select event_type, date_trunc('hour', ts) as start, count(*) as requests from events group by 1, 2 having count(*) >= 4")
    def ledger(spark, d):
        fills = table(spark, d, "lineitem").select(
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("fill_id"), F.concat(F.lit("P"), F.col("l_partkey") % 25).alias("symbol"), F.col("l_shipdate").cast("timestamp").alias("ts"), F.when(F.col("l_returnflag") == "R", "SELL").otherwise("BUY").alias("side"),
            F.col("l_quantity").alias("quantity"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        )
        return rounded(market.positions(fills).withColumn("ts", F.col("ts").cast("timestamp_ntz")), 6)

    reg.add("ledger_positions", ledger, f"""with recursive f as (select 'P' || (l_partkey % 25) as symbol, l_shipdate as ts, case when l_returnflag = 'R' then -l_quantity else l_quantity end as s, l_extendedprice / l_quantity as price,
            row_number() over (partition by l_partkey % 25 order by l_shipdate, l_orderkey * 10 + l_linenumber) as n from lineitem),
        p as (select symbol, ts, n, s as q, price as c, 0.0::double as g from f where n = 1
            union all select f.symbol, f.ts, f.n, p.q + f.s, case when p.q = 0 or p.q * f.s > 0 then case when p.q + f.s <> 0 then (abs(p.q) * p.c + abs(f.s) * f.price) / abs(p.q + f.s) else 0.0 end when p.q * (p.q + f.s) < 0 then f.price when p.q + f.s <> 0 then p.c else 0.0 end,
                p.g + case when p.q = 0 or p.q * f.s > 0 then 0.0 else least(abs(p.q), abs(f.s)) * (f.price - p.c) * sign(p.q) end from p join f on f.symbol = p.symbol and f.n = p.n + 1)
        select symbol, ts, {r('q', 'quantity', 6)}, {r('c', 'mean_cost', 6)}, {r('g', 'realised', 6)} from p""")

    def rules(spark, d):
        snaps = sources.snapshots(bars(spark, d)).select("symbol", "ts", "price", "change_pct")
        own = spark.createDataFrame([(1, "view", "price_above", 1.0), (2, "click", "price_below", 1000.0), (3, "purchase", "change_percent_above", 5.0)], "rule_id int, symbol string, kind string, limit double")
        return rounded(market.alerts(snaps, own))

    reg.add("stream_alerts", rules, f"""with {BARS_SQL}, s as (select symbol, ts, close, (close / lag(close) over (partition by symbol order by ts) - 1) * 100 as chg, row_number() over (partition by symbol order by ts desc) as rn from bars),
        u(rule_id, symbol, kind, lim) as (values (1, 'view', 'price_above', 1.0::double), (2, 'click', 'price_below', 1000.0::double), (3, 'purchase', 'change_percent_above', 5.0::double))
        select s.symbol, ts, rule_id, kind, {r('close', 'price')}, lim as "limit" from s join u on s.symbol = u.symbol where rn = 1 and case kind when 'price_above' then close > lim when 'price_below' then close < lim else abs(chg) > lim end""")
    votes = lambda spark, d: table(spark, d, "lineitem").select(F.col("l_suppkey").alias("symbol"), F.when(F.col("l_returnflag") == "A", "BUY").when(F.col("l_returnflag") == "R", "OVERBOUGHT").otherwise("NEUTRAL").alias("signal"), (F.col("l_discount") * 1000).alias("confidence"))
    reg.add("signal_consensus", lambda spark, d: rounded(signals.consensus(votes(spark, d))), f"""with v as (select l_suppkey as symbol, count(*) as n, count(*) filter (where l_returnflag = 'A') as bulls, count(*) filter (where l_returnflag = 'R') as bears, avg(l_discount * 1000) filter (where l_returnflag = 'A') as b, avg(l_discount * 1000) filter (where l_returnflag = 'R') as s from lineitem group by 1),
        w as (select *, bulls >= 3 and bulls > bears as up, bears >= 3 and bears > bulls as down from v) select symbol, bulls, bears, case when up then 'BUY' when down then 'SELL' else 'NEUTRAL' end as consensus, {r('least(95.0::double, case when up then b * bulls / n when down then s * bears / n else 0.0 end)', 'confidence')} from w""")
    reg.add("signal_execution", lambda spark, d: rounded(table(spark, d, "orders").select("o_orderkey", signals.commission(F.col("o_totalprice")).alias("commission"), signals.execution_price(F.col("o_totalprice"), F.when(F.col("o_custkey") % 2 == 0, "BUY").otherwise("SELL"), F.lit(20.0), F.col("o_totalprice")).alias("executed"))),
        f"select o_orderkey, {r('case when o_totalprice <= 1000 then 1.0 when o_totalprice <= 10000 then o_totalprice * 0.005 else o_totalprice * 0.001 end', 'commission')}, {r('o_totalprice + case when o_custkey % 2 = 0 then 1 else -1 end * (o_totalprice * 0.0005 * 3 / 2 + o_totalprice * 0.0001 * o_totalprice / 1e6)', 'executed')} from orders")
