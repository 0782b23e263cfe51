"""Queries of strategy results and choices, each with its SQL. Trades are events; a user trades one strategy."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators import selector as sel
from tickloom.operators import strategies as st
from tickloom.plans.base import Registry, full, lag, r, rounded, ticks
from tickloom.plans.snapshot_sql import SNAPS_SQL, snaps
from tickloom.sources.market import latest, table

NAMES = ("bear", "breakout", "bull", "range", "volatility", "carry")
AS_OF = "2024-01-31 00:00:00"
TRADES_SQL = f"trades as (select {list(NAMES)}[(user_id % 6 + 1)::int] as strategy, ts, (value - 25) / 1000 as ret, event_id as trade_id from events)"
CLIP = lambda x, low, high: f"case when {x} > {high} then {high} when {x} < {low} then {low} else {x} end"
RESULTS_SQL = f"""{TRADES_SQL}, r0 as (select *, (epoch(timestamp '{AS_OF}') - floor(epoch(ts))) / 86400 as age from trades), r1 as (select *, exp(sum(ln(1 + ret)) over o) as w from r0 where age between 0 and 30 window o as (partition by strategy order by ts, trade_id rows unbounded preceding)),
    r2 as (select *, 1 - w / max(w) over (partition by strategy order by ts, trade_id rows unbounded preceding) as d from r1),
    r3 as (select strategy, count(*) as trades, avg(ret) as mean_return, stddev_pop(ret) as volatility, avg((ret > 0)::int) as win_rate, max(d) as drawdown, floor(min(age)) as days from r2 group by strategy),
    results as (select *, case when trades >= 10 then {CLIP(f"(50 + win_rate * 30 + {CLIP('(mean_return * 1000)', -20, 20)})", 0, 100)} else 50.0 end as performance,
        case when trades >= 10 then {CLIP(f"(50 + {CLIP('(case when volatility > 0 then mean_return / volatility else 0.0 end * 25)', -25, 25)} + {CLIP('(-drawdown * 100)', -15, 15)} + {CLIP('(-volatility * 200)', -10, 10)})", 0, 100)} else 50.0 end as risk,
        {CLIP(f"(least(trades / 10 * 20, 40.0) + case when trades >= 5 then {CLIP('((1 - volatility / (abs(mean_return) + 0.01)) * 40)', 0, 40)} else 20.0 end + greatest(20.0 - days, 0.0))", 0, 100)} as confidence from r3)"""
_RANK = "case " + " ".join(f"when regime = '{g}' and strategy = '{s}' then {30.0 * (1 - k / len(o))}" for g, o in sel.BY_REGIME.items() for k, s in enumerate(o)) + " else 0.0 end"
_ASSET = "case " + " ".join(f"when asset_type = '{a}' and strategy = '{s}' then {p}" for a, d in sel.BY_ASSET.items() for s, p in d.items()) + " else 0.0 end"
_FIT = "case strategy when 'volatility' then case when vs > 0.3 then 10.0 when vs < 0.15 then -10.0 else 0.0 end when 'breakout' then case when vs between 0.2 and 0.4 then 10.0 else 0.0 end when 'bull' then case when vs < 0.25 then 10.0 else 0.0 end when 'bear' then case when vs < 0.25 then 10.0 else 0.0 end else 0.0 end"
SCORES_SQL = f"""{SNAPS_SQL}, {RESULTS_SQL}, states as (select symbol, regime, asset_type, volatility / 100 as volatility from snaps qualify row_number() over (partition by symbol order by ts desc) = 1),
    s0 as (select symbol, regime, asset_type, coalesce(volatility, 0.2) as vs, unnest({list(sel.STRATEGIES)}) as strategy from states),
    s1 as (select *, {CLIP(f'(50 + {_RANK} + {_ASSET} + {_FIT})', 0.0, 100.0)}::double as suitability from s0),
    s2 as (select s1.*, coalesce(performance, 50.0) as performance, coalesce(risk, 50.0) as risk, coalesce(confidence, 20.0) as confidence, coalesce(mean_return, 0.0) as mean_return, coalesce(results.volatility, 0.0) as rv from s1 left join results using (strategy)),
    scores as (select *, round(0.3 * suitability + 0.25 * performance + 0.25 * risk + 0.2 * confidence, 9) as composite, (({' or '.join(f"(regime = '{g}' and strategy in ({', '.join(repr(s) for s in o)}))" for g, o in sel.BY_REGIME.items())})) as own from s2)"""


def trades(spark, d):
    names = F.array(*[F.lit(n) for n in NAMES])
    return table(spark, d, "events").select(F.element_at(names, (F.col("user_id") % 6 + 1).cast("int")).alias("strategy"), "ts", ((F.col("value") - 25) / 1000).alias("ret"), F.col("event_id").alias("trade_id"))


def found(spark, d):
    return sel.results(trades(spark, d), F.lit(AS_OF).cast("timestamp_ntz"))


def scores(spark, d):
    states = latest(snaps(spark, d), ["symbol"], [F.desc("ts")]).select("symbol", "regime", "asset_type", (F.col("volatility") / 100).alias("volatility"))
    return sel.scored(states, found(spark, d))


def register(reg: Registry) -> None:
    cols = ("mean_return", "volatility", "win_rate", "drawdown", "performance", "risk", "confidence")
    reg.add("select_results", lambda spark, d: rounded(found(spark, d)), f"with {RESULTS_SQL} select strategy, trades, {', '.join(r(c + '::double', c) for c in cols)} from results")
    parts = ("suitability", "performance", "risk", "confidence", "composite")
    reg.add("select_rankings", lambda spark, d: rounded(sel.rankings(scores(spark, d)).select("symbol", "regime", "asset_type", "strategy", *parts, "place")), f"with {SCORES_SQL} select symbol, regime, asset_type, strategy, {', '.join(r(c + '::double', c) for c in parts)}, row_number() over (partition by symbol order by composite desc, strategy)::int as place from scores")
    reg.add("select_choices", lambda spark, d: rounded(sel.choices(scores(spark, d))), f"""with {SCORES_SQL}, e0 as (select *, row_number() over (partition by symbol order by composite desc, strategy) as n, row_number() over (partition by symbol order by own desc, composite desc, strategy) as k from scores),
        e1 as (select * from e0 where (composite >= 40 and n <= 3) or n = 1), e2 as (select *, greatest(0.1, composite / sum(composite) over (partition by symbol)) as w0 from e1), e3 as (select *, w0 / sum(w0) over (partition by symbol) as w from e2),
        e4 as (select symbol, string_agg(strategy, '+' order by n) as ensemble, count(*) as size, sum(w * mean_return) as er, sqrt(sum(pow(w * rv, 2))) as ek from e3 group by symbol),
        e5 as (select symbol, any_value(regime) as regime, max(case when k = 1 then strategy end) as by_regime, max(case when k = 1 then mean_return end) as rr, max(case when k = 1 then rv end) as rk, max(case when n = 1 then strategy end) as best, arg_min(strategy, (-risk, strategy)) as by_risk from e0 group by symbol)
        select e5.symbol, regime, by_regime, best, by_risk, ensemble, {r('er', 'ensemble_return')}, {r('ek', 'ensemble_risk')}, case when size > 1 and er > rr * 1.1 and ek < rk * 1.2 then ensemble else by_regime end as adaptive from e5 join e4 using (symbol)""")
    cond = ("volatility_share", "trend_strength", "volume_trend", "move_4")
    m20, v10 = full(20, "avg(price)", "price"), full(10, "avg(volume)", "volume")
    reg.add("select_conditions", lambda spark, d: rounded(sel.conditions(snaps(spark, d)).select("symbol", "ts", *cond)), f"""with {SNAPS_SQL}, c as (select *, {m20} as m, {v10} as v from snaps)
        select symbol, ts, {r('volatility / 100', 'volatility_share')}, {r('abs(price - m) / m', 'trend_strength')}, {r('volume / nullif(v, 0)', 'volume_trend')}, {r(f'price / {lag("price", 4)} - 1', 'move_4')} from c""")

    def kept(spark, d):
        s = snaps(spark, d)
        chosen = s.select("symbol", "ts", st.strategy_of(F.col("asset_type"), F.coalesce("regime", F.lit("SIDEWAYS")), F.col("volatility"), F.col("rsi")).alias("choice"))
        return sel.stable(chosen).withColumn("due", sel.due(chosen, 61)).select("symbol", "ts", "choice", "kept", "due")

    name = "case g when 'BULL' then 'bull_momentum' when 'BEAR' then 'bear_defensive' when 'VOLATILE' then 'volatility_trading' when 'BREAKOUT' then 'breakout_momentum' else 'range_trading' end"
    reg.add("select_stable", kept, f"""with {SNAPS_SQL}, a as (select *, coalesce(regime, 'SIDEWAYS') as g from snaps), b as (select symbol, ts, case asset_type when 'crypto' then case when volatility > 50 then 'crypto_volatility' when g in ('BULL', 'BREAKOUT') then 'bull_momentum' else 'volatility_trading' end when 'forex' then 'forex_carry'
            when 'stock' then case when g = 'SIDEWAYS' and (rsi > 70 or rsi < 30) then 'mean_reversion' when g = 'BULL' then 'bull_momentum' else 'bear_defensive' end else {name} end as choice, row_number() over (partition by symbol order by ts) as i from a),
        c as (select x.symbol, x.i, y.choice, count(*) as n from b x join b y on x.symbol = y.symbol and y.i between x.i - 4 and x.i where x.i >= 5 group by 1, 2, 3), m as (select symbol, i, choice, n from c qualify row_number() over (partition by symbol, i order by n desc, choice) = 1)
        select b.symbol, b.ts, b.choice, case when m.n >= 3 then m.choice else b.choice end as kept, coalesce(epoch(b.ts) - epoch(lag(b.ts) over (partition by b.symbol order by b.ts)) >= 61 * 60, true) as due from b left join m on b.symbol = m.symbol and b.i = m.i""")
    reg.add("select_due_history", lambda spark, d: ticks(spark, d).where(F.col("ts") >= F.lit("2024-01-24 00:00:00").cast("timestamp_ntz")).groupBy("symbol").agg(F.count("*").alias("decisions"), F.max("ts").alias("last_ts")), f"with {'ticks as (select event_type as symbol, ts from events)'} select symbol, count(*) as decisions, max(ts) as last_ts from ticks where ts >= timestamp '2024-01-24' group by symbol")
