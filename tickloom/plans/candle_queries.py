"""Queries of averaged candles and of patterns that do not overlap, with the SQL of the candles."""

from __future__ import annotations

from tickloom.operators import candles, schedule
from tickloom.plans.base import BARS_SQL, Registry, bars, lag, rounded
from tickloom.plans.snapshot_sql import snaps


def _past(column: str, n: int, factor: str) -> str:
    frame = f"over (partition by symbol order by ts rows between {n} preceding and 1 preceding)"
    return f"case when count({column}) {frame} = {n} then {factor} * avg({column}) {frame} end"


CANDLES_SQL = f"""{BARS_SQL}, m0 as (select *, abs(close - open) as body, high - low as span, high - greatest(open, close) as up, least(open, close) - low as down, case when close >= open then 1 else -1 end as col, greatest(open, close) as top, least(open, close) as foot from bars),
    m1 as (select *, {_past('body', 10, '1.0')} as avg_body, {_past('span', 10, '0.1')} as tenth, {_past('span', 5, '0.2')} as near from m0),
    m2 as (select *, {', '.join(f'{lag(x)} as {x}1' for x in ('open', 'close', 'high', 'low', 'body', 'col', 'top', 'foot', 'avg_body', 'near'))}, {', '.join(f'{lag(x, 2)} as {x}2' for x in ('close', 'body', 'col', 'top', 'foot', 'avg_body'))} from m1),
    hits as (select symbol, ts, 'doji' as pattern, 100 as strength from m2 where body <= tenth
        union all select symbol, ts, 'hammer', 100 from m2 where body < avg_body and down > body and up < tenth and foot <= low1 + near1
        union all select symbol, ts, 'hanging_man', -100 from m2 where body < avg_body and down > body and up < tenth and foot >= high1 - near1
        union all select symbol, ts, 'shooting_star', -100 from m2 where body < avg_body and up > body and down < tenth and foot > top1
        union all select symbol, ts, 'engulfing', case when open <> close1 and close <> open1 then 100 else 80 end from m2 where col = 1 and col1 = -1 and ((close >= open1 and open < close1) or (close > open1 and open <= close1))
        union all select symbol, ts, 'engulfing', case when open <> close1 and close <> open1 then -100 else -80 end from m2 where col = -1 and col1 = 1 and ((open >= close1 and close < open1) or (open > close1 and close <= open1))
        union all select symbol, ts, 'morning_star', 100 from m2 where body2 > avg_body2 and col2 = -1 and body1 <= avg_body1 and top1 < foot2 and body > avg_body and col = 1 and close > close2 + 0.3 * body2
        union all select symbol, ts, 'evening_star', -100 from m2 where body2 > avg_body2 and col2 = 1 and body1 <= avg_body1 and foot1 > top2 and body > avg_body and col = -1 and close < close2 - 0.3 * body2
        union all select symbol, ts, 'harami', -col1 * case when top < top1 and foot > foot1 then 100 else 80 end from m2 where body1 > avg_body1 and body <= avg_body and top <= top1 and foot >= foot1
        union all select symbol, ts, 'dragonfly_doji', 100 from m2 where body <= tenth and up < tenth and down > tenth
        union all select symbol, ts, 'gravestone_doji', 100 from m2 where body <= tenth and down < tenth and up > tenth)"""


def register(reg: Registry) -> None:
    reg.add("candles_averaged", lambda spark, d: candles.candles(bars(spark, d)), f"with {CANDLES_SQL} select symbol, ts, pattern, strength::int as strength from hits")
    reg.add("candles_recent", lambda spark, d: rounded(candles.recent_signals(bars(spark, d))), f"""with {CANDLES_SQL}, r as (select * from hits qualify row_number() over (partition by symbol, pattern order by ts desc) <= 5)
        select symbol, ts, pattern, case when abs(strength) < 100 then 'WEAK_' else '' end || case when strength > 0 then 'BUY' else 'SELL' end as signal, round(least(0.95, abs(strength) / 100 * 0.8), 6) as confidence from r where ts < (select max(ts) from bars b where b.symbol = r.symbol)""")
    reg.add("pattern_schedule", lambda spark, d: rounded(schedule.scan(bars(spark, d), snaps(spark, d), cover=True)))
    reg.add("pattern_scan", lambda spark, d: rounded(schedule.scan(bars(spark, d), snaps(spark, d), most=20)))
