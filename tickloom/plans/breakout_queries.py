"""Queries of breakouts by all detectors, with the SQL of those that are not the state of levels."""

from __future__ import annotations

from tickloom.operators import breakouts
from tickloom.operators import strategies as st
from tickloom.plans.base import Registry, r, rounded
from tickloom.plans.snapshot_sql import SNAPS_SQL, snaps

COLUMNS = ("symbol", "ts", "kind", "direction", "quality", "level", "entry", "target", "stop", "width", "volume_ratio", "momentum", "sure")
DOUBLES = ("level", "entry", "target", "stop", "volume_ratio", "momentum", "sure")
SHOWN = ", ".join(r(f"({c})::double", c) if c in DOUBLES else c for c in COLUMNS)
W = "over (partition by symbol order by ts rows between {} and {})"

SHAPES_SQL = f"""with {SNAPS_SQL}, a as (select symbol, ts, price as p, row_number() over (partition by symbol order by ts) - 1 as i from snaps),
    b as (select *, count(*) {W.format('3 preceding', '3 following')} = 7 and p > max(p) {W.format('3 preceding', '1 preceding')} and p >= max(p) {W.format('1 following', '3 following')} as top,
        count(*) {W.format('3 preceding', '3 following')} = 7 and p < min(p) {W.format('3 preceding', '1 preceding')} and p <= min(p) {W.format('1 following', '3 following')} as bottom from a),
    c as (select *, case when top then p end as th, case when bottom then p end as bl, i::double as x from b),
    d as (select *, count(th) {W.format('59 preceding', '3 preceding')} as nt, count(bl) {W.format('59 preceding', '3 preceding')} as nb, min(case when th is not null or bl is not null then i end) {W.format('59 preceding', '3 preceding')} as first_,
        regr_slope(th, x) {W.format('59 preceding', '3 preceding')} as hs, regr_intercept(th, x) {W.format('59 preceding', '3 preceding')} as hi, corr(th, x) {W.format('59 preceding', '3 preceding')} as hr,
        regr_slope(bl, x) {W.format('59 preceding', '3 preceding')} as ls, regr_intercept(bl, x) {W.format('59 preceding', '3 preceding')} as li, corr(bl, x) {W.format('59 preceding', '3 preceding')} as lr,
        count(p) {W.format('50 preceding', '1 preceding')} as n, max(p) {W.format('50 preceding', '1 preceding')} as res, min(p) {W.format('50 preceding', '1 preceding')} as sup, list(p) {W.format('50 preceding', '1 preceding')} as seen from c),
    e as (select *, hs * i + hi as up, ls * i + li as down, least(abs(hr), abs(lr)) as fit, nt + nb as swings, i >= 29 and nt >= 2 and nb >= 2 and hs < 0 and ls > 0 and ls - hs > 0.001 as tri,
        coalesce(len(list_filter(seen, lambda v: v >= res * 0.995)), 0) as t1, coalesce(len(list_filter(seen, lambda v: v <= sup * 1.005)), 0) as t2 from d),
    f as (select *, n >= 15 and (res - sup) / res <= 0.1 and t1 >= 2 and t2 >= 2 as box from e),
    g as (select symbol, ts, 'triangle' as kind, case when p > up * 1.005 then 'UP' else 'DOWN' end as direction, case when fit > 0.8 and swings >= 6 then 'VERY_STRONG' when fit > 0.6 and swings >= 4 then 'STRONG' when fit > 0.4 then 'MODERATE' else 'WEAK' end as quality,
            case when p > up * 1.005 then up else down end as level, p as entry, case when p > up * 1.005 then up + (up - down) else down - (up - down) end as target, case when p > up * 1.005 then down else up end as stop, i - first_ as width, 1.0 as volume_ratio, 0.0 as momentum, fit * 100 as sure
            from f where tri and (p > up * 1.005 or p < down * 0.995)
        union all select symbol, ts, 'rectangle', case when p > res * 1.003 then 'UP' else 'DOWN' end, case when n >= 30 and t1 + t2 >= 8 then 'VERY_STRONG' when n >= 20 and t1 + t2 >= 6 then 'STRONG' when n >= 15 and t1 + t2 >= 4 then 'MODERATE' else 'WEAK' end,
            case when p > res * 1.003 then res else sup end, p, case when p > res * 1.003 then res + (res - sup) else sup - (res - sup) end, case when p > res * 1.003 then sup else res end, n, 1.0, 0.0, 70.0
            from f where box and (p > res * 1.003 or p < sup * 0.997))
    select {SHOWN} from g"""

SIZE_SQL = f"""with {SNAPS_SQL}, a as (select symbol, ts, price as p, volume, regime, volatility, lag(price) over (partition by symbol order by ts) as before, row_number() over (partition by symbol order by ts) as n from snaps),
    b as (select *, p - before as move, case when before is null then 0.0 else abs(p - before) end as true_range from a),
    c as (select *, volume / nullif(avg(volume) {W.format('19 preceding', 'current row')}, 0) as ratio, case when count(p) {W.format('19 preceding', 'current row')} = 20 then avg(p) {W.format('19 preceding', 'current row')} end as mean,
        case when count(p) {W.format('19 preceding', 'current row')} = 20 then stddev_samp(p) {W.format('19 preceding', 'current row')} end as dev, case when count(true_range) {W.format('13 preceding', 'current row')} = 14 then avg(true_range) {W.format('13 preceding', 'current row')} end as atr from b),
    d as (select *, mean + 2 * dev as top, mean - 2 * dev as low, abs(move) / atr as times, case when move > 0 then 1.0 else -1.0 end as way from c),
    g as (select symbol, ts, 'volume' as kind, case when move > 0 then 'UP' else 'DOWN' end as direction, case when ratio > 6 then 'STRONG' else 'MODERATE' end as quality, p as level, p as entry, p as target, p as stop, 1 as width, ratio as volume_ratio, abs(move / before) as momentum, least(90.0, 60 + ratio * 5) as sure
            from d where n >= 20 and ratio > 3 and abs(move / before) > 0.01
        union all select symbol, ts, 'bands', 'UP', 'MODERATE', top, p, p + (top - low) * 0.5, mean, 20, 1.0, (p - top) / top, 70.0 from d where p > top
        union all select symbol, ts, 'bands', 'DOWN', 'MODERATE', low, p, p - (top - low) * 0.5, mean, 20, 1.0, (low - p) / low, 70.0 from d where p < low
        union all select symbol, ts, 'range', case when move > 0 then 'UP' else 'DOWN' end, case when times > 3 then 'STRONG' else 'MODERATE' end, p, p, p + way * atr * 2, p - way * atr, 14, 1.0, times, least(90.0, 60 + times * 10) from d where atr > 0 and times > 1.5)
    select {SHOWN.replace('width', 'width::bigint as width')} from g"""


def register(reg: Registry) -> None:
    reg.add("sig_level_breakouts", lambda spark, d: rounded(breakouts.at_levels(snaps(spark, d)).select(*COLUMNS)))
    reg.add("sig_shape_breakouts", lambda spark, d: rounded(breakouts.from_shapes(snaps(spark, d)).select(*COLUMNS)), SHAPES_SQL)
    reg.add("sig_size_breakouts", lambda spark, d: rounded(breakouts.by_size(snaps(spark, d)).select(*COLUMNS)), SIZE_SQL)
    reg.add("sig_every_breakout", lambda spark, d: rounded(st.best_breakout(breakouts.every(snaps(spark, d)))))
