"""Queries of the native indicators over hourly bars."""

from __future__ import annotations

from tickloom.functions import indicators as ind
from tickloom.plans.base import Registry, full, lag, over, r, so_far

HH14, LL14 = full(14, "max(high)", "high"), full(14, "min(low)", "low")


def register(reg: Registry) -> None:
    reg.over_bars("bars_hourly", lambda b: b, ["open", "high", "low", "close", "volume"], f"select symbol, ts, {r('open', 'open')}, {r('high', 'high')}, {r('low', 'low')}, {r('close', 'close')}, {r('volume', 'volume')} from bars")
    reg.over_bars("ind_sma", ind.sma, [f"sma_{n}" for n in (10, 20, 50, 100, 200)], "select symbol, ts, " + ", ".join(r(full(n, "avg(close)", "close"), f"sma_{n}") for n in (10, 20, 50, 100, 200)) + " from bars")
    weighted = " + ".join([f"{20 - k} * {lag('close', k)}" for k in range(1, 20)] + ["20 * close"])
    reg.over_bars("ind_wma", ind.wma, ["wma_20"], f"select symbol, ts, {r(f'({weighted}) / 210.0', 'wma_20')} from bars")
    band = f"""select symbol, ts, {r('m', 'bb_mid')}, {r('u', 'bb_upper')}, {r('l', 'bb_lower')}, {r('w', 'bb_width')}, {r('case when u - l > 0 then (close - l) / (u - l) * 100 end', 'bb_position')},
        w < 0.5 * {full(20, 'avg(w)', 'w')} as bb_squeeze from c"""
    steps = lambda sd: f", a as (select *, {full(20, 'avg(close)', 'close')} as m, {full(20, f'{sd}(close)', 'close')} as s from bars), b as (select *, m + 2 * s as u, m - 2 * s as l from a), c as (select *, (u - l) / m * 100 as w from b) "
    columns = ["bb_mid", "bb_upper", "bb_lower", "bb_width", "bb_position", "bb_squeeze"]
    reg.over_bars("ind_bollinger", ind.bollinger, columns, steps("stddev_pop") + band)
    reg.over_bars("ind_bollinger_sample", lambda b: ind.bollinger(b, sample=True), columns, steps("stddev_samp") + band)
    du, dl = full(20, "max(high)", "high"), full(20, "min(low)", "low")
    reg.over_bars("ind_donchian", ind.donchian, ["dc_upper", "dc_lower", "dc_mid"], f"select symbol, ts, {r(du, 'dc_upper')}, {r(dl, 'dc_lower')}, {r(f'({du} + {dl}) / 2', 'dc_mid')} from bars")
    mid = lambda n: f"(({full(n, 'max(high)', 'high')}) + ({full(n, 'min(low)', 'low')})) / 2"
    reg.over_bars("ind_ichimoku", ind.ichimoku, ["tenkan", "kijun", "senkou_a", "senkou_b", "chikou"], f""", a as (select *, {mid(9)} as t, {mid(26)} as k, {mid(52)} as g from bars)
        select symbol, ts, {r('t', 'tenkan')}, {r('k', 'kijun')}, {r(lag('(t + k) / 2', 26), 'senkou_a')}, {r(lag('g', 26), 'senkou_b')}, {r('lead(close, 26) over (partition by symbol order by ts)', 'chikou')} from a""")
    reg.over_bars("ind_aroon", ind.aroon, ["aroon_up", "aroon_down", "aroon_osc"], f""", i as (select *, row_number() over (partition by symbol order by ts) as i from bars),
        m as (select *, max(high) {over(26)} as hh, min(low) {over(26)} as ll from i),
        j as (select m.symbol, m.ts, m.i, max(p.i) filter (where p.high = m.hh) as hi, max(p.i) filter (where p.low = m.ll) as li from m join i p on p.symbol = m.symbol and p.i between m.i - 25 and m.i group by 1, 2, 3),
        k as (select *, case when i > 25 then 100.0 * (25 - (i - hi)) / 25 end as u, case when i > 25 then 100.0 * (25 - (i - li)) / 25 end as d from j)
        select symbol, ts, {r('u::double', 'aroon_up')}, {r('d::double', 'aroon_down')}, {r('(u - d)::double', 'aroon_osc')} from k""")
    reg.over_bars("ind_stochastic", ind.stochastic, ["stoch_k", "stoch_d"], f""", a as (select *, {HH14} as hh, {LL14} as ll from bars), b as (select *, case when hh - ll > 0 then (close - ll) / (hh - ll) * 100 when hh = ll then 0.0 end as f from a),
        c as (select *, {full(3, 'avg(f)', 'f')} as k from b) select symbol, ts, {r('k', 'stoch_k')}, {r(full(3, 'avg(k)', 'k'), 'stoch_d')} from c""")
    reg.over_bars("ind_williams_r", ind.williams_r, ["williams_r"], f", a as (select *, {HH14} as hh, {LL14} as ll from bars) select symbol, ts, {r('case when hh - ll > 0 then -100 * (hh - close) / (hh - ll) when hh = ll then 0.0 end', 'williams_r')} from a")
    reg.over_bars("ind_roc", ind.roc, ["roc"], f"select symbol, ts, {r(f'case when {lag('close', 10)} <> 0 then (close / {lag('close', 10)} - 1) * 100 end', 'roc')} from bars")
    reg.over_bars("ind_momentum", ind.momentum, ["momentum"], f"select symbol, ts, {r(f'close - {lag('close', 10)}', 'momentum')} from bars")
    reg.over_bars("ind_cci", ind.cci, ["cci"], f""", i as (select *, (high + low + close) / 3 as tp, row_number() over (partition by symbol order by ts) as i from bars), a as (select *, {full(20, 'avg(tp)', 'tp')} as m from i),
        d as (select a.symbol, a.i, sum(abs(p.tp - a.m)) / 20 as away from a join i p on p.symbol = a.symbol and p.i between a.i - 19 and a.i where a.i >= 20 group by 1, 2)
        select a.symbol, a.ts, {r('case when away > 0 then (a.tp - a.m) / (0.015 * away) when away = 0 then 0.0 end', 'cci')} from a left join d on d.symbol = a.symbol and d.i = a.i""")
    share = lambda n: f"({full(n, 'sum(bp)', 'bp')}) / nullif({full(n, 'sum(tr)', 'tr')}, 0)"
    reg.over_bars("ind_ultimate_oscillator", ind.ultimate_oscillator, ["ultimate"], f""", p as (select *, {lag('close')} as pc from bars), a as (select *, case when pc is not null then close - least(low, pc) end as bp, case when pc is not null then greatest(high, pc) - least(low, pc) end as tr from p)
        select symbol, ts, {r(f'100 * (4 * {share(7)} + 2 * {share(14)} + {share(28)}) / 7', 'ultimate')} from a""")
    reg.over_bars("ind_obv", ind.obv, ["obv"], f", p as (select *, {lag('close')} as pc from bars), a as (select *, case when pc is null or close > pc then volume when close < pc then -volume else 0.0 end as s from p) select symbol, ts, {r(so_far('sum(s)'), 'obv')} from a")
    reg.over_bars("ind_ad_line", ind.ad_line, ["ad_line"], f", a as (select *, case when high <> low then ((close - low) - (high - close)) / (high - low) * volume else 0.0 end as s from bars) select symbol, ts, {r(so_far('sum(s)'), 'ad_line')} from a")
    reg.over_bars("ind_mfi", ind.mfi, ["mfi"], f""", t as (select *, (high + low + close) / 3 as tp from bars), p as (select *, {lag('tp')} as q from t), a as (select *, case when tp > q then tp * volume when q is not null then 0.0 end as u, case when tp < q then tp * volume when q is not null then 0.0 end as d from p),
        b as (select *, {full(14, 'sum(u)', 'u')} as su, {full(14, 'sum(d)', 'd')} as sd from a) select symbol, ts, {r('case when su + sd >= 1 then 100 * su / (su + sd) when su + sd < 1 then 0.0 end', 'mfi')} from b""")
    reg.over_bars("ind_vwap", ind.vwap, ["vwap"], f"select symbol, ts, {r(so_far('sum((high + low + close) / 3 * volume)') + ' / nullif(' + so_far('sum(volume)') + ', 0)', 'vwap')} from bars")
    rsi = f""", p as (select *, close - {lag('close')} as d from bars), g as (select *, {full(14, 'avg(greatest(d, 0.0))', 'd')} as gain, {full(14, 'avg(greatest(-d, 0.0))', 'd')} as loss from p),
        rsi as (select *, case when loss > 0 then 100 - 100 / (1 + gain / loss) when gain > 0 then 100.0 when loss = 0 then 50.0 end as rsi from g)"""
    reg.over_bars("ind_rsi_simple", ind.simple_rsi, ["rsi_simple"], rsi + f" select symbol, ts, {r('rsi', 'rsi_simple')} from rsi")
    reg.over_bars("ind_expanding_mean", ind.expanding_mean, ["ma_warm"], f"select symbol, ts, {r(f'avg(close) {over(20)}', 'ma_warm')} from bars")
    reg.over_bars("ind_normalised", ind.normalised, ["close_100"], f"select symbol, ts, {r('close / nullif(first_value(close) over (partition by symbol order by ts), 0) * 100', 'close_100')} from bars")
    reg.over_bars("ind_ma_crossover", ind.ma_crossover, ["cross"], f""", a as (select *, {full(20, 'avg(close)', 'close')} as f, {full(50, 'avg(close)', 'close')} as s from bars), b as (select *, {lag('f')} as pf, {lag('s')} as ps from a)
        select symbol, ts, case when pf <= ps and f > s and abs(f - s) / s > 0.001 then 'BULLISH' when pf >= ps and f < s and abs(f - s) / s > 0.001 then 'BEARISH' end as "cross" from b""")
    reg.over_bars("ind_composite_momentum", ind.composite_momentum, ["composite_momentum", "composite_mean"], rsi + f""", a as (select *, {HH14} as hh, {LL14} as ll from rsi), b as (select *, case when hh - ll > 0 then (close - ll) / (hh - ll) * 100 when hh = ll then 0.0 end as f, case when hh - ll > 0 then -100 * (hh - close) / (hh - ll) when hh = ll then 0.0 end + 100 as wr from a),
        c as (select *, {full(3, 'avg(f)', 'f')} as k from b) select symbol, ts, {r('0.4 * rsi + 0.3 * k + 0.3 * wr', 'composite_momentum')}, {r('(coalesce(rsi, 0) + coalesce(k, 0) + coalesce(wr, 0)) / nullif((rsi is not null)::int + (k is not null)::int + (wr is not null)::int, 0)', 'composite_mean')} from c""")
    reg.over_bars("ind_volatility_regime", ind.volatility_regime, ["regime_code"], f""", p as (select *, close / nullif({lag('close')}, 0) - 1 as rt, row_number() over (partition by symbol order by ts) as i, {full(20, 'avg(close)', 'close')} as m20, {full(50, 'avg(close)', 'close')} as m50 from bars),
        v as (select *, coalesce({full(20, 'stddev_samp(rt)', 'rt')} * sqrt(252) * 100, 20) as vol from p)
        select symbol, ts, case when i > 60 then case when vol < 15 then case when close > m20 and m20 > m50 then 1 when close < m20 and m20 < m50 then 2 else 3 end when vol > 30 then 4 else 5 end end::int as regime_code from v""")
    reg.add("ind_volume_profile", lambda spark, d: _profile(spark, d), _PROFILE_SQL)


def _profile(spark, sf_dir):
    from tickloom.plans.base import bars, rounded

    return rounded(ind.volume_profile(bars(spark, sf_dir)))


def _profile_sql() -> str:
    from tickloom.plans.base import BARS_SQL

    return f"""with {BARS_SQL}, e as (select symbol, min(low) as lo, (max(high) - min(low)) / 20 as step from bars group by symbol),
        b as (select e.symbol, bin::int as bin, lo + bin * step as low_edge, lo + (bin + 1) * step as high_edge from e, (select unnest(range(20)) as bin))
        select b.symbol, b.bin, {r('any_value(low_edge)', 'low_edge')}, {r('any_value(high_edge)', 'high_edge')}, {r('coalesce(sum(bars.volume), 0.0)', 'volume')}
        from b left join bars on bars.symbol = b.symbol and bars.low <= high_edge and bars.high >= low_edge group by b.symbol, b.bin"""


_PROFILE_SQL = _profile_sql()
