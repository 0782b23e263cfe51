"""Queries of the recurrences; SQL follows them with recursive tables."""

from __future__ import annotations

from tickloom.functions import sequential as seq
from tickloom.plans.base import BARS_SQL, Registry, bars, lag, r, rounded

_I = "i as (select *, row_number() over (partition by symbol order by ts) - 1 as i from bars)"


def _ema(name: str, source: str, column: str, n: int, start: int | None = None, alpha: float | None = None) -> str:
    """A recursive table (symbol, i, v): the mean of n values ending at `start`, then the recurrence."""
    start = n - 1 if start is None else start
    alpha = 2 / (n + 1) if alpha is None else alpha
    return f"""{name} as (
        select symbol, {start}::bigint as i, avg({column})::double as v from {source} where i between {start - n + 1} and {start} group by symbol having count(*) = {n}
        union all select s.symbol, s.i, e.v + {alpha!r}::double * (s.{column} - e.v) from {name} e join {source} s on s.symbol = e.symbol and s.i = e.i + 1)"""


def _sql(tables: str, columns: str, joins: str) -> str:
    return f"with recursive {BARS_SQL}, {_I}, {tables} select i.symbol, i.ts, {columns} from i {joins}"


def _join(*names: str) -> str:
    return " ".join(f"left join {n} on {n}.symbol = i.symbol and {n}.i = i.i" for n in names)


#: Directional movement: sums of 14 that decay by a 14th, then the same of their ratio. The last table, `adx`, has symbol, i, p, m, v.
ADX_TABLES = f"""dm0 as (select *, {lag('high')} as ph, {lag('low')} as pl, {lag('close')} as pc from i), dm as (select symbol, i, case when high - ph > pl - low and high > ph then high - ph else 0.0 end as up, case when pl - low > high - ph and pl > low then pl - low else 0.0 end as down, greatest(high - low, abs(high - pc), abs(low - pc)) as tr from dm0 where i > 0),
    dsum as (select symbol, 13::bigint as i, sum(up)::double as u, sum(down)::double as d, sum(tr)::double as t from dm where i <= 13 group by symbol having count(*) = 13
        union all select n.symbol, n.i, s.u - s.u / 14 + n.up, s.d - s.d / 14 + n.down, s.t - s.t / 14 + n.tr from dsum s join dm n on n.symbol = s.symbol and n.i = s.i + 1),
    di as (select symbol, i, case when t > 0 then 100 * u / t else 0.0 end as p, case when t > 0 then 100 * d / t else 0.0 end as m from dsum where i >= 14), dx as (select *, case when p + m > 0 then 100 * abs(p - m) / (p + m) end as x from di),
    av as (select symbol, 27::bigint as i, avg(coalesce(x, 0.0))::double as v from dx where i <= 27 group by symbol having count(*) = 14
        union all select n.symbol, n.i, case when n.x is null then a.v else (a.v * 13 + n.x) / 14 end from av a join dx n on n.symbol = a.symbol and n.i = a.i + 1),
    adx as (select di.*, av.v from di left join av using (symbol, i))"""
SAR_TABLES = f"""h as (select symbol, i, high, low, case when i = 1 then high else {lag('high')} end as hb, case when i = 1 then low else {lag('low')} end as lb, {lag('high')} as h0, {lag('low')} as l0 from i),
    sar as (select symbol, 0::bigint as i, case when l0 - low > greatest(high - h0, 0.0) then -1 else 1 end as s, case when l0 - low > greatest(high - h0, 0.0) then -low else high end as e, case when l0 - low > greatest(high - h0, 0.0) then -h0 else l0 end as stop, 0.02::double as pace, null::double as v from h where i = 1
        union all select symbol, i, s2, e2, least(stop1 + pace2 * (e2 - stop1), case when s2 > 0 then lb else -hb end, case when s2 > 0 then low else -high end), pace2, s2 * stop1
        from (select *, case when turn then case when s2 > 0 then high else -low end when ahead > e then ahead else e end as e2, case when turn then 0.02 when ahead > e then least(pace + 0.02, 0.2) else pace end as pace2, case when turn then -greatest(e, behind, ahead) else stop end as stop1
            from (select h.symbol, h.i, h.high, h.low, h.hb, h.lb, sar.e, sar.stop, sar.pace, case when sar.s > 0 then h.high else -h.low end as ahead, case when sar.s > 0 then h.hb else -h.lb end as behind,
                case when sar.s > 0 then h.low else -h.high end <= sar.stop as turn, case when (case when sar.s > 0 then h.low else -h.high end) <= sar.stop then -sar.s else sar.s end as s2 from sar join h on h.symbol = sar.symbol and h.i = sar.i + 1)))"""


_LINE = "m as (select f.symbol, f.i - 25 as i, f.v - s.v as d from f join s on s.symbol = f.symbol and s.i = f.i where f.i >= 25)"
_MARK = "g as (select symbol, i + 25 as i, v from k), mm as (select m.symbol, m.i + 25 as i, m.d, g.v from m join g on g.symbol = m.symbol and g.i = m.i + 25)"
#: The last table, `mm`, has symbol, i, d (line) and v (signal).
MACD_TABLES = ", ".join([_ema("f", "i", "close", 12, 25), _ema("s", "i", "close", 26), _LINE, _ema("k", "m", "d", 9), _MARK])
#: Means of gains and losses: `ga` and `lo` with symbol, i, v.
RSI_TABLES = ", ".join([f"p as (select symbol, i, close - {lag('close')} as d from i), u as (select symbol, i, greatest(d, 0.0) as x, greatest(-d, 0.0) as y from p where i > 0)", _ema("ga", "u", "x", 14, 14, 1 / 14), _ema("lo", "u", "y", 14, 14, 1 / 14)])


def register(reg: Registry) -> None:
    def add(name: str, columns: list[str], oracle: str | None = None) -> None:
        reg.add(name, lambda spark, d: rounded(seq.pack(bars(spark, d)).select("symbol", "ts", *columns)), oracle)

    add("seq_ema", ["ema_12", "ema_26", "ema_50"], _sql(", ".join(_ema(f"e{n}", "i", "close", n) for n in (12, 26, 50)), ", ".join(r(f"e{n}.v", f"ema_{n}") for n in (12, 26, 50)), _join("e12", "e26", "e50")))
    add("seq_macd", ["macd", "macd_signal", "macd_hist"], _sql(MACD_TABLES, f"{r('mm.d', 'macd')}, {r('mm.v', 'macd_signal')}, {r('mm.d - mm.v', 'macd_hist')}", _join("mm")))
    add("seq_rsi", ["rsi_14"], _sql(RSI_TABLES, r("case when ga.v + lo.v > 0 then 100 * ga.v / (ga.v + lo.v) when ga.v is not null then 0.0 end", "rsi_14"), _join("ga", "lo")))
    tr = f"q as (select *, {lag('close')} as pc from i), t as (select symbol, i, greatest(high - low, abs(high - pc), abs(low - pc)) as x from q where i > 0)"
    add("seq_atr", ["atr_14"], _sql(", ".join([tr, _ema("a14", "t", "x", 14, 14, 1 / 14)]), r("a14.v", "atr_14"), _join("a14")))
    add("seq_keltner", ["keltner_mid", "keltner_upper", "keltner_lower"], _sql(", ".join([tr, _ema("a20", "t", "x", 20, 20, 1 / 20), _ema("e20", "i", "close", 20)]), f"{r('e20.v', 'keltner_mid')}, {r('e20.v + 2 * a20.v', 'keltner_upper')}, {r('e20.v - 2 * a20.v', 'keltner_lower')}", _join("a20", "e20")))
    ad = "ad as (select symbol, i, sum(case when high <> low then ((close - low) - (high - close)) / (high - low) * volume else 0.0 end) over (partition by symbol order by i rows unbounded preceding) as x from i)"
    add("seq_chaikin", ["chaikin_osc"], _sql(", ".join([ad, _ema("c3", "ad", "x", 1, 0, 0.5), _ema("c10", "ad", "x", 1, 0, 2 / 11)]), r("case when i.i >= 9 then c3.v - c10.v end", "chaikin_osc", 4), _join("c3", "c10")))
    reg.queries["seq_chaikin"] = lambda spark, d: rounded(seq.pack(bars(spark, d)).select("symbol", "ts", "chaikin_osc"), 4)
    sq = f"sq as (select symbol, i, pow(close / {lag('close')} - 1, 2) as x from i qualify i > 0)"
    add("seq_ewma_volatility", ["ewma_vol"], _sql(", ".join([sq, _ema("ev", "sq", "x", 1, 1, 0.06)]), r("case when i.i >= 10 then sqrt(ev.v * 252) end", "ewma_vol"), _join("ev")))
    add("seq_ema_from_first", ["ema_smooth"], _sql(_ema("es", "i", "close", 1, 0, 0.1), r("es.v", "ema_smooth"), _join("es")))
    add("seq_adx", ["plus_di", "minus_di", "adx"], _sql(ADX_TABLES, f"{r('adx.p', 'plus_di')}, {r('adx.m', 'minus_di')}, {r('adx.v', 'adx')}", _join("adx")))
    add("seq_parabolic_sar", ["sar"], _sql(SAR_TABLES, r("case when i.i > 0 then sar.v end", "sar"), _join("sar")))
    weight = lambda s: f"sum(pow({1 - 2 / (s + 1)!r}::double, a.i - b.i) * b.close) / sum(pow({1 - 2 / (s + 1)!r}::double, a.i - b.i))"
    add("seq_macd_ewm", ["macd_ewm"], f"with {BARS_SQL}, {_I} select a.symbol, a.ts, {r(weight(12) + ' - ' + weight(26), 'macd_ewm')} from i a join i b on b.symbol = a.symbol and b.i <= a.i group by a.symbol, a.ts, a.i")
