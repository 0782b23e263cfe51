"""Queries of regimes and patterns over hourly bars, and of vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators import patterns, regimes
from tickloom.plans.base import BARS_SQL, Registry, bars, full, lag, over, r, rounded
from tickloom.sources.market import table


def _rows(start: int, end: int) -> str:
    side = lambda k: f"{abs(k)} {'preceding' if k < 0 else 'following'}" if k else "current row"
    return f"over (partition by symbol order by ts rows between {side(start)} and {side(end)})"


def _centroids(spark, d):
    """The mean vector of each label."""
    spread = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("at", "x"))
    means = spread.groupBy("label", "at").agg(F.avg("x").alias("m"))
    return means.groupBy(F.col("label").alias("centroid")).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "m"))), lambda s: F.round(s["m"], 6)).alias("centre"))


def register(reg: Registry) -> None:
    gap = "(top - bottom)"
    reg.add("pattern_breakouts", lambda spark, d: rounded(patterns.breakouts(bars(spark, d))), f"""with {BARS_SQL}, x as (select *, max(high) {_rows(-19, -1)} as top, min(low) {_rows(-19, -1)} as bottom, count(close) {_rows(-19, -1)} as n, avg(volume) {_rows(-19, -1)} as v from bars),
        y as (select *, greatest((close - top) / {gap}, (bottom - close) / {gap}) as s from x where n = 19 and top > bottom)
        select symbol, ts, case when close > top then 'BUY' else 'SELL' end as direction, {r('s', 'strength')}, {r('least(0.95, 0.6 + 2 * s) + case when volume > 1.5 * v then 0.1 else 0.0 end', 'confidence')} from y where s > 0.01""")
    reg.add("pattern_volume_breakouts", lambda spark, d: rounded(patterns.volume_breakouts(bars(spark, d))), f"with {BARS_SQL}, x as (select *, close / nullif({lag('close')}, 0) - 1 as ret, volume / nullif(avg(volume) {_rows(-20, -1)}, 0) as ratio from bars) select symbol, ts, {r('ratio', 'ratio')}, {r('ret', 'ret')} from x where ratio > 3 and abs(ret) > 0.01")
    reg.add("pattern_atr_breakouts", lambda spark, d: rounded(patterns.atr_breakouts(bars(spark, d))), f"with {BARS_SQL}, x as (select *, {lag('close')} as pc from bars), y as (select *, greatest(high - low, abs(high - pc), abs(low - pc)) as tr, close - pc as m from x), z as (select *, count(tr) {_rows(-14, -1)} as n, avg(tr) {_rows(-14, -1)} as atr from y) select symbol, ts, {r('m', 'move')}, {r('atr', 'atr')} from z where n = 14 and abs(m) > 1.5 * atr")
    reg.add("pattern_bollinger_breakouts", lambda spark, d: rounded(patterns.bollinger_breakouts(bars(spark, d))), f"with {BARS_SQL}, x as (select *, {full(20, 'avg(close)', 'close')} as m, {full(20, 'stddev_samp(close)', 'close')} as sd from bars), y as (select *, (close - m) / nullif(sd, 0) as z from x) select symbol, ts, case when z > 0 then 'BUY' else 'SELL' end as direction, {r('z', 'z')} from y where abs(z) > 2")
    reg.add("pattern_flags", lambda spark, d: rounded(patterns.flags(bars(spark, d))), f"with {BARS_SQL}, x as (select *, {lag('close', 15)} as b, max(high) {_rows(0, 9)} as hi, min(low) {_rows(0, 9)} as lo, count(close) {_rows(0, 9)} as n from bars), y as (select *, (close - b) / b * 100 as p from x where b > 0 and n = 10) select symbol, ts, case when p > 0 then 'BULL_FLAG' else 'BEAR_FLAG' end as pattern, {r('p', 'move_pct')} from y where abs(p) > 5 and hi - lo < 0.5 * abs(close - b)")
    body, spread, up, down = "abs(close - open)", "(high - low)", "(high - greatest(open, close))", "(least(open, close) - low)"
    kinds = [
        ("DOJI", "NEUTRAL", f"{spread} > 0 and {body} <= 0.1 * {spread}"), ("HAMMER", "BUY", f"{body} > 0 and {down} >= 2 * {body} and {up} <= 0.3 * {body}"), ("SHOOTING_STAR", "SELL", f"{body} > 0 and {up} >= 2 * {body} and {down} <= 0.3 * {body}"),
        ("MARUBOZU", "BUY", f"{body} > ab and {body} >= 0.95 * {spread} and close > open"), ("MARUBOZU", "SELL", f"{body} > ab and {body} >= 0.95 * {spread} and close < open"),
        ("ENGULFING", "BUY", "pc < po and close > open and open <= pc and close >= po"), ("ENGULFING", "SELL", "pc > po and close < open and open >= pc and close <= po"),
        ("HARAMI", "BUY", "pc < po and close > open and open > pc and close < po"), ("HARAMI", "SELL", "pc > po and close < open and open < pc and close > po"),
    ]
    union = " union all ".join(f"select symbol, ts, '{name}' as pattern, '{way}' as direction from x where {cond}" for name, way, cond in kinds)
    reg.add("pattern_candles", lambda spark, d: patterns.candles(bars(spark, d)), f"with {BARS_SQL}, q as (select *, {body} as b, {lag('open')} as po, {lag('close')} as pc from bars), x as (select *, {full(10, 'avg(b)', 'b')} as ab from q) {union}")
    reg.add("pattern_double_extremes", lambda spark, d: rounded(patterns.double_extremes(bars(spark, d))))
    reg.add("pattern_triangles", lambda spark, d: rounded(patterns.triangles(bars(spark, d))))
    reg.add("pattern_peaks", lambda spark, d: rounded(patterns.peak_patterns(bars(spark, d))))
    # regimes
    reg.add("regime_ensemble", lambda spark, d: rounded(regimes.ensemble(bars(spark, d)).select("symbol", "ts", "volatility", "momentum_20", "regime", "regime_confidence")), f"""with {BARS_SQL}, a as (select *, row_number() over (partition by symbol order by ts)::double as i, {lag('close')} as pc, {lag('close', 20)} as c20 from bars),
        b as (select *, case when close > 0 and pc > 0 then ln(close / pc) end as lr, case when c20 > 0 then close / c20 - 1 end as m20, (close > pc)::int as u, (close < pc)::int as dn from a), c as (select *, coalesce(u = 1 and {lag('u')} = 1, false) as hh, coalesce(dn = 1 and {lag('dn')} = 1, false) as ll from b),
        e as (select *, ({full(20, 'stddev_pop(lr)', 'lr')}) * sqrt(252) as vol, {full(20, 'avg(lr)', 'lr')} as mr, ({full(14, 'regr_slope(close, i)', 'close')}) / first_value(close) {over(14)} as slope, {full(14, 'regr_r2(close, i)', 'close')} as fit, count(*) filter (where hh) {over(18)} as nh, count(*) filter (where ll) {over(18)} as nl from c),
        v as (select *, case when vol > 0.30 then 'VOLATILE' when mr > 0.001 and nh >= nl then 'BULL' when mr < -0.001 and nl >= nh then 'BEAR' else 'SIDEWAYS' end as v1, case when fit > 0.5 and m20 > 0.05 then 'BULL' when fit > 0.5 and m20 < -0.05 then 'BEAR' else 'SIDEWAYS' end as v2,
            case when vol >= 0.40 then 'VOLATILE' else 'SIDEWAYS' end as v3, case when slope > 0.02 then 'BULL' when slope < -0.02 then 'BEAR' else 'SIDEWAYS' end as v4 from e),
        n(name) as (values ('BEAR'), ('BULL'), ('SIDEWAYS'), ('VOLATILE')), w as (select symbol, ts, name, ((case when v1 = name then 0.3 else 0.0 end + case when v2 = name then 0.25 else 0.0 end + case when v3 = name then 0.2 else 0.0 end + case when v4 = name then 0.15 else 0.0 end) / 0.9)::double as x from v, n),
        k as (select * from w qualify row_number() over (partition by symbol, ts order by round(x, 9) desc, name) = 1)
        select symbol, ts, {r('vol', 'volatility')}, {r('m20', 'momentum_20')}, name as regime, {r('x', 'regime_confidence')} from v join k using (symbol, ts)""")
    reg.add("regime_persistence", lambda spark, d: rounded(regimes.persistence(bars(spark, d).withColumn("regime", F.when(F.col("close") > F.col("open"), "UP").otherwise("DOWN"))).select("symbol", "ts", "regime", F.col("regime_duration").cast("long").alias("regime_duration"), "transitions", "regime_share")), f"""with {BARS_SQL}, a as (select symbol, ts, case when close > open then 'UP' else 'DOWN' end as regime from bars), b as (select *, coalesce((regime <> {lag('regime')})::int, 0) as c, row_number() over (partition by symbol order by ts) as i from a),
        e as (select *, sum(c) over (partition by symbol order by ts rows unbounded preceding) as g from b), s as (select x.symbol, x.ts, avg((y.regime = x.regime)::int)::double as share from b x join b y on x.symbol = y.symbol and y.i between x.i - 9 and x.i group by 1, 2)
        select symbol, ts, regime, row_number() over (partition by symbol, g order by ts) as regime_duration, sum(c) {over(20)} as transitions, {r('share', 'regime_share')} from e join s using (symbol, ts)""".replace("sum(c) over (partition by symbol order by ts rows 19 preceding) as transitions", "(sum(c) over (partition by symbol order by ts rows 19 preceding))::bigint as transitions"))
    reg.add("regime_consolidations", lambda spark, d: regimes.consolidations(bars(spark, d)), f"""with {BARS_SQL}, a as (select * from bars qualify row_number() over (partition by symbol order by ts desc) <= 30), b as (select *, {full(5, 'stddev_pop(close)', 'close')} as sd from a), c as (select symbol, ts, sd < 0.5 * median(sd) over (partition by symbol) as flat from b where sd is not null),
        e as (select symbol, flat and not coalesce({lag('flat')}, false) as s from c) select symbol, count(*) filter (where s) as consolidations from e group by symbol""")
    reg.add("regime_clusters", lambda spark, d: rounded(regimes.cluster_series(regimes.features(bars(spark, d)), ["momentum_5", "volatility", "slope", "volume_trend"])))
    reg.add("regime_drift", lambda spark, d: rounded(regimes.drift(regimes.features(bars(spark, d)), ["momentum_5", "volatility"])))
    reg.add("vector_nearest_centroid", lambda spark, d: rounded(regimes.nearest_centroid(table(spark, d, "embeddings"), _centroids(spark, d)).select("vec_id", "similarity"), 5), """with u as (select label, unnest(embedding) as x, generate_subscripts(embedding, 1) as k from embeddings), m as (select label, k, round(avg(x::double), 6) as y from u group by 1, 2), c as (select label, list(y order by k) as v from m group by 1)
        select vec_id, round(max(list_cosine_similarity(embedding::double[], v)), 5) + 0.0 as similarity from embeddings, c group by vec_id""")
