"""Queries of features and regime trees over snapshots, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators import features as ft
from tickloom.operators import regimes
from tickloom.plans.base import Registry, lag, over, r, rounded
from tickloom.plans.sequential_queries import ADX_TABLES, MACD_TABLES, RSI_TABLES
from tickloom.plans.snapshot_sql import SNAPS_SQL, snaps

CLIP = lambda x, low, high: f"case when {x} > {high} then {high} when {x} < {low} then {low} else {x} end"
MARKET_SQL = f"""{SNAPS_SQL}, fm as (select ts, avg(coalesce(change_pct, 0)) as change_mean, stddev_pop(coalesce(change_pct, 0)) as change_std, avg(coalesce(change_pct > 0, false)::int) as bullish_ratio, max(abs(coalesce(change_pct, 0))) as change_max_abs,
        case when sum(volume) > 0 then avg(ln(1 + coalesce(volume, 0))) else 0 end as volume_log_mean, case when sum(volume) > 0 then stddev_pop(ln(1 + coalesce(volume, 0))) / (avg(ln(1 + coalesce(volume, 0))) + 1e-8) else 0 end as volume_spread,
        avg(coalesce(rsi, 50)) as rsi_mean, avg(coalesce(macd, 0)) as macd_mean, avg(coalesce(volatility, 20)) as volatility_mean, avg(coalesce(sentiment, 0)) as sentiment_mean, stddev_pop(coalesce(sentiment, 0)) as sentiment_std, avg(coalesce(sentiment > 0.1, false)::int) as positive_ratio,
        greatest(count(*) filter (where change_pct > 0), count(*) filter (where change_pct < 0)) / count(*) as agreement, count(*) as n from snaps group by ts)"""
SHORT_SQL = f"""{SNAPS_SQL}, f0 as (select *, coalesce(change_pct, 0) as c, coalesce(volatility, abs(change_pct), 0) as v, (row_number() over (partition by symbol order by ts) % 10) / 10 as liquidity from snaps), f1 as (select *, avg(c) over (partition by ts) as m from f0),
    fs as (select ts, avg(c) as change_mean, stddev_pop(c) as change_std, avg(v) as volatility_mean, stddev_pop(v) as volatility_std, coalesce(avg(case when volume <> 0 then volume end), 0.0) as volume_mean,
        case when count(*) < 2 then 0.5 else greatest(0.0, least(1.0, 1 - avg(abs(c - m)) / (stddev_pop(c) + 1e-8))) end as coherence, avg(liquidity) as liquidity, avg(coalesce(sentiment, 0)) as sentiment_mean from f1 group by ts)"""

_OF = {
    "current_price": "price", "price_change_pct": "change_pct", "rsi": "rsi", "macd": "macd", "volatility": "volatility", "sentiment_score": "sentiment", **{f"momentum_{k}": f"case when n > {k} then (price - {lag('price', k - 1)}) / {lag('price', k - 1)} * 100 end" for k in (5, 10, 20)},
    **{f"volatility_{k}": f"case when count(rt) {over(k)} = {k} then stddev_samp(rt) {over(k)} * sqrt(252) * 100 end" for k in (5, 10, 20)}, **{f"volume_ratio_{k}": f"case when n > {k} and avg(volume) {over(k)} > 0 then volume / avg(volume) {over(k)} end" for k in (5, 10, 20)},
    **{f"ma_ratio_{k}": f"case when n > {k} then (price - avg(price) {over(k)}) / avg(price) {over(k)} * 100 end" for k in (10, 20, 50)},
    "price_percentile_20": f"case when n > 20 then (2 * len(list_filter(list(price) {over(20)}, lambda x: x < price)) + len(list_filter(list(price) {over(20)}, lambda x: x = price)) + 1) * 50 / 20 end",
    "volatility_ratio_5_20": f"case when count(rt) {over(20)} = 20 and stddev_samp(rt) {over(20)} > 0 then stddev_samp(rt) {over(5)} / stddev_samp(rt) {over(20)} end",
    "volume_trend": f"case when n > 10 and avg(volume) over (partition by symbol order by ts rows between 9 preceding and 5 preceding) > 0 then (avg(volume) {over(5)} - avg(volume) over (partition by symbol order by ts rows between 9 preceding and 5 preceding)) / avg(volume) over (partition by symbol order by ts rows between 9 preceding and 5 preceding) end",
    "price_volume_correlation": f"case when n > 20 then corr(dp, dv) {over(19)} end", "crypto_volatility_adjusted": "case when asset_type = 'crypto' then volatility * 1.5 end",
}
VECTOR_SQL = f"""{SNAPS_SQL}, w0 as (select *, change_pct / 100 as rt, price - {lag('price')} as dp, volume - {lag('volume')} as dv, row_number() over (partition by symbol order by ts) as n from snaps),
    w1 as (select symbol, ts, asset_type, volume, {', '.join(f'({sql})::double as {name}' for name, sql in sorted(_OF.items()) if name not in ('rsi', 'macd', 'volatility'))}, rsi, macd, volatility from w0),
    w2 as (select symbol, ts, asset_type, volume, unnest([{', '.join(f"{{'name': '{name}', 'value': {name}}}" for name in sorted(_OF))}]) as f from w1),
    w3 as (select symbol, ts, asset_type, volume, f.name as name, f.value as value from w2 where f.value is not null and not isnan(f.value))"""
SCALED_SQL = f"""{VECTOR_SQL}, w4 as (select symbol, ts, quantile_cont(value, 0.5) as m, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) as q from w3 group by symbol, ts),
    w5 as (select w3.*, greatest(-1e6, least(1e6, (value - m) / case when q > 0 then q else 1.0 end)) as z from w3 join w4 using (symbol, ts))"""


def market(spark, d):
    return ft.market(snaps(spark, d))


def short(spark, d):
    from tickloom.functions.windows import in_order

    return ft.market_short(snaps(spark, d).withColumn("liquidity", (F.row_number().over(in_order()) % 10) / 10))


def exploded(rows):
    return rows.select("symbol", "ts", F.explode("features").alias("_f")).select("symbol", "ts", "_f.name", "_f.value")


_W = lambda n, agg, col: f"case when count({col}) over (partition by symbol order by i rows {n - 1} preceding) = {n} then {agg} over (partition by symbol order by i rows {n - 1} preceding) end"
_LAG = lambda col, k: f"lag({col}, {k}) over (partition by symbol order by i)"
DECISION_SQL = f"""with recursive {SNAPS_SQL}, i as (select symbol, ts, price * 1.01 as high, price * 0.99 as low, price as close, volume, row_number() over (partition by symbol order by ts) - 1 as i from snaps), {ADX_TABLES}, {RSI_TABLES}, {MACD_TABLES},
    q0 as (select *, i::double as x, case when close > 0 and {_LAG('close', 1)} > 0 then ln(close / {_LAG('close', 1)}) end as ret, (close > {_LAG('close', 1)})::int as rose, (close < {_LAG('close', 1)})::int as fell, close / {_LAG('close', 20)} - 1 as m20, close / {_LAG('close', 60)} - 1 as m60 from i),
    q1 as (select *, coalesce(rose = 1 and {_LAG('rose', 1)} = 1, false) as hh, coalesce(fell = 1 and {_LAG('fell', 1)} = 1, false) as ll, {_W(5, 'avg(close)', 'close')} as mid, {_W(5, 'stddev_pop(close)', 'close')} as dev from q0),
    q2 as (select *, ({_W(20, 'stddev_pop(ret)', 'ret')}) * sqrt(252) as vol, {_W(20, 'avg(ret)', 'ret')} as mean_ret, ({_W(14, 'regr_slope(close, x)', 'close')}) / first_value(close) over (partition by symbol order by i rows 13 preceding) as slope, {_W(14, 'regr_r2(close, x)', 'close')} as fit,
        count(*) filter (where hh) over (partition by symbol order by i rows 17 preceding) as nh, count(*) filter (where ll) over (partition by symbol order by i rows 17 preceding) as nl from q1),
    q3 as (select q2.*, coalesce(adx.v, 25.0) as adx_, coalesce(case when ga.v + lo.v > 0 then 100 * ga.v / (ga.v + lo.v) when ga.v is not null then 0.0 end, 50.0) as rsi_, coalesce(mm.d - mm.v, 0.0) as hist, coalesce(case when dev > 0 then (close - mid + 2 * dev) / (4 * dev) when dev = 0 then 0.5 end, 0.5) as place, coalesce(m20, 0.0) as mo
        from q2 left join adx using (symbol, i) left join ga using (symbol, i) left join lo using (symbol, i) left join mm using (symbol, i) where vol is not null),
    q4 as (select *, case when vol > 0.3 then 'VOLATILE' when mean_ret > 0.001 and slope > 0.001 then case when abs(slope) > 0.01 then 'BREAKOUT' else 'BULL' end when mean_ret < -0.001 and slope < -0.001 then case when abs(slope) > 0.01 then 'BREAKDOWN' else 'BEAR' end
            when nh > 0 and nl = 0 then 'ACCUMULATION' when nl > 0 and nh = 0 then 'DISTRIBUTION' else 'SIDEWAYS' end as r1,
        case when vol > 0.3 then least(0.9, vol / 0.3 * 0.7) when (mean_ret > 0.001 and slope > 0.001) or (mean_ret < -0.001 and slope < -0.001) then case when abs(slope) > 0.01 then least(0.9, abs(slope) * 50) else 0.7 end else 0.6 end as c1,
        case when adx_ > 25 then case when rsi_ > 60 and hist > 0 then 'BULL' when rsi_ < 40 and hist < 0 then 'BEAR' else 'VOLATILE' end when adx_ < 20 then case when place > 0.8 then 'DISTRIBUTION' when place < 0.2 then 'ACCUMULATION' else 'SIDEWAYS' end when mo > 0.05 then 'BULL' when mo < -0.05 then 'BEAR' else 'SIDEWAYS' end as r2,
        case when adx_ > 25 then case when (rsi_ > 60 and hist > 0) or (rsi_ < 40 and hist < 0) then least(0.9, abs(rsi_ - 50) / 50 * 0.8) else 0.7 end when adx_ < 20 then case when place > 0.8 or place < 0.2 then 0.6 else 0.7 end else 0.6 end as c2,
        case when vol >= 0.2 then 'VOLATILE' when vol < 0.1 and m60 > 0 then 'ACCUMULATION' else 'SIDEWAYS' end as r3, case when vol >= 0.4 then 0.9 when vol >= 0.2 then 0.7 when vol < 0.1 then 0.6 else 0.4 end as c3,
        case when slope > 0.001 then case when slope > 0.02 then 'BREAKOUT' else 'BULL' end when slope < -0.001 then case when slope < -0.02 then 'BREAKDOWN' else 'BEAR' end else 'SIDEWAYS' end as r4,
        least(0.9, coalesce(fit, 0.0) * 0.8 + 0.3) * case when abs(slope) > 0.02 then 1.0 when abs(slope) > 0.001 then 0.8 else 0.6 end as c4 from q3),
    q5 as (select symbol, ts, unnest([{{'n': r1, 'w': 0.3 * c1}}, {{'n': r2, 'w': 0.25 * c2}}, {{'n': r3, 'w': 0.2 * c3}}, {{'n': r4, 'w': 0.15 * c4}}]) as v from q4), q6 as (select symbol, ts, v.n as name, round(sum(v.w) / 0.9, 9) as w from q5 group by all),
    q7 as (select *, row_number() over (partition by symbol, ts order by w desc, name) as rn, lead(name) over (partition by symbol, ts order by w desc, name) as name2, lead(w) over (partition by symbol, ts order by w desc, name) as w2 from q6)
    select s.symbol, s.ts, name as regime, {r('w::double', 'regime_confidence')}, case when w2 > 0.7 * w then name2 end as regime_second, case when w > 0.85 then 'VERY_STRONG' when w > 0.75 then 'STRONG' when w > 0.65 then 'MODERATE' when w is not null then 'WEAK' end as strength from snaps s left join q7 on q7.symbol = s.symbol and q7.ts = s.ts and rn = 1"""


def register(reg: Registry) -> None:
    cols = (*ft.MARKET, "agreement")
    reg.add("feat_market", lambda spark, d: rounded(market(spark, d)), f"with {MARKET_SQL} select ts, {', '.join(r(f'({c})::double', c) for c in cols)}, n from fm")
    diff = ", ".join(r(CLIP(f"({c} - first({c} order by ts) over (order by ts rows between unbounded preceding and unbounded following))", -3, 3), c) for c in ft.MARKET)
    reg.add("feat_against_first", lambda spark, d: rounded(ft.against_first(market(spark, d)).select("ts", *ft.MARKET)), f"with {MARKET_SQL}, o as (select ts, {', '.join(f'({c})::double as {c}' for c in ft.MARKET)} from fm) select ts, {diff} from o")
    sc = ("change_mean", "change_std", "volatility_mean", "volatility_std", "volume_mean", "coherence", "liquidity", "sentiment_mean")
    reg.add("feat_market_short", lambda spark, d: rounded(short(spark, d)), f"with {SHORT_SQL} select ts, {', '.join(r(f'({c})::double', c) for c in sc)} from fs")
    reg.add("feat_volume_trend", lambda spark, d: rounded(ft.volume_trend(snaps(spark, d))), f"with {SNAPS_SQL}, v as (select *, row_number() over (partition by symbol order by ts desc) as n from snaps), w as (select symbol, avg(volume) filter (where n <= 5) as a, avg(volume) filter (where n > 5) as b from v group by symbol) select symbol, {r('case when b > 0 then (a - b) / b else 0.0 end', 'volume_trend')} from w")
    tree = lambda chg, vol, act, sen: f"case when abs({chg}) > 2 and {chg} > 0 then case when {vol} > 30 then 'BREAKOUT' else 'BULL' end when abs({chg}) > 2 and {chg} < 0 then case when {vol} > 30 then 'BREAKDOWN' else 'BEAR' end when {vol} > 40 then 'VOLATILE' when abs({chg}) < 0.5 then case when {act} and {sen} > 0.1 then 'ACCUMULATION' when {act} and {sen} < -0.1 then 'DISTRIBUTION' else 'SIDEWAYS' end else 'SIDEWAYS' end"

    def trees(spark, d):
        s = snaps(spark, d).where("volatility is not null")
        c = F.col
        return s.select(
            "symbol", "ts", ft.regime_tree(c("change_pct"), c("volatility") - 10, c("volume") / 2e6, c("sentiment")).alias("tree"), ft.regime_tree_by_volume(c("change_pct"), c("volatility") - 10, c("volume_ratio") - 1).alias("by_volume"),
            ft.regime_tree_short(c("change_pct"), c("volatility") / 20, F.abs("change_pct") * 2, c("volatility") / 20, c("volume") / 2e6, c("rsi") / 100, c("sentiment")).alias("short"),
        )

    reg.add("feat_regime_trees", trees, f"""with {SNAPS_SQL}, t as (select *, volatility - 10 as v, volume / 2e6 as a, volume_ratio - 1 as tr, abs(change_pct) * 2 as sv, volatility / 20 as st from snaps where volatility is not null)
        select symbol, ts, {tree('change_pct', 'v', 'a > 0.6', 'sentiment')} as tree, {tree('change_pct', 'v', 'abs(tr) > 0.2', 'tr')} as by_volume,
        case when change_pct > 2 and sv < 3 and sentiment > 0.3 then 'BULL' when change_pct > 0.5 and st > 2 and a > 0.7 then 'BREAKOUT' when change_pct < -2 and sv > 4 then 'BEAR' when change_pct < -0.5 and st > 2 then 'BREAKDOWN' when sv > 5 and st > 2 then 'VOLATILE'
        when abs(change_pct) < 0.3 and rsi / 100 > 0.7 and a > 0.6 then 'ACCUMULATION' when abs(change_pct) < 0.3 and rsi / 100 < 0.4 then 'DISTRIBUTION' else 'SIDEWAYS' end as short from t""")

    def adaptive(spark, d):
        s = snaps(spark, d)
        found = ft.adaptive(F.col("rsi") / 60, F.col("confidence") / 100, F.col("regime") == "BREAKOUT")
        out = s.withColumns(found).withColumn("size", ft.decayed(F.col("confidence"), F.hour("ts").cast("double")))
        out = out.withColumn("trusted", ft.context_confidence(F.col("confidence") / 100, F.abs("sentiment"), F.col("rsi") / 100, F.col("momentum")))
        return rounded(out.select("symbol", "ts", "threshold", "rate", "size", "trusted"))

    sized = "(confidence * pow(0.98, hour(ts)))"
    trusted = "(confidence / 100 * (0.7 + 0.3 * coalesce(abs(sentiment), 1.0)) * (0.8 + 0.2 * rsi / 100) * case when momentum > 0.1 then 0.9 else 1.0 end)"
    reg.add("feat_adaptive", adaptive, f"""with {SNAPS_SQL} select symbol, ts, {r("case when regime = 'BREAKOUT' then 0.75 * 0.9 when rsi / 60 > 0.9 then 0.75 * 1.05 when rsi / 60 < 0.7 then 0.75 * 0.95 else 0.75 end::double", 'threshold')},
        {r("case when regime = 'BREAKOUT' then 0.14 * 1.5 when confidence / 100 > 0.8 then 0.14 * 0.8 when confidence / 100 < 0.6 then 0.14 * 1.2 else 0.14 end::double", 'rate')}, {r(f'case when {sized} < 1 then 1.0 else {sized} end', 'size')}, {r(CLIP(trusted, 0.1, 1.0), 'trusted')} from snaps""")
    reg.add("feat_drift_trend", lambda spark, d: rounded(ft.drift_trend(snaps(spark, d).select("symbol", "ts", (F.col("volume_ratio")).alias("score")).where("score is not null")).select("symbol", "ts", "drift_trend")), f"with {SNAPS_SQL}, d as (select symbol, ts, volume_ratio as score, row_number() over (partition by symbol order by ts) as i from snaps where volume_ratio is not null) select symbol, ts, {r(f'case when count(score) {over(10)} = 10 then regr_slope(score, i) {over(10)} else 0.0 end', 'drift_trend')} from d")

    reg.add("feat_symbol", lambda spark, d: rounded(exploded(ft.symbol_features(snaps(spark, d)))), f"with {VECTOR_SQL} select symbol, ts, name, {r('value', 'value')} from w3")
    reg.add("feat_scaled", lambda spark, d: rounded(exploded(ft.scaled(ft.symbol_features(snaps(spark, d)))), 5), f"with {SCALED_SQL} select symbol, ts, name, {r('z', 'value', 5)} from w5")
    weight = "case when name like '%momentum%' or name like '%trend%' then 1.2 when name like '%volatility%' or name like '%volume%' then 1.1 else 1.0 end"
    reg.add("feat_selected", lambda spark, d: exploded(ft.selected(ft.scaled(ft.symbol_features(snaps(spark, d))), 8)).groupBy("symbol", "name").agg(F.count("*").alias("times")), f"with {SCALED_SQL}, s as (select * from w5 qualify row_number() over (partition by symbol, ts order by round(-abs(z) * 0.5 * {weight}, 9), name) <= 8) select symbol, name, count(*) as times from s group by symbol, name")

    def trust(spark, d):
        out = ft.symbol_features(snaps(spark, d))
        age = (F.unix_timestamp(F.lit("2024-01-30 12:00:00")) - F.unix_timestamp(F.col("ts").cast("timestamp"))) / 3600
        return rounded(out.select("symbol", "ts", F.size("features").cast("long").alias("n"), ft.confidence(F.col("features"), F.col("volume"), age).alias("confidence")))

    reg.add("feat_confidence", trust, f"""with {VECTOR_SQL}, c as (select symbol, ts, count(*) as n, count(*) filter (where value <> 0) as k, any_value(volume) as volume, (epoch(timestamp '2024-01-30 12:00:00') - epoch(ts)) / 3600 as age from w3 group by symbol, ts),
        x as (select *, 0.8 * (0.5 + 0.5 * k / n) + case when volume > 0 then 0.1 else 0.0 end + case when age < 1 then 0.1 when age > 24 then -0.1 else 0.0 end as s from c) select symbol, ts, n, {r(CLIP('s', 0.1, 1.0), 'confidence')} from x""")
    codes = "case asset_type " + " ".join(f"when '{k}' then {v}" for k, v in ft.ASSET_CODES.items()) + " else 0.5 end::double as asset_code"
    reg.add("feat_fallback", lambda spark, d: rounded(ft.fallback(snaps(spark, d))), f"with {SNAPS_SQL} select symbol, ts, {r('price', 'price')}, {r('coalesce(change_pct, 0.0)', 'change_pct')}, {r('volume', 'volume')}, {r('coalesce(rsi, 50.0)', 'rsi')}, {r('coalesce(volatility, 20.0)', 'volatility')}, {codes}, 0.3::double as confidence from snaps")
    reg.add("feat_spectral", lambda spark, d: rounded(ft.spectral(snaps(spark, d))))

    def vote(spark, d):
        c = F.col
        s = snaps(spark, d).withColumn("place", F.when(c("bb_upper") > c("bb_lower"), (c("price") - c("bb_lower")) / (c("bb_upper") - c("bb_lower"))))
        return rounded(s.withColumns(regimes.technical_vote(c("volatility") / 2, c("rsi"), c("macd"), c("place"), c("momentum"))).select("symbol", "ts", "technical_regime", "technical_confidence"))

    place = "case when bb_upper > bb_lower then (price - bb_lower) / (bb_upper - bb_lower) end"
    def index_bars(spark, d):
        p = F.col("price")
        return snaps(spark, d).select("symbol", "ts", (p * 1.01).alias("high"), (p * 0.99).alias("low"), p.alias("close"), "volume")

    reg.add("regime_decision", lambda spark, d: rounded(regimes.decision(index_bars(spark, d))), DECISION_SQL)
    reg.add("regime_technical_vote", vote, f"""with {SNAPS_SQL}, v as (select *, volatility / 2 as adx, {place} as place, (rsi > 60 and macd > 0) or (rsi < 40 and macd < 0) as sided from snaps)
        select symbol, ts, case when adx > 25 then case when rsi > 60 and macd > 0 then 'BULL' when rsi < 40 and macd < 0 then 'BEAR' else 'VOLATILE' end when adx < 20 then case when place > 0.8 then 'DISTRIBUTION' when place < 0.2 then 'ACCUMULATION' else 'SIDEWAYS' end
            when adx is not null then case when momentum > 0.05 then 'BULL' when momentum < -0.05 then 'BEAR' else 'SIDEWAYS' end end as technical_regime,
        {r("case when adx > 25 then case when sided then least(0.9, abs(rsi - 50) / 50 * 0.8) else 0.7 end when adx < 20 then case when place > 0.8 or place < 0.2 then 0.6 else 0.7 end when adx is not null then 0.6 end::double", 'technical_confidence')} from v""")
