"""Queries of strategies over snapshots, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators import strategies as st
from tickloom.plans.base import Registry, lag, over, r, rounded
from tickloom.plans.snapshot_sql import SNAPS_SQL, snaps

ONE = lambda x: f"least(1.0, {x})"
CAP = lambda x: f"case when {x} > 1 then 1.0 else {x} end"


def pts(*rules: tuple[str, float]) -> str:
    return " + ".join(f"case when {cond} then {worth} else 0.0 end" for cond, worth in rules)


def named(column: str, values: dict, other) -> str:
    text = lambda v: f"'{v}'" if isinstance(v, str) else "null" if v is None else f"{v}::double"
    return f"case {column} " + " ".join(f"when '{k}' then {text(v)}" for k, v in values.items()) + f" else {text(other)} end"


def shown(*columns: str, digits: int = 6) -> str:
    """Columns as they are, those with a star rounded."""
    return ", ".join(r(f"({c[1:]})::double", c[1:], digits) if c.startswith("*") else c for c in columns)


STOP = f"({named('asset_type', st.STOPS, 0.05)} * case when volatility > 20 then 1.5 else 1.0 end)"
PAST = "over (partition by symbol order by ts rows between {} preceding and {} preceding)"

BULL_SQL = f"""b0 as (select *, sum(case when change_pct > 0 then 1 else 0 end) {over(3)} as rises, count(change_pct) {over(5)} as known from snaps),
    b1 as (select *, {ONE(pts(('change_pct > 1', 0.4), ('change_pct > 2', 0.3), ('momentum > 0', 0.3), ('known >= 3 and rises >= 2', 0.2)))} as momentum_part, {ONE(pts(('volume > 0', 0.7), ('volume > 1000000', 0.3)))} as volume_part,
        {ONE(pts(('rsi between 35 and 75', 0.4), ('rsi between 50 and 70', 0.2), ('macd > 0', 0.3), ('price > (bb_upper + bb_lower) / 2', 0.1)))} as technical_part,
        {CAP("confidence / 100 + case when regime = 'BULL' and confidence > 85 then 0.2 when regime = 'BREAKOUT' and confidence > 80 then 0.3 else 0.0 end")} as regime_part,
        case when sentiment is null then 0.5 when sentiment > 0.1 then least(sentiment + 0.5, 1.0) when sentiment > 0 then 0.5 else 0.2 end as sentiment_part from b0),
    b2 as (select *, {CAP("(0.30 * momentum_part + 0.20 * volume_part + 0.25 * technical_part + 0.15 * regime_part + 0.10 * sentiment_part) * case asset_type when 'crypto' then 0.9 when 'forex' then 1.1 when 'commodity' then 1.05 else 1.0 end")} as s from b1),
    b3 as (select *, coalesce(regime in ('BULL', 'BREAKOUT') and confidence >= 75 and s >= 0.7, false) as raw from b2),
    b4 as (select *, max(case when raw then ts end) over (partition by symbol order by ts rows between unbounded preceding and 1 preceding) as before from b3),
    b5 as (select *, raw and coalesce(epoch(ts) - epoch(before) < 3600, false) as recent_entry, raw and not coalesce(epoch(ts) - epoch(before) < 3600, false) as taken from b4),
    b6 as (select *, case when taken then price * (1 - {STOP}) end as stop, case when taken then least(95.0, confidence * s) end as sc from b5)"""

BEAR_SQL = f"""a0 as (select *, {ONE(pts(('change_pct < -2', 0.5), ('change_pct < -4', 0.3), ('momentum < 0', 0.2)))} as breakdown_part, {ONE(pts(('volatility > 25', 0.6), ('volatility > 37.5', 0.4), ('volume > 0', 0.3)))} as volatility_part,
        greatest(0.0, {pts(('rsi > 70', 0.4), ('rsi < 30', -0.3), ('macd < 0', 0.3), ('price > bb_upper * 0.95', 0.3))}) as technical_part, confidence / 100 * case when regime = 'BREAKDOWN' then 1.2 else 1.0 end as regime_part,
        case when sentiment is null then 0.5 when sentiment < -0.2 then 1.0 when sentiment < 0 then 0.7 else 0.2 end as sentiment_part,
        list_filter([case regime when 'BEAR' then 0.7::double when 'BREAKDOWN' then 0.9 when 'VOLATILE' then 0.6 end, case when volatility is not null then least(volatility / 50, 1.0) end, case when sentiment is not null then least(greatest(-sentiment, 0.0) / 0.5, 1.0) end], lambda x: x is not null) as known from snaps),
    a1 as (select *, case when confidence is not null then {ONE('0.35 * breakdown_part + 0.25 * volatility_part + 0.20 * technical_part + 0.15 * regime_part + 0.05 * sentiment_part')} end as s, case when len(known) > 0 then list_avg(known) else 0.5 end as stress from a0),
    a2 as (select *, case when regime in ('BEAR', 'BREAKDOWN', 'VOLATILE') and confidence >= 80 and s > 0.7 then case when s >= 0.9 then 'STRONG_SELL' else 'SELL' end
        when regime in ('BEAR', 'VOLATILE') and confidence > 75 and stress > 0.6 then 'HEDGE' when regime in ('BEAR', 'BREAKDOWN') and confidence > 70 then 'REDUCE' end as signal from a1),
    a3 as (select *, signal in ('SELL', 'STRONG_SELL') as sells, case when signal in ('SELL', 'STRONG_SELL') then price * (1 + 0.05 * case asset_type when 'crypto' then 2.0 when 'forex' then 0.5 else 1.0 end) end as stop,
        case when signal in ('SELL', 'STRONG_SELL') then least(95.0, confidence * s) when signal is not null then confidence end as sc from a2)"""


def sized(price: str, stop: str, confidence: str, risk: float, most: float) -> str:
    return f"least(coalesce(case when abs({price} - {stop}) > 0 then 100000.0 * {risk} / abs({price} - {stop}) when {stop} is not null then 0.0 end * {price}, 5000.0) * least({confidence} / 100, 1.0), {100000.0 * most})"


SIDE = "case when change_pct > 0 then 'BUY' else 'SELL' end"
RULES_SQL = {
    "momentum": "case when regime in ('BULL', 'BREAKOUT') and change_pct > 1 and rsi < 70 then case when change_pct > 2 then 'STRONG_BUY' else 'BUY' end end",
    "defensive": "case when regime in ('BEAR', 'BREAKDOWN') and (change_pct < -1 or rsi > 70) then case when change_pct > -2 then 'SELL' else 'STRONG_SELL' end end",
    "volatility": f"case when regime = 'VOLATILE' and volatility > 30 and abs(change_pct) > 2 then {SIDE} end", "breakout": "case when regime = 'BREAKOUT' and price > bb_upper then 'STRONG_BUY' end",
    "range": "case when regime = 'SIDEWAYS' then case when price <= bb_lower then 'BUY' when price >= bb_upper then 'SELL' end end", "crypto_volatility": f"case when asset_type = 'crypto' and volatility > 40 and abs(change_pct) > 5 then {SIDE} end",
    "forex_carry": "case when asset_type = 'forex' and abs(change_pct) < 0.5 then 'HOLD' end", "mean_reversion": "case when rsi > 75 then 'SELL' when rsi < 25 then 'BUY' end",
    "trend_up": "case when change_pct > 1 and rsi < 70 and volume > 0 and confidence > 75 then case when confidence > 85 then 'STRONG_BUY' else 'BUY' end end",
    "trend_down": "case when change_pct < -1.5 and rsi > 30 and confidence > 75 then case when confidence > 85 then 'STRONG_SELL' else 'SELL' end end",
    "bands": "case when price <= bb_lower * 1.02 and rsi < 30 then 'BUY' when price >= bb_upper * 0.98 and rsi > 70 then 'SELL' end", "sure_volatility": f"case when volatility > 30 and abs(change_pct) > 2 and confidence > 80 then {SIDE} end",
    "surge": "case when change_pct > 3 and volume > 0 and confidence > 80 then 'BUY' end", "plunge": "case when change_pct < -3 and volume > 0 and confidence > 80 then 'SELL' end",
    "accumulate": "case when abs(change_pct) < 1 and rsi > 35 and rsi < 65 and volume > 0 then 'BUY' end", "distribute": "case when abs(change_pct) < 0.5 and rsi > 60 then 'SELL' end",
}
SPOKEN_SQL = "spoken as (" + " union all ".join(f"select symbol, ts, asset_type, price, volatility, '{n}' as rule, {sql} as signal, confidence * {st.RULE_CONFIDENCE.get(n, 1.0)} as confidence from snaps where {sql} is not null" for n, sql in RULES_SQL.items()) + ")"

SHARE = lambda v, n: f"(len(list_filter(list({v}) {over(n)}, lambda x: x < {v})) / len(list_filter(list({v}) {over(n)}, lambda x: x is not null)))"
CRYPTO_SQL = f"""c0 as (select *, coalesce(volatility, 20.0) as v, coalesce(sentiment, 0.0) * (2.0::double / 3) as se, coalesce({named("regexp_replace(symbol, '-USD|USD$|-', '', 'g')", st.CATEGORIES, None)}, 'altcoin_mid') as category from snaps),
    c1 as (select *, tanh(2 * coalesce(change_pct, 0.0) / 100 * least(2.0, v / 30) * {named('regime', st.REGIME_MOMENTUM, 1.0)}) as momentum_score,
        greatest(-1.0, least(1.0, se + 0.5 * case when count(se) {over(6)} = 6 then avg(se) {over(3)} - avg(se) {PAST.format(5, 3)} else 0.0 end)) as sentiment_score, case when count(v) {over(100)} > 10 then {SHARE('v', 100)} else 0.5 end as p from c0),
    c2 as (select *, case when v > 50 then p * 0.5 else (p - 0.5) * 0.2 end as volatility_score from c1),
    c3 as (select *, greatest(-1.0, least(1.0, momentum_score * {named('category', {k: w[0] for k, w in st.CATEGORY_WEIGHTS.items()}, 0.6)} + sentiment_score * {named('category', {k: w[1] for k, w in st.CATEGORY_WEIGHTS.items()}, 0.3)}
        + volatility_score * {named('category', {k: w[2] for k, w in st.CATEGORY_WEIGHTS.items()}, 0.1)})) as combined_score from c2)"""
CRYPTO_SIGNAL_SQL = f"""{CRYPTO_SQL}, c4 as (select *, case when combined_score > 0.6 then 'STRONG_BUY' when combined_score > 0.3 then 'BUY' when combined_score < -0.6 then 'STRONG_SELL' when combined_score < -0.3 then 'SELL' end as s0,
        confidence * abs(combined_score) * {named('category', {'bitcoin': 1.1, 'meme': 0.8}, 1.0)} * case when hour(ts) between 2 and 6 then 0.8 when hour(ts) between 13 and 21 then 1.2 else 1.0 end * case when isodow(ts) >= 6 then 0.9 else 1.0 end
        * case when volatility > 100 then case when category in ('altcoin_small', 'meme') then 0.6 else 0.8 end else 1.0 end as sc from c3),
    c5 as (select *, coalesce(s0 is not null and sc >= 0.3 and category <> 'stablecoin', false) as taken from c4)"""

VOL_SQL = f"""v0 as (select *, volatility / 100 as v, change_pct / 100 as rt from snaps), v1 as (select *, {lag('v')} as b, {lag('v', 5)} as v5 from v0),
    v2 as (select *, case when count(v) {over(60)} >= 20 and stddev_samp(v) {over(60)} > 0 then (v - avg(v) {over(60)}) / stddev_samp(v) {over(60)} end as vol_z, case when count(v) {over(60)} >= 20 and v is not null then {SHARE('v', 60)} end as vol_rank,
        case when v5 > 0 then v / v5 - 1 end as vol_trend, case when count(case when b is not null then v end) {over(60)} >= 20 then 1 - regr_slope(v, b) {over(60)} end as vol_speed, case when count(rt) {over(5)} = 5 then sum(rt) {over(5)} end as move from v1),
    v3 as (select *, case when vol_trend > 0.1 then 'EXPANDING' when vol_trend < -0.1 then 'CONTRACTING' when vol_z > 3 then 'EXTREME' when vol_rank <= 0.15 then 'LOW' when vol_rank >= 0.95 then 'HIGH' when vol_rank is not null then 'NORMAL' end as vol_regime from v2),
    v4 as (select *, case when count(vol_regime) {over(10)} = 10 then len(list_filter(list(vol_regime) {over(10)}, lambda x: x = vol_regime)) / 10 end as persistence from v3),
    v5 as (select *, case when vol_regime in ('HIGH', 'EXTREME') and vol_speed >= 0.5 then case when vol_z > 2 then 'SELL' when vol_z < -2 then 'BUY' end end as s1,
        case when vol_regime not in ('HIGH', 'EXTREME') and vol_trend > 0 and vol_z >= 1.5 then case when move > 0.02 then 'BUY' when move < -0.02 then 'SELL' end end as s2 from v4),
    v6 as (select *, coalesce(s1, s2) as signal, case when s1 is not null then 'mean_reversion' when s2 is not null then 'breakout' end as rule from v5),
    v7 as (select *, least(95.0, case rule when 'mean_reversion' then least(95.0, 50 + abs(vol_z) * 10) when 'breakout' then least(90.0, 60 + vol_z * 10) end * case when persistence > 0.8 then 1.1 when persistence < 0.3 then 0.9 else 1.0 end) as sc0,
        0.02 * case when v > 0 then greatest(0.5, least(3.0, 0.2 / v)) else 1.0 end as size0, v * 2 / sqrt(252) as away, case when signal = 'BUY' then 1.0 else -1.0 end as sg from v6),
    v8 as (select *, case when signal is not null then sc0 end as signal_confidence, case when signal is not null then size0 end as size, case when signal is not null then price * (1 - sg * away) end as stop, case when signal is not null then price * (1 + sg * away * 3) end as target,
        case when signal is not null then v / sqrt(252) <= 0.05 and sc0 >= 60 and size0 <= 0.1 end as valid from v7)"""

BREAK_SQL = f"""k0 as (select *, max(price) {PAST.format(20, 1)} as top, min(price) {PAST.format(20, 1)} as low, count(price) {PAST.format(20, 1)} as n, list(price) {PAST.format(20, 1)} as seen, sum(change_pct) {over(3)} as three,
        (volatility - avg(volatility) {over(100)}) / nullif(stddev_samp(volatility) {over(100)}, 0) as z from snaps),
    k1 as (select *, 1 + coalesce(len(list_filter(seen, lambda x: x >= top * 0.995 or x <= low * 1.005)), 0) as touches, top - low as height, price * volatility / 100 / sqrt(252) * 5 as swing, case when three > 0 then 1.0 else -1.0 end as way from k0),
    k2 as (select *, least(1.0, touches / 5) as strength from k1),
    k3 as (select *, 40 * strength + case when volume_ratio > 2 then 30.0 when volume_ratio > 1.5 then 20.0 when volume_ratio > 1.2 then 10.0 else 0.0 end + least(30.0, abs(change_pct / 100) * 1000) as points, least(95.0, 50 + 30 * strength) as sure0 from k2),
    k4 as (select *, case when points >= 80 then 'VERY_STRONG' when points >= 60 then 'STRONG' when points >= 40 then 'MODERATE' else 'WEAK' end as grade from k3),
    k5 as (select symbol, ts, regime, volatility, 'resistance' as kind, 'UP' as direction, grade as quality, top as level, price as entry, price + height as target, top * 0.99 as stop, volume_ratio, change_pct / 100 as momentum, sure0 as sure from k4 where n = 20 and price > top * 1.002
        union all select symbol, ts, regime, volatility, 'support', 'DOWN', grade, low, price, price - height, low * 1.01, volume_ratio, change_pct / 100, sure0 from k4 where n = 20 and price < low * 0.998
        union all select symbol, ts, regime, volatility, 'volatility', case when way > 0 then 'UP' else 'DOWN' end, case when z > 3 then 'STRONG' else 'MODERATE' end, price, price, price + way * swing, price - way * swing / 2, 1.0, z, least(95.0, 50 + z * 10) from k4 where z > 2),
    k6 as (select *, round(case when abs(entry - stop) > 0 then abs(target - entry) / abs(entry - stop) end, 9) as reward_risk, coalesce(volume_ratio >= 1.2, false) as volume_ok, coalesce(abs(momentum) >= 0.01, false) as momentum_ok from k5),
    k7 as (select *, ({named('quality', st.QUALITY_POINTS, 10.0)} + case when reward_risk > 3 then 30.0 when reward_risk > 2 then 20.0 when reward_risk > 1.5 then 10.0 else 0.0 end + case when volume_ok then 15.0 else 0.0 end + case when momentum_ok then 15.0 else 0.0 end)
            * case when (regime in ('BULL', 'BREAKOUT') and direction = 'UP') or (regime in ('BEAR', 'BREAKDOWN') and direction <> 'UP') then 1.3 else 1.0 end as score,
        case when direction = 'UP' then 'BUY' else 'SELL' end as signal, least(95.0, sure + case when volume_ok then 10.0 else 0.0 end + case when momentum_ok then 10.0 else 0.0 end) as signal_confidence,
        least(100.0, case when volume_ok then 40 * least(1.0, volume_ratio / 3) else 0.0 end + case when momentum_ok then 30 * least(1.0, abs(momentum) / 0.05) else 0.0 end + {named('quality', st.CONFIRM_POINTS, 8.0)}) as confirmation,
        case when entry > 0 then abs(target - entry) / entry else 0.0 end as expected_move, case quality when 'VERY_STRONG' then 3 when 'STRONG' then 5 when 'MODERATE' then 5 else 10 end::bigint as horizon,
        level * case when direction = 'UP' then 0.995 else 1.005 end as invalidation,
        concat_ws(',', case when not volume_ok then 'low volume' end, case when not momentum_ok then 'weak momentum' end, case when reward_risk < 1.5 then 'poor reward' end, case when volatility > 30 then 'high volatility' end) as risks,
        ((not volume_ok)::int + (not momentum_ok)::int + coalesce(reward_risk < 1.5, false)::int + coalesce(volatility > 30, false)::int)::int as n_risks,
        least(0.05, 0.025 * {named('quality', st.QUALITY_SIZE, 1.0)}) * case when reward_risk < 2 then 0.7 else 1.0 end as size from k6),
    k8 as (select *, signal_confidence >= 60 and coalesce(reward_risk >= 1, false) and n_risks <= 3 and size <= 0.05 and score >= 40 as valid from k7)"""


def register(reg: Registry) -> None:
    def add(name, step, columns, sql, digits=6):
        plain = [c.lstrip("*") for c in columns]
        reg.add(name, lambda spark, d: rounded(step(snaps(spark, d)).select("symbol", "ts", *plain), digits), f"with {SNAPS_SQL} {sql.format(shown=shown('symbol', 'ts', *columns, digits=digits))}")

    facts = ("*price", "*volume", "*sentiment", "*change_pct", "*momentum", "*rsi", "*macd", "*volatility", "*bb_upper", "*bb_lower", "*volume_ratio", "asset_type", "regime", "*confidence")
    add("snap_enriched", lambda s: s, facts, "select {shown} from snaps")
    parts = ("*momentum_part", "*volume_part", "*technical_part", "*regime_part", "*sentiment_part", "*strength")
    bull_tail = f", b7 as (select * exclude (s, sc), s as strength, sc as signal_confidence, case when taken then case when s >= 0.9 then 'STRONG_BUY' else 'BUY' end end as signal, case when taken then price + 2.5 * abs(price - stop) end as target, case when taken then {sized('price', 'stop', 'sc', 0.025, 0.15)} end as value from b6) "
    add("sig_bull_parts", st.bull, parts, f", {BULL_SQL}{bull_tail} select {{shown}} from b7")
    add("sig_bull", st.bull, ("signal", "*signal_confidence", "*stop", "*target", "*value", "recent_entry"), f", {BULL_SQL}{bull_tail} select {{shown}} from b7")
    bear_tail = f", a4 as (select * exclude (s, sc), s as strength, sc as signal_confidence, case when sells then price - (stop - price) * 2.0 end as target, case when sells then 0.7 * {sized('price', 'stop', 'sc', 0.015, 0.08)} when signal = 'HEDGE' then 5000.0 end as value from a3) "
    add("sig_bear_parts", st.bear, ("*breakdown_part", "*volatility_part", "*technical_part", "*regime_part", "*sentiment_part", "*strength", "*stress"), f", {BEAR_SQL}{bear_tail} select {{shown}} from a4")
    add("sig_bear", st.bear, ("signal", "*signal_confidence", "*stop", "*target", "*value"), f", {BEAR_SQL}{bear_tail} select {{shown}} from a4")

    def levels(s):
        f = st.factors(F.col("rsi"), F.col("macd"), F.col("volatility"), F.col("momentum"), F.col("sentiment"))
        return s.withColumns({
            "rsi_level": st.rsi_level(F.col("rsi")), "volatility_level": st.volatility_level(F.col("volatility")), "sentiment_level": st.sentiment_level(F.col("sentiment")),
            "factors": F.concat_ws(";", F.transform(F.array_sort(F.map_entries(f)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))),
        })

    lv = "case when rsi <= 30 then 'oversold' when rsi >= 70 then 'overbought' when rsi is not null then 'neutral' end"
    vl = "case when volatility < 10 then 'low' when volatility > 30 then 'high' when volatility is not null then 'moderate' end"
    sl = "case when sentiment > 0.3 then 'positive' when sentiment < -0.3 then 'negative' when sentiment is not null then 'neutral' end"
    pairs = [("macd_signal", "case when macd > 0 then 'bullish' when macd is not null then 'bearish' end"), ("momentum_side", "case when momentum > 0 then 'up' when momentum is not null then 'down' end"), ("rsi", "printf('%.4f', rsi)"), ("rsi_condition", lv), ("sentiment_bias", sl), ("volatility_level", vl)]
    add("sig_levels", levels, ("rsi_level", "volatility_level", "sentiment_level", "factors"), f"select symbol, ts, {lv} as rsi_level, {vl} as volatility_level, {sl} as sentiment_level, concat_ws(';', {', '.join(f"'{k}=' || {v}" for k, v in pairs)}) as factors from snaps")

    def spoken(s):
        out = st.rule_signals(s).join(s.select("symbol", "ts", "volatility"), ["symbol", "ts"])
        buys = F.col("signal").isin("BUY", "STRONG_BUY")
        out = out.withColumn("stop", st.stop_loss(F.col("asset_type"), F.col("price"), buys, F.col("volatility")))
        out = out.withColumns({"target": st.take_profit(F.col("price"), F.col("stop"), buys), "value": st.position_value(st.PORTFOLIO, F.col("price"), F.col("stop"), F.col("confidence"))})
        return out.withColumn("reward_risk", st.reward_risk(F.col("price"), F.col("stop"), F.col("target")))

    by_rule = f", {SPOKEN_SQL}, l0 as (select *, signal in ('BUY', 'STRONG_BUY') as buys, price * case when signal in ('BUY', 'STRONG_BUY') then 1 - {STOP} else 1 + {STOP} end as stop from spoken), l1 as (select *, price + case when buys then 2.0 else -2.0 end * abs(price - stop) as target, {sized('price', 'stop', 'confidence', 0.02, 0.1)} as value from l0), l2 as (select *, abs(target - price) / abs(price - stop) as reward_risk from l1) "
    add("sig_rules", spoken, ("rule", "signal", "*confidence", "*stop", "*target", "*value", "*reward_risk"), f"{by_rule} select {{shown}} from l2")
    add("sig_wary", lambda s: st.wary(spoken(s)), ("rule", "signal", "*confidence", "*stop", "note"), f"{by_rule}, l3 as (select symbol, ts, rule, signal, confidence * 0.9 as confidence, price - (price - stop) * 1.5 as stop, 'wary: ' || rule as note from l2) select {{shown}} from l3", digits=8)  # prices end in few digits: at 6 engines break ties apart

    def valid(s):
        one = st.rule_signals(s).groupBy("symbol", "ts", "asset_type", "price").agg(F.max_by(F.struct("rule", "signal", "confidence"), F.struct("confidence", "rule")).alias("_b")).select("symbol", "ts", "asset_type", "price", "_b.*")
        return st.valid(one.withColumn("position_share", F.col("confidence") / 800), seconds=3601, least=50, crypto_least=60)

    add("sig_valid", valid, ("rule", "signal", "*confidence", "reason", "valid"), f""", {SPOKEN_SQL}, m0 as (select * from spoken qualify row_number() over (partition by symbol, ts order by confidence desc nulls last, rule desc) = 1), m1 as (select *, epoch(ts) - epoch({lag('ts')}) as gap from m0),
        m2 as (select *, case when confidence < 50 then 'confidence' when gap < 3601 then 'too_soon' when confidence / 800 > 0.1 then 'size' when asset_type = 'crypto' and confidence < 60 then 'crypto_confidence' when asset_type = 'forex' and hour(ts) > 22 then 'forex_hours' end as reason from m1),
        m3 as (select *, reason is null as valid from m2) select {{shown}} from m3""")

    def limited(s):
        out = spoken(s).drop("stop", "target").withColumn("position_value", F.col("value") * (1 + F.hour("ts") / 24))
        return st.with_limits(out.withColumn("open_value", F.lit(20_000.0) * F.hour("ts")), st.PORTFOLIO, most=0.08, risk=4.0)

    add("sig_limits", limited, ("rule", "signal", "*position_value", "*stop", "*target"), f"""{by_rule}, l3 as (select * exclude (stop, target), value * (1 + hour(ts) / 24) as position_value, case when buys then price * 0.95 when signal in ('SELL', 'STRONG_SELL') then price * 1.05 end as stop,
        case when buys then price * 1.1 when signal in ('SELL', 'STRONG_SELL') then price * 0.9 end as target from l2), l4 as (select * from l3 where position_value <= 8000.0 and 20000.0 * hour(ts) <= 400000.0) select {{shown}} from l4""")

    def filled(s):
        out = spoken(s).withColumn("quantity", st.kelly_size(st.PORTFOLIO, F.col("confidence"), F.col("price"), F.col("stop")) / F.col("price"))
        return out.withColumns(st.fill(F.col("price"), F.col("signal"), F.col("confidence"), F.col("quantity"), F.concat(F.col("symbol"), F.when(F.col("asset_type") == "crypto", "USD").otherwise(""))))

    add("sig_fills", filled, ("rule", "signal", "*quantity", "*fill_price", "*fee"), f"""{by_rule}, l3 as (select *, case when confidence is not null then greatest(0.0, least(0.25, (confidence / 100 * 0.08 - (1 - confidence / 100) * 0.05) / 0.08)) end as kelly, abs(price - stop) / price as lost, 0.0001 * (2 - confidence / 100) as slip from l2),
        l4 as (select *, case when kelly is not null then least(kelly * 100000.0, 100000.0 * 0.02 / lost) end / price as quantity, price * case when buys then 1 + slip else 1 - slip end as fill_price from l3), l5 as (select *, fill_price * quantity * case when asset_type = 'crypto' then 0.001 else 0.0025 end as fee from l4) select {{shown}} from l5""")
    regime_name = "case regime when 'BULL' then 'bull_momentum' when 'BEAR' then 'bear_defensive' when 'VOLATILE' then 'volatility_trading' when 'BREAKOUT' then 'breakout_momentum' else 'range_trading' end"
    engine = f"{named('regime', st.ENGINE, 'range_trading')}"
    add("sig_strategy_choice", lambda s: s.withColumns({"strategy": st.strategy_of(F.col("asset_type"), F.col("regime"), F.col("volatility"), F.col("rsi")), "engine_strategy": st.engine_strategy(F.col("asset_type"), F.col("regime"), F.col("confidence"), F.col("volatility"))}), ("strategy", "engine_strategy"), f"""select symbol, ts,
        case asset_type when 'crypto' then case when volatility > 50 then 'crypto_volatility' when regime in ('BULL', 'BREAKOUT') then 'bull_momentum' else 'volatility_trading' end when 'forex' then 'forex_carry'
        when 'stock' then case when regime = 'SIDEWAYS' and (rsi > 70 or rsi < 30) then 'mean_reversion' when regime = 'BULL' then 'bull_momentum' else 'bear_defensive' end else {regime_name} end as strategy,
        case when asset_type = 'crypto' and volatility > 50 then 'crypto_volatility' when asset_type = 'crypto' and regime in ('BULL', 'BREAKOUT') then 'crypto_momentum' when asset_type = 'forex' then 'forex_carry' when asset_type = 'commodity' and regime = 'VOLATILE' then 'commodity_momentum'
        when confidence < 60 then 'conservative' when confidence > 90 then {engine} || '_aggressive' else {engine} end as engine_strategy from snaps""")
    add("sig_crypto_scores", st.crypto_scores, ("category", "*momentum_score", "*sentiment_score", "*volatility_score", "*combined_score"), f", {CRYPTO_SQL} select {{shown}} from c3")
    add("sig_crypto", st.crypto, ("signal", "kind", "*signal_confidence", "*most_risk"), f""", {CRYPTO_SIGNAL_SQL}, c6 as (select symbol, ts, case when taken then s0 end as signal, case when taken then case s0 when 'STRONG_BUY' then 'MOMENTUM_BUY' when 'BUY' then 'TECHNICAL_BOUNCE' when 'STRONG_SELL' then 'MOMENTUM_SELL' else 'TECHNICAL_BREAKDOWN' end end as kind,
        case when taken then sc end as signal_confidence, case when taken then 0.02 * {named('category', {'meme': 0.5, 'altcoin_small': 0.7}, 1.0)} end as most_risk from c5) select {{shown}} from c6""")
    add("sig_crypto_volatility", st.crypto_volatility, ("*vol_share", "signal", "*signal_confidence", "*stop"), f""", d0 as (select *, coalesce(volatility, 20.0) as v from snaps), d1 as (select *, case when count(v) {over(100)} >= 20 then {SHARE('v', 100)} end as vol_share from d0),
        d2 as (select *, case when vol_share > 0.9 then case when change_pct > 0 then 'STRONG_BUY' else 'STRONG_SELL' end when vol_share < 0.2 and v < 15 and abs(change_pct) > 3 then case when change_pct > 0 then 'SELL' else 'BUY' end end as signal from d1),
        d3 as (select *, case when signal is not null and confidence is not null then confidence * least(1.5, abs(vol_share - 0.5) * 4) end as signal_confidence, case when signal is not null and v > 80 then price * case when signal in ('BUY', 'STRONG_BUY') then 0.95 else 1.05 end end as stop from d2) select {{shown}} from d3""")
    add("sig_crypto_sentiment", st.crypto_sentiment, ("*recent", "*shift", "signal", "*signal_confidence"), f""", e0 as (select *, coalesce(sentiment, 0.0) as se from snaps), e1 as (select *, case when count(se) {over(10)} = 10 then avg(se) {over(5)} end as recent, case when count(se) {over(10)} = 10 then avg(se) {over(5)} - avg(se) {PAST.format(9, 5)} end as shift from e0),
        e2 as (select *, case when recent > 0.6 and shift > 0.1 then 'BUY' when recent < -0.6 and shift < -0.1 then 'SELL' when recent > 0.8 then 'WEAK_SELL' when recent < -0.8 then 'WEAK_BUY' end as signal from e1),
        e3 as (select *, case when signal is not null then confidence * (abs(shift) * 2 + abs(recent) * 0.5) end as signal_confidence from e2) select {{shown}} from e3""")
    add("sig_volatility", st.volatility_signals, ("*vol_z", "*vol_rank", "*vol_trend", "*vol_speed", "vol_regime", "*persistence", "rule", "signal", "*signal_confidence", "*size", "*stop", "*target", "valid"), f", {VOL_SQL} select {{shown}} from v8")
    kept = ("kind", "direction", "quality", "*level", "*entry", "*target", "*stop", "*reward_risk", "volume_ok", "momentum_ok", "*score", "signal", "*signal_confidence", "*confirmation", "*expected_move", "horizon", "*invalidation", "risks", "n_risks", "*size", "valid")
    add("sig_breakouts", st.breakouts, kept, f", {BREAK_SQL} select {{shown}} from k8")
    add("sig_breakout_best", lambda s: st.best_breakout(st.breakouts(s)), ("kind", "direction", "quality", "*score", "signal", "*signal_confidence", "*size"), f", {BREAK_SQL}, k9 as (select * from k8 where valid qualify row_number() over (partition by symbol, ts order by score desc, kind) = 1) select {{shown}} from k9")

    def grades(s):
        touches, width = (F.hour("ts") % 9).cast("int"), (F.col("volume") / 50000).cast("int")
        a, b = F.col("rsi") / 100, F.col("confidence") / 100
        return s.withColumns({"triangle": st.triangle_quality(a, b, touches), "rectangle": st.rectangle_quality(width, touches), "strength": st.level_strength(touches, F.col("confidence"), (F.hour("ts") % 7).cast("double"))})

    add("sig_pattern_grades", grades, ("triangle", "rectangle", "*strength"), """, g0 as (select *, hour(ts) % 9 as t, trunc(volume / 50000) as w, case when rsi is null then confidence / 100 when confidence is null then rsi / 100 else least(rsi, confidence) / 100 end as r, hour(ts) % 7 as ds from snaps),
        g1 as (select *, case when r > 0.8 and t >= 6 then 'VERY_STRONG' when r > 0.6 and t >= 4 then 'STRONG' when r > 0.4 then 'MODERATE' else 'WEAK' end as triangle, case when w >= 30 and t >= 8 then 'VERY_STRONG' when w >= 20 and t >= 6 then 'STRONG' when w >= 15 and t >= 4 then 'MODERATE' else 'WEAK' end as rectangle,
        least(1.0, (least(1.0, t / 5) + least(1.0, confidence / 100) * 0.8 + case when ds < 5 then 1.2 * (5 - ds) / 5 else 0.0 end) / 3) as strength from g0) select {shown} from g1""")
