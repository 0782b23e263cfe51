"""Queries of trading ranges. Levels of peaks are an iteration without SQL; what is made of them has SQL, over the Bollinger bands in place of levels."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators import ranges
from tickloom.plans.base import Registry, full, lag, r, rounded
from tickloom.plans.snapshot_sql import SNAPS_SQL, snaps
from tickloom.sources.market import latest


def rows(spark, d):
    p = F.col("price")
    return snaps(spark, d).select("symbol", "ts", p.alias("close"), (p * 1.002).alias("high"), (p * 0.998).alias("low"), "volume", "bb_upper", "bb_lower", "confidence")


def state(spark, d):
    """Each row with the bands as its range."""
    s = ranges.conditions(rows(spark, d)).where("bb_upper is not null and bb_upper > bb_lower")
    hour = F.hour("ts").cast("double")
    return s.select(
        "symbol", "ts", F.col("close").alias("price"), "momentum_4", "may_buy", "may_sell", F.col("bb_lower").alias("support"), F.col("bb_upper").alias("resistance"), F.col("confidence").alias("quality"), (hour * 4).cast("long").alias("bars"),
        (hour / 24).alias("reversion"), F.when(F.hour("ts") % 12 == 0, 0.9).otherwise(0.3).alias("breakout_probability"),
    )


CONDITIONS_SQL = f"""{SNAPS_SQL}, q0 as (select symbol, ts, price as close, volume, bb_upper, bb_lower, confidence, price - {lag('price')} as d, price / {lag('price', 4)} - 1 as momentum_4, {full(10, 'avg(volume)', 'volume')} as mean from snaps),
    q1 as (select *, {full(14, 'avg(greatest(d, 0.0))', 'd')} as g, {full(14, 'avg(greatest(-d, 0.0))', 'd')} as l from q0), q2 as (select *, case when l > 0 then 100 - 100 / (1 + g / l) when g > 0 then 100.0 end as rsi from q1),
    q3 as (select *, coalesce(momentum_4 >= -0.005, true) and coalesce(volume >= 1.2 * mean, true) and coalesce(rsi <= 30, true) as may_buy, coalesce(momentum_4 <= 0.005, true) and coalesce(volume >= 1.2 * mean, true) and coalesce(rsi >= 70, true) as may_sell from q2)"""
JUDGED_SQL = f"""{CONDITIONS_SQL}, j0 as (select symbol, ts, close as price, momentum_4, may_buy, may_sell, bb_lower as s, bb_upper as t, confidence as q, hour(ts) * 4 as bars, hour(ts) / 24 as rev, case when hour(ts) % 12 = 0 then 0.9 else 0.3 end as bp from q3 where bb_upper is not null and bb_upper > bb_lower),
    j1 as (select *, case when q >= 80 then 'EXCELLENT' when q >= 65 then 'GOOD' when q >= 50 then 'MODERATE' when q >= 35 then 'POOR' else 'INVALID' end as grade, case when price < s or price > t then 'OUTSIDE' when (price - s) / (t - s) <= 0.2 then 'BOTTOM' when (price - s) / (t - s) <= 0.4 then 'LOWER' when (price - s) / (t - s) <= 0.6 then 'MIDDLE' when (price - s) / (t - s) <= 0.8 then 'UPPER' else 'TOP' end as position,
        momentum_4 / ((t - s) / s) as range_momentum, greatest(5, floor(bars / 4)) as base, q >= 60 and bp <= 0.8 and rev >= 0.4 as sound from j0),
    j2 as (select *, case grade when 'EXCELLENT' then greatest(3, floor(base / 2)) when 'GOOD' then greatest(5, floor(base * 7 / 10)) else base end::bigint as bars_to_target, case when sound and position in ('BOTTOM', 'LOWER') and may_buy then 'BUY' when sound and position in ('TOP', 'UPPER') and may_sell then 'SELL' end as signal from j1),
    j3 as (select *, case signal when 'BUY' then s * 0.995 when 'SELL' then t * 1.005 end as stop, case signal when 'BUY' then price + (t - price) * 0.8 when 'SELL' then price - (price - s) * 0.8 end as target from j2),
    j4 as (select *, abs(target - price) / abs(price - stop) as reward_risk, case when signal is not null then case when q > 95 then 95.0 else q end end as signal_confidence from j3)"""


def register(reg: Registry) -> None:
    reg.add("range_conditions", lambda spark, d: rounded(ranges.conditions(rows(spark, d)).select("symbol", "ts", "momentum_4", "rsi", "may_buy", "may_sell")), f"with {CONDITIONS_SQL} select symbol, ts, {r('momentum_4', 'momentum_4')}, {r('rsi', 'rsi')}, may_buy, may_sell from q3")
    reg.add(
        "range_judged",
        lambda spark, d: rounded(ranges.judged(state(spark, d)).select("symbol", "ts", "grade", "position", "range_momentum", "bars_to_target", "sound", "signal", "stop", "target", "reward_risk", "signal_confidence", "valid")),
        f"with {JUDGED_SQL} select symbol, ts, grade, position, {r('range_momentum', 'range_momentum')}, bars_to_target, sound, signal, {r('stop', 'stop')}, {r('target', 'target')}, {r('reward_risk', 'reward_risk')}, {r('signal_confidence', 'signal_confidence')}, coalesce(reward_risk >= 1.5 and signal_confidence >= 60 and position <> 'OUTSIDE', false) as valid from j4",
    )

    def signals(spark, d):
        last = latest(ranges.conditions(rows(spark, d)), ["symbol"], [F.desc("ts")]).select("symbol", F.col("close").alias("price"), "momentum_4", "may_buy", "may_sell")
        return rounded(ranges.judged(ranges.ranges(rows(spark, d)).join(last, "symbol")))

    reg.add("range_signals", signals)
