"""Snapshots as a common table of SQL, beside `operators.snapshots`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tickloom.operators import snapshots
from tickloom.plans.base import BARS_SQL, bars, full, lag, over

_TYPES = "case symbol " + " ".join(f"when '{s}' then '{t}'" for s, t in snapshots.ASSET_TYPES.items()) + " else 'stock' end"
_PAST = "over (partition by symbol order by ts rows between 20 preceding and 1 preceding)"

#: `snaps`, and what it is made of; put after `with`.
SNAPS_SQL = f"""{BARS_SQL}, sn0 as (
        select symbol, ts, 200.0::double + avg(close) {over(10)} as price, volume * 10000 as volume, case when high > low then (close - open) / (high - low) end as sentiment from bars),
    sn1 as (select *, {lag('price')} as pb, {lag('price', 10)} as pb10 from sn0),
    sn2 as (select *, price - pb as d, case when price > 0 and pb > 0 then ln(price / pb) end as lr from sn1),
    sn3 as (select *, case when pb <> 0 then d / pb * 100 end as change_pct, case when pb10 <> 0 then price / pb10 - 1 end as momentum, {full(14, 'avg(greatest(d, 0.0))', 'd')} as gain, {full(14, 'avg(greatest(-d, 0.0))', 'd')} as loss,
        ({full(12, 'avg(price)', 'price')}) - ({full(26, 'avg(price)', 'price')}) as macd, ({full(20, 'stddev_pop(lr)', 'lr')}) * sqrt(252) * 100 as volatility, {full(20, 'avg(price)', 'price')} as m20, {full(50, 'avg(price)', 'price')} as m50,
        {full(20, 'stddev_pop(price)', 'price')} as s20, max(price) {_PAST} as top20, min(price) {_PAST} as low20, volume / nullif(avg(volume) {_PAST}, 0) as volume_ratio from sn2),
    snaps as (select symbol, ts, price, volume, sentiment, change_pct, momentum, macd, volatility, volume_ratio,
        case when loss > 0 then 100 - 100 / (1 + gain / loss) when gain > 0 then 100.0 when loss = 0 then 50.0 end as rsi, m20 + 2 * s20 as bb_upper, m20 - 2 * s20 as bb_lower, {_TYPES} as asset_type,
        case when m20 is null then null when price > top20 * 1.01 then 'BREAKOUT' when price < low20 * 0.99 then 'BREAKDOWN' when volatility > 40 then 'VOLATILE'
             when price > m20 and m20 > coalesce(m50, m20) then 'BULL' when price < m20 and m20 < coalesce(m50, m20) then 'BEAR' else 'SIDEWAYS' end as regime,
        case when m20 is not null then least(95.0, 60 + 15 * case when s20 > 0 then abs(price - m20) / s20 else 0.0 end) end as confidence from sn3)"""


def snaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.enrich(snapshots.index_level(bars(spark, sf_dir)))
