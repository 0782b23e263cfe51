"""Queries of volatility, data quality and scans over hourly bars."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators import quality, scanner, volatility
from tickloom.plans.base import BARS_SQL, Registry, bars, full, lag, over, r, rounded, ticks
from tickloom.sources import market

#: Bars with faults: every 13th has no close, every 29th a negative volume, every 17th a high under its low, every 31st a price of 50 times.
DIRTY_SQL = """k as (select *, row_number() over (partition by symbol order by ts) as n from bars), dirty as (select symbol, ts, open, case when n % 17 = 0 then low - 1 else high end as high, low,
    case when n % 13 = 0 then null when n % 31 = 0 then close * 50 else close end as close, case when n % 29 = 0 then -volume else volume end as volume from k)"""

PREP = f"""q as (select *, close - {lag('close')} as d, {lag('close')} as pc, row_number() over (partition by symbol order by ts) as i from bars), g as (select *, {full(14, 'avg(greatest(d, 0.0))', 'd')} as gain, {full(14, 'avg(greatest(-d, 0.0))', 'd')} as loss,
    volume / nullif(avg(volume) over (partition by symbol order by ts rows between 20 preceding and 1 preceding), 0) as v20, volume / nullif(avg(volume) over (partition by symbol order by ts rows between 10 preceding and 1 preceding), 0) as v10,
    max(close) over (partition by symbol order by ts rows between 20 preceding and 1 preceding) as top20, case when close > 0 and pc > 0 then ln(close / pc) end as lr from q),
    p as (select *, (close - pc) / nullif(pc, 0) * 100 as chg, case when loss > 0 then 100 - 100 / (1 + gain / loss) when gain > 0 then 100.0 when loss = 0 then 50.0 end as rsi,
    stddev_pop(lr) over (partition by symbol order by ts rows between 4 preceding and current row) as s5, stddev_pop(lr) over (partition by symbol order by ts rows between 19 preceding and 5 preceding) as s15 from g qualify i > 20)"""

ONE = lambda x: f"least({x}, 1.0)"


def _scan(name: str, cond: str, score: str, confidence: str, alert: str) -> str:
    return f"select symbol, ts, '{name}' as scan, {score} as score, {confidence} as confidence, {alert} as alert, close from p where {cond}"


_BREAK = f"(0.4 * {ONE('(close / top20 - 1) * 20')} + 0.4 * {ONE('coalesce(v20, 0) / 2')} + 0.2 * (coalesce(rsi, 50) - 50) / 50)"
_N = "(coalesce(rsi > 60 and rsi < 80, false)::int + coalesce(chg > 2, false)::int + coalesce(v10 > 1.2, false)::int)"
_GAP = ("abs(chg) >= 3 and chg {} 0", f"{ONE('abs(chg) / 10')} * case when v10 > 1.5 then 1.2 else 1.0 end", ONE("0.5 + abs(chg) / 20"), "case when abs(chg) > 8 then 'CRITICAL' when abs(chg) > 5 then 'HIGH' else 'MEDIUM' end")
SCANS_SQL = {
    "breakout": _scan("BREAKOUT", f"close > 1.005 * top20 and {_BREAK} >= 0.5", _BREAK, ONE(f"0.5 + {_BREAK} / 2"), f"case when {_BREAK} > 0.8 and coalesce(v20, 0) > 3 then 'HIGH' when {_BREAK} > 0.6 and coalesce(v20, 0) > 2 then 'MEDIUM' else 'LOW' end"),
    "momentum": _scan("MOMENTUM", f"{_N} >= 2", "0.4 * coalesce(rsi > 60 and rsi < 80, false)::int + 0.3 * coalesce(chg > 2, false)::int + 0.3 * coalesce(v10 > 1.2, false)::int", f"0.5 + {_N} / 8.0", f"case when {_N} = 3 then 'HIGH' else 'MEDIUM' end"),
    "volume_spike": _scan("VOLUME_SPIKE", "v20 >= 2", f"0.8 * {ONE('v20 / 5')} + 0.2 * {ONE('abs(coalesce(chg, 0)) / 5')}", ONE("0.5 + v20 / 20"), "case when v20 > 5 and abs(chg) > 3 then 'CRITICAL' when v20 > 4 then 'HIGH' when v20 > 3 then 'MEDIUM' else 'LOW' end"),
    "gap": _scan("GAP_UP", _GAP[0].format(">"), *_GAP[1:]) + " union all " + _scan("GAP_DOWN", _GAP[0].format("<"), *_GAP[1:]),
    "reversal": _scan("REVERSAL", "(rsi < 30 and chg > 1) or (rsi > 70 and chg < -1)", "case when rsi < 30 and chg > 1 then (30 - rsi) / 30 else (rsi - 70) / 30 end * 0.5 + 0.5", "0.6", "'MEDIUM'"),
    "volatility_spike": _scan("VOLATILITY_SPIKE", "s5 / nullif(s15, 0) >= 1.5", f"0.6 * {ONE('s5 / nullif(s15, 0) / 3')} + 0.4 * {ONE('abs(coalesce(chg, 0)) / 5')}", ONE("0.4 + s5 / nullif(s15, 0) / 10"), "case when s5 / nullif(s15, 0) > 3 then 'HIGH' else 'MEDIUM' end"),
}
ROUNDED = f"select symbol, ts, scan, {r('score', 'score')}, {r('confidence', 'confidence')}, alert, {r('close', 'close')} from s"


def dirty(spark, d):
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("symbol").orderBy("ts"))
    rows = bars(spark, d).withColumn("n", n)
    return rows.select("symbol", "ts", "open", F.when(F.col("n") % 17 == 0, F.col("low") - 1).otherwise(F.col("high")).alias("high"), "low", F.when(F.col("n") % 13 == 0, None).when(F.col("n") % 31 == 0, F.col("close") * 50).otherwise(F.col("close")).alias("close"), F.when(F.col("n") % 29 == 0, -F.col("volume")).otherwise(F.col("volume")).alias("volume"))


def register(reg: Registry) -> None:
    rt = f"x as (select *, close / nullif({lag('close')}, 0) - 1 as rt, {lag('close')} as pc from bars)"
    reg.over_bars("vol_historical", volatility.historical, ["hist_vol"], f", {rt} select symbol, ts, {r(f'({full(20, 'stddev_samp(rt)', 'rt')}) * sqrt(252)', 'hist_vol')} from x")
    reg.over_bars("vol_parkinson", volatility.parkinson, ["parkinson_vol"], f", x as (select *, pow(ln(high / low), 2) / (4 * ln(2)) as v from bars) select symbol, ts, {r(f'sqrt(({full(20, 'avg(v)', 'v')}) * 252)', 'parkinson_vol')} from x")
    root = lambda m, name: r(f"case when {m} >= 0 then sqrt({m} * 252) when {m} is not null then 0.0 end", name)
    reg.over_bars("vol_garman_klass", volatility.garman_klass, ["garman_klass_vol"], f", x as (select *, 0.5 * pow(ln(high / low), 2) - (2 * ln(2) - 1) * pow(ln(close / open), 2) as v from bars), z as (select *, {full(20, 'avg(v)', 'v')} as m from x) select symbol, ts, {root('m', 'garman_klass_vol')} from z")
    k = 0.34 / (1.34 + 21 / 19)
    reg.over_bars("vol_yang_zhang", volatility.yang_zhang, ["yang_zhang_vol"], f""", {rt}, y as (select *, pow(ln(open / pc), 2) + {k} * pow(ln(close / pc), 2) + (1 - {k}) * (ln(high / close) * ln(high / open) + ln(low / close) * ln(low / open)) as v from x),
        z as (select *, {full(20, 'avg(v)', 'v')} as m from y) select symbol, ts, {root('m', 'yang_zhang_vol')} from z""")
    reg.over_bars("vol_up_down", volatility.up_down, ["up_vol", "down_vol"], f", {rt} select symbol, ts, " + ", ".join(r(f"case when count(rt) {over(20)} = 20 then stddev_samp(case when rt {s} 0 then rt end) {over(20)} * sqrt(252) end", n) for s, n in ((">", "up_vol"), ("<", "down_vol"))) + " from x")
    reg.over_bars("vol_shape", volatility.shape, ["skew", "excess_kurtosis"], f", {rt} select symbol, ts, {r(full(20, 'skewness(rt)', 'rt'), 'skew', 4)}, {r(full(20, 'kurtosis(rt)', 'rt'), 'excess_kurtosis', 4)} from x")
    reg.queries["vol_shape"] = lambda spark, d: rounded(volatility.shape(bars(spark, d)).select("symbol", "ts", "skew", "excess_kurtosis"), 4)
    reg.over_bars("vol_rank_and_trend", volatility.rank_and_trend, ["vol_percentile", "vol_z", "vol_slope", "vol_reversion"], f""", {rt}, v as (select *, ({full(20, 'stddev_samp(rt)', 'rt')}) * sqrt(252) as v, row_number() over (partition by symbol order by ts) as i from x), w as (select *, {lag('v')} as b from v),
        n as (select a.symbol, a.ts, count(*) filter (where b.v <= a.v) / nullif(count(b.v), 0) as pct from v a join v b on a.symbol = b.symbol and b.i between a.i - 89 and a.i and b.v is not null where a.v is not null group by 1, 2)
        select w.symbol, w.ts, {r('pct', 'vol_percentile')}, {r(f'case when stddev_samp(v) {over(90)} > 0 then (v - avg(v) {over(90)}) / stddev_samp(v) {over(90)} end', 'vol_z')}, {r(f'case when count(v) {over(20)} = 20 then regr_slope(v, i::double) {over(20)} end', 'vol_slope')},
        {r(f'case when count(case when b is not null then v end) {over(90)} >= 3 then 1 - regr_slope(v, b) {over(90)} end', 'vol_reversion')} from w left join n on n.symbol = w.symbol and n.ts = w.ts""".replace("over (partition by symbol order by ts", "over (partition by w.symbol order by w.ts").replace("v as (select *, (case when count(rt) over (partition by w.symbol order by w.ts rows 19 preceding) = 20 then stddev_samp(rt) over (partition by w.symbol order by w.ts", "v as (select *, (case when count(rt) over (partition by symbol order by ts rows 19 preceding) = 20 then stddev_samp(rt) over (partition by symbol order by ts").replace("row_number() over (partition by w.symbol order by w.ts)", "row_number() over (partition by symbol order by ts)").replace("lag(v, 1) over (partition by w.symbol order by w.ts)", "lag(v, 1) over (partition by symbol order by ts)").replace("lag(close, 1) over (partition by w.symbol order by w.ts)", "lag(close, 1) over (partition by symbol order by ts)"))
    # quality
    base = f"with {BARS_SQL}, {DIRTY_SQL}"
    broken = "coalesce(high < low, false) or coalesce(high < open, false) or coalesce(high < close, false) or coalesce(low > open, false) or coalesce(low > close, false)"
    anyp = lambda c: " or ".join(f"coalesce({p} {c}, false)" for p in quality.PRICES)
    meas = f"""w as (select *, {lag('close')} as b, epoch(ts - {lag('ts')})::double as step, avg(volume) over (partition by symbol) as mv from dirty), w2 as (select *, median(case when step > 0 then step end) over (partition by symbol) as med from w),
        m as (select symbol, count(*) as "rows", (count(*) * 5 - count(open) - count(high) - count(low) - count(close) - count(volume)) as nulls, count(*) filter (where {anyp('<= 0')}) as not_positive, count(*) filter (where {anyp('> 1e6')}) as too_high, count(*) filter (where volume < 0) as negative_volume,
        count(*) filter (where volume = 0) as zero_volume, count(*) filter (where {broken}) as broken_order, count(*) filter (where abs(close / nullif(b, 0) - 1) > 0.1) as gaps, count(*) filter (where volume > 10 * mv) as volume_spikes, count(*) filter (where step = 0) as duplicates, max(med) as median_step, count(*) filter (where step > 3 * med) as time_gaps from w2 group by symbol)"""
    reg.add("quality_measures", lambda spark, d: rounded(quality.measures(dirty(spark, d)).withColumn("frequency", quality.frequency(F.col("median_step")))), f"{base}, {meas} select *, case when median_step <= 90 then '1m' when median_step <= 450 then '5m' when median_step <= 1800 then '15m' when median_step <= 43200 then '1h' else '1d' end as frequency from m")
    rule = lambda cond, name, sev, n: f"select symbol, '{name}' as rule, {sev} as severity, {n} as affected from m where {cond}"
    iss = "iss as (" + " union all ".join([rule('nulls / "rows" > 0.05', "nulls", "case when nulls / (5 * \"rows\") > 0.05 then 'ERROR' else 'WARNING' end", "nulls"), rule("not_positive > 0", "not_positive", "'CRITICAL'", "not_positive"), rule("too_high > 0", "too_high", "'WARNING'", "too_high"), rule("negative_volume > 0", "negative_volume", "'ERROR'", "negative_volume"), rule('zero_volume / "rows" > 0.1', "zero_volume", "'WARNING'", "zero_volume"), rule("broken_order > 0", "broken_order", "'ERROR'", "broken_order"), rule("gaps > 0", "gaps", "'INFO'", "gaps"), rule('volume_spikes / "rows" > 0.05', "volume_spikes", "'WARNING'", "volume_spikes"), rule("duplicates > 0", "duplicates", "'ERROR'", "duplicates"), rule("time_gaps > 0", "time_gaps", "'WARNING'", "time_gaps")]) + ")"
    reg.add("quality_issues", lambda spark, d: quality.issues(quality.measures(dirty(spark, d))), f"{base}, {meas}, {iss} select * from iss")
    score = "greatest(100 - 25 * critical - 10 * error - 3 * warning - info - 2 * greatest(missing_pct - 5, 0.0), 0.0)"
    reg.add("quality_score", lambda spark, d: rounded(quality.quality_score(quality.measures(dirty(spark, d)))), f"""{base}, {meas}, {iss}, c as (select symbol, count(*) filter (where severity = 'CRITICAL') as critical, count(*) filter (where severity = 'ERROR') as error, count(*) filter (where severity = 'WARNING') as warning, count(*) filter (where severity = 'INFO') as info from iss group by symbol),
        f as (select m.symbol, nulls / (5 * "rows") * 100 as missing_pct, coalesce(critical, 0) as critical, coalesce(error, 0) as error, coalesce(warning, 0) as warning, coalesce(info, 0) as info from m left join c using (symbol)), g as (select *, {score} as score from f)
        select symbol, {r('missing_pct', 'missing_pct')}, critical, error, warning, info, {r('score', 'score')}, case when score >= 95 then 'EXCELLENT' when score >= 85 then 'GOOD' when score >= 70 then 'FAIR' when score >= 50 then 'POOR' else 'UNUSABLE' end as level from g""")
    cols = ["symbol", "ts", *quality.PRICES, "volume"]
    shown = "symbol, ts, " + ", ".join(r(c, c) for c in (*quality.PRICES, "volume"))
    far = " or ".join(f"coalesce(stddev_pop({c}) over (partition by symbol) > 0 and abs({c} - avg({c}) over (partition by symbol)) / stddev_pop({c}) over (partition by symbol) > 3, false)" for c in quality.PRICES)
    reg.add("quality_remove_outliers", lambda spark, d: rounded(quality.remove_outliers(dirty(spark, d)).select(cols)), f"{base}, f as (select *, {far} as far from dirty) select {shown} from f where not far")
    line = "ai.v + (bi.v - ai.v) * (i - ai.i) / (bi.i - ai.i)"
    fill = f"""j as (select *, row_number() over (partition by symbol order by ts) as i from dirty), s as (select *, last_value(case when close is not null then {{'i': i, 'v': close}} end ignore nulls) over (partition by symbol order by ts rows unbounded preceding) as ai, first_value(case when close is not null then {{'i': i, 'v': close}} end ignore nulls) over (partition by symbol order by ts rows between current row and unbounded following) as bi from j),
        filled as (select symbol, ts, open, high, low, coalesce(close, case when i - ai.i <= 3 then coalesce({line}, ai.v) end) as close, volume from s)"""
    reg.add("quality_interpolate", lambda spark, d: rounded(quality.interpolate(dirty(spark, d)).select(cols)), f"{base}, {fill} select {shown} from filled")
    pos = "p as (select symbol, ts, " + ", ".join(f"case when {c} > 0 then {c} end as {c}" for c in quality.PRICES) + ", case when volume < 0 then 0.0 else volume end as volume from dirty)"
    reg.add("quality_correct", lambda spark, d: rounded(quality.correct(dirty(spark, d)).select(cols)), f"{base}, {pos}, c as (select symbol, ts, open, greatest(open, high, low, close) as high, least(open, high, low, close) as low, close, volume from p) select {shown} from c")
    kept, filled = f"f as (select *, {far} as far from dirty), near as (select * from f where not far)", fill.replace("from dirty)", "from near)")
    corrected = pos.replace("from dirty)", "from filled)") + ", c as (select symbol, ts, open, greatest(open, high, low, close) as high, least(open, high, low, close) as low, close, volume from p)"
    reg.add("quality_clean", lambda spark, d: rounded(quality.clean(dirty(spark, d)).select(cols)), f"{base}, {kept}, {filled}, {corrected} select {shown} from c")
    steps, last = [f"a0 as (select * from dirty where open is not null and high is not null and low is not null and close is not null and volume >= 0 and not ({broken}))"], "a0"
    for n, c in enumerate(quality.PRICES, 1):
        steps.append(f"b{n} as (select *, quantile_cont({c}, 0.01) over (partition by symbol) as lo, quantile_cont({c}, 0.99) over (partition by symbol) as hi from {last}), a{n} as (select symbol, ts, open, high, low, close, volume from b{n} where {c} <= 2 * hi and {c} >= 0.5 * lo)")
        last = f"a{n}"
    reg.add("quality_drop_extremes", lambda spark, d: rounded(quality.drop_extremes(dirty(spark, d)).select(cols)), f"{base}, {', '.join(steps)} select {shown} from {last}")
    # scans
    for one in scanner.SCANS:
        name = one.__name__
        reg.add(f"scan_{name}", lambda spark, d, one=one: rounded(one(scanner.prepared(bars(spark, d)))), f"with {BARS_SQL}, {PREP}, s as ({SCANS_SQL[name]}) {ROUNDED}")
    union = " union all ".join(SCANS_SQL.values())
    reg.add("scan_all", lambda spark, d: rounded(scanner.scan(bars(spark, d))), f"with {BARS_SQL}, {PREP}, s as (select * from ({union}) where score >= 0.5 and confidence >= 0.5) {ROUNDED}")
    rank = "case alert when 'CRITICAL' then 1 when 'HIGH' then 2 when 'MEDIUM' then 3 else 4 end"
    reg.add("scan_top", lambda spark, d: rounded(scanner.top(scanner.scan(bars(spark, d)))), f"with {BARS_SQL}, {PREP}, s as (select * from ({union}) where score >= 0.5 and confidence >= 0.5 order by {rank}, score desc, symbol, ts, scan limit 50) {ROUNDED}")
    reg.add("scan_best_per_symbol", lambda spark, d: rounded(scanner.best_per_symbol(scanner.scan(bars(spark, d))).select("symbol", "ts", "scan", "score", "rank")), f"with {BARS_SQL}, {PREP}, s as (select *, row_number() over (partition by symbol order by score desc, ts, scan) as n from ({union}) where score >= 0.5 and confidence >= 0.5) select symbol, ts, scan, {r('score', 'score')}, n::int as rank from s where n <= 3")
    # sources
    reg.add("source_resample_daily", lambda spark, d: rounded(market.resample(bars(spark, d), "day")), f"with {BARS_SQL} select symbol, date_trunc('day', ts)::timestamp as ts, {r('arg_min(open, ts)', 'open')}, {r('max(high)', 'high')}, {r('min(low)', 'low')}, {r('arg_max(close, ts)', 'close')}, {r('sum(volume)', 'volume')} from bars group by symbol, date_trunc('day', ts)")
    reg.add("source_downsample_old", lambda spark, d: rounded(market.downsample_old(bars(spark, d), 100, "day")), f"""with {BARS_SQL}, n as (select *, row_number() over (partition by symbol order by ts desc) as rn from bars), a as (select symbol, date_trunc('day', ts)::timestamp as ts, arg_min(open, ts) as open, max(high) as high, min(low) as low, arg_max(close, ts) as close, sum(volume) as volume from n where rn > 100 group by symbol, date_trunc('day', ts)
        union all select symbol, ts, open, high, low, close, volume from n where rn <= 100) select {shown} from a""")
    snap = f"with {BARS_SQL}, s as (select *, close - {lag('close')} as c, {lag('close')} as pc, row_number() over (partition by symbol order by ts desc) as rn from bars)"
    reg.add("source_snapshots", lambda spark, d: rounded(market.snapshots(bars(spark, d)).select("symbol", "ts", "price", "change", "change_pct")), f"{snap} select symbol, ts, {r('close', 'price')}, {r('c', 'change')}, {r('c / nullif(pc, 0) * 100', 'change_pct')} from s where rn = 1")
    reg.add("source_valid_snapshots", lambda spark, d: rounded(market.valid_snapshots(market.snapshots(bars(spark, d)), F.lit("2024-01-30 23:30:00").cast("timestamp_ntz"), 24).select("symbol", "price", "suspect")), f"{snap} select symbol, {r('close', 'price')}, abs(c / nullif(pc, 0) * 100) > 50 as suspect from s where rn = 1 and close > 0 and ts >= timestamp '2024-01-30 23:30:00' - interval 24 hour")
    reg.add("source_range_scan", lambda spark, d: rounded(market.range_scan(bars(spark, d), "2024-01-05", "2024-01-08 12:00:00", 50)), f"with {BARS_SQL}, n as (select *, row_number() over (partition by symbol order by ts) as rn from bars where ts between '2024-01-05' and '2024-01-08 12:00:00') select {shown} from n where rn <= 50")

    def fallback(spark, d):
        rows = market.snapshots(bars(spark, d)).select("symbol", "price")
        return rounded(market.first_source([(2, rows), (1, rows.where("symbol in ('view', 'click')").withColumn("price", F.col("price") + 1))], ["symbol"]))

    reg.add("source_fallback", fallback, f"{snap} select symbol, {r("close + (symbol in ('view', 'click'))::int", 'price')}, case when symbol in ('view', 'click') then 1 else 2 end as source_priority from s where rn = 1")

    def upserted(spark, d):
        old = market.table(spark, d, "nation")
        new = old.where("n_nationkey % 5 = 0").withColumn("n_name", F.lit("NEW")).withColumn("n_nationkey", (F.col("n_nationkey") + F.when(F.col("n_nationkey") > 15, 100).otherwise(0)).cast("int"))
        return market.upsert(old, new, ["n_nationkey"])

    reg.add("source_upsert", upserted, "with new as (select (n_nationkey + case when n_nationkey > 15 then 100 else 0 end)::int as n_nationkey, 'NEW' as n_name, n_regionkey from nation where n_nationkey % 5 = 0) select * from new union all select * from nation where n_nationkey not in (select n_nationkey from new)")

    def book(spark, d):
        t = ticks(spark, d).select("symbol", F.when(F.col("event_id") % 2 == 0, "bid").otherwise("ask").alias("side"), (F.when(F.col("event_id") % 2 == 0, -1).otherwise(1) * F.col("price") + 500).alias("price"), F.col("volume").alias("size"))
        return rounded(market.book_measures(market.order_book(t, 10)))

    reg.add("source_order_book", book, f"with {BARS_SQL}, b as (select symbol, max(500 - price) filter (where event_id % 2 = 0) as bid, min(500 + price) filter (where event_id % 2 = 1) as ask from ticks group by symbol) select symbol, {r('bid', 'best_bid')}, {r('ask', 'best_ask')}, {r('(bid + ask) / 2', 'mid')}, {r('(ask - bid) / bid * 100', 'spread_pct')} from b")
    reg.add("source_success_rates", lambda spark, d: rounded(market.success_rates(ticks(spark, d).select(F.col("symbol").alias("source"), (F.col("price") > 20).alias("success")))), f"with {BARS_SQL} select symbol as source, count(*) as total, count(*) filter (where price > 20) as succeeded, count(*) filter (where not price > 20) as failed, {r('count(*) filter (where price > 20) / count(*)', 'rate')} from ticks group by symbol")
