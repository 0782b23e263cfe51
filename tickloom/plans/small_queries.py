"""Queries of small functions, summaries and look-ups, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions import scalars, text
from tickloom.functions.windows import full, in_order, lag, last
from tickloom.operators import quality, regimes, reports
from tickloom.plans.base import BARS_SQL, Registry, bars, r, rounded
from tickloom.plans.base import full as sql_full
from tickloom.plans.base import lag as sql_lag
from tickloom.plans.base import over as sql_over
from tickloom.plans.sequential_queries import ADX_TABLES
from tickloom.plans.snapshot_sql import SNAPS_SQL, snaps
from tickloom.plans.trading_queries import POSITIONS_SQL, positions
from tickloom.sources import market
from tickloom.sources.market import latest, table

_LIST = lambda values: "[" + ", ".join(f"'{v}'" for v in values) + "]"
NAMES = ("BTC/USDT", "eth-usd", "C", "S", "W", "SB", "KC", "XX", "curl/8.0", "Mozilla", "sqlmap-1", "10 Jan 2024", "2024-01-10", "01/10/2024", "never")
FORMATS = ("yyyy-MM-dd", "dd MMM yyyy", "MM/dd/yyyy")


#: Asset types that sources serve in the queries; the fifth has none.
KINDS = ("stock", "crypto", "forex", "commodity", "bond")


def register(reg: Registry) -> None:
    orders = lambda spark, d: table(spark, d, "orders").withColumn("word", F.element_at(F.array(*[F.lit(x) for x in NAMES]), (F.col("o_orderkey") % len(NAMES) + 1).cast("int")))
    base = f"with o as (select *, {_LIST(NAMES)}[o_orderkey % {len(NAMES)} + 1] as word from orders)"

    def forms(spark, d):
        v = F.col("o_totalprice")
        share = (v - 200000) / 1e5
        return orders(spark, d).select(
            "o_orderkey", scalars.format_percentage(text.nearest(share, 3) + 0.0001).alias("percent"), scalars.format_number(v).alias("number"), scalars.format_timestamp(F.col("o_orderdate"), "yyyy/MM/dd").alias("day"), F.when(v.isNotNull(), scalars.in_range(v, 1000, 200000)).alias("inside"),
            scalars.exchange_symbol(F.col("word")).alias("pair"), F.when(F.abs(v) < 2.0**53, F.floor(v / 0.25) * 0.25).otherwise(v).alias("stepped"), text.safe_divide(v, (F.col("o_orderkey") % 3).cast("double")).alias("ratio"), text.percent_change(F.col("o_orderkey") % 4, F.col("o_custkey")).alias("change"),
            text.format_currency(v, minus_first=False).alias("currency"), text.valid_symbol(F.col("word")).alias("symbol_ok"), text.valid_email(F.concat(F.col("word"), F.lit("@site.org"))).alias("email_ok"),
        )

    share = "(round((o_totalprice - 200000) / 1e5, 3) + 0.0001)"
    percent = f"case when abs({share}) > 1 then {share} else {share} * 100 end"
    reg.add("scalar_forms", lambda spark, d: rounded(forms(spark, d)), f"""{base}, p as (select *, round({percent}, 2) as pc from o)
        select o_orderkey, case when pc > 0 then '+' else '' end || printf('%.2f', pc) || '%' as percent, format('{{:,.2f}}', o_totalprice) as number, strftime(o_orderdate, '%Y/%m/%d') as day, o_totalprice between 1000 and 200000 as inside, upper(regexp_replace(word, '[/-]', '', 'g')) as pair,
        {r('floor(o_totalprice / 0.25) * 0.25', 'stepped')}, {r('case when o_orderkey % 3 <> 0 then o_totalprice / (o_orderkey % 3) else 0.0 end', 'ratio')}, {r("case when o_orderkey % 4 <> 0 then (o_custkey - o_orderkey % 4) / (o_orderkey % 4) * 100 when o_custkey = 0 then 0.0 else 'inf'::double end", 'change')},
        '$' || format('{{:,.2f}}', o_totalprice) as currency, regexp_full_match(word, '[A-Z]{{1,10}}') as symbol_ok, regexp_full_match(word || '@site.org', '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{{2,}}') as email_ok from p""")

    def looked(spark, d):
        month = F.month("o_orderdate")
        return orders(spark, d).select(
            "o_orderkey", F.concat_ws(",", scalars.listed(F.col("word"), scalars.REGIONS, ("Unknown",))).alias("regions"), scalars.growing_stage(F.col("word"), month).alias("stage"), scalars.suspicious_agent(F.col("word")).alias("automatic"),
            scalars.threat_level(month > 10, scalars.suspicious_agent(F.col("word")), F.col("o_custkey") % 2 == 0, F.col("o_custkey") % 3 == 0).alias("threat"), market.parse_dates(F.col("word"), FORMATS).cast("date").alias("parsed"),
        )

    regions = "case word " + " ".join(f"when '{k}' then '{','.join(v)}'" for k, v in scalars.REGIONS.items()) + " else 'Unknown' end"
    auto = "(" + " or ".join(f"contains(lower(word), '{a}')" for a in scalars.AGENTS) + ")"
    threat = f"(case when month(o_orderdate) > 10 then 30 else 0 end + case when {auto} then 20 else 0 end + case when o_custkey % 2 = 0 then 25 else 0 end + case when o_custkey % 3 = 0 then 15 else 0 end)"
    reg.add("scalar_lookups", looked, f"""{base} select o_orderkey, {regions} as regions, case when word in ('C', 'S') then case when month(o_orderdate) between 3 and 5 then 'Planting' when month(o_orderdate) between 6 and 8 then 'Growing' when month(o_orderdate) between 9 and 11 then 'Harvest' else 'Dormant' end else 'Unknown' end as stage,
        {auto} as automatic, case when {threat} >= 70 then 'CRITICAL' when {threat} >= 50 then 'HIGH' when {threat} >= 30 then 'MEDIUM' else 'LOW' end as threat, coalesce(try_strptime(word, '%Y-%m-%d'), try_strptime(word, '%d %b %Y'), try_strptime(word, '%m/%d/%Y'))::date as parsed from o""")

    def sources(spark, d):
        """Suppliers as sources: their nation gives the type, the number the priority; those in debt are switched off."""
        kinds = F.array(*[F.lit(k) for k in KINDS])
        return table(spark, d, "supplier").select(F.element_at(kinds, (F.col("s_nationkey") % 5 + 1).cast("int")).alias("asset_type"), F.col("s_name").alias("source"), (F.col("s_suppkey") * 7 % 11).alias("priority"), (F.col("s_acctbal") > 0).alias("enabled"))

    def routed(spark, d):
        s = market.routed(snaps(spark, d), sources(spark, d), most=3)
        return rounded(s.select("symbol", "ts", F.concat_ws(",", "sources").alias("sources"), market.liquidity_score(F.col("volume"), F.when(F.col("asset_type") == "crypto", F.col("price") * 1e5)).alias("liquidity")))

    reg.add("source_routing", routed, f"""with {SNAPS_SQL}, a as (select ({list(KINDS)})[s_nationkey % 5 + 1] as asset_type, s_name, s_suppkey * 7 % 11 as priority from supplier where s_acctbal > 0),
        b as (select * from a qualify row_number() over (partition by asset_type order by priority, s_name) <= 3), c as (select asset_type, string_agg(s_name, ',' order by priority, s_name) as sources from b group by 1)
        select symbol, ts, coalesce(sources, '') as sources, {r("case when volume is null then 0.3 when asset_type <> 'crypto' then 0.1 else least(1.0, 10 * volume / (price * 1e5)) end", 'liquidity')} from snaps left join c using (asset_type)""")

    # scores over snapshots
    def scores(spark, d):
        s = snaps(spark, d)
        c = F.col
        s = s.withColumns({"_change": (~c("regime").eqNullSafe(lag("regime")) & lag("regime").isNotNull()).cast("int"), "_i": F.row_number().over(in_order()).cast("double")})
        s = s.withColumns({"_t": F.sum("_change").over(last(20)), "_hi": full("bb_upper", F.regr_slope("bb_upper", "_i"), 10), "_lo": full("bb_lower", F.regr_slope("bb_lower", "_i"), 10), "_ha": full("bb_upper", F.regr_intercept("bb_upper", "_i"), 10), "_la": full("bb_lower", F.regr_intercept("bb_lower", "_i"), 10)})
        kind = F.when(c("_hi") < c("_lo"), F.when(c("_hi") < 0, "descending").otherwise("ascending")).otherwise("symmetrical")
        conf = scalars.triangle_confidence(kind, c("_hi") / 1000, c("_lo") / 1000)
        return rounded(s.select("symbol", "ts", scalars.transition_probability(c("volatility") > 50, c("_t"), c("rsi"), c("confidence"), F.abs("sentiment")).alias("transition"), conf.alias("triangle"), scalars.reliability(conf).alias("reliability"), scalars.crossing(c("_hi"), c("_ha"), c("_lo"), c("_la")).alias("meets_at")), 4)

    fit = lambda f, col: sql_full(10, f"{f}({col}, i)", col)
    tri = "case kind when 'ascending' then (greatest(1 - abs(hi) / 1000 * 1000, 0.0) + least(lo / 1000 * 500, 1.0)) / 2 when 'descending' then (least(abs(hi) / 1000 * 500, 1.0) + greatest(1 - abs(lo) / 1000 * 1000, 0.0)) / 2 else greatest(1 - abs(abs(hi) - abs(lo)) / 1000 * 1000, 0.0) end"
    reg.add("scalar_scores", scores, f"""with {SNAPS_SQL}, a as (select *, {sql_lag('regime')} as rb, row_number() over (partition by symbol order by ts)::double as i from snaps), b as (select *, sum((rb is not null and regime is distinct from rb)::int) {sql_over(20)} as tr, {fit('regr_slope', 'bb_upper')} as hi, {fit('regr_slope', 'bb_lower')} as lo,
            {fit('regr_intercept', 'bb_upper')} as ha, {fit('regr_intercept', 'bb_lower')} as la from a), c as (select *, case when hi < lo then case when hi < 0 then 'descending' else 'ascending' end else 'symmetrical' end as kind from b),
        d as (select *, case when hi is not null then greatest(0.1, least(0.95, {tri})) end as t from c)
        select symbol, ts, {r('least(1.0, case when volatility > 50 then 0.3 else 0 end + case when tr > 2 then 0.2 else 0 end + case when rsi > 80 or rsi < 20 then 0.2 else 0 end + case when confidence > 30 then 0.1 else 0 end + case when abs(sentiment) < 0.3 then 0.1 else 0 end)::double', 'transition', 4)},
        {r('t::double', 'triangle', 4)}, case when t >= 0.9 then 'VERY_HIGH' when t >= 0.8 then 'HIGH' when t >= 0.6 then 'MEDIUM' when t >= 0.4 then 'LOW' else 'VERY_LOW' end as reliability, {r('case when abs(hi - lo) > 1e-10 then (la - ha) / (hi - lo) end', 'meets_at', 4)} from d""")

    reg.add("ind_trend_strength", lambda spark, d: rounded(regimes.trend_strength(bars(spark, d))), f"""with recursive {BARS_SQL}, i as (select *, row_number() over (partition by symbol order by ts) - 1 as i from bars), {ADX_TABLES},
        a as (select *, {sql_full(20, 'avg(close)', 'close')} as m20, {sql_full(50, 'avg(close)', 'close')} as m50, {sql_lag('close', 19)} as b from i)
        select a.symbol, ts, {r('case when a.i >= 49 then (least(100.0, 2 * adx.v) + case when (close > m20 and m20 > m50) or (close < m20 and m20 < m50) then 100.0 else 50.0 end + least(100.0, abs(close / b - 1) * 500)) / 3 end', 'trend_strength')} from a left join adx on adx.symbol = a.symbol and adx.i = a.i""")

    # summaries
    top = lambda spark, d: reports.valued(positions(spark, d), F.lit(235.0))
    reg.add("top_positions", lambda spark, d: rounded(reports.top_positions(top(spark, d)).select("account", "symbol", "market_value"), 4), f"with {POSITIONS_SQL} select account, symbol, {r('quantity * entry', 'market_value', 4)} from positions order by quantity * entry desc, account, symbol limit 5")
    reg.add("recent_trades", lambda spark, d: reports.newest(table(spark, d, "events"), 20).select("event_id", "event_type", "ts"), "select event_id, event_type, ts from events order by ts desc, event_id desc limit 20")

    gain = "case when side = 'LONG' then 235.0 - entry else entry - 235.0 end * quantity"
    reg.add("account_totals", lambda spark, d: rounded(reports.account_totals(top(spark, d)), 4), f"with {POSITIONS_SQL} select account, count(*) as positions, {r('sum(quantity * entry)', 'market_value', 4)}, {r(f'sum({gain})', 'unrealized', 4)}, {r('max(quantity * entry)', 'largest', 4)}, count(*) filter (where side = 'LONG') as long, count(*) filter (where {gain} > 0) as winning from positions group by account")

    reg.add("risk_metrics", lambda spark, d: rounded(reports.risk_metrics(snaps(spark, d))), f"""with {SNAPS_SQL}, q as (select symbol, ts, price, {sql_lag('price')} as b, max(price) over (partition by symbol order by ts rows unbounded preceding) as peak from snaps), t as (select symbol, price / b - 1 as x from q where b > 0),
        a as (select symbol, count(*) as n, quantile_cont(x, 0.05) as p5, quantile_cont(x, 0.01) as p1, stddev_pop(x) * sqrt(252) as v, avg(x) / stddev_samp(x) as sh, avg((x > 0)::int) as w from t group by symbol), e as (select t.symbol, avg(x) as es from t join a using (symbol) where x <= p5 group by t.symbol),
        m as (select symbol, max((peak - price) / peak * 100) as dd from q group by symbol) select symbol, n, {r('abs(p5) * 1000', 'var_95')}, {r('abs(p1) * 1000', 'var_99')}, {r('abs(es) * 1000', 'expected_shortfall')}, {r('v', 'volatility')}, {r('sh', 'sharpe')}, {r('w', 'win_rate')}, {r('dd', 'max_drawdown_pct')}, {r('case when sh > 0 then sh * sqrt(252) else 0.0 end', 'risk_adjusted')}
        from a join e using (symbol) join m using (symbol)""")

    reg.add("validation_summary", lambda spark, d: rounded(reports.validation_summary(snaps(spark, d).select("symbol", "ts", F.col("rsi").alias("score")))), f"with {SNAPS_SQL}, t as (select * from snaps where rsi is not null qualify row_number() over (partition by symbol order by ts desc) <= 10) select symbol, {r('avg(rsi)', 'mean_score')}, {r('min(rsi)', 'least')}, {r('max(rsi)', 'most')}, case when arg_max(rsi, ts) > arg_min(rsi, ts) then 'improving' else 'declining' end as trend from t group by symbol")
    alert_sql = "al as (select *, case when rsi > 70 then 'RSI_HIGH' when rsi < 30 then 'RSI_LOW' when abs(change_pct) > 3 then 'MOVE' end as type, case when confidence > 85 then 'HIGH' else 'NORMAL' end as priority from snaps)"
    reg.add("alert_counts", lambda spark, d: reports.alert_counts(reports.alerting(snaps(spark, d))), f"with {SNAPS_SQL}, {alert_sql} select type, priority, count(*) as alerts, max(ts) as last_ts from al where type is not null group by all")
    reg.add("alert_history", lambda spark, d: reports.alert_history(reports.alerting(snaps(spark, d))).select("symbol", "ts", "type", "priority"), f"with {SNAPS_SQL}, {alert_sql} select symbol, ts, type, priority from al where type is not null order by ts desc, symbol limit 50")
    reg.add("indicator_summary", lambda spark, d: rounded(reports.indicator_summary(reports.indicator_votes(latest(snaps(spark, d), ["symbol"], [F.desc("ts")])))), f"""with {SNAPS_SQL}, n as (select * from snaps qualify row_number() over (partition by symbol order by ts desc) = 1),
        i as (select symbol, case when rsi > 70 then 'BEARISH' when rsi < 30 then 'BULLISH' else 'HOLD' end as s, confidence as c from n union all select symbol, case when macd > 0 then 'BULLISH' else 'BEARISH' end, 60 from n union all select symbol, case when momentum > 0 then 'BULLISH' else 'BEARISH' end, 50 from n)
        select symbol, count(*) as indicators, count(*) filter (where s = 'BULLISH') as bullish, count(*) filter (where s = 'BEARISH') as bearish, count(*) filter (where s = 'HOLD') as neutral, {r('avg(c)', 'mean_confidence')} from i group by symbol""")

    def quotes(spark, d):
        s = table(spark, d, "events").select(F.when(F.col("event_id") % 17 != 0, F.col("event_type")).alias("symbol"), "event_id", "ts", F.col("value").alias("bid"), (F.col("value") + F.col("event_id") % 5 - 1).alias("ask"))
        flags = quality.valid_quotes(s, F.lit("2024-01-30 23:30:00").cast("timestamp_ntz"), 86400)
        return flags.withColumn("error", F.when(F.col("missing"), "missing field").when(F.col("crossed"), "ask not over bid").when(F.col("stale"), "stale")).select("event_id", "missing", "crossed", "stale", "error")

    reg.add("quality_quotes", quotes, """with q as (select event_id, case when event_id % 17 <> 0 then event_type end as symbol, ts, value as bid, value + event_id % 5 - 1 as ask from events), f as (select event_id, symbol is null or bid is null or ask is null or ts is null as missing, coalesce(ask <= bid, false) as crossed, coalesce(epoch(timestamp '2024-01-30 23:30:00') - floor(epoch(ts)) > 86400, false) as stale from q)
        select *, case when missing then 'missing field' when crossed then 'ask not over bid' when stale then 'stale' end as error from f""")
    reg.add("scan_filter", lambda spark, d: rounded(reports.matching(snaps(spark, d), (210, 260), 500000, (-5, 5)).select("symbol", "ts", "price", "volume", "change_pct")), f"with {SNAPS_SQL} select symbol, ts, {r('price', 'price')}, {r('volume', 'volume')}, {r('change_pct', 'change_pct')} from snaps where price between 210 and 260 and volume >= 500000 and change_pct between -5 and 5")

    reg.add("running_metrics", lambda spark, d: rounded(reports.running_metrics(snaps(spark, d).where("rsi is not null").select("symbol", "ts", "confidence", (F.col("change_pct") > 0).alias("success"))), 8), f"with {SNAPS_SQL} select symbol, ts, count(*) over w as n, {r('avg(confidence) over w', 'mean_confidence', 8)}, {r('avg((change_pct > 0)::int) over w', 'success_rate', 8)} from snaps where rsi is not null window w as (partition by symbol order by ts rows unbounded preceding)")
