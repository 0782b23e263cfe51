"""Queries of record checks, presets, look-backs and messages, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions import text
from tickloom.operators import checks, regimes, risk, scanner
from tickloom.plans.base import BARS_SQL, Registry, bars, r, rounded
from tickloom.plans.market_queries import PREP, SCANS_SQL
from tickloom.sources.market import table
from tickloom.streaming import machines, market

NOW = "2024-01-30 23:30:00"
WORDS = ("market", "water", "river", "system", "school", "music", "energy", "price", "company", "history", "science", "government", "family", "health", "trade")


def live(spark, d):
    """Events as live records: every kind in turn, some wrong."""
    c, k = F.col, F.coalesce(F.from_json("props", "k double")["k"], F.lit(0.0))
    i = c("event_id")
    pair = lambda p, s: F.struct(p.alias("price"), s.alias("size"))
    kind = F.element_at(F.array(*[F.lit(x) for x in ("quote", "trade", "orderbook", "candle")]), (i % 4 + 1).cast("int"))
    e = table(spark, d, "events").withColumn("k", k)
    return e.select(
        i.alias("record_id"), kind.alias("kind"), F.when(i % 11 != 0, c("value")).alias("bid"), (c("value") + c("k") - 20).alias("ask"), (c("value") - 2).alias("price"), c("k").alias("size"), F.when(i % 13 != 0, F.array(pair(c("value"), c("k")))).alias("bids"),
        F.when(i % 17 == 2, F.array().cast("array<struct<price: double, size: double>>")).otherwise(F.array(pair(c("value") + c("k") - 20, c("k") + 1))).alias("asks"), "ts",
    )


LIVE_SQL = f"""with e as (select event_id as i, value, coalesce((props->>'$.k')::double, 0.0) as k, epoch(timestamp '{NOW}') - epoch(ts) as age from events),
    l as (select i, (['quote', 'trade', 'orderbook', 'candle'])[i % 4 + 1] as kind, case when i % 11 <> 0 then value end as bid, value + k - 20 as ask, value - 2 as price, k, i % 13 <> 0 as has_bids, i % 17 = 2 as no_asks, value, age from e)
    select i as record_id, kind, case when kind = 'candle' then 'unknown_kind' when kind = 'quote' and (bid is null or ask is null) then 'missing' when kind = 'orderbook' and not has_bids then 'missing' when kind = 'orderbook' and no_asks then 'empty_side'
        when kind = 'quote' and (bid <= 0 or ask <= 0) then 'not_positive' when kind = 'trade' and (price <= 0 or k <= 0) then 'not_positive' when kind = 'orderbook' and (value <= 0 or k <= 0 or ask <= 0) then 'not_positive'
        when kind = 'quote' and bid >= ask then 'crossed' when kind = 'orderbook' and value >= ask then 'crossed' when age > 864000 then 'stale' end as error from l"""


def feed(spark, d):
    """Events as JSON text of a feed: tickers, trades, book updates, and noise."""
    i = F.col("event_id")
    ticker = F.to_json(F.struct(F.lit("ticker").alias("stream"), F.col("event_type").alias("symbol"), F.col("value").alias("price"), F.lit(1.0).alias("volume")))
    trade = F.to_json(F.struct(F.lit("x@trade").alias("stream"), F.col("event_type").alias("symbol"), F.col("value").alias("price"), F.lit(2.0).alias("volume"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("trade_ts")))
    change = F.to_json(F.struct(F.lit("l2update").alias("type"), F.col("event_type").alias("product_id"), i.alias("sequence"), F.array(F.array(F.when(i % 2 == 0, "buy").otherwise("sell"), F.col("value").cast("string"), F.lit("3"))).alias("changes")))
    return table(spark, d, "events").select("event_id", F.when(i % 4 == 0, ticker).when(i % 4 == 1, trade).when(i % 4 == 2, change).otherwise("no message").alias("value"))


def register(reg: Registry) -> None:
    age = lambda: F.unix_timestamp(F.lit(NOW).cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    reg.add("checks_live", lambda spark, d: live(spark, d).select("record_id", "kind", checks.live_error(age(), 864000).alias("error")), LIVE_SQL)

    def parameters(spark, d):
        o = table(spark, d, "orders")
        word = F.when(F.col("o_orderkey") % 5 == 0, "BTC-USD").otherwise(F.substring("o_orderpriority", 3, 12))
        quantity = F.when(F.col("o_orderkey") % 7 == 0, F.lit("many")).otherwise((F.col("o_custkey") - 3).cast("string"))
        return o.select("o_orderkey", checks.parameter_error(word, quantity, F.col("o_totalprice") * 3).alias("error"))

    reg.add("checks_parameters", parameters, """select o_orderkey, case when not regexp_full_match(upper(case when o_orderkey % 5 = 0 then 'BTC-USD' else substr(o_orderpriority, 3, 12) end), '[A-Z]{1,10}') then 'symbol' when o_orderkey % 7 = 0 or o_custkey - 3 <= 0 or o_custkey - 3 > 1000000 then 'quantity' when o_totalprice * 3 <= 0 or o_totalprice * 3 > 1000000 then 'price' end as error from orders""")
    flawed = lambda spark, d: bars(spark, d).withColumn("high", F.when((F.col("symbol") == "view") & (F.hour("ts") == 5), F.col("low") - 1).otherwise(F.col("high")))
    reg.add("checks_series", lambda spark, d: checks.whole_series(flawed(spark, d)), f"with {BARS_SQL} select symbol, count(*) as bars, count(*) filter (where symbol = 'view' and hour(ts) = 5) as broken, count(*) filter (where symbol = 'view' and hour(ts) = 5) = 0 as usable from bars group by symbol")
    reg.add("checks_categories", lambda spark, d: checks.kept_categories(table(spark, d, "part").select(F.col("p_brand").alias("category"), (F.col("p_partkey") % 40).cast("int").alias("feature")).distinct(), [3, 30, 7, 19]).select("category", F.concat_ws(",", F.transform("indexes", lambda x: x.cast("string"))).alias("indexes")),
        "with m as (select distinct p_brand as category, case p_partkey % 40 when 3 then 0 when 30 then 1 when 7 then 2 when 19 then 3 end as n from part) select category, string_agg(n::varchar, ',' order by n) as indexes from m where n is not null group by category")
    reg.add("risk_compound", lambda spark, d: rounded(checks.compound(risk.returns(bars(spark, d), "close").where(F.col("r") < 1))), f"with {BARS_SQL}, a as (select symbol, close, lag(close) over (partition by symbol order by ts) as b from bars), x as (select symbol, close / b - 1 as r from a where b > 0 and close / b - 1 < 1) select symbol, {r('case when max((r <= -1)::int) = 1 then -1.0 else exp(sum(case when r > -1 then ln(1 + r) end)) - 1 end', 'compound_return')} from x group by symbol")
    reg.add("scan_history", lambda spark, d: rounded(scanner.history(scanner.scan(bars(spark, d)), F.lit(NOW).cast("timestamp_ntz"), 168, 100)), f"with {BARS_SQL}, {PREP}, s as (select * from ({' union all '.join(SCANS_SQL.values())}) where score >= 0.5 and confidence >= 0.5 and ts >= timestamp '{NOW}' - interval 168 hour order by ts desc, symbol, scan limit 100) select symbol, ts, scan, {r('score', 'score')}, {r('confidence', 'confidence')}, alert, {r('close', 'close')} from s")
    reg.add("scan_breakout_preset", lambda spark, d: rounded(scanner.breakout_preset(bars(spark, d), volume=100, least_score=0.6)), f"with {BARS_SQL}, {PREP}, s as (select x.* from ({SCANS_SQL['breakout']}) x join (select symbol as y, ts as t from p where volume >= 100 and v20 >= 1.5) on symbol = y and ts = t where score >= 0.6) select symbol, ts, scan, {r('score', 'score')}, {r('confidence', 'confidence')}, alert, {r('close', 'close')} from s")
    reg.add("scan_momentum_preset", lambda spark, d: rounded(scanner.momentum_preset(bars(spark, d), F.when(F.col("symbol").isin("click", "error"), "stock").otherwise("crypto"), least_score=0.6)), f"with {BARS_SQL}, {PREP}, s as (select x.* from ({SCANS_SQL['momentum']}) x join (select symbol as y, ts as t from p where rsi between 60 and 80 and chg >= 3 and symbol in ('click', 'error')) on symbol = y and ts = t where score >= 0.6) select symbol, ts, scan, {r('score::double', 'score')}, {r('confidence', 'confidence')}, alert, {r('close', 'close')} from s")
    known = "[" + ", ".join(f"'{w}'" for w in WORDS) + "]"
    reg.add("text_known_words", lambda spark, d: table(spark, d, "documents").select("doc_id", F.concat_ws(",", text.keywords(F.col("text"), list(WORDS))).alias("words")), f"""with t as (select doc_id, list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z]+')) as w from documents) select doc_id, array_to_string(list_slice(list_sort(list_filter({known}, lambda k: list_contains(w, k))), 1, 10), ',') as words from t""")
    reg.add("text_market_hours", lambda spark, d: table(spark, d, "events").select("event_id", text.in_market_hours(F.col("ts").cast("timestamp")).alias("open"), text.is_trading_day(F.col("ts")).alias("weekday")), "select event_id, isodow(ts - interval 5 hour) < 6 and hour(ts - interval 5 hour) * 60 + minute(ts - interval 5 hour) between 570 and 959 as open, isodow(ts) < 6 as weekday from events")
    reg.add("vector_distances", lambda spark, d: rounded(table(spark, d, "embeddings").select("vec_id", regimes.euclidean(F.col("embedding"), F.array(*[F.lit(0.1)] * 64)).alias("distance"))), f"select vec_id, {r('sqrt(list_sum(list_transform(embedding, lambda x: pow(x::double - 0.1, 2))))', 'distance')} from embeddings")
    reg.add("stream_feed", lambda spark, d: market.messages(feed(spark, d), received=F.lit(NOW).cast("timestamp")).select("kind", "symbol", F.col("ts").cast("timestamp_ntz").alias("ts"), "price", "volume"), f"select case event_id % 4 when 0 then 'ticker' else 'trade' end as kind, event_type as symbol, case event_id % 4 when 0 then timestamp '{NOW}' else ts end as ts, value as price, case event_id % 4 when 0 then 1.0 else 2.0 end as volume from events where event_id % 4 < 2")
    reg.add("stream_book_feed", lambda spark, d: machines.book_messages(feed(spark, d)).select("symbol", "seq", "kind", F.try_element_at("bids", F.lit(1))["price"].alias("bid"), F.try_element_at("asks", F.lit(1))["price"].alias("ask")), "select event_type as symbol, event_id as seq, 'change' as kind, case when event_id % 2 = 0 then value end as bid, case when event_id % 2 = 1 then value end as ask from events where event_id % 4 = 2")

    def summary(spark, d):
        e = table(spark, d, "events").withColumns({"account": F.col("user_id") % 25, "k": F.coalesce(F.from_json("props", "k double")["k"], F.lit(0.0))})
        metrics = e.select("account", F.struct("ts", "event_id").alias("ts"), (F.col("value") * 100).alias("value"), (F.col("k") / 200).alias("volatility"), (F.col("value") / 400).alias("drawdown"))
        events = e.where("event_type = 'error'").select("account", "ts", F.when(F.col("k") > 90, "CRITICAL").when(F.col("k") > 70, "HIGH").otherwise("LOW").alias("severity"))
        positions = e.groupBy("account", "event_type").agg((F.avg("k") / 70).alias("risk_score"))
        return rounded(checks.risk_summary(metrics, events, positions).withColumn("ts", F.col("ts.ts")))

    reg.add("risk_summary", summary, f"""with e as (select *, user_id % 25 as account, coalesce((props->>'$.k')::double, 0.0) as k from events), m as (select account, ts, value * 100 as value, k / 200 as volatility, value / 400 as drawdown from e qualify row_number() over (partition by account order by ts desc, event_id desc) = 1),
        p as (select account, count(*) filter (where s > 0.7) as n from (select account, event_type, avg(k) / 70 as s from e group by all) group by 1), v as (select account, count(*) filter (where k > 70) as n from (select * from e where event_type = 'error' qualify row_number() over (partition by account order by ts desc, case when k > 90 then 'CRITICAL' when k > 70 then 'HIGH' else 'LOW' end desc) <= 10) group by 1)
        select account, ts, {r('value', 'value')}, {r('volatility', 'volatility')}, {r('drawdown', 'drawdown')}, coalesce(p.n, 0) as risky_positions, coalesce(v.n, 0)::int as recent_severe, case when coalesce(v.n, 0) >= 3 or drawdown > 0.2 then 'CRITICAL' when coalesce(p.n, 0) >= 3 or coalesce(v.n, 0) >= 1 then 'HIGH' when volatility > 0.3 then 'MEDIUM' else 'LOW' end as level from m left join p using (account) left join v using (account)""")
