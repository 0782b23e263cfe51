"""Queries of risk, portfolio, joins and the query builder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions.windows import as_of_join
from tickloom.operators import joins, risk
from tickloom.plans.base import BARS_SQL, Registry, bars, lag, r, rounded
from tickloom.plans.query import Query, delete, insert, update
from tickloom.sources import market
from tickloom.sources.market import table

RET = f"x as (select symbol, ts, close / nullif({lag('close')}, 0) - 1 as r from bars), ret as (select *, row_number() over (partition by symbol order by ts desc) as rn from x where r is not null qualify rn <= 252)"

QUOTES_SQL = """quotes as (
    select 'S' || (l_partkey % 40) as symbol, 'V' || (l_suppkey % 6) as venue, round(avg(l_extendedprice / l_quantity), 4) as bid, round(avg(l_extendedprice / l_quantity), 4) * 1.001 as ask,
           round(avg(l_extendedprice / l_quantity), 4) as last, sum(l_quantity) as volume from lineitem group by 1, 2)"""

#: Trades of accounts: a line's account is its order's customer segment, its profit a fixed function of price, discount and tax.
TRADES_SQL = """trades as (
    select c_mktsegment as strategy, 'P' || (l_partkey % 25) as symbol, l_orderkey, l_linenumber, l_quantity as quantity, l_extendedprice / l_quantity as price, l_returnflag as flag,
           l_extendedprice * (l_discount - 0.05) as pnl, l_shipdate as ts from lineitem join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey)"""

POSITIONS_SQL = TRADES_SQL + """, positions as (
    select strategy as account, symbol, sum(case when flag = 'R' then -quantity else quantity end) as quantity, avg(price) as avg_cost,
           sum(case when flag = 'R' then -quantity else quantity end) * avg(price) as market_value, case when symbol < 'P2' then 1.2 end as beta from trades group by 1, 2)"""


def quotes(spark: SparkSession, d: str) -> DataFrame:
    price = F.round(F.avg(F.col("l_extendedprice") / F.col("l_quantity")), 4)
    lines = table(spark, d, "lineitem").select(F.concat(F.lit("S"), F.col("l_partkey") % 40).alias("symbol"), F.concat(F.lit("V"), F.col("l_suppkey") % 6).alias("venue"), "l_extendedprice", "l_quantity")
    return lines.groupBy("symbol", "venue").agg(price.alias("bid"), (price * 1.001).alias("ask"), price.alias("last"), F.sum("l_quantity").alias("volume"))


def trades(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("o_orderkey") == F.col("l_orderkey")).join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    return lines.select(F.col("c_mktsegment").alias("strategy"), F.concat(F.lit("P"), F.col("l_partkey") % 25).alias("symbol"), "l_orderkey", "l_linenumber", F.col("l_quantity").alias("quantity"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_returnflag").alias("flag"), (F.col("l_extendedprice") * (F.col("l_discount") - 0.05)).alias("pnl"), F.col("l_shipdate").alias("ts"))


def positions(spark: SparkSession, d: str) -> DataFrame:
    signed = F.sum(F.when(F.col("flag") == "R", -F.col("quantity")).otherwise(F.col("quantity")))
    out = trades(spark, d).groupBy(F.col("strategy").alias("account"), "symbol").agg(signed.alias("quantity"), F.avg("price").alias("avg_cost"), (signed * F.avg("price")).alias("market_value"))
    return out.withColumn("beta", F.when(F.col("symbol") < "P2", 1.2))


def _rets(spark: SparkSession, d: str) -> DataFrame:
    return risk.returns(bars(spark, d), "close", keep=252)


def register(reg: Registry) -> None:
    def over_returns(name: str, step, columns: str) -> None:
        reg.add(name, lambda spark, d: rounded(step(_rets(spark, d))), f"with {BARS_SQL}, {RET} {columns}")

    over_returns("risk_var_es", risk.value_at_risk, f""", c as (select symbol, count(*) as n, quantile_cont(r, 0.05) as p5, quantile_cont(r, 0.01) as p1 from ret group by symbol), t as (select ret.symbol, avg(r) as tail from ret join c on c.symbol = ret.symbol and r <= p5 group by 1)
        select c.symbol, n, {r('case when n >= 30 then abs(p5) else 0.0 end', 'var_95')}, {r('case when n >= 30 then abs(p1) else 0.0 end', 'var_99')}, {r('case when n >= 30 then abs(tail) else 0.0 end', 'expected_shortfall')} from c left join t using (symbol)""".replace(", c as", ", c as", 1).lstrip())
    over_returns("risk_volatility", risk.volatility, f"select symbol, {r('case when count(*) >= 10 then stddev_pop(r) * sqrt(252) else 0.2 end', 'volatility')} from ret group by symbol")
    over_returns("risk_performance", lambda x: risk.performance(x).withColumn("compound_return", F.signum("compound_return") * F.log1p(F.abs("compound_return"))), f"""select symbol, count(*) as n, {r('sign(product(1 + r) - 1) * ln(1 + abs(product(1 + r) - 1))', 'compound_return')},
        {r('case when stddev_samp(r) > 0 then avg(r) / stddev_samp(r) else 0.0 end', 'sharpe')}, {r('case when avg(pow(least(r, 0.0), 2)) > 0 then avg(r) / sqrt(avg(pow(least(r, 0.0), 2))) else 0.0 end', 'sortino')}, {r('avg((r > 0)::int)', 'win_rate')} from ret group by symbol""")
    dd = "d as (select *, max(close) over (partition by symbol order by ts rows unbounded preceding) as peak from bars), e as (select *, case when peak > 0 then (peak - close) / peak * 100 else 0.0 end as dd from d)"
    reg.add("risk_drawdown", lambda spark, d: rounded(risk.drawdown(bars(spark, d), "close").select("symbol", "ts", "peak", "drawdown_pct")), f"with {BARS_SQL}, {dd} select symbol, ts, {r('peak', 'peak')}, {r('dd', 'drawdown_pct')} from e")
    reg.add("risk_max_drawdown", lambda spark, d: rounded(risk.max_drawdown(bars(spark, d), "close")), f"with {BARS_SQL}, {dd} select symbol, {r('max(dd)', 'max_drawdown_pct')}, {r('arg_max(dd, ts)', 'current_drawdown_pct')} from e group by symbol")
    grown = "case when days > 0 and f > 0 then pow(l / f, 365.25 / days) - 1 end"
    reg.add("risk_annualised", lambda spark, d: rounded(risk.annualised(bars(spark, d), "close").withColumn("annualised_return", F.log1p(F.greatest("annualised_return", F.lit(-0.999))))), f"with {BARS_SQL}, g as (select symbol, arg_min(close, ts) as f, arg_max(close, ts) as l, (max(ts)::date - min(ts)::date)::int as days from bars group by symbol) select symbol, {r('f', 'first_value')}, {r('l', 'last_value')}, days, {r(f'ln(1 + greatest({grown}, -0.999))', 'annualised_return')} from g")
    metrics = """m as (select strategy, count(*) as trades, count(*) filter (where pnl > 0) as wins, coalesce(avg(pnl) filter (where pnl > 0), 0) as avg_win, coalesce(avg(-pnl) filter (where pnl < 0), 0) as avg_loss,
        coalesce(sum(pnl), 0) as total_pnl, count(*) filter (where pnl > 0) / count(*) as win_rate, sum(pnl) filter (where pnl > 0) / sum(-pnl) filter (where pnl < 0) as profit_factor from trades group by strategy)"""
    shown = ", ".join(["strategy", "trades", "wins", r("avg_win", "avg_win"), r("avg_loss", "avg_loss"), r("total_pnl", "total_pnl", 3), r("win_rate", "win_rate"), r("profit_factor", "profit_factor")])
    fix = lambda x: x.withColumn("total_pnl", F.round("total_pnl", 3))
    reg.add("strategy_metrics", lambda spark, d: rounded(fix(risk.trade_metrics(trades(spark, d)))), f"with {TRADES_SQL}, {metrics} select {shown} from m")
    kelly = "case when trades < 20 then 0.02 when avg_loss = 0 then 0.01 else greatest(0.0, least(0.25, ((avg_win / avg_loss) * win_rate - (1 - win_rate)) / (avg_win / avg_loss) * 0.999)) end"
    reg.add("strategy_kelly", lambda spark, d: rounded(fix(risk.kelly(risk.trade_metrics(trades(spark, d))))), f"with {TRADES_SQL}, {metrics} select {shown}, {r(kelly, 'kelly')} from m")
    reg.add("strategy_best", lambda spark, d: rounded(risk.best_strategies(risk.trade_metrics(trades(spark, d)), limit=3).select("strategy", F.round("score", 3).alias("score"))), f"with {TRADES_SQL}, {metrics} select strategy, {r('total_pnl * win_rate', 'score', 3)} from m where trades >= 10 order by total_pnl * win_rate desc, strategy limit 3")
    reg.add("portfolio_positions", lambda spark, d: rounded(positions(spark, d), 4), f"with {POSITIONS_SQL} select account, symbol, {r('quantity', 'quantity', 4)}, {r('avg_cost', 'avg_cost', 4)}, {r('market_value', 'market_value', 4)}, beta from positions")
    reg.add("portfolio_weights", lambda spark, d: rounded(risk.weights(positions(spark, d)).select("account", "symbol", "weight")), f"with {POSITIONS_SQL} select account, symbol, {r('market_value / nullif(sum(market_value) over (partition by account), 0)', 'weight')} from positions")

    def targets(spark, d):
        held = positions(spark, d)
        return held.where("symbol < 'P3'").select("account", "symbol", F.lit(0.08).alias("target")).unionByName(held.select("account", F.lit("NEW").alias("symbol"), F.lit(0.1).alias("target")).distinct())

    reg.add("portfolio_rebalancing", lambda spark, d: rounded(risk.rebalancing(positions(spark, d), targets(spark, d))), f"""with {POSITIONS_SQL}, t as (select account, symbol, 0.08 as target from positions where symbol < 'P3' union all select distinct account, 'NEW', 0.1 from positions),
        w as (select account, symbol, market_value / nullif(sum(market_value) over (partition by account), 0) as weight from positions), x as (select account, symbol, target::double as target, coalesce(weight, 0.0) as weight from t left join w using (account, symbol))
        select account, symbol, target, {r('weight', 'weight')}, {r('weight - target', 'drift')}, abs(weight - target) > 0.05 as drifted from x""")
    expo = """e as (select account, count(*) as positions, sum(market_value) + 100000 as total, sum(abs(market_value)) as gross, sum(abs(market_value) * coalesce(beta, 1.0)) as b, max(abs(market_value)) as most, count(*) filter (where market_value > 0) as long_count, count(*) filter (where market_value < 0) as short_count from positions group by account)"""
    reg.add("portfolio_exposure", lambda spark, d: rounded(risk.exposure(positions(spark, d), 100000.0), 4), f"with {POSITIONS_SQL}, {expo} select account, positions, {r('total', 'total_value', 4)}, {r('gross / total', 'leverage', 4)}, {r('b / total', 'beta', 4)}, {r('most / total', 'max_weight', 4)}, long_count, short_count from e")
    reg.add("risk_events", lambda spark, d: rounded(risk.risk_events(risk.exposure(positions(spark, d), 100000.0).withColumn("drawdown_pct", F.col("leverage") * 16)), 4), f"""with {POSITIONS_SQL}, {expo}, m as (select account, gross / total as lever, most / total as weight, gross / total * 16 as fall from e)
        select account, 'DRAWDOWN' as event, 'HIGH' as severity, {r('fall', 'value', 4)} from m where fall > 15 union all select account, 'LEVERAGE', case when lever > 2 then 'CRITICAL' else 'HIGH' end, {r('lever', 'value', 4)} from m where lever > 1.5 union all select account, 'CONCENTRATION', 'MEDIUM', {r('weight', 'value', 4)} from m where weight > 0.1""")
    reg.add("portfolio_allocation", lambda spark, d: rounded(risk.allocation(positions(spark, d).withColumn("asset_type", F.substring("symbol", 2, 1))), 4), f"with {POSITIONS_SQL}, a as (select symbol[2] as asset_type, count(*) as positions, sum(market_value) as mv from positions group by 1) select asset_type, positions, {r('mv', 'market_value', 4)}, {r('mv / sum(mv) over ()', 'share', 4)} from a")
    snaps = f"s as (select ts, symbol, volume, (close - {lag('close')}) / nullif({lag('close')}, 0) * 100 as c from bars)"

    def cross(spark, d):
        rows = bars(spark, d)
        from tickloom.functions.windows import lag as before

        return rounded(risk.cross_section(rows.select("ts", "symbol", "volume", ((F.col("close") - before("close")) / F.nullif(before("close"), F.lit(0.0)) * 100).alias("change_pct"))))

    reg.add("market_cross_section", cross, f"""with {BARS_SQL}, {snaps}, g as (select ts, count(*) as symbols, count(c) as n, avg(c) as m, stddev_pop(c) as sd, count(*) filter (where c > 0) as up, count(*) filter (where c < 0) as down, max(abs(c)) as most, avg(ln(1 + volume)) as lv, stddev_pop(ln(1 + volume)) as ls from s group by ts),
        a as (select s.ts, avg(abs(c - m)) as mad from s join g using (ts) group by 1) select ts, symbols, {r('m', 'mean_change')}, {r('sd', 'std_change')}, {r('up / nullif(n, 0)', 'share_up')}, {r('most', 'max_change')}, {r('lv', 'mean_log_volume')}, {r('ls / (lv + 1e-8)', 'cv_volume')}, {r('case when n < 2 then 0.5 else greatest(up, down) / n end', 'agreement')},
        {r('case when n < 2 or sd = 0 then 0.5 else greatest(0.0, least(1.0, 1 - mad / sd)) end', 'coherence')} from g left join a using (ts)""")
    reg.queries["market_cross_section"] = cross

    def summary(spark, d):
        orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_orderstatus").alias("status"), (F.col("o_totalprice") / 1000).alias("order_quantity"))
        fills = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("order_id"), F.col("l_quantity").alias("quantity"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), (F.col("l_extendedprice") * F.col("l_tax")).alias("commission"))
        return rounded(risk.execution_summary(orders, fills), 2)

    reg.add("execution_summary", summary, f"""with f as (select l_orderkey as k, sum(l_quantity) as q, sum(l_quantity * (l_extendedprice / l_quantity)) as n, sum(l_extendedprice * l_tax) as c from lineitem group by 1)
        select o_orderstatus as status, count(*) as orders, {r('sum(coalesce(q, 0.0))', 'filled', 2)}, {r('sum(coalesce(n, 0.0))', 'notional', 2)}, {r('sum(coalesce(c, 0.0))', 'commission', 2)}, {r('avg(case when o_totalprice > 0 then coalesce(q, 0.0) / (o_totalprice / 1000) end)', 'fill_rate', 2)} from orders left join f on k = o_orderkey group by 1""")
    # joins
    reg.add("join_arbitrage", lambda spark, d: rounded(joins.arbitrage(quotes(spark, d)), 5), f"""with {QUOTES_SQL} select a.symbol, a.venue as buy_venue, b.venue as sell_venue, {r('a.ask', 'buy_price', 5)}, {r('b.bid', 'sell_price', 5)}, {r('(b.bid - a.ask) / a.ask * 100', 'profit_pct', 5)}, least(a.volume, b.volume) as max_size
        from quotes a join quotes b on a.symbol = b.symbol and a.venue <> b.venue and b.bid > a.ask and (b.bid - a.ask) / a.ask * 100 >= 0.5""")
    reg.add("join_best_venues", lambda spark, d: rounded(joins.best_venues(quotes(spark, d)), 5), f"""with {QUOTES_SQL}, g as (select symbol, first(venue order by last, venue) as buy_venue, last(venue order by last, venue) as sell_venue, min(last) as lo, max(last) as hi from quotes group by symbol)
        select symbol, buy_venue, sell_venue, {r('lo', 'buy_price', 5)}, {r('hi', 'sell_price', 5)}, {r('(hi - lo) / lo * 100', 'profit_pct', 5)} from g where (hi - lo) / lo * 100 > 0.5 and buy_venue <> sell_venue""")

    def rates(spark, d):
        n = table(spark, d, "nation")
        return n.select(F.col("n_nationkey").alias("idx"), F.col("n_name").alias("currency"), ((F.col("n_nationkey") * 37 % 25) / 4).alias("rate"), F.when(F.col("n_nationkey") % 3 > 0, (F.col("n_nationkey") % 7) / 7).alias("risk"))

    reg.add("join_carry_pairs", lambda spark, d: rounded(joins.carry_pairs(rates(spark, d))), f"""with n as (select n_nationkey as idx, n_name as currency, (n_nationkey * 37 % 25) / 4 as rate, case when n_nationkey % 3 > 0 then (n_nationkey % 7) / 7 end as risk from nation),
        p as (select a.currency as long_currency, b.currency as short_currency, a.rate - b.rate as differential, (coalesce(a.risk, 0.5) + coalesce(b.risk, 0.5)) / 2 as risk from n a join n b on a.idx < b.idx and a.rate - b.rate > 0.1), s as (select *, differential / (1 + risk) as score from p)
        select long_currency, short_currency, {r('differential', 'differential')}, {r('risk', 'risk')}, {r('score', 'score')}, case when score > 3 then 'STRONG_BUY' when score > 2 then 'BUY' when score > 1 then 'HOLD' when score > 0.5 then 'WEAK' else 'AVOID' end as advice from s""")

    def held(spark, d):
        return positions(spark, d).where("symbol <> 'P3'").withColumn("side", F.when(F.col("quantity") < 0, "SHORT").otherwise("LONG"))

    def prices(spark, d):
        p = table(spark, d, "part")
        return p.groupBy(F.concat(F.lit("P"), F.col("p_partkey") % 30).alias("symbol")).agg((F.avg("p_retailprice") * 2).alias("price"), F.avg("p_size").alias("change")).where("symbol <> 'P5'")

    prices_sql = "prices as (select 'P' || (p_partkey % 30) as symbol, avg(p_retailprice) * 2 as price, avg(p_size) as change from part group by 1 having symbol <> 'P5'), held as (select *, case when quantity < 0 then 'SHORT' else 'LONG' end as side from positions where symbol <> 'P3')"
    marked = prices_sql + ", marked as (select h.*, price, change, (case when side = 'SHORT' then -1.0 else 1.0 end) as sgn from held h left join prices p on p.symbol = h.symbol)"
    pct = "case when avg_cost <> 0 then sgn * (price / avg_cost - 1) * 100 end"
    reg.add("join_mark_to_market", lambda spark, d: rounded(joins.mark_to_market(held(spark, d), prices(spark, d)).select("account", "symbol", "side", "price", "unrealised_pnl", "unrealised_pct", "day_change"), 3), f"with {POSITIONS_SQL}, {marked} select account, symbol, side, {r('price', 'price', 3)}, {r('sgn * quantity * (price - avg_cost)', 'unrealised_pnl', 3)}, {r(pct, 'unrealised_pct', 3)}, {r('sgn * quantity * change', 'day_change', 3)} from marked")
    reg.add("join_exits", lambda spark, d: rounded(joins.exits(joins.mark_to_market(held(spark, d), prices(spark, d))).select("account", "symbol", "reason")), f"with {POSITIONS_SQL}, {marked}, x as (select account, symbol, {pct} as p from marked) select account, symbol, case when p <= -5 then 'STOP_LOSS' when p >= 10 then 'TAKE_PROFIT' else 'LOSS_LIMIT' end as reason from x where p <= -5 or p >= 10")
    reg.add("join_candidates_anti", lambda spark, d: rounded(joins.candidates(prices(spark, d), held(spark, d)), 4), f"with {POSITIONS_SQL}, {prices_sql} select symbol, {r('price', 'price', 4)}, {r('change', 'change', 4)} from prices where symbol not in (select symbol from held)")

    def as_of(spark, d):
        ticks = market.ticks(table(spark, d, "events")).select("symbol", "ts", "event_id")
        return rounded(as_of_join(ticks, bars(spark, d).select("symbol", "ts", "close", "volume"), "symbol", "ts", ["close", "volume"]))

    as_of_sql = f"with {BARS_SQL} select t.symbol, t.ts, t.event_id, {r('b.close', 'close')}, {r('b.volume', 'volume')} from %s t asof left join bars b on t.symbol = b.symbol and t.ts >= b.ts"
    reg.add("join_as_of", as_of, f"with {BARS_SQL} select t.symbol, t.ts, t.event_id, {r('b.close', 'close')}, {r('b.volume', 'volume')} from ticks t asof left join bars b on t.symbol = b.symbol and t.ts >= b.ts")
    reg.add("join_as_of_all", as_of, as_of_sql.replace("%s", "ticks"))

    def balances(spark, d):
        a = table(spark, d, "customer").select(F.col("c_nationkey").alias("currency"), F.col("c_acctbal").alias("balance"))
        b = table(spark, d, "supplier").select(F.col("s_nationkey").alias("currency"), F.col("s_acctbal").alias("balance"))
        return rounded(joins.total_by_key([a, b], "currency", "balance"), 2)

    reg.add("union_balances", balances, f"select currency, {r('sum(balance)', 'balance', 2)} from (select c_nationkey as currency, c_acctbal as balance from customer union all select s_nationkey, s_acctbal from supplier) group by currency")

    # query builder
    def q(spark, d, *names):
        return Query(spark, {n: table(spark, d, n) for n in names})

    reg.add("query_filters", lambda spark, d: q(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice").from_table("orders").where("o_totalprice > ?", 100000).where_eq("o_orderstatus", "O").where_in("o_orderpriority", ["1-URGENT", "2-HIGH"]).where_between("o_totalprice", 120000, 480000).where_like("o_orderpriority", "%h%").frame(),
            "select o_orderkey, o_orderstatus, o_totalprice from orders where o_totalprice > 100000 and o_orderstatus = 'O' and o_orderpriority in ('1-URGENT', '2-HIGH') and o_totalprice between 120000 and 480000 and o_orderpriority ilike '%h%'")
    group = lambda x: x.group_by("n_name").aggregate(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("total"))
    reg.add("query_join_group_having_top", lambda spark, d: group(q(spark, d, "customer", "nation").from_table("customer").inner_join("nation", "customer.c_nationkey = nation.n_nationkey").where("c_acctbal > ?", 0)).having("n > ?", 5).order_by_desc("total").order_by_asc("n_name").limit(10).offset(2).frame(),
            "select n_name, count(*) as n, round(sum(c_acctbal), 2) as total from customer join nation on c_nationkey = n_nationkey where c_acctbal > 0 group by n_name having count(*) > 5 order by total desc, n_name limit 10 offset 2")
    for how, sql in (("left", "left join"), ("right", "right join"), ("full", "full join")):
        reg.add(f"query_{how}_join", lambda spark, d, how=how: q(spark, d, "supplier", "nation").select("s_suppkey", "n_name").from_table("supplier").join("nation", "supplier.s_nationkey = nation.n_nationkey and supplier.s_acctbal > 5000", how).frame(), f"select s_suppkey, n_name from supplier {sql} nation on s_nationkey = n_nationkey and s_acctbal > 5000")
    reg.add("query_semi_join", lambda spark, d: q(spark, d, "customer", "orders").select("c_custkey").from_table("customer").semi_join("orders", "customer.c_custkey = orders.o_custkey and orders.o_totalprice > 400000").frame(), "select c_custkey from customer where exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 400000)")
    reg.add("query_anti_join", lambda spark, d: q(spark, d, "customer", "orders").select("c_custkey").from_table("customer").anti_join("orders", "customer.c_custkey = orders.o_custkey").frame(), "select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey)")
    reg.add("query_theta_join", lambda spark, d: q(spark, d, "nation", "region").select("n_name", "r_name").from_table("nation").join("region", "nation.n_regionkey < region.r_regionkey").frame(), "select n_name, r_name from nation join region on n_regionkey < r_regionkey")
    reg.add("query_order_nulls", lambda spark, d: q(spark, d, "nation").select("n_nationkey", "nullif(n_regionkey, 1) as k").from_table("nation").order_by_asc("k").order_by_desc("n_nationkey").limit(8).frame(), "select n_nationkey, nullif(n_regionkey, 1) as k from nation order by k asc nulls first, n_nationkey desc limit 8")
    reg.add("query_insert", lambda spark, d: insert(table(spark, d, "region"), r_regionkey=99, r_name="NOWHERE"), "select * from region union all select 99, 'NOWHERE'")
    reg.add("query_update", lambda spark, d: update(table(spark, d, "nation"), F.col("n_regionkey") == 2, n_name="CHANGED"), "select n_nationkey, case when n_regionkey = 2 then 'CHANGED' else n_name end as n_name, n_regionkey from nation")
    reg.add("query_delete", lambda spark, d: delete(table(spark, d, "nation"), F.col("n_regionkey") == 2), "select * from nation where n_regionkey <> 2 or n_regionkey is null")
    reg.add("query_rollup", lambda spark, d: table(spark, d, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n")), "select o_orderstatus, o_orderpriority, count(*) as n from orders group by rollup (o_orderstatus, o_orderpriority)")
    reg.add("query_cube", lambda spark, d: table(spark, d, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.round(F.sum("o_totalprice"), 2).alias("total")), "select o_orderstatus, o_orderpriority, round(sum(o_totalprice), 2) as total from orders group by cube (o_orderstatus, o_orderpriority)")
    reg.add("query_set_ops", lambda spark, d: table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).intersect(table(spark, d, "supplier").select("s_nationkey")).subtract(table(spark, d, "region").select("r_regionkey")), "select c_nationkey as k from customer intersect select s_nationkey from supplier except select r_regionkey from region")
