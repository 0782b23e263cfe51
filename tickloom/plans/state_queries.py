"""Queries of keyed state: clusters, books, histories, levels, and states saved and restored."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.windows import lag, last
from tickloom.plans.base import Registry, bars, full, r, rounded
from tickloom.plans.base import lag as lag_sql
from tickloom.sources.market import table
from tickloom.streaming import keyed, machines, market
from tickloom.streaming.snapshots import Snapshots, newer, shared_folder


def vectors(rows: DataFrame) -> DataFrame:
    """(symbol, ts, features) of bars: change, distance from the mean of 20, range and volume against its mean, each in units that a few make much."""
    c = F.col
    mean, size = F.avg("close").over(last(20)), F.avg("volume").over(last(20))
    over = lambda a, b: a / F.nullif(b, F.lit(0.0))
    named = [(over(c("close"), lag("close")) - 1) * 2, over(c("close"), mean) - 1, over(c("high") - c("low"), c("close")) - 1, over(c("volume"), size) - 1]
    return rows.select("symbol", "ts", F.array(*[F.coalesce(x, F.lit(0.0)) for x in named]).alias("features"))


def fills(spark, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("fill_id"), F.concat(F.lit("P"), F.col("l_partkey") % 25).alias("symbol"), F.col("l_shipdate").alias("ts"), F.when(F.col("l_returnflag") == "R", "SELL").otherwise("BUY").alias("side"),
        F.col("l_quantity").alias("quantity"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
    )


def restored(rows: DataFrame, machine: keyed.Machine, split, ties: tuple[str, ...] = ()) -> DataFrame:
    """What a machine gives for rows up to a time, whose states are then saved, and for the rest, which goes on from the states as restored."""
    spark = rows.sparkSession
    store = Snapshots(spark, shared_folder(spark, "states"))
    first = rows.where(F.col(machine.order) < split)
    store.save(keyed.end_states(first, machine, ties=ties))
    states = store.restore()
    return keyed.run(first, machine, ties=ties).unionByName(keyed.run(newer(rows, states, machine.key, machine.order), machine, states, ties))


def messages(spark, d: str) -> DataFrame:
    """Book messages of events: one price each, or two a side in a snapshot; numbered by symbol, with some lost."""
    e = table(spark, d, "events")
    n = F.row_number().over(Window.partitionBy("event_type").orderBy("ts", "event_id")).cast("long")
    k = F.coalesce(F.from_json("props", "k long")["k"], F.lit(0))
    e = e.select(F.col("event_type").alias("symbol"), n.alias("seq"), k.alias("k"), F.floor("value").cast("double").alias("p"), (F.col("event_id") % 2 == 0).alias("buys"), "user_id").where("user_id % 97 <> 0")
    one = lambda price, size: F.struct(price.alias("price"), size.cast("double").alias("size"))
    c, none = F.col, F.array().cast("array<struct<price: double, size: double>>")
    whole = c("k") % 25 == 0
    two = lambda a, step: F.array(one(a, c("k") + 1), one(a + step, c("k") + 2))
    change = F.array(one(c("p"), c("k") % 7)), F.array(one(c("p") + 50, c("k") % 7))
    return e.select("symbol", "seq", F.when(whole, "snapshot").otherwise("change").alias("kind"), F.when(whole, two(c("p"), -1)).when(c("buys"), change[0]).otherwise(none).alias("bids"), F.when(whole, two(c("p") + 50, 1)).when(~c("buys"), change[1]).otherwise(none).alias("asks"))


BOOK_SQL = """with e as (select event_type as symbol, row_number() over (partition by event_type order by ts, event_id) as seq, coalesce((props->>'$.k')::bigint, 0) as k, floor(value) as p, event_id % 2 = 0 as buys, user_id from events),
    m as (select *, k % 25 = 0 as whole, lag(seq) over (partition by symbol order by seq) as before from e where user_id % 97 <> 0),
    g as (select *, (not whole and before is not null and seq <> before + 1)::int as missing, sum(whole::int) over (partition by symbol order by seq rows unbounded preceding) as epoch from m),
    s as materialized (select *, sum(missing) over (partition by symbol, epoch order by seq rows unbounded preceding) as gaps from g),
    l as materialized (select symbol, epoch, seq, unnest(case when whole then [{'b': true, 'p': p, 's': k + 1}, {'b': true, 'p': p - 1, 's': k + 2}, {'b': false, 'p': p + 50, 's': k + 1}, {'b': false, 'p': p + 51, 's': k + 2}] else [{'b': buys, 'p': case when buys then p else p + 50 end, 's': k % 7}] end) as x from s where epoch > 0),
    a as (select s.symbol, s.seq, l.x.b as b, l.x.p as p, arg_max(l.x.s, l.seq)::double as size from s join l on l.symbol = s.symbol and l.epoch = s.epoch and l.seq <= s.seq where s.gaps = 0 group by all),
    o as (select *, row_number() over (partition by symbol, seq, b order by case when b then -p else p end) as rank from a where size > 0),
    t as (select symbol, seq, max(p) filter (where b) as bid, max(size) filter (where b and rank = 1) as bid_size, min(p) filter (where not b) as ask, max(size) filter (where not b and rank = 1) as ask_size,
        coalesce(sum(size) filter (where b and rank <= 5), 0.0) as bid_depth, coalesce(sum(size) filter (where not b and rank <= 5), 0.0) as ask_depth, count(*) filter (where b) as bids, count(*) filter (where not b) as asks from o group by symbol, seq)
    select s.symbol, s.seq, case when whole then 'snapshot' when epoch = 0 then 'waiting' when gaps = 1 and missing = 1 then 'gap' when gaps > 0 then 'waiting' else 'change' end as status, bid, bid_size, ask, ask_size,
        case when epoch > 0 and gaps = 0 then coalesce(bid_depth, 0.0) end as bid_depth, case when epoch > 0 and gaps = 0 then coalesce(ask_depth, 0.0) end as ask_depth, case when epoch > 0 and gaps = 0 then coalesce(bids, 0) end as bids, case when epoch > 0 and gaps = 0 then coalesce(asks, 0) end as asks, ask - bid as spread from s left join t using (symbol, seq)"""


def level_rows(spark, d: str) -> DataFrame:
    return keyed.run(bars(spark, d), machines.price_levels())


def seen_items(spark, d: str) -> DataFrame:
    """A stream over the events: each kind of event of a user once within a day, as a monitor's folder has it."""
    path = shared_folder(spark, "monitor")
    source = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events.parque[t]")  # a pattern: the table may be one file or a folder
    items = source.select(F.col("ts").cast("timestamp").alias("ts"), F.concat_ws("/", "event_type", "user_id").alias("item"))
    market.monitor(items, "item", f"{path}/items", f"{path}/checkpoint", late="400 days").awaitTermination()
    return spark.read.parquet(f"{path}/items").select("item")


def register(reg: Registry) -> None:
    reg.add("state_clusters", lambda spark, d: rounded(keyed.run(vectors(bars(spark, d)), machines.clusters())))
    reg.add("state_cluster_info", lambda spark, d: rounded(machines.cluster_info(keyed.end_states(vectors(bars(spark, d)), machines.clusters(likeness="exponential")))))
    reg.add("state_clusters_restored", lambda spark, d: rounded(restored(vectors(bars(spark, d)), machines.clusters(likeness="inverse", threshold=0.55), F.lit("2024-01-12").cast("timestamp_ntz"))))
    reg.add("state_ledger_restored", lambda spark, d: rounded(restored(fills(spark, d), machines.ledger(), F.lit("1995-06-01").cast("timestamp_ntz"), ("fill_id",))), LEDGER_SQL)
    reg.add("state_order_book", lambda spark, d: keyed.run(messages(spark, d), machines.order_book()), BOOK_SQL)
    reg.over_bars("state_history", lambda b: keyed.run(b, machines.history()), ["held", "mean_20", "deviation_20", "momentum_5", "momentum_20", "momentum_60", "volume_ratio"], f"""
        select symbol, ts, least(500, row_number() over (partition by symbol order by ts)) as held, {r(full(20, 'avg(close)', 'close'), 'mean_20')}, {r(full(20, 'stddev_pop(close)', 'close'), 'deviation_20')},
        {', '.join(r(f"close / nullif({lag_sql('close', k)}, 0) - 1", f'momentum_{k}') for k in (5, 20, 60))}, {r(f"volume / nullif({full(20, 'avg(volume)', 'volume')}, 0)", 'volume_ratio')} from bars""")  # fmt: skip
    reg.add("state_levels", lambda spark, d: rounded(level_rows(spark, d)))
    reg.add("stream_unseen", seen_items, "select distinct event_type || '/' || user_id as item from events")


LEDGER_SQL = f"""with recursive f as (select 'P' || (l_partkey % 25) as symbol, l_shipdate as ts, case when l_returnflag = 'R' then -l_quantity else l_quantity end as s, l_extendedprice / l_quantity as price,
        row_number() over (partition by l_partkey % 25 order by l_shipdate, l_orderkey * 10 + l_linenumber) as n from lineitem),
    p as (select symbol, ts, n, s as q, price as c, 0.0::double as g from f where n = 1
        union all select f.symbol, f.ts, f.n, p.q + f.s, case when p.q = 0 or p.q * f.s > 0 then case when p.q + f.s <> 0 then (abs(p.q) * p.c + abs(f.s) * f.price) / abs(p.q + f.s) else 0.0 end when p.q * (p.q + f.s) < 0 then f.price when p.q + f.s <> 0 then p.c else 0.0 end,
            p.g + case when p.q = 0 or p.q * f.s > 0 then 0.0 else least(abs(p.q), abs(f.s)) * (f.price - p.c) * sign(p.q) end from p join f on f.symbol = p.symbol and f.n = p.n + 1)
    select symbol, ts, {r('q', 'quantity')}, {r('c', 'mean_cost')}, {r('g', 'realised')} from p"""
