"""Streaming, state, patterns and text against small cases worked out by hand."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tickloom.functions import text
from tickloom.operators import patterns, regimes
from tickloom.streaming import market

FILLS = [(1, "A", "2024-01-01 00:00:00", "BUY", 10.0, 5.0), (2, "A", "2024-01-01 00:01:00", "BUY", 10.0, 7.0), (3, "A", "2024-01-01 00:02:00", "SELL", 5.0, 8.0), (4, "A", "2024-01-01 00:03:00", "SELL", 20.0, 4.0)]
#: Quantity, mean cost and realised profit after each.
AFTER = [(10.0, 5.0, 0.0), (20.0, 6.0, 0.0), (15.0, 6.0, 10.0), (-5.0, 4.0, -20.0)]


def fills(spark):
    return spark.createDataFrame(FILLS, "fill_id int, symbol string, ts string, side string, quantity double, price double").withColumn("ts", F.col("ts").cast("timestamp"))


def test_position_fold_on_a_table_and_on_a_stream(spark, tmp_path):
    assert [tuple(x)[2:] for x in market.positions(fills(spark)).orderBy("ts").collect()] == AFTER
    got = []
    path = str(tmp_path / "in")
    for part in (fills(spark).where("fill_id <= 2"), fills(spark).where("fill_id > 2")):
        part.coalesce(1).write.mode("append").parquet(path)
        query = market.start(market.positions(spark.readStream.schema(part.schema).parquet(path)), lambda df, _: got.extend(df.collect()), str(tmp_path / "check"))
        query.awaitTermination()
    assert [tuple(x)[2:] for x in sorted(got, key=lambda x: x["ts"])] == AFTER


def test_streamed_bars_match_the_table(spark, tmp_path):
    rows = spark.range(500).select(F.concat(F.lit("S"), F.col("id") % 3).alias("symbol"), F.timestamp_seconds(1700000000 + F.col("id") * 60).alias("ts"), (F.col("id") % 17).cast("double").alias("price"), F.lit(1.0).alias("volume"))
    path = str(tmp_path / "ticks")
    rows.coalesce(1).write.parquet(path)
    got = []
    stream = spark.readStream.schema(rows.schema).parquet(path)
    market.start(market.bars(stream), lambda df, _: got.extend(df.collect()), str(tmp_path / "check"), mode="update").awaitTermination()
    assert sorted(map(tuple, got)) == sorted(map(tuple, market.bars(rows).collect()))


def test_messages_keep_what_parses(spark):
    raw = spark.createDataFrame([('{"stream": "a@trade", "symbol": "X", "price": 2.5, "volume": 1, "trade_ts": "2024-01-01T00:00:00"}',), ("no json",), (None,)], "value string")
    assert [(x["kind"], x["symbol"], x["price"]) for x in market.messages(raw).collect()] == [("trade", "X", 2.5)]


def test_peaks_and_levels():
    x = np.array([0, 3, 1, 5, 5, 2, 4, 0.0])
    assert patterns.peaks(x).tolist() == [1, 3, 6]
    assert patterns.peaks(x, 3).tolist() == [3, 6]
    assert patterns.peaks(x, 1, 2.5).tolist() == [3]
    assert patterns.levels(np.array([1.0, 1.001, 2.0]), 1.0) == [(1.0005, 2, 0.4)]


def test_kolmogorov_smirnov():
    a = np.arange(100.0)
    assert regimes.ks_statistic(a, a) == (0.0, 1.0)
    gap, p = regimes.ks_statistic(a, a + 200)
    assert gap == 1.0 and p < 1e-6


def test_online_clusters_split_and_join():
    names, sure, centres = regimes.online_clusters(np.array([[1.0, 0], [0.9, 0.1], [0, 1.0], [-1.0, 0]]), most=2)
    assert names.tolist() == [0, 0, 1, 1] and len(centres) == 2 and sure[1] == 1.0


def test_text_functions_take_nulls(spark):
    rows = spark.createDataFrame([("Rally! #Gain #gain @bob $ABC USD",), (None,), ("",)], "text string")
    t = F.col("text")
    got = rows.select(text.lexicon_score(t), text.hashtags(t), text.mentions(t), text.symbols(t), text.category(t)).collect()
    assert tuple(got[0])[1:4] == (["gain", "gain"], ["bob"], ["ABC"]) and abs(got[0][0] - (0.7 + 0.5 + 0.5) / 3) < 1e-9
    assert tuple(got[1]) == tuple(got[2]) == (0.0, [], [], [], "GENERAL")
