"""Keyed state: plain loops over all rows of sf0.01, a stream in three batches with a restart equal to the table, saved states restored."""

from __future__ import annotations

import datetime as dt
import json
import math
import os
import random
import time
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tickloom.operators.regimes import ks_statistic
from tickloom.plans import registry, state_queries
from tickloom.plans.base import bars
from tickloom.streaming import keyed, machines, market, shapes
from tickloom.streaming.snapshots import Snapshots, newer

SF = "/root/testdata/sf0.01"
DAY = dt.datetime(2024, 1, 1)


def streamed(spark, folder, parts, schema, build, **options):
    """Rows of a stream over `parts`, a file a batch: two batches, a stop, and a third after a restart from the checkpoint."""
    base = f"file://{folder}"
    for k, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{base}/part{k}")
    os.makedirs(f"{folder}/in")

    def arrive(k):
        for name in os.listdir(f"{folder}/part{k}"):
            if name.endswith(".parquet"):
                os.rename(f"{folder}/part{k}/{name}", f"{folder}/in/{k}.parquet")
                at = time.time() - 100 + 10 * k
                os.utime(f"{folder}/in/{k}.parquet", (at, at))

    def go():
        rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
        query = build(rows).writeStream.outputMode("append").format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/check").trigger(availableNow=True).start()
        query.awaitTermination()

    for k in range(len(parts) - 1):
        arrive(k)
    go()
    arrive(len(parts) - 1)
    go()
    return spark.read.parquet(f"{base}/out").collect()


def same(a, b):
    if isinstance(a, float) or isinstance(b, float):
        return a is not None and b is not None and math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)
    return a == b


def assert_rows(got, want):
    got, want = sorted(map(str, got)), sorted(map(str, want))
    assert got == want


# Clusters


def plain_clusters(rows, threshold=0.75, rate=0.14, decay=0.02, most=12, window=100):
    """The rules of machines.clusters by cosine, written out for one key's vectors."""
    out, held, number, eta, theta, sure, seen, ref = [], {}, 0, rate, threshold, [], [], None
    for ts, x in rows:
        if number == 0:
            held[0] = [list(x), 1.0, 1.0]
            number, answer, confidence = 1, 0, 1.0
        else:
            likes = {}
            for i, (c, _, _) in held.items():
                norm = math.sqrt(sum(v * v for v in c)) * math.sqrt(sum(v * v for v in x))
                likes[i] = sum(a * b for a, b in zip(c, x)) / norm if norm else 0.0
            accuracy = sum(s > 0.7 for s in sure[-100:]) / len(sure[-100:])
            theta = min(0.9, 1.05 * threshold) if accuracy > 0.9 else max(0.5, 0.95 * threshold) if accuracy < 0.7 else theta
            if held:
                mean = sum(h[2] for h in held.values()) / len(held)
                eta = max(0.05, 0.8 * rate) if mean > 0.8 else min(0.3, 1.2 * rate) if mean < 0.6 else eta
            best = max(likes, key=lambda i: (likes[i], -list(likes).index(i))) if likes else None
            if best is not None and likes[best] > theta:
                h = held[best]
                h[0] = [a * (1 - eta) + b * eta for a, b in zip(h[0], x)]
                h[1] += 1
                h[2] = min(1.0, 0.99 * h[2] + 0.01 * likes[best])
                answer, confidence = best, min(1.0, 1.2 * likes[best])
            elif len(held) < most:
                held[number] = [list(x), 1.0, 0.8]
                answer, confidence, number = number, 0.8, number + 1
            else:
                answer, confidence = best, 0.7 * likes[best]
            for h in held.values():
                h[1] = max(1.0, h[1] * (1 - decay))
        seen.append(x)
        score = 0.0
        if ref is None and len(seen) == window:
            ref = seen[:]
        if ref is not None:
            now = seen[-window:]
            score = max(1 - ks_statistic(*(__import__("numpy").array([v[c] for v in part]) for part in (ref, now)))[1] for c in range(len(x)))
            if score > 0.9:
                ref, eta, theta = now[:], min(0.3, 1.5 * rate), max(0.5, 0.9 * threshold)
                held = {i: h for i, h in held.items() if h[2] >= 0.3}
        sure.append(confidence)
        out.append((ts, answer, confidence, len(held), theta, eta, score, score > 0.9))
    return out


def test_clusters_are_the_plain_loop(spark):
    rows = state_queries.vectors(bars(spark, SF))
    by_key = defaultdict(list)
    for r in rows.orderBy("symbol", "ts").collect():
        by_key[r.symbol].append((r.ts, list(r.features)))
    got = defaultdict(list)
    for r in keyed.run(rows, machines.clusters()).collect():
        got[r.symbol].append(tuple(r)[1:])
    assert sum(map(len, got.values())) == rows.count() > 3000
    drifts = 0
    for key, vectors in by_key.items():
        want = plain_clusters(vectors)
        drifts += sum(w[-1] for w in want)
        for g, w in zip(sorted(got[key]), want, strict=True):
            assert all(same(a, b) for a, b in zip(g, w)), (key, g, w)
    assert drifts


def test_drift_lowers_the_threshold_and_drops_weak_clusters(spark):
    r = random.Random(3)
    state = machines.clusters(threshold=0.75, window=20).fresh()
    machine = machines.clusters(threshold=0.75, window=20, weak=0.9)
    for k in range(60):
        shift = 0.0 if k < 40 else 5.0
        given = machine.step(state, (DAY + dt.timedelta(minutes=k), [1 + r.random() + shift, -1 + r.random() - shift]))
        if given[0][-1]:
            break
    assert k > 40 and given[0][4] == pytest.approx(0.675) and given[0][5] == pytest.approx(0.21)
    assert all(c["stability"] >= 0.9 for c in state["clusters"])


VECTORS = "symbol string, ts timestamp_ntz, features array<double>"


def some_vectors(n=150):
    r = random.Random(5)
    return [(s, DAY + dt.timedelta(minutes=k), [r.gauss(k // 60, 1) if r.random() > 0.05 else None, r.gauss(0, 1), r.gauss(1, 0.2)]) for k in range(n) for s in ("a", "b", None)]


@pytest.mark.parametrize("likeness", ["cosine", "exponential", "inverse"])
def test_clusters_on_a_stream_are_those_of_the_table(spark, tmp_path, likeness):
    rows = some_vectors()
    machine = machines.clusters(window=40, likeness=likeness, threshold=0.6)
    table = keyed.run(spark.createDataFrame(rows, VECTORS), machine).collect()
    stream = streamed(spark, tmp_path, [rows[:120], rows[120:300], rows[300:]], VECTORS, lambda s: keyed.run(s, machine))
    assert_rows(stream, table)


def test_cluster_info(spark):
    states = keyed.end_states(spark.createDataFrame(some_vectors(), VECTORS), machines.clusters())
    held = {r.key: json.loads(r.payload)["clusters"] for r in states.collect()}
    info = machines.cluster_info(states).collect()
    assert len(info) == sum(map(len, held.values())) and set(held) == {"a", "b", None}
    for r in info:
        c = next(c for c in held[r.key] if c["id"] == r.cluster)
        assert r.centre == c["centre"] and r["size"] == c["size"] and r.age == c["age"]
        assert r.unseen == pytest.approx(min(1.0, ((DAY + dt.timedelta(minutes=149) - DAY).total_seconds() + DAY.replace(tzinfo=dt.timezone.utc).timestamp() - c["seen"]) / 3600))


# Order books


def plain_book(messages, depth=5):
    out, bids, asks, last, known = [], {}, {}, None, False
    for seq, kind, b, a in messages:
        if last is not None and seq <= last:
            status = "repeat"
        else:
            gap, last = last is not None and seq > last + 1, seq
            if kind == "snapshot":
                bids, asks, known, status = {}, {}, True, "snapshot"
            elif known and gap:
                known, status = False, "gap"
            else:
                status = "change" if known else "waiting"
            if known:
                for side, levels in ((bids, b), (asks, a)):
                    for price, size in levels:
                        side[price] = size
                        if size <= 0:
                            del side[price]
        if not known:
            out.append((seq, status, *[None] * 9))
            continue
        high, low = sorted(bids.items(), reverse=True), sorted(asks.items())
        best, ask = high[0] if high else (None, None), low[0] if low else (None, None)
        out.append((seq, status, *best, *ask, float(sum(s for _, s in high[:depth])), float(sum(s for _, s in low[:depth])), len(high), len(low), ask[0] - best[0] if high and low else None))
    return out


BOOK = "symbol string, n long, seq long, kind string, bids array<struct<price: double, size: double>>, asks array<struct<price: double, size: double>>"


def some_messages():
    r = random.Random(9)
    rows = []
    for symbol in ("x", "y"):
        seq = 0
        for n in range(200):
            seq += r.choice([1] * 20 + [0, 2, 3])
            kind = "snapshot" if n in (3, 60) or r.random() < 0.05 else "change"
            sides = [[(float(r.randint(1, 9) + up), float(r.randint(0, 4))) for _ in range(r.randint(0, 3))] for up in (0, 9)]
            rows.append((symbol, n, seq, kind, *sides))
    return rows


def test_order_book(spark, tmp_path):
    rows = some_messages()
    machine = machines.order_book(order="seq")
    table = keyed.run(spark.createDataFrame(rows, BOOK), machine, ties=("n",)).collect()
    want = [(s, *x) for s in ("x", "y") for x in plain_book([r[2:] for r in rows if r[0] == s])]
    assert_rows([tuple(r) for r in table], want)
    statuses = {r.status for r in table}
    assert statuses == {"snapshot", "change", "gap", "waiting", "repeat"}
    parts = [[r for r in rows if r[1] < 70], [r for r in rows if 70 <= r[1] < 150], [r for r in rows if r[1] >= 150]]
    # numbers may not fall between batches of the test; late ones give nothing on a stream
    stream = streamed(spark, tmp_path, parts, BOOK, lambda s: keyed.run(s, machine, ties=("n",)))
    assert_rows(stream, table)


def test_book_messages(spark):
    texts = [
        json.dumps({"type": "snapshot", "product_id": "A", "sequence": 1, "bids": [["10", "1"], ["9.5", "2"]], "asks": [["11", "3"]]}),
        json.dumps({"type": "l2update", "product_id": "A", "sequence": 2, "changes": [["buy", "10", "0"], ["sell", "10.5", "4"]]}),
        json.dumps({"channel": "book", "product_id": "B", "sequence": 7, "b": [["5", "1"]], "a": []}),
        json.dumps({"type": "ticker", "product_id": "A", "sequence": 3}), "no json", None,
    ]
    rows = machines.book_messages(spark.createDataFrame([(t,) for t in texts], "value string"))
    got = {(r.symbol, r.seq): (r.kind, [tuple(x) for x in r.bids], [tuple(x) for x in r.asks]) for r in rows.collect()}
    assert got == {("A", 1): ("snapshot", [(10.0, 1.0), (9.5, 2.0)], [(11.0, 3.0)]), ("A", 2): ("change", [(10.0, 0.0)], [(10.5, 4.0)]), ("B", 7): ("change", [(5.0, 1.0)], [])}
    book = keyed.run(rows, machines.order_book()).where("symbol = 'A'").orderBy("seq").collect()
    assert [(r.status, r.bid, r.ask) for r in book] == [("snapshot", 10.0, 11.0), ("change", 9.5, 10.5)]


# Histories and levels

BARS = "symbol string, ts timestamp_ntz, high double, low double, close double, volume double"


def some_bars(n=400, seed=2):
    r = random.Random(seed)
    rows, price = [], {"a": 100.0, "b": 40.0}
    for k in range(n):
        for s in price:
            price[s] *= 1 + r.gauss(0, 0.01)
            rows.append((s, DAY + dt.timedelta(hours=k), price[s] * (1 + r.random() / 100), price[s] * (1 - r.random() / 100), price[s], float(r.randint(1, 100))))
    return rows


def test_history_on_a_stream_is_that_of_the_table(spark, tmp_path):
    rows = some_bars(120)
    machine = machines.history(most=61)
    table = keyed.run(spark.createDataFrame(rows, BARS), machine).collect()
    assert_rows(streamed(spark, tmp_path, [rows[:50], rows[50:140], rows[140:]], BARS, lambda s: keyed.run(s, machine)), table)
    assert max(r.held for r in table) == 61


def plain_levels(rows, reach=5, merge=0.01):
    out, levels, number = [], [], 0
    for i, (ts, high, low, close, volume) in enumerate(rows):
        j = i - reach
        for side, column, sign in (("resistance", 1, 1), ("support", 2, -1)):
            if j >= reach:
                p = rows[j][column]
                if all(sign * rows[q][column] < sign * p for q in range(j - reach, j)) and all(sign * rows[q][column] <= sign * p for q in range(j + 1, i + 1)):
                    near = [x for x in levels if x["side"] == side and abs(x["price"] - p) / p < merge]
                    if near:
                        near[0]["touches"] += 1
                        near[0]["tested"] = rows[j][0]
                    else:
                        levels.append({"id": number, "side": side, "price": p, "touches": 1, "age": 0, "tested": rows[j][0]})
                        number += 1
        for x in levels:
            x["age"] += 1
            days = (ts - x["tested"]).days
            x["strength"] = min(1.0, (min(1, x["touches"] / 5) + 0.8 * min(1, x["age"] / 100) + (1.2 * (5 - days) / 5 if days < 5 else 0)) / 3)
        levels = [x for x in levels if x["strength"] > 0.2 and x["age"] < 200]
        for x in levels:
            past = rows[max(0, i + 1 - x["age"] - 20) : i + 1]
            up = x["side"] == "resistance"
            height = x["price"] - min(q[2] for q in past) if up else max(q[1] for q in past) - x["price"]
            broken = (high > 1.002 * x["price"] if up else low < 0.998 * x["price"]) and x["strength"] > 0.3
            out.append((ts, x["side"], x["id"], x["price"], x["touches"], x["age"], x["strength"], broken, height))
    return out


def test_levels_are_the_plain_loop(spark):
    rows = bars(spark, SF).select("symbol", "ts", "high", "low", "close", "volume")
    by_key = defaultdict(list)
    for r in rows.orderBy("symbol", "ts").collect():
        by_key[r.symbol].append(tuple(r)[1:])
    got = defaultdict(list)
    for r in keyed.run(rows, machines.price_levels()).collect():
        got[r.symbol].append(tuple(r)[1:10])
    for key in by_key:
        want = plain_levels(by_key[key])
        assert len(want) == len(got[key]) > 1000
        for g, w in zip(sorted(got[key], key=lambda x: (x[0], x[2])), sorted(want, key=lambda x: (x[0], x[2])), strict=True):
            assert all(same(a, b) for a, b in zip(g, w)), (key, g, w)


def test_levels_merge_age_and_break(spark, tmp_path):
    rows = some_bars()
    schema = BARS
    machine = machines.price_levels()
    table = keyed.run(spark.createDataFrame(rows, schema), machine).collect()
    assert max(r.touches for r in table) > 1 and max(r.age for r in table) == 199 and any(r.broken for r in table)
    assert_rows(streamed(spark, tmp_path, [rows[:300], rows[300:500], rows[500:]], schema, lambda s: keyed.run(s, machine)), table)


def test_planted_level_breaks(spark):
    """Three peaks at 110 with troughs at 100, then a rise through 110: the level has three touches and breaks upwards, aimed its height further."""
    closes = [105 + 5 * math.sin(k * math.pi / 8) for k in range(60)] + [111.0, 113.0]
    rows = [("p", DAY + dt.timedelta(hours=k), c + 0.05, c - 0.05, c, 10.0) for k, c in enumerate(closes)]
    found = [r for r in keyed.run(spark.createDataFrame(rows, BARS), machines.price_levels()).collect() if r.broken and r.side == "resistance"]
    assert found and found[0].touches == 3 and found[0].price == pytest.approx(110.05, abs=0.1) and found[0].height == pytest.approx(10.1, abs=0.2)


def test_level_breakouts_fire(spark):
    rows = registry.queries()["sig_level_breakouts"](spark, "/root/testdata/sf0.001").collect()
    assert {r.direction for r in rows} == {"UP", "DOWN"}


def shape_rows(closes, symbol="p", spread=0.02):
    return [(symbol, DAY + dt.timedelta(hours=k), c + spread, c - spread, c, 10.0) for k, c in enumerate(closes)]


def test_planted_triangle_and_rectangle(spark):
    """Swings that close in on 100 and a jump: a triangle. Swings between 99 and 101 and a fall: a rectangle."""
    narrowing = [100 + (8 - 0.15 * k) * math.sin(k * math.pi / 5) for k in range(45)]
    level = [100 + math.sin(k * math.pi / 5) for k in range(60)]
    rows = shape_rows([*narrowing, 109.0], "up") + shape_rows([*level, 97.0], "down") + shape_rows([*narrowing, 91.0], "low")
    got = {(r.symbol, r.kind): r for r in keyed.run(spark.createDataFrame(rows, BARS), shapes.shapes()).collect() if (r.symbol, r.ts) in {("up", DAY + dt.timedelta(hours=45)), ("down", DAY + dt.timedelta(hours=60)), ("low", DAY + dt.timedelta(hours=45))}}
    up, low, box = got["up", "triangle"], got["low", "triangle"], got["down", "rectangle"]
    assert up.direction == "UP" and low.direction == "DOWN" and up.level > low.level and up.high_r < -0.95 and up.low_r > 0.95
    assert up.target - up.level == pytest.approx(up.level - up.stop) and low.stop == pytest.approx(up.level)
    assert box.direction == "DOWN" and box.level == pytest.approx(99.0, abs=0.1) and box.stop == pytest.approx(101.0, abs=0.1) and box.target == pytest.approx(97.0, abs=0.2)


def test_shapes_on_a_stream_are_those_of_the_table(spark, tmp_path):
    rows = some_bars(300)
    table = keyed.run(spark.createDataFrame(rows, BARS), shapes.shapes()).collect()
    assert {r.kind for r in table} == {"triangle", "rectangle"}
    assert_rows(streamed(spark, tmp_path, [rows[:130], rows[130:260], rows[260:]], BARS, lambda s: keyed.run(s, shapes.shapes())), table)


# Saved states


def test_restored_states_go_on_as_if_never_stopped(spark, tmp_path):
    rows = spark.createDataFrame(some_vectors(), VECTORS)
    machine = machines.clusters(window=40)
    whole = keyed.run(rows, machine).collect()
    store = Snapshots(spark, f"file://{tmp_path}/states")
    assert store.current() is None and store.restore().count() == 0
    split = DAY + dt.timedelta(minutes=70)
    first = rows.where(F.col("ts") < F.lit(split))
    assert store.save(keyed.end_states(first, machine)) == 1
    later = keyed.run(newer(rows, store.restore()), machine, store.restore()).collect()
    assert_rows(keyed.run(first, machine).collect() + later, whole)
    # a second version goes on from the first; the first can be gone back to and replayed
    assert store.save(keyed.end_states(newer(rows, store.restore()), machine, store.restore())) == 2
    assert newer(rows, store.restore()).count() == 0 and store.current() == 2
    assert_rows(store.restore().select("key", "payload").collect(), keyed.end_states(rows, machine).select("key", "payload").collect())
    store.point(1)
    assert store.current() == 1
    assert_rows(keyed.run(newer(rows, store.restore()), machine, store.restore()).collect(), later)
    with pytest.raises(ValueError):
        store.point(9)


def test_a_version_that_was_not_finished_is_not_seen(spark, tmp_path):
    store = Snapshots(spark, f"file://{tmp_path}/states")
    rows = spark.createDataFrame(some_vectors(20), VECTORS)
    machine = machines.clusters()
    store.save(keyed.end_states(rows, machine))
    os.makedirs(f"{tmp_path}/states/version=2")  # a job that died
    assert store.versions() == [1] and store.current() == 1
    assert store.save(keyed.end_states(rows, machine)) == 3
    assert store.current() == 3 and store.forget(keep=1) == [1] and store.versions() == [3]


def test_keys_without_new_rows_keep_their_state(spark):
    rows = spark.createDataFrame(some_vectors(30), VECTORS)
    machine = machines.clusters()
    states = keyed.end_states(rows, machine)
    after = keyed.end_states(rows.where("false"), machine, states)
    assert_rows(after.collect(), states.collect())


def test_rows_without_order_or_vector(spark):
    rows = spark.createDataFrame([("a", None, [1.0]), ("a", DAY, None), ("a", DAY, []), (None, DAY, [0.0, None]), ("b", DAY, [1.0]), ("b", DAY, [1.0])], VECTORS)
    got = keyed.run(rows, machines.clusters()).collect()
    assert [(r.symbol, r.cluster) for r in sorted(got, key=str)] == [("b", 0), ("b", 0), (None, 0)]
    assert keyed.run(rows.where("false"), machines.clusters()).count() == 0


# Monitors


def test_monitor_gives_each_item_once_over_restarts(spark, tmp_path):
    at = lambda m: DAY + dt.timedelta(minutes=m)
    batches = [[("a", at(0)), ("b", at(1)), ("a", at(2))], [("b", at(10)), ("c", at(30))], [("c", at(31)), ("a", at(25)), ("d", at(40))], [("e", at(300)), ("d", at(41))], [("f", at(1)), ("d", at(301))]]
    os.makedirs(f"{tmp_path}/in")
    for k, batch in enumerate(batches):
        spark.createDataFrame(batch, "item string, ts timestamp").coalesce(1).write.parquet(f"file://{tmp_path}/part{k}")
        for name in os.listdir(f"{tmp_path}/part{k}"):
            if name.endswith(".parquet"):
                os.rename(f"{tmp_path}/part{k}/{name}", f"{tmp_path}/in/{k}.parquet")
        source = spark.readStream.schema("item string, ts timestamp").parquet(f"file://{tmp_path}/in")
        market.monitor(source, "item", f"file://{tmp_path}/out", f"file://{tmp_path}/check", late="1 hour").awaitTermination()
    got = sorted(r.item for r in spark.read.parquet(f"file://{tmp_path}/out").collect())
    # f at minute 1 is far older than the watermark; d at 301 is over an hour after d at 40, so it is news again
    assert got == ["a", "b", "c", "d", "d", "e"]
