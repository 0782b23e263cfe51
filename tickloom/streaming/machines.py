"""Machines for keyed state: adaptive online clusters, order books from deltas, histories of the last rows, price levels that live and die."""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.operators.regimes import LIKENESS, ks_statistic
from tickloom.streaming.keyed import Machine

# Adaptive clusters


def _adapted(state: dict, threshold: float, rate: float) -> None:
    """Threshold by the share of sure answers among the last hundred, rate by the clusters' mean stability; between the bounds both stay as they are."""
    sure = state["sure"]
    if sure:
        share = sum(sure) / len(sure)
        if share > 0.9:
            state["threshold"] = min(0.9, threshold * 1.05)
        elif share < 0.7:
            state["threshold"] = max(0.5, threshold * 0.95)
    if state["clusters"]:
        stable = sum(c["stability"] for c in state["clusters"]) / len(state["clusters"])
        if stable > 0.8:
            state["rate"] = max(0.05, rate * 0.8)
        elif stable < 0.6:
            state["rate"] = min(0.3, rate * 1.2)


def _drift(state: dict, x: list[float], window: int, limit: float) -> tuple[float, bool]:
    """Largest 1 - p over the features of the last `window` vectors against the reference, the first full window; beyond the limit that window becomes the reference."""
    held = state["window"]
    held.append(x)
    del held[:-window]
    if state["reference"] is None:
        if len(held) == window:
            state["reference"] = [list(v) for v in held]
        else:
            return 0.0, False
    now, then = np.array(held), np.array(state["reference"])
    score = max(1 - ks_statistic(then[:, c], now[:, c])[1] for c in range(now.shape[1]))
    if score > limit:
        state["reference"] = [list(v) for v in held]
    return float(score), score > limit


def clusters(features: str = "features", threshold: float = 0.75, rate: float = 0.14, decay: float = 0.02, most: int = 12, window: int = 100, limit: float = 0.9, weak: float = 0.3, likeness: str = "cosine", key: str = "symbol", order: str = "ts") -> Machine:
    """Online clusters of vectors (an array column, nulls as 0) that adapt to themselves.

    A vector joins the most similar cluster if the likeness is over the threshold: the cluster's centre moves by the rate, its size grows by one,
    its stability takes a hundredth of the likeness, the confidence is 1.2 times the likeness, at most 1. Else it starts a
    cluster at 0.8, the first at 1, up to `most`; beyond, it is given to the most similar at 0.7 of the likeness and moves nothing. After each vector but the first all sizes lose `decay`,
    not under 1, and all ages grow. Threshold and rate follow sureness and stability; a drift of the last `window` vectors from the reference
    takes the threshold to 0.9 and the rate to 1.5 of their bases and drops clusters under the stability `weak`. Numbers of
    dropped clusters are not given again. likeness: a name of regimes.LIKENESS. State: at most `most` centres and two windows.
    """
    like = LIKENESS[likeness]

    def fresh() -> dict:
        return {"clusters": [], "next": 0, "threshold": threshold, "rate": rate, "sure": [], "window": [], "reference": None, "drifts": 0}

    def step(state: dict, row: tuple) -> list[tuple]:
        ts, x = row[0], [0.0 if v is None or v != v else float(v) for v in row[1] or ()]
        if not x:
            return []
        vector, known, seen = np.array(x), state["clusters"], pd.Timestamp(ts).value / 1e9
        new = {"centre": x, "size": 1.0, "age": 0, "seen": seen}
        if not known and not state["next"]:
            known.append(new | {"id": 0, "stability": 1.0})
            state["next"], answer, confidence = 1, 0, 1.0
        else:
            near = [like(vector, np.array(c["centre"])) for c in known]
            best = int(np.argmax(near)) if near else -1
            _adapted(state, threshold, rate)
            if near and near[best] > state["threshold"]:
                c = known[best]
                c["centre"] = (np.array(c["centre"]) * (1 - state["rate"]) + vector * state["rate"]).tolist()
                c["size"], c["age"], c["seen"] = c["size"] + 1, c["age"] + 1, seen
                c["stability"] = min(1.0, c["stability"] * 0.99 + near[best] * 0.01)
                answer, confidence = c["id"], min(1.0, near[best] * 1.2)
            elif len(known) < most:
                known.append(new | {"id": state["next"], "stability": 0.8})
                answer, confidence = state["next"], 0.8
                state["next"] += 1
            else:
                answer, confidence = known[best]["id"], near[best] * 0.7
            for c in known:
                c["size"], c["age"] = max(1.0, c["size"] * (1 - decay)), c["age"] + 1
        score, drifted = _drift(state, x, window, limit)
        if drifted:
            state["drifts"] += 1
            state["rate"], state["threshold"] = min(0.3, rate * 1.5), max(0.5, threshold * 0.9)
            state["clusters"] = [c for c in known if c["stability"] >= weak]
        state["sure"] = [*state["sure"][-99:], int(confidence > 0.7)]
        return [(ts, answer, float(confidence), len(state["clusters"]), float(state["threshold"]), float(state["rate"]), score, bool(drifted))]

    gives = f"`{order}` timestamp_ntz, cluster long, confidence double, clusters long, threshold double, rate double, drift_score double, drifted boolean"
    return Machine((features,), gives, fresh, step, key, order)


def cluster_info(states: DataFrame) -> DataFrame:
    """(key, cluster, centre, size, age, stability, unseen) of each cluster in saved states of `clusters`; unseen: hours since its last vector, at most 1."""
    kind = "clusters array<struct<id: long, centre: array<double>, size: double, age: long, stability: double, seen: double>>"
    rows = states.select("key", F.unix_micros(F.to_timestamp(F.concat(F.substring("at", 1, 26), F.lit("+00:00")))).alias("_now"), F.inline(F.from_json("payload", kind)["clusters"]))
    return rows.select("key", F.col("id").alias("cluster"), "centre", "size", "age", "stability", F.least(F.lit(1.0), (F.col("_now") / 1e6 - F.col("seen")) / 3600).alias("unseen"))


# Order books


def _put(side: list[list[float]], price: float, size: float) -> None:
    """Set the size at a price of a side sorted by price; 0 takes it away."""
    at = bisect_left(side, price, key=lambda x: x[0])
    there = at < len(side) and side[at][0] == price
    if there and size <= 0:
        side.pop(at)
    elif there:
        side[at][1] = size
    elif size > 0:
        side.insert(at, [price, size])


def order_book(depth: int = 5, key: str = "symbol", order: str = "seq") -> Machine:
    """A book from messages (seq, kind, bids, asks), arrays of (price, size).

    A `snapshot` replaces the book, a `change` sets sizes at prices, and 0 deletes a price. Numbers of a key's messages follow each other: a change
    whose number leaves one out makes the book unknown, changes after that wait, and the next snapshot builds it anew. A number that was seen gives `repeat` and changes nothing. Each message gives seq, status (snapshot, change,
    gap, waiting, repeat), the best prices and sizes, the sizes of the `depth` best prices of each side, the number of prices, and
    the spread; null while the book is unknown, and where a side is empty.
    """

    def fresh() -> dict:
        return {"bids": [], "asks": [], "seq": None, "known": False, "gaps": 0}

    def step(state: dict, row: tuple) -> list[tuple]:
        seq, kind, bids, asks = row
        if state["seq"] is not None and seq <= state["seq"]:
            status = "repeat"
        else:
            missing = state["seq"] is not None and seq != state["seq"] + 1
            state["seq"] = seq
            if kind == "snapshot":
                state["bids"], state["asks"], state["known"], status = [], [], True, "snapshot"
            elif state["known"] and missing:
                state["bids"], state["asks"], state["known"], status = [], [], False, "gap"
                state["gaps"] += 1
            else:
                status = "change" if state["known"] else "waiting"
            if state["known"]:
                for side, changes in (("bids", bids), ("asks", asks)):
                    for change in changes or ():
                        _put(state[side], float(change["price"]), float(change["size"]))
        if not state["known"]:
            return [(seq, status, None, None, None, None, None, None, None, None, None)]
        high, low = state["bids"], state["asks"]
        best, ask = (high[-1] if high else (None, None)), (low[0] if low else (None, None))
        return [(seq, status, best[0], best[1], ask[0], ask[1], sum(s for _, s in high[-depth:]), sum(s for _, s in low[:depth]), len(high), len(low), ask[0] - best[0] if high and low else None)]

    gives = f"`{order}` long, status string, bid double, bid_size double, ask double, ask_size double, bid_depth double, ask_depth double, bids long, asks long, spread double"
    return Machine(("kind", "bids", "asks"), gives, fresh, step, key, order)


BOOK_MESSAGE = "type string, channel string, product_id string, sequence long, changes array<array<string>>, bids array<array<string>>, asks array<array<string>>, b array<array<string>>, a array<array<string>>"


def book_messages(raw: DataFrame, value: str = "value") -> DataFrame:
    """(symbol, seq, kind, bids, asks) of JSON text in either of two shapes: `snapshot` and `l2update` messages with changes (side, price, size), or channel `book` with `b` and `a` levels; text that is neither goes."""
    m = raw.select(F.from_json(F.col(value).cast("string"), BOOK_MESSAGE).alias("m")).select("m.*")
    pair = lambda p, s: F.struct(p.cast("double").alias("price"), s.cast("double").alias("size"))
    levels = lambda c: F.transform(F.coalesce(c, F.array().cast("array<array<string>>")), lambda x: pair(x[0], x[1]))

    def of(side: str) -> Column:
        return F.transform(F.filter(F.coalesce("changes", F.array().cast("array<array<string>>")), lambda x: x[0] == side), lambda x: pair(x[1], x[2]))

    kind = F.when((F.col("type") == "snapshot") | ((F.col("channel") == "book") & F.col("bids").isNotNull()), "snapshot").when((F.col("type") == "l2update") | (F.col("channel") == "book"), "change")
    whole = F.col("type").isNotNull() & F.col("changes").isNotNull()
    bids, asks = F.when(whole, of("buy")).otherwise(levels(F.coalesce("bids", "b"))), F.when(whole, of("sell")).otherwise(levels(F.coalesce("asks", "a")))
    out = m.select(F.col("product_id").alias("symbol"), F.col("sequence").alias("seq"), kind.alias("kind"), bids.alias("bids"), asks.alias("asks"))
    return out.where(F.col("symbol").isNotNull() & F.col("seq").isNotNull() & F.col("kind").isNotNull())


# Histories


def history(most: int = 500, key: str = "symbol", order: str = "ts") -> Machine:
    """The last `most` prices and volumes of a key, a ring, and what windows over them say at each row: mean and deviation of 20, momentum over 5, 20 and 60 rows, volume against the mean of 20; null until enough rows are there.

    Equal to window functions over all rows where windows reach no further back than `most`.
    """

    def fresh() -> dict:
        return {"price": [], "volume": []}

    def step(state: dict, row: tuple) -> list[tuple]:
        ts, price, volume = row
        p, v = state["price"], state["volume"]
        p.append(price)
        v.append(volume)
        del p[:-most], v[:-most]
        back = lambda k: p[-1] / p[-1 - k] - 1 if len(p) > k and p[-1] is not None and p[-1 - k] else None
        some = [x for x in p[-20:] if x is not None]
        mean = sum(some) / 20 if len(some) == 20 else None
        spread = (sum((x - mean) ** 2 for x in some) / 20) ** 0.5 if mean is not None else None
        sizes = [x for x in v[-20:] if x is not None]
        average = sum(sizes) / 20 if len(sizes) == 20 else None
        return [(ts, len(p), mean, spread, back(5), back(20), back(60), volume / average if average and volume is not None else None)]

    return Machine(("close", "volume"), f"`{order}` timestamp_ntz, held long, mean_20 double, deviation_20 double, momentum_5 double, momentum_20 double, momentum_60 double, volume_ratio double", fresh, step, key, order)


# Price levels


def strength(touches: int, age: int, days: int) -> float:
    """A third of touches (of five), age (of a hundred rows, 0.8) and a test in the last five days (1.2), at most 1."""
    recent = 1.2 * (5 - days) / 5 if days < 5 else 0.0
    return min(1.0, (min(1.0, touches / 5) + min(1.0, age / 100) * 0.8 + recent) / 3)


def price_levels(reach: int = 5, merge: float = 0.01, beyond: float = 0.002, least: float = 0.3, weak: float = 0.2, old: int = 200, key: str = "symbol", order: str = "ts") -> Machine:
    """Levels of support and resistance that live with their tests, and the rows that break them; rows (ts, high, low, close, volume).

    A high above all of the `reach` rows before it and not below any of the `reach` rows after is a swing, known that many rows later; lows mirrored. A swing touches
    the oldest level of its side within `merge` of its price, which keeps its price, or starts one. Then all levels of the key grow older by a row, take the strength that touches,
    age and days since their last swing give, and go at a strength of `weak` and under or at an age of `old`. Each level that is left
    gives a row: ts, side, level (a number, from 0), price, touches, age, strength; whether this row's high (low) is `beyond` it while its strength is over `least`; how far the price went on the other
    side over the level's age and 20 rows more, its height; volume against the mean of 20 rows, and the sum of the last five changes. State: levels, at most old / reach a side, and the last rows.
    """
    keep = old + 20

    def fresh() -> dict:
        return {"high": [], "low": [], "close": [], "volume": [], "ts": [], "levels": [], "next": 0}

    def swing(values: list[float], sign: int) -> float | None:
        part = values[-2 * reach - 1 :]
        if len(part) < 2 * reach + 1 or any(x is None for x in part):
            return None
        at = part[reach] * sign
        return part[reach] if all(x * sign < at for x in part[:reach]) and all(x * sign <= at for x in part[reach + 1 :]) else None

    def step(state: dict, row: tuple) -> list[tuple]:
        ts, high, low, close, volume = row
        now = pd.Timestamp(ts).value
        for name, value in (("high", high), ("low", low), ("close", close), ("volume", volume), ("ts", now)):
            state[name].append(value)
            del state[name][:-keep]
        for side, sign, values in (("resistance", 1, state["high"]), ("support", -1, state["low"])):
            price = swing(values, sign)
            if price:
                tested = state["ts"][-reach - 1]
                near = next((x for x in state["levels"] if x["side"] == side and abs(x["price"] - price) / price < merge), None)
                if near:
                    near["touches"], near["tested"] = near["touches"] + 1, tested
                else:
                    state["levels"].append({"id": state["next"], "side": side, "price": price, "touches": 1, "age": 0, "tested": tested})
                    state["next"] += 1
        for x in state["levels"]:
            x["age"] += 1
            x["strength"] = strength(x["touches"], x["age"], (now - x["tested"]) // 86_400_000_000_000)
        state["levels"] = [x for x in state["levels"] if x["strength"] > weak and x["age"] < old]
        sizes = [v for v in state["volume"][-20:] if v is not None]
        ratio = volume / (sum(sizes) / len(sizes)) if sizes and sum(sizes) and volume is not None else None
        closes = state["close"][-6:]
        moves = [b / a - 1 for a, b in zip(closes, closes[1:], strict=False) if a and b is not None]
        out = []
        for x in state["levels"]:
            up = x["side"] == "resistance"
            span = [v for v in state["low" if up else "high"][-x["age"] - 20 :] if v is not None]
            height = (x["price"] - min(span) if up else max(span) - x["price"]) if span else None
            edge = high if up else low
            broken = edge is not None and (edge > x["price"] * (1 + beyond) if up else edge < x["price"] * (1 - beyond)) and x["strength"] > least
            out.append((ts, x["side"], x["id"], x["price"], x["touches"], x["age"], x["strength"], bool(broken), height, ratio, sum(moves) if moves else None))
        return out

    gives = f"`{order}` timestamp_ntz, side string, level long, price double, touches long, age long, strength double, broken boolean, height double, volume_ratio double, momentum double"
    return Machine(("high", "low", "close", "volume"), gives, fresh, step, key, order)


# Ledgers


def ledger(key: str = "symbol", order: str = "ts") -> Machine:
    """The position after each fill (side, quantity, price): quantity, mean cost, realised profit, by market.position_step."""
    from tickloom.streaming.market import position_step

    def step(state: dict, row: tuple) -> list[tuple]:
        ts, side, quantity, price = row
        state["held"] = list(position_step(tuple(state["held"]), side, float(quantity), float(price)))
        return [(ts, *state["held"])]

    return Machine(("side", "quantity", "price"), f"`{order}` timestamp_ntz, quantity double, mean_cost double, realised double", lambda: {"held": [0.0, 0.0, 0.0]}, step, key, order)
