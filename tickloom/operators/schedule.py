"""Patterns of a symbol that do not overlap and together weigh most: weighted interval scheduling in two ordered passes, with a bounded state a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators import breakouts
from tickloom.operators.candles import candles
from tickloom.operators.patterns import flags
from tickloom.streaming import keyed
from tickloom.streaming.keyed import Machine


def _forward(longest: int, key: str) -> Machine:
    """In order of their ends: whether an interval is worth taking, given the best that ends before it starts. Only ends that a later interval can still look back to are kept."""

    def step(state: dict, row: tuple) -> list[tuple]:
        end, start, kind, weight = row
        ends = state["ends"]  # (end, best weight of intervals up to there), ascending
        while len(ends) > 1 and ends[1][0] < end - longest:
            ends.pop(0)
        behind = 0.0
        for at, best in reversed(ends):
            if at < start:
                behind = best
                break
        before = ends[-1][1] if ends else 0.0
        take = behind + weight > before
        best = max(before, behind + weight)
        if ends and ends[-1][0] == end:
            ends[-1][1] = best
        else:
            ends.append([end, best])
        state["n"] += 1
        return [(end, state["n"], start, kind, weight, take)]

    return Machine(("start", "kind", "weight"), "end long, n long, start long, kind string, weight double, take boolean", lambda: {"ends": [], "n": 0}, step, key, "end")


def _backward(key: str) -> Machine:
    """From the last interval back: one that was worth taking and ends before the one taken last starts."""

    def step(state: dict, row: tuple) -> list[tuple]:
        _, start, end, kind, weight, take = row
        if not take or (state["start"] is not None and end >= state["start"]):
            return []
        state["start"] = start
        return [(start, end, kind, weight)]

    return Machine(("start", "end", "kind", "weight", "take"), "start long, end long, kind string, weight double", lambda: {"start": None}, step, key, "back")


def best_intervals(rows: DataFrame, longest: int, key: str = "symbol") -> DataFrame:
    """Of rows (key, start, end, kind, weight), whole numbers with start <= end, those that do not share a place and have the largest sum of weights of each key.

    Intervals may be `longest` places apart in start and end; longer ones, and those with a null or a weight of 0 and under, are left out. Of equal sums the one that comes
    first in order of end, start and kind stays. Both passes read a key's rows in order with a state of at most `longest` entries.
    """
    c = F.col
    sound = rows.where((c("end") >= c("start")) & (c("end") - c("start") <= longest) & (c("weight") > 0) & c("kind").isNotNull()).select(key, c("start").cast("long").alias("start"), c("end").cast("long").alias("end"), "kind", c("weight").cast("double").alias("weight"))
    forward = keyed.run(sound, _forward(longest, key), ties=("start", "kind", "weight"))
    return keyed.run(forward.withColumn("back", -F.col("n")), _backward(key))


def _spans(found: DataFrame, kind: Column, width: Column, weight: Column) -> DataFrame:
    return found.select("symbol", "ts", kind.alias("kind"), width.cast("long").alias("width"), weight.cast("double").alias("weight"))


def all_patterns(bars: DataFrame, snaps: DataFrame) -> DataFrame:
    """(symbol, ts, kind, width, weight) by every detector: ten candles, flags, resistance, support, triangle, rectangle, volume, bands, true range; weight is the confidence, 0 to 1."""
    c = F.col
    wide = F.when(c("pattern").isin("morning_star", "evening_star"), 3).when(c("pattern").isin("engulfing", "harami", "hammer", "hanging_man", "shooting_star"), 2).otherwise(1)
    lit = lambda n: F.lit(n)
    broken = breakouts.at_levels(snaps).unionByName(breakouts.from_shapes(snaps)).unionByName(breakouts.by_size(snaps))
    parts = [
        _spans(candles(bars), c("pattern"), wide, F.abs("strength") / 100 * 0.8),
        _spans(flags(bars), F.lower("pattern"), lit(15), F.least(F.lit(0.95), 0.5 + F.abs("move_pct") / 100)),
        _spans(broken, c("kind"), F.least(F.lit(60), c("width") + 1), F.least(F.lit(0.95), c("sure") / 100)),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def scan(bars: DataFrame, snaps: DataFrame, sure: float = 0.6, longest: int = 60, cover: bool = False, most: int | None = None) -> DataFrame:
    """(symbol, start, end, kind, weight): of all patterns with a confidence of `sure` and over, those that do not overlap and weigh most; start and end are times.

    cover: a row that a pattern spans weighs its confidence, so that long ones stand against many short ones. most: only so many a symbol, the surest and then the latest.
    """
    places = bars.select("symbol", "ts", F.row_number().over(Window.partitionBy("symbol").orderBy("ts")).alias("at"))
    rows = all_patterns(bars, snaps).where(F.col("weight") >= sure).join(places, ["symbol", "ts"])
    rows = rows.select("symbol", F.greatest(F.lit(1), F.col("at") - F.col("width") + 1).cast("long").alias("start"), F.col("at").cast("long").alias("end"), "kind", "weight")
    rows_of = F.col("end") - F.col("start") + 1
    best = best_intervals(rows.withColumn("weight", F.col("weight") * rows_of) if cover else rows, longest)
    best = best.withColumn("weight", F.col("weight") / rows_of) if cover else best
    named = best.join(places.withColumnsRenamed({"at": "start", "ts": "_from"}), ["symbol", "start"]).join(places.withColumnsRenamed({"at": "end", "ts": "_to"}), ["symbol", "end"])
    out = named.select("symbol", F.col("_from").alias("start"), F.col("_to").alias("end"), "kind", "weight")
    if most is None:
        return out
    rank = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("weight"), F.desc("end")))
    return out.withColumn("_rn", rank).where(F.col("_rn") <= most).drop("_rn")
