"""All breakouts of a symbol's rows: levels, triangles, rectangles, volatility, volume, bands and true range, judged and ranked as one set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.windows import full, in_order, lag, last
from tickloom.operators import strategies as st
from tickloom.streaming import keyed, machines, shapes

SHAPE = ("symbol", "ts", "regime", "volatility", "kind", "direction", "quality", "level", "entry", "target", "stop", "width", "volume_ratio", "momentum", "sure")


def prices(snaps: DataFrame) -> DataFrame:
    """(symbol, ts, high, low, close, volume) of snapshots; where they have no high and low, the price."""
    own = lambda c: F.coalesce(F.col(c), F.col("price")) if c in snaps.columns else F.col("price")
    return snaps.select("symbol", "ts", own("high").alias("high"), own("low").alias("low"), F.col("price").alias("close"), "volume")


def _with(found: DataFrame, snaps: DataFrame) -> DataFrame:
    return found.join(snaps.select("symbol", "ts", "regime", "volatility"), ["symbol", "ts"])


def at_levels(snaps: DataFrame) -> DataFrame:
    """Breaks of living levels, aimed the height that the price went on the other side, stopped 2 % behind the level; the oldest broken level of a side at each row."""
    c, up = F.col, F.col("side") == "resistance"
    found = keyed.run(prices(snaps), machines.price_levels()).where("broken").groupBy("symbol", "ts", "side").agg(F.min_by(F.struct("price", "age", "strength", "height", "volume_ratio", "momentum"), "level").alias("x")).select("symbol", "ts", "side", "x.*")
    found = _with(found, snaps).join(snaps.select("symbol", "ts", F.col("price").alias("entry")), ["symbol", "ts"])
    out = found.withColumns({
        "kind": c("side"), "direction": F.when(up, "UP").otherwise("DOWN"), "quality": st.breakout_quality(c("strength"), c("volume_ratio"), c("momentum")), "level": c("price"), "target": c("price") + F.when(up, c("height")).otherwise(-c("height")),
        "stop": c("price") * F.when(up, 0.98).otherwise(1.02), "width": (c("age") + 20).cast("long"), "sure": c("strength") * 100,
    })
    return out.select(*SHAPE)


def from_shapes(snaps: DataFrame) -> DataFrame:
    """Breakouts of triangles and rectangles, graded by fit and touches."""
    c = F.col
    found = _with(keyed.run(prices(snaps), shapes.shapes()), snaps)
    grade = F.when(c("kind") == "triangle", st.triangle_quality(c("high_r"), c("low_r"), c("touches"))).otherwise(st.rectangle_quality(c("width"), c("touches")))
    return found.withColumns({"quality": grade, "volume_ratio": F.lit(1.0), "momentum": F.lit(0.0)}).select(*SHAPE)


def by_size(snaps: DataFrame) -> DataFrame:
    """Breakouts of one row: over three times the mean volume of 20 with a move over 1 %, a price outside bands of two deviations of 20, a move over 1.5 times the true range of 14; one exchange serves all."""
    p = prices(snaps).join(snaps.select("symbol", "ts", "regime", "volatility"), ["symbol", "ts"])
    c, before = F.col, lag("close")
    move = c("close") - before
    true = F.greatest(c("high") - c("low"), F.abs(c("high") - before), F.abs(c("low") - before))
    out = p.withColumns({"_move": move, "_change": move / F.nullif(before, F.lit(0.0)), "_true": true, "_range": c("high") - c("low"), "_n": F.row_number().over(in_order())})
    out = out.withColumns({"_ratio": c("volume") / F.nullif(F.avg("volume").over(last(20)), F.lit(0.0)), "_mean": full("close", F.avg("close"), 20), "_dev": full("close", F.stddev_samp("close"), 20), "_atr": full("_true", F.avg("_true"), 14), "_span": F.avg("_range").over(last(20))})
    up, price = c("_move") > 0, c("close")
    way = F.when(up, 1.0).otherwise(-1.0)
    top, low = c("_mean") + 2 * c("_dev"), c("_mean") - 2 * c("_dev")

    def shape(cond: Column, kind: str, rising: Column, quality: Column, level: Column, target: Column, stop: Column, width: int, ratio: Column, momentum: Column, sure: Column) -> Column:
        names = dict(kind=F.lit(kind), direction=F.when(rising, "UP").otherwise("DOWN"), quality=quality, level=level, entry=price, target=target, stop=stop, width=F.lit(width).cast("long"), volume_ratio=ratio, momentum=momentum, sure=sure)
        return F.when(cond, F.struct(*[x.cast("double").alias(k) if k in ("level", "entry", "target", "stop", "volume_ratio", "momentum", "sure") else x.alias(k) for k, x in names.items()]))

    by = c("_span") * c("_ratio") * 0.5
    times = F.abs("_move") / F.nullif(c("_atr"), F.lit(0.0))
    every = F.array(
        shape((c("_n") >= 20) & (c("_ratio") > 3) & (F.abs("_change") > 0.01), "volume", up, F.when(c("_ratio") > 6, "STRONG").otherwise("MODERATE"), price, price + way * by, price - way * c("_span"), 1, c("_ratio"), F.abs("_change"), F.least(F.lit(90.0), 60 + c("_ratio") * 5)),
        shape(price > top, "bands", F.lit(True), F.lit("MODERATE"), top, price + (top - low) * 0.5, c("_mean"), 20, F.lit(1.0), (price - top) / F.nullif(top, F.lit(0.0)), F.lit(70.0)),
        shape(price < low, "bands", F.lit(False), F.lit("MODERATE"), low, price - (top - low) * 0.5, c("_mean"), 20, F.lit(1.0), (low - price) / F.nullif(low, F.lit(0.0)), F.lit(70.0)),
        shape((c("_atr") > 0) & (times > 1.5), "range", up, F.when(times > 3, "STRONG").otherwise("MODERATE"), price, price + way * c("_atr") * 2, price - way * c("_atr"), 14, F.lit(1.0), times, F.least(F.lit(90.0), 60 + times * 10)),
    )
    return out.select("symbol", "ts", "regime", "volatility", F.explode(F.filter(every, lambda x: x.isNotNull())).alias("_p")).select("symbol", "ts", "regime", "volatility", "_p.*")


def every(snaps: DataFrame) -> DataFrame:
    """Breakouts by all detectors, judged: resistance, support, triangle, rectangle, volatility, volume, bands, range."""
    volatile = st.breakouts(snaps).where(F.col("kind") == "volatility").withColumn("width", F.col("width").cast("long")).select(*SHAPE)
    return st.judged(at_levels(snaps).unionByName(from_shapes(snaps)).unionByName(by_size(snaps)).unionByName(volatile))
