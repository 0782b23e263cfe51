"""Window frames over a symbol's bars, and the rule that a frame must be full."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def in_order(by: str = "symbol", order: str = "ts") -> WindowSpec:
    return Window.partitionBy(by).orderBy(order)


def last(n: int, by: str = "symbol", order: str = "ts") -> WindowSpec:
    """The last n rows, this one included."""
    return in_order(by, order).rowsBetween(-(n - 1), 0)


def so_far(by: str = "symbol", order: str = "ts") -> WindowSpec:
    return in_order(by, order).rowsBetween(Window.unboundedPreceding, 0)


def before(n: int, by: str = "symbol", order: str = "ts") -> WindowSpec:
    """The n rows before this one."""
    return in_order(by, order).rowsBetween(-n, -1)


def lag(column: Column | str, k: int = 1) -> Column:
    return F.lag(column, k).over(in_order())


def full(value: Column | str, aggregate: Column, n: int) -> Column:
    """The aggregate over the last n rows; null until n values are there."""
    return F.when(F.count(value).over(last(n)) == n, aggregate.over(last(n)))


def mean(value: Column | str, n: int) -> Column:
    return full(value, F.avg(value), n)


def highest(value: Column | str, n: int) -> Column:
    return full(value, F.max(value), n)


def lowest(value: Column | str, n: int) -> Column:
    return full(value, F.min(value), n)


def total(value: Column | str, n: int) -> Column:
    return full(value, F.sum(value), n)


def as_of_join(left: DataFrame, right: DataFrame, by: str, ts: str, values: list[str]) -> DataFrame:
    """left with the values of right's last row at or before each time, of the same key: one union and one window, no range join."""
    blank = [F.lit(None).cast(right.schema[v].dataType).alias(v) for v in values]
    marked = left.select("*", *blank, F.lit(1).alias("_left"))
    known = right.select(by, ts, *values, F.lit(0).alias("_left"))
    both = marked.unionByName(known, allowMissingColumns=True)
    frame = Window.partitionBy(by).orderBy(ts, "_left").rowsBetween(Window.unboundedPreceding, 0)
    filled = both.withColumn("_at", F.last(F.when(F.col("_left") == 0, F.struct(*values)), ignorenulls=True).over(frame))
    return filled.where("_left = 1").select(*left.columns, *[F.col("_at")[v].alias(v) for v in values])


def islands(rows: DataFrame, flag: str, by: str = "symbol", order: str = "ts") -> DataFrame:
    """rows with `island`, a number for each run of equal flags, and `run_length`, the rows of the run so far."""
    changed = F.coalesce((~F.col(flag).eqNullSafe(F.lag(flag).over(in_order(by, order)))).cast("int"), F.lit(1))
    numbered = rows.withColumn("_new", changed).withColumn("island", F.sum("_new").over(so_far(by, order))).drop("_new")
    return numbered.withColumn("run_length", F.row_number().over(Window.partitionBy(by, "island").orderBy(order)))
