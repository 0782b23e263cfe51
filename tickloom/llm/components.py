"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def connected_components(edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """Edges (a, b), any order and repeats allowed, to (node, component): the smallest node reachable.

    Every round hangs the neighbours of a node on the smallest one, first those above it, then
    those below. The minimum is a partial aggregate and is joined back, so that a hub's edges
    never meet in one task and adaptive execution may split them; the number of rounds
    grows with the logarithm of a chain's length. Only nodes that have an edge come out. Edges from
    a node to itself and null ends are ignored. A round's edges go when the next one's are written; the last
    stay, for the caller's scratch to drop.
    """
    scratch = scratch or Scratch(edges.sparkSession)
    clean = edges.where("a is not null and b is not null and a <> b")
    own = Scratch(edges.sparkSession)
    now = own.write(clean.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before, signature = None, _signature(now)
    while signature != before:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
        small = large.join(least, F.col("a") == F.col("u"))
        small = small.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        last = own
        own = Scratch(edges.sparkSession)
        now = own.write(small.where("a <> b").distinct(), "edges")
        last.drop()
        before, signature = signature, _signature(now)
    scratch.paths += own.paths
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
