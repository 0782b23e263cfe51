"""Anomalies by isolation forest: trees grown from bounded samples, kept as a table of nodes, and walked for every row, a batch at a time."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NODE = "tree int, node int, feature int, split double, below int, above int, length double"


def average_path(n: int) -> float:
    """Mean depth at which a search in a random tree of n values ends without a hit."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def grow(x: np.ndarray, rng: np.random.Generator, most_depth: int) -> list[tuple[int, int, float, int, int, float]]:
    """(node, feature, split, below, above, length) of a tree over rows x, root first: values under the split go below. A leaf has feature -1 and the path length that it stands for; it goes to itself."""
    nodes: list[tuple[int, int, float, int, int, float]] = []
    waiting = [(np.arange(len(x)), 0)]
    made = 1
    for rows, depth in waiting:
        node = len(nodes)
        low, high = x[rows].min(axis=0, initial=np.inf), x[rows].max(axis=0, initial=-np.inf)
        open_ = np.flatnonzero(high > low)
        if depth >= most_depth or len(rows) < 2 or not len(open_):
            nodes.append((node, -1, 0.0, node, node, depth + average_path(len(rows))))
            continue
        feature = int(open_[rng.integers(len(open_))])
        split = float(rng.uniform(low[feature], high[feature]))
        split = split if split > low[feature] else float(high[feature])  # both sides get rows
        under = x[rows, feature] < split
        nodes.append((node, feature, split, made, made + 1, 0.0))
        waiting += [(rows[under], depth + 1), (rows[~under], depth + 1)]
        made += 2
    return nodes


def sound(features: list[str]) -> Column:
    """All features are finite numbers."""
    ok = [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) < float("inf")) for c in features]
    out = ok[0]
    for x in ok[1:]:
        out = out & x
    return out


def forest(rows: DataFrame, features: list[str], trees: int = 100, sample: int = 256, pool: int = 2048, seed: int = 42) -> DataFrame:
    """The nodes (tree, node, feature, split, below, above, length) of a forest.

    The pool is the `pool` rows with the least hashes of their features, so at most so many rows leave the table; each tree is grown from the `sample` of them that have the least hashes of
    tree and row, to a depth of log2(sample), rounded up. Splits are uniform between a feature's bounds, so that scaling the features changes nothing. Rows with a
    null or infinite feature are not drawn. Without rows there are no nodes. The same rows give the same forest.
    """
    values = F.array(*[F.col(c).cast("double") for c in features])
    held = rows.where(sound(features)).select(values.alias("x")).withColumn("h", F.xxhash64(F.lit(seed), "x")).orderBy("h", "x").limit(pool)
    numbered = held.withColumn("i", F.row_number().over(Window.orderBy("h", "x")))  # of the pool alone
    each = numbered.select("x", "i", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree")).withColumn("h", F.xxhash64(F.lit(seed), "tree", "i"))
    drawn = each.withColumn("rank", F.row_number().over(Window.partitionBy("tree").orderBy("h", "i"))).where(F.col("rank") <= sample).select("tree", "rank", "x")
    depth = max(1, math.ceil(math.log2(max(2, sample))))

    def one(group: pd.DataFrame) -> pd.DataFrame:
        x = np.array(group.sort_values("rank")["x"].tolist(), dtype=float)
        tree = int(group["tree"].iloc[0])
        found = grow(x, np.random.default_rng([seed, tree]), depth)
        return pd.DataFrame([(tree, *n) for n in found], columns=["tree", "node", "feature", "split", "below", "above", "length"])

    return drawn.groupBy("tree").applyInPandas(one, NODE)


def path_lengths(rows: DataFrame, features: list[str], nodes: DataFrame, sample: int = 256) -> DataFrame:
    """rows with `path`, the mean path length of the forest, and `score`, 2 to the minus path over its mean for `sample` rows: over half is unusual, near 1 an outlier; null for rows with a null or infinite feature, and without nodes.

    The nodes, at most 2 * sample - 1 a tree, go to the tasks as arrays. A batch of rows walks all trees together, a level a step: a leaf stays where it is, as its split is infinite. Works on streams.
    """
    depth = max(1, math.ceil(math.log2(max(2, sample))))
    known = nodes.orderBy("tree", "node").toPandas()  # bounded by trees and sample
    if not len(known):
        return rows.withColumns({"path": F.lit(None).cast("double"), "score": F.lit(None).cast("double")})
    sizes = known.groupby("tree").size()
    roots = (sizes.cumsum() - sizes).to_numpy()
    leaf = known["feature"].to_numpy() < 0
    feature, split, length = np.where(leaf, 0, known["feature"]), np.where(leaf, np.inf, known["split"]), known["length"].to_numpy()
    below = np.repeat(roots, sizes) + known["below"].to_numpy()

    @F.pandas_udf("double")
    def walked(x: pd.Series) -> pd.Series:
        out, told = np.full(len(x), np.nan), x.notna().to_numpy()
        values = np.array(x[told].tolist(), dtype=float).reshape(-1, len(features))
        found = np.empty(len(values))
        for start in range(0, len(values), 2000):
            part = values[start : start + 2000]
            at, each = np.broadcast_to(roots, (len(part), len(roots))), np.arange(len(part))[:, None]
            for _ in range(depth):  # the upper side of a split follows the lower one
                at = below[at] + (part[each, feature[at]] >= split[at])
            found[start : start + 2000] = length[at].mean(axis=1)
        out[told] = found
        return pd.Series(out)

    values = F.when(sound(features), F.array(*[F.col(c).cast("double") for c in features]))
    path = F.nanvl(walked(values), F.lit(None).cast("double"))
    return rows.withColumn("path", path).withColumn("score", F.pow(F.lit(2.0), -F.col("path") / average_path(sample)))


def limit(rows: DataFrame, features: list[str], nodes: DataFrame, contamination: float = 0.1, sample: int = 256) -> float | None:
    """The score that a share `contamination` of the rows lies over, to a hundredth of a percent of ranks; None without rows."""
    return path_lengths(rows, features, nodes, sample).select(F.percentile_approx("score", 1 - contamination, 10_000)).first()[0]


def anomalies(rows: DataFrame, features: list[str], trained_on: DataFrame | None = None, contamination: float = 0.1, least: int = 100, **kw) -> DataFrame:
    """rows with `path`, `score` and `anomaly`: the score is over what a share `contamination` of the training rows exceeds; the forest comes from the training rows, the rows themselves by default.

    Under `least` training rows nothing is an anomaly, and score and path are null.
    """
    training = rows if trained_on is None else trained_on
    if len(training.select(F.lit(1)).limit(least).collect()) < least:
        return rows.withColumns({"path": F.lit(None).cast("double"), "score": F.lit(None).cast("double"), "anomaly": F.lit(False)})
    kept = {k: v for k, v in kw.items() if k == "sample"}
    nodes = training.sparkSession.createDataFrame(forest(training, features, **kw).collect(), NODE)  # at most trees * (2 * sample - 1) nodes
    bound = limit(training, features, nodes, contamination, **kept)
    return path_lengths(rows, features, nodes, **kept).withColumn("anomaly", F.coalesce(F.col("score") > F.lit(bound), F.lit(False)))


def alerts(scored: DataFrame, at: str = "ts", component: str = "system") -> DataFrame:
    """(ts, severity, component, metric, value, message) of rows that are anomalies."""
    return scored.where("anomaly").select(F.col(at), F.lit("WARNING").alias("severity"), F.lit(component).alias("component"), F.lit("anomaly_score").alias("metric"), F.col("score").alias("value"), F.concat(F.lit("unusual, score "), F.format_number("score", 2)).alias("message"))
