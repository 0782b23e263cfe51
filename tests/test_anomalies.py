"""Isolation forest: path lengths by hand, planted outliers, streams."""

from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.operators import anomalies
from tickloom.plans import registry

SCHEMA = "id long, a double, b double"


def points(n=600, seed=1):
    r = random.Random(seed)
    rows = [(i, r.gauss(0, 1), r.gauss(50, 10)) for i in range(n)]
    return rows + [(n + k, 9.0 + k, -200.0 - 50 * k) for k in range(5)]


def by_hand(x, nodes, sample):
    """Mean path length of a point, tree by tree down the node table."""
    trees = defaultdict(dict)
    for n in nodes:
        trees[n.tree][n.node] = n
    lengths = []
    for tree in trees.values():
        at = tree[0]
        while at.feature >= 0:
            at = tree[at.below if x[at.feature] < at.split else at.above]
        lengths.append(at.length)
    return sum(lengths) / len(lengths)


def test_paths_are_those_down_the_nodes(spark):
    rows = spark.createDataFrame(points(), SCHEMA)
    nodes = anomalies.forest(rows, ["a", "b"], trees=20, sample=64)
    known = nodes.collect()
    assert len({n.tree for n in known}) == 20 and all(n.above == n.below + 1 for n in known if n.feature >= 0)
    got = anomalies.path_lengths(rows, ["a", "b"], spark.createDataFrame(known, anomalies.NODE), sample=64).collect()
    for r in got:
        want = by_hand((r.a, r.b), known, 64)
        assert r.path == pytest.approx(want) and r.score == pytest.approx(2 ** (-want / anomalies.average_path(64)))
    assert nodes.collect() == known  # the same rows, the same forest


def test_trees_hold_their_sample():
    x = np.random.default_rng(0).normal(size=(256, 3))
    nodes = anomalies.grow(x, np.random.default_rng(1), 8)
    leaf = {n[0]: 0 for n in nodes if n[1] < 0}
    for v in x:
        at = nodes[0]
        while at[1] >= 0:
            at = nodes[at[3] if v[at[1]] < at[2] else at[4]]
        leaf[at[0]] += 1
    assert all(leaf.values()) and sum(leaf.values()) == 256
    depth = {0: 0}
    for n in nodes:
        if n[1] >= 0:
            depth[n[3]] = depth[n[4]] = depth[n[0]] + 1
    for n in nodes:
        if n[1] < 0:
            assert n[5] == pytest.approx(depth[n[0]] + anomalies.average_path(leaf[n[0]])) and depth[n[0]] <= 8


def test_planted_outliers_score_highest(spark):
    rows = spark.createDataFrame(points(), SCHEMA)
    scored = anomalies.anomalies(rows, ["a", "b"], contamination=0.02).orderBy(F.desc("score")).collect()
    assert {r.id for r in scored[:5]} == set(range(600, 605)) and all(r.anomaly for r in scored[:5])
    assert 5 <= sum(r.anomaly for r in scored) <= 0.03 * len(scored)
    # scales of features do not matter
    other = anomalies.anomalies(rows.withColumn("b", F.col("b") * 1000), ["a", "b"], contamination=0.02)
    assert {r.id for r in other.orderBy(F.desc("score")).limit(5).collect()} == set(range(600, 605))


def test_odd_rows(spark):
    rows = spark.createDataFrame([*points(150), (900, None, 1.0), (901, float("nan"), 1.0), (902, float("inf"), 1.0)], SCHEMA)
    got = {r.id: r for r in anomalies.anomalies(rows, ["a", "b"], trees=10).collect()}
    assert len(got) == 158 and all(got[i].score is None and not got[i].anomaly for i in (900, 901, 902))
    few = anomalies.anomalies(rows.limit(99), ["a", "b"]).collect()
    assert len(few) == 99 and not any(r.anomaly for r in few)
    assert anomalies.anomalies(rows.where("false"), ["a", "b"]).count() == 0
    same = spark.createDataFrame([(i, 1.0, 2.0) for i in range(200)], SCHEMA)
    assert not any(r.anomaly for r in anomalies.anomalies(same, ["a", "b"], trees=5).collect())


def test_a_stream_is_scored_like_the_table(spark, tmp_path):
    rows = spark.createDataFrame(points(200), SCHEMA)
    nodes = spark.createDataFrame(anomalies.forest(rows, ["a", "b"], trees=10).collect(), anomalies.NODE)
    rows.repartition(3).write.parquet(f"file://{tmp_path}/in")
    stream = anomalies.path_lengths(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in"), ["a", "b"], nodes)
    stream.writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/check").trigger(availableNow=True).start().awaitTermination()
    got = spark.read.schema(stream.schema).parquet(f"file://{tmp_path}/out")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, anomalies.path_lengths(rows, ["a", "b"], nodes).collect()))


def test_alerts_are_the_later_anomalies(spark):
    found = registry.queries()["anomaly_alerts"](spark, "/root/testdata/sf0.001").collect()
    assert found and {r.severity for r in found} == {"WARNING"}
