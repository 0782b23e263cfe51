"""Centroid clustering of integer vectors by exponion search with bounds kept from round to round."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .exponion import Bounds, Centres, bounded, integers, is_whole, matrix, rounds, squares


def _assign(dims: int):
    def assign(state: DataFrame, old: list[np.ndarray], books: list[np.ndarray]) -> DataFrame:
        before, centres, names = old[0], Centres(books[0]), state.columns

        def run(batches):
            for batch in batches:
                v = matrix(batch.column("v"), dims)
                held = Bounds(matrix(batch.column("code"), 1)[:, 0], batch.column("upper").to_numpy(), batch.column("lower").to_numpy())
                held = bounded(v, centres, held.moved(before, centres.rows))
                far = squares(v, centres.rows[held.index])
                ends = pa.array(np.arange(len(v) + 1), pa.int32())
                code = pa.ListArray.from_arrays(ends, pa.array(held.index.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), code, pa.array(held.upper), pa.array(held.lower), pa.array(far)], names=names)

        return state.mapInArrow(run, state.schema)

    return assign


def cluster(vectors: DataFrame, centroids: int = 16, many: int = 3, scale: int = 64, dims: int = 64, seed: int = 1, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """(vec_id, v, cluster, distance) of every vector, and the centroids.

    Components become floor(scale * x). Centroids start as the vectors with the smallest sha256 of `<seed>:<vec_id>` (a null id: `<seed>:`; ties: by components), in
    that order, fewer where there are fewer vectors. `many` rounds assign each vector to its nearest centroid (ties: the smaller number) and move each centroid
    that has vectors to their floored mean; then vectors are assigned once more. `distance` is squared.

    Rows go whose vector is null, has another length than dims, or holds null, NaN or infinite components. Repeated rows and ids count
    each; a table without vectors gives no rows. Components beyond exponion.most_component (190 million at 64 dimensions) are cut there. The driver holds
    the centroids alone; a vector's centroid and bounds are written to the shared folder each round in place of those of the round before.
    """
    scratch = Scratch(vectors.sparkSession)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector")).where((F.size("vector") == dims) & is_whole(F.col("vector")))
    state = integers(rows, scale, dims, ["vec_id"]).select("vec_id", "v", F.array(F.lit(0)).alias("code"), F.lit(float("inf")).alias("upper"), F.lit(0.0).alias("lower"), F.lit(0).cast("long").alias("distance"))
    state = scratch.write(state, "vectors")
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = [row.v for row in state.orderBy(order, "v").select("v").limit(centroids).collect()]
    start = np.array(first, dtype=np.int64).reshape(len(first), dims)
    state, books = rounds(state, [0, dims], [start], many, _assign(dims), scratch)
    return state.select("vec_id", "v", F.col("code")[0].alias("cluster"), "distance"), books[0]


def digest(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of the rows and centroids of cluster; the sums are joined as a row a centroid."""
    spark = rows.sparkSession
    totals = {row.cluster: int(row.s) for row in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    table = [(k, totals.get(k, 0), sum(totals.values()), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for k, c in enumerate(centroids.tolist())]
    small = spark.createDataFrame(table, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(small), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle(centroids: int = 16, many: int = 3, scale: int = 64, dims: int = 64, seed: int = 1) -> str:
    """The same rows in SQL: every vector against every centroid, round by round."""
    steps = []
    for k in range(many + 1):
        steps.append(f"""a{k} as materialized (select n, arg_min(entry, d * {centroids} + entry) as entry, min(d) as d from
            (select x.n, c.entry, sum((x.x - c.x) * (x.x - c.x))::bigint as d from x join c{k} c using (pos) group by x.n, c.entry) group by n)""")
        if k < many:
            steps.append(f"""c{k + 1} as materialized (select c.entry, c.pos, coalesce(m.x, c.x) as x from c{k} c left join
            (select entry, pos, floor(sum(x)::hugeint / count(*))::bigint as x from x join a{k} using (n) group by entry, pos) m using (entry, pos))""")
    return f"""with v as materialized (select row_number() over (order by sha256('{seed}:' || vec_id)) - 1 as n, vec_id, embedding as e from embeddings where len(embedding) = {dims} and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        x as materialized (select n, i::int as pos, floor({scale} * e[i + 1]::double)::bigint as x from v, range({dims}) r(i)),
        c0 as materialized (select n as entry, pos, x from x where n < {centroids}), {', '.join(steps)},
        h as (select entry, sha256(string_agg(x::varchar, ',' order by pos)) as centroid_sha256 from c{many} group by entry)
        select vec_id, entry::int as cluster, d as distance, (sum(d) over (partition by entry))::bigint as cluster_inertia, (sum(d) over ())::bigint as inertia, centroid_sha256 from a{many} join v using (n) join h using (entry)"""
