"""Vector code compression: product codes of integer vectors, whose entries are found by exponion search from the entry of the round before."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .exponion import Centres, integers, is_whole, matrix, nearest, rounds


def _assign(edges: list[int]):
    parts, dims = len(edges) - 1, edges[-1]

    def assign(state: DataFrame, old: list[np.ndarray], books: list[np.ndarray]) -> DataFrame:
        centres, names = [Centres(book) for book in books], state.columns

        def run(batches):
            for batch in batches:
                v, codes = matrix(batch.column("v"), dims), matrix(batch.column("code"), parts)
                error = np.zeros(len(v), dtype=np.int64)
                for p in range(parts):
                    codes[:, p], far = nearest(v[:, edges[p] : edges[p + 1]], centres[p], codes[:, p].copy())
                    error += far
                ends = pa.array(np.arange(0, codes.size + 1, parts), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id"), batch.column("label"), batch.column("v"), pa.ListArray.from_arrays(ends, pa.array(codes.ravel().astype(np.int32))), pa.array(error)], names=names
                )

        return state.mapInArrow(run, state.schema)

    return assign


def compress(vectors: DataFrame, parts: int = 8, entries: int = 16, many: int = 6, scale: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, list[np.ndarray]]:
    """(vec_id, label, v, code, error) of every vector, and the codebooks, an array of entries for each part.

    Components become floor(scale * x); vectors are cut into equal consecutive parts (where the length is no multiple, parts differ by
    one component). A part's book starts as that part of the vectors with the `entries` smallest ids (null: last; ties: by components), fewer where there are
    fewer; `many` rounds assign each part to its nearest entry, ties to the lower index, and move each entry to its parts' floored
    mean. Then all are assigned once more; `error` is the squared distance over all parts.

    Rows go whose vector is null or holds null, NaN or infinite components, or has another length than most vectors (of equally frequent
    lengths the longest stays). Repeated rows and ids count each; a table without vectors gives no rows and empty books. Components
    beyond exponion.most_component (190 million at 64 dimensions) are cut there, so that squared distances fit. The driver holds the books alone; each round's
    assignment is written to the shared folder and replaces that of the round before.
    """
    scratch = Scratch(vectors.sparkSession)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector")).where(is_whole(F.col("vector")))
    common = rows.groupBy(F.size("vector").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    dims = common.dims if common else 0
    edges = [p * dims // parts for p in range(parts + 1)]
    state = integers(rows.where(F.size("vector") == dims), scale, dims, ["vec_id", "label"]) if dims else rows.where(F.size("vector") == 0).select("vec_id", "label", F.col("vector").cast("array<int>").alias("v"))
    state = scratch.write(state.select("vec_id", "label", "v", F.array_repeat(F.lit(0), parts).alias("code"), F.lit(0).cast("long").alias("error")), "vectors")
    first = [row.v for row in state.orderBy(F.asc_nulls_last("vec_id"), "v").select("v").limit(entries).collect()]
    start = np.array(first, dtype=np.int64).reshape(len(first), dims)
    return rounds(state, edges, [start[:, a:b] for a, b in zip(edges, edges[1:], strict=False)], many, _assign(edges), scratch)


def books_digest(books: list[np.ndarray]) -> str:
    """sha256 of all components by part, entry and place, as decimal integers joined by commas."""
    return hashlib.sha256(",".join(str(x) for book in books for x in book.ravel().tolist()).encode()).hexdigest()


def digest(rows: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of the rows and books of compress."""
    by_label = rows.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    code = F.lower(F.array_join(F.transform("code", lambda c: F.lpad(F.hex(c), 2, "0")), ""))
    joined = rows.join(by_label, F.col("label").eqNullSafe(F.col("_label")))
    return joined.select("vec_id", code.alias("code"), "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))


def oracle(parts: int = 8, entries: int = 16, many: int = 6, scale: int = 4096, dims: int = 64) -> str:
    """The same rows in SQL: every part against every entry, round by round."""
    width = dims // parts
    steps = []
    for k in range(many + 1):
        steps.append(f"""a{k} as materialized (select n, part, arg_min(entry, d * {entries} + entry) as entry, min(d) as d from
            (select x.n, x.part, c.entry, sum((x.x - c.x) * (x.x - c.x))::bigint as d from x join c{k} c using (part, pos) group by x.n, x.part, c.entry) group by n, part)""")
        if k < many:
            steps.append(f"""c{k + 1} as materialized (select c.part, c.entry, c.pos, coalesce(m.x, c.x) as x from c{k} c left join
            (select part, entry, pos, floor(sum(x)::hugeint / count(*))::bigint as x from x join a{k} using (n, part) group by part, entry, pos) m using (part, entry, pos))""")
    return f"""with v as materialized (select row_number() over (order by vec_id) - 1 as n, vec_id, label, embedding as e from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        x as materialized (select n, (i // {width})::int as part, (i % {width})::int as pos, floor({scale} * e[i + 1]::double)::bigint as x from v, range({dims}) r(i)),
        c0 as materialized (select part, n as entry, pos, x from x where n < {entries}), {', '.join(steps)},
        o as (select n, string_agg(format('{{:02x}}', entry), '' order by part) as code, sum(d)::bigint as error from a{many} group by n)
        select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, (select sha256(string_agg(x::varchar, ',' order by part, entry, pos)) from c{many}) as codebooks_sha256 from v join o using (n)"""
