"""Operator 5, sharding by extendible hashing, with DataFrame functions alone.

A document's hash has 60 bits. The directory starts as one shard; a shard over the byte limit splits on its next bit, and only such a
shard does. So a document's shard is the shortest prefix of its hash whose documents fit the limit together. Sizes of prefixes are summed
from those of cells, prefixes some bits longer than an average shard's; documents of a cell that is itself too large go
on to a longer one.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialise

BITS = 60
#: A round looks so many bits further than it would need if all shards were alike.
SPARE_BITS = 4
#: Rounds of a level each, after the first, while shards are over the limit.
STEP = 8


def _key(id_col: str):
    digest = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("null")))
    return F.conv(F.substring(digest, 1, BITS // 4), 16, 10).cast("long")


def _prefix(key, bits):
    """The first bits of a 60-bit key; both may be columns."""
    return F.call_function("shiftright", key, (F.lit(BITS) - bits).cast("int"))


def directory(cells: DataFrame, limit: int, low: int, high: int) -> DataFrame:
    """Cells (cell of `high` bits, bytes, docs) to (cell, depth, shard, shard_bytes, shard_docs): the shortest prefix of low..high bits that fits.

    A cell over the limit gets depth null.
    """
    levels = F.explode(F.sequence(F.lit(low), F.lit(high)))
    every = cells.select("cell", "bytes", "docs", levels.alias("depth"))
    every = every.withColumn("shard", F.call_function("shiftright", F.col("cell"), (F.lit(high) - F.col("depth")).cast("int")))
    fits = every.groupBy("depth", "shard").agg(F.sum("bytes").alias("shard_bytes"), F.sum("docs").alias("shard_docs")).where(F.col("shard_bytes") <= limit)
    best = every.join(fits, ["depth", "shard"]).groupBy("cell").agg(F.min(F.struct("depth", "shard", "shard_bytes", "shard_docs")).alias("best"))
    return cells.select("cell").join(best, "cell", "left").select("cell", "best.*")


def shard(docs: DataFrame, limit: int = 4 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, bytes, key, depth, shard, shard_bytes, shard_docs): the shard of each row, named by `depth` leading bits of the key.

    bytes: the text's in UTF-8 (null: 0). A key whose rows alone are over the limit, as one longer document or
    rows that share an id can be, cannot be split: it is a shard of its own at depth 60, over the limit. Null ids share
    a key. Depth 0 is a table that fits as it is; an empty table gives an empty one; other columns are not looked at.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("bytes"), _key(id_col).alias("key"))
    rows = materialise(rows, "keys")
    total = rows.agg(F.sum("bytes")).first()[0] or 0
    low, high = 0, min(BITS, SPARE_BITS + math.ceil(math.log2(max(1, total / limit))))
    done, left = [], rows
    while True:
        dealt = left.withColumn("cell", _prefix(F.col("key"), F.lit(high)))
        cells = dealt.groupBy("cell").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("docs"))
        found = materialise(directory(cells, limit, low, high), "directory")
        placed = dealt.join(found.where("depth is not null"), "cell").drop("cell")
        done.append(placed)
        over = found.where("depth is null").select("cell")
        if not over.take(1):
            break
        left = dealt.join(over, "cell", "left_semi").drop("cell")
        if high == BITS:
            alone = left.groupBy("key").agg(F.sum("bytes").alias("shard_bytes"), F.count("*").alias("shard_docs"))
            done.append(left.join(alone, "key").select("doc_id", "bytes", "key", F.lit(BITS).alias("depth"), F.col("key").alias("shard"), "shard_bytes", "shard_docs"))
            break
        low, high = high + 1, min(BITS, high + STEP)
    out = done[0].select("doc_id", "bytes", "key", "depth", "shard", "shard_bytes", "shard_docs")
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def write_shards(docs: DataFrame, path: str, limit: int = 4 << 20, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write docs as Parquet, a folder `depth=.../shard=...` for each shard; a shard goes to one task, which its limit keeps small."""
    depth, name, key = fresh(docs, "depth", "shard", "shard_key")
    where = shard(docs, limit, id_col, text_col).select(F.col("key").alias(key), F.col("depth").alias(depth), F.col("shard").alias(name)).distinct()
    placed = docs.withColumn(key, _key(id_col)).join(where, key).drop(key)
    placed.repartition(depth, name).write.partitionBy(depth, name).parquet(path)


def oracle(limit: int = 4 << 20) -> str:
    """DuckDB SQL for `shard` of documents."""
    return f"""
    with d as (
        select doc_id, coalesce(strlen(text), 0)::bigint as bytes,
               ('0x' || substr(md5(coalesce(doc_id::varchar, 'null')), 1, 15))::bigint as key from documents
    ), e as (
        select d.*, depth, key >> ({BITS} - depth) as shard from d, (select unnest(range({BITS + 1}))::int as depth)
    ), s as (
        select depth, shard, sum(bytes)::bigint as shard_bytes, count(*) as shard_docs from e group by depth, shard
    ), f as (
        select e.doc_id, e.bytes, e.key, depth, shard, shard_bytes, shard_docs,
               row_number() over (partition by doc_id, key order by depth) as n
        from e join s using (depth, shard) where shard_bytes <= {limit} or depth = {BITS}
    )
    select doc_id, bytes, key, depth, shard, shard_bytes, shard_docs from f where n = 1
    """
