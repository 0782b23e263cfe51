"""Operator 9, mixing sources to target weights by systematic sampling, with DataFrame functions alone.

A source's documents are expected target / size times each. In a fixed order, those expected copies are summed up, one
offset of the source is added, and a document comes out once for each whole number its step crosses. The order goes by
size, so that the words taken differ from the target by about one long document, not by chance.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, hash_cell, materialise, word_count

#: Weights of sources in order, repeating.
WEIGHTS = (1, 2, 3)
MOST_COPIES = 3
#: Documents of one source and size go to so many cells, so that none is too large to number.
CELLS = 64
_OFFSETS = 1 << 30


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """Sources (source, source_size) to (source, source_size, target).

    Sources weigh by code point order, null last, and share all sizes; none gets over `most` times its own, and what it leaves goes to the others
    by weight until none is above. The sources that stop are those with the least size for their weight: with t_k = (total - limits of
    the k first) / (weights of the others), the share of weight 1 is the first t_k that the next source still holds.
    """
    numbered = sizes.withColumn("_n", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1)  # a row a source
    weighed = numbered.withColumn("_w", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("_n") % len(weights) + 1).cast("int")))
    limited = weighed.withColumn("_limit", F.col("source_size") * most)
    order = Window.orderBy((F.col("_limit") / F.col("_w")), "_n")
    before, all_rows = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    taken, others = F.coalesce(F.sum("_limit").over(before), F.lit(0)), F.sum("_w").over(order.rowsBetween(0, Window.unboundedFollowing))
    share = limited.withColumn("_t", (F.sum("source_size").over(all_rows) - taken) / others)
    level = F.min(F.when(F.col("_t") * F.col("_w") <= F.col("_limit"), F.struct(F.col("_limit") / F.col("_w"), "_n", "_t"))).over(all_rows)["_t"]
    target = F.least(F.col("_w") * level, F.col("_limit").cast("double"))
    return share.select("source", "source_size", target.alias("target"))


def plan_copies(rows: DataFrame, seed: int = 42, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """rows (doc_id, source, size, cell, digest, and others not of the names used here) with source_size, target and copies: how often the mix takes each.

    Null is a source of its own. A source without a word takes nothing, and its rows come out 0 times. Rows that share an id, or have
    none, are numbered by their text's digest. The texts themselves are not looked at.
    """
    sizes = rows.groupBy("source", "size", "cell").agg(F.count("*").alias("n"))
    by_size = sizes.groupBy("source", "size").agg(F.sum("n").alias("all"))
    total = targets(by_size.groupBy("source").agg(F.sum(F.col("size") * F.col("all")).alias("source_size")), weights, most).withColumnRenamed("source", "s")
    smaller = by_size.select(F.col("source").alias("s"), F.col("size").alias("z"), (F.sum("all").over(Window.partitionBy("source").orderBy("size")) - F.col("all")).alias("smaller"))
    in_size = F.sum("n").over(Window.partitionBy("source", "size").orderBy("cell")) - F.col("n")
    start = sizes.withColumn("in_size", in_size).join(smaller, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")))
    start = start.select(F.col("source").alias("s"), F.col("size").alias("z"), F.col("cell").alias("c"), (F.col("smaller") + F.col("in_size")).alias("start"))
    inside = Window.partitionBy("source", "size", "cell").orderBy(F.asc_nulls_last("doc_id"), "digest")
    ranked = rows.withColumn("in_cell", F.row_number().over(inside) - 1)
    placed = ranked.join(start, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")) & (F.col("cell") == F.col("c"))).drop("s", "z", "c")
    aimed = placed.join(total, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    offset = hash_cell(F.col("source"), f"offset-{seed}-", _OFFSETS) / F.lit(float(_OFFSETS))
    step = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(0.0)
    k = F.col("start") + F.col("in_cell")
    crossed = F.floor((k + 1) * step + offset) - F.floor(k * step + offset)
    return aimed.withColumn("copies", F.least(crossed, F.lit(most)).cast("long")).drop("start", "in_cell")


def measured(docs: DataFrame, seed: int, id_col: str, text_col: str, source_col: str, *more) -> DataFrame:
    """(doc_id, source, size, cell, digest, more) of each row, written, so that each text is read once. Size is the number of words, null: 0."""
    return materialise(docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), hash_cell(F.col(id_col), f"mix-{seed}-", CELLS).cast("int").alias("cell"), F.md5(text_col).alias("digest"), *more,
    ), "sizes")


def mix(docs: DataFrame, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **kw) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies) of each row; taken = copies * size. An empty table gives an empty one; other columns are not looked at."""
    out = plan_copies(measured(docs, seed, id_col, text_col, source_col), seed, **kw)
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def apply_mix(docs: DataFrame, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **kw) -> DataFrame:
    """docs' rows, each as often as the mix takes it. Rows are told apart by a 64-bit hash of all columns; the copies of equal rows are added up. Any column name may be there."""
    key, times, copy = fresh(docs, "row_key", "times", "copy")
    keyed = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])
    planned = plan_copies(measured(docs, seed, id_col, text_col, source_col, keyed.alias("row_key")), seed, **kw)
    wanted = planned.groupBy(F.col("row_key").alias(key)).agg(F.sum("copies").alias(times)).where(F.col(times) > 0)
    taken = docs.withColumn(key, keyed).join(wanted, key).dropDuplicates([key])
    return taken.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times).cast("int")))).select(*docs.columns)


def oracle(seed: int = 42) -> str:
    """DuckDB SQL for `mix` of documents."""
    return f"""
    with d as (
        select doc_id, text, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as size,
               ('0x' || substr(md5('mix-{seed}-' || coalesce(doc_id::varchar, 'null')), 1, 8))::bigint % {CELLS} as cell from documents
    ), s as (
        select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) - 1 as n from d group by source
    ), w as (
        select *, [1, 2, 3][(n % 3 + 1)::int] as w, source_size * {MOST_COPIES} as cap from s
    ), t as (
        select *, ((sum(source_size) over ())::double - coalesce(sum(cap) over (order by cap / w, n rows between unbounded preceding and 1 preceding), 0)::double)
                  / (sum(w) over (order by cap / w, n rows between current row and unbounded following))::double as t from w
    ), l as (select first(t order by cap / w, n) as level from t where t * w <= cap),
    g as (select source, source_size, least(w * level, cap::double) as target from t, l),
    k as (
        select d.*, row_number() over (partition by source order by size, cell, doc_id nulls last, md5(text)) - 1 as k from d
    ), x as (
        select doc_id, size, source_size, target, k,
               case when source_size > 0 then least(target / source_size, {MOST_COPIES}.0::double) else 0.0::double end as step,
               (('0x' || substr(md5('offset-{seed}-' || coalesce(k.source, 'null')), 1, 8))::bigint % {_OFFSETS})::double / {float(_OFFSETS)}::double as u
        from k join g on k.source is not distinct from g.source
    ), y as (
        select *, least(floor((k + 1) * step + u) - floor(k * step + u), {MOST_COPIES})::bigint as copies from x
    )
    select doc_id, size, source_size, target, copies * size as taken, copies from y
    """
