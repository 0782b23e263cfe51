"""Operator 1, SimHash near duplicates, by covering locality-sensitive hashing.

A fingerprint has 64 bits: a bit is set if it is set in over half the XXH64 values of a text's word
shingles. Two fingerprints link if at most `radius` bits differ. Candidates come from
2^(radius+1)-1 tables. Each bit position gets a vector of radius+1 bits that is not zero, each table
a vector v, and a table's key keeps the positions whose vector has an odd overlap with v. However
the at most `radius` differing positions fall, some v has an even overlap with all of them, so
that the pair shares that table's key: no pair within the radius is missed.
"""

from __future__ import annotations

import random
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, one_of_each, row_keys
from .components import connected_components

BITS = 64
#: A bucket of at most so many different fingerprints is compared pair by pair; beyond it, the exact way for many is used.
PAIRWISE = 8
_ROWS_AT_ONCE = 1 << 18


def shingle_hashes(text: str | None, words: int = 3, seed: int = 42) -> np.ndarray:
    """XXH64 of each word shingle of one text, repeats included (at most `words` words: one of all of them; no word: none)."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(found)
    if len(found) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, seed)], dtype=np.uint64)
    sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(found) - words + 1].tolist()
    slices = map(joined.__getitem__, map(slice, starts, ends[words - 1 :].tolist()))
    return np.fromiter(map(xxhash.xxh64_intdigest, slices, repeat(seed)), dtype=np.uint64, count=len(starts))


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """SimHash of one text, as a signed 64-bit integer (null or no word: 0)."""
    return fingerprint_of(shingle_hashes(text, words, seed))


def fingerprint_of(hashes: np.ndarray) -> int:
    if not len(hashes):
        return 0
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), _ROWS_AT_ONCE):
        part = hashes[at : at + _ROWS_AT_ONCE]
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def add_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp) for each row; each whole text is read where it lies, nothing is shuffled."""

    def run(batches):
        for batch in batches:
            texts = batch.column(1)
            prints = [fingerprint(x.as_py(), words, seed) for x in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


def covering_masks(radius: int, bits: int = BITS, seed: int = 7) -> list[int]:
    """The tables' masks, as signed integers."""
    vectors = 2 ** (radius + 1) - 1
    given = [1 + i % vectors for i in range(bits)]
    random.Random(seed).shuffle(given)
    masks = [sum(1 << i for i, p in enumerate(given) if (p & v).bit_count() % 2) for v in range(1, vectors + 1)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _hex(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def links(prints: DataFrame, radius: int = 2, pairwise: int = PAIRWISE) -> DataFrame:
    """Different fingerprints (fp) to edges (a, b) that connect the same fingerprints as all pairs within the radius do.

    A bucket of few fingerprints gives its pairs, compared in full. In a larger one, pairs could grow
    with the square, so each fingerprint goes instead to the points at radius/2 bits from it (itself included)
    and links to the least fingerprint at the same point. Points shared are links within
    the radius, and any two within the radius share one: exact, and linear in the bucket.
    """
    if radius not in (1, 2):
        raise ValueError("the radius is 1 or 2")
    masks = covering_masks(radius)
    keyed = prints.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("t", "key"))
    full = keyed.groupBy("t", "key").agg(F.count("*").alias("n"), F.min("fp").alias("low")).where("n > 1")
    members = materialise(keyed.join(full, ["t", "key"]).select("t", "key", "n", "fp"), "buckets")
    few = members.where(F.col("n") <= pairwise)
    other = few.select("t", "key", F.col("fp").alias("b"))
    near = few.select("t", "key", F.col("fp").alias("a")).join(other, ["t", "key"])
    near = near.where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)).select("a", "b")
    many = members.where(F.col("n") > pairwise).select("fp").distinct()
    flips = [0, *[(1 << i) - (1 << 64) if i == 63 else 1 << i for i in range(BITS)]]
    points = many.select("fp", F.explode(F.array(*[F.col("fp").bitwiseXOR(F.lit(x)) for x in flips])).alias("point"))
    least = points.groupBy("point").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).where("low < high").select("point", "low")
    star = points.join(least, "point").where("fp <> low").select(F.col("fp").alias("a"), F.col("low").alias("b"))
    if radius == 1:
        star = star.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 1)
    return near.unionByName(star).distinct()


def roots(prints: DataFrame, radius: int = 2) -> DataFrame:
    """Different fingerprints (fp) to (fp, root): the least fingerprint reachable over links."""
    found = connected_components(links(prints, radius)).withColumnsRenamed({"node": "fp", "component": "root"})
    return prints.join(found, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 2, seed: int = 42) -> DataFrame:
    """(doc_id, fingerprint, component_id, fp_copies): the near-duplicate class of each row.

    component_id is the least doc_id reachable over links, the row's own included.
    Null and empty texts have fingerprint zero and link like others. Repeated rows come out as often as
    they go in. A null doc_id takes no part in the minimum; a class of such rows alone
    has a null component_id. An empty table gives an empty one; other columns are not looked at.
    """
    prints = materialise(add_fingerprints(docs, id_col, text_col, words, seed), "fingerprints")
    distinct = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("fp_copies")), "distinct")
    classes = distinct.join(roots(distinct.select("fp"), radius), "fp")
    least = classes.groupBy("root").agg(F.min("first_id").alias("component_id"))
    by_print = classes.join(least, "root").select("fp", "component_id", "fp_copies")
    return prints.join(by_print, "fp").select("doc_id", _hex(F.col("fp")).alias("fingerprint"), "component_id", "fp_copies")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 2, seed: int = 42) -> DataFrame:
    """The rows of docs, one of each near-duplicate class, as one_of_each chooses it."""

    def run(batches):
        for batch in batches:
            prints = [fingerprint(x.as_py(), words, seed) for x in batch.column(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(prints, pa.int64())], ["doc_id", "_text", "_row", "fp"])

    keyed = row_keys(docs, id_col, text_col)
    prints = materialise(keyed.mapInArrow(run, "doc_id long, _text long, _row long, fp long"), "fingerprints")
    classes = roots(materialise(prints.select("fp").distinct(), "distinct"), radius)
    return one_of_each(docs, prints.join(classes, "fp"), text_col)
