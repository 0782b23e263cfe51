"""Operator 8, token ids in a content-addressed store.

A rolling hash over the last ids ends a chunk wherever its value says so, so equal passages give equal chunks whatever
stands before them. `chunks` holds each different chunk once, under the digest of its ids; `recipes` holds a row for each
document, in ascending id: where its ids start, how many they are, its chunks' digests, and their
Merkle root. Both are Parquet with ids as little-endian unsigned integers of `width` bytes.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_path, running_total, shared_dir
from .tokens import Encoder, default_vocabulary, encoded

#: A chunk ends where the hash of the last WINDOW ids is 0 modulo MEAN; it has LEAST to MOST ids.
WINDOW, MEAN, LEAST, MOST = 4, 256, 32, 2048
#: Digests that a task remembers, so as not to send a chunk again.
SEEN = 200_000
DIGEST = 16


def cut(ids: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of each chunk of an id stream."""
    n = len(ids)
    rolled = np.zeros(max(0, n - WINDOW + 1), dtype=np.uint32)
    for k in range(WINDOW):
        rolled = rolled * np.uint32(0x01000193) + (ids[k : n - WINDOW + 1 + k].astype(np.uint32) + np.uint32(1)) * np.uint32(0x9E3779B1)
    marks = (np.flatnonzero((rolled >> np.uint32(12)) % MEAN == 0) + WINDOW).tolist()
    chunks, last = [], 0
    for mark in [*marks, n]:
        while mark - last > MOST:
            chunks.append((last, last + MOST))
            last += MOST
        if mark - last >= LEAST or mark == n and mark > last:
            chunks.append((last, mark))
            last = mark
    return chunks


def merkle_root(digests: bytes) -> bytes:
    """Root of the binary tree over chunk digests, an odd node moving up as it is; no chunk: the digest of nothing."""
    level = [digests[i : i + DIGEST] for i in range(0, len(digests), DIGEST)]
    if not level:
        return hashlib.blake2b(b"", digest_size=DIGEST).digest()
    while len(level) > 1:
        pairs = [hashlib.blake2b(a + b, digest_size=DIGEST).digest() for a, b in zip(level[::2], level[1::2], strict=False)]
        level = pairs + level[2 * len(pairs) :]
    return level[0]


def crc_join(first: int, second: int, second_bytes: int) -> int:
    """CRC-32 of two byte strings in a row from theirs: CRC-32 is affine, so zeros can stand for the second."""
    zeros = bytes(second_bytes)
    return zlib.crc32(zeros, first) ^ zlib.crc32(zeros) ^ second


def write_store(docs: DataFrame, path: str, end_id: int | None = 2, vocabulary: str | None = None, width: int = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode whole texts (null: empty) and write `path`/chunks and `path`/recipes.

    Texts are encoded once, into a staging folder that goes in the end; of the chunks that tasks send, sorted by digest, each is
    written once. Documents start in ascending id, null ids last, equal ids by their chunks' digests. The ids must fit `width` bytes.
    """
    spark, kind, vocabulary = docs.sparkSession, np.dtype(f"<u{width}"), vocabulary or default_vocabulary()

    def encode(batches):
        encoder, seen = Encoder(vocabulary), set()
        for batch in batches:
            rows = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoded(encoder, (x.as_py() for x in batch.column(1))), strict=True):
                if end_id is not None:
                    ids = np.append(ids, np.uint32(end_id))
                if len(ids) and int(ids.max()) >> (8 * width):
                    raise ValueError(f"an id does not fit {width} bytes")
                data, digests = ids.astype(kind).tobytes(), []
                for start, end in cut(ids):
                    chunk = data[start * width : end * width]
                    digest = hashlib.blake2b(chunk, digest_size=DIGEST).digest()
                    digests.append(digest)
                    if digest not in seen:
                        rows.append((True, None, end - start, digest, chunk))
                        seen.add(digest)
                rows.append((False, doc_id, len(ids), b"".join(digests), None))
                if len(seen) > SEEN:
                    seen.clear()
                if len(rows) > 4000:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)

    def _batch(rows):
        types = (pa.bool_(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["is_chunk", "doc_id", "n_tokens", "digests", "ids"])

    staging = f"{path}/staging"
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    staged = rows.mapInArrow(encode, "is_chunk boolean, doc_id long, n_tokens long, digests binary, ids binary")
    staged.write.option("compression", "zstd").partitionBy("is_chunk").parquet(staging)
    schema = "doc_id long, n_tokens long, digests binary, ids binary, is_chunk boolean"
    staged = spark.read.schema(schema).parquet(staging)

    def once(batches):
        last = None
        for batch in batches:
            digests = batch.column(0).to_pylist()
            new = [d != (digests[i - 1] if i else last) for i, d in enumerate(digests)]
            last = digests[-1] if digests else last
            yield batch.filter(pa.array(new, pa.bool_()))

    sent = staged.where("is_chunk").select(F.col("digests").alias("digest"), "n_tokens", "ids")
    unique = sent.repartition("digest").sortWithinPartitions("digest").mapInArrow(once, sent.schema)
    unique.write.option("compression", "zstd").parquet(f"{path}/chunks")

    @F.pandas_udf("binary")
    def root(digests):
        return digests.map(merkle_root)

    recipes = staged.where("not is_chunk").select("doc_id", "n_tokens", F.col("digests").alias("chunks"))
    placed = running_total(recipes, "doc_id", "n_tokens", "start", ["chunks"])
    placed.select("doc_id", "start", "n_tokens", "chunks", root("chunks").alias("root")).write.parquet(f"{path}/recipes")
    drop_path(spark, staging)


def read_recipes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("doc_id long, start long, n_tokens long, chunks binary, root binary").parquet(f"{path}/recipes")


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("digest binary, n_tokens long, ids binary").parquet(f"{path}/chunks")


def _uses(recipes: DataFrame) -> DataFrame:
    """(row, start, doc_id, root, n_tokens, at, digest): a row for each chunk of each document, none shared by two documents."""
    whole = F.expr(f"transform(sequence(0, cast(length(chunks) / {DIGEST} as int) - 1), i -> substring(chunks, i * {DIGEST} + 1, {DIGEST}))")
    some = F.when(F.length("chunks") > 0, whole)
    numbered = recipes.withColumn("row", F.monotonically_increasing_id())  # before the rows are parted
    return numbered.select("row", "start", "doc_id", "root", "n_tokens", F.posexplode_outer(some).alias("at", "digest"))


def read_ids(spark: SparkSession, path: str, width: int = 2) -> DataFrame:
    """(doc_id, start, ids array<long>): the documents' ids put together again from chunks."""
    chunks, kind = read_chunks(spark, path).select("digest", "ids"), np.dtype(f"<u{width}")
    joined = _uses(read_recipes(spark, path)).join(chunks, "digest", "left").groupBy("row", "start", "doc_id", "root", "n_tokens").agg(F.array_sort(F.collect_list(F.struct("at", "ids"))).alias("parts"))

    @F.pandas_udf("array<long>")
    def put(parts):
        return parts.map(lambda p: np.frombuffer(b"".join(x["ids"] or b"" for x in p), dtype=kind).astype(np.int64))

    return joined.select("doc_id", "start", put("parts").alias("ids"))


def verify(spark: SparkSession, path: str, width: int = 2) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, verified) of each document, from the files.

    Every stored chunk is read: its digest is computed again, and the CRC-32 of its ids as 4-byte integers. A document's CRC follows from
    its chunks', so that no ids are sent to it. verified: all its chunks are there, have the digests they are stored under and the right
    number of ids, and the Merkle root over the digests is the recipe's.
    """
    kind = np.dtype(f"<u{width}")

    def digest(batches):
        for batch in batches:
            data = batch.column(1).to_pylist()
            found = [hashlib.blake2b(x, digest_size=DIGEST).digest() for x in data]
            crcs = [zlib.crc32(np.frombuffer(x, dtype=kind).astype("<u4").tobytes()) for x in data]
            arrays = [batch.column(0), pa.array(found, pa.binary()), pa.array([len(x) // width for x in data], pa.int64()), pa.array(crcs, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["digest", "found", "n", "crc"])

    chunks = read_chunks(spark, path).select("digest", "ids").mapInArrow(digest, "digest binary, found binary, n long, crc long")
    good = chunks.where("digest = found").select("digest", "n", "crc")
    parts = F.array_sort(F.collect_list(F.struct("at", "digest", "n", "crc"))).alias("parts")
    joined = _uses(read_recipes(spark, path)).join(good, "digest", "left").groupBy("row", "start", "doc_id", "root", "n_tokens").agg(parts)

    def put(batches):
        for batch in batches:
            rows = []
            for x in batch.to_pylist():
                there = [p for p in x["parts"] if p["digest"] is not None]
                crc, total, whole = 0, 0, all(p["n"] is not None for p in there)
                for p in there if whole else ():
                    crc, total = crc_join(crc, p["crc"], 4 * p["n"]), total + p["n"]
                right = whole and total == x["n_tokens"] and merkle_root(b"".join(p["digest"] for p in there)) == x["root"]
                rows.append((x["doc_id"], x["start"], x["n_tokens"], crc if whole else None, right))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32", "verified"])

    return joined.mapInArrow(put, "doc_id long, start long, n_tokens long, ids_crc32 long, verified boolean")


def write_and_verify(docs: DataFrame, path: str | None = None, **kw) -> DataFrame:
    """Write a store (by default into a new folder of the shared one) and return `verify` of it.

    Null texts have the end id alone; repeated rows share their chunks and have a recipe each; an empty table gives an empty store
    and no row; other columns are not looked at.
    """
    path = path or f"{shared_dir(docs.sparkSession)}/store-{uuid.uuid4().hex}"
    write_store(docs, path, **kw)
    return verify(docs.sparkSession, path, kw.get("width", 2))
