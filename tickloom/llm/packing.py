"""Operator 6, best-fit-decreasing packing of documents into sequences.

Each piece goes, longest first, into the open sequence with the least room that holds it; a segment
tree over the remaining capacities finds that room in logarithmic time. Pieces of one length are alike, and after a
piece has gone into the tightest sequence, that sequence stays the tightest as long as another fits. So
all sequences with equal room are served as one group, and the whole packing follows from the number of pieces of
each length: at most `capacity` counts reach the driver, however many documents there are. The plan says which
sequences the k-th piece of a length goes to, and every piece is given its k on the executors.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import hash_cell, materialise
from .tokens import Encoder, default_vocabulary, encoded

#: Pieces a cell; the pieces of one length are dealt to so many cells and ranked cell by cell.
RANKED_AT_ONCE = 10_000


class SegmentTree:
    """Numbers of open sequences by remaining capacity 0..capacity."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.sums = [0] * (2 * self.leaves)

    def add(self, room: int, n: int) -> None:
        at = self.leaves + room
        while at:
            self.sums[at] += n
            at >>= 1

    def tightest(self, size: int) -> int | None:
        """The least remaining capacity of at least `size` that an open sequence has."""
        at = self.leaves + size
        if self.sums[at]:
            return size
        while at > 1:
            if not at & 1 and self.sums[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at + (not self.sums[2 * at])
                return at - self.leaves
            at >>= 1
        return None


class Plan(NamedTuple):
    """Row i: pieces of `length` with ranks from `rank` on go, `each` to a sequence, to sequences from `sequence` on, at `offset`."""

    length: np.ndarray
    rank: np.ndarray
    sequence: np.ndarray
    each: np.ndarray
    offset: np.ndarray
    sequences: int


def plan_packing(counts: dict[int, int], capacity: int) -> Plan:
    """Best fit decreasing over pieces given as {length: number}."""
    tree, open_at, made, rows = SegmentTree(capacity), defaultdict(list), 0, []
    for size in sorted(counts, reverse=True):
        left, rank = counts[size], 0
        while left:
            room = tree.tightest(size)
            if room is None:
                room, first, there = capacity, made, -(-left // (capacity // size))
                made += there
            else:
                first, there = open_at[room].pop()
                tree.add(room, -there)
            each = min(room // size, left)
            used = min(there, left // each)
            rows.append((size, rank, first, each, capacity - room))
            for rest, start, n in ((room - each * size, first, used), (room, first + used, there - used)):
                if n and rest:
                    open_at[rest].append((start, n))
                    tree.add(rest, n)
            rank += used * each
            left -= used * each
    return Plan(*np.array(sorted(rows), dtype=np.int64).reshape(-1, 5).T, made)


_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_pieces(docs: DataFrame, vocabulary: str, capacity: int, end_id: int | None, id_col: str, text_col: str, keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, and ids if asked for): what each document is packed as. A document without any id gives no piece."""

    def run(batches):
        encoder = Encoder(vocabulary)
        for batch in batches:
            rows = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoded(encoder, (x.as_py() for x in batch.column(1))), strict=True):
                if end_id is not None:
                    ids = np.append(ids, np.uint32(end_id))
                data = ids.astype("<u4")
                for piece, at in enumerate(range(0, len(data), capacity)):
                    part = data[at : at + capacity]
                    row = (doc_id, piece, at, len(part), zlib.crc32(part.tobytes()))
                    rows.append((*row, part.astype(np.int32)) if keep_ids else row)
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())][: 5 + keep_ids]
            columns = zip(*rows, strict=True) if rows else [[]] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + keep_ids])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, _PIECE + (", ids array<int>" if keep_ids else ""))


def pack(docs: DataFrame, capacity: int = 4096, end_id: int | None = 1, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): where each piece lies; sequences are 0, 1, ... without gaps inside. With keep_ids each piece's token ids come too.

    Null texts count as empty: their end id is packed. Documents over the capacity are cut into full pieces and a rest.
    Repeated rows are packed as often as they come; an empty table gives an empty one; other columns are not looked at.
    """
    pieces = materialise(cut_pieces(docs, vocabulary or default_vocabulary(), capacity, end_id, id_col, text_col, keep_ids), "pieces")
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # one row a length
    plan = plan_packing(counts, capacity)
    cells = max(1, sum(counts.values()) // RANKED_AT_ONCE)
    dealt = pieces.withColumn("cell", hash_cell(F.col("doc_id"), "pack", cells))
    before = dealt.groupBy("length", "cell").agg(F.count("*").alias("n"))
    before = before.select("length", "cell", (F.sum("n").over(Window.partitionBy("length").orderBy("cell")) - F.col("n")).alias("before"))
    in_cell = Window.partitionBy("length", "cell").orderBy("doc_id", "piece", "ids_crc32")
    ranked = dealt.withColumn("in_cell", F.row_number().over(in_cell)).join(before, ["length", "cell"])
    own = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else [])]
    ranked = ranked.select(*own, (F.col("before") + F.col("in_cell") - 1).alias("rank"))

    def place(batches):
        keys = plan.length * (1 << 48) + plan.rank
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(len(own)).to_numpy()
            at = np.searchsorted(keys, length * (1 << 48) + rank, side="right") - 1
            within = rank - plan.rank[at]
            sequence, offset = plan.sequence[at] + within // plan.each[at], plan.offset[at] + within % plan.each[at] * length
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(own)], pa.array(sequence), pa.array(offset)], [*own, "sequence_id", "offset"])

    return ranked.mapInArrow(place, _PIECE + (", ids array<int>" if keep_ids else "") + ", sequence_id long, offset long")


def sequences(docs: DataFrame, capacity: int = 4096, **kw) -> DataFrame:
    """(sequence_id, length, ids, doc_ids): the packed sequences themselves. A group has at most `capacity` ids."""
    packed = pack(docs, capacity, keep_ids=True, **kw)
    held = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids", "doc_id"))).alias("p"))
    ids = F.flatten(F.transform("p", lambda x: x["ids"]))
    return held.select("sequence_id", F.size(ids).alias("length"), ids.alias("ids"), F.transform("p", lambda x: x["doc_id"]).alias("doc_ids"))
