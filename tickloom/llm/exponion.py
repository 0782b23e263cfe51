"""Nearest centres of integer vectors by exponion search, and Lloyd rounds with exact integer means.

A centre further from a vector's present centre than twice the vector's own distance to that cannot be nearer. So each centre
keeps the others in order of distance, and a vector scans that list from its present centre outwards, as far as a ball of a
sufficient radius reaches; the radius counts itself, so that ties are seen. Distances are squared integers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def most_component(dims: int) -> int:
    """Largest magnitude of a component for which squared distances over so many dimensions fit a signed 64-bit integer."""
    return min(1 << 30, int(((1 << 63) / max(1, dims)) ** 0.5 / 2) - 1)


class Centres:
    """Centres with their squared distances to each other, and for each one all of them from near to far (equal distances: by index)."""

    def __init__(self, rows: np.ndarray):
        self.rows = np.asarray(rows, dtype=np.int64)
        self.gaps = np.array([squares(self.rows, row) for row in self.rows]).reshape(len(self.rows), len(self.rows))
        self.lists = np.argsort(self.gaps, axis=1, kind="stable")
        if len(self.rows):  # copies of a centre come after it in its own list
            self.lists = np.array([[a, *[j for j in row if j != a]] for a, row in enumerate(self.lists.tolist())])


def squares(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    gap = x - centre
    return np.einsum("ij,ij->i", gap, gap)


def _by_start(start: np.ndarray, size: int) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(start, kind="stable")
    ends = np.cumsum(np.bincount(start, minlength=size))
    for a in range(size):
        if (rows := order[ends[a - 1] if a else 0 : ends[a]]).size:
            yield a, rows


def nearest(x: np.ndarray, centres: Centres, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of each vector's nearest centre, ties to the lower index; start: the centre to begin at."""
    index, best = start.copy(), np.zeros(len(x), dtype=np.int64)
    for a, rows in _by_start(start, len(centres.rows)):
        own = squares(x[rows], centres.rows[a])
        at, least = np.full(len(rows), a), own.copy()
        for j in centres.lists[a][1:].tolist():
            seen = np.flatnonzero(centres.gaps[a, j] // 4 <= own)  # gap <= 4 * own, or less than four above it
            if not seen.size:
                break
            far = squares(x[rows[seen]], centres.rows[j])
            better = (far < least[seen]) | ((far == least[seen]) & (j < at[seen]))
            at[seen[better]], least[seen[better]] = j, far[better]
        index[rows], best[rows] = at, least
    return index, best


def _above(squared: np.ndarray) -> np.ndarray:
    """A number not below the root."""
    return np.nextafter(np.sqrt(squared.astype(np.float64)) * (1 + 1e-15), np.inf)


def _below(squared: np.ndarray) -> np.ndarray:
    return np.maximum(np.nextafter(np.sqrt(squared.astype(np.float64)) * (1 - 1e-15), -np.inf), 0)


@dataclass
class Bounds:
    """By vector: its centre, a bound above its distance to it, and one below that to any other centre."""

    index: np.ndarray
    upper: np.ndarray
    lower: np.ndarray

    def moved(self, old: np.ndarray, new: np.ndarray) -> Bounds:
        """The same after the centres moved."""
        drift = _above(np.array([squares(a[None], b)[0] for a, b in zip(old, new, strict=True)]))
        if not len(drift):
            return self
        top = int(drift.argmax())
        others = np.full(len(drift), drift[top])
        others[top] = np.delete(drift, top).max(initial=0.0)
        upper = np.nextafter(self.upper + drift[self.index], np.inf)
        lower = np.nextafter(self.lower - others[self.index], -np.inf)
        return Bounds(self.index, upper, lower)


def bounded(x: np.ndarray, centres: Centres, held: Bounds) -> Bounds:
    """Bounds with each vector's nearest centre, ties to the lower index. Vectors whose bounds show that theirs stays strictly nearest are not compared."""
    size = len(centres.rows)
    gaps = centres.gaps + 0
    np.fill_diagonal(gaps, np.iinfo(np.int64).max)
    near = gaps.min(axis=1, initial=np.iinfo(np.int64).max)
    half, reach = _below(near) / 2, _above(near)
    index, upper, lower = held.index.copy(), held.upper.copy(), held.lower.copy()
    open_ = np.flatnonzero(upper >= np.maximum(lower, half[index]))
    for a, rows in _by_start(index[open_], size):
        rows = open_[rows]
        own = squares(x[rows], centres.rows[a])
        upper[rows] = _above(own)
        still = upper[rows] >= np.maximum(lower[rows], half[a])
        rows, own = rows[still], own[still]
        radius = np.nextafter(2 * upper[rows] + reach[a], np.inf)
        at, least, second = np.full(len(rows), a), own.copy(), np.full(len(rows), np.iinfo(np.int64).max)
        for j in centres.lists[a][1:].tolist():
            seen = np.flatnonzero(_below(centres.gaps[a, j : j + 1])[0] <= radius)
            if not seen.size:
                break
            far = squares(x[rows[seen]], centres.rows[j])
            better = (far < least[seen]) | ((far == least[seen]) & (j < at[seen]))
            second[seen] = np.where(better, least[seen], np.minimum(second[seen], far))
            at[seen[better]], least[seen[better]] = j, far[better]
        index[rows], upper[rows], lower[rows] = at, _above(least), _below(second)
    return Bounds(index, upper, lower)


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Arrays of so many integers as rows of a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), dims)


def is_whole(vector: Column) -> Column:
    """The vector is there, and so are all its components, each a finite number."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))


def integers(vectors: DataFrame, scale: int, dims: int, columns: list[str]) -> DataFrame:
    """The columns, and `v`: the integers floor(scale * x) of `vector`, arrays of dims finite numbers. What lies beyond most_component is cut there."""
    limit = most_component(dims)

    def run(batches):
        for batch in batches:
            flat = batch.column("vector").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            v = np.clip(np.floor(scale * flat), -limit, limit).astype(np.int32)
            ends = pa.array(np.arange(0, len(v) + 1, dims), pa.int32())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.ListArray.from_arrays(ends, pa.array(v))], names=[*columns, "v"])

    rows = vectors.select(*columns, "vector")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "vector")
    return rows.mapInArrow(run, f"{kinds}, v array<int>")


def sums(state: DataFrame, edges: list[int]) -> DataFrame:
    """(part, entry, n, sums) of a state with `v` and `code`, an entry for each part: the parts lie between the edges. Tasks add up their own batches first."""
    dims = edges[-1]

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            v, codes, out = matrix(batch.column("v"), dims), matrix(batch.column("code"), len(edges) - 1), []
            for p, (low, high) in enumerate(zip(edges, edges[1:], strict=False)):
                order = np.argsort(codes[:, p], kind="stable")
                ordered = codes[order, p]
                first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
                added = np.add.reduceat(v[order, low:high], first, axis=0)
                counts = np.diff(np.append(first, len(ordered)))
                out += [(p, int(ordered[f]), int(n), s) for f, n, s in zip(first, counts, added.tolist(), strict=True)]
            parts, entries, counts, totals = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(entries, pa.int32()), pa.array(counts, pa.int64()), pa.array(totals, pa.list_(pa.int64()))], names=["part", "entry", "n", "sums"])

    each = state.select("v", "code").mapInArrow(run, "part int, entry int, n long, sums array<long>")
    widest = max((b - a for a, b in zip(edges, edges[1:], strict=False)), default=0)
    total = [F.sum(F.get("sums", F.lit(i)).cast("decimal(38,0)")).alias(f"s{i}") for i in range(widest)]
    return each.groupBy("part", "entry").agg(F.sum("n").alias("n"), *total)


def next_centres(state: DataFrame, edges: list[int], books: list[np.ndarray]) -> list[np.ndarray]:
    """The books after one round: each entry is the componentwise floor of its vectors' mean; entries without a vector stay. The driver gets a row an entry."""
    out = [book.copy() for book in books]
    for row in sums(state, edges).collect():
        width = edges[row.part + 1] - edges[row.part]
        out[row.part][row.entry] = [int(row[f"s{i}"]) // int(row.n) for i in range(width)]
    return out


def rounds(state: DataFrame, edges: list[int], books: list[np.ndarray], many: int, assign, scratch: Scratch) -> tuple[DataFrame, list[np.ndarray]]:
    """Assign and move `many` times, then assign once more. assign(state, old books, books) gives a state with the same columns, written here; the last one before goes."""
    old = books
    for k in range(many + 1):
        step = Scratch(state.sparkSession)
        state = step.write(assign(state, old, books), "assigned")
        scratch.drop()
        scratch.paths = step.paths
        if k < many:
            old, books = books, next_centres(state, edges, books)
    return state, books
