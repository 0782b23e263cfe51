"""Operator 3, a Katz backoff language model over words.

Counts up to 5 are discounted by Good-Turing; a context's discounted mass, and `NOVEL` of an observation, so that no context
is without any, goes to the words it was not seen with, in proportion to their unigram probabilities:

    P(w | u) = d(c(u w)) c(u w) / (c(u) + NOVEL)   if c(u w) > 0
             = alpha(u) P(w)                       else, with alpha(u) such that the sum over all w is 1
    P(w)     = d'(c(w)) c(w) / N                   if c(w) > 0; what is left is the probability of the unknown word.

A context without a count backs off with weight 1. Words are XXH64 values throughout.

The work goes in rounds over tables partitioned by word or context:

1. Word counts. The most frequent words, at most a fixed number, are known to every later task by rank, with their counts.
2. Every task turns its documents into blocks. A block's word pairs, each with the rows that have it, go to the table part that
   counts the pair: that of the pair if the word has a rank, else that of the word. So no part depends on a
   frequent word. Pairs of two of the few hundred most frequent words send counts alone; their rows wait in the block.
3. A part adds up its pairs' counts and sends rows their share of the score, contexts their counts of counts, and, for pairs not seen, asks
   for the context's backoff weight.
4. Contexts' weights are computed where their counts meet and answered to the blocks; those of ranked contexts are broadcast.
5. A block adds up what its rows got.
"""

from __future__ import annotations

import math
import pickle
import zlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_memory_back, let_go, materialise
from .repeats import configured
from .tokens import different

DISCOUNTED = 5
NOVEL = 0.1
DICTIONARY, HOT = 60_000, 256
#: Tokens of a block, and of a table part, about; a part is counted in so many slices, one after the other.
BLOCK_TOKENS, PART_TOKENS, SLICES = 500_000, 4_000_000, 12
_NONE = np.uint16(65535)
_START, _END = (np.uint64(xxhash.xxh64_intdigest(x, 1)) for x in (b"\x00 start", b"\x00 end"))
_HELD, _ROW = np.uint32(1 << 31), np.uint32((1 << 31) - 1)
_COUNTED = _ROW  # stands for all training rows of a block


def discounts(counts_of_counts: list[int]) -> np.ndarray:
    """d(r) for r = 1..DISCOUNTED from the numbers of things seen 1..DISCOUNTED + 1 times.

    Where these are too few for Good-Turing (a discount outside 0..1), absolute discounting by n1 / (n1 + 2 n2) stands in.
    """
    n = [0, *counts_of_counts]
    k = DISCOUNTED
    if all(n[1 : k + 2]):
        far = (k + 1) * n[k + 1] / n[1]
        found = np.array([((r + 1) * n[r + 1] / (n[r] * r) - far) / (1 - far) if far < 1 else -1 for r in range(1, k + 1)])
        if ((found > 0) & (found < 1)).all():
            return found
    less = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
    return np.array([(r - less) / r for r in range(1, k + 1)])


class Unigrams(NamedTuple):
    """What every task knows: N, V, discounts, the unknown word's probability, and the ranked words in the order of their hashes."""

    tokens: int
    distinct: int
    discount: np.ndarray
    unknown: float
    scale: float
    keys: np.ndarray
    counts: np.ndarray
    hot: np.ndarray  # number among the hot words, or -1
    hot_words: int

    def ranks(self, words: np.ndarray) -> np.ndarray:
        """Places in keys, 65535 where there is none."""
        if not len(self.keys):
            return np.full(len(words), _NONE)
        at = np.minimum(np.searchsorted(self.keys, words), len(self.keys) - 1)
        return np.where(self.keys[at] == words, at, _NONE).astype(np.uint16)

    def log_p(self, counts: np.ndarray) -> np.ndarray:
        """log10 P(w) of words seen so often."""
        if not self.tokens:
            return np.zeros(len(counts))
        small = np.concatenate([[0.0], self.discount])[np.minimum(counts, DISCOUNTED)]
        p = np.where(counts > DISCOUNTED, counts, small * counts) / self.tokens * self.scale
        return np.log10(np.where(counts > 0, p, self.unknown))


#: Bytes of texts whose words are hashed together, about.
HASHED = 1 << 20


def token_hashes(texts: Iterable[str | None], uni: Unigrams | None = None) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
    """For each text, XXH64 of the words, A-Z lower-cased, without the end, and their ranks. A word is hashed once for several texts."""

    def together(held):
        words, at, counts = different(held)
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))
        ranks = uni.ranks(hashes)[at] if uni else None
        hashes, edges = hashes[at], np.append(0, np.cumsum(counts)).tolist()
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            yield hashes[a:b], ranks[a:b] if uni else None

    held, size = [], 0
    for text in texts:
        held.append((text or "").encode("utf-8", "replace").lower())
        size += len(held[-1])
        if size >= HASHED:
            yield from together(held)
            held, size = [], 0
    yield from together(held)


def _held_out(doc_id: int | None, folds: int, fold: int) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % folds == fold


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def count_words(docs: DataFrame, folds: int, fold: int, block_tokens: int) -> DataFrame:
    """(w, c): the training words' hashes and counts, the end included."""

    def run(batches):
        give_memory_back()
        held, size = [], 0
        for batch in batches:
            learned = (text.as_py() for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) if not _held_out(doc_id, folds, fold))
            for found, _ in token_hashes(learned):
                held += [found, np.array([_END])]
                size += len(found) + 1
                if size >= block_tokens:
                    yield _counted(held)
                    held, size = [], 0
        if held:
            yield _counted(held)

    def _counted(held):
        words, counts = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(counts)], ["w", "c"])

    return docs.mapInArrow(run, "w long, c long").groupBy("w").agg(F.sum("c").alias("c"))


def summarise(words: DataFrame, dictionary: int, hot_words: int) -> Unigrams:
    """From the word table: sums, and its most frequent words, at most `dictionary`."""
    k = DISCOUNTED
    row = words.agg(F.count("*"), F.coalesce(F.sum("c"), F.lit(0)), *[F.count_if(F.col("c") == r) for r in range(1, k + 2)]).first()
    distinct, tokens, of_counts = row[0], row[1], list(row[2:])
    top = words.orderBy(F.desc("c"), "w").limit(dictionary).toPandas()  # bounded
    keys, counts = top["w"].to_numpy(dtype=np.int64).view(np.uint64), top["c"].to_numpy(dtype=np.int64)
    hot = np.where(np.arange(len(keys)) < hot_words - 1, np.arange(len(keys)), -1)
    docs = int(counts[keys == _END].sum())
    keys, counts, hot = np.append(keys, _START), np.append(counts, docs), np.append(hot, min(hot_words - 1, len(hot)))
    order = np.argsort(keys)
    d = discounts(of_counts)
    left = sum((1 - d[r - 1]) * r * of_counts[r - 1] for r in range(1, k + 1)) / tokens if tokens else 1.0
    scale = 1.0 if left > 0 else tokens / (tokens + 1)
    return Unigrams(tokens, distinct, d, left if left > 0 else 1 / (tokens + 1), scale, keys[order], counts[order], hot[order], hot_words)


def _cells(pairs_from: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places of runs of `sizes` that start at `pairs_from`, one after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(pairs_from - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


def _runs(*sorted_columns: np.ndarray) -> np.ndarray:
    """Where runs of equal rows start."""
    new = np.ones(len(sorted_columns[0]), dtype=bool)
    if len(new):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in sorted_columns])
    return np.flatnonzero(new)


def _narrow(x: np.ndarray) -> np.ndarray:
    """Whole numbers from 0 on in the fewest bytes that hold the largest."""
    return x.astype(np.min_scalar_type(int(x.max()) if len(x) else 0))


def _by_part(part: np.ndarray, parts: int, mixed: np.ndarray) -> np.ndarray:
    """The order of rows by part and hash, rows that share both as they come. The hash is shortened to what a 64-bit integer has left, so that rows of two hashes may alternate: that parts runs, and mixes none."""
    bits, places = np.uint64(parts.bit_length()), np.uint64((1 << len(part).bit_length()) - 1)
    key = (part << (np.uint64(64) - bits)) | (mixed >> bits)
    return (np.sort((key & ~places) | np.arange(len(part), dtype=np.uint64)) & places).astype(np.int64)


def _send(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.string(), pa.int64(), pa.int64(), pa.binary())
    columns = zip(*rows, strict=True) if rows else [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["kind", "key", "block", "data"])


def _added(several: list[tuple]) -> tuple:
    """Columns of (row, value, ...) tuples added up by row."""
    rows, inverse = np.unique(np.concatenate([x[0] for x in several]), return_inverse=True)
    sums = [np.bincount(inverse, np.concatenate(c), minlength=len(rows)) for c in list(zip(*several, strict=True))[1:]]
    return (rows, *[s if i < 2 else s.astype(np.uint32) for i, s in enumerate(sums)])


_MESSAGE = "kind string, key long, block long, data binary"


def make_blocks(docs: DataFrame, uni: Unigrams, parts: int, folds: int, fold: int, block_tokens: int) -> DataFrame:
    """Messages to table parts: (kind, key: part, block, data)."""

    def flush(block, ids, lengths, hashes, ranks):
        lengths = np.array(lengths)
        row = np.repeat(np.arange(len(ids), dtype=np.uint32), lengths + 1)
        ends = np.cumsum(lengths + 1) - 1
        w, u, rank_w, rank_u = (np.empty(len(row), t) for t in (np.uint64, np.uint64, np.uint16, np.uint16))
        inner = np.ones(len(row), dtype=bool)
        inner[ends] = False
        (end, start), firsts = uni.ranks(np.array([_END, _START])), ends - lengths
        w[inner], w[ends], rank_w[inner], rank_w[ends] = np.concatenate(hashes), _END, np.concatenate(ranks), end
        u[1:], u[firsts], rank_u[1:], rank_u[firsts] = w[:-1], _START, rank_w[:-1], start
        held = np.array([_held_out(i, folds, fold) for i in ids])
        known, known_u = rank_w != _NONE, rank_u != _NONE
        counts = uni.counts[rank_w[known]] if len(uni.counts) else np.zeros(0)
        base = np.bincount(row[known], np.log10(counts + 1.0), minlength=len(ids)).astype(float)
        n_known = np.bincount(row[known], counts > 0, minlength=len(ids)).astype(np.int64)
        score = -np.bincount(row[known_u], np.log10(np.where(uni.counts[rank_u[known_u]] > 0, uni.counts[rank_u[known_u]] + NOVEL, 1.0)), minlength=len(ids)).astype(float)
        tagged = row | np.where(held[row], _HELD, np.uint32(0))
        mixed = _mix(w ^ _mix(u))
        part = np.where(known, mixed, _mix(w)) % np.uint64(parts * SLICES)
        order = _by_part(part, parts * SLICES, mixed)
        w, u, tagged, rank_w, rank_u, part = w[order], u[order], tagged[order], rank_w[order], rank_u[order], part[order]
        cell = _runs(w, u, tagged)
        tf = np.diff(np.append(cell, len(w))).astype(np.uint32)
        pair_at = _runs(w[cell], u[cell])
        tagged, pairs = tagged[cell], cell[pair_at]
        w, u, rank_w, rank_u, part = w[pairs], u[pairs], rank_w[pairs], rank_u[pairs], part[pairs].astype(np.int64)
        n = np.diff(np.append(pair_at, len(cell)))
        hot_w, hot_u = (np.where(r != _NONE, uni.hot[np.minimum(r, len(uni.hot) - 1)], -1) for r in (rank_w, rank_u))
        hot = (hot_w >= 0) & (hot_u >= 0)
        at = _cells(pair_at[hot], n[hot])
        pair = np.repeat((hot_w[hot] * uni.hot_words + hot_u[hot]).astype(np.uint16), n[hot])
        yield "info", block % parts, block, pickle.dumps((ids, held, lengths + 1, n_known, base, score, pair, _narrow(tagged[at] & _ROW), _narrow(tf[at])), protocol=5)
        trained = np.add.reduceat(np.where(tagged & _HELD, 0, tf), pair_at) if len(pair_at) else np.zeros(0)
        coded = ((tagged & _ROW) << np.uint32(1) | tagged >> np.uint32(31)) + np.uint32(1)  # of a row and whether it is held out; 0: all training rows
        edges = np.append(_runs(part), len(part))
        for start, end in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            k, only = int(part[start]), hot[start:end]
            cold, counted = start + np.flatnonzero(~only), start + np.flatnonzero(only)
            at = _cells(pair_at[cold], n[cold])
            both = np.concatenate([cold, counted])
            rows_ = np.concatenate([coded[at], np.zeros(len(counted), np.uint32)])
            times = np.concatenate([tf[at], trained[counted].astype(np.uint32)])
            sizes = np.concatenate([n[cold], np.ones(len(counted), np.int64)]).astype(np.uint32)
            rw, ru = rank_w[both], rank_u[both]
            yield f"pairs {k % SLICES}", k // SLICES, block, pickle.dumps((rw, w[both][rw == _NONE], ru, u[both][ru == _NONE], *map(_narrow, (sizes, rows_, times))), protocol=5)

    def run(batches):
        give_memory_back()
        task, made = TaskContext.get().partitionId(), 0
        ids, lengths, hashes, ranks, size = [], [], [], [], 0
        for batch in batches:
            for doc_id, (found, rank) in zip(batch.column(0).to_pylist(), token_hashes((x.as_py() for x in batch.column(1)), uni), strict=True):
                ids.append(doc_id)
                lengths.append(len(found))
                hashes.append(found)
                ranks.append(rank)
                size += len(found) + 1
                if size >= block_tokens:
                    for message in flush((task << 24) + made, ids, lengths, hashes, ranks):
                        yield _send([message])
                    ids, lengths, hashes, ranks, size, made = [], [], [], [], 0, made + 1
        if ids:
            for message in flush((task << 24) + made, ids, lengths, hashes, ranks):
                yield _send([message])

    return docs.mapInArrow(run, _MESSAGE)


def _spell(ranks: np.ndarray, others: np.ndarray, uni: Unigrams) -> np.ndarray:
    out = np.empty(len(ranks), np.uint64)
    there = ranks != _NONE
    out[there], out[~there] = uni.keys[ranks[there]], others
    return out


def count_pairs(messages: DataFrame, uni: Unigrams, parts: int) -> DataFrame:
    """Step 3: from pairs to messages `row` and `ask` (key: block), `context` and `ask_context` (key: part), `hot` and `tally`.

    A part's slices come one after the other, and what a slice gives leaves before the next one is counted; the rows' sums alone stay until the part ends.
    """

    def run(batches):
        give_memory_back()
        part, slice_, held, rows = None, None, [], {}
        for batch in batches:
            for kind, key, block, data in zip(*(batch.column(c).to_pylist() for c in ("kind", "key", "block")), batch.column("data"), strict=True):
                if (key, kind) != (part, slice_):
                    yield from count_slice(held, rows)
                    held = []
                    if key != part:
                        yield from sent_rows(rows)
                    part, slice_ = key, kind
                if kind == "info":
                    yield _send([("info", block, block, data.as_py())])
                else:
                    held.append((block, data))
        yield from count_slice(held, rows)
        held = []
        yield from sent_rows(rows)

    def sent_rows(rows):
        """What rows get, each block's sums dropped as they leave."""
        while rows:
            block, sums = rows.popitem()
            yield _send([("row", block, block, pickle.dumps((*sums[:3], *map(_narrow, sums[3:])), protocol=5))])

    def count_slice(held, rows):
        """A slice's messages; what rows get is added to `rows`."""
        if not held:
            return
        columns, blocks, out = [], [], []
        for block, data in held:
            rw, wx, ru, ux, sizes, cells, times = pickle.loads(data.as_buffer())
            cells = cells.astype(np.uint32) - np.uint32(1)  # 0 wraps to all ones
            cells = np.where(cells == ~np.uint32(0), _COUNTED, cells >> np.uint32(1) | cells << np.uint32(31))
            columns.append((_spell(rw, wx, uni), _spell(ru, ux, uni), rw, ru, sizes, cells, times))
            blocks.append(block)
        counts = [len(c[0]) for c in columns]
        columns = [np.concatenate(c) for c in zip(*columns, strict=True)]
        for kind, key, block, data in score_part(columns, np.repeat(np.arange(len(blocks), dtype=np.int64), counts), blocks):
            if kind == "row":
                rows[block] = _added([rows[block], data]) if block in rows else data
            else:
                out.append((kind, key, block, data))
        yield _send(out)

    def score_part(columns, pair_block, blocks):
        w, u, rank_w, rank_u, sizes, rows, times = columns
        starts = np.cumsum(sizes, dtype=np.int64) - sizes
        held = (rows & _HELD) != 0
        trained = np.add.reduceat(np.where(held, 0, times).astype(np.int64), starts)
        order = np.argsort(u)
        order = order[np.argsort(w[order], kind="stable")]
        first = _runs(w[order], u[order])
        group = np.empty(len(w), np.int64)
        group[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(w))))
        r_of = np.bincount(group, trained, minlength=len(first)).astype(np.int64)
        lead = order[first]
        gw, gu, grw, gru = w[lead], u[lead], rank_w[lead], rank_u[lead]
        word_first = _runs(gw)
        sums = np.add.reduceat(r_of, word_first)
        c_of = np.repeat(sums, np.diff(np.append(word_first, len(gw))))
        ranked = grw != _NONE
        c_of[ranked] = uni.counts[grw[ranked]]
        log_p = uni.log_p(c_of)
        out = [("tally", 0, 0, pickle.dumps([int((r_of == r).sum()) for r in range(1, DISCOUNTED + 2)]))]
        seen_group = r_of > 0
        hot_w, hot_u = (np.where(x != _NONE, uni.hot[np.minimum(x, len(uni.hot) - 1)], -1) for x in (grw, gru))
        hot = (hot_w >= 0) & (hot_u >= 0) & seen_group
        if hot.any():
            out.append(("hot", 0, 0, pickle.dumps(((hot_w[hot] * uni.hot_words + hot_u[hot]).astype(np.int64), r_of[hot]), protocol=5)))
        # what contexts get
        by_u = np.argsort(gu[seen_group], kind="stable")
        su, sr, sp = gu[seen_group][by_u], r_of[seen_group][by_u], 10.0 ** log_p[seen_group][by_u]
        at = _runs(su)
        if len(at):
            classes = [np.add.reduceat((sr == r).astype(np.int64), at).astype(np.uint32) for r in range(1, DISCOUNTED + 1)]
            heads, ranks, share = su[at], gru[seen_group][by_u][at], np.add.reduceat(sp, at)
            target = (_mix(heads) % np.uint64(parts)).astype(np.int64)
            for k in np.unique(target).tolist():
                mine, others = (np.flatnonzero((target == k) & x) for x in (ranks != _NONE, ranks == _NONE))
                both = np.concatenate([mine, others])  # ranks ascend as hashes do: their steps are small
                out.append(("context", k, 0, pickle.dumps((_narrow(np.diff(ranks[mine], prepend=np.uint16(0))), heads[others], [_narrow(c[both]) for c in classes], share[both]), protocol=5)))
        # what rows get
        cell_pair = np.repeat(np.arange(len(w)), sizes)
        real = rows != _COUNTED
        cell_pair, row, tf = cell_pair[real], rows[real] & _ROW, times[real].astype(np.int64)
        g, block = group[cell_pair], pair_block[cell_pair]
        key = (block << 32) | row
        uniq, inverse = np.unique(key, return_inverse=True)
        r, rare = r_of[g], grw[g] == _NONE
        seen, c = r > 0, c_of[g]
        gain = np.where(seen, np.log10(np.maximum(r, 1)), log_p[g]) - np.where(rare & (c > 0), np.log10(c + NOVEL), 0.0)
        score = np.bincount(inverse, gain * tf, minlength=len(uniq))
        base = np.bincount(inverse[rare], (np.log10(c + 1.0) * tf)[rare], minlength=len(uniq))
        known = np.bincount(inverse[rare], (tf * (c > 0))[rare], minlength=len(uniq)).astype(np.uint32)
        few = [np.bincount(inverse[r == k], tf[r == k], minlength=len(uniq)).astype(np.uint32) for k in range(1, DISCOUNTED + 1)]
        edges = np.searchsorted(uniq >> 32, np.arange(len(blocks) + 1))
        for i, name in enumerate(blocks):
            cut = slice(edges[i], edges[i + 1])
            if edges[i + 1] > edges[i]:
                out.append(("row", name, name, ((uniq[cut] & 0xFFFFFFFF).astype(np.uint32), score[cut], base[cut], known[cut], *[f[cut] for f in few])))
        # what is asked of contexts
        ask = ~seen
        aru, au, ablock, arow, atf = gru[g][ask], gu[g][ask], block[ask], row[ask], tf[ask].astype(np.uint32)
        for i, name in enumerate(blocks):
            mine = (ablock == i) & (aru != _NONE)
            if mine.any():
                out.append(("ask", name, name, pickle.dumps((aru[mine], _narrow(arow[mine]), _narrow(atf[mine])), protocol=5)))
        rare = aru == _NONE
        target = (_mix(au) % np.uint64(parts)).astype(np.int64)
        names = np.array(blocks, dtype=np.int64)
        for k in np.unique(target[rare]).tolist():
            mine = rare & (target == k)
            out.append(("ask_context", k, 0, pickle.dumps((au[mine], names[ablock[mine]], _narrow(arow[mine]), _narrow(atf[mine])), protocol=5)))
        return out

    return messages.repartition("key").sortWithinPartitions("key", "kind", "block").mapInArrow(run, _MESSAGE)


def weigh_contexts(messages: DataFrame, uni: Unigrams, d: np.ndarray) -> DataFrame:
    """Step 4: `answer` (key: block) and `weight` messages. A weight is log10 of alpha(u) (c(u) + NOVEL): rows have been charged the latter for every token."""

    def run(table: pa.Table) -> pa.Table:
        give_memory_back()
        contexts, asks = [], []
        for kind, data in zip(table.column("kind").to_pylist(), table.column("data"), strict=True):
            message = pickle.loads(data.as_py())
            if kind == "context":
                steps, others, classes, share = message
                contexts.append((np.concatenate([uni.keys[np.cumsum(steps, dtype=np.int64)], others]), classes, share))
            else:
                asks.append(message)
        out, heads, weight = [], np.zeros(0, np.uint64), np.zeros(0)
        if contexts:
            u = np.concatenate([c[0] for c in contexts])
            left = sum((1 - d[r]) * (r + 1) * np.concatenate([c[1][r] for c in contexts]) for r in range(DISCOUNTED))
            share = np.concatenate([c[2] for c in contexts])
            heads, inverse = np.unique(u, return_inverse=True)
            left, share = (np.bincount(inverse, x, minlength=len(heads)) for x in (left, share))
            weight = np.log10((left + NOVEL) / np.maximum(1 - share, 1e-300))
            rank = uni.ranks(heads)
            if (rank != _NONE).any():
                out.append(("weight", 0, 0, pickle.dumps((rank[rank != _NONE], weight[rank != _NONE]), protocol=5)))
        if asks:
            u, block, row, tf = (np.concatenate(c) for c in zip(*asks, strict=True))
            value = np.zeros(len(u))
            if len(heads):
                at = np.minimum(np.searchsorted(heads, u), len(heads) - 1)
                value = np.where(heads[at] == u, weight[at], 0.0) * tf
            order = np.argsort(block, kind="stable")
            edges = np.append(_runs(block[order]), len(order))
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                name = int(block[order[a]])
                out.append(("answer", name, name, pickle.dumps((row[order[a:b]], value[order[a:b]]), protocol=5)))
        return pa.Table.from_batches([_send(out)])

    return messages.groupBy("key").applyInArrow(run, _MESSAGE)


_RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def finish(messages: DataFrame, uni: Unigrams, d: np.ndarray, weights: np.ndarray, pair_counts: np.ndarray) -> DataFrame:
    """Step 5: the rows of each block."""
    names = [x.split()[0] for x in _RESULT.split(", ")]
    by_hot = np.zeros(uni.hot_words, np.int64)
    for rank in np.flatnonzero(uni.hot >= 0):
        by_hot[uni.hot[rank]] = rank

    def run(table: pa.Table) -> pa.Table:
        give_memory_back()
        by_kind: dict[str, list] = {}
        for kind, data in zip(table.column("kind").to_pylist(), table.column("data"), strict=True):
            by_kind.setdefault(kind, []).append(pickle.loads(data.as_py()))
        ids, held, n, known, base, score, pair, row, tf = by_kind["info"][0]
        few = np.zeros((DISCOUNTED, len(ids)))
        for at, gain, more, words, *classes in by_kind.get("row", []):
            score[at] += gain
            base[at] += more
            known[at] += words
            for r in range(DISCOUNTED):
                few[r][at] += classes[r]
        if len(pair):
            r = pair_counts[pair]
            w, u = by_hot[pair // uni.hot_words], by_hot[pair % uni.hot_words]
            gain = np.where(r > 0, np.log10(np.maximum(r, 1)), uni.log_p(uni.counts[w]) + weights[u])
            score += np.bincount(row, gain * tf, minlength=len(ids))
            for k in range(DISCOUNTED):
                few[k] += np.bincount(row, (r == k + 1) * tf, minlength=len(ids))
        for ranks, row, tf in by_kind.get("ask", []):
            score += np.bincount(row, weights[ranks] * tf, minlength=len(ids))
        for row, value in by_kind.get("answer", []):
            score += np.bincount(row, value, minlength=len(ids))
        score += np.log10(d) @ few
        base -= n * math.log10(uni.tokens + uni.distinct + 1)
        columns = [pa.array(ids, pa.int64()), pa.array(held), pa.array(n), pa.array(known), pa.array(np.full(len(ids), uni.tokens)), pa.array(base), pa.array(score)]
        return pa.Table.from_arrays(columns, names)

    return messages.groupBy("key").applyInArrow(run, _RESULT)


def score(docs: DataFrame, folds: int = 7, fold: int = 2, id_col: str = "doc_id", text_col: str = "text", dictionary: int = DICTIONARY, hot_words: int = HOT, block_tokens: int = BLOCK_TOKENS, part_tokens: int = PART_TOKENS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row; rows of the held-out fold are not learned from.

    Null and empty texts have the end alone. A null id's text is empty for the fold. Repeated rows are learned from and scored each; an
    empty table gives an empty one; other columns are not looked at. If no row is learned from, all scores are those of unknown words, 0.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    with configured(docs.sparkSession):  # what is shuffled goes once what comes of it is written
        uni = summarise(materialise(count_words(rows, folds, fold, block_tokens), "words"), dictionary, hot_words)
        parts = max(4, -(-uni.tokens // part_tokens))
        found = materialise(count_pairs(make_blocks(rows, uni, parts, folds, fold, block_tokens), uni, parts), "pairs", "zstd")
    let_go(docs.sparkSession)
    of_kind = lambda *kinds: found.where(F.col("kind").isin(*kinds))
    tallies = [pickle.loads(r[0]) for r in of_kind("tally").select("data").collect()]  # a few numbers a part
    d = discounts([sum(x) for x in zip(*tallies, strict=True)] or [0] * (DISCOUNTED + 1))
    pair_counts = np.zeros(hot_words * hot_words, np.int64)
    for r in of_kind("hot").select("data").toLocalIterator():  # at most hot_words squared pairs in all
        pairs, counts = pickle.loads(r[0])
        pair_counts[pairs] = counts
    answers = materialise(weigh_contexts(of_kind("context", "ask_context"), uni, d), "weights", "zstd")
    weights = np.zeros(len(uni.keys))
    for r in answers.where("kind = 'weight'").select("data").toLocalIterator():  # at most `dictionary` in all
        ranks, values = pickle.loads(r[0])
        weights[ranks] = values
    return finish(of_kind("info", "row", "ask").unionByName(answers.where("kind = 'answer'")), uni, d, weights, pair_counts)
