"""Passages that repeat across documents, found in suffix arrays of shards and removed.

A string of `length` bytes belongs to the shard that its least hash of a short substring names, so that equal strings meet in one
shard whatever documents they stand in. A text falls into runs of consecutive strings with one such hash. Runs whose hash no
other document has cannot repeat; where all runs with a hash are copies of one, its first document is known. All others, parts of passages that begin, end or
change there, are sent to their shard, once for each different run and with the least id that has it. Each shard's runs make one text: its suffix array comes by induced sorting, strings that agree in
`length` bytes stand together in it by their permuted common prefixes, and the least id of each such group is the answer for all its members.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch
from .suffixes import permuted_prefixes, suffix_array

#: Order of rows without an id: after all ids.
LAST = (1 << 63) - 1
#: Bytes of runs in a shard, and of runs that share a hash before another hash parts them.
SHARD, HEAVY = 1 << 20, 1 << 19
#: How often runs that share hashes are parted by a further one.
SPLITS = 4
#: Bytes of text that a task hashes at a time.
PIECE = 1 << 20
#: Multipliers of the hash of short substrings: the next one, and one for each further splitting.
MULTIPLIERS = (0x100000001B3, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)


#: Queries run inside let Spark delete their shuffle files as they end, and join by hash tables where each partition's measured size allows it.
SETTINGS = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64m"}


@contextmanager
def configured(spark: SparkSession) -> Iterator[None]:
    before = {name: spark.conf.get(name, None) for name in SETTINGS}
    for name, value in SETTINGS.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def runs_of(text: bytes | None, length: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, strings, hash) of the runs of a text: `strings` consecutive strings from `start` on share the hash, the least of their substrings of half the length."""
    return next(iter(runs_of_many([text], length, salt)))[:3]


def runs_of_many(texts: list[bytes | None], length: int, salt: int = 0, digests: bool = False) -> Iterator[tuple[np.ndarray, ...]]:
    """(start, strings, hash, digest) of the runs of each text; equal runs have equal digests (None unless asked for). Short texts are hashed together."""
    held: list[bytes] = []
    size = 0
    for text in texts:
        text = text or b""
        if held and size + len(text) > PIECE // 4:
            yield from _together(held, length, salt, digests)
            held, size = [], 0
        held.append(text)
        size += len(text)
        if size > PIECE:
            yield from _long(held.pop(), length, salt, digests)  # it is alone
            size = 0
    yield from _together(held, length, salt, digests)


def _long(text: bytes, length: int, salt: int, digests: bool) -> Iterator[tuple[np.ndarray, ...]]:
    """A text in pieces that overlap by a string; a run that a piece ends is two."""
    parts = [next(_together([text[at : at + PIECE + length - 1]], length, salt, digests)) for at in range(0, len(text) - length + 1, PIECE)]
    starts = [p[0] + k * PIECE for k, p in enumerate(parts)]
    yield (np.concatenate(starts), *(np.concatenate([p[i] for p in parts]) for i in (1, 2)), np.concatenate([p[3] for p in parts]) if digests else None)


def _together(texts: list[bytes], length: int, salt: int, digests: bool) -> Iterator[tuple[np.ndarray, ...]]:
    if not texts:
        return
    sizes = np.array([len(t) for t in texts])
    ends = np.cumsum(sizes)
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    if len(data) < length:
        none = np.zeros(0, np.int64)
        yield from ((none, none, none, none if digests else None) for _ in texts)
        return
    least = _least(data, length, salt)
    new = np.concatenate(([True], least[1:] != least[:-1]))
    new[(ends - sizes)[ends - sizes < len(new)]] = True
    start = np.flatnonzero(new)
    stop = np.append(start[1:], len(least))
    who = np.searchsorted(ends, start, side="right")
    strings = np.minimum(stop, ends[who] - length + 1) - start
    whole = strings > 0
    start, strings, who = start[whole], strings[whole], who[whole]
    hashes, digest = least[start].view(np.int64), None
    if digests:
        with np.errstate(over="ignore"):
            values, up, down = _powers()
            total = np.concatenate(([np.uint64(0)], np.cumsum(values[data] * up[: len(data)])))
            digest = (total[start + strings + length - 1] - total[start]) * down[start] + strings.astype(np.uint64)
            digest = ((digest ^ (digest >> np.uint64(31))) * np.uint64(MULTIPLIERS[2])).view(np.int64)
    edges = np.searchsorted(who, np.arange(len(texts) + 1))
    for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
        yield start[a:b] - (ends[i] - sizes[i]), strings[a:b], hashes[a:b], digest[a:b] if digests else None


@cache
def _powers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Random values of bytes, powers of an odd number, and of its inverse modulo 2**64."""
    odd = MULTIPLIERS[1]
    values = np.random.default_rng(1).integers(0, 1 << 63, 256, dtype=np.uint64)
    many = PIECE + 1000
    return values, *(np.concatenate(([np.uint64(1)], np.cumprod(np.full(many, x, dtype=np.uint64)))) for x in (np.uint64(odd), np.uint64(pow(odd, -1, 1 << 64))))


def _least(text: np.ndarray, length: int, salt: int) -> np.ndarray:
    """For each string of `length` bytes of a text, the least hash of its substrings of half that."""
    width = max(1, length // 2)
    with np.errstate(over="ignore"):
        power, part, size, out, have = np.uint64(MULTIPLIERS[salt]), text.astype(np.uint64) + np.uint64(1 + salt), 1, None, 0
        left = width
        while left:  # polynomial of the substring, by doubling
            if left & 1:
                n = len(text) - have - size + 1
                out, have = (part[:n], size) if out is None else (out[:n] * power + part[have : have + n], have + size)
            left >>= 1
            if left:
                n = len(part) - size
                part, power, size = part[:n] * power + part[size : size + n], power * power, size * 2
        out = (out ^ (out >> np.uint64(32))) * np.uint64(MULTIPLIERS[1])
        out ^= out >> np.uint64(29)
    many, size = length - width + 1, 1
    while size * 2 <= many:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    return np.minimum(out[: len(out) - (many - size)], out[many - size :]) if many > size else out


def _in(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(values), dtype=bool)
    known = np.sort(known)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Some texts at a time: their hashes are what takes memory."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(sizes):
        upto = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + 4 * PIECE, side="right")))
        yield batch.slice(at, upto - at)
        at = upto


def _ends(d: np.ndarray, h: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Which of the rows (d, h, g) to keep so that each h keeps its least and greatest d and g: of rows that share h and g, the first and last by d."""
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    several = np.concatenate(([False], same)) | np.concatenate((same, [False]))
    once, often = order[~several], order[several]
    often = often[np.lexsort((d[often], g[often], h[often]))]
    new = (h[often[1:]] != h[often[:-1]]) | (g[often[1:]] != g[often[:-1]])
    return np.concatenate((once, often[np.concatenate(([True], new)) | np.concatenate((new, [True]))] if len(often) else often))


#: Parts to which hashes are dealt by their low bits, and the bits by which a part knows them.
PART_BITS, KEY_BITS = 10, 32


def _messages(length: int):
    """(part, keys) of the runs of texts, a row for each slice and part: 32 bits of each hash, once, and twice where two ids of the slice have it."""

    def run(batches):
        for part in (p for batch in batches for p in _slices(batch)):
            found = [f[2] for f in runs_of_many(part.column("text").to_pylist(), length)]
            d, h = np.repeat(part.column("d").to_numpy(), [len(f) for f in found]), np.concatenate(found)
            keys = (h & ((1 << PART_BITS) - 1)) << KEY_BITS | (h >> PART_BITS) & ((1 << KEY_BITS) - 1)
            order = np.argsort(keys, kind="stable")
            keys, d = keys[order], d[order]
            same = keys[1:] == keys[:-1]
            keys = np.sort(np.concatenate((keys[:1], keys[1:][~same], np.unique(keys[1:][same & (d[1:] != d[:-1])]))))
            parts, first = np.unique(keys >> KEY_BITS, return_index=True)
            packed, edges = keys.astype("<u4"), [*first.tolist(), len(keys)]
            sent = [packed[a:b].tobytes() for a, b in zip(edges, edges[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int64()), pa.array(sent, pa.binary())], names=["part", "keys"])

    return run


def _several(messages: pa.Table) -> pa.Table:
    """The low bits of a part's hashes that came twice."""
    keys = np.sort(np.frombuffer(b"".join(messages.column("keys").to_pylist()), dtype="<u4"))
    keys = np.unique(keys[1:][keys[1:] == keys[:-1]]).astype(np.int64)
    return pa.table({"h": pa.array(keys << PART_BITS | messages.column("part")[0].as_py(), pa.int64())})


def _seen_twice(docs: DataFrame, length: int) -> DataFrame:
    """(h): the low 42 bits of all hashes that rows of different d have, and of few others. Some four bytes a run are exchanged."""
    return docs.select("d", "text").mapInArrow(_messages(length), "part long, keys binary").groupBy("part").applyInArrow(_several, "h long")


#: Bits of a sieve for each hash in it, about, and at most; and the pieces in which it is made.
SIEVE, MOST_BITS, SIEVE_PIECES = 16, 1 << 29, 64


def _sieve(known: DataFrame, most: int = MOST_BITS) -> np.ndarray:
    """A bit for each remainder of hashes, set where one of `known` (h) has it: hashes without their bit are not among them. At most `most` bits, however many hashes there are; the rest is left to the join."""
    bits = min(most, max(1 << 16, 1 << (SIEVE * known.count()).bit_length()))
    each = bits // SIEVE_PIECES

    def piece(table: pa.Table) -> pa.Table:
        there = np.zeros(each, dtype=np.uint8)
        there[table.column("at").to_numpy() % each] = 1
        return pa.table({"piece": pa.array([table.column("at")[0].as_py() // each], pa.int64()), "bits": pa.array([np.packbits(there, bitorder="little").tobytes()], pa.binary())})

    at = F.col("h").bitwiseAND(F.lit(bits - 1))
    made = known.select(at.alias("at"), F.floor(at / each).alias("part")).groupBy("part").applyInArrow(piece, "piece long, bits binary")
    found = np.zeros(bits // 8, dtype=np.uint8)
    for row in made.toLocalIterator():
        found[row[0] * (each // 8) : (row[0] + 1) * (each // 8)] = np.frombuffer(row[1], dtype=np.uint8)
    return found


def _passes(hashes: np.ndarray, sieve: np.ndarray) -> np.ndarray:
    at = hashes & np.int64(8 * len(sieve) - 1)
    return (sieve[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


def _hashes(length: int, digests: bool, sieve=None):
    """(d, h, g) of the runs of texts, those alike in a slice at most twice, or (d, k1, h); of those alone that pass the broadcast sieve, if there is one."""
    names = ["d", "h", "g"] if digests else ["d", "k1", "h"]

    def run(batches):
        for part in (p for batch in batches for p in _slices(batch)):
            found = list(runs_of_many(part.column("text").to_pylist(), length, digests=digests))
            counts = [len(f[0]) for f in found]
            columns = {c: np.repeat(part.column(c).to_numpy(), counts) for c in names if c in part.schema.names}
            columns["h"] = np.concatenate([f[2] for f in found])
            if digests:
                columns["g"] = np.concatenate([f[3] for f in found])
            if sieve is not None:
                keep = _passes(columns["h"], sieve.value)
                columns = {c: v[keep] for c, v in columns.items()}
            if digests:
                keep = _ends(columns["d"], columns["h"], columns["g"]) if len(columns["h"]) else slice(0)
                columns = {c: v[keep] for c, v in columns.items()}
            yield pa.RecordBatch.from_arrays([pa.array(columns[c]) for c in names], names=names)

    return run


_CUT = "d long, k1 long, k2 long, start long, end long, route long, run binary"


def _cut(length: int):
    """Of each text: the spans that copies of runs with an earlier id cover (no run), and the runs that have to be compared."""

    def run(batches):
        for part in (p for batch in batches for p in _slices(batch)):
            texts, covered, asked = (part.column(c) for c in ("text", "covered", "asked"))
            ids = [part.column(c).to_numpy() for c in ("d", "k1", "k2")]
            rows, starts, ends, routes, pieces = [], [], [], [], []
            bodies = texts.to_pylist()
            for i, (start, strings, hashes, _) in enumerate(runs_of_many(bodies, length)):
                text, end = bodies[i], start + strings + length - 1
                whole = _in(hashes, covered[i].values.to_numpy(zero_copy_only=False))
                a, b = merged(start[whole], end[whole])
                send = _in(hashes, asked[i].values.to_numpy(zero_copy_only=False))
                starts += [a, start[send]]
                ends += [b, end[send]]
                routes += [np.zeros(len(a), np.int64), hashes[send]]
                rows.append(np.full(len(a) + int(send.sum()), i))
                pieces += [None] * len(a) + [text[x:y] for x, y in zip(start[send].tolist(), end[send].tolist(), strict=True)]
            rows = np.concatenate(rows)
            columns = [*(pa.array(x[rows]) for x in ids), *(pa.array(np.concatenate(x)) for x in (starts, ends, routes)), pa.array(pieces, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["d", "k1", "k2", "start", "end", "route", "run"])

    return run


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans as the maximal ones that they cover, ascending."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    head = np.concatenate(([True], start[1:] > end[:-1]))
    return start[head], end[np.append(np.flatnonzero(head)[1:] - 1, len(end) - 1)]


def _part(length: int, salt: int):
    """Runs parted at another hash: `at` is the place of a part in its run."""

    def run(batches):
        for batch in batches:
            out = []
            for run_, digest, least, at in zip(*(batch.column(c).to_pylist() for c in ("run", "digest", "least", "at")), strict=True):
                for s, n, h in zip(*(x.tolist() for x in runs_of(run_, length, salt)), strict=True):
                    out.append((digest, least, at + s, h, run_[s : s + n + length - 1]))
            if out:
                columns = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["digest", "least", "at", "route", "run"])

    return run


def least_in_shard(runs: list[bytes], least: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(run, place, least): from this place of a run on, up to the next entry, the least id of all runs that hold the string of `length` bytes that starts there."""
    sizes = np.array([len(x) for x in runs])
    # 0 ends the text, 1 stands behind each run, bytes follow from 2 on
    text = np.frombuffer(b"\0".join(runs) + b"\0", dtype=np.uint8).astype(np.uint16) + np.uint16(2)
    ends = np.cumsum(sizes + 1)
    text[ends - 1] = 1
    text = np.append(text, np.uint16(0))
    sa = suffix_array(text, 258)
    shared = permuted_prefixes(text, sa)
    starts = ends - sizes - 1
    owner = np.repeat(np.arange(len(runs), dtype=np.int32), sizes + 1)
    inside = np.zeros(len(text), dtype=bool)
    step = np.zeros(len(text) + 1, dtype=np.int32)  # places from which a whole string fits into its run
    step[starts] += 1
    step[starts + sizes - length + 1] -= 1
    inside = np.cumsum(step[:-1]) > 0
    places = sa[inside[sa]]
    head = shared[places] < length
    head[0] = True
    group = np.flatnonzero(head)
    best = np.minimum.reduceat(least[owner[places]], group)
    found = np.empty(len(text), dtype=np.int64)
    found[places] = np.repeat(best, np.diff(np.append(group, len(places))))
    at = np.flatnonzero(inside)
    change = np.concatenate(([True], (found[at[1:]] != found[at[:-1]]) | (at[1:] != at[:-1] + 1)))
    at = at[change]
    return owner[at], at - starts[owner[at]], found[at]


_FOUND = "digest binary, first long, upto long, earliest long"


def _sort_shard(length: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        runs = group["run"].tolist()
        who, place, least = least_in_shard(runs, group["least"].to_numpy(), length)
        strings = np.array([len(x) - length + 1 for x in runs])
        upto = np.append(place[1:], 0)
        upto[np.append(who[1:] != who[:-1], True)] = strings
        shift = group["at"].to_numpy()[who]
        return pd.DataFrame({"digest": group["digest"].to_numpy()[who], "first": place + shift, "upto": upto + shift, "earliest": least})

    return run


def repeated_spans(docs: DataFrame, scratch: Scratch, length: int = 50) -> DataFrame:
    """(d, k1, k2, spans) for rows (d, k1, k2, text binary): spans, in no order and overlapping, whose strings of `length` bytes also start in a row with a smaller d."""
    spark, key = docs.sparkSession, ["d", "k1", "k2"]
    with configured(spark):
        # nine of ten hashes are not shared: they stay where they are
        sieve = spark.sparkContext.broadcast(_sieve(scratch.write(_seen_twice(docs, length), "seen")))
        known = docs.select("d", "text").mapInArrow(_hashes(length, True, sieve), "d long, h long, g long").repartition("h").groupBy("h").agg(F.min("d").alias("low"), (F.min("g") == F.max("g")).alias("alike"), F.max("d").alias("high"))
        known = scratch.write(known.where("low < high").select("h", "low", "alike"), "shared")
        hashes = docs.select("d", "k1", "text").mapInArrow(_hashes(length, False, sieve), "d long, k1 long, h long").join(known, "h").where("not alike or low < d")
        wanted = scratch.write(hashes.groupBy("d", "k1").agg(F.collect_set(F.when(F.col("alike"), F.col("h"))).alias("covered"), F.collect_set(F.when(~F.col("alike"), F.col("h"))).alias("asked")), "wanted")
        sieve.destroy()
        scratch.drop("seen", "shared")
        cut = scratch.write(docs.join(wanted, ["d", "k1"]).select(*key, "text", "covered", "asked").mapInArrow(_cut(length), _CUT).withColumn("digest", F.unhex(F.md5("run"))), "runs")
        scratch.drop("wanted")
        runs = cut.where("run is not null")
        once = runs.groupBy("run", "digest", "route").agg(F.min("d").alias("least"))
        once = scratch.write(once.select("digest", "least", F.lit(0).cast("long").alias("at"), "route", "run"), "once")
        for salt in range(1, SPLITS + 1):
            heavy = scratch.write(once.groupBy("route").agg(F.sum(F.octet_length("run")).alias("bytes")).where(F.col("bytes") > HEAVY).select("route"), "heavy")
            if heavy.isEmpty():
                break
            parted = once.join(heavy, "route", "left_semi").select(*once.columns).mapInArrow(_part(length, salt), once.schema)
            once = scratch.write(once.join(heavy, "route", "left_anti").select(*once.columns).unionByName(parted), "once")
        size = once.agg(F.sum(F.octet_length("run"))).first()[0] or 0
        shards = max(1, -(-size // SHARD), min(4 * spark.sparkContext.defaultParallelism, -(-size // (SHARD // 4))))
        found = once.withColumn("shard", F.pmod(F.xxhash64("route"), F.lit(shards))).groupBy("shard").applyInPandas(_sort_shard(length), _FOUND)
        found = scratch.write(found, "found")
        scratch.drop("once", "heavy")
        placed = runs.select(*key, "start", "digest").join(found, "digest").where("earliest < d")
        spans = placed.select(*key, (F.col("start") + F.col("first")).alias("start"), (F.col("start") + F.col("upto") + length - 1).alias("end"))
        spans = spans.unionByName(cut.where("run is null").select(*key, "start", "end"))
        spans = scratch.write(spans.groupBy(*key).agg(F.collect_set(F.struct("start", "end")).alias("spans")), "spans")
        scratch.drop("runs", "found")
        return spans


def _remove(batches):
    for batch in batches:
        starts, ends, counts, kept = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [0], []
        for text, found in zip(batch.column("text").to_pylist(), batch.column("found"), strict=True):
            if not found.is_valid:
                counts.append(0)
                kept.append(text)
                continue
            start, end = merged(*(found.values.field(k).to_numpy() for k in (0, 1)))
            starts.append(start)
            ends.append(end)
            counts.append(len(start))
            kept.append(b"".join(text[a:b] for a, b in zip([0, *end.tolist()], [*start.tolist(), len(text)], strict=True)))
        pairs = pa.StructArray.from_arrays([pa.array(np.concatenate(starts)), pa.array(np.concatenate(ends))], names=["start", "end"])
        columns = [batch.column("doc_id"), batch.column("n_bytes"), pa.ListArray.from_arrays(pa.array(np.cumsum(counts), pa.int32()), pairs), pa.array(kept, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "spans", "kept"])


def remove_repeats(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, spans, kept) of every row: the bytes of its text that no string of `length` bytes covers that also starts in a row with a smaller id.

    A text is its UTF-8 bytes; null is empty, and a text shorter than `length` loses nothing. Matches never cross documents and
    are judged on the texts as they come in. Rows that share an id, repeated rows among them, take nothing from each other; rows without an id come after
    all others, and take nothing from each other. `spans` are the maximal removed runs (start, end exclusive, in bytes), ascending; other columns do not matter. Tables
    written on the way go once what comes of them is written; the spans stay in the shared folder, for the result is read from them.
    """
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"))
    rows = rows.select("doc_id", F.coalesce("doc_id", F.lit(LAST)).alias("d"), F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(length), "text").alias("k2"), "text")
    spans = repeated_spans(rows.select("d", "k1", "k2", "text"), scratch, length)
    joined = rows.join(spans.withColumnRenamed("spans", "found"), ["d", "k1", "k2"], "left")
    schema = "doc_id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary"
    return joined.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "text", "found").mapInArrow(_remove, schema)


def digest(rows: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of rows of remove_repeats."""
    return rows.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def oracle(length: int = 50) -> str:
    """The same rows in SQL: every string of every document, in hexadecimal."""
    return f"""with t as materialized (select doc_id, lower(hex(encode(coalesce(text, '')))) as h from documents),
        w as (select doc_id, h, unnest(range(0, length(h) // 2 - {length - 1})) as pos from t where length(h) >= {2 * length}),
        s as materialized (select doc_id, pos, md5_number(substr(h, 2 * pos + 1, {2 * length})) as k from w),
        m as (select k, min(doc_id) as low from s group by k having count(distinct doc_id) > 1),
        hit as (select s.doc_id, s.pos from s join m using (k) where m.low < s.doc_id),
        g as (select *, (pos > lag(pos) over (partition by doc_id order by pos) + {length})::int as new from hit),
        i as (select *, sum(coalesce(new, 0)) over (partition by doc_id order by pos rows unbounded preceding) as n from g),
        r as (select doc_id, n, min(pos) as a, max(pos) + {length} as b from i group by doc_id, n),
        p as (select doc_id, a, b, lag(b, 1, 0) over (partition by doc_id order by a) as from_, row_number() over (partition by doc_id order by a desc) as last from r),
        k as (select p.doc_id, count(*) as n_spans, sum(b - a)::bigint as n_removed, string_agg(substr(h, 2 * from_ + 1, 2 * (a - from_)) || case when last = 1 then substr(h, 2 * b + 1) else '' end, '' order by a) as kept from p join t using (doc_id) group by p.doc_id)
        select t.doc_id, (length(h) // 2)::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans, sha256(unhex(coalesce(kept, h))) as kept_sha256 from t left join k using (doc_id)"""
