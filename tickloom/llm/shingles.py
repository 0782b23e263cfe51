"""Near duplicates by the Jaccard similarity of word shingles, for the pipeline.

Two texts link if the sets of their five-word shingles have a Jaccard similarity of at least 0.8. Operator 1's
covering SimHash tables find the pairs within two bits of 64, but a pair at 0.8 differs in ten bits on average. So
candidates also come from BANDS keys, each of ROWS MinHash values: a pair of similarity s shares one
with a probability of 1 - (1 - s^ROWS)^BANDS: 0.99992 at 0.8, more above. A pair's share of equal MinHash values (four bits
of each are kept) estimates its similarity: SURE and over, or under UNLIKE, is over four standard deviations from 0.8 and
decides; pairs between are checked on their two texts. Classes are what the links connect.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, one_of_each, row_keys
from .components import connected_components
from .simhash import covering_masks, fingerprint_of, shingle_hashes

BANDS, ROWS = 40, 7
#: Estimates from which on a pair links, and under which it does not, for a similarity of 0.8.
SURE, UNLIKE = 0.92, 0.69
#: Of the pairs across classes, those whose estimate is at least this come first: most links are there, and join classes whose other pairs need no look.
LIKELY = 0.78
#: Bands of the first round; the others are then asked of texts that are still apart alone.
FIRST = 5
#: A bucket that holds more texts of several classes than this is not compared pair by pair, for the number of pairs counts squared, but by what its texts differ in.
CROWD = 32
#: Shingles hashed at once, and shingles of texts kept at hand while pairs are checked.
_AT_ONCE, _AT_HAND = 1 << 10, 1 << 20
_VALUES = BANDS * ROWS
LONGS = -(-_VALUES // 16)
_draw = np.random.default_rng(20)
_TIMES = _draw.integers(0, 1 << 32, (_VALUES, 1), dtype=np.uint32) | np.uint32(1)
_PLUS = _draw.integers(0, 1 << 32, (_VALUES, 1), dtype=np.uint32)
_MIX = _draw.integers(0, 1 << 64, (BANDS, ROWS), dtype=np.uint64) | np.uint64(1)
_TABLES = np.array(covering_masks(2), dtype=np.int64)
#: Every fourth bit of a long.
_FOURTHS = 0x1111111111111111


def signature(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of a text's shingle hashes: the BANDS keys, and four bits of each MinHash value, sixteen values a long; texts without words are alike."""
    folded = (hashes ^ (hashes >> np.uint64(32))).astype(np.uint32)
    least = np.full(_VALUES, (1 << 32) - 1, dtype=np.uint32)
    for at in range(0, len(folded), _AT_ONCE):
        np.minimum(least, (folded[at : at + _AT_ONCE] * _TIMES + _PLUS).min(axis=1), out=least)
    keys = (least.reshape(BANDS, ROWS).astype(np.uint64) * _MIX).sum(axis=1, dtype=np.uint64)
    four = np.zeros(16 * LONGS, dtype=np.uint8)
    four[:_VALUES] = ((least ^ (least >> np.uint32(15))) * np.uint32(0x9E3779B1)) >> np.uint32(28)
    return (keys ^ (keys >> np.uint64(32))).view(np.int64), (four[::2] << 4 | four[1::2]).view(np.int64)


def table_keys(fingerprint: int) -> np.ndarray:
    """The keys of a fingerprint in operator 1's covering tables."""
    masked = (np.int64(fingerprint) & _TABLES).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.arange(len(_TABLES), dtype=np.uint64)
    return (masked ^ (masked >> np.uint64(29))).view(np.int64)


def estimate(a: Column, b: Column) -> Column:
    """Of two signatures: the similarity, from the share of equal values less what four bits hit by chance. JVM only: a value differs if one of its four bits does."""
    spread = lambda x: x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseOR(F.shiftrightunsigned(x, 3))
    differ = F.zip_with(a, b, lambda x, y: F.bit_count(spread(x.bitwiseXOR(y)).bitwiseAND(F.lit(_FOURTHS))).cast("int"))
    return (1 - F.aggregate(differ, F.lit(0), lambda s, x: s + x) / _VALUES - 1 / 16) / (15 / 16)


def shingle_set(text: str | None, words: int = 5, seed: int = 42) -> np.ndarray:
    return np.unique(shingle_hashes(text, words, seed))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted sets; two empty ones are equal."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common)


def _by_texts(pairs: DataFrame, texts: DataFrame, words: int, least: float, seed: int, scratch: Scratch) -> DataFrame:
    """Those of the pairs (a, b) whose texts (_text, text) are at least so similar."""

    def run(batches):
        known, held = {}, 0
        for batch in batches:
            found = []
            for row in zip(*(batch.column(i) for i in range(4)), strict=True):
                sets = []
                for key, text in zip((row[0].as_py(), row[1].as_py()), row[2:], strict=True):
                    if key not in known:
                        if held > _AT_HAND:
                            known, held = {}, 0
                        known[key] = shingle_set(text.as_py(), words, seed)
                        held += len(known[key]) + 16
                    sets.append(known[key])
                found.append(jaccard(*sets) >= least)
            keep = pa.array(found, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(keep) for i in range(2)], ["a", "b"])

    wanted = pairs.select(F.col("a").alias("_text")).union(pairs.select("b")).distinct()
    few = scratch.write(texts.join(wanted, "_text", "left_semi").dropDuplicates(["_text"]), "texts")
    full = pairs.join(few.select(F.col("_text").alias("a"), F.col("text").alias("text_a")), "a").join(few.select(F.col("_text").alias("b"), F.col("text").alias("text_b")), "b")
    return full.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def _links(pairs: DataFrame, texts: DataFrame, words: int, least: float, seed: int, scratch: Scratch) -> DataFrame:
    """Those of the pairs (a, b, near) that link: by estimate where it is clear, else by their texts."""
    shift = least - 0.8
    sure = pairs.where(F.col("near") >= SURE + shift).select("a", "b")
    unsure = pairs.where((F.col("near") >= UNLIKE + shift) & (F.col("near") < SURE + shift)).select("a", "b")
    return scratch.write(sure.unionByName(_by_texts(unsure, texts, words, least, seed, scratch)), "links")


def _roots(nodes: DataFrame, edges: DataFrame, scratch: Scratch) -> DataFrame:
    found = connected_components(edges, scratch).withColumnsRenamed({"node": "_text", "component": "root"})
    return nodes.join(found, "_text", "left").withColumn("root", F.coalesce("root", "_text"))


def _stars(members: DataFrame) -> DataFrame:
    """Pairs (a, b, near) of each member and its bucket's centre, where their classes differ. A bucket's centre is drawn by hash, another one in each bucket, so that a text meets many of a large group."""
    centre = F.min(F.struct(F.xxhash64("key", "_text").alias("h"), "_text", "root", "sig"))
    found = members.groupBy("key").agg(centre.alias("c"), F.max("root").alias("high"), F.min("root").alias("least")).where("least < high").select("key", "c")
    pairs = members.join(found, "key").where("root <> c.root")
    return pairs.select(F.least("_text", "c._text").alias("a"), F.greatest("_text", "c._text").alias("b"), estimate(F.col("sig"), F.col("c.sig")).alias("near")).where(F.col("near") >= UNLIKE - 0.2).dropDuplicates(["a", "b"])


def _mixed(members: DataFrame) -> DataFrame:
    """members of buckets that hold several classes, with the bucket's size n."""
    found = members.groupBy("key").agg(F.count("*").alias("n"), F.max("root").alias("high"), F.min("root").alias("least")).where("least < high").select("key", "n")
    return members.join(found, "key")


def _across(members: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b, near), with an estimate from `least` on, of members of a bucket of at most CROWD whose classes differ, but not of one crowd (group), which _in_crowds does.

    The join passes a pair in the first band that it shares alone, so that no pair comes out of each bucket in which it lies.
    """
    both = members.where(F.col("n") <= CROWD).select("key", "band", "_text", "root", "group", "sig", "tags")
    other = both.select("key", *[F.col(c).alias(f"{c}_b") for c in ("_text", "root", "group", "sig", "tags")])
    near = estimate(F.col("sig"), F.col("sig_b"))
    first = F.array_position(F.zip_with("tags", "tags_b", lambda x, y: x == y), True) - 1
    apart = F.col("group").isNull() | F.col("group_b").isNull() | (F.col("group") != F.col("group_b"))
    pairs = both.join(other, (both["key"] == other["key"]) & (F.col("root") < F.col("root_b")) & apart & (near >= least) & (first == F.col("band")))
    return pairs.select(F.least("_text", "_text_b").alias("a"), F.greatest("_text", "_text_b").alias("b"), near.alias("near")).dropDuplicates(["a", "b"])


def _crowds(mixed: DataFrame, scratch: Scratch) -> DataFrame:
    """(_text, group): the texts of buckets of more than CROWD; those that share such buckets, by a chain of them, are one group."""
    crowded = mixed.where(F.col("n") > CROWD).select("key", "_text")
    centre = crowded.groupBy("key").agg(F.min("_text").alias("b"))
    return scratch.write(connected_components(crowded.join(centre, "key").select(F.col("_text").alias("a"), "b"), scratch).withColumnsRenamed({"node": "_text", "component": "group"}), "crowds")


def _apart(least: float):
    """From a text's shingles and its group's core (x, c: texts of the group that have it): how it differs from the core, by how many private shingles, and the rarest of the others as far as a partner must share one."""

    def pairs(found: pa.ListScalar) -> list[np.ndarray]:
        return [found.values.field(i).to_numpy() for i in (0, 1)] if found.is_valid else [np.zeros(0, np.int64)] * 2

    def run(batches):
        for batch in batches:
            out = []
            for n, own, core in zip(batch.column("n").to_pylist(), batch.column("own"), batch.column("core"), strict=True):
                (x, c), (k, kc) = pairs(own), pairs(core)
                extra, lacks = ~np.isin(x, k), ~np.isin(k, x)
                which, times = np.concatenate([x[extra], k[lacks]]), np.concatenate([c[extra], n - kc[lacks]])
                shared = times > 1
                private = int((~shared).sum())
                room = int(len(x) * (1 - least) / least + 1e-6) - private
                order = np.lexsort((which[shared], times[shared]))[: max(0, room + 1)]
                out.append((len(x), private, int(shared.sum()), which[shared][order]))
            size, private, common, first = zip(*out, strict=True) if out else ([], [], [], [])
            columns = [*(batch.column(c) for c in ("group", "_text", "root")), *(pa.array(v, pa.int64()) for v in (size, private, common)), pa.array(first, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["group", "_text", "root", "size", "private", "common", "first"])

    return run


def _in_crowds(crowds: DataFrame, texts: DataFrame, words: int, least: float, seed: int, scratch: Scratch) -> DataFrame:
    """The links (a, b) that join all classes of a group (_text, root, group), whatever its size, as all its pairs would; exact, by shingles.

    Texts are told by how they differ from the group's core, the shingles that over half of its texts have: two texts differ by what they differ from the
    core, less twice what is common to both differences. So a difference of least 0.8 is at most a ninth of both sizes, and three cases are all:
    two texts that together are so near to the core lie as near to the text m that is nearest to it, and link to m; a difference that no other text of the
    group has counts in full, and if these are too many a text has no partner; else partners share one of the text's rarest common differences. Few pairs of a large
    group do, and those are checked on their texts.
    """
    ratio = (1 - least) / (1 + least)

    def run(batches):
        for batch in batches:
            sets = [shingle_set(t.as_py(), words, seed).view(np.int64) for t in batch.column("text")]
            sizes = [len(x) for x in sets]
            columns = [pa.array(np.repeat(np.asarray(batch.column(c)), sizes)) for c in ("group", "_text", "root", "n")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64))], names=["group", "_text", "root", "n", "x"])

    crowds = crowds.join(crowds.groupBy("group").agg(F.count("*").alias("n")), "group")
    rows = texts.join(crowds, "_text").dropDuplicates(["_text"]).select("group", "_text", "root", "n", "text").mapInArrow(run, "group long, _text long, root long, n long, x long")
    rows = scratch.write(rows.withColumn("c", F.count("*").over(Window.partitionBy("group", "x"))), "shingles")
    core = rows.where(F.col("c") * 2 > F.col("n")).select("group", "x", "c").distinct().groupBy("group").agg(F.collect_list(F.struct("x", "c")).alias("core"))
    own = rows.groupBy("group", "_text", "root", "n").agg(F.collect_list(F.struct("x", "c")).alias("own"))
    schema = "group long, _text long, root long, size long, private long, common long, first array<long>"
    told = scratch.write(own.join(core, "group", "left").mapInArrow(_apart(least), schema), "apart").withColumn("far", F.col("private") + F.col("common") - F.col("size") * ratio)
    nearest = told.groupBy("group").agg(F.min(F.struct("far", "_text", "root")).alias("m"))
    told = told.join(nearest, "group").withColumn("near_m", F.col("far") + F.col("m.far") <= 1e-6)
    stars = told.where("near_m and root <> m.root").select(F.least("_text", "m._text").alias("a"), F.greatest("_text", "m._text").alias("b"))
    dealt = told.select("group", F.explode("first").alias("x"), "_text", F.when(F.col("near_m"), F.col("m.root")).otherwise(F.col("root")).alias("root"), "size", "private", "common")
    other = dealt.select("group", "x", *[F.col(c).alias(f"{c}_b") for c in ("_text", "root", "size", "private", "common")])
    differ = F.col("private") + F.col("private_b") + F.abs(F.col("common") - F.col("common_b"))
    pairs = dealt.join(other, ["group", "x"]).where((F.col("root") < F.col("root_b")) & (differ <= (F.col("size") + F.col("size_b")) * ratio + 1e-6))
    pairs = scratch.write(pairs.select(F.least("_text", "_text_b").alias("a"), F.greatest("_text", "_text_b").alias("b")).distinct(), "pairs")
    return scratch.write(stars.unionByName(_by_texts(pairs, texts, words, least, seed, scratch)), "links")


def _own_nodes(rows: DataFrame, clashes: DataFrame | None) -> DataFrame:
    """rows (_text, _check) whose _text is a node: the hash of the text, and of both hashes where different texts share the first."""
    if clashes is None:
        return rows
    marked = rows.join(F.broadcast(clashes.select(F.col("_text").alias("_clash"))), F.col("_text") == F.col("_clash"), "left")
    return marked.withColumn("_text", F.when(F.col("_clash").isNotNull(), F.xxhash64("_text", "_check")).otherwise(F.col("_text"))).drop("_clash")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, least: float = 0.8, seed: int = 42, scratch: Scratch | None = None, identity: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """(doc_id, _text, _row, root) of each row: root is the least text hash that links reach.

    A text is known by 128 bits: texts that share the 64 of `identity` (at 10^11 texts some hundreds) are told apart by 64 others.

    In four rounds, each on texts that are still apart. Every text of a bucket is held against the bucket's centre: first in operator 1's
    tables and a few bands, then in all bands. That is linear, and joins the copies of one text, for a text meets another centre in each bucket. Then, in buckets that still hold
    several classes, all pairs across classes, the likely ones first; a join lets no pair pass whose estimate rules a link out. Crowded buckets, where a common passage or
    many near copies would pair all texts, go by what their texts differ in, which loses no link. Equal texts, null ids and repeated rows need no care: the nodes are texts.
    """
    scratch = scratch or Scratch(docs.sparkSession)

    def run(batches):
        for batch in batches:
            found = []
            for text in batch.column("text"):
                hashes = shingle_hashes(text.as_py(), words, seed)
                keys, sig = signature(hashes)
                found.append((np.concatenate([table_keys(fingerprint_of(hashes)), keys]), sig))
            n = len(_TABLES) + BANDS
            flat = pa.array(np.concatenate([k for k, _ in found]) if found else np.zeros(0, np.int64), pa.int64())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * n), flat)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "_key", "_check", "_row", "_text")), lists, pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * LONGS), pa.array(np.concatenate([s for _, s in found]) if found else np.zeros(0, np.int64), pa.int64()))], ["doc_id", "_key", "_check", "_row", "_text", "keys", "sig"])

    rows = row_keys(docs, id_col, text_col).withColumns({"_key": F.col("_text"), "_check": F.xxhash64(F.lit(seed), "text"), "_text": identity(F.col("text"))})
    every = scratch.write(rows.mapInArrow(run, "doc_id long, _key long, _check long, _row long, _text long, keys array<long>, sig array<long>"), "prints")
    found = every.groupBy("_text").agg(F.first("keys").alias("keys"), F.first("sig").alias("sig"), F.min("_check").alias("low"), F.max("_check").alias("high"))
    prints, clashes = scratch.write(found, "distinct"), None
    if not prints.where("low < high").isEmpty():
        clashes = prints.where("low < high").select("_text")
        every = _own_nodes(every, clashes)
        prints = scratch.write(every.select("_text", "keys", "sig").dropDuplicates(["_text"]), "distinct")
    texts = _own_nodes(rows, clashes).select("_text", "text")
    dealt = prints.select("_text", F.posexplode("keys").alias("band", "key"))
    shared = dealt.groupBy("key").agg(F.min("_text").alias("low"), F.max("_text").alias("high")).where("low < high").select("key")
    tags = F.transform("keys", lambda k: k.bitwiseAND(F.lit(0x7FFFFFFF)).cast("int"))
    members = scratch.write(dealt.join(shared.hint("merge"), "key").select("key", "band", "_text").join(prints.select("_text", "sig", tags.alias("tags")).hint("merge"), "_text"), "buckets")
    nodes, edges = members.select("_text").distinct(), None
    for step in ("first", "all", "likely", "rest"):
        roots = nodes.withColumn("root", F.col("_text")) if edges is None else scratch.write(_roots(nodes, edges, scratch), "roots")
        placed = members.where(F.col("band") < len(_TABLES) + FIRST) if step == "first" else members
        placed = placed.join(roots, "_text").select("key", "band", "_text", "root", "sig", "tags")
        crowds = None
        if step in ("first", "all"):
            pairs = _stars(placed)
        else:
            placed, none = scratch.write(_mixed(placed), "mixed"), F.lit(None).cast("long")
            if step == "rest" and not placed.where(F.col("n") > CROWD).isEmpty():
                crowds = _crowds(placed, scratch)
            placed = placed.withColumn("group", none) if crowds is None else placed.join(crowds, "_text", "left")
            pairs = _across(placed, (LIKELY if step == "likely" else UNLIKE) + least - 0.8)
        found = _links(scratch.write(pairs, "pairs"), texts, words, least, seed, scratch)
        if crowds is not None:
            found = found.unionByName(_in_crowds(crowds.join(roots, "_text"), texts, words, least, seed, scratch))
        edges = found if edges is None else edges.unionByName(found)
    rooted = every.select("doc_id", "_key", "_row", "_text").join(_roots(nodes, edges, scratch), "_text", "left").withColumn("root", F.coalesce("root", "_text"))
    return rooted.select("doc_id", F.col("_key").alias("_text"), "_row", "root")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """The rows of docs, one of each class, as one_of_each chooses it; of what was written on the way, the chosen rows' keys alone stay."""
    scratch = Scratch(docs.sparkSession)
    out = one_of_each(docs, classes(docs, id_col, text_col, scratch=scratch, **kw), text_col)
    scratch.drop()
    return out
