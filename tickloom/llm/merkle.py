"""Operator 2, document fingerprints: a Merkle tree over paragraphs and sections.

Paragraphs end at line ends, and long lines at spaces that their own neighbourhood chooses, or between characters
chosen so where no space is near, so an edit moves no boundary but those beside it. Runs of paragraphs form sections, whose ends the
paragraphs' digests choose. The root is the digest of the section digests. Equal roots mean equal
texts; where roots differ, equal sections are skipped and the rest names the paragraphs that changed.
"""

from __future__ import annotations

import hashlib
from base64 import b64encode
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ordered_buckets

#: A space ends a paragraph if the hash of the bytes before it is 0 modulo this; no such cut within so many bytes of the last.
SPACE_CUT, LEAST_BYTES = 8, 16
#: A run without such a space is cut at the first space after so many bytes.
MOST_BYTES = 128
#: Without a space in so many bytes more, a run is cut before characters instead: where the hash of the bytes before is 0 modulo this.
FAR_BYTES, CHARACTER_CUT = 512, 64
#: A paragraph ends its section if its digest is 0 modulo this.
SECTION_CUT = 8
#: Bytes of text that a task of the ordered pass gets, about, in so many buckets.
TASK_BYTES, BUCKETS_A_TASK = 24 << 20, 4
_LOWEST = -(1 << 63)

Leaf = tuple[str, int]
#: Root, then sections of (digest, paragraphs of (digest, bytes)).
Tree = tuple[str, list[tuple[str, list[Leaf]]]]


def _short(digest: bytes, size: int) -> str:
    return b64encode(digest[:size], b"-_").decode().rstrip("=")


def _between_characters(data: bytes, start: int, end: int) -> list[int]:
    """Cuts inside data[start:end], a run without spaces: only where a UTF-8 character begins, LEAST_BYTES apart."""
    array = np.frombuffer(data, dtype=np.uint8)[start:end].astype(np.uint32)
    mixed = array[6:-1]
    for back, times in enumerate((0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1, 0xD3A2646D)):
        mixed = mixed + array[5 - back : -2 - back] * np.uint32(times) if back else array[5:-2] * np.uint32(times)
    places = np.flatnonzero(((mixed >> np.uint32(16)) % CHARACTER_CUT == 0) & ((array[6:-1] & 0xC0) != 0x80)) + 6
    out, last = [], 0
    for at in places.tolist():
        if at - last >= LEAST_BYTES:
            out.append(start + at)
            last = at
    return out


def _cuts(data: bytes) -> list[int]:
    """Ends of the paragraphs."""
    array = np.frombuffer(data, dtype=np.uint8)
    lines = np.flatnonzero(array == 10) + 1
    spaces = np.flatnonzero(array[3:] == 32) + 3
    mixed = array[spaces - 1].astype(np.uint32) * np.uint32(0x9E3779B1) + array[spaces - 2] * np.uint32(0x85EBCA77) + array[spaces - 3] * np.uint32(0xC2B2AE3D)
    spaces = spaces[(mixed >> np.uint32(16)) % SPACE_CUT == 0] + 1
    hard = np.zeros(len(lines) + len(spaces), dtype=bool)
    both = np.concatenate([lines, spaces])
    hard[: len(lines)] = True
    order = np.argsort(both, kind="stable")
    ends, last = [], 0
    for at, fixed in [*zip(both[order].tolist(), hard[order].tolist(), strict=True), (len(data), True)]:
        if at - last >= LEAST_BYTES or fixed and at > last:
            while at - last > MOST_BYTES:
                space = data.find(b" ", last + MOST_BYTES, at - 1) + 1
                if (space or at) - last > FAR_BYTES:
                    ends += _between_characters(data, last, space or at)
                if not space:
                    break
                ends.append(space)
                last = space
            ends.append(at)
            last = at
    return ends


def tree(text: str | None) -> Tree:
    """The Merkle tree of one text; null counts as empty, whose tree has no section."""
    data = (text or "").encode("utf-8", "surrogatepass")
    sections, leaves, inner, top, last = [], [], hashlib.blake2b(digest_size=16), hashlib.blake2b(digest_size=16), 0
    for end in _cuts(data):
        digest = hashlib.blake2b(data[last:end], digest_size=16).digest()
        leaves.append((_short(digest, 6), end - last))
        inner.update(digest)
        last = end
        if digest[15] % SECTION_CUT == 0 or end == len(data):
            sections.append((_short(inner.digest(), 6), leaves))
            top.update(inner.digest())
            leaves, inner = [], hashlib.blake2b(digest_size=16)
    return _short(top.digest(), 16), sections


def to_string(found: Tree) -> str:
    """root|section:paragraph.bytes,paragraph.bytes;section:..."""
    return found[0] + "|" + ";".join(f"{name}:" + ",".join(f"{leaf}.{size}" for leaf, size in leaves) for name, leaves in found[1])


def from_string(fingerprint: str) -> Tree:
    root, _, rest = fingerprint.partition("|")
    sections = []
    for part in filter(None, rest.split(";")):
        name, _, leaves = part.partition(":")
        sections.append((name, [(x.partition(".")[0], int(x.partition(".")[2])) for x in leaves.split(",")]))
    return root, sections


def likeness(a: Tree, b: Tree) -> float:
    """Share of the two texts' bytes that lie in paragraphs both have: 1 if the roots are equal, 0 if nothing is shared."""
    if a[0] == b[0]:
        return 1.0
    left, right = (Counter(leaf for _, leaves in t[1] for leaf in leaves) for t in (a, b))
    total = sum(size * n for t in (left, right) for (_, size), n in t.items())
    return 2 * sum(size * n for (_, size), n in (left & right).items()) / total if total else 0.0


def changed(a: Tree, b: Tree) -> list[tuple[int, int]]:
    """Byte ranges (start, end) of a's text whose paragraphs b lacks; equal roots and sections are passed over."""
    if a[0] == b[0]:
        return []
    same, known = {name for name, _ in b[1]}, {leaf for _, leaves in b[1] for leaf in leaves}
    ranges, at = [], 0
    for name, leaves in a[1]:
        for leaf in leaves:
            if name not in same and leaf not in known:
                if ranges and ranges[-1][1] == at:
                    ranges[-1] = (ranges[-1][0], at + leaf[1])
                else:
                    ranges.append((at, at + leaf[1]))
            at += leaf[1]
    return ranges


def add_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint) for each row, where it lies."""

    def run(batches):
        for batch in batches:
            prints = [to_string(tree(x.as_py())) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.string())], ["doc_id", "fingerprint"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fingerprint string")


def in_descending_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(bucket, extra, doc_id, text), sorted in each partition so that a row's next document follows it.

    The ids are cut into buckets at their quantiles, as many as the bytes of text ask for. A bucket's last row is
    followed by an extra one: the first row of the next bucket, after the last bucket that of the first. So
    texts are dealt out once and no window spans the table. What the driver holds is
    one id for each bucket of some megabytes. Rows that share an id go by their text, null ids come last.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_LOWEST)).alias("k"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    if not n:
        return rows.select(F.lit(0).alias("bucket"), F.lit(False).alias("extra"), "doc_id", "text")
    tasks = max(1, -(-size // TASK_BYTES))
    dealt = ordered_buckets(rows, "k", min(n, tasks * BUCKETS_A_TASK), descending=True)
    heads = [(r[0], r[1]) for r in dealt.select("bucket", "k").groupBy("bucket").agg(F.max("k").alias("k")).orderBy("bucket").collect()]
    before = [(heads[i][1], heads[i - 1][0]) for i in range(len(heads))]  # a head also follows the bucket before it, the first head the last bucket
    follows = F.broadcast(spark.createDataFrame(before, "k long, bucket int"))  # a row a bucket
    extra = rows.join(follows, "k").groupBy("k", "bucket").agg(F.min(F.struct(F.col("text").isNotNull(), "text", "doc_id")).alias("x"))
    extra = extra.select("bucket", F.lit(True).alias("extra"), "k", "x.doc_id", "x.text")
    both = dealt.select("bucket", F.lit(False).alias("extra"), "k", "doc_id", "text").unionByName(extra)
    return both.repartition(tasks, "bucket").sortWithinPartitions("bucket", "extra", F.desc("k"), F.asc_nulls_first("text")).select("bucket", "extra", "doc_id", "text")


def _compare(rows: Iterator[tuple]) -> Iterator[tuple]:
    held = None
    for bucket, extra, doc_id, text in rows:
        text = text or ""
        found = tree(text)
        if held:
            own_id, own, own_tree = held
            half = len(own) // 2
            edited = own[: len(own) - half] + text[:half]
            edited_tree = tree(edited)
            yield own_id, len(own), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), to_string(own_tree), to_string(edited_tree), likeness(own_tree, edited_tree), likeness(own_tree, found)
        held = None if extra else (doc_id, text, found)


def against_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's fingerprint against its edited text's and the next document's, in descending doc_id.

    The edited text has its last half (rounded down, code points) replaced by as many code points of
    the next document, or all it has. After the last document comes the first; a single document is its own
    next. Null texts count as empty, rows that share an id are ordered by text (null first), null ids come last. An
    empty table gives an empty one; other columns are not looked at.
    """
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    names = [x.split()[0] for x in schema.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(batches):
        rows = (tuple(c[i].as_py() for c in batch.columns) for batch in batches for i in range(batch.num_rows))
        held = []
        for row in _compare(rows):
            held.append(row)
            if len(held) == 512:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)

    return in_descending_runs(docs, id_col, text_col).mapInArrow(run, schema)
