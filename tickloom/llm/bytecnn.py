"""Operator 10, a quality classifier: a byte-level convolutional network in numpy.

Bytes are looked up in a learned table; filters slide over them; each filter's largest value in a chunk is kept. A chunk's filter values go through
a hidden layer, the hidden values' maxima over all chunks are combined into one logit. Chunks overlap and cover the whole document, so
that a short bad passage counts wherever it stands. Only bytes are read.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_cell

EMBED, WIDTH, STRIDE, FILTERS, HIDDEN = 8, 8, 2, 32, 16
#: Windows of a chunk that no other has, and those it shares with the next.
FRESH, SHARED = 96, 32
CHUNK_BYTES = (FRESH + SHARED - 1) * STRIDE + WIDTH
_BLOCK_CHUNKS = 256


class Sample(NamedTuple):
    """What fitting may take: at most so many documents of each label, and so many chunks, evenly spread, of each."""

    documents: int = 1200
    chunks: int = 12


@dataclass
class Network:
    embed: np.ndarray  # 256 + 1 (beyond the end), EMBED
    filters: np.ndarray  # WIDTH * EMBED, FILTERS
    filter_bias: np.ndarray
    hidden: np.ndarray  # FILTERS, HIDDEN
    hidden_bias: np.ndarray
    out: np.ndarray  # HIDDEN
    out_bias: np.ndarray  # 1

    @staticmethod
    def random(seed: int) -> Network:
        r = np.random.default_rng(seed)
        draw = lambda scale, *shape: (r.standard_normal(shape) * scale).astype(np.float32)
        return Network(draw(0.5, 257, EMBED), draw((WIDTH * EMBED) ** -0.5, WIDTH * EMBED, FILTERS), np.zeros(FILTERS, np.float32), draw(FILTERS**-0.5, FILTERS, HIDDEN), np.full(HIDDEN, 0.1, np.float32), draw(HIDDEN**-0.5, HIDDEN), np.zeros(1, np.float32))

    def parameters(self) -> list[np.ndarray]:
        return [self.embed, self.filters, self.filter_bias, self.hidden, self.hidden_bias, self.out, self.out_bias]

    def logit(self, text: str | None) -> float:
        """The logit of one whole text; null counts as empty, a chunk beyond the end."""
        data = np.frombuffer((text or "").encode("utf-8", "replace"), dtype=np.uint8)
        chunks = max(1, -(-(len(data) - (CHUNK_BYTES - FRESH * STRIDE)) // (FRESH * STRIDE)))
        best = np.full(HIDDEN, -np.inf, dtype=np.float32)
        for first in range(0, chunks, _BLOCK_CHUNKS):
            n = min(_BLOCK_CHUNKS, chunks - first)
            start, size = first * FRESH * STRIDE, (n * FRESH + SHARED - 1) * STRIDE + WIDTH
            ids = np.full(size, 256, dtype=np.intp)
            part = data[start : start + size]
            ids[: len(part)] = part
            windows = sliding_window_view(self.embed[ids].reshape(-1), WIDTH * EMBED)[:: STRIDE * EMBED]
            values = np.ascontiguousarray(windows) @ self.filters
            edges = np.add.outer(np.arange(n + 1) * FRESH, [0, SHARED]).ravel()[:-1]
            pieces = np.maximum.reduceat(values, edges, axis=0)
            ahead = pieces[2::2]
            pooled = np.maximum(np.maximum(pieces[0:-1:2], pieces[1::2]), ahead)
            hidden = np.maximum(pooled + self.filter_bias, 0) @ self.hidden + self.hidden_bias
            best = np.maximum(best, np.maximum(hidden, 0).max(axis=0))
        return float(best @ self.out + self.out_bias[0])

    def probability(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.logit(text), -30, 30))))


def sample_chunks(text: str | None, most: int) -> np.ndarray:
    """At most `most` chunks of a text, evenly spread: byte ids, 256 beyond the end."""
    data = np.frombuffer((text or "").encode("utf-8", "replace"), dtype=np.uint8)
    chunks = max(1, -(-(len(data) - (CHUNK_BYTES - FRESH * STRIDE)) // (FRESH * STRIDE)))
    take = np.unique(np.linspace(0, chunks - 1, min(most, chunks)).astype(int))
    out = np.full((len(take), CHUNK_BYTES), 256, dtype=np.int16)
    for row, k in zip(out, take, strict=True):
        part = data[k * FRESH * STRIDE : k * FRESH * STRIDE + CHUNK_BYTES]
        row[: len(part)] = part
    return out


def fit(documents: list[np.ndarray], labels: np.ndarray, prior: float | None = None, epochs: int = 6, batch: int = 32, rate: float = 4e-3, seed: int = 11) -> Network:
    """Adam on the cross-entropy of balanced labels; `prior`, the share of label 1 among all, moves the last bias back.

    With one label only, or no document, the network says the prior (1/2 where there is none) for every text.
    """
    net = Network.random(seed)
    share = float(np.clip(labels.mean() if prior is None and len(labels) else 0.5 if prior is None else prior, 1e-4, 1 - 1e-4))
    if len(set(labels.tolist())) < 2:
        net.out[:] = 0
        net.out_bias[:] = np.log(share / (1 - share))
        return net
    r = np.random.default_rng(seed)
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in net.parameters()]
    weight = np.where(labels == 1, 0.5 / labels.mean(), 0.5 / (1 - labels.mean())).astype(np.float32)
    step, steps = 0, epochs * -(-len(documents) // batch)
    for _ in range(epochs):
        order = r.permutation(len(documents))
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            step += 1
            grads = _gradients(net, [documents[i] for i in rows], labels[rows].astype(np.float32), weight[rows])
            lr = rate * (1 - step / (steps + 1))
            for p, g, (m, v) in zip(net.parameters(), grads, state, strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= lr * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    net.out_bias += np.float32(np.log(share / (1 - share)))
    return net


def _gradients(net: Network, documents: list[np.ndarray], labels: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
    chunks = np.concatenate(documents).astype(np.intp)
    ends = np.cumsum([len(d) for d in documents])
    starts = ends - [len(d) for d in documents]
    n, at = len(chunks), np.arange(FRESH + SHARED) * STRIDE
    windows = sliding_window_view(net.embed[chunks].reshape(n, -1), WIDTH * EMBED, axis=1)[:, at * EMBED]
    values = windows.reshape(-1, WIDTH * EMBED) @ net.filters
    values = values.reshape(n, len(at), FILTERS)
    where = values.argmax(axis=1)
    pooled = np.maximum(np.take_along_axis(values, where[:, None], axis=1)[:, 0] + net.filter_bias, 0)
    hidden = np.maximum(pooled @ net.hidden + net.hidden_bias, 0)
    best = np.array([hidden[a:b].argmax(axis=0) + a for a, b in zip(starts, ends, strict=True)])
    top = np.take_along_axis(hidden, best, axis=0)
    p = 1 / (1 + np.exp(-(top @ net.out + net.out_bias[0])))
    d_logit = (p - labels) * weight / len(labels)
    d_top = np.outer(d_logit, net.out) * (top > 0)
    d_hidden = np.zeros_like(hidden)
    np.add.at(d_hidden, (best, np.arange(HIDDEN)[None]), d_top)
    d_pooled = (d_hidden @ net.hidden.T) * (pooled > 0)
    used = np.flatnonzero(d_pooled.any(axis=1))
    picked = windows[used[:, None], where[used]]  # used, FILTERS, WIDTH * EMBED
    d_used = d_pooled[used]
    d_filters = np.einsum("nf,nfk->kf", d_used, picked, optimize=True)
    d_inputs = (d_used[:, :, None] * net.filters.T[None]).reshape(-1, EMBED)
    positions = (at[where[used]][:, :, None] + np.arange(WIDTH)).reshape(len(used), -1)
    ids = np.take_along_axis(chunks[used], positions, axis=1).ravel()
    d_embed = np.stack([np.bincount(ids, d_inputs[:, e], minlength=257) for e in range(EMBED)], axis=1).astype(np.float32)
    return [d_embed, d_filters, d_pooled.sum(axis=0), pooled.T @ d_hidden, d_hidden.sum(axis=0), top.T @ d_logit, np.array([d_logit.sum()], np.float32)]


def is_held_out(id_col: str = "doc_id", folds: int = 5):
    """crc32 of the id as text, modulo `folds`, is 0; a null id's text is empty."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds == 0


def learn(docs: DataFrame, labels: DataFrame, sample: Sample = Sample(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", **kw) -> Network:
    """Fit on a bounded sample of labelled rows outside the held-out fold; the share of each label comes from all of them.

    The sample of a label is the ids with the least digests, one document each: of rows that share an id the one with the least hash of its text. An executor cuts the chunks, so that the
    driver gets at most 2 * documents * chunks * CHUNK_BYTES bytes. Labels other than 0 and 1 and null ids are left out; an id with both labels counts as 0;
    null and empty texts give one chunk. Without documents the network is the one that it starts as.
    """
    known = labels.where(F.col(label_col).isin(0, 1) & ~is_held_out(id_col)).select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label"))
    known = known.groupBy("_id").agg(F.min("_label").alias("_label"))
    counts = {r[0]: r[1] for r in known.groupBy("_label").count().collect()}
    digest = hash_cell(F.col("_id"), "sample", 1 << 31)
    picked = None
    for label in (0, 1):
        some = known.where(F.col("_label") == label).orderBy(digest, "_id").limit(sample.documents)
        picked = some if picked is None else picked.unionByName(some)
    most = sample.chunks

    def cut(batches):
        for batch in batches:
            cuts = [sample_chunks(x.as_py(), most) for x in batch.column(2)]
            arrays = [batch.column(0), batch.column(1), pa.array([len(c) for c in cuts], pa.int32()), pa.array([c.tobytes() for c in cuts], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "label", "n", "chunks"])

    slim = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("_text"))
    rows = slim.join(F.broadcast(picked), F.col("_doc") == F.col("_id")).select(F.col("_id").cast("long").alias("id"), F.col("_label").alias("label"), F.col("_text").alias("text"))
    rows = rows.groupBy("id", "label").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    found = rows.mapInArrow(cut, "id long, label int, n int, chunks binary").toPandas().sort_values(["id", "chunks"])  # bounded by `sample`
    documents = [np.frombuffer(c, dtype=np.int16).reshape(n, CHUNK_BYTES) for n, c in zip(found["n"], found["chunks"], strict=True)]
    total = sum(counts.values())
    return fit(documents, found["label"].to_numpy(), counts.get(1, 0) / total if total else None, **kw)


def score(docs: DataFrame, net: Network, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row, from the bytes of its whole text; null and empty texts get one fixed score.

    Repeated rows come out as often as they go in; an empty table gives an empty one; other columns are not looked at. Nothing is shuffled.
    """

    def run(batches):
        for batch in batches:
            found = [net.probability(x.as_py()) for x in batch.column(2)]
            arrays = [batch.column(0), batch.column(1), pa.array(found, pa.float64()), pa.array([int(x >= threshold) for x in found], pa.int32())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), is_held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
