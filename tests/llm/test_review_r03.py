"""Faults that a review found in the training-data operators."""

from __future__ import annotations

import pickle
import random
from collections import Counter

import pyarrow as pa

from tickloom.llm import katz, repeats, shingles
from tickloom.llm.common import Scratch


def test_a_table_part_is_counted_slice_by_slice(spark):
    """No task holds a part's messages together, and a block's rows get one sum from all slices."""
    r = random.Random(4)
    docs = spark.createDataFrame([(i, " ".join(f"w{r.randrange(40)}" for _ in range(30))) for i in range(60)], "doc_id long, text string")
    uni = katz.summarise(katz.count_words(docs, 7, 2, 300), 20, 8)
    found = katz.count_pairs(katz.make_blocks(docs, uni, 4, 7, 2, 300), uni, 4)
    assert "FlatMapGroupsInArrow" not in found._jdf.queryExecution().toString()
    sent = found.collect()
    parts = Counter((x["block"], x["kind"]) for x in sent if x["kind"] in ("info", "row"))
    blocks = {b for b, _ in parts}
    assert len(blocks) > 1 and all(parts[b, "info"] == 1 and 1 <= parts[b, "row"] <= 4 for b in blocks)
    assert sum(len(pickle.loads(x["data"])[0]) for x in sent if x["kind"] == "info") == 60


def _by_all_pairs(sets, least=0.8):
    group = list(range(len(sets)))

    def find(k):
        while group[k] != k:
            k = group[k]
        return k

    for a in range(len(sets)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]):
                group[find(a)] = find(b)
    return [find(k) for k in range(len(sets))]


def test_crowds_lose_no_link(spark, monkeypatch):
    """Near copies of one text on both sides of 0.8, with and without that text, and texts that share a passage: groups are joined as all pairs would join them, and few pairs are looked at."""
    r = random.Random(17)
    word = lambda: f"w{r.randrange(10**6)}"
    texts, of = [], []
    for k in range(2):
        base = [word() for _ in range(130)]
        edits = [[i, word()] for i in range(0, 130, 6) for _ in range(2)]  # a place has two other words, so that copies share edits
        for n in range(0 if k else 1, 160):
            words = list(base)
            for i, new in r.sample(edits, n % 9 if n else 0):
                words[i] = new
            texts.append(" ".join(words))
            of.append(k)
    passage = [word() for _ in range(60)]
    texts += [" ".join(passage + [word() for _ in range(n)]) for n in range(0, 90, 2)]
    of += [2] * (len(texts) - len(of))
    texts, of = zip(*dict(zip(texts, of, strict=True)).items(), strict=True)
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    want = _by_all_pairs(sets)
    table = spark.createDataFrame(list(enumerate(texts)), "_text long, text string")
    crowds = spark.createDataFrame([(i, i, g) for i, g in enumerate(of)], "_text long, root long, `group` long")
    looked, before = [], shingles._by_texts
    monkeypatch.setattr(shingles, "_by_texts", lambda pairs, *a: looked.append(pairs.count()) or before(pairs, *a))
    found = [(x.a, x.b) for x in shingles._in_crowds(crowds, table, 5, 0.8, 42, Scratch(spark)).collect()]
    group = list(range(len(texts)))
    for a, b in found:
        assert len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
        group = [group[b] if g == group[a] else g for g in group]
    assert len({*zip(want, group, strict=True)}) == len(set(want)) == len(set(group))
    assert 3 < len(set(want)) < len(texts) and 0 < sum(looked) < sum(of.count(k) ** 2 for k in range(3)) // 4


def test_crowded_buckets_give_the_classes_of_all_pairs(spark, monkeypatch):
    """From fingerprints on: buckets of more than four texts count as crowded, and the classes are those of all pairs."""
    monkeypatch.setattr(shingles, "CROWD", 4)
    went, before = [], shingles._in_crowds
    monkeypatch.setattr(shingles, "_in_crowds", lambda *a: went.append(1) or before(*a))
    r = random.Random(23)
    base = [f"w{r.randrange(10**6)}" for _ in range(150)]
    texts = []
    for n in range(120):
        words = list(base)
        for i in r.sample(range(0, 150, 6), 2 + n % 6):
            words[i] = f"new{r.randrange(10**9)}"
        texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    root = {x.doc_id: x.root for x in shingles.classes(docs).collect()}
    want = _by_all_pairs([{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts])
    assert went and len({(want[i], root[i]) for i in range(120)}) == len(set(want)) == len(set(root.values()))


def test_runs_leave_a_slice_at_most_twice():
    """What goes to a hash's task does not grow with the copies in a slice, and keeps the least and greatest id and digest."""
    r = random.Random(6)
    texts = ["the same passage in all of the texts, longer than fifty bytes by far; " + " ".join(f"w{r.randrange(9)}" for _ in range(k % 5)) for k in range(80)]
    d = [r.randrange(1000) for _ in texts]
    batch = pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array([t.encode() for t in texts], pa.binary())], names=["d", "text"])
    rows = [x for b in repeats._hashes(50, True)([batch]) for x in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    want = [(i, h, g) for i, found in zip(d, repeats.runs_of_many([t.encode() for t in texts], 50, digests=True), strict=True) for h, g in zip(found[2].tolist(), found[3].tolist(), strict=True)]
    ends = lambda z: {h: (min(x[0] for x in z if x[1] == h), max(x[0] for x in z if x[1] == h), min(x[2] for x in z if x[1] == h), max(x[2] for x in z if x[1] == h)) for h in {x[1] for x in z}}
    assert ends(rows) == ends(want) and len(rows) < len(want) and max(Counter(x[1:] for x in rows).values()) <= 2
