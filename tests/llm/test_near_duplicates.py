"""Which documents the near-duplicate stage keeps, against brute force and on planted copies."""

from __future__ import annotations

import random

from tickloom.llm import shingles, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def make(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], SCHEMA)


def prose(r, n):
    return [f"w{r.randrange(5000)}" for _ in range(n)]


def five(text):
    words = (text or "").lower().split()
    return {" ".join(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) > 5 else {" ".join(words)} if words else set()


def alike(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def copies(r, words, changes):
    """The text with so many words changed, far enough from each other that each costs five shingles."""
    out = list(words)
    for k in r.sample(range(1, len(words) // 10 - 1), changes):
        out[10 * k] = f"new{r.randrange(10**9)}"
    return " ".join(out)


def test_keep_one_by_class_not_by_id(spark):
    r = random.Random(3)
    a, b, c, d, e = (" ".join(prose(r, 80)) for _ in range(5))
    rows = [(None, a), (None, b), (None, b), (None, c), (1, c), (7, d), (7, e), (7, e), (3, d)]
    for keep in (simhash.keep_one, shingles.keep_one):
        got = [(x.doc_id, x.text) for x in keep(make(spark, rows)).collect()]
        assert sorted(got, key=str) == sorted([(None, a), (None, b), (1, c), (3, d), (7, e)], key=str)


def test_classes_at_a_similarity_of_0_8(spark):
    r = random.Random(8)
    rows, pairs = [], []
    for k in range(120):
        words = prose(r, 300)
        rows += [(10 * k, " ".join(words))] + [(10 * k + c, copies(r, words, c)) for c in range(1, 8)]
        pairs += [(10 * k, 10 * k + c) for c in range(1, 8)]
    sets = {i: five(t) for i, t in rows}
    root = {x.doc_id: x.root for x in shingles.classes(make(spark, rows)).collect()}
    near = [(a, b) for a, b in pairs if alike(sets[a], sets[b]) >= 0.8]
    assert len(near) == 720 and {c % 10 for _, c in near} == {1, 2, 3, 4, 5, 6}
    found = sum(root[a] == root[b] for a, b in near)
    assert found == len(near), f"recall {found / len(near)}"
    assert len(set(root.values())) >= 120 and not any(root[10 * k] == root[10 * k + 10] for k in range(119))


def test_classes_are_those_of_all_pairs(spark):
    r = random.Random(9)
    texts = ["", None, " \n", "one two", "One  two", "one two three"]
    for _ in range(12):
        words = prose(r, r.randint(30, 200))
        texts += [" ".join(words)] * 2
        for _ in range(14):
            words = list(words) if r.random() < 0.5 else copies(r, words, 1).split()
            texts.append(" ".join(words + prose(r, r.randint(0, 12))))
    hub = prose(r, 400)
    texts += [copies(r, hub, 9) for _ in range(40)]
    rows = [(i if i % 7 else None, t) for i, t in enumerate(texts)]
    sets, group = [five(t) for t in texts], list(range(len(texts)))

    def find(k):
        while group[k] != k:
            k = group[k]
        return k

    for a in range(len(texts)):
        for b in range(a):
            if alike(sets[a], sets[b]) >= 0.8:
                group[find(a)] = find(b)
    want = {}
    for k, (i, t) in enumerate(rows):
        want.setdefault(find(k), set()).add((i, t))
    got = {}
    for x, t in ((x, x.text) for x in shingles.classes(make(spark, rows)).join(shingles.row_keys(make(spark, rows)).select("_text", "_row", "text").distinct(), ["_text", "_row"]).collect()):
        got.setdefault(x.root, set()).add((x.doc_id, t))
    assert {frozenset(v) for v in got.values()} == {frozenset(v) for v in want.values()}
    kept = shingles.keep_one(make(spark, rows)).collect()
    assert len(kept) == len(want)
    assert sorted(x.doc_id is None for x in kept) == sorted(all(i is None for i, _ in v) for v in want.values())
