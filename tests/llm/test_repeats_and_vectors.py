"""Operators 11 to 13: kernels and whole operators against brute force, queries against their SQL, odd tables."""

from __future__ import annotations

import hashlib
import math
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from tickloom.llm import clusters, codes, exponion, queries, repeats, suffixes

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, d int, k1 string, spans string, h int, start int, run string, kept string, found int, n_bytes string"


# Suffix arrays


def test_suffix_arrays_and_common_prefixes():
    r = random.Random(1)
    for _ in range(600):
        n, k = r.randint(1, 60), r.choice([1, 2, 3, 5, 20])
        text = [r.randint(1, k) for _ in range(n)]
        if r.random() < 0.3:
            text = (text[: r.randint(1, 5)] * 60)[:n]
        text.append(0)
        for order in (suffixes.suffix_array, lambda t, s: suffixes._doubled(t)):
            sa = order(np.array(text, dtype=r.choice([np.uint16, np.int32])), k + 1)
            assert sa.tolist() == sorted(range(n + 1), key=lambda i: text[i:])
        shared = suffixes.permuted_prefixes(np.array(text), sa)
        for a, b in zip(sa, sa[1:]):
            m = 0
            while m < min(len(text) - a, len(text) - b) and text[a + m] == text[b + m]:
                m += 1
            assert shared[b] == m
        assert shared[sa[0]] == 0


def test_recursion_below_its_end(monkeypatch):
    """With no short cut the recursion sorts down to unequal names."""
    monkeypatch.setattr(suffixes, "SHORT", 0)
    r = random.Random(2)
    for n in (5000, 20_000):
        words = [bytes(r.choice(b"abc") for _ in range(r.randint(2, 9))) for _ in range(30)]
        text = np.frombuffer(b" ".join(r.choice(words) for _ in range(n // 5)), dtype=np.uint8).astype(np.uint16)
        text = np.append(text, np.uint16(0))
        sa = suffixes.suffix_array(text, 257)
        assert sorted(sa.tolist()) == list(range(len(text)))
        body = text.astype(np.uint8).tobytes()
        assert all(body[a:] < body[b:] for a, b in zip(sa.tolist(), sa.tolist()[1:]))


@pytest.mark.parametrize("text", [[7] * 100_000, [3, 1, 2] * 40_000, [1] * 50_000 + [2] * 50_000])
def test_long_repeats(text):
    text = np.array([*text, 0], dtype=np.uint16)
    sa = suffixes.suffix_array(text, 8)
    shared = suffixes.permuted_prefixes(text, sa)
    rank = np.empty(len(text), dtype=int)
    rank[sa] = np.arange(len(text))
    for a, b in zip(sa[:-1].tolist(), sa[1:].tolist()):  # neighbours: first symbols, then the ranks of what follows
        assert text[a] < text[b] or (text[a] == text[b] and rank[a + 1] < rank[b + 1])
    assert shared.max() < len(text)


def test_runs_cover_each_string_once(monkeypatch):
    monkeypatch.setattr(repeats, "PIECE", 400)
    repeats._powers.cache_clear()
    r = random.Random(3)
    for salt in (0, 2):
        texts = [bytes(r.choice(b"ab c") for _ in range(r.choice([0, 10, 49, 50, 51, 80, 300, 401, 1500]))) for _ in range(60)]
        seen = {}
        for text, (start, strings, hashes, digests) in zip(texts, repeats.runs_of_many(texts, 50, salt, digests=True), strict=True):
            assert strings.sum() == max(0, len(text) - 49)
            for s, n, h, g in zip(start.tolist(), strings.tolist(), hashes.tolist(), digests.tolist()):
                assert seen.setdefault(g, text[s : s + n + 49]) == text[s : s + n + 49]
                for at in range(s, s + n):
                    assert seen.setdefault(("string", text[at : at + 50]), h) == h  # equal strings, equal hashes
    repeats._powers.cache_clear()


# Repeats


def plain_repeats(rows, length):
    """(n_bytes, kept, spans) of (doc_id, text) in order: every string of every text."""
    first = {}
    for i, t in rows:
        body = (t or "").encode()
        for at in range(len(body) - length + 1):
            s = body[at : at + length]
            first[s] = min(first.get(s, math.inf), math.inf if i is None else i)
    out = []
    for i, t in rows:
        body = (t or "").encode()
        gone = bytearray(len(body))
        for at in range(len(body) - length + 1):
            if first[body[at : at + length]] < (math.inf if i is None else i):
                gone[at : at + length] = b"\1" * length
        spans, at = [], 0
        while at < len(body):
            if gone[at]:
                end = at
                while end < len(body) and gone[end]:
                    end += 1
                spans.append((at, end))
                at = end
            at += 1
        out.append((i, len(body), tuple(spans), bytes(b for b, g in zip(body, gone) if not g)))
    return out


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", "y", 2, 3, "z", "w", 4, "v") for i, t in rows], DOCS)


def check_repeats(spark, rows, length):
    got = [(r.doc_id, r.n_bytes, tuple((s.start, s.end) for s in r.spans), bytes(r.kept)) for r in repeats.remove_repeats(docs_of(spark, rows), length=length).collect()]
    assert Counter(got) == Counter(plain_repeats(rows, length))
    return got


def some_texts(seed=4):
    r = random.Random(seed)
    words = ["river", "stone", "Lantern", "under", "gray", "Äpfel", "漢字", "🙂", "walk"]
    prose = lambda n: " ".join(r.choice(words) + str(r.randint(0, 99)) for _ in range(n))
    passage, line = prose(30), prose(12)
    rows = [(i, prose(r.randint(1, 60))) for i in range(30)]
    rows += [(100 + i, f"{prose(8)} {passage} {prose(5)}") for i in range(8)]
    rows += [(200 + i, f"{prose(3)}\n{line}\n{prose(4)}\n{line}") for i in range(8)]
    rows += [(300 + i, rows[5][1]) for i in range(6)]  # copies
    rows += [(400 + i, rows[31][1].replace("river", "rivers", i)) for i in range(5)]  # near copies
    r.shuffle(rows)
    return rows


def test_repeats_are_those_of_all_strings(spark):
    rows = some_texts()
    got = check_repeats(spark, rows, 50)
    assert sum(bool(s) for _, _, s, _ in got) > 15
    gone = {i: n for i, n, spans, kept in got if n == len(kept)}
    assert 100 in gone and 200 in gone  # the first that holds a passage keeps it


@pytest.mark.parametrize("length", [7, 20])
def test_repeats_of_other_lengths(spark, length):
    r = random.Random(length)
    check_repeats(spark, [(r.choice([None, *range(12)]), "".join(r.choice("ab") for _ in range(r.randint(0, 60)))) for _ in range(40)], length)


def test_odd_documents(spark):
    text = "a passage of over fifty bytes that stands in several documents as it is, word for word"
    rows = [(1, None), (1, None), (None, None), (2, ""), (3, text), (3, text), (3, text + " and on"), (4, text), (None, text), (None, text), (5, "x" * 120_000), (6, "x" * 60), (7, "word " * 30_000), (8, "ord " + "word " * 20), (-5, text[:60]), (9, "é" * 60), (10, "é" * 24 + "e")]
    got = {}
    for r in repeats.remove_repeats(docs_of(spark, rows)).collect():
        got.setdefault(r.doc_id, []).append((r.n_bytes, bytes(r.kept)))
    assert got[1] == [(0, b""), (0, b"")] and got[2] == [(0, b"")]
    assert sorted(k for _, k in got[3]) == sorted([text[60:].encode()] * 2 + [(text[60:] + " and on").encode()])  # -5 has the first 60 bytes
    assert got[4][0][1] == b"" and [k for _, k in got[None]].count(b"") == 3
    assert got[5] == [(120_000, b"x" * 120_000)] and got[6] == [(60, b"")]  # a text takes nothing from itself
    assert got[7][0][0] == len(got[7][0][1]) == 150_000 and got[8][0][1] == b""
    assert got[9][0] == (120, b"\xc3\xa9" * 60) and got[10][0][0] == 49
    assert repeats.remove_repeats(docs_of(spark, [])).count() == 0


def test_hot_hashes_are_parted(spark, monkeypatch):
    """Many different runs that share their least hash: with a small bound they are parted again and again, with the same result."""
    monkeypatch.setattr(repeats, "HEAVY", 2000)
    monkeypatch.setattr(repeats, "SHARD", 4000)
    r = random.Random(6)
    shared = "https://www.example.org/a/path/that/all/have"
    rows = [(i, " ".join(f"{shared}{r.randint(0, 40)} {r.choice('abcd') * r.randint(1, 9)}" for _ in range(6))) for i in range(60)]
    check_repeats(spark, rows, 50)


def test_settings_come_back(spark):
    before = {name: spark.conf.get(name, None) for name in repeats.SETTINGS}
    repeats.remove_repeats(docs_of(spark, some_texts()[:5])).collect()
    assert {name: spark.conf.get(name, None) for name in repeats.SETTINGS} == before


# Exponion search


def brute_nearest(x, centres):
    far = ((x[:, None, :] - centres[None]) ** 2).sum(axis=2)
    return far.argmin(axis=1), far.min(axis=1)


def test_nearest_is_that_of_all_centres():
    r = np.random.default_rng(0)
    for k in (1, 2, 7, 16):
        centres = r.integers(-9, 9, size=(k, 3))
        if k > 3:
            centres[3] = centres[0]  # a copy: the lower index wins
        x = r.integers(-12, 12, size=(4000, 3))
        for start in (np.zeros(len(x), int), r.integers(0, k, len(x))):
            index, far = exponion.nearest(x, exponion.Centres(centres), start)
            want, least = brute_nearest(x, centres)
            assert (index == want).all() and (far == least).all()


def test_bounds_hold_from_round_to_round():
    r = np.random.default_rng(1)
    for k in (1, 2, 9, 16):
        centres = r.integers(-40, 40, size=(k, 5))
        if k > 4:
            centres[4] = centres[1]
        x = r.integers(-50, 50, size=(3000, 5))
        held = exponion.Bounds(np.zeros(len(x), int), np.full(len(x), np.inf), np.zeros(len(x)))
        for _ in range(6):
            held = exponion.bounded(x, exponion.Centres(centres), held)
            want, least = brute_nearest(x, centres)
            assert (held.index == want).all()
            assert (held.upper >= np.sqrt(least)).all()
            other = ((x[:, None, :] - centres[None]) ** 2).sum(axis=2).astype(float)
            other[np.arange(len(x)), want] = np.inf
            assert (held.lower <= np.sqrt(other.min(axis=1))).all()
            new = np.array([x[want == j].sum(axis=0) // max(1, (want == j).sum()) if (want == j).any() else centres[j] for j in range(k)])
            held, centres = held.moved(centres, new), new


def test_large_components_fit():
    for dims in (1, 8, 64, 1000):
        m = exponion.most_component(dims)
        assert dims * (2 * m) ** 2 < 1 << 63
    x = np.array([[exponion.most_component(8)] * 8, [-exponion.most_component(8)] * 8])
    assert exponion.nearest(x, exponion.Centres(x), np.array([1, 0]))[0].tolist() == [0, 1]


# Vector codes and clusters

VECTORS = "vec_id long, embedding array<double>, label int, v string, code string, n int, vector string"


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, v, label, "x", "y", 1, "z") for i, v, label in rows], VECTORS)


def some_vectors(n=300, dims=64, seed=7):
    r = random.Random(seed)
    rows = [(i, [r.gauss((i % 5) / 3, 0.3) for _ in range(dims)], i % 4 if i % 9 else None) for i in range(n)]
    rows += [(1000, None, 1), (1001, [1.0] * (dims - 1) + [None], 1), (1002, [float("nan")] * dims, 1), (1003, [float("inf")] + [0.0] * (dims - 1), 1), (1004, [0.5] * 5, 1), (1005, [], None)]
    rows += [(3, rows[3][1], 3), (3, rows[3][1], 3), (None, [0.1] * dims, None), (-7, [-0.3] * dims, 2), (2000, [1e300] * dims, 9)]
    return rows


def sound(rows, dims=64):
    return [(i, v, x) for i, v, x in rows if v is not None and len(v) == dims and all(c is not None and math.isfinite(c) for c in v)]


def lloyd(parts, starts, rounds):
    """Integer vectors of one part: (books after the rounds, index, squared distance) in plain Python."""
    books = [list(s) for s in starts]
    assign = lambda: [min(((sum((a - b) ** 2 for a, b in zip(p, c)), k) for k, c in enumerate(books))) for p in parts]
    for _ in range(rounds):
        groups = defaultdict(list)
        for p, (_, k) in zip(parts, assign()):
            groups[k].append(p)
        for k, some in groups.items():
            books[k] = [sum(c) // len(some) for c in zip(*some)]
    return books, assign()


def test_vector_codes(spark):
    rows = some_vectors()
    kept = sorted(sound(rows), key=lambda r: (r[0] is None, r[0] or 0, [math.floor(4096 * c) for c in r[1]]))
    bound = exponion.most_component(64)
    ints = [[max(-bound, min(bound, math.floor(4096 * c))) for c in v] for _, v, _ in kept]
    code, error, sha = [""] * len(kept), [0] * len(kept), []
    for p in range(8):
        part = [v[8 * p : 8 * p + 8] for v in ints]
        books, found = lloyd(part, part[:16], 6)
        sha += [str(c) for b in books for c in b]
        code = [c + f"{k:02x}" for c, (_, k) in zip(code, found)]
        error = [e + d for e, (d, _) in zip(error, found)]
    by_label = defaultdict(int)
    for (_, _, label), e in zip(kept, error):
        by_label[label] += e
    want = Counter((i, c, e, by_label[x], hashlib.sha256(",".join(sha).encode()).hexdigest()) for (i, _, x), c, e in zip(kept, code, error))
    got = Counter(map(tuple, codes.digest(*codes.compress(vectors_of(spark, rows))).collect()))
    assert got == want


def test_clusters(spark):
    rows = some_vectors()
    digest = lambda i: hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    bound = exponion.most_component(64)
    kept = sorted(((digest(i), [max(-bound, min(bound, math.floor(64 * c))) for c in v], i) for i, v, _ in sound(rows)), key=lambda x: x[:2])
    books, found = lloyd([v for _, v, _ in kept], [v for _, v, _ in kept[:16]], 3)
    sums = defaultdict(int)
    for d, k in found:
        sums[k] += d
    want = Counter((i, k, d, sums[k], sum(sums.values()), hashlib.sha256(",".join(map(str, books[k])).encode()).hexdigest()) for (_, _, i), (d, k) in zip(kept, found))
    assert Counter(map(tuple, clusters.digest(*clusters.cluster(vectors_of(spark, rows))).collect())) == want


@pytest.mark.parametrize("rows", [[], [(1, None, 0)], [(1, [0.5] * 64, None)], [(1, [0.5] * 64, 2)] * 3 + [(2, [0.5] * 64, None)]])
def test_few_vectors(spark, rows):
    n = len(sound(rows))
    got = codes.digest(*codes.compress(vectors_of(spark, rows))).collect()
    assert len(got) == n and all(r.code == "00" * 8 and r.error == 0 for r in got)
    got = clusters.digest(*clusters.cluster(vectors_of(spark, rows))).collect()
    assert len(got) == n and all(r.cluster == 0 and r.distance == 0 for r in got)


def test_parts_of_uneven_length(spark):
    rows = [(i, [float(i % 7), float(i % 3), 1.0, 0.0, -1.5][:5], 0) for i in range(40)]
    table, books = codes.compress(vectors_of(spark, rows), parts=3, entries=4, many=2, scale=2)
    assert [b.shape for b in books] == [(4, 1), (4, 2), (4, 2)] and table.count() == 40
    empty = codes.compress(vectors_of(spark, [(1, [], 0)]), parts=3)[0].collect()
    assert [r.error for r in empty] == [0]


# Queries


@pytest.mark.parametrize("name", ["op11_vector_codes", "op12_suffix_dedup", "op13_exponion_clusters"])
def test_query_is_its_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    frame = queries.queries()[name](spark, SF)
    cursor = con.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(frame.columns)
    assert Counter(tuple(r[c] for c in columns) for r in frame.collect()) == Counter(cursor.fetchall())
