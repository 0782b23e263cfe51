"""Each operator against brute force on small tables, and on tables made to break it."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tickloom.llm import bilstm, bytecnn, fertility, katz, merkle, mixing, packing, pii, sharding, simhash, store, tokens

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, bucket int, length string, key string, rank string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def make(spark, rows):
    """documents with columns whose names the operators use inside."""
    full = [(i, t, lang, src, None if t is None else len(t), "x", 1, "y", "z", "w") for i, t, lang, src in rows]
    return spark.createDataFrame(full, SCHEMA)


def prose(r, n):
    words = ["the", "of", "station", "river", "Lantern", "walks", "under", "gray", "morning", "and", "they", "counted", "slowly,", "every", "boat", "that", "came", "home.", "until", "night"]
    return " ".join(r.choice(words) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    r = random.Random(4)
    out = []
    for i in range(60):
        text = prose(r, r.randint(1, 400))
        if i % 3 == 0:
            text = text.replace(" they ", "\n")
        out.append((i, text, "en", f"s{i % 3}"))
    out += [(100, out[5][1], "en", "s1"), (101, out[5][1], "en", "s1"), (101, out[5][1], "en", "s1"), (102, out[7][1] + " end", "en", None), (103, None, None, "s0"), (104, "", "xx", "s0"), (105, " \n\t ", "en", "s2"), (None, "null id text with the mail a@b.co", "de", "s2"), (106, "word " * 60_000, "en", "s2"), (107, "Äpfel 漢字 🙂 don't", "zz", "s1")]
    return out


ODD = [(1, None, None, None), (1, None, None, None), (None, None, None, None), (2, "", "en", "a"), (2, "one", "en", "a"), (2, "one", "en", "a"), (3, "\n\n", "en", "a"), (4, "x" * 200_000, "en", "b")]


def tables(spark):
    return [make(spark, []), make(spark, ODD)]


@pytest.fixture(scope="module")
def net():
    return bilstm.trained()


def all_operators(net):
    cnn = bytecnn.Network.random(1)
    return {
        "simhash": simhash.near_duplicates, "keep_one": simhash.keep_one, "merkle": merkle.against_edits, "merkle_plain": merkle.add_fingerprints, "katz": katz.score, "fertility": fertility.score, "keep_good": fertility.keep_good,
        "sharding": sharding.shard, "packing": packing.pack, "pii": lambda d: pii.scan(d, net), "redacted": lambda d: pii.redacted(d, net), "store": store.write_and_verify, "mix": mixing.mix, "apply_mix": mixing.apply_mix, "cnn": lambda d: bytecnn.score(d, cnn),
    }


#: Operators that give one row for each row they get.
ONE_TO_ONE = {"simhash", "merkle", "merkle_plain", "katz", "fertility", "sharding", "pii", "redacted", "store", "mix", "cnn"}


def test_odd_tables(spark, net):
    empty, odd = tables(spark)
    for name, run in all_operators(net).items():
        assert run(empty).count() == 0, name
        got = run(odd).collect()
        if name in ONE_TO_ONE:
            assert sorted(map(str, (x[0] for x in got))) == sorted(str(i) for i, *_ in ODD), name


def test_simhash(spark, rows):
    got = simhash.near_duplicates(make(spark, rows)).collect()
    prints = {}
    for i, text, *_ in rows:
        words = [w.encode() for w in WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))]
        grams = [b" ".join(words[k : k + 3]) for k in range(len(words) - 2)] if len(words) >= 3 else [b" ".join(words)] if words else []
        h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        prints[(i, text)] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    values = sorted(set(prints.values()))
    group = {v: v for v in values}

    def root(v):
        while group[v] != v:
            v = group[v]
        return v

    for a in values:
        for b in values:
            if (a ^ b).bit_count() <= 2:
                group[root(a)] = root(b)
    least = defaultdict(list)
    for (i, _), v in prints.items():
        if i is not None:
            least[root(v)].append(i)
    want = sorted((str(i), f"{v:016x}", str(min(least[root(v)]) if least[root(v)] else None)) for i, text, *_ in rows for v in [prints[(i, text)]])
    assert sorted((str(x.doc_id), x.fingerprint, str(x.component_id)) for x in got) == want


@pytest.mark.parametrize("radius", [1, 2])
def test_links_connect_what_all_pairs_connect(spark, radius):
    r = random.Random(radius)
    base = [r.getrandbits(64) for _ in range(6)]
    values = {b ^ sum(1 << k for k in r.sample(range(20), r.randint(0, 4))) for b in base for _ in range(40)}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    edges = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"), radius).collect()

    def classes(pairs):
        group = {v: v for v in signed}

        def root(v):
            while group[v] != v:
                v = group[v]
            return v

        for a, b in pairs:
            group[root(a)] = root(b)
        sets = defaultdict(set)
        for v in signed:
            sets[root(v)].add(v)
        return {frozenset(s) for s in sets.values()}

    close = lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= radius
    assert all(close(a, b) for a, b in edges)
    assert classes([(a, b) for a, b in edges]) == classes([(a, b) for a in signed for b in signed if close(a, b)])


def test_masks_cover(spark):
    masks = simhash.covering_masks(2)
    assert len(masks) == 7
    for a in range(64):
        for b in range(64):
            assert any(not (m >> a & 1) and not (m >> b & 1) for m in masks)


def test_keep_one(spark, rows):
    docs = make(spark, rows)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    classes = simhash.near_duplicates(docs).select("component_id").distinct().count()
    assert kept.count() == classes


def test_merkle(spark, rows):
    got = merkle.against_edits(make(spark, rows)).collect()
    low = -(1 << 63)
    order = sorted(rows, key=lambda x: (-(x[0] if x[0] is not None else low), x[1] is not None, x[1] or ""))
    want = []
    for k, (i, text, *_) in enumerate(order):
        own, following = text or "", order[(k + 1) % len(order)][1] or ""
        half = len(own) // 2
        edited = own[: len(own) - half] + following[:half]
        a, b, c = merkle.tree(own), merkle.tree(edited), merkle.tree(following)
        want.append((str(i), len(own), hashlib.sha256(edited.encode()).hexdigest(), merkle.to_string(a), merkle.to_string(b), merkle.likeness(a, b), merkle.likeness(a, c)))
    assert sorted((str(x[0]), *x[1:]) for x in got) == sorted(want)


def test_merkle_tree():
    r = random.Random(1)
    text = "\n".join(prose(r, 60) for _ in range(20))
    edited = text.replace("\n", "\nA new line here.\n", 1)
    a, b = merkle.tree(text), merkle.tree(edited)
    assert merkle.tree(text) == a and a[0] != b[0] and merkle.likeness(a, a) == 1 and merkle.likeness(a, b) > 0.9
    assert sum(size for _, leaves in a[1] for _, size in leaves) == len(text.encode())
    ((start, end),) = merkle.changed(b, a)
    assert "A new line" in edited.encode()[start:end].decode()
    assert merkle.from_string(merkle.to_string(a)) == a
    assert merkle.tree("") == merkle.tree(None) and merkle.likeness(merkle.tree(""), a) == 0
    repeated = merkle.tree("to " * 4000)
    assert merkle.likeness(repeated, merkle.tree("to " * 2000 + "be " * 2000)) > 0.4


def brute_katz(rows):
    tok = lambda t: re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    uni, bi, ctx = Counter(), Counter(), Counter()
    for i, t, *_ in rows:
        if not held(i):
            w = [*tok(t), "END"]
            c = ["START", *w[:-1]]
            uni.update(w), bi.update(zip(c, w, strict=True)), ctx.update(c)
    n, v = sum(uni.values()), len(uni)
    d1, d2 = (katz.discounts([sum(x == r for x in k.values()) for r in range(1, 7)]) for k in (uni, bi))
    unknown = sum((1 - d1[x - 1]) * x for x in uni.values() if x <= 5) / n
    p = lambda w: unknown if uni[w] == 0 else (d1[uni[w] - 1] if uni[w] <= 5 else 1) * uni[w] / n
    q = lambda u, w: (d2[bi[u, w] - 1] if bi[u, w] <= 5 else 1) * bi[u, w] / (ctx[u] + katz.NOVEL)
    follow = defaultdict(list)
    for u, w in bi:
        follow[u].append(w)
    alpha = {u: (1 - sum(q(u, w) for w in ws)) / (1 - sum(p(w) for w in ws)) for u, ws in follow.items()}
    out = []
    for i, t, *_ in rows:
        w = [*tok(t), "END"]
        s = sum(math.log10(q(u, x) if bi[u, x] else alpha.get(u, 1) * p(x)) for u, x in zip(["START", *w[:-1]], w, strict=True))
        out.append((i, held(i), len(w), sum(uni[x] > 0 for x in w), n, sum(math.log10((uni[x] + 1) / (n + v + 1)) for x in w), s))
    return out


@pytest.mark.parametrize("sizes", [{"hot_words": 4, "dictionary": 8, "block_tokens": 500, "part_tokens": 2000}, {}])
def test_katz(spark, rows, sizes):
    some = [x for x in rows if x[0] != 106]
    got, want = sorted(katz.score(make(spark, some), **sizes).collect(), key=lambda x: (str(x[0]), x[2])), sorted(brute_katz(some), key=lambda x: (str(x[0]), x[2]))
    for a, b in zip(got, want, strict=True):
        assert tuple(a)[:5] == b[:5]
        assert a.base_score == pytest.approx(b[5], rel=1e-6) and a.score == pytest.approx(b[6], rel=1e-6)


def test_fertility_base(spark, rows):
    got = {(x.doc_id, x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.base_failed) for x in fertility.score(make(spark, [*rows, (200, "a b c d a b c\nx # <\nx # <\n\n\n", "en", "s")])).collect()}
    want = set()
    for i, text, *_ in [*rows, (200, "a b c d a b c\nx # <\nx # <\n\n\n", "en", "s")]:
        text = text or ""
        words = WORD.findall(text)
        grams = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
        count = Counter(grams)
        repeat = {k + j for k, g in enumerate(grams) if count[g] > 1 for j in range(3)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        want.add((i, len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeat), len(words) < 50 or 100 * len(repeat) > 50 * len(words)))
    assert got == want


def test_fertility_rejects_junk_and_keeps_prose(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id")
    found = fertility.score(docs).join(docs.select("doc_id", "quality"), "doc_id").where("not base_failed").toPandas()
    assert found[found.quality == 1].kept.mean() > 0.97 and found[found.quality == 0].kept.mean() < 0.1
    assert fertility.keep_good(docs).columns == docs.columns


def test_tokens_are_the_librarys():
    r, encoder = random.Random(2), tokens.Encoder(tokens.default_vocabulary(), kept_words=300)
    letters = "abcXYZ'’\"«».,;!?#$%&*()<|>[]{}-_ \t\n\r\x1c\x85\xa0 éÉeñ́ßİΣσµª0123½²٣漢🙂ﬁ가sDtll"
    words = ["<|endoftext|>", "<|EndOfText|>", "don't", "we'll.", "('s", "x.'s", "..."]
    for _ in range(3000):
        text = "".join(r.choice(letters) if r.random() < 0.85 else r.choice(words) for _ in range(r.randint(0, 14)))
        assert encoder.ids(text).tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_sharding(spark, rows):
    limit = 20_000
    got = sharding.shard(make(spark, rows), limit).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for x in got:
        sizes[(x.depth, x.shard)] += x.bytes
        assert x.key >> (60 - x.depth) == x.shard
    for x in got:
        assert sizes[(x.depth, x.shard)] == x.shard_bytes and (x.shard_bytes <= limit or x.depth == 60)
        if x.depth:  # only oversized buckets split
            assert sum(y.bytes for y in got if y.key >> (61 - x.depth) == x.shard >> 1) > limit


def test_packing(spark, rows):
    docs = make(spark, rows)
    got = packing.pack(docs, capacity=256).collect()
    places = defaultdict(list)
    for x in got:
        places[x.sequence_id].append((x.offset, x.length))
    for spans in places.values():
        at = 0
        for start, length in sorted(spans):
            assert start == at
            at += length
        assert at <= 256
    encoder = tokens.Encoder(tokens.default_vocabulary())
    want = Counter()
    for i, text, *_ in rows:
        ids = np.append(encoder.ids(text), 1).astype("<u4")
        for k in range(0, len(ids), 256):
            want[(i, k // 256, k, len(ids[k : k + 256]), zlib.crc32(ids[k : k + 256].tobytes()))] += 1
    assert Counter((x.doc_id, x.piece, x.start, x.length, x.ids_crc32) for x in got) == want


def test_plan_is_best_fit_decreasing():
    r = random.Random(3)
    for _ in range(20):
        sizes = sorted((r.choice((r.randint(1, 40), 13, 20)) for _ in range(200)), reverse=True)
        rooms = []
        for s in sizes:
            fitting = [k for k, room in enumerate(rooms) if room >= s]
            if fitting:
                rooms[min(fitting, key=lambda k: rooms[k])] -= s
            else:
                rooms.append(40 - s)
        plan = packing.plan_packing(Counter(sizes), 40)
        left = [40] * plan.sequences
        for size in set(sizes):
            for rank in range(sizes.count(size)):
                at = max(k for k in range(len(plan.length)) if (plan.length[k], plan.rank[k]) <= (size, rank))
                left[int(plan.sequence[at] + (rank - plan.rank[at]) // plan.each[at])] -= size
        assert sorted(left) == sorted(rooms)


def test_pii_patterns_and_model(spark, net):
    text = "Mail é.x@y.example.com, 10.0.0.256 1.2.3.4 card 4111 1111-1111 1111 or 4111111111111112 call +1 (017) 555-7713 or +1 23."
    (base, spans), (none, clean) = pii.find([text, "In 1999, 12 of 30 boats (v1.2) came home."], net)
    assert [(s.kind, text[s.start : s.end]) for s in base] == [("email", ".x@y.example.com"), ("ip", "1.2.3.4"), ("card", "4111 1111-1111 1111"), ("phone", "+1 (017) 555-7713")]
    assert set(base) <= set(spans) and not none and not clean
    hidden = "thonon +1 (269) 555-3296 4524132264652876 and onren"
    ((base, spans),) = pii.find([hidden], net)
    assert not base and {s.kind for s in spans} == {"phone", "card"}
    assert pii.redact(hidden, spans) == "thonon [PHONE] [CARD] and onren"
    row = pii.scan(make(spark, [(1, text, "en", "s")]), net).first()
    assert (row.n_email, row.n_ip, row.n_card, row.n_phone) == (1, 1, 1, 1) and row.base_sha256 == hashlib.sha256(b"email:6:22,ip:35:42,card:48:67,phone:93:110").hexdigest()


def test_tagger_learns(net):
    ids, tags = bilstm.examples(400, 99)
    found = bilstm.viterbi(net, net.run(ids.astype(int)))
    assert (found == tags).mean() > 0.97 and (found == tags)[tags > 0].mean() > 0.9


def test_tagger_gradients():
    net = bilstm.Tagger.random(1)
    ids, tags = (x.astype(int) for x in bilstm.examples(3, 9))
    _, grads = bilstm.loss_and_gradients(net, ids, tags)
    for p, g in zip(net.parameters(), grads, strict=True):
        flat, at, old = p.reshape(-1), np.abs(g).argmax(), p.reshape(-1)[np.abs(g).argmax()]
        flat[at] = old + 1e-2
        up = bilstm.loss_and_gradients(net, ids, tags)[0]
        flat[at] = old - 1e-2
        down = bilstm.loss_and_gradients(net, ids, tags)[0]
        flat[at] = old
        assert (up - down) / 2e-2 == pytest.approx(g.reshape(-1)[at], rel=0.02)


def test_store(spark, rows, tmp_path):
    path = str(tmp_path / "store")
    store.write_store(make(spark, rows), path)
    got = store.verify(spark, path).collect()
    encoder = tokens.Encoder(tokens.default_vocabulary())
    ids = {(i, t): np.append(encoder.ids(t), 2).astype("<u4") for i, t, *_ in rows}
    assert all(x.verified for x in got)
    assert Counter((x.doc_id, x.n_tokens, x.ids_crc32) for x in got) == Counter((i, len(ids[i, t]), zlib.crc32(ids[i, t].tobytes())) for i, t, *_ in rows)
    at = 0
    for x in sorted(got, key=lambda x: x.start):
        assert x.start == at
        at += x.n_tokens
    order = [x.doc_id for x in sorted(got, key=lambda x: x.start)]
    assert order[:-1] == sorted(order[:-1]) and order[-1] is None
    chunks = store.read_chunks(spark, path).select("digest").collect()
    assert len(chunks) == len({bytes(c[0]) for c in chunks})
    whole = {x.doc_id: x.ids for x in store.read_ids(spark, path).collect()}
    assert all(whole[i] == ids[i, t].tolist() for i, t, *_ in rows)


def test_store_finds_damage(spark, rows, tmp_path):
    path = str(tmp_path / "store")
    store.write_store(make(spark, rows[:9]), path)
    bad = store.read_chunks(spark, path).toPandas()
    bad["ids"] = [bytes(x[2:]) + bytes(x[:2]) for x in bad["ids"]]
    spark.createDataFrame(bad, "digest binary, n_tokens long, ids binary").write.mode("overwrite").parquet(path + "/chunks")
    assert not any(x.verified for x in store.verify(spark, path).collect())


def test_crc_join():
    a, b = b"some bytes", b"and more of them"
    assert store.crc_join(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_mixing(spark, rows):
    docs = make(spark, rows)
    got, again = (sorted(mixing.mix(docs).collect(), key=str) for _ in range(2))
    assert got == again and len(got) == len(rows)
    sizes = Counter()
    for _, text, _, source in rows:
        sizes[source] += len(WORD.findall(text or ""))
    total = sum(sizes.values())
    target = {s: 0.0 for s in sizes}
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(sorted((s for s in sizes if s is not None)))}
    weight[None] = (1, 2, 3)[len(weight) % 3]
    open_, left = set(sizes), float(total)
    while open_:
        share = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if share * weight[s] > 3 * sizes[s]}
        for s in over or open_:
            target[s] = 3.0 * sizes[s] if over else share * weight[s]
        left -= sum(target[s] for s in over)
        open_ = open_ - over if over else set()
    assert sorted({x.target for x in got}) == pytest.approx(sorted(target.values()))
    for s in sizes:
        mine = [x for x in got if x.target == pytest.approx(target[s]) and x.source_size == sizes[s]]
        assert abs(sum(x.taken for x in mine) - target[s]) <= 2.01 * max(x.size for x in mine)
    assert all(x.taken <= 3 * x.size and x.taken % max(1, x.size) == 0 for x in got)
    assert mixing.apply_mix(docs).count() == sum(x.copies for x in got)


def test_classifier_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    net = bytecnn.learn(docs, labels)
    found = bytecnn.score(docs.join(labels.select("doc_id"), "doc_id"), net).join(labels, "doc_id").where("held_out").toPandas()
    rank, y = found.score.rank(), found.quality
    auc = (rank[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() + 1) / 2) / ((y == 1).sum() * (y == 0).sum())
    assert auc > 0.97 and (found.predicted == y).mean() > 0.95


def test_classifier_reads_every_chunk():
    net = bytecnn.Network.random(3)
    text = prose(random.Random(5), 3000)
    chunks = bytecnn.sample_chunks(text, 10**6).astype(int)
    best = np.full(bytecnn.HIDDEN, -np.inf)
    for c in chunks:
        windows = np.stack([net.embed[c[k * 2 : k * 2 + bytecnn.WIDTH]].ravel() for k in range(bytecnn.FRESH + bytecnn.SHARED)])
        pooled = np.maximum((windows @ net.filters).max(axis=0) + net.filter_bias, 0)
        best = np.maximum(best, np.maximum(pooled @ net.hidden + net.hidden_bias, 0))
    assert net.logit(text) == pytest.approx(float(best @ net.out + net.out_bias[0]), rel=1e-4)
    assert bytecnn.fit([], np.array([], int)).probability("x") == pytest.approx(0.5)


def test_components(spark):
    from tickloom.llm.components import connected_components

    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 200), (200, 100), (5, 5), (300, None)] + [(400, k) for k in range(401, 460)]
    got = {x.node: x.component for x in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 61)}, 100: 100, 200: 100, **{k: 400 for k in range(400, 460)}}
