"""What the findings of round 3 on budgets ask for, as counts that do not depend on the machine."""

from __future__ import annotations

import os
import pickle
import random
from collections import defaultdict
from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from tickloom.llm import katz, repeats, tokens
from tickloom.llm.common import shared_dir


def test_a_word_that_texts_share_is_looked_up_once(monkeypatch):
    """op6, op8: of texts encoded together, each different word is looked up once, however often and in however many of them it stands."""
    asked = []
    find = tokens._Known.find
    monkeypatch.setattr(tokens._Known, "find", lambda self, things: asked.append((self, len(things))) or find(self, things))
    encoder = tokens.Encoder(tokens.default_vocabulary())
    texts = ["the cat and the dog " * 500, "the dog, the cat", None, "  \t\n", "and the"] * 20
    found = encoder.ids_of(texts)
    assert sum(n for known, n in asked if known is encoder.words) == 5
    whole = tokens._tokenizer(tokens.default_vocabulary())
    assert [x.tolist() for x in found] == [whole.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_words_are_parted_at_ascii_white_space_alone():
    texts = [" a \x0b b\x1c\x85c\n\n", "", None, "　x y z ", "\ud800 q", "end\r\n\f", "\x1d\x1e", "x" * 70_000 + " y"]
    data = [(t or "").encode("utf-8", "replace") for t in texts]
    words, at, counts = tokens.different(data)
    rows = [t.split() for t in data]
    assert counts.tolist() == [len(x) for x in rows] and len(set(words)) == len(words)
    assert [words[i] for i in at.tolist()] == [w for x in rows for w in x]
    assert [len(x) for x in tokens.different([b"", b" "])] == [0, 0, 2]


def test_blocks_hash_a_word_once_and_send_small_numbers_small(spark, monkeypatch):
    """op3: texts hashed together hash each different word once; a block's messages spell rows, sizes and counts in as few bytes as they need."""
    hashed = []
    real = katz.xxhash.xxh64_intdigest
    monkeypatch.setattr(katz.xxhash, "xxh64_intdigest", lambda x, *a: hashed.append(x) or real(x, *a))
    texts = ["Aa bb aa cc " * 50, None, "bb  AA\n", "é bb"]
    found = [x.tolist() for x, _ in katz.token_hashes(texts)]
    assert sorted(hashed) == sorted([b"aa", b"bb", b"cc", "é".encode()])
    assert found == [[real(w) for w in (t or "").encode().lower().split()] for t in texts]
    r = random.Random(4)
    docs = spark.createDataFrame([(i, " ".join(f"w{r.randrange(40)}" for _ in range(30))) for i in range(60)], "doc_id long, text string")
    uni = katz.summarise(katz.count_words(docs, 7, 2, 300), 20, 8)
    sent = [pickle.loads(x["data"]) for x in katz.make_blocks(docs, uni, 4, 7, 2, 300).collect() if x["kind"].startswith("pairs")]
    assert sent and all(column.dtype.itemsize == 1 for message in sent for column in message[4:])


def test_shortened_hashes_part_runs_and_mix_none():
    """op3: rows of one pair stay in one part and in their order, whatever of its hash is left to sort by."""
    r = np.random.default_rng(3)
    mixed = r.integers(0, 1 << 63, 40, dtype=np.uint64)[r.integers(0, 40, 5000)]
    for parts in (1, 7, 1 << 40):
        part = mixed % np.uint64(parts)
        order = katz._by_part(part, parts, mixed)
        assert sorted(order.tolist()) == list(range(5000)) and (np.diff(part[order].astype(np.int64)) >= 0).all()
        assert all((np.diff(order[mixed[order] == x]) > 0).all() for x in np.unique(mixed))


def test_only_shared_hashes_and_few_others_pass_the_sieve(spark):
    """op12: hashes that no other document has are sieved out before they are dealt; all that are shared pass, even where the sieve is small."""
    r = np.random.default_rng(5)
    known, others = r.integers(-(1 << 63), 1 << 63, 3000), r.integers(-(1 << 63), 1 << 63, 100_000)
    table = spark.createDataFrame([(int(h),) for h in known], "h long")
    sieve = repeats._sieve(table)
    assert repeats._passes(known, sieve).all() and repeats._passes(others, sieve).mean() < 0.1
    small = repeats._sieve(table, 1 << 10)
    assert len(small) == 128 and repeats._passes(known, small).all()
    assert not repeats._passes(others, repeats._sieve(table.limit(0))).any()
    docs = pa.record_batch({"d": [1, 2], "k1": [3, 4], "text": [bytes(range(97, 123)) * 9, b"other " * 60]})
    every = [b.num_rows for b in repeats._hashes(50, False)([docs])]
    none = [b.num_rows for b in repeats._hashes(50, False, SimpleNamespace(value=repeats._sieve(table.limit(0))))([docs])]
    assert every[0] > 0 and none == [0]


def test_shared_hashes_are_found_from_some_four_bytes_a_run(spark):
    """op12: what is exchanged about all runs is four bytes each; hashes of two ids come out, in one slice or in several; those of one id's rows do not, if they are in one slice."""
    r = random.Random(8)
    prose = lambda n: " ".join(r.choice(["river", "stone", "Äpfel", "漢字", "walk"]) + str(r.randint(0, 9999)) for _ in range(n))
    rows = [(i, prose(900).encode()) for i in range(40)] + [(100, b""), (101, b"short")]
    rows += [(200 + i, prose(50).encode() + rows[3][1][:2000]) for i in range(3)] + [(300, rows[9][1]), (400, b"one id's rows " * 40), (400, b"one id's rows " * 40)]
    who = defaultdict(set)
    for d, text in rows:
        for h in repeats.runs_of(text, 50)[2].tolist():
            who[h & ((1 << 42) - 1)].add(d)
    docs, shared = spark.createDataFrame(rows, "d long, text binary"), {h for h, ids in who.items() if len(ids) > 1}
    assert {x.h for x in repeats._seen_twice(docs.coalesce(1), 50).collect()} == shared
    dealt = {x.h for x in repeats._seen_twice(docs.repartition(3), 50).collect()}
    assert shared <= dealt and all(who[h] == {400} for h in dealt - shared)  # rows of one id in several slices: the join that follows is exact
    batch = pa.record_batch({"d": [d for d, _ in rows], "text": [t for _, t in rows]})
    sent = list(repeats._messages(50)([batch]))
    runs = sum(len(repeats.runs_of(t, 50)[0]) for _, t in rows)
    assert sum(len(x) for b in sent for x in b.column("keys").to_pylist()) <= 4.5 * runs
    assert [b.num_rows for b in repeats._messages(50)([batch.slice(40, 2)])] == [0]


def test_tables_on_the_way_go_before_the_next_step(spark):
    """op12: of the tables that it writes only the spans, from which the result is read, are left."""
    folder = shared_dir(spark).removeprefix("file://").removeprefix("file:")
    before = set(os.listdir(folder))
    text = "a passage of over fifty bytes that stands in several documents as it is, word for word"
    rows = repeats.remove_repeats(spark.createDataFrame([(i, f"{i} {text} {i}") for i in range(6)], "doc_id long, text string"))
    assert {x.rsplit("-", 1)[0] for x in set(os.listdir(folder)) - before} == {"spans"}
    assert sorted(len(x.kept) for x in rows.collect()) == [2] * 5 + [len(text) + 4]
