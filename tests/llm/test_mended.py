"""Faults that were found and mended: clashing names, shared ids, hashes that clash, texts without spaces."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from tickloom.llm import bytecnn, merkle, shingles, simhash


def prose(r, n):
    return " ".join(f"w{r.randrange(5000)}" for _ in range(n))


def test_columns_named_like_keys_come_out_as_they_are(spark):
    r = random.Random(1)
    a, b = prose(r, 80), prose(r, 80)
    rows = [(1, a, "mine", -5, "x"), (2, a, "yours", 6, "x"), (3, b, "theirs", 7, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _text string, _row long, `_whole` string")
    for keep in (simhash.keep_one, shingles.keep_one):
        got = keep(docs)
        assert got.columns == docs.columns
        assert sorted(tuple(x) for x in got.collect()) == [rows[0], rows[2]]


def test_texts_whose_hashes_clash_stay_apart(spark):
    r = random.Random(2)
    texts = [prose(r, 120) for _ in range(12)]
    near = [" ".join([*t.split()[:-1], "changed"]) for t in texts]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts + near + texts[:3])], "doc_id long, text string")
    plain = {x.doc_id: x.root for x in shingles.classes(docs).collect()}
    for keys in (1, 5):
        got = {x.doc_id: x.root for x in shingles.classes(docs, identity=lambda t: F.pmod(F.xxhash64(t), F.lit(keys))).collect()}
        assert len(got) == 27 and len(set(got.values())) == 12 == len(set(plain.values()))
        assert all(got[k] == got[12 + k] for k in range(12)) and all(got[k] == got[24 + k] for k in range(3))


def test_rows_that_share_an_id_send_one_document(spark, monkeypatch):
    sent = []
    fit = bytecnn.fit
    monkeypatch.setattr(bytecnn, "fit", lambda documents, labels, *a, **kw: (sent.append((len(documents), labels.tolist())), fit(documents, labels, *a, **{**kw, "epochs": 1}))[1])
    rows = [(1, f"text number {k % 3}") for k in range(500)] + [(2, "another text"), (None, "no id"), (3, None), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (3, 1), (None, 1), (4, 7)], "doc_id long, quality int")
    held = {x.doc_id for x in docs.where(bytecnn.is_held_out()).select("doc_id").distinct().collect()}
    bytecnn.learn(docs, labels, bytecnn.Sample(documents=5, chunks=2))
    assert sent[0][0] == len({1, 2, 3} - held) and sorted(sent[0][1]) == sorted({1: 1, 2: 0, 3: 1}[i] for i in {1, 2, 3} - held)
    again = bytecnn.learn(docs.repartition(7), labels, bytecnn.Sample(documents=5, chunks=2))
    assert sent[1] == sent[0] and again.probability("x") == bytecnn.learn(docs, labels, bytecnn.Sample(documents=5, chunks=2)).probability("x")


def test_texts_without_spaces_are_cut_between_characters():
    r = random.Random(3)
    signs = lambda n: "".join(chr(r.randint(0x4E00, 0x9000)) for _ in range(n))
    text = signs(2400)
    edited = text[:1200] + signs(1200)
    a, b = merkle.tree(text), merkle.tree(edited)
    assert 0.3 < merkle.likeness(a, b) < 0.7
    (start, end), = merkle.changed(a, b)
    assert 3000 < start <= 3600 and end == len(text.encode())
    moved = merkle.tree(signs(5) + text)  # cuts follow the text, not its place
    assert merkle.likeness(a, moved) > 0.9
    mixed = ("word " * 50 + text + " ") * 2
    for whole in (text, mixed, "é" * 3000, "x" * 5000, "🙂" * 900):
        data = whole.encode()
        ends = merkle._cuts(data)
        assert ends[-1] == len(data) and ends == sorted(set(ends))
        for start, end in zip([0, *ends], ends):
            data[start:end].decode()
