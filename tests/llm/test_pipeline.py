"""The corpus pipeline: its stages one by one against plain Python, and run()."""

from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np

import corpus_pipeline
from tickloom.llm import bilstm, fertility, mixing, pii, tokens

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def five(text):
    words = text.lower().split()
    return {" ".join(words[k : k + 5]) for k in range(len(words) - 4)}


def test_stages_and_run(spark, tmp_path):
    r = random.Random(5)
    base = [x.text for x in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang = 'en' and n_chars between 1200 and 4000").orderBy("doc_id").limit(40).collect()]
    rows = [(i, t, "en", f"s{i % 3}") for i, t in enumerate(base)]
    for i, t in enumerate(base):
        words = t.split(" ")
        words[len(words) // 2] = f"changed{r.randrange(10**6)}"
        rows.append((None if i % 4 == 0 else 100 + i, " ".join(words), "en", "s1"))
    rows += [rows[3], rows[3], (None, base[5] + " mail a.b@example.com", "en", "s0"), (300, "too short", "en", "s0"), (301, None, "en", "s0"), (None, None, None, None)]
    rows = [(*x, None if x[1] is None else len(x[1])) for x in rows]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = [tuple(x) for x in docs.collect()]

    meter = fertility.Meter(fertility.default_vocabulary())
    good = [x for x in rows if not fertility.base_failed(m := meter.measure(x[1])) and fertility.passes(m, x[2], x[1])]
    assert Counter(seen["quality"]) == Counter(good) and len(good) >= 40

    sets, group = [five(x[1]) for x in good], list(range(len(good)))
    for a in range(len(good)):
        for b in range(a):
            if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8 and group[a] != group[b]:
                group = [group[b] if g == group[a] else g for g in group]
    ids = [x[0] for x in seen["near_duplicates"]]
    least = [min((x[0] for x, g in zip(good, group, strict=True) if g == k and x[0] is not None), default=None) for k in set(group)]
    assert Counter(ids) == Counter(least) and len(ids) < len(good) - 20 and set(seen["near_duplicates"]) <= set(good)

    net = bilstm.trained()
    clean = []
    for i, t, lang, source, n in seen["near_duplicates"]:
        new = pii.redact(t, pii.find([t], net)[0][1])
        clean.append((i, new, lang, source, n if new == t else len(new)))
    assert Counter(seen["pii"]) == Counter(clean)

    times = {(x.doc_id, x.size): x.copies for x in mixing.mix(spark.createDataFrame(clean, SCHEMA)).collect()}
    assert sum(times.values()) == len(seen["mix"]) and set(seen["mix"]) <= set(clean)

    encoder, want = tokens.Encoder(tokens.default_vocabulary()), Counter()
    for i, t, *_ in seen["mix"]:
        got = np.append(encoder.ids(t), 1).astype("<u4")
        want.update((i, k // 4096, k, len(got[k : k + 4096]), zlib.crc32(got[k : k + 4096].tobytes())) for k in range(0, len(got), 4096))
    assert Counter(x[:5] for x in seen["pack"]) == want
    assert Counter(tuple(x)[:5] for x in corpus_pipeline.run(spark, str(tmp_path)).collect()) == want
