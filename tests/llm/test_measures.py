"""Personal data, fertility and Merkle trees against plain versions written without the operators' own functions."""

from __future__ import annotations

import hashlib
import math
import random
import re
from base64 import b64encode
from collections import Counter

import numpy as np
import pytest

from tickloom.llm import bilstm, common, fertility, merkle, mixing, pii

PLAIN = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"), "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
SENTENCES = {
    "cyrillic": "Все люди рождаются свободными и равными в своём достоинстве и правах. Они наделены разумом и совестью и должны поступать в отношении друг друга в духе братства.",
    "greek": "Όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια και τα δικαιώματα. Είναι προικισμένοι με λογική και συνείδηση.",
    "arabic": "يولد جميع الناس أحراراً متساوين في الكرامة والحقوق. وقد وهبوا عقلاً وضميراً وعليهم أن يعامل بعضهم بعضاً بروح الإخاء.",
    "hebrew": "כל בני האדם נולדו בני חורין ושווים בערכם ובזכויותיהם. כולם חוננו בתבונה ובמצפון, לפיכך חובה עליהם לנהוג איש ברעהו ברוח של אחווה.",
    "devanagari": "सभी मनुष्यों को गौरव और अधिकारों के मामले में जन्मजात स्वतन्त्रता और समानता प्राप्त है। उन्हें बुद्धि और अन्तरात्मा की देन प्राप्त है।",
    "han": "人人生而自由,在尊严和权利上一律平等。他们赋有理性和良心,并应以兄弟关系的精神相对待。人人有资格享有本宣言所载的一切权利和自由。",
    "kana": "すべての人間は、生まれながらにして自由であり、かつ、尊厳と権利とについて平等である。人間は、理性と良心とを授けられている。",
    "hangul": "모든 인간은 태어날 때부터 자유로우며 그 존엄과 권리에 있어 동등하다. 인간은 천부적으로 이성과 양심을 부여받았다.",
    "thai": "มนุษย์ทั้งปวงเกิดมามีอิสระและเสมอภาคกันในศักดิ์ศรีและสิทธิ ต่างในตนมีเหตุผลและมโนธรรม",
    "latin": "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem.",
}


@pytest.fixture(scope="module")
def texts(spark):
    return {x.doc_id: x.text for x in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}


def plain_spans(text):
    """Kind by kind, by the contract's patterns and rules alone."""
    out = []
    for kind, pattern in PLAIN.items():
        for m in pattern.finditer(text or ""):
            digits = [int(c) for c in m[0] if c.isdigit()]
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card":
                total = sum(d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9) for i, d in enumerate(reversed(digits)))
                if not 13 <= len(digits) <= 19 or total % 10:
                    continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((kind, *m.span()))
    return out


def test_base_spans_of_all_documents(spark, texts):
    got = {x.doc_id: x for x in pii.scan(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()}
    assert got.keys() == texts.keys()
    for i, text in texts.items():
        want = plain_spans(text)
        line = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        n = Counter(k for k, _, _ in want)
        assert (got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone) == (n["email"], n["ip"], n["card"], n["phone"])
        assert got[i].base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert set(filter(None, line.split(","))) <= set(got[i].spans.split(","))


def test_matching_is_that_of_the_patterns():
    r = random.Random(1)
    for _ in range(30_000):
        text = "".join(r.choice("a1.@ -+_(9%b4é") for _ in range(r.randint(0, 40)))
        assert pii.emails(text) == [m.span() for m in PLAIN["email"].finditer(text)], text
        for kind in ("ip", "card", "phone"):
            assert [m.span() for m in pii.PATTERNS[kind].finditer(text)] == [m.span() for m in PLAIN[kind].finditer(text)], text


def test_long_runs_take_linear_time():
    import time

    began = time.perf_counter()
    for text in ("1" * 500_000, "a" * 500_000 + "@", "1." * 200_000, "a@b" * 100_000, "+1 " * 100_000):
        pii.by_pattern(text)
    assert time.perf_counter() - began < 20


def test_windows_near_triggers_give_what_all_windows_give(texts):
    net = bilstm.trained()
    r = random.Random(2)
    some = [t for t in texts.values() if t and len(t) < 3000][:60]
    some += [" ".join(r.choice(("word", "1999", "call", "me@site.org", "x" * 90, "(555) 123-4567", "4111 1111 1111 1111", "10.0.0.1", "Q" * 70 + "7")) for _ in range(60)) for _ in range(20)]
    assert pii.find(some, net) == pii.find(some, net, everywhere=True)


def test_tagger_on_formats_it_was_not_trained_on():
    """Values between words of the test's own, in writings that the training templates lack."""
    net, r = bilstm.trained(), random.Random(4)
    planted = {"phone": ["020 7946 0958 11", "(030) 901820-14", "1.415.555.2671", "+49 (0) 30 901820"], "email": ["first.last%tag@sub-domain.example.museum", "x_y-z@host7.io"], "ip": ["192.168.001.010", "8.8.8.8"], "card": ["4111-1111-1111-1111", "3782 822463 10005"]}
    words = ["lantern", "harbour", "counted", "slowly", "between", "eleven", "boats", "and", "the", "keeper's", "notes"]
    caught, total, wrong = Counter(), Counter(), 0
    for _ in range(300):
        kind = r.choice(list(planted))
        value = r.choice(planted[kind])
        before, after = " ".join(r.choices(words, k=12)), " ".join(r.choices(words, k=12))
        text = f"{before} {value} {after}"
        ((_, spans),) = pii.find([text], net)
        start, end = len(before) + 1, len(before) + 1 + len(value)
        hit = [s for s in spans if s.start < end and start < s.end]
        total[kind] += 1
        caught[kind] += any(s.kind == kind and s.end - s.start >= 0.7 * len(value) for s in hit)
        wrong += len(spans) - len(hit)
    recall = {k: caught[k] / total[k] for k in total}
    assert wrong == 0
    assert min(recall[k] for k in ("email", "ip", "card")) > 0.95 and recall["phone"] > 0.2, recall


def test_fertility_measures_word_by_word(spark, texts):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=fertility.default_vocabulary())
    got = {x.doc_id: x for x in fertility.score(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()}
    for i, text in list(texts.items())[::7]:
        ids, chars = [], 0
        for word in re.findall(r"[^\x20\x09-\x0D]+", text or ""):
            ids += sp.encode(word)
            chars += len(word)
        n = len(ids)
        assert got[i].n_tokens == n
        if n:
            entropy = -sum(c / n * math.log2(c / n) for c in Counter(ids).values())
            share = sum(sp.is_byte(x) for x in ids) / n
            assert np.allclose([got[i].chars_per_token, got[i].byte_share, got[i].token_entropy], [chars / n, share, entropy])


def test_bands_by_script():
    meter = fertility.Meter(fertility.default_vocabulary())
    for name, text in SENTENCES.items():
        assert fertility.script(text) == name
        assert fertility.passes(meter.measure(text), None, text), name
        assert fertility.passes(meter.measure(text), "unknown", text), name
    for text in ("слово " * 200, "λέξη " * 200, "كلمة " * 200, "단어 " * 200, "".join(chr(0x10000 + i * 37 % 60000) for i in range(400))):
        assert not fertility.passes(meter.measure(text), None, text)


def plain_tree(text):
    """Paragraphs by the rules of the docstrings, one byte after the other, and the digests over them."""
    data = (text or "").encode()
    cuts, last = [], 0
    for at in range(1, len(data) + 1):
        line, whole = data[at - 1] == 10, at == len(data)
        space = False
        if data[at - 1] == 32 and at >= 4:
            mixed = (data[at - 2] * 0x9E3779B1 + data[at - 3] * 0x85EBCA77 + data[at - 4] * 0xC2B2AE3D) % 2**32
            space = (mixed >> 16) % merkle.SPACE_CUT == 0
        if line or whole or space and at - last >= merkle.LEAST_BYTES:
            while at - last > merkle.MOST_BYTES:
                blank = data.find(b" ", last + merkle.MOST_BYTES, at - 1)
                if blank < 0:
                    break
                last = blank + 1
                cuts.append(last)
            cuts.append(at)
            last = at
    b2 = lambda x: hashlib.blake2b(x, digest_size=16).digest()
    text_of = lambda x, n: b64encode(x[:n], b"-_").decode().rstrip("=")
    sections, held, tops = [], [], []
    for a, b in zip([0, *cuts], cuts, strict=False):
        held.append((b2(data[a:b]), b - a))
        if held[-1][0][15] % merkle.SECTION_CUT == 0 or b == len(data):
            digest = b2(b"".join(d for d, _ in held))
            tops.append(digest)
            sections.append(f"{text_of(digest, 6)}:" + ",".join(f"{text_of(d, 6)}.{n}" for d, n in held))
            held = []
    return text_of(b2(b"".join(tops)), 16) + "|" + ";".join(sections)


def test_merkle_against_a_plain_tree(spark, texts):
    ordered = sorted(texts, reverse=True)
    got = {x.doc_id: x for x in merkle.against_edits(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()}
    for i, after in list(zip(ordered, [*ordered[1:], ordered[0]], strict=True))[::9]:
        own, nxt = texts[i] or "", texts[after] or ""
        edited = own[: len(own) - len(own) // 2] + nxt[: len(own) // 2]
        assert got[i].n_chars == len(own) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        prints = [plain_tree(t) for t in (own, edited, nxt)]
        assert got[i].fingerprint == prints[0] and got[i].edited_fingerprint == prints[1]
        leaves = [Counter((x.split(".")[0], int(x.split(".")[1])) for part in p.split("|")[1].split(";") if part for x in part.split(":")[1].split(",")) for p in prints]
        for k, value in ((1, got[i].near_edited), (2, got[i].near_next)):
            both = sum(n * size for (_, size), n in leaves[0].items()) + sum(n * size for (_, size), n in leaves[k].items())
            want = 1.0 if prints[0].split("|")[0] == prints[k].split("|")[0] else 2 * sum(n * size for (_, size), n in (leaves[0] & leaves[k]).items()) / both if both else 0.0
            assert value == pytest.approx(want)


def test_mix_keeps_columns_of_any_name(spark):
    rows = [(i, "one two three " * (1 + i % 4), f"s{i % 3}", i, "a", "b", 7, "k", 1) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size long, cell string, _target string, copies int, row_key string, times int")
    times = {x.doc_id: x.copies for x in mixing.mix(docs).collect()}
    got = Counter(tuple(x) for x in mixing.apply_mix(docs).collect())
    assert got == Counter({row: times[row[0]] for row in rows if times[row[0]]})
    assert common.fresh(docs, "size", "other", "other") == ["size_", "other", "other_"]


def test_another_vocabulary_goes_through_the_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    from tickloom.llm import tokens

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["Hello  World, don't\nstop 123", "", None, "Äpfel 漢字 🙂"]
    assert not tokens.word_by_word(path) and tokens.word_by_word(tokens.default_vocabulary())
    want = [Tokenizer.from_file(path).encode(t or "", add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in tokens.Encoder(path).ids_of(texts)] == want


def test_empty_rows_of_one_id_stay_apart(spark):
    from tickloom.llm import store

    docs = spark.createDataFrame([(1, ""), (1, ""), (2, "one two")], "doc_id long, text string")
    got = store.write_and_verify(docs, end_id=None).collect()
    assert sorted((x.doc_id, x.n_tokens, x.verified) for x in got) == [(1, 0, True), (1, 0, True), (2, 2, True)]


def test_packed_sequences_and_shards_can_be_read_back(spark, tmp_path):
    from tickloom.llm import packing, sharding, tokens

    r = random.Random(6)
    rows = [(i, " ".join(f"word{r.randrange(99)}" for _ in range(r.randrange(90))), "s") for i in range(80)] + [(None, None, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    got = packing.sequences(docs, 256).collect()
    encoder, stream = tokens.Encoder(tokens.default_vocabulary()), Counter()
    for _, text, _ in rows:
        stream.update([*encoder.ids(text).tolist(), 1])
    assert all(x.length == len(x.ids) <= 256 for x in got) and Counter(i for x in got for i in x.ids) == stream
    sharding.write_shards(docs, f"{tmp_path}/shards", limit=4000)
    back = spark.read.parquet(f"{tmp_path}/shards")
    assert Counter(tuple(x) for x in back.select("doc_id", "text", "shard").collect()) == Counter(rows)
    sizes = back.groupBy("depth", "shard_").agg({"text": "count"}).count()
    assert sizes > 3
