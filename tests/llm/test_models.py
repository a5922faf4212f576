import random
import zlib

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F
from tidemark.llm import bitslice, language, quality

SYLLABLES = {"en": ["the", "ing", "th", "er", "and", "wh"], "fr": ["eau", "oi", "ê", "ou", "que", "é"], "ru": ["при", "вет", "мир", "да"]}


def say(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def test_language_held_out_accuracy_and_cases(spark):
    rng = random.Random(1)
    langs = [rng.choice(list(SYLLABLES)) for _ in range(300)]
    texts = [say(rng, k, rng.randrange(5, 80)) for k in langs]
    odd = [None, "", "123 !!", "中文字符", "— … €", "😀", "É"]
    docs = brute.documents(spark, texts + odd, langs=langs + [None] * len(odd))
    rows = {r.doc_id: r for r in language.op8(spark, brute.with_more_columns(docs)).collect()}
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(rows[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in rows)
    assert np.mean([rows[i].lang_pred == langs[i] for i in held]) > 0.97
    assert [rows[300 + i].lang_pred for i in (0, 1, 2, 4, 5)] == ["und"] * 5
    assert rows[303].lang_pred in SYLLABLES and rows[306].lang_pred == "fr"
    assert all(0 <= r.score <= 1 for r in rows.values())


def test_spans_of_mixed_text(spark):
    rng = random.Random(2)
    docs = brute.documents(spark, [say(rng, k, 60) for k in SYLLABLES for _ in range(30)], langs=[k for k in SYLLABLES for _ in range(30)])
    model = language.train(docs, F.lit(True))
    a, b = say(rng, "en", 40), say(rng, "fr", 40)
    rows = language.spans(brute.documents(spark, [f"{a} {b}", None]), model).orderBy("at").collect()
    assert [r.lang for r in rows] == ["en", "fr"]
    assert abs(rows[1]["at"] - len(a) - 1) < 20


def test_scripts_after_general_punctuation(spark):
    rng = random.Random(7)
    word = lambda lo, hi: "".join(chr(rng.randrange(lo, hi)) for _ in range(rng.randrange(2, 7)))
    ranges = {"ber": (0x2D30, 0x2D68), "cop": (0x2C80, 0x2CE4), "glag": (0x2C00, 0x2C5F)}
    text = {k: lambda k=k: " ".join(word(*ranges[k]) for _ in range(20)) for k in ranges} | {"en": lambda: say(rng, "en", 20) + " — … “x” ⼀"}
    langs = [k for k in text for _ in range(30)] + ["en"] * 60
    docs = brute.documents(spark, [text[k]() for k in langs], langs=langs)
    rows = {r.doc_id: r for r in language.op8(spark, docs).collect()}
    assert all(rows[i].lang_pred == k and rows[i].score > 0.9 for i, k in enumerate(langs))
    signs = "— ⁂ ⯿ ⸺ ⼀ ⵰ ⳾ ⳥"
    assert not language.letters(np.frombuffer(signs.encode(), np.uint8)).any()
    of = lambda t: language.word_scripts(np.frombuffer(t.encode(), np.uint8), np.array([0]), None)[0]
    assert [of(t) for t in ("ⱡa", "ⰰ", "ⲁ", "ⴀ", "ⴰ", "ⶀ", "вⷠ")] == [1, 15, 16, 9, 17, 9, 3]


def test_viterbi_is_best():
    rng = np.random.default_rng(1)
    for _ in range(60):
        n = rng.integers(0, 30, rng.integers(1, 8))
        first, switch = np.concatenate([[0], np.cumsum(n)]), rng.choice([2.0, 8.0, 20.0])
        scores = rng.normal(0, rng.choice([0.5, 3, 8]), (first[-1], rng.integers(1, 5))).astype(np.float32)
        for labels in (language.label_words(scores, first, switch), language.viterbi(scores, first, switch)):
            for i in np.flatnonzero(n):
                w = np.arange(first[i], first[i + 1])
                got = scores[w, labels[w]].sum() - switch * (np.diff(labels[w].astype(int)) != 0).sum()
                best = scores[w[0]].astype(float)
                for x in w[1:]:
                    best = np.maximum(best, best.max() - switch) + scores[x]
                assert abs(got - best.max()) < 1e-3


def plain_language(train, texts, switch=language.SWITCH):
    """Word by word and trigram by trigram, from the operator's description, for texts of a-z and spaces."""
    langs = sorted({k for _, k in train})
    number = lambda a, b, c: (((ord(a) if a else 0) << 16 | ord(b) << 8 | (ord(c) if c else 0)) * 2654435761 % 2**32) >> 16
    grams = lambda w: [number(w[i - 1] if i else "", w[i], w[i + 1] if i + 1 < len(w) else "") for i in range(len(w))]
    counts = np.zeros((len(langs), language.GRAMS))
    for t, k in train:
        for w in t.split():
            for g in grams(w):
                counts[langs.index(k), g] += 1
    logs = np.log((counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * language.GRAMS))
    out = []
    for t in texts:
        path, best = [], np.zeros(len(langs))
        for i, w in enumerate(t.split()):
            stay = best >= best.max() - switch if i else np.ones(len(langs), bool)
            path.append(np.where(stay, np.arange(len(langs)), best.argmax()))
            best = np.maximum(best, best.max() - switch) * (i > 0) + sum(logs[:, g] for g in grams(w))
        if not path:
            out.append(("und", 0.0))
            continue
        at, labels = int(best.argmax()), []
        for back in reversed(path):
            labels.append(at)
            at = int(back[at])
        n = np.bincount(labels, minlength=len(langs))
        out.append((langs[int(n.argmax())], n.max() / n.sum()))
    return out


def ascii_rows(rng, langs, n, most=40):
    kinds = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(3)) for _ in range(langs)]
    say = lambda k, m: " ".join("".join(rng.choice([k, k[::-1], k[:2]]) for _ in range(rng.randrange(1, 4))) for _ in range(m))
    picked = [i % langs if i < langs else rng.randrange(langs) for i in range(n)]
    return [say(kinds[k], rng.randrange(1, most)) for k in picked], [f"l{k:03d}" for k in picked], lambda k, m: say(kinds[k], m)


def test_language_equals_plain_code(spark):
    rng = random.Random(12)
    texts, langs, say = ascii_rows(rng, 5, 160)
    texts += [say(rng.randrange(5), 30) + " " + say(rng.randrange(5), 30) for _ in range(30)] + ["", "1 2 3"]
    langs += [None] * 32
    docs = brute.documents(spark, texts, langs=langs, ids=[*range(150), *range(10), *range(160, 192)])
    rows = docs.collect()
    train = [(r.text, r.lang) for r in rows if r.lang is not None and zlib.crc32(str(r.doc_id).encode()) % 4 != 2]
    want = plain_language(train, [r.text.replace("1 2 3", "") for r in rows])
    got = sorted((r.doc_id, r.lang_pred, round(r.score, 9)) for r in language.op8(spark, docs).collect())
    assert got == sorted((r.doc_id, k, round(x, 9)) for r, (k, x) in zip(rows, want))


def test_three_hundred_languages(spark):
    texts, langs, _ = ascii_rows(random.Random(4), 300, 2400)
    docs = brute.documents(spark, texts, langs=langs)
    model = language.train(docs, F.lit(True))
    assert len(model.langs) == 300
    got = [r.lang_pred for r in language.identify(docs, model, F.lit(False)).orderBy("doc_id").collect()]
    want = [k for k, _ in plain_language(list(zip(texts, langs)), texts[:60])]
    assert got[:60] == want and np.mean([a == b for a, b in zip(got, langs)]) > 0.8


def test_slices_change_no_score(spark, monkeypatch):
    rng = random.Random(8)
    texts = [say(rng, k, rng.randrange(60)) for k in SYLLABLES for _ in range(20)] + ["мир" * 300 + " the " + "x" * 900, "a" * 64, "b" * 65, ""]
    docs = brute.documents(spark, texts, langs=[k for k in SYLLABLES for _ in range(20)] + [None] * 4)
    model = language.train(docs, F.lit(True))
    raw = [t.encode() for t in texts]
    data, ends = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in raw])])
    start, want, known = model.scores(data, ends)
    for most in (1, 7, 64, 1000):
        monkeypatch.setattr(language, "SLICE", most)
        at, got, there = model.scores(data, ends)
        assert (at == start).all() and (there == known).all() and np.allclose(got, want, rtol=1e-5, atol=1e-3)
        assert (language.train(docs, F.lit(True)).logs == model.logs).all()


def test_no_training_rows(spark):
    docs = brute.documents(spark, ["some text"], langs=[None])
    assert [tuple(r) for r in language.op8(spark, docs).select("lang_pred", "score").collect()] == [("und", 0.0)]
    assert language.op8(spark, brute.documents(spark, [])).collect() == []


def test_quality_held_out_accuracy_and_cases(spark):
    rng = random.Random(3)
    good = [rng.random() < 0.8 for _ in range(400)]
    texts = [say(rng, "en", rng.randrange(20, 90)) if g else "".join(w + rng.choice(["***", "$$$", "%%%"]) + " " for w in say(rng, "en", 30).split()) for g in good]
    docs = brute.documents(spark, [*texts, None, "", "x" * 2000, "zz"])
    labels = spark.createDataFrame([(i, int(g), 0) for i, g in enumerate(good)] + [(0, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    rows = {r.doc_id: r for r in quality.op5(spark, brute.with_more_columns(docs), labels).collect()}
    held = [i for i in range(400) if rows[i].held_out]
    assert held == [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([rows[i].predicted == good[i] for i in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows.values()) and len(rows) == 404
    assert {r.score for r in quality.op5(spark, docs, labels.limit(0)).collect()} == {0.5}


def plain_probability(net, text):
    """A text's probability by a plain convolution, chunk by chunk."""
    x = [*text, *[0] * quality.WIDTH]
    z = np.array([sum(net.table[w][x[i + w]].astype(float) for w in range(quality.WIDTH)) for i in range(len(text))]).reshape(len(text), quality.FILTERS)
    pooled = [z[i : i + quality.CHUNK].max(axis=0) for i in range(0, len(text), quality.CHUNK)]
    h = np.tanh(np.concatenate([np.max(pooled, axis=0), np.mean(pooled, axis=0)])) if pooled else np.zeros(2 * quality.FILTERS)
    return 1 / (1 + np.exp(-(h @ net.out + net.bias)))


def test_quality_equals_plain_code(spark):
    rng = random.Random(5)
    texts = [say(rng, "fr", rng.randrange(90)) + rng.choice(["", "***"]) * rng.randrange(9) for _ in range(60)] + [None, "", "y", "z" * 256, "é" * 700]
    ids = [*range(60), 7, 61, 62, 63, None]
    docs = brute.documents(spark, texts, ids=ids)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)] + [(4, 1, 0), (4, 0, 0)], "doc_id long, quality int, toxic int")
    net = quality.train(docs, labels, quality.remainder(5) != 0)
    of = {}
    for i, t in zip(ids, texts):
        if i is not None and i < 60 and zlib.crc32(str(i).encode()) % 5:
            of[i] = min(x for x in (t, of.get(i)) if x is not None)
    by_id = sorted(of)
    again = quality.Network().fit([of[i].encode() for i in by_id], [1 if i == 4 else i % 2 for i in by_id])
    assert np.allclose(net.table, again.table) and np.allclose(net.out, again.out)
    want = sorted((str(i), plain_probability(net, (t or "").encode())) for i, t in zip(ids, texts))
    got = sorted((str(r.doc_id), r.score, r.predicted) for r in quality.op5(spark, docs, labels).collect())
    assert [(i, p) for i, _, p in got] == [(i, int(x >= 0.3)) for i, x in want] and np.allclose([x for _, x, _ in got], [x for _, x in want], atol=1e-6)


def test_blocks_change_no_response(monkeypatch):
    net, rng = quality.Network(), np.random.default_rng(6)
    texts = [rng.integers(0, 256, n).astype(np.uint8) for n in (0, 5, 256, 1300, 252, 40_000)]
    data, ends = np.concatenate(texts), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    want = net.chunks(data, ends, places=True)
    for block in (1, 2, 1000):
        monkeypatch.setattr(quality, "BLOCK", block)
        got = net.chunks(data, ends, places=True)
        assert (got[0] == want[0]).all() and (got[1] == want[1]).all() and (got[2][0] == want[2][0]).all()


def test_chunks_cover_every_byte():
    """A text's response is that of a plain convolution over all of its bytes."""
    net, rng = quality.Network(), np.random.default_rng(5)
    texts = [rng.integers(1, 256, n).astype(np.uint8) for n in (0, 1, 3, 252, 253, 255, 256, 257, 511, 512, 513, 2000)]
    pooled, first, _ = net.chunks(np.concatenate(texts), np.concatenate([[0], np.cumsum([len(t) for t in texts])]))
    for i, t in enumerate(texts):
        if len(t):
            x = np.concatenate([t, np.zeros(quality.WIDTH, np.uint8)])
            want = max_of = sum(net.table[w][x[w : w + len(t)]] for w in range(quality.WIDTH)).max(axis=0)
            assert np.allclose(pooled[first[i] : first[i + 1]].max(axis=0), want, atol=1e-5) and max_of is want
            assert first[i + 1] - first[i] == -(-len(t) // quality.CHUNK)
    assert first[1] == 0


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    vecs = [[float(np.float32(x)) for x in rng.choice([-0.5, -0.2, 0.0, 0.02, 0.3, 9.0], 6)] for _ in range(230)]
    rows = [(i, v) for i, v in enumerate(vecs)] + [(300, None), (320, [1.0, None]), (340, [float("nan"), 1.0]), (360, [float("inf")]), (None, [1.0]), (380, [0.25, -1.0]), (400, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1)).withColumn("rank", F.lit(1))
    good = {i: [int(np.floor(64 * x)) for x in v] for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    want = set()
    for q in good:
        if q % 20 == 0:
            dot = lambda a, b: sum(x * y for x, y in zip(a, b))
            best = sorted((-dot(good[q], good[c]), c) for c in good if c != q)[:20]
            want |= {(q, r + 1, c, -s) for r, (s, c) in enumerate(best)}
    got = bitslice.top_k(df, F.col("vec_id") % 20 == 0, block_rows=64, block_queries=4)
    assert {tuple(r) for r in got.collect()} == want
    assert {tuple(r) for r in bitslice.op3(spark, df).collect()} == want
    assert bitslice.op3(spark, df.limit(0)).collect() == []


def test_few_candidates(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (2, [2.0]), (2, [3.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in bitslice.op3(spark, df).orderBy("rank").collect()] == [(0, 1, 1, 8192), (0, 2, 2, 8192)]


def test_large_components_are_exact(spark):
    rows = [(0, [0.03125, 1.0, 0.0]), (1, [2e16, -3.0, 0.0]), (2, [2e16, 1.0, -5e25]), (3, [6e6, 7e6, 3e30]), (4, [5e6, 7e6, 0.0]), (5, [4.2e6, -2e7, 1.0]), (20, [-0.03125, 7e7, 0.0])]
    vecs = {i: [int(np.floor(64.0 * float(np.float32(x)))) for x in v] for i, v in rows}
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    want = set()
    for q in (0, 20):
        best = sorted((-sum(x * y for x, y in zip(vecs[q], vecs[c])), c) for c in vecs if c != q)
        want |= {(q, r + 1, c, -s) for r, (s, c) in enumerate(best)}
    assert max(abs(w[3]) for w in want) < 2**63
    assert {tuple(r) for r in bitslice.op3(spark, df).collect()} == want
    assert {tuple(r) for r in bitslice.top_k(df, F.col("vec_id") % 20 == 0, block_rows=2, block_queries=1).collect()} == want


def test_a_score_beyond_a_long_is_an_error(spark):
    df = spark.createDataFrame([(0, [1e12]), (1, [1e12])], "vec_id long, embedding array<float>")
    with pytest.raises(Exception, match="does not fit a long"):
        bitslice.op3(spark, df).collect()
