import random
from collections import Counter, defaultdict

import brute
from tidemark.llm import mixing


def targets(sizes: dict, cap=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = total - sum(cap * sizes[s] for s in full)
        open_ = sum(weight[s] for s in order if s not in full)
        got = {s: cap * sizes[s] if s in full else rest * weight[s] / open_ for s in order}
        over = {s for s in order if s not in full and got[s] > cap * sizes[s]}
        if not over:
            return got
        full |= over


def test_targets_caps_and_reruns(spark):
    rng = random.Random(3)
    texts = [*brute.ODD_TEXTS, *(" ".join(["w"] * rng.randrange(700)) for _ in range(300))]
    sources = [rng.choice(["a", "a", "a", "a", "b", "é", None, "", "z"]) for _ in texts]
    sources[-1] = "tiny"
    texts[-1] = "just three words"
    docs = brute.with_more_columns(brute.documents(spark, texts, sources=sources, ids=[5, 5, *range(10, 8 + len(texts))]))
    mix = mixing.Mix(block_words=32, chunks=8, run=16)
    rows = mixing.mix_documents(docs, mix).collect()
    assert len(rows) == len(texts)
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    by_size = {}
    for s, t in zip(sources, texts):
        sizes[s] += len(brute.words(t))
    want = targets(sizes)
    for r in rows:
        assert 0 <= r.taken <= 3 * r.size
        by_size.setdefault((r.source_size, r.target), 0)
        by_size[r.source_size, r.target] += r.taken
    assert sorted((sizes[s], round(want[s], 6)) for s in sizes) == sorted((n, round(t, 6)) for n, t in by_size)
    for (_, t), got in by_size.items():
        assert abs(got - t) <= 0.5000001
    key = lambda r: tuple(str(x) for x in r)
    again = mixing.mix_documents(docs.repartition(7), mix).collect()
    assert sorted(map(key, rows)) == sorted(map(key, again))


def test_documents_of_the_mix(spark):
    rng = random.Random(4)
    texts = [" ".join(f"w{rng.randrange(99)}" for _ in range(rng.randrange(200))) for _ in range(80)] + [None, ""]
    docs = brute.documents(spark, texts, sources=[rng.choice("aab") for _ in texts])
    mix = mixing.Mix(block_words=16, chunks=4)
    takes = {r.doc_id: (r.size, r.taken) for r in mixing.mix_documents(docs, mix).collect()}
    out = mixing.mixed_documents(docs, mix)
    assert out.columns == docs.columns
    got = defaultdict(int)
    for r in out.collect():
        got[r.doc_id] += len(brute.words(r.text))
        assert r.n_chars == len(r.text)
    assert {d: t for d, (_, t) in takes.items() if t} == {d: n for d, n in got.items() if n}


def test_shards_draw_and_blocks_follow(spark, tmp_path):
    rng = random.Random(8)
    texts = [" ".join(f"d{i}w{k}" for k in range(rng.randrange(150))) for i in range(90)] + [None, "", "x " * 700]
    sources = [rng.choice(["a", "a", "b", None]) for _ in texts]
    docs = brute.with_more_columns(brute.documents(spark, texts, sources=sources))
    mix = mixing.Mix(block_words=16, shard_slots=10, chunks=4, run=8, shard_run=3)
    cut = docs.select("doc_id", "text", "source")
    srcs, _ = mixing._placed(cut, mix, [])
    draws = {(r.src if not r.snull else None, r.shard): r.draws for r in mixing.draw(srcs, mix).collect()}
    rows = mixing.mixed_blocks(docs, mix).orderBy("position").collect()
    assert [r.position for r in rows] == list(range(len(rows))) and all(r.shard == r.position // 10 for r in rows)
    assert Counter((r.source, r.shard) for r in rows) == draws
    # Counts follow the sources' shares, but are drawn: they differ between shards.
    assert all(len({draws.get((s, k), 0) for k in range(len(rows) // 10)}) > 2 for s in ("a", "b"))
    taken, source_of = defaultdict(int), {i: s for i, s in enumerate(sources)}
    passes = defaultdict(list)
    for r in rows:
        words = brute.words(r.text)
        assert len(words) == r.words <= 16
        passes[r.source, getattr(r, "pass")] += words
        for w in words:
            i = int(w[1 : w.index("w")]) if w != "x" else 92
            assert source_of[i] == r.source
            taken[i] += 1
    assert taken == {r.doc_id: r.taken for r in mixing.mix_documents(docs, mix).collect() if r.taken}
    for (s, _), words in passes.items():
        every = Counter(w for i, t in enumerate(texts) if sources[i] == s for w in brute.words(t))
        assert not Counter(words) - every
    mixing.write_blocks(docs, str(tmp_path / "mix"), mix)
    assert spark.read.parquet(str(tmp_path / "mix")).count() == len(rows)


def test_sql_agrees(spark):
    import duckdb
    import pandas as pd

    rng = random.Random(5)
    texts = [None, "", *(" ".join(["w"] * rng.randrange(400)) for _ in range(200)), "same text", "same text", "one two", "six ten"]
    documents = pd.DataFrame({"doc_id": [*range(202), 7, 7, 8, 8], "text": texts, "source": [rng.choice(["a", "a", "b", None]) for _ in texts]})
    mix = mixing.Mix(block_words=32, shard_slots=8, chunks=8, run=16, shard_run=2)
    want = duckdb.sql(mixing.oracle(mix)).df()
    docs = brute.documents(spark, texts, sources=documents["source"].tolist(), ids=documents["doc_id"].tolist())
    got = mixing.mix_documents(docs, mix).toPandas()[list(want.columns)]
    rows = lambda df: sorted(map(str, df.itertuples(index=False, name=None)))
    assert rows(got) == rows(want)


def test_documents_of_the_mix_when_ids_and_texts_repeat(spark):
    docs = brute.documents(spark, ["a b c d e f g"] * 6 + ["h i j k"] * 3 + ["z"], ids=[1, 1, 1, None, None, 2, 3, 3, 3, 4], langs=list("uvwxyzuvwu"), sources=["a"] * 9 + ["b"])
    mix = mixing.Mix(block_words=4, chunks=2)
    rows = [sorted(map(str, mixing.mixed_documents(docs.repartition(n, "lang"), mix).collect())) for n in (1, 5)]
    assert rows[0] == rows[1]
    taken = sum(r.taken for r in mixing.mix_documents(docs, mix).collect())
    assert taken == sum(len(brute.words(r.text)) for r in mixing.mixed_documents(docs, mix).collect())


def test_very_long_text(spark):
    docs = brute.documents(spark, ["w " * 300_000, "v " * 1000], sources=["a", "b"])
    rows = {r.doc_id: r for r in mixing.mix_documents(docs).collect()}
    assert rows[1].taken == 3000 and rows[0].taken == 298_000


def test_empty(spark):
    assert mixing.op2(spark, brute.documents(spark, [])).collect() == []
    rows = mixing.op2(spark, brute.documents(spark, [None, ""])).collect()
    assert [(r.size, r.taken, r.target) for r in rows] == [(0, 0, 0.0)] * 2
    assert mixing.mixed_documents(brute.documents(spark, [None, ""])).collect() == []
