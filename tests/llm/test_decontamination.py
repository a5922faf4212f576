import random

import brute
import corpus_pipeline
from tidemark.llm import decontamination as d


def bench(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def test_equals_brute_force(spark):
    rng = random.Random(9)
    words = ["The", "of", "é", "a1", "RARE", "Straße", "x", "ÉCOLE", "go"]
    say = lambda n: rng.choice([" ", ", ", "-"]).join(rng.choice(words) for _ in range(n))
    items = [(i, say(rng.choice([1, 2, 9, 10, 11, 40]))) for i in range(25)] + [(25, None), (26, "..."), (27, "the of"), (27, "the of"), (None, "rare rare rare")]
    texts = list(brute.ODD_TEXTS)
    for _ in range(150):
        t = say(rng.randrange(60))
        if rng.random() < 0.5:
            t += " " + (rng.choice(items)[1] or "").upper() + " " + say(rng.randrange(9))
        texts.append(t)
    docs = brute.documents(spark, texts)
    got = {r.doc_id: tuple(r)[1:] for r in d.contamination(brute.with_more_columns(docs), bench(spark, items)).collect()}
    want = brute.decontaminate(list(enumerate(texts)), [("null" if i is None else i, t) for i, t in items])
    assert got == want


def test_cases(spark):
    text = "one two three four five six seven eight nine ten"
    docs = brute.documents(spark, [text, "other", text, None], ids=[1, 1, None, None])
    rows = sorted((str(r.doc_id), r.n_words, r.n_hit) for r in d.contamination(docs, bench(spark, [(1, text)])).collect())
    assert rows == [("1", 1, 0), ("1", 10, 10), ("None", 0, 0), ("None", 10, 10)]
    assert d.contamination(brute.documents(spark, []), bench(spark, [(1, text)])).collect() == []
    assert [r.contaminated for r in d.contamination(docs, bench(spark, [])).collect()] == [False] * 4


def test_proximity(spark):
    docs = brute.documents(spark, ["zeta one alpha two beta", "zeta " + "x " * 50 + "alpha beta", "beta zeta alpha", "alpha beta"])
    rows = d.proximity(docs, bench(spark, [(4, "alpha beta zeta")]), within=6, lists=3).collect()
    assert sorted((r.doc_id, r.item, r.start) for r in rows) == [(0, "4", 0), (2, "4", 0)]


def test_repeated_rows_keep_their_results(spark):
    text = "one two three four five six seven eight nine ten"
    docs = brute.documents(spark, [text, text, text, text, text, "other"], ids=[1, 1, 1, None, None, 2])
    rows = sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.contaminated) for r in d.contamination(docs, bench(spark, [(1, text)])).collect())
    assert rows == [("1", 10, 10, 1, True)] * 3 + [("2", 1, 0, 0, False)] + [("None", 10, 10, 1, True)] * 2


def test_pipeline_drops_repeated_contaminated_rows(spark, tmp_path):
    text = "one two three four five six seven eight nine ten"
    bench(spark, [(1, text)]).write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = brute.documents(spark, [text, text, "other"], ids=[None, None, 2])
    assert [r.doc_id for r in corpus_pipeline.decontaminate(spark, docs, str(tmp_path)).collect()] == [2]


def test_proximity_by_default_needs_three_terms(spark):
    docs = brute.documents(spark, ["zeta one alpha two beta", "zeta " + "x " * 50 + "alpha beta", "beta zeta alpha", "alpha beta", "beta zeta", "alpha zeta"])
    rows = d.proximity(docs, bench(spark, [(4, "alpha beta zeta")]), within=6).collect()
    assert sorted((r.doc_id, r.item, r.start) for r in rows) == [(0, "4", 0), (2, "4", 0)]


def test_very_long_text_and_common_terms(spark):
    """An item of words that every document has, and one deep in a long text."""
    rng = random.Random(1)
    item, rare = "the of and to in a is that it was", " ".join(f"r{i}" for i in range(12))
    long = " ".join(rng.choice(item.split()) for _ in range(100_000)) + f" {rare} " + " ".join(["the"] * 5)
    texts = [long, item, "the of and to in a is that it", f"x {rare}"]
    items = [(1, item), (2, rare), (3, rare)]
    got = {r.doc_id: tuple(r)[1:] for r in d.contamination(brute.documents(spark, texts), bench(spark, items)).collect()}
    assert got == brute.decontaminate(list(enumerate(texts)), items) and got[0][2] == 2


def test_few_lists_or_many_give_the_same(spark):
    rng = random.Random(4)
    say = lambda n: " ".join(rng.choice("abcde") for _ in range(n))
    items, texts = [(i, say(12)) for i in range(6)], [say(80) for _ in range(30)]
    texts += [f"{say(5)} {items[i % 6][1]} {say(5)}" for i in range(12)]
    want = brute.decontaminate(list(enumerate(texts)), items)
    for lists in (1, 2, 5, 10):
        assert {r.doc_id: tuple(r)[1:] for r in d.contamination(brute.documents(spark, texts), bench(spark, items), lists=lists).collect()} == want


def test_broadcasts_are_checked_by_rows_and_bytes(spark, monkeypatch):
    from tidemark.llm import common

    df = spark.createDataFrame([(1, "x" * 1000, [1, 2])], "a long, b string, c array<int>")
    hinted = lambda x, *rows: common.broadcast_checked(x, *rows) is not x
    assert hinted(df) and hinted(df.limit(0)) and not hinted(df, 10**9)
    monkeypatch.setattr(common, "BROADCAST_BYTES", 1000)
    assert not hinted(df)
    monkeypatch.setattr(common, "BROADCAST_BYTES", 2000)
    assert hinted(df)
