import random

import brute
import pytest
import tidemark.llm.jaccard as jaccard
from tidemark.llm import windows
from tidemark.llm.components import components


@pytest.mark.parametrize("seed", [0, 1])
def test_equals_brute_force(spark, monkeypatch, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)]
    base = [[rng.choice(words) for _ in range(rng.randrange(3, 90))] for _ in range(6)]
    texts = list(brute.ODD_TEXTS)
    for _ in range(120):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            w[rng.randrange(len(w))] = rng.choice(words)
        if rng.random() < 0.3:
            w = w[: max(1, len(w) - rng.randrange(8))]
        texts.append(" ".join(w).upper() if rng.random() < 0.2 else " ".join(w))
    monkeypatch.setattr(windows, "PACK", 15)
    docs = brute.with_more_columns(brute.documents(spark, texts))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.op10(spark, docs).collect()}
    assert got == brute.jaccard_components(list(enumerate(texts)))


@pytest.mark.parametrize("seed, block", [(0, 2000), (1, 2000), (0, 5), (1, 5)])
def test_small_packs_and_cells_equal_brute_force(spark, monkeypatch, seed, block):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)]
    base = [[rng.choice(words) for _ in range(rng.randrange(3, 90))] for _ in range(6)]
    texts = list(brute.ODD_TEXTS)
    for _ in range(120):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            w[rng.randrange(len(w))] = rng.choice(words)
        if rng.random() < 0.3:
            w = w[: max(1, len(w) - rng.randrange(8))]
        texts.append(" ".join(w).upper() if rng.random() < 0.2 else " ".join(w))
    monkeypatch.setattr(windows, "PACK", 7)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    docs = brute.with_more_columns(brute.documents(spark, texts))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.op10(spark, docs).collect()}
    assert got == brute.jaccard_components(list(enumerate(texts)))


def test_last_search_in_many_cells_loses_no_link(spark, monkeypatch):
    rng = random.Random(3)
    base = [[f"w{rng.randrange(40)}" for _ in range(40)] for _ in range(4)]
    texts = []
    for _ in range(37):
        w = list(rng.choice(base))
        w[rng.randrange(40)] = "x"
        texts.append(" ".join(w))
    sets = [brute.shingles(t) for t in texts]
    want = {(a, b) for b in range(37) for a in range(b) if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])}
    docs = brute.documents(spark, texts).select("doc_id", "text")
    lists = docs.selectExpr("1L as list", "doc_id as did")
    members = docs.selectExpr("doc_id as rep", "doc_id as did")
    comps = spark.createDataFrame([], "node long, comp long")
    for block in (5, 2000):
        monkeypatch.setattr(jaccard, "BLOCK", block)
        rows = jaccard._opened_links(docs, lists, members, comps, jaccard.Join()).collect()
        assert {(min(r), max(r)) for r in rows} == want and want


def test_one_passage_in_every_document_and_a_hot_group(spark, monkeypatch):
    """Shingles of every document, one large group of near copies, one of equal texts, and many rows without an id."""
    rng = random.Random(11)
    passage, base = [f"p{i}" for i in range(25)], [f"b{i}" for i in range(50)]
    texts = [" ".join([*passage, *(f"w{rng.randrange(60)}" for _ in range(rng.randrange(30)))]) for _ in range(60)]
    for _ in range(60):
        w = list(base)
        for _ in range(rng.randrange(4)):
            w[rng.randrange(50)] = f"x{rng.randrange(9)}"
        texts.append(" ".join(w))
    texts += ["same five words in here"] * 30
    monkeypatch.setattr(windows, "PACK", 6)
    monkeypatch.setattr(jaccard, "BLOCK", 9)
    docs = brute.documents(spark, texts + texts[:20], ids=[*range(150), *[None] * 20])
    rows = jaccard.op10(spark, docs).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows if r.doc_id is not None} == brute.jaccard_components(list(enumerate(texts)))
    assert sorted(r.n_shingles for r in rows if r.doc_id is None) == sorted(len(brute.shingles(t)) for t in texts[:20])


def test_very_long_text(spark):
    rng = random.Random(2)
    long = " ".join(f"w{rng.randrange(10**6)}" for _ in range(100_000))
    rows = jaccard.op10(spark, brute.documents(spark, [long, "x " + long, "short one"])).orderBy("doc_id").collect()
    assert [(r.n_shingles > 99_000, r.component_id) for r in rows] == [(True, 0), (True, 0), (False, 2)]


def test_ids_null_and_repeated(spark):
    docs = brute.documents(spark, ["a b c d e", "a b c d e", "x y z q r", "x y z q r", "a b c d e"], ids=[7, 3, 7, 9, None])
    rows = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard.op10(spark, docs).collect())
    assert rows == [("3", 2, "3"), ("7", 2, "3"), ("7", 2, "3"), ("9", 2, "3"), ("None", 2, "None")]
    assert jaccard.op10(spark, brute.documents(spark, [])).collect() == []


def test_components_of_paths(spark):
    links = [(i + 1, i) for i in range(1, 40)] + [(100, 101), (103, 101), (7, 7)]
    got = {r.node: r.comp for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, **{i: 100 for i in (100, 101, 103)}}
