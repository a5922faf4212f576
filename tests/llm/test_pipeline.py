import random

import brute
import corpus_pipeline as p
from pyspark.sql import functions as F
from tidemark.llm import decontamination, mixing, sharding


def sets(text, n=5):
    return brute.shingles(text, n)


def test_stages_against_plain_python(spark, tmp_path):
    rng = random.Random(6)
    words = [f"word{i}" for i in range(300)]
    say = lambda n: [rng.choice(words) for _ in range(n)]
    items = [(i, " ".join(say(20))) for i in range(3)]
    texts = [*brute.ODD_TEXTS, *(" ".join(say(rng.randrange(6, 120))) for _ in range(60))]
    texts += [t + " more" for t in texts[-10:]] + [texts[-3]] * 4
    texts += [" ".join(say(30)) + " " + items[i % 3][1] for i in range(6)]
    docs = brute.documents(spark, texts, sources=[rng.choice(["a", "a", "b", None]) for _ in texts]).withColumnRenamed("n_chars", "n_chars")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    stages, ins, outs, d = [f for _, f in p.STAGES], [], [], spark.read.parquet(str(tmp_path / "documents.parquet"))
    for k, f in enumerate(stages):
        ins.append(d.collect())
        f(spark, d, str(tmp_path)).write.parquet(str(tmp_path / f"out{k}"))
        d = spark.read.parquet(str(tmp_path / f"out{k}"))
        outs.append(d.collect())
        if k < len(stages) - 1:
            assert d.columns == docs.columns
    assert {r.doc_id for r in outs[0]} == {r.doc_id for r in ins[0] if any(c.isalpha() for c in r.text or "")}
    ids = sorted(r.doc_id for r in ins[1])
    s = {r.doc_id: sets(r.text) for r in ins[1]}
    links = [(a, b) for a in ids for b in ids if a < b and s[a] and s[b] and 100 * len(s[a] & s[b]) >= 80 * len(s[a] | s[b])]
    comp = brute.components(ids, links)
    assert sorted(r.doc_id for r in outs[1]) == [i for i in ids if comp[i] == i] and len(outs[1]) < len(ids)
    dirty = brute.decontaminate([(r.doc_id, r.text) for r in ins[2]], items)
    assert {r.doc_id for r in outs[2]} == {i for i, x in dirty.items() if not x[4]} != set(dirty)
    takes = {r.doc_id: r.taken for r in mixing.mix_documents(spark.read.parquet(str(tmp_path / "out2"))).collect()}
    got = {}
    for r in outs[3]:
        got[r.doc_id] = got.get(r.doc_id, 0) + len(brute.words(r.text))
    assert got == {i: n for i, n in takes.items() if n}
    table = sharding.fill(sharding.SHARDS, sharding.SLOTS)
    assert len(outs[4]) == len(outs[3]) and all(table[r.slot] == r.shard for r in outs[4])
    assert decontamination.WINDOW == 10


def test_empty_and_repeated(spark):
    docs = brute.documents(spark, ["alpha beta gamma delta epsilon"] * 3 + ["other words in here now"], ids=[1, 1, 2, None])
    rows = p.drop_near_duplicates(spark, docs, "").collect()
    assert sorted(str(r.doc_id) for r in rows) == ["1", "None"]
    assert p.drop_near_duplicates(spark, docs.limit(0), "").collect() == []
    assert p.identify_language(spark, docs.limit(0), "").collect() == []


def test_shared_ids_keep_each_text(spark):
    a, b = "alpha beta gamma delta epsilon zeta", "one two three four five six seven"
    docs = brute.documents(spark, [a, a, b, b, b, "clean words of their own kind", None], ids=[7, 3, 7, 9, 7, 9, None])
    rows = p.drop_near_duplicates(spark, docs, "").collect()
    assert sorted((str(r.doc_id), r.text) for r in rows) == [("3", a), ("7", b), ("9", "clean words of their own kind"), ("None", None)]


def test_run_with_repeated_rows_no_ids_and_clashing_columns(spark, tmp_path):
    item = "one two three four five six seven eight nine ten"
    texts = [item, item, f"before {item} after", "clean words that nobody has seen", "clean words that nobody has seen", None, "", "12 34", "a last clean text of several words"]
    docs = brute.documents(spark, texts, ids=[None, None, 3, 4, 4, 5, 6, 7, 8], langs=[None] + ["en"] * 8, sources=["a"] * 9)
    docs = brute.with_more_columns(docs).withColumns({c: F.lit("x") for c in ("did", "tv", "rn", "start_", "component_id", "wid", "w", "many", "node", "comp")})
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = p.run(spark, str(tmp_path))
    assert set(out.columns) == set(docs.columns) | {"input_slot", "input_shard"}
    rows = out.collect()
    assert {r.doc_id for r in rows} == {4, 8} and all(r.input_slot == 7 and r.did == "x" for r in rows)
    # One source: its target is its size, so that each document comes once.
    assert sorted(r.text for r in rows) == [texts[8], texts[3]]


def test_stages_on_empty_tables(spark, tmp_path):
    docs = brute.documents(spark, [])
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in p.STAGES:
        assert stage(spark, docs, str(tmp_path)).collect() == []
    assert p.run(spark, str(tmp_path)).collect() == []
    some = brute.documents(spark, ["some text", None])
    assert p.decontaminate(spark, some, str(tmp_path)).count() == 2
