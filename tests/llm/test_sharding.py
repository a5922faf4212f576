from collections import Counter

import brute
import pytest
from tidemark.llm import sharding


def test_fill_is_even_and_stable():
    a, b = sharding.fill(16, 4093), sharding.fill(17, 4093)
    sizes = Counter(a).values()
    assert set(a) == set(range(16)) and max(sizes) - min(sizes) <= 1
    assert sum(x != y for x, y in zip(a, b) if y != 16) < 0.1 * 4093
    with pytest.raises(ValueError):
        sharding.fill(4, 100)


def test_assign_and_cases(spark):
    docs = brute.with_more_columns(brute.documents(spark, ["a"] * 50, ids=[None, 7, 7, *range(100, 147)]))
    out = sharding.assign(docs, "doc_id")
    rows = out.collect()
    assert len(rows) == 50 and set(out.columns) == set(docs.columns) | {"input_slot", "input_shard"}
    assert {(r.input_slot, r.input_shard) for r in rows} == {(7, 7)}
    assert len({r.shard for r in rows if r.doc_id == 7}) == 1
    table = sharding.fill(sharding.SHARDS, sharding.SLOTS)
    assert all(table[r.slot] == r.shard for r in rows)
    assert sharding.op1(spark, brute.documents(spark, [])).collect() == []


def test_write_shards(spark, tmp_path):
    docs = brute.documents(spark, [f"t{i}" for i in range(60)])
    sharding.write_shards(docs, "doc_id", str(tmp_path / "out"), shards=4, slots=401, files_per_shard=2)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 60 and back.select("shard").distinct().count() == 4
